"""Query op10_licenses and its SQL."""

from sparkloom.llm.licenses import COVERED, NEAR, scan, template_pairs
from sparkloom.llm.tables import table


def op10_licenses(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op10_licenses": op10_licenses}
SQL = {
    "op10_licenses": rf"""
        WITH pairs(template, label, base, pairs, place, first, second) AS (VALUES {", ".join(str(p) for p in template_pairs())}),
        d AS (
            SELECT row_number() OVER () AS tag, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), e AS (SELECT tag, w, unnest(range(len(w) - 1)) AS i FROM d),
        m AS (
            SELECT tag, template, label, base, pairs, i - place AS diagonal, bit_or(CAST(1 AS BIGINT) << place) AS met
            FROM e JOIN pairs ON w[i + 1] = first AND w[i + 2] = second
            GROUP BY ALL
        ), s AS (
            SELECT *, base AND bit_count(met) = pairs AS exact,
                   bit_count(bit_or(met) OVER (PARTITION BY tag, template ORDER BY diagonal RANGE BETWEEN {NEAR} PRECEDING AND {NEAR} FOLLOWING)) / pairs AS covered
            FROM m
        ), a AS (
            SELECT tag, count(*) FILTER (exact) AS n_base, min(diagonal) FILTER (exact) AS first_word, max(diagonal) FILTER (exact) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base_labels,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact OR pairs >= 3 AND covered >= {COVERED}) AS labels,
                   max(CASE WHEN exact THEN 1.0::DOUBLE WHEN pairs >= 3 THEN covered ELSE 0.0 END) AS score
            FROM s GROUP BY tag
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
        FROM d LEFT JOIN a USING (tag)
    """
}
