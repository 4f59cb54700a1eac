"""Query op9_minhash and its SQL, which compares all pairs that share a shingle."""

from sparkloom.llm.minhash import near_groups
from sparkloom.llm.tables import table


def op9_minhash(spark, sf_dir):
    return near_groups(table(spark, sf_dir, "documents")).drop("tag", "text_key")


QUERIES = {"op9_minhash": op9_minhash}
SQL = {
    "op9_minhash": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct([array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)]) END AS s
            FROM words
        ), each AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS h FROM sets),
        links AS (
            SELECT a.doc_id AS x, b.doc_id AS y
            FROM each a JOIN each b ON a.h = b.h AND a.doc_id <> b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
            GROUP BY 1, 2, a.n, b.n
            HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
        ), reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents
            UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
        ), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM sets JOIN least USING (doc_id)
    """
}
