"""Query op8_forest and its SQL, which compares all pairs of a label."""

from sparkloom.llm.forest import near_vectors
from sparkloom.llm.tables import table


def op8_forest(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_forest": op8_forest}
SQL = {
    "op8_forest": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum([x * x FOR x IN CAST(embedding AS DOUBLE[])])) AS norm
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), links AS (
            SELECT a.vec_id AS x, b.vec_id AS y
            FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.norm > 0 AND b.norm > 0 AND len(a.e) = len(b.e)
            WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
        ), reach(vec_id, other) AS (
            SELECT vec_id, vec_id FROM embeddings
            UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON l.x = r.other
        ), least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY 1),
        degree AS (SELECT x, count(*) AS n FROM links GROUP BY 1)
        SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
        FROM embeddings e JOIN least USING (vec_id) LEFT JOIN degree ON x = e.vec_id
    """
}
