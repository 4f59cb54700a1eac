"""Query op5_chat and its SQL."""

from sparkloom.llm.chat import formatted, read_back
from sparkloom.llm.tables import table


def op5_chat(spark, sf_dir):
    own = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return read_back(formatted(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))


QUERIES = {"op5_chat": op5_chat}
SQL = {
    "op5_chat": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), w AS (
            SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 WHEN 'system' THEN 18 ELSE 16 + length(url_encode(role)) END
                      + length(regexp_replace(text, '(\[|<)(\\*)(/?INST\]|<SYS>>|</SYS>>|/?s>|\|)', '\1\\\2\3', 'g')) AS chars
            FROM t
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
        FROM w GROUP BY conv_id
    """
}
