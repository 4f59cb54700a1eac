"""Query op7_langid. SQL can't express a trained classifier; its tests hold it against a slow version and held-out labels."""

from pyspark.sql import functions as F

from sparkloom.llm.langid import held_out, train, with_language
from sparkloom.llm.tables import table


def op7_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    asked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return with_language(asked, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


QUERIES = {"op7_langid": op7_langid}
SQL = {}
