"""Query op2_html. SQL can't express a trained field; its tests hold it against pages whose text is known."""

from sparkloom.llm.html_crf import main_text
from sparkloom.llm.tables import table


def op2_html(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html": op2_html}
SQL = {}
