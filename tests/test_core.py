import duckdb

import __spark_entry__
from sparkloom.session import forget, shared_dir, written

SMALL = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_pricing_summary_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{SMALL}/lineitem.parquet'")
    got = __spark_entry__.queries()["pricing_summary"](spark, SMALL).toPandas()
    want = con.sql(__spark_entry__.oracle_sql()["pricing_summary"]).df()
    by = ["l_returnflag", "l_linestatus"]
    assert got.sort_values(by, ignore_index=True).equals(want[got.columns].sort_values(by, ignore_index=True))


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_written_tables_stand_alone_and_go(spark):
    df = written(spark.range(5).selectExpr("id", "id % 2 AS odd"), "numbers")
    assert df.count() == 5 and df.columns == ["id", "odd"]
    assert shared_dir(spark) in df.inputFiles()[0]
    forget(spark)
