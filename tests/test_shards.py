import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from sparkloom.sources import queries
from sparkloom.sources.shards import BatchReader, Log, Shard, register, write_shards

KIND = "id long, tag string, x double, long_text string, parts array<string>"


def made(n, seed=1):
    r = random.Random(seed)
    rows = [(i if r.random() > 0.05 else None, r.choice(["a", "b", None]), r.random(), "é" * r.choice([0, 3, 200]), r.choice([None, [], ["u", None]])) for i in range(n)]
    return rows + rows[: n // 10]


same = lambda got, want: sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
files = lambda path: {f for f in os.listdir(f"{path}/data")}
listed = lambda path: {s.file for s in Log(str(path)).shards(Log(str(path)).names())}


def test_rows_come_back_and_a_replayed_write_leaves_each_once(spark, tmp_path):
    rows, path = made(300), str(tmp_path / "t")
    df = spark.createDataFrame(rows, KIND).repartition(3)
    first = write_shards(df, path, "load-1", rows=50)
    assert first.schema == df.schema and same(first.collect(), rows)
    again = write_shards(df, path, "load-1", rows=50)  # as after a driver that stopped before it knew
    assert same(again.collect(), rows) and files(path) == listed(path)
    assert same(write_shards(df, path, "load-2").collect(), rows * 2) and len(Log(path).names()) == 2


def test_a_failed_write_shows_nothing_and_a_repeated_task_shows_once(spark, tmp_path):
    """A UDF fails in one partition after others have written; then each task's first rows are written twice."""
    path = str(tmp_path / "t")
    write_shards(spark.createDataFrame(made(20), KIND), path)
    broken = spark.range(0, 4000, 1, 4).select("id", F.lit("a").alias("tag"), F.when(F.col("id") == 3999, F.raise_error(F.lit("planned"))).otherwise(F.lit(1.0)).cast("double").alias("x"), F.lit("").alias("long_text"), F.array(F.lit("u")).alias("parts"))
    with pytest.raises(Exception, match="planned"):
        write_shards(broken, path, rows=10)
    kept = spark.read.format("shards").load(path)
    assert same(kept.collect(), made(20)) and len(Log(path).names()) == 1
    left = files(path) - listed(path)  # a task's second attempt: files that no commit names
    (tmp_path / "t/data/stray.parquet").write_bytes(b"half")
    assert same(kept.collect(), made(20)) and len(left) < 400


def test_filters_leave_shards_out(spark, tmp_path):
    path = str(tmp_path / "t")
    table = write_shards(spark.range(0, 1000, 1, 10).selectExpr("id", "CAST(id % 7 AS string) AS tag"), path)
    assert table.rdd.getNumPartitions() == 10
    for condition, parts, n in (("id >= 850", 2, 150), ("id = 42", 1, 1), ("id IN (5, 950)", 2, 2), ("id < 100 AND tag = '3'", 1, 14), ("id > 5000", 0, 0), ("tag = 'z'", 0, 0), ("tag IS NULL", 10, 0), ("id % 2 = 0", 10, 500)):
        got = table.filter(condition)
        assert got.count() == n and got.rdd.getNumPartitions() in (parts, max(parts, 1)), condition
    reader = BatchReader(path)
    assert list(reader.pushFilters([GreaterThan(("id",), 899)])) == [GreaterThan(("id",), 899)] and [s.limits["id"] for s in reader.partitions()] == [[900, 999]]


def test_shards_end_by_their_bytes(spark, tmp_path):
    """Rows of a thousand characters in batches of 10,000: each is a shard of its own."""
    rows = spark.range(0, 30_000, 1, 1).select("id", F.rpad(F.col("id").cast("string"), 1000, "é").alias("text"))
    register(spark)
    rows.write.format("shards").option("bytes", "1000000").mode("append").save(str(tmp_path / "t"))
    log = Log(str(tmp_path / "t"))
    shards = log.shards(log.names())
    assert len(shards) >= 3 and sum(s.n for s in shards) == 30_000 == spark.read.format("shards").load(str(tmp_path / "t")).distinct().count()


def test_limits_never_rule_out_what_a_shard_may_hold():
    s = Shard("f", 3, {"a": [3, 9], "none": []})
    held = lambda f: s.may_hold(f)
    assert held(EqualTo(("a",), 3)) and not held(EqualTo(("a",), 2)) and not held(EqualTo(("a",), None)) and not held(EqualTo(("none",), 1))
    assert held(In(("a",), (None, 4))) and not held(In(("a",), (None, 1))) and held(EqualTo(("other",), 1)) and held(EqualTo(("a", "b"), 1))
    assert held(LessThanOrEqual(("a",), 3)) and not held(LessThanOrEqual(("a",), 2)) and not held(GreaterThan(("a",), 9)) and held(GreaterThan(("a",), 8))


def test_a_stream_from_shards_to_shards_over_a_restart_and_a_replay(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run():
        stream = spark.readStream.format("shards").load(source)
        stream.writeStream.format("shards").option("txn", "copy").option("checkpointLocation", check).trigger(availableNow=True).start(target).awaitTermination()
        return spark.read.format("shards").load(target).collect()

    a, b = made(120, 2), made(80, 3)
    write_shards(spark.createDataFrame(a, KIND).repartition(2), source)
    assert same(run(), a)
    write_shards(spark.createDataFrame(b, KIND), source)
    assert same(run(), a + b) and same(run(), a + b)
    last = max((int(f), f) for f in os.listdir(f"{check}/commits") if f.isdigit())[1]
    os.remove(f"{check}/commits/{last}")  # the query stopped after the sink's commit, before its own
    crc = f"{check}/commits/.{last}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert same(run(), a + b) and files(target) == listed(target)


def test_empty_tables_and_refused_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    empty = write_shards(spark.createDataFrame([], KIND), path)
    assert empty.collect() == [] and empty.columns == ["id", "tag", "x", "long_text", "parts"]
    assert write_shards(spark.createDataFrame([(None, None, None, None, None)], KIND), path).filter("id IS NULL").count() == 1
    never_null = spark.createDataFrame([(1, "a", 0.5, "", [])], KIND).withColumn("id", F.lit(7).cast("long"))
    assert write_shards(never_null, path).filter("id = 7").count() == 1
    with pytest.raises(Exception, match="columns differ"):
        write_shards(spark.range(3), path)
    with pytest.raises(Exception, match="append"):
        spark.range(3).write.format("shards").mode("overwrite").save(path)
    register(spark)
    with pytest.raises(Exception, match="nothing is committed"):
        spark.read.format("shards").load(str(tmp_path / "none"))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert same(got.collect(), con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall()) and got.count()
