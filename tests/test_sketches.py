import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators.queries import sketch_words
from sparkloom.operators.sketches import estimates, rolled_up, sketched, together
from sparkloom.session import written

KIND = "a string, b string, v long, x double, n_rows_ string"
DIMS = ["a", "b"]
SETS = [["a", "b"], ["a"], ["b"], []]


def made(n, seed, values):
    """A third of the rows in one group; nulls in every column."""
    r = random.Random(seed)
    return [("hot" if r.random() < 0.34 else r.choice(["p", "q", None]), r.choice(["x", "y", None]), r.choice([None, *[r.randrange(values)] * 20]), r.choice([None, *[r.uniform(-5, 5)] * 20]), None) for _ in range(n)]


def exact(rows):
    """(a, b, level) -> number of rows, values, sorted x."""
    out = {}
    for a, b, v, x, _ in rows:
        for key in ((a, b, 0), (a, None, 1), (None, b, 2), (None, None, 3)):
            n, values, xs = out.setdefault(key, (0, set(), []))
            out[key] = n + 1, values | {v} if v is not None and v not in values else values, xs
            if x is not None:
                xs.append(x)
    return {k: (n, values, sorted(xs)) for k, (n, values, xs) in out.items()}


def sketch(spark, rows, parts=5):
    return sketched(spark.createDataFrame(rows, KIND).repartition(parts), {d: F.col(d) for d in DIMS}, {"v": F.col("v")}, {"x": F.col("x")})


def test_few_values_are_counted_exactly_in_every_set(spark):
    rows = made(150, 1, 60)
    got = estimates(rolled_up(sketch(spark, rows), DIMS, SETS), (0.0, 0.5, 1.0)).collect()
    want = exact(rows)
    assert {(r.a, r.b, r.level): (r.n_rows, r.n_v, r.q_x) for r in got} == {k: (n, len(v), [xs[0], xs[-(-len(xs) // 2) - 1], xs[-1]] if xs else None) for k, (n, v, xs) in want.items()}


def test_errors_of_many_values_stay_in_their_bounds(spark):
    """60,000 rows, two tables merged: counts within four standard errors of 1.6 %, ranks within 3 %."""
    rows = made(60_000, 2, 40_000)
    halves = [sketch(spark, rows[:20_000]), sketch(spark, rows[20_000:], 3)]
    stored = written(together(halves), "halves")
    up = rolled_up(stored, DIMS, SETS)
    assert up.inputFiles() == stored.inputFiles()  # the rows aren't read again
    got = {(r.a, r.b, r.level): r for r in estimates(up, (0.1, 0.5, 0.9)).collect()}
    want = exact(rows)
    assert got.keys() == want.keys()
    for key, (n, values, xs) in want.items():
        assert got[key].n_rows == n
        assert abs(got[key].n_v - len(values)) <= 4 * 2**-6 * len(values)
        for q, at in zip(got[key].q_x, (0.1, 0.5, 0.9), strict=True):
            assert abs(sum(x <= q for x in xs) / len(xs) - at) < 0.03


def test_theta_doesn_t_depend_on_partitions_below_its_size(spark):
    rows = made(5000, 3, 3000)
    counts = [sorted(map(tuple, estimates(sketch(spark, rows, p)).select("a", "b", "n_rows", "n_v").collect()), key=repr) for p in (1, 9)]
    assert counts[0] == counts[1]


def test_columns_without_values_and_empty_tables(spark):
    rows = [("p", None, None, None, None)] * 3
    table = sketch(spark, rows)
    assert [tuple(r) for r in estimates(together([table, table])).collect()] == [("p", None, 6, 0, None)]
    empty = sketch(spark, [])
    assert estimates(rolled_up(empty, DIMS, SETS)).collect() == [] and estimates(together([empty, table])).count() == 1


def test_refused_names(spark):
    with pytest.raises(ValueError):
        sketched(spark.createDataFrame([], KIND), {"theta_a": F.col("a")}, {})


def test_words_of_documents(spark):
    """The query against exact counts of the whole table."""
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    words = docs.select("lang", "source", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("w")).filter("w <> ''")
    want = {(r.lang, r.source, r.level): r for r in words.groupingSets([["lang", "source"], ["lang"], ["source"], []], "lang", "source").agg(F.grouping_id("lang", "source").alias("level"), F.count("w").alias("n"), F.countDistinct("w").alias("d")).collect()}
    got = {(r.lang, r.source, r.level): r for r in sketch_words(spark, data).collect()}
    assert got.keys() == want.keys() and got
    for key, w in want.items():
        assert got[key].n_rows == w.n and abs(got[key].n_words - w.d) <= 4 * 2**-6 * w.d and 1 <= got[key].median_length <= got[key].ninth_decile
