import hashlib
import itertools
import math
import random
from collections import Counter

import pytest

from sparkloom.operators.sampling import LANES, weighted_sample

KIND = "s string, i long, w double, _x string"


def wait(i, w, seed):
    u = (int(hashlib.md5(f"{seed}|{'n' if i is None else f'v{i}'}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return -math.log(u) / w


def slow(rows, size, seed):
    """Ids of each stratum's sample, in the order of draws."""
    out = {}
    for s, i, w, _ in rows:
        if w is not None and 0 < w < math.inf:
            out.setdefault(s, []).append((wait(i, w, seed), i))
    return {s: [i for _, i in sorted(own)[:size]] for s, own in out.items()}


def drawn(got):
    out = {}
    for r in sorted(got, key=lambda r: r.drawn):
        out.setdefault(r.s, []).append(r.i)
    return out


@pytest.mark.parametrize("size, parts", [(1, 1), (7, 5), (60, 90), (2000, 3)])
def test_sample_equals_sorting_each_stratum(spark, size, parts):
    """A third of the rows share a stratum; some weights can't be drawn; a stratum is null."""
    r = random.Random(size)
    rows = [("hot" if r.random() < 0.34 else r.choice(["a", "b", "c", None]), i, r.choice([None, 0.0, -1.0, math.nan, math.inf, *[r.uniform(0.1, 50)] * 15]), None) for i in range(1500)]
    got = weighted_sample(spark.createDataFrame(rows, KIND).repartition(parts), ["s"], "w", size, ["i"], seed=5)
    assert got.columns == ["s", "i", "w", "_x", "drawn"]
    want = slow(rows, size, 5)
    assert drawn(got.collect()) == want and all(len(v) == min(size, sum(x[0] == s and x[2] is not None and 0 < x[2] < math.inf for x in rows)) for s, v in want.items())


def test_a_larger_size_holds_the_smaller_sample(spark):
    rows = spark.range(500).selectExpr("'s' AS s", "id AS i", "1.0D + id % 9 AS w")
    few, more = (weighted_sample(rows, ["s"], "w", n, ["i"]).collect() for n in (20, 50))
    assert drawn(few)["s"] == drawn(more)["s"][:20]
    other = weighted_sample(rows, ["s"], "w", 20, ["i"], seed=1).collect()
    assert drawn(other) != drawn(few)


def test_rows_are_drawn_by_their_weights_and_chances_are_right(spark):
    """4,000 strata of five rows, two drawn of each: inclusion against all orders of draws, and sums estimated without bias."""
    n, weights = 4000, [1.0, 2.0, 3.0, 6.0, 12.0]
    rows = spark.range(n).selectExpr("id AS s", "explode(array(0, 1, 2, 3, 4)) AS j").selectExpr("s", "j", "array(1.0D, 2.0D, 3.0D, 6.0D, 12.0D)[j] AS w")
    got = weighted_sample(rows, ["s"], "w", 2, ["s", "j"], seed=3, chances=True).collect()
    assert set(Counter(r.s for r in got).values()) == {2} and len(got) == 2 * n
    want = [0.0] * 5
    for a, b in itertools.permutations(range(5), 2):
        p = weights[a] / 24 * weights[b] / (24 - weights[a])
        want[a] += p
        want[b] += p
    for j, count in Counter(r.j for r in got).items():
        assert abs(count / n - want[j]) < 4.5 * math.sqrt(want[j] * (1 - want[j]) / n)
    for value, mean in ((lambda r: 1.0, 5.0), (lambda r: r.j, 10.0), (lambda r: r.w, 24.0)):
        by = Counter()
        for r in got:
            by[r.s] += value(r) / r.chance
        spread = math.sqrt(sum((x - mean) ** 2 for x in by.values()) / n)
        assert abs(sum(by.values()) / n - mean) < 4.5 * spread / math.sqrt(n)


def test_a_whole_stratum_has_chance_one_and_repeated_rows_may_be_drawn_each(spark):
    rows = spark.createDataFrame([("a", 1, 2.0, "x")] * 3 + [("b", None, 1.0, None)], KIND)
    got = weighted_sample(rows, ["s"], "w", 3, ["i"], chances=True).collect()
    assert sorted((r.s, r.i, r.drawn, r.chance) for r in got) == [("a", 1, 1, 1.0), ("a", 1, 2, 1.0), ("a", 1, 3, 1.0), ("b", None, 1, 1.0)]


def test_empty_tables_and_refused_names(spark):
    empty = spark.createDataFrame([], KIND)
    assert weighted_sample(empty, ["s"], "w", 3, ["i"], chances=True).collect() == []
    assert weighted_sample(spark.createDataFrame([("a", 1, None, None)], KIND), [], "w", 3, ["i"]).collect() == []
    with pytest.raises(ValueError):
        weighted_sample(empty.withColumnRenamed("_x", "Drawn"), ["s"], "w", 3, ["i"])
    with pytest.raises(ValueError):
        weighted_sample(empty, ["s"], "w", 0, ["i"])


@pytest.mark.parametrize("size", [10, 5000])
def test_tasks_send_no_more_than_a_sample(spark, size):
    """30,000 rows of one stratum over 70 partitions: what is shuffled is bounded by the size, not by the stratum."""
    rows = spark.range(0, 30_000, 1, 70).selectExpr("concat('s', id div 1000000) AS s", "id AS i", "1.0D + id % 9 AS w", "'' AS _x")
    got = weighted_sample(rows, ["s"], "w", size, ["i"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number(), " + str(size) + ", Partial") == 2 and LANES == 64
    assert got.count() == size
