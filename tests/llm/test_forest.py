import numpy as np
import pytest

from sparkloom.llm import forest
from sparkloom.llm.forest import near_vectors
from tests.llm.test_components import brute as reach

SCHEMA = "vec_id long, embedding array<float>, label int, kept string, tag string, copies string, rep string"


def brute(rows, limit=0.93):
    ok = [e is not None and l is not None and all(c is not None and np.isfinite(c) for c in e) and any(e) for _, e, l in rows]
    n, links = [0] * len(rows), []
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], np.float32).astype(np.float64) for k in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= limit:
                    n[a] += 1
                    n[b] += 1
                    links.append((a, b))
    root = reach(links)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root.get(k, k)] = min(r[0], least.get(root.get(k, k), r[0]))
    return [(r[0], n[k], least.get(root.get(k, k))) for k, r in enumerate(rows)]


def check(spark, rows):
    df = spark.createDataFrame([(*r, "k", "t", "c", "r") for r in rows], SCHEMA).repartition(3)
    got = near_vectors(df).collect()
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted([(g.vec_id, g.n_links, g.component_id) for g in got], key=order) == sorted(brute(rows), key=order)
    for g in got:
        assert not g.kept or g.vec_id == g.component_id
    assert len({g.component_id for g in got if g.kept and g.vec_id is not None}) == sum(g.kept for g in got if g.vec_id is not None)


def vectors(seed, groups, size, noise, dim=16):
    r = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        c = r.normal(size=dim)
        out += [(c + r.normal(size=dim) * noise).astype(np.float32).tolist() for _ in range(r.integers(1, size))]
    return out


def test_odd_vectors(spark):
    one, nan = [1.0, 0.0], float("nan")
    rows = [(1, one, 1), (2, one, 1), (3, one, 2), (4, one, None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [nan, 1.0], 1), (9, [float("inf"), 1.0], 1), (10, [], 1), (11, [2.0, 0.0], 1), (12, [-1.0, 0.0], 1), (13, [1.0, 0.0, 0.0], 1), (2, one, 1), (None, one, 2)]
    check(spark, rows)


def test_empty_table(spark):
    check(spark, [])


@pytest.mark.parametrize("leaf", [512, 20, 4])
def test_groups_large_and_small(spark, monkeypatch, leaf):
    monkeypatch.setattr(forest, "LEAF", leaf)
    monkeypatch.setattr(forest, "BLOCK", 2 * leaf)
    x = vectors(leaf, 40, 8, 0.05) + vectors(1, 1, 90, 0.02) + vectors(2, 2, 20, 0.2)
    x += x[:10]
    check(spark, [(len(x) - i, v, i % 2 if i > 100 else 0) for i, v in enumerate(x)])


def test_subtree_places_and_spill():
    r = np.random.default_rng(0)
    at = r.normal(size=(5000, forest.STEPS)).astype(np.float32)
    cuts = forest.cuts_of(at, 5000, 0.1, forest.LEAF)
    row, place = forest.descend(at, np.tile(cuts, (5000, 1)), np.full(5000, 0.1, np.float32))
    sizes = np.bincount(place)
    assert set(row.tolist()) == set(range(5000)) and sizes.max() <= forest.LEAF and len(row) < 2 * 5000
    assert len(set(zip(row.tolist(), place.tolist()))) == len(row)
    for i, k in list(zip(row.tolist(), place.tolist()))[::97]:  # down the tree by hand
        k, node = k + (1 << forest.STEPS), 1
        for level in range(forest.STEPS):
            if np.isinf(cuts[node]):
                break
            side = (k >> (forest.STEPS - 1 - level)) & 1
            assert at[i, level] > cuts[node] - 0.1 if side else at[i, level] <= cuts[node] + 0.1
            node = 2 * node + side
    same = np.zeros((2000, forest.STEPS), np.float32)  # nothing to split by: one large leaf
    assert np.isnan(forest.cuts_of(same, 2000, 0.1, 512)[1]) and set(forest.descend(same, np.tile(forest.cuts_of(same, 2000, 0.1, 512), (2000, 1)), np.full(2000, 0.1))[1].tolist()) == {0}


def test_recall_at_production_parameters(spark):
    """Spread-out vectors and a tight cluster, with planted pairs just above the limit, against brute force."""
    r = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    spread, center = unit(r.normal(size=(6000, 64))), unit(r.normal(size=64))
    noise = unit(r.normal(size=(3000, 64)))
    tight = unit(center * 0.88**0.5 + noise * 0.12**0.5)
    base = np.concatenate((spread[:500], tight[:200]))
    other = r.normal(size=base.shape)
    other = unit(other - (other * base).sum(1, keepdims=True) * base)
    cosine = r.uniform(0.9305, 0.945, (len(base), 1))
    planted = base * cosine + other * np.sqrt(1 - cosine**2)
    x = np.concatenate((spread, tight, planted)).astype(np.float32)
    rows = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = near_vectors(rows).toPandas().sort_values("vec_id")
    y = unit(x.astype(np.float64))
    want = np.array([int((y[i] @ y.T >= 0.93).sum()) - 1 for i in range(len(y))])
    assert (got.n_links.to_numpy() <= want).all() and got.n_links.sum() >= 0.995 * want.sum() and want.sum() > 1400
