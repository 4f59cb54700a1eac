"""Near-duplicate embeddings by a forest of random-projection trees.

Equal vectors of a label become one representative. Each of ``TREES`` trees
splits every node of more than ``LEAF`` representatives at the median of a
random projection; what lies within a margin of it goes to both sides (spill).
A node of which more than ``MOST_SPILL`` would go to both sides isn't split
along that direction, so spill can't outgrow what splits gain.

All trees grow together, ``STEPS`` levels a round: the cuts of a node's subtree
are fitted on a sample of about ``SAMPLE`` of its representatives, chosen by a
hash, and every representative descends by them in one pass. A round more is
needed only when nodes hold about 2 ** STEPS times as many. Leaves that stay
too large, such as those of many near copies, are compared in pairs of blocks,
so nothing is capped.

Within a leaf all pairs are compared in double precision. A pair that meets in
several leaves counts in the first of them only, so a leaf gives a number of
links for each vector and a spanning forest, never its pairs. Links found are
exact; two vectors at the limit are parted in one tree of 64 dimensions with a
chance of about 2.5 % a level, and are missed if all trees part them.

Defined results: vectors that are null, zero, or hold null or non-finite
components, and vectors without a label, link with nothing; vectors of
different length never link; repeated rows are vectors of their own and one row
of a component is kept; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.components import components
from sparkloom.session import written

TREES, LEAF, BLOCK = 8, 512, 1024
#: Levels of a round, and rounds at most.
STEPS, TURNS = 6, 4
#: Representatives of a node on which its subtree is fitted, about.
SAMPLE = 8192
LIMIT = 0.93
#: Half the spill, in deviations of the distance between projections of a pair at the limit; and the largest share of a node that may go to both sides.
SPILL, MOST_SPILL = 0.5, 0.25
SEED = 11
NODE = ["label", "dim", "tree", "node"]


def directions(dim: int, turn: int) -> np.ndarray:
    """TREES x dim x STEPS unit vectors along the second axis."""
    r = np.random.default_rng((SEED, dim, turn)).normal(size=(TREES, dim, STEPS))
    return r / np.linalg.norm(r, axis=1, keepdims=True)


def margin(dim: np.ndarray, limit: float) -> np.ndarray:
    return SPILL * np.sqrt(2 * (1 - limit) / dim)


def unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of one length, scaled to length 1 in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def projected(rows: DataFrame, turn: int) -> DataFrame:
    """(rep, label, dim, tree, node, n, at): the projections of each row's vector on the directions of its tree in this round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, trees = batch.column("dim").to_numpy(), batch.column("tree").to_numpy()
            at = np.zeros((batch.num_rows, STEPS), np.float32)
            for dim in np.unique(dims):
                along = directions(int(dim), turn)
                for tree in np.unique(trees[dims == dim]):
                    own = np.flatnonzero((dims == dim) & (trees == tree))
                    at[own] = unit(batch.column("vector").take(pa.array(own))) @ along[tree]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, at.size + 1, STEPS), pa.int32()), pa.array(at.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("rep", *NODE, "n")], lists], names=["rep", *NODE, "n", "at"])

    return rows.select("rep", *NODE, "n", "vector").mapInArrow(run, f"rep long, label {dict(rows.dtypes)['label']}, dim int, tree long, node long, n long, at array<float>")


def cuts_of(at: np.ndarray, n: int, width: float, leaf: int) -> np.ndarray:
    """Cuts of a subtree as a heap, from the projections of a sample of its n rows: infinite at a leaf, not a number where a node isn't split."""
    out, held = np.full(1 << STEPS, np.inf, np.float32), {1: np.arange(len(at))}
    for k in range(1, 1 << STEPS):
        rows = held.pop(k, None)
        if rows is None or n * len(rows) <= leaf * len(at):
            continue
        x = at[rows, k.bit_length() - 1]
        cut = np.median(x)
        if (np.abs(x - cut) <= width).mean() > MOST_SPILL:
            out[k], held[2 * k] = np.nan, rows
        else:
            out[k], held[2 * k], held[2 * k + 1] = cut, rows[x <= cut + width], rows[x > cut - width]
    return out


def fitted(at: DataFrame, limit: float) -> DataFrame:
    """(label, dim, tree, node, cuts) of every node."""
    leaf = LEAF
    share = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n"))
    some = at.filter(F.pmod(F.xxhash64("rep", "tree"), F.lit(1 << 30)) < share * (1 << 30))

    def fit(table: pa.Table) -> pa.Table:
        cuts = cuts_of(matrix(table.column("at"), STEPS), table.column("n")[0].as_py(), float(margin(table.column("dim")[0].as_py(), limit)), leaf)
        return pa.table({**{c: table.column(c).slice(0, 1) for c in NODE}, "cuts": pa.array([cuts], pa.list_(pa.float32()))})

    return some.groupBy(*NODE).applyInArrow(fit, f"label {dict(at.dtypes)['label']}, dim int, tree long, node long, cuts array<float>")


def descend(at: np.ndarray, cuts: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and the place from 0 at the bottom of the subtree that each reaches; a row may reach several."""
    row, k = np.arange(len(at)), np.ones(len(at), np.int64)
    rows, places = [], []
    for level in range(STEPS):
        cut, x, w = cuts[row, k], at[row, level], width[row]
        ends, whole = np.isinf(cut), np.isnan(cut)
        rows.append(row[ends])
        places.append(k[ends] << (STEPS - level))
        low, high = ~ends & (whole | (x <= cut + w)), ~ends & ~whole & (x > cut - w)
        row, k = np.concatenate((row[low], row[high])), np.concatenate((2 * k[low], 2 * k[high] + 1))
    return np.concatenate((*rows, row)), np.concatenate((*places, k)) - (1 << STEPS)


def descended(at: DataFrame, limit: float) -> DataFrame:
    """(rep, label, dim, tree, node) of the nodes that rows with the cuts of their node reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = margin(batch.column("dim").to_numpy(), limit).astype(np.float32)
            row, place = descend(matrix(batch.column("at"), STEPS), matrix(batch.column("cuts"), 1 << STEPS), width)
            node = batch.column("node").to_numpy()[row] * (1 << STEPS) + place
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(taken) for c in ("rep", "label", "dim", "tree")], pa.array(node)], names=["rep", *NODE])

    return at.select("rep", *NODE, "at", "cuts").mapInArrow(run, f"rep long, label {dict(at.dtypes)['label']}, dim int, tree long, node long")


def leaves(reps: DataFrame, limit: float) -> DataFrame:
    """(rep, label, dim, tree, node, leaf) of every leaf that holds a representative."""
    rows = reps.select("rep", "label", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TREES - 1).cast("long"))).alias("tree"), F.lit(1).cast("long").alias("node"))
    settled = []
    for turn in range(TURNS):
        large = written(rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n")).filter(f"n > {LEAF}"), "large-nodes")
        if large.isEmpty():
            break
        settled.append(rows.join(large, NODE, "left_anti").select("rep", *NODE))
        at = written(projected(rows.join(large, NODE).join(reps.select("rep", "vector"), "rep"), turn), "projections")
        cuts = written(fitted(at, limit), "cuts")
        rows = written(descended(at.join(cuts, NODE), limit), "nodes")
    every = reduce(DataFrame.unionByName, settled, rows.select("rep", *NODE))
    return written(every.withColumn("leaf", F.col("tree") * (1 << (STEPS * TURNS + 2)) + F.col("node")), "leaves")


def meetings(held: pa.ListArray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, earlier leaf) of the leaves before this one that hold a row too."""
    row, ids = np.repeat(np.arange(len(held)), np.diff(held.offsets.to_numpy())), held.flatten().to_numpy()
    earlier = ids < leaf
    return row[earlier], ids[earlier]


def forest(close: np.ndarray) -> tuple[list[int], list[int], list[int], list[int]]:
    """Edges that connect what is connected by ``close`` (rows x columns): row to column, and row to row."""
    free_row, free_column = np.ones(close.shape[0], bool), np.ones(close.shape[1], bool)
    a, b, c, d = [], [], [], []
    for i in np.flatnonzero(close.any(1)).tolist():
        if not free_row[i]:
            continue
        free_row[i] = False
        front = np.array([i])
        while len(front):
            columns = np.flatnonzero(free_column & close[front].any(0))
            free_column[columns] = False
            front = np.flatnonzero(free_row & close[:, columns].any(1))
            free_row[front] = False
            a, b, c, d = a + [i] * len(columns), b + columns.tolist(), c + [i] * len(front), d + front.tolist()
    return a, b, c, d


def compare(table: pa.Table, limit: float) -> pa.Table:
    """Of the rows of one leaf (or two blocks of it): the links of each counted here, and edges of a spanning forest."""
    table = table.combine_chunks()
    block = table.column("block").to_numpy()
    one, other = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    alone = block.min() == block.max()
    x, copies, rep = unit(table.column("vector")), table.column("copies").to_numpy(), table.column("rep").to_numpy()
    close = x[one] @ x[other].T >= limit
    if alone:
        np.fill_diagonal(close, False)
    row, earlier = meetings(table.column("held").combine_chunks(), table.column("leaf")[0].as_py())
    names, at = np.unique(earlier, return_inverse=True)
    inside = np.zeros((len(x), len(names)), np.float32)
    inside[row, at] = 1
    counted = close & (inside[one] @ inside[other].T == 0)
    links = np.zeros(len(x), np.int64)
    links[one] += counted @ copies[other]
    if not alone:
        links[other] += counted.T @ copies[one]
    a, b, c, d = forest(close)
    left, right = rep[np.concatenate((one[a], one[c])).astype(int)], rep[np.concatenate((other[b], one[d])).astype(int)]
    some = np.flatnonzero(links)
    return pa.table({"rep": np.concatenate((rep[some], left)), "links": np.concatenate((links[some], np.zeros(len(left), np.int64))), "other": np.concatenate((rep[some], right))})


def found(reps: DataFrame, limit: float) -> DataFrame:
    """(rep, links, other): how many links of a representative a leaf counts, or an edge to another one."""
    at = leaves(reps, limit)
    sizes = at.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("blocks", F.when(F.col("n") > BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(F.lit(1)).cast("long"))
    held = at.groupBy("rep").agg(F.sort_array(F.collect_list("leaf")).alias("held"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    rows = at.join(sizes, NODE).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    full = rows.join(reps.select("rep", "vector", "copies").join(held, "rep"), "rep")
    group = full.groupBy("label", "dim", "leaf", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return group.applyInArrow(lambda table: compare(table, limit), "rep long, links long, other long")


def near_vectors(vectors: DataFrame, limit: float = LIMIT, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    source = vectors.select(F.col(vec_id).alias("vec_id"), F.monotonically_increasing_id().alias("tag"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    # equal vectors of a label have equal keys of 128 bits, which take their place from here on
    all_ = written(source.withColumns({"key_a": F.xxhash64("label", "vector"), "key_b": F.xxhash64(F.lit(SEED), "vector", "label")}), "vectors")
    key = ["key_a", "key_b"]
    real = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vector", lambda c: c != 0)
    usable = F.coalesce(F.col("label").isNotNull() & real, F.lit(False))
    order = F.struct(F.col("vec_id").isNull().alias("no_id"), F.col("vec_id").alias("id"), F.col("tag").alias("tag"))
    groups = all_.filter(usable).groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("first"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    reps = written(groups.select(F.col("first.tag").alias("rep"), *key, "label", F.size("vector").alias("dim"), "vector", "copies", "first"), "representatives")
    got = written(found(reps, limit), "links")
    degree = got.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(got.filter("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    rooted = reps.select("rep", *key, "copies", "first").join(degree, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    placed = rooted.join(least, "root").select(*key, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least")
    joined = all_.select("vec_id", "tag", *key).join(placed, key, "left")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("least").isNull(), F.col("vec_id")).otherwise(F.col("least.id")).alias("component_id"),
        F.coalesce(F.col("tag") == F.col("least.tag"), F.lit(True)).alias("kept"),
    )
