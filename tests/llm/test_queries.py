"""Registered queries against their SQL, and the pipeline against slow versions of its stages."""

import re

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.test_exact_dedup import brute as exact_brute
from tests.llm.test_minhash import brute as near_brute

DATA = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", [n for n in sorted(__spark_entry__.oracle_sql()) if n.startswith("op")])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = __spark_entry__.queries()[name](spark, DATA), con.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    key = lambda x: tuple((v is None, v if v is not None else 0) for v in x)
    assert sorted(rows, key=key) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall(), key=key)


def test_all_operators_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "packed"]


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, DATA)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids[name] = sorted({r.doc_id for r in docs.select("doc_id").collect()})
        if name != "packed":
            assert docs.columns == columns
        if name == "language":
            assert ids[name] == sorted(i for i, t in before if t and any(c.isalpha() for c in t))
        elif name == "exact":
            assert ids[name] == sorted({keep for _, keep, _, _ in exact_brute(before)})
        elif name == "near":
            assert ids[name] == sorted(i for i, _, root in near_brute(before, 5) if i == root)
        else:
            assert ids[name] == ids["near"]
    whole = corpus_pipeline.run(spark, DATA)
    assert sorted({r.doc_id for r in whole.select("doc_id").collect()}) == ids["near"]


@pytest.mark.parametrize("labelled", [False, True])
def test_pipeline_on_odd_rows(spark, docs_of, odd, prose, tmp_path, labelled):
    """Nulls, empty and long texts, repeated rows, clashing columns; with and without labels."""
    german = str.maketrans({"a": "ä", "t": "sch", "o": "ü"})
    rows = odd + [(100 + i, prose(i) if i % 2 else prose(i).translate(german), "en" if i % 2 else "de") for i in range(12)]
    rows += [(90, prose(3), "en"), (91, prose(4).translate(german).replace(" ", "  ")), (92, prose(5, 200)), (93, prose(5, 200) + " more"), (105, prose(5), "en")]
    docs = docs_of(rows if labelled else [r[:2] for r in rows])
    columns, left = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packed":
            assert docs.columns == columns
            left = [(r.doc_id, r.text) for r in docs.collect()]
            assert all(any(c.isalpha() for c in t) for _, t in left)
        if name == "exact":
            assert len({re.sub(r"[\x20\x09-\x0D]+", " ", t) for _, t in left}) == len(left)
    # of the clean documents the first of each group stays
    assert {i for i, _ in left if i is not None and i >= 90} == {*range(90, 93), *range(100, 112)} - {103, 104}
    assert {i for i, _ in left} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_on_an_empty_table(spark, docs_of, tmp_path):
    docs = docs_of([])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0
