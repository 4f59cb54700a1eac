import hashlib
import re
from collections import defaultdict

from sparkloom.llm.exact_dedup import drop_exact_copies, exact_groups


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    return sorted((i, min((x for x in g if x is not None), default=None), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g if i is not None)


def check(rows, docs_of):
    got = exact_groups(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got if r.doc_id is not None) == brute(rows)
    assert len(got) == len(rows)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) <= {1}
    left = drop_exact_copies(docs_of(rows))
    assert left.columns == docs_of(rows).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == sorted((r.doc_id is None, r.doc_id or 0) for r in got if r.kept)


def test_odd_rows(docs_of, odd):
    check(odd, docs_of)


def test_a_hot_text_and_ties(docs_of, prose):
    rows = [(i, prose(0) if i % 3 == 0 else prose(i % 40) + (" " if i % 2 else "\n") + "end") for i in range(400, 0, -1)]
    check(rows + rows[:5], docs_of)


def test_white_space_is_normalised_and_nothing_else(docs_of):
    check([(1, "a  b"), (2, "a\tb"), (3, "a b "), (4, "A b"), (5, "a b"), (6, "a\x0b\x0c\r\nb")], docs_of)


def test_empty_table(docs_of):
    check([], docs_of)


def test_plan_is_native(spark, docs_of):
    plan = exact_groups(docs_of([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
