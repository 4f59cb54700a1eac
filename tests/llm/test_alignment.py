import hashlib
import random
from collections import Counter
from functools import cache

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import alignment, queries_alignment
from sparkloom.llm.alignment import aligned, cut, dictionary, expanded, links_of, pair_counts, stretches
from sparkloom.llm.packing import byte_letters

DATA = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@cache
def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B), byte_letters()


def tokens(text):
    """(id, begin, end) of each token of A and B by the libraries over the whole text; None where bytes differ."""
    t, sp, letters = libraries()
    a = [(i, bytes(letters[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
    out = []
    for found in (a, b):
        if b"".join(x for _, x in found) != (" " + text).encode():
            return None
        at, spans = 0, []
        for i, x in found:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def brute(rows):
    cuts = [tokens(t) if t else None for _, t in rows]
    links = [[(x, y) for x, p, q in c[0] for y, r, s in c[1] if p < s and r < q] if c else [] for c in cuts]
    count = Counter(l for own in links for l in own)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(n, best.get(y, 0))
    out = []
    for (k, _), c, own in zip(rows, cuts, links, strict=True):
        if not c:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({e for _, _, e in c[0]} & {e for _, _, e in c[1]})
        groups = [[",".join(str(i) for i, b, e in side if lo <= b and e <= hi) for side in c] for lo, hi in zip([0, *ends], ends)]
        sha = hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest()
        out.append((k, len(c[0]), len(c[1]), len(ends), len(own), sum(count[l] == best[l[1]] for l in own), sum(count[l] for l in own), sha))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


PARTS = [" ", "  ", "\n", "\t ", " \n", "a", "the", " word", "é", "日本語", "　", "\x1c", "\x85", "<|endoftext|>", "<s>", "<0x0A>", "'s", "123", "!?", "▁", "😀", "x" * 70, "\x00", "‎"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=4), max_size=12).map("".join))
def test_stretches_give_the_groups_of_the_whole_text(text):
    [found], want = stretches(A, B).of([text]), tokens(text) if text else None
    if want is None:
        assert found is None
        return
    keys = found.split(";")
    assert [int(i) for k in keys for i in k.split("|")[0].split(",")] == [i for i, _, _ in want[0]]
    assert [int(i) for k in keys for i in k.split("|")[1].split(",")] == [i for i, _, _ in want[1]]
    assert len(keys) == len({e for _, _, e in want[0]} & {e for _, _, e in want[1]})
    own = Counter((x, y) for x, p, q in want[0] for y, r, s in want[1] if p < s and r < q)
    table = stretches(A, B)
    assert sum((expanded(k, table.bytes_a, table.bytes_b) for k in keys), Counter()) == own


def test_a_full_table_keeps_giving_the_same(monkeypatch):
    monkeypatch.setattr(alignment, "MOST", 5_000)
    table, r = alignment.Stretches(A, B), random.Random(2)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(1, 9))) for _ in range(300)]
    for _ in range(20):
        text = " ".join(r.choice(words) for _ in range(20)) + " " + "x" * 100
        assert table.of([text]) == [table.groups(text, table.cut_b([text])[0])]
    assert table.size < 16_000 and "x" * 100 not in table and table.size == sum(alignment.ENTRY + len(k) + len(v or "") for k, v in table.items())


def test_documents(docs_of, odd, prose):
    rows = [(k, t) for k, t in odd if not t or len(t) < 1000] + [(100 + i, prose(i, 30)) for i in range(8)] + [(200 + i, prose(0, 30)) for i in range(3)]
    rows += [(300, "a ▁ b"), (301, "<|endoftext|> </s>"), (302, "word "), (303, " word  two\n three"), (304, "日本語のテキスト " * 5)]
    assert rows_of(aligned(docs_of(rows), A, B)) == brute(rows)


def test_long_texts_stand_beside_others(docs_of, prose, monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 500)
    rows = [(i, prose(i % 3, 20 * (i % 5))) for i in range(20)] + [(30, "x" * 3000), (31, " ".join(prose(4) for _ in range(5)))]
    assert rows_of(aligned(docs_of(rows, 2), A, B)) == brute(rows)


def test_empty_table(docs_of):
    assert aligned(docs_of([]), A, B).count() == 0


def test_dictionary_counts_rows_and_pairs(docs_of):
    cuts = cut(docs_of([(1, "the the cat"), (2, "the dog"), (3, None)]), A, B)
    found = {r.key: (r.freq, r.n_docs) for r in dictionary(cuts).collect()}
    the = next(k for k in found if found[k] == (3, 2))
    links = links_of(dictionary(cuts), A, B)
    for by, n in (("freq", 3), ("n_docs", 2)):
        assert {f"{r.a_id}|{r.b_id}": r["count"] for r in pair_counts(links, by).collect()}[the] == n


def test_other_files_are_refused_or_read_alike(docs_of):
    """A vocabulary without byte letters gives no bytes back, so no tokens."""
    got = aligned(docs_of([(1, "some text")]), public_tokenizers.path("word_bpe_49k.json"), B).collect()
    assert [(r.n_a, r.n_links, r.groups_sha256) for r in got] == [(0, 0, "")]


def test_query(spark):
    """Links by a merge of the spans of whole texts, as all pairs of spans would take long."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r[0]: r for r in rows_of(queries_alignment.op12_alignment(spark, DATA))}
    count, own, best = Counter(), {}, Counter()
    for k, t in docs:
        c = tokens(t) if t else None
        own[k], i, j = Counter(), 0, 0
        while c and i < len(c[0]) and j < len(c[1]):
            own[k][c[0][i][0], c[1][j][0]] += 1
            a, b = c[0][i][2], c[1][j][2]
            i, j = i + (a <= b), j + (b <= a)
        count.update(own[k])
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    assert got.keys() == own.keys()
    for k, links in own.items():
        assert got[k][4:7] == (links.total(), sum(n for p, n in links.items() if count[p] == best[p[1]]), sum(n * count[p] for p, n in links.items()))
