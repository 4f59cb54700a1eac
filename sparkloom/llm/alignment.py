r"""Alignment of two tokenizers by a dictionary of groups.

A text with a space before it is cut by a byte-level BPE (A) and by a piece BPE
(B). The byte offsets where tokens of both end cut the text into groups; a
group's key is its A ids, a bar and its B ids (``262,11|278``). Ids fix their
bytes, so a group holds the same links wherever it occurs: every pair of an A
and a B token whose bytes overlap. Corpus counts so need no text:

1. texts are cut once; each row of the written table has its groups' keys with
   their numbers (a text's distinct groups, not its tokens);
2. the dictionary has each distinct key once, with its frequency and the number
   of texts that hold it; its links are expanded once a key;
3. pairs are counted by frequency times links, the best of each B id follows;
4. each key is graded (links that are their B id's best, summed counts), and
   the grades are joined back to the texts by key.

Both tokenizers cut before a space that follows a character other than white
space, and none of their tokens spans such a place, so stretches between these
places are cut alone, and kept in a table of bounded size in each worker. That
B has no piece with a space inside is checked when its file is read; a file
with one has its texts cut whole.

Shuffles: keys and their numbers, twice (pre-aggregated for the dictionary,
whole for the join back, whose uneven partitions Spark can split); the rest is
as large as the dictionary. Nothing but the best count of each B id is
broadcast: one row an id of the vocabulary at most.

Defined results: texts that are null or empty, and those whose bytes either
tokenizer doesn't give back (such as a text with U+2581, which B reads as a
space), have no tokens: zeros and an empty groups_sha256. Strings of special
tokens are plain text. Repeated rows count each. A count that several A ids
share is best for each of them. An empty table gives an empty result; other
columns are not read, and doc_id may be null or repeated.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.chunks import whole_pieces
from sparkloom.llm.packing import byte_letters
from sparkloom.session import written

#: Longer stretches (in characters) hardly repeat: they aren't kept.
LONGEST = 64
#: Bytes that a worker's table of stretches holds at most, about, and what an entry takes beside its strings.
MOST, ENTRY = 80 << 20, 250
#: Characters of texts, and texts, that are cut at a time, but for one longer text.
HELD, MANY = 1 << 19, 1000
#: Stretches that are cut as one text.
TOGETHER = 512
#: What marks a space in a piece.
SPACE = "▁"
#: Where a split at single spaces isn't one into stretches.
_RUN = re.compile(r"^ |\s | $")
#: What keeps a stretch from being cut together with others.
_ODD = re.compile(rf"^$|\s|{SPACE}")


def byte_tokens(path: str) -> tuple[Callable[[str], list[int]], dict[int, bytes]]:
    """How a byte-level tokenizer file cuts plain text, and its tokens' bytes.

    Its merges are carried out by ``tiktoken`` where they come in the order of
    their ids, which gives the same ids; else by ``tokenizers``.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    special = {v.content for v in slow.get_added_tokens_decoder().values()}
    letters = byte_letters()
    names = {n: i for n, i in slow.get_vocab(with_added_tokens=False).items() if n not in special and set(n) <= letters.keys()}
    entries = {i: bytes(letters[c] for c in n) for n, i in names.items()}
    with open(path, encoding="utf-8") as f:
        kept = json.load(f)
    order = [names.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in kept["model"]["merges"]]
    if kept.get("normalizer") is None and order == sorted(order) and -1 not in order:
        fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in entries.items()}, special_tokens={})
        return fast.encode_ordinary, entries
    return lambda text: slow.encode(text, add_special_tokens=False).ids, entries


def piece_tokens(path: str) -> tuple[Callable[[list[str]], list[list[int]]], dict[int, bytes], bool]:
    """How a piece tokenizer file cuts texts with a space before them, its tokens' bytes, and whether no piece has a space after another character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    entries, apart = {}, True
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            entries[i] = bytes([int(piece[1:-1], 16)])
        elif not (model.is_unknown(i) or model.is_control(i)):
            entries[i] = piece.replace(SPACE, " ").encode()
            apart &= SPACE not in piece.lstrip(SPACE)
    alone = model.piece_to_id(SPACE)

    def cut_all(texts: list[str]) -> list[list[int]]:
        # the library adds the space, but not to an empty text
        return [ids if t else [alone] for t, ids in zip(texts, model.encode(texts, num_threads=1), strict=True)]

    return cut_all, entries, apart


class Rows:
    """A vocabulary by id: sizes, and names with each of the marks that may follow."""

    def __init__(self, entries: dict[int, bytes], marks: str):
        self.entries, most = entries, max(entries) + 2
        self.sizes, self.names = np.zeros(most, np.int64), np.full((len(marks), most), "", object)
        for i, x in entries.items():
            self.sizes[i] = len(x)
            self.names[:, i] = [f"{i}{m}" for m in marks]

    def gives(self, ids: np.ndarray, data: bytes) -> bool:
        """Whether the ids' bytes are these."""
        try:
            return b"".join(map(self.entries.__getitem__, ids.tolist())) == data
        except KeyError:  # an id without bytes
            return False


class Stretches(dict):
    """The groups of stretches, as keys joined by semicolons; None where bytes don't come back.

    A stretch is named without the space that it begins with. Beyond about
    ``MOST`` bytes the half goes that wasn't met for longest.
    """

    def __init__(self, a: str, b: str):
        self.cut_a, self.bytes_a = byte_tokens(a)
        self.cut_b, self.bytes_b, self.apart = piece_tokens(b)
        self.sizes_a, self.sizes_b = ({i: len(x) for i, x in entries.items()} for entries in (self.bytes_a, self.bytes_b))
        self.names_a, self.names_b = ({i: str(i) for i in entries} for entries in (self.bytes_a, self.bytes_b))
        self.rows_a, self.rows_b = Rows(self.bytes_a, ",|"), Rows(self.bytes_b, ",;\n")
        self.size = 0

    def groups(self, stretch: str, b: list[int]) -> str | None:
        """Of one stretch and its B ids."""
        spaced = " " + stretch
        a, data, bytes_a, bytes_b = self.cut_a(spaced), spaced.encode("utf-8", "surrogatepass"), self.bytes_a, self.bytes_b
        try:
            if b"".join([bytes_a[i] for i in a]) != data or b"".join([bytes_b[i] for i in b]) != data:
                return None
        except KeyError:  # an id without bytes
            return None
        sizes_a, sizes_b, names_a, names_b = self.sizes_a, self.sizes_b, self.names_a, self.names_b
        out, more_a, more_b = [], iter(a), iter(b)
        for x in more_a:
            y = next(more_b)
            ahead, key_a, key_b = sizes_a[x] - sizes_b[y], names_a[x], names_b[y]
            while ahead:  # bytes that A has read more than B
                if ahead < 0:
                    x = next(more_a)
                    ahead += sizes_a[x]
                    key_a += "," + names_a[x]
                else:
                    y = next(more_b)
                    ahead -= sizes_b[y]
                    key_b += "," + names_b[y]
            out.append(key_a + "|" + key_b)
        return ";".join(out)

    def learn(self, wanted: set[str]) -> list[str]:
        """Add what is missing; the long ones of it, to be dropped after use."""
        if self.size > MOST:
            for old in list(self)[: len(self) // 2]:
                self.size -= ENTRY + len(old) + len(self.pop(old) or "")
        new = [p for p in wanted if p not in self]
        for p in wanted.difference(new):
            self[p] = self.pop(p)  # now among the younger
        plain = [p for p in new if len(p) <= LONGEST and not _ODD.search(p)] if self.apart else []
        for lo in range(0, len(plain), TOGETHER):
            self.update(self.groups_of(plain[lo : lo + TOGETHER]))
        rest = [p for p in new if p not in self]
        for p, b in zip(rest, self.cut_b(rest), strict=True):
            self[p] = self.groups(p, b)
        self.size += sum(ENTRY + len(p) + len(self[p] or "") for p in new)
        return [p for p in rest if len(p) > LONGEST]

    def groups_of(self, stretches: list[str]) -> dict[str, str]:
        """Of stretches without white space, cut as one text; nothing if its bytes don't come back."""
        text = " ".join(stretches)
        a, [b], data = np.array(self.cut_a(" " + text), np.int64), self.cut_b([text]), (" " + text).encode("utf-8", "surrogatepass")
        b = np.array(b, np.int64)
        if not self.rows_a.gives(a, data) or not self.rows_b.gives(b, data):
            return {}
        ends_a, ends_b = np.cumsum(self.rows_a.sizes[a]), np.cumsum(self.rows_b.sizes[b])
        last_a, last_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
        # a stretch ends where the next one's space or the text's end stands
        over = last_b & np.isin(ends_b, np.append(np.flatnonzero(np.frombuffer(data, np.uint8) == 32)[1:], len(data)))
        # a group's A ids stand before its B ids: both move by the other side's ids before them
        out = np.empty(len(a) + len(b), object)
        to_a, to_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        out[np.arange(len(a)) + np.append(0, to_b)[group_a]] = self.rows_a.names[last_a.astype(np.int64), a]
        out[np.arange(len(b)) + to_a[group_b]] = self.rows_b.names[last_b.astype(np.int64) + over, b]
        return dict(zip(stretches, "".join(out.tolist()).split("\n"), strict=False))

    def of(self, texts: list[str]) -> list[str | None]:
        """The groups of each whole text, None if it has no tokens."""
        split = [self.split(t) for t in texts]
        long = self.learn(set().union(*split))
        out = []
        for stretches in split:
            found = [self[p] for p in stretches]
            out.append(None if not found or None in found else ";".join(found))
        for p in long:
            self.size -= ENTRY + len(p) + len(self.pop(p) or "")
        return out

    def split(self, text: str) -> list[str]:
        if not text or not self.apart:
            return [text] if text else []
        split = text.split(" ")
        if _RUN.search(text):
            first, *later = whole_pieces(split)
            split = [first, *[p[1:] for p in later]]
        return split


@cache
def stretches(a: str, b: str) -> Stretches:
    return Stretches(a, b)


def expanded(key: str, bytes_a: dict[int, bytes], bytes_b: dict[int, bytes]) -> Counter:
    """How many links of a group hold each (A id, B id)."""
    a, b = ([int(i) for i in ids.split(",")] for ids in key.split("|"))
    found: Counter = Counter()
    i = j = 0
    end_a, end_b = len(bytes_a[a[0]]), len(bytes_b[b[0]])
    while True:
        found[a[i], b[j]] += 1
        if end_a == end_b:  # both end together in a group's last tokens alone
            return found
        if end_a < end_b:
            i += 1
            end_a += len(bytes_a[a[i]])
        else:
            j += 1
            end_b += len(bytes_b[b[j]])


def counted(texts: list[str | None]) -> list[pa.Array]:
    """n_a, n_b, n_groups, n_links, groups_sha256 and groups of texts by their groups."""
    rows, keys, numbers, ends = [], [], [], [0]
    for joined in texts:
        if joined is None:
            rows.append((0, 0, 0, 0, ""))
        else:
            found = Counter(joined.split(";"))
            n_groups = n_a = n_b = joined.count(";") + 1
            for key, n in found.items():
                if "," in key:
                    bar = key.index("|")
                    n_a += n * key.count(",", 0, bar)
                    n_b += n * key.count(",", bar)
            # a group of x and y tokens whose ends meet in its last ones alone has x + y - 1 links
            rows.append((n_a, n_b, n_groups, n_a + n_b - n_groups, hashlib.sha256(joined.encode()).hexdigest()))
            keys.extend(found.keys())
            numbers.extend(found.values())
        ends.append(len(keys))
    *figures, sha = zip(*rows, strict=True)
    groups = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(numbers, pa.int64())], ["key", "n"])
    return [*(pa.array(c, pa.int64()) for c in figures), pa.array(sha, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), groups)]


def cut(docs: DataFrame, a: str, b: str) -> DataFrame:
    """tag, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups (key, n) of every document. ``tag`` tells rows apart."""
    kind = dict(docs.dtypes)["doc_id"]
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = stretches(a, b)
        for batch in batches:
            texts, begun, held = batch.column("text"), 0, []
            for k in range(len(texts)):
                held.append(texts[k].as_py() or "")
                if sum(map(len, held)) > HELD or len(held) == MANY or k + 1 == len(texts):
                    columns = counted(table.of(held))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(begun, len(held)) for c in ("tag", "doc_id")), *columns], names=["tag", "doc_id", *names, "groups"])
                    begun, held = k + 1, []

    schema = f"tag long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups array<struct<key:string,n:long>>"
    return docs.select(F.monotonically_increasing_id().alias("tag"), "doc_id", "text").mapInArrow(run, schema)


def dictionary(cuts: DataFrame) -> DataFrame:
    """key, freq, n_docs: every distinct group once, how often it occurs and in how many rows."""
    return cuts.select(F.explode("groups").alias("g")).groupBy(F.col("g.key").alias("key")).agg(F.sum("g.n").alias("freq"), F.count(F.lit(1)).alias("n_docs"))


def links_of(groups: DataFrame, a: str, b: str) -> DataFrame:
    """key, freq, n_docs, a_id, b_id, links: the links of each distinct group, once a pair of ids."""
    names = ["key", "freq", "n_docs", "a_id", "b_id", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = stretches(a, b)
        for batch in batches:
            rows = [
                (key, freq, n_docs, x, y, n)
                for key, freq, n_docs in zip(*(batch.column(c).to_pylist() for c in names[:3]), strict=True)
                for (x, y), n in expanded(key, table.bytes_a, table.bytes_b).items()
            ]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "key" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)

    return groups.select(*names[:3]).mapInArrow(run, "key string, freq long, n_docs long, a_id long, b_id long, links long")


def pair_counts(links: DataFrame, by: str = "freq") -> DataFrame:
    """a_id, b_id, count (links that hold the pair), best (whether no A id has more with this B id).

    By "n_docs", a group's links count once for each row that holds the group.
    """
    pairs = links.groupBy("a_id", "b_id").agg(F.sum(F.col(by) * F.col("links")).alias("count"))
    # one row for each id of B's vocabulary at most
    most = pairs.groupBy("b_id").agg(F.max("count").alias("most"))
    return pairs.join(F.broadcast(most), "b_id").select("a_id", "b_id", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, a: str, b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    cuts = written(cut(docs, a, b), "cuts")
    links = written(links_of(dictionary(cuts), a, b), "links")
    pairs = written(pair_counts(links), "pairs")
    best, counted = F.when(F.col("best"), F.col("links")).otherwise(0), F.col("links") * F.col("count")
    # written, so that both sides of the join by key are plain shuffles, whose uneven partitions Spark splits
    grades = written(links.join(pairs, ["a_id", "b_id"]).groupBy("key").agg(F.sum(best).alias("best_links"), F.sum(counted).alias("counts")), "grades")
    held = cuts.select("tag", F.explode("groups").alias("g")).select("tag", F.col("g.key").alias("key"), F.col("g.n").alias("n"))
    totals = held.join(grades, "key").groupBy("tag").agg(F.sum(F.col("n") * F.col("best_links")).alias("n_best"), F.sum(F.col("n") * F.col("counts")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return cuts.drop("groups").join(totals, "tag", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
