r"""Repair of the structure of conversations by a weighted automaton, determinised lazily.

A conversation's roles should read ``(s?(ua)+)?``: an optional system turn, then
user and assistant in turn. Edits cost: Keep 0, Rerole (to user or assistant) 2,
Delete 3, Insert (an empty user or assistant turn) 2; a truncated turn that
isn't deleted adds 1; blank and duplicate turns have to be deleted.

The automaton of edits has a state for each position in the pattern. Rows are
read from the last to the first; what is known then is a vector, the least cost
to finish from each state. Less its minimum, such a vector is a state of the
determinised automaton. Few exist, so they are numbered as they appear and the
steps between them, one a kind of row, are kept in a table: nearly all rows cost
one look-up. The trace goes back over the rows in order from the pattern's
start, along tight arcs (those whose cost is the whole difference of the two
vectors), the least letter first; so of the cheapest edits it takes those whose
initials are ASCII-least.

Rows reach it without their texts: roles, numbers of turns and digests, with
copies counted, are brought together by conversation in one shuffle, and a
conversation takes two bytes a row. Whether a message was said earlier is
decided before, by a minimum for each message and a join. The digest of the
repaired conversation needs the texts in order: they are shuffled once, beside
the edits, and read as a stream. A conversation is so read by one task, twice,
as an order of all its rows needs, in bounded memory.

Defined results: a null id counts as one space where the damage is chosen, and
null rows form a conversation; a null role or text is one space; turns without a
number come first; rows of equal number come by role, then by the MD5 of their
text; equal rows are duplicates of the first; conversations whose rows all went
have zeros and an empty audit. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions in the pattern: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that the next user or assistant turn leads to, and that turn's role.
NEXT, ROLE = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
FINAL = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Kinds of rows: deleted by rule, or by initial, with 4 more where truncated.
GONE = 8
_INITIALS = {"s": 0, "u": 1, "a": 2}
_FAR = 1 << 30


def kind_of(role: str, faulty: bool, truncated: bool) -> int:
    return GONE if faulty else _INITIALS.get(role[:1], 3) + 4 * truncated


def kept(state: int, kind: int) -> int | None:
    """The state after a row that is kept, None where its role can't stand."""
    initial = kind % 4
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 3:
        return None
    target = NEXT[state]
    return target if target == (USER, ASSISTANT)[initial - 1] else None


def with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Costs to finish, where turns may be inserted first."""
    for _ in range(3):  # start, user, assistant, user: no shorter way comes after these
        costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


def arcs(state: int, kind: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, next state) of the ways to read a row, by initial."""
    yield "D", DELETE, state
    if kind != GONE:
        extra = TRUNCATED if kind >= 4 else 0
        to = kept(state, kind)
        if to is not None:
            yield "K", extra, to
        yield "R", REROLE + extra, NEXT[state]


class Automaton:
    """Determinised states and their transitions, made when first asked for."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.traces: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end, self.end_cost = self.state(with_inserts([0 if q in FINAL else _FAR for q in range(4)]))

    def state(self, costs: tuple[int, ...]) -> tuple[int, int]:
        """The number of a vector less its minimum, and that minimum."""
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    def step(self, after: int, kind: int) -> tuple[int, int]:
        """The state before a row, from the state after it, and what it costs more."""
        made = self.steps.get((after, kind))
        if made is None:
            later = self.vectors[after]
            made = self.steps[after, kind] = self.state(with_inserts([min(cost + later[to] for _, cost, to in arcs(q, kind)) for q in range(4)]))
        return made

    def trace(self, after: int, kind: int, at: int) -> tuple[str, int]:
        """Initials of the cheapest edits up to and with a row, from a state of the pattern, and the state that follows."""
        made = self.traces.get((after, kind, at))
        if made is None:
            before, more = self.step(after, kind)
            now, later, initials, state = self.vectors[before], self.vectors[after], "", at
            while True:
                tight = [(i, to) for i, cost, to in arcs(state, kind) if now[state] + more == cost + later[to]]
                inserted = now[state] == INSERT + now[NEXT[state]]
                if tight and not (inserted and tight[0][0] > "I"):
                    made = initials + tight[0][0], tight[0][1]
                    break
                initials, state = initials + "I", NEXT[state]
            self.traces[after, kind, at] = made
        return made

    def finish(self, at: int) -> str:
        """Inserts after the last row."""
        initials = ""
        while at not in FINAL:
            initials, at = initials + "I", NEXT[at]
        return initials

    def costs(self, kinds: bytes) -> tuple[int, bytearray]:
        """The least cost of a conversation, and the number of the state after each row."""
        state, total, after = self.end, self.end_cost, bytearray(len(kinds))
        steps = self.steps
        for i in range(len(kinds) - 1, -1, -1):
            after[i] = state
            state, more = steps.get((state, kinds[i])) or self.step(state, kinds[i])
            total += more
        return total + self.vectors[state][START], after

    def edits(self, kinds: bytes, after: bytes) -> Iterator[str]:
        """Initials of the edits up to and with each row in order, then of the inserts at the end."""
        at = START
        for kind, state in zip(kinds, after, strict=True):
            initials, at = self.traces.get((state, kind, at)) or self.trace(state, kind, at)
            yield initials
        yield self.finish(at)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, gone: rows after the damage of the test; rows that it drops are marked as gone.

    By crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets role user.
    """
    space = F.lit(" ")
    said = lambda c: F.coalesce(F.col(c).cast("string"), space)
    chosen = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), chosen.alias("chosen"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("chosen") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("chosen") == 1, F.lit("")).when(F.col("chosen") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("chosen") == 3, 2).otherwise(1).cast("long").alias("copies"),
        (F.col("chosen") == 0).alias("gone"),
    )


def undamaged(turns: DataFrame) -> DataFrame:
    """The same columns for rows as they are."""
    space = F.lit(" ")
    said = lambda c: F.coalesce(F.col(c), space).alias(c)
    return turns.select("conv_id", "turn", said("role"), said("text"), F.lit(1).cast("long").alias("copies"), F.lit(False).alias("gone"))


ORDER = ["conv_id", "turn", "role", "digest"]


def _digest() -> Column:
    return F.md5(F.col("text").cast("binary"))


def messages(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, blank, truncated, gone, copies, again: equal rows counted, without texts.

    ``again``: role and text were said at an earlier turn. A conversation has one
    row for all its rows that are gone.
    """
    present = lambda c: F.when(~F.col("gone"), c)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    narrow = rows.select(
        "conv_id",
        "gone",
        present(F.col("turn")).alias("turn"),
        present(F.col("role")).alias("role"),
        present(_digest()).alias("digest"),
        present(blank).alias("blank"),
        present(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
        "copies",
    )
    counted = narrow.groupBy(*[c for c in narrow.columns if c != "copies"]).agg(F.sum("copies").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn"))
    first = narrow.filter(~F.col("gone")).groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    said = first.filter(F.col("first") != F.col("last")).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    again = F.coalesce(place > F.col("first"), F.lit(False))
    return counted.join(said, same, "left").select(*counted.columns, again.alias("again"))


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class Conversation:
    """What is known of a conversation whose messages come in order: figures, and the kind of each row in a byte."""

    def __init__(self, key):
        self.key, self.kinds = key, bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.first, self.turn, self.initial = 0, None, None, None

    def add(self, turn: int | None, role: str, blank: bool, truncated: bool, copies: int, again: bool) -> None:
        if turn is not None and turn != self.turn:
            self.turns, self.turn = self.turns + 1, turn
            self.first = turn if self.first is None else self.first
        faulty = copies if blank or again else copies - 1
        self.blank += copies if blank else 0
        self.duplicate += 0 if blank else faulty
        self.truncated += truncated and faulty < copies
        if faulty < copies:
            self.kinds.append(kind_of(role, False, truncated))
        self.kinds += bytes([GONE]) * faulty
        initial = role[:1]
        self.illegal += copies - 1 + (self.initial is not None and (self.initial, initial) not in (("s", "u"), ("u", "a"), ("a", "u")))
        self.initial = initial

    def row(self, automaton: Automaton) -> tuple:
        cost, after = automaton.costs(self.kinds)
        audit = "".join(automaton.edits(self.kinds, after))
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def scanned(found: DataFrame) -> DataFrame:
    """conv_id, the figures, cost and audit of every conversation, from ``messages``."""
    columns = ["gone", "turn", "role", "blank", "truncated", "copies", "again"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, now, kind = Automaton(), None, pa.int64()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            made = list(zip(*rows, strict=True)) or [()] * (len(FIGURES) + 2)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, [kind, *[pa.int64()] * len(FIGURES), pa.string()], strict=True)], names=["conv_id", *FIGURES, "audit"])

        for batch in batches:
            kind, rows = batch.column("conv_id").type, []
            for key, gone, *message in zip(*(batch.column(c).to_pylist() for c in ("conv_id", *columns)), strict=True):
                if now is None or now.key != key:
                    if now is not None:
                        rows.append(now.row(automaton))
                    now = Conversation(key)
                if not gone:
                    now.add(*message)
            yield out(rows)
        if now is not None:
            yield out([now.row(automaton)])

    ordered = found.repartition("conv_id").sortWithinPartitions(*ORDER).select("conv_id", *columns)
    return ordered.mapInArrow(run, f"conv_id {dict(found.dtypes)['conv_id']}, {', '.join(f'{c} long' for c in FIGURES)}, audit string")


class Editor:
    """Carries out an audit on rows that come in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.place = audit, 0, START, 0

    def inserted(self) -> Iterator[tuple[int, str, str]]:
        while self.audit.startswith("I", self.at):
            yield self.turn(ROLE[self.state], "", NEXT[self.state])

    def turn(self, role: str, text: str, state: int) -> tuple[int, str, str]:
        self.at, self.state, self.place = self.at + 1, state, self.place + 1
        return self.place - 1, role, text

    def row(self, role: str, text: str) -> Iterator[tuple[int, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        if edit == "D":
            self.at += 1
        elif edit == "R":
            yield self.turn(ROLE[self.state], text, NEXT[self.state])
        else:
            yield self.turn(role, text, kept(self.state, kind_of(role, False, False)))


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, role, text, and the figures: every conversation after its repair.

    A conversation begins with a row of place -1, which has its figures, cost and
    audit; its turns follow in order, from place 0. All are in one partition.
    """
    kinds = dict(rows.dtypes)
    figures = scanned(messages(rows))
    empty = lambda *names: [F.lit(None).cast(kinds.get(n, "string")).alias(n) for n in names]
    texts = rows.filter(~F.col("gone")).select(
        "conv_id", F.lit(1).alias("part"), "turn", "role", _digest().alias("digest"), "text", "copies", *[F.lit(None).cast("long").alias(c) for c in FIGURES], F.lit(None).cast("string").alias("audit")
    )
    heads = figures.select("conv_id", F.lit(0).alias("part"), *empty("turn", "role", "digest", "text", "copies"), *FIGURES, "audit")
    ordered = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "part", *ORDER[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, kind = None, None, pa.int64()
        for batch in batches:
            kind, out = batch.column("conv_id").type, []
            for conv_id, part, role, text, copies, *head in zip(*(batch.column(c) for c in ("conv_id", "part", "role", "text", "copies", *FIGURES, "audit")), strict=True):
                if part.as_py() == 0:
                    if now is not None:
                        out.extend((key, *made, *[None] * 7) for made in now.inserted())
                    key, head = conv_id.as_py(), [v.as_py() for v in head]
                    now = Editor(head[-1])
                    out.append((key, -1, None, None, *head))
                    continue
                for _ in range(copies.as_py()):
                    out.extend((key, *made, *[None] * 7) for made in now.row(role.as_py(), text.as_py()))
            yield _turns(out, kind)
        if now is not None:
            yield _turns([(key, *made, *[None] * 7) for made in now.inserted()], kind)

    return ordered.select("conv_id", "part", "role", "text", "copies", *FIGURES, "audit").mapInArrow(run, f"conv_id {kinds['conv_id']}, place long, role string, text string, {', '.join(f'{c} long' for c in FIGURES)}, audit string")


def _turns(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * (5 + len(FIGURES))
    types = [kind, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * len(FIGURES), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=["conv_id", "place", "role", "text", *FIGURES, "audit"])


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, the figures, cost, audit and repaired_sha256 of what ``repaired`` gives, read in its order."""
    names = ["conv_id", *FIGURES, "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, said, kind = None, None, pa.int64()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * (len(names) + 1)
            types = [kind, *[pa.int64()] * len(FIGURES), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names=[*names, "repaired_sha256"])

        for batch in batches:
            kind, found = batch.column("conv_id").type, []
            for place, role, text, *row in zip(*(batch.column(c) for c in ("place", "role", "text", *names)), strict=True):
                at = place.as_py()
                if at < 0:
                    if head is not None:
                        found.append((*head, said.hexdigest()))
                    head, said = [v.as_py() for v in row], hashlib.sha256()
                else:
                    said.update(f"{'\n' if at else ''}{role.as_py()}:{text.as_py()}".encode())
            yield out(found)
        if head is not None:
            yield out([(*head, said.hexdigest())])

    kinds = f"conv_id {dict(conversations.dtypes)['conv_id']}, {', '.join(f'{c} long' for c in FIGURES)}, audit string, repaired_sha256 string"
    return conversations.select("place", "role", "text", *names).mapInArrow(run, kinds)
