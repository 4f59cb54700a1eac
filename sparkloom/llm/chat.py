r"""Chat formatting that is checked by a grammar round trip.

    conversation = "<s>" turn*
    turn = "[INST] " text " [/INST]"                      user
         | " " text " </s>"                               assistant
         | "<<SYS>>\n" text "\n<</SYS>>\n"                system
         | "<|role|" role "|>" text "<|end|>"             any other role, percent-encoded

Inside a text every control string carries at least one backslash after its
first character. Rendered turns are parsed again; a turn that doesn't come back
as it was gets one backslash more in each control string, bare or escaped, and
is rendered and parsed once more: then it does. Reading takes one backslash
away, so any text survives.

Conversations are brought together by one shuffle on their id, sorted by turn,
and read as a stream. A conversation is written in parts that end with the turn
that reaches ``PART`` characters, nearly always in one; no more than a part is
held, however long a conversation is, and reading back keeps hash states only.

Defined results: a null text or role counts as empty; turns without a number
come first, turns of equal number are ordered by role and text; all turns with a
null conv_id are one conversation; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = "<s>"
#: Characters after which a part of a conversation ends.
PART = 1 << 20
#: role: what stands before and after a text
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n")}
OTHER = ("<|role|", "|>", "<|end|>")
_CONTROL = re.compile(r"(\[|<)(\\*)(/?INST\]|<SYS>>|</SYS>>|/?s>|\|)")
_BARE = re.compile(r"\[/?INST\]|<</?SYS>>|</?s>|<\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return re.sub(r"(\[|<)\\(\\*)(/?INST\]|<SYS>>|</SYS>>|/?s>|\|)", r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends; the text is taken as it is."""
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = OTHER[0] + quote(role, safe="") + OTHER[1], OTHER[2]
    return before + text + after, len(before), len(before) + len(text)


class Mismatch(ValueError):
    """The text isn't a conversation."""


def parse(formatted: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """role, text, and the text's span, of each turn from ``at`` on."""
    while at < len(formatted):
        if formatted.startswith(OTHER[0], at):
            end = formatted.find(OTHER[1], at + len(OTHER[0]))
            role, begin, after = unquote(formatted[at + len(OTHER[0]) : end]), end + len(OTHER[1]), OTHER[2]
        else:
            role = next((r for r, (before, _) in MARKS.items() if formatted.startswith(before, at)), None)
            if role is None:
                raise Mismatch(f"no turn begins at {at}")
            begin, after = at + len(MARKS[role][0]), MARKS[role][1]
        end = formatted.find(after, begin)
        if end < 0 or _BARE.search(formatted, begin, end):
            raise Mismatch(f"the turn at {at} doesn't end")
        yield role, unescape(formatted[begin:end]), begin, end
        at = end + len(after)


def turn(role: str, text: str) -> tuple[str, int, int]:
    """A rendered turn that parses as what it was made from."""
    for written in (text, escape(text)):
        made, begin, end = render(role, written)
        try:
            if list(parse(made)) == [(role, text, begin, end)]:
                return made, begin, end
        except Mismatch:
            pass
    raise Mismatch("a turn can't be written")


def formatted(turns: DataFrame, most: int = PART) -> DataFrame:
    """conv_id, part, formatted, and loss_spans: where the assistant's texts stand in this part. Parts in order make the conversation."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part, pieces, spans, size, kind, begun = None, 0, [], [], 0, pa.int64(), False
        done: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.string(), span), strict=True)], names=["conv_id", "part", "formatted", "loss_spans"])

        for batch in batches:
            kind = batch.column("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                fresh = not begun or conv != key
                if begun and (fresh or size >= most):
                    done.append((key, part, "".join(pieces), spans))
                    held += size
                    key, part, pieces, spans, size = conv, 0 if fresh else part + 1, [START] if fresh else [], [], len(START) if fresh else 0
                    if held >= most or len(done) >= 500:
                        yield out()
                        held = 0
                elif fresh:
                    key, pieces, size, begun = conv, [START], len(START), True
                made, begin, end = turn(role, text)
                if role == "assistant":
                    spans.append({"begin": size + begin, "end": size + end})
                pieces.append(made)
                size += len(made)
        if begun:
            done.append((key, part, "".join(pieces), spans))
        if done:
            yield out()

    return ordered.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {dict(rows.dtypes)['conv_id']}, part long, formatted string, loss_spans array<struct<begin:long,end:long>>")


class Digest:
    """What the parts of one conversation hold, read in order."""

    def __init__(self, key):
        self.key, self.parts, self.turns, self.loss_chars, self.chars = key, 0, 0, 0, 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, part: int, text: str, spans: list[dict]) -> None:
        if part != self.parts:
            raise Mismatch(f"part {part} of a conversation comes after {self.parts} parts")
        for role, said, _, _ in parse(text, 0 if part else len(START)):
            self.turns += 1
            self.said.update(f"{role}\n{said}\n".encode())
        for s in spans:
            masked = unescape(text[s["begin"] : s["end"]])
            self.loss.update(masked.encode())
            self.loss_chars += len(masked)
        self.parts, self.chars = part + 1, self.chars + len(text)

    def row(self) -> tuple:
        return self.key, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(conversations: DataFrame) -> DataFrame:
    """Digests of what the formatted texts hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Parts of a conversation have to come one after another, as ``formatted`` gives them; anything else is refused.
    """
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kind = None, pa.int64()

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in found], kind), *[pa.array([o[i] for o in found], pa.string() if n.endswith("sha256") else pa.int64()) for i, n in enumerate(names, 1)]], names=["conv_id", *names]
            )

        for batch in batches:
            kind, found = batch.column("conv_id").type, []
            for key, part, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss_spans")), strict=True):
                if part == 0 or now is None or now.key != key:
                    if now is not None:
                        found.append(now.row())
                    now = Digest(key)
                now.add(part, text, spans)
            yield out(found)
        if now is not None:
            yield out([now.row()])

    kinds = ", ".join(f"{n} {'string' if n.endswith('sha256') else 'long'}" for n in names)
    return conversations.select("conv_id", "part", "formatted", "loss_spans").mapInArrow(run, f"conv_id {dict(conversations.dtypes)['conv_id']}, {kinds}")
