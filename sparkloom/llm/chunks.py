"""Splitting text for byte-level BPE so that pieces can be encoded once and looked up.

The public pattern never joins a character that isn't white space with a space
after it, and looks at nothing before a match. So a text may be cut before any
space that follows another kind of character, each piece encoded alone, and the
results put end to end. Words repeat, so most pieces are found in a table.
"""

from __future__ import annotations

from collections.abc import Callable

#: Longer pieces (in characters) hardly repeat, as where a script has no spaces: they aren't kept.
LONGEST = 64
#: Places in which pieces that were met are noted, so that the many that occur once don't crowd out others.
MET = 1 << 21
#: What an entry takes beside its piece and its encoding, about, in bytes.
ENTRY = 200


class Memo(dict):
    """What is made of pieces, from the second time on that a piece is asked for; nothing for a piece that doesn't end a run.

    ``once``: of pieces met for the first time, for a single call. ``size``: bytes held, about.
    """

    def __init__(self):
        self.size, self.once, self.met = 0, {}, bytearray(MET)

    def __missing__(self, piece: str) -> bytes | None:
        return self.once[piece]

    def again(self, piece: str) -> bool:
        """Whether a piece was met before (or one that shares its place) and is short enough to be kept."""
        at = hash(piece) % MET
        if self.met[at]:
            return len(piece) <= LONGEST
        self.met[at] = 1
        return False

    def put(self, piece: str, made: bytes | None) -> None:
        self[piece] = made
        self.size += ENTRY + 4 * len(piece) + len(made or b"")

    def halve(self) -> None:
        """Let the older half go, and begin anew to note what was met."""
        for old in list(self)[: (len(self) + 1) // 2]:
            self.size -= ENTRY + 4 * len(old) + len(self.pop(old) or b"")
        self.met = bytearray(MET)


class PieceTable:
    """Encodings of pieces, as bytes that can be joined.

    ``encode`` takes a list of pieces and gives a list of bytes. The older half
    goes when the table holds more than about ``most`` bytes, and long pieces
    aren't kept, so beyond the texts of one call its memory is bounded.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], most: int = 64 << 20):
        self.encode, self.most = encode, most
        self.first, self.later = Memo(), Memo()

    def learn(self, texts: list[list[str]]) -> None:
        """Add what is missing of texts split at single spaces. A piece that doesn't end a run gets None."""
        while self.first.size + self.later.size > self.most:
            self.first.halve()
            self.later.halve()
        later: set[str] = set()
        for t in texts:
            later.update(t[1:])
        for table, mark, seen in ((self.first, "", {t[0] for t in texts}), (self.later, " ", later)):
            new = list(seen - table.keys())
            plain = [p for p in new if p and not p[-1].isspace()]
            made = dict(zip(plain, self.encode([mark + p for p in plain]), strict=True))
            for p in new:
                if table.again(p):
                    table.put(p, made.get(p))
                else:
                    table.once[p] = made.get(p)

    def joined(self, texts: list[str]) -> list[bytes]:
        """The encoding of each text."""
        split = [t.split(" ") for t in texts]
        self.learn(split)
        out = []
        for s in split:
            try:
                out.append(b"".join([self.first[s[0]], *map(self.later.__getitem__, s[1:])]))
            except TypeError:  # white space before a space
                out.append(b"".join(self.encode(whole_pieces(s))))
        self.first.once.clear()
        self.later.once.clear()
        return out


def whole_pieces(split: list[str]) -> list[str]:
    """Pieces of a text split at spaces, each with the run of white space that it begins or ends with."""
    out, now = [], split[0]
    for p in split[1:]:
        if not now or now[-1].isspace():
            now += " " + p
        else:
            out.append(now)
            now = " " + p
    return [*out, now] if now else out
