"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton.

Bytes are mapped to Latin-1 characters, so one automaton pass finds every vocabulary entry in a piece. The encoding is the
only sequence of entries in which each adjacent pair is compatible: merged together by rank, the two come out as the same
two. The search takes the longest match at each place and, when it isn't compatible with what stands before, the next
shorter one, or steps back; a place found hopeless is never tried again, so work is linear in the piece. Compatibility is
memoised by pair. Pieces that are entries themselves encode to that entry.

Null texts count as empty; an empty text has no ids. Rows are kept one for one, also repeated ones and null ids; tables without rows give
none. Texts are whole, however long; a piece's matches are found window by window. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import sys
import unicodedata
from array import array
from collections.abc import Sequence

import ahocorasick
from pyspark.sql import DataFrame

from .common import map_chunks

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Entries of each memo table; when full it starts anew.
MEMO = 250_000
#: Bytes of a piece whose matches are held at once.
WINDOW = 1 << 14
_NONE = 1 << 60
#: Unicode's White_Space, as a class body (fixed values of the standard).
_LATIN_SPACE = r"\t-\r \x85\xa0"
_SPACE = _LATIN_SPACE + "  -     　"


#: One more than the last code point, and than Latin-1's.
ALL, LATIN = sys.maxunicode + 1, 256


@functools.cache
def _class_body(major: str, limit: int = ALL) -> str:
    """The code points below ``limit`` of a general category (L or N) as the inside of a regular expression's class."""
    out, start = [], None
    for c in range(limit + 1):
        inside = c < limit and unicodedata.category(chr(c))[0] == major
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@functools.cache
def splitter(pattern: str, limit: int = ALL) -> re.Pattern:
    """``pattern`` (with the classes L and N, and white space) for the standard library's faster matcher, and for texts of code points below ``limit``.

    Within Latin-1 a class is a small bit map, which is several times faster; on such texts the matches are the same.
    """
    inner = {r"\p{L}": _class_body("L", limit), r"\p{N}": _class_body("N", limit), r"\s": _SPACE if limit > LATIN else _LATIN_SPACE}

    def group(m: re.Match) -> str:
        if m[1]:
            body = m[1]
            for k, v in inner.items():
                body = body.replace(k, v)
            return f"[^{body}]"
        return f"[^{inner[chr(92) + 's']}]" if m[0] == r"\S" else f"[{inner[m[0]]}]"

    return re.compile(re.sub(r"\[\^([^\]]*)\]|\\p\{[LN]\}|\\s|\\S", group, pattern))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Windows:
    """The entries that start at each place of a long piece, shortest first; found for ``WINDOW`` places at a time, two of which are held."""

    def __init__(self, owner: Bpe, b: bytes):
        self.owner, self.b = owner, b
        self.held: dict[int, list[list]] = {}

    def __getitem__(self, at: int) -> list:
        k, i = divmod(at, WINDOW)
        if (window := self.held.get(k)) is None:
            if len(self.held) == 2:
                del self.held[max(self.held, key=lambda x: abs(x - k))]
            window = self.held[k] = self.find(k * WINDOW)
        return window[i]

    def find(self, at: int) -> list[list]:
        size = min(WINDOW, len(self.b) - at)
        starts: list[list] = [[] for _ in range(size)]
        for end, hit in self.owner.found.iter(self.b[at : at + size + self.owner.longest - 1].decode("latin-1")):  # they may end beyond
            if (i := end + 1 - hit[0]) < size:
                starts[i].append(hit)
        return starts


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.entry = ranks, {i: b for b, i in ranks.items()}
        self.wide, self.narrow = splitter(pattern).findall, splitter(pattern, LATIN).findall
        self.names = {i: str(i) for i in self.entry}
        self.found = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.found.add_word(b.decode("latin-1"), (len(b), i))
        self.found.make_automaton()
        self.longest = max(map(len, ranks))
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.pieces: dict[str, Sequence[int]] = {}

    def merged(self, b: bytes) -> list[int]:
        """The merges by rank, done one by one: what defines the encoding. For short strings."""
        parts = [b[i : i + 1] for i in range(len(b))]
        while len(parts) > 1:
            each = [self.ranks.get(x + y, _NONE) for x, y in zip(parts, parts[1:])]
            rank = min(each)
            if rank == _NONE:
                break
            i = each.index(rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        if (known := self.pairs.get(a << 32 | b)) is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self.merged(self.entry[a] + self.entry[b]) == [a, b]
        return known

    def stands(self, a: int) -> bool:
        if (known := self.alone.get(a)) is None:
            known = self.alone[a] = self.merged(self.entry[a]) == [a]
        return known

    def search(self, b: bytes) -> Sequence[int]:
        """What grows with a piece of more than ``WINDOW`` bytes is flat: some 15 bytes an id and one a byte."""
        n = len(b)
        if n <= WINDOW:
            starts: list[list] | Windows = [[] for _ in range(n)]  # matches by start, shortest first
            for end, hit in self.found.iter(b.decode("latin-1")):
                starts[end + 1 - hit[0]].append(hit)
            path, which, ids = [], [], []  # where each id starts, and which match it is
        else:
            starts, path, which, ids = Windows(self, b), array("q"), array("H"), array("i")
        at, k = 0, len(starts[0]) - 1  # k: which match to try next
        hopeless = bytearray(n + 1)
        while at < n:
            here = starts[at]
            while k >= 0:
                size, token = here[k]
                if not hopeless[at + size] and (self.compatible(ids[-1], token) if ids else self.stands(token)):
                    break
                k -= 1
            if k >= 0:
                path.append(at)
                which.append(k)
                ids.append(token)
                at += size
                k = len(starts[at]) - 1 if at < n else 0
            else:
                if not path:
                    raise ValueError("the vocabulary doesn't cover all bytes")
                hopeless[at] = 1
                at, k = path.pop(), which.pop() - 1
                ids.pop()
        return ids

    def piece(self, p: str) -> Sequence[int]:
        if len(self.pieces) >= MEMO:
            self.pieces.clear()
        b = p.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(b)
        ids = (whole,) if whole is not None else self.search(b)
        if len(p) <= 64:
            self.pieces[p] = ids
        return ids

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.wide(text)
        return self.narrow(text)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, add, new = self.pieces.get, out.extend, self.piece
        for p in self.split(text):
            add(known(p) or new(p))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entry.__getitem__, ids))


@functools.cache
def codec(path: str, pattern: str) -> Bpe:
    """One for each Python worker."""
    return Bpe(load_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) for each row of ``docs`` (doc_id, text)."""

    def make():
        c = codec(path, pattern)
        return lambda x: {"doc_id": x["doc_id"], "ids": [c.encode(t or "") for t in x["text"]]}

    return map_chunks(docs.select("doc_id", "text"), make, "doc_id long, ids array<int>", 64)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) for each row of ``encoded`` (doc_id, ids)."""

    def make():
        c = codec(path, pattern)
        return lambda x: {"doc_id": x["doc_id"], "bytes": [c.decode(i or []) for i in x["ids"]]}

    return map_chunks(encoded.select("doc_id", "ids"), make, "doc_id long, bytes binary", 64)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of the ids and of what they decode to, in one pass."""

    def make():
        c = codec(path, pattern)

        def one(text):
            ids = c.encode(text or "")
            return len(ids), hashlib.sha256(",".join(map(c.names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

        def rows(x):
            n, a, b = zip(*map(one, x["text"])) if x["text"] else ((), (), ())
            return {"doc_id": x["doc_id"], "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

        return rows

    return map_chunks(docs.select("doc_id", "text"), make, SCHEMA, 64)
