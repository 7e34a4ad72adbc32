"""Byte-level BPE encoding and decoding by tree reduction.

A text is cut in halves until a part has at most LEAF characters. Leaves are encoded on their own; a
parent joins its two neighbours by encoding a window around the joint again. The window grows
on either side until it ends where a piece starts for certain, whatever stands further away; so
the tokens outside are proven to stay.

* Certain starts, of the splitting pattern SPLIT: white space after something else; the last of two or more white-space
  characters before something else (a run leaves it to what follows); and, among ASCII, a character of another class
  (letter, digit, other) than the one before, unless that is an apostrophe before a letter. No piece spans such a place,
  no match looks behind its start, and none looks further ahead than one character. Other patterns have no
  certain starts here: their windows grow to the whole part, which is right, but does not save work.
* One piece. A window over LONG characters that is a single run of ASCII letters is joined by tokens. A sequence of tokens
  is the encoding of its bytes if and only if each two neighbours are the encoding of their joined bytes. So
  windows of 1, 2, 4, ... tokens on either side of the joint are encoded until the pairs at both window edges hold.

Decoding concatenates the bytes of tokens up the same kind of tree.

A null text is the empty text and has no tokens; repeated rows give repeated results; ties cannot occur; other
columns are not read; an empty table gives an empty result. Very long texts hold 4 bytes a
token and copies of it while two parts are joined; their nodes are as many as their leaves.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_of

#: Characters of a leaf, tokens of a leaf of decoding, and characters of a window from which on one piece is joined by tokens.
LEAF, LEAF_IDS, LONG = 256, 128, 2048
# Characters with the property White_Space, which the rank files' library takes for \s.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Fixed value: the splitting pattern whose certain starts are known.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE, LETTER, DIGIT, OTHER, APOSTROPHE, BEYOND = range(6)


def piece_pattern(pattern: str) -> regex.Pattern:
    """The splitting pattern with White_Space spelled out."""
    out = pattern.replace("[^\\s", f"[^{WHITE}").replace("\\S", f"[^{WHITE}]").replace("\\s", f"[{WHITE}]")
    return regex.compile(out)


class Kinds(dict):
    """The class of each character."""

    white = regex.compile(f"[{WHITE}]")

    def __missing__(self, c: str) -> int:
        kind = SPACE if self.white.match(c) else BEYOND if c > "\x7f" else LETTER if c.isalpha() else DIGIT if c.isdigit() else APOSTROPHE if c == "'" else OTHER
        if len(self) < 4096:
            self[c] = kind
        return kind


KINDS = Kinds()
#: Which neighbouring classes other than white space have a start between them.
CHANGES = frozenset((x, y) for x in (LETTER, DIGIT, OTHER, APOSTROPHE) for y in (LETTER, DIGIT, OTHER, APOSTROPHE) if x != y and (x, y) not in ((APOSTROPHE, LETTER), (APOSTROPHE, OTHER), (OTHER, APOSTROPHE)))


def starts(text: str, i: int, end: int) -> bool:
    """Does a piece start at i for certain, in every part of the text that holds i - 1 and ends at `end` or later?"""
    x, y = KINDS[text[i - 1]], KINDS[text[i]]
    if y == SPACE:
        return x != SPACE or i + 1 < end and KINDS[text[i + 1]] != SPACE
    return (x, y) in CHANGES


class Tree:
    """An encoder for one rank file and pattern."""

    def __init__(self, path: str, pattern: str, leaf: int = LEAF, long: int = LONG):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.leaf, self.long, self.known = max(leaf, 1), max(long, 4), pattern == SPLIT
        self.core = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes_of[i] = t
        self.size_of = [len(t) for t in self.bytes_of]
        self.names = [str(i) for i in range(len(self.bytes_of))]
        self.single = self.core._core_bpe.encode_single_piece
        self.pairs: dict[tuple[int, int], bool] = {}

    @cached_property
    def sound(self) -> bool:
        """The pair rule needs each token to be its own encoding."""
        return all(self.single(t) == [i] for i, t in enumerate(self.bytes_of) if t)

    def holds(self, a: int, b: int) -> bool:
        """Do two neighbouring tokens of a piece stay when their bytes are encoded together?"""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > 200_000:
                self.pairs.clear()
            got = self.pairs[a, b] = self.single(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return got

    def join_tokens(self, a: array, b: array) -> array:
        """The encoding of two neighbouring parts of one piece."""
        if not a or not b or self.holds(a[-1], b[0]):
            return a + b
        k = 1
        while True:
            i, j = max(0, len(a) - k), min(len(b), k)
            w = self.single(self.joined(a[i:] + b[:j]))
            if (i == 0 or self.holds(a[i - 1], w[0])) and (j == len(b) or self.holds(w[-1], b[j])):
                return a[:i] + array("I", w) + b[j:]
            k *= 2

    def window(self, text: str, lo: int, mid: int, hi: int) -> tuple[int, int]:
        """Where the window around the joint begins and ends: at certain starts, or at the ends of the parts."""
        if not self.known:
            return lo, hi
        p = mid - 1
        while p > lo and not starts(text, p, mid):
            p -= 1
        q = mid + 1
        while q < hi and not starts(text, q, hi):
            q += 1
        return max(p, lo), min(q, hi)

    def join(self, text: str, lo: int, mid: int, hi: int, a: array, b: array) -> array:
        """The ids of text[lo:hi] from those of its two parts."""
        p, q = self.window(text, lo, mid, hi)
        i, n = len(a), len(text[p:mid].encode())
        while n > 0:
            i -= 1
            n -= self.size_of[a[i]]
        j, n = 0, len(text[mid:q].encode())
        while n > 0:
            n -= self.size_of[b[j]]
            j += 1
        part = text[p:q]
        if len(part) > self.long and (bare := part[1:] if part[0] == " " else part).isascii() and bare.isalpha() and self.sound:
            middle = self.join_tokens(a[i:], b[:j])
        else:
            middle = array("I", self.core.encode_ordinary(part))
        return a[:i] + middle + b[j:]

    def node(self, text: str, lo: int, hi: int) -> array:
        """The ids of text[lo:hi], by halves."""
        if hi - lo <= self.leaf:
            return array("I", self.core.encode_ordinary(text[lo:hi]))
        mid = (lo + hi) // 2
        return self.join(text, lo, mid, hi, self.node(text, lo, mid), self.node(text, mid, hi))

    def encode(self, text: str) -> array:
        return self.node(text, 0, len(text))

    def joined(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids, leaf: int = LEAF_IDS) -> bytes:
        """Bytes of tokens, concatenated up the tree."""
        if len(ids) <= leaf:
            return self.joined(ids)
        m = len(ids) // 2
        return self.decode(ids[:m], leaf) + self.decode(ids[m:], leaf)


@cache
def tree(path: str, pattern: str, leaf: int = LEAF, long: int = LONG) -> Tree:
    """One encoder a worker process."""
    return Tree(path, pattern, leaf, long)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and `ids` array<int> of each text."""

    def one(b):
        t = tree(path, pattern)
        got = [t.encode(x) for x in b.column("text").to_pylist()]
        ends = np.cumsum([0, *map(len, got)], dtype=np.int32)
        flat = np.frombuffer(b"".join(x.tobytes() for x in got), np.uint32)
        return {"id": b.column("id"), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))}

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), one, f"id {kind}, ids array<int>", "text", 512 << 10).withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and `data` binary of each token list; null lists are empty."""

    def one(b):
        t = tree(path, pattern)
        return {"id": b.column("id"), "data": [t.decode(list(x)) for x in b.column("ids").to_pylist()], "size": b.column("size")}

    kind = df.schema[id_col].dataType.simpleString()
    ids = F.coalesce(F.col(ids_col), F.array().cast("array<int>"))
    return map_arrow(df.select(F.col(id_col).alias("id"), ids.alias("ids"), F.lit(b"").alias("size")), one, f"id {kind}, data binary, size binary", "size").drop("size").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text, decode the ids, and return digests of both: id, n_tokens, ids_sha256, decoded_sha256."""

    def one(b):
        t = tree(path, pattern)
        n, ids_sha, sha = [], [], []
        for x in b.column("text").to_pylist():
            ids = t.encode(x)
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join(map(t.names.__getitem__, ids)).encode()).hexdigest())
            sha.append(hashlib.sha256(t.decode(ids)).hexdigest())
        return {"id": b.column("id"), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": sha}

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), one, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", "text", 512 << 10).withColumnRenamed("id", id_col)


def op10(spark, docs: DataFrame) -> DataFrame:
    import public_tokenizers as P

    return round_trip(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
