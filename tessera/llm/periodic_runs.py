"""Runs: the maximal periodic stretches of words of each text, by the runs theorem.

Every run holds a Lyndon root which, under the order of words or under the reversed one, is the longest Lyndon word at each place where it stands. So

* words become numbers, the documents of a batch are laid behind one another with numbers of their own, so nothing matches across them;
* the suffix array of each order comes from prefix doubling (only suffixes that are still alike are sorted again), and the next smaller value of the inverse
  suffix array ends the longest Lyndon word at each place: 2 n roots at most;
* a root is extended to both sides by longest common extensions, minima of the LCP array between two suffixes, of the text and of the reversed text, by
  sparse tables over blocks. The LCP array is read at the places where it is not the value before less one, and filled in between.

Of the runs, those of at least REPEATS periods and LEAST words are kept. The first root of such a run goes on for over two periods and three words,
so others, and documents without one, are passed over before the extension.

A null or empty text has no words and no runs. Ids are not judged: a null id, ties and repeated rows are rows like others. Extra columns are not read. Empty
tables give no rows. Very long texts are read whole, one document a batch; a word takes some 200 bytes there.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_of

REPEATS, LEAST = 4, 6
#: Places in a block of a sparse table.
BLOCK = 16
#: Bytes of text that are worked on together.
BATCH = 2 << 20


def suffix_array(code: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order, and the place of each; a suffix ends at `end` of its place, and codes of different documents differ."""
    n = len(code)
    places = np.arange(n)
    sa = np.argsort(code)
    new = np.append(True, np.diff(code[sa]) != 0)
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, places, 0))
    slots, step = np.flatnonzero(~(new & np.append(new[1:], True))), 1  # those that are not alone in their group
    while len(slots):
        s = sa[slots]
        far = s + step
        key = rank[s] * (n + 1) + np.where(far < end[s], rank[np.minimum(far, n - 1)] + 1, 0)
        order = np.argsort(key)
        s, key = s[order], key[order]
        sa[slots] = s
        new = np.append(True, key[1:] != key[:-1])
        rank[s] = slots[np.maximum.accumulate(np.where(new, places[: len(s)], 0))]
        slots, step = slots[~(new & np.append(new[1:], True))], step * 2
    return sa, rank


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """The next place with a smaller value than each, or the length."""
    r = [*rank.tolist(), -1]
    out = [0] * len(r)
    for i in range(len(r) - 2, -1, -1):
        x, j = r[i], i + 1
        while r[j] > x:
            j = out[j]
        out[i] = j
    return np.array(out[:-1], np.int64)


def common_prefixes(code: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """The length of what each suffix shares with the one before it in order."""
    n = len(code)
    padded = np.append(code, -1)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    alike = np.zeros(n, bool)
    alike[1:] = (before[1:] > 0) & (code[:-1] == padded[before[1:] - 1])  # one less than at the place before
    read = np.flatnonzero(~alike & (before >= 0))
    a, b, got = read, before[read], np.zeros(len(read), np.int64)
    open_, length = np.arange(len(read)), 0
    while len(open_) > 64:
        open_ = open_[padded[a[open_] + length] == padded[b[open_] + length]]
        length += 1
        got[open_] = length
    for k in open_.tolist():
        x, y, size = int(a[k]) + length, int(b[k]) + length, 64
        while True:
            u, v = padded[x : x + size], padded[y : y + size]
            m = min(len(u), len(v))
            off = np.flatnonzero(u[:m] != v[:m])
            if len(off):
                got[k] = min(x - a[k], y - b[k]) + off[0]
                break
            x, y, size = x + m, y + m, size * 2
    out = np.zeros(n, np.int64)
    out[read] = got
    last = np.maximum.accumulate(np.where(alike, 0, np.arange(n)))
    return (out[last] - (np.arange(n) - last))[sa]


class Minima:
    """Least values of ranges: prefixes and suffixes of blocks, and a sparse table over whole blocks."""

    def __init__(self, values: np.ndarray):
        wide = np.full(-(-len(values) // BLOCK) * BLOCK, np.iinfo(np.int64).max)
        wide[: len(values)] = values
        rows = wide.reshape(-1, BLOCK)
        self.values, self.left = wide, np.minimum.accumulate(rows, axis=1).ravel()
        self.right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [rows.min(axis=1)]
        while (w := 1 << len(self.table) - 1) < len(self.table[-1]):
            self.table.append(np.minimum(self.table[-1][:-w], self.table[-1][w:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value from low to high, both included; low <= high."""
        a, b = low // BLOCK, high // BLOCK
        out = np.minimum(self.right[low], self.left[high])
        level = np.frexp(np.maximum(b - a - 1, 0))[1] - 1
        for k in range(len(self.table)):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(out[at], np.minimum(self.table[k][a[at] + 1], self.table[k][b[at] - (1 << k)]))
        same = np.flatnonzero(a == b)
        if len(same):
            lo, hi, got = low[same], high[same], self.values[low[same]]
            for t in range(1, BLOCK):
                got = np.minimum(got, np.where(lo + t <= hi, self.values[np.minimum(lo + t, hi)], got))
            out[same] = got
        return out


class Extensions:
    """Longest common extensions of pairs of places of a text."""

    def __init__(self, code: np.ndarray, sa: np.ndarray):
        self.rank = np.empty(len(sa), np.int64)
        self.rank[sa] = np.arange(len(sa))
        self.minima = Minima(common_prefixes(code, sa))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.rank[i], self.rank[j]
        return self.minima.least(np.minimum(a, b) + 1, np.maximum(a, b))


def runs(docs: list[np.ndarray], repeats: int = REPEATS, least: int = LEAST) -> list[np.ndarray]:
    """start, length and period of the runs of each document (an array of numbers not below 0), by start, then period; repeats is 4 at least."""
    if repeats < 4:
        raise ValueError("runs of under four periods are not looked for")
    none = np.zeros((0, 3), np.int64)
    sizes = np.array([len(d) for d in docs], np.int64)
    n = int(sizes.sum())
    if not n:
        return [none] * len(docs)
    word, doc = np.concatenate(docs).astype(np.int64), np.repeat(np.arange(len(docs)), sizes)
    base = int(word.max()) + 1
    later = (len(docs) - 1 - doc) * base  # later documents are smaller, so Lyndon words end with theirs
    code = later + word
    end = np.repeat(np.cumsum(sizes), sizes)
    sa, rank = suffix_array(code, end)
    found = []
    for r in (rank, suffix_array(later + base - 1 - word, end)[1]):
        place = np.arange(n)
        period = next_smaller(r) - place
        for t in range(3):  # three words more come again
            far = place + period + t
            ok = far < end[place]
            ok[ok] = code[place[ok] + t] == code[far[ok]]
            place, period = place[ok], period[ok]
        found.append((place, period))
    place, period = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(place):
        return [none] * len(docs)
    some = np.zeros(len(docs), bool)
    some[doc[place]] = True
    keep = some[doc]
    new = np.cumsum(keep) - 1
    code, sa, place, n = code[keep], new[sa[keep[sa]]], new[place], int(keep.sum())
    going = Extensions(code, sa).common(place, place + period)
    far = going > 2 * period
    place, period, going = place[far], period[far], going[far]
    if not len(place):
        return [none] * len(docs)
    held = sizes[some]
    from_, of = np.repeat(np.cumsum(held) - held, held), np.repeat(np.flatnonzero(some), held)
    back = np.zeros(len(place), np.int64)
    inner = np.flatnonzero(place > from_[place])
    mirror = code[::-1]
    behind = Extensions(mirror, suffix_array(mirror, n - from_[::-1])[0])
    back[inner] = behind.common(n - place[inner], n - place[inner] - period[inner])
    length = back + period + going
    ok = length >= np.maximum(least, repeats * period)
    all_ = np.unique(np.stack([of[place], place - back - from_[place], length, period], axis=1)[ok], axis=0)
    all_ = all_[np.lexsort((all_[:, 3], all_[:, 1], all_[:, 0]))]
    cuts = np.searchsorted(all_[:, 0], np.arange(1, len(docs)))
    return np.split(all_[:, 1:], cuts)


def collapsed(words: list, found: np.ndarray) -> list:
    """The words that no run holds after its first period."""
    if not len(found):
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def find_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: int = REPEATS, least: int = LEAST) -> DataFrame:
    """The id, runs (array of start, length, period, by start, then period) and collapsed (the kept words, joined by one space) of each row."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def one(b):
        texts = [x.split() for x in b.column("text").cast(pa.binary()).to_pylist()]  # of bytes, so at ASCII white space
        numbers: dict[bytes, int] = {}
        got = runs([np.array([numbers.setdefault(w, len(numbers)) for w in t], np.int64) for t in texts], repeats, least)
        flat = np.concatenate(got) if got else np.zeros((0, 3), np.int64)
        offsets = pa.array(np.append(0, np.cumsum([len(g) for g in got])), pa.int32())
        items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
        return {"id": b.column("id"), "runs": pa.ListArray.from_arrays(offsets, items).cast(kind), "collapsed": pa.array([b" ".join(collapsed(t, g)) for t, g in zip(texts, got, strict=True)], pa.binary())}

    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    form = f"id {df.schema[id_col].dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
    return map_arrow(rows, one, form, "text", BATCH).select(F.col("id").alias(id_col), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def repeated_words(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, in which the words of a tenth of them (by the id's checksum) come again from some place on."""
    words = F.filter(F.split(text_of(), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", text_of().alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h")).withColumn("g", F.floor(F.col("h") / 10))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    word = lambda i: F.element_at("words", (F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")) + 1).cast("int"))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), word), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op12(spark, docs: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of find_runs() over repeated_words()."""
    found = find_runs(repeated_words(docs))
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    rows = found.withColumn("best", F.when(F.size("runs") > 0, longest))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.length")).alias("length"), F.col("best.period").alias("period"),
        F.expr("-1000 * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
