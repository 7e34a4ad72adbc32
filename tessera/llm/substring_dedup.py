"""Repeated word windows, found by super-k-mer partitioning.

A window is WINDOW consecutive words. Its minimiser is the least hash of the MER-word runs
in it. Consecutive windows with one minimiser form a super-k-mer, which is packed as one
string (its words joined by spaces) and travels to the minimiser's bucket, where
all windows of the bucket's strings are sorted; the first of equal windows has the smallest document.

1. Minimisers of all windows are written without text. Equal windows have equal
   minimisers, so only those seen in two documents matter.
2. Documents with such super-k-mers (compressed) meet the positions of theirs and are packed.
3. Equal strings of a bucket are combined before the shuffle, with their smallest document.
   A bucket whose windows have over MOST bytes is never brought together: they are dealt out by
   their text, combined before the shuffle.
4. Windows whose first document is smaller are joined to spans of words, and the spans cut
   from their documents.

Strings are looked up again by 128-bit digests; windows are compared as they are. A null
text has no words. A null id counts as larger than all. Rows with the same id never
cover each other; repeated rows give repeated results; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, chunks, discard, map_arrow, text_of, to_python, written

WINDOW, MER = 50, 12
#: Windows of a super-k-mer, and bytes of a bucket's windows that are sorted in one place.
LONGEST, MOST = 200, 16 << 20
#: Large buckets whose names may be broadcast.
MOST_LARGE = 1_000_000
#: Bytes whose words are hashed at once; about 40 times as many are held meanwhile.
PIECE = 256 << 10
#: The six ASCII characters between words.
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15 | 1, U))
BYTES = mixed(np.arange(1, 257, dtype=U))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word. A word that goes on in the next piece adds up over both."""
    first, last, sums = [], [], []
    since = 0  # where a word that has not ended began
    for at in range(0, len(data), PIECE):
        b = np.frombuffer(data, np.uint8, min(PIECE, len(data) - at), at)
        gap = SPACE[b]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        edge = np.concatenate([[0] if not gap[0] else [], edge, [len(b)] if not gap[-1] else []]).astype(np.int32)
        begin, end = edge[0::2], edge[1::2]
        if not len(begin):
            continue
        size = end - begin
        heads = np.cumsum(size, dtype=np.int32) - size
        inner = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(heads, size)
        value = BYTES[b[inner + np.repeat(begin, size)]]
        if begin[0] == 0 and last and last[-1][-1] == at:
            inner[: size[0]] += (at - since) & 4095
        value *= POWERS[inner & 4095]
        if not (begin[-1] == 0 and last and last[-1][-1] == at):
            since = at + int(begin[-1])
        first.append(begin.astype(np.int64) + at)
        last.append(end.astype(np.int64) + at)
        sums.append(np.add.reduceat(value, heads))
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, U)
    first, last, sums = map(np.concatenate, (first, last, sums))
    heads = np.flatnonzero(np.concatenate([[True], first[1:] != last[:-1]]))
    size = np.add.reduceat(last - first, heads)
    return first[heads], mixed(np.add.reduceat(sums, heads) + size.astype(U))


def window_least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values, by doubling."""
    have, size = x, 1
    while size * 2 <= n:
        have, size = np.minimum(have[:-size], have[size:]), size * 2
    return np.minimum(have[: len(x) - n + 1], have[n - size :]) if size < n else have


def super_kmers(texts: list[bytes], window: int = WINDOW, mer: int = MER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document number, first window, number of windows and minimiser of each super-k-mer."""
    data = b"\n".join(texts)
    starts, h = word_hashes(data)
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, none.astype(U)
    offset = np.cumsum([0, *(len(x) + 1 for x in texts)])
    first = np.searchsorted(starts, offset)  # of each document's words
    runs = np.zeros(len(h) - mer + 1, U)
    for j in range(mer):
        runs += h[j : j + len(runs)] * POWERS[j]
    least = window_least(mixed(runs), window - mer + 1)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + window <= first[doc + 1])
    if not len(at):
        return none, none, none, none.astype(U)
    v, d = least[at], doc[at]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])])
    head = np.flatnonzero(new)
    inner = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
    head = np.flatnonzero(new | (inner % LONGEST == 0))
    return d[head], at[head] - first[d[head]], np.diff(np.append(head, len(at))), v[head]


def text_key(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def minimisers(rows: DataFrame) -> DataFrame:
    """doc, key (of the text), first, n, mini of each super-k-mer."""

    def one(b):
        texts, ids = b.column("text").cast(pa.binary()).to_pylist(), b.column("doc").to_numpy()
        d, first, n, v = super_kmers(texts)
        keys = np.array([text_key(x) for x in texts], np.int64)
        return {"doc": ids[d], "key": keys[d], "first": first, "n": n, "mini": v.view(np.int64)}

    return map_arrow(rows, one, "doc long, key long, first int, n int, mini long", "text", 512 << 10)


def whole(rows: DataFrame) -> DataFrame:
    """doc, key, n_words and the digest of all words of each document."""

    def one(b):
        out = {"key": [], "n_words": [], "sha": []}
        for x in b.column("text").cast(pa.binary()).to_pylist():
            words = x.split()
            out["key"].append(text_key(x))
            out["n_words"].append(len(words))
            out["sha"].append(hashlib.sha256(b" ".join(words)).hexdigest())
        return {"doc": b.column("doc")} | out

    return map_arrow(rows, one, "doc long, key long, n_words long, sha string", "text")


def compressed(rows: DataFrame) -> DataFrame:
    """doc, key and the compressed text."""

    def one(b):
        z = zstandard.ZstdCompressor(level=3)
        texts = b.column("text").cast(pa.binary()).to_pylist()
        return {"doc": b.column("doc"), "key": [text_key(x) for x in texts], "z": [z.compress(x) for x in texts]}

    return map_arrow(rows, one, "doc long, key long, z binary", "text")


def packed(hits: DataFrame) -> DataFrame:
    """doc, key, first, mini, id (digest), string and the bytes of its windows, of each super-k-mer listed in `at`."""

    def one(b):
        z = zstandard.ZstdDecompressor()
        out = {k: [] for k in ("doc", "key", "first", "mini", "id", "string", "weight")}
        for doc, key, blob, at in zip(*(b.column(c).to_pylist() for c in ("doc", "key", "z", "at")), strict=True):
            words = z.decompress(blob).split()
            for x in at:
                string = b" ".join(words[x["first"] : x["first"] + x["n"] + WINDOW - 1])
                for k, v in zip(out, (doc, key, x["first"], x["mini"], xxhash.xxh3_128_digest(string), string, len(string) * x["n"] * WINDOW // (x["n"] + WINDOW - 1)), strict=True):
                    out[k].append(v)
        return out

    return map_arrow(hits, one, "doc long, key long, first int, mini long, id binary, string binary, weight long", "z", 256 << 10)


def windows_of(string: bytes) -> list[bytes]:
    """The windows of a packed string."""
    words = string.split(b" ")
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    return [string[starts[i] : ends[i + WINDOW - 1] - 1] for i in range(len(words) - WINDOW + 1)]


def first_documents(strings: list[bytes], docs: list[int]) -> list[list[int]]:
    """For each window of each string the smallest document that has it: all windows are sorted, equal ones follow each other."""
    if len(strings) == 1:
        n = strings[0].count(b" ") + 2 - WINDOW
        if n == 1:
            return [[docs[0]]]
    order = sorted((w, docs[r], r, i) for r, s in enumerate(strings) for i, w in enumerate(windows_of(s)))
    out: list[list[int]] = [[] for _ in strings]
    places: list[list[tuple[int, int]]] = [[] for _ in strings]
    last, least = None, 0
    for w, d, r, i in order:
        if w != last:
            last, least = w, d
        places[r].append((i, least))
    for r, p in enumerate(places):
        out[r] = [d for _, d in sorted(p)]
    return out


def sorted_buckets(rows: DataFrame) -> DataFrame:
    """mini, id, firsts (of each window) of the strings of each bucket."""
    form = pa.schema([("mini", pa.int64()), ("id", pa.binary()), ("firsts", pa.list_(pa.int64()))])

    def run(batches) -> Iterator[pa.RecordBatch]:
        mini, ids, strings, docs = None, [], [], []
        done: dict[str, list] = {k: [] for k in form.names}

        def end():
            if ids:
                done["mini"] += [mini] * len(ids)
                done["id"] += ids
                done["firsts"] += first_documents(strings, docs)

        def flush():
            got = pa.RecordBatch.from_pydict(done, form)
            for v in done.values():
                v.clear()
            return got

        for b in chunks(batches, "string"):
            for m, i, s, d in zip(*(b.column(c).to_pylist() for c in ("mini", "id", "string", "doc")), strict=True):
                if m != mini:
                    end()
                    mini, ids, strings, docs = m, [], [], []
                    if len(done["id"]) >= 5000:
                        yield flush()
                ids.append(i)
                strings.append(s)
                docs.append(d)
        end()
        if done["id"]:
            yield flush()

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "mini").sortWithinPartitions("mini")
    return to_python(dealt, run, "mini long, id binary, firsts array<long>")


def dealt_windows(big: DataFrame) -> DataFrame:
    """id, firsts of strings of large buckets: each window goes where its own text sends it."""

    def one(b):
        out = {"mini": [], "id": [], "i": [], "window": [], "doc": []}
        for m, k, s, d in zip(*(b.column(c).to_pylist() for c in ("mini", "id", "string", "doc")), strict=True):
            for i, w in enumerate(windows_of(s)):
                for name, v in zip(out, (m, k, i, w, d), strict=True):
                    out[name].append(v)
        return out

    each = written(map_arrow(big, one, "mini long, id binary, i int, window binary, doc long", "string", 128 << 10), "windows")
    least = each.groupBy("window").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    # written, so that the join meets the windows as they are and Spark can split those of a frequent one
    least = written(least.select(F.col("window").alias("of"), "first"), "least")
    rows = each.join(least, F.col("window") == F.col("of"), "left").withColumn("first", F.coalesce("first", "doc"))
    return rows.groupBy("mini", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "first"))), lambda x: x["first"]).alias("firsts"))


def covered(rows: DataFrame) -> DataFrame:
    """doc, key, a, b: words a to b (exclusive) that windows of smaller documents cover."""

    def one(b):
        out = {"doc": [], "key": [], "a": [], "b": []}
        for doc, key, first, firsts in zip(*(b.column(c).to_pylist() for c in ("doc", "key", "first", "firsts")), strict=True):
            i = 0
            while i < len(firsts):
                if firsts[i] < doc:
                    j = i
                    while j + 1 < len(firsts) and firsts[j + 1] < doc:
                        j += 1
                    for name, v in zip(out, (doc, key, first + i, first + j + WINDOW), strict=True):
                        out[name].append(v)
                    i = j
                i += 1
        return out

    return map_arrow(rows, one, "doc long, key long, a int, b int", "size")


def cut(rows: DataFrame) -> DataFrame:
    """doc, key, n_removed, sha, kept of documents with spans."""

    def one(b):
        z = zstandard.ZstdDecompressor()
        out = {"n_removed": [], "sha": [], "kept": []}
        for blob, spans in zip(b.column("z").to_pylist(), b.column("spans").to_pylist(), strict=True):
            words, kept, at = z.decompress(blob).split(), [], 0
            for x in sorted(spans, key=lambda x: x["a"]):
                if x["a"] > at:
                    kept += words[at : x["a"]]
                at = max(at, x["b"])
            kept += words[at:]
            text = b" ".join(kept)
            out["n_removed"].append(len(words) - len(kept))
            out["sha"].append(hashlib.sha256(text).hexdigest())
            out["kept"].append(text.decode())
        return {"doc": b.column("doc"), "key": b.column("key")} | out

    return map_arrow(rows, one, "doc long, key long, n_removed long, sha string, kept string", "z", 512 << 10)


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(doc, key, n_words, sha) of each row, and (doc, key, n_removed, sha, kept) of each document that loses words."""
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), text_of(text_col).alias("text"))
    minis = written(minimisers(rows), "minimisers")
    shared = minis.groupBy("mini").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select(F.col("mini").alias("of"))
    mine = minis.join(shared, F.col("mini") == F.col("of")).dropDuplicates(["doc", "key", "first"])
    per = mine.groupBy("doc", "key").agg(F.collect_list(F.struct("first", "n", "mini")).alias("at"))
    hits = written(compressed(rows).join(per, ["doc", "key"]).dropDuplicates(["doc", "key"]), "hits")
    discard(minis)
    strings = written(packed(hits), "strings")
    once = written(strings.groupBy("mini", "id", "string").agg(F.min("doc").alias("doc"), F.first("weight").alias("weight")), "once")
    # buckets are weighed before they meet: a large one never comes into one task
    large = written(once.groupBy("mini").agg(F.sum("weight").alias("weight")).where(F.col("weight") > most).select(F.col("mini").alias("of")), "large")
    n = large.count()
    if n:
        named = F.broadcast(large) if n <= MOST_LARGE else large
        small, big = (once.join(named, F.col("mini") == F.col("of"), how) for how in ("left_anti", "left_semi"))
        firsts = written(sorted_buckets(small), "buckets").unionByName(written(dealt_windows(big), "buckets"))
    else:
        firsts = written(sorted_buckets(once), "buckets")
    discard(once, large)
    firsts = firsts.where(F.size("firsts") > 0).withColumn("lo", F.array_min("firsts"))
    back = strings.select("doc", "key", "first", "mini", "id").join(firsts, ["mini", "id"]).where("lo < doc")
    spans = covered(back.select("doc", "key", "first", "firsts", F.lit(b"").alias("size")))
    per = spans.groupBy("doc", "key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return whole(rows), cut(hits.select("doc", "key", "z").join(per, ["doc", "key"]))


def op6(spark, docs: DataFrame) -> DataFrame:
    all_rows, less = deduplicate(docs)
    less = written(less.select(F.col("doc").alias("of_doc"), F.col("key").alias("of_key"), "n_removed", F.col("sha").alias("kept_sha")), "kept")
    got = all_rows.join(less, (F.col("doc") == F.col("of_doc")) & (F.col("key") == F.col("of_key")), "left")
    return got.select(F.when(F.col("doc") != LAST_ID, F.col("doc")).alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))
