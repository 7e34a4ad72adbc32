"""SimHash near-duplicates with pigeonring filtering.

Fingerprints. A document's words are hashed in shingles (64 bits by XXH64, seed 42; further
words of 64 bits by remixing); a bit is 1 if it is set in over half of the hashes.

Candidates. The bits are cut into m consecutive segments on a ring. If two fingerprints
differ in t bits or fewer, there is a segment from which on each chain of l segments has l*t/m
differences or fewer (the strong pigeonring principle). With t < m the first segment is equal, and
with 2t/m < 2 the second has one difference at most. So each fingerprint is sent to a bucket for each chain
of two segments, and, with `flips`, to those where one 0 bit of the second segment is 1; two
fingerprints that satisfy the two-segment budgets meet there. Within a bucket, chains of three and four
segments are held against their budgets before the full Hamming check.

Groups. Equal fingerprints are one node from the start. A bucket's rows are sorted next to each other and read
as a stream; only links that span a chunk's components leave it, never all pairs. A bucket of
over MOST rows is dealt again by pairs of salts, each with a bounded number of rows, so no task
has to hold it and no link is lost.

A null text is empty; documents without words have fingerprint zero and are linked like
others; repeated rows stay (one result row for each); a null id is never the smallest unless
all are null; other columns are not read; an empty table gives an empty result. Texts of any length are hashed whole, in slices of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_of, to_python, written
from .components import components

MOST = 16384
#: Runs of a bucket up to this length are compared by offsets, all runs of a chunk at once.
SHORT = 24
CHUNK = 1 << 18
SEED = 42


def shingle_hashes(data: bytes, k: int) -> list[int]:
    """XXH64 of each k-word shingle of lower-cased words, repeats included; fewer words make one shingle."""
    words = data.lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [h(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    stops = (ends - 1).tolist()
    return [h(joined[a:b], SEED) for a, b in zip(starts, stops[k - 1 :], strict=False)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of documents whose hashes follow each other. A byte lane sums one bit of up to 255 hashes."""
    out = np.zeros(len(counts), np.uint64)
    some = counts > 0
    n = counts[some]
    if not len(n):
        return out
    parts = -(-n // 255)
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    doc = np.repeat(np.arange(len(n)), parts)
    inner = np.arange(len(doc)) - np.repeat(np.concatenate([[0], np.cumsum(parts)[:-1]]), parts)
    cuts = first[doc] + 255 * inner
    heads = np.concatenate([[0], np.cumsum(parts)[:-1]])
    fp = np.zeros(len(n), np.uint64)
    lane = np.uint64(0x0101010101010101)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & lane, cuts).view(np.uint8).reshape(-1, 8)
        per = np.add.reduceat(sums.astype(np.int64), heads, axis=0)
        for j in range(8):
            fp |= (2 * per[:, j] > n).astype(np.uint64) << np.uint64(8 * j + k)
    out[some] = fp
    return out


def remixed(h: np.ndarray, w: int) -> np.ndarray:
    """The hashes of the w-th word of a wide fingerprint; word 0 has them unchanged."""
    if w == 0:
        return h
    x = h + np.uint64((w * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, words: int = 1, once: bool = False) -> DataFrame:
    """id, text_hash and w0, w1, ...: the fingerprint in 64-bit words, each as a signed long; `once` counts repeated shingles once."""

    def one(b):
        lists = [shingle_hashes(x, k) for x in b.column("text").cast(pa.binary()).to_pylist()]
        if once:
            lists = [np.unique(np.array(x, np.uint64)) for x in lists]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.concatenate([np.array(x, np.uint64) for x in lists]) if len(lists) else np.zeros(0, np.uint64)
        return {"id": b.column("id"), "text_hash": b.column("text_hash")} | {f"w{w}": pa.array(majority(remixed(flat, w), counts).view(np.int64)) for w in range(words)}

    kind = df.schema[id_col].dataType.simpleString()
    got = map_arrow(df.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).alias("text")), one, f"id {kind}, text_hash long, " + ", ".join(f"w{w} long" for w in range(words)), "text", 1 << 20)
    return got.withColumnRenamed("id", id_col)


class Ring:
    """Segments of a fingerprint of `words` 64-bit words, and the budgets of chains."""

    def __init__(self, words: int, segments: int, radius: int, flips: bool):
        self.words, self.m, self.t, self.flips = words, segments, radius, flips
        bits = 64 * words
        cuts = [bits * i // segments for i in range(segments + 1)]
        self.spans = list(zip(cuts, cuts[1:], strict=False))
        self.masks = []  # of each chain of 1 to 4 segments from each start
        for i in range(segments):
            chain, row = 0, []
            for n in range(min(4, segments)):
                a, b = self.spans[(i + n) % segments]
                chain |= ((1 << (b - a)) - 1) << a
                row.append([np.uint64((chain >> (64 * w)) & (2**64 - 1)) for w in range(words)])
            self.masks.append(row)
        self.chains = {n: np.array([row[n] for row in self.masks], np.uint64) for n in (2, 3) if n < segments}

    def value(self, fps: np.ndarray, i: int) -> np.ndarray:
        """Segment i of fingerprints (rows of words)."""
        a, b = self.spans[i % self.m]
        out = np.zeros(len(fps), np.uint64)
        for w in range(self.words):
            lo, hi = max(a, 64 * w), min(b, 64 * w + 64)
            if lo < hi:
                out |= ((fps[:, w] >> np.uint64(lo - 64 * w)) & np.uint64((1 << (hi - lo)) - 1)) << np.uint64(lo - a)
        return out

    def buckets(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and the buckets they are sent to."""
        rows, out, own = [], [], np.arange(len(fps))
        for i in range(self.m):
            a, b = self.spans[(i + 1) % self.m]
            first, second = self.value(fps, i), self.value(fps, i + 1)
            head = (np.uint64(i) << np.uint64(48)) | (first << np.uint64(b - a))
            rows.append(own)
            out.append(head | second)
            if self.flips:
                for k in range(b - a):
                    bit = np.uint64(1 << k)
                    zero = (second & bit) == 0
                    rows.append(own[zero])
                    out.append((head | second | bit)[zero])
        return np.concatenate(rows), np.concatenate(out)

    def close(self, chain: np.ndarray | int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs hold the budgets of chains of three and four segments from `chain` on, and the radius. A pair that fails here holds them from another chain on, if it is within the radius."""
        diff = x ^ y
        ok = np.ones(len(diff), bool)
        for n, masks in self.chains.items():
            ok &= np.bitwise_count(diff & masks[chain]).sum(1, dtype=np.int64) <= (n + 1) * self.t // self.m
        at = np.flatnonzero(ok)
        ok[at] = np.bitwise_count(diff[at]).sum(1, dtype=np.int64) <= self.t
        return ok


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node) of the components of pairs among n nodes, without the smallest themselves."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def reached(fps: np.ndarray, ring: Ring, chain: int) -> Iterator[tuple[int, np.ndarray]]:
    """Breadth-first search over one bucket, that of a chain; what is reached leaves the search. Yields a row and the rows it reached."""
    left = np.arange(len(fps))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = ring.close(chain, fps[left], fps[i])
            if near.any():
                hit = left[near]
                yield i, hit
                queue += hit.tolist()
                left = left[~near]


def bucket_starts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows and lengths of the buckets (the first two columns) of sorted rows."""
    key = rows[:, :2]
    starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
    return starts, np.diff(np.append(starts, len(rows)))


def within_short(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Rows i and an offset d: i and i + d are in one bucket of at most SHORT rows."""
    n = int(lengths.sum())
    run = np.repeat(np.arange(len(starts)), lengths)
    short = np.flatnonzero(np.repeat((lengths > 1) & (lengths <= SHORT), lengths))
    for d in range(1, int(lengths[lengths <= SHORT].max(initial=1))):
        i = short[short + d < n]
        i = i[run[i] == run[i + d]]
        if len(i):
            yield i, d


def spanning_links(rows: np.ndarray, ring: Ring) -> tuple[np.ndarray, np.ndarray] | None:
    """Links that span the components of rows (bucket, salt, node, words of the fingerprint) within the radius."""
    starts, lengths = bucket_starts(rows)
    fps, node, a, b = np.ascontiguousarray(rows[:, 3:]).view(np.uint64), rows[:, 2], [], []
    for i, d in within_short(starts, lengths):
        i = i[ring.close((rows[i, 0] >> 48).astype(np.int64), fps[i], fps[i + d])]
        a.append(i)
        b.append(i + d)
    for s, n in zip(starts[lengths > SHORT], lengths[lengths > SHORT], strict=True):
        for i, hit in reached(fps[s : s + n], ring, int(rows[s, 0] >> 48)):
            a.append(np.full(len(hit), s + i))
            b.append(s + hit)
    if not a or not sum(map(len, a)):
        return None
    a, b = np.concatenate(a), np.concatenate(b)
    seen, at = np.unique(node[np.concatenate([a, b])], return_inverse=True)
    x, y = spanning(len(seen), at[: len(a)], at[len(a) :])
    return seen[x], seen[y]


def bucket_links(batches: Iterator[pa.RecordBatch], payload: list[str], meet: Callable, most: int, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket: meet's links (bucket null, a, b), and the rows of buckets with over `most` rows (bucket, a)."""
    names = ["bucket", "salt", "node", *payload]
    held: list[np.ndarray] = []  # an array of int64 rows for each batch
    size, over = 0, None

    def out(bucket, a, b, rest):
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *[pa.array(rest[:, j] if rest is not None else [None] * len(a), pa.int64()) for j in range(len(payload))]], names=["bucket", "a", "b", *payload])

    def big(rows):
        return out(rows[:, 0], rows[:, 2], rows[:, 2], rows[:, 3:])

    def cut(rows, last):
        """Yields results of whole buckets of rows; returns the rest."""
        nonlocal over
        if over is not None:
            n = int((rows[:, :2] == over).all(1).sum())
            if n:
                yield big(rows[:n])
                rows = rows[n:]
            if len(rows):
                over = None
        if not len(rows):
            return rows
        tail = len(rows) if last else int(np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1)).max(initial=-1)) + 1
        whole, rest = rows[:tail], rows[tail:]
        if len(whole):
            _, lengths = bucket_starts(whole)
            if lengths.max() > most:
                large = np.repeat(lengths > most, lengths)
                yield big(whole[large])
                whole = whole[~large]
            if len(whole) and (got := meet(whole)) is not None:
                yield out([None] * len(got[0]), *got, None)
        if len(rest) > most:
            over = rest[0, :2].copy()
            yield big(rest)
            rest = rest[:0]
        return rest

    for batch in batches:
        held.append(np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], axis=1))
        size += len(held[-1])
        if size >= chunk:
            rest = yield from cut(np.concatenate(held), False)
            held, size = [rest], len(rest)
    if size:
        yield from cut(np.concatenate(held), True)


def links(nodes: DataFrame, words: int, payload: list[str], send: Callable, meet: Callable, most: int = MOST) -> DataFrame:
    """a, b: what `meet` finds in the buckets of nodes (node, w0, w1, ..., each fingerprint once).

    `send` gives row numbers, buckets and payload columns (int64 rows) of fingerprints; `meet` gives links
    of nodes of whole buckets.
    """
    spark = nodes.sparkSession
    columns = [f"w{w}" for w in range(words)]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = "".join(f", {c} long" for c in payload)
    form, out = f"bucket long, salt long, node long{rest}", f"bucket long, a long, b long{rest}"

    def deal(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                fps = np.stack([b.column(w).to_numpy() for w in columns], axis=1).view(np.uint64)
                i, bucket, load = send(fps)
                cols = [pa.array(bucket.astype(np.int64)), pa.array(np.zeros(len(i), np.int64)), b.column("node").take(pa.array(i)), *[pa.array(load[:, j]) for j in range(len(payload))]]
                yield pa.RecordBatch.from_arrays(cols, names=["bucket", "salt", "node", *payload])

    def met(rows: DataFrame, most: int) -> DataFrame:
        dealt = rows.repartition(n, "bucket", "salt").sortWithinPartitions("bucket", "salt", "node")
        return to_python(dealt, lambda batches: bucket_links(batches, payload, meet, most), out)

    first = written(met(to_python(nodes.select("node", *columns), deal, form), most), "links")
    found = first.where("bucket IS NULL").select("a", "b")
    big = first.where("bucket IS NOT NULL")
    if not big.isEmpty():
        sizes = big.groupBy("bucket").agg(F.ceil(F.count("*") / F.lit(most)).alias("k")).withColumnRenamed("bucket", "of")
        rows = big.join(sizes, F.col("bucket") == F.col("of")).withColumn("s", F.pmod(F.xxhash64("a"), F.col("k")))
        rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        rows = rows.select("bucket", (F.least("s", "o") * F.col("k") + F.greatest("s", "o")).alias("salt"), F.col("a").alias("node"), *payload)
        found = found.unionByName(written(met(rows, 1 << 40), "links").select("a", "b"))
    return found


def name_of_node(words: list[str]):
    """A node is named by its smallest id, `least`; fingerprints of rows without ids by a negative hash."""
    return F.coalesce(F.col("least").cast("long"), -F.abs(F.xxhash64(*words) % (1 << 62)) - 1)


def named(fps: DataFrame, nodes: DataFrame, found: DataFrame, words: list[str]) -> DataFrame:
    """Each row of fps with component_id and root (the component's node), from nodes (node, least, words) and links."""
    roots = written(components(found), "roots")
    with_root = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = with_root.join(roots.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min("least").alias("component_id"))
    names = with_root.join(smallest, "root", "left").select(*[F.col(w).alias(f"of_{w}") for w in words], F.coalesce("component_id", "least").alias("component_id"), "root")
    same = None
    for w in words:
        same = (F.col(w) == F.col(f"of_{w}")) if same is None else same & (F.col(w) == F.col(f"of_{w}"))
    return fps.join(names, same).drop(*[f"of_{w}" for w in words])


def groups(fps: DataFrame, ring: Ring, id_col: str = "doc_id", most: int = MOST) -> DataFrame:
    """Each row of fps with component_id, the smallest id reachable over links within the radius."""
    words = [f"w{w}" for w in range(ring.words)]
    nodes = written(fps.groupBy(*words).agg(F.min(id_col).alias("least")).withColumn("node", name_of_node(words)), "nodes")

    def send(f):
        i, bucket = ring.buckets(f)
        return i, bucket, f[i].view(np.int64)

    return named(fps, nodes, links(nodes, ring.words, words, send, lambda rows: spanning_links(rows, ring), most), words)


#: The ring of the registered query: 64 bits, radius 4 in five segments, exact.
EXACT = Ring(1, 5, 4, True)

def op5(spark, docs: DataFrame) -> DataFrame:
    fps = written(fingerprints(docs), "fingerprints")
    hexed = F.lower(F.lpad(F.hex("w0"), 16, "0"))
    return groups(fps, EXACT).select("doc_id", hexed.alias("fingerprint"), "component_id")
