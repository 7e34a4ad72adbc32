"""Near-duplicates by word shingles: SimHash with pigeonring filtering and prefixes of sets bring candidates together, then an exact check.

Rows are linked if the Jaccard similarity of their sets of k-word shingles (A-Z lower-cased; fewer words
make one shingle) is `similarity` or more; a group is what links connect.

* Rows with the same set (told by 128 bits of its sorted hashes) are one node. Fingerprints have 256 bits (SimHash), each distinct shingle counted once.
* The first 64 bits of the fingerprints go through the pigeonring of simhash.py: its buckets, its budgets of chains and its distance give candidates, too.
* All sets are put in one order, shingles that are common in a sample of texts last. Two sets of n and m shingles that are
  as similar as asked share one of the first n - ceil(similarity * n) + 1 and m - ceil(similarity * m) + 1, whatever the order, so
  each node is sent to the buckets of these and each pair meets, at any length.
* Pairs that meet are candidates if their sizes allow the similarity. Fingerprints rule out no pair, they only say in which order pairs of large buckets are looked at.
* Buckets of up to SHORT rows give all candidates. Of larger ones, parts of PART rows first give minimum spanning
  forests by Hamming distance, with edges of up to RADIUS bits; once these are verified, all candidates between different groups follow, however far their fingerprints are.
* Candidates are compared by odd sketches before any text is moved: each shingle flips one of ODD bits, so two sketches differ in no more bits than the sets
  do in shingles, and a pair whose sketches differ in more than the similarity leaves room for is none. That bound is exact and close (long sets have a wide sketch, too), so
  links do not grow with the square of a group, and none is lost to it.
* Each candidate is verified on the shingles of the two whole texts. No pair is linked by an estimate.

Null texts are empty; texts without words are one group; very long texts are one set each, of all their shingles; repeated rows stay, and rows that share an id are judged by their texts; null ids are never the smallest
unless all are null; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash as S
from .common import chunks, map_arrow, text_of, to_python, written
from .components import components

SIMILARITY, K = 0.8, 5
#: Bits of an edge of a forest, at most: 48 of 256, the mean at a similarity of 0.8 for the least favourable sizes (4 and 5 shingles), and six standard deviations of 6.2.
#: Longer edges would hardly be verified; their pairs come with those between groups.
RADIUS = 88
KEPT = 4
#: Texts of the sample that tells common shingles, how many have to hold one, and how many shingles are sent to all tasks.
SAMPLE, COMMON, MOST_COMMON = 20_000, 4, 200_000
#: Rows of a part of a large bucket that gets a forest.
PART = 1024
#: Rows of a table of two longs that may be broadcast.
MOST_SENT = 1_000_000
#: Bits of an odd sketch; and of a second one, of sets of over LONG_SET shingles, for which the first is too full to tell.
ODD, WIDE, LONG_SET = 1024, 1 << 14, 1500
ODDS = [f"o{w}" for w in range(ODD // 64)]
WORDS, SETS = [f"w{w}" for w in range(KEPT)], ["set0", "set1"]


def shingles_of(data: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(np.array(S.shingle_hashes(data, k), np.uint64))


def odd_sketch(s: np.ndarray, bits: int = ODD) -> np.ndarray:
    """`bits` (a power of two) as longs: how often, modulo 2, each is some shingle's."""
    place = (s * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits.bit_length() + 1)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(bool)).view(np.int64)


def prefix(s: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set, one of which any set as similar has among its own first ones."""
    known, often = common
    n = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1
    if not len(s) or not len(known):
        return s[:n]
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    return s[np.lexsort((s, np.where(known[at] == s, often[at], 0)))[:n]]


def common_shingles(df: DataFrame, text_col: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that COMMON texts of a sample hold, and how many do. Any order is right; this one keeps buckets small."""
    share = min(1.0, SAMPLE / max(1, df.count()))
    texts = df.select(text_of(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))

    def one(batches):
        for b in (c for x in batches for c in chunks([x], "text")):
            lists = [shingles_of(x, k) for x in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).view(np.int64))], names=["s"])

    often = to_python(texts, one, "s long").groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    got = np.array([tuple(r) for r in often.orderBy(F.desc("n"), "s").limit(MOST_COMMON).collect()], np.int64).reshape(-1, 2)
    s = got[:, 0].copy().view(np.uint64)
    order = np.argsort(s)
    return s[order], got[order, 1]


def sets(df: DataFrame, id_col: str, text_col: str, k: int, similarity: float) -> DataFrame:
    """id, text_hash, set0 and set1 (which set it is), fingerprint, odd sketch, number of different shingles and prefix of each row."""
    common = common_shingles(df, text_col, k)

    def one(b):
        lists = [shingles_of(x, k) for x in b.column("text").cast(pa.binary()).to_pylist()]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.concatenate([np.zeros(0, np.uint64), *lists])
        out = {"id": b.column("id"), "text_hash": b.column("text_hash"), "size": counts, "prefix": [prefix(s, similarity, common).view(np.int64) for s in lists]}
        out |= {c: [xxhash.xxh64_intdigest(s.tobytes(), i) - (1 << 63) for s in lists] for i, c in enumerate(SETS)}
        odd = np.stack([odd_sketch(s) for s in lists])
        out |= {c: pa.array(np.ascontiguousarray(odd[:, i])) for i, c in enumerate(ODDS)}
        out["wide"] = [odd_sketch(s, WIDE) if len(s) > LONG_SET else None for s in lists]
        return out | {w: pa.array(S.majority(S.remixed(flat, i), counts).view(np.int64)) for i, w in enumerate(WORDS)}

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).alias("text"))
    return map_arrow(rows, one, f"id {kind}, text_hash long, size long, prefix array<long>, wide array<long>, " + ", ".join(f"{w} long" for w in [*SETS, *WORDS, *ODDS]), "text", 1 << 20).withColumnRenamed("id", id_col)


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(1, dtype=np.int64)


def forest(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A minimum spanning forest of the graph of rows within the radius."""
    left = np.arange(1, len(fps))
    least, by = np.full(len(left), 1 << 30), np.zeros(len(left), np.int64)
    i, a, b = 0, [], []
    while len(left):
        d = distance(fps[left], fps[i])
        nearer = d < least
        least[nearer], by[nearer] = d[nearer], i
        j = int(least.argmin())
        i = int(left[j])
        if least[j] <= radius:
            a.append(by[j])
            b.append(i)
        for x in (left, least, by):
            x[j] = x[-1]
        left, least, by = left[:-1], least[:-1], by[:-1]
    return np.array(a, np.int64), np.array(b, np.int64)


def alike(rows: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of rows (bucket, salt, node, size, fingerprint, and odd sketch, if they have one) may be as similar as asked."""
    x, y = rows[i, 3], rows[j, 3]
    ok = np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6
    if rows.shape[1] > 4 + KEPT + len(ODDS):
        at, odd = np.flatnonzero(ok), rows[:, 4 + KEPT : 4 + KEPT + len(ODDS)].view(np.uint64)
        most = (1 - similarity) / (1 + similarity) * (x + y)[at] + 1e-6  # of different shingles
        ok[at] = distance(odd[np.broadcast_to(i, ok.shape)[at]], odd[np.broadcast_to(j, ok.shape)[at]]) <= most
    return ok


def each_once(rows: np.ndarray, a: list, b: list) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs of different nodes of pairs of rows, each once."""
    if not a:
        return None
    x, y = rows[np.concatenate(a), 2], rows[np.concatenate(b), 2]
    pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1)[x != y], axis=0)
    return (pairs[:, 0], pairs[:, 1]) if len(pairs) else None


def all_pairs(rows: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Candidates of buckets of up to SHORT rows."""
    a, b = [], []
    for i, d in S.within_short(*S.bucket_starts(rows)):
        i = i[alike(rows, i, i + d, similarity)]
        a.append(i)
        b.append(i + d)
    return each_once(rows, a, b)


def forests(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Pairs of the minimum spanning forest of each part of a large bucket."""
    fps, a, b = np.ascontiguousarray(rows[:, 4 : 4 + KEPT]).view(np.uint64), [], []
    for s, n in zip(*S.bucket_starts(rows), strict=True):
        x, y = forest(fps[s : s + n])
        a.append(s + x)
        b.append(s + y)
    return each_once(rows, a, b)


def between(rows: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Candidates of rows of different groups (the last column) of each bucket. The rows of its largest group are only met, not gone through."""
    a, b = [], []
    for s, n in zip(*S.bucket_starts(rows), strict=True):
        _, of, sizes = np.unique(rows[s : s + n, -1], return_inverse=True, return_counts=True)
        order = np.lexsort((of, sizes[of]))
        ends = np.searchsorted(key := (sizes[of] * (n + 1) + of)[order], key, "right")
        for i in range(n):
            if ends[i] == n:
                break
            j = s + order[ends[i] :]
            j = j[alike(rows, np.array([s + order[i]]), j, similarity)]
            a.append(np.full(len(j), s + order[i]))
            b.append(j)
    return each_once(rows, a, b)


def pigeonring(nodes: DataFrame, most: int = S.MOST) -> DataFrame:
    """a, b: links that span what lies within the ring's radius of the first word (w0) of nodes' fingerprints."""

    def send(fps):
        i, bucket = S.EXACT.buckets(fps)
        return i, bucket, fps[i].view(np.int64)

    return S.links(nodes.select("node", "w0"), 1, ["w0"], send, lambda rows: S.spanning_links(rows, S.EXACT), most)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity of two sorted arrays of distinct hashes; two empty ones are alike."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def verified(pairs: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs a, b whose texts (node, text) are as similar as asked. Sorted by a, so its shingles are made once a run."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(two, "b").join(one.hint("merge"), "a").select("a", "b", "text_a", "text_b")

    def check(batches):
        last, shingles = None, None
        for batch in batches:
            for b in chunks([batch], "text_b"):
                keep = []
                x, y = b.column("text_a").cast(pa.binary()), b.column("text_b").cast(pa.binary())
                for row, node in enumerate(b.column("a").to_pylist()):
                    if node != last:
                        last, shingles = node, shingles_of(x[row].as_py(), k)
                    keep.append(jaccard(shingles, shingles_of(y[row].as_py(), k)) >= similarity)
                yield b.select(["a", "b"]).filter(pa.array(keep))

    return to_python(both, check, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, similarity: float = SIMILARITY, most: int = S.MOST) -> DataFrame:
    """id, text_hash, component_id (the smallest id of its group) and root (the group itself) of each row."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    payload = ["size", *WORDS]
    fps = written(sets(df, id_col, text_col, k, similarity), "fingerprints")
    per = fps.groupBy(*SETS).agg(F.min(id_col).alias("least"), F.min(F.struct("text_hash", "size", "prefix", "wide", *WORDS, *ODDS)).alias("one"))
    nodes = written(per.select(F.xxhash64(*SETS).alias("node"), "least", *SETS, "one.*"), "nodes")

    def met(rows: DataFrame, columns: list[str], meet, most: int) -> DataFrame:
        """What S.bucket_links finds in rows of bucket, salt, node and columns."""
        form = "bucket long, a long, b long" + "".join(f", {c} long" for c in columns)
        dealt = rows.select("bucket", "salt", "node", *columns).repartition(n, "bucket", "salt").sortWithinPartitions("bucket", "salt", "node")
        chunk = S.CHUNK * 8 // (3 + len(columns))
        return to_python(dealt, lambda batches: S.bucket_links(batches, columns, meet, most, chunk), form)

    def possible(pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose odd sketches leave room for the similarity; no texts are moved."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        odd = written(nodes.join(ends, "node", "left_semi").select("node", "size", "wide", *ODDS), "odd")
        side = lambda end: odd.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("size", "wide", *ODDS)])
        differ = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in ODDS), F.lit(0))
        most = F.lit((1 - similarity) / (1 + similarity)) * (F.col("size_a") + F.col("size_b")) + 1e-6
        wide = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
        return pairs.join(side("a"), "a").join(side("b"), "b").where(differ <= most).where(F.coalesce(wide <= most, F.lit(True))).select("a", "b")

    def checked(pairs: DataFrame) -> DataFrame:
        """Those of the pairs that are as similar as asked."""
        pairs = written(possible(written(pairs.select("a", "b").distinct(), "met")), "pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = written(nodes.join(ends, "node", "left_semi").select("node", F.col("text_hash").alias("of")), "wanted")
        if wanted.count() <= MOST_SENT:
            wanted = F.broadcast(wanted)
        found = df.select(text_of(text_col).alias("text")).join(wanted, F.xxhash64("text") == F.col("of"))
        texts = written(found.groupBy("node").agg(F.first("text").alias("text")), "texts")
        return written(verified(pairs, texts, k, similarity), "verified")

    sent = nodes.select(F.explode("prefix").alias("bucket"), F.lit(0).cast("long").alias("salt"), "node", *payload)
    first = written(met(sent, payload, lambda rows: all_pairs(rows, similarity), S.SHORT), "links")
    pairs, big = first.where("bucket IS NULL"), first.where("bucket IS NOT NULL").select("bucket", F.col("a").alias("node"), *payload)
    large = not big.isEmpty()
    if large:
        sizes = written(big.groupBy("bucket").agg(F.count("*").alias("rows")).withColumnRenamed("bucket", "of"), "sizes")
        big = big.join(sizes, F.col("bucket") == F.col("of")).drop("of")
        parts = big.withColumn("salt", F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("rows") / F.lit(PART))))
        pairs = pairs.unionByName(met(parts, payload, forests, 1 << 40), allowMissingColumns=True)
    links = checked(pairs.select("a", "b").unionByName(pigeonring(nodes, most)))
    if large:
        roots = written(components(links), "roots").select(F.col("node").alias("of"), "root")
        grouped = big.join(roots, F.col("node") == F.col("of"), "left").withColumn("own", F.coalesce("root", "node")).drop("of", "root")
        grouped = written(grouped, "grouped")
        mixed = grouped.groupBy(F.col("bucket").alias("of")).agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x <> y").select("of")
        rows = grouped.join(mixed, F.col("bucket") == F.col("of"), "left_semi").withColumn("k", F.ceil(F.col("rows") / F.lit(most)))
        rows = rows.withColumn("s", F.pmod(F.xxhash64("node"), F.col("k"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
        rows = rows.withColumn("salt", F.least("s", "o") * F.col("k") + F.greatest("s", "o"))
        odd = nodes.select(F.col("node").alias("of"), *ODDS)
        rows = rows.join(odd, F.col("node") == F.col("of"))
        links = links.unionByName(checked(met(rows, [*payload, *ODDS, "own"], lambda rows: between(rows, similarity), 1 << 40)))
    return S.named(fps.select(id_col, "text_hash", *SETS), nodes.select("node", "least", *SETS), links, SETS).select(id_col, "text_hash", "component_id", "root")
