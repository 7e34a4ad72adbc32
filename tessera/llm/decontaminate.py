"""Benchmark decontamination by fingerprints of item-sized windows.

A benchmark item of n words is looked for in every window of n words of every document, and in documents of fewer words as they are.

* Shingles are five words (shorter items: all their words), lower-cased in A-Z. A window of as many
  shingles as its item has, with a weighted similarity of 0.8 or more, has to
  share 8/9 of them, so windows with fewer shingles of any item than that are passed over.
* The others get a 64-bit SimHash. Six blocks of 10 or 11 bits index the items: of two fingerprints within RADIUS
  bits one block differs in FLIPS bits at most, so each window looks up every value that near in every block, and meets each item within the radius.
* Those of the window's size and within the radius are verified on words: the weighted Jaccard similarity of
  shingles, weights being how often they occur.
* A document of fewer words than an item is one window, as a whole. Items that share as many shingles with it as
  their two sizes ask for are verified in the same way, without fingerprints.

Items are worked on in blocks of at most ITEMS items and BYTES of text (a longer one is a block by itself), one pass over the documents a block. A
block is sent to all tasks, and the next one is fetched when its results are written, so neither the driver nor a task holds more than one
block, whatever the benchmark's size. Null texts are empty; empty items are never
found; null ids are values like others; repeated documents or items give repeated rows; of equally similar windows the first counts;
other columns are not read; empty tables give an empty result. Very long texts are worked on whole, with some 30 bytes a word.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_of, written
from .substring_dedup import POWERS, mixed, word_hashes

K, SIMILARITY, RADIUS, ITEMS, BYTES = 5, 0.8, 22, 50_000, 16 << 20
#: Bounds of the six blocks of a fingerprint.
BLOCKS = [0, 11, 22, 33, 44, 54, 64]
#: Differing bits of the nearest block: the radius over six blocks.
FLIPS = RADIUS // 6
#: All values of up to FLIPS bits, by the number of bits of a block.
FLIPPED = {b: np.array([sum(1 << i for i in bits) for n in range(FLIPS + 1) for bits in combinations(range(b), n)], np.int64) for b in (10, 11)}
U = np.uint64


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words."""
    out = np.zeros(max(0, len(h) - k + 1), U)
    for j in range(k):
        out += h[j : j + len(out)] * POWERS[j]
    return mixed(out)


def simhash(rows: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of equally many shingle hashes: a bit is 1 if it is in over half."""
    out = np.zeros(len(rows), U)
    for bit in range(64):
        n = ((rows >> U(bit)) & U(1)).sum(1, dtype=np.int64)
        out |= (2 * n > rows.shape[1]).astype(U) << U(bit)
    return out


def weighted(a: list[bytes], b: list[bytes], k: int) -> float:
    """Weighted Jaccard similarity of two word lists' k-word shingles."""
    x, y = (Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) for w in (a, b))
    both = sum((x & y).values())
    return both / (x.total() + y.total() - both) if both else 0.0


class Items:
    """One block of benchmark items with its index."""

    def __init__(self, ids: list, texts: list[bytes]):
        got = [(i, w) for i, x in zip(ids, texts, strict=True) if (w := x.lower().split())]
        self.ids, self.texts = [i for i, _ in got], [b" ".join(w) for _, w in got]
        self.size = np.array([len(w) for _, w in got], np.int64)
        shingles = [runs(h, min(K, len(h))) for h in (word_hashes(x)[1] for x in self.texts)]
        self.fp = np.array([simhash(s[None])[0] for s in shingles], U)
        self.holders, self.maps = {}, {}
        for k in sorted({min(K, int(n)) for n in self.size}):
            own = [i for i, n in enumerate(self.size) if min(K, n) == k]
            held = [np.unique(shingles[i]) for i in own]
            flat, who = np.concatenate(held), np.repeat(np.array(own, np.int32), [len(x) for x in held])
            order = np.argsort(flat, kind="stable")
            self.holders[k] = flat[order], who[order]
            bits = min(24, max(19, len(flat).bit_length() + 4))
            self.maps[k] = np.zeros(1 << bits, bool), U(64 - bits)
            self.maps[k][0][flat >> self.maps[k][1]] = True
        # items by size; the places of each block value among the items of a size
        self.by_size = {n: np.flatnonzero(self.size == n) for n in np.unique(self.size).tolist()}
        self.lists: dict[int, list] = {}

    def blocks(self, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block of the fingerprints of items of a size: the items in order of their values, and where each value's begin."""
        if size not in self.lists:
            own, out = self.by_size[size], []
            for lo, hi in zip(BLOCKS, BLOCKS[1:], strict=False):
                value = ((self.fp[own] >> U(lo)) & U((1 << (hi - lo)) - 1)).astype(np.int64)
                order = np.argsort(value, kind="stable")
                out.append((own[order], value[order]))
            self.lists[size] = out
        return self.lists[size]

    def near(self, fp: np.ndarray, size: int) -> list[tuple[int, int, int]]:
        """(window, item, distance) of all items of this size within the radius."""
        out = set()
        fps, which = np.unique(fp, return_inverse=True)
        for (who, values), lo, hi in zip(self.blocks(size), BLOCKS, BLOCKS[1:], strict=False):
            own = ((fps >> U(lo)) & U((1 << (hi - lo)) - 1)).astype(np.int64)
            probe = own[:, None] ^ FLIPPED[hi - lo][None]
            first, last = np.searchsorted(values, probe), np.searchsorted(values, probe, "right")
            n = (last - first).ravel()
            if not n.any():
                continue
            x = np.repeat(np.arange(len(fps)).repeat(probe.shape[1]), n)
            y = who[np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first.ravel(), n)]
            d = np.bitwise_count(fps[x] ^ self.fp[y])
            at = np.flatnonzero(d <= RADIUS)
            out.update(zip(x[at].tolist(), y[at].tolist(), d[at].tolist(), strict=True))
        rows = [np.flatnonzero(which == x).tolist() for x in range(len(fps))] if out else []
        return sorted((w, y, d) for x, y, d in out for w in rows[x])

    def has(self, s: np.ndarray, k: int) -> np.ndarray:
        """Which shingle hashes are some item's."""
        (seen, shift), flat = self.maps[k], self.holders[k][0]
        out = seen[s >> shift]
        at = np.flatnonzero(out)
        out[at] = flat[np.minimum(np.searchsorted(flat, s[at]), len(flat) - 1)] == s[at]
        return out

    def holding(self, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in s, item) of all items that hold a shingle."""
        flat, who = self.holders[k]
        lo, hi = np.searchsorted(flat, s), np.searchsorted(flat, s, "right")
        n = hi - lo
        at = np.repeat(np.arange(len(s)), n)
        return at, who[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, int, float, int]]:
        """(document, item, first word, distance, similarity, words): the best window of each document and item, the first of equals."""
        lowered = [x.lower() for x in texts]
        starts, h = word_hashes(b"\n".join(lowered))
        first = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in lowered)]))
        best: dict[tuple[int, int], tuple] = {}
        words: dict[int, list[bytes]] = {}
        for k in sorted(self.holders):
            s = runs(h, k)
            if not len(s):
                continue
            hit = self.has(s, k)
            total = np.concatenate([[0], np.cumsum(hit)])
            # documents shorter than an item: what they share is at least SIMILARITY / (1 + SIMILARITY) of both sizes
            share, own = SIMILARITY / (1 + SIMILARITY), np.diff(first) - k + 1
            short = np.flatnonzero((own > 0) & (own < self.size[np.minimum(self.size, K) == k].max() - k + 1))
            for i in short[total[first[short] + own[short]] - total[first[short]] >= share * (2 * own[short] + 1) - 1e-9].tolist():
                mine = s[first[i] : first[i] + own[i]]
                shared, sizes = np.bincount(self.holding(mine, k)[1], minlength=len(self.size)), self.size - k + 1
                for item in np.flatnonzero((sizes > own[i]) & (shared > 0) & (shared >= share * (sizes + own[i]) - 1e-9)).tolist():
                    words.setdefault(i, lowered[i].split())
                    sim = weighted(words[i], self.texts[item].split(), k)
                    if sim >= SIMILARITY:
                        best[i, item] = (-sim, 0, int(np.bitwise_count(simhash(mine[None])[0] ^ self.fp[item])))
            for n in np.unique(self.size[np.minimum(self.size, K) == k]).tolist():
                count = n - k + 1
                need = int(np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * count - 1e-9))
                if len(s) < count:
                    continue
                at = np.flatnonzero(total[count:] - total[:-count] >= need)
                if not len(at):
                    continue
                doc = np.searchsorted(first, at, "right") - 1
                inside = at + n <= first[doc + 1]
                at, doc = at[inside], doc[inside]
                for part in range(0, len(at), 4000):
                    a, d = at[part : part + 4000], doc[part : part + 4000]
                    fp = simhash(s[a[:, None] + np.arange(count)])
                    for w, item, dist in self.near(fp, n):
                        i = int(d[w])
                        if i not in words:
                            words[i] = lowered[i].split()
                        p = int(a[w] - first[i])
                        sim = weighted(words[i][p : p + n], self.texts[item].split(), k)
                        if sim >= SIMILARITY and (-sim, p) < best.get((i, item), (0, 0))[:2]:
                            best[i, item] = (-sim, p, dist)
        length = np.diff(first)
        return [(i, item, p, dist, -sim, int(min(self.size[item], length[i]))) for (i, item), (sim, p, dist) in sorted(best.items())]


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item found in it: id, item, first_word, n_words, distance, similarity."""
    kind, item_kind = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    form = f"id {kind}, item {item_kind}, first_word long, n_words long, distance int, similarity double"
    items = benchmark.select(F.col(item_col).alias("item"), text_of(item_text_col).alias("text"))
    parts, held, size = [], [], 0

    def search(block):
        index: list[Items] = []

        def one(b):
            if not index:
                index.append(Items([i for i, _ in block], [x for _, x in block]))
            ids, got = b.column("id"), index[0].find(b.column("text").cast(pa.binary()).to_pylist())
            return {
                "id": ids.take(pa.array([g[0] for g in got], pa.int64())), "item": [index[0].ids[g[1]] for g in got], "first_word": [g[2] for g in got],
                "n_words": [g[5] for g in got], "distance": [g[3] for g in got], "similarity": [g[4] for g in got],
            }

        return map_arrow(docs, one, form, "text", 1 << 20)

    for r in items.toLocalIterator():  # a partition at a time
        text = r["text"].encode()
        if held and (len(held) >= ITEMS or size + len(text) > BYTES):
            parts.append(written(search(held), "found"))
            held, size = [], 0
        held.append((r["item"], text))
        size += len(text)
    last = search(held)
    out = reduce(DataFrame.unionByName, [*parts, written(last, "found") if parts else last])
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def op9(spark, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark)
