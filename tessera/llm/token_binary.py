"""Token ids in a binary file format with static range asymmetric numeral coding.

encode_corpus() runs in three passes, each over a table in the shared folder:

1. Texts are dealt by ranges of doc_id, sorted and tokenized; a partition's ids are cut into
   segments of whole documents with SEGMENT or more ids (one row a segment).
2. Occurrences of each id are counted over all segments, and one table of frequencies that
   sum to 2**SCALE is made of them; every id that occurs has 1 or more. It holds one entry a
   vocabulary id, so its size has a bound.
3. Each segment becomes one file (a binary cell): header, document index, and blocks of
   BLOCK ids. A block has LANES interleaved coder states, a checkpoint of them all EVERY
   steps, and checksums of its words and of its ids. Blocks share nothing but the table, so
   any block, or any stretch between checkpoints, is decoded by itself.

File layout, little-endian: magic `TSA1`, scale u32, table checksum u32, lanes u32, block u32,
every u32, documents u64, ids u64, blocks u64; then first_id u64 (ids before the file in its
partition); the doc ids as i64; their lengths as u64; the byte offset of each block as
u64; the blocks. A block: ids u32, words u32, checkpoints u32, crc32 of the ids as u32,
crc32 of all that follows; then for each checkpoint the word offset u32 and the lanes' states u64; then
the words u32.

A null text is empty and holds the end id alone; a null doc_id comes last (as the largest
i64); rows with the same id are in order of their texts; other columns are not read;
an empty table gives no file and no row.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from functools import cache
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import piece_pattern
from .common import LAST_ID, chunks, discard, map_arrow, text_of, to_python, written
from .substring_dedup import mixed

SCALE, LANES, BLOCK, EVERY, SEGMENT = 20, 32, 32768, 256, 1 << 18
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sIIIIIQQQQ")
BHEAD = struct.Struct("<IIIII")
END_ID = 2
ID = attrgetter("id")
#: Rows of the partitions' totals that may be broadcast.
MOST_PARTITIONS = 1_000_000
#: Blocks that take their steps together.
WIDE = 128
#: Bytes of a part that is told apart by its bytes as they are; and the masks of the first 0 to 8 bytes.
LONG = 64
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Classes of bytes: 0 ASCII white space, 1 letter, 2 digit, 3 other, 4 to be looked at by the pattern itself.
CLASS = np.array([0 if b in (9, 10, 11, 12, 13, 32) else 4 if b > 127 or b == 39 or b in (28, 29, 30, 31) else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)


class Kept(dict):
    """Results of a function by key: the last `most` or up to twice as many, those asked for again among them."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = got
        return got


class FastTokens:
    """Ids of a byte-level BPE tokenizer file, as 16- or 32-bit arrays.

    Texts are cut into parts where a piece starts for certain, and the ids of parts are kept. A space
    before a character that is no white space starts one, whatever comes before it: a run of white space
    leaves its last character to what follows. So does a letter, digit or other
    character after one of another class. Next to apostrophes and to characters
    beyond ASCII that are no Latin-1 letters there is no cut; the pattern finds the pieces of such parts.
    Texts that hold an added token of the file as text (such as an end mark) go to the library whole, which gives it its own id.
    """

    KEPT = 600_000

    def __init__(self, path: str):
        import json

        import public_tokenizers as P
        from tokenizers import Tokenizer

        self.all = Tokenizer.from_file(path)
        self.added = [x.content.encode() for x in self.all.get_added_tokens_decoder().values()]
        self.type = np.uint16 if self.all.get_vocab_size() <= 1 << 16 else np.uint32
        form = json.loads(self.all.to_str())
        pre = form["pre_tokenizer"] or {}
        self.plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not form["normalizer"] and form["model"]["type"] == "BPE"
        self.model, self.find = self.all.model, piece_pattern(P.PATTERN).findall
        # the byte alphabet: printable Latin-1 characters stand for themselves, the others follow from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: b for b in own} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(own))}
        self.code = "H" if self.type is np.uint16 else "I"
        self.parts, self.pieces = Kept(self.part, self.KEPT), Kept(self.piece, self.KEPT // 8)

    def piece(self, piece: str) -> bytes:
        """Ids of a piece, by the library's model."""
        if piece.isascii() and piece[1:].isalpha() and piece[0] == " ":
            form = "\u0120" + piece[1:]
        else:
            form = piece.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, map(ID, self.model.tokenize(form))).tobytes()

    def part(self, part: bytes) -> bytes:
        """Ids of a part."""
        text = part.decode()
        if text.isalpha() or text[:1] == " " and text[1:].isalpha():
            return self.piece(text)
        found = self.find(text)
        return self.piece(text) if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        data = b"".join(texts)
        if self.plain and not any(x in data for x in self.added):
            return self.encode_plain(texts, data)
        whole = [not self.plain or any(a in x for a in self.added) for x in texts]
        ids, n = self.encode_plain(rest := [x for x, w in zip(texts, whole, strict=True) if not w], b"".join(rest))
        own = iter(np.split(ids, np.cumsum(n)[:-1]) if len(n) else [])
        got = [np.array(self.all.encode(x.decode(), add_special_tokens=False).ids, self.type) if w else next(own) for x, w in zip(texts, whole, strict=True)]
        return np.concatenate([np.zeros(0, self.type), *got]), np.fromiter(map(len, got), np.int64, len(got))

    def encode_plain(self, texts: list[bytes], data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """encode() of texts without added tokens; `data` is all of them.

        Parts are grouped by a hash of 8 bytes at a time and compared with the first of their group; those over LONG bytes are grouped by
        their bytes. Each different one is looked up once.
        """
        counts = np.zeros(len(texts), np.int64)
        if not data:
            return np.zeros(0, self.type), counts
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(sizes) - sizes
        b = np.frombuffer(data, np.uint8)
        kind = CLASS[b]
        # a Latin-1 letter is the byte C3 and another, but for the signs of multiplication and division
        latin = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] != 0x97) & (b[1:] != 0xB7))
        kind[latin] = kind[latin + 1] = 1
        cut = np.zeros(len(b), bool)
        cut[:-1] = (b[:-1] == 32) & (kind[1:] != 0) & (kind[1:] != 4)
        cut[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != 0) & (kind[1:] != 0) & (kind[:-1] != 4) & (kind[1:] != 4)
        cut[first[sizes > 0]] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, len(b)))
        eights = np.ndarray(len(b), "<u8", data + b"\0" * 8, strides=(1,))  # the 8 bytes from each place on

        def word(k: int, own: np.ndarray, like: np.ndarray) -> np.ndarray:
            """The k-th 8 bytes of parts `like`, as far as parts `own` are long."""
            return eights[start[like] + 8 * k] & LOW_BYTES[np.minimum(size[own] - 8 * k, 8)]

        steps = [np.arange(len(start))]  # parts with a k-th word
        while len(steps) < LONG // 8 and len(more := steps[-1][size[steps[-1]] > 8 * len(steps)]):
            steps.append(more)
        code = mixed(size.astype(np.uint64))
        for k, own in enumerate(steps):
            code[own] = mixed(code[own] ^ word(k, own, own))
        which, _ = pd.factorize(code)
        n = int(which.max()) + 1
        one = np.zeros(n, np.int64)
        one[which[::-1]] = np.arange(len(which))[::-1]  # the first of each
        like = one[which]
        differs = (size != size[like]) | (size > LONG)
        for k, own in enumerate(steps):
            own = own[~differs[own]]
            differs[own] = word(k, own, own) != word(k, own, like[own])
        other = np.flatnonzero(differs)
        if len(other):  # parts with the hash of another, and long ones: by their bytes
            own: dict[bytes, int] = {}
            which[other] = [n + own.setdefault(data[start[i] : start[i] + size[i]], len(own)) for i in other.tolist()]
            one = np.zeros(n + len(own), np.int64)
            one[which[::-1]] = np.arange(len(which))[::-1]
        got = [self.parts[data[i : i + k]] for i, k in zip(start[one].tolist(), size[one].tolist(), strict=True)]
        width = np.dtype(self.type).itemsize
        have = np.fromiter(map(len, got), np.int64, len(got)) // width
        flat = np.frombuffer(b"".join(got), self.type)
        per = have[which]
        shift = (np.cumsum(have) - have)[which] - (np.cumsum(per) - per)
        ids = flat[np.arange(int(per.sum())) + np.repeat(shift, per)]
        total = np.concatenate([[0], np.cumsum(per)])
        bound = np.searchsorted(start, np.append(first, len(b)))
        return ids, total[bound[1:]] - total[bound[:-1]]


@cache
def fast_tokens(path: str) -> FastTokens:
    return FastTokens(path)


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies with the sum 2**scale, 1 or more where counts are; ties go to the smaller id."""
    counts = np.asarray(counts, np.float64)
    used = counts > 0
    if not used.any():
        return np.zeros(len(counts), np.uint32)
    if used.sum() > 1 << scale:
        raise ValueError("more ids than the scale has slots")
    f = np.where(used, np.maximum(1, np.floor(counts * ((1 << scale) / counts.sum()))), 0).astype(np.int64)
    off = (1 << scale) - int(f.sum())
    order = np.argsort(-counts, kind="stable")
    if off > 0:
        f[order[0]] += off
    while off < 0:
        for i in order:
            take = min(-off, int(f[i]) // 2)
            f[i] -= take
            off += take
            if not off:
                break
    return f.astype(np.uint32)


class Coder:
    """Encodes and decodes blocks under one table."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE, lanes: int = LANES, block: int = BLOCK, every: int = EVERY):
        self.freq, self.scale, self.lanes, self.block, self.every = freq.astype(np.uint64), scale, lanes, block, every
        self.start = np.concatenate([[0], np.cumsum(self.freq)])[:-1].astype(np.uint64)
        self.top = self.freq << np.uint64(63 - scale)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    def blocks(self, ids: np.ndarray) -> list[bytes]:
        """Each block's bytes."""
        return self.blocks_of([ids])[0]

    def blocks_of(self, files: list[np.ndarray]) -> list[list[bytes]]:
        """The blocks of each file's ids. WIDE blocks, of whatever files, take their steps together."""
        cut = [(i, x[at : at + self.block]) for i, x in enumerate(files) for at in range(0, len(x), self.block)]
        out: list[list[bytes]] = [[] for _ in files]
        for at in range(0, len(cut), WIDE):
            for (i, _), blob in zip(cut[at : at + WIDE], self._group([x for _, x in cut[at : at + WIDE]]), strict=True):
                out[i].append(blob)
        return out

    def _group(self, parts: list[np.ndarray]) -> list[bytes]:
        """Blocks with one step of all lanes of all blocks at a time, from the last ids to the first."""
        K, n = self.lanes, len(parts)
        sizes = [len(x) for x in parts]
        steps = -(-max(sizes) // K)
        grid = np.zeros(n * steps * K, np.int64)
        live = np.zeros(n * steps * K, bool)
        for b, x in enumerate(parts):
            grid[b * steps * K : b * steps * K + sizes[b]] = x
            live[b * steps * K : b * steps * K + sizes[b]] = True
        grid, live = grid.reshape(n, steps, K), live.reshape(n, steps, K)
        words, mask = np.zeros((n, steps, K), np.uint32), np.zeros((n, steps, K), bool)
        x = np.full((n, K), LOW, np.uint64)
        low32, s = np.uint64(0xFFFFFFFF), np.uint64(self.scale)
        marks: dict[int, np.ndarray] = {}
        for t in range(steps - 1, -1, -1):
            sym, on = grid[:, t], live[:, t]
            f = self.freq[sym]
            full = on & (x >= self.top[sym])
            words[:, t] = (x & low32) * full
            mask[:, t] = full
            y = np.where(full, x >> np.uint64(32), x)
            f = np.where(on, f, np.uint64(1))
            q = y // f
            x = np.where(on, (q << s) + (y - q * f) + self.start[sym], x)
            if t % self.every == 0:
                marks[t] = x.copy()
        out = []
        for b in range(n):
            held, m = words[b][mask[b]].astype("<u4"), mask[b]
            before = np.concatenate([[0], np.cumsum(m.sum(1))])
            mine = [t for t in sorted(marks) if t * K < sizes[b]]
            body = b"".join(struct.pack("<I", before[t]) + marks[t][b].astype("<u8").tobytes() for t in mine)
            raw = held.tobytes()
            own = parts[b].astype("<u4").tobytes()
            out.append(BHEAD.pack(sizes[b], len(held), len(mine), zlib.crc32(own), zlib.crc32(body + raw)) + body + raw)
        return out

    def decode(self, blocks: list[bytes]) -> np.ndarray:
        """Ids of blocks; the stretches between their checkpoints are decoded side by side."""
        K, s = self.lanes, np.uint64(self.scale)
        low = np.uint64((1 << self.scale) - 1)
        states, ptrs, counts, streams, base, crcs = [], [], [], [], 0, []
        for blob in blocks:
            size, n_words, n_marks, crc_ids, crc_words = BHEAD.unpack_from(blob)
            at = BHEAD.size
            rec = np.frombuffer(blob, np.dtype([("w", "<u4"), ("x", "<u8", (K,))]), n_marks, at)
            at += n_marks * (4 + 8 * K)
            raw = blob[at : at + 4 * n_words]
            if len(raw) != 4 * n_words or zlib.crc32(blob[BHEAD.size :]) != crc_words:
                raise ValueError("a block is damaged")
            states.append(rec["x"])
            ptrs.append(rec["w"].astype(np.int64) + base)
            counts.append(np.minimum(self.every * K, size - np.arange(n_marks) * self.every * K))
            streams.append(np.frombuffer(raw, "<u4"))
            base += n_words
            crcs.append((size, crc_ids))
        if not blocks:
            return np.zeros(0, np.uint32)
        x, ptr, count = np.concatenate(states).astype(np.uint64), np.concatenate(ptrs), np.concatenate(counts)
        stream = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
        steps = min(self.every, -(-int(count.max(initial=0)) // K))
        out = np.zeros((len(x), steps, K), np.uint32)
        lane = np.arange(K)
        ragged = bool((count < steps * K).any())
        for t in range(steps):
            slot = x & low
            sym = self.slots[slot]
            y = self.freq[sym] * (x >> s) + slot - self.start[sym]
            need = y < LOW
            if ragged:
                on = t * K + lane[None] < count[:, None]
                need &= on
            at = ptr[:, None] + np.cumsum(need, 1) - 1
            z = np.where(need, (y << np.uint64(32)) | stream[np.where(need, at, -1)], y)
            x = np.where(on, z, x) if ragged else z
            ptr = ptr + need.sum(1)
            out[:, t] = sym
        flat = np.concatenate([out[i].reshape(-1)[: count[i]] for i in range(len(x))]) if ragged else out.reshape(-1)
        at = 0
        for size, crc in crcs:
            if zlib.crc32(flat[at : at + size].astype("<u4").tobytes()) != crc:
                raise ValueError("a block's ids are damaged")
            at += size
        return flat

    def files(self, many: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]) -> list[bytes]:
        """Files of (doc ids, lengths, ids, ids before the file in its partition)."""
        out = []
        for (doc_ids, lengths, ids, first), blocks in zip(many, self.blocks_of([x[2] for x in many]), strict=True):
            ends = np.cumsum([0, *map(len, blocks)])[:-1]
            head = HEAD.pack(b"TSA1", self.scale, self.crc, self.lanes, self.block, self.every, len(doc_ids), len(ids), len(blocks), first)
            out.append(b"".join([head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u8").tobytes(), ends.astype("<u8").tobytes(), *blocks]))
        return out

    def read(self, blobs: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """Doc ids, lengths, ids and the ids before the file in its partition, of each file."""
        found, blocks = [], []
        for blob in blobs:
            magic, scale, crc, lanes, block, every, docs, n, n_blocks, first = HEAD.unpack_from(blob)
            if magic != b"TSA1" or crc != self.crc or (scale, lanes, block, every) != (self.scale, self.lanes, self.block, self.every):
                raise ValueError("not a file of this table")
            at = HEAD.size
            doc_ids, lengths = np.frombuffer(blob, "<i8", docs, at), np.frombuffer(blob, "<u8", docs, at + 8 * docs).astype(np.int64)
            ends = [*(np.frombuffer(blob, "<u8", n_blocks, at + 16 * docs).astype(np.int64) + at + 16 * docs + 8 * n_blocks), len(blob)]
            blocks += [blob[a:b] for a, b in zip(ends, ends[1:], strict=False)]
            found.append((doc_ids, lengths, n, first))
        ids, at, out = self.decode(blocks), 0, []
        for doc_ids, lengths, n, first in found:
            if lengths.sum() != n or at + n > len(ids):
                raise ValueError("a file's length is wrong")
            out.append((doc_ids, lengths, ids[at : at + n], first))
            at += n
        return out


def segments(df: DataFrame, path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """Pass 1: part, first (ids before it in the part), doc_ids, lengths, ids (binary) of each segment in order of doc_id."""
    spark = df.sparkSession
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), text_of(text_col).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text")

    def run(batches):
        from pyspark import TaskContext

        t, part, first = fast_tokens(path), TaskContext.get().partitionId(), 0
        doc_ids, lengths, got, held = [], [], [], 0

        def row():
            cols = {"doc_ids": np.concatenate(doc_ids).astype("<i8").tobytes(), "lengths": np.concatenate(lengths).astype("<i8").tobytes(), "ids": np.concatenate(got).tobytes()}
            return pa.RecordBatch.from_pydict({k: [v] for k, v in ({"part": part, "first": first} | cols).items()}, pa.schema([("part", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())]))

        for b in chunks(batches, "text", 2 << 20):
            ids, n = t.encode(b.column("text").cast(pa.binary()).to_pylist())
            ids, own = np.insert(ids, np.cumsum(n), end_id), b.column("id").to_numpy()
            n = n + 1
            ends = np.cumsum(n)
            at = 0
            while at < len(n):  # whole documents until the segment is full
                base = int(ends[at - 1]) if at else 0
                stop = min(len(n), int(np.searchsorted(ends, base + SEGMENT - held)) + 1)
                doc_ids.append(own[at:stop])
                lengths.append(n[at:stop])
                got.append(ids[base : int(ends[stop - 1])])
                held += int(ends[stop - 1]) - base
                at = stop
                if held >= SEGMENT:
                    yield row()
                    first += held
                    doc_ids, lengths, got, held = [], [], [], 0
        if held:
            yield row()

    return to_python(rows, run, "part int, first long, doc_ids binary, lengths binary, ids binary")


def id_counts(segs: DataFrame, vocab: int, width: int) -> np.ndarray:
    """Pass 2: how often each of the `vocab` ids occurs, in all segments."""
    kind = np.uint16 if width == 2 else np.uint32

    def run(batches):
        total = np.zeros(vocab, np.int64)
        for b in chunks(batches, "ids"):
            for x in b.column("ids"):
                total += np.bincount(np.frombuffer(x.as_buffer(), kind), minlength=vocab)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], names=["id", "n"])

    out = np.zeros(vocab, np.int64)
    for r in to_python(segs.select("ids"), run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["id"]] = r["n"]
    return out


def encode_corpus(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> tuple[DataFrame, np.ndarray]:
    """Write a corpus in the file format. Returns the table of files (part, first, n_ids, file) and the frequencies."""
    t = fast_tokens(path)
    vocab, width = max(t.all.get_vocab_size(), end_id + 1), np.dtype(t.type).itemsize
    segs = written(segments(df, path, id_col, text_col, end_id), "segments", blobs=True)
    freq = frequencies(id_counts(segs, vocab, width))
    kind = np.uint16 if width == 2 else np.uint32

    def one(b):
        many = [(np.frombuffer(d, "<i8"), np.frombuffer(k, "<i8"), np.frombuffer(x, kind), first) for first, d, k, x in zip(*(b.column(c).to_pylist() for c in ("first", "doc_ids", "lengths", "ids")), strict=True)]
        return {"part": b.column("part"), "first": b.column("first"), "n_ids": [len(x[2]) for x in many], "file": _coder(freq.tobytes()).files(many)}

    files = written(map_arrow(segs, one, "part int, first long, n_ids long, file binary", "ids"), "files", blobs=True)
    discard(segs)
    return files, freq


@cache
def _coder(freq: bytes) -> Coder:
    return Coder(np.frombuffer(freq, np.uint32))


def decode_corpus(files: DataFrame, freq: np.ndarray) -> DataFrame:
    """Documents of files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian u32)."""
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = totals.selectExpr("part AS of_part", "coalesce(sum(n_ids) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS base")
    before = written(before, "bases")
    before = F.broadcast(before) if before.count() <= MOST_PARTITIONS else before

    def one(b):
        coder = _coder(freq.tobytes())
        out = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32")}
        for base, (doc_ids, lengths, ids, first) in zip(b.column("base").to_pylist(), coder.read(b.column("file").to_pylist()), strict=True):
            ends = np.cumsum(lengths)
            raw = memoryview(ids.astype("<u4").tobytes())
            out["doc_id"] += [None if i == LAST_ID else i for i in doc_ids.tolist()]
            out["start"] += (ends - lengths + first + base).tolist()
            out["n_tokens"] += lengths.tolist()
            out["ids_crc32"] += [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        return out

    rows = files.join(before, files["part"] == before["of_part"]).select("base", "file")
    return map_arrow(rows, one, "doc_id long, start long, n_tokens long, ids_crc32 long", "file", 4 << 20)


def op3(spark, docs: DataFrame) -> DataFrame:
    import public_tokenizers as P

    return decode_corpus(*encode_corpus(docs, P.path("byte_bpe_50k.json")))
