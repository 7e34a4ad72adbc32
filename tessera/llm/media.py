"""Telephony audio: G.711 and IMA ADPCM sources to resampled PCM.

`encode_payload` stores bytes as WAV files of mu-law, A-law or IMA ADPCM, whose 8-bit units hold any byte, so nothing is lost. `decode_audio`
reads such files from a binary column, expands mu-law and A-law by lookup tables, decodes the ADPCM blocks of a whole
slice of rows together, one numpy step a nibble, and stores linear PCM at the asked rate. `pcm_features` describes stored PCM.

The form of a payload follows from its checksum, so equal texts are stored alike and each form holds about a third of them.

Null or empty media give empty PCM and rate 0; bytes that are no WAV file of a
known format give a null PCM cell and the reason in `error`, and a null feature. A null text is empty. Rows are independent, so
ties, repeated rows and extra columns (which are not read) need no rule; an empty table gives an empty result. A text is one cell: its
file is a little longer, its PCM up to four times as long, so texts have to stay below half a gigabyte.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_arrow, text_of, written

# WAV format tags.
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
#: Forms of a payload, its unit in bytes (an ADPCM block), the rate it is stored at (wideband), and the rate of PCM.
FORMS, UNIT, STORED_RATE, RATE = (MULAW, ALAW, IMA_ADPCM), 64, 16000, 8000
#: How hard the stored tables are compressed.
LEVEL = 9
#: Shares of the stored files whose PCM is on disk one after the other.
SHARES = 4
# The step table of IMA ADPCM and its index changes.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mulaw_table() -> np.ndarray:
    """The 256 linear values of mu-law codes, by the rule of G.711."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The 256 linear values of A-law codes, by the rule of G.711; all differ."""
    code = np.arange(256) ^ 0x55
    part, step = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(part == 0, step + 8, (step + 0x108) << np.maximum(part - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def ima_blocks(data: bytes, align: int) -> np.ndarray:
    """Mono IMA ADPCM: every block has its own start state, so one numpy step decodes a nibble of all blocks."""
    n = len(data) // align
    if not n or align < 4:
        return np.zeros(0, np.int16)
    rows = np.frombuffer(data, np.uint8, n * align).reshape(n, align)
    value = rows[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.clip(rows[:, 2].astype(np.int32), 0, 88)
    body = rows[:, 4:]
    nibbles = np.stack([body & 15, body >> 4], axis=2).reshape(n, -1)
    out = np.empty((n, nibbles.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(nibbles.shape[1]):
        c, step = nibbles[:, k].astype(np.int32), IMA_STEPS[index]
        move = (step >> 3) + np.where(c & 1, step >> 2, 0) + np.where(c & 2, step >> 1, 0) + np.where(c & 4, step, 0)
        value = np.clip(value + np.where(c & 8, -move, move), -32768, 32767)
        index = np.clip(index + IMA_MOVES[c], 0, 88)
        out[:, k + 1] = value
    return out.reshape(-1)


def wav(data: bytes, tag: int, rate: int, bits: int, align: int = 0) -> bytes:
    """A mono WAV file."""
    if len(data) >= (1 << 32) - 128:
        raise ValueError("a WAV file holds less than 4 GB")
    align = align or bits // 8
    per = (align - 4) * 2 + 1 if tag == IMA_ADPCM else 1  # samples of a block
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * align // per, align, bits)
    if tag == IMA_ADPCM:
        fmt += struct.pack("<HH", 2, per)
    elif tag != PCM:
        fmt += struct.pack("<H", 0)
    frames = len(data) // align * per
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if tag != PCM:
        body += b"fact" + struct.pack("<II", 4, frames)
    body += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def unwav(blob: bytes) -> tuple[int, int, int, memoryview]:
    """Format tag, rate, block size and samples of a mono WAV file."""
    if len(blob) < 12 or blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, found, view = 12, None, memoryview(blob)
    while at + 8 <= len(blob):
        kind, n = blob[at : at + 4], struct.unpack_from("<I", blob, at + 4)[0]
        if kind == b"fmt ":
            if n < 16 or at + 24 > len(blob):
                raise ValueError("short fmt chunk")
            tag, channels, rate, _, align, _ = struct.unpack_from("<HHIIHH", blob, at + 8)
            if channels != 1:
                raise ValueError("not mono")
            found = tag, rate, align
        elif kind == b"data":
            if found is None:
                raise ValueError("no fmt chunk")
            return *found, view[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def linear(tag: int, align: int, data) -> np.ndarray:
    """16-bit samples of stored data."""
    if tag in TABLES:
        return TABLES[tag][np.frombuffer(data, np.uint8)]
    if tag == IMA_ADPCM:
        return ima_blocks(bytes(data), align)
    if tag == PCM and align == 2:
        return np.frombuffer(data, "<i2", len(data) // 2)
    raise ValueError(f"format {tag} is not known")


def doubled(x: np.ndarray) -> np.ndarray:
    """Twice the rate: old samples stay, new ones are a four-point integer interpolation, so results are exact."""
    if not len(x):
        return x.astype(np.int16)
    p = np.empty(len(x) + 3, np.int32)
    p[1:-2], p[0], p[-2:] = x, x[0], x[-1]
    out = np.empty(2 * len(x), np.int16)
    out[0::2] = x
    out[1::2] = np.clip((9 * (p[1:-2] + p[2:-1]) - p[:-3] - p[3:] + 8) >> 4, -32768, 32767)
    return out


def halved(x: np.ndarray) -> np.ndarray:
    """Half the rate: a half-band filter of seven taps with the weights of doubled(), in integers, so results are exact; the ends are held."""
    if not len(x):
        return x.astype(np.int16)
    p, n = np.pad(x.astype(np.int32), 3, "edge"), len(x)
    y = (16 * p[3 : n + 3] + 9 * (p[2 : n + 2] + p[4 : n + 4]) - p[:n] - p[6 : n + 6] + 16) >> 5
    return np.clip(y[::2], -32768, 32767).astype(np.int16)


def resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """PCM at rate `to`: doublings or halvings first, then linear interpolation in integers for what is left."""
    if rate <= 0 or to <= 0:
        raise ValueError("rates must be positive")
    while rate * 2 <= to:
        x, rate = doubled(x), rate * 2
    while rate >= to * 2 and rate % 2 == 0:
        x, rate = halved(x), rate // 2
    if rate == to or not len(x):
        return x.astype(np.int16)
    at = np.arange(len(x) * to // rate, dtype=np.int64) * rate
    i, part = at // to, at % to
    a, b = x[i].astype(np.int64), x[np.minimum(i + 1, len(x) - 1)].astype(np.int64)
    return ((a * (to - part) + b * part) // to).astype(np.int16)


def payload(text: bytes) -> bytes:
    """A text's bytes, padded with 0 to a positive multiple of UNIT."""
    return text + b"\0" * (-len(text) % UNIT if text else UNIT)


def stored(data: bytes, rate: int) -> bytes:
    """The WAV file of a payload, in the form that its checksum picks."""
    tag = FORMS[zlib.crc32(data) % len(FORMS)]
    return wav(data, tag, rate, 4, UNIT) if tag == IMA_ADPCM else wav(data, tag, rate, 8)


def encode_payload(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = STORED_RATE) -> DataFrame:
    """Each text's UTF-8 bytes as samples of a WAV file: the id, n_bytes (without padding) and media (binary)."""

    def one(b):
        texts = b.column("text").cast(pa.binary()).to_pylist()
        return {"id": b.column("id"), "n_bytes": [len(x) for x in texts], "media": [stored(payload(x), rate) for x in texts]}

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), one, f"id {kind}, n_bytes long, media binary", "text", 1 << 20).withColumnRenamed("id", id_col)


def read_all(files: list[bytes | None]) -> list[tuple]:
    """(tag, rate, samples, stored bytes) or the error of each file; the ADPCM blocks of all files of one block size are decoded together."""
    out: list[tuple] = []
    blocks: dict[int, list[int]] = {}
    for i, x in enumerate(files):
        try:
            tag, rate, align, data = unwav(x) if x else (None, 0, 0, b"")
            if tag == IMA_ADPCM and align >= 4:
                blocks.setdefault(align, []).append(i)
                out.append((tag, rate, None, data))
            else:
                out.append((tag, rate, linear(tag, align, data) if x else np.zeros(0, np.int16), data))
        except ValueError as e:
            out.append((None, 0, str(e), b""))
    for align, rows in blocks.items():
        whole = [bytes(out[i][3][: len(out[i][3]) // align * align]) for i in rows]
        per = (align - 4) * 2 + 1
        ends = np.cumsum([len(x) // align * per for x in whole])
        for i, x in zip(rows, np.split(ima_blocks(b"".join(whole), align), ends[:-1]), strict=True):
            out[i] = (*out[i][:2], x, out[i][3])
    return out


def decode_audio(df: DataFrame, id_col: str, media_col: str, rate: int = RATE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Stored telephony audio as 16-bit PCM WAV files at `rate`.

    Returns the id, the columns of `keep`, source_format, source_rate, n_samples, pcm and error; and of the stored form payload_bytes, payload_sha256,
    tail_crc32 (of the last UNIT bytes), media_bytes and media_sha256.
    """
    names = ("source_format", "source_rate", "n_samples", "pcm", "error", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")

    def one(b):
        out = {k: [] for k in names}
        files = b.column("media").to_pylist()
        for x, (tag, src, samples, data) in zip(files, read_all(files), strict=True):
            row = (None, 0, 0, b"", None)
            if isinstance(samples, str):
                row = (None, 0, 0, None, samples)
            elif x:
                try:
                    y = resampled(samples, src, rate)
                    row = (tag, src, len(y), wav(y.astype("<i2").tobytes(), PCM, rate, 16), None)
                except ValueError as e:
                    row = (None, 0, 0, None, str(e))
            raw = x or b""
            row += (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest())
            for k, v in zip(names, row, strict=True):
                out[k].append(v)
        return {"id_": b.column("id_")} | {f"keep_{i}": b.column(f"keep_{i}") for i in range(len(keep))} | out

    kinds = "".join(f", keep_{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    rows = df.select(F.col(id_col).alias("id_"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)], F.col(media_col).alias("media"))
    form = f"id_ {df.schema[id_col].dataType.simpleString()}{kinds}, source_format int, source_rate int, n_samples long, pcm binary, error string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    return map_arrow(rows, one, form, "media", 1 << 20).toDF(id_col, *keep, *names)


def features(x: np.ndarray, rate: int) -> str:
    """Length, peak, mean square, sign changes and checksum of PCM, all integers."""
    y = x.astype(np.int64)
    neg = x < 0
    return f"rate={rate};n={len(x)};peak={int(np.abs(y).max(initial=0))};power={int((y * y).sum()) // max(1, len(x))};crossings={int((neg[1:] != neg[:-1]).sum())};crc32={zlib.crc32(x.astype('<i2').tobytes())}"


def feature_of(file: bytes | None) -> str | None:
    """The features of a PCM WAV file; null for a null cell."""
    if file is None:
        return None
    if not file:
        return features(np.zeros(0, np.int16), 0)
    tag, rate, align, data = unwav(file)
    return features(linear(tag, align, data), rate)


def pcm_features(df: DataFrame, keep: tuple[str, ...], pcm_col: str = "pcm") -> DataFrame:
    """The columns of `keep` and `feature`, what the stored PCM of decode_audio() says."""
    names = [f"keep_{i}" for i in range(len(keep))]

    def one(b):
        return {c: b.column(c) for c in names} | {"feature": [feature_of(x) for x in b.column("pcm").to_pylist()]}

    kinds = "".join(f"{n} {df.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep, strict=True))
    rows = df.select(*[F.col(c).alias(n) for n, c in zip(names, keep, strict=True)], F.col(pcm_col).alias("pcm"))
    return map_arrow(rows, one, f"{kinds}feature string", "pcm", 1 << 20).toDF(*keep, "feature")


def op8(spark, docs: DataFrame) -> DataFrame:
    """Texts stored as WAV files in the shared folder, read back, decoded to stored PCM, and that read back and described.

    PCM takes twice the disk of the files, so they are decoded in SHARES of files of their table, one after the other; a share's PCM goes once it is described.
    """
    files = written(encode_payload(docs), "media", blobs=True, level=LEVEL)
    paths, keep = sorted(files.inputFiles()), ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "source_format", "n_samples")
    out = None
    for share in [paths[i::SHARES] for i in range(min(SHARES, len(paths)))]:
        pcm = written(decode_audio(spark.read.schema(files.schema).parquet(*share), "doc_id", "media", keep=("n_bytes",)), "pcm", blobs=True, level=LEVEL)
        got = written(pcm_features(pcm, keep), "described")
        discard(pcm)
        out = got if out is None else out.unionByName(got)
    return pcm_features(decode_audio(files, "doc_id", "media", keep=("n_bytes",)), keep) if out is None else out  # no files: no rows
