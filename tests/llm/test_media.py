"""Telephony audio."""

import hashlib
import zlib

import numpy as np

from tessera.llm import media as M


def test_tables():
    mu, a = M.mulaw_table(), M.alaw_table()
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0)
    assert len(set(a.tolist())) == 256 and a[0xD5] == 8 and a[0x55] == -8 and a.max() == 32256


def plain(block):
    v, i = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [v]
    for byte in block[4:]:
        for c in (byte & 15, byte >> 4):
            s = int(M.IMA_STEPS[i])
            d = (s >> 3) + (s >> 2 if c & 1 else 0) + (s >> 1 if c & 2 else 0) + (s if c & 4 else 0)
            v = max(-32768, min(32767, v - d if c & 8 else v + d))
            i = max(0, min(88, i + int(M.IMA_MOVES[c])))
            out.append(v)
    return out


def test_adpcm_blocks_one_by_one():
    data = np.random.default_rng(1).integers(0, 256, 36 * 5, np.uint8).tobytes()
    assert M.ima_blocks(data, 36).tolist() == [v for k in range(5) for v in plain(data[36 * k : 36 * k + 36])]
    assert len(M.ima_blocks(b"", 36)) == 0


def test_resampling():
    x = np.array([0, 100, 200, -32768, 32767], np.int16)
    y = M.resampled(x, 8000, 16000)
    assert (y[::2] == x).all() and len(y) == 10
    assert len(M.resampled(x, 8000, 11025)) == 5 * 11025 // 8000
    assert (M.resampled(x, 8000, 8000) == x).all()


def test_halving():
    x = np.array([0, 100, 200, -32768, 32767, 5, 7], np.int16)
    held = lambda i: int(x[min(max(i, 0), len(x) - 1)])
    taps = {0: 16, 1: 9, -1: 9, 3: -1, -3: -1}
    want = [min(max((sum(w * held(i + k) for k, w in taps.items()) + 16) >> 5, -32768), 32767) for i in range(0, len(x), 2)]
    high = (np.arange(400) % 2 * 2 - 1).astype(np.int16) * 10000  # at the old rate's limit: nothing of it may be left
    assert np.abs(M.resampled(high, 16000, 8000)[4:-4]).max() == 0
    assert M.resampled(x, 16000, 8000).tolist() == want and len(M.resampled(x[:0], 16000, 8000)) == 0


def samples(p, tag):
    """Linear samples of a payload, one after another."""
    if tag == M.IMA_ADPCM:
        return [v for i in range(0, len(p), M.UNIT) for v in plain(p[i : i + M.UNIT])]
    out = []
    for c in p:
        if tag == M.MULAW:
            c ^= 0xFF
            v = (((c & 15) << 3) + 132 << (c >> 4 & 7)) - 132
            out.append(-v if c & 128 else v)
        else:
            c ^= 0x55
            e, v = c >> 4 & 7, (c & 15) << 4
            v = v + 8 if e == 0 else (v + 264) << (e - 1)
            out.append(v if c & 128 else -v)
    return out


def test_payload_and_decoding(spark):
    texts = {1: "häß", 2: None, 3: "", 4: "a" * 200, None: "häß"} | {i: "word " * i for i in range(10, 40)} | {50: "long text " * 300_000}
    rows = [*texts.items(), (1, "häß")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS media", "0L AS n_bytes", "'k' AS keep_0", "1 AS id_")
    got = M.op8(spark, df).collect()
    assert len(got) == len(rows)
    for r in got:
        x = (texts[r.doc_id] or "").encode()
        p = x + b"\0" * (-len(x) % 64 if x else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(x), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        file = M.stored(p, 16000)
        tag, rate, _, data = M.unwav(file)
        assert (r.media_bytes, r.media_sha256, r.source_format, rate) == (len(file), hashlib.sha256(file).hexdigest(), tag, 16000) and bytes(data) == p
        if len(p) < 1000:
            y = M.halved(np.array(samples(p, tag), np.int16)).astype(int).tolist()
            turns = sum((a < 0) != (b < 0) for a, b in zip(y, y[1:]))
            crc = zlib.crc32(np.array(y, "<i2").tobytes())
            assert r.feature == f"rate=8000;n={len(y)};peak={max(map(abs, y))};power={sum(v * v for v in y) // len(y)};crossings={turns};crc32={crc}" and r.n_samples == len(y)
    assert {r.source_format for r in got} == set(M.FORMS)
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (1, None)}) == 1
    assert M.op8(spark, df.where("false")).count() == 0
    out = M.decode_audio(M.encode_payload(df), "doc_id", "media", 16000).collect()
    assert all(M.unwav(bytes(r.pcm))[:2] == (M.PCM, 16000) and r.error is None for r in out)
    bad = spark.createDataFrame([(1, b"RIFFxxxxWAVE"), (2, None), (3, b"junk"), (4, M.wav(b"ab", 9, 8000, 8))], "id long, media binary")
    out = {r.id: r for r in M.decode_audio(bad, "id", "media").collect()}
    assert out[1].error and out[3].error and out[4].error and out[2].error is None and out[2].n_samples == 0
    assert [r.feature is None for r in M.pcm_features(M.decode_audio(bad, "id", "media").orderBy("id"), ("id",)).orderBy("id").collect()] == [True, False, True, True]
    assert M.decode_audio(bad.where("false"), "id", "media").count() == 0


def test_pcm_goes_once_it_is_described(spark, tmp_path, monkeypatch):
    """All PCM is stored and read back, but never more than a share of it lies on disk."""
    df = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(64)], "doc_id long, text string").repartition(8, "doc_id")
    held, seen, write, drop = {}, [], M.written, M.discard

    def spy(rows, name, **kw):
        got = write(rows, name, **kw)
        if name == "pcm":
            held[got._tessera_path] = got.count()
            seen.append(sum(held.values()))
        return got

    def dropped(*tables):
        drop(*tables)
        for t in tables:
            seen.append(-held.pop(t._tessera_path))

    monkeypatch.setattr(M, "written", spy)
    monkeypatch.setattr(M, "discard", dropped)
    got = M.op8(spark, df)
    assert not held and -sum(x for x in seen if x < 0) == 64 and max(seen) < 40
    assert sorted(r.doc_id for r in got.collect()) == list(range(64))
    assert len({r.feature for r in got.collect()}) > 1 and all(r.feature.startswith("rate=8000;") for r in got.collect())
