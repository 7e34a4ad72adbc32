"""Byte-level BPE by tree reduction, and token files."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tessera.llm import token_binary as B
from tessera.llm.bpe import Tree, decode, encode, round_trip

MULTI, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
BITS = ["a", "b", "the", " ", "  ", "\n", "\t", "'", "'s", "'re", "'l", "1", "23", ".", "!!", "é", "\x1c", "　", "\xa0", "漢字", "😀", " ", "\x85", "́", "\x00", "<|endoftext|>", "ing"]


def texts(n, most=80):
    rnd = random.Random(5)
    return ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def test_tree_is_the_library():
    small, plain = Tree(MULTI, P.PATTERN, leaf=16, long=6), Tree(MULTI, P.PATTERN)
    assert small.sound
    for x in texts(600):
        ids = small.encode(x)
        assert list(ids) == plain.core.encode_ordinary(x) == list(plain.encode(x))
        assert small.decode(ids, 3) == x.encode()


def test_tree_of_a_text_without_any_cut():
    t = Tree(MULTI, P.PATTERN)
    x = "".join(random.Random(1).choice("abcdefgnerthing") for _ in range(30_000))
    for y in (x, " " + x, "  " + x[:4096] + "\n" + x, "漢字" * 5000, " " * 9000 + "a", x[:3000] + "'s" + x[:3000]):
        assert list(t.encode(y)) == t.core.encode_ordinary(y)


def test_tree_of_another_pattern():
    t = Tree(MULTI, r"\w+|\W", leaf=5)
    assert not t.known
    for x in texts(100, 30):
        assert list(t.encode(x)) == t.core.encode_ordinary(x)


def test_tree_of_words_and_copies_of_documents(spark):
    """Words in leaves of the registered size, against the library, over all documents of the smallest data."""
    t = Tree(MULTI, P.PATTERN)
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert sum(len(x) > t.leaf for x in docs) > 0.8 * len(docs)
    for x in docs:
        assert list(t.encode(x)) == t.core.encode_ordinary(x)


def test_round_trip_rows(spark):
    rows = [(1, "a b", "x"), (2, None, "x"), (None, "a b", "x"), (1, "a b", "x"), (3, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(round_trip(df, MULTI, P.PATTERN).collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    assert [r.n_tokens for r in got] == [2, 2, 2, 0, 0]
    assert round_trip(df.where("false"), MULTI, P.PATTERN).count() == 0
    back = decode(encode(df, MULTI, P.PATTERN), MULTI, P.PATTERN).collect()
    assert sorted(bytes(r.data) for r in back) == [b"", b"", b"a b", b"a b", b"a b"]


def test_fast_tokens_are_the_library():
    t, lib = B.FastTokens(JSON), Tokenizer.from_file(JSON)
    many = texts(800)
    word = "".join(random.Random(8).choices("abcdefgh", k=6000))
    swapped = word[:4] + word[4100] + word[5:4100] + word[4] + word[4101:]  # bytes 4096 apart change places
    many += [word + " " + swapped, swapped, word, "hello <|endoftext|> world", "<|endoftext|><|endoftext|>"]
    assert word != swapped and 50256 in lib.encode(many[-2], add_special_tokens=False).ids
    ids, n = t.encode([x.encode() for x in many])
    ends = np.cumsum(n)
    for x, e, k in zip(many, ends, n):
        assert ids[e - k : e].tolist() == lib.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("n", [0, 1, 33, 32768, 100_000])
def test_blocks(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50256)
    c = B.Coder(B.frequencies(np.bincount(np.append(ids, 2), minlength=50257)))
    blocks = c.blocks(ids)
    assert (c.decode(blocks) == ids).all()
    if n > 40_000:  # each block by itself
        assert (np.concatenate([c.decode([b]) for b in blocks]) == ids).all()
    if n:
        hurt = blocks[0][:-1] + bytes([blocks[0][-1] ^ 1])
        with pytest.raises(ValueError):
            c.decode([hurt])


def test_frequencies():
    f = B.frequencies(np.array([0, 1, 10**12, 3]))
    assert f.sum() == 1 << B.SCALE and f[0] == 0 and (f[1:] > 0).all()
    assert B.frequencies(np.zeros(3)).sum() == 0


def test_corpus_files(spark, monkeypatch):
    monkeypatch.setattr(B, "SEGMENT", 40)
    rows = [(i, x) for i, x in enumerate(texts(60))] + [(7, None), (7, "again"), (None, "last")]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id").repartition(3)
    got = sorted(B.decode_corpus(*B.encode_corpus(df, JSON)).collect(), key=lambda r: r.start)
    lib, start = Tokenizer.from_file(JSON), 0
    want = sorted(rows, key=lambda r: (B.LAST_ID if r[0] is None else r[0], (r[1] or "").encode()))
    assert len(got) == len(rows)
    for (i, x), r in zip(want, got):
        ids = lib.encode(x or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert B.decode_corpus(*B.encode_corpus(df.where("false"), JSON)).count() == 0


def test_parts_with_one_hash_stay_apart(monkeypatch):
    t, lib = B.FastTokens(JSON), Tokenizer.from_file(JSON)
    monkeypatch.setattr(B, "mixed", lambda x: x & np.uint64(1))
    many = texts(60) + ["abcdefgh ijklmnop abcdefgi ijklmnop", "x" * 70 + " " + "x" * 69 + "y " + "x" * 70]
    ids, n = t.encode([x.encode() for x in many])
    for x, e, k in zip(many, np.cumsum(n), n):
        assert ids[e - k : e].tolist() == lib.encode(x, add_special_tokens=False).ids, x
