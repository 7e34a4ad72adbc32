"""Shards, periodic runs and the filter audit against plain loops."""

import hashlib
import random
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit as A
from tessera.llm import periodic_runs as R
from tessera.llm import sharding as S

FORM = "doc_id long, text string"


def shards(rows, n):
    """doc_id, size, shard, slot, by a running sum."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    total, at, out, used = sum(sizes), 0, [], {}
    for (d, _), s in zip(rows, sizes):
        k = (2 * at + s) * n // (2 * total)
        out.append((d, s, k, used.get(k, 0)))
        used[k] = used.get(k, 0) + 1
        at += s
    return out


@pytest.mark.parametrize("n", [1, 2, 8, 40])
def test_shards_like_a_running_sum(spark, n):
    rnd = random.Random(n)
    rows = [(i, None if i % 11 == 0 else "é" * rnd.choice([0, 1, 30, 400])) for i in range(150)] + [(1000, "x" * 3_000_000)]
    df = spark.createDataFrame(rows, FORM).repartition(7).withColumns({"size": F.lit("clash"), "part": F.lit(1)})
    got = S.sharded(df, n).select("doc.doc_id", "size", "shard", "slot", "doc.part").collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(shards(rows, n)) and {r.part for r in got} == {1}


def test_shards_of_equal_rows_nulls_and_nothing(spark):
    rows = [(None, "same")] * 3000 + [(5, "same")] * 3000 + [(5, None), (6, "")]
    got = S.op11(spark, spark.createDataFrame(rows, FORM).withColumn("shard", F.lit(9)).repartition(9)).collect()
    assert len(got) == len(rows) and all(r.text_crc32 == zlib.crc32({5: b"same", 1: b""}[r.size]) for r in got)
    per = [sorted(r.slot for r in got if r.shard == k) for k in range(8)]
    assert all(x == list(range(len(x))) for x in per)
    sizes = [sum(r.size for r in got if r.shard == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 5 and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert {r.shard for r in got if r.doc_id is None} == {4, 5, 6, 7} or {r.shard for r in got if r.doc_id is None} == {3, 4, 5, 6, 7}
    assert S.op11(spark, spark.createDataFrame([], FORM)).count() == 0
    with pytest.raises(ValueError):
        S.sharded(spark.createDataFrame([], FORM), 0)


def test_shards_written(spark, tmp_path):
    rows = [(i, "x" * (i % 9)) for i in range(100)]
    S.write_shards(S.sharded(spark.createDataFrame(rows, FORM), 4), f"{tmp_path}/shards")
    again = spark.read.parquet(f"{tmp_path}/shards")
    assert sorted((r.doc.doc_id, r.size, r.shard, r.slot) for r in again.collect()) == sorted(shards(rows, 4))


def plain_runs(w, repeats=4, least=6):
    """All runs by their definition, a period after another."""
    out, n = {}, len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= 2 * q and (i, j + q - i) not in out:
                out[i, j + q - i] = q
            i = max(j, i + 1)
            while i < n and i + q < n and w[i - 1] == w[i - 1 + q]:
                i += 1
    return sorted((s, size, q) for (s, size), q in out.items() if size >= max(least, repeats * q))


def words_of(rnd, kind):
    if kind == 0:
        return [rnd.randrange(2) for _ in range(rnd.randint(0, 60))]
    if kind == 1:
        return [rnd.randrange(3) for _ in range(rnd.randint(1, 7))] * rnd.randint(1, 9) + [rnd.randrange(3) for _ in range(rnd.randint(0, 9))]
    if kind == 2:
        x = [rnd.randrange(2) for _ in range(rnd.randint(1, 4))] * rnd.randint(4, 7)
        return (x + [rnd.randrange(2) for _ in range(rnd.randint(0, 3))]) * rnd.randint(1, 6)
    if kind == 3:
        return [7] * rnd.randint(0, 300)
    return [rnd.randrange(50) for _ in range(rnd.randint(0, 200))]


@pytest.mark.parametrize("seed", range(6))
def test_runs_by_definition(seed):
    rnd = random.Random(seed)
    docs = [words_of(rnd, rnd.randrange(5)) for _ in range(150)]
    got = R.runs([np.array(d, int) for d in docs])
    assert [[tuple(r) for r in g.tolist()] for g in got] == [plain_runs(d) for d in docs]


def test_parts_of_the_runs_theorem():
    rnd = random.Random(4)
    docs = [[rnd.randrange(2) for _ in range(40)], [1, 2] * 500, [], [3] * 90]
    code, end = np.concatenate([np.array(d, int) + 10 * (9 - i) for i, d in enumerate(docs)]), np.repeat(np.cumsum([len(d) for d in docs]), [len(d) for d in docs])
    sa, rank = R.suffix_array(code, end)
    want = sorted(range(len(code)), key=lambda i: code[i : end[i]].tolist())
    assert sa.tolist() == want and rank[sa].tolist() == list(range(len(code)))
    lcp, place = R.common_prefixes(code, sa), rank
    common = lambda i, j: next((k for k in range(min(end[i] - i, end[j] - j)) if code[i + k] != code[j + k]), min(end[i] - i, end[j] - j))
    assert lcp[1:].tolist() == [common(a, b) for a, b in zip(sa[:-1], sa[1:])]
    assert R.next_smaller(place).tolist() == [next((j for j in range(i + 1, len(code)) if place[j] < place[i]), len(code)) for i in range(len(code))]
    m, v = R.Minima(lcp), lcp.tolist()
    lo = np.array([rnd.randrange(len(v)) for _ in range(500)])
    hi = np.array([rnd.randrange(a, len(v)) for a in lo])
    assert m.least(lo, hi).tolist() == [min(v[a : b + 1]) for a, b in zip(lo, hi)]


def op12_row(d, text):
    w = (text or "").encode().split()
    if d is not None and w and (h := zlib.crc32(str(d).encode())) % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (d, len(found), *first, sha("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op12_like_plain_loops(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(f"w{x}" for x in words_of(rnd, i % 5))) for i in range(200)] + [(None, "a a a a a a a b"), (None, None), (7, ""), (7, " \t\n "), (8, "é é é é é é é é"), (8, "x\x0by\x0cx y x y x y x"), (10, None)]
    rows += [(i, "tail " * 3 + "a b " * 40) for i in range(300, 340)]
    df = spark.createDataFrame(rows, FORM).withColumns({"runs": F.lit(1), "h": F.lit(2)})
    key = lambda r: str(r)
    assert sorted([tuple(r) for r in R.op12(spark, df).collect()], key=key) == sorted([op12_row(*r) for r in rows], key=key)
    assert R.op12(spark, spark.createDataFrame([], FORM)).count() == 0


def test_runs_of_long_texts():
    rnd = np.random.default_rng(1)
    tail = rnd.integers(0, 1000, 30_000)
    for w, want in (([1] * 300_000, [(0, 300_000, 1)]), (np.tile(tail[:7919], 40)[:300_000], [(0, 300_000, 7919)])):
        assert [tuple(r) for r in R.runs([np.append(w, tail + 2000), tail])[0].tolist()] == want
    assert len(R.runs([np.tile(np.append(np.tile(tail[:50], 5), 5000 + np.arange(1)), 2000)])[0]) == 2001


def plain_audit(docs, labels):
    first, held = {}, {}
    last = A.LAST_ID
    for d, t, _ in docs:
        d, t = last if d is None else d, t or ""
        first[t] = min(first.get(t, d), d)
    for d, q, x in labels:
        if d is not None:
            a = held.get(d, (False, False))
            held[d] = (a[0] or q == 1, a[1] or x == 1)
    rows = {}
    for d, t, s in docs:
        d, t = last if d is None else d, t or ""
        w = t.encode().split()
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d > first[t]}
        rows.setdefault(s or "", []).append(({k for k in fails if fails[k]}, *held.get(d, (False, False))))
    out = []
    for part, docs_ in rows.items():
        steps, total = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs_
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                steps.append((part, "".join(order), k + 1, len(left), len(gone), sum(f in x[0] for x in docs_) - len(gone), sum(x[0] == {f} for x in docs_), sum(x[1] for x in gone), sum(x[2] for x in gone)))
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def audit_fixture():
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(140):
        t = " ".join(rnd.choice(vocab[: rnd.choice([20, 400])]) for _ in range(rnd.choice([5, 100, 199, 200, 350])))
        t = t.upper() if i % 7 == 0 else t
        t = t + rnd.choice(["", "", " #1", " a|b"])
        docs.append((i, docs[rnd.randrange(i)][1] if i % 5 == 4 else t, rnd.choice(["web", "web", "web", "books", None, ""])))
    docs += [(3, docs[3][1], "web"), (3, docs[9][1], "web"), (None, docs[3][1], "web"), (None, "own", "web"), (None, "own", "books"), (500, None, "only"), (501, None, "only"), (502, " \x0b\x0c", None)]
    docs += [(600, "A" * 300_000, "long"), (601, "ab " * 300_000, "long")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 140, 2)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_audit_like_plain_loops_and_sql(spark, tmp_path):
    docs, labels = audit_fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"part": F.lit("clash"), "A": F.lit(1), "key": F.lit(2)})
    m = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("clash"))
    want = plain_audit(docs, labels)
    got = A.op13(spark, d, m)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == want
    c = duckdb.connect()
    for name, df in (("documents", d), ("labels", m)):
        df.write.parquet(f"{tmp_path}/{name}")
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    assert sorted(c.execute(A.OP13_SQL).fetchall()) == want


def test_audit_of_nothing(spark):
    d, m = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.op13(spark, d, m).count() == 0
    one = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    assert A.op13(spark, one, m).count() == 600


def test_each_state_is_visited_once(spark):
    """Three filters: seven states but the full one, twelve edges."""
    rows = spark.createDataFrame([("p", i % 2 == 0, i % 3 == 0, i % 5 == 0, i % 7 == 0) for i in range(210)], "part string, x boolean, y boolean, z boolean, hot boolean")
    edges = A.counted_edges(rows, ["x", "y", "z"], ["hot"]).collect()
    assert sorted((r.state, r.filter) for r in edges) == sorted((s, i) for s in range(7) for i in range(3) if not s >> i & 1)
    assert all(r.removed == sum(not any(n % k == 0 for j, k in enumerate((2, 3, 5)) if r.state >> j & 1) and n % (2, 3, 5)[r.filter] == 0 for n in range(210)) for r in edges)
    got = A.audit(rows, ["x", "y", "z"], ["hot"])
    assert got.count() == 18 and got.where("step = 1").agg(F.max("redundant")).first()[0] == 0


def test_op11_like_sql(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i, None if i % 11 == 0 else "é x" * rnd.choice([0, 1, 30, 400])) for i in range(150)] + [(None, "last")]
    df = spark.createDataFrame(rows, FORM)
    df.write.parquet(f"{tmp_path}/documents")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in S.op11(spark, df).collect()), key=key) == sorted(c.execute(S.OP11_SQL).fetchall(), key=key)
