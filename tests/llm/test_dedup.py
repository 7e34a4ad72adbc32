"""SimHash groups, repeated windows, benchmark windows: each against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from tessera.llm import decontaminate as D
from tessera.llm import near_duplicate as N
from tessera.llm import simhash as S
from tessera.llm import substring_dedup as X
from tessera.llm.components import components

RND = random.Random(11)
VOCAB = ["".join(RND.choice("abcdeéñ") for _ in range(RND.randint(1, 6))) for _ in range(300)]


def words(n, rnd=RND):
    return [rnd.choice(VOCAB) for _ in range(n)]


def corpus():
    """Copies, near copies, shared passages, odd and empty texts."""
    rnd, base, passage = random.Random(3), words(220), words(70)
    rows = [(i, " ".join(words(rnd.randint(0, 160), rnd))) for i in range(60)]
    for i in range(60, 110):
        w = list(base)
        w[rnd.randrange(len(w))] = rnd.choice(VOCAB)
        rows.append((i, (" " if i % 2 else "\n").join(w)))
    rows += [(i, " ".join(words(20, rnd) + passage + words(rnd.randint(0, 30), rnd))) for i in range(110, 130)]
    rows += [(130, " ".join(base)), (131, " ".join(base).upper()), (132, None), (133, ""), (134, "x y"), (135, "x  y"), (None, " ".join(base)), (130, " ".join(base)), (137, "a " * 400)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'n' AS node", "0 AS bucket", "'k' AS key", "1 AS w0").repartition(3)


def fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) > k else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(fps, near):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if near(fps[i], fps[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("most", [S.MOST, 3])
def test_groups(spark, most):
    rows = corpus()
    df = frame(spark, rows)
    got = S.groups(S.fingerprints(df), S.EXACT, most=most).collect()
    fps = [fingerprint(x) for _, x in rows]
    roots = grouped(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted((str(i), f, least[r]) for (i, _), f, r in zip(rows, fps, roots))
    assert sorted((str(r.doc_id), r.w0 & (2**64 - 1), r.component_id) for r in got) == want


def test_buckets_meet_all_within_the_radius():
    rnd = np.random.default_rng(4)
    a = rnd.integers(0, 2**63, 300).astype(np.uint64)
    b = a.copy()
    for i in range(300):
        for bit in rnd.choice(64, 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    for i in range(300):
        _, x = S.EXACT.buckets(a[i : i + 1, None])
        _, y = S.EXACT.buckets(b[i : i + 1, None])
        met = np.intersect1d(x, y)
        chain = (met >> np.uint64(48)).astype(int)
        n = len(met)
        assert n and S.EXACT.close(chain, np.repeat(a[i : i + 1, None], n, 0), np.repeat(b[i : i + 1, None], n, 0)).any()


def alike(x, y, k=5):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    a, b = shingles(x), shingles(y)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_odd_sketches_bound_the_difference():
    rnd = np.random.default_rng(2)
    for n in (0, 1, 30, 500, 5000):
        x = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        y = np.union1d(x[rnd.random(len(x)) < 0.9], rnd.integers(0, 2**63, n // 12).astype(np.uint64))
        d = int(N.distance(N.odd_sketch(x)[None].view(np.uint64), N.odd_sketch(y)[None].view(np.uint64))[0])
        real = len(np.setxor1d(x, y))
        assert d <= real and (d - real) % 2 == 0 and (n != 500 or d >= 0.8 * real)


@pytest.mark.parametrize("most", [S.MOST, 30])
def test_near_duplicates_of_five_words(spark, most):
    """Groups are those of all exact similarities: of pairs around 0.8 on either side, and of a group beyond a bucket's size."""
    rnd, rows = random.Random(21), corpus()
    for g in range(40):
        base = words(rnd.randint(80, 300), rnd)
        for _ in range(2):
            w = list(base)
            for _ in range(rnd.randint(0, len(base) // 40)):
                w[rnd.randrange(len(w))] = rnd.choice(VOCAB) + "q"
            rows.append((200 + len(rows), " ".join(w)))
    got = N.near_duplicates(frame(spark, rows), most=most).collect()
    texts = [x for _, x in rows]
    sims = {(i, j): alike(texts[i], texts[j]) for i in range(len(rows)) for j in range(i)}
    roots = grouped(list(range(len(rows))), lambda i, j: sims[i, j] >= 0.8)
    sure = grouped(list(range(len(rows))), lambda i, j: sims[i, j] >= 0.85)
    mine = {}
    for r in got:
        mine.setdefault(r.doc_id, r.component_id)
    own = [mine[i] for i, _ in rows]
    assert len(got) == len(rows) and sum(0.7 <= s < 0.8 for s in sims.values()) > 3
    missed = 0
    for i, j in sims:
        assert own[i] != own[j] or roots[i] == roots[j]
        assert own[i] == own[j] or sure[i] != sure[j]
        missed += own[i] != own[j] and roots[i] == roots[j]
    assert missed <= 1


@pytest.mark.parametrize("most", [S.MOST, 30])
def test_near_duplicates_lose_no_short_text(spark, most):
    """Texts of 8 words and the same with one more (4 of 5 shingles), 12 of 15, and a large bucket of texts around one phrase: the groups are the exact ones."""
    rnd, rows = random.Random(5), []
    own = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    for n, more in [(8, 1)] * 60 + [(16, 3)] * 40:
        w = own(n)
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w + own(more)))]
    phrase = own(9)
    for _ in range(60):
        w = phrase + own(rnd.randint(0, 12))
        rows += [(len(rows), " ".join(w)), (len(rows) + 1, " ".join(w + own(rnd.randint(1, 4))))]
    texts = [x for _, x in rows]
    want = grouped(list(range(len(rows))), lambda i, j: alike(texts[i], texts[j]) >= 0.8)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(frame(spark, rows), most=most).collect()}
    mine = [got[i] for i, _ in rows]
    assert len({(a, b) for a, b in zip(mine, want)}) == len(set(mine)) == len(set(want))


def test_forest_links_what_the_radius_links():
    rnd = np.random.default_rng(8)
    fps = rnd.integers(0, 2**63, (40, 4)).astype(np.uint64)
    fps = np.concatenate([fps, fps ^ (np.uint64(1) << rnd.integers(0, 40, (40, 4)).astype(np.uint64)), fps[:3]])
    a, b = N.forest(fps, 9)
    want = grouped([tuple(map(int, x)) for x in fps], lambda x, y: sum((p ^ q).bit_count() for p, q in zip(x, y)) <= 9)
    x, y = S.spanning(len(fps), a, b)
    root = np.arange(len(fps))
    root[x] = y
    assert len(a) == len(fps) - len(set(want)) and len({(r, w) for r, w in zip(root.tolist(), want)}) == len(set(want))


def test_empty_tables(spark):
    none = frame(spark, corpus()).where("false")
    assert N.near_duplicates(none).count() == 0
    assert [x.count() for x in X.deduplicate(none)] == [0, 0]
    assert D.contamination(none, none.selectExpr("doc_id AS item_id", "text")).count() == 0


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 530)] + [(600, i) for i in range(601, 640)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("most", [X.MOST, 2])
def test_windows(spark, most):
    rows = corpus()
    all_rows, less = X.deduplicate(frame(spark, rows), most=most)
    lost = {(r.doc, r.key): r for r in less.collect()}
    first = {}
    for i, x in rows:
        w = (x or "").encode().split()
        for k in range(len(w) - 49):
            t = tuple(w[k : k + 50])
            first[t] = min(first.get(t, X.LAST_ID), X.LAST_ID if i is None else i)
    seen = 0
    for i, x in rows:
        doc, w = X.LAST_ID if i is None else i, (x or "").encode().split()
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < doc:
                gone |= set(range(k, k + 50))
        kept = b" ".join(v for j, v in enumerate(w) if j not in gone)
        r = lost.get((doc, X.text_key((x or "").encode())))
        assert (r.n_removed if r else 0) == len(gone), i
        if r:
            seen += 1
            assert r.sha == hashlib.sha256(kept).hexdigest() and r.kept.encode() == kept
    assert seen > 20 and sorted(r.n_words for r in all_rows.collect()) == sorted(len((x or "").split()) for _, x in rows)


def test_word_hashes_of_pieces(monkeypatch):
    data = " ".join(words(500)).encode() + b"  \n" + b"z" * 300
    whole = X.word_hashes(data)
    monkeypatch.setattr(X, "PIECE", 64)
    parts = X.word_hashes(data)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and len(whole[0]) == 501


def test_items_within_the_radius_are_met():
    rnd = np.random.default_rng(6)
    index = D.Items(list(range(300)), [" ".join(f"w{i}x{j}" for j in range(9)).encode() for i in range(300)])
    fp = index.fp[rnd.integers(0, 300, 200)].copy()
    for i in range(200):
        for bit in rnd.choice(64, rnd.integers(0, 26), replace=False):
            fp[i] ^= np.uint64(1) << np.uint64(bit)
    fp[:5] = fp[5]
    want = [(w, i, d) for w in range(200) for i in range(300) if (d := int(np.bitwise_count(fp[w] ^ index.fp[i]))) <= D.RADIUS]
    assert index.near(fp, 9) == want and max(d for _, _, d in want) == D.RADIUS


@pytest.mark.parametrize("block", [D.ITEMS, 5])
def test_contamination(spark, block, monkeypatch):
    monkeypatch.setattr(D, "ITEMS", block)
    rnd = random.Random(9)
    items = [(i, " ".join(words(rnd.randint(12, 40), rnd))) for i in range(20)] + [(20, "tiny"), (21, None), (22, "Uvw xyz")]
    docs = []
    for i in range(80):
        w = words(rnd.randint(0, 120), rnd)
        if i % 4 == 0:
            item = items[rnd.randrange(20)][1].split()
            if i % 8 == 0:
                item[-1] = "changed"
            at = rnd.randint(0, len(w))
            w[at:at] = [x.upper() if i % 3 else x for x in item]
        docs.append((i, " ".join(w)))
    docs += [(80, None), (81, "so uvw\nXYZ it is"), (0, docs[0][1]), (None, items[3][1]), (82, "and so on " * 1500 + items[4][1])]
    got = {(r.doc_id, r.item_id, r.first_word, round(r.similarity, 9)) for r in D.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for i, x in docs:
        w = (x or "").encode().lower().split()
        for item, y in items:
            v = (y or "").encode().lower().split()
            if v:
                best = max(((D.weighted(w[p : p + len(v)], v, min(5, len(v))), -p) for p in range(len(w) - len(v) + 1)), default=(0, 0))
                if best[0] >= 0.8:
                    want.add((i, item, -best[1], round(best[0], 9)))
    assert got == want and len(want) > 7


def test_contamination_of_documents_shorter_than_an_item():
    """A document that is an item without some of its words is found by its own size, as plain loops find it."""
    rnd = random.Random(12)
    items = [f"q{i} " + " ".join(words(rnd.randint(3, 60), rnd)) for i in range(30)] + [" ".join(["a b"] * 20)]
    docs = ["", "a", " ".join(["a b"] * 18), " ".join(["a b"] * 12)]
    for x in items[:30]:
        w = x.split()
        docs += [" ".join(w[rnd.randint(0, 2) : len(w) - rnd.randint(1, 6)]), " ".join(w[1:]).upper()]
    docs.append(" ".join(max(items, key=len).split()[:-2]))
    index = D.Items(list(range(len(items))), [x.encode() for x in items])
    got = {(i, item, n, round(sim, 9)) for i, item, p, _, sim, n in index.find([x.encode() for x in docs]) if n < index.size[item] and p == 0}
    want = set()
    for i, x in enumerate(docs):
        w = x.encode().lower().split()
        for item, v in enumerate(x.split() for x in index.texts):
            if len(w) < len(v) and (sim := D.weighted(w, v, min(5, len(v)))) >= 0.8:
                want.add((i, item, len(w), round(sim, 9)))
    assert got == want and len(want) > 20


def test_no_pair_is_ruled_out_by_fingerprints():
    """Rows of one bucket and like sizes are candidates, however far their fingerprints are; others are not."""
    row = lambda node, size, bits: [7, 0, node, size, *[-1 if bits else 0] * N.KEPT]
    rows = np.array([row(1, 10, 0), row(2, 10, 1), row(3, 12, 1), row(4, 13, 0)], np.int64)
    a, b = N.all_pairs(rows, 0.8)
    assert sorted(zip(a.tolist(), b.tolist())) == [(1, 2), (1, 3), (2, 3), (3, 4)]


def test_chains_prune_large_buckets_and_lose_no_component():
    """Over all buckets of all rows, links by chain budgets give the components of the full distance."""
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 63, (12, 1), dtype=np.int64).astype(np.uint64)
    fps = np.concatenate([base ^ np.bitwise_or.reduce(np.uint64(1) << draw.integers(0, 64, (12, 3), dtype=np.int64).astype(np.uint64), axis=1)[:, None] for _ in range(60)])
    ring = S.EXACT
    own, bucket = ring.buckets(fps)
    rows = np.stack([bucket.view(np.int64), np.zeros(len(own), np.int64), own, fps[own, 0].view(np.int64)], axis=1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    assert (S.bucket_starts(rows)[1] > S.SHORT).any()
    a, b = S.spanning_links(rows, ring)
    i, j = np.nonzero(np.triu(np.bitwise_count(fps ^ fps[:, 0]) <= 4, 1))
    label = lambda x, y: (lambda m: {**dict(zip(range(len(fps)), range(len(fps)))), **dict(zip(m[0].tolist(), m[1].tolist()))})(S.spanning(len(fps), np.asarray(x), np.asarray(y)))
    assert label(a, b) == label(i, j)


def test_near_duplicates_go_through_the_pigeonring(spark, monkeypatch):
    near = [0, 0b1111, 0b11110000_1111, (1 << 40) - 1, ((1 << 40) - 1) ^ 0b10001]
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(near)], "node long, w0 long")
    got = {(min(r), max(r)) for r in map(tuple, N.pigeonring(nodes).collect())}
    assert {x for p in got if max(p) < 3 for x in p} == {0, 1, 2} and (3, 4) in got and all((min(p) < 3) == (max(p) < 3) for p in got)
    asked, own = [], N.pigeonring
    monkeypatch.setattr(N, "pigeonring", lambda nodes, most: asked.append(nodes.count()) or own(nodes, most))
    text = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(1, text), (2, text.replace("w150 ", "zz ")), (3, "a b c d e f g")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in N.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3} and asked == [3]
