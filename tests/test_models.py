"""N-gram models, labelings, samplers and networks: invariants and brute force on tiny corpora."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import bags, bayes, evaluate, lexicon, neural, ngram, sampling, scores

CORPUS = [["a", "b", "c"], ["a", "b", "b"], ["c", "a", "b", "c"]]


def sents(spark, rows=CORPUS):
    return spark.createDataFrame([(i // 2, i, t) for i, t in enumerate(rows)], "doc_id long, sent_id long, tokens array<string>")


def descended(n):
    """Kneser-Ney counts by going down from each window while it is new."""
    num, seen = defaultdict(Counter), set()
    for t in CORPUS:
        t = ["<s>"] * (n - 1) + t + ["</s>"]
        for i in range(n - 1, len(t)):
            for d in range(n, 0, -1):
                g = tuple(t[i - d + 1 : i + 1])
                num[d][g] += 1
                if g in seen and d > 1 or d == 1:
                    break
                seen.add(g)
    return num


@pytest.mark.parametrize("n", [1, 2, 3])
def test_kneser_ney(spark, n):
    m = ngram.kneser_ney(ngram.windows(sents(spark), n), n)
    got = {(r.order, tuple(r.ngram)): r.c for r in m.num.collect()}
    assert got == {(d, g): c for d, per in descended(n).items() for g, c in per.items()}
    words = ["a", "b", "c", "</s>"]
    seen = {tuple(r.ngram[:-1]) for r in ngram.windows(sents(spark), n).collect()}
    wins = spark.createDataFrame([([*c, w],) for c in seen for w in words], "ngram array<string>")
    per = Counter()
    for r in ngram.probabilities(m, wins).collect():
        per[tuple(r.ngram[:-1])] += r.p
    assert all(abs(p - 1) < 1e-9 for p in per.values()) and len(per) == len(seen)


def test_save_and_selective_load(spark, tmp_path):
    m = ngram.kneser_ney(ngram.windows(sents(spark), 2), 2)
    m.save(str(tmp_path / "m"))
    assert ngram.KneserNey.load(spark, str(tmp_path / "m")).num.count() == m.num.count()
    few = spark.createDataFrame([(["a", "b"],)], "ngram array<string>")
    assert [r.ngram for r in ngram.KneserNey.load(spark, str(tmp_path / "m"), few).num.collect()] == [["a", "b"]]


def test_sentence_scores(spark):
    wins = ngram.windows(sents(spark), 3)
    m = ngram.kneser_ney(wins, 3)
    words = scores.word_log_probabilities(m, wins).collect()
    for r in scores.score_sentences(m, wins).collect():
        own = sorted((w.pos, w.lp, w.up) for w in words if w.sent_id == r.sent_id)
        lp, up, n = sum(w[1] for w in own), sum(w[2] for w in own), len(own)
        assert math.isclose(r.logprob, lp) and math.isclose(r.slor, (lp - up) / (n + 2)) and r.sent_length == n - 1
        ratio = sorted(-w[1] / w[2] for w in own)
        assert math.isclose(r.wlogprob_bot_1, ratio[0]) and math.isclose(r.ppl, 10 ** (-lp / n))


def test_laplace_and_back_off(spark):
    c = ngram.counts(sents(spark), 2)
    p = {tuple(r.ngram): r.p for r in ngram.laplace(c, 2).collect()}
    assert math.isclose(p["a", "b"], (3 + 1) / (3 + 5))
    wins = spark.createDataFrame([(["a", "b"],), (["b", "a"],), (["q", "z"],)], "ngram array<string>")
    b = {tuple(r.ngram): r.p for r in ngram.back_off(c, wins, 2).collect()}
    assert math.isclose(b["a", "b"], 1.0) and math.isclose(b["b", "a"], 3 / 16) and b["q", "z"] == 0.0


def test_word_classes(spark):
    rnd = random.Random(1)
    counts = [rnd.choice([1, 1, 1, 2, 3, 9, 40]) for _ in range(200)]
    tok = spark.createDataFrame([(f"w{i}",) for i, c in enumerate(counts) for _ in range(c)], "word string")
    v = lexicon.vocabulary(tok, spark.createDataFrame([(50,)], "n long"))
    rows = sorted(v.collect(), key=lambda r: r.word_id)
    assert [r.word_id for r in rows] == list(range(201)) and rows[0].word == "</s>"
    assert [(-r.cn, r.word) for r in rows[1:]] == sorted((-c, f"w{i}") for i, c in enumerate(counts))
    for k in (5, 100):
        a, mass, want, whole = 0, 0.0, [], sum(r.cn for r in rows)
        for i, r in enumerate(rows):
            mass += r.cn / whole
            if i and mass * k > (a + 1) + 1e-9 and a < k - 1:
                a += 1
            want.append(a)
        got = [r.class_index for r in sorted(lexicon.word_classes(v, k).collect(), key=lambda r: r.word_id)]
        assert got == want


def test_labelings(spark):
    pairs = [("x", 1), ("x", 1), ("x", 2), ("y", 2), ("y", 3), ("y", 2)]
    c = evaluate.confusion(spark.createDataFrame(pairs, "m string, g long"), "m", "g")
    assert dict(evaluate.one_to_one(c)) == {"x": 1, "y": 2}
    assert math.isclose(evaluate.accuracy(c, evaluate.many_to_one(c)).first().accuracy, 4 / 6)
    same = list(itertools.combinations(pairs, 2))
    tp = sum(a == b for a, b in same)
    r = evaluate.pairwise(c).first()
    assert math.isclose(r.precision, tp / sum(a[0] == b[0] for a, b in same)) and math.isclose(r.recall, tp / sum(a[1] == b[1] for a, b in same))
    alike = evaluate.confusion(spark.createDataFrame([("x", "x"), ("y", "y")], "m string, g string"), "m", "g")
    assert abs(evaluate.variation_of_information(alike).first().vi) < 1e-12


def test_bag_clusters(spark):
    rows = [(1, "a", 2), (1, "b", 1), (2, "a", 2), (2, "c", 1), (3, "c", 5), (3, "d", 1), (4, "z", 1)]
    b = spark.createDataFrame(rows, "k long, word string, n long")
    d = {(r.a, r.b): r for r in bags.distances(b, "k").collect()}
    assert math.isclose(d[1, 2].bray_curtis, 1 / 3) and d[1, 2].manhattan == 2 and math.isclose(d[2, 3].euclidean, math.sqrt(4 + 16 + 1))
    assert {r.k: r.cluster for r in bags.clusters(b, "k", 0.8).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_samples(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a, b = (sorted(r.k for r in sampling.sample(df.repartition(p), 50, 3, "k").collect()) for p in (1, 7))
    assert a == b and len(set(a)) == 50
    s = sents(spark)
    for x, y in zip(s.orderBy("sent_id").collect(), sampling.swap_words(s, 1).orderBy("sent_id").collect(), strict=True):
        assert sorted(x.tokens) == sorted(y.tokens)


@pytest.mark.parametrize("kind", ["bigram", "trigram"])
def test_sampler(spark, kind):
    rnd = random.Random(4)
    rows = [(i, 0, [x for _ in range(rnd.randint(2, 6)) for x in (rnd.choice([0, 1]), rnd.choice([2, 3]))]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, sent_id long, words array<int>")
    m, z = bayes.train(df.repartition(3), 4, states=2, kind=kind, sweeps=3, seed=5)
    again, _ = bayes.train(df.repartition(1), 4, states=2, kind=kind, sweeps=3, seed=5)
    assert (m.word == again.word).all() and m.word.sum() == sum(len(r[2]) for r in rows) == m.trans.sum() - 40
    assert np.allclose(m.transition().sum(-1), 1) and np.allclose(m.emission().sum(1), 1)
    assert bayes.best_states(z, m).count() == 40 and bayes.induced_classes(z, 6).count() <= 40


def test_forward_is_the_sum_over_states(spark):
    m = bayes.Model("bigram", 2, 0.1, 0.1, np.array([[3, 1, 0], [0, 2, 4]]), np.array([[1, 2, 0], [2, 0, 3], [4, 1, 0]]))
    w = [0, 2, 1]
    df = spark.createDataFrame([(0, 0, w)], "doc_id long, sent_id long, words array<int>")
    e, t, p = m.emission(), m.transition(), 0.0
    for z in itertools.product(range(2), repeat=3):
        y = [2, *z, 2]
        p += np.prod([t[a, b] for a, b in zip(y, y[1:], strict=False)]) * np.prod([e[s, x] for s, x in zip(z, w, strict=True)])
    assert math.isclose(bayes.exact_log_probabilities(df, m).first().logprob, math.log10(p))
    assert bayes.sentence_log_probabilities(df, m, 20, 10, 2).first().logprob < 0


@pytest.mark.parametrize("arity", [2, 3])
def test_huffman(arity):
    counts = [50, 20, 10, 10, 5, 3, 1, 1]
    codes = neural.huffman(counts, arity)
    assert len({tuple(c) for c in codes}) == 8
    assert not any(a != b and b[: len(a)] == a for a in codes for b in codes)
    assert len(codes[0]) <= len(codes[-1])


def test_network(spark, monkeypatch):
    rows = [(i, 0, [0, 1, 2, 0, 1, 2, 0, 1, 2]) for i in range(30)] + [(90, 0, []), (91, 0, [2])]
    df = spark.createDataFrame(rows, "doc_id long, sent_id long, words array<int>")
    counts = spark.createDataFrame([(0, 90), (1, 90), (2, 91), (3, 5)], "word int, n long")
    monkeypatch.setattr(neural.keyed, "TOKENS", 100)
    weights, losses = neural.train_bigram(df.repartition(2), counts, hidden=4, epochs=6, rate=0.3)
    loss = [r.loss for r in losses.orderBy("epoch").collect()]
    again, other = neural.train_bigram(df.coalesce(1), counts, hidden=4, epochs=6, rate=0.3)
    assert np.allclose(loss, [r.loss for r in other.orderBy("epoch").collect()], rtol=1e-9) and {r.pairs for r in losses.collect()} == {240}
    a, b = neural.matrices(weights)
    assert np.allclose(a, neural.matrices(again)[0]) and a.shape == (4, 4)
    assert loss[-1] < loss[0] and abs(neural.next_words(a, b, 0).sum() - 1) < 1e-9 and neural.next_words(a, b, 0).argmax() == 1
    assert neural.generate(a, b, 0, 2, 1) == neural.generate(a, b, 0, 2, 1)
    got = {r.doc_id: r for r in neural.bigram_scores(df, weights).collect()}
    w = rows[0][2]
    assert len(got) == 32 and math.isclose(got[0].score, sum(a[i] @ b[j] for i, j in zip(w, w[1:])) / math.log(10), rel_tol=1e-9) and (got[90].n, got[91].score) == (0, 0)


def test_noise_is_drawn_by_its_shares(spark):
    counts = spark.createDataFrame([(i, (i + 1) ** 2) for i in range(40)], "word int, n long")
    ranges = neural.noise_ranges(counts, 0.75)
    q = np.array([(i + 1) ** 1.5 for i in range(40)])
    q /= q.sum()
    rows = ranges.orderBy("word").collect()
    assert np.allclose([r.q for r in rows], q) and np.allclose([r.high for r in rows], np.cumsum(q))
    got = neural.drawn(ranges, 12, 7)
    n = np.zeros(40)
    for r in got.groupBy("word").sum("m").collect():
        n[r[0]] = r[1]
    assert n.sum() == 12 * neural.POOL and np.abs(n / n.sum() - q).max() < 0.004


def test_steps_follow_the_gradient():
    """One pair a step: the change is the slope of the contrast's log likelihood, by the times a row occurs in it."""
    draw, x, y, q = np.random.default_rng(3), None, None, np.array([0.2, 0.3, 0.5])
    x0, y0 = draw.normal(0, 1, (3, 4)), draw.normal(0, 1, (3, 4))

    def value(x, y, js):
        s = y[js] @ x[1] - np.log(2 * q[js])
        p = 1 / (1 + np.exp(-s))
        return np.log(p[0]) + np.log(1 - p[1:]).sum()

    pool = np.array([2])
    x, y = x0.copy(), y0.copy()
    n, loss = neural.contrast([np.array([1, 0])], x, y, q, pool, 1e-3, 2, np.random.default_rng(1))
    js = [0, 2, 2]
    assert n == 1 and math.isclose(-loss, value(x0, y0, js), rel_tol=1e-9)
    for z0, z, which in ((x0, x, 0), (y0, y, 1)):
        for i in np.ndindex(z0.shape):
            up = z0.copy()
            up[i] += 1e-6
            slope = (value(*((up, y0) if which == 0 else (x0, up)), js) - value(x0, y0, js)) / 1e-6
            assert math.isclose(z[i] - z0[i], 1e-3 * slope / (2 if which and i[0] == 2 else 1), abs_tol=1e-7)


def test_cleaning_sends_frequent_words_and_deals_the_others(spark, monkeypatch):
    rows = [(d, i, [f"w{(7 * d + 3 * i + j * j) % 23}{'ing' * (j % 2)}" for j in range(5 + d)]) for d in range(6) for i in range(3)]
    s = spark.createDataFrame(rows, "doc_id long, sent_id long, tokens array<string>")
    t = s.select("doc_id", "sent_id", F.posexplode("tokens").alias("pos", "word"))
    lex = lexicon.lexicon(t, 4)
    want = sorted(map(tuple, lexicon.joined(lexicon.clean(t, lex)).collect()))
    assert any("UNK" in w for r in want for w in r[2]) and any("UNK" not in w for r in want for w in r[2])
    for most in (200_000, 3, 0):
        monkeypatch.setattr(lexicon, "SENT", most)
        assert sorted(map(tuple, lexicon.clean_corpus(s, t).collect())) == want
    twice = s.union(s.where("doc_id = 2"))  # sentences that share their ids are one
    t = twice.select("doc_id", "sent_id", F.posexplode("tokens").alias("pos", "word"))
    assert sorted(map(tuple, lexicon.clean_corpus(twice, t).collect())) == sorted(map(tuple, lexicon.joined(lexicon.clean(t, lexicon.lexicon(t))).collect()))


@pytest.mark.parametrize("n", [1, 2, 3])
def test_own_probabilities_are_those_looked_up(spark, n):
    wins = ngram.windows(sents(spark), n)
    m = ngram.kneser_ney(wins, n)
    assert sorted(m.by_order) == list(range(1, n + 1))  # each order is written
    same = lambda df: {tuple(r.ngram): (round(r.p, 12), round(r.p1, 12)) for r in df.collect()}
    assert same(ngram.probabilities(m, wins)) == same(ngram.probabilities(m, wins.select("ngram")))


@pytest.mark.parametrize("kind", ["bigram", "trigram"])
def test_sentences_are_drawn_at_once_as_by_themselves(kind):
    r, S, W, trigram = np.random.default_rng(3), 4, 9, kind == "trigram"
    words = [r.integers(W, size=k) for k in (0, 1, 7, 2, 7, 40)]
    states = [r.integers(S, size=len(w)) for w in words]
    em, tr = r.random((S, W)), r.random((S + 1,) * (3 if trigram else 2))
    for best in (False, True):
        got = bayes.resample_all(words, states, em, tr, trigram, [bayes.rng(1, 2, i, 0).random(len(w)) for i, w in enumerate(words)], best)
        assert [x.tolist() for x in got] == [bayes.resample(w, z, em, tr, trigram, bayes.rng(1, 2, i, 0), best).tolist() for i, (w, z) in enumerate(zip(words, states, strict=True))]
