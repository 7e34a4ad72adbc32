"""Readers, writers, saved models, tags and evaluation by hand-made cases."""

import csv
import glob
import itertools
import random

import numpy as np

from tessera.operators import bayes, evaluate, filters, ngram, scores, tags
from tessera.operators.store import ranked
from tessera.sources import corpus, streams


def parts(path):
    return [list(csv.reader(open(f), delimiter="\t" if "corr" in path else ",")) for f in sorted(glob.glob(f"{path}/*.csv"))]


def test_score_files(spark, tmp_path):
    s = spark.createDataFrame([(2, 0, ["a", "b"], "a b"), (1, 3, ["b"], "b"), (1, 1, ["a", "a", "b"], "a a b")], "doc_id long, sent_id long, tokens array<string>, line string")
    wins = ngram.windows(s, 2)
    got = scores.score_sentences(ngram.kneser_ney(wins, 2), wins)
    streams.write_scores(got, str(tmp_path / "plain"), scores.SCORES)
    streams.write_scores(got, str(tmp_path / "text"), scores.SCORES, s)
    rows = [r for p in parts(str(tmp_path / "plain")) for r in p[1:]]
    assert parts(str(tmp_path / "plain"))[0][0] == ["id", "ppl", "sent_length", *scores.SCORES] and len(rows[0]) == 17
    assert sorted((int(r[0]), int(r[2])) for r in rows) == [(0, 3), (1, 1), (2, 2)]
    assert sorted((int(r[0]), r[-1]) for p in parts(str(tmp_path / "text")) for r in p[1:]) == [(0, "a a b"), (1, "b"), (2, "a b")]
    back = corpus.unpivot_scores(spark.read.option("header", True).csv(str(tmp_path / "plain")), ["id", "ppl", "sent_length"])
    assert back.count() == 3 * len(scores.SCORES)
    streams.write_correlations(spark.createDataFrame([("slor", 0.5)], "metric string, correlation double"), str(tmp_path / "corr"))
    assert parts(str(tmp_path / "corr")) == [[["METRICS", "CORRELATION"], ["SLOR", "0.5"]]]


def test_selective_load(spark, tmp_path):
    s = spark.createDataFrame([(0, 0, ["a", "b", "c"]), (0, 1, ["c", "d", "e"])], "doc_id long, sent_id long, tokens array<string>")
    m = ngram.kneser_ney(ngram.windows(s, 3), 3)
    m.save(str(tmp_path / "m"))
    few = ngram.windows(s.where("sent_id = 0"), 3)
    part = ngram.KneserNey.load(spark, str(tmp_path / "m"), ngram.all_orders(few, 3))
    assert part.num.count() < m.num.count() and part.ctx.count() < m.ctx.count()
    same = lambda k: sorted((r.ngram, r.p, r.p1) for r in ngram.probabilities(k, few).collect())
    assert same(part) == same(m)


def test_ranks_over_ranges(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(5), i) for i in range(500)]
    got = ranked(spark.createDataFrame(rows, "a int, b int").repartition(7), "r", "a", "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.rank)] == sorted(rows) and sorted(r.rank for r in got) == list(range(1, 501))


def test_settings_and_corpus_kinds():
    assert streams.read_properties(["# no", "a = 1", " b='x y' ", "", "! no", 'c="q"', "nothing"]) == {"a": "1", "b": "x y", "c": "q"}
    assert [streams.smoothing(*x) for x in ((True, False), (False, True), (False, False))] == ["tag", "none", "kneser-ney"]


def test_lists(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["x"]), ([], ["y"]), (["q"], ["q", "r"])], "a array<string>, b array<string>")
    got = df.select(streams.interleaved(df.a, df.b).alias("i"), streams.same_lines(df.a, df.b).alias("s")).collect()
    assert [r.i for r in got] == [["a", "x", "b", "c"], ["y"], ["q", "q", "r"]] and [r.s for r in got] == [False, True, True]


def test_tags(spark):
    df = spark.createDataFrame([("The,", "DT"), ("42", "CD"), ("--", ":"), ("x", None), ("dog", "NN"), ("odd", "ZZ")], "word string, tag string")
    got = tags.normalized(tags.without(df, [":"]), "penn").select("word", tags.reduced(df.tag).alias("r")).collect()
    assert [tuple(r) for r in got] == [("the", "DET"), ("42", "ADJ"), ("dog", "N"), ("odd", None)]
    assert len(set(tags.PENN)) == 17 and tags.normalized(df, "plain").count() == 6
    assert [r.word for r in tags.normalized(df, "numbered").collect()][1] == "#"


def test_predefined_filters(spark):
    x = '<wtext type="FICTION"><lg/></wtext><textClass><catRef targets="WRI ALLTIM3"/></textClass><catRef targets="SPO"/>'
    df = spark.createDataFrame([(x,), (None,)], "x string")
    names = filters.predefined(df.x)
    assert len(filters.CODES) == len(set(filters.CODES)) and len(names) == len(filters.CODES) + 3
    got = df.select(*[filters.parse(e, names).alias(f"c{i}") for i, e in enumerate(["FICTION * WRI", "POETRY * -ALLTIM3", "SPO + NEWS", "TRUE * -FALSE"])]).collect()
    assert list(got[0]) == [True, False, False, True] and list(got[1]) == [False, False, False, True]


def test_unknown_words_keep_their_place(spark):
    t = spark.createDataFrame([(0, 0, 0, "a"), (0, 0, 1, "zz"), (0, 0, 2, "b")], "doc_id long, sent_id long, pos long, word string")
    v = spark.createDataFrame([(0, "a"), (1, "b"), (2, "UNK")], "word_id long, word string")
    assert bayes.word_ids(t, v).first().words == [0, 2, 1] and bayes.word_ids(t, v.where("word_id < 2")).first().words == [0, -1, 1]


def test_saved_models_go_on(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(0, i, [rnd.randrange(9) for _ in range(rnd.randint(0, 7))]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, sent_id long, words array<int>")
    for kind in ("bigram", "trigram"):
        whole, states = bayes.train(df, 9, 3, kind, sweeps=3)
        half, kept = bayes.train(df, 9, 3, kind, sweeps=2)
        bayes.save(half, spark, str(tmp_path / kind))
        again = bayes.load(spark, str(tmp_path / kind))
        assert (again.word == half.word).all() and (again.trans == half.trans).all() and again.gamma == half.gamma
        more, end = bayes.train(df, 9, 3, kind, sweeps=1, start=kept, done=2)
        assert (more.word == whole.word).all() and (more.trans == whole.trans).all()
        by = lambda s: {r.sent_id: r.states for r in s.collect()}
        assert by(end) == by(states)


def test_bundle_of_twelve(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(4), rnd.choice(["A1", "A2", "B1", "B2"])) for _ in range(200)]
    row = evaluate.bundle(evaluate.confusion(spark.createDataFrame(pairs, "m int, g string"), "m", "g"), lambda g: g.substr(1, 1))
    got, line = row.first(), evaluate.bundle_line(row).first().value
    assert len(got) == 12 and line.split("\t") == [f"{x:.6f}" for x in got]
    for name, data in (("full", pairs), ("reduced", [(m, g[0]) for m, g in pairs])):
        ms, gs = [m for m, _ in data], [g for _, g in data]
        n = {(m, g): data.count((m, g)) for m in set(ms) for g in set(gs)}
        cost = lambda m, g: 1 - n[m, g] / (ms.count(m) + gs.count(g) - n[m, g])
        left, right, one = set(), set(), 0
        for m, g in sorted((x for x in n if n[x]), key=lambda x: (cost(*x), x)):
            if m not in left and g not in right:
                one += n[m, g]
                left.add(m)
                right.add(g)
        many = sum(n[m, min((g for g in set(gs) if n[m, g]), key=lambda g: (cost(m, g), g))] for m in set(ms))
        assert abs(got[f"{name}_one_to_one"] - one / 200) < 1e-9 and abs(got[f"{name}_many_to_one"] - many / 200) < 1e-9
        tp = sum(a[0] == b[0] and a[1] == b[1] for a, b in itertools.combinations(data, 2))
        assert abs(got[f"{name}_precision"] - tp / sum(a == b for a, b in itertools.combinations(ms, 2))) < 1e-9
        h = lambda xs: -sum((c := xs.count(x) / 200) * np.log(c) for x in set(xs))
        mi = sum(n[x] / 200 * np.log(n[x] / 200 / (ms.count(x[0]) / 200 * gs.count(x[1]) / 200)) for x in n if n[x])
        assert abs(got[f"{name}_vi"] - (h(ms) + h(gs) - 2 * mi)) < 1e-9
