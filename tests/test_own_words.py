"""Scores of sentences under the model made of them, against the general way, which moves windows by their words."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import ngram, scores
from tessera.sources import corpus

TEXTS = [(0, 0, "a b c a b"), (0, 1, "b"), (1, 0, "a b c"), (None, 3, "c c c a"), (2, 0, "a b d"), (2, 7, "")]


def sentences(spark, more=()):
    rows = [(d, s, x.split(), [w != "d" for w in x.split()]) for d, s, x in [*TEXTS, *more] if x]
    return spark.createDataFrame(rows, "doc_id long, sent_id long, tokens array<string>, known array<boolean>")


def found(df):
    return sorted((str(r.doc_id), r.sent_id, r.pos, round(r.lp, 12), round(r.up, 12), getattr(r, "known", None)) for r in df.collect())


@pytest.mark.parametrize("more", [(), [(5, 0, "<s> a </s> <s> b")]])
@pytest.mark.parametrize("flag", [True, False])
def test_like_windows(spark, more, flag):
    s = sentences(spark, more)
    s = s if flag else s.drop("known")
    wins = ngram.windows(s, 3)
    want = found(scores.word_log_probabilities(ngram.kneser_ney(wins, 3), wins))
    got = scores.own_words(s)
    assert found(got) == want and len(want) == s.select(F.sum(F.size("tokens") + 1)).first()[0]


def test_other_unigrams(spark):
    s = sentences(spark).drop("known").where("doc_id IS NOT NULL")
    up = scores.reestimated_unigrams(corpus.tokens(s), s)
    of = {r["word"]: r["up"] for r in up.collect()}
    words = {(r["doc_id"], r["sent_id"]): [*r["tokens"], "</s>"] for r in s.collect()}
    got = scores.own_words(s, unigrams=up).collect()
    assert len(got) == sum(map(len, words.values())) and all(abs(r["up"] - of[words[r["doc_id"], r["sent_id"]][r["pos"]]]) < 1e-12 for r in got)


def test_many_words(spark, monkeypatch):
    """The same if words are too many to be sent."""
    monkeypatch.setattr("tessera.operators.scores.MOST", 2)
    monkeypatch.setattr("tessera.operators.lexicon.SENT", 2)
    s = sentences(spark)
    wins = ngram.windows(s, 3)
    assert found(scores.own_words(s)) == found(scores.word_log_probabilities(ngram.kneser_ney(wins, 3), wins))


def test_tokens_move_as_numbers(spark):
    """No text and no list goes back to the sentences: what moves are numbers, once a token."""
    plan = scores.own_words(sentences(spark).drop("known"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning(doc_id") == 1 and "array_join" not in plan
