"""Queries that work on sentences as they are, against their SQL and against the operators over tokens."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import bags, hmm, lexicon, ngram, scores
from tessera.sources import corpus, streams
from tests.test_queries import DATA, TABLES, plain

TEXTS = [(0, "a b c d e f g\n\nb a", "x"), (1, "c c a b q", "y"), (2, "", "x"), (3, "a b\nz a b c", None)]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")


def rows(df):
    return sorted(tuple(map(str, (r[c] for c in sorted(df.columns)))) for r in df.collect())


@pytest.mark.parametrize("name", ["unigram_reestimate", "kn_tag_prob", "bag_centroid", "chunk_transition_prob", "chunk_bigrams", "chunk_counts", "kn_meta", "kn_twosided_ctx"])
def test_like_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    cur = c.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    want = sorted(tuple(plain(r[cols.index(k)]) for k in sorted(cols)) for r in cur.fetchall())
    assert sorted(tuple(plain(r[k]) for k in sorted(df.columns)) for r in df.collect()) == want


def test_chunks_of_sentences(docs):
    s = corpus.sentences(docs).select("doc_id", "sent_id", "tokens")
    t = corpus.tokens(s).withColumns({"state": F.ascii("word") % 5, "boundary": F.col("pos") % 3 == 2})
    wide = s.withColumns({"states": F.transform("tokens", lambda w: F.ascii(w) % 5), "ends": F.transform("tokens", lambda w, i: i % 3 == 2)})
    assert rows(hmm.segments_of(wide)) == rows(hmm.segments(t))
    assert rows(hmm.bigrams_of(wide)) == rows(hmm.chunk_bigrams(hmm.segments(t)))


def test_centroids_of_documents(docs):
    whole = docs.select("doc_id", "lang", F.split(F.regexp_replace("text", "\n+", " "), " ").alias("tokens")).withColumn("tokens", F.filter("tokens", lambda w: w != ""))
    bag = bags.bag_counts(corpus.tokens(corpus.sentences(docs))).join(docs.select("doc_id", "lang"), "doc_id")
    assert rows(bags.centroid_of(whole, "doc_id", "lang")) == rows(bags.centroid(bag, "doc_id", "lang"))


def test_counts_of_the_cleaned_corpus(docs):
    s = corpus.sentences(docs)
    clean = lexicon.clean_corpus(s, corpus.tokens(s))
    want = scores.reestimated_unigrams(corpus.tokens(clean), clean)
    assert rows(scores.unigrams_of(lexicon.cleaned_counts(corpus.tokens(s)), s)) == rows(want)
    for n in (1, 2, 3):
        wins = ngram.windows(clean, n)
        assert rows(ngram.unigram_denominator(wins, n)) == rows(ngram.kneser_ney(wins, n).meta)


def test_ids_of_sentences_that_share_theirs(spark, docs):
    """Sentences of one id are one, as before; those with ids of their own are looked up in place."""
    s = corpus.sentences(docs).select("doc_id", "sent_id", "tokens")
    vocab = spark.createDataFrame([(0, "</s>"), (1, "a"), (2, "<unk>"), (3, "c")], "word_id long, word string")
    got = {(r.doc_id, r.sent_id): (r.ids, r.oov) for r in streams.sentence_ids(s, vocab, reverse=True, longest=5).collect()}
    assert got == {(0, 0): ([0, -1, -1, -1, 0], True), (0, 2): ([0, 1, -1, 0], True), (1, 0): ([0, -1, -1, 1, 0], True), (3, 0): ([0, -1, 1, 0], True), (3, 1): ([0, 3, -1, 1, 0], True)}
    assert {tuple(r.ids) for r in streams.sentence_ids(s, vocab, convert=True).where("doc_id = 3").collect()} == {(0, 1, 2, 0), (0, 2, 1, 2, 3, 0)}
    twice = streams.sentence_ids(s.unionByName(s), vocab)
    assert twice.count() == 5 and twice.where("doc_id = 0 AND sent_id = 2").first().ids == [0, -1, -1, 1, 1, 0]


@pytest.mark.parametrize("name", ["net_sentence_ids", "net_unknown_ids"])
def test_ids_of_a_long_sentence(spark, tmp_path, name):
    """No word of a sentence goes, however many it has: the SQL has no longest sentence."""
    c = duckdb.connect()
    c.execute("CREATE TABLE documents AS SELECT CAST(1 AS BIGINT) AS doc_id, string_agg('w' || i % 30, ' ' ORDER BY i) || ' rare' AS text FROM range(12000) t(i)")
    c.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    got = [(r.doc_id, r.sent_id, r.ids, r.oov) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    want = c.execute(f"SELECT doc_id, sent_id, ids, oov FROM ({entry.oracle_sql()[name]})").fetchall()
    assert len(want[0][2].split()) == 12003 and got == want


def test_sentences_are_padded_once(spark, docs):
    """No filter works out windows or chunks before they are made: it would pad or join the sentence again for each word."""
    s = corpus.sentences(docs).select("doc_id", "sent_id", "tokens")
    wide = s.select("*", F.col("tokens").alias("words"), F.transform("tokens", F.length).alias("states"), F.transform("tokens", lambda w, i: i % 3 == 2).alias("ends"))
    for df in (ngram.windows(s, 3), ngram.two_sided(s, 2), ngram.tagged_windows(wide, 3), hmm.segments_of(wide), hmm.bigrams_of(wide)):
        lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert not any("Filter" in x and ("array_repeat" in x or "array_join" in x) for x in lines)
