"""Column functions on small fixtures with answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import filters
from tessera.sources import corpus


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("word", "mark"),
    [("well-known", "UNK-DASH"), ("1990s", "UNK-NUM-s"), ("running", "UNK-ing"), ("nation", "UNK-ion"), ("faster", "UNK-er"), ("biggest", "UNK-est"), ("quickly", "UNK-ly"), ("ability", "UNK-ity"), ("happy", "UNK-y"), ("global", "UNK-al"), ("is", "UNK"), ("gas", "UNK-s"), ("red", "UNK")],
)
def test_signatures(spark, word, mark):
    assert one(spark, T.signature(F.lit(word))) == mark
    assert one(spark, T.signature(F.lit(word), False)) == "UNK" + ("-DASH" if "-" in word else "") + ("-NUM" if word[0].isdigit() else "")


def test_percentiles(spark):
    v = F.array(*map(F.lit, [1.0, 2.0, 4.0, 8.0, 16.0]))
    assert [one(spark, T.rank_percentile(v, p)) for p in (0, 25, 50, 100)] == [1.0, 1.25, 3.0, 16.0]
    assert [one(spark, T.spaced_percentile(v, p)) for p in (25, 50)] == [1.5, 4.0]
    assert one(spark, T.rank_percentile(F.array(F.lit(5.0)), 25)) == 5.0
    assert one(spark, T.mean_up_to(v, F.lit(2.0))) == 1.5 and one(spark, T.mean_up_to(v, F.lit(0.0))) == 1.0
    assert one(spark, T.log10(F.lit(0.0))) == float("-inf")


def test_tokens_and_normal_forms(spark):
    assert one(spark, T.tokenize(F.lit(" A b\t\x0bC\n"), True)) == ["a", "b", "c"]
    assert one(spark, T.normal_trimmed(F.lit('"Hello!"'))) == "hello" and one(spark, T.normal_trimmed(F.lit("a."))) == ""
    assert one(spark, T.normal_number(F.lit("B2b"))) == "#"
    tag, word = T.tag_and_word(F.lit("NN_@dog"))
    assert (one(spark, tag), one(spark, word)) == ("NN", "dog")


def test_conll(spark):
    text = "\n\na\tX\nb\tY\n\n\nc"
    got = corpus.read_conll(spark.createDataFrame([(1, text)], "k long, b string"), "k", "b").orderBy("sent", "pos").collect()
    assert [(r.sent, r.pos, r.word, r.tag) for r in got] == [(0, 0, "a", "X"), (0, 1, "b", "Y"), (1, 0, "c", "")]


def test_files(spark, tmp_path):
    s = spark.createDataFrame([(1, 0, ["a", "b"]), (2, 0, ["c"])], "doc_id long, sent_id long, tokens array<string>")
    corpus.write_normal(s, str(tmp_path / "n"))
    assert sorted(r.line for r in corpus.read_lines(spark, str(tmp_path / "n")).collect()) == ["a b", "c"]
    corpus.write_conll(s, str(tmp_path / "c"), by_document=True)
    assert (tmp_path / "c" / "doc=000000000000002").is_dir()
    (tmp_path / "g.txt").write_text("a 3\n*****\na b 2\n")
    (tmp_path / "p.arpa").write_text("\\data\\\n\\1-grams:\n-1.5\ta\t-0.1\n\n\\2-grams:\n-1\ta b\n")
    lines = corpus.read_lines(spark, str(tmp_path / "g.txt")).withColumn("i", F.monotonically_increasing_id())
    assert sorted((r.order, r.ngram, r.c) for r in corpus.read_counts(lines, "i").collect()) == [(1, ["a"], 3), (2, ["a", "b"], 2)]
    lines = corpus.read_lines(spark, str(tmp_path / "p.arpa")).withColumn("i", F.monotonically_increasing_id())
    assert [(r.word, r.logprob) for r in corpus.read_arpa_unigrams(lines, "i").collect()] == [("a", -1.5)]


def test_predicates(spark):
    xml = F.lit('<d><wtext type="FICTION"/><textClass><catRef targets="WRI ALLTIM3"/></textClass><lg>x</lg></d>')
    names = {"POETRY": filters.has_element(xml, "lg"), "FICTION": filters.has_code(xml, "wtext", "type", "FICTION"), "NEWS": filters.has_code(xml, "wtext", "type", "NEWS"), "TIM3": filters.any_code(xml, "catRef", "targets", "ALLTIM3")}
    ask = lambda e: one(spark, filters.parse(e, names))
    assert ask("POETRY * FICTION * TIM3") and not ask("NEWS") and ask("-NEWS * (NEWS + POETRY)") and ask("TRUE") and not ask("-TRUE + FALSE")
    for bad in ("POETRY *", "(POETRY", "OTHER", "POETRY ! NEWS", "__import__('os')"):
        with pytest.raises(ValueError):
            filters.parse(bad, names)
