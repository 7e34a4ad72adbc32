"""Queries against their SQL, and the driver's contract."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans.estimation_sql import ESTIMATION
from tessera.plans.more_sql import MORE

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(float(v)) if type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["lexicon", "unknown_signatures", "conll_sentences", "kn_twosided_ctx", "score_correlation", "vocabulary", "document_filter", "bag_distances", "pairwise_prf", "variation_of_information", "hmm_transition_prob", "chunk_prob", "kn_meta", "document_numbers", "lm_interpolation", *ESTIMATION, *MORE])
def test_like_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    order = [cols.index(c) for c in sorted(cols)]
    assert sorted(cols) == sorted(df.columns)
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_stream(spark, tmp_path):
    from tessera.operators.ngram import kneser_ney, windows
    from tessera.streaming.scoring import score_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("a b c\n\nb a\nb a\n")
    s = spark.createDataFrame([(0, 0, ["a", "b", "c"]), (0, 1, ["b", "a"])], "doc_id long, sent_id long, tokens array<string>")
    got = []
    score_stream(spark, str(tmp_path / "in"), kneser_ney(windows(s, 2), 2), lambda df, n: got.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.sent_length for r in got) == [2, 2, 3]
