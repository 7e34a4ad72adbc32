"""Bags of words: counts, centroids, distances and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def bag_counts(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, word, n."""
    return tokens.groupBy(key, "word").agg(F.count("*").alias("n"))


def centroid(bags: DataFrame, key: str, *by: str) -> DataFrame:
    """Mean counts by group over all its bags, rounded half up; zeros go."""
    size = bags.select(*by, key).distinct().groupBy(*by).agg(F.count("*").alias("bags"))
    size = size.select(*[F.col(c).alias(f"of_{c}") for c in by], "bags")
    on = [F.col(c) == F.col(f"of_{c}") for c in by]
    got = bags.groupBy(*by, "word").agg(F.sum("n").alias("n")).join(size, on)
    return got.select(*by, "word", F.floor(F.col("n") / F.col("bags") + 0.5).cast("long").alias("n")).where("n > 0")


def centroid_of(docs: DataFrame, key: str, *by: str) -> DataFrame:
    """centroid() of the bags of documents (`by`, tokens) whose keys are their own: words are counted by group at once."""
    some = docs.where(F.size("tokens") > 0)
    size = some.where(F.col(key).isNotNull()).groupBy(*[F.col(c).alias(f"of_{c}") for c in by]).agg(F.count("*").alias("bags"))
    got = some.where(F.col(key).isNotNull()).select(*by, F.explode("tokens").alias("word")).groupBy(*by, "word").agg(F.count("*").alias("n"))
    got = got.join(F.broadcast(size), [F.col(c) == F.col(f"of_{c}") for c in by])  # a row a group
    return got.select(*by, "word", F.floor(F.col("n") / F.col("bags") + 0.5).cast("long").alias("n")).where("n > 0")


def shared(bags: DataFrame, key: str) -> DataFrame:
    """a, b, least, near, near2: for bags that share a word, the sums of the lesser counts, of |x-y| - x - y, and of (x-y)^2 - x^2 - y^2."""
    x = bags.select(F.col(key).alias("a"), F.col("word").alias("w"), F.col("n").alias("x"))
    y = bags.select(F.col(key).alias("b"), F.col("word").alias("v"), F.col("n").alias("y"))
    met = x.join(y, (F.col("w") == F.col("v")) & (F.col("a") < F.col("b")))
    d = F.col("x") - F.col("y")
    return met.groupBy("a", "b").agg(F.sum(F.least("x", "y")).alias("least"), F.sum(F.abs(d) - F.col("x") - F.col("y")).alias("near"), F.sum(d * d - F.col("x") * F.col("x") - F.col("y") * F.col("y")).alias("near2"))


def distances(bags: DataFrame, key: str) -> DataFrame:
    """a, b, bray_curtis, manhattan, euclidean of bags that share a word; of others the first is 1 and the rest follow from the sizes."""
    size = bags.groupBy(key).agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    one = lambda p: size.select(F.col(key).alias(f"k{p}"), F.col("s").alias(f"s{p}"), F.col("q").alias(f"q{p}"))
    got = shared(bags, key).join(one("a"), F.col("a") == F.col("ka")).join(one("b"), F.col("b") == F.col("kb"))
    s = F.col("sa") + F.col("sb")
    return got.select("a", "b", (1 - 2 * F.col("least") / s).alias("bray_curtis"), (s + F.col("near")).cast("double").alias("manhattan"), F.sqrt((F.col("qa") + F.col("qb") + F.col("near2")).cast("double")).alias("euclidean"))


def minkowski(bags: DataFrame, key: str, p: int) -> DataFrame:
    """a, b, minkowski: the p-th root of the sum of p-th powers of differences, of bags that share a word."""
    size = bags.groupBy(key).agg(F.sum(F.pow("n", F.lit(p))).alias("s"))
    x = bags.select(F.col(key).alias("a"), F.col("word").alias("w"), F.col("n").alias("x"))
    y = bags.select(F.col(key).alias("b"), F.col("word").alias("v"), F.col("n").alias("y"))
    met = x.join(y, (F.col("w") == F.col("v")) & (F.col("a") < F.col("b")))
    both = met.groupBy("a", "b").agg(F.sum(F.pow(F.abs(F.col("x") - F.col("y")), F.lit(p)) - F.pow("x", F.lit(p)) - F.pow("y", F.lit(p))).alias("near"))
    got = both.join(size.select(F.col(key).alias("ka"), F.col("s").alias("sa")), F.col("a") == F.col("ka")).join(size.select(F.col(key).alias("kb"), F.col("s").alias("sb")), F.col("b") == F.col("kb"))
    return got.select("a", "b", F.pow(F.col("sa") + F.col("sb") + F.col("near"), F.lit(1.0 / p)).alias("minkowski"))


def merged_space(a, b):
    """The words of two spaces, each once and sorted."""
    return F.array_sort(F.array_union(a, b))


def clusters(bags: DataFrame, key: str, threshold: float) -> DataFrame:
    """key, cluster: single-link clusters under Bray-Curtis distance; cluster is the smallest key."""
    close = distances(bags, key).where(F.col("bray_curtis") <= threshold)
    edges = written(close.select("a", "b").union(close.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = written(bags.select(F.col(key).alias("node")).distinct().withColumn("cluster", F.col("node")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("cluster").alias("least"))
        step = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("cluster", F.coalesce("least", "cluster")).alias("c"))
        jump = step.select(F.col("node").alias("at"), F.col("c").alias("next"))
        new = written(step.join(jump, F.col("c") == F.col("at")).select("node", F.col("next").alias("cluster")), "labels")
        if new.join(labels.withColumnRenamed("cluster", "old"), "node").where("cluster <> old").isEmpty():
            return new.select(F.col("node").alias(key), "cluster")
        labels = new
