"""Connected components of an edge table, by alternating large and small stars.

Rounds work on the edges alone: a grouped minimum (combined before the shuffle), written, so that the join with it
meets the edges as they are and Spark can split those of a node that has many. Each round's edges are written to the
shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large or small star; edges have a > b."""
    around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).select(F.col("a").alias("of"), "m")
    least = written(least, "least")
    got = around.join(least, F.col("a") == F.col("of"))
    if large:
        new = got.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        tails = got.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = tails.unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b")))
    new = written(new.where("a != b").distinct(), "edges")
    discard(least)
    return new


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root of each node with an edge to another; root is the smallest node of its component.

    Edges may repeat, point either way or join a node to itself; rows with a null end are ignored.
    """
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct()
    now, mark = written(now, "edges"), None
    while True:
        wide = _star(now, True)
        new = _star(wide, False)
        discard(wide)
        got = new.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        discard(now)
        now = new
        if tuple(got) == mark or not got[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        mark = tuple(got)
