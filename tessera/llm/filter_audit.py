"""Filter interaction audit: what each filter removes after each set of others, over all orders.

The orders of the filters form a trie; what is left at a node depends on the set of filters applied, not on their order. The trie is
walked depth-first: a filter is applied to the persisted survivors of the node above, the survivors are persisted in turn, and each set is visited
once (memoisation), whatever number of orders pass it. At every set one aggregate over its survivors counts what each further filter
keeps and removes; these edges are written as rows. All other numbers follow from counted edges: what a filter would remove at first, what it
alone removes (its edge from the set of all others), and its removals over all orders (each edge times the orders that pass it).

Predicates are evaluated once a row; survivors are rows of a part, one flag a filter and one a mark, without texts. Lost executors cost the
persisted blocks they held, which come again from the written flags. Survivors are counted before the shuffle, so a part with
most rows is no burden.

A null text is empty; a null part is the empty part; a null id comes after all others, so its text is a copy if another id has it. Rows with one id and
text are no copies of each other. Labels that repeat an id hold if one of them does; labels without an id, and nulls in labels, hold for none. Texts
of any length are read whole. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, shared_dir, text_of, written

#: Rows of a table of ids or checksums that may be broadcast (some 50 bytes each, 10 MB); beyond it is joined by a shuffle.
MOST = 200_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST else df


def text_filters() -> dict[str, Callable[[Column], Column]]:
    """The failure conditions of four filters on a text; `copied` is the fifth."""
    words = lambda t: F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return {
        "A": lambda t: F.size(words(t)) < 200,
        "B": lambda t: 100 * F.size(F.array_distinct(words(t))) < 50 * F.size(words(t)),
        "C": lambda t: 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > 2 * F.length(t),
        "D": lambda t: t.rlike("[#$%&*|]"),
    }


def copied(rows: DataFrame, name: str) -> DataFrame:
    """Adds the flag `name`: the text (its checksum `key`) is that of a row with a smaller id (`id_`)."""
    first = rows.groupBy(F.col("key").alias("of")).agg(F.min("id_").alias("first"), F.max("id_").alias("last")).where("first < last").drop("last")
    met = rows.join(_small(written(first, "copies")), F.col("key") == F.col("of"), "left")
    return met.withColumn(name, F.coalesce(F.col("id_") > F.col("first"), F.lit(False))).drop("of", "first")


def marked(rows: DataFrame, labels: DataFrame, marks: dict[str, Column], id_col: str = "doc_id") -> DataFrame:
    """Adds a flag a mark, by the labels of an id."""
    hold = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("of")).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in marks.items()])
    hold = written(hold.where(" OR ".join(marks)), "marks")
    met = rows.drop(*marks).join(_small(hold), F.col("id_") == F.col("of"), "left")
    return met.withColumns({n: F.coalesce(n, F.lit(False)) for n in marks}).drop("of")


def counted_edges(rows: DataFrame, names: list[str], marks: list[str], part: str = "part") -> DataFrame:
    """part, state, filter, kept, removed and lost_<mark> of every set of filters applied (`state`, a bit a filter) and every further filter (its number).

    rows: the part, a flag a filter (true: it fails), a flag a mark. Counts of parts that a set leaves without rows are missing.
    """
    spark = rows.sparkSession
    path, seen = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}", set()
    form = f"part {rows.schema[part].dataType.simpleString()}, state int, filter int, kept long, removed long" + "".join(f", lost_{m} long" for m in marks)

    def visit(state: int, survivors: DataFrame) -> None:
        seen.add(state)
        left = [i for i in range(len(names)) if not state >> i & 1]
        fails = {i: F.col(names[i]) for i in left}
        counts = survivors.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("all"), *[
            c for i in left for c in (F.count_if(fails[i]).alias(f"r{i}"), *[F.count_if(fails[i] & F.col(m)).alias(f"l{i}_{m}") for m in marks])
        ])
        edges = [F.struct(F.lit(state).alias("state"), F.lit(i).alias("filter"), (F.col("all") - F.col(f"r{i}")).alias("kept"), F.col(f"r{i}").alias("removed"), *[F.col(f"l{i}_{m}").alias(f"lost_{m}") for m in marks]) for i in left]
        counts.select("part", F.explode(F.array(*edges)).alias("e")).select("part", "e.*").write.mode("append").parquet(path)
        for i in left:
            below = state | 1 << i
            if below not in seen and below != (1 << len(names)) - 1:
                kept = survivors.where(~fails[i]).persist(StorageLevel.MEMORY_AND_DISK)
                visit(below, kept)
                kept.unpersist()

    root = rows.select(part, *names, *marks).persist(StorageLevel.MEMORY_AND_DISK)
    visit(0, root)
    root.unpersist()
    return spark.read.schema(form).parquet(path)


def audit(rows: DataFrame, names: list[str], marks: list[str], part: str = "part") -> DataFrame:
    """A row for each part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, lost_<mark>, shapley."""
    spark, n = rows.sparkSession, len(names)
    edges, full = counted_edges(rows, names, marks, part), (1 << n) - 1
    every = [(s, i) for s in range(full) for i in range(n) if not s >> i & 1]
    grid = edges.where("state = 0 AND filter = 0").select("part", F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(i).alias("filter")) for s, i in every])).alias("e")).select("part", "e.*")
    counts = ["kept", "removed", *[f"lost_{m}" for m in marks]]
    whole = grid.join(edges, ["part", "state", "filter"], "left").na.fill(0, counts)
    of = Window.partitionBy("part", "filter")  # as many rows as there are sets of the other filters
    alone = F.expr(f"{full} - shiftleft(1, `filter`)")
    passes = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)) for k in range(n)]), F.bit_count("state") + 1)
    whole = whole.withColumns({
        "redundant": F.max(F.when(F.col("state") == 0, F.col("removed"))).over(of) - F.col("removed"),
        "unique_fails": F.max(F.when(F.col("state") == alone, F.col("removed"))).over(of),
        "shapley": F.sum(F.col("removed") * passes).over(of).cast("long"),
    })
    steps = [("".join(names[i] for i in order), k + 1, sum(1 << i for i in order[:k]), order[k]) for order in permutations(range(n)) for k in range(n)]
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, state int, filter int"))  # rows fixed by the number of filters
    return whole.join(steps, ["state", "filter"]).select("part", "filter_order", "step", *counts[:2], "redundant", "unique_fails", *counts[2:], "shapley")


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, the flags A to E and the marks good and toxic of each document, written."""
    filters = text_filters()
    rows = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col("doc_id"), F.lit(LAST_ID)).alias("id_"), text_of().alias("text"))
    rows = written(rows.select("part", "id_", F.unhex(F.sha2("text", 256)).alias("key"), *[f(F.col("text")).alias(n) for n, f in filters.items()]), "flags")
    rows = marked(copied(rows, "E"), labels, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})
    return written(rows.select("part", *filters, "E", "good", "toxic"), "flags")


def op13(spark, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters by source."""
    return audit(document_flags(docs, labels), list("ABCDE"), ["good", "toxic"]).withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"})


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
OP13_SQL = rf"""
WITH texts AS (SELECT coalesce(source, '') AS part, coalesce(doc_id, {LAST_ID}) AS id, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t AS of, min(id) AS first FROM texts GROUP BY t),
marks AS (SELECT doc_id AS of, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len({_WORDS}) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct({_WORDS})) < 50 * len({_WORDS}) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN id > first THEN 'E' ELSE '' END AS fails
  FROM texts JOIN firsts ON t = firsts.of LEFT JOIN marks ON id = marks.of),
kinds AS (SELECT part, fails, count(*) AS n, sum(good::INT) AS good, sum(toxic::INT) AS toxic FROM flags GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, filter_order[1:step - 1] AS before, filter_order[step] AS f FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
met AS (SELECT *, translate(fails, before, '') = fails AS here, contains(fails, f) AS bad FROM kinds, steps),
counts AS (
  SELECT part, filter_order, step::INT AS step, f, coalesce(sum(n) FILTER (here AND NOT bad), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (here AND bad), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (bad AND NOT here), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = f), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (here AND bad), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (here AND bad), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counts
"""
