"""Contiguous shards of nearly equal bytes, in DataFrame functions alone.

Rows are put in one order (by id, then text) and stored in it, in parts that are ranges of the order. The bytes and rows before each part are
prefix sums over the parts' totals, a row a part. The whole has `shards` equal targets; a row goes to the shard in which its middle byte
lies, so each cut is at the row border nearest to its target. A part whose bytes lie between two targets needs no look at its rows; only parts
with a target inside add up their own rows. What is sent to all tasks is a row a part and a row a shard, whatever the rows are.

A null text has no bytes, any row counts one more (its end mark). A null id comes after all others. Rows with one id are ordered by their texts;
equal rows are alike, so their order does not matter, and they are dealt to parts by their place in the input: a third of all rows may be equal.
Equal texts are rows like others, this law keeps no groups together. Texts of any length are whole rows, which may cover several targets; then some
shards are empty, as they are when there are fewer rows than shards. Columns of the input are kept in a struct, so their names clash with nothing.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

SHARDS = 8


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows in order, in the shared folder: doc (the row), size, part and at (its place in the part)."""
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), F.col(id_col).alias("id"),
        F.xxhash64(text_of(text_col)).alias("h"), F.col(text_col).isNull().alias("none"), (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.col("id").asc_nulls_last(), F.col("h").asc(), F.col("none").asc(), F.col("tie").asc()]
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc", "size", F.spark_partition_id().alias("part"), at.alias("at")), "ordered")


def shard_of(twice_middle: str, total: str, shards: int):
    """The target interval of a byte position, given twice; exact for any number of bytes."""
    return F.expr(f"CAST((CAST({twice_middle} AS DECIMAL(20,0)) * CAST({shards} AS DECIMAL(10,0))) div (2 * CAST({total} AS DECIMAL(20,0))) AS INT)")


def starts(rows: DataFrame, shards: int) -> DataFrame:
    """part, at, shard, row: the places where a part or a shard begins, and the number of rows before."""
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    parts = totals.select(
        "part", "bytes", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("r"),
        F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    parts = written(parts.withColumns({"low": shard_of("2 * b", "total", shards), "high": shard_of("2 * (b + bytes) - 1", "total", shards)}), "totals")
    whole = parts.where("low = high").select("part", F.lit(0).cast("long").alias("at"), F.col("low").alias("shard"), F.col("r").alias("row"))
    cut = F.broadcast(parts.where("low < high").select(F.col("part").alias("of"), "b", "r", "total"))
    within = Window.partitionBy("part").orderBy("at")
    inside = rows.select("part", "at", "size").join(cut, F.col("part") == F.col("of"))
    inside = inside.withColumn("b", F.col("b") + F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = inside.withColumn("shard", shard_of("2 * b + size", "total", shards))
    first = F.coalesce(F.lag("shard").over(within) != F.col("shard"), F.lit(True))
    inside = inside.withColumn("first", first).where("first").select("part", "at", "shard", (F.col("r") + F.col("at")).alias("row"))
    return written(whole.unionByName(inside), "starts")


def sharded(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc (the row), size, shard, and slot, the row's place in its shard; read from the stored order."""
    if shards < 1:
        raise ValueError("there has to be a shard")
    rows = stored(df, id_col, text_col)
    marks = starts(rows, shards)
    begin = marks.groupBy("shard").agg(F.min("row").alias("begin"))
    per = marks.join(F.broadcast(begin), "shard").groupBy(F.col("part").alias("of"))
    per = per.agg(F.sort_array(F.collect_list(F.struct("at", "shard", "row", "begin"))).alias("marks"))  # a mark a part and a shard
    last = F.element_at(F.filter("marks", lambda m: m["at"] <= F.col("at")), -1)
    got = rows.join(F.broadcast(per), F.col("part") == F.col("of")).withColumn("mark", last)
    return got.select("doc", "size", F.col("mark.shard").alias("shard"), (F.col("mark.row") + F.col("at") - F.col("mark.at") - F.col("mark.begin")).alias("slot"))


def write_shards(rows: DataFrame, path: str) -> None:
    """What sharded() returns as Parquet, a folder a shard; no row moves, a part lies in few shards."""
    rows.write.partitionBy("shard").parquet(path)


def op11(spark, docs: DataFrame) -> DataFrame:
    """The shard of each document; size and checksum are those of the stored texts."""
    text = F.col("doc.text")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    return sharded(docs.select("doc_id", "text"), SHARDS).select(
        F.col("doc.doc_id").alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def _crc_table() -> str:
    """The 256 remainders of CRC-32, eight hexadecimal digits each."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(f"{n:08x}")
    return "".join(out)


#: For tables in which no id comes twice, and none is null more than once.
OP11_SQL = rf"""
WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
sums AS (SELECT *, (octet_length(t) + 1)::BIGINT AS size, coalesce(sum(octet_length(t) + 1) OVER (ORDER BY doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(octet_length(t) + 1) OVER () AS total FROM texts),
dealt AS (SELECT *, ((2 * before + size) * {SHARDS} // (2 * total))::INT AS shard FROM sums)
SELECT doc_id, size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(t), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(c >> 8, ('0x' || substr('{_crc_table()}', ((xor(c, b) & 255) * 8 + 1)::INT, 8))::BIGINT)), 4294967295)::BIGINT AS text_crc32,
  'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST) - 1)::BIGINT AS slot, NULL::INT AS grown_shard
FROM dealt
"""
