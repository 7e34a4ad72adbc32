"""Tables in the folder that all executors share, and numbers over a whole order."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a table of short values that may be broadcast; beyond it is joined by a shuffle.
MOST = 200_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only in local mode, where none is set, a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: lineage is cut and lost executors cost nothing."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._tessera_path = path
    return again


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, most: int = MOST) -> DataFrame:
    """A written table, marked to be broadcast if it has `most` rows or fewer."""
    return F.broadcast(df) if df.count() <= most else df


def ranked(df: DataFrame, name: str, *order) -> DataFrame:
    """Adds `rank`, from 1, in an order of all rows: ranges of the order are sorted by themselves and start where the ones before end.

    `order` has to tell all rows apart.
    """
    part, at = F.spark_partition_id(), F.monotonically_increasing_id()
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": part, "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}), name)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("_part").alias("_of"), before.alias("_start"))
    return rows.join(F.broadcast(starts), F.col("_part") == F.col("_of")).withColumn("rank", F.col("_start") + F.col("_at") + 1).drop("_part", "_at", "_of", "_n", "_start")
