"""Scores of a stream of sentences under a fixed model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import tokenize
from tessera.operators.ngram import KneserNey, windows
from tessera.operators.scores import score_sentences


def score_stream(spark: SparkSession, folder: str, model: KneserNey, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that scores each line of new text files in `folder` and hands each batch's scores to `sink`.

    Stateless: a batch's lines are joined with the model's tables. The key of a line is its file and a
    hash of its text, so a batch that is run again gives the same rows. Equal lines of a file are scored once and
    give a row each.
    """
    lines = spark.readStream.text(folder).select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.xxhash64("value").alias("sent_id"), tokenize(F.col("value"), True).alias("tokens"))

    def batch(df: DataFrame, number: int) -> None:
        rows = df.where(F.size("tokens") > 0).groupBy("doc_id", "sent_id").agg(F.first("tokens").alias("tokens"), F.count("*").alias("times"))
        times = rows.select(F.col("doc_id").alias("d"), F.col("sent_id").alias("s"), F.sequence(F.lit(1).cast("long"), "times").alias("copies"))
        scored = score_sentences(model, windows(rows, model.order))
        each = scored.join(times, (F.col("doc_id") == F.col("d")) & (F.col("sent_id") == F.col("s")))
        sink(each.select("*", F.explode("copies")).select(*scored.columns), number)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
