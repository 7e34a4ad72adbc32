"""Steps of the corpus pipeline: each takes documents and an operator's decisions, and returns documents.

Rows are known by their id and a hash of their text, so rows that share an id are judged by their texts. A null id is keyed by a number that no
document has (-1; where the smallest id counts, the largest long, so that it comes last); a null text is judged as the empty text and stays null where it is kept.
Repeated rows share a decision; in one_of_each_group() one of them stays. Columns other than those of documents are dropped, whatever their names.
An empty table gives an empty table with the same columns. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, text_of, written
from .secret_scan import KINDS

#: Rows of a decision table that may be broadcast (two longs each, 32 MB at most); beyond it is joined by a shuffle.
MOST = 1_000_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MARK = "<SECRET>"
#: Characters of a text that are redacted together.
BLOCK = 4096


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST else df


def without(docs: DataFrame, rejected: DataFrame, *keys: str) -> DataFrame:
    """Documents whose keys are not among the rejected ones; rows with null keys stay."""
    gone = written(rejected.select(*[F.col(k).alias(f"of_{k}") for k in keys]).distinct(), "rejected")
    on = None
    for k in keys:
        same = F.col(k) == F.col(f"of_{k}")
        on = same if on is None else on & same
    return docs.join(_small(gone), on, "left_anti")


def speak_known_languages(docs: DataFrame) -> DataFrame:
    """Documents with an accepted language. Repeated ids are judged by their texts."""
    from .language_id import fit, identify_documents

    keyed = docs.withColumn("row", F.struct(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.xxhash64(text_of()).alias("h")))
    judged = identify_documents(keyed, fit(docs, "doc_id", "text", "lang"), "row")
    no = judged.where("NOT accepted").select(F.col("row.id").alias("id_"), F.col("row.h").alias("h_"))
    marked = docs.withColumn("id_", F.coalesce("doc_id", F.lit(-1))).withColumn("h_", F.xxhash64(text_of()))
    return without(marked, no, "id_", "h_").select(*COLUMNS)


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, then hash of the text; null ids come last."""
    from .near_duplicate import near_duplicates

    key = F.coalesce("doc_id", F.lit(LAST_ID))
    rows = near_duplicates(docs).groupBy("root", key.alias("id_"), F.col("text_hash").alias("h_")).agg(F.count("*").alias("n"))
    rows = written(rows, "classes")
    first = rows.groupBy("root").agg(F.min(F.struct("id_", "h_")).alias("first"), F.count("*").alias("members")).where("members > 1")
    first = written(first.select(F.col("root").alias("of"), "first"), "first")
    gone = rows.join(_small(first), F.col("root") == F.col("of")).where("id_ <> first.id_ OR h_ <> first.h_")
    marked = docs.withColumn("id_", key).withColumn("h_", F.xxhash64(text_of()))
    left = without(marked, gone, "id_", "h_")
    twice = written(rows.where("n > 1").select(F.col("id_").alias("of_id_"), F.col("h_").alias("of_h_")), "twice")
    if not twice.isEmpty():  # rows that are the same in id and text; only their texts move
        same = (F.col("id_") == F.col("of_id_")) & (F.col("h_") == F.col("of_h_"))
        left = left.join(_small(twice), same, "left_anti").unionByName(left.join(_small(twice), same, "left_semi").dropDuplicates(["id_", "h_"]))
    return left.select(*COLUMNS)


def free_of_benchmarks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents in which no benchmark item was found."""
    from .decontaminate import contamination

    keyed = docs.withColumn("row", F.struct(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.xxhash64(text_of()).alias("h")))
    found = contamination(keyed, benchmark, id_col="row").select(F.col("row.id").alias("id_"), F.col("row.h").alias("h_"))
    marked = docs.withColumn("id_", F.coalesce("doc_id", F.lit(-1))).withColumn("h_", F.xxhash64(text_of()))
    return without(marked, found, "id_", "h_").select(*COLUMNS)


def redacted(text, spans):
    """Text with each stretch that spans (sorted, those of secret_scan.scan()) cover replaced by one mark.

    The text is gone through in blocks of BLOCK characters. Each takes the spans that begin in it from a slice of the array, so the work grows with
    the text and the spans, not with their product. At most one span of a kind begins at a place, which bounds the slice.
    """
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    blocks = F.transform(blocks, lambda x, i: F.struct((i.cast("long") * BLOCK).alias("from"), x.alias("text")))

    def cut(block):
        def step(acc, x):
            begin = F.greatest(acc["at"], block["from"])
            kept = F.substr(block["text"], (begin - block["from"] + 1).cast("int"), (x["start"] - begin).cast("int"))
            out = F.when(x["start"] >= acc["at"], F.concat(acc["out"], kept, F.lit(MARK))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

        return step

    def pass_(acc, block):
        here = F.filter(F.slice(spans, acc["next"] + 1, F.lit(len(KINDS) * BLOCK)), lambda x: x["start"] < block["from"] + BLOCK)
        done = F.aggregate(here, F.struct(acc["at"].alias("at"), F.lit("").alias("out")), cut(block))
        tail = lambda d: F.concat(d["out"], F.substr(block["text"], F.greatest(d["at"] - block["from"] + 1, F.lit(1)).cast("int")))
        return F.aggregate(F.array(done), acc, lambda a, d: F.struct((a["next"] + F.size(here)).alias("next"), d["at"].alias("at"), F.concat(a["out"], F.array(tail(d))).alias("out")))

    none = F.struct(F.lit(0).alias("next"), F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    return F.array_join(F.aggregate(blocks, none, pass_)["out"], "")


def without_secrets(docs: DataFrame) -> DataFrame:
    """Documents with their secrets replaced by MARK; the others are unchanged."""
    from .secret_scan import scan

    keyed = docs.withColumn("row", F.struct(F.coalesce("doc_id", F.lit(-1)).alias("id"), F.xxhash64(text_of()).alias("h")))
    found = scan(keyed, "row", "text").where(F.size("found") > 0).select(F.col("row.id").alias("of_id"), F.col("row.h").alias("of_h"), "found").dropDuplicates(["of_id", "of_h"])
    found = written(found, "found")
    on = (F.coalesce(F.col("doc_id"), F.lit(-1)) == F.col("of_id")) & (F.xxhash64(text_of()) == F.col("of_h"))
    met = docs.join(_small(found), on, "left")
    text = F.when(F.col("found").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("found")))
    return met.withColumn("text", text).withColumn("n_chars", F.when(F.col("found").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def as_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and ids of each document."""
    import public_tokenizers as P

    from .bpe import encode

    return encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
