"""Corpora as tables of sentences and tokens, and the column formats they are read from and written to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokenize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8", recursive: bool = False) -> DataFrame:
    """file, line of text files; compressed files and folders of files too."""
    reader = spark.read.option("encoding", encoding).option("recursiveFileLookup", str(recursive).lower())
    return reader.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))


def spread(df: DataFrame) -> DataFrame:
    """A scan of few splits dealt to all tasks before its rows multiply."""
    sc = df.sparkSession.sparkContext
    return df.repartition(sc.defaultParallelism) if df.rdd.getNumPartitions() < sc.defaultParallelism // 2 else df


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lower: bool = True) -> DataFrame:
    """doc_id, sent_id, line, tokens: the lines of texts that have words; sent_id is the line's number in its text."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("sent_id", "line"))
    return lines.select("doc_id", F.col("sent_id").cast("long").alias("sent_id"), "line", tokenize(F.col("line"), lower).alias("tokens")).where(F.size("tokens") > 0)


def tokens(sents: DataFrame) -> DataFrame:
    """doc_id, sent_id, pos, word."""
    return sents.select("doc_id", "sent_id", F.posexplode("tokens").alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))


def conll_block(rows: Column) -> Column:
    """Sentences (arrays of word-tag structs) as text: a line `word<TAB>tag` each token, an empty line after each sentence."""
    return F.array_join(F.transform(rows, lambda s: F.concat(F.array_join(F.transform(s, lambda t: F.concat(t["word"], F.lit("\t"), t["tag"])), "\n"), F.lit("\n"))), "\n")


def read_conll(blocks: DataFrame, key: str, block: str) -> DataFrame:
    """key, sent, pos, word, tag of text blocks; sentences are runs of lines between blank ones, numbered from 0."""
    lines = blocks.select(key, F.posexplode(F.split(F.col(block), "\n")).alias("i", "line")).withColumn("blank", F.trim("line") == "")
    before = Window.partitionBy(key).orderBy("i")
    starts = lines.withColumn("new", ~F.col("blank") & F.coalesce(F.lag("blank").over(before), F.lit(True)))
    numbered = starts.withColumn("sent", F.sum(F.col("new").cast("long")).over(before.rowsBetween(Window.unboundedPreceding, 0)) - 1).where("NOT blank")
    parts = F.split("line", "\t")
    pos = F.row_number().over(Window.partitionBy(key, "sent").orderBy("i")).cast("long") - 1
    return numbered.select(key, "sent", pos.alias("pos"), parts[0].alias("word"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("tag"))


def document_numbers(lines: DataFrame, file_col: str, order: list[str], line_col: str, mark: str = "<PAGEBOUNDARY>") -> DataFrame:
    """Adds doc, counted up by boundary lines of each file; the boundary lines go."""
    from tessera.operators.store import written

    # ranges of a file's lines are counted by themselves and start where the ones before end, so a large file is not one task's
    cut = lines.repartitionByRange(file_col, *order).withColumns({"_part": F.spark_partition_id(), "_flag": (F.trim(line_col) == mark).cast("long")})
    rows = written(cut, "lines")
    sums = rows.groupBy(F.col(file_col).alias("_file"), F.col("_part").alias("_of")).agg(F.sum("_flag").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("_file", "_of", before.alias("_before"))  # a row a file and range
    own = F.sum("_flag").over(Window.partitionBy(file_col, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    got = rows.withColumn("_own", own).join(sums, F.col(file_col).eqNullSafe(F.col("_file")) & (F.col("_part") == F.col("_of")))
    return got.withColumn("doc", F.col("_own") + F.col("_before")).where(F.trim(line_col) != mark).select(*lines.columns, "doc")


def characters(line: Column) -> Column:
    """Each character as a token, white space as <sp>, and the end of the sentence."""
    each = F.transform(F.filter(F.split(F.concat(line, F.lit("\n")), ""), lambda c: c != ""), lambda c: F.when(c.rlike("[ \\t\\n\\r]"), "<sp>").otherwise(c))
    return F.concat(each, F.array(F.lit("</s>")))


def write_normal(sents: DataFrame, path: str) -> None:
    """One sentence a line."""
    sents.select(F.array_join("tokens", " ")).write.mode("overwrite").text(path)


def write_conll(sents: DataFrame, path: str, by_document: bool = False) -> None:
    """One token a line and an empty line after each sentence; with by_document a folder for each document."""
    out = sents.select(F.lpad(F.col("doc_id").cast("string"), 15, "0").alias("doc"), F.concat(F.array_join("tokens", "\n"), F.lit("\n")).alias("value"))
    if by_document:
        out.repartition("doc").write.mode("overwrite").partitionBy("doc").text(path)
    else:
        out.select("value").write.mode("overwrite").text(path)


def read_counts(lines: DataFrame, order_col: str) -> DataFrame:
    """order, ngram, c of a file of n-gram counts whose sections are closed by a line of five stars."""
    order = F.sum((F.col("line") == "*****").cast("int")).over(Window.partitionBy("file").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)) + 1
    parts = F.split("line", " ")
    return lines.withColumn("order", order).where("line <> '*****'").select("order", F.slice(parts, 1, F.size(parts) - 1).alias("ngram"), F.element_at(parts, -1).cast("long").alias("c"))


def read_arpa_unigrams(lines: DataFrame, order_col: str) -> DataFrame:
    """word, logprob of the unigram section of an ARPA file."""
    w = Window.partitionBy("file").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    section = F.sum(F.when(F.col("line") == "\\1-grams:", 1).when(F.col("line").rlike("^\\\\[2-9]-grams:"), 1).otherwise(0)).over(w)
    parts = F.split("line", "\t")
    return lines.withColumn("section", section).where("section = 1 AND line LIKE '%\t%'").select(parts[1].alias("word"), parts[0].cast("double").alias("logprob"))


def read_word_scores(lines: DataFrame) -> DataFrame:
    """logprob, n, unigram, word_scores of lines `logprob n unigram w1,w2,...`."""
    parts = F.split("line", " ")
    return lines.select(parts[0].cast("double").alias("logprob"), parts[1].cast("int").alias("n"), parts[2].cast("double").alias("unigram"), F.transform(F.split(parts[3], ","), lambda x: x.cast("double")).alias("word_scores"))


def unpivot_scores(df: DataFrame, id_cols: list[str]) -> DataFrame:
    """id columns, metric, score of a table of scores; missing ones are 0."""
    metrics = [c for c in df.columns if c not in id_cols]
    return df.unpivot(id_cols, metrics, "metric", "score").withColumn("score", F.coalesce(F.col("score").cast("double"), F.lit(0.0)))


def read_pos_dictionary(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tag_id, tag) of header lines `id:tag`, and (word, states) of lines `word id id ...`."""
    head = F.col("line").rlike("^[0-9]+:[^ ]+$")
    tags = lines.where(head).select(F.substring_index("line", ":", 1).cast("int").alias("tag_id"), F.expr("substring(line, instr(line, ':') + 1)").alias("tag"))
    parts = F.split("line", " ")
    words = lines.where(~head & (F.trim("line") != "")).select(parts[0].alias("word"), F.transform(F.slice(parts, 2, F.size(parts)), lambda x: x.cast("int")).alias("states"))
    return tags, words


def read_debug_log(lines: DataFrame) -> DataFrame:
    """word, p of lines `p( word | ...) = [...] p [ log ]` of a language model's debug log."""
    got = lines.select(F.regexp_extract("line", r"^\s*p\( (\S+) \|", 1).alias("word"), F.regexp_extract("line", r"= (?:\[\S+\] )?(\S+) \[", 1).alias("p"))
    return got.where("word <> ''").select("word", F.col("p").cast("double").alias("p"))


def read_evaluations(lines: DataFrame) -> DataFrame:
    """file, corpus, model, scores: the first line of numbers of each file; names are parts between dots."""
    rows = lines.where(F.col("line").rlike(r"^([0-9][.][0-9]+\s*)+$")).groupBy("file").agg(F.first("line").alias("line"))
    name = F.split(F.element_at(F.split("file", "/"), -1), "[.]")
    return rows.select("file", name[0].alias("corpus"), F.get(name, F.size(name) - 3).alias("model"), F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double")).alias("scores"))


def read_annotated(lines: DataFrame) -> DataFrame:
    """word and the columns N, F, R, GF, GR of annotated output lines."""
    parts = F.split("line", r"\s+")
    field = lambda k: F.regexp_extract("line", rf"(?:^|\s){k}:(\S+)", 1)
    return lines.where(F.trim("line") != "").select(parts[0].alias("word"), field("N").cast("int").alias("state"), field("F").alias("one_to_one"), field("R").alias("many_to_one"), field("GF").alias("gold"), field("GR").alias("gold_reduced"))
