"""Word streams of networks, vocabulary files, property files, and the writers of score files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import lexicon
from tessera.operators.store import written

#: Characters of a word that the two kinds of networks keep, and words of a sentence.
LONG_WORD, SHORT_WORD, LONGEST = 999, 99, 10_000


def word_stream(line: Column, longest: int = LONG_WORD) -> Column:
    """The words of a line between blanks and tabs, cut at `longest` characters, and </s>; carriage returns are no characters of a word."""
    words = F.filter(F.split(F.regexp_replace(line, "\r", ""), "[ \t]"), lambda w: w != "")
    return F.concat(F.transform(words, lambda w: F.substring(w, 1, longest)), F.array(F.lit("</s>")))


def word_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Lines with `words`, as the stream of short words has them: blank lines go."""
    return lines.withColumn("words", word_stream(F.col(line_col), SHORT_WORD)).where(F.size("words") > 1)


def sentence_ids(sents: DataFrame, vocab: DataFrame, convert: bool = False, reverse: bool = False, longest: int | None = LONGEST) -> DataFrame:
    """doc_id, sent_id, ids, oov: word ids between two 0s, the first `longest` - 2 words of a sentence, or all with None.

    A word outside the vocabulary (word_id, word) is -1 and sets `oov`; with `convert` it gets the id of <unk>.
    """
    zero = F.array(F.lit(0).cast("long"))
    words = F.reverse("tokens") if reverse else F.col("tokens")
    words = words if longest is None else F.slice(words, 1, longest - 2)
    vocab = written(vocab.select("word_id", "word"), "ids")
    if not lexicon.repeated(sents) and vocab.count() == vocab.select("word").distinct().count():
        unk = vocab.where("word = '<unk>'").agg(F.max("word_id").cast("long")).first()[0] if convert else None
        ids = lexicon.numbered(sents.where(F.size("tokens") > 0).select("doc_id", "sent_id", words.alias("tokens")), vocab)
        w = F.transform("words", lambda i: F.when(i < 0, -1 if unk is None else unk).otherwise(i).cast("long"))
        per = ids.select("doc_id", "sent_id", w.alias("w"))
        return per.select("doc_id", "sent_id", F.concat(zero, "w", zero).alias("ids"), F.array_contains("w", F.lit(-1).cast("long")).alias("oov"))
    rows = sents.select("doc_id", "sent_id", F.posexplode(words).alias("pos", "word"))
    ids = vocab.select(F.col("word").alias("of"), F.col("word_id").cast("long").alias("id"))
    got = rows.join(ids, F.col("word") == F.col("of"), "left")
    if convert:
        unk = vocab.where("word = '<unk>'").agg(F.max("word_id").cast("long").alias("unk"))
        got = got.crossJoin(F.broadcast(unk)).withColumn("id", F.coalesce("id", "unk"))  # one row
    got = got.withColumn("id", F.coalesce("id", F.lit(-1)))
    per = got.groupBy("doc_id", "sent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("w"))
    return per.select("doc_id", "sent_id", F.concat(zero, "w", zero).alias("ids"), F.array_contains("w", F.lit(-1).cast("long")).alias("oov"))


def vocabulary_lines(vocab: DataFrame) -> DataFrame:
    """word_id and `line`, `word count`, of a vocabulary."""
    return vocab.select("word_id", F.concat_ws(" ", "word", F.col("cn").cast("string")).alias("line"))


def read_vocabulary(lines: DataFrame, order_col: str) -> DataFrame:
    """word_id, word, cn of lines `word count`: the first line stays first, the others by falling count, equal ones in the order of the file."""
    from tessera.operators.store import ranked

    rows = lines.select(F.col(order_col).alias("at"), F.substring_index("line", " ", 1).alias("word"), F.substring_index("line", " ", -1).cast("long").alias("cn"))
    first = rows.agg(F.min("at").alias("first"))
    rows = rows.crossJoin(F.broadcast(first)).withColumn("rest", F.col("at") != F.col("first"))  # one row
    return ranked(rows, "vocabulary", "rest", F.desc("cn"), "at").select((F.col("rank") - 1).alias("word_id"), "word", "cn")


def external_probabilities(lines: DataFrame) -> DataFrame:
    """p: the first number of each line of another model's output; the rest of the line is not read."""
    return lines.withColumn("p", F.regexp_extract("line", r"^\s*(\S+)", 1).cast("double"))


def read_properties(lines: list[str]) -> dict[str, str]:
    """Settings of lines `key = value`: text after # or ! at a line's start is a comment, quotes around values go."""
    out = {}
    for line in lines:
        text = line.strip()
        if text and text[0] not in "#!" and "=" in text:
            key, value = (x.strip() for x in text.split("=", 1))
            out[key] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def is_tagged(line: Column, mark: str = "_@") -> Column:
    """Does a line's first token carry a tag?"""
    return F.coalesce(F.contains(F.regexp_extract(line, r"^[ \t]*([^ \t\n]+)", 1), F.lit(mark)), F.lit(False))


def is_xml(line: Column) -> Column:
    """Does a text begin as markup does?"""
    return F.coalesce(F.regexp_like(line, F.lit(r"^[ \t\n\r]*<[A-Za-z!?]")), F.lit(False))


def smoothing(tagged: bool, xml: bool) -> str:
    """The model that suits a corpus."""
    return "tag" if tagged else "none" if xml else "kneser-ney"


def nbest_lines(line: Column, utterance: str = "1") -> Column:
    """Lines with the number of their utterance in front."""
    return F.concat(F.lit(f"{utterance} "), line)


def write_scores(scores: DataFrame, path: str, metrics: list[str], sentences: DataFrame | None = None) -> None:
    """CSV files with a header: id, ppl, sent_length, the scores, and with `sentences` (doc_id, sent_id, line) the sentence. The id numbers the sentences in order."""
    from tessera.operators.store import ranked

    cols = ["ppl", "sent_length", *metrics]
    if sentences is not None:
        text = sentences.select(F.col("doc_id").alias("d"), F.col("sent_id").alias("s"), F.col("line").alias("sentence"))
        scores = scores.join(text, (F.col("doc_id") == F.col("d")) & (F.col("sent_id") == F.col("s"))).drop("d", "s")
        cols.append("sentence")
    got = ranked(scores, "scores", "doc_id", "sent_id")
    got.select((F.col("rank") - 1).alias("id"), *cols).write.mode("overwrite").option("header", True).csv(path)


def write_correlations(correlations: DataFrame, path: str) -> None:
    """One file of lines METRICS and CORRELATION between a tab; a row a metric."""
    rows = correlations.select(F.upper("metric").alias("METRICS"), F.col("correlation").alias("CORRELATION"))
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def sample_vectors(df: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """Samples of a group as the vectors of two typesetters, and their mean: matlab `[a b c]`, latex `(a,b)(a,b)` of number and value."""
    rows = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("x"), F.avg(value).alias("mean"))
    text = F.transform("x", lambda x: x["v"].cast("string"))
    pairs = F.transform("x", lambda x, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(","), x["v"].cast("string"), F.lit(")")))
    return rows.select(*by, F.concat(F.lit("["), F.array_join(text, " "), F.lit("]")).alias("matlab"), F.array_join(pairs, "").alias("latex"), "mean")


def read_first_column(blocks: DataFrame, key: str, block: str) -> DataFrame:
    """key, sent, words: the first column of tagged text blocks, a row a sentence."""
    from .corpus import read_conll

    rows = read_conll(blocks, key, block)
    return rows.groupBy(key, "sent").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words"))


def same_lines(a: Column, b: Column) -> Column:
    """Are two lists of lines the same, as far as the shorter one goes?"""
    n = F.least(F.size(a), F.size(b))
    return F.when(n == 0, True).otherwise(F.slice(a, 1, n) == F.slice(b, 1, n))


def interleaved(a: Column, b: Column) -> Column:
    """The items of two lists in turns; the rest of the longer one follows."""
    return F.filter(F.flatten(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: F.array(x["a"], x["b"]))), lambda x: x.isNotNull())


def sentence_name(name: Column) -> tuple[Column, Column]:
    """File (the first three characters) and number (from the fifth on) of a sentence's name."""
    return F.substring(name, 1, 3), F.substring(name, 5, 1 << 20).cast("long")


def place_in(value: Column, fixed: list[str], full: str = "full") -> Column:
    """The place of a value in a fixed list, from 0; `full` comes after all, others are null."""
    at = F.array_position(F.array(*map(F.lit, fixed)), value)
    return F.when(value == full, F.lit(len(fixed)).cast("long")).when(at > 0, at - 1)
