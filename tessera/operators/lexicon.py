"""Lexicons, unknown words and vocabularies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import signature

from .store import ranked, small, written

#: Words of a lexicon that are sent to all tasks, and their greatest length.
SENT, LONGEST = 200_000, 64


def lexicon(tokens: DataFrame, min_freq: int = 4) -> DataFrame:
    """word, freq of words seen min_freq times or more."""
    return tokens.groupBy("word").agg(F.count("*").alias("freq")).where(F.col("freq") >= min_freq)


def most_frequent(lex: DataFrame, n: int) -> DataFrame:
    return lex.orderBy(F.desc("freq"), "word").limit(n)


def clean(tokens: DataFrame, lex: DataFrame, suffixes: bool = True) -> DataFrame:
    """Tokens with words outside the lexicon replaced by their signatures; `known` tells which were inside."""
    got = tokens.join(lex.select(F.col("word").alias("of_word"), F.lit(True).alias("known")), F.col("word") == F.col("of_word"), "left")
    known = F.coalesce("known", F.lit(False))
    return got.select("doc_id", "sent_id", "pos", F.when(known, F.col("word")).otherwise(signature(F.col("word"), suffixes)).alias("word"), known.alias("known"))


def joined(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_id, tokens: words in order."""
    return tokens.groupBy("doc_id", "sent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("tokens"))


def flagged(df: DataFrame, known: Callable[[pa.Array, np.ndarray, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """Sentences with `known` beside their tokens: what `known` says of the tokens of a batch, given where its sentences start."""
    names = [c for c in df.columns if c != "unseen"]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            lists = b.column("tokens")
            starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flags = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(known(lists.flatten(), starts, b)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], flags], names=[*names, "known"])

    form = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names)
    return df.mapInArrow(run, f"{form}, known array<boolean>")


def clean_corpus(sents: DataFrame, tokens: DataFrame, min_freq: int = 4, suffixes: bool = True, lex: DataFrame | None = None) -> DataFrame:
    """Sentences with unknown words replaced."""
    return clean_sentences(sents, tokens, min_freq, suffixes, lex).drop("known")


def clean_sentences(sents: DataFrame, tokens: DataFrame, min_freq: int = 4, suffixes: bool = True, lex: DataFrame | None = None) -> DataFrame:
    """doc_id, sent_id, tokens with unknown words replaced, and known, whether each was in the lexicon.

    The SENT most frequent words of the lexicon are sent to all tasks, where sentences are looked up as they are. If the lexicon has more, the tokens of other
    words alone are dealt by word, and those that it lacks meet their sentences. Sentences that share their ids are one, as in joined().
    """
    lex = written(lexicon(tokens, min_freq), "lexicon") if lex is None else lex
    own = sents.select("doc_id", "sent_id", "tokens").where(F.size("tokens") > 0)
    if repeated(own):
        rows = clean(tokens, small(lex), suffixes).groupBy("doc_id", "sent_id").agg(F.sort_array(F.collect_list(F.struct("pos", "word", "known"))).alias("x"))
        return rows.select("doc_id", "sent_id", F.col("x.word").alias("tokens"), F.col("x.known").alias("known"))
    short = lex.where(F.length("word") <= LONGEST)
    top = (short.orderBy(F.desc("freq"), "word") if "freq" in lex.columns else short).limit(SENT)
    words = [r["word"] for r in top.select("word").collect()]
    sent = own.sparkSession.sparkContext.broadcast(words)
    got = flagged(own, lambda values, starts, b: pc.is_in(values, value_set=pa.array(sent.value, values.type)).to_numpy(zero_copy_only=False))
    if lex.count() > len(words):
        at = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: ~F.get("known", i))
        other = got.select("doc_id", "sent_id", F.explode(F.transform(at, lambda i: F.struct(i.alias("pos"), F.get("tokens", i).alias("word")))).alias("x"))
        none = other.select("doc_id", "sent_id", "x.*").join(lex.select(F.col("word").alias("of_word")), F.col("word") == F.col("of_word"), "left_anti")
        none = none.groupBy(F.col("doc_id").alias("d"), F.col("sent_id").alias("s")).agg(F.collect_list("pos").alias("unseen"))
        lines = own.select("doc_id", "sent_id", F.array_join("tokens", "\n").alias("line"))  # a text moves in fewer bytes than a list
        met = lines.join(none, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("sent_id").eqNullSafe(F.col("s")), "left")

        def known(values: pa.Array, starts: np.ndarray, b: pa.RecordBatch) -> np.ndarray:
            out, unseen = np.ones(len(values), bool), b.column("unseen")
            sizes = pc.fill_null(pc.list_value_length(unseen), 0).to_numpy(zero_copy_only=False)
            out[np.repeat(starts[:-1], sizes) + unseen.flatten().to_numpy(zero_copy_only=False)] = False
            return out

        got = flagged(met.select("doc_id", "sent_id", F.split("line", "\n").alias("tokens"), "unseen"), known)
    return got.select("doc_id", "sent_id", F.zip_with("tokens", "known", lambda w, k: F.when(k, w).otherwise(signature(w, suffixes))).alias("tokens"), "known")


def repeated(sents: DataFrame) -> bool:
    """Do sentences share their ids?"""
    return not sents.groupBy("doc_id", "sent_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def cleaned_counts(tokens: DataFrame, min_freq: int = 4, suffixes: bool = True) -> DataFrame:
    """word, n of the cleaned corpus, from the counts of its words: no token moves."""
    counts, word = tokens.groupBy("word").agg(F.count("*").alias("n")), F.col("word")
    return counts.groupBy(F.when(F.col("n") >= min_freq, word).otherwise(signature(word, suffixes)).alias("word")).agg(F.sum("n").alias("n"))


def numbered(sents: DataFrame, vocab: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, sent_id, words and the columns of `keep`: sentences (tokens, with ids of their own) as the ids of a vocabulary (word_id, word), which has each word once; others are -1.

    The SENT first words are sent to all tasks, where sentences are looked up as they are; only tokens of other words are dealt by word.
    """
    words = vocab.select("word_id", "word")
    top = words.where(F.length("word") <= LONGEST).orderBy("word_id").limit(SENT).collect()
    sent = sents.sparkSession.sparkContext.broadcast(([r["word"] for r in top], np.array([r["word_id"] for r in top], np.int32)))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            lists, (of, ids) = b.column("tokens"), sent.value
            starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            place = pc.index_in(lists.flatten(), value_set=pa.array(of, lists.type.value_type)).fill_null(-1).to_numpy(zero_copy_only=False)
            got = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(np.append(ids, np.int32(-1))[place], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("sent_id"), got, *[b.column(c) for c in keep]], names=["doc_id", "sent_id", "words", *keep])

    own = sents.select("doc_id", "sent_id", "tokens", *keep)
    rows = own.mapInArrow(run, "doc_id long, sent_id long, words array<int>" + "".join(f", {c} {sents.schema[c].dataType.simpleString()}" for c in keep))
    if words.count() <= len(top):
        return rows
    known = sents.sparkSession.createDataFrame([(r["word"],) for r in top], "known string")
    other = own.select("doc_id", "sent_id", F.posexplode("tokens").alias("pos", "word")).join(F.broadcast(known), F.col("word") == F.col("known"), "left_anti")
    other = other.join(words.select(F.col("word").alias("of"), F.col("word_id").cast("int").alias("id")), F.col("word") == F.col("of"))
    other = other.groupBy(F.col("doc_id").alias("d"), F.col("sent_id").alias("s")).agg(F.map_from_entries(F.collect_list(F.struct("pos", "id"))).alias("more"))
    met = rows.join(other, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("sent_id").eqNullSafe(F.col("s")), "left")
    return met.select("doc_id", "sent_id", F.when(F.col("more").isNull(), F.col("words")).otherwise(F.transform("words", lambda w, i: F.coalesce(F.when(w < 0, F.try_element_at("more", i)), w))).alias("words"), *keep)


def vocabulary(tokens: DataFrame, n_sentences: DataFrame) -> DataFrame:
    """word_id, word, cn: the sentence end first, then by falling count and rising word.

    Words are ranked by ranges of this order, so no task holds all of a count.
    """
    counts = tokens.groupBy("word").agg(F.count("*").alias("cn"))
    rows = ranked(counts, "vocabulary", F.desc("cn"), "word")
    end = n_sentences.select(F.lit(0).cast("long").alias("word_id"), F.lit("</s>").alias("word"), F.col("n").alias("cn"))
    return end.unionByName(rows.select(F.col("rank").cast("long").alias("word_id"), "word", "cn"))


def first_seen(tokens: DataFrame) -> DataFrame:
    """word_id, word: words numbered from 0 in the order in which they first occur."""
    first = tokens.groupBy("word").agg(F.min(F.struct("doc_id", "sent_id", "pos")).alias("at"))
    return ranked(first, "first", "at").select((F.col("rank") - 1).cast("long").alias("word_id"), "word")


def word_classes(vocab: DataFrame, classes: int, root: bool = False) -> DataFrame:
    """word_id, word, cn, class_index: equal shares of (the roots of) relative frequencies.

    The class rises by one a word at most: it is the least, over the words up to this one, of the class that word's
    share asks for plus the words since. Words of equal count share a sum, so cumulative shares
    need one row a count; the last step runs over those as well.
    """
    total = vocab.agg(F.sum("cn").alias("all_n"))
    share = F.sqrt(F.col("cn") / F.col("all_n")) if root else F.col("cn") / F.col("all_n")
    end = vocab.where("word_id = 0").select(F.col("cn").alias("end_n"))
    rows = vocab.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(end)).withColumn("p", share)  # one row each
    grp = F.when(F.col("word_id") == 0, F.lit(-1)).otherwise(F.col("cn"))
    per = rows.withColumn("g", grp).groupBy("g").agg(F.min("word_id").alias("first"), F.count("*").alias("n"), F.max("p").alias("p"))
    upto = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("mass", F.coalesce(F.sum(F.col("n") * F.col("p")).over(upto), F.lit(0.0)))
    whole = per.agg(F.sum(F.col("n") * F.col("p")).alias("whole"))
    per = per.crossJoin(F.broadcast(whole))
    step = F.col("p") / F.col("whole") * classes

    def asked(i):
        """The class that the i-th word (from 1) of a group asks for."""
        return F.least(F.ceil(F.col("mass") / F.col("whole") * classes + i * step - F.lit(1e-9)) - 1, F.lit(classes - 1))

    # within a group what is asked minus the word's number is least at one of its ends or, as steps are under 1 or over, everywhere equal
    least = F.least(asked(F.lit(1)) - F.col("first"), asked(F.col("n").cast("double")) - (F.col("first") + F.col("n") - 1))
    per = per.withColumn("before", F.coalesce(F.min(least).over(upto), F.lit(0)))
    got = rows.withColumn("g", grp).drop("p").join(per.withColumnRenamed("g", "of_g"), F.col("g") == F.col("of_g"))
    i = (F.col("word_id") - F.col("first") + 1).cast("double")
    inner = F.min(asked(i) - F.col("word_id")).over(Window.partitionBy("g").orderBy("word_id").rowsBetween(Window.unboundedPreceding, 0))
    return got.withColumn("class_index", F.greatest(F.lit(0), F.least(F.col("word_id"), F.least(inner, F.col("before")) + F.col("word_id"))).cast("long")).select("word_id", "word", "cn", "class_index")


def noise(vocab: DataFrame, power: float = 0.75, smooth: float = 0.0) -> DataFrame:
    """word, p: counts to a power, smoothed and normalised."""
    w = F.pow("cn", F.lit(power)) + F.lit(smooth)
    return vocab.withColumn("w", w).crossJoin(F.broadcast(vocab.agg(F.sum(w).alias("s")))).select("word", (F.col("w") / F.col("s")).alias("p"))
