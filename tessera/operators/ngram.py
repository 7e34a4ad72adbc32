"""N-gram counts and the models made of them: Laplace, Kneser-Ney and its variants, back-off.

Models are tables. Kneser-Ney counts come in closed form: top-order counts, below it the
number of different words to the left, all by chains of grouped counts that are
combined before they are shuffled. Between steps an n-gram is its key, the words with SEP between
them, which takes a fraction of a list's bytes; so no word may hold SEP, and those of lines don't. Each order is written once.
Lists that are never empty are exploded as outer ones: else Spark filters by their size first, and works out the whole padded sentence again for each of its words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import MOST, small, written

START, END = "<s>", "</s>"
DISCOUNT = 0.7
SEP = "\n"


def key_of(ngram: Column) -> Column:
    return F.array_join(ngram, SEP)


def ngram_of(key: Column | str) -> Column:
    return F.split(key, SEP)


def first(key: Column | str, d: int) -> Column:
    """The first d words of a key."""
    return F.substring_index(key, SEP, d)


def last(key: Column | str, d: int) -> Column:
    """The last d words of a key."""
    return F.substring_index(key, SEP, -d)


def padded(tokens: Column, n: int, left: str = START, right: str = END, closing: int = 1) -> Column:
    parts = [F.array_repeat(F.lit(left), n - 1)] if n > 1 else []
    return F.concat(*parts, tokens, F.array_repeat(F.lit(right), closing))


def windows(sents: DataFrame, n: int, start: str = START) -> DataFrame:
    """doc_id, sent_id, pos, ngram: the n words up to each predicted position; `known`, if sentences have it beside their tokens, is the last word's, and true of the end."""
    flag = "known" in sents.columns
    wide = sents.select("doc_id", "sent_id", padded(F.col("tokens"), n, start).alias("t"), *["known"] * flag)
    own = lambda i: [F.coalesce(F.get("known", i - n), F.lit(True)).alias("known")] * flag
    each = F.transform(F.sequence(F.lit(n), F.size("t")), lambda i: F.struct(F.slice("t", i - n + 1, n).alias("ngram"), *own(i)))
    return wide.select("doc_id", "sent_id", F.posexplode_outer(each).alias("pos", "x")).where("pos IS NOT NULL").select("doc_id", "sent_id", F.col("pos").cast("long").alias("pos"), "x.*")


def counts(sents: DataFrame, n: int, cutoff: int = 0) -> DataFrame:
    """order, ngram, c of all orders up to n, pads included; top-order n-grams seen cutoff times or less go.

    Only what ends at each word is counted in the text, as long as it can be; an order's counts are the sums of those of the order above.
    """
    wide = sents.select(padded(F.col("tokens"), n).alias("t"))
    ends = F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: F.struct(F.least(i, F.lit(n)).cast("long").alias("order"), key_of(F.slice("t", F.greatest(i - n + 1, F.lit(1)), F.least(i, F.lit(n)))).alias("key")))
    ended = written(wide.select(F.explode_outer(ends).alias("x")).where("x IS NOT NULL").groupBy("x.order", "x.key").agg(F.count("*").alias("c")), f"counts{n}")
    level, out = ended.where(F.col("order") == n).select("key", "c"), None
    for d in range(n, 0, -1):
        if d < n:
            level = level.select(last("key", d).alias("key"), "c").unionByName(ended.where(F.col("order") == d).select("key", "c"))
            level = written(level.groupBy("key").agg(F.sum("c").alias("c")), f"counts{d}")
        part = level.select(F.lit(d).cast("long").alias("order"), ngram_of("key").alias("ngram"), "c").where(F.col("c") > (cutoff if d == n else 0))
        out = part if out is None else out.unionByName(part)
    return out


def totals(cnt: DataFrame) -> DataFrame:
    """tokens (with pads) and vocab: the sum and number of unigrams."""
    return cnt.where("order = 1").agg(F.sum("c").alias("tokens"), F.count("*").alias("vocab"))


class KneserNey:
    """Tables of an interpolated Kneser-Ney model with one discount.

    num: order, ngram, c; ctx: order, ctx, den, nz; meta: the unigram denominator, one row.
    """

    def __init__(self, order: int, num: DataFrame, ctx: DataFrame, meta: DataFrame, discount: float = DISCOUNT):
        self.order, self.num, self.ctx, self.meta, self.discount = order, num, ctx, meta, discount
        self.by_order: dict[int, DataFrame] = {}  # written counts (key, c), if there are
        self.source: DataFrame | None = None  # the windows it was made of

    def save(self, path: str) -> None:
        self.num.write.mode("overwrite").partitionBy("order").parquet(f"{path}/num")
        self.ctx.write.mode("overwrite").partitionBy("order").parquet(f"{path}/ctx")
        self.meta.select("unigram_denominator", F.lit(self.order).alias("n"), F.lit(self.discount).alias("discount")).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, spark, path: str, only: DataFrame | None = None) -> KneserNey:
        """A saved model; with `only` (ngram), no n-grams but those."""
        meta = spark.read.parquet(f"{path}/meta")
        head = meta.first()
        num, ctx = (spark.read.parquet(f"{path}/{x}").withColumn("order", F.col("order").cast("long")) for x in ("num", "ctx"))
        if only is not None:  # and no contexts but theirs
            num = selected(num, only)
            ctx = ctx.join(only.select(F.slice("ngram", 1, F.size("ngram") - 1).alias("ctx")).distinct(), "ctx", "left_semi").select(*ctx.columns)
        return cls(head["n"], num, ctx, meta.select("unigram_denominator"), head["discount"])


def all_orders(wins: DataFrame, n: int) -> DataFrame:
    """ngram: what scores of windows of n tokens look up in a model, the ends of each window at all orders and, for their contexts, the words before."""
    ends = F.array(*[F.slice("ngram", n - d + 1, d) for d in range(1, n + 1)])
    return wins.select(F.explode(ends).alias("ngram")).distinct()


def selected(num: DataFrame, only: DataFrame) -> DataFrame:
    """N-grams of a model that also occur in `only`."""
    return num.join(only.select("ngram").distinct(), "ngram", "left_semi")


def kneser_ney(wins: DataFrame, n: int, discount: float = DISCOUNT) -> KneserNey:
    """A model of windows of n tokens (column ngram). Each order's counts are written, made from those of the order above; what uses the model counts nothing again."""
    level = written(wins.select(key_of(F.col("ngram")).alias("key")).groupBy("key").agg(F.count("*").alias("c")), f"num{n}")
    tables = {n: level}
    for d in range(n - 1, 0, -1):
        level = tables[d] = written(level.select(last("key", d).alias("key")).groupBy("key").agg(F.count("*").alias("c")), f"num{d}")
    num = reduce(DataFrame.unionByName, [t.select(F.lit(d).cast("long").alias("order"), ngram_of("key").alias("ngram"), "c") for d, t in tables.items()])
    parts = [contexts(t, d).select(F.lit(d).cast("long").alias("order"), ngram_of("ctx").alias("ctx"), "den", "nz") for d, t in tables.items() if d > 1]
    empty = num.where("false").select("order", F.col("ngram").alias("ctx"), F.col("c").alias("den"), F.col("c").alias("nz"))
    meta = level.agg(F.sum("c").alias("unigram_denominator"))
    out = KneserNey(n, num, reduce(DataFrame.unionByName, parts) if parts else empty, meta, discount)
    out.by_order, out.source = tables, wins
    return out


def unigram_denominator(wins: DataFrame, n: int) -> DataFrame:
    """The meta table of kneser_ney() alone: a word's count at order one is its number of different left neighbours, so their sum is the number of different pairs."""
    rows = wins.select(key_of(F.slice("ngram", n - 1, 2)).alias("key")).distinct() if n > 1 else wins
    return rows.agg(F.sum(F.lit(1).cast("long")).alias("unigram_denominator"))


def contexts(counts_of: DataFrame, d: int) -> DataFrame:
    """ctx (a key), den, nz of the counts (key, c) of order d."""
    return counts_of.groupBy(first("key", d - 1).alias("ctx")).agg(F.sum("c").alias("den"), F.count("*").alias("nz"))


def stingy(wins: DataFrame, words: DataFrame) -> DataFrame:
    """Windows whose last word is among the test words or an end of sentence."""
    allowed = words.select(F.col("word").alias("of_word")).union(words.sparkSession.createDataFrame([(START,), (END,)], "of_word string")).distinct()
    return wins.join(allowed, F.element_at("ngram", -1) == F.col("of_word"), "left_semi")


def met(table: DataFrame, rows: DataFrame, of: Column, key: str) -> DataFrame:
    """Rows of a model's table that `rows` ask for with `of`: if those are few, they are sent to the table, which stays where it is."""
    asked = rows.select(of.alias("_of")).distinct()
    return table.join(F.broadcast(asked), F.col(key) == F.col("_of"), "left_semi")


def looked_up(model: KneserNey, wins: DataFrame) -> DataFrame:
    """ngram of each different window, and what interpolated() needs: num, den and nz of each order, unigram_denominator."""
    n = model.order
    rows = written(wins.select(key_of(F.col("ngram")).alias("key")).distinct(), "asked")
    asked, few = rows, rows.count() <= MOST
    for d in range(1, n + 1):
        num = model.by_order[d] if d in model.by_order else model.num.where(F.col("order") == d).select(key_of(F.col("ngram")).alias("key"), "c")
        num = num.select(F.col("key").alias("g"), F.col("c").alias(f"num{d}"))
        num = met(num, asked, last("key", d), "g") if few else small(num) if d == 1 and model.by_order else num  # words are few, and frequent ones would meet in one task
        rows = rows.join(num, last("key", d) == F.col("g"), "left").drop("g")
        if d > 1:
            of = first(last("key", d), d - 1)
            if model.by_order:
                level = model.by_order[d]
                if few:  # before they are summed
                    level = level.join(F.broadcast(asked.select(of.alias("_of")).distinct()), first("key", d - 1) == F.col("_of"), "left_semi")
                ctx = contexts(level, d)
            else:
                ctx = model.ctx.where(F.col("order") == d).select(key_of(F.col("ctx")).alias("ctx"), "den", "nz")
                ctx = met(ctx, asked, of, "ctx") if few else ctx
            ctx = ctx.select(F.col("ctx").alias("x"), F.col("den").alias(f"den{d}"), F.col("nz").alias(f"nz{d}"))
            ctx = small(written(ctx, "contexts")) if d == 2 and model.by_order and not few else ctx
            rows = rows.join(ctx, of == F.col("x"), "left").drop("x")
    rows = rows.crossJoin(F.broadcast(model.meta.select("unigram_denominator")))  # one row
    return rows.select(ngram_of("key").alias("ngram"), *[c for c in rows.columns if c != "key"])


def interpolated(n: int, D: Column) -> tuple[Column, Column]:
    """p and p1 of rows of looked_up() at a discount."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    p = p1 = zero("num1") / F.col("unigram_denominator")
    alive = F.lit(True)
    for d in range(2, n + 1):
        alive = alive & (zero(f"den{d}") > 0)
        own = F.when(zero(f"num{d}") > 0, (zero(f"num{d}") - D) / zero(f"den{d}")).otherwise(0.0)
        p = F.when(alive, own + zero(f"nz{d}") * D / zero(f"den{d}") * p).otherwise(p)
    return p, p1


def own_probabilities(model: KneserNey) -> DataFrame:
    """key, p, p1 of the n-grams that the model was made of: an order's come from those of the order below, of which there are fewer, so a table meets its contexts and its ends alone."""
    D = F.lit(model.discount)
    whole = F.broadcast(model.meta.select("unigram_denominator"))  # one row
    share = F.col("c").cast("double") / F.col("unigram_denominator")
    rows = model.by_order[1].crossJoin(whole).select("key", share.alias("p"), share.alias("p1"))
    for d in range(2, model.order + 1):
        level, low = model.by_order[d], rows.select(F.col("key").alias("g"), F.col("p").alias("low"), "p1")
        if d == 2:  # words are few, and frequent ones would meet in one task
            low, ctx = small(written(low, "words")), small(written(contexts(level, d), "contexts"))
            level = level.join(ctx, first("key", d - 1) == F.col("ctx"))
        else:
            same = Window.partitionBy(first("key", d - 1))
            level = level.withColumns({"den": F.sum("c").over(same), "nz": F.count("*").over(same)})
        den, nz = F.col("den").cast("double"), F.col("nz").cast("double")
        p = (F.col("c").cast("double") - D) / den + nz * D / den * F.col("low")
        rows = level.join(low, last("key", d - 1) == F.col("g")).select("key", p.alias("p"), "p1")
        rows = written(rows, f"p{d}") if d < model.order else rows
    return rows


def keyed_probabilities(model: KneserNey, wins: DataFrame) -> DataFrame:
    """probabilities() by key."""
    if model.source is wins:
        return own_probabilities(model)
    p, p1 = interpolated(model.order, F.lit(model.discount))
    return looked_up(model, wins).select(key_of(F.col("ngram")).alias("key"), p.alias("p"), p1.alias("p1"))


def probabilities(model: KneserNey, wins: DataFrame) -> DataFrame:
    """ngram, p, p1 of each different window: probability at the model's order and as a unigram.

    A context that was never seen leaves the lower order's value.
    """
    return keyed_probabilities(model, wins).select(ngram_of("key").alias("ngram"), "p", "p1")


def laplace(cnt: DataFrame, n: int) -> DataFrame:
    """ngram, p of seen n-grams: one is added to each count."""
    t = F.broadcast(totals(cnt))  # one row
    top = cnt.where(F.col("order") == n).crossJoin(t)
    if n == 1:
        return top.select("ngram", ((F.col("c") + 1) / (F.col("tokens") + F.col("vocab"))).alias("p"))
    top = top.select(key_of(F.col("ngram")).alias("key"), "c", "vocab")
    low = cnt.where(F.col("order") == n - 1).select(key_of(F.col("ngram")).alias("prefix"), F.col("c").alias("cp"))
    got = top.join(low, first("key", n - 1) == F.col("prefix"), "left")
    return got.select(ngram_of("key").alias("ngram"), ((F.col("c") + 1) / (F.coalesce("cp", F.lit(0)) + F.col("vocab"))).alias("p"))


def back_off(cnt: DataFrame, wins: DataFrame, n: int) -> DataFrame:
    """ngram, p: the count over its prefix's at the longest order that was seen. Windows that have their value leave; only the others meet the next order."""
    left, out = wins.select(key_of(F.col("ngram")).alias("key")).distinct(), None
    for d in range(n, 1, -1):
        c, low = (cnt.where(F.col("order") == k).select(key_of(F.col("ngram")).alias(f"g{k}"), F.col("c").alias(f"c{k}")) for k in (d, d - 1))
        got = left.join(c, last("key", d) == F.col(f"g{d}"), "left").join(low, first(last("key", d), d - 1) == F.col(f"g{d - 1}"), "left")
        got = written(got.select("key", (F.col(f"c{d}") / F.col(f"c{d - 1}")).alias("p")), "backed")
        done, left = got.where("p IS NOT NULL"), got.where("p IS NULL").select("key")
        out = done if out is None else out.unionByName(done)
        if left.isEmpty():
            return out.select(ngram_of("key").alias("ngram"), "p")
    words = cnt.where("order = 1").select(F.col("ngram")[0].alias("g"), "c")
    one = left.join(words, last("key", 1) == F.col("g"), "left").crossJoin(F.broadcast(totals(cnt)))  # one row
    one = one.select("key", F.coalesce(F.col("c") / F.col("tokens"), F.lit(0.0)).alias("p"))
    return (one if out is None else out.unionByName(one)).select(ngram_of("key").alias("ngram"), "p")


def tag_probabilities(model: KneserNey, tagged: DataFrame, word_freq: DataFrame, tag_freq: DataFrame) -> DataFrame:
    """word, ngram (of tags), p: (count of the word + 1) / count of its tag, times the tags' probability. Tags and their windows are few, and tasks of their keys would be uneven: they are sent."""
    pairs = written(tagged.select("word", "tag", key_of(F.col("ngram")).alias("key")).distinct(), "pairs").withColumn("ngram", ngram_of("key"))
    p = small(written(probabilities(model, pairs).select(F.col("ngram").alias("of_ngram"), F.col("p").alias("tag_p")), "tag_p"))
    rows = pairs.join(p, F.col("ngram") == F.col("of_ngram"))
    rows = rows.join(small(written(word_freq.select(F.col("word").alias("w"), F.col("freq").alias("cw")), "word_freq")), F.col("word") == F.col("w"), "left")
    rows = rows.join(small(written(tag_freq.select(F.col("tag").alias("t"), F.col("freq").alias("ct")), "tag_freq")), F.col("tag") == F.col("t"), "left")
    return rows.select("word", "ngram", ((F.coalesce("cw", F.lit(0)) + 1) / F.col("ct") * F.col("tag_p")).alias("p"))


def tagged_windows(sents: DataFrame, n: int) -> DataFrame:
    """doc_id, sent_id, word, tag, ngram: each word of sentences (words, and their tags as tokens) with the n tags up to its own."""
    wide = sents.select("doc_id", "sent_id", "words", padded(F.col("tokens"), n).alias("t"))
    each = F.transform("words", lambda w, i: F.struct(w.alias("word"), F.get("t", i + n - 1).alias("tag"), F.slice("t", i + 1, n).alias("ngram")))
    return wide.select("doc_id", "sent_id", F.explode_outer(each).alias("x")).where("x IS NOT NULL").select("doc_id", "sent_id", "x.*")


def two_sided(sents: DataFrame, d: int) -> DataFrame:
    """ngram: the word at a position, then its d-1 neighbours on either side, in order: (pivot, left..., right...)."""
    t = sents.select(F.concat(F.array_repeat(F.lit(START), d - 1), F.col("tokens"), F.array_repeat(F.lit(END), d - 1)).alias("t"))
    each = F.transform(F.sequence(F.lit(d), F.size("t") - d + 1), lambda i: F.struct(F.concat(F.slice("t", i - d + 1, d - 1), F.slice("t", i + 1, d - 1)).alias("ctx"), F.element_at("t", i).alias("pivot")))
    return t.select(F.explode_outer(each).alias("x")).where("x IS NOT NULL").select("x.ctx", "x.pivot")


def two_sided_probabilities(pairs: DataFrame, discount: float = DISCOUNT) -> DataFrame:
    """ctx, pivot, p of pairs that occur (columns ctx, pivot): the discounted share in the context, and the rest by the pivot's own share."""
    c = pairs.groupBy("ctx", "pivot").agg(F.count("*").alias("n"))
    per = c.groupBy(F.col("ctx").alias("of_ctx")).agg(F.sum("n").alias("den"), F.count("*").alias("nz"))
    own = c.groupBy(F.col("pivot").alias("of_pivot")).agg(F.sum("n").alias("own"))
    whole = c.agg(F.sum("n").alias("whole"))
    rows = c.join(per, F.col("ctx") == F.col("of_ctx")).join(own, F.col("pivot") == F.col("of_pivot")).crossJoin(F.broadcast(whole))  # one row
    p = (F.col("n") - discount) / F.col("den") + F.col("nz") * F.lit(discount) / F.col("den") * F.col("own") / F.col("whole")
    return rows.select("ctx", "pivot", p.alias("p"))
