"""Sufficient statistics and smoothed parameters of hidden-Markov, topic, two-tier and chunk models.

They need an assignment of states to tokens (column state, 0..states-1); the boundary state is `states`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import small, written


def sentence():
    """A sentence's tokens in order."""
    return Window.partitionBy("doc_id", "sent_id").orderBy("pos")


def previous(col: str, k: int, default: int) -> Column:
    """The k-th value before in the sentence, else the boundary's."""
    return F.coalesce(F.lag(col, k).over(sentence()), F.lit(default))


def contexts(tokens: DataFrame, states: int) -> DataFrame:
    """Adds lag1, lag2 and next."""
    return tokens.withColumn("lag1", previous("state", 1, states)).withColumn("lag2", previous("state", 2, states)).withColumn("next", F.coalesce(F.lead("state").over(sentence()), F.lit(states)))


def state_words(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("state", "word").agg(F.count("*").alias("n"))


def states_of(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("state").agg(F.count("*").alias("n"))


def transitions(ctx: DataFrame, order: int = 1) -> DataFrame:
    """Counts of (lag1, state) or (lag2, lag1, state), with the step into the boundary at sentence ends."""
    cols = ["lag2", "lag1", "state"][2 - order :]
    return ctx.groupBy(*cols).agg(F.count("*").alias("n"))


def grid(spark, states: int, n: int) -> DataFrame:
    """All n-tuples of states and boundary."""
    ids = F.explode(F.array(*map(F.lit, range(states + 1))))
    out = spark.range(1)
    for i in range(n):
        out = out.withColumn(f"g{i}", ids)
    return out.drop("id")


def transition_probabilities(trans: DataFrame, states: int, gamma: float) -> DataFrame:
    """prev, state, p for all pairs: (n + gamma) / (row + states' * gamma), the boundary among the states."""
    g = grid(trans.sparkSession, states, 2).join(F.broadcast(trans), (F.col("g0") == F.col("lag1")) & (F.col("g1") == F.col("state")), "left")  # states squared rows
    n = F.coalesce("n", F.lit(0))
    row = F.sum(n).over(Window.partitionBy("g0"))
    return g.select(F.col("g0").alias("prev"), F.col("g1").alias("state"), ((n + gamma) / (row + (states + 1) * gamma)).alias("p"))


def emission_probabilities(words: DataFrame, prior: float, content_prior: float | None = None, content: int = 0) -> DataFrame:
    """state, word, p of pairs that occur: (n + prior) / (state's n + words * prior); the first `content` states may have their own prior."""
    b = F.when(F.col("state") < content, F.lit(content_prior)).otherwise(F.lit(prior)) if content_prior is not None else F.lit(prior)
    words = written(words, "state_words")
    vocab = F.broadcast(words.agg(F.countDistinct("word").alias("v")))  # one row
    per = F.broadcast(words.groupBy(F.col("state").alias("of_state")).agg(F.sum("n").alias("per")))  # a row a state
    return words.join(per, F.col("state") == F.col("of_state")).crossJoin(vocab).select("state", "word", ((F.col("n") + b) / (F.col("per") + F.col("v") * b)).alias("p"))


def topic_counts(tokens: DataFrame) -> DataFrame:
    """kind, id, key, n: topic-word counts where the state is 0, topic counts and document-topic counts."""
    zero = tokens.where("state = 0")
    tw = zero.groupBy(F.col("topic").cast("long").alias("id"), F.col("word").alias("key")).agg(F.count("*").alias("n")).select(F.lit("topic_word").alias("kind"), "id", "key", "n")
    t = zero.groupBy(F.col("topic").cast("long").alias("id")).agg(F.count("*").alias("n")).select(F.lit("topic").alias("kind"), "id", F.lit("").alias("key"), "n")
    dt = tokens.groupBy(F.col("doc_id").alias("id"), F.col("topic").cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit("doc_topic").alias("kind"), "id", "key", "n")
    return tw.unionByName(t).unionByName(dt)


def top_words(words: DataFrame, k: int) -> DataFrame:
    """state, rank, word, n: the k most frequent words of each state, the first of equals by name."""
    rank = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("n"), "word"))
    return words.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("state", "rank", "word", "n")


def two_tier(tokens: DataFrame, states: int) -> DataFrame:
    """kind, chunk, state, next, n: chunk transitions (chunk, state to chunk) and state transitions (chunk, state to state)."""
    nc, ns = F.coalesce(F.lead("chunk").over(sentence()), F.lit(-1)), F.coalesce(F.lead("state").over(sentence()), F.lit(states))
    rows = tokens.select("chunk", "state", nc.alias("nc"), ns.alias("ns"))
    a = rows.groupBy("chunk", "state", F.col("nc").alias("next")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("chunk"))
    b = rows.groupBy("chunk", "state", F.col("ns").alias("next")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("state"))
    return a.unionByName(b).select("kind", "chunk", "state", "next", "n")


def segments(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_id, chunk_id, chunk: states between boundaries (column boundary: does a chunk end here?), joined by +."""
    before = F.coalesce(F.sum(F.col("boundary").cast("long")).over(sentence().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = tokens.withColumn("chunk_id", before)
    return rows.groupBy("doc_id", "sent_id", "chunk_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "state"))), lambda x: x["state"].cast("string")), "+").alias("chunk"))


def chunked(sents: DataFrame) -> DataFrame:
    """doc_id, sent_id, chunks: the chunks of segments() in order, from sentences of `states` and `ends` (does a chunk end here?); no token moves."""
    each = F.zip_with("states", "ends", lambda s, e: F.concat(s.cast("string"), F.when(e, "\n").otherwise("+")))
    return sents.select("doc_id", "sent_id", F.split(F.rtrim(F.array_join(each, ""), F.lit("+\n")), "\n").alias("chunks"))


def segments_of(sents: DataFrame) -> DataFrame:
    """segments() of such sentences."""
    rows = chunked(sents).select("doc_id", "sent_id", F.posexplode_outer("chunks").alias("chunk_id", "chunk"))
    return rows.withColumn("chunk_id", F.col("chunk_id").cast("long"))


def bigrams_of(sents: DataFrame) -> DataFrame:
    """chunk_bigrams() of such sentences."""
    pairs = F.transform("chunks", lambda c, i: F.struct(F.when(i == 0, ".").otherwise(F.get("chunks", i - 1)).alias("prev"), c.alias("chunk")))
    return chunked(sents).select(F.explode_outer(pairs).alias("x")).groupBy("x.prev", "x.chunk").agg(F.count("*").alias("n"))


def chunk_counts(segs: DataFrame) -> DataFrame:
    """chunk, n."""
    return segs.groupBy("chunk").agg(F.count("*").alias("n"))


def chunk_bigrams(segs: DataFrame) -> DataFrame:
    """prev, chunk, n; sentences start after the dummy chunk `.`."""
    prev = F.coalesce(F.lag("chunk").over(Window.partitionBy("doc_id", "sent_id").orderBy("chunk_id")), F.lit("."))
    return segs.withColumn("prev", prev).groupBy("prev", "chunk").agg(F.count("*").alias("n"))


def chunk_probabilities(counts: DataFrame, states: DataFrame, alpha: float, rho: float) -> DataFrame:
    """chunk, p: (n + alpha * p0) / (all + alpha), p0 the product of state shares times rho (1-rho)^(length-1)."""
    share = F.broadcast(states.select(F.col("state").cast("string").alias("s"), (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share")))  # a row a state
    parts = counts.select("chunk", "n", F.posexplode(F.split("chunk", "[+]")).alias("i", "part")).join(share, F.col("part") == F.col("s"))
    p0 = parts.groupBy("chunk", "n").agg((F.exp(F.sum(F.log("share"))) * F.lit(rho) * F.pow(F.lit(1 - rho), F.count("*") - 1)).alias("p0"))
    whole = F.broadcast(counts.agg(F.sum("n").alias("whole")))
    return p0.crossJoin(whole).select("chunk", ((F.col("n") + alpha * F.col("p0")) / (F.col("whole") + alpha)).alias("p"))


def chunk_transition_probabilities(bigrams: DataFrame, probs: DataFrame, beta: float) -> DataFrame:
    """prev, chunk, p of pairs that occur: (n + beta * p(chunk)) / (prev's n + beta * chunk types)."""
    types = F.broadcast(probs.agg(F.count("*").alias("types")))
    bigrams = written(bigrams, "bigrams")
    per = small(written(bigrams.groupBy(F.col("prev").alias("of_prev")).agg(F.sum("n").alias("per")), "per"))
    rows = bigrams.join(per, F.col("prev") == F.col("of_prev")).join(probs.select(F.col("chunk").alias("c"), F.col("p").alias("pc")), F.col("chunk") == F.col("c")).crossJoin(types)
    return rows.select("prev", "chunk", ((F.col("n") + beta * F.col("pc")) / (F.col("per") + beta * F.col("types"))).alias("p"))


def third_order(tokens: DataFrame, states: int) -> DataFrame:
    """lag3, lag2, lag1, state, n: counts of states after the three before; a sentence's end resets what was before."""
    lags = {f"lag{k}": previous("state", k, states) for k in (1, 2, 3)}
    return tokens.withColumns(lags).groupBy("lag3", "lag2", "lag1", "state").agg(F.count("*").alias("n"))


def second_order_probabilities(trans: DataFrame, states: int, gamma: float) -> DataFrame:
    """prev2, prev, state, p for all triples: (n + gamma) / (row + states' * gamma), the boundary among the states."""
    g = grid(trans.sparkSession, states, 3).join(F.broadcast(trans), (F.col("g0") == F.col("lag2")) & (F.col("g1") == F.col("lag1")) & (F.col("g2") == F.col("state")), "left")  # states cubed rows
    n = F.coalesce("n", F.lit(0))
    row = F.sum(n).over(Window.partitionBy("g0", "g1"))
    return g.select(F.col("g0").alias("prev2"), F.col("g1").alias("prev"), F.col("g2").alias("state"), ((n + gamma) / (row + (states + 1) * gamma)).alias("p"))


def masked_emissions(words: DataFrame, dictionary: DataFrame, prior: float) -> DataFrame:
    """state, word, p of pairs that occur and that the dictionary (word, states) allows; each state's shares are those of the words it may have."""
    listed = words.join(dictionary.select(F.col("word").alias("of_word"), "states"), F.col("word") == F.col("of_word"), "left").drop("of_word")
    kept = written(listed.where(F.col("states").isNull() | F.array_contains("states", F.col("state"))), "masked")
    every = words.select("word").distinct().join(dictionary.select(F.col("word").alias("of_word"), "states"), F.col("word") == F.col("of_word"), "left")
    state_ids = words.select("state").distinct()
    free = every.agg(F.count_if(F.col("states").isNull()).alias("free"))  # one row
    own = every.where("states IS NOT NULL").select(F.explode("states").alias("s")).groupBy("s").agg(F.count("*").alias("own"))
    size = state_ids.join(own, F.col("state") == F.col("s"), "left").crossJoin(F.broadcast(free)).select(F.col("state").alias("s"), (F.coalesce("own", F.lit(0)) + F.col("free")).alias("v"))
    per = kept.groupBy(F.col("state").alias("of_state")).agg(F.sum("n").alias("per"))
    both = F.broadcast(per.join(size, F.col("of_state") == F.col("s")).drop("s"))  # a row a state
    return kept.join(both, F.col("state") == F.col("of_state")).select("state", "word", ((F.col("n") + prior) / (F.col("per") + F.col("v") * prior)).alias("p"))


def word_unigrams(words: DataFrame, emissions: DataFrame) -> DataFrame:
    """word, p: the shares of states times their words' probabilities, summed over the states that had the word."""
    share = words.groupBy(F.col("state").alias("s")).agg(F.sum("n").alias("n"))
    share = F.broadcast(share.select("s", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share")))  # a row a state
    return emissions.join(share, F.col("state") == F.col("s")).groupBy("word").agg(F.sum(F.col("p") * F.col("share")).alias("p"))


def top_by_probability(emissions: DataFrame, k: int) -> DataFrame:
    """state, rank, word, p: the k likeliest words of each state, the first of equals by name; `Null` fills up."""
    rank = F.row_number().over(Window.partitionBy("state").orderBy(F.desc("p"), "word"))
    top = emissions.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
    places = emissions.select("state").distinct().select(F.col("state").alias("s"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))).alias("r"))
    got = places.join(top, (F.col("s") == F.col("state")) & (F.col("r") == F.col("rank")), "left")
    return got.select(F.col("s").alias("state"), F.col("r").alias("rank"), F.coalesce("word", F.lit("Null")).alias("word"), F.coalesce("p", F.lit(0.0)).alias("p"))


def tabulated(top: DataFrame, width: int = 4) -> DataFrame:
    """block, rank and c0, c1, ...: the words of `width` states side by side."""
    cols = [F.max(F.when(F.col("state") % width == i, F.col("word"))).alias(f"c{i}") for i in range(width)]
    return top.groupBy(F.floor(F.col("state") / width).alias("block"), "rank").agg(*cols)


def top_chunks(probs: DataFrame, k: int = 100) -> DataFrame:
    """The k chunks with the greatest values, the last of equals by name."""
    return probs.orderBy(F.desc("p"), F.desc("chunk")).limit(k)


def long_chunks(counts: DataFrame, parts: int = 5) -> DataFrame:
    """Chunks of more parts than that."""
    return counts.where(F.size(F.split("chunk", "[+]")) > parts)


def invariants(tokens: DataFrame, states: int) -> DataFrame:
    """name, counted, expected: sums of the model's counts that have to be the number of tokens (and sentences)."""
    ctx = contexts(tokens, states)
    whole = tokens.agg(F.count("*").alias("expected"))
    sums = [
        state_words(tokens).agg(F.sum("n").alias("counted")).select(F.lit("state_word").alias("name"), "counted"),
        transitions(ctx, 1).agg(F.sum("n").alias("counted")).select(F.lit("first_order").alias("name"), "counted"),
        transitions(ctx, 2).agg(F.sum("n").alias("counted")).select(F.lit("second_order").alias("name"), "counted"),
        states_of(tokens).agg(F.sum("n").alias("counted")).select(F.lit("state").alias("name"), "counted"),
    ]
    out = sums[0]
    for s in sums[1:]:
        out = out.unionByName(s)
    return out.crossJoin(F.broadcast(whole))  # one row
