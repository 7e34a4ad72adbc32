"""Agreement of two labelings, statistics over runs, and averages of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, model: str, gold: str) -> DataFrame:
    """model, gold, n."""
    return df.groupBy(F.col(model).alias("model"), F.col(gold).alias("gold")).agg(F.count("*").alias("n"))


def jaccard_cost(conf: DataFrame) -> DataFrame:
    """model, gold, cost: one minus shared over joined tokens, of pairs that occur."""
    ni, nj = F.sum("n").over(Window.partitionBy("model")), F.sum("n").over(Window.partitionBy("gold"))
    return conf.select("model", "gold", (1 - F.col("n") / (ni + nj - F.col("n"))).alias("cost"))


def many_to_one(conf: DataFrame) -> DataFrame:
    """model, gold: the gold label of least cost for each model label, the first of equals."""
    return jaccard_cost(conf).groupBy("model").agg(F.min_by("gold", F.struct("cost", "gold")).alias("gold"))


def one_to_one(conf: DataFrame) -> list[tuple]:
    """(model, gold) matched greedily by least cost. The table of labels is small by nature: it is one row a pair of labels."""
    out, left, right = [], set(), set()
    for r in jaccard_cost(conf).orderBy("cost", "model", "gold").toLocalIterator():
        if r["model"] not in left and r["gold"] not in right:
            out.append((r["model"], r["gold"]))
            left.add(r["model"])
            right.add(r["gold"])
    return out


def accuracy(conf: DataFrame, mapping: DataFrame) -> DataFrame:
    """accuracy of a mapping of model to gold labels."""
    m = mapping.select(F.col("model").alias("m"), F.col("gold").alias("g"))
    got = conf.join(F.broadcast(m), F.col("model") == F.col("m"), "left")  # one row a label
    return got.agg((F.sum(F.when(F.col("gold") == F.col("g"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))


def pairwise(conf: DataFrame) -> DataFrame:
    """precision, recall, f of the pairs of tokens that share a label."""
    sq = lambda d, k: d.groupBy(k).agg(F.sum("n").alias("s")).agg(F.sum(F.col("s").cast("double") * F.col("s")).alias(k))
    both = conf.agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("both"), F.sum("n").cast("double").alias("all"))
    one = both.crossJoin(sq(conf, "model")).crossJoin(sq(conf, "gold"))  # one row each
    tp, mp, gp = ((F.col(c) - F.col("all")) / 2 for c in ("both", "model", "gold"))
    p, r = tp / mp, tp / gp
    return one.select(p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r)).alias("f"))


def variation_of_information(conf: DataFrame) -> DataFrame:
    """vi: entropies less twice the mutual information, in nats; joint shares of 1e-12 or less count nothing."""
    whole = F.broadcast(conf.agg(F.sum("n").alias("whole")))
    ent = lambda k: conf.groupBy(k).agg(F.sum("n").alias("s")).crossJoin(whole).agg((-F.sum(F.col("s") / F.col("whole") * F.log(F.col("s") / F.col("whole")))).alias(f"h_{k}"))
    ni, nj = F.sum("n").over(Window.partitionBy("model")), F.sum("n").over(Window.partitionBy("gold"))
    joint = conf.withColumn("ni", ni).withColumn("nj", nj).crossJoin(whole).withColumn("p", F.col("n") / F.col("whole")).where("p > 1e-12")
    mi = joint.agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("ni") / F.col("whole") * F.col("nj") / F.col("whole")))).alias("mi"))
    return ent("model").crossJoin(ent("gold")).crossJoin(mi).select((F.col("h_model") + F.col("h_gold") - 2 * F.col("mi")).alias("vi"))


def over_runs(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean and sample deviation by group."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"), F.count(value).alias("runs"))


def mapping_ratio(df: DataFrame, many: str, one: str) -> DataFrame:
    """ratio, tags: how many one-to-one tags a many-to-one tag has: 1, 2, 3 or M."""
    per = df.groupBy(many).agg(F.countDistinct(one).alias("k"))
    return per.groupBy(F.when(F.col("k") <= 3, F.col("k").cast("string")).otherwise("M").alias("ratio")).agg(F.count("*").alias("tags"))


def harmonic_mean(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n over the sum of reciprocals."""
    return df.groupBy(*by).agg((F.count("*") / F.sum(1 / F.col(value))).alias("harmonic_mean"))


def perplexity_average(df: DataFrame, value: str, tokens: float, *by: str) -> DataFrame:
    """n over the sum of exponentials of values a token."""
    return df.groupBy(*by).agg((F.count("*") / F.sum(F.exp(F.col(value) / F.lit(float(tokens))))).alias("perplexity"))


def bundle(conf: DataFrame, reduce_gold) -> DataFrame:
    """The twelve numbers of a run, one row: accuracies (one to one, many to one) for full and reduced gold labels, then pairwise precision, recall, F and variation of information of both."""
    spark = conf.sparkSession
    short = conf.groupBy("model", reduce_gold(F.col("gold")).alias("gold")).agg(F.sum("n").alias("n"))
    cells = []
    for name, c in (("full", conf), ("reduced", short)):
        pairs = one_to_one(c)
        kinds = f"model {c.schema['model'].dataType.simpleString()}, gold {c.schema['gold'].dataType.simpleString()}"
        cells.append(accuracy(c, spark.createDataFrame(pairs, kinds)).withColumnRenamed("accuracy", f"{name}_one_to_one"))
        cells.append(accuracy(c, many_to_one(c)).withColumnRenamed("accuracy", f"{name}_many_to_one"))
    for name, c in (("full", conf), ("reduced", short)):
        cells.append(pairwise(c).toDF(*[f"{name}_{x}" for x in ("precision", "recall", "f")]))
        cells.append(variation_of_information(c).withColumnRenamed("vi", f"{name}_vi"))
    out = cells[0]
    for c in cells[1:]:
        out = out.crossJoin(c)  # one row each
    return out


def bundle_line(row: DataFrame) -> DataFrame:
    """`value`: the numbers of a bundle in their order, six digits each, between tabs."""
    return row.select(F.concat_ws("\t", *[F.format_string("%f", F.col(c)) for c in row.columns]).alias("value"))


def shannon(df: DataFrame, count: str, *by: str) -> DataFrame:
    """Entropy in bits of counts by group; zeros add nothing."""
    s = F.sum(count).over(Window.partitionBy(*by))
    p = F.col(count) / s
    return df.withColumn("_p", p).where("_p > 0").groupBy(*by).agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"))
