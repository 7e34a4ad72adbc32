"""Seeded samples and perturbations. The same rows give the same draws, whatever the partitions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uniform(seed: int, *keys: str) -> Column:
    """A number in (0, 1) that depends on the seed and keys alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def sample(df: DataFrame, k: int, seed: int, *keys: str) -> DataFrame:
    """k rows without replacement."""
    return df.withColumn("_u", uniform(seed, *keys)).orderBy("_u", *keys).limit(k).drop("_u")


def weighted_sample(df: DataFrame, k: int, weight: str, seed: int, *keys: str) -> DataFrame:
    """k rows without replacement, by exponential race of their weights."""
    race = -F.log(uniform(seed, *keys)) / F.col(weight)
    return df.where(F.col(weight) > 0).withColumn("_u", race).orderBy("_u", *keys).limit(k).drop("_u")


def swap_words(sents: DataFrame, seed: int, distance: int = 1) -> DataFrame:
    """Sentences with one word exchanged for the one `distance` after it; shorter ones stay."""

    def run(frames):
        for f in frames:
            out = []
            for d, s, t in zip(f["doc_id"], f["sent_id"], f["tokens"], strict=True):
                t = list(t)
                if len(t) > distance:
                    i = int(np.random.default_rng([seed, int(d), int(s)]).integers(len(t) - distance))
                    t[i], t[i + distance] = t[i + distance], t[i]
                out.append(t)
            yield f.assign(tokens=out)

    return sents.select("doc_id", "sent_id", "tokens").mapInPandas(run, "doc_id long, sent_id long, tokens array<string>")
