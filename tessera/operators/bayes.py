"""Gibbs samplers of hidden-Markov models over sentences, and sentence probabilities by sampling.

A sweep sends the count tables to all tasks, resamples each partition's sentences against them, and sums
the differences of counts over partitions (counts are stale within a sweep). Draws depend on the
seed, sweep and sentence alone, so results don't depend on partitions. States are kept as an
array a sentence, and the corpus is written out after each sweep, which cuts lineage and bounds
what a lost executor costs. Count tables have states x words cells; words are ids.

Models: `bigram` and `trigram` transitions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexicon import numbered
from .store import written

FORM = "doc_id long, sent_id long, words array<int>, states array<int>"


@dataclass
class Model:
    """Counts of a model: words by state (S x W), transitions (S+1)^2, or (S+1)^3 for trigrams."""

    kind: str
    states: int
    gamma: float
    delta: float
    word: np.ndarray
    trans: np.ndarray

    def emission(self) -> np.ndarray:
        """p(word | state), S x W."""
        return (self.word + self.delta) / (self.word.sum(1, keepdims=True) + self.word.shape[1] * self.delta)

    def transition(self) -> np.ndarray:
        """p(state | what was before), the boundary state last."""
        return (self.trans + self.gamma) / (self.trans.sum(-1, keepdims=True) + (self.states + 1) * self.gamma)


def save(model: Model, spark, path: str) -> None:
    """A model as tables: its settings (one row) and its counts that are not zero."""
    cells = pd.concat([pd.DataFrame({"kind": k, "cell": (i := np.flatnonzero(x)), "n": x.ravel()[i]}) for k, x in (("word", model.word.ravel()), ("trans", model.trans.ravel()))])
    spark.createDataFrame(cells, "kind string, cell long, n long").write.mode("overwrite").parquet(f"{path}/counts")
    row = (model.kind, model.states, model.word.shape[1], model.gamma, model.delta)
    spark.createDataFrame([row], "kind string, states int, words long, gamma double, delta double").write.mode("overwrite").parquet(f"{path}/settings")


def load(spark, path: str) -> Model:
    """A saved model."""
    s = spark.read.parquet(f"{path}/settings").first()
    out = Model(s["kind"], s["states"], s["gamma"], s["delta"], np.zeros((s["states"], s["words"]), np.int64), np.zeros((s["states"] + 1,) * (3 if s["kind"] == "trigram" else 2), np.int64))
    for r in spark.read.parquet(f"{path}/counts").toLocalIterator():
        (out.word if r["kind"] == "word" else out.trans).reshape(-1)[r["cell"]] = r["n"]
    return out


def word_ids(tokens: DataFrame, vocab: DataFrame, unknown: str = "UNK") -> DataFrame:
    """doc_id, sent_id, words of a token table; words outside the vocabulary (word_id, word) get the id of `unknown`, or -1 if it has none."""
    rows = tokens.join(vocab.select(F.col("word").alias("of"), "word_id"), F.col("word") == F.col("of"), "left")
    unk = vocab.where(F.col("word") == unknown).agg(F.coalesce(F.max("word_id"), F.lit(-1)).alias("unk"))
    rows = rows.crossJoin(F.broadcast(unk)).withColumn("word_id", F.coalesce("word_id", "unk"))  # one row
    return rows.groupBy("doc_id", "sent_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word_id"))), lambda x: x["word_id"].cast("int")).alias("words"))


def sentence_ids(sents: DataFrame, vocab: DataFrame) -> DataFrame:
    """doc_id, sent_id, words: sentences (tokens, with ids of their own) as the ids of a vocabulary (word_id, word) that has all their words; id 0 is the sentence end, no word."""
    return numbered(sents, vocab.where("word_id > 0"))


def rng(seed: int, sweep: int, doc: int, sent: int) -> np.random.Generator:
    return np.random.default_rng([seed, sweep, doc & (2**63 - 1), sent])


def resample(words: np.ndarray, states: np.ndarray, em: np.ndarray, tr: np.ndarray, trigram: bool, draw: np.random.Generator, best: bool = False) -> np.ndarray:
    """New states of one sentence, token by token, from emission and transition probabilities."""
    S = em.shape[0]
    z = np.full(len(states) + 4, S)
    z[2:-2] = states
    u = draw.random(len(words))
    for i, w in enumerate(words):
        k = i + 2
        if trigram:
            p = em[:, w] * tr[z[k - 2], z[k - 1], :S] * tr[z[k - 1], :S, z[k + 1]] * tr[np.arange(S), z[k + 1], z[k + 2]]
        else:
            p = em[:, w] * tr[z[k - 1], :S] * tr[:S, z[k + 1]]
        c = np.cumsum(p)
        z[k] = int(p.argmax()) if best else min(int(np.searchsorted(c, u[i] * c[-1], "right")), S - 1)
    return z[2:-2]


def flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """Lists one after the other, and their lengths."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return (np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(sizes) else np.zeros(0, np.int64)), sizes


def resample_all(words: list, states: list, em: np.ndarray, tr: np.ndarray, trigram: bool, draws: list[np.ndarray], best: bool = False) -> list[np.ndarray]:
    """resample() of many sentences, token by token in all of them at once; `draws` has a number a token. Longer ones come first, so that those still going on are the first ones."""
    S, (w, n), (old, _), u = em.shape[0], flat(words), flat(states), np.concatenate([np.zeros(0), *draws])
    order = np.argsort(-n, kind="stable")
    ends = np.cumsum(n)
    at = (ends - n + 4 * np.arange(len(n)))[order]  # where a sentence starts in z, with two boundaries on either side
    z = np.full(int(n.sum()) + 4 * len(n), S)
    inner = np.arange(len(w)) + 4 * np.repeat(np.arange(len(n)), n) + 2
    z[inner] = old
    begin, going = (ends - n)[order], np.searchsorted(-n[order], -np.arange(int(n.max(initial=0))), "left")
    columns, every = np.ascontiguousarray(em.T), np.arange(S)
    out, back = np.ascontiguousarray(tr[..., :S]), None if trigram else np.ascontiguousarray(tr[:S].T)
    for i, m in enumerate(going):
        k = at[:m] + i + 2
        e = columns[w[begin[:m] + i]]
        if trigram:
            p = e * out[z[k - 2], z[k - 1]] * tr[z[k - 1][:, None], every, z[k + 1][:, None]] * tr[every, z[k + 1][:, None], z[k + 2][:, None]]
        else:
            p = e * out[z[k - 1]] * back[z[k + 1]]
        if best:
            z[k] = p.argmax(1)
        else:
            c = np.cumsum(p, 1)
            z[k] = np.minimum((c <= (u[begin[:m] + i] * c[:, -1])[:, None]).sum(1), S - 1)
    return np.split(z[inner], ends[:-1]) if len(n) else []


def count(frame: pd.DataFrame, S: int, W: int, trigram: bool) -> tuple[np.ndarray, np.ndarray]:
    (w, n), (s, _) = flat(list(frame["words"])), flat(list(frame["states"]))
    word = np.bincount(s * W + w, minlength=S * W).reshape(S, W)
    pads = 3  # two boundaries before and one behind
    z = np.full(len(s) + pads * len(n), S)
    z[np.arange(len(s)) + pads * np.repeat(np.arange(len(n)), n) + 2] = s
    heads, inner = np.cumsum(n + pads) - n - pads, np.ones(len(z), bool)
    inner[heads] = inner[heads + 1] = False
    mid = np.flatnonzero(inner)  # all places but the first two of a sentence
    cell = ((z[mid - 2] * (S + 1) + z[mid - 1]) if trigram else z[mid - 1]) * (S + 1) + z[mid]
    shape = (S + 1,) * (3 if trigram else 2)
    return word, np.bincount(cell, minlength=int(np.prod(shape))).reshape(shape)


def totals(sents: DataFrame, S: int, W: int, trigram: bool) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all partitions; each sends its cells that aren't zero, summed by cell before they come to the driver."""

    def run(frames):
        word, trans = np.zeros((S, W), np.int64), np.zeros((S + 1,) * (3 if trigram else 2), np.int64)
        for f in frames:
            a, b = count(f, S, W, trigram)
            word += a
            trans += b
        for kind, x in ((0, word.ravel()), (1, trans.ravel())):
            i = np.flatnonzero(x)
            yield pd.DataFrame({"kind": kind, "cell": i, "n": x[i]})

    word, trans = np.zeros(S * W, np.int64), np.zeros((S + 1) ** (3 if trigram else 2), np.int64)
    sums = sents.mapInPandas(run, "kind int, cell long, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).toArrow()
    kind, cell, n = (sums[c].to_numpy() for c in ("kind", "cell", "n"))
    for k, x in enumerate((word, trans)):
        x[cell[kind == k]] = n[kind == k]
    return word.reshape(S, W), trans.reshape((S + 1,) * (3 if trigram else 2))


def initial(sents: DataFrame, states: int, seed: int) -> DataFrame:
    def run(frames):
        for f in frames:
            yield f.assign(states=[rng(seed, 0, d, s).integers(states, size=len(w)).tolist() for d, s, w in zip(f["doc_id"], f["sent_id"], f["words"], strict=True)])

    return sents.select("doc_id", "sent_id", "words").mapInPandas(run, FORM)


def sweep_over(sents: DataFrame, model: Model, seed: int, number: int, best: bool = False, temperature: float = 1.0) -> DataFrame:
    em, tr, trigram = model.emission() ** (1 / temperature), model.transition() ** (1 / temperature), model.kind == "trigram"

    def run(frames):
        for f in frames:
            draws = [rng(seed, number, d, s).random(len(w)) for d, s, w in zip(f["doc_id"], f["sent_id"], f["words"], strict=True)]
            yield f.assign(states=resample_all(list(f["words"]), list(f["states"]), em, tr, trigram, draws, best))

    return sents.mapInPandas(run, FORM)


def train(sents: DataFrame, words: int, states: int = 30, kind: str = "bigram", sweeps: int = 100, gamma: float = 0.1, delta: float = 0.01, seed: int = 1, annealing: list[float] | None = None, start: DataFrame | None = None, done: int = 0) -> tuple[Model, DataFrame]:
    """A model of sentences of word ids (below `words`), and the last states of each. annealing: temperatures, each for `sweeps` sweeps.

    `start` (doc_id, sent_id, states) goes on from earlier states after `done` sweeps, with the draws that one run would have made.
    """
    trigram = kind == "trigram"
    now = written(initial(sents, states, seed) if start is None else sents.join(start.select("doc_id", "sent_id", "states"), ["doc_id", "sent_id"]).select("doc_id", "sent_id", "words", "states"), "sweep")
    number = done
    for t in annealing or [1.0]:
        for _ in range(sweeps):
            number += 1
            m = Model(kind, states, gamma, delta, *totals(now, states, words, trigram))
            now = written(sweep_over(now, m, seed, number, temperature=t), "sweep")
    return Model(kind, states, gamma, delta, *totals(now, states, words, trigram)), now


def best_states(sents: DataFrame, model: Model, seed: int = 1) -> DataFrame:
    """One sweep in which each token takes its likeliest state."""
    return sweep_over(sents, model, seed, 0, best=True)


def sentence_log_probabilities(sents: DataFrame, model: Model, sweeps: int = 5000, burn_in: int = 4500, lag: int = 10, seed: int = 1) -> DataFrame:
    """doc_id, sent_id, logprob: the mean over samples of the log10 probability of words and states under frozen counts."""
    em, tr, trigram, S = model.emission(), model.transition(), model.kind == "trigram", model.states

    def value(w, z):
        y = np.concatenate([[S, S], z, [S]]).astype(int)
        t = tr[y[:-2], y[1:-1], y[2:]] if trigram else tr[y[1:-1], y[2:]]
        return np.log10(t).sum() + np.log10(em[np.asarray(z, int), w]).sum()

    def run(frames):
        for f in frames:
            words = [np.asarray(w, int) for w in f["words"]]
            draws = [rng(seed, 0, d, s) for d, s in zip(f["doc_id"], f["sent_id"], strict=True)]
            z, got = [g.integers(S, size=len(w)) for g, w in zip(draws, words, strict=True)], [[] for _ in words]
            for k in range(sweeps):
                z = resample_all(words, z, em, tr, trigram, [g.random(len(w)) for g, w in zip(draws, words, strict=True)])
                if k >= burn_in and (k - burn_in) % lag == 0:
                    for own, w, x in zip(got, words, z, strict=True):
                        own.append(value(w, x))
            yield pd.DataFrame({"doc_id": f["doc_id"], "sent_id": f["sent_id"], "logprob": [float(np.mean(x)) if x else None for x in got]})

    return sents.select("doc_id", "sent_id", "words").mapInPandas(run, "doc_id long, sent_id long, logprob double")


def exact_log_probabilities(sents: DataFrame, model: Model) -> DataFrame:
    """doc_id, sent_id, logprob: the sum over all state sequences, by the forward recursion (bigram models)."""
    em, tr, S = model.emission(), model.transition(), model.states

    def one(w):
        a, total = tr[S, :S].copy(), 0.0
        for i, x in enumerate(w):
            a = (a if i == 0 else a @ tr[:S, :S]) * em[:, x]
            total += np.log10(a.sum())
            a /= a.sum()
        return total + np.log10(a @ tr[:S, S] if len(w) else tr[S, S])

    def run(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "sent_id": f["sent_id"], "logprob": [float(one(np.asarray(w, int))) for w in f["words"]]})

    return sents.select("doc_id", "sent_id", "words").mapInPandas(run, "doc_id long, sent_id long, logprob double")


def induced_classes(states: DataFrame, max_length: int = 0) -> DataFrame:
    """Sentences of state names S0, S1, ...; longer ones than max_length go (0: none)."""
    rows = states.where(F.size("states") <= max_length) if max_length else states
    return rows.select("doc_id", "sent_id", F.transform("states", lambda s: F.concat(F.lit("S"), s.cast("string"))).alias("tokens"))
