"""Language identification by Bayesian fusion of evidence.

For each row and language, the log posterior is the sum of

* text: TEMPER times the log likelihood of the whole text's byte trigrams around letters (hashed to
  BUCKETS, add-one-half smoothed), from a model fitted on at most SAMPLE labelled rows a language,
* declared: log p(declared markup language | language), from soft counts over all rows,
* suffix: log p(address suffix | language), likewise,
* host: the host's prior. Soft counts of all rows are summed by host, then by each domain above it; from the corpus down each
  domain's counts are smoothed by the prior of the one above (`blog.a.example.org`, `a.example.org`, `example.org`, all).

Soft counts are the posteriors of the text under a flat prior. A further class `und` gives
each bucket the same probability; a text without letters is `und`. Labels are primary subtags of two or three letters (`en` of `en-US`); other values
are no labels. A model holds one row of BUCKETS a language, so fit() refuses labels of more than MOST_LANGUAGES languages and drops none.

Null or empty declared values, suffixes and hosts give no evidence. A null text is empty; very long texts are counted whole.
Repeated rows count as often as they occur and give repeated results; other columns are not read; an empty table
gives an empty result, and a model without labels knows `und` alone. Ties go to the first language in order of name.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_of, to_python, written

BUCKETS, TEMPER, SAMPLE, STRENGTH, CONFIDENCE = 1 << 15, 0.1, 1000, 20.0, 0.5
#: Rows of a table of evidence that may be broadcast (one number a language each), and languages of a model.
MOST_HOSTS, MOST_LANGUAGES = 10_000, 512
UND = "und"
LETTERS = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


def trigrams(data: bytes) -> np.ndarray:
    """Buckets of a text's byte trigrams around a letter, A-Z lower-cased, between two spaces."""
    b = np.frombuffer(b" " + data.lower() + b" ", np.uint8).astype(np.uint32)
    codes = (((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)) >> np.uint32(17)
    return codes[LETTERS[b[1:-1]]].astype(np.int64)


class Model:
    """Log probabilities of buckets by language; the last row is `und`."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table

    def likelihoods(self, data: bytes) -> np.ndarray:
        """Tempered log likelihood by language, `und` last."""
        t = trigrams(data)
        if not len(t):
            out = np.full(len(self.languages) + 1, -1e3)
            out[-1] = 0.0
            return out
        n = np.bincount(t, minlength=BUCKETS) if len(t) > BUCKETS else None
        return TEMPER * (self.table @ n if n is not None else self.table[:, t].sum(1))


def primary(label: Column) -> Column:
    """The primary subtag of a language tag; null for what is none."""
    got = F.regexp_extract(F.lower(F.trim(label.cast("string"))), r"^([a-z]{2,3})(?:$|[-_])", 1)
    return F.when(got != "", got)


def fit(labelled: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> Model:
    """A model of the languages in label_col, from the `sample` rows of each with the least hash of the id."""
    from pyspark.sql import Window

    label = primary(F.col(label_col))
    rows = labelled.select(F.col(id_col).alias("id"), label.alias("label")).where("label IS NOT NULL")
    counts = rows.groupBy("label").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"labels of more than {MOST_LANGUAGES} languages")
    languages = sorted(r["label"] for r in counts)
    if not languages:
        return Model([], np.full((1, BUCKETS), -np.log(BUCKETS)))
    # a threshold on the hash leaves about twice the sample of each language before rows are ranked
    share = F.create_map(*[x for r in counts for x in (F.lit(r["label"]), F.lit(min(1.0, 2.0 * sample / r["count"] + 20.0 / r["count"])))])
    u = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("u")
    few = rows.select("id", "label", u).where(F.col("u") <= share[F.col("label")])
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("u", "id"))).where(F.col("rank") <= sample).select(F.col("id").alias("of"), "label")
    texts = labelled.select(F.col(id_col).alias("id"), label.alias("own"), text_of(text_col).alias("text")).join(F.broadcast(few), (F.col("id") == F.col("of")) & (F.col("own") == F.col("label")))

    def count(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for b in batches:
            for x, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                total[languages.index(label)] += np.bincount(trigrams(x.encode()), minlength=BUCKETS)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j], pa.int64())], names=["i", "j", "n"])

    seen = np.zeros((len(languages), BUCKETS))
    for r in to_python(texts.select("text", "label"), count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toLocalIterator():
        seen[r["i"], r["j"]] = r["n"]
    table = np.log((seen + 0.5) / (seen.sum(1, keepdims=True) + 0.5 * BUCKETS))
    return Model(languages, np.concatenate([table, np.full((1, BUCKETS), -np.log(BUCKETS))]))


def likelihoods(df: DataFrame, model: Model, id_col: str, text_col: str, declared: Column, suffix: Column, host: Column, read: Callable[[str], str] | None = None) -> DataFrame:
    """id, declared, suffix, host and `ll`, the likelihoods of the text, or of what `read` makes of it."""

    def one(b):
        texts = b.column("text").cast(pa.binary()).to_pylist() if read is None else [read(x).encode() for x in b.column("text").to_pylist()]
        return {c: b.column(c) for c in ("id", "declared", "suffix", "host")} | {"ll": [model.likelihoods(x).tolist() for x in texts]}

    kind = df.schema[id_col].dataType.simpleString()
    blank = lambda c: F.when(F.trim(c.cast("string")) != "", F.lower(F.trim(c.cast("string"))))
    rows = df.select(F.col(id_col).alias("id"), blank(declared).alias("declared"), blank(suffix).alias("suffix"), blank(host).alias("host"), text_of(text_col).alias("text"))
    return map_arrow(rows, one, f"id {kind}, declared string, suffix string, host string, ll array<double>", "text", 1 << 20)


def posterior(scores: Column) -> Column:
    """Probabilities of log scores."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def soft_counts(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """Sums of the rows' posteriors p by key."""
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.element_at("p", i + 1)) for i in range(n)]).alias("c"))


def smoothed(counts: Column, prior: Column, strength: float) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, prior, lambda c, p: (c + strength * p) / (total + strength))


def host_priors(hosts: DataFrame, corpus: Column, strength: float) -> DataFrame:
    """of_host and p_host from hosts and their soft counts `c`: the counts of each domain, smoothed by the prior of the one above."""
    labels = F.split("host", "[.]")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    above = F.when(F.size(labels) > 2, F.slice(above, 1, F.size(labels) - 1)).otherwise(F.array("host"))  # a suffix is evidence of its own
    each = hosts.select("host", "c", F.posexplode(above).alias("level", "domain"))
    per = each.select("domain", F.posexplode("c").alias("i", "x")).groupBy("domain", "i").agg(F.sum("x").alias("x"))
    per = per.groupBy("domain").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("sum")).withColumnRenamed("domain", "of")
    chain = each.join(per, F.col("domain") == F.col("of")).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("level", "sum")), asc=False).alias("chain"))
    prior = F.aggregate("chain", corpus, lambda p, x: smoothed(x["sum"], p, strength))
    return chain.select(F.col("host").alias("of_host"), prior.alias("p_host"))


def identify(df: DataFrame, model: Model, id_col: str, text_col: str, declared: Column | None = None, suffix: Column | None = None, host: Column | None = None, strength: float = STRENGTH, read: Callable[[str], str] | None = None) -> DataFrame:
    """id, declared, language, confidence, accepted (a language, with a confidence of CONFIDENCE or more) of each row."""
    none = F.lit(None).cast("string")
    pick = lambda c: none if c is None else c
    L = len(model.languages) + 1
    rows = written(likelihoods(df, model, id_col, text_col, pick(declared), pick(suffix), pick(host), read), "likelihoods")
    soft = rows.withColumn("p", posterior(F.col("ll")))
    flat = F.array(*[F.lit(1.0 / L)] * L)
    total = np.array(soft_counts(soft.withColumn("all", F.lit(1)), L, "all").select("c").first()[0] if not rows.isEmpty() else [0.0] * L)
    overall = (total + 1.0) / (total.sum() + L)
    corpus = F.array(*map(F.lit, overall.tolist()))

    def evidence(col: str) -> DataFrame:
        """log p(value | language) of each value of a column, values seen with a language rarely drawn to the overall share."""
        c = soft_counts(soft.where(F.col(col).isNotNull()), L, col)
        t = c.agg(*[F.coalesce(F.sum(F.element_at("c", i + 1)), F.lit(0.0)).alias(f"t{i}") for i in range(L)]).first()
        tot, every = np.array(list(t)), sum(t) or 1.0
        share = F.aggregate("c", F.lit(0.0), lambda a, x: a + x) / F.lit(float(every))
        logs = F.array(*[F.log((F.element_at("c", i + 1) + F.lit(strength) * share + F.lit(1e-9)) / F.lit(float(tot[i] + strength))) for i in range(L)])
        return c.select(F.col(col).alias(f"of_{col}"), logs.alias(f"e_{col}"))

    out, tables = rows, []
    if declared is not None:
        tables.append((evidence("declared"), F.col("declared") == F.col("of_declared")))
    if suffix is not None:
        tables.append((evidence("suffix"), F.col("suffix") == F.col("of_suffix")))
    if host is not None:
        hosts = written(soft_counts(soft.where("host IS NOT NULL"), L, "host"), "hosts")
        tables.append((host_priors(hosts, corpus, strength), F.col("host") == F.col("of_host")))
    for t, on in tables:
        t = written(t, "evidence")
        out = out.join(F.broadcast(t) if t.count() <= MOST_HOSTS else t, on, "left")
    zero = F.array(*[F.lit(0.0)] * L)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    score = F.col("ll")
    for col, given in (("e_declared", declared), ("e_suffix", suffix)):
        if given is not None:
            score = add(score, F.coalesce(F.col(col), zero))
    score = add(score, F.transform(F.coalesce("p_host", corpus, flat) if host is not None else corpus, lambda x: F.log(x)))
    out = out.withColumn("p", posterior(score)).withColumn("confidence", F.array_max("p"))
    names = F.array(*map(F.lit, [*model.languages, UND]))
    out = out.withColumn("language", F.element_at(names, F.array_position("p", F.col("confidence")).cast("int")))
    return out.select(F.col("id").alias(id_col), "declared", "language", "confidence", ((F.col("language") != UND) & (F.col("confidence") >= CONFIDENCE)).alias("accepted"))


def identify_documents(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id") -> DataFrame:
    """Documents by their text and the prior of their `source`. `lang` is what a model is fitted on, so it is no evidence here."""
    model = model or fit(docs, "doc_id", "text", "lang")
    return identify(docs, model, id_col, "text", host=F.col("source"))


def identify_pages(pages: DataFrame, model: Model) -> DataFrame:
    """Web pages: main text, the html element's lang, and the address's suffix and host."""
    from .html_extract import extract

    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    declared = primary(F.regexp_extract("html", r"(?i)<html(?=\s)[^>]*?\slang\s*=\s*[\"']?([A-Za-z_-]+)", 1))
    host = F.when(F.length(host) <= 253, host)  # longer ones are no host names
    return identify(pages, model, "page_id", "html", declared, F.regexp_extract(host, r"\.([a-z]{2,})$", 1), host, read=extract)


def op2(spark, pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Languages of web pages; the text model is fitted on labelled documents."""
    return identify_pages(pages, fit(labelled, "doc_id", "text", "lang"))
