"""Secret scans with multipart credential linking, in DataFrame functions alone.

Base secrets stand by themselves: assignments (`assign`), access identifiers (`access`) and long
hexadecimal runs (`hex`). Weak candidates - short assigned values (`short`), random-looking tokens
(`opaque`), user names (`login`) and service addresses (`endpoint`) - count only with
their complements. Each identifier (access, login) opens a scope, the interval of REACH
characters on either side of it; scopes are joined with the other parts that start in
them. The join is dealt by document and by cells of CELL characters, so its keys hold no
more than a cell's text, whatever the document. Then

* a short or opaque value counts if a scope holds it,
* a login counts if its scope holds a secret of any kind,
* an endpoint counts if a scope holds it together with a secret of any kind.

Positions are code points, the end is exclusive. They come from running sums of the lengths of
matches and of the text between them, over rows, so the work is linear in the matches.

A null text is empty and has no spans. A null id is a value like any other, repeated rows give
repeated results (parts are linked by id and text), parts that start together are in order of KINDS, other columns are not read, and an
empty table gives an empty result. Very long texts are one cell of a row; each pattern passes them in
linear time, and their parts are dealt by cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of, written

REACH, CELL = 400, 512
# The patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Weak kinds. Those that begin with a long run of characters begin only where the run does, so the work stays linear.
OPAQUE = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_-]{20,}={0,2}"
LOGIN = r"""(?i)(?<![A-Za-z0-9])(user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@=-]+)"""
ENDPOINT = r"""(?i)(?:(?:https?|s3|ftp|jdbc|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\x20\x09-\x0D"'<>]+|(?<![a-z0-9.-])[a-z0-9][a-z0-9.-]*\.(?:amazonaws\.com|core\.windows\.net|googleapis\.com))"""
KINDS = ["assign", "access", "hex", "short", "opaque", "login", "endpoint"]
BASE = KINDS[:3]


def found(text: Column, pattern: str, group: int = 0, strong: bool = False) -> Column:
    """Of each match in order: the length of the text before it, its own, its group's, and whether it looks random."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(hits), F.lit(1)))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    mixed = lambda x: x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]") if strong else F.lit(True)
    some = F.transform(F.arrays_zip(between.alias("b"), hits.alias("h"), groups.alias("g")), lambda x: F.struct(F.length(x["b"]).alias("gap"), F.length(x["h"]).alias("size"), F.length(x["g"]).alias("value"), mixed(x["h"]).alias("mixed")))
    return F.when(text.rlike(pattern), some).otherwise(F.array().cast("array<struct<gap:int,size:int,value:int,mixed:boolean>>"))


def matches(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, key (a hash of the text), and the matches of each pattern; the texts end here."""
    rows = df.select(F.col(id_col).alias("doc"), text_of(text_col).alias("text"))
    t = F.col("text")
    return rows.select(
        "doc", F.coalesce(F.col("doc").cast("string"), F.lit("")).alias("doc_key"), F.xxhash64("text").alias("key"),
        found(t, ASSIGN, 2).alias("assign"), found(t, ACCESS).alias("access"), found(t, HEX).alias("hex"),
        found(t, OPAQUE, 0, True).alias("opaque"), found(t, LOGIN, 2).alias("login"), found(t, ENDPOINT).alias("endpoint"),
    )


def spans(found_in: DataFrame) -> DataFrame:
    """doc_key, key, kind, start, end of every match that passes its kind's own test; identical rows count once."""
    per = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("hits")) for k in ("assign", "access", "hex", "opaque", "login", "endpoint")])
    once = found_in.where(F.greatest(*[F.size(k) for k in ("assign", "access", "hex", "opaque", "login", "endpoint")]) > 0).dropDuplicates(["doc_key", "key"])
    rows = once.select("doc_key", "key", F.explode(per).alias("p")).select("doc_key", "key", "p.kind", F.posexplode("p.hits").alias("i", "m"))
    upto = F.sum(F.col("m.gap") + F.col("m.size")).over(Window.partitionBy("doc_key", "key", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("doc_key", "key", "kind", (upto - F.col("m.size")).alias("start"), upto.alias("end"), F.col("m.value").alias("value"), F.col("m.mixed").alias("mixed"))
    rows = rows.withColumn("kind", F.when((F.col("kind") == "assign") & (F.col("value") < 8), "short").otherwise(F.col("kind")))
    return rows.where((F.col("kind") != "short") | (F.col("value") >= 4)).where((F.col("kind") != "opaque") | F.col("mixed")).drop("value", "mixed")


def linked(parts: DataFrame) -> DataFrame:
    """Weak parts that count, with the same columns."""
    cols = ["doc_key", "key", "kind", "start", "end"]
    ids = parts.where(F.col("kind").isin("access", "login"))
    scopes = ids.select("doc_key", "key", F.col("kind").alias("id_kind"), F.col("start").alias("id_start"), F.col("end").alias("id_end"), F.greatest(F.col("start") - REACH, F.lit(0)).alias("lo"), (F.col("end") + REACH).alias("hi"))
    scopes = scopes.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / CELL), F.floor(F.col("hi") / CELL))))
    others = parts.where(~F.col("kind").isin("access", "login")).withColumn("cell", F.floor(F.col("start") / CELL))
    pairs = scopes.join(others, ["doc_key", "key", "cell"]).where((F.col("start") >= F.col("lo")) & (F.col("start") < F.col("hi")) & ((F.col("end") <= F.col("id_start")) | (F.col("start") >= F.col("id_end"))))
    secret = F.max((F.col("kind") != "endpoint").cast("int")).over(Window.partitionBy("doc_key", "key", "id_start", "id_kind"))
    pairs = pairs.withColumn("secret", secret)
    weak = pairs.where(F.col("kind").isin("short", "opaque") | ((F.col("kind") == "endpoint") & (F.col("secret") == 1))).select(*cols)
    login = pairs.where((F.col("id_kind") == "login") & (F.col("secret") == 1)).select("doc_key", "key", F.col("id_kind").alias("kind"), F.col("id_start").alias("start"), F.col("id_end").alias("end"))
    return weak.unionByName(login).distinct()


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and `found`, the array of (start, rank, kind, end) of all spans in order, for each row."""
    seen = written(matches(df, id_col, text_col), "matches")
    parts = written(spans(seen), "parts")
    every = parts.where(F.col("kind").isin(*BASE)).unionByName(linked(parts))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    per = every.groupBy("doc_key", "key").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("found"))
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return seen.select("doc", "doc_key", "key").join(per, ["doc_key", "key"], "left").select(F.col("doc").alias(id_col), F.coalesce("found", none).alias("found"))


def op7(spark, docs: DataFrame) -> DataFrame:
    """Counts and digests of scan()."""
    def listed(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    base = F.filter("found", lambda x: x["rank"] <= len(BASE))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scan(docs).select("doc_id", *map(count, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
