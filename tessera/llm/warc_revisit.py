"""Resolution of not-modified revisit records of web archives.

A revisit (status 304) has no payload; it stands for the latest full response (status 200) to
the same canonical URL captured before it. It resolves if its validator is the response's: the
entity tag by weak comparison, or without entity tags the date of modification. Its
headers are then the response's, updated by those a 304 may change.

The as-of join is a running last value over records in order of time, cut into spans of time: a
URL's rows of one span are ordered in one place, and the last response before a span comes from
a running value over the spans' own last responses, a row a span. So a URL with a great share of all
records is spread over many tasks, and payloads never move.

Times have to be earlier; of responses at one time the largest record id counts. A revisit without a URL,
a time or an earlier response is `no-response`; other validators give
`validator-mismatch`. Repeated records give repeated results; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 100_000
# Headers that a 304 response updates, and query parameters that are no part of an address.
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
TRACKING = "^(utm_[^=]*|ref|sid|sessionid|phpsessid|jsessionid|gclid|fbclid)(=|$)"
URL = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)([^?]*)"


def canonical(url: Column) -> Column:
    """Host, path and sorted query: no scheme, user, `www`, default port, fragment, closing slash or tracking parameter; null if there is no host."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(plain, URL, 1)), "^www[0-9]*[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, URL, 2), "/+$", "")
    asked = F.filter(F.split(F.regexp_extract(plain, "[?](.*)$", 1), "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING))
    query = F.array_join(F.array_sort(asked), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def opaque_tag(etag: Column) -> Column:
    """An entity tag without its weakness mark; null if blank."""
    bare = F.regexp_replace(F.trim(etag), "^W/", "")
    return F.when(bare != "", bare)


def resolve(records: DataFrame, span: int = SPAN) -> DataFrame:
    """Revisits of records (record_id, kind `response` or `revisit`, url, ts, etag, last_modified, headers map<string,string>).

    Returns record_id, canonical_url, response_id, outcome, headers (of resolved ones, names in lower case).
    """
    lower = F.transform_keys(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    rows = records.select("record_id", "kind", canonical(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), opaque_tag(F.col("etag")).alias("tag"), F.col("last_modified").cast("string").alias("modified"), lower.alias("headers"))
    rows = rows.withColumn("span", F.floor(F.col("ts") / span))
    lost = "canonical_url IS NULL OR ts IS NULL"
    full = F.struct("ts", F.col("record_id").alias("response_id"), F.col("tag").alias("r_tag"), F.col("modified").alias("r_modified"), F.map_entries("headers").alias("r_headers"))
    rows = rows.withColumn("full", F.when(F.col("kind") == "response", full))
    placed = rows.where(f"NOT ({lost})")
    last = placed.where("kind = 'response'").groupBy("canonical_url", "span").agg(F.max_by("full", F.struct("ts", "record_id")).alias("last"))
    # revisits' spans come along, so that each has the last response of the spans before
    spans = placed.where("kind = 'revisit'").select("canonical_url", "span").distinct().join(last, ["canonical_url", "span"], "full")
    before = F.last("last", True).over(Window.partitionBy("canonical_url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    carried = spans.select(F.col("canonical_url").alias("of_url"), F.col("span").alias("of_span"), before.alias("before"))
    # at one time revisits come first: an earlier response is asked for
    order = Window.partitionBy("canonical_url", "span").orderBy("ts", F.col("kind").desc(), "record_id").rowsBetween(Window.unboundedPreceding, 0)
    inner = placed.withColumn("inner", F.last("full", True).over(order)).where("kind = 'revisit'")
    met = inner.join(carried, (F.col("canonical_url") == F.col("of_url")) & (F.col("span") == F.col("of_span")), "left").withColumn("found", F.coalesce("inner", "before"))
    same = F.when(F.col("tag").isNotNull() & F.col("found.r_tag").isNotNull(), F.col("tag") == F.col("found.r_tag")).otherwise(F.coalesce((F.col("modified") == F.col("found.r_modified")) & F.col("tag").isNull(), F.lit(False)))
    outcome = F.when(F.col("found").isNull(), "no-response").when(same, "resolved").otherwise("validator-mismatch")
    update = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    base = F.map_filter(F.map_from_entries("found.r_headers"), lambda k, _: ~F.array_contains(F.map_keys(update), k))
    got = met.withColumn("outcome", outcome).select("record_id", "canonical_url", F.col("found.response_id").alias("response_id"), "outcome", F.when(F.col("outcome") == "resolved", F.map_concat(base, update)).alias("headers"))
    rest = rows.where(f"({lost}) AND kind = 'revisit'").select("record_id", "canonical_url", F.lit(None).cast(got.schema["response_id"].dataType).alias("response_id"), F.lit("no-response").alias("outcome"), F.lit(None).cast("map<string,string>").alias("headers"))
    return got.unionByName(rest)


def records_of(pages: DataFrame) -> DataFrame:
    """Archive records of a table of pages: a full response each (even ids), and two revisits (odd ids), shortly before and long after it.

    A page's time is ten times its id; its entity tag is the md5 of its html.
    """
    tag = F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16)
    base = pages.select("page_id", "url", tag.alias("tag"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    m = lambda **h: F.create_map(*[x for k, v in h.items() for x in (F.lit(k.replace("_", "-")), v)])
    quoted = F.concat(F.lit('"'), "tag", F.lit('"'))

    def record(number: int, kind: str, shift: int, etag: Column, headers: Column) -> Column:
        return F.struct((F.col("page_id") * 4 + number).alias("record_id"), F.lit(kind).alias("kind"), "url", (F.col("page_id") * 10 + shift).alias("ts"), etag.alias("etag"), (F.col("page_id") * 10).cast("string").alias("last_modified"), headers.alias("headers"))

    day = lambda shift: (F.col("page_id") * 10 + shift).cast("string")
    weak = F.concat(F.lit("W/"), quoted)
    again = lambda shift: m(Date=day(shift), ETag=weak, Cache_Control=F.lit("max-age=120"), Content_Length=F.lit("0"), X_Cache=F.lit("HIT"))
    first = m(Date=day(0), ETag=quoted, Cache_Control=F.lit("max-age=60"), Content_Length=F.col("size").cast("string"), Content_Type=F.lit("text/html"))
    each = F.array(record(0, "response", 0, quoted, first), record(1, "revisit", -5, weak, again(-5)), record(3, "revisit", 1_000_005, weak, again(1_000_005)))
    return base.select(F.explode(each).alias("r")).select("r.*")


def op4(spark, pages: DataFrame) -> DataFrame:
    got = resolve(records_of(pages))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda x: F.concat(x["key"], F.lit(": "), x["value"])), "\n")
    return got.select("record_id", "canonical_url", "response_id", "outcome", F.coalesce(listed, F.lit("")).alias("headers"))


OP4_SQL = r"""
WITH base AS (
  SELECT page_id, substr(md5(coalesce(html, '')), 1, 16) AS tag, strlen(coalesce(html, '')) AS size,
         regexp_replace(trim(url), '#.*$', '') AS plain
  FROM pages
), parts AS (
  SELECT page_id, tag, size,
         regexp_replace(regexp_replace(lower(regexp_extract(plain, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)([^?]*)', 1)), '^www[0-9]*[.]', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(plain, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)([^?]*)', 2), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(plain, '[?](.*)$', 1), '&'),
           lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|ref|sid|sessionid|phpsessid|jsessionid|gclid|fbclid)(=|$)'))), '&') AS query
  FROM base
), responses AS (
  SELECT page_id, tag, size, CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical_url
  FROM parts
), revisits AS (
  SELECT page_id * 4 + 1 AS record_id, page_id * 10 - 5 AS ts, tag, canonical_url FROM responses
  UNION ALL
  SELECT page_id * 4 + 3 AS record_id, page_id * 10 + 1000005 AS ts, tag, canonical_url FROM responses
), latest AS (
  SELECT v.record_id, max(r.page_id) AS page_id
  FROM revisits v JOIN responses r ON v.canonical_url = r.canonical_url AND r.page_id * 10 < v.ts
  GROUP BY v.record_id
)
SELECT v.record_id, v.canonical_url, r.page_id * 4 AS response_id,
       CASE WHEN r.page_id IS NULL THEN 'no-response' WHEN r.tag = v.tag THEN 'resolved' ELSE 'validator-mismatch' END AS outcome,
       CASE WHEN r.tag = v.tag THEN 'cache-control: max-age=120' || chr(10) || 'content-length: ' || CAST(r.size AS VARCHAR) || chr(10)
         || 'content-type: text/html' || chr(10) || 'date: ' || CAST(v.ts AS VARCHAR) || chr(10) || 'etag: W/"' || v.tag || '"' ELSE '' END AS headers
FROM revisits v LEFT JOIN latest l ON v.record_id = l.record_id LEFT JOIN responses r ON r.page_id = l.page_id
"""
