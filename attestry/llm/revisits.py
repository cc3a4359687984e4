"""Operator 7: not-modified captures of a web archive, resolved to the full response they stand for.

A revisit record holds no payload: its server said that nothing had changed. It is joined, as of its time, to
the latest earlier full response of the same canonical URL; the validators of both are compared, and the headers
that a not-modified answer may renew are merged into the response's.

The as-of join splits every URL's records by time: inside a slice a window finds the latest response, and where a
slice has none before a record, the last one of the slices before it is taken, which a window over one row
for each slice knows. So no task holds all records of a URL that a third of the archive is about.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.llm.common import table

#: Headers that a 304 answer may renew (HTTP semantics, 304; caching, freshening stored responses).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that name a visit, not a page.
TRACKING = "utm_[^=]*|ref|fbclid|gclid|sessionid|sid|phpsessid|jsessionid"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without a final slash, own parameters in order.

    Scheme, user, fragment and tracking parameters go. Null stays null; what is no http URL is only trimmed.
    """
    text = F.trim(url)
    part = lambda k: F.regexp_extract(text, r"^[Hh][Tt][Tt][Pp][Ss]?://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)\??([^#]*)", k)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_replace(part(2), "/+$", "")
    own = F.array_sort(F.filter(F.split(part(3), "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^({TRACKING})(=|$)")))
    query = F.when(F.size(own) > 0, F.concat(F.lit("?"), F.array_join(own, "&"))).otherwise("")
    return F.when(part(1) == "", text).otherwise(F.concat(host, path, query))


def _weak(etag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(etag, "^W/", "")


def _slice(at: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds a time has reached, by halves over one constant array, however many there are."""
    held = F.split(F.lit(",".join(map(repr, bounds))), ",").cast("array<double>")
    return T.first_index(F.lit(len(bounds)), lambda k: F.get(held, k) > at) if bounds else F.lit(0)


def as_of(records: DataFrame, slices: int | None = None, rows: int = 50_000) -> DataFrame:
    """``records`` (key, at, record_id, full, and more) with ``source``: the latest earlier full record of the key.

    Earlier: a smaller (at, record_id). ``full`` marks the records that can be a source; ``source`` is a struct
    of all columns, null where there is none. Records with a null key or time have none. Slices hold about as many records
    each, whatever stray times there are: their bounds are quantiles of the times, known within a quarter of a slice. There are so many that
    a slice of the whole table has some ``rows``, so those of one key in a slice are no more, even if all records have that key.
    """
    names = records.columns
    slices = slices or max(128, records.count() // rows)
    bounds = sorted(set(records.stat.approxQuantile("at", [k / slices for k in range(1, slices)], min(1e-3, 0.25 / slices)))) if slices > 1 else []
    sliced = records.withColumn("slice", _slice(F.col("at"), bounds))
    usable = F.col("key").isNotNull() & F.col("at").isNotNull()
    timed, rest = sliced.where(usable), sliced.where(~usable)
    source = F.when(F.col("full"), F.struct(*names))
    inside = Window.partitionBy("key", "slice").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = timed.withColumn("near", F.last(source, ignorenulls=True).over(inside))
    ends = timed.groupBy("key", "slice").agg(F.max_by(source, F.when(F.col("full"), F.struct("at", "record_id"))).alias("end"))
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("key", "slice", F.last("end", ignorenulls=True).over(before).alias("carried"))
    found = near.join(carried, ["key", "slice"]).select(*names, F.coalesce("near", "carried").alias("source"))
    kind = found.schema["source"].dataType
    return found.unionByName(rest.select(*names, F.lit(None).cast(kind).alias("source")))


def resolve(captures: DataFrame) -> DataFrame:
    """record_id, canonical_url, source_id, outcome, headers of every revisit in ``captures``.

    ``captures``: record_id, url, captured (long), kind ('response', 'revisit'), etag, last_modified, digest and
    headers (map with names in lower case); other columns are left behind. outcome: 'resolved'; 'changed' if a
    validator that both have differs (entity tags by weak comparison, then Last-Modified, and payload digests);
    'unvalidated' if they have none in common; 'missing' without an earlier response. Only 'resolved' has
    headers: the response's, with the permitted ones of the revisit over them. A revisit with a null URL or time
    is 'missing'; rows of other or null kinds are no captures; repeated rows keep a result each.
    """
    records = captures.where(F.col("kind").isin("response", "revisit")).select(
        canonical_url(F.col("url")).alias("key"), F.col("captured").cast("long").alias("at"), F.col("record_id").cast("long").alias("record_id"),
        (F.col("kind") == "response").alias("full"), _weak(F.col("etag")).alias("etag"), "last_modified", "digest", F.coalesce("headers", F.expr("map()").cast("map<string,string>")).alias("headers"))
    found = as_of(records).where(~F.col("full"))
    same = lambda c: F.col(c) == F.col(f"source.{c}")
    alike = F.coalesce(same("etag"), same("last_modified"))
    outcome = (
        F.when(F.col("source").isNull(), "missing")
        .when(~F.coalesce(alike, F.lit(True)) | ~F.coalesce(same("digest"), F.lit(True)), "changed")
        .when(F.coalesce(alike, same("digest")).isNull(), "unvalidated")
        .otherwise("resolved")
    )
    renewed = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter("source.headers", lambda k, _: ~F.map_contains_key(renewed, k))
    return found.select("record_id", F.col("key").alias("canonical_url"), outcome.alias("outcome"), F.col("source.record_id").alias("source_id"), F.map_concat(kept, renewed).alias("merged")).select(
        "record_id", "canonical_url", "source_id", "outcome", F.when(F.col("outcome") == "resolved", F.col("merged")).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Two captures for each page, since the table has no record of visits.

    A response at ten times the page_id with the page's digest as entity tag, and a revisit some pages later that
    asks with the same tag, as a weak one, or for every fifth page with another. Its Content-Length and Content-Type are
    those of an empty answer, so a resolver must not let them through.
    """
    day = F.col("page_id") % 28 + 1
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    text = lambda **h: F.map_from_arrays(F.array(*[F.lit(k.replace("_", "-")) for k in h]), F.array(*h.values()))
    number = lambda c: c.cast("string")
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("captured"), F.lit("response").alias("kind"), tag.alias("etag"),
        text(content_length=number(F.length(F.coalesce("html", F.lit("")))), content_type=F.lit("text/html"), date=F.concat(F.lit("day "), number(day)), etag=tag).alias("headers"))
    asked = F.when(F.col("page_id") % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 10 + 5 + F.col("page_id") % 7 * 1000).alias("captured"), F.lit("revisit").alias("kind"), asked.alias("etag"),
        text(cache_control=F.lit("max-age=60"), content_length=F.lit("0"), content_type=F.lit("text/plain"), date=F.concat(F.lit("later than day "), number(day))).alias("headers"))
    return response.unionByName(revisit).withColumns({"last_modified": F.lit(None).cast("string"), "digest": F.lit(None).cast("string")})


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of ``captures`` resolved; see ``resolve`` for its cases."""
    found = resolve(captures(table(spark, sf_dir, "pages")))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit(": "), e.value)))
    return found.select("record_id", "canonical_url", "source_id", "outcome", F.array_join(lines, "\n").alias("headers"))


OP7_SQL = r"""
WITH parts AS (
  SELECT page_id, trim(url) AS url, coalesce(html, '') AS html,
         regexp_extract(trim(url), '^[Hh][Tt][Tt][Pp][Ss]?://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)\??([^#]*)', 1) AS host,
         regexp_extract(trim(url), '^[Hh][Tt][Tt][Pp][Ss]?://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)\??([^#]*)', 2) AS path,
         regexp_extract(trim(url), '^[Hh][Tt][Tt][Pp][Ss]?://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)\??([^#]*)', 3) AS query
  FROM pages
), own AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|ref|fbclid|gclid|sessionid|sid|phpsessid|jsessionid)(=|$)'))) AS params
  FROM parts
), keyed AS (
  SELECT page_id, html, '"' || substr(md5(html), 1, 16) || '"' AS tag, page_id % 28 + 1 AS day,
         CASE WHEN host = '' THEN url ELSE
           regexp_replace(regexp_replace(lower(host), ':(80|443)?$', ''), '^www\.', '') || regexp_replace(path, '/+$', '')
           || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS key
  FROM own
), response AS (
  SELECT key, page_id * 2 AS record_id, page_id * 10 AS at, tag, length(html) AS n, day FROM keyed
), revisit AS (
  SELECT key, page_id * 2 + 1 AS record_id, page_id * 10 + 5 + page_id % 7 * 1000 AS at,
         CASE WHEN page_id % 5 = 0 THEN '"other"' ELSE tag END AS tag, day FROM keyed
), matched AS (
  SELECT v.record_id, v.key, v.tag, v.day, r.record_id AS source_id, r.tag AS source_tag, r.n,
         row_number() OVER (PARTITION BY v.record_id ORDER BY r.at DESC, r.record_id DESC) AS place
  FROM revisit v LEFT JOIN response r ON v.key = r.key AND (r.at < v.at OR r.at = v.at AND r.record_id < v.record_id)
)
SELECT record_id, key AS canonical_url, source_id,
       CASE WHEN source_id IS NULL THEN 'missing' WHEN tag = source_tag THEN 'resolved' ELSE 'changed' END AS outcome,
       CASE WHEN tag = source_tag THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || n || chr(10)
         || 'content-type: text/html' || chr(10) || 'date: later than day ' || day || chr(10) || 'etag: ' || source_tag END AS headers
FROM matched WHERE place = 1
"""
