"""Not-modified revisits of a web archive, resolved against the full response they stand for.

A revisit is joined with the latest full response of the same canonical URL that
was recorded strictly before it. If the revisit names an entity tag it must be
that of the response (weak comparison), else its time of last change must be the
same; a revisit with neither proves nothing. A resolved revisit has the
response's headers, brought up to date with those that a not-modified answer may
change.

The join is by time slots of a URL: inside a slot by a window, before it by the
last response of each earlier slot. A URL with very many records so fills many
tasks; the table of slots has a row for each URL and slot.

States: resolved, changed (validators differ), unproven (no validator to
compare), missing (no earlier response; also where the URL is null). Times that
are null are never earlier and have nothing before them. Of responses at the
same time the one with the largest record id counts. Repeated records stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Parameters that do not name a page, and headers a not-modified answer never changes.
TRACKING = ("utm_[a-z]+", "ref", "fbclid", "gclid", "sessionid", "phpsessid")
KEPT = (
    "content-length", "content-type", "content-encoding", "content-range", "content-md5", "transfer-encoding",
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "upgrade",
)
#: Seconds of a slot.
SLOT = 3600


def canonical(url: Column) -> Column:
    """Host, path and query of a URL: lower-cased host without www. and usual port, sorted query without tracking, no end slash."""
    plain = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    query = F.split(F.regexp_extract(plain, r"\?(.*)$", 1), "&")
    wanted = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(rf"(?i)^({'|'.join(TRACKING)})(=|$)")))
    asked = F.when(F.size(wanted) > 0, F.concat(F.lit("?"), F.array_join(wanted, "&"))).otherwise("")
    # what is no absolute URL stands for itself
    return F.when(host == "", plain).otherwise(F.concat(host, path, asked))


def _tag(column: Column) -> Column:
    return F.regexp_replace(F.trim(column), "^W/", "")


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Stored headers (map, lower-case names) with those of a not-modified answer that may change them, as sorted entries."""
    stored, fresh = (F.coalesce(m, F.create_map().cast("map<string,string>")) for m in (stored, fresh))
    fresh = F.map_filter(fresh, lambda k, _: ~k.isin(*KEPT))
    old = F.map_filter(stored, lambda k, _: ~F.map_contains_key(fresh, k))
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(old, fresh))))


def resolve(responses: DataFrame, revisits: DataFrame, slot: int = SLOT) -> DataFrame:
    """Adds to each revisit `url_key`, `state`, `response_id`, `response_digest` and `merged_headers`.

    responses: record_id, url, at (seconds, long), etag, last_modified, digest, headers (map of lower-case names).
    revisits: record_id, url, at, etag, last_modified, headers.
    """
    facts = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    full = responses.select(canonical(F.col("url")).alias("url_key"), "at", facts.alias("full"), F.struct("at", "record_id").alias("order"))
    seen = revisits.select(
        canonical(F.col("url")).alias("url_key"), "at", "record_id", F.struct("etag", "last_modified", "headers").alias("visit")
    )
    # one row for each URL and second: the last response in it, and whether somebody asks then
    both = full.withColumn("asked", F.lit(False)).unionByName(seen.select("url_key", "at", F.lit(True).alias("asked")), allowMissingColumns=True)
    seconds = both.filter("url_key is not null and at is not null").groupBy("url_key", "at").agg(
        F.max_by("full", "order").alias("full"), F.max("asked").alias("asked")
    ).withColumn("slot", F.floor(F.col("at") / slot))
    earlier = Window.partitionBy("url_key", "slot").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    within = seconds.withColumn("near", F.last("full", ignorenulls=True).over(earlier))
    slots = seconds.groupBy("url_key", "slot").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.col("at"))).alias("last"))
    before = Window.partitionBy("url_key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = slots.select("url_key", "slot", F.last("last", ignorenulls=True).over(before).alias("far")).filter("far is not null")
    answers = within.filter("asked").join(carried, ["url_key", "slot"], "left").select(
        F.concat(F.lit("k"), "url_key").alias("k"), F.col("at").alias("t"), F.coalesce("near", "far").alias("found")
    ).filter("found is not null")
    # a missing key meets nothing; it is spread by the record instead of meeting in one task
    key = F.coalesce(F.concat(F.lit("k"), "url_key"), F.concat(F.lit("n"), F.xxhash64("record_id", "at").cast("string")))
    found = seen.withColumn("key", key).join(answers, (F.col("key") == F.col("k")) & (F.col("at") == F.col("t")), "left")
    tag, time = F.col("visit.etag"), F.col("visit.last_modified")
    same = F.when(tag.isNotNull(), _tag(tag).eqNullSafe(_tag(F.col("found.etag")))).when(time.isNotNull(), time.eqNullSafe(F.col("found.last_modified")))
    state = F.when(F.col("found").isNull(), "missing").when(same.isNull(), "unproven").when(same, "resolved").otherwise("changed")
    found = found.withColumn("state", state)
    resolved = F.col("state") == "resolved"
    return found.select(
        "record_id", "url_key", "at", "state", F.col("found.record_id").alias("response_id"),
        F.when(resolved, F.col("found.digest")).alias("response_digest"),
        F.when(resolved, merge_headers(F.col("found.headers"), F.col("visit.headers"))).alias("merged_headers"),
    )


def records_of(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Responses and revisits that follow from a table of pages: each page is fetched once and asked for again.

    The second request comes up to 700 seconds later or up to 300 earlier, under another spelling of the URL. Its entity tag
    is the page's own, a wrong one (every fifth), or missing (every seventh); then its time of change is given, or not.
    """
    n = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    changed = (n - n % 50).cast("string")
    responses = pages.select(
        (2 * n).alias("record_id"), "url", n.alias("at"), tag.alias("etag"), changed.alias("last_modified"), F.sha1("html").alias("digest"),
        F.create_map(
            F.lit("etag"), tag, F.lit("last-modified"), changed, F.lit("content-length"), F.length("html").cast("string"),
            F.lit("content-type"), F.lit("text/html"), F.lit("cache-control"), F.lit("max-age=60"),
        ).alias("headers"),
    )
    own = F.when(n % 7 == 0, F.lit(None)).when(n % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))
    again = F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again"))
    revisits = pages.select(
        (2 * n + 1).alias("record_id"), again.alias("url"), (n + n * 7919 % 1000 - 300).alias("at"), own.alias("etag"),
        F.when(n % 3 == 0, changed).alias("last_modified"),
        F.create_map(
            F.lit("date"), n.cast("string"), F.lit("cache-control"), F.lit("max-age=120"), F.lit("content-length"), F.lit("0"),
        ).alias("headers"),
    )
    return responses, revisits


def report(pages: DataFrame) -> DataFrame:
    found = resolve(*records_of(pages))
    headers = F.array_join(F.transform(F.map_entries("merged_headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("record_id", "url_key", F.col("at").alias("seen_at"), "state", "response_id", "response_digest", headers.alias("merged_headers"))


#: The report in DuckDB.
ORACLE = r"""
with plain as (
  select page_id, html, regexp_replace(trim(url), '#.*$', '') as p from pages
), keyed as (
  select page_id, html, p,
    regexp_replace(regexp_replace(lower(regexp_extract(p, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') as host,
    regexp_replace(regexp_extract(p, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') as path,
    list_sort(list_filter(string_split(regexp_extract(p, '\?(.*)$', 1), '&'),
      lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)(=|$)', 'i'))) as q
  from plain
), named as (
  select page_id, html,
    case when host = '' then p else concat(host, path, case when len(q) > 0 then '?' || array_to_string(q, '&') else '' end) end as url_key,
    '"' || substr(md5(html), 1, 16) || '"' as tag, cast(page_id - page_id % 50 as varchar) as changed
  from keyed
), visits as (
  select 2 * page_id + 1 as record_id, url_key, page_id + page_id * 7919 % 1000 - 300 as seen_at, page_id,
    case when page_id % 7 = 0 then null when page_id % 5 = 0 then '"other"' else tag end as etag,
    case when page_id % 3 = 0 then changed end as last_modified
  from named
), last as (
  select url_key, page_id as seen_at, page_id, tag, changed, sha1(html) as digest, length(html) as n from named
), met as (
  select v.record_id, v.url_key, v.seen_at, v.page_id as visit, v.etag, v.last_modified, l.page_id as page, l.tag, l.changed, l.digest, l.n,
    case when l.page_id is null then 'missing'
         when v.etag is not null then case when v.etag = l.tag then 'resolved' else 'changed' end
         when v.last_modified is not null then case when v.last_modified = l.changed then 'resolved' else 'changed' end
         else 'unproven' end as state
  from visits v asof left join last l on v.url_key = l.url_key and v.seen_at > l.seen_at
)
select record_id, url_key, seen_at, state, 2 * page as response_id,
  case when state = 'resolved' then digest end as response_digest,
  case when state = 'resolved' then concat('cache-control=max-age=120;content-length=', n, ';content-type=text/html;date=', visit,
    ';etag=', tag, ';last-modified=', changed) end as merged_headers
from met
"""
