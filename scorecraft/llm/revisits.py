"""WARC: not-modified revisits resolved to the full responses they stand for.

A revisit record says that the server found nothing new.  It is joined, by canonical URL and
as of its time, to the latest earlier full response; if their validators agree, the page as
of then is that response's payload under its headers, updated by the permitted headers of
the revisit.

Latest responses are found within slots of time, on top of the latest of the slots before,
so that one URL with very many captures is spread over as many tasks as it has slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorecraft.llm.store import table

#: The headers that a not-modified response may update.
PERMITTED = (
    "age",
    "cache-control",
    "content-location",
    "date",
    "etag",
    "expires",
    "last-modified",
    "vary",
)
SLOT_ROWS = 20_000


def canonical_url(url: Column) -> Column:
    """One key for the spellings of a URL.

    Without scheme, ``www.``, default port, fragment, tracking parameters (``utm_*`` and
    ``ref``) and closing slash; ASCII letters of the host in lower case.  Null stays null.
    """
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), "#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    tail = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    path = F.regexp_replace(F.regexp_extract(tail, r"^([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(tail, r"\?(.*)$", 1)
    kept = F.array_join(
        F.array_sort(
            F.filter(F.split(query, "&"), lambda p: ~F.rlike(p, F.lit(r"^(utm_[^=]*|ref)(=|$)")) & (p != ""))
        ),
        "&",
    )
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def merged_headers(stored_: Column, update: Column) -> Column:
    """Header lists ``array<struct<name, value>>``: stored ones, replaced by permitted updates.

    Names are compared in lower case; a name may repeat.  Sorted by name and value.
    """
    low = lambda c: F.transform(
        F.coalesce(c, F.array().cast("array<struct<name:string,value:string>>")),
        lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value")),
    )
    new = F.filter(low(update), lambda h: h["name"].isin(*PERMITTED))
    names = F.transform(new, lambda h: h["name"])
    old = F.filter(low(stored_), lambda h: ~F.array_contains(names, h["name"]))
    return F.array_sort(F.concat(old, new))


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit: ``record_id, url_key, refers_to, outcome, status, headers, payload_digest``.

    ``records`` has ``record_id`` (long, unique), ``kind`` (``response`` or ``revisit``),
    ``url``, ``captured_at`` (long), ``status``, ``etag``, ``last_modified``, ``headers``
    and ``payload_digest``.  Outcomes: ``resolved``; ``no_response`` (no strictly earlier
    full response of the URL, or URL or time is null); ``no_validator`` (no validator is
    known on both sides); ``mismatch`` (entity tags, compared weakly, or else dates of last
    change differ).  Only resolved revisits get status, headers and digest.  Of responses
    captured at the same time the one with the larger id counts as later.  Other kinds and
    columns are left out.
    """
    key = canonical_url(F.col("url"))
    narrow = records.where(F.col("kind").isin("response", "revisit")).select(
        "record_id", "kind", key.alias("url_key"), "captured_at", "etag", "last_modified"
    )
    span = narrow.agg(
        F.count(F.lit(1)).alias("n"), F.min("captured_at").alias("low"), F.max("captured_at").alias("high")
    ).first()
    slots = max(1, span["n"] // SLOT_ROWS)
    low = span["low"] or 0
    width = max(1, -(-((span["high"] or 0) - low + 1) // slots))
    timed = narrow.withColumn("slot", F.floor((F.col("captured_at") - low) / width))

    full = F.when(
        (F.col("kind") == "response") & F.col("url_key").isNotNull() & F.col("captured_at").isNotNull(),
        F.struct("captured_at", "record_id"),
    )
    earlier_slots = Window.partitionBy("url_key").orderBy("slot").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = (
        timed.where("url_key is not null and slot is not null")
        .groupBy("url_key", "slot")
        .agg(F.max(full).alias("last"))
        .withColumn("carried", F.max("last").over(earlier_slots))
        .select("url_key", "slot", "carried")
    )
    # a revisit stands before the responses of its own second: strictly earlier ones only
    within = (
        Window.partitionBy("url_key", "slot")
        .orderBy("captured_at")
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    revisits = (
        timed.where("url_key is not null and slot is not null")
        .withColumn("here", F.max(full).over(within))
        .where("kind = 'revisit'")
        .join(carried, ["url_key", "slot"])
        .select("record_id", "url_key", "etag", "last_modified", F.coalesce("here", "carried")["record_id"].alias("refers_to"))
    )
    lost = timed.where("kind = 'revisit' and (url_key is null or slot is null)").select(
        "record_id", "url_key", "etag", "last_modified", F.lit(None).cast("long").alias("refers_to")
    )
    asked = revisits.unionByName(lost)

    responses = records.where("kind = 'response'").select(
        F.col("record_id").alias("response_id"),
        F.col("status").alias("full_status"),
        F.col("etag").alias("full_etag"),
        F.col("last_modified").alias("full_modified"),
        F.col("headers").alias("full_headers"),
        F.col("payload_digest").alias("full_digest"),
    )
    updates = records.where("kind = 'revisit'").select("record_id", F.col("headers").alias("update"))
    weak = lambda tag: F.regexp_replace(tag, "^W/", "")
    tags = F.col("etag").isNotNull() & F.col("full_etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("full_modified").isNotNull()
    outcome = (
        F.when(F.col("response_id").isNull(), "no_response")
        .when(tags, F.when(weak(F.col("etag")) == weak(F.col("full_etag")), "resolved").otherwise("mismatch"))
        .when(dates, F.when(F.col("last_modified") == F.col("full_modified"), "resolved").otherwise("mismatch"))
        .otherwise("no_validator")
    )
    good = F.col("outcome") == "resolved"
    return (
        asked.join(responses, F.col("refers_to") == F.col("response_id"), "left")
        .join(updates, "record_id")
        .withColumn("outcome", outcome)
        .select(
            "record_id",
            "url_key",
            "refers_to",
            "outcome",
            F.when(good, F.col("full_status")).alias("status"),
            F.when(good, merged_headers(F.col("full_headers"), F.col("update"))).alias("headers"),
            F.when(good, F.col("full_digest")).alias("payload_digest"),
        )
    )


def records_of(pages: DataFrame) -> DataFrame:
    """Capture records derived from pages: for each one, in the order of ids, a full response,
    a revisit just before it (an earlier crawl knew the page) and one long after it.

    The entity tag is the page's checksum, so of pages with one canonical URL the later
    revisit meets the last response's tag, and the earlier one the previous page's.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    at = F.col("page_id") * 10
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    kept = pages.select("page_id", "url", at.alias("at"), tag.alias("tag"), F.octet_length("html").alias("size"))

    def record(shift: int, kind: str, time: Column, status: int, etag: Column, *extra: Column) -> Column:
        return F.struct(
            (F.col("page_id") * 3 + shift).alias("record_id"),
            F.lit(kind).alias("kind"),
            time.alias("captured_at"),
            F.lit(status).alias("status"),
            etag.alias("etag"),
            F.lit(None).cast("string").alias("last_modified"),
            F.array(header("Date", time), header("ETag", etag), *extra).alias("headers"),
            F.when(F.lit(kind == "response"), F.substring("tag", 2, 32)).alias("payload_digest"),
        )

    weak = F.concat(F.lit("W/"), F.col("tag"))
    length = header("Content-Length", F.coalesce("size", F.lit(0)))
    age = header("Cache-Control", F.lit("max-age=60"))
    server = header("Server", F.lit("crawl"))
    rows = F.array(
        record(0, "revisit", F.col("at") - 1, 304, F.col("tag"), age, server),
        record(1, "response", F.col("at"), 200, F.col("tag"), length, server),
        record(2, "revisit", F.col("at") + 1_000_000_000, 304, weak, age, header("Content-Length", F.lit(0))),
    )
    return kept.select("url", F.explode(rows).alias("r")).select("url", "r.*")


def op6_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit derived from the pages, headers as lines of text."""
    lines = F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    return resolve(records_of(table(spark, sf_dir, "pages"))).withColumn(
        "headers", F.array_join(lines, "\n")
    )


OP6_SQL = r"""
WITH cut AS (
  SELECT page_id, html, url,
         regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\-]*://', ''), '#.*$', '') AS rest,
         '"' || md5(coalesce(html, '')) || '"' AS tag, coalesce(strlen(html), 0) AS size
  FROM pages),
parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
         regexp_extract(rest, '^[^/?]*(.*)$', 1) AS tail FROM cut),
keyed AS (
  SELECT *, regexp_replace(regexp_extract(tail, '^([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(tail, '\?(.*)$', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)'))), '&') AS query FROM parts),
named AS (SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key FROM keyed),
responses AS (SELECT url_key, page_id * 10 AS t, page_id * 3 + 1 AS response_id, tag, size FROM named),
revisits AS (
  SELECT page_id * 3 AS record_id, url_key, page_id * 10 - 1 AS t, tag AS etag, tag FROM named
  UNION ALL
  SELECT page_id * 3 + 2, url_key, page_id * 10 + 1000000000, 'W/' || tag, tag FROM named),
joined AS (
  SELECT v.*, r.response_id, r.tag AS full_tag, r.size FROM revisits v
  LEFT JOIN LATERAL (
    SELECT response_id, tag, size FROM responses r
    WHERE r.url_key = v.url_key AND r.t < v.t ORDER BY r.t DESC, response_id DESC LIMIT 1) r ON true)
SELECT record_id, url_key, response_id AS refers_to,
       CASE WHEN response_id IS NULL THEN 'no_response' WHEN tag = full_tag THEN 'resolved' ELSE 'mismatch' END AS outcome,
       CASE WHEN tag = full_tag THEN 200 END AS status,
       CASE WHEN tag = full_tag THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || size || chr(10)
         || 'date: ' || t || chr(10) || 'etag: ' || etag || chr(10) || 'server: crawl' END AS headers,
       CASE WHEN tag = full_tag THEN substr(full_tag, 2, 32) END AS payload_digest
FROM joined
"""
