"""Resolve not-modified revisits of a web archive to the response that they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.runtime import ascii_lower

#: Query parameters that name a visit, not a page.
VISIT_PARAMETERS = "^(utm_[a-z]+|ref|sessionid|fbclid|gclid)="
#: Headers of a 304 that must not replace those of the stored response (RFC 9110 and 9111):
#: they describe the message or the hop, or the stored body.
FIXED_HEADERS = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]
#: Rows that a bucket of time should hold over all URLs.
BUCKET_ROWS = 20_000
#: Quantiles of the time at most, between which buckets are cut; more buckets are equal parts of these.
QUANTILES = 256


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased, default port and fragment dropped, an empty path made /, query
    parameters sorted without those of a visit, no slash at the end of a longer path."""
    whole = F.regexp_replace(F.btrim(url), "#.*$", "")
    scheme = ascii_lower(F.regexp_extract(whole, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = ascii_lower(F.regexp_extract(whole, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    port = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_extract(whole, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1)
    path = F.when(path == "", "/").when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.split(F.regexp_extract(whole, "\\?(.*)$", 1), "&", -1)
    kept = F.array_join(F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(VISIT_PARAMETERS))), "&")
    return F.when(scheme == "", whole).otherwise(F.concat(scheme, F.lit("://"), port, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def merge_headers(stored: Column, newer: Column) -> Column:
    """The stored headers with those of a 304 that may replace them (names in lower case)."""
    free = F.map_filter(F.coalesce(newer, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(FIXED_HEADERS))
    rest = F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(F.map_keys(free), k))
    return F.map_concat(rest, free)


def _bucket(captures: DataFrame) -> Column:
    """A bucket that does not decrease with ``fetched_at``: its place among the quantiles of all
    captures' times, then, where QUANTILES are too few, equal parts of the time between two."""
    time = F.col("fetched_at").cast("long")
    low, high, n, cuts = captures.agg(
        F.min(time), F.max(time), F.count(time), F.percentile_approx(time, [k / QUANTILES for k in range(1, QUANTILES)])
    ).first()
    wanted = min(QUANTILES, n // BUCKET_ROWS)
    if wanted < 2:
        return F.struct(F.lit(0).alias("quantile"), F.lit(0).cast("long").alias("part"))
    starts = sorted({low, *[cuts[QUANTILES * k // wanted - 1] for k in range(1, wanted)]})
    parts = max(1, n // (BUCKET_ROWS * len(starts)))
    widths = [max(1, (b - a) // parts) for a, b in zip(starts, [*starts[1:], high + 1])]
    at = F.size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= time)) - 1
    of = lambda values: F.get(F.array(*[F.lit(v).cast("long") for v in values]), at)
    return F.struct(at.alias("quantile"), F.floor((time - of(starts)) / of(widths)).alias("part"))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """One row a revisit: (``record_id``, ``url_key``, ``fetched_at``, ``outcome``, ``refers_to``,
    ``digest``, ``headers`` map).

    ``captures`` has record_id, url, fetched_at (long, never decreasing time), status int, etag,
    last_modified, digest strings and headers map<string,string> with names in lower case. Status
    200 is a full response, 304 a revisit, others are ignored. A revisit refers to the latest full
    response of its canonical URL at a strictly earlier time; among equal times the largest
    record_id. Outcome: ``resolved``; ``mismatch`` if both have an etag and these differ (weak
    prefixes apart), or, where either lacks one, both have a last_modified and these differ;
    ``unmatched`` without an earlier response. Only a resolved revisit gets the digest and the
    merged headers. A null URL or time is unmatched; repeated rows are resolved one by one; other
    columns are ignored; an empty table gives an empty table.

    A URL may hold most of the captures. So time is cut at its quantiles into buckets of about
    BUCKET_ROWS captures over all URLs, however unevenly captures lie in time; within (URL,
    bucket) the latest response is carried forward by a window, and only one row a (URL, bucket)
    is carried along the whole URL.
    """
    rows = captures.where(F.col("status").isin(200, 304)).select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), F.col("fetched_at").cast("long").alias("fetched_at"), "status",
        F.struct("record_id", "etag", "last_modified", "digest", "headers").alias("own"),
    )
    keyed = rows.where("url_key is not null and fetched_at is not null").withColumn("bucket", _bucket(captures))
    answer = F.when(F.col("status") == 200, F.col("own"))
    place = F.when(F.col("status") == 200, F.struct("fetched_at", "record_id"))
    latest = keyed.where("status = 200").groupBy("url_key", "bucket").agg(F.max_by("own", F.struct("fetched_at", "record_id")).alias("last"))
    every = keyed.select("url_key", "bucket").distinct().join(latest, ["url_key", "bucket"], "left")
    ahead = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("url_key", "bucket", F.last("last", True).over(ahead).alias("carried"))
    # RANGE up to the unit before: a response of the same time is not earlier.
    earlier = Window.partitionBy("url_key", "bucket").orderBy("fetched_at").rangeBetween(Window.unboundedPreceding, -1)
    near = F.max_by(answer, place).over(earlier)
    found = keyed.withColumn("near", near).where("status = 304").join(carried, ["url_key", "bucket"])
    known = found.select("record_id", "url_key", "fetched_at", "own", F.coalesce("near", "carried").alias("to"))
    lost = rows.where("status = 304 and (url_key is null or fetched_at is null)")
    known = known.unionByName(lost.select("record_id", "url_key", "fetched_at", "own", F.lit(None).cast(known.schema["to"].dataType).alias("to")))
    bare = lambda c: F.regexp_replace(c, "^W/", "")
    other_tag = F.when(F.col("own.etag").isNotNull() & F.col("to.etag").isNotNull(), bare(F.col("own.etag")) != bare(F.col("to.etag")))
    other_date = F.when(F.col("own.last_modified").isNotNull() & F.col("to.last_modified").isNotNull(), F.col("own.last_modified") != F.col("to.last_modified"))
    outcome = F.when(F.col("to").isNull(), "unmatched").when(F.coalesce(other_tag, other_date, F.lit(False)), "mismatch").otherwise("resolved")
    ok = F.col("outcome") == "resolved"
    return known.withColumn("outcome", outcome).select(
        "record_id", "url_key", "fetched_at", "outcome",
        F.col("to.record_id").alias("refers_to"),
        F.when(ok, F.col("to.digest")).alias("digest"),
        F.when(ok, merge_headers(F.col("to.headers"), F.col("own.headers"))).alias("headers"),
    )
