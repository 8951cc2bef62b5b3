"""WARC not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

A revisit record (a 304 answer) stands for the payload of a response that came before. It is resolved by the latest
response of its canonical URL with an earlier time, of several at one time the one of the highest id, if their
validators agree; the response's headers are then updated by those of the revisit that a 304 may carry.

The join is two window steps: within a URL and a bucket of time (a day) the latest earlier response is a running maximum,
and from earlier buckets it is one over a row per bucket. So a URL with a third of all rows is as many tasks as it has
buckets; rows without a URL or a time, which nothing can resolve, take no part in the steps. Headers go along whole.

Records have record_id, url, ts (long), kind (`response` or `revisit`), etag, last_modified, digest and headers (a map);
other columns are not read. A null url or time has no earlier response and is none. Null validators are absent; null
headers are empty. Repeated rows each get a result; ties are broken as said. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .url_filter import ascii_lower

#: Seconds of a bucket.
BUCKET = 86_400
#: The headers that a 304 answer may update (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, no default port, no fragment, / for an empty path."""
    plain = F.regexp_replace(url, r"(?s)#.*\z", "")
    scheme = ascii_lower(F.regexp_extract(plain, r"(?s)\A([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = ascii_lower(F.regexp_extract(plain, r"(?s)\A[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    rest = F.regexp_extract(plain, r"(?s)\A[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)\z", 1)
    port = F.when(scheme == "http", F.regexp_replace(host, r":80\z", "")).when(scheme == "https", F.regexp_replace(host, r":443\z", "")).otherwise(host)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(scheme == "", plain).otherwise(F.concat(scheme, F.lit("://"), port, rest))


def _entries(headers: Column) -> Column:
    """A map's entries, names in lower case, by name."""
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(ascii_lower(e["key"]).alias("key"), e["value"].alias("value")))
    return F.coalesce(F.array_sort(pairs), F.array().cast("array<struct<key:string,value:string>>"))


def merge_headers(stored: Column, new: Column) -> Column:
    """Stored entries with those of the new ones that are permitted in place of the same names."""
    allowed = F.filter(new, lambda e: e["key"].isin(*PERMITTED))
    names = F.transform(allowed, lambda e: e["key"])
    return F.array_sort(F.concat(F.filter(stored, lambda e: ~F.array_contains(names, e["key"])), allowed))


def resolve_revisits(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Per revisit: record_id, url_key, response_id, outcome and headers (entries by name, merged if resolved).

    outcome is resolved, no_earlier_response, no_validator (no kind of validator on both sides) or validator_mismatch.
    Entity tags decide where both sides have one (weakly compared), else modification dates, else digests.
    """
    row = records.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), (F.col("kind") == "response").alias("full"), F.col("kind").alias("kind"),
        F.regexp_replace("etag", r"\AW/", "").alias("etag"), "last_modified", "digest", _entries(F.col("headers")).alias("headers"),
    ).withColumn("bucket", F.floor(F.col("ts") / bucket))
    usable = F.col("full")
    state = F.when(usable, F.struct("ts", "record_id", "etag", "last_modified", "digest", "headers"))
    within = Window.partitionBy("url_key", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    keyed = row.where("url_key IS NOT NULL AND ts IS NOT NULL")
    inside = keyed.withColumn("near", F.max(state).over(within)).where("kind = 'revisit'")
    last = keyed.where(usable).groupBy("url_key", "bucket").agg(F.max(state).alias("last"))
    # a row for each bucket with a response, and for each with a revisit
    asked = keyed.where("kind = 'revisit'").select("url_key", "bucket").distinct().join(last, ["url_key", "bucket"], "full_outer")
    before = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = asked.select("url_key", "bucket", F.max("last").over(before).alias("far"))
    found = inside.join(earlier, ["url_key", "bucket"], "left").select(*row.columns, F.coalesce("near", "far").alias("found"))
    alone = row.where("kind = 'revisit' AND (url_key IS NULL OR ts IS NULL)")
    found = found.unionByName(alone.withColumn("found", F.lit(None).cast(found.schema["found"].dataType)))
    same = F.lit(None).cast("boolean")
    for name in ("digest", "last_modified", "etag"):
        same = F.when(F.col(name).isNotNull() & F.col(f"found.{name}").isNotNull(), F.col(name) == F.col(f"found.{name}")).otherwise(same)
    outcome = F.when(F.col("found").isNull(), "no_earlier_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("validator_mismatch")
    merged = F.when(outcome == "resolved", merge_headers(F.col("found.headers"), F.col("headers"))).otherwise(F.col("headers"))
    return found.select("record_id", "url_key", F.col("found.record_id").alias("response_id"), outcome.alias("outcome"), merged.alias("headers"))
