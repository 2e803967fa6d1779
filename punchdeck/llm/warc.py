"""WARC: resolution of not-modified revisit records.

A revisit record says that a URL had not changed; its content is that of the latest earlier full response of the
same canonical URL (an as-of join). Where both name a validator, an ETag or else a Last-Modified, it has to
agree; headers that a 304 response may update are merged over those of the full response.

The as-of join is made of aggregations and windows, without pairs: captures are cut into ``slices`` of time with about
as many captures in each, the same for all URLs, a window runs inside each (URL, slice), and the last full response of each slice is
carried to later slices by a window over at most ``slices`` rows of a URL. So a URL with a third of all captures
is spread over all slices. Bodies stay where they are: a result names the record that holds the body.

Cases: null URLs never resolve ("no-url"); captures of one URL at one time are ordered by record id and a
response is earlier than a revisit only with a smaller (time, record id); null times come first; repeated rows
stay; an empty table gives an empty result; columns that are not named below are not read; very long values are
carried whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from punchdeck.llm.common import written

# Header fields that a 304 response may update (RFC 9111 3.2, RFC 9110 15.4.5).
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
# Query parameters that name a visit, not a resource.
TRACKING = "utm_[a-z]+|ref|gclid|fbclid|sessionid"


def canonical(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without a trailing slash, no fragment, query without visit parameters and sorted."""
    parts = lambda k: F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)\??([^#]*)", k)
    host = F.regexp_replace(F.lower(parts(1)), r"^www\.|:(80|443)$", "")
    kept = F.array_sort(F.filter(F.split(parts(3), "&"), lambda p: (p != "") & ~p.rlike(rf"^(?i)({TRACKING})(=|$)")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(parts(1) != "", F.concat(host, F.regexp_replace(parts(2), "/+$", ""), query))


def header(name: str) -> Column:
    """A field of ``headers``, whose keys are compared without case; the first in order of the keys."""
    return F.expr(f"try_element_at(transform(filter(array_sort(map_entries(headers)), e -> lower(e.key) = '{name}'), e -> e.value), 1)")


def resolve(records: DataFrame, slices: int = 64) -> DataFrame:
    """``records(record_id long, url string, at long, kind string, headers map<string,string>)`` -> a row for each revisit.

    ``kind``: ``response`` for full responses, ``revisit`` for not-modified ones, others are ignored. Returns
    ``record_id, url_key, refers_to, status, headers``; status is one of ``resolved``, ``no-url``, ``no-response``,
    ``etag-differs``, ``date-differs``; ``refers_to`` and merged ``headers`` are null unless resolved.
    """
    kept = records.filter(F.col("kind").isin("response", "revisit")).select(
        "record_id", canonical(F.col("url")).alias("url_key"), "at", "kind",
        F.coalesce("headers", F.expr("map()").cast("map<string,string>")).alias("headers"),
    )
    kept = kept.withColumns({"etag": header("etag"), "modified": header("last-modified")})
    kept = written(kept, "captures")
    shares = [k / slices for k in range(1, slices)]
    bounds = sorted(set(kept.agg(F.percentile_approx("at", shares, 1000)).first()[0] or ()))  # one for each slice
    kept = kept.withColumn("slice", F.when(F.col("at").isNull(), -1).otherwise(sum((F.col("at") >= x).cast("int") for x in bounds) if bounds else F.lit(0)))

    full = F.struct("record_id", "at", "etag", "modified", "headers")
    own = F.when(F.col("kind") == "response", full)
    keyed = kept.filter("url_key is not null")
    inside = Window.partitionBy("url_key", "slice").orderBy(F.col("at").asc_nulls_first(), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    asked = keyed.withColumn("near", F.last(own, ignorenulls=True).over(inside)).filter("kind = 'revisit'")
    order = F.struct(F.col("at").isNotNull().alias("a"), F.coalesce("at", F.lit(0)).alias("b"), "record_id")
    lasts = keyed.filter("kind = 'response'").groupBy("url_key", "slice").agg(F.max_by(full, order).alias("last"))
    # a slice's carry is what the slices before it ended with; slices with revisits alone take part with a null
    grid = lasts.unionByName(asked.filter("near is null").select("url_key", "slice").distinct().withColumn("last", F.lit(None).cast(lasts.schema["last"].dataType)))
    grid = grid.groupBy("url_key", "slice").agg(F.max_by("last", F.col("last").isNotNull()).alias("last"))
    over = Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = grid.select("url_key", "slice", F.last("last", ignorenulls=True).over(over).alias("far")).filter("far is not null")
    met = asked.join(carry, ["url_key", "slice"], "left").withColumn("found", F.coalesce("near", "far")).drop("near", "far")

    tag = lambda c: F.regexp_replace(F.col(c), "^W/", "")  # noqa: E731  a 304 compares weakly
    status = (
        F.when(F.col("found").isNull(), "no-response")
        .when(tag("etag") != tag("found.etag"), "etag-differs")
        .when((F.col("etag").isNull() | F.col("found.etag").isNull()) & (F.col("modified") != F.col("found.modified")), "date-differs")
        .otherwise("resolved")
    )
    new = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]).isin(*PERMITTED))
    names = F.transform(new, lambda e: F.lower(e["key"]))
    old = F.filter(F.map_entries("found.headers"), lambda e: ~F.array_contains(names, F.lower(e["key"])))
    out = met.withColumn("status", status).select(
        "record_id", "url_key",
        F.when(F.col("status") == "resolved", F.col("found.record_id")).alias("refers_to"), "status",
        F.when(F.col("status") == "resolved", F.map_from_entries(F.concat(old, new))).alias("headers"),
    )
    lost = kept.filter("url_key is null and kind = 'revisit'").select("record_id", "url_key", F.lit(None).cast("long").alias("refers_to"), F.lit("no-url").alias("status"), F.lit(None).cast("map<string,string>").alias("headers"))
    return out.unionByName(lost)


def with_bodies(resolved: DataFrame, records: DataFrame, body_column: str = "body") -> DataFrame:
    """Adds the body of the response that each resolved revisit refers to."""
    bodies = records.select(F.col("record_id").alias("refers_to"), F.col(body_column).alias("body"))
    return resolved.join(bodies, "refers_to", "left")
