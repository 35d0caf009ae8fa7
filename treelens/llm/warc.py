"""Resolution of WARC not-modified revisits.

A revisit record (a 304 answer) has no payload: it stands for the latest full
response of the same canonical URL captured strictly earlier.  The as-of join
finds that response, its validators are checked against the revisit's, and the
headers that a 304 may renew are merged over the response's.

Scale: payloads take no part; only record heads move.  Records are range-sorted
by (URL, time), so a URL with a third of all records spreads over ranges; the
latest response is found within each range, and what a range inherits from
those before it is one row for each URL that crosses a border (at most two a
range, which bounds the broadcast).

Defined results: only `response` records are full and only `revisit` records are
resolved; records of any other kind (null too) pass through with status `other`
and are never an answer.  A record without a time, URL or host in its URL (blank
ones) matches nothing (`no_response` for revisits); a response of the same time as the revisit is not earlier; of
responses of one time the largest record id counts; a revisit without
validators is resolved as `unverified`; null headers count as none, names are
compared in lower case (of names that differ only in case the one sorted last
counts); repeated rows give a row each; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, materialize, partitions

RESPONSE, REVISIT = "response", "revisit"
#: fixed values: headers that a not-modified answer may renew
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary")
#: fixed values: query parameters that name no other resource
TRACKING = r"^(utm_[a-z]+|fbclid|gclid|ref|sessionid)=.*"


def canonical_url(url: Column) -> Column:
    """host/path?query: no scheme, user, `www.`, default port or fragment; lower-case
    host; no tracking parameters, the others sorted; no slash at the end of the path.
    Null where there is no host."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^www[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "^[^?]*[?](.*)$", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING)))), "&")
    return F.when(host != "", F.concat(host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def _lower_keys(headers: Column) -> Column:
    pairs = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(e["key"].alias("raw"), e["value"].alias("value"))))
    last = lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != F.lower(e["raw"])), F.create_map(F.lower(e["raw"]), e["value"]))
    return F.coalesce(F.aggregate(pairs, F.create_map().cast("map<string,string>"), last), F.create_map().cast("map<string,string>"))


def merge_headers(response: Column, revisit: Column) -> Column:
    """The response's headers with what the not-modified answer renews."""
    new = F.map_filter(revisit, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    old = F.map_filter(response, lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(old, new)


def _strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def _verdict(row: dict[str, Column]) -> Column:
    """`match`, `mismatch` or `unverified`: the first validator that both have."""
    def both(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, "match").otherwise("mismatch"))

    tag = both(_strong(row["own"]["etag"]), _strong(row["found"]["etag"]))
    time = both(row["own"]["last-modified"], row["found"]["last-modified"])
    digest = both(row["own_digest"], row["found_digest"])
    return F.coalesce(tag, time, digest, F.lit("unverified"))


def resolve_revisits(records: DataFrame, record_id: str = "record_id", kind: str = "kind", uri: str = "uri", ts: str = "ts", headers: str = "headers", digest: str = "digest") -> DataFrame:
    """One row a record: record_id, kind, ts, canonical, status (`full`,
    `resolved`, `unverified`, `mismatch`, `no_response`, `other`), response_id
    (of the full response that holds the payload), digest and headers (merged).

    On a mismatch the response is named but nothing is taken from it."""
    columns_of(records, record_id, kind, uri, ts, headers, digest)
    c = lambda n: F.col(f"`{n}`")
    role = F.when(c(kind) == RESPONSE, 1).when(c(kind) == REVISIT, 0)  # null: another kind
    # heads are written once: range sampling, dealing and the unmatched rest read them
    heads = materialize(records.select(
        c(record_id).alias("id"), c(kind).alias("kind"), c(ts).alias("ts"), canonical_url(c(uri)).alias("canonical"),
        _lower_keys(c(headers)).alias("headers"), c(digest).alias("digest"), role.alias("full"),
    ))
    can_match = F.col("canonical").isNotNull() & F.col("ts").isNotNull() & F.col("full").isNotNull()
    # a revisit sorts before the responses of its time: they are not earlier
    keys = ["canonical", "ts", "full", "id"]
    dealt = heads.where(can_match).repartitionByRange(partitions(records.sparkSession), *keys)
    dealt = materialize(dealt.withColumn("part", F.spark_partition_id()))
    response = F.when(F.col("full") == 1, F.struct("id", "headers", "digest"))
    place = F.when(F.col("full") == 1, F.struct("ts", "id"))
    before = Window.partitionBy("part", "canonical").orderBy("ts", "full", "id").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("found", F.last(response, ignorenulls=True).over(before))
    ends = dealt.groupBy("canonical", "part").agg(F.max_by(response, place).alias("last"))
    crossing = Window.partitionBy("canonical")
    # URLs in several ranges: at most two rows a range
    border = ends.withColumn("parts", F.count(F.lit(1)).over(crossing)).where("parts > 1")
    carried = border.select("canonical", "part", F.last("last", ignorenulls=True).over(crossing.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    joined = local.join(F.broadcast(carried.where(F.col("carried").isNotNull())), ["canonical", "part"], "left")
    asof = joined.withColumn("found", F.coalesce("found", "carried")).drop("carried", "part")
    nothing = asof.schema["found"].dataType
    every = asof.unionByName(heads.where(~can_match).withColumn("found", F.lit(None).cast(nothing)))
    verdict = _verdict({"own": F.col("headers"), "found": F.col("found")["headers"], "own_digest": F.col("digest"), "found_digest": F.col("found")["digest"]})
    status = F.when(F.col("full").isNull(), "other").when(F.col("full") == 1, "full").when(F.col("found").isNull(), "no_response").otherwise(F.when(verdict == "match", "resolved").otherwise(verdict))
    every = every.withColumn("status", status)
    taken = F.col("status").isin("resolved", "unverified")
    return every.select(
        F.col("id").alias(record_id), F.col("kind").alias(kind), F.col("ts").alias(ts), "canonical", "status",
        F.when(F.col("full") == 1, F.col("id")).otherwise(F.col("found")["id"]).alias("response_id"),
        F.when(taken, F.col("found")["digest"]).when(F.col("status").isin("full", "other"), F.col("digest")).alias(digest),
        F.when(taken, merge_headers(F.col("found")["headers"], F.col("headers"))).otherwise(F.col("headers")).alias(headers),
    )


def attach_payload(resolved: DataFrame, payloads: DataFrame, response_id: str = "response_id", key: str = "record_id", payload: str = "payload") -> DataFrame:
    """resolved with the payload of the response that each row stands for; only
    rows that took something from it.  Only wanted payloads are read."""
    bodies = payloads.select(F.col(f"`{key}`").alias(response_id), F.col(f"`{payload}`").alias(payload))
    wanted = resolved.where(F.col("status").isin("full", "resolved", "unverified"))
    return wanted.join(bodies, response_id, "left").unionByName(resolved.where(~F.col("status").isin("full", "resolved", "unverified")), allowMissingColumns=True)


def header_lines(headers: Column) -> Column:
    """name: value lines, sorted by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
