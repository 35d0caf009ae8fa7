"""op2: the captures of `pages` as WARC record heads, and their resolution.

Every page was answered in full at page_id * 1000.  Its URL was asked again and
not modified; the remainder of the length of html by 6 says how:

0  by the entity tag of that answer, in its weak form
1  by its time of modification
2  by the digest of its payload
3  without any validator
4  by an entity tag that no answer has
5  by the entity tag, but 500 before the answer

Those of 0 to 4 were asked 500 + (length modulo 50) * 1000 after the answer.
Where another page of the same canonical URL was answered in between, the
validator is checked against that answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc


def _headers(*pairs) -> Column:
    """A map of the pairs whose value is not null."""
    made = F.map_from_arrays(F.array(*(F.lit(k) for k, _ in pairs)), F.array(*(v.cast("string") for _, v in pairs)))
    return F.map_filter(made, lambda _, v: v.isNotNull())


def records_of(pages: DataFrame) -> DataFrame:
    body = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", "url", F.md5(body).alias("digest"), F.char_length(body).alias("n"), (F.col("page_id") * 1000).alias("asked"))
    way = F.col("n") % 6
    later = F.when(way == 5, F.col("asked") - 500).otherwise(F.col("asked") + 500 + F.col("n") % 50 * 1000)
    tag = F.when(way.isin(0, 5), F.concat(F.lit("W/"), F.col("digest"))).when(way == 4, F.concat(F.lit("old-"), F.col("digest")))
    answer = _headers(
        ("Content-Type", F.lit("text/html")), ("Content-Length", F.col("n")), ("ETag", F.col("digest")), ("Date", F.col("asked")),
        ("Last-Modified", F.col("asked")), ("Cache-Control", F.lit("max-age=60")),
    )
    again = _headers(("Content-Length", F.lit(0)), ("ETag", tag), ("Date", later), ("Last-Modified", F.when(way == 1, F.col("asked"))), ("Expires", later + 60))
    full = base.select(
        (F.col("page_id") * 2).alias("record_id"), F.lit(warc.RESPONSE).alias("kind"), F.col("url").alias("uri"), F.col("asked").alias("ts"),
        answer.alias("headers"), "digest",
    )
    revisit = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), F.lit(warc.REVISIT).alias("kind"), F.col("url").alias("uri"), later.alias("ts"),
        again.alias("headers"), F.when(way == 2, F.col("digest")).alias("digest"),
    )
    return full.unionByName(revisit)


def op2_warc_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the captures with its resolution."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = warc.resolve_revisits(records_of(pages))
    return found.select("record_id", "kind", "ts", "canonical", "status", "response_id", "digest", warc.header_lines(F.col("headers")).alias("header_lines"))


ORACLE = r"""
WITH base AS (
  SELECT page_id, md5(coalesce(html, '')) AS digest, length(coalesce(html, '')) AS n,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS rest
  FROM pages
), urls AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www[.]', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*[?](.*)$', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|fbclid|gclid|ref|sessionid)=.*'))) AS params
  FROM base
), canon AS (
  SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN len(params) = 0 THEN '' ELSE '?' || array_to_string(params, '&') END END AS canonical,
         page_id * 1000 AS asked, CASE WHEN n % 6 = 5 THEN page_id * 1000 - 500 ELSE page_id * 1000 + 500 + n % 50 * 1000 END AS later,
         CASE WHEN n % 6 IN (0, 5) THEN 'W/' || digest WHEN n % 6 = 4 THEN 'old-' || digest END AS tag,
         CASE WHEN n % 6 = 1 THEN page_id * 1000 END AS since
  FROM urls
), records AS (
  SELECT page_id * 2 AS record_id, 'response' AS kind, asked AS ts, canonical, digest, n, digest AS tag, asked AS since, 1 AS fully FROM canon
  UNION ALL
  SELECT page_id * 2 + 1, 'revisit', later, canonical, CASE WHEN n % 6 = 2 THEN digest END, n, tag, since, 0 FROM canon
), latest AS (
  SELECT *, CASE WHEN canonical IS NOT NULL THEN last_value(CASE WHEN fully = 1 THEN {'id': record_id, 'digest': digest, 'n': n, 'since': since} END IGNORE NULLS) OVER (
    PARTITION BY canonical ORDER BY ts, fully, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS found
  FROM records
), judged AS (
  SELECT *, CASE WHEN fully = 1 THEN 'full' WHEN found IS NULL THEN 'no_response'
                 WHEN tag IS NOT NULL THEN CASE WHEN regexp_replace(tag, '^W/', '') = found.digest THEN 'resolved' ELSE 'mismatch' END
                 WHEN since IS NOT NULL THEN CASE WHEN since = found.since THEN 'resolved' ELSE 'mismatch' END
                 WHEN digest IS NOT NULL THEN CASE WHEN digest = found.digest THEN 'resolved' ELSE 'mismatch' END
                 ELSE 'unverified' END AS status
  FROM latest
)
SELECT record_id, kind, ts, canonical, status,
  CASE WHEN fully = 1 THEN record_id ELSE found.id END AS response_id,
  CASE WHEN fully = 1 THEN digest WHEN status IN ('resolved', 'unverified') THEN found.digest END AS digest,
  CASE WHEN fully = 1 THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10)
                           || 'etag: ' || tag || chr(10) || 'last-modified: ' || since
       WHEN status IN ('resolved', 'unverified') THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || found.n || chr(10) || 'content-type: text/html' || chr(10)
                           || 'date: ' || ts || chr(10) || 'etag: ' || coalesce(tag, found.digest) || chr(10) || 'expires: ' || (ts + 60) || chr(10)
                           || 'last-modified: ' || coalesce(since, found.since)
       ELSE 'content-length: 0' || chr(10) || 'date: ' || ts || coalesce(chr(10) || 'etag: ' || tag, '') || chr(10) || 'expires: ' || (ts + 60)
            || coalesce(chr(10) || 'last-modified: ' || since, '') END AS header_lines
FROM judged
"""
