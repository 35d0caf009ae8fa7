"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base kinds are found by fixed patterns.  Positions come from the text between
matches: `split` and `regexp_extract_all` with one pattern give gaps and
matches, whose running lengths (code points) are the spans.

The method: the value of every base match and every long mixed token anywhere in
the corpus is a candidate.  Its hash is counted over distinct owners and distinct
repositories.  A value that many owners or very many repositories have is a
copied example; a token of at most MAX_OWNERS owners and MAX_REPOS repositories
is live-looking, and all its occurrences, with or without a keyword beside them,
become spans of kind `owned`.  Base spans stay whatever their counts; they carry
them, so that copied examples can be told from live values among them too.

Scale: texts are scanned where they are read and never shuffled; only matches
move.  Documents without matches take no part in any exchange.  Counts combine
before they are shuffled.  Values that very many matches have are joined with
their counts by broadcast of those few, the others by a shuffle.

Defined results: a null text counts as empty (no spans); null owners and null
repositories count as one owner or repository each; repeated rows give a row
each and count as one repository; an empty table gives no rows; other columns
of the input are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, free_names, join_counted, materialize

#: fixed values: the base kinds in their order, pattern, group of the value
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    ("access", r"AKIA[A-Z0-9]{12,}", 0),
    ("hex", r"[0-9a-f]{32,}", 0),
)
MIN_VALUE = 8
#: candidates of the method: long tokens with letters and digits
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
OWNED = len(KINDS)
NAMES = [k for k, _, _ in KINDS] + ["owned"]
MAX_OWNERS, MAX_REPOS = 2, 100
MIN_DISTINCT_CHARS = 8
#: fixed values: what a text with a match of `assign` or `access` holds (lower case)
HINTS = (("password", "passwd", "secret", "token", "apikey", "api_key"), ("akia",))


def _matches(text: Column, kind: int, pattern: str, group: int) -> Column:
    """Array of (kind, i, gap, len, value) of the matches of one pattern."""
    p = F.lit(pattern)
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("whole"))
    # a match found again in itself has the same groups
    value = (lambda whole: F.regexp_extract(whole, pattern, group)) if group else (lambda whole: whole)
    rows = F.transform(
        F.filter(parts, lambda z: z["whole"].isNotNull()),
        lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.char_length(z["gap"]).alias("gap"), F.char_length(z["whole"]).alias("len"), value(z["whole"]).alias("value")),
    )
    some = F.rlike(text, p)
    if kind < len(HINTS):  # plain searches first: they are cheaper than a pattern
        small = F.lower(text)
        some = reduce(or_, (F.contains(small, F.lit(h)) for h in HINTS[kind])) & some
    return F.when(some, rows)


def _candidates(docs: DataFrame, id_col: str, text: str, owner: str, repo: str) -> DataFrame:
    """One row a document: rid, id, owner, repo, found (array, null if none)."""
    columns_of(docs, id_col, text, owner, repo)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    scanned = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{owner}`").cast("string").alias("owner"), F.col(f"`{repo}`").cast("string").alias("repo"),
        *(_matches(body, k, p, g).alias(f"k{k}") for k, (_, p, g) in enumerate(KINDS)),
        _matches(body, OWNED, TOKEN, 0).alias(f"k{OWNED}"),
    )
    some = [F.coalesce(F.col(f"k{k}"), F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,value:string>>")) for k in range(OWNED + 1)]
    any_found = F.coalesce(*(F.col(f"k{k}") for k in range(OWNED + 1))).isNotNull()
    return materialize(scanned.select(F.monotonically_increasing_id().alias("rid"), "id", "owner", "repo", F.when(any_found, F.concat(*some)).alias("found")))


def _located(found: DataFrame) -> DataFrame:
    """One row a match, with start and end in code points."""
    rows = found.where(F.col("found").isNotNull()).select("rid", "id", "owner", "repo", F.inline("found"))
    order = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order)).withColumn("start", F.col("end") - F.col("len"))
    short = (F.col("kind") == 0) & (F.char_length("value") < MIN_VALUE)
    return rows.where(~short).select("rid", "id", "owner", "repo", "kind", "start", "end", "value")


def _looks_live(value: Column) -> Column:
    chars = F.array_remove(F.array_distinct(F.split(value, "")), "")
    return F.rlike(value, F.lit("[0-9]")) & F.rlike(value, F.lit("[A-Za-z]")) & (F.size(chars) >= MIN_DISTINCT_CHARS)


def _valued(located: DataFrame) -> DataFrame:
    """The matches with the hash of their value; bare tokens that don't look live go."""
    return located.where((F.col("kind") < OWNED) | _looks_live(F.col("value"))).withColumn("hash", F.unhex(F.sha2("value", 256)))


def _frequency(valued: DataFrame) -> DataFrame:
    """hash, n_rows, n_seen, n_repos, n_owners: how many matches have the value,
    at how many places, in how many repositories, of how many owners; distinct
    counts by one level at a time.  Matches of two kinds that end at one place
    are one place."""
    by_place = valued.groupBy("hash", "owner", "repo", "rid", "end").agg(F.count(F.lit(1)).alias("n_rows"))
    by_repo = by_place.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("n_rows"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows"))
    return by_owner.groupBy("hash").agg(F.sum("n_rows").alias("n_rows"), F.sum("n").alias("n_seen"), F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def ownership(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """(hash, n_seen, n_repos, n_owners) of every candidate value of the corpus."""
    return _frequency(_valued(_located(_candidates(docs, id_col, text, owner, repo)))).drop("n_rows")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", repo: str = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row a document: id, n_assign, n_access, n_hex, n_owned (long) and
    spans: array<struct<start,kind,end,n_owners,n_repos>> by start, then kind.

    kind numbers NAMES; n_owners and n_repos count the span's value."""
    found = _candidates(docs, id_col, text, owner, repo)
    valued = materialize(_valued(_located(found)))
    counts = materialize(_frequency(valued).select("hash", "n_rows", "n_owners", "n_repos"))
    counted = join_counted(valued, counts, "hash", "n_rows")
    every = counted.where((F.col("kind") < OWNED) | ((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)))
    n = lambda k: F.count(F.when(F.col("kind") == k, 1))
    with_spans = every.groupBy("rid").agg(
        *(n(k).alias(f"n_{name}") for k, name in enumerate(NAMES)),
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "n_owners", "n_repos"))).alias("spans"),
    )
    some = found.where(F.col("found").isNotNull()).select("rid", "id").join(with_spans.hint("merge"), "rid", "left")
    kind = "array<struct<start:bigint,kind:int,end:bigint,n_owners:bigint,n_repos:bigint>>"
    none = found.where(F.col("found").isNull()).select("id", *(F.lit(0).cast("long").alias(f"n_{k}") for k in NAMES), F.array().cast(kind).alias("spans"))
    some = some.select("id", *(F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in NAMES), F.coalesce("spans", F.array().cast(kind)).alias("spans"))
    out = some.unionByName(none)
    return out.toDF(id_col, *free_names([id_col], *out.columns[1:]))


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(x) for x in NAMES))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["kind"] < OWNED)


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with each maximal run of overlapping spans replaced by mark."""
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        inside = s["start"] < acc["at"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(inside, acc["parts"]).otherwise(F.concat(acc["parts"], F.array(gap, F.lit(mark)))).alias("parts"),
        )

    rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, state, step, rest))


def redact_secrets(docs: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, mark: str = "[SECRET]") -> DataFrame:
    """docs, all columns, with every span of scan_secrets replaced by mark
    (`n_chars` follows where it exists)."""
    rid, own = free_names(docs, "rid", "found_spans")
    rows = materialize(docs.withColumn(rid, F.monotonically_increasing_id()))
    plain = rows.select(*(F.col(f"`{c}`").alias(n) for c, n in ((rid, "rid"), (text, "text"), (owner, "owner"), (repo, "repo"))))
    found = scan_secrets(plain, "rid", "text", "owner", "repo", max_owners, max_repos).where(F.size("spans") > 0).select(F.col("rid").alias(rid), F.col("spans").alias(own))
    joined = rows.join(found.hint("merge"), rid, "left")
    new = F.when(F.col(own).isNull(), F.col(f"`{text}`")).otherwise(redact(F.col(f"`{text}`"), F.col(own), mark))
    change = {text: new}
    if "n_chars" in docs.columns and text != "n_chars":
        kind = docs.schema["n_chars"].dataType
        change["n_chars"] = F.when(F.col(own).isNull(), F.col("n_chars")).otherwise(F.char_length(new).cast(kind))
    return joined.select(*(change[c].alias(c) if c in change else F.col(f"`{c}`") for c in docs.columns))
