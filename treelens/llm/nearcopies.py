"""Near copies: documents whose sets of five-word shingles are alike by 0.8 or more.

SimHash at 3 differing bits (op8) finds little but equal texts; most pairs of a
Jaccard similarity of 0.8 differ in 4 to 9 bits.  keep_one() links what op8
links and, besides, every pair of candidates whose exact similarity is SIMILAR
or more; of each component of all these links one document stays.

Candidates: BANDS x ROWS minima of hashes of a document's shingles.  Two
documents of similarity s share a band with the chance 1 - (1 - s**5)**20:
0.9996 at 0.8.  Components of documents that share bands are compared, each
document with all others of its component, by their whole sets of shingles.

Scale: equal word sequences are folded first; only documents that share a band
with another have their texts dealt out, once each, by component.  A component
above GROUP documents or SHINGLES shingles is split into pairs of bounded
chunks.  Of the links found in a block only a spanning forest is kept.

Words are those of op8: lower-cased runs without ASCII white space.  Texts of
fewer than five words are alike only if equal, which op8 links.  64-bit hashes
are taken as equality.

Defined results of keep_one: null and empty texts are equal to each other; a
null id counts as the largest; repeated rows leave one; an empty table gives no
rows; all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import LOWER, SPACES, Words, _WORD_BASE, free_name, importable, join_counted, map_texts, materialize, partitions, span_hashes, splitmix, utf8, window_hashes

WIDTH = 5
SIMILAR = 0.8
BANDS, ROWS = 20, 5
GROUP = 512
SHINGLES = 1 << 21
#: bytes of text that are hashed at once: minima are taken in the cache
_BATCH = 1 << 18
_FACTORS, _SHIFTS = splitmix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).reshape(2, -1)
_FACTORS |= np.uint64(1)


def _shingles(texts: list[str | None]) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words, their hashes, the hash of each shingle, and its text."""
    words = Words([utf8(t).translate(LOWER) for t in texts], SPACES, b" ")
    hashes = words.hashes()
    found, at = window_hashes(hashes, words.doc, WIDTH)
    return words, hashes, found, words.doc[at]


def signatures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each text: a hash of its words in order, how many shingles it has,
    and its bands (none without a shingle)."""
    words, hashes, found, doc = _shingles(texts)
    digest = span_hashes(hashes, words.first[:-1], words.first[1:], _WORD_BASE)
    count = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    some = np.flatnonzero(count)
    bands = [np.empty(0, np.int64)] * len(texts)
    if len(some):
        first = (np.cumsum(count) - count)[some]
        keys = np.empty((BANDS, len(some)), np.uint64)
        for b in range(BANDS):
            key = np.full(len(some), b + 1, np.uint64)
            for k in range(b * ROWS, (b + 1) * ROWS):
                key = splitmix(key ^ np.minimum.reduceat(found * _FACTORS[k] + _SHIFTS[k], first))
            keys[b] = key
        for i, row in zip(some.tolist(), keys.T.copy().view(np.int64), strict=True):
            bands[i] = row
    return digest.view(np.int64), count, bands


def forest(texts: list[str], left: int | None = None, least: float = SIMILAR) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of texts that are alike by `least` or more:
    of all pairs, or of those between the first `left` texts and the others."""
    n = len(texts)
    _, _, found, doc = _shingles(texts)
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    found, doc = found[new], doc[new]
    size = np.bincount(doc, minlength=n)
    some = np.flatnonzero(size)
    end = np.cumsum(size)
    first = end - size
    known, code = np.unique(found, return_inverse=True)
    mark = np.zeros(len(known), np.int32)
    group, both = np.arange(n), np.zeros(n, np.int64)
    links = []
    for i in some.tolist():
        if left is not None and i >= left:
            break
        others = np.arange(i + 1 if left is None else left, n)
        others = others[(group[others] != group[i]) & (np.minimum(size[others], size[i]) >= least * np.maximum(size[others], size[i]) - 1e-9)]
        if not len(others):
            continue
        own = code[first[i] : end[i]]
        mark[own] = 1
        both[some] = np.add.reduceat(mark[code], first[some])
        mark[own] = 0
        alike = others[both[others] >= least * (size[i] + size[others] - both[others]) - 1e-9]
        for j in alike.tolist():
            if group[j] != group[i]:
                links.append((i, j))
                group[group == group[j]] = group[i]
    return links


def _link(least: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("part", kind="stable")
            left = int((rows["part"] == 2).sum()) or None
            rid = rows["rid"].to_numpy(np.int64)
            if left is None and rows["part"].iloc[0] == 3:  # nothing on the other side
                found = []
            else:
                found = forest(rows["text"].tolist(), left, least)
            return pd.DataFrame({"u": np.array([rid[i] for i, _ in found], np.int64), "v": np.array([rid[j] for _, j in found], np.int64)})

        held: pd.DataFrame | None = None
        for frame in frames:
            rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if not len(rows):
                continue
            key = rows[["root", "block"]].to_numpy(np.int64)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=False):
                yield links(rows.iloc[a:b])
            held = rows.iloc[int(cut[-1]) if len(cut) else 0 :]
        if held is not None and len(held):
            yield links(held)

    return run


def candidates(rows: DataFrame, rid: str, text: str) -> DataFrame:
    """(node, root, n): rows of different word sequences that share a band with
    another, their component and their number of shingles."""
    made = map_texts(rows, text, [rid], lambda: signatures, "digest long; n long; bands array<long>", _BATCH)
    signed = made.where(F.col("n") > 0).groupBy("digest").agg(F.min_by(F.struct("n", "bands"), rid).alias("own"), F.min(rid).alias("node"))
    signed = materialize(signed.select("node", "own.n", "own.bands"))
    buckets = signed.select("node", F.explode("bands").alias("band"))
    heads = materialize(buckets.groupBy("band").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("many")).where("many > 1"))
    links = join_counted(buckets, heads, "band", "many").where("node <> head").select(F.col("node").alias("u"), F.col("head").alias("v")).distinct()
    return simhash.contract(links)[0].join(signed.select("node", "n"), "node")


def alike(rows: DataFrame, rid: str, text: str, least: float = SIMILAR, group: int = GROUP, shingles: int = SHINGLES) -> DataFrame:
    """(u, v) of rows whose shingles are alike by `least` or more, enough to
    connect what all such candidates connect.  rid: a long, different in each row."""
    spark = rows.sparkSession
    importable(spark)
    members = materialize(candidates(rows, rid, text))
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / group), F.ceil(F.sum("n") / shingles)).cast("int")
    sizes = materialize(members.groupBy("root").agg(chunks.alias("chunks"), F.count(F.lit(1)).alias("members")))
    # chunk a of k meets every chunk b in block (min, max); in block (a, a) it is alone
    placed = join_counted(members, sizes, "root", "members").withColumn("a", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    placed = placed.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    block = (F.least("a", "b").cast("long") * F.col("chunks") + F.greatest("a", "b")).cast("long")
    part = F.when(F.col("a") == F.col("b"), 0).when(F.col("a") < F.col("b"), 2).otherwise(3)
    placed = placed.select(F.col("node").alias("rid"), "root", block.alias("block"), part.alias("part"))
    texts = rows.select(F.col(f"`{rid}`").alias("rid"), F.col(f"`{text}`").cast("string").alias("text"))
    dealt = placed.join(texts.hint("merge"), "rid").select("root", "block", "part", "rid", "text")
    dealt = dealt.repartition(partitions(spark), "root", "block").sortWithinPartitions("root", "block")
    return dealt.mapInPandas(_link(least), "u long, v long")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = SIMILAR, group: int = GROUP) -> DataFrame:
    """docs, all columns, with one row of each component of op8's links and
    those of alike(): that of the smallest id (nulls last; of repeated ids one row)."""
    rid = free_name(docs, "rid")
    rows = materialize(docs.withColumn(rid, F.monotonically_increasing_id()))
    plain = rows.select(F.col(f"`{rid}`").alias("__rid"), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    near = materialize(simhash.near_duplicates(plain, "__rid", "__text", ("__id",)).drop("fp"))
    own = near.select(F.col("__rid").alias("rid"), "component_id")
    links = materialize(alike(plain, "__rid", "__text", least, group))
    links = links.join(own.select(F.col("rid").alias("u"), F.col("component_id").alias("cu")).hint("merge"), "u")
    links = links.join(own.select(F.col("rid").alias("v"), F.col("component_id").alias("cv")).hint("merge"), "v")
    roots = simhash.contract(links.select(F.col("cu").alias("u"), F.col("cv").alias("v")).distinct())[0].withColumnRenamed("node", "component_id")
    # the first document of each of op8's components, then of components of those
    best = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id"), F.col("__rid"))).alias("best")
    firsts = near.groupBy("component_id").agg(best).join(roots.hint("merge"), "component_id", "left")
    kept = firsts.groupBy(F.coalesce("root", "component_id").alias("root")).agg(F.min("best").alias("best")).select(F.col("best.__rid").alias(rid))
    return rows.join(kept.hint("merge"), rid, "left_semi").drop(rid)
