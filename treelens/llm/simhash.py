"""SimHash near-duplicate classes by anchor-point covering.

Fingerprint: 64 bits, each the majority over the XXH64 of all word shingles.
Two fingerprints link at THRESHOLD (3) or fewer differing bits.

Covering: of two fingerprints that differ in at most 3 bits, one of the two
32-bit halves differs in at most 1.  The anchors of a half are the words of the
perfect Hamming code of length 31: every 31-bit string lies within 1 bit (the
covering radius) of exactly one code word, and within radius + threshold = 2
bits of at most 16.  Each fingerprint is replicated to those anchors of each
half, so linked fingerprints meet at an anchor; there they are compared.

Scale: texts never leave the task that reads them; classes of equal
fingerprints are folded first (a minimum by key, combined before the shuffle),
so copies cost nothing further.  An anchor with more than GROUP fingerprints is
split into pairs of bounded chunks, each compared in a task's own time.  Of the
links found at an anchor only a spanning forest is kept, so no anchor emits all
its pairs; the connected components of the forests are those of all links.
Components come from rounds of contraction, logarithmic in the longest chain of
links, each round a written table.  Fingerprints and components that very many
rows share are joined by broadcast of those few keys, so they spread over tasks.

Defined results: null and empty texts have fingerprint zero and link like any
other; repeated rows give a row each; ids are of any ordered type, a null id is
never the smallest (the component of rows with null ids alone is null); an empty
table gives no rows; other columns are not read (near_duplicates) or kept
(keep_one); an id or carried column named `fp` or `component_id` keeps its name,
and the new column gets an underscore in front.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, columns_of, free_name, importable, join_counted, map_texts, materialize, partitions, utf8

SHINGLE = 3
SEED = 42
THRESHOLD = 3
GROUP = 2048
_BLOCK_BITS = 1 << 16
#: a table of split anchors up to this many rows is broadcast (16 bytes a row)
BROADCAST_ROWS = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = utf8(text).translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    k = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    n = len(words) - k
    counts = np.zeros(64, np.int64)
    spans = zip(starts[:n].tolist(), ends[k:].tolist(), strict=True)
    for at in range(0, n, _BLOCK_BITS):
        some = np.fromiter((digest(joined[a:b], seed) for (a, b), _ in zip(spans, range(at, min(n, at + _BLOCK_BITS)), strict=False)), np.uint64, min(n, at + _BLOCK_BITS) - at)
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs with only id, the carried columns, and `fp`: the fingerprint as a signed long."""
    def make():
        return lambda texts: [np.array([fingerprint(t, shingle, seed) for t in texts], np.uint64).view(np.int64)]

    columns_of(docs, id_col, *carry, text)
    return map_texts(docs, text, [id_col, *carry], make, "fp long")


# ------------------------------------------------------------------- anchors

_PLACES = np.arange(1, 32)


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, code word) of all code words of the Hamming code of length 31
    within 2 bits of each 31-bit string."""
    half = half.astype(np.int64)
    syndrome = np.zeros(len(half), np.int64)
    for p in _PLACES:
        syndrome ^= np.where(half >> (p - 1) & 1, p, 0)
    every = np.arange(len(half))
    home = np.where(syndrome > 0, half ^ (np.int64(1) << np.maximum(syndrome - 1, 0)), half)
    index, words = [every], [home]
    for p in _PLACES:  # flipping p and q leads to a code word if p xor q is the syndrome
        q = syndrome ^ p
        on = np.flatnonzero((q > p) & (syndrome > 0))
        index.append(on)
        words.append(half[on] ^ (1 << (int(p) - 1)) ^ (np.int64(1) << (q[on] - 1)))
    return np.concatenate(index), np.concatenate(words)


def _replicate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        bits = frame["fp"].to_numpy(np.int64).view(np.uint64)
        for side in (0, 1):
            index, words = anchors((bits >> np.uint64(32 * side)) & np.uint64(0x7FFFFFFF))
            yield pd.DataFrame({"anchor": words | side << 32, "fp": bits[index].view(np.int64)})


def forest(left: np.ndarray, right: np.ndarray | None, threshold: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within left, or between left and right."""
    nodes = (left if right is None else np.concatenate((left, right))).view(np.uint64)  # bits of signed numbers would be those of their absolute value
    columns = np.arange(len(nodes)) if right is None else np.arange(len(left), len(nodes))
    group = np.arange(len(nodes))
    links = []
    for i in range(len(left)):
        there = columns[i + 1 :] if right is None else columns
        there = there[np.bitwise_count(nodes[there] ^ nodes[i]) <= threshold]
        for j in there[group[there] != group[i]].tolist():
            if group[j] != group[i]:
                links.append((i, j))
                group[group == group[j]] = group[i]
    signed = nodes.view(np.int64)
    return [(int(signed[i]), int(signed[j])) for i, j in links]


def _link(threshold: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def links(rows: pd.DataFrame) -> pd.DataFrame:
            key = rows[["anchor", "block"]].to_numpy(np.int64)
            cut = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            size = np.diff(np.append(cut, len(rows)))
            fp, part = rows["fp"].to_numpy(np.int64), rows["part"].to_numpy(np.int64)
            out = []
            for a, n in zip(cut[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                own, side = fp[a : a + n], part[a : a + n]
                if side[0]:  # a pair of chunks, told apart by 2 and 3
                    out += forest(own[side == 2], own[side == 3], threshold)
                else:
                    out += forest(own, None, threshold)
            return pd.DataFrame({"u": np.array([min(x) for x in out], np.int64), "v": np.array([max(x) for x in out], np.int64)})

        for frame in frames:
            rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
            key = rows[["anchor", "block"]].to_numpy(np.int64)
            last = np.flatnonzero((key != key[-1]).any(axis=1)) if len(rows) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            held = rows.iloc[cut:]
            if cut:
                yield links(rows.iloc[:cut])
        if held is not None and len(held):
            yield links(held)

    return run


def link_forest(distinct: DataFrame, threshold: int = THRESHOLD, group: int = GROUP) -> DataFrame:
    """(u, v) links of different fingerprints, enough to connect what all links
    connect.  distinct: a column fp of different fingerprints."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"the covering holds for thresholds of 0 to {THRESHOLD}")
    spark = distinct.sparkSession
    importable(spark)
    replicas = distinct.select("fp").mapInPandas(_replicate, "anchor long, fp long")
    crowded = materialize(replicas.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group).select("anchor", F.ceil(F.col("n") / group).cast("int").alias("chunks")))
    n_crowded = crowded.count()
    if n_crowded:
        small = F.broadcast(crowded) if n_crowded <= BROADCAST_ROWS else crowded
        marked = replicas.join(small, "anchor", "left")
        # chunk a of k meets every chunk b in block (min, max); in block (a, a) it is alone
        a, k = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"), F.col("chunks")
        b = F.explode(F.when(k.isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), k - 1)))
        marked = marked.withColumn("a", a).withColumn("b", b)
        keyed = marked.select(
            "anchor",
            F.when(F.col("b") < 0, F.lit(0)).otherwise(F.least("a", "b").cast("long") * F.col("chunks") + F.greatest("a", "b") + 1).cast("long").alias("block"),
            F.when((F.col("b") < 0) | (F.col("a") == F.col("b")), 0).when(F.col("a") < F.col("b"), 2).otherwise(3).alias("part"),
            "fp",
        )
    else:
        keyed = replicas.select("anchor", F.lit(0).cast("long").alias("block"), F.lit(0).alias("part"), "fp")
    dealt = keyed.repartition(partitions(spark), "anchor", "block").sortWithinPartitions("anchor", "block")
    return dealt.mapInPandas(_link(threshold), "u long, v long").distinct()


# ---------------------------------------------------------------- components


def contract(links: DataFrame) -> tuple[DataFrame, int]:
    """(node, root) of every node of the links (u, v), and the number of rounds;
    root is one node of the component, the same for all its nodes.

    A round points each node at the one of smallest hash among itself and its
    neighbours, then once more along the pointers, and keeps the links between
    different targets.  Hashes make the order a random one, so a chain that
    ascends is no special case: a chain loses at least half of its nodes a
    round on average, a star all but its centre in two.  Rounds are logarithmic
    in the longest path, and their tables shrink geometrically."""
    links = materialize(links.where(F.col("u") != F.col("v")).select("u", "v"))
    maps = []
    while not links.isEmpty():
        both = links.select(F.col("u").alias("node"), F.col("v").alias("other")).unionByName(links.select(F.col("v").alias("node"), F.col("u").alias("other")))
        best = both.groupBy("node").agg(F.min_by("other", F.xxhash64("other")).alias("other"))
        own, other = F.xxhash64("node"), F.xxhash64("other")
        lower = (other < own) | ((other == own) & (F.col("other") < F.col("node")))
        step = best.select("node", F.when(lower, F.col("other")).otherwise(F.col("node")).alias("root"))
        onward = step.select(F.col("node").alias("root"), F.col("root").alias("top"))
        step = materialize(step.join(onward, "root").select("node", F.col("top").alias("root")))
        maps.append(step)
        u = step.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        v = step.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        image = links.join(u, "u").join(v, "v").where(F.col("ru") != F.col("rv"))
        links = materialize(image.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
    rounds = len(maps)
    if not maps:
        return links.select(F.col("u").alias("node"), F.col("v").alias("root")), 0
    found = maps.pop()
    while maps:
        upper = found.select(F.col("node").alias("root"), F.col("root").alias("top"))
        found = maps.pop().join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return found, rounds


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (u, v); root is the smallest node
    of its component."""
    named = materialize(contract(links)[0])
    least = named.groupBy("root").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n"))
    return join_counted(named, least, "root", "n").select("node", F.col("least").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), threshold: int = THRESHOLD, group: int = GROUP) -> DataFrame:
    """One row a document: id, carried columns, fp (signed long) and
    component_id, the smallest id of all documents that links reach."""
    made = fingerprints(docs, id_col, text, carry)
    names = made.columns
    rows = materialize(made.toDF(*(f"c{k}" for k in range(len(names) - 1)), "fp"))
    classes = materialize(rows.groupBy("fp").agg(F.min("c0").alias("first"), F.count(F.lit(1)).alias("n")))
    roots = contract(link_forest(classes, threshold, group))[0].withColumnRenamed("node", "fp")
    linked = materialize(classes.join(roots, "fp").select("fp", "first", "root"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("members"))
    known = join_counted(linked, materialize(smallest), "root", "members").select("fp", "component_id")
    every = classes.join(known, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id"))
    # a fingerprint that very many rows share (that of empty texts, say) spreads
    found = join_counted(rows, materialize(every), "fp", "n")
    return found.select(*(f"c{k}" for k in range(len(names) - 1)), "fp", "component_id").toDF(*names, free_name(names, "component_id"))


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, group: int = GROUP) -> DataFrame:
    """docs, all columns, with one row of each component: that of the smallest
    id (nulls last; of repeated ids one row)."""
    rid = free_name(docs, "rid")
    rows = materialize(docs.withColumn(rid, F.monotonically_increasing_id()))
    own = F.col(f"`{id_col}`")
    classes = near_duplicates(rows.select(rid, own.alias("__id"), F.col(f"`{text}`").alias("__text")), rid, "__text", ("__id",), threshold, group)
    best = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id"), F.col(rid)))
    kept = classes.groupBy("component_id").agg(best.alias("best")).select(F.col(f"best.{rid}").alias(rid))
    return rows.join(kept.hint("merge"), rid, "left_semi").drop(rid)
