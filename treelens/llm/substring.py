"""Substring deduplication by Rabin-Karp hashes of every token window.

Words are runs without ASCII white space.  Each window of `width` words of a
document is hashed; Spark groups the hashes of all windows of all documents,
finds the smallest document of each, and every occurrence in a larger document
is marked.  Marked windows of a document merge into maximal removal intervals.

Layout, for scale:

1. Documents are packed where they are read into blobs of bounded size (words
   joined by one space, compressed), written once: the texts' only copy.
2. Each pack hashes its windows and keeps each hash once, with its smallest
   document: a combine before the shuffle, so a passage that a third of all
   documents hold costs one entry a pack.  Entries go to buckets by hash, as
   sorted, difference-coded binary cells, some 6 to 8 bytes a window.
3. A bucket (about BUCKET entries, their number follows the input) marks the
   entries that have a smaller document elsewhere: one bit an entry, sent back.
4. Packs and their bits meet by pack; windows are hashed again and removed.

A pack makes at most FANOUT cells, so that cells stay thick (85 entries of some
700,000) however many buckets there are.  Beyond FANOUT buckets (about 100 GB of
text) entries take two exchanges: cells of coarse ranges of hashes, as many as
the square root of the buckets, meet by range and group of packs, as many as
make a bucket's size; there each hash is combined to one entry, with the smallest
document of the group, and the entries go on to the buckets, as cells that stand
for a group; bits come back the same way.  Per window that is one more written
copy of its entry and one more exchange.

64-bit hashes are taken as equality: with n different windows the chance that
any two of them collide is below n**2 / 2**65.

Defined results: null and empty texts have no words; a row without an id never
loses words and is never the smaller document; rows that share an id are one
document for this purpose (each keeps what the others hold); ids are whole
numbers (others raise); an empty table gives no rows; other columns are not
read; an id column named as a new column keeps its name, and the new one gets an
underscore in front.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, Words, coverage, free_names, materialize, merged, narrow, partitions, slices, utf8, window_hashes

WIDTH = 13
BUCKET = 2_000_000
FANOUT = 8192


# ------------------------------------------------------------ binary columns


def squeeze(values: np.ndarray) -> bytes:
    """An array of unsigned integers as compressed byte planes."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def unsqueeze(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).view(dtype).reshape(-1)


def sorted_bytes(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit numbers, as differences."""
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def sorted_back(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64), dtype=np.uint64)


# ------------------------------------------------------------------- 1. packs


def _pack(width: int):
    def run(batches):
        for batch in batches:
            for piece in slices(batch, 1):
                column = piece.column(0)
                known = np.array(column.is_valid())
                ids = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.lexsort((ids, ~known))
                texts = piece.column(1).to_pylist()
                words = [utf8(texts[k]).split() for k in order]
                count = np.fromiter(map(len, words), np.int64, len(words))
                blob = zstandard.compress(b"\n".join(b" ".join(w) for w in words), 1)
                row = ([ids[order].tobytes()], [int(known.sum())], [int(np.maximum(count - width + 1, 0).sum())], [blob])
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["ids", "n_known", "windows", "blob"])

    return run


class _Pack:
    """The windows of one pack: `hash` sorted and different, `entry` of each
    window, and the first (smallest) document of each hash."""

    def __init__(self, ids: bytes, n_known: int, blob: bytes, width: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.texts = zstandard.decompress(blob).split(b"\n")
        self.words = Words(self.texts, SPACES, b"\n")
        known = self.words.first[n_known]  # documents without an id come last
        values, self.at = window_hashes(self.words.hashes()[:known], self.words.doc[:known], width)
        order = np.argsort(values)
        ranked = values[order]
        new = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.empty(0, np.int64)
        self.hash = ranked[new]
        self.doc = self.words.doc[self.at]
        self.entry = np.empty(len(values), np.int64)
        self.entry[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(values))))
        first = np.minimum.reduceat(order, new) if len(new) else new
        self.smallest = self.ids[self.doc[first]]

    def cuts(self, buckets: int) -> np.ndarray:
        return cuts(self.hash, 0, buckets, buckets)


def cuts(hashes: np.ndarray, first: int, n: int, buckets: int) -> np.ndarray:
    """Where the entries of the n buckets from the first on begin in their sorted
    hashes, and the end; buckets are ranges of hashes."""
    bounds = [-(-(b << 64) // buckets) for b in range(first + 1, first + n)]
    return np.concatenate(([0], np.searchsorted(hashes, np.array(bounds, np.uint64)), [len(hashes)])).astype(np.int64)


# ------------------------------------------------------------- 2. and 3. cells

CELL = "bucket long, pack long, hashes binary, base long, small boolean, offsets binary"


def _cells_of(hashes: np.ndarray, ids: np.ndarray, cut: np.ndarray, first: int, pack: int) -> pd.DataFrame:
    """Sorted hashes and the document of each as a cell for each bucket."""
    out = []
    for b in np.flatnonzero(np.diff(cut)).tolist():
        own = ids[cut[b] : cut[b + 1]]
        base = int(own.min())
        offset = (own - base).view(np.uint64)
        small = int(offset.max()) < 1 << 32
        out.append((first + b, pack, sorted_bytes(hashes[cut[b] : cut[b + 1]]), base, small, squeeze(offset.astype(np.uint32) if small else offset)))
    return pd.DataFrame(out, columns=["bucket", "pack", "hashes", "base", "small", "offsets"])


def _cells(width: int, buckets: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                pack = _Pack(row.ids, row.n_known, row.blob, width)
                yield _cells_of(pack.hash, pack.smallest, pack.cuts(buckets), 0, row.pack)

    return run


class _Bucket:
    """The entries of several cells: `owner`, the document of each; `group`, its
    hash among the different ones in `hash`; `least`, the smallest of each."""

    def __init__(self, cells: pd.DataFrame):
        hashes = [sorted_back(h) for h in cells["hashes"]]
        ids = [unsqueeze(o, np.uint32 if s else np.uint64).astype(np.int64) + b for o, s, b in zip(cells["offsets"], cells["small"], cells["base"], strict=True)]
        self.pack, self.bucket, self.size = cells["pack"], cells["bucket"], [len(h) for h in hashes]
        every, self.owner = np.concatenate(hashes), np.concatenate(ids)
        order = np.argsort(every)
        ranked = every[order]
        new = np.append(True, ranked[1:] != ranked[:-1])
        self.hash = ranked[new]
        self.least = np.minimum.reduceat(self.owner[order], np.flatnonzero(new))
        self.group = np.empty(len(every), np.int64)
        self.group[order] = np.cumsum(new) - 1

    def marks(self, elsewhere: np.ndarray | None = None) -> pd.DataFrame:
        """Bits of the entries that have a smaller document here, or elsewhere (a
        mark for each hash); cells without any are left out."""
        smaller = self.least[self.group] < self.owner
        if elsewhere is not None:
            smaller |= elsewhere[self.group]
        parts = np.split(smaller, np.cumsum(self.size)[:-1])
        kept = [(p, b, np.packbits(m).tobytes()) for p, b, m in zip(self.pack, self.bucket, parts, strict=True) if m.any()]
        return pd.DataFrame(kept, columns=["pack", "bucket", "bits"])


def _each(key: str, run):
    """run(rows) for the rows of each key in a task (a task holds whole keys)."""

    def every(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if held:
            for value, rows in pd.concat(held, ignore_index=True).groupby(key, sort=False):
                yield run(value, rows)

    return every


def _combine(coarse: int, fine: int, groups: int):
    """The cells of a coarse range and a group of packs (a place) as cells for
    the fine buckets, each hash once; they stand for the place."""

    def run(place: int, cells: pd.DataFrame) -> pd.DataFrame:
        b = _Bucket(cells)
        first = place // groups * fine
        return _cells_of(b.hash, b.least, cuts(b.hash, first, fine, coarse * fine), first, place)

    return run


def _spread(coarse: int, fine: int, groups: int):
    """Marks of fine buckets for the packs of a place."""

    def run(cells: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        if not len(cells):
            return pd.DataFrame({"pack": [], "bucket": [], "bits": []})
        b = _Bucket(cells)
        elsewhere, first = np.zeros(len(b.hash), bool), int(cells["place"].iloc[0]) // groups * fine
        cut = cuts(b.hash, first, fine, coarse * fine)
        for bucket, bits in zip(marks["bucket"], marks["bits"], strict=True):
            a, z = cut[bucket - first], cut[bucket - first + 1]
            elsewhere[a:z] = np.unpackbits(np.frombuffer(bits, np.uint8), count=z - a)
        return b.marks(elsewhere)

    return run


MARK = "pack long, bucket long, bits binary"


def _marked(parts: DataFrame, width: int, total: int, buckets: int, bucket: int, fanout: int) -> tuple[DataFrame, int]:
    """The marks of all packs, and for how many ranges of hashes they are."""
    mark = _each("bucket", lambda _, cells: _Bucket(cells).marks())
    if buckets <= fanout:
        cells = parts.mapInPandas(_cells(width, buckets), CELL)
        # a task for each bucket: a hash of the bucket would put several into some tasks
        return cells.repartitionById(buckets, F.col("bucket").cast("int")).mapInPandas(mark, MARK), buckets
    coarse = math.isqrt(buckets - 1) + 1
    fine, groups = -(-buckets // coarse), max(1, -(-total // (coarse * bucket)))
    place = F.col("bucket") * groups + F.pmod(F.xxhash64("pack"), F.lit(groups))
    cells = materialize(parts.mapInPandas(_cells(width, coarse), CELL).withColumn("place", place))
    dealt = cells.repartitionById(coarse * groups, F.col("place").cast("int"))
    combined = dealt.mapInPandas(_each("place", _combine(coarse, fine, groups)), CELL)
    found = combined.repartitionById(coarse * fine, F.col("bucket").cast("int")).mapInPandas(mark, MARK)
    back = cells.groupBy("place").cogroup(found.withColumnRenamed("pack", "place").groupBy("place"))
    return back.applyInPandas(_spread(coarse, fine, groups), MARK), coarse


# --------------------------------------------------------------- 4. removal

RESULT = "id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>"


def _remove(width: int, buckets: int):
    def run(packs: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        out, ids, unknown = [], [], []
        for row in packs.itertuples(index=False):
            pack = _Pack(row.ids, row.n_known, row.blob, width)
            ids.append(pack.ids)
            unknown.append(np.arange(len(pack.ids)) >= row.n_known)
            cut = pack.cuts(buckets)
            smaller = np.zeros(len(pack.hash), bool)
            for bucket, bits in zip(marks["bucket"], marks["bits"], strict=True):
                a, b = cut[bucket], cut[bucket + 1]
                smaller[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
            gone = smaller[pack.entry] | (pack.ids[pack.doc] > pack.smallest[pack.entry])
            start = pack.at[gone]
            covered = coverage(len(pack.words), start, start + width)
            per_doc = np.diff(np.append(0, np.cumsum(covered))[pack.words.first])
            cuts = np.searchsorted(start, pack.words.first)
            for k, text in enumerate(pack.texts):
                first, last = pack.words.first[k], pack.words.first[k + 1]
                kept, spans = text, []
                if per_doc[k]:
                    own = start[cuts[k] : cuts[k + 1]] - first
                    spans = merged(own, own + width)
                    left = np.flatnonzero(~covered[first:last])
                    words = text.split(b" ")
                    kept = b" ".join([words[i] for i in left.tolist()])
                out.append((last - first, per_doc[k], kept.decode("utf-8"), [{"start": a, "end": b} for a, b in spans]))
        frame = pd.DataFrame(out, columns=["n_words", "n_removed", "kept", "spans"])
        frame.insert(0, "id", pd.arrays.IntegerArray(np.concatenate([np.empty(0, np.int64), *ids]), np.concatenate([np.empty(0, bool), *unknown])))
        return frame

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, bucket: int = BUCKET, fanout: int = FANOUT) -> DataFrame:
    """One row a document: id, n_words, n_removed, kept (the kept words joined
    by one space) and spans (maximal removal intervals, in words)."""
    spark = docs.sparkSession
    source = narrow(docs, id_col, text).toDF("id", "text")
    if not isinstance(source.schema["id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise ValueError(f"{id_col} is no column of whole numbers")
    source = source.withColumn("id", F.col("id").cast("long"))
    packs = source.mapInArrow(_pack(width), "ids binary, n_known long, windows long, blob binary")
    packs = materialize(packs.withColumn("pack", F.monotonically_increasing_id()))
    total = packs.agg(F.sum("windows")).first()[0] or 0
    buckets = max(partitions(spark), -(-total // bucket))
    parts = packs.select("pack", "ids", "n_known", "blob")
    marks, ranges = _marked(parts, width, total, buckets, bucket, fanout)
    found = parts.groupBy("pack").cogroup(marks.groupBy("pack")).applyInPandas(_remove(width, ranges), RESULT)
    return found.toDF(id_col, *free_names([id_col], *found.columns[1:]))
