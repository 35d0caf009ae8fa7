"""Packing along a space-filling curve.

Each document becomes token ids (with an end id) and a hashed vector: ids fall
into HASHED signed buckets, and the normalised bucket counts are projected to
DIMS dimensions.  The grid cell of the projection has a Hilbert key; documents
in order of their keys have their neighbours beside them.  Documents are laid
one after another along the curve and cut every `length` ids, so a sequence
holds documents that are alike.  The rest at the end, shorter than a sequence,
is cut at powers of two, which need no padding.

Layout, for scale: texts are tokenized where they are read; the ids are written
once.  The order needs only (key, row, count): range-sorted, numbered within
each range, and offset by the totals of the ranges before it (as many numbers
as partitions).  Places then join the ids by row.  A group of equal keys of any
size spreads over ranges, as rows are part of the sort key.

Defined results: null and empty texts are the end id alone; repeated rows are
packed once each; ties of the key go by row; ids of any type and null are
carried; an empty table gives no rows; other columns are carried on request; an
id or carried column named as one of PIECE keeps its name, and the new column
gets an underscore in front.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, free_names, map_texts, materialize, partitions, splitmix

LENGTH = 2048
END_ID = 1
HASHED = 4096
DIMS, BITS = 4, 8
SEED = 5
PIECE = ("start", "length", "doc_tokens", "sequence_id", "offset", "ids")


# ------------------------------------------------------------------ tokenizer


class Tokenizer:
    """Token ids of texts by a tokenizers file, the same ids by its merges as
    ranks where that file is given (several times faster).

    A text that holds one of the file's added tokens is left to the file."""

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Base

        self.base = Base.from_file(path)
        self.added = [t.content for t in self.base.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path and pattern:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text) -> np.ndarray:
        if not isinstance(text, str) or not text:
            return np.empty(0, np.uint32)
        if self.fast is None or any(t in text for t in self.added):
            return np.array(self.base.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


_tokenizers: dict[tuple, Tokenizer] = {}


def tokenizer(*paths: str | None) -> Tokenizer:
    """One tokenizer a process and file."""
    if paths not in _tokenizers:
        _tokenizers[paths] = Tokenizer(*paths)
    return _tokenizers[paths]


# ---------------------------------------------------------------- the curve


def projection(ids: int = 1 << 16, dims: int = DIMS, hashed: int = HASHED, seed: int = SEED) -> np.ndarray:
    """The row of the projection that each id adds: its bucket's, with its sign."""
    rng = np.random.default_rng(seed)
    matrix = rng.standard_normal((hashed, dims))
    h = splitmix(np.arange(1, ids + 1, dtype=np.uint64))
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    return (matrix[(h % np.uint64(hashed)).astype(np.int64)] * sign[:, None]).astype(np.float32)


def grid(sums: np.ndarray, counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Cells (0 to 2**bits - 1 in each dimension) of projected vectors.

    Sums are scaled by the square root of the number of ids and squashed, so the
    cells need no statistics of the corpus."""
    z = sums / np.sqrt(np.maximum(counts, 1))[:, None] / 4
    return np.minimum((0.5 + np.arctan(z) / np.pi) * (1 << bits), (1 << bits) - 1).astype(np.int64)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of grid cells (a row each) along the Hilbert curve.

    The cells' bits are turned, plane by plane from the top, by the rotations
    and reflections that keep the curve unbroken; then Gray code to number."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    plane = 1 << (bits - 1)
    while plane > 1:
        low = plane - 1
        for i in range(n):
            on = x[i] & plane != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        plane >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    plane = 1 << (bits - 1)
    while plane > 1:
        turn ^= np.where(x[n - 1] & plane != 0, plane - 1, 0)
        plane >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


# ------------------------------------------------------------------- packing


def _encoder(paths: tuple, end_id: int):
    """Makes f(texts) -> ids (16 bits each where they fit), their number,
    whether they are 32 bits wide, and the Hilbert key."""

    def make():
        coder, table = tokenizer(*paths), projection()

        def encode(texts: list):
            ids = [np.append(coder.encode(t), np.uint32(end_id)) for t in texts]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            sums = np.array([table[i[:-1] & 0xFFFF].sum(axis=0, dtype=np.float64) for i in ids])
            wide = [bool(i.max() >= 1 << 16) for i in ids]
            return [(i if w else i.astype(np.uint16)).tobytes() for i, w in zip(ids, wide, strict=True)], counts, wide, hilbert_keys(grid(sums, counts - 1))

        return encode

    return make


def _number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The place of each document in its range, which is the partition."""
    part, at = TaskContext.get().partitionId(), 0
    for frame in frames:
        n = frame["n"].to_numpy(np.int64)
        start = at + np.cumsum(n) - n
        at += int(n.sum())
        yield pd.DataFrame({"rid": frame["rid"], "part": part, "start": start, "n": n})


def sequence_starts(total: int, length: int) -> tuple[int, list[int]]:
    """How many full sequences there are, and where those of the rest begin."""
    full, rest = divmod(total, length)
    starts, at = [], full * length
    for b in range(rest.bit_length() - 1, -1, -1):
        if rest >> b & 1:
            starts.append(at)
            at += 1 << b
    return full, starts


def _cut(total: int, length: int, names: list[str], carried: int):
    """carried columns, place, n, wide and ids in; a row a piece out."""
    full, tail = sequence_starts(total, length)
    tails = np.array(tail, np.int64)

    def pieces(start: int, n: int):
        """(from, to, sequence, offset) of the pieces of a document at start."""
        at, end = start, start + n
        while at < end:
            if at < full * length:
                sequence, begin = at // length, at // length * length
                stop = begin + length
            else:
                k = int(np.searchsorted(tails, at, side="right")) - 1
                sequence, begin = full + k, int(tails[k])
                stop = int(tails[k + 1]) if k + 1 < len(tails) else total
            to = min(end, stop)
            yield at - start, to - start, sequence, at - begin
            at = to

    kinds = [pa.int64()] * 5 + [pa.binary()]

    def run(batches):
        for batch in batches:
            rows, source = [], []
            places, counts, wides, datas = (c.to_pylist() for c in batch.columns[carried:])
            for k, (place, n, wide, data) in enumerate(zip(places, counts, wides, datas, strict=True)):
                ids = data if wide else np.frombuffer(data, np.uint16).astype("<u4").tobytes()
                for a, b, sequence, offset in pieces(place, n):
                    source.append(k)
                    rows.append((a, b - a, n, sequence, offset, ids[4 * a : 4 * b]))
            if rows:
                kept = [c.take(pa.array(source)) for c in batch.columns[:carried]]
                made = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=names)

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", ranks_path: str | None = None, pattern: str | None = None, length: int = LENGTH, end_id: int = END_ID, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a piece: id, carried columns, start, length, doc_tokens,
    sequence_id, offset (long) and ids (binary, little-endian 32-bit).

    path: the tokenizers file; it and ranks_path are read on the executors."""
    spark = docs.sparkSession
    columns_of(docs, id_col, *carry, text)
    names = [f"c{k}" for k in range(1 + len(carry))]
    encoded = map_texts(docs, text, [id_col, *carry], _encoder((path, ranks_path, pattern), end_id), "ids binary; n long; wide boolean; key long")
    encoded = materialize(encoded.toDF(*names, "ids", "n", "wide", "key").withColumn("rid", F.monotonically_increasing_id()))
    light = encoded.select("key", "rid", "n")
    ordered = light.repartitionByRange(partitions(spark), "key", "rid").sortWithinPartitions("key", "rid").select("rid", "n")
    numbered = materialize(ordered.mapInPandas(_number, "rid long, part int, start long, n long"))
    totals = {r["part"]: r["n"] for r in numbered.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a number a range
    offsets, at = [], 0
    for part in range(max(totals, default=-1) + 1):
        offsets.append(at)
        at += totals.get(part, 0)
    first = F.element_at(F.split(F.lit(",".join(map(str, offsets or [0]))), ","), F.col("part") + 1).cast("long")
    placed = numbered.select("rid", (first + F.col("start")).alias("place"))
    # the same plan at every size: places are as many as documents
    joined = encoded.join(placed.hint("merge"), "rid").select(*names, "place", "n", "wide", "ids")
    schema = joined.select(*names).schema
    for c in PIECE:
        schema = schema.add(c, "binary" if c == "ids" else "long")
    return joined.mapInArrow(_cut(at, length, schema.names, len(names)), schema).toDF(id_col, *carry, *free_names([id_col, *carry], *PIECE))
