"""Helpers shared by the training-data operators: written cuts of the lineage,
bounded batches of whole documents, and vectorised word scanning."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: bytes of text that a worker holds at once, unless one document is longer
BATCH_BYTES = 4 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests) is one
    chosen; on a cluster there is no folder to choose, and this raises."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file:///tmp/checkpoints/treelens-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def importable(spark: SparkSession) -> None:
    """Let Python workers that start beside this copy of the package import it,
    whatever the working folder; on a cluster it comes by --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, root])


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends
    there, and an executor lost later costs only the tasks that read its part."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables of materialize() there are."""
    return len(_written)


def drop_materialized(since: int = 0, but_last: int = 0) -> None:
    """Delete the tables that materialize() wrote in this process: those after
    the first `since`, without the last `but_last`."""
    gone = _written[since : len(_written) - but_last]
    del _written[since : len(_written) - but_last]
    for spark, path in gone:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: its files go with the shared folder
            pass


atexit.register(drop_materialized)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def columns_of(df: DataFrame, *names: str) -> list[str]:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing} in {df.columns}")
    return list(names)


def free_name(taken: DataFrame | Sequence[str], name: str) -> str:
    """A column name that is not taken yet.  Columns that an operator makes give
    way to those of its input: a taken name gets underscores in front."""
    names = taken.columns if isinstance(taken, DataFrame) else taken
    while name.lower() in {n.lower() for n in names}:
        name = "_" + name
    return name


def free_names(taken: DataFrame | Sequence[str], *names: str) -> list[str]:
    return [free_name(taken, n) for n in names]


#: keys of more than one in HOT of all rows are joined by broadcast
HOT = 1024


def join_counted(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """rows with the columns of table, which has one row a key and in `n` how
    many rows have that key; rows of other keys go.

    Keys of more than a share of 1 in HOT are fewer than HOT by arithmetic: they
    are broadcast, whatever the input's size, so no task gets all rows of a hot
    key; the other keys are shuffled.  Both are read twice: written tables."""
    total = table.agg(F.sum(n)).first()[0] or 0
    often = F.col(n) * HOT > total
    few, rest = table.where(often).drop(n), table.where(~often).drop(n)
    hot = rows.join(F.broadcast(few), key)
    others = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(rest.hint("merge"), key)
    return hot.unionByName(others.select(hot.columns))


# ---------------------------------------------------------------- batches


def whole_documents(frames, text: str = "text", limit: int = BATCH_BYTES):
    """Regroup pandas batches into frames of about `limit` bytes of text.

    A document is never cut; one longer than the limit is a batch of its own."""
    held: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        lengths = np.fromiter((len(t) if isinstance(t, str) else 0 for t in frame[text]), np.int64, len(frame))
        start = 0
        while start < len(frame):
            room = np.searchsorted(np.cumsum(lengths[start:]), limit - size, side="right")
            end = start + int(room)
            if end == start and not held:
                end = start + 1
            if end > start:
                held.append(frame.iloc[start:end])
                size += int(lengths[start:end].sum())
            if end < len(frame):
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
            start = end
    if held:
        yield pd.concat(held, ignore_index=True)


def utf8(value) -> bytes:
    return value.encode("utf-8") if isinstance(value, str) else b""


def slices(batch: pa.RecordBatch, at: int, limit: int = BATCH_BYTES):
    """The batch in runs of rows of about `limit` bytes of the text column `at`."""
    column = batch.column(at)
    sizes = np.array([len(t) if t else 0 for t in column.to_pylist()], np.int64)
    start, ends = 0, np.cumsum(sizes)
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def map_texts(df: DataFrame, text: str, carried: list[str], make, fields: str, limit: int = BATCH_BYTES) -> DataFrame:
    """The carried columns as they are, and new columns made from the text.

    make() is called once a task and returns f(list of texts) -> one sequence a
    new column.  fields: their names and types; a name that a carried column has
    gives way (free_name).  The carried values stay Arrow values: pandas would
    turn integers beside nulls into floats."""
    importable(df.sparkSession)
    names = [f"c{k}" for k in range(len(carried))]
    kept = df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(carried, names, strict=True)), F.col(f"`{text}`").cast("string").alias("text"))
    schema = kept.drop("text").schema
    for part in fields.split("; "):
        name, kind = part.split(" ", 1)
        schema = schema.add(name, df.sparkSession.range(0).selectExpr(f"cast(null as {kind}) as x").schema["x"].dataType)
    width = len(names)
    kinds = [to_arrow_type(f.dataType) for f in schema.fields[width:]]

    def run(batches):
        f = make()
        for batch in batches:
            for piece in slices(batch, width, limit):
                made = f(piece.column(width).to_pylist())
                arrays = [*piece.columns[:width], *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    out = kept.mapInArrow(run, schema)
    return out.toDF(*carried, *free_names(carried, *schema.names[width:]))


# ---------------------------------------------------------------- word scanning

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD6E8FEB86659FD93 | 1


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit integers."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


_BYTE_VALUE = splitmix(np.arange(1, 257, dtype=_U64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n (kept, grown by doubling)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        m = max(1024, 1 << (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            steps = np.full(m, b, _U64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[base] = have = (both[0], both[1])
    return have[0][:n], have[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Polynomial hashes of values[start:end] for many spans, from one prefix sum.

    The sum runs modulo 2**64 and is shifted to the start of its span, so equal
    runs get equal hashes wherever they stand; a finaliser spreads the bits."""
    up, down = powers(base, len(values) + 1)
    prefix = np.empty(len(values) + 1, _U64)
    prefix[0] = 0
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return splitmix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U64))


class Words:
    """The words of several UTF-8 texts.

    start, end: byte offsets into `data`; doc: index of the text of each word;
    first: index of the first word of each text (one more than texts)."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, separator: bytes):
        assert not is_word[separator[0]]
        self.joined = separator.join(texts)
        self.data = np.frombuffer(self.joined, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offset = np.concatenate(([0], np.cumsum(lengths + 1)))[: len(texts)]
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = is_word[self.data]
        turn = np.diff(inside)
        self.start = np.flatnonzero(turn == 1)
        self.end = np.flatnonzero(turn == -1)
        self.first = np.searchsorted(self.start, np.append(self.offset, len(self.data) + 1))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        return span_hashes(_BYTE_VALUE[self.data], self.start, self.end)

    def word(self, i: int) -> bytes:
        return self.joined[self.start[i] : self.end[i]]


def window_hashes(word_hashes: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of `width` words that lie in one text, and where they start."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.empty(0, _U64), np.empty(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return span_hashes(word_hashes, at, at + width, _WORD_BASE), at


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The maximal intervals that cover the given half-open ones."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return list(zip(starts[new].tolist(), reach[np.append(new[1:] - 1, len(starts) - 1)].tolist(), strict=True))


def coverage(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any of the half-open intervals."""
    change = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0


#: letters A-Z to a-z, all other bytes as they are
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: fixed values: bytes that are no word bytes where words are [^\x20\x09-\x0D]+
SPACES = np.ones(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: fixed values: bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing)
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, by exact name (names with dots included)."""
    importable(df.sparkSession)
    return df.select(*(F.col(f"`{n}`") for n in columns_of(df, *names)))
