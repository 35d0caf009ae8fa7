"""Quality classifier: a byte-level convolutional network in numpy.

Filters of WIDTH bytes move over the UTF-8 bytes of the whole text two bytes at
a time.  The text is a row of chunks of STEP window starts each; as a window at
the end of a chunk reads on into the next, chunks overlap and none is left out.
In a chunk each filter keeps its maximum; a linear layer on the rectified maxima
gives the chunk's logit; the mean, smallest and largest chunk logits of a text
combine into one probability.

Filters and layers are learned on the driver from all chunks of a bounded sample
of labelled rows: of each label the MAX_ROWS rows of smallest hash of their id,
and of those the first whose texts together have MAX_BYTES bytes (one row at
least).  A row counts once, however many chunks it has.  The final combination
is fitted on the same rows' whole texts, weighted back to the label's frequency.
Training passes over all chunks EPOCHS times, or fewer (one at least) where that
would be more than MAX_STEPS steps.  Scoring
reads whole texts where they are, without a shuffle, in pieces of bounded size.

Defined results: null and empty texts are one chunk of zero bytes and get its
score; labels of null id or value are not used, of several labels of an id the
largest counts; if one of the labels has no row, all scores are the frequency
of label 1 (0.5 without labels); repeated rows give a row each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, map_texts, materialize, narrow, partitions, utf8
from .toxicity import sample_labels

WIDTH, STRIDE, FILTERS = 8, 2, 24
STEP = 124
CHUNK = STEP * STRIDE
READ = CHUNK + WIDTH - STRIDE
MAX_ROWS = 2000
MAX_BYTES = 16 << 20
EPOCHS = 14
MAX_STEPS = 1000
BATCH = 256
SEED = 11
#: chunks that are scored at once
PIECE = 2048


@dataclass
class ByteNet:
    """table[k, byte, filter]: the filters; v, c: the layer on the maxima;
    combine: weights of mean, smallest and largest chunk logit, and a constant."""

    table: np.ndarray
    v: np.ndarray
    c: float
    combine: np.ndarray
    constant: float | None = None
    _pairs: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_pairs": []}

    def pairs(self) -> list[np.ndarray]:
        """Two neighbouring bytes of the filters as one look-up of 65,536 rows."""
        if not self._pairs:
            for k in range(0, WIDTH, 2):
                self._pairs.append((self.table[k][:, None, :] + self.table[k + 1][None, :, :]).reshape(65536, FILTERS).astype(np.float32))
        return self._pairs

    def chunk_logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.v + self.c

    def pool(self, chunks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Maxima of each filter in chunks of READ bytes; only windows that
        start within the length count (the first always does)."""
        codes = chunks[:, 0::2].astype(np.int32) * 256 + chunks[:, 1::2]
        sums = None
        for k, table in enumerate(self.pairs()):
            part = table[codes[:, k : k + STEP]]
            sums = part if sums is None else np.add(sums, part, out=sums)
        short = np.flatnonzero(lengths < CHUNK)
        if len(short):
            late = np.arange(STEP) * STRIDE >= np.maximum(lengths[short], 1)[:, None]
            some = sums[short]
            some[late] = -1e9
            sums[short] = some
        return sums.max(axis=1)

    def logits(self, text) -> np.ndarray:
        """Mean, smallest and largest chunk logit of a text."""
        data = utf8(text)
        n = max(1, -(-len(data) // CHUNK))
        padded = np.frombuffer(data.ljust(n * CHUNK + READ - CHUNK, b"\0"), np.uint8)
        chunks = np.lib.stride_tricks.as_strided(padded, (n, READ), (CHUNK, 1), writeable=False)
        lengths = np.minimum(CHUNK, len(data) - np.arange(n) * CHUNK)
        out = np.concatenate([self.chunk_logits(self.pool(chunks[a : a + PIECE], lengths[a : a + PIECE])) for a in range(0, n, PIECE)])
        return np.array([out.mean(), out.min(), out.max()])

    def probability(self, logits: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(logits), self.constant)
        z = np.clip(logits @ self.combine[:3] + self.combine[3], -40, 40)
        return 1 / (1 + np.exp(-z))


def batch_logits(net: ByteNet, texts: list) -> np.ndarray:
    """logits() of several texts, short ones together."""
    data = [utf8(t) for t in texts]
    out = np.empty((len(data), 3))
    at = 0
    while at < len(data):
        end, chunks = at, 0
        while end < len(data) and (end == at or chunks + max(1, -(-len(data[end]) // CHUNK)) <= PIECE):
            chunks += max(1, -(-len(data[end]) // CHUNK))
            end += 1
        if end == at + 1:
            out[at] = net.logits(texts[at])
            at = end
            continue
        group = data[at:end]
        counts = np.array([max(1, -(-len(d) // CHUNK)) for d in group])
        rows = np.frombuffer(b"".join(d.ljust(n * CHUNK, b"\0") for d, n in zip(group, counts.tolist(), strict=True)), np.uint8).reshape(-1, CHUNK)
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        tail = np.zeros((len(rows), READ - CHUNK), np.uint8)
        tail[:-1] = rows[1:, : READ - CHUNK]
        tail[first[1:] - 1] = 0  # a text's last window doesn't read into the next text
        lengths = np.full(len(rows), CHUNK)
        lengths[first + counts - 1] = [len(d) - (n - 1) * CHUNK for d, n in zip(group, counts.tolist(), strict=True)]
        z = net.chunk_logits(net.pool(np.hstack((rows, tail)), lengths))
        out[at:end, 0] = np.add.reduceat(z, first) / counts
        out[at:end, 1] = np.minimum.reduceat(z, first)
        out[at:end, 2] = np.maximum.reduceat(z, first)
        at = end
    return out


# ------------------------------------------------------------------- training


def _chunked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each text all chunks, READ bytes each one after another, and its length."""
    for frame in frames:
        rows = []
        for grade, text in zip(frame["grade"], frame["text"], strict=True):
            data = utf8(text)
            n = max(1, -(-len(data) // CHUNK))
            padded = np.frombuffer(data.ljust(n * CHUNK + READ - CHUNK, b"\0"), np.uint8)
            rows.append((grade, np.lib.stride_tricks.as_strided(padded, (n, READ), (CHUNK, 1), writeable=False).tobytes(), len(data)))
        yield pd.DataFrame(rows, columns=["grade", "chunks", "n_bytes"])


def train(chunks: np.ndarray, lengths: np.ndarray, labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> ByteNet:
    """Filters and layer by Adam on the weighted logistic loss of chunks."""
    rng = np.random.default_rng(seed)
    net = ByteNet((rng.standard_normal((WIDTH, 256, FILTERS)) * 0.3).astype(np.float32), rng.standard_normal(FILTERS) * 0.3, 0.0, np.array([1.0, 0, 0, 0]))
    params = [net.table, net.v, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = 0
    slot = np.arange(WIDTH)[:, None, None]
    epochs = max(1, min(epochs, MAX_STEPS * BATCH // max(1, len(chunks))))
    for epoch in range(epochs):
        order = rng.permutation(len(chunks))
        for at in range(0, len(order), BATCH):
            own = order[at : at + BATCH]
            x, n = chunks[own], lengths[own]
            sums = sum(net.table[k][x[:, k : k + CHUNK : STRIDE]] for k in range(WIDTH))
            sums[np.arange(STEP) * STRIDE >= np.maximum(n, 1)[:, None]] = -1e9
            best = sums.argmax(axis=1)
            pooled = np.take_along_axis(sums, best[:, None, :], 1)[:, 0]
            active = np.maximum(pooled, 0)
            z = active @ net.v + net.c
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[own]) * weights[own] / len(own)
            back = error[:, None] * net.v * (pooled > 0)
            seen = x[np.arange(len(own))[:, None, None], best[:, :, None] * STRIDE + np.arange(WIDTH)].transpose(2, 0, 1)
            flat = (slot * 256 + seen) * FILTERS + np.arange(FILTERS)
            g_table = np.bincount(flat.ravel(), np.broadcast_to(back, seen.shape).ravel(), minlength=net.table.size).reshape(net.table.shape)
            grads = [g_table + 1e-5 * net.table, active.T @ error + 1e-4 * net.v, np.array([error.sum()])]
            t += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.001
            params[2][0] = net.c
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)).astype(p.dtype)
            net.c = float(params[2][0])
    return net


def fit_combination(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weighted logistic regression with a small penalty, by Newton steps."""
    x = np.column_stack((logits, np.ones(len(logits))))
    w = np.zeros(4)
    penalty = np.array([1e-2, 1e-2, 1e-2, 1e-6]) * weights.sum()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (weights * (p - labels)) + penalty * w
        hess = (x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hess, grad)
        w = w - move * min(1.0, 2.0 / max(1e-9, np.abs(move).max()))
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", quality: str = "quality", max_rows: int = MAX_ROWS) -> ByteNet:
    """Fit on at most max_rows labelled documents of each label (MAX_BYTES bytes)."""
    counts = {r["q"]: r["n"] for r in labels.where(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{quality}`").cast("int").alias("q")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = np.array([counts.get(0, 0), counts.get(1, 0)], float)
    if not n.all():
        return ByteNet(np.zeros((WIDTH, 256, FILTERS), np.float32), np.zeros(FILTERS), 0.0, np.zeros(4), float(n[1] / n.sum()) if n.sum() else 0.5)
    chosen = sample_labels(labels, id_col, quality, {0: max_rows, 1: max_rows})
    known = narrow(docs, id_col, text).toDF("id", "text").join(F.broadcast(chosen), "id").dropDuplicates(["id"])
    # at most 2 * max_rows rows: a window over a label is as bounded
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(Window.partitionBy("grade").orderBy(F.xxhash64("id"), "id"))
    first = F.row_number().over(Window.partitionBy("grade").orderBy(F.xxhash64("id"), "id")) == 1
    known = known.withColumn("use", first | (size <= MAX_BYTES)).where("use").select("grade", "text")
    known = materialize(known.repartition(partitions(docs.sparkSession)))
    got = known.mapInPandas(_chunked, "grade int, chunks binary, n_bytes long").toPandas()
    count = np.fromiter((len(c) // READ for c in got["chunks"]), np.int64, len(got))
    y, row = np.repeat(got["grade"].to_numpy(float), count), np.repeat(np.arange(len(got)), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    lengths = np.minimum(CHUNK, got["n_bytes"].to_numpy()[row] - place * CHUNK)
    share = np.array([max(1, (got["grade"] == k).sum()) for k in (0, 1)])
    weight = len(y) / 2 / share[y.astype(int)] / count[row]
    net = train(np.frombuffer(b"".join(got["chunks"]), np.uint8).reshape(-1, READ), lengths, y, weight)

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            z = batch_logits(net, frame["text"].tolist())
            yield pd.DataFrame({"grade": frame["grade"], "a": z[:, 0], "b": z[:, 1], "c": z[:, 2]})

    rows = known.mapInPandas(whole, "grade int, a double, b double, c double").toPandas()
    y = rows["grade"].to_numpy(float)
    share = np.array([max(1, (y == k).sum()) for k in (0, 1)])
    net.combine = fit_combination(rows[["a", "b", "c"]].to_numpy(), y, np.where(y == 1, n[1] / share[1], n[0] / share[0]) / n.sum() * len(y))
    return net


def score(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: id and score, the probability of label 1."""
    columns_of(docs, id_col, text)
    return map_texts(docs, text, [id_col], lambda: lambda texts: [net.probability(batch_logits(net, texts))], "score double")


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4: rows of remainder 2 are held out."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 4
