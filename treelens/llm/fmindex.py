"""Benchmark decontamination with an FM-index for each training shard.

A shard is a bounded batch of whole documents (a longer document is a shard of
its own), indexed where it is read, so nothing is shuffled:

* words become numbers; a separator of its own ends each document;
* the suffix array comes from prefix doubling that sorts again only what is
  still tied; the last column is held in a wavelet matrix with bit ranks;
* all test phrases of all items are searched together, backwards, one word a
  step; occurrences are located by walking to sampled suffix positions;
* hits merge into maximal removal spans of words.

Equal texts within a shard are indexed once.  The benchmark is the stated query
set: its word hashes go to the workers in blocks of at most BLOCK_BYTES of text,
and a shard's one index is searched for block after block.  A pass over the
documents takes blocks of PASS_BYTES in all, which bounds what is broadcast; a
larger benchmark makes further passes, and their hits are merged by document.

Defined results: null and empty texts have no words and no hits; a null item
text has no window; windows of an item without an id are hits, but it is not
counted or listed among the items, as it has no name; items with equal text are
all reported, items of one id once; repeated rows give a row each; an empty
documents table gives no rows, an empty benchmark no hits; ids are of any type;
other columns are not read (find_leaks) or kept (remove_leaks), whatever their
names; an id column named as a column of HITS keeps its name, and the new column
gets an underscore in front.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, Words, free_names, importable, map_texts, materialize, merged, narrow, slices, utf8

WIDTH = 10
SAMPLE = 8
BLOCK_BYTES = 8 << 20
PASS_BYTES = 32 << 20


# ------------------------------------------------------------------ the index


class WaveletMatrix:
    """Ranks of and access to the symbols of an array, one bit plane a level."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n = len(symbols)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        s = symbols.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            bit = (s >> np.uint32(level)) & np.uint32(1) != 0
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.zeros(len(words), np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=before[1:])
            self.words.append(words)
            self.before.append(before)
            ones = s[bit]
            self.zeros.append(self.n - len(ones))
            s = np.concatenate((s[~bit], ones))

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        """Set bits among the first i of level k."""
        at = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k][at] + np.bitwise_count(self.words[k][at] & below)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol[j] stands among the first i[j]."""
        lo, hi = np.zeros(len(symbol), np.int64), i.astype(np.int64)
        for k in range(self.levels):
            one = (symbol >> (self.levels - 1 - k)) & 1 == 1
            a, b = self._ones(k, lo), self._ones(k, hi)
            lo = np.where(one, a + self.zeros[k], lo - a)
            hi = np.where(one, b + self.zeros[k], hi - b)
        return hi - lo

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it stands before i."""
        at, lo = i.astype(np.int64), np.zeros(len(i), np.int64)
        symbol = np.zeros(len(i), np.int64)
        for k in range(self.levels):
            one = (self.words[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            a, b = self._ones(k, lo), self._ones(k, at)
            lo = np.where(one, a + self.zeros[k], lo - a)
            at = np.where(one, b + self.zeros[k], at - b)
            symbol = symbol * 2 + one
        return symbol, at - lo


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Sorted suffix starts of an array of numbers below sigma whose suffixes
    all differ before its end (a separator of its own ends each document)."""
    n = len(text)
    bits = max(1, int(sigma).bit_length())
    depth = max(1, min(63 // bits, n))
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key <<= bits
        key[: n - j] |= text[j:] + 1
    order = np.argsort(key)
    sorted_key = key[order]
    head = np.append(True, sorted_key[1:] != sorted_key[:-1])
    slot = np.arange(n)
    group = np.maximum.accumulate(np.where(head, slot, 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    tied = ~head
    tied[:-1] |= ~head[1:]
    slots = np.flatnonzero(tied)
    while len(slots):
        at = order[slots]
        nxt = at + depth
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + second
        inner = np.argsort(key)
        at, key = at[inner], key[inner]
        order[slots] = at
        new = np.append(True, key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))
        rank[at] = slots[first]
        open_ = ~new
        open_[:-1] |= ~new[1:]
        slots = slots[open_]
        depth *= 2
    return order


class FMIndex:
    """Count and locate word phrases in the documents of one shard."""

    def __init__(self, symbols: np.ndarray, doc: np.ndarray, n_docs: int, sigma: int, sample: int = SAMPLE):
        # text: the words of each document, then its separator.  Numbers below
        # n_docs are separators, words follow.  In the last column all
        # separators are 0: no phrase holds one.
        n = len(symbols) + n_docs
        first = np.searchsorted(doc, np.arange(n_docs + 1))
        place = np.arange(len(symbols)) + doc
        ends = first[1:] + np.arange(n_docs)
        text = np.empty(n, np.int64)
        text[place] = symbols + n_docs
        text[ends] = np.arange(n_docs)
        order = suffix_array(text, sigma + n_docs)
        column = np.maximum(text[order - 1] - n_docs + 1, 0)
        self.sigma = sigma + 1
        self.less = np.zeros(self.sigma + 1, np.int64)
        np.cumsum(np.bincount(column, minlength=self.sigma), out=self.less[1:])
        self.matrix = WaveletMatrix(column, self.sigma)
        # sampled: the start of each document and every sample-th word after it
        starts = np.concatenate(([0], ends[:-1] + 1)) if n_docs else np.empty(0, np.int64)
        begin = np.repeat(starts, np.diff(np.append(starts, n)))
        marked = ((np.arange(n) - begin) % sample == 0)[order]
        self.marked = marked
        self.sampled = np.cumsum(marked) - marked
        self.position = order[marked]
        self.doc_start = starts
        self.n = n

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases (a row each, right-aligned, word numbers)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        width = phrases.shape[1]
        for k in range(width):
            on = live[lengths[live] > k]
            if not len(on):
                break
            c = phrases[on, width - 1 - k] + 1
            lo[on] = self.less[c] + self.matrix.rank(c, lo[on])
            hi[on] = self.less[c] + self.matrix.rank(c, hi[on])
            live = on[hi[on] > lo[on]]
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Word positions (without separators) of rows of phrases."""
        at, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.marked[at])
        while len(open_):
            symbol, before = self.matrix.access_rank(at[open_])
            at[open_] = self.less[symbol] + before
            steps[open_] += 1
            open_ = open_[~self.marked[at[open_]]]
        text = self.position[self.sampled[at]] + steps
        return text - (np.searchsorted(self.doc_start, text, side="right") - 1)


# -------------------------------------------------------------- the benchmark


class Phrases:
    """Windows of the items of one benchmark block: the hashes of all its words,
    where each window starts, its length and the number of its item."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        self.width, self.ids = width, [i for i, _ in items]
        words = Words([utf8(t).translate(LOWER) for _, t in items], ALNUM, b"\n")
        self.hashes = words.hashes()
        count = np.diff(words.first)
        take = np.minimum(width, count)
        windows = np.where(count > 0, count - take + 1, 0)
        self.owner = np.repeat(np.arange(len(items), dtype=np.int32), windows)
        inner = np.arange(len(self.owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.start = (words.first[:-1][self.owner] + inner).astype(np.int32)
        self.lengths = take[self.owner].astype(np.int32)

    def numbered(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows whose words are all in the sorted vocabulary, as numbers of
        words (a row each, right-aligned), and which windows they are."""
        at = np.searchsorted(vocabulary, self.hashes)
        missing = np.append(0, np.cumsum(vocabulary[np.minimum(at, len(vocabulary) - 1)] != self.hashes))
        end = self.start + self.lengths
        rows = np.flatnonzero(missing[end] == missing[self.start])
        places = end[rows][:, None] + np.arange(-self.width, 0)  # before the start of a short window: not read
        return at[np.maximum(places, 0)], rows


def shard_hits(texts: list[bytes], *blocks: Phrases) -> tuple[Words, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For each of the (different) texts: starts and ends of occurrences, in
    words of the text, and the number of the item of each, over all blocks."""
    words = Words([t.translate(LOWER) for t in texts], ALNUM, b"\n")
    starts, lengths, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    index, before = None, 0
    if len(words):
        vocabulary, symbols = np.unique(words.hashes(), return_inverse=True)
        for phrases in blocks:
            wanted, which = phrases.numbered(vocabulary)
            if len(which):
                index = index or FMIndex(symbols.astype(np.int64), words.doc, len(texts), len(vocabulary))
                lo, hi = index.search(wanted, phrases.lengths[which])
                count = hi - lo
                found = np.repeat(np.arange(len(which)), count)
                starts.append(index.locate(np.arange(len(found)) - np.repeat(np.cumsum(count) - count, count) + lo[found]))
                lengths.append(phrases.lengths[which][found].astype(np.int64))
                items.append(phrases.owner[which][found].astype(np.int64) + before)
            before += len(phrases.ids)
    start, length, item = (np.concatenate(x) for x in (starts, lengths, items))
    order = np.argsort(start, kind="stable")
    start, length, item = start[order], length[order], item[order]
    cut = np.searchsorted(start, words.first)
    return words, [(start[a:b] - words.first[k], start[a:b] - words.first[k] + length[a:b], item[a:b]) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]


HITS = "n_words long; spans array<struct<start:long,end:long>>; byte_spans array<struct<start:long,end:long>>; items array<string>"


def _scan(blocks: list[Phrases]):
    """f(texts) -> the columns of HITS; the texts are one shard."""
    names = [i for phrases in blocks for i in phrases.ids]

    def scan(texts: list) -> tuple[list, list, list, list]:
        data = [utf8(t) for t in texts]
        different = {t: k for k, t in enumerate(dict.fromkeys(data))}
        words, hits = shard_hits(list(different), *blocks)
        answers = []
        for k, (start, end, item) in enumerate(hits):
            first, spans, offset = words.first[k], merged(start, end), words.offset[k]
            answers.append((
                int(words.first[k + 1] - first), [{"start": a, "end": b} for a, b in spans],
                [{"start": int(words.start[first + a] - offset), "end": int(words.end[first + b - 1] - offset)} for a, b in spans],
                sorted({names[i] for i in np.unique(item).tolist()} - {None}),
            ))
        return tuple([answers[different[t]][c] for t in data] for c in range(4))

    return scan


def benchmark_passes(benchmark: DataFrame, id_col: str, text: str, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> Iterator[list[Phrases]]:
    """The items, read one partition at a time, as blocks of bounded bytes, as
    many as a pass takes.  An item longer than a block is a block of its own.
    There is always a pass."""
    blocks, block, size, total = [], [], 0, 0
    rows = benchmark.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text}`").cast("string")).where(F.col(f"`{text}`").isNotNull())
    for item, body in rows.toLocalIterator():
        n = len(body.encode("utf-8"))
        if block and size + n > block_bytes:
            blocks.append(Phrases(block, width))
            block, size = [], 0
        if blocks and total + n > pass_bytes:
            yield [*blocks, Phrases(block, width)] if block else blocks
            blocks, block, size, total = [], [], 0, 0
        block.append((item, body))
        size += n
        total += n
    yield [*blocks, Phrases(block, width)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, keep_text: bool = False, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row a document: id, n_words, spans and byte_spans (maximal removal
    spans, in words and in UTF-8 bytes of the text) and items (sorted ids)."""
    kept = [id_col, text] if keep_text else [id_col]
    source = narrow(docs, id_col, text).toDF("id", "body")
    scan = lambda frame, carried, blocks: map_texts(frame, "body", carried, lambda b=blocks: _scan(b), HITS)
    passes = benchmark_passes(benchmark, item_id, item_text, width, block_bytes, pass_bytes)
    parts, blocks, more = [], next(passes), next(passes, None)
    names = [*kept, *free_names(kept, *(part.split(" ")[0] for part in HITS.split("; ")))]
    if more is None:
        return scan(source, ["id", "body"] if keep_text else ["id"], blocks).toDF(*names)
    # several passes over all documents: their hits meet by row
    source = materialize(source.withColumn("rid", F.monotonically_increasing_id()))
    while blocks is not None:
        parts.append(materialize(scan(source, ["rid"], blocks)))
        blocks, more = more, next(passes, None)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    gathered = every.groupBy("rid").agg(
        F.max("n_words").alias("n_words"), *(_merge_spans(F.sort_array(F.flatten(F.collect_list(c)))).alias(c) for c in ("spans", "byte_spans")),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return source.select("rid", "id", *["body"] * keep_text).join(gathered, "rid").drop("rid").toDF(*names)


def _merge_spans(spans):
    kind = "array<struct<start:bigint,end:bigint>>"

    def step(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, F.array().cast(kind), step)


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """docs, all columns, with the removal spans cut out of the texts (`n_chars`
    follows where it exists).  Documents that consist of nothing else go."""
    importable(docs.sparkSession)
    at, chars = docs.columns.index(text), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    passes = benchmark_passes(benchmark, item_id, item_text, width, block_bytes, pass_bytes)
    blocks = next(passes)

    def cut(batch, texts, found):
        """batch without found[k] = (n_words, spans, byte_spans, items) of texts[k]."""
        new = [remove_spans(t, f[2]) for t, f in zip(texts, found, strict=True)]
        gone = [bool(len(f[1])) and sum(s["end"] - s["start"] for s in f[1]) == f[0] for f in found]
        out = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
        if chars is not None:
            old = out.column(chars).to_pylist()
            sizes = [len(t) if len(f[1]) else n for n, t, f in zip(old, new, found, strict=True)]
            out = out.set_column(chars, out.schema.field(chars), pa.array(sizes, out.schema.field(chars).type))
        return out.filter(pa.array([not g for g in gone]))

    if next(passes, None) is None:
        scan = _scan(blocks)

        def run(batches):
            for batch in batches:
                for piece in slices(batch, at):
                    texts = piece.column(at).to_pylist()
                    yield cut(piece, texts, list(zip(*scan(texts), strict=True)))

        return docs.mapInArrow(run, docs.schema)
    rid, own = free_names(docs, "rid", "found")
    rows = materialize(docs.withColumn(rid, F.monotonically_increasing_id()))
    found = find_leaks(rows.select(F.col(rid).alias("row"), F.col(f"`{text}`").alias("body")), benchmark, "row", "body", item_id, item_text, width, False, block_bytes, pass_bytes)
    hits = found.where(F.size("spans") > 0).select(F.col("row").alias(rid), F.struct("n_words", "spans", "byte_spans").alias(own))
    width_ = len(docs.columns)

    def apply(batches):
        for batch in batches:
            found = [(f["n_words"], f["spans"], f["byte_spans"]) if f else (0, [], []) for f in batch.column(width_).to_pylist()]
            plain = pa.RecordBatch.from_arrays(batch.columns[:width_], names=batch.schema.names[:width_])
            yield cut(plain, plain.column(at).to_pylist(), found)

    return rows.join(hits, rid, "left").select(*(F.col(f"`{c}`") for c in docs.columns), own).mapInArrow(apply, docs.schema)


def remove_spans(text: str | None, byte_spans) -> str | None:
    """text without the given byte spans; what is left keeps its white space."""
    if text is None or byte_spans is None or not len(byte_spans):
        return text
    data, parts, at = text.encode("utf-8"), [], 0
    for s in byte_spans:
        parts.append(data[at : s["start"]])
        at = s["end"]
    return (b"".join(parts) + data[at:]).decode("utf-8")
