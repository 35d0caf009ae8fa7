"""Media columns with content-defined payload chunking.

A text becomes a payload (UTF-8, padded with spaces to a positive multiple of
192 bytes), stored losslessly as a WAV of 8-bit mono samples.  A rolling gear
hash cuts the stored bytes into chunks where their content says so; a chunk is
named by a digest and kept once in the corpus.  A media is the ordered list of
its chunks; reading it back fetches them, checks the SHA-256 of the whole and
takes the samples out of the container again.

Layout, for scale:

1. Documents are stored where they are read, in packs of bounded size: the
   different chunks of the pack, compressed, and the chunk list of each document.
2. Spark joins deduplicate digests over packs: the smallest pack that holds a
   chunk owns it.  Only names move, one a pack and chunk.
3. Each pack reads back the documents whose chunks it owns.  Chunks that other
   packs need leave it once; documents that need chunks of other packs go on.
4. Those lists are joined with the shared chunks and put together by document.
   A chunk that very many documents need is salted by the count of its packs.

Copies that a pack does not own are never read: after step 2 they are garbage
that `store` leaves out.

Defined results: a null or empty text is a payload of 192 spaces; equal texts
have equal values; ids of any atomic type (binary ones too), null or repeated,
give a row for each row, ids of other types raise; an empty table gives no rows;
other columns are not read; an id column named as one of FIELDS keeps its name,
and the field gets an underscore in front.
"""

from __future__ import annotations

import bz2
import hashlib
import io
import struct
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, join_counted, materialize, narrow, splitmix, utf8, whole_documents

UNIT = 192
RATE = 8000
MIN_CHUNK, MASK_BITS, MAX_CHUNK = 512, 12, 32768
PACKS_A_SALT = 64
DIGEST = 16

#: the gear table: a 32-bit number for each byte, by rule
GEAR = splitmix(np.arange(1000, 1256, dtype=np.uint64)).astype(np.uint32)


# ----------------------------------------------------------------- the format


def payload_of(text) -> tuple[bytes, int]:
    """The padded payload of a text and its length before."""
    data = utf8(text)
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" "), len(data)


def encode_wav(payload: bytes) -> bytes:
    """A WAV file whose 8-bit mono samples are the payload (of even length)."""
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def decode_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media)) as f:
        if (f.getnchannels(), f.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return f.readframes(f.getnframes())


def features(samples: bytes) -> str:
    """Frames, mean level in hundredths, peak, mean step and crossings of the middle."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    high = x >= 128
    step = int(np.abs(np.diff(x)).sum())
    return f"frames={len(x)};level={int(x.sum()) * 100 // len(x)};peak={int(np.abs(x - 128).max())};step={step * 100 // max(1, len(x) - 1)};crossings={int((high[1:] != high[:-1]).sum())}"


# ------------------------------------------------------------------- chunking


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte the rolling hash h = 2 h + GEAR[byte] modulo 2**32, which
    the last 32 bytes decide; by doubling the window five times."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cut_points(data: np.ndarray, starts: list[int], ends: list[int]) -> list[list[int]]:
    """The end of each chunk of each media that lies at data[start:end].

    A cut follows a byte whose hash has MASK_BITS upper bits clear, not within
    MIN_CHUNK of the last cut (more than the hash's window, so what stands
    before a media cannot matter), and at MAX_CHUNK at the latest."""
    marks = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - MASK_BITS) == 0) + 1
    out = []
    for at, end in zip(starts, ends, strict=True):
        own = []
        while end - at > MIN_CHUNK:
            k = np.searchsorted(marks, at + MIN_CHUNK)
            at = min(int(marks[k]) if k < len(marks) else end, at + MAX_CHUNK, end)
            own.append(at)
            if at == end:
                break
        if not own or own[-1] != end:
            own.append(end)
        out.append(own)
    return out


def chunks_of(media: bytes) -> list[bytes]:
    cuts = cut_points(np.frombuffer(media, np.uint8), [0], [len(media)])[0]
    return [media[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]


def digest_of(chunk) -> bytes:
    return hashlib.blake2b(chunk, digest_size=DIGEST).digest()


# ---------------------------------------------------------------------- packs

_PACK = "ids array<string>, n_bytes binary, shas binary, counts binary, refs binary, digests binary, sizes binary, blob binary"


def _packs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in whole_documents(frames):
        made = [payload_of(t) for t in frame["text"]]
        media = [encode_wav(p) for p, _ in made]
        joined = b"".join(media)
        ends = np.cumsum(np.fromiter(map(len, media), np.int64, len(media)))
        starts = [0, *ends[:-1].tolist()]
        known: dict[bytes, int] = {}
        refs, counts, kept, sizes = [], [], [], []
        view = memoryview(joined)
        for at, cuts in zip(starts, cut_points(np.frombuffer(joined, np.uint8), starts, ends.tolist()), strict=True):
            counts.append(len(cuts))
            for cut in cuts:
                name = digest_of(view[at:cut])
                k = known.setdefault(name, len(known))
                if k == len(kept):
                    kept.append(view[at:cut])
                    sizes.append(cut - at)
                refs.append(k)
                at = cut
        yield pd.DataFrame({
            "ids": [frame["id"].astype(object).where(frame["id"].notna(), None).tolist()],
            "n_bytes": [np.array([n for _, n in made], np.int64).tobytes()],
            "shas": [b"".join(hashlib.sha256(m).digest() for m in media)],
            "counts": [np.array(counts, np.int32).tobytes()], "refs": [np.array(refs, np.int32).tobytes()],
            "digests": [b"".join(known)], "sizes": [np.array(sizes, np.int64).tobytes()],
            "blob": [bz2.compress(b"".join(kept))],
        })


def _names(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for pack, digests in zip(frame["pack"], frame["digests"], strict=True):
            names = [digests[i : i + DIGEST] for i in range(0, len(digests), DIGEST)]
            yield pd.DataFrame({"digest": names, "pack": pack, "at": np.arange(len(names))})


# ------------------------------------------------------------- reading it back

FIELDS = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks")
_FINAL = "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks long"
_NUMBERS = ("n_bytes", "payload_bytes", "tail_crc32", "media_bytes", "n_chunks", "pack", "k", "seq", "salts")
_COLUMNS = ("id", *FIELDS, "pack", "k", "seq", "digest", "salts", "bytes")
_PARTS = f"kind int, {_FINAL}, pack long, k long, seq long, digest binary, salts int, bytes binary"


def read_back(media: bytes, sha: bytes, n_bytes: int, n_chunks: int) -> tuple:
    """The values of FIELDS of a media put together from its chunks."""
    if hashlib.sha256(media).digest() != sha:
        raise ValueError("a media put together from its chunks has another SHA-256")
    payload = decode_wav(media)
    return (n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), sha.hex(), features(payload), n_chunks)


def _read_packs(packs: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
    """kind 0: documents read back; 1: chunks that other packs need; 2: pieces
    of documents that need chunks of other packs (seq -1: what to check)."""
    final, chunks, pieces = [], [], []
    for row in packs.itertuples(index=False):
        blob = bz2.decompress(row.blob)
        ends = np.cumsum(np.frombuffer(row.sizes, np.int64)).tolist()
        starts = [0, *ends[:-1]]
        salts = dict(zip(shared["at"], shared["salts"], strict=True))
        owned = dict(zip(shared["at"], shared["owned"], strict=True))
        name = lambda c, row=row: row.digests[c * DIGEST : (c + 1) * DIGEST]
        for c, own in owned.items():
            if own:
                chunks.append((name(c), salts[c], blob[starts[c] : ends[c]]))
        counts, refs = np.frombuffer(row.counts, np.int32), np.frombuffer(row.refs, np.int32).tolist()
        n_bytes = np.frombuffer(row.n_bytes, np.int64).tolist()
        at = 0
        for k, n in enumerate(counts.tolist()):
            own, sha = refs[at : at + n], row.shas[32 * k : 32 * k + 32]
            at += n
            if all(owned.get(c, True) for c in own):
                final.append((row.ids[k], *read_back(b"".join([blob[starts[c] : ends[c]] for c in own]), sha, n_bytes[k], n)))
                continue
            pieces.append((row.pack, k, -1, None, None, struct.pack("<qq", n_bytes[k], n) + sha, row.ids[k]))
            for seq, c in enumerate(own):
                if owned.get(c, True):
                    pieces.append((row.pack, k, seq, None, None, blob[starts[c] : ends[c]], None))
                else:
                    pieces.append((row.pack, k, seq, name(c), salts[c], None, None))
    parts = []
    for kind, rows, names in ((0, final, ["id", *FIELDS]), (1, chunks, ["digest", "salts", "bytes"]), (2, pieces, ["pack", "k", "seq", "digest", "salts", "bytes", "id"])):
        columns = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {}
        whole = {}
        for c in _COLUMNS:  # whole numbers beside nulls must stay whole
            values = list(columns.get(c, [None] * len(rows)))
            whole[c] = pd.array(values, dtype="Int64") if c in _NUMBERS else pd.Series(values, dtype=object)
        parts.append(pd.DataFrame({"kind": np.full(len(rows), kind, np.int32), **whole}))
    return pd.concat(parts, ignore_index=True)


def _join_pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for own, pieces in zip(frame["id"], frame["pieces"], strict=True):
            head = pieces[0]["bytes"]
            n_bytes, n = struct.unpack("<qq", head[:16])
            out.append((own, *read_back(b"".join(p["bytes"] for p in pieces[1:]), head[16:], n_bytes, n)))
        yield pd.DataFrame(out, columns=["id", *FIELDS])


class ChunkStore:
    """Documents stored as deduplicated chunks.

    packs: what was written; names: (digest, pack, at, owner, n_packs)."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text"):
        source = narrow(docs, id_col, text).toDF("id", "text")
        self.id_col, self.id_type = id_col, source.schema["id"].dataType
        if isinstance(self.id_type, (T.StructType, T.ArrayType, T.MapType)):
            raise ValueError(f"ids of {self.id_type.simpleString()} can't be carried")
        # ids travel as text
        text_id = F.base64("id") if isinstance(self.id_type, T.BinaryType) else F.col("id").cast("string")
        made = source.withColumn("id", text_id).mapInPandas(_packs, _PACK)
        self.packs = materialize(made.withColumn("pack", F.monotonically_increasing_id()))
        names = materialize(self.packs.select("pack", "digests").mapInPandas(_names, "digest binary, pack long, at long"))
        owners = materialize(names.groupBy("digest").agg(F.min("pack").alias("owner"), F.count(F.lit(1)).alias("n_packs")).withColumn("n", F.col("n_packs")))
        # a chunk that all packs hold (that of empty texts, say) spreads over tasks
        self.names = join_counted(names, owners, "digest", "n")

    def store(self) -> DataFrame:
        """(digest, bytes) of every chunk, once."""
        owned = self.names.where(F.col("owner") == F.col("pack")).select("pack", "at")

        def run(packs: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            out = []
            for row in packs.itertuples(index=False):
                blob, ends = bz2.decompress(row.blob), np.cumsum(np.frombuffer(row.sizes, np.int64))
                for c in own["at"]:
                    out.append((row.digests[c * DIGEST : (c + 1) * DIGEST], blob[ends[c] - np.frombuffer(row.sizes, np.int64)[c] : ends[c]]))
            return pd.DataFrame(out, columns=["digest", "bytes"])

        packs = self.packs.select("pack", "digests", "sizes", "blob")
        return packs.groupBy("pack").cogroup(owned.groupBy("pack")).applyInPandas(run, "digest binary, bytes binary")

    def read(self) -> DataFrame:
        """One row a document: its id and FIELDS, read back from the chunks."""
        shared = self.names.where(F.col("n_packs") > 1).select("pack", "at", (F.col("owner") == F.col("pack")).alias("owned"), F.ceil(F.col("n_packs") / PACKS_A_SALT).cast("int").alias("salts"))
        parts = materialize(self.packs.groupBy("pack").cogroup(shared.groupBy("pack")).applyInPandas(_read_packs, _PARTS))
        final = parts.where("kind = 0").select("id", *FIELDS)
        chunks = parts.where("kind = 1").select("digest", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "bytes")
        pieces = parts.where("kind = 2")
        foreign = pieces.where("digest is not null").select("pack", "k", "seq", F.lit(None).cast("string").alias("id"), "digest", F.pmod(F.xxhash64("pack", "k"), F.col("salts")).cast("int").alias("salt"))
        rows = ["pack", "k", "seq", "id", "bytes"]
        every = pieces.where("digest is null").select(rows).unionByName(foreign.join(chunks, ["digest", "salt"]).select(rows))
        listed = every.groupBy("pack", "k").agg(F.max("id").alias("id"), F.sort_array(F.collect_list(F.struct("seq", "bytes"))).alias("pieces"))
        joined = listed.select("id", "pieces").mapInPandas(_join_pieces, _FINAL)
        own = F.unbase64("id") if isinstance(self.id_type, T.BinaryType) else F.col("id").cast(self.id_type)
        both = final.unionByName(joined).select(own.alias("id"), *FIELDS)
        return both.toDF(self.id_col, *free_names([self.id_col], *FIELDS))
