"""Operators that scan documents: decontamination, substrings, media, packing."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from fixtures import PASSAGE, alnum_words, awkward, docs, space_words, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treelens.llm import fmindex, media, packing, substring
from treelens.llm.common import ALNUM, SPACES, Words, merged, span_hashes, whole_documents
from treelens.llm.queries import tokenizer_files

FILES = tokenizer_files()


def key(v):
    return (v is not None, v if v is not None else 0)


# ---------------------------------------------------------------- foundations


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é\t\n\x0b\x00-9", max_size=12), min_size=1, max_size=5))
def test_words_match_the_pattern(texts):
    for lut, pattern in ((SPACES, space_words), (ALNUM, None)):
        got = Words([t.encode() for t in texts], lut, b"\n")
        for k, t in enumerate(texts):
            own = [got.word(i).decode() for i in range(got.first[k], got.first[k + 1])]
            if pattern:
                assert own == pattern(t)
            else:
                assert own == [w for w in alnum_words(t)] or any("A" <= c <= "Z" for c in t)


def test_span_hashes_depend_on_content_only():
    data = np.frombuffer(b"abcXXabcYabd", np.uint8).astype(np.uint64) + np.uint64(3)
    h = span_hashes(data, np.array([0, 5, 9, 0]), np.array([3, 8, 12, 2]))
    assert h[0] == h[1] and len({*h.tolist()}) == 3


def test_whole_documents_keeps_rows_and_bounds():
    import pandas as pd

    texts = ["a" * n for n in (3, 50, 2, 2, 2, 0, 9, 100)] + [None]
    out = list(whole_documents(iter([pd.DataFrame({"text": texts[:4]}), pd.DataFrame({"text": texts[4:]})]), "text", 10))
    assert [t for f in out for t in f["text"]] == texts
    assert all(len(f) == 1 or sum(len(t or "") for t in f["text"]) <= 10 for f in out)


def test_merged():
    assert merged(np.array([5, 0, 2, 20]), np.array([8, 2, 5, 21])) == [(0, 8), (20, 21)]


# ------------------------------------------------------------ decontamination


def brute_leaks(texts, items, width):
    windows = []
    for item, text in items:
        own = alnum_words(text)
        n = min(width, len(own))
        if n:
            windows.append((item, {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}, n))
    out = []
    for text in texts:
        own, hit, found = alnum_words(text), set(), set()
        for item, some, n in windows:
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in some:
                    hit |= set(range(i, i + n))
                    found.add(item)
        out.append((len(own), len(hit), sorted(found)))
    return out


@settings(max_examples=120, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(1, 5))
def test_fm_index_against_brute_force(rnd, width):
    vocabulary = ["a", "B", "c", "dé", "x1"][: rnd.randint(1, 5)]
    make = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    texts = list(dict.fromkeys([make(rnd.randint(0, 50)) for _ in range(rnd.randint(1, 6))] + [""]))
    items = [(str(k), rnd.choice([make(rnd.randint(0, 9)), None, ""])) for k in range(rnd.randint(0, 5))]
    phrases = fmindex.Phrases(items, width)
    scanned, hits = fmindex.shard_hits([t.encode() for t in texts], phrases)
    got = [(int(scanned.first[k + 1] - scanned.first[k]), sum(b - a for a, b in merged(s, e)), sorted({phrases.ids[i] for i in found})) for k, (s, e, found) in enumerate(hits)]
    assert got == brute_leaks(texts, items, width)


def test_suffix_array_and_ranks():
    rnd = random.Random(3)
    text = np.array([rnd.randrange(1, 4) for _ in range(200)] + [0])
    order = fmindex.suffix_array(text, 4)
    assert order.tolist() == sorted(range(201), key=lambda i: text[i:].tolist())
    matrix = fmindex.WaveletMatrix(text, 4)
    at = np.arange(201)
    for c in range(4):
        assert matrix.rank(np.full(201, c), at).tolist() == [int((text[:i] == c).sum()) for i in range(201)]
    symbol, before = matrix.access_rank(at)
    assert symbol.tolist() == text.tolist() and before.tolist() == [int((text[:i] == text[i]).sum()) for i in range(201)]


ITEMS = [(0, PASSAGE), (1, "one"), (2, ""), (3, None), (4, "Alpha1 " + " ".join(PASSAGE.split()[5:16])), (5, PASSAGE), (None, "two"), (6, words(12, 5))]


@pytest.mark.parametrize(("block_bytes", "pass_bytes"), [(fmindex.BLOCK_BYTES, fmindex.PASS_BYTES), (300, fmindex.PASS_BYTES), (300, 700)])
def test_leaks_of_awkward_documents(spark, block_bytes, pass_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = fmindex.find_leaks(docs(spark), items, block_bytes=block_bytes, pass_bytes=pass_bytes, keep_text=True).collect()
    rows = awkward()
    # an item without an id hits words but has no name
    want = [(n, hit, [i for i in found if i != "None"]) for n, hit, found in brute_leaks([r[1] for r in rows], [(str(i), t) for i, t in ITEMS], 10)]
    mine = sorted((key(r["doc_id"]), r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) for r in got)
    assert mine == sorted((key(r[0]), *w) for r, w in zip(rows, want, strict=True)) and (key(7), 2, 1, []) in mine
    for r in got:
        left = alnum_words(fmindex.remove_spans(r["text"], r["byte_spans"]))
        assert len(left) == r["n_words"] - sum(s["end"] - s["start"] for s in r["spans"])


def test_blocks_and_passes_of_the_benchmark(spark):
    items = spark.createDataFrame([*ITEMS, (0, PASSAGE), (0, PASSAGE)], "item_id long, text string").coalesce(1)
    count = lambda *sizes: [len(p) for p in fmindex.benchmark_passes(items, "item_id", "text", 10, *sizes)]
    assert count() == [1] and len(count(300, 10**9)) == 1 and count(300, 10**9)[0] > 2 and len(count(300, 700)) == 2
    # several rows of one id count once, whatever the blocks
    for sizes in ((fmindex.BLOCK_BYTES, fmindex.PASS_BYTES), (300, 10**9), (300, 700)):
        nine = next(r for r in fmindex.find_leaks(docs(spark), items, block_bytes=sizes[0], pass_bytes=sizes[1]).collect() if r["doc_id"] == 9)
        assert nine["items"] == sorted(set(nine["items"])) and "0" in nine["items"]


@pytest.mark.parametrize(("block_bytes", "pass_bytes"), [(fmindex.BLOCK_BYTES, fmindex.PASS_BYTES), (300, 700)])
def test_remove_leaks_keeps_clean_rows_as_they_are(spark, block_bytes, pass_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    frame = docs(spark)
    out = fmindex.remove_leaks(frame, items, block_bytes=block_bytes, pass_bytes=pass_bytes)
    assert out.columns == frame.columns
    rows = out.collect()
    assert len(rows) == len(awkward()) - 1  # the document "one" is nothing but a leak
    clean = {r[0]: r[1] for r in awkward() if r[0] not in (6, 7, 8, 9, 11, 12)}
    assert all(r["text"] == clean[r["doc_id"]] for r in rows if r["doc_id"] in clean and r["doc_id"] is not None)
    nine = next(r for r in rows if r["doc_id"] == 9)
    assert nine["text"] == "Start. \n\nEnd, of it." and nine["n_chars"] == len(nine["text"]) and nine["rid"] == "rid"


def test_leaks_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert fmindex.find_leaks(docs(spark, []), none).count() == 0
    assert all(r["spans"] == [] for r in fmindex.find_leaks(docs(spark), none).collect())


# ----------------------------------------------------------------- substrings


def brute_substrings(rows, width):
    first, out = {}, []
    for i, text, *_ in rows:
        own = space_words(text)
        if i is not None:
            for k in range(len(own) - width + 1):
                w = tuple(own[k : k + width])
                first[w] = min(first.get(w, i), i)
    for i, text, *_ in rows:
        own, gone = space_words(text), set()
        if i is not None:
            for k in range(len(own) - width + 1):
                if first[tuple(own[k : k + width])] < i:
                    gone |= set(range(k, k + width))
        out.append((key(i), len(own), len(gone), " ".join(w for k, w in enumerate(own) if k not in gone)))
    return sorted(out)


def test_substrings_of_awkward_documents(spark):
    got = substring.remove_repeats(docs(spark, parts=4)).collect()
    assert sorted((key(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_substrings(awkward(), 13)
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] for r in got)
    assert substring.remove_repeats(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("bucket", "fanout"), [(50, substring.FANOUT), (50, 3), (400, 2), (10**6, 1)])
def test_substrings_of_random_documents_and_small_buckets(spark, bucket, fanout):
    rnd = random.Random(8)
    rows = [(i if rnd.random() > 0.1 else rnd.randrange(30), " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 25))), None, None) for i in range(120)]
    got = substring.remove_repeats(docs(spark, rows, 5), width=4, bucket=bucket, fanout=fanout).collect()
    assert sorted((key(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == brute_substrings(rows, 4)


# ---------------------------------------------------------------------- media


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=6000), st.binary(max_size=3000))
def test_chunks_rebuild_and_depend_on_content(a, b):
    data = a * 9
    chunks = media.chunks_of(data) if data else []
    assert b"".join(chunks) == data and all(len(c) <= media.MAX_CHUNK for c in chunks)
    joined = b + data  # the same media inside other bytes is cut alike
    if data:
        cuts = media.cut_points(np.frombuffer(joined, np.uint8), [len(b)], [len(joined)])[0]
        assert [c - len(b) for c in cuts] == np.cumsum([len(c) for c in chunks]).tolist()


def test_chunks_survive_an_insertion():
    data = random.Random(1).randbytes(400_000)
    a, b = set(media.chunks_of(data)), set(media.chunks_of(data[:1000] + b"!" + data[1000:]))
    assert len(a & b) > 0.9 * len(a)


def test_media_round_trip(spark):
    store = media.ChunkStore(docs(spark, parts=4))
    got = store.read().collect()
    want = []
    for i, text, *_ in awkward():
        data = (text or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 192)) * 192)
        wav = media.encode_wav(payload)
        assert media.decode_wav(wav) == payload
        want.append((key(i), len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(wav), hashlib.sha256(wav).hexdigest(), media.features(payload)))
    assert sorted((key(r["doc_id"]), *(r[c] for c in media.FIELDS[:-1])) for r in got) == sorted(want)
    kept = store.store().collect()
    assert len({r["digest"] for r in kept}) == len(kept) and all(media.digest_of(r["bytes"]) == r["digest"] for r in kept)
    assert store.names.where("n_packs > 1").count() > 0  # copies in several packs were joined
    assert media.ChunkStore(docs(spark, [])).read().count() == 0


def test_wrong_bytes_are_noticed():
    wav = media.encode_wav(b" " * 192)
    with pytest.raises(ValueError):
        media.read_back(wav[:-1] + b"x", hashlib.sha256(wav).digest(), 0, 1)


# -------------------------------------------------------------------- packing


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("ab'sSrelvtm \n\t\r 　é12٣.,-😀İſ\x1c")), st.characters(codec="utf-8")), max_size=40))
def test_ranks_give_the_file_s_ids(text):
    coder = packing.tokenizer(FILES["path"], FILES["ranks_path"], FILES["pattern"])
    assert coder.encode(text).tolist() == coder.base.encode(text, add_special_tokens=False).ids


def test_hilbert_curve_is_one_unbroken_walk():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_packing_of_awkward_documents(spark):
    got = packing.pack(docs(spark), **FILES, length=64, carry=("lang",)).collect()
    tokens = defaultdict(list)
    coder = packing.tokenizer(FILES["path"]).base
    want = Counter((i, tuple(coder.encode(t or "", add_special_tokens=False).ids + [1])) for i, t, *_ in awkward())
    places = defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        tokens[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for s in places.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 64 and (at == 64 or at & (at - 1) == 0)
        total += at
    assert total == sum(len(t) * n for (_, t), n in want.items()) and sorted(places) == list(range(len(places)))
    for (i, n), parts in tokens.items():
        copies = [t for (j, t), m in want.items() for _ in range(m) if j == i and len(t) == n]
        assert sum(len(p) for _, p in parts) == sum(map(len, copies))
        if len(copies) == 1:
            assert tuple(x for _, p in sorted(parts) for x in p) == copies[0]
    assert packing.pack(docs(spark, []), **FILES).count() == 0


def test_neighbours_on_the_curve_are_alike(spark):
    """Documents of one vocabulary come to lie nearer each other than by chance."""
    rows = [(i, words(60, i, ("aa", "bb") if i % 2 else ("yy", "zz")), None, None) for i in range(120)]
    got = packing.pack(docs(spark, rows), **FILES, length=512).orderBy("sequence_id", "offset").where(F.col("start") == 0).collect()
    kinds = [r["doc_id"] % 2 for r in got]
    assert sum(a == b for a, b in zip(kinds, kinds[1:], strict=False)) > 0.7 * len(kinds)
    assert public_tokenizers.path("byte_bpe_50k.json") == FILES["path"]
