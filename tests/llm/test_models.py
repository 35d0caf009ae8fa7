"""Toxicity, quality, near duplicates, secrets, sharding, revisits, pipeline."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from fixtures import awkward, docs, held_out, lower, space_words, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from treelens.llm import bytecnn, secrets, sharding, simhash, toxicity, warc
from treelens.llm.warc_query import ORACLE, records_of

SF = "/root/testdata/sf0.01"


def key(v):
    return (v is not None, v if v is not None else 0)


def text_docs(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


# ------------------------------------------------------------------- toxicity


def test_cumulative_link_gradient_and_order():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 3, (400, 3)).astype(float)
    z = x @ np.array([2.0, -1.5, 0.0]) + rng.logistic(size=400)
    grades = np.searchsorted([0.5, 2.5, 4.5], z)
    rows = [(np.flatnonzero(r), r[r > 0]) for r in x]
    m = toxicity.fit_ordinal(rows, grades, np.arange(3, dtype=np.uint64), l2=1e-4, steps=800, rate=0.05)
    assert (np.diff(m.thresholds) > 0).all() and np.allclose(m.weights, [2.0, -1.5, 0.0], atol=0.4) and np.allclose(m.thresholds, [0.5, 2.5, 4.5], atol=0.9)
    above = m.exceed(x @ m.weights)
    assert (np.diff(above, axis=1) <= 0).all()
    assert np.corrcoef(above.sum(axis=1), grades)[0, 1] > 0.6


def test_toxicity_on_held_out_rows(spark):
    frame, labels = text_docs(spark)
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = toxicity.fit(frame, labels.where(~fold))
    rows = toxicity.score(frame, model).join(labels, "doc_id").where(fold).select("expected_severity", "p_toxic", labels["toxic"].alias("label")).collect()
    hit = [r for r in rows if r["label"]]
    assert sum(r["p_toxic"] >= 0.5 for r in hit) >= 0.75 * len(hit)
    assert sum(r["p_toxic"] >= 0.5 for r in rows if not r["label"]) <= 0.02 * len(rows)
    assert all(0 <= r["expected_severity"] <= toxicity.GRADES - 1 for r in rows)


def test_toxicity_of_awkward_documents(spark):
    labels = spark.createDataFrame([(0, 0), (9, 1), (8, 1), (11, 0), (None, 1), (5, None), (9, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark), labels)
    got = toxicity.score(docs(spark), model).collect()
    assert sorted(key(r["doc_id"]) for r in got) == sorted(key(r[0]) for r in awkward())
    frame = docs(spark)
    kept = toxicity.keep_clean(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(not r["toxic"] for r in got)
    none = toxicity.fit(frame, labels.where("toxic = 0"))
    assert {r["toxic"] for r in toxicity.score(frame, none).collect()} == {False} and toxicity.keep_clean(frame, none).count() == len(awkward())
    assert toxicity.score(docs(spark, []), model).count() == 0


# -------------------------------------------------------------------- quality


@pytest.fixture(scope="module")
def net(spark):
    frame, labels = text_docs(spark)
    return bytecnn.fit(frame, labels.where(bytecnn.fold() != 2))


def test_quality_on_held_out_rows(spark, net):
    frame, labels = text_docs(spark)
    rows = bytecnn.score(frame, net).join(labels, "doc_id").collect()
    own = [r for r in rows if held_out(r["doc_id"])]
    assert len(own) > 50
    assert np.mean([(r["score"] >= 0.7) == bool(r["quality"]) for r in own]) > 0.9
    assert all(r["score"] >= 0.7 for r in own if r["quality"]) or sum(r["score"] < 0.7 for r in own if r["quality"]) <= 2


def test_quality_of_awkward_documents(spark, net):
    got = bytecnn.score(docs(spark), net).collect()
    assert sorted(key(r["doc_id"]) for r in got) == sorted(key(r[0]) for r in awkward()) and all(0 <= r["score"] <= 1 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(r["doc_id"], set()).add(round(r["score"], 6))
    assert len(by_text[10]) == 1 and by_text[0] == by_text[4] and by_text[2] <= by_text[None]
    assert bytecnn.score(docs(spark, []), net).count() == 0
    one = spark.createDataFrame([(0, 1), (8, 1)], "doc_id long, quality int")
    assert {r["score"] for r in bytecnn.score(docs(spark), bytecnn.fit(docs(spark), one)).collect()} == {1.0}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(max_size=1200), min_size=1, max_size=5))
def test_batches_score_as_single_texts(net, texts):
    texts = [*texts, "", "a" * 248, "b" * 249, "c" * 3000]
    assert np.allclose(bytecnn.batch_logits(net, texts), [net.logits(t) for t in texts], atol=1e-4)


def test_pooling_covers_every_window(net):
    text = words(150, 3)
    data = np.frombuffer(text.encode(), np.uint8)
    padded = np.append(data, np.zeros(300, np.uint8))
    own = np.array([sum(net.table[k][padded[i + k]] for k in range(bytecnn.WIDTH)) for i in range(0, len(data), bytecnn.STRIDE)])
    logits = [net.chunk_logits(own[a : a + bytecnn.STEP].max(axis=0)) for a in range(0, len(own), bytecnn.STEP)]
    assert np.allclose(net.logits(text), [np.mean(logits), np.min(logits), np.max(logits)], atol=1e-3)


# ------------------------------------------------------------ near duplicates


def brute_fingerprint(text):
    own = space_words(lower(text))
    if not own:
        return 0
    k = min(3, len(own))
    shingles = [" ".join(own[i : i + k]) for i in range(len(own) - k + 1)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, threshold=3):
    group = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return group


def test_fingerprints():
    for _, text, *_ in awkward():
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_anchors_meet():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = int(rng.integers(0, 1 << 31))
        y = x ^ (1 << int(rng.integers(0, 31)))
        ix, ax = simhash.anchors(np.array([x]))
        iy, ay = simhash.anchors(np.array([y]))
        assert set(ax.tolist()) & set(ay.tolist()) and len(ax) in (1, 16) and len(set(ax.tolist())) == len(ax)
        assert all((a ^ x).bit_count() <= 2 for a in ax.tolist())


@pytest.mark.parametrize("group", [simhash.GROUP, 4])
def test_link_forest_connects_what_links_connect(spark, group):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(60)}
    centre = rnd.getrandbits(64)
    for _ in range(150):  # a crowd around one fingerprint, and pairs at 3 and 4 bits
        x = centre
        for _ in range(rnd.randint(0, 7)):
            x ^= 1 << rnd.randrange(64)
        fps.add(x)
    for x in list(fps)[:40]:
        fps.add(x ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice([3, 4]))))
    fps = sorted(fps)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    links = simhash.link_forest(spark.createDataFrame([(x,) for x in signed], "fp long"), 3, group)
    for u, v in links.collect():
        assert (np.int64(u) ^ np.int64(v)).view(np.uint64).item().bit_count() <= 3
    root = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    mine = [root.get(x, x) for x in signed]
    want = brute_components(fps)
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_near_duplicates_of_awkward_documents(spark):
    got = simhash.near_duplicates(docs(spark)).collect()
    rows = awkward()
    fps = [brute_fingerprint(r[1]) for r in rows]
    group = brute_components(fps)
    least = {g: min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=None) for g in group}
    want = sorted((key(r[0]), f, key(least[g])) for r, f, g in zip(rows, fps, group, strict=True))
    assert sorted((key(r["doc_id"]), int(np.int64(r["fp"]).view(np.uint64)), key(r["component_id"])) for r in got) == want
    kept = simhash.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns
    assert Counter(key(r["doc_id"]) for r in kept.collect()) == Counter(key(v) for v in dict.fromkeys(least.values()))
    assert simhash.near_duplicates(docs(spark, [])).count() == 0 and simhash.keep_one(docs(spark, [])).count() == 0


def test_long_chain_is_one_component(spark):
    chain = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r["root"] for r in simhash.components(chain).collect()} == {0}


@pytest.mark.parametrize("order", ["ascending", "descending", "shuffled", "broom"])
def test_rounds_are_logarithmic(spark, order):
    n = 1000
    name = list(range(n + 1))
    if order == "descending":
        name.reverse()
    if order == "shuffled":
        random.Random(4).shuffle(name)
    pairs = [(name[i], name[0 if order == "broom" and i < n // 2 else i + 1]) for i in range(n)]
    if order == "broom":
        pairs += [(name[0], name[n])]
    found, rounds = simhash.contract(spark.createDataFrame(pairs, "u long, v long"))
    rows = found.collect()
    assert len(rows) == len({r["node"] for r in rows}) == n + 1 and len({r["root"] for r in rows}) == 1 and rounds <= 15


# -------------------------------------------------------------------- secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 32]
    return sorted(out)


LIVE, COPIED = "Zx9kQ27bLm4TtR8pWv3Ns6Yd", "EXAMPLEkey0123456789abcdEXAMPLE"
SECRETS = [
    (0, f"Token = '{LIVE}' and 😀 again {LIVE}", "en", "a"), (1, f"see {LIVE}.", "en", "a"), (2, f"api_key: {COPIED}", "en", "a"), (3, f"APIKEY={COPIED}", "en", "b"), (4, f"password {COPIED} secret: x", "en", "c"),
    (5, "token=secret=\"abcdefgh12\" passwd: short  password:longenough1", "en", "a"), (6, "AKIA" + "Q" * 12 + " AKIAshort " + "0123456789abcdef" * 3 + "g", "en", None),
    (7, None, None, None), (8, "", "x", "a"), (None, f"é {LIVE}", "en", "a"), (9, f"é {LIVE}", "en", "a"), (9, f"é {LIVE}", "en", "a"), (10, "ab " * 3000 + "deadbeef" * 4, "en", "z"),
]


def test_secret_spans(spark):
    got = secrets.scan_secrets(docs(spark, SECRETS)).collect()
    base = sorted((key(i), brute_spans(t)) for i, t, *_ in SECRETS)
    assert sorted((key(r["doc_id"]), [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] < 3]) for r in got) == base
    owned = lambda i: [t[s["start"] : s["end"]] for r in got if r["doc_id"] == i for s in r["spans"] if s["kind"] == 3 for t in [next(x[1] for x in SECRETS if x[0] == i)]]
    assert owned(0) == [LIVE, LIVE] and owned(1) == [LIVE] and owned(2) == owned(3) == owned(4) == []
    freq = {r["hash"].hex(): (r["n_seen"], r["n_repos"], r["n_owners"]) for r in secrets.ownership(docs(spark, SECRETS)).collect()}
    assert freq[hashlib.sha256(COPIED.encode()).hexdigest()] == (3, 3, 3) and freq[hashlib.sha256(LIVE.encode()).hexdigest()] == (6, 4, 1)
    assert secrets.scan_secrets(docs(spark, [])).count() == 0
    assert len(secrets.scan_secrets(docs(spark)).collect()) == len(awkward())


def test_redaction(spark):
    frame = docs(spark, SECRETS)
    out = secrets.redact_secrets(frame)
    assert out.columns == frame.columns
    text = {r["doc_id"]: r for r in out.collect()}
    assert text[0]["text"] == "[SECRET]' and 😀 again [SECRET]" and text[1]["text"] == "see [SECRET]." and text[7]["text"] is None
    assert text[10]["text"] == "ab " * 3000 + "[SECRET]" and text[10]["n_chars"] == 9008 and text[8]["text"] == ""
    assert text[5]["text"] == 'token=secret="abcdefgh12" passwd: short  [SECRET]'


# ------------------------------------------------------------------- sharding


def test_lookup_table():
    names = [f"s{i}" for i in range(7)]
    a, b = sharding.lookup_table(names, 1009), sharding.lookup_table(names[:-1], 1009)
    counts = Counter(a)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert sum(x != y for x, y in zip(a, b, strict=True)) < 0.35 * 1009
    weighted = Counter(sharding.lookup_table(["a", "b"], 1009, weights=[3, 1]))
    assert abs(weighted[0] - 3 * weighted[1]) <= 4
    for bad in ((["a"], 10), ([], 7), (["a", "a"], 7), (["a", "b", "c"], 2)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def brute_table(names, size):
    """Preference lists written out; shards claim in turns."""
    prefer = [[(sharding._draw(n, "offset", size) + j * (sharding._draw(n, "step", size - 1) + 1)) % size for j in range(size)] for n in names]
    owner, at = [None] * size, [0] * len(names)
    while None in owner:
        for k in range(len(names)):
            while at[k] < size and owner[prefer[k][at[k]]] is not None:
                at[k] += 1
            if at[k] < size:
                owner[prefer[k][at[k]]] = k
    return owner


def test_placement(spark):
    names = ["x", "y", "z"]
    assert sharding.lookup_table(names, 101) == brute_table(names, 101)
    frame = docs(spark)
    got = sharding.assign_shards(frame, names, "doc_id", size=101)
    assert got.count() == len(awkward()) and set(got.columns) == {*frame.columns, "shard"}
    table = brute_table(names, 101)
    for r in got.select("slot", "shard", F.pmod(F.xxhash64("doc_id"), F.lit(101)).alias("h")).collect():
        assert r["slot"] == r["h"] and r["shard"] == names[table[r["h"]]]
    assert sharding.assign_shards(docs(spark, []), names, "doc_id").count() == 0


def test_write_shards(spark, tmp_path):
    sharding.write_shards(docs(spark), f"{tmp_path}/out", ["x", "y"], "doc_id", size=101)
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(awkward())


# ------------------------------------------------------------------- revisits


def test_canonical_urls(spark):
    pairs = {
        "http://WWW.Example.com:80/a/b/?b=2&utm_source=x&a=1#top": "example.com/a/b?a=1&b=2", "https://u:p@example.com": "example.com", "example.com/": "example.com",
        "https://example.com/A?ref=z": "example.com/A", "https://example.com:8080/x?": "example.com:8080/x", " https://e.com/p//": "e.com/p",
    }
    df = spark.createDataFrame([(k,) for k in pairs], "u string").select("u", warc.canonical_url(F.col("u")).alias("c"))
    assert {r["u"]: r["c"] for r in df.collect()} == pairs


def test_resolution(spark):
    h = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        (1, "response", "http://a.com/", 10, h(ETag='"1"', Content_Length="5", Date="10"), "d1"), (2, "response", "http://a.com/", 20, h(ETag='"2"', Date="20"), "d2"),
        (3, "revisit", "https://www.a.com", 20, h(etag='W/"1"', Date="20", Content_Length="0", Vary="x"), None), (4, "revisit", "http://a.com/", 30, h(etag='"1"'), None),
        (5, "revisit", "http://a.com/", 31, h(date="31"), None), (6, "revisit", "http://b.com/", 5, None, None), (7, "revisit", None, 5, None, None), (8, "revisit", "http://a.com/", None, None, None),
        (9, "response", "http://c.com", 1, None, "d9"), (10, "revisit", "http://c.com", 2, h(Last_Modified="x"), "d9"), (11, "revisit", "http://c.com", 3, None, "zz"), (12, "response", "http://a.com/", 20, h(ETag='"3"'), "d12"),
        (5, "revisit", "http://a.com/", 31, h(date="31"), None),
    ]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "record_id long, kind string, uri string, ts long, headers map<string,string>, digest string, status string")
    got = {r["record_id"]: r for r in warc.resolve_revisits(df).collect()}
    assert {i: (r["status"], r["response_id"]) for i, r in got.items()} == {
        1: ("full", 1), 2: ("full", 2), 3: ("resolved", 1), 4: ("mismatch", 12), 5: ("unverified", 12), 6: ("no_response", None), 7: ("no_response", None), 8: ("no_response", None),
        9: ("full", 9), 10: ("resolved", 9), 11: ("mismatch", 9), 12: ("full", 12),
    }
    assert got[3]["headers"] == {"etag": 'W/"1"', "content-length": "5", "date": "20", "vary": "x"} and got[3]["digest"] == "d1" and got[4]["digest"] is None
    assert warc.resolve_revisits(df).count() == len(rows) and warc.resolve_revisits(df.limit(0)).count() == 0
    bodies = spark.createDataFrame([(1, "one"), (12, "twelve")], "record_id long, payload string")
    full = {r["record_id"]: r["payload"] for r in warc.attach_payload(warc.resolve_revisits(df), bodies).collect()}
    assert full[3] == "one" and full[5] == "twelve" and full[4] is None


def test_hot_url_spreads_over_ranges(spark):
    rnd = random.Random(2)
    pages = [(i, "http://hot.com/" if rnd.random() < 0.6 else f"http://x.com/{rnd.randrange(5)}", rnd.choice("ab") * rnd.randrange(1, 60)) for i in range(300)]
    frame = spark.createDataFrame([*pages, (300, None, None)], "page_id long, url string, html string")
    got = warc.resolve_revisits(records_of(frame)).select("record_id", "kind", "ts", "canonical", "status", "response_id", "digest", warc.header_lines(F.col("headers")).alias("header_lines")).where("canonical is not null").collect()
    con = duckdb.connect()
    con.register("pages", frame.where("url is not null").toPandas())
    want = con.sql(ORACLE)
    assert sorted(repr(tuple(r[c] for c in want.columns)) for r in got) == sorted(map(repr, want.fetchall()))
    assert {r["status"] for r in got} == {"full", "resolved", "unverified", "mismatch", "no_response"}
