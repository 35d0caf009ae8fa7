"""Every operator and stage with the awkward cases: clashing names, odd ids,
empty tables, one-sided labels; and the registered queries with their types."""

import os

import numpy as np
import pytest
from fixtures import PASSAGE, awkward, docs
from pyspark.sql import functions as F
from test_models import brute_spans

import corpus_pipeline
from treelens.llm import bytecnn, common, fmindex, media, nearcopies, packing, queries, secrets, sharding, simhash, substring, toxicity, warc

SF = "/root/testdata/sf0.001"
FILES = queries.tokenizer_files()
ITEMS = [(0, PASSAGE), (None, "two")]


def flat_model():
    return toxicity.OrdinalModel(np.empty(0, np.uint64), np.empty(0), np.array([1.0, 2.0, 3.0]))


def flat_net():
    rng = np.random.default_rng(3)
    return bytecnn.ByteNet(rng.standard_normal((bytecnn.WIDTH, 256, bytecnn.FILTERS)).astype(np.float32), rng.standard_normal(bytecnn.FILTERS), 0.0, np.array([1.0, 0, 0, 0]))


def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


#: operators with one row a document and an id column of any name
BY_ID = {
    "toxicity": lambda spark, df, i: toxicity.score(df, flat_model(), i),
    "media": lambda spark, df, i: media.ChunkStore(df, i).read(),
    "substring": lambda spark, df, i: substring.remove_repeats(df, i),
    "fmindex": lambda spark, df, i: fmindex.find_leaks(df, items(spark), i),
    "fmindex, two passes": lambda spark, df, i: fmindex.find_leaks(df, items(spark), i, block_bytes=1, pass_bytes=1),
    "bytecnn": lambda spark, df, i: bytecnn.score(df, flat_net(), i),
    "simhash": lambda spark, df, i: simhash.near_duplicates(df, i),
    "secrets": lambda spark, df, i: secrets.scan_secrets(df, i, repo=i),
}
#: operators that keep all columns
KEEPING = {
    "toxicity": lambda spark, df: toxicity.keep_clean(df, flat_model(), threshold=2.0),
    "simhash": lambda spark, df: simhash.keep_one(df),
    "nearcopies": lambda spark, df: nearcopies.keep_one(df),
    "fmindex": lambda spark, df: fmindex.remove_leaks(df, items(spark)),
    "fmindex, two passes": lambda spark, df: fmindex.remove_leaks(df, items(spark), block_bytes=1, pass_bytes=1),
    "secrets": lambda spark, df: secrets.redact_secrets(df),
    "sharding": lambda spark, df: sharding.assign_shards(df, ["a", "b"], "doc_id", size=101).drop("slot", "shard"),
}
MADE = "fp component_id grade toxic expected_severity score n_words spans items kept n_removed n_bytes feature n_assign n_owned start ids rid found slot shard made anchor c0".split()


def crowded(spark, rows=None):
    """documents with a column of every name that operators use within."""
    df = docs(spark, rows)
    taken = [*MADE, "__found", "__spans", "__id", "__rid", "found_spans", "row", "body", "hash", "pack", "n_owners", "block"]
    return df.select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(k).alias(n) for k, n in enumerate(taken)))


@pytest.mark.parametrize("name", BY_ID)
def test_id_columns_of_any_name(spark, name):
    base = docs(spark).select("doc_id", "text", "source")
    want = [tuple(r) for r in BY_ID[name](spark, base, "doc_id").collect()]
    made = BY_ID[name](spark, base, "doc_id").columns[1:]
    taken = next(c for c in made)
    got = BY_ID[name](spark, base.withColumnRenamed("doc_id", taken), taken)
    assert got.columns == [taken, *("_" + c if c == taken else c for c in made)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", KEEPING)
def test_all_columns_are_kept_whatever_their_names(spark, name):
    df = crowded(spark)
    got = KEEPING[name](spark, df)
    if name == "sharding":
        df = df.drop("slot", "shard")
        got = got.select(df.columns)
    assert got.columns == df.columns
    left = {(k, v) for k, v in enumerate(df.columns) if v not in ("doc_id", "text", "lang", "source", "n_chars")}
    first = df.first()
    assert all(r[v] == first[v] for r in got.collect() for _, v in left)
    empty = KEEPING[name](spark, crowded(spark, []))
    assert empty.count() == 0


@pytest.mark.parametrize("name", BY_ID)
def test_empty_tables_give_no_rows(spark, name):
    assert BY_ID[name](spark, docs(spark, []), "doc_id").count() == 0


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_ids_of_other_types(spark, kind):
    rows = [(b"\xff\x00" if k else b"a", f"text {k}") for k in range(2)] + [(None, "no id")]
    df = spark.createDataFrame(rows, "doc_id binary, text string").withColumn("source", F.lit("s"))
    make = {"string": F.base64("doc_id"), "binary": F.col("doc_id")}
    df = df.withColumn("doc_id", make[kind])
    ids = sorted(map(repr, (r["doc_id"] for r in df.collect())))
    for name, run in BY_ID.items():
        if name == "substring":
            with pytest.raises(ValueError):
                run(spark, df, "doc_id")
            continue
        assert sorted(map(repr, (r["doc_id"] for r in run(spark, df, "doc_id").collect()))) == ids, name
    pieces = packing.pack(df, **FILES)
    assert {repr(r["doc_id"]) for r in pieces.collect()} == set(ids)
    with pytest.raises(ValueError):
        media.ChunkStore(df.withColumn("doc_id", F.struct("doc_id")))


def test_keys_named_slot_and_shard(spark):
    df = spark.createDataFrame([("a", "b"), (None, "c")], "slot string, shard string")
    want = {(r["a"], r["b"]) for r in sharding.assign_shards(df.toDF("k", "l"), ["x", "y", "z"], "k", "l", size=101).select(F.col("slot").alias("a"), F.col("shard").alias("b")).collect()}
    assert {(r["slot"], r["shard"]) for r in sharding.assign_shards(df, ["x", "y", "z"], "slot", "shard", size=101).collect()} == want


def test_packing_gives_way_to_carried_names(spark):
    df = crowded(spark)
    got = packing.pack(df, **FILES, carry=("ids", "start"))
    assert got.columns == ["doc_id", "ids", "start", "_start", "length", "doc_tokens", "sequence_id", "offset", "_ids"]
    assert {r["doc_id"] for r in got.collect()} == {r[0] for r in awkward()}


def brute_severity(text, model):
    """Features, weights and probabilities written out, one at a time."""
    import math
    import re

    import xxhash

    counts = {}
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for name in {f"w:{w}"} | ({f"4:{w[:4]}"} if len(w) > 4 else set()) | ({f"5:{w[:5]}"} if len(w) > 5 else set()):
            f = xxhash.xxh64_intdigest(name, 7)
            counts[f] = counts.get(f, 0) + 1
    weight = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    z = sum(weight[f] * (1 + math.log(n)) for f, n in counts.items() if f in weight)
    return [1 / (1 + math.exp(-max(-40.0, min(40.0, z - t)))) for t in model.thresholds.tolist()]


def test_severity_against_brute_force(spark):
    rows = [(i, " ".join(["clean words here now"] * (i % 3 + 1)), "en", "a") for i in range(30)]
    rows += [(100 + i, "you pathetic loser " * (i % 4 + 1) + "words " + "scum " * (i % 2), "en", "a") for i in range(12)]
    rows += [(200, None, "en", "a"), (201, "", "en", "a"), (202, "x" * 200_000 + " loser", "en", "a"), (203, "Pathetic LOSER", "en", "a"), (203, "Pathetic LOSER", "en", "a")]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in [*range(30), *range(100, 112)]], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    assert len(model.features) > 3 and (np.diff(model.thresholds) > 0).all()
    got = toxicity.score(df, model).collect()
    text = {r[0]: r[1] for r in rows}
    for r in got:
        above = brute_severity(text[r["doc_id"]], model)
        assert abs(r["expected_severity"] - sum(above)) < 1e-9 and abs(r["p_toxic"] - above[0]) < 1e-9
        assert r["grade"] == sum(p >= 0.5 for p in above) and r["toxic"] == (above[0] >= 0.5)
    assert {r["doc_id"] for r in got if r["toxic"]} >= {*range(100, 112), 203} and not any(r["toxic"] for r in got if r["doc_id"] < 30)


@pytest.mark.parametrize("labels", [[(0, 1), (8, 1)], [(0, 0)], [], [(10**9, 1), (0, 0)], [(None, 1), (0, None)]])
def test_labels_of_one_kind_reject_nothing(spark, labels):
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs(spark), toxicity.fit(docs(spark), frame)).collect()
    assert not any(r["toxic"] for r in got) and all(r["expected_severity"] < 1e-9 for r in got)


def test_kinds_of_records(spark):
    h = {"ETag": "1"}
    rows = [
        (1, "response", "http://a.com/", 1, h, "d"), (2, "request", "http://a.com/", 2, h, "q"), (3, "metadata", "http://a.com/", 3, None, "m"), (4, None, "http://a.com/", 4, h, None),
        (5, "revisit", "http://a.com/", 5, h, None), (6, "response", "", 1, h, "e"), (7, "revisit", "", 2, h, None), (8, "response", " /x", 1, h, "e"), (9, "revisit", "/x", 2, h, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, kind string, uri string, ts long, headers map<string,string>, digest string")
    got = {r["record_id"]: (r["status"], r["response_id"], r["digest"]) for r in warc.resolve_revisits(df).collect()}
    assert got == {
        1: ("full", 1, "d"), 2: ("other", None, "q"), 3: ("other", None, "m"), 4: ("other", None, None), 5: ("resolved", 1, "d"),
        6: ("full", 6, "e"), 7: ("no_response", None, None), 8: ("full", 8, "e"), 9: ("no_response", None, None),
    }


def test_base_values_have_owners_and_copied_examples_are_none(spark):
    shared, own, spread = "hunter2hunter2", "sEcretOf1Only", "Zx9kQ27bLm4TtR8pWv3Ns6Yd"
    rows = [(i, f"password={shared}", "en", f"o{i}") for i in range(5)] + [(9, f"password={own}", "en", "o1")] + [(100 + i, f"see {spread} here", "en", "hot") for i in range(6)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan_secrets(docs(spark, rows), max_repos=5).collect()}
    assert [(s["n_owners"], s["n_repos"]) for s in got[0]] == [(5, 5)] and [(s["n_owners"], s["n_repos"]) for s in got[9]] == [(1, 1)]
    assert all(not got[100 + i] for i in range(6))  # one owner, but six repositories
    few = secrets.scan_secrets(docs(spark, rows), max_repos=6).where("doc_id >= 100").collect()
    assert all([(s["kind"], s["n_owners"], s["n_repos"]) for s in r["spans"]] == [(secrets.OWNED, 1, 6)] for r in few)


def test_secrets_of_awkward_documents(spark):
    got = secrets.scan_secrets(docs(spark)).collect()
    want = sorted(repr((r[0], brute_spans(r[1]))) for r in awkward())
    assert sorted(repr((r["doc_id"], [(s["start"], s["kind"], s["end"]) for s in r["spans"] if s["kind"] < 3])) for r in got) == want


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 99, k) for k in range(300)], "k long, x long")
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> 5").withColumn("y", F.col("k") * 2)
    want = sorted((r["k"], r["x"], r["k"] * 2) for r in rows.collect() if r["k"] != 5)
    for hot in (1, 4, common.HOT):
        old, common.HOT = common.HOT, hot
        try:
            got = common.join_counted(rows, table, "k", "n")
            assert sorted((r["k"], r["x"], r["y"]) for r in got.collect()) == want
        finally:
            common.HOT = old


def test_a_cluster_must_name_a_shared_folder(spark):
    from treelens.sources import shared

    class Conf:
        def get(self, *_):
            return None

        def set(self, *_):
            raise AssertionError

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "x"})

    for f in (common.shared_dir, shared.shared_dir):
        with pytest.raises(RuntimeError):
            f(Session())


# -------------------------------------------------------- registered queries

TYPES = {
    "op1": {"doc_id": "bigint", "expected_severity": "double", "p_toxic": "double", "grade": "int", "toxic": "boolean"},
    "op2": {"record_id": "bigint", "kind": "string", "ts": "bigint", "canonical": "string", "status": "string", "response_id": "bigint", "digest": "string", "header_lines": "string"},
    "op3": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op4": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op5": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op7": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op10": {"doc_id": "bigint", "slot": "int", "shard": "string"},
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("op", TYPES)
def test_registered_query(spark, op):
    name = next(n for n in queries.QUERIES if n.startswith(op + "_"))
    df = queries.QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    assert {c: kinds[c] for c in TYPES[op]} == TYPES[op]
    rows = df.collect()
    ids = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    if op == "op2":
        assert len(rows) == 2 * spark.read.parquet(f"{SF}/pages.parquet").count()
    else:
        assert {r["doc_id"] for r in rows} == ids and (op == "op5" or len(rows) == len(ids))


# ------------------------------------------------------------------ pipeline


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('bare')}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_with_awkward_documents_and_bare_tables(spark, bare, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    df = crowded(spark)
    got = stage(spark, df, bare)
    if name == "packing":
        assert {r["doc_id"] for r in got.collect()} == {r[0] for r in awkward()}
        assert stage(spark, crowded(spark, []), bare).count() == 0
        return
    assert got.columns == df.columns and stage(spark, crowded(spark, []), bare).count() == 0
    rows = got.collect()
    if name == "simhash_near_dedup":
        assert len({r["text"] or "" for r in rows}) == len(rows)
    else:
        assert len(rows) == len(awkward())
    if name in ("toxicity", "benchmark_decontamination"):
        assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, map(tuple, df.collect())))


def test_run_of_an_empty_table(spark, tmp_path):
    docs(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    before = common.written()
    assert corpus_pipeline.run(spark, f"{tmp_path}").count() == 0
    assert common.written() <= before + 4  # tables of finished stages are gone
