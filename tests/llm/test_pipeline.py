"""The pipeline over a small corpus, held against brute force stage by stage."""

import numpy as np
import pytest
from fixtures import PASSAGE, words
from test_models import brute_components, brute_fingerprint, brute_spans
from test_scan import FILES, brute_leaks

import corpus_pipeline
from treelens.llm import packing

BAD = "pathetic loser scum"
KEY = 'token = "0123456789abcdef0123456789abcdef01234567"'


def corpus():
    rows = [(i, words(80, 100 + i)) for i in range(40)]
    rows += [(40 + i, words(40, 200 + i) + " " + BAD + " " + words(10, 300 + i)) for i in range(8)]
    rows += [(50, rows[3][1]), (51, rows[3][1] + " more"), (52, words(30, 400) + " " + PASSAGE + " " + words(30, 401)), (53, words(50, 402) + " " + KEY + " end"), (54, PASSAGE), (55, None), (56, "")]
    return [(i, t, "en", f"src{i % 3}", len(t) if t is not None else None) for i, t in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(40 <= i < 48)) for i in range(0, 48, 1) if i not in (7, 45, 46)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, PASSAGE)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
    df = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = df.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, df, folder).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({r["doc_id"]: r for r in df.collect()} if name != "packing" else df.collect())
        if name != "packing":
            assert df.columns == columns
    start = {r[0]: r[1] for r in corpus()}
    clean, one, safe, masked, pieces = seen
    assert set(clean) == set(start) - set(range(40, 48))
    ids = sorted(clean)
    group = brute_components([brute_fingerprint(start[i]) for i in ids])
    assert set(one) == {min(i for i, g in zip(ids, group, strict=True) if g == h) for h in group} and 50 not in one and 56 not in one
    hits = brute_leaks([start[i] for i in sorted(one)], [("0", PASSAGE)], 10)
    gone = {i for i, (n, h, _) in zip(sorted(one), hits, strict=True) if h and h == n}
    assert gone == {54} and set(safe) == set(one) - gone
    assert all(safe[i]["text"] == start[i] for i, (_, h, _) in zip(sorted(one), hits, strict=True) if not h)
    assert PASSAGE not in safe[52]["text"] and safe[52]["n_chars"] == len(safe[52]["text"]) == len(start[52]) - len(PASSAGE)
    assert set(masked) == set(safe) and "0123456789abcdef" not in masked[53]["text"] and "[SECRET]" in masked[53]["text"]
    assert all(masked[i]["text"] == safe[i]["text"] for i in safe if not brute_spans(safe[i]["text"]))
    coder = packing.tokenizer(FILES["path"]).base
    for i, r in masked.items():
        own = sorted((p["start"], p["ids"]) for p in pieces if p["doc_id"] == i)
        assert np.frombuffer(b"".join(x for _, x in own), "<u4").tolist() == coder.encode(r["text"] or "", add_special_tokens=False).ids + [1]


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() > 35
