"""Near copies of the pipeline's second stage against brute force."""

import random

import pytest
from fixtures import awkward, docs, lower, space_words, words
from test_models import brute_components, brute_fingerprint

import corpus_pipeline
from treelens.llm import nearcopies


def shingles(text):
    own = space_words(lower(text))
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)}


def similarity(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def edited(text, n, seed):
    own, rnd = text.split(" "), random.Random(seed)
    for i in rnd.sample(range(len(own)), n):
        own[i] = f"edit{seed}x{i}"
    return " ".join(own)


def corpus():
    rows = []
    for i in range(12):
        base = words(200, 500 + i)
        rows += [(10 * i + 5, base, "en", "a"), (10 * i + 3, edited(base, 2, i), "en", "a"), (10 * i + 4, edited(base, 4, 50 + i), "en", "b"), (10 * i + 6, edited(base, 30, 90 + i), "en", "b")]
    return rows + [(1000 + r[0] if r[0] is not None and r[0] >= 0 else r[0], *r[1:]) for r in awkward()]


def brute_kept(rows):
    sets, fps = [shingles(r[1]) for r in rows], [brute_fingerprint(r[1]) for r in rows]
    group = brute_components(fps)
    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return {min((r[0] for r, h in zip(rows, group, strict=True) if h == g and r[0] is not None), default=None) for g in set(group)}


@pytest.mark.parametrize("group", [nearcopies.GROUP, 2])
def test_near_copies_go(spark, group):
    rows = corpus()
    base, near = shingles(rows[0][1]), shingles(rows[1][1])
    assert 0.8 <= similarity(base, near) < 1 and (brute_fingerprint(rows[0][1]) ^ brute_fingerprint(rows[1][1])).bit_count() > 3
    got = nearcopies.keep_one(docs(spark, rows), group=group)
    assert got.columns == docs(spark, rows).columns
    kept = [r["doc_id"] for r in got.collect()]
    assert len(kept) == len(set(kept)) and set(kept) == brute_kept(rows)
    assert nearcopies.keep_one(docs(spark, [])).count() == 0


def test_the_stage_drops_near_copies(spark):
    rows = corpus()
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert {r["doc_id"] for r in stage(spark, docs(spark, rows), "").collect()} == brute_kept(rows)


def test_signatures_of_texts_do_not_depend_on_the_batch():
    texts = [r[1] for r in corpus()]
    digest, count, bands = nearcopies.signatures(texts)
    for i, t in enumerate(texts):
        d, c, b = nearcopies.signatures([t])
        assert (d[0], c[0], b[0].tolist()) == (digest[i], count[i], bands[i].tolist())
