"""Documents with every awkward case, and brute-force versions of operators."""

import random
import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, text_ string, rid string, key double, n int, fp string, spans string, slot string, part int"


def words(n, seed, vocabulary=("alpha", "beta", "Gamma", "delta", "éps", "zeta", "eta9", "theta")):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(vocabulary) + str(rnd.randrange(40)) for _ in range(n))


PASSAGE = words(40, 99)


def awkward():
    """Rows (doc_id, text, lang, source): nulls, empties, long texts, copies,
    near copies, shared passages, repeated rows, odd white space, scripts."""
    base = words(120, 1)
    near = base.split(" ")
    near[60] = "changed"
    return [
        (0, base, "en", "a"), (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n ", "en", None), (4, base, "en", "b"), (5, " ".join(near), "en", "a"),
        (6, "one", "de", "a"), (7, "two\x0bwords", "de", "c"), (8, words(5000, 2) + " " + PASSAGE + " " + words(4000, 3), "en", "a"),
        (9, "Start. " + PASSAGE + "\n\nEnd, of it.", "en", "c"), (10, "日本語 の テキスト 😀 é́ " + words(30, 4), "ja", "a"), (10, "日本語 の テキスト 😀 é́ " + words(30, 4), "ja", "a"),
        (None, base, "en", "a"), (None, None, None, None), (11, words(300, 5), "en", "a"), (12, words(300, 5).upper(), "en", "a"), (13, "x" * 70000, "en", "b"),
        (14, "<|endoftext|> it's 'tis we'll  \n\n go", "en", "b"), (2**60 + 1, words(50, 6), "en", "d"), (-5, words(50, 6), "en", "d"),
    ]


def frame(spark, rows):
    full = [(i, t, lang, s, len(t) if t is not None else None, 7, "text", "rid", 1.5, 3, "fp", "spans", "slot", 0) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def docs(spark, rows=None, parts=3):
    return frame(spark, awkward() if rows is None else rows).repartition(parts)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2
