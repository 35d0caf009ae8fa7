"""Toxicity as cumulative-link ordinal regression on sparse text features.

Features of a text: its words (letters of any script, lower case) and their
first 4 and 5 letters, as 64-bit hashes; a feature that occurs n times has the
value 1 + log n.  With one weight vector w shared by all thresholds t1 < t2 < ...
    P(grade >= k) = sigmoid(w x - t_k),
and the expected severity is the sum of these probabilities.

Labels say toxic or not.  Grades refine them: 0 for rows that are not toxic;
toxic rows get 1, 2 or 3 by how many marker words they hold (STEPS), markers
being the features far likelier in toxic rows of the sample.

The model is fitted on the driver from a bounded sample: MAX_TOXIC toxic and
MAX_CLEAN other labelled rows, those of smallest hash of their id.  Scoring is
one pass where the texts are read, without a shuffle.

Defined results: null and empty texts have no features and severity by the
thresholds alone; labels of null id or grade are not used; labels of one id are
joined by their largest; unless labels of both kinds have documents, nothing
tells texts apart and every severity is 0 (nothing is rejected); repeated rows
give a row each; an empty table gives no rows; other columns are not read
(scores) or are kept (`keep_clean`); an id column with the name of a score keeps
it, and the score gets an underscore in front.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, importable, map_texts, materialize, narrow

MAX_TOXIC = 3000
MAX_CLEAN = 6000
PREFIXES = (4, 5)
#: marker words from which on a toxic row has grade 2, and 3
STEPS = (3, 6)
GRADES = 4
L2 = 2e-4
THRESHOLD = 0.5
#: words whose features a task remembers, and the longest of them
_CACHE, _CACHED_LETTERS = 400_000, 64
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    names = {f"w:{word}"} | {f"{n}:{word[:n]}" for n in PREFIXES if len(word) > n}
    return [xxhash.xxh64_intdigest(x, 7) for x in sorted(names)]


def text_features(text) -> Counter:
    """How often each feature occurs in the text."""
    found: Counter = Counter()
    if isinstance(text, str):
        for word, n in Counter(_WORD.findall(text.lower())).items():
            for f in word_features(word):
                found[f] += n
    return found


def _signed(features) -> np.ndarray:
    return np.fromiter(features, np.uint64, len(features)).view(np.int64)


def _presence(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(feature, toxic) of each feature of each row."""
    for frame in frames:
        for own, text in zip(frame["toxic"], frame["text"], strict=True):
            yield pd.DataFrame({"feature": _signed(text_features(text)), "toxic": own})


def _counted(use: np.ndarray):
    """(toxic, at, counts): how often features of the sorted `use` occur."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for own, text in zip(frame["toxic"], frame["text"], strict=True):
                found = text_features(text)
                names, counts = _signed(found), np.fromiter(found.values(), np.int64, len(found))
                at = np.searchsorted(use, names)
                on = use[np.minimum(at, len(use) - 1)] == names if len(use) else np.zeros(len(names), bool)
                rows.append((own, at[on].tobytes(), counts[on].tobytes()))
            yield pd.DataFrame(rows, columns=["toxic", "at", "counts"])

    return run


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class OrdinalModel:
    """Weights of the features (sorted hashes) and the ordered thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, linear: np.ndarray) -> np.ndarray:
        """P(grade >= k), k = 1, 2, ..., a row each."""
        return _sigmoid(np.asarray(linear, float)[:, None] - self.thresholds)


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, features: np.ndarray, n_grades: int = GRADES, l2: float = L2, steps: int = 300, rate: float = 0.1) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty, by Adam on all rows.

    rows: (positions in features, values) of each row; grades: 0 to n_grades-1."""
    n = len(rows)
    index = np.concatenate([r[0] for r in rows]) if n else np.empty(0, np.int64)
    value = np.concatenate([r[1] for r in rows]) if n else np.empty(0)
    owner = np.repeat(np.arange(n), [len(r[0]) for r in rows])
    share = np.array([np.clip((grades >= k).mean(), 1e-4, 1 - 1e-4) for k in range(1, n_grades)])
    # thresholds: the first, then logarithms of the gaps; so they stay in order
    at = np.maximum.accumulate(np.log((1 - share) / share))
    params = np.concatenate((np.zeros(len(features)), at[:1], np.log(np.maximum(np.diff(at), 0.05))))
    m = v = np.zeros(len(params))
    d = len(features)
    for step in range(1, steps + 1):
        w, gaps = params[:d], np.exp(np.minimum(params[d + 1 :], 5))
        theta = params[d] + np.concatenate(([0.0], np.cumsum(gaps)))
        linear = np.bincount(owner, w[index] * value, minlength=n)
        above = np.column_stack((np.ones(n), _sigmoid(linear[:, None] - theta), np.zeros(n)))
        p = np.maximum(above[np.arange(n), grades] - above[np.arange(n), grades + 1], 1e-12)
        slope = above * (1 - above)  # of sigmoid; zero at both ends
        upper, lower = slope[np.arange(n), grades] / p, slope[np.arange(n), grades + 1] / p
        g_linear = -(upper - lower) / n
        g_theta = np.zeros(n_grades + 1)
        np.add.at(g_theta, grades, upper / n)
        np.add.at(g_theta, grades + 1, -lower / n)
        g_theta = g_theta[1:n_grades]
        tail = np.cumsum(g_theta[::-1])[::-1]
        grad = np.concatenate((np.bincount(index, g_linear[owner] * value, minlength=d) + l2 * w, tail[:1], tail[1:] * gaps))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    theta = params[d] + np.concatenate(([0.0], np.cumsum(np.exp(np.minimum(params[d + 1 :], 5)))))
    return OrdinalModel(features, params[:d], theta)


def sample_labels(labels: DataFrame, id_col: str, grade: str, limits: dict[int, int]) -> DataFrame:
    """(id, grade) of at most limits[g] labels of grade g, by hash of the id."""
    clean = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{grade}`").isNotNull())
    one = clean.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(f"`{grade}`").cast("int").alias("grade"))
    parts = [one.where(F.col("grade") == g).orderBy(F.xxhash64("id"), "id").limit(n) for g, n in limits.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", toxic: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> OrdinalModel:
    """Fit on at most max_toxic + max_clean labelled documents.  Without any
    document of one of the labels the model finds nothing toxic."""
    chosen = sample_labels(labels, id_col, toxic, {1: max_toxic, 0: max_clean}).withColumnRenamed("grade", "toxic")
    # a label sample of bounded rows; repeated documents of one id count once
    known = narrow(docs, id_col, text).toDF("id", "text").join(F.broadcast(chosen), "id").dropDuplicates(["id"])
    known = materialize(known.select("toxic", "text"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return OrdinalModel(np.empty(0, np.uint64), np.empty(0), np.full(GRADES - 1, 40.0))
    # features are counted in Spark; only those that speak for toxic rows arrive here
    least = max(2, round(0.004 * n[1]))
    df = known.mapInPandas(_presence, "feature long, toxic int").groupBy("feature").agg(F.sum("toxic").alias("n1"), F.count(F.lit(1)).alias("n"))
    odds = F.log((F.col("n1") + 0.05) / n[1]) - F.log((F.col("n") - F.col("n1") + 0.5) / n[0])
    chosen_features = df.where(F.col("n1") >= least).select("feature", odds.alias("odds")).where("odds > 1.0").toPandas().sort_values("feature")
    use, marker = chosen_features["feature"].to_numpy(np.int64), chosen_features["odds"].to_numpy() > 3.0
    rows, marks, is_toxic = [], [], []
    for r in known.mapInPandas(_counted(use), "toxic int, at binary, counts binary").collect():
        at, counts = np.frombuffer(r["at"], np.int64), np.frombuffer(r["counts"], np.int64)
        marks.append(int(counts[marker[at]].sum() / (1 + len(PREFIXES)) + 0.5))
        rows.append((at, 1 + np.log(counts)))
        is_toxic.append(bool(r["toxic"]))
    grades = np.where(is_toxic, 1 + np.searchsorted(STEPS, marks, side="right"), 0)
    return fit_ordinal(rows, grades, use.view(np.uint64))


SCORES = "expected_severity double; p_toxic double; grade int; toxic boolean"


def _scorer(model: OrdinalModel, threshold: float):
    """Makes f(texts) -> the columns of SCORES."""
    index = {int(f): k for k, f in enumerate(model.features)}

    def make():
        known: dict[str, tuple[int, ...]] = {}

        def linear(text) -> float:
            if not isinstance(text, str):
                return 0.0
            counts: dict[int, int] = {}
            for word in _WORD.findall(text.lower()):
                own = known.get(word)
                if own is None:
                    own = tuple(index[f] for f in word_features(word) if f in index)
                    if len(word) <= _CACHED_LETTERS:
                        if len(known) >= _CACHE:
                            known.clear()
                        known[word] = own
                for k in own:
                    counts[k] = counts.get(k, 0) + 1
            if not counts:
                return 0.0
            at = np.fromiter(counts, np.int64, len(counts))
            return float(model.weights[at] @ (1 + np.log(np.fromiter(counts.values(), float, len(counts)))))

        def scores(texts: list) -> list[np.ndarray]:
            above = model.exceed(np.array([linear(t) for t in texts], float))
            return [above.sum(axis=1), above[:, 0], (above >= 0.5).sum(axis=1).astype(np.int32), above[:, 0] >= threshold]

        return scores

    return make


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: id, expected_severity (0 to GRADES-1), p_toxic (of
    grade 1 or more), grade (the median) and toxic (p_toxic >= threshold)."""
    columns_of(docs, id_col, text)
    return map_texts(docs, text, [id_col], _scorer(model, threshold), SCORES)


def keep_clean(docs: DataFrame, model: OrdinalModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns as they are, that are not toxic."""
    importable(docs.sparkSession)
    make, at = _scorer(model, threshold), docs.columns.index(text)

    def kept(batches):
        scores = make()
        for batch in batches:
            yield batch.filter(pa.array(~scores(batch.column(at).to_pylist())[3]))

    return docs.mapInArrow(kept, docs.schema)
