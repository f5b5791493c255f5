"""Quality by supervised subword embeddings.

A text's features are its words, its pairs of neighbouring words and the character n-grams of its words, all hashed to
one table of vectors. A document is the average of the vectors of all its features, and a softmax over a linear layer
gives its class. Vectors and layer are learned together by stochastic gradient descent in numpy, on a bounded,
reproducible sample of the labelled rows. Since everything between vectors and softmax is linear, a learned model is one
number for each hashed feature, and a document's score needs their average alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from parley.llm._shared import id_remainder

#: Bits of a feature's hash, lengths of the character n-grams, dimensions of a vector.
BITS, LENGTHS, DIMS = 16, (2, 3, 4), 8
#: Labels that the model is fitted on, about; passes over them, step size, rows of a step.
FIT_ROWS, PASSES, RATE, BATCH = 4000, 10, 2.0, 4
CUT, SEED = 0.3, 42
#: Feature of a word that repeats the one before it, whichever it is.
REPEATED = 0

#: Whether a character is a space; the last place stands for all above it, which are none.
_SPACE = np.array([chr(i).isspace() for i in range(0x3002)])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _bucket(code: np.ndarray) -> np.ndarray:
    code = (code ^ (code >> np.uint64(31))) * _ODD
    return (code >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Hashes of all features of the whole text, as often as they occur; case and punctuation count."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    points = np.where(_SPACE[np.minimum(points, 0x3001).astype(np.int64)], np.uint64(0), points + np.uint64(1))
    points = np.concatenate((np.zeros(1, np.uint64), points, np.zeros(1, np.uint64)))
    inside = points > 0
    points = points[np.append(True, inside[1:] | inside[:-1])]  # one boundary between words
    inside = points > 0
    lengths = np.diff(np.flatnonzero(~inside)) - 1
    if not len(lengths):
        return np.zeros(0, np.int64)
    starts = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _ODD))
    hashes = np.add.reduceat(points[inside] * powers[at], starts)
    pairs = _bucket(hashes[:-1] * np.uint64(31) + hashes[1:])
    found = [_bucket(hashes), np.where(hashes[1:] == hashes[:-1], REPEATED, pairs)]
    for n in LENGTHS:
        if len(points) >= n:
            code = np.full(len(points) - n + 1, n, np.uint64)
            whole = np.ones(len(code), bool)
            for k in range(n):
                code = code * np.uint64(0x100000001B3) + points[k : len(points) - n + 1 + k]
                if 0 < k < n - 1:
                    whole &= inside[k : len(points) - n + 1 + k]
            found.append(_bucket(code[whole]))
    return np.concatenate(found)


@dataclass
class Model:
    """``weights[feature]``: what a feature adds to the difference of the two classes' outputs; ``bias``: where it starts."""

    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        found = features(text)
        margin = self.bias + (float(self.weights[found].mean()) if len(found) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, weight: np.ndarray) -> Model:
    """Vectors and softmax layer by stochastic gradient descent with steps that shrink for each feature.

    ``rows`` hold each document's distinct features and their shares of it.
    """
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMS, 1 / DIMS, (1 << BITS, DIMS)).astype(np.float32)
    layer, bias = np.zeros((DIMS, 2), np.float32), np.zeros(2, np.float32)
    seen, seen_layer, seen_bias = np.zeros(1 << BITS, np.float32), np.zeros_like(layer), np.zeros_like(bias)
    truth = np.eye(2, dtype=np.float32)[good]
    for turn in range(PASSES):
        rate, order = RATE * (1 - turn / PASSES), rng.permutation(len(rows))
        for start in range(0, len(order), BATCH):
            some = order[start : start + BATCH]
            means = np.stack([share @ vectors[at] for at, share in (rows[i] for i in some)])
            out = means @ layer + bias
            out = np.exp(out - out.max(axis=1, keepdims=True))
            error = (out / out.sum(axis=1, keepdims=True) - truth[some]) * weight[some, None]
            back = error @ layer.T
            for k, i in enumerate(some):
                at, share = rows[i]
                seen[at] += share * share * (back[k] @ back[k])
                vectors[at] -= (rate * share / np.sqrt(seen[at] + 1e-8))[:, None] * back[k]
            slope, slope_bias = means.T @ error, error.sum(axis=0)
            seen_layer += slope * slope
            seen_bias += slope_bias * slope_bias
            layer -= rate * slope / np.sqrt(seen_layer + 1e-8)
            bias -= rate * slope_bias / np.sqrt(seen_bias + 1e-8)
    difference = (layer[:, 1] - layer[:, 0]).astype(np.float64)
    return Model(vectors.astype(np.float64) @ difference, float(bias[1] - bias[0]))


def _counted(texts: pd.Series) -> pd.DataFrame:
    """Each text's distinct features and their counts as bytes."""
    found = [np.unique(features(x), return_counts=True) for x in texts]
    return pd.DataFrame({"features": [f.astype("<u2").tobytes() for f, _ in found], "counts": [np.minimum(n, 65535).astype("<u2").tobytes() for _, n in found]})


def sample_labels(labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[DataFrame, dict[int, float]]:
    """Some ``fit_rows`` distinct labels (``doc_id``, ``good``), half of each class, and the share of each class that was taken.

    All of a class are taken that is smaller. A hash of the id chooses, below a bound that follows from the totals, so
    nothing is sorted. Without rows of both classes the shares are empty.
    """
    labels = labels.where("doc_id IS NOT NULL AND good in (0, 1)").select("doc_id", "good").distinct()
    totals = dict(labels.groupBy("good").count().collect())
    if len(totals) < 2:
        return labels.limit(0), {}
    few = min(totals.values())
    quota = {c: n if n <= fit_rows // 2 else max(fit_rows // 2, fit_rows - few) for c, n in totals.items()}
    share = {c: min(1.0, quota[c] / totals[c]) for c in totals}
    scale = 1 << 31
    bound = F.when(F.col("good") == 1, int(scale * share[1])).otherwise(int(scale * share[0]))
    return labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < bound), share


def fit_sample(docs: DataFrame, some: DataFrame) -> DataFrame:
    """Distinct texts of the sampled labels with their features; copies count once however many there are.

    ``some`` is bounded by ``sample_labels`` and is broadcast, so that the texts of the table are not shuffled.
    """
    rows = docs.join(F.broadcast(some), "doc_id").select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text", "good")
    rows = rows.groupBy("key", "good").agg(F.any_value("text").alias("text"))
    found = F.pandas_udf(_counted, "features binary, counts binary")("text").alias("of")
    return rows.select("key", "good", found).select("key", "good", "of.*")


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``good`` 0 or 1), other labels left out.

    The driver gets the features of at most about ``fit_rows`` distinct texts. Rows weigh so that the classes have their
    shares of all labels. With labels of one class only, or none, every score is 0.5.
    """
    some, share = sample_labels(labels, fit_rows)
    found = fit_sample(docs, some).toPandas().sort_values(["key", "good"], ignore_index=True) if share else None
    if found is None or found["good"].nunique() < 2:
        return Model(np.zeros(1 << BITS), 0.0)
    held = []
    for at, counts in zip(found["features"], found["counts"], strict=True):
        n = np.frombuffer(counts, "<u2").astype(np.float32)
        held.append((np.frombuffer(at, "<u2").astype(np.int64), n / max(1.0, float(n.sum()))))
    good = found["good"].to_numpy()
    weight = np.where(good == 1, 1 / share[1], 1 / share[0]).astype(np.float32)
    return fit(held, good, weight / weight.mean())


def quality_score(text: Column, model: Model) -> Column:
    """The model's probability of class 1 for each whole text; null counts as empty."""

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(x) for x in texts], dtype="float64")

    return F.pandas_udf(of, DoubleType())(text)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels training does not see."""
    return id_remainder(doc_id, 5) == 0


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 from ``cut``) for every row of ``docs``.

    ``labels`` has ``doc_id`` and ``quality``; labels of held-out documents are not read. A text labelled both ways
    counts once for each. Null, empty and blank texts have no features and get the score that the bias alone gives. Very
    long texts are read whole. Repeated rows get equal scores; an empty table gives no rows. Columns of other names
    are not read.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select("doc_id", F.col("quality").cast("int").alias("good"))
    model = train(text, known.where(~held_out(F.col("doc_id"))))
    scored = text.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
