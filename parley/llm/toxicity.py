"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed character n-grams it contains, each worth its log-count ratio between toxic and
other texts. The ratios are counted over all labelled training rows. A logistic regression on the features with
the clearest ratios is fitted on a bounded, reproducible sample of those rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from parley.llm._shared import id_remainder, materialize

#: Lengths of the n-grams, bits of their hash, and labelled rows that the regression is fitted on, about.
LENGTHS, BITS, FIT_ROWS = (3, 4, 5, 6), 20, 10_000
#: Labels up to which they are broadcast to the texts (some 50 MB); beyond, Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000
#: A feature is kept if its shares in the two classes are so many standard errors and so much of all texts apart, and if
#: its log-count ratio is of this size: it is then three times as common in one class. These are effects and not a number
#: of features, so more texts do not make more features pass.
CLEAR, APART, STRONG = 4.0, 0.01, 1.0
SMOOTHING, RIDGE, STEPS, CUT = 1.0, 1e-4, 400, 0.7

_KEPT = np.array([chr(i).isalnum() for i in range(128)])


def buckets(text: str | None) -> np.ndarray:
    """Hash of every n-gram of the whole lower-case text; ASCII characters other than letters and digits are spaces."""
    points = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where((points < 128) & ~_KEPT[np.minimum(points, 127)], np.uint32(32), points)
    found = []
    for n in LENGTHS:
        if len(points) < n:
            break
        code = np.full(len(points) - n + 1, n, np.uint32)
        for k in range(n):
            code = code * np.uint32(0x01000193) + points[k : len(points) - n + 1 + k]
        code *= np.uint32(0x9E3779B1)
        found.append(code >> np.uint32(32 - BITS))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def _document_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            counts[toxic, np.unique(buckets(text))] += 1
    used = np.flatnonzero(counts.sum(axis=0))
    yield pd.DataFrame({"bucket": used, "clean": counts[0, used], "toxic": counts[1, used]})


@dataclass
class Model:
    """``place[bucket]``: the feature's place in ``weights``, or the last place, whose weight is 0."""

    place: np.ndarray
    weights: np.ndarray
    bias: float

    def features(self, text: str | None) -> np.ndarray:
        found = np.zeros(len(self.weights), bool)
        found[self.place[buckets(text)]] = True
        found[-1] = False
        return np.flatnonzero(found)

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[self.features(text)].sum() + self.bias, -30, 30))))


def _fit(rows: list[np.ndarray], toxic: np.ndarray, ratios: np.ndarray, copies: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights (times the ratios) and bias of a ridge logistic regression; a row counts ``copies`` times, both classes weigh the same."""
    copies = np.ones(len(rows)) if copies is None else copies.astype(np.float64)
    sizes = np.array([len(x) for x in rows])
    at = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    columns = np.concatenate(rows).astype(np.int32)
    values = ratios.astype(np.float32)[columns]
    norm = max(1.0, float(np.sqrt(np.average(np.bincount(at, values * values, len(rows)), weights=copies))))
    values /= np.float32(norm)
    balance = 0.5 * copies / np.where(toxic == 1, max(1.0, copies[toxic == 1].sum()), max(1.0, copies[toxic == 0].sum()))
    weights, bias = np.zeros(len(ratios)), 0.0
    first, second = np.zeros(len(ratios) + 1), np.zeros(len(ratios) + 1)
    for step in range(1, STEPS + 1):
        margin = np.bincount(at, values * weights[columns], len(rows)) + bias
        error = balance * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - toxic)
        slope = np.append(np.bincount(columns, values * error[at], len(ratios)) + RIDGE * weights, error.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope * slope
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-10)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights * ratios / norm, float(bias)


def log_count_ratios(rows: DataFrame, totals: dict[int, int]) -> DataFrame:
    """``bucket``, ``ratio``, ``clear`` (standard errors between the shares of the classes) and ``apart`` (their difference) of every feature.

    ``totals`` are the numbers of rows of class 0 and 1 in ``rows`` (``text``, ``toxic``).
    """
    clean, toxic = totals[0], totals[1]
    counts = rows.mapInPandas(_document_counts, "bucket int, clean long, toxic long")
    counts = counts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    ratio = F.log((F.col("toxic") + SMOOTHING) / (toxic + 2 * SMOOTHING)) - F.log(
        (F.col("clean") + SMOOTHING) / (clean + 2 * SMOOTHING)
    )
    share = (F.col("toxic") + F.col("clean")) / (toxic + clean)
    gap = F.abs(F.col("toxic") / toxic - F.col("clean") / clean)
    clear = gap / F.sqrt(share * (1 - share) * (1 / toxic + 1 / clean) + 1e-12)
    return counts.select("bucket", ratio.alias("ratio"), clear.alias("clear"), gap.alias("apart"))


def fit_sample(rows: DataFrame, totals: dict[int, int], fit_rows: int) -> DataFrame:
    """Some ``fit_rows`` of ``rows``, half of them of each class; all of a class that is smaller.

    Rows are chosen by a hash of their id and text below a bound that follows from the totals, so nothing is
    sorted and no text leaves its partition.
    """
    few = min(totals.values())
    quota = {c: n if n <= fit_rows // 2 else max(fit_rows // 2, fit_rows - few) for c, n in totals.items()}
    scale = 1 << 31
    bound = F.when(F.col("toxic") == 1, int(scale * min(1.0, quota[1] / totals[1]))).otherwise(int(scale * min(1.0, quota[0] / totals[0])))
    return rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale)) < bound)


def train(texts: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from ``texts`` (columns ``doc_id``, ``text``, ``toxic`` 0 or 1), null labels left out.

    Log-count ratios cover every row. The regression sees ``fit_sample``: all of a class that has no more than half of
    ``fit_rows``; rows that repeat an id and its text are one row with their number as its weight. The driver receives
    the ratios that pass ``CLEAR``, ``APART`` and ``STRONG``, of the 2 ** ``BITS`` that there are, and the features of about
    ``fit_rows`` rows. Without rows of both classes every score is 0.5.
    """
    rows = materialize(texts.where("toxic in (0, 1)").select("doc_id", "text", F.col("toxic").cast("int")), "toxicity")
    totals = dict(rows.groupBy("toxic").count().collect())
    if not totals.get(0) or not totals.get(1):
        return Model(np.zeros(1 << BITS, np.int64), np.zeros(1), 0.0)
    kept = (F.col("clear") >= CLEAR) & (F.col("apart") >= APART) & (F.abs("ratio") >= STRONG)
    best = log_count_ratios(rows, totals).where(kept).toPandas().sort_values("bucket", ignore_index=True)
    place = np.full(1 << BITS, len(best), np.int64)
    place[best["bucket"].to_numpy()] = np.arange(len(best))
    model = Model(place, np.zeros(len(best) + 1), 0.0)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [model.features(x) for x in batch["text"]]
            yield pd.DataFrame({"key": batch["key"], "toxic": batch["toxic"], "copies": batch["copies"], "found": found})

    sample = fit_sample(rows, totals, fit_rows).groupBy(F.xxhash64("doc_id", "text").alias("key"), "toxic")
    sample = sample.agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))
    fitted = sample.mapInPandas(featured, "key long, toxic int, copies long, found array<int>").toPandas()
    fitted = fitted.sort_values(["key", "toxic"], ignore_index=True)
    if fitted["toxic"].nunique() < 2:
        return Model(place, np.zeros(len(best) + 1), 0.0)
    weights, bias = _fit(list(fitted["found"]), fitted["toxic"].to_numpy(), best["ratio"].to_numpy(), fitted["copies"].to_numpy())
    return Model(place, np.append(weights, 0.0), bias)


def toxicity_score(text: Column, model: Model) -> Column:
    """The model's probability for each whole text; null counts as empty."""

    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(x) for x in texts], dtype="float64")

    return F.pandas_udf(of, DoubleType())(text)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels training does not see."""
    return id_remainder(doc_id, 3) == 1


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` (1 from ``cut``) for every row of ``docs``.

    ``labels`` has ``doc_id`` and ``toxic``; labels of held-out documents are not read. A document with several
    labels counts once for each. Null and empty texts get the score of a text without features; repeated rows get
    equal scores; an empty table gives no rows. The score reads the text alone.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    seen = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    seen = seen.where(~held_out(F.col("doc_id")))
    seen = F.broadcast(seen) if seen.count() <= BROADCAST_ROWS else seen
    model = train(text.where(~held_out(F.col("doc_id"))).join(seen, "doc_id"))
    scored = text.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity_score(F.col("text"), model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
