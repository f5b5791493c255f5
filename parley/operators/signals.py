"""Sentiment and emotion aggregates, trend and volatility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.chunks import running
from parley.operators.metrics import ORDER


def dominant_emotion(emotion: Column) -> Column:
    """The emotion with the highest score, the first among equals; null without one."""
    entries = F.map_entries(emotion)
    top = F.array_max(F.transform(entries, lambda e: e["value"]))
    return F.get(F.filter(entries, lambda e: e["value"] == top), F.lit(0))["key"]


def _first_most(rows: DataFrame, keys: list[str], value: str, first: str) -> Column:
    order = Window.partitionBy(*keys).orderBy(F.desc(value), first)
    return F.row_number().over(order)


def sentiment_aggregate(utterances: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of labels, the average score and the dominant label (first seen among equals), by ``keys``.

    Only utterances with both a label and a score count.
    """
    scored = utterances.where("sent_label is not null and score_e4 is not null")
    label = F.lower("sent_label")
    clamped = F.greatest(F.lit(0), F.least(F.lit(10000), F.col("score_e4")))
    by_label = scored.groupBy(*keys, label.alias("label")).agg(
        F.count("*").alias("n"), F.sum(clamped).alias("total"), F.min("pos").alias("first")
    )
    ranked = by_label.withColumn("place", _first_most(by_label, keys, "n", "first"))
    count = lambda name: F.coalesce(F.sum(F.when(F.col("label") == name, F.col("n"))), F.lit(0))
    return ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("place") == 1, F.col("label"))).alias("label"),
        F.round(F.sum("total") / F.sum("n") / 10000, 4).alias("avg_score"),
        count("positive").alias("positive_count"),
        count("neutral").alias("neutral_count"),
        count("negative").alias("negative_count"),
        F.sum("n").alias("sample_count"),
    )


def emotion_distribution(utterances: DataFrame, keys: list[str]) -> DataFrame:
    """One row per ``keys`` and emotion: its share of all scores and whether it is the dominant one."""
    felt = utterances.where("emotion is not null and size(emotion) > 0")
    samples = felt.groupBy(*keys).agg(F.count("*").alias("sample_count"))
    entries = felt.select(*keys, "pos", F.posexplode(F.map_entries("emotion")).alias("at", "e"))
    sums = entries.groupBy(*keys, F.lower("e.key").alias("emotion")).agg(
        F.sum(F.round(F.col("e.value") * 10000).cast("long")).alias("total"),
        F.min(F.col("pos") * 1000 + F.col("at")).alias("first"),
    )
    whole = F.sum("total").over(Window.partitionBy(*keys))
    shares = sums.withColumn("share", F.when(whole > 0, F.round(F.col("total") / whole, 4)).otherwise(F.lit(0.0)))
    shares = shares.withColumn("dominant", _first_most(shares, keys, "share", "first") == 1)
    return shares.join(samples, keys).select(*keys, "emotion", "share", "dominant", "sample_count")


def emotion_aggregate(utterances: DataFrame, keys: list[str]) -> DataFrame:
    """The dominant emotion and its share, by ``keys``."""
    return emotion_distribution(utterances, keys).where("dominant").select(
        *keys, F.col("emotion").alias("dominant_emotion"), F.col("share").alias("dominant_share"), "sample_count"
    )


def sentiment_trend(seq: DataFrame) -> DataFrame:
    """Direction and slope from the first to the last scored utterance; a single one is stable."""
    ends = seq.where("sent_label is not null and score_e4 is not null").groupBy("session_id").agg(
        F.min_by("score_e4", "seq").alias("first"), F.max_by("score_e4", "seq").alias("last"), F.count("*").alias("points")
    )
    slope = F.when(F.col("points") < 2, 0).otherwise(F.col("last") - F.col("first"))
    direction = (
        F.when(F.col("points") < 2, "stable")
        .when(slope >= 800, "improving")
        .when(slope <= -800, "declining")
        .when(F.abs(slope) < 300, "stable")
        .otherwise("mixed")
    )
    return ends.select("session_id", direction.alias("direction"), (slope / 10000).alias("slope"), "points")


def emotion_volatility(seq: DataFrame) -> DataFrame:
    """0.65 times the mean step of the score and 0.35 times the share of changes of the dominant emotion.

    Scores follow the sequence order, emotions the input order. Sessions without either have 0.
    """
    score = F.when(F.col("sent_label").isNotNull(), F.col("score_e4"))
    felt = F.coalesce(F.col("emotion").isNotNull() & (F.size("emotion") > 0), F.lit(False))
    chunk = [c for c in seq.columns if c == "chunk"]
    rows = seq.select("session_id", "pos", *ORDER, *chunk, score.alias("score"), F.when(felt, F.struct(dominant_emotion(F.col("emotion")).alias("top"))).alias("felt"))
    rows = running(rows, ["session_id"], ORDER, {"last_score": F.col("score")})
    # the input order may go back in time, so it has no chunks
    rows = running(rows.drop("chunk"), ["session_id"], ("pos",), {"last_felt": F.col("felt")})
    rows = rows.withColumns({"step": F.abs(F.col("score") - F.col("last_score")), "switch": F.col("felt.top") != F.col("last_felt.top")})
    sums = rows.groupBy("session_id").agg(F.avg("step").alias("step"), F.count_if("switch").alias("switches"), F.count("felt").alias("n"))
    share = F.when(F.col("n") > 1, F.col("switches") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    raw = 0.65 * F.coalesce(F.col("step") / 10000, F.lit(0.0)) + 0.35 * share
    return sums.select("session_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4).alias("emotion_volatility"))
