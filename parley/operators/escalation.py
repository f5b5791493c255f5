"""Escalation: five signals, marker clusters and the assessment of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import lexicon
from parley.operators.metrics import dominant_speaker

RELEVANT = ["high_tension", "emotional_shift", "interruption", "engagement_drop"]


def _signal(rows: DataFrame, place: int, kind: str, score: Column, high: Column, speaker: Column | None = None) -> DataFrame:
    return rows.select(
        "session_id",
        F.lit(place).alias("place"),
        F.lit(kind).alias("signal_type"),
        F.when(high, "high").otherwise("medium").alias("severity"),
        F.round(score, 4).alias("score"),
        (F.lit(None).cast("string") if speaker is None else speaker).alias("speaker"),
    )


def marker_clusters(timeline: DataFrame) -> DataFrame:
    """Three relevant markers in a row within 45 seconds of the first."""
    order = Window.partitionBy("session_id").orderBy("time_sec", "marker_id")
    rows = timeline.where(F.col("type").isin(RELEVANT)).select(
        "session_id",
        F.col("time_sec").alias("start_sec"),
        F.lead("time_sec", 2).over(order).alias("end_sec"),
        F.coalesce("speaker", F.lead("speaker", 1).over(order), F.lead("speaker", 2).over(order)).alias("primary_speaker"),
        F.row_number().over(order).alias("at"),
    )
    span = F.col("end_sec") - F.col("start_sec")
    return rows.where(F.round(span, 3) <= 45).withColumn("window_span_sec", F.round(span, 3))


def escalation_signals(
    trend: DataFrame, sentiment: DataFrame, speaker_emotion: DataFrame, speakers: DataFrame, timeline: DataFrame
) -> DataFrame:
    """Fired signals in their fixed order. ``sentiment`` is by session, ``speaker_emotion`` by session and speaker."""
    slope = F.abs("slope")
    declining = F.least(F.lit(0.30), 0.12 + slope)
    parts = [_signal(trend.where("direction = 'declining'"), 1, "declining_session_trend", declining, declining >= 0.22)]

    share = F.col("negative_count") / F.col("sample_count")
    parts.append(
        _signal(sentiment.where(share >= 0.15), 2, "negative_sentiment_density", F.least(F.lit(0.25), 0.10 + share), share >= 0.30)
    )

    strained = speaker_emotion.where(F.col("dominant_emotion").isin(lexicon.NEGATIVE_EMOTIONS))
    strained = strained.withColumn("strain", F.least(F.lit(0.25), 0.08 + F.col("dominant_share") * 0.25))
    strained = strained.join(speakers.select("session_id", "speaker", "first_seq"), ["session_id", "speaker"])
    order = Window.partitionBy("session_id").orderBy(F.desc("strain"), "first_seq")
    worst = strained.withColumn("at", F.row_number().over(order)).where("at = 1")
    parts.append(_signal(worst, 3, "speaker_emotional_strain", F.col("strain"), F.col("strain") >= 0.20, F.col("speaker")))

    turns = speakers.groupBy("session_id").agg(
        F.sum(F.col("interruption_count") + F.col("overlap_count")).alias("events"), F.sum("utterance_count").alias("n")
    )
    tension = F.least(F.lit(0.30), F.col("events") / F.greatest(F.col("n"), F.lit(1)))
    parts.append(_signal(turns.where("events > 0"), 4, "turn_tension", tension, tension >= 0.20))

    clusters = marker_clusters(timeline).groupBy("session_id").agg(F.count("*").alias("clusters"))
    density = F.least(F.lit(0.25), F.col("clusters") * 0.08)
    parts.append(_signal(clusters, 5, "marker_cluster_density", density, density >= 0.20))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def level_of(score: Column, *steps: tuple[float, str]) -> Column:
    level = F
    for least, name in steps:
        level = level.when(score >= least, name)
    return level.otherwise("none")


def assess(signals: DataFrame, speakers: DataFrame, kind: str, nothing: str, *steps: tuple[float, str]) -> DataFrame:
    """Score, level, primary speaker and a sentence for every session with speakers.

    The score adds up the signals, each a whole number of ten-thousandths, so the order does not matter. The primary
    speaker has the highest share of attributed signals, the first to be named among equals, or else speaks most.
    """
    blamed = signals.where("speaker is not null").groupBy("session_id", "speaker").agg(
        F.sum(F.round(F.col("score") * 10000).cast("long")).alias("blame"), F.min("place").alias("named")
    )
    order = Window.partitionBy("session_id").orderBy(F.desc("blame"), "named")
    blamed = blamed.withColumn("at", F.row_number().over(order)).where("at = 1").select("session_id", "speaker")
    sums = signals.groupBy("session_id").agg(
        F.sum(F.round(F.col("score") * 10000).cast("long")).alias("total"),
        F.array_sort(F.collect_list(F.struct("place", "signal_type"))).alias("fired"),
    )
    sessions = dominant_speaker(speakers).join(sums, "session_id", "left").join(blamed, "session_id", "left")
    score = F.least(F.lit(1.0), F.coalesce(F.col("total"), F.lit(0)) / 10000)
    level = level_of(score, *steps)
    names = F.array_join(F.transform(F.slice("fired", 1, 3), lambda s: s["signal_type"]), ", ")
    primary = F.coalesce("speaker", "dominant_speaker")
    text = F.concat(
        F.lit(f"{kind} level is "), level, F.lit(", driven by "), names, F.lit(". Primary speaker of concern: "), primary, F.lit(".")
    )
    return sessions.select(
        "session_id",
        level.alias("level"),
        score.alias("score"),
        F.coalesce(F.size("fired"), F.lit(0)).cast("long").alias("signal_count"),
        primary.alias("primary_speaker"),
        F.when(level == "none", nothing).otherwise(text).alias("summary"),
    )


def assess_escalation(signals: DataFrame, speakers: DataFrame) -> DataFrame:
    steps = ((0.70, "severe"), (0.45, "moderate"), (0.20, "mild"))
    return assess(signals, speakers, "Escalation", "No clear escalation pattern was detected.", *steps)
