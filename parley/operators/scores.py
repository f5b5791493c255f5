"""Scores, their parts, and flags of sessions and speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.numbers import round_binary
from parley.thresholds import TenantThresholds, Thresholds


def _unit(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), round_binary(value, 4)))


def compute_scores(sessions: DataFrame, speakers: DataFrame, trend: DataFrame, volatility: DataFrame) -> DataFrame:
    """Five scores in [0, 1] per session, with the parts of the engagement score."""
    turns = speakers.groupBy("session_id").agg(
        F.max("speaking_ratio").alias("dominance"), F.sum(F.col("interruption_count") + F.col("overlap_count")).alias("events")
    )
    rows = sessions.join(turns, "session_id").join(trend, "session_id", "left").join(volatility, "session_id", "left")
    n = F.greatest(F.col("total_utterances"), F.lit(1))
    bonus = F.when(F.col("direction") == "improving", 0.05).when(F.col("direction") == "declining", -0.05).otherwise(0.0)
    rows = rows.withColumns(
        {
            "pause_part": 1.0 - F.least(F.col("avg_pause_sec") / 5.0, F.lit(1.0)),
            "question_part": F.least(F.col("total_questions") / n, F.lit(1.0)),
            "trend_part": bonus,
            "dominance_score": _unit(F.col("dominance")),
            "conflict_score": _unit(F.col("events") / n),
            "emotion_volatility_score": _unit(F.coalesce("emotion_volatility", F.lit(0.0))),
        }
    )
    engagement = _unit(0.7 * F.col("pause_part") + 0.3 * F.col("question_part") + F.col("trend_part"))
    rows = rows.withColumn("engagement_score", engagement)
    cooperation = (
        (1.0 - F.col("dominance_score")) * 0.35 + (1.0 - F.col("conflict_score")) * 0.40 + F.col("engagement_score") * 0.25
    )
    return rows.select(
        "session_id",
        "dominance_score",
        "engagement_score",
        "conflict_score",
        _unit(cooperation).alias("cooperation_score"),
        "emotion_volatility_score",
        "pause_part",
        "question_part",
        "trend_part",
    )


def score_breakdown(scores: DataFrame) -> DataFrame:
    """One row per score and part, with its reason."""
    # Parts, weights and reasons.
    parts = [
        ("dominance_score", "max_speaking_ratio", 1.0, "dominance_score", "Higher concentration of speaking time increases dominance score."),
        ("engagement_score", "pause_behavior", 0.7, "pause_part", "Shorter pauses and steadier turn flow improve engagement."),
        ("engagement_score", "question_behavior", 0.3, "question_part", "More clarifying questions can indicate active engagement."),
        ("engagement_score", "sentiment_trend_adjustment", 0.05, "trend_part", "Sentiment trend slightly adjusts engagement score."),
        ("conflict_score", "interruptions_and_overlaps", 1.0, "conflict_score", "More interruptions and overlaps increase conflict score."),
        ("cooperation_score", "balance_and_low_conflict", 1.0, "cooperation_score", "Balanced participation with low conflict improves cooperation."),
        ("emotion_volatility_score", "aggregated_signal_variation", 1.0, "emotion_volatility_score", "Higher sentiment swings and more emotion switching increase volatility."),
    ]
    items = F.array(
        *[
            F.struct(
                F.lit(score).alias("score"), F.lit(part).alias("component"), F.lit(weight).alias("weight"), round_binary(F.col(value), 3).alias("value"),
                F.lit(reason).alias("reason"),
            )
            for score, part, weight, value, reason in parts
        ]
    )
    return scores.select("session_id", F.explode(items).alias("item")).select("session_id", "item.*")


def _flags(rows: DataFrame, *flags: tuple[str, Column, Column, Column]) -> DataFrame:
    """Rows for the flags that hold; each is (type, condition, severity, reason), in the order of output."""
    made = F.array(
        *[
            F.when(holds, F.struct(F.lit(at).alias("place"), F.lit(kind).alias("type"), severity.alias("severity"), reason.alias("reason")))
            for at, (kind, holds, severity, reason) in enumerate(flags, 1)
        ]
    )
    return rows.select("*", F.explode(F.array_compact(made)).alias("flag"))


def speaker_flags(speakers: DataFrame, speaker_emotion: DataFrame, t: Thresholds | TenantThresholds | None = None) -> DataFrame:
    t = t or Thresholds()
    rows = t.on(speakers.join(speaker_emotion, ["session_id", "speaker"], "left"))
    who, emotion = F.col("speaker"), F.col("dominant_emotion")
    strained = emotion.isin("angry", "frustrated", "anxious", "upset") & (F.col("sample_count") >= 2)
    medium, low = F.lit("medium"), F.lit("low")
    found = _flags(
        rows,
        ("frequent_interruptions", F.col("interruption_count") >= t.frequent_interruptions, medium,
         F.concat(who, F.lit(" shows repeated interruption behavior."))),
        ("high_overlap_participation", F.col("overlap_count") >= t.overlap_participation, medium,
         F.concat(who, F.lit(" is frequently involved in overlapping turns."))),
        ("low_inquiry_behavior", (F.col("question_count") == 0) & (F.col("utterance_count") >= t.low_inquiry_utterances), low,
         F.concat(who, F.lit(" asks very few or no questions."))),
        ("speaker_emotional_strain", strained, low,
         F.concat(who, F.lit(" shows repeated "), emotion, F.lit(" emotional signals."))),
    )
    return found.select("session_id", "speaker", "flag.place", "flag.type", "flag.severity", "flag.reason")


def session_flags(
    speakers: DataFrame,
    sentiment: DataFrame,
    trend: DataFrame,
    escalation: DataFrame,
    inconsistency: DataFrame,
    t: Thresholds | TenantThresholds | None = None,
) -> DataFrame:
    """Flags of a session, in order: those by speaker in the order of first speech, then those of the whole."""
    t = t or Thresholds()
    speaking, words = F.col("speaking_ratio"), F.col("word_ratio")
    interruptions, overlaps = F.col("interruption_count"), F.col("overlap_count")
    high = lambda condition: F.when(condition, "high").otherwise("medium")
    by_speaker = _flags(
        t.on(speakers),
        ("speaker_dominance", (speaking >= t.dominance_speaking_ratio) | (words >= t.dominance_word_ratio),
         high((speaking >= 0.75) | (words >= 0.75)), F.concat("speaker", F.lit(" appears to dominate the conversation."))),
        ("high_tension", (interruptions >= t.tension_interruptions) | (overlaps >= t.tension_overlaps),
         high((interruptions >= 4) | (overlaps >= 4)),
         F.concat("speaker", F.lit(" is involved in repeated interruptions or overlaps, which may indicate elevated conversational tension."))),
    )
    by_speaker = by_speaker.select(
        "session_id", "speaker", (F.col("first_seq") * 10 + F.col("flag.place")).alias("place"), "flag.type", "flag.severity", "flag.reason"
    )
    whole = (
        escalation.select("session_id", F.col("level").alias("e_level"), F.col("summary").alias("e_summary"))
        .join(inconsistency.select("session_id", F.col("level").alias("i_level"), F.col("summary").alias("i_summary")), "session_id", "left")
        .join(sentiment.select("session_id", "label", "avg_score"), "session_id", "left")
        .join(trend.select("session_id", "direction"), "session_id", "left")
    )
    of_escalation = F.when(F.col("e_level") == "mild", "low").when(F.col("e_level") == "moderate", "medium").otherwise("high")
    of_session = _flags(
        whole,
        ("negative_session_mood", (F.col("label") == "negative") & (F.col("avg_score") <= 0.35), F.lit("medium"),
         F.lit("The session shows a strongly negative overall sentiment pattern.")),
        ("declining_session_tone", F.col("direction") == "declining", F.lit("low"),
         F.lit("Session sentiment trends downward across the interaction.")),
        ("conversation_escalation", F.col("e_level") != "none", of_escalation, F.col("e_summary")),
        ("conversation_inconsistency", F.col("i_level") != "none", F.col("i_level"), F.col("i_summary")),
    )
    last = 1_000_000_000_000
    of_session = of_session.select(
        "session_id", F.lit(None).cast("string").alias("speaker"), (F.col("flag.place") + last).alias("place"), "flag.type", "flag.severity", "flag.reason"
    )
    return by_speaker.unionByName(of_session)
