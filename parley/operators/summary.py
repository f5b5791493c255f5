"""Texts about a session: overall, by speaker, concerns, key moments, and a report row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

RANKS = {"low": 1, "medium": 2, "high": 3}


def fixed(value: Column, digits: int = 2, percent: bool = False) -> Column:
    """A number as text with fixed decimals, rounded on its exact binary value."""
    pattern = f"%.{digits}f" + ("%%" if percent else "")

    def of(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else pattern % (v * 100 if percent else v)).astype(object)

    return F.pandas_udf(of, StringType())(value.cast("double"))


def _rank(severity: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in RANKS.items() for x in p]), severity), F.lit(0))


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def speaker_summaries(speakers: DataFrame, sentiment: DataFrame, emotion: DataFrame, flags: DataFrame) -> DataFrame:
    who = ["session_id", "speaker"]
    named = flags.groupBy(*who).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "type"))), lambda f: f["type"]).alias("flags"))
    rows = speakers.join(sentiment.select(*who, "label"), who, "left").join(emotion.select(*who, "dominant_emotion"), who, "left").join(named, who, "left")
    share = F.col("speaking_ratio")
    style = F.when(share >= 0.60, "dominant").when(share <= 0.20, "limited").otherwise("moderately active")
    asked = F.col("question_count") / F.col("utterance_count")
    questions = (
        F.when(F.col("question_count") == 0, "They did not ask questions during the captured interaction.")
        .when(asked >= 0.40, "They used questions frequently, suggesting active probing or clarification.")
        .when(asked >= 0.15, "They asked occasional questions during the conversation.")
        .otherwise("They asked only a small number of questions.")
    )
    text = F.concat_ws(
        " ",
        _say("", F.col("speaker"), " contributed ", F.col("utterance_count"), " utterances, ", F.col("word_count"), " words, and ",
             fixed(F.col("speaking_time_sec")), " seconds of speech."),
        _say("Their speaking share was ", fixed(share, percent=True), ", suggesting ", style, " participation."),
        questions,
        _say("Their sentiment profile appears mostly ", F.col("label"), "."),
        _say("Their dominant emotional signal is ", F.col("dominant_emotion"), "."),
        F.when(F.col("interruption_count") > 0, _say("They were associated with ", F.col("interruption_count"), " interruption event(s).")),
        F.when(F.col("overlap_count") > 0, _say("They were involved in ", F.col("overlap_count"), " overlapping turn(s).")),
        F.coalesce(_say("Notable speaker-level signals include: ", F.array_join(F.slice("flags", 1, 3), ", "), "."),
                   F.lit("No major speaker-level concerns were flagged.")),
    )
    return rows.select(*who, text.alias("summary"))


def notable_concerns(flags: DataFrame, most: int = 6) -> DataFrame:
    """Distinct concerns of a session, the most severe first, in the order of the flags among equals."""
    text = F.concat(F.coalesce(F.concat("speaker", F.lit(": ")), F.lit("")), "reason")
    rows = flags.select("session_id", text.alias("concern"), _rank(F.col("severity")).alias("r"), "place")
    first = rows.groupBy("session_id", "concern").agg(F.min(F.struct(-F.col("r"), F.col("place"))).alias("at"))
    order = Window.partitionBy("session_id").orderBy("at")
    return first.withColumn("number", F.row_number().over(order).cast("long")).where(F.col("number") <= most).select("session_id", "number", "concern")


def key_moments(timeline: DataFrame, most: int = 5) -> DataFrame:
    """The most severe markers, the latest first among equals."""
    order = Window.partitionBy("session_id").orderBy(F.desc(_rank(F.col("severity"))), F.desc("time_sec"), "place")
    rows = timeline.withColumn("number", F.row_number().over(order).cast("long")).where(F.col("number") <= most)
    kind = F.replace("type", F.lit("_"), F.lit(" "))
    text = _say("At ", fixed(F.col("time_sec")), "s, ", F.coalesce(F.concat("speaker", F.lit(" ")), F.lit("")), "showed a ", kind, " signal (", F.col("severity"), ").")
    return rows.select("session_id", "number", "marker_id", text.alias("moment"))


def overall_summary(sessions: DataFrame, scores: DataFrame, dominant: DataFrame, sentiment: DataFrame, trend: DataFrame, emotion: DataFrame,
                    escalation: DataFrame, inconsistency: DataFrame, flags: DataFrame) -> DataFrame:
    counts = flags.groupBy("session_id").agg(
        F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium")
    )
    level = lambda df, p: df.select("session_id", *[F.col(c).alias(f"{p}_{c}") for c in ("level", "score", "summary")])
    rows = sessions.join(scores, "session_id").join(dominant, "session_id")
    for other in (sentiment.select("session_id", "label", "avg_score"), trend.select("session_id", "direction"),
                  emotion.select("session_id", "dominant_emotion"), level(escalation, "e"), level(inconsistency, "i"), counts):
        rows = rows.join(other, "session_id", "left")
    top, conflict, engagement = F.col("speaking_ratio"), F.col("conflict_score"), F.col("engagement_score")
    balance = F.when(top >= 0.75, "highly imbalanced").when(top >= 0.60, "somewhat imbalanced").otherwise("fairly balanced")
    tone = (
        F.when(conflict >= 0.7, "strained")
        .when((engagement >= 0.7) & (conflict < 0.3), "active and reasonably cooperative")
        .when(engagement < 0.35, "low-energy")
        .otherwise("moderately engaged")
    )
    pause = (
        F.when(F.col("max_pause_sec") >= 6, "some substantial hesitation or disengagement windows")
        .when(F.col("avg_pause_sec") >= 3, "noticeable pauses between responses")
        .when(F.col("avg_pause_sec") <= 1, "a relatively smooth response flow")
        .otherwise("occasional pauses but generally steady pacing")
    )
    friction = (
        F.when(conflict >= 0.7, "Turn-taking behavior suggests elevated tension, with frequent interruptions or overlaps.")
        .when(conflict >= 0.4, "There are moderate signs of friction in the turn-taking pattern.")
        .otherwise("Turn-taking appears relatively orderly, with limited conflict signals.")
    )
    assessed = lambda p, name: F.when(
        F.col(f"{p}_level") != "none", _say(f"{name} assessment is ", F.col(f"{p}_level"), ", with score ", fixed(F.col(f"{p}_score")), ". ", F.col(f"{p}_summary"))
    )
    closing = (
        F.when(F.col("high") > 0, _say("There are ", F.col("high"), " high-severity concern(s) that may deserve closer review."))
        .when(F.col("medium") > 0, _say("There are ", F.col("medium"), " medium-severity signal(s) worth monitoring."))
        .otherwise("No major high-severity conversational risks were detected.")
    )
    text = F.concat_ws(
        " ",
        _say("This session contains ", F.col("total_utterances"), " utterances across ", F.col("total_speakers"), " speaker(s), with a total measured speaking time of ",
             fixed(F.col("total_duration_sec")), " seconds and ", F.col("total_words"), " words."),
        _say("Overall sentiment appears ", F.col("label"), " with a ", F.col("direction"), " trend (average score ", fixed(F.col("avg_score")), ")."),
        _say("Emotion signals are led by ", F.col("dominant_emotion"), " across the session."),
        _say("The interaction appears ", balance, ", with ", F.col("dominant_speaker"), " contributing the largest share of speaking time."),
        _say("Overall engagement appears ", tone, ", and pause behavior suggests ", pause, "."),
        friction,
        assessed("e", "Escalation"),
        assessed("i", "Inconsistency"),
        closing,
    )
    return rows.select("session_id", text.alias("summary"))


def transcript_excerpt(turns: DataFrame, most: int = 4000) -> DataFrame:
    """A session's text, cut after ``most`` characters with a marker."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    rows = turns.groupBy("session_id").agg(text.alias("text"))
    cut = F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit(" ... [TRUNCATED]"))).otherwise(F.col("text"))
    return rows.select("session_id", cut.alias("transcript"), (F.length("text") > most).alias("cut"))
