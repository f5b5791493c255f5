"""Registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import claims, escalation, language, metrics, quality, recommend, scores, signals, timeline
from parley.plans.bundle import SPEAKER, Bundle, build_bundle
from parley.sources.adapters import read_table, utterances_from_events
from parley.sources.scratch import materialize
from parley.thresholds import Thresholds

Query = Callable[[SparkSession, str], DataFrame]


def of_bundle(table: Callable[[Bundle], DataFrame]) -> Query:
    return lambda spark, folder: table(build_bundle(utterances_from_events(spark, folder)))


def of_sequence(table: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: table(metrics.sequence(utterances_from_events(spark, folder)))


def _markers(kind: Callable[[DataFrame], DataFrame]) -> Query:
    return of_sequence(lambda seq: kind(seq).select(*timeline.COLUMNS))


T = Thresholds()

QUERIES: dict[str, Query] = {
    "utterances": lambda spark, folder: utterances_from_events(spark, folder).drop("emotion", "word_count", "confidence"),
    "session_metrics": of_sequence(metrics.session_metrics),
    "speaker_metrics": of_sequence(lambda s: metrics.speaker_metrics(s).drop("first_seq")),
    "pauses": of_sequence(metrics.pauses),
    "dominant_speaker": of_sequence(lambda s: metrics.dominant_speaker(metrics.speaker_metrics(s))),
    "session_sentiment": of_sequence(lambda s: signals.sentiment_aggregate(s, ["session_id"])),
    "speaker_sentiment": of_sequence(lambda s: signals.sentiment_aggregate(s, SPEAKER)),
    "emotion_distribution": of_sequence(lambda s: signals.emotion_distribution(s, ["session_id"])),
    "speaker_emotion": of_sequence(lambda s: signals.emotion_aggregate(s, SPEAKER)),
    "sentiment_trend": of_sequence(signals.sentiment_trend),
    "emotion_volatility": of_sequence(signals.emotion_volatility),
    "dominance_markers": _markers(lambda s: timeline.dominance_markers(metrics.speaker_metrics(s), T)),
    "tension_markers": _markers(lambda s: timeline.tension_markers(metrics.speaker_metrics(s), T)),
    "pause_markers": _markers(lambda s: timeline.pause_markers(s, T)),
    "interruption_markers": _markers(lambda s: timeline.interruption_markers(s, T)),
    "shift_markers": _markers(lambda s: timeline.shift_markers(s, T)),
    "decline_markers": _markers(lambda s: timeline.decline_markers(s, signals.sentiment_trend(s), T)),
    "timeline": of_bundle(lambda b: b.timeline.drop("evidence")),
    "marker_clusters": of_bundle(lambda b: escalation.marker_clusters(b.markers).drop("at")),
    "escalation_signals": of_bundle(lambda b: b.escalation_signals),
    "escalation": of_bundle(lambda b: b.escalation),
    "read_turns": of_bundle(
        lambda b: b.read_turns.select("session_id", "utt_id", "lexical", "stance", "emotion_top", "emotion_side")
    ),
    "inconsistent_turns": of_bundle(
        lambda b: b.inconsistent_turns.select("session_id", "family", "seq", "speaker", "hit")
    ),
    "inconsistency_signals": of_bundle(lambda b: b.inconsistency_signals),
    "inconsistency_windows": of_bundle(lambda b: b.inconsistency_windows),
    "inconsistency": of_bundle(lambda b: b.inconsistency),
    "scores": of_bundle(lambda b: b.scores),
    "score_breakdown": of_bundle(lambda b: scores.score_breakdown(b.scores)),
    "speaker_flags": of_bundle(lambda b: b.speaker_flags.drop("place")),
    "session_flags": of_bundle(lambda b: b.session_flags.drop("place")),
    "session_insights": of_bundle(
        lambda b: b.insights.withColumns(
            {
                "speakers": F.array_join("speakers.speaker", ","),
                "timeline": F.array_join("timeline.marker_id", ","),
                "flags": F.array_join("flags.type", ","),
                "speaker_flags": F.array_join("speaker_flags.type", ","),
            }
        )
    ),
}


def _of_turns(table: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: table(utterances_from_events(spark, folder))


#: What claims are held against: for each subject a value that many claims come near to, and some gaps.
EVIDENCE = [
    ("CRYPTO_PRICE", "BTC", 100.0, None, "crypto"),
    ("WEATHER", "Paris|C", 90.0, None, "weather"),
    ("CURRENCY_RATE", "USD/EUR", 110.0, None, "forex"),
    ("STATIC_FACT", "France", None, "PARÍS", "facts"),
]


def evidence(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """A snapshot of every subject whenever an agent speaks, 20 seconds before."""
    known = F.array(
        *[
            F.struct(
                F.lit(kind).alias("claim_type"), F.lit(subject).alias("subject"), F.lit(value).cast("double").alias("value"),
                F.lit(text).cast("string").alias("value_text"), F.lit(source).alias("source"),
            )
            for kind, subject, value, text, source in EVIDENCE
        ]
    )
    at = turns.where("speaker = 'agent'").select((F.col("start_ms") - 20_000).alias("fetched_ms")).distinct()
    return at.select("fetched_ms", F.explode(known).alias("k")).select("k.claim_type", "k.subject", "fetched_ms", "k.value", "k.value_text", "k.source")


CLAIM_KEYS = ["session_id", "utt_id", "claim_ms"]


def detected_claims(turns: DataFrame) -> DataFrame:
    return claims.detect_claims(turns.withColumn("claim_ms", F.col("start_ms")), CLAIM_KEYS)


def checked_claims(spark: SparkSession, turns: DataFrame) -> DataFrame:
    return claims.verdicts(claims.with_evidence(detected_claims(turns), evidence(spark, turns)))


def claim_results(spark: SparkSession, folder: str) -> DataFrame:
    return checked_claims(spark, utterances_from_events(spark, folder))


def recommendations(spark: SparkSession, folder: str) -> DataFrame:
    turns = materialize(utterances_from_events(spark, folder), "turns")
    mood = signals.sentiment_aggregate(turns, ["session_id"]).where("label = 'negative'")
    return recommend.run_recommendations(turns, checked_claims(spark, turns), negative=mood)


def signals_table(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("samples"))


def _detector(of: Callable[[DataFrame], DataFrame]) -> Query:
    return _of_turns(lambda t: of(t).drop("payload"))


QUERIES |= {
    "clean_text": _of_turns(lambda t: t.select("session_id", "utt_id", language.clean_text(F.col("text")).alias("clean"))),
    "gated_sentiment": _of_turns(
        lambda t: t.select(
            "session_id",
            "utt_id",
            language.gated_sentiment(F.col("text"), F.col("sent_label"), F.col("score_e4") / 10000)[0].alias("label"),
            language.gated_sentiment(F.col("text"), F.col("sent_label"), F.col("score_e4") / 10000)[1].alias("score"),
        )
    ),
    "emotion_of_text": _of_turns(
        lambda t: t.select("session_id", "utt_id", language.emotion_of(F.col("text"), F.col("sent_label")).alias("emotion"))
    ),
    "intents": _of_turns(lambda t: t.select("session_id", "utt_id", language.intent_of(F.col("text")).alias("intent"))),
    "intent_counts": _of_turns(language.intent_counts),
    "cues": _of_turns(language.cues),
    "candidates": _of_turns(language.candidates),
    "sentiment_shares": _of_turns(language.sentiment_shares),
    "emotion_shares": _of_turns(language.emotion_shares),
    "term_weights": _of_turns(language.term_weights),
    "top_keywords": _of_turns(language.top_keywords),
    "top_emotion": _of_turns(
        lambda t: t.select("session_id", "utt_id", language.best_label(F.col("emotion"), F.col("text")).alias("b")).select(
            "session_id", "utt_id", "b.topic", "b.confidence"
        )
    ),
    "broken_words": lambda spark, folder: read_table(spark, folder, "documents").select(
        "doc_id", F.md5(language.break_long_words(F.col("text"))).alias("broken")
    ),
    "audio_quality": lambda spark, folder: quality.audio_quality(signals_table(spark, folder), 1600, 16),
    "claims": _of_turns(detected_claims),
    "claim_verdicts": lambda spark, folder: claim_results(spark, folder).drop("start", "end", "claim_text"),
    "claim_stats": lambda spark, folder: claims.claim_stats(claim_results(spark, folder), ["session_id"]),
    "task_recommendations": _detector(recommend.task_recommendations),
    "meeting_recommendations": _detector(recommend.meeting_recommendations),
    "email_recommendations": _detector(recommend.email_recommendations),
    "escalation_recommendations": _detector(recommend.escalation_recommendations),
    "review_recommendations": lambda spark, folder: recommend.review_recommendations(claim_results(spark, folder)).drop("payload"),
    "recommendations": lambda spark, folder: recommendations(spark, folder),
    "agent_context": _of_turns(lambda t: recommend.agent_context(t)),
}
