"""The insight bundle: every table of a session's insights from its utterances."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators import chunks, escalation, inconsistency, metrics, scores, signals, summary, timeline
from parley.sources.scratch import discard, materialize
from parley.thresholds import TenantThresholds, Thresholds

SESSION, SPEAKER = ["session_id"], ["session_id", "speaker"]
#: The tables of a whole bundle; each reads those of earlier steps only.
STEPS = (
    ("turns",),
    ("sessions", "speakers", "session_sentiment", "session_emotion", "speaker_emotion", "trend", "inconsistent_turns"),
    ("markers", "scores", "inconsistency_signals"),
    ("escalation_signals", "inconsistency"),
    ("escalation",),
    ("session_flags",),
)


class Bundle:
    """Tables by session, each planned when it is first asked for.

    What several of them read is written once to the shared folder: the turns in sequence, the aggregates of
    sessions and speakers, the markers and the signals. So every plan starts from a few small tables, and no task
    holds the sorts and hash maps of more than one of them. ``discard()`` deletes the written tables.
    """

    def __init__(self, utterances: DataFrame, thresholds: Thresholds | TenantThresholds | None = None):
        self.utterances, self.thresholds = utterances, thresholds or Thresholds()
        self._written: list[DataFrame] = []

    def _keep(self, table: DataFrame, name: str) -> DataFrame:
        table = materialize(table, f"bundle-{name}")
        self._written.append(table)
        return table

    def discard(self) -> None:
        """Delete the written tables; the bundle must not be read after."""
        discard(*self._written)
        self._written = []

    def prepare(self, without: tuple[str, ...] = ()) -> None:
        """Write the shared tables; those that do not read each other are written side by side."""
        with ThreadPoolExecutor(len(STEPS[1])) as threads:
            for step in STEPS:
                list(threads.map(lambda name: getattr(self, name), [name for name in step if name not in without]))

    @cached_property
    def turns(self) -> DataFrame:
        return self._keep(metrics.sequence(self.utterances, self.bounds), "turns")

    @cached_property
    def bounds(self) -> DataFrame | None:
        """Where sessions too long for one task are cut; None if there is none."""
        found = chunks.long_sessions(self.utterances)
        return None if found is None else self._keep(found, "bounds")

    @cached_property
    def read_turns(self) -> DataFrame:
        return inconsistency.read_turns(self.turns)

    @cached_property
    def sessions(self) -> DataFrame:
        return self._keep(metrics.session_metrics(self.turns), "sessions")

    @cached_property
    def speakers(self) -> DataFrame:
        return self._keep(metrics.speaker_metrics(self.turns), "speakers")

    @cached_property
    def dominant(self) -> DataFrame:
        return metrics.dominant_speaker(self.speakers)

    @cached_property
    def session_sentiment(self) -> DataFrame:
        return self._keep(signals.sentiment_aggregate(self.turns, SESSION), "sentiment")

    @cached_property
    def speaker_sentiment(self) -> DataFrame:
        return signals.sentiment_aggregate(self.turns, SPEAKER)

    @cached_property
    def session_emotion(self) -> DataFrame:
        return self._keep(signals.emotion_aggregate(self.turns, SESSION), "emotion")

    @cached_property
    def speaker_emotion(self) -> DataFrame:
        return self._keep(signals.emotion_aggregate(self.turns, SPEAKER), "speaker-emotion")

    @cached_property
    def trend(self) -> DataFrame:
        return self._keep(signals.sentiment_trend(self.turns), "trend")

    @cached_property
    def volatility(self) -> DataFrame:
        return signals.emotion_volatility(self.turns)

    @cached_property
    def markers(self) -> DataFrame:
        """The timeline that escalation sees."""
        return self._keep(timeline.build_timeline(self.turns, self.speakers, self.trend, self.thresholds, self.bounds), "markers")

    @cached_property
    def escalation_signals(self) -> DataFrame:
        found = escalation.escalation_signals(self.trend, self.session_sentiment, self.speaker_emotion, self.speakers, self.markers)
        return self._keep(found, "escalation-signals")

    @cached_property
    def escalation(self) -> DataFrame:
        return self._keep(escalation.assess_escalation(self.escalation_signals, self.speakers), "escalation")

    @cached_property
    def inconsistent_turns(self) -> DataFrame:
        return self._keep(inconsistency.inconsistent_turns(self.read_turns), "hits")

    @cached_property
    def inconsistency_signals(self) -> DataFrame:
        return self._keep(inconsistency.inconsistency_signals(self.inconsistent_turns), "inconsistency-signals")

    @cached_property
    def inconsistency_windows(self) -> DataFrame:
        return inconsistency.inconsistency_windows(self.inconsistent_turns, self.inconsistency_signals)

    @cached_property
    def inconsistency(self) -> DataFrame:
        return self._keep(inconsistency.assess_inconsistency(self.inconsistency_signals, self.speakers), "inconsistency")

    @cached_property
    def scores(self) -> DataFrame:
        return self._keep(scores.compute_scores(self.sessions, self.speakers, self.trend, self.volatility), "scores")

    @cached_property
    def speaker_flags(self) -> DataFrame:
        return scores.speaker_flags(self.speakers, self.speaker_emotion, self.thresholds)

    @cached_property
    def session_flags(self) -> DataFrame:
        self.prepare(("sessions", "session_emotion", "scores", "session_flags"))
        found = scores.session_flags(
            self.speakers, self.session_sentiment, self.trend, self.escalation, self.inconsistency, self.thresholds
        )
        return self._keep(found, "flags")

    @cached_property
    def timeline(self) -> DataFrame:
        """Markers with those of inconsistency, which escalation does not see."""
        self.prepare(("sessions", "session_sentiment", "session_emotion", "speaker_emotion", "scores", "escalation_signals", "escalation", "session_flags"))
        more = inconsistency.inconsistency_markers(self.inconsistency_windows, self.inconsistency)
        rows = self.markers.drop("place").unionByName(more)
        return timeline.placed(rows, self.bounds)

    @cached_property
    def overall(self) -> DataFrame:
        return summary.overall_summary(
            self.sessions, self.scores, self.dominant, self.session_sentiment, self.trend, self.session_emotion, self.escalation, self.inconsistency,
            self.session_flags,
        )

    @cached_property
    def insights(self) -> DataFrame:
        """Every table of the bundle in one row per session: lists in their order, the rest as columns."""
        self.prepare()

        def listed(table: DataFrame, name: str, *order: str) -> DataFrame:
            item = F.struct(*order, *[c for c in table.columns if c != "session_id" and c not in order])
            return table.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias(name))

        def level(table: DataFrame, name: str) -> DataFrame:
            return table.select("session_id", *[F.col(c).alias(f"{name}_{c}") for c in ("level", "score", "primary_speaker", "summary")])

        who = ["session_id", "speaker"]
        people = self.speakers.join(self.speaker_sentiment.select(*who, F.col("label").alias("sentiment")), who, "left")
        people = people.join(self.speaker_emotion.select(*who, F.col("dominant_emotion").alias("emotion")), who, "left")
        rows = self.sessions.join(self.scores, "session_id").join(self.dominant.select("session_id", "dominant_speaker"), "session_id")
        for other in (
            self.session_sentiment.select("session_id", F.col("label").alias("sentiment"), F.col("avg_score").alias("sentiment_score")),
            self.trend.select("session_id", F.col("direction").alias("trend"), F.col("slope").alias("trend_slope")),
            self.session_emotion.select("session_id", F.col("dominant_emotion").alias("emotion")),
            level(self.escalation, "escalation"),
            level(self.inconsistency, "inconsistency"),
            self.overall,
            listed(people, "speakers", "first_seq"),
            listed(self.timeline, "timeline", "place"),
            listed(self.session_flags, "flags", "place"),
            listed(self.speaker_flags, "speaker_flags", "speaker", "place"),
        ):
            rows = rows.join(other, "session_id", "left")
        return rows


def build_bundle(utterances: DataFrame, thresholds: Thresholds | TenantThresholds | None = None) -> Bundle:
    return Bundle(utterances, thresholds)
