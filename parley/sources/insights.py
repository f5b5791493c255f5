"""Stored insights: a session's whole bundle in one row of nested columns, and views that read a part of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators import summary
from parley.plans.bundle import Bundle
from parley.sources import store

WHO = ["session_id", "speaker"]


def _fields(table: DataFrame, *without: str) -> list[str]:
    return [c for c in table.columns if c not in ("session_id", *without)]


def _listed(table: DataFrame, item: Column, name: str) -> DataFrame:
    """The rows of each session as a sorted list; the first field of ``item`` orders it."""
    return table.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias(name))


def insight_records(bundle: Bundle) -> DataFrame:
    """One row per session: ``analytics`` (metrics, scores, speakers), ``insights`` (timeline, flags, speakers) and ``summaries``.

    Lists of speakers are in the order of first speech, so their places agree. A section without entries is an empty list.
    A session's lists are as long as its speakers, markers and flags; its utterances stay in their own table.
    """
    bundle.prepare()
    people = bundle.speakers.join(bundle.speaker_sentiment.select(*WHO, F.col("label").alias("sentiment")), WHO, "left")
    people = people.join(bundle.speaker_emotion.select(*WHO, F.col("dominant_emotion").alias("emotion")), WHO, "left")
    texts = summary.speaker_summaries(bundle.speakers, bundle.speaker_sentiment, bundle.speaker_emotion, bundle.speaker_flags)
    people = people.join(texts, WHO, "left")
    flags = bundle.speaker_flags.groupBy(*WHO).agg(
        F.array_sort(F.collect_list(F.struct("place", *_fields(bundle.speaker_flags, "speaker", "place")))).alias("flags")
    )
    people = people.join(flags, WHO, "left")
    metrics = _fields(bundle.speakers, "first_seq", "speaker")
    speaker = F.struct(
        "first_seq", "speaker", F.struct(*metrics).alias("metrics"),
        F.struct("sentiment", "emotion", F.coalesce("flags", F.array().cast(flags.schema["flags"].dataType)).alias("flags")).alias("signals"), "summary",
    )
    timeline, session_flags = bundle.timeline, bundle.session_flags
    markers = F.struct("place", *_fields(timeline, "place"))
    concerns, moments = summary.notable_concerns(session_flags), summary.key_moments(timeline)
    rows = bundle.sessions
    for part in (
        bundle.scores.select("session_id", F.struct(*_fields(bundle.scores)).alias("scores")),
        _listed(people, speaker, "people"),
        _listed(timeline, markers, "timeline"),
        _listed(session_flags, F.struct("place", *_fields(session_flags, "place")), "flags"),
        bundle.overall.select("session_id", F.col("summary").alias("overall")),
        _listed(concerns, F.struct("number", "concern"), "concerns"),
        _listed(moments, F.struct("number", "moment"), "moments"),
    ):
        rows = rows.join(part, "session_id", "left")
    kinds = dict(zip(rows.columns, (f.dataType for f in rows.schema), strict=True))
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast(kinds[c])) for c in ("people", "timeline", "flags", "concerns", "moments")})
    each = lambda *names: F.transform("people", lambda p: F.struct(*[p[n] for n in names]))
    return rows.select(
        "session_id",
        F.struct(F.struct(*_fields(bundle.sessions)).alias("session"), "scores", each("speaker", "metrics").alias("speakers")).alias("analytics"),
        F.struct("timeline", "flags", each("speaker", "signals").alias("speakers")).alias("insights"),
        F.struct(
            "overall",
            F.transform("concerns", lambda c: c["concern"]).alias("concerns"),
            F.transform("moments", lambda m: m["moment"]).alias("moments"),
            each("speaker", "summary").alias("speakers"),
        ).alias("summaries"),
    )


def store_insights(bundle: Bundle, path: str, at: Column, parts: int = store.PARTITIONS) -> None:
    """Insert or replace the records of a bundle's sessions in the table at ``path``; ``at`` is the time of writing."""
    store.upsert(insight_records(bundle).withColumns({"created_at": at, "updated_at": at}), path, parts=parts)


def summary_view(stored: DataFrame) -> DataFrame:
    """The conversation-level texts; reads ``summaries`` without its speakers."""
    s = "summaries"
    return stored.select("session_id", F.col(f"{s}.overall").alias("overall_summary"), F.col(f"{s}.concerns").alias("notable_concerns"), F.col(f"{s}.moments").alias("key_moments"))


def speakers_view(stored: DataFrame) -> DataFrame:
    """One row per speaker: metrics, signals and text; reads the three lists of speakers."""
    rows = stored.select(
        "session_id",
        F.explode(F.arrays_zip(F.col("analytics.speakers").alias("a"), F.col("insights.speakers").alias("i"), F.col("summaries.speakers").alias("s"))).alias("p"),
    )
    return rows.select("session_id", "p.a.speaker", "p.a.metrics.*", "p.i.signals.*", "p.s.summary")


def timeline_view(stored: DataFrame) -> DataFrame:
    """One row per marker, in order by ``place``; reads ``insights.timeline`` alone."""
    return stored.select("session_id", F.explode("insights.timeline").alias("m")).select("session_id", "m.*")


def flags_view(stored: DataFrame) -> DataFrame:
    """One row per flag of a session; reads ``insights.flags`` alone."""
    return stored.select("session_id", F.explode("insights.flags").alias("f")).select("session_id", "f.*")
