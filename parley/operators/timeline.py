"""Timeline markers: dominance, pauses, interruptions, emotional shifts, tone decline and tension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.numbers import round_binary
from parley.operators.chunks import in_chunks, running
from parley.operators.metrics import ORDER, seconds
from parley.thresholds import TenantThresholds, Thresholds

COLUMNS = ["session_id", "marker_id", "type", "time_sec", "speaker", "severity", "start_sec", "end_sec", "reason"]


def _marker(rows: DataFrame, kind: str, time: Column, severity: Column, start: Column, end: Column, reason: Column, evidence: Column) -> DataFrame:
    return rows.select(
        "session_id",
        "marker_id",
        F.lit(kind).alias("type"),
        time.alias("time_sec"),
        "speaker",
        severity.alias("severity"),
        start.alias("start_sec"),
        end.alias("end_sec"),
        reason.alias("reason"),
        F.to_json(evidence).alias("evidence"),
    )


def _high_if(condition: Column) -> Column:
    return F.when(condition, "high").otherwise("medium")


def dominance_markers(speakers: DataFrame, t: Thresholds | TenantThresholds) -> DataFrame:
    speaking, words = F.col("speaking_ratio"), F.col("word_ratio")
    rows = t.on(speakers).where((speaking >= t.dominance_speaking_ratio) | (words >= t.dominance_word_ratio))
    rows = rows.withColumn("marker_id", F.concat(F.lit("dominance_"), "speaker"))
    first, last = F.col("first_spoke_at_sec"), F.col("last_spoke_at_sec")
    evidence = F.struct(round_binary(speaking, 3).alias("speaking_ratio"), round_binary(words, 3).alias("word_ratio"))
    reason = F.concat("speaker", F.lit(" shows dominant participation across the session."))
    return _marker(rows, "dominance_window", first, _high_if((speaking >= 0.75) | (words >= 0.75)), first, last, reason, evidence)


def tension_markers(speakers: DataFrame, t: Thresholds | TenantThresholds) -> DataFrame:
    interruptions, overlaps = F.col("interruption_count"), F.col("overlap_count")
    rows = t.on(speakers).where((interruptions >= t.tension_interruptions) | (overlaps >= t.tension_overlaps))
    rows = rows.withColumn("marker_id", F.concat(F.lit("high_tension_"), "speaker"))
    first, last = F.col("first_spoke_at_sec"), F.col("last_spoke_at_sec")
    evidence = F.struct("interruption_count", "overlap_count")
    reason = F.concat("speaker", F.lit(" is involved in repeated interruptions or overlaps, which may indicate elevated conversational tension."))
    return _marker(rows, "high_tension", first, _high_if((interruptions >= 4) | (overlaps >= 4)), first, last, reason, evidence)


def _mark(kind: str, holds: Column, time: Column, severity: Column, start: Column, end: Column, reason: Column, evidence: Column) -> Column:
    """A marker of a turn, null where it does not hold."""
    parts = {"type": F.lit(kind), "time_sec": time, "severity": severity, "start_sec": start, "end_sec": end, "reason": reason, "evidence": F.to_json(evidence)}
    return F.when(holds, F.struct(*[c.alias(n) for n, c in parts.items()]))


def _pause(t: Thresholds | TenantThresholds) -> Column:
    evidence = F.struct(
        seconds(F.col("gap_ms")).alias("pause_duration_sec"),
        F.col("prev_speaker").alias("speaker_before"),
        F.col("speaker").alias("speaker_after"),
    )
    start, severity = seconds(F.col("prev_end_ms")), _high_if(F.col("gap_ms") >= t.severe_pause_ms)
    gap = F.format_string("%.2f", round_binary(F.col("gap_ms") / 1000, 2))
    reason = F.concat(F.lit("Long pause of "), gap, F.lit("s may indicate disengagement or response hesitation."))
    return _mark("engagement_drop", F.col("gap_ms") >= t.long_pause_ms, start, severity, start, seconds(F.col("start_ms")), reason, evidence)


def _interruption(t: Thresholds | TenantThresholds) -> Column:
    evidence = F.struct(
        F.col("prev_speaker").alias("interrupted_speaker"),
        seconds(F.col("prev_end_ms") - F.col("start_ms")).alias("overlap_sec"),
        F.col("utt_id").alias("utterance_id"),
    )
    start = seconds(F.col("start_ms"))
    reason = F.concat("speaker", F.lit(" begins before "), "prev_speaker", F.lit(" finished speaking."))
    return _mark("interruption", F.col("interrupts"), start, F.lit("medium"), start, seconds(F.col("end_ms")), reason, evidence)


def _shift(t: Thresholds | TenantThresholds) -> Column:
    """A speaker's score moves far from that of the same speaker's utterance just before."""
    step = F.col("score_e4") - F.col("own_score")
    evidence = F.struct(
        round_binary(F.col("own_score") / 10000, 3).alias("previous_score"),
        round_binary(F.col("score_e4") / 10000, 3).alias("current_score"),
        F.round(F.abs(step) / 10000, 3).alias("delta"),
        F.when(step > 0, "up").otherwise("down").alias("direction"),
        F.coalesce("own_label", F.lit("")).alias("previous_label"),
        F.coalesce("sent_label", F.lit("")).alias("current_label"),
    )
    start, end, severity = seconds(F.col("own_start")), seconds(F.col("end_ms")), _high_if(F.abs(step) >= t.severe_shift_e4)
    reason = F.concat("speaker", F.lit(" shows a notable sentiment shift between turns."))
    return _mark("emotional_shift", F.abs(step) >= t.shift_e4, seconds(F.col("start_ms")), severity, start, end, reason, evidence)


def _decline(t: Thresholds | TenantThresholds) -> Column:
    """A scored utterance with a clear step down; the first one of a declining session is a marker."""
    start, end = seconds(F.col("start_ms")), seconds(F.col("end_ms"))
    evidence = F.struct(F.lit("declining").alias("trend_direction"))
    reason = F.lit("Session sentiment begins a noticeable downward shift.")
    return _mark("session_tone_decline", F.col("score_e4") - F.col("prev_score") <= -800, start, F.lit("medium"), start, end, reason, evidence)


TURN_MARKERS = {"engagement_drop": _pause, "interruption": _interruption, "emotional_shift": _shift, "session_tone_decline": _decline}


def turn_markers(seq: DataFrame, t: Thresholds | TenantThresholds, *kinds: str) -> DataFrame:
    """Markers of single turns, numbered by kind in sequence order: one pass over a session's turns, one numbering."""
    own = {"own_score": "score_e4", "own_label": "sent_label", "own_start": "start_ms"}
    scored = F.col("sent_label").isNotNull() & F.col("score_e4").isNotNull()
    # by session first: what is placed by it needs no other exchange for the windows by speaker and by kind
    rows = running(seq, ["session_id"], ORDER, {"scored": F.when(scored, F.col("score_e4"))})
    rows = running(rows, ["session_id", "speaker"], ORDER, {"own": F.struct(*own.values())})
    rows = t.on(rows).withColumns({name: F.col(f"own.{c}") for name, c in own.items()} | {"prev_score": F.when(scored, F.col("scored"))})
    marks = F.array_compact(F.array(*[TURN_MARKERS[k](t) for k in kinds or TURN_MARKERS]))
    chunk = [c for c in rows.columns if c == "chunk"]
    rows = rows.select("session_id", "seq", "speaker", *chunk, F.explode(marks).alias("m")).select("session_id", "seq", "speaker", *chunk, "m.*")
    rows = running(rows, ["session_id", "type"], ("seq",), number="number").withColumn("marker_id", F.concat("type", F.lit("_"), "number"))
    return rows.select(*COLUMNS, "evidence", "number")


def pause_markers(seq: DataFrame, t: Thresholds | TenantThresholds) -> DataFrame:
    return turn_markers(seq, t, "engagement_drop").drop("number")


def interruption_markers(seq: DataFrame, t: Thresholds | TenantThresholds) -> DataFrame:
    return turn_markers(seq, t, "interruption").drop("number")


def shift_markers(seq: DataFrame, t: Thresholds | TenantThresholds) -> DataFrame:
    return turn_markers(seq, t, "emotional_shift").drop("number")


def decline_markers(seq: DataFrame, trend: DataFrame, t: Thresholds | TenantThresholds) -> DataFrame:
    """In a declining session, the first scored utterance with a clear step down."""
    return _declining(turn_markers(seq, t, "session_tone_decline"), trend)


def _declining(markers: DataFrame, trend: DataFrame) -> DataFrame:
    """Without the steps down that are not the first of a declining session; that one tells the session's slope."""
    decline = F.col("type") == "session_tone_decline"
    falling = trend.where("direction = 'declining'").select("session_id", "direction", "slope")
    rows = markers.where(~decline | (F.col("number") == 1)).join(falling, "session_id", "left").where(~decline | F.col("slope").isNotNull())
    evidence = F.to_json(F.struct(F.col("direction").alias("trend_direction"), F.col("slope").alias("trend_slope")))
    rows = rows.withColumns({"marker_id": F.when(decline, F.col("type")).otherwise(F.col("marker_id")), "evidence": F.when(decline, evidence).otherwise(F.col("evidence"))})
    return rows.select(*COLUMNS, "evidence")


def placed(markers: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Markers with their place in the order of time and marker id; ``bounds`` are those of long sessions."""
    rows = markers if bounds is None else in_chunks(markers, bounds, F.col("time_sec") * 1000)
    rows = running(rows, ["session_id"], ("time_sec", "marker_id"), number="place")
    return rows.select(*markers.columns, F.col("place").cast("long").alias("place"))


def build_timeline(seq: DataFrame, speakers: DataFrame, trend: DataFrame, t: Thresholds | TenantThresholds | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """All markers of a session with their place in the order of time and marker id."""
    t = t or Thresholds()
    rows = _declining(turn_markers(seq, t), trend).unionByName(dominance_markers(speakers, t)).unionByName(tension_markers(speakers, t))
    return placed(rows, bounds)
