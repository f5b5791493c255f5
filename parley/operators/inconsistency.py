"""Inconsistency between what is said, how it is labelled and how it sounds: five families of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import text as rules
from parley.operators.chunks import running
from parley.operators.escalation import assess
from parley.operators.metrics import ORDER, seconds
from parley.operators.signals import dominant_emotion

#: Family, and the score from which its windows are of medium level.
FAMILIES = (
    ("sentiment_text_mismatch", 0.18),
    ("sentiment_emotion_contradiction", 0.16),
    ("abrupt_emotional_reversal", 0.18),
    ("contradictory_statements", 0.14),
    ("masking_tone", 0.14),
)
REVERSAL_MS, STANCE_MS = 30_000, 60_000


def read_turns(seq: DataFrame) -> DataFrame:
    """Utterances with tokens, polarity of text and emotion, stance and lower-case label."""
    rows = seq.withColumn("tokens", rules.tokens(F.col("text")))
    rows = rows.withColumns(
        {
            "lexical": rules.lexical_polarity(F.col("tokens")),
            "stance": rules.stance(F.col("tokens")),
            "emotion_top": dominant_emotion(F.col("emotion")),
            "label": F.lower("sent_label"),
        }
    )
    return rows.withColumn("emotion_side", rules.emotion_polarity(F.col("emotion_top"))).drop("tokens")


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _hit(family: int, eligible: Column, hit: Column, from_ms: Column, reason: Column) -> Column:
    parts = {"family": F.lit(family), "from_ms": from_ms, "hit": F.coalesce(hit, F.lit(False)), "reason": reason}
    return F.when(eligible, F.struct(*[c.alias(n) for n, c in parts.items()]))


def _state(state: Column, known: Column, name: Column) -> Column:
    return F.when(known, F.struct(state.alias("state"), name.alias("name"), F.col("start_ms").alias("from"), F.col("end_ms").alias("to")))


def _turnaround(family: int, state: Column, known: Column, was: Column, reach_ms: int, verb: str, name: Column) -> Column:
    """A hit where a speaker's known state differs from the same speaker's known state before, which ended shortly before."""
    turned = known & (was["state"] != state) & (F.col("start_ms") - was["to"]).between(0, reach_ms)
    reason = _say(F.col("speaker"), f" {verb} from '", was["name"], "' to '", name, f"' within {reach_ms // 1000}s.")
    return _hit(family, turned, F.lit(True), was["from"], reason)


def inconsistent_turns(turns: DataFrame) -> DataFrame:
    """Every eligible turn of a family and whether it is a hit; families are numbered from 1 in their order.

    One pass: a turn's hits of all families are made side by side.
    """
    label, lexical, side = F.col("label"), F.col("lexical"), F.col("emotion_side")
    polar = label.isin("positive", "negative")
    opposed = ((label == "positive") & (side == "negative")) | ((label == "negative") & (side == "positive"))
    flat = F.lower("emotion_top").isin("neutral", "calm")
    own, stance, emotion = F.col("start_ms"), F.col("stance"), F.col("emotion_top")
    felt = F.coalesce(side.isin("positive", "negative"), F.lit(False))
    states = {"felt_before": _state(side, felt, emotion), "said_before": _state(stance, stance.isNotNull(), stance)}
    turns = running(turns, ["session_id", "speaker"], ORDER, states)
    hits = F.array(
        _hit(1, polar & lexical.isNotNull(), lexical != label, own, _say("Sentiment label '", label, "' disagrees with lexical tone '", lexical, "' in this turn.")),
        _hit(2, polar & side.isNotNull(), opposed, own, _say("Sentiment '", label, "' conflicts with dominant emotion '", emotion, "' on this turn.")),
        _turnaround(3, side, felt, F.col("felt_before"), REVERSAL_MS, "flips emotion", emotion),
        _turnaround(4, stance, stance.isNotNull(), F.col("said_before"), STANCE_MS, "switches stance", stance),
        _hit(5, flat & ((lexical == "negative") | (label == "negative")), F.lit(True), own,
             _say(F.col("speaker"), " delivers negative content with a flat / '", emotion, "' emotional tone.")),
    )
    # not by a column of arrays, which Spark also puts into a filter and so makes twice
    rows = turns.select("session_id", "seq", "speaker", "end_ms", F.explode(F.array_compact(hits)).alias("h"))
    return rows.select("session_id", "h.family", "seq", "speaker", "h.from_ms", "end_ms", "h.hit", "h.reason")


def inconsistency_signals(hits: DataFrame) -> DataFrame:
    """Families that fire, with score, severity and the speaker of most hits (the first among equals)."""
    counts = hits.groupBy("session_id", "family").agg(F.count_if("hit").alias("hits"), F.count("*").alias("eligible"))
    share = F.col("hits") / F.col("eligible")
    enough = (F.col("hits") >= 2) | (share >= 0.5)
    n, family = F.col("hits"), F.col("family")
    raw = (
        F.when((family == 1) & enough, F.least(F.lit(0.30), 0.08 + share * 0.40))
        .when((family == 2) & enough, F.least(F.lit(0.25), 0.07 + share * 0.35))
        .when(family == 3, F.least(F.lit(0.25), 0.10 + n * 0.08))
        .when(family == 4, F.least(F.lit(0.20), 0.08 + n * 0.06))
        .when((family == 5) & (n >= 2), F.least(F.lit(0.20), 0.07 + n * 0.05))
    )
    fired = counts.where("hits > 0").withColumn("raw", raw).where("raw is not null")
    speakers = hits.where("hit").groupBy("session_id", "family", "speaker").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    order = Window.partitionBy("session_id", "family").orderBy(F.desc("n"), "first")
    top = speakers.withColumn("at", F.row_number().over(order)).where("at = 1").select("session_id", "family", "speaker")
    medium, name = F, F
    for number, (kind, step) in enumerate(FAMILIES, 1):
        medium = medium.when(family == number, F.col("raw") >= step)
        name = name.when(family == number, kind)
    return fired.join(top, ["session_id", "family"]).select(
        "session_id",
        family.alias("place"),
        name.alias("signal_type"),
        F.when(medium, "medium").otherwise("low").alias("severity"),
        F.round("raw", 4).alias("score"),
        "speaker",
        "hits",
        "eligible",
    )


def inconsistency_windows(hits: DataFrame, signals: DataFrame) -> DataFrame:
    """The first five hits of each family that fires, numbered through the families."""
    order = Window.partitionBy("session_id", "family").orderBy("seq")
    first = hits.where("hit").withColumn("at", F.row_number().over(order)).where("at <= 5")
    fired = signals.select("session_id", F.col("place").alias("family"), "signal_type", F.col("severity").alias("level"))
    rows = first.join(fired, ["session_id", "family"])
    number = F.row_number().over(Window.partitionBy("session_id").orderBy("family", "at"))
    return rows.select(
        "session_id",
        number.cast("long").alias("number"),
        "signal_type",
        "level",
        "speaker",
        seconds(F.col("from_ms")).alias("start_sec"),
        seconds(F.col("end_ms")).alias("end_sec"),
        "reason",
    )


def assess_inconsistency(signals: DataFrame, speakers: DataFrame) -> DataFrame:
    steps = ((0.65, "high"), (0.40, "medium"), (0.15, "low"))
    return assess(signals, speakers, "Inconsistency", "No clear inconsistency pattern was detected.", *steps)


def inconsistency_markers(windows: DataFrame, assessment: DataFrame) -> DataFrame:
    """Windows as timeline markers, for sessions with a level."""
    some = assessment.where("level != 'none'").select("session_id")
    return windows.join(some, "session_id").select(
        "session_id",
        F.concat(F.lit("inconsistency_"), "number").alias("marker_id"),
        F.lit("inconsistency_candidate").alias("type"),
        F.col("start_sec").alias("time_sec"),
        "speaker",
        F.col("level").alias("severity"),
        "start_sec",
        "end_sec",
        "reason",
        F.to_json(F.struct("signal_type", F.col("level").alias("window_level"))).alias("evidence"),
    )
