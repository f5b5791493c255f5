"""Sequence columns and the metrics of sessions, speakers and pauses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.chunks import in_chunks, running

ORDER = ("start_ms", "end_ms", "utt_id")


def seconds(ms: Column) -> Column:
    return F.round(ms / 1000, 3)


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """Rounded quotient, 0 for an empty whole."""
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))


def first_by(value: str, *order: Column, over: tuple[str, ...]) -> Column:
    """The value of the first row in an order that has no ties, over a window partition."""
    return F.first(value).over(Window.partitionBy(*over).orderBy(*order))


def word_count(text: Column) -> Column:
    """Words between white space; none in an empty text."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def sequence(utterances: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Utterances, placed by session, with their number, word count and the values of the one before.

    One exchange on ``session_id``, none if the rows are placed by it already; every rule that follows windows or groups
    on it without another. With ``bounds``
    (``chunks.long_sessions``) long sessions are placed by chunk too, and turns tell their ``chunk``.
    """
    before = ["utt_id", "speaker", "start_ms", "end_ms"]
    if bounds is None:
        order = Window.partitionBy("session_id").orderBy(*ORDER)
        last = F.struct(*[F.lag(c).over(order).alias(c) for c in before])
        rows = utterances.withColumns({"seq": F.row_number().over(order), "prev": last})
    else:
        rows = running(in_chunks(utterances, bounds), ["session_id"], ORDER, {"prev": F.struct(*before)}, "seq")
    return rows.select(
        *[c for c in rows.columns if c not in ("prev", "seq", "chunk")],
        F.col("seq").cast("long").alias("seq"),
        F.coalesce("word_count", word_count(F.col("text"))).alias("words"),
        F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")).alias("duration_ms"),
        F.col("text").contains("?").alias("question"),
        *[F.col(f"prev.{c}").alias(f"prev_{c}") for c in before],
        *([] if bounds is None else ["chunk"]),
    ).withColumns(
        {
            "gap_ms": F.col("start_ms") - F.col("prev_end_ms"),
            "interrupts": F.coalesce(
                (F.col("speaker") != F.col("prev_speaker")) & (F.col("start_ms") < F.col("prev_end_ms")), F.lit(False)
            ),
        }
    )


def session_metrics(seq: DataFrame) -> DataFrame:
    gap = F.when(F.col("gap_ms") > 0, F.col("gap_ms"))
    sums = seq.groupBy("session_id").agg(
        F.sum("duration_ms").alias("duration"),
        F.count_distinct("speaker").alias("total_speakers"),
        F.count("*").alias("total_utterances"),
        F.sum("words").alias("total_words"),
        F.count_if("question").alias("total_questions"),
        F.count(gap).alias("total_pauses"),
        F.coalesce(F.sum(gap), F.lit(0)).alias("pause"),
        F.coalesce(F.max(gap), F.lit(0)).alias("longest"),
    )
    n = F.col("total_utterances")
    return sums.select(
        "session_id",
        seconds(F.col("duration")).alias("total_duration_sec"),
        "total_speakers",
        n,
        "total_words",
        ratio(F.col("total_words"), n, 3).alias("avg_utterance_length_words"),
        F.round(F.col("duration") / n / 1000, 3).alias("avg_utterance_duration_sec"),
        "total_questions",
        "total_pauses",
        F.when(F.col("total_pauses") > 0, F.round(F.col("pause") / F.col("total_pauses") / 1000, 3))
        .otherwise(F.lit(0.0))
        .alias("avg_pause_sec"),
        seconds(F.col("longest")).alias("max_pause_sec"),
    )


def speaker_metrics(seq: DataFrame) -> DataFrame:
    """One row per session and speaker; ratios are shares of the session's totals."""
    sums = seq.groupBy("session_id", "speaker").agg(
        F.sum("duration_ms").alias("time"),
        F.count("*").alias("utterance_count"),
        F.sum("words").alias("word_count"),
        F.count_if("question").alias("question_count"),
        F.count_if("interrupts").alias("interruption_count"),
        F.count_if("overlap").alias("overlap_count"),
        F.min_by("start_ms", "seq").alias("first_ms"),
        F.max_by("end_ms", "seq").alias("last_ms"),
        F.min("seq").alias("first_seq"),
    )
    session = Window.partitionBy("session_id")
    n = F.col("utterance_count")
    return sums.select(
        "session_id",
        "speaker",
        seconds(F.col("time")).alias("speaking_time_sec"),
        n,
        "word_count",
        ratio(F.col("time"), F.sum("time").over(session)).alias("speaking_ratio"),
        ratio(F.col("word_count"), F.sum("word_count").over(session)).alias("word_ratio"),
        ratio(F.col("word_count"), n, 3).alias("avg_utterance_length_words"),
        F.round(F.col("time") / n / 1000, 3).alias("avg_utterance_duration_sec"),
        "question_count",
        "interruption_count",
        "overlap_count",
        seconds(F.col("first_ms")).alias("first_spoke_at_sec"),
        seconds(F.col("last_ms")).alias("last_spoke_at_sec"),
        "first_seq",
    )


def pauses(seq: DataFrame) -> DataFrame:
    return seq.where("gap_ms > 0").select(
        "session_id",
        F.col("prev_utt_id").alias("start_after_utterance_id"),
        F.col("utt_id").alias("end_before_utterance_id"),
        seconds(F.col("gap_ms")).alias("duration_sec"),
        F.col("prev_speaker").alias("speaker_before"),
        F.col("speaker").alias("speaker_after"),
    )


def dominant_speaker(speakers: DataFrame) -> DataFrame:
    """The speaker with the largest share of speaking time, the first to speak among equals."""
    order = Window.partitionBy("session_id").orderBy(F.desc("speaking_ratio"), "first_seq")
    first = speakers.withColumn("place", F.row_number().over(order)).where("place = 1")
    return first.select("session_id", F.col("speaker").alias("dominant_speaker"), "speaking_ratio")
