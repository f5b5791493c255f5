"""Recognised words and diarized turns: smoothing, capping, alignment, overlap, conversation turns and roles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "SPEAKER_UNKNOWN"
#: Words and turns meet in buckets of this length.
BUCKET_MS = 30_000
MERGE_GAP_MS, OVERLAP_MS, OVERLAP_CAP = 750, 150, 0.55


def asr_confidence(avg_logprob: Column, no_speech_prob: Column) -> Column:
    raw = (1 / (1 + F.exp(-F.coalesce(avg_logprob, F.lit(-1.0))))) * (1 - F.coalesce(no_speech_prob, F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def slice_words(asr: DataFrame) -> DataFrame:
    """One row per word; a segment's time is divided evenly, and its last word ends with it. Times in milliseconds."""
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    rows = asr.where("trim(text) != ''").withColumns(
        {"n": F.size(words), "length": F.greatest((F.col("end_ms") - F.col("start_ms")).cast("double"), F.lit(0.001))}
    )
    rows = rows.select("session_id", "pos", "start_ms", "end_ms", "n", "length", F.posexplode(words).alias("at", "word")).withColumn("at", F.col("at").cast("long"))
    part = F.col("length") / F.col("n")
    return rows.select(
        "session_id",
        F.col("pos").alias("seg_pos"),
        "at",
        "word",
        (F.col("start_ms") + F.col("at") * part).alias("word_start"),
        F.when(F.col("at") == F.col("n") - 1, F.col("end_ms").cast("double"))
        .otherwise(F.col("start_ms") + (F.col("at") + 1) * part)
        .alias("word_end"),
    )


def _buckets(start: Column, end: Column) -> Column:
    first = F.floor(start / BUCKET_MS)
    return F.explode(F.sequence(first, F.greatest(first, F.floor(end / BUCKET_MS))))


def align_words(words: DataFrame, turns: DataFrame) -> DataFrame:
    """Each turn with the words that it overlaps, in order; turns without words are dropped.

    An interval join: both sides are dealt into the time buckets that they touch and meet on session and bucket; a
    pair counts in the bucket where the later of the two starts.
    """
    w = words.withColumn("bucket", _buckets(F.col("word_start"), F.col("word_end")))
    t = turns.select(
        "session_id", F.col("pos").alias("turn_pos"), "speaker", "start_ms", "end_ms",
        F.coalesce("diarization_confidence", "confidence", F.lit(1.0)).alias("diarization_confidence"),
    ).withColumn("bucket", _buckets(F.col("start_ms"), F.col("end_ms")))
    meet = (F.col("word_end") > F.col("start_ms")) & (F.col("word_start") < F.col("end_ms"))
    once = F.floor(F.greatest(F.col("word_start"), F.col("start_ms").cast("double")) / BUCKET_MS) == F.col("bucket")
    pairs = t.join(w, ["session_id", "bucket"]).where(meet & once)
    said = F.array_sort(F.collect_list(F.struct("word_start", "seg_pos", "at", "word")))
    grouped = pairs.groupBy("session_id", "turn_pos", "speaker", "start_ms", "end_ms", "diarization_confidence").agg(said.alias("said"))
    return grouped.select(
        "session_id", F.col("turn_pos").alias("pos"), "speaker", "start_ms", "end_ms", "diarization_confidence",
        F.array_join(F.transform("said", lambda x: x["word"]), " ").alias("text"),
    )


def _islands(rows: DataFrame, joined: Column) -> DataFrame:
    """Number the runs of rows in which each continues the one before."""
    order = Window.partitionBy("session_id").orderBy("start_ms", "pos")
    starts = F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)
    return rows.withColumn("new", starts).withColumn("island", F.sum("new").over(order)).drop("new")


def _gap(order) -> Column:
    return F.col("start_ms") - F.lag("end_ms").over(order)


def merge_blocks(segments: DataFrame, max_gap_ms: int = MERGE_GAP_MS) -> DataFrame:
    """Join a segment to the one before by the same speaker if it follows within the gap and does not overlap it.

    The end is that of the last segment; the confidence moves half-way towards each new one.
    """
    order = Window.partitionBy("session_id").orderBy("start_ms", "pos")
    same = (F.col("speaker") == F.lag("speaker").over(order)) & _gap(order).between(0, max_gap_ms)
    rows = _islands(segments, same)
    parts = F.array_sort(F.collect_list(F.struct("start_ms", "pos", "end_ms", "text", "diarization_confidence")))
    merged = rows.groupBy("session_id", "island").agg(F.first("speaker").alias("speaker"), parts.alias("p"))
    first, last = F.element_at("p", 1), F.element_at("p", -1)
    folded = F.aggregate(
        F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), first["diarization_confidence"], lambda a, x: (a + x["diarization_confidence"]) / 2
    )
    return merged.select(
        "session_id", first["pos"].alias("pos"), "speaker", first["start_ms"].alias("start_ms"), last["end_ms"].alias("end_ms"),
        F.trim(F.array_join(F.transform("p", lambda x: x["text"]), " ")).alias("text"), folded.alias("diarization_confidence"),
    )


def best_segment(turns: DataFrame, asr: DataFrame) -> DataFrame:
    """Turns with the confidence of the recognised segment that overlaps them most, the first among equals; else 0.5."""
    t = turns.withColumn("bucket", _buckets(F.col("start_ms"), F.col("end_ms")))
    a = asr.select(
        "session_id", F.col("pos").alias("asr_pos"), F.col("start_ms").alias("a_start"), F.col("end_ms").alias("a_end"),
        asr_confidence(F.col("avg_logprob"), F.col("no_speech_prob")).alias("asr_confidence"),
    ).withColumn("bucket", _buckets(F.col("a_start"), F.col("a_end")))
    overlap = F.least("end_ms", "a_end") - F.greatest("start_ms", "a_start")
    pairs = t.join(a, ["session_id", "bucket"]).withColumn("overlap", overlap).where("overlap > 0")
    best = pairs.groupBy("session_id", "pos").agg(F.min(F.struct(-F.col("overlap"), F.col("asr_pos"), F.col("asr_confidence"))).alias("b"))
    best = best.select("session_id", "pos", F.col("b.asr_confidence").alias("found"))
    return turns.join(best, ["session_id", "pos"], "left").withColumn("confidence", F.coalesce("found", F.lit(0.5))).drop("found")


def overlap_windows(turns: DataFrame, least_ms: int = OVERLAP_MS) -> DataFrame:
    """Times when two turns overlap for ``least_ms`` at least; windows that touch are one."""
    t = turns.select("session_id", "pos", "start_ms", "end_ms").withColumn("bucket", _buckets(F.col("start_ms"), F.col("end_ms")))
    a, b = t.alias("a"), t.alias("b")
    earlier = F.struct("a.start_ms", "a.end_ms", "a.pos") < F.struct("b.start_ms", "b.end_ms", "b.pos")
    start, end = F.greatest("a.start_ms", "b.start_ms"), F.least("a.end_ms", "b.end_ms")
    once = F.floor(start / BUCKET_MS) == F.col("a.bucket")
    on = (F.col("a.session_id") == F.col("b.session_id")) & (F.col("a.bucket") == F.col("b.bucket"))
    pairs = a.join(b, on & earlier).where((end - start >= least_ms) & once)
    pairs = pairs.select(F.col("a.session_id").alias("session_id"), start.alias("start_ms"), end.alias("end_ms")).distinct()
    order = Window.partitionBy("session_id").orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = pairs.withColumn("new", F.when(F.col("start_ms") <= reach, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(order))
    merged = rows.groupBy("session_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return merged.drop("island")


def mark_overlap(segments: DataFrame, windows: DataFrame, policy: str = "mark_overlap") -> DataFrame:
    """Segments within any window: marked, their confidences capped, the speaker unknown unless the policy is ``dominant``."""
    if policy not in ("mark_overlap", "dominant"):
        raise ValueError("policy must be mark_overlap or dominant")
    s = segments.withColumn("bucket", _buckets(F.col("start_ms"), F.col("end_ms")))
    w = windows.select("session_id", F.col("start_ms").alias("w_start"), F.col("end_ms").alias("w_end"))
    w = w.withColumn("bucket", _buckets(F.col("w_start"), F.col("w_end")))
    inside = (F.least("end_ms", "w_end") - F.greatest("start_ms", "w_start")) > 0
    hit = s.join(w, ["session_id", "bucket"]).where(inside).select("session_id", "pos", F.lit(True).alias("hit")).distinct()
    rows = segments.join(hit, ["session_id", "pos"], "left").withColumn("overlap", F.coalesce("hit", F.lit(False))).drop("hit")
    cap = lambda c: F.when(F.col("overlap"), F.least(F.coalesce(F.col(c), F.lit(1.0)), F.lit(OVERLAP_CAP))).otherwise(F.col(c))
    speaker = F.when(F.col("overlap") & F.lit(policy == "mark_overlap"), UNKNOWN).otherwise(F.col("speaker"))
    return rows.withColumns(
        {"speaker": speaker, "confidence": cap("confidence"), "diarization_confidence": cap("diarization_confidence")}
    )


def roles(segments: DataFrame) -> DataFrame:
    """The speaker with most time is the customer, the next the agent, others keep their name."""
    length = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    times = segments.groupBy("session_id", "speaker").agg(F.sum(length).alias("ms"), F.min(F.struct("start_ms", "pos")).alias("first"))
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ms"), "first"))
    times = times.withColumn("place", place)
    role = F.when(F.col("place") == 1, "CUSTOMER").when(F.col("place") == 2, "AGENT").otherwise(F.col("speaker"))
    return times.select("session_id", "speaker", role.alias("role"))


def conversation_turns(segments: DataFrame, max_gap_ms: int = MERGE_GAP_MS) -> DataFrame:
    """Turns of one speaker each; a segment that begins before the last one ended continues it too."""
    order = Window.partitionBy("session_id").orderBy("start_ms", "pos")
    same = (F.col("speaker") == F.lag("speaker").over(order)) & (_gap(order) <= max_gap_ms)
    rows = _islands(segments, same)
    parts = F.array_sort(F.collect_list(F.struct("start_ms", "pos", "end_ms", F.coalesce("text", F.lit("")).alias("text"))))
    merged = rows.groupBy("session_id", "island").agg(
        F.first("speaker").alias("speaker_raw"), parts.alias("p"), F.bool_or("overlap").alias("overlap")
    )
    who = roles(segments).withColumnRenamed("speaker", "speaker_raw")
    merged = merged.join(who, ["session_id", "speaker_raw"])
    return merged.select(
        "session_id", F.col("island").alias("turn"), F.element_at("p", 1)["start_ms"].alias("start_ms"),
        F.element_at("p", -1)["end_ms"].alias("end_ms"), F.col("role").alias("speaker"), "speaker_raw",
        F.trim(F.array_join(F.transform("p", lambda x: x["text"]), " ")).alias("text"), "overlap",
    )


def _smoother(min_ms: float, gap_ms: float):
    def smooth(rows: Iterator) -> Iterator:
        """Turns in order, of one session after the other; only the turn that was kept last is held."""
        last = None
        for x in rows:
            same = last is not None and x.session_id == last.session_id
            near = same and x.speaker == last.speaker and 0 <= x.start_ms - last.end_ms <= gap_ms
            if near or (same and x.end_ms - x.start_ms < min_ms):
                last = last._replace(
                    end_ms=max(last.end_ms, x.end_ms),
                    confidence=(last.confidence + x.confidence) / 2,
                    diarization_confidence=(last.diarization_confidence + x.diarization_confidence) / 2,
                )
            else:
                if last is not None:
                    yield last
                last = x
        if last is not None:
            yield last

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = smooth(x for part in parts for x in part.itertuples(index=False, name="Turn"))
        while some := list(islice(kept, 10_000)):
            yield pd.DataFrame(some)

    return batches


def smooth_turns(turns: DataFrame, low_snr: bool = False) -> DataFrame:
    """Merge close turns of a speaker and absorb very short ones into the turn that was kept last.

    What a turn merges with depends on what was merged before, so sessions stream by in order through Python.
    """
    factor = 1.25 if low_snr else 1.0
    columns = ["session_id", "pos", "speaker", "start_ms", "end_ms", "confidence", "diarization_confidence"]
    rows = turns.where("end_ms > start_ms").select(
        *columns[:5], F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("diarization_confidence", F.lit(1.0)).alias("diarization_confidence")
    )
    rows = rows.repartition("session_id").sortWithinPartitions("session_id", "start_ms", "pos")
    schema = "session_id string, pos long, speaker string, start_ms long, end_ms long, confidence double, diarization_confidence double"
    return rows.mapInPandas(_smoother(500 * factor, 300 * factor), schema)


def cap_speakers(turns: DataFrame, most: int = 8, low_snr: bool = False) -> DataFrame:
    """Speakers beyond the ``most`` with most time, or with hardly any, become unknown, with capped confidences."""
    share_from, most = (0.07 if low_snr else 0.05), max(1, min(most, 12))
    length = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    times = turns.groupBy("session_id", "speaker").agg(F.sum(length).alias("ms"), F.min(F.struct("start_ms", "pos")).alias("first"))
    session = Window.partitionBy("session_id")
    times = times.withColumns(
        {
            "place": F.row_number().over(session.orderBy(F.desc("ms"), "first")),
            "share": F.col("ms") / F.greatest(F.sum("ms").over(session), F.lit(1)),
            "cap_applied": F.count("*").over(session) > most,
        }
    )
    rows = turns.join(times.select("session_id", "speaker", "place", "share", "cap_applied"), ["session_id", "speaker"])
    minor = (F.col("place") > most) | (F.col("share") < share_from)
    cap = lambda c: F.when(minor, F.least(F.coalesce(F.col(c), F.lit(1.0)), F.lit(0.6))).otherwise(F.col(c))
    low = lambda c: F.least(c, F.lit(0.7)) if low_snr else c
    return rows.select(
        "session_id", "pos", F.when(minor, UNKNOWN).otherwise(F.col("speaker")).alias("speaker"), "start_ms", "end_ms",
        low(cap("confidence")).alias("confidence"), low(cap("diarization_confidence")).alias("diarization_confidence"), "cap_applied",
    )


def align(asr: DataFrame, turns: DataFrame, policy: str = "mark_overlap") -> DataFrame:
    """Speaker segments with text, confidence and overlap from recognised segments and diarized turns."""
    merged = merge_blocks(align_words(slice_words(asr), turns))
    return mark_overlap(best_segment(merged, asr), overlap_windows(turns), policy)


def to_utterances(segments: DataFrame) -> DataFrame:
    """Speaker segments in the columns of utterances."""
    order = Window.partitionBy("session_id").orderBy("start_ms", "pos")
    n = F.row_number().over(order)
    return segments.select(
        "session_id", F.concat(F.lit("utt_"), n).alias("utt_id"), n.cast("long").alias("pos"), "speaker", "start_ms", "end_ms", "text",
        F.lit(None).cast("long").alias("word_count"), F.lit(None).cast("string").alias("sent_label"), F.lit(None).cast("long").alias("score_e4"),
        F.lit(None).cast("map<string,double>").alias("emotion"), "overlap", "confidence",
    )
