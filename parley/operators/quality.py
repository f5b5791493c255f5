"""Quality of recordings and transcripts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from parley.functions.numbers import round_binary
from parley.operators.metrics import ratio, word_count
from parley.operators.payloads import SENTIMENTS

SILENCE_DB, NEAR_SILENCE_DB, SPEECH_DB = -60.0, -45.0, -35.0


def decibels(amplitude: Column) -> Column:
    return 20.0 * F.log10(F.greatest(amplitude, F.lit(1e-12)))


def frame_energy(signals: DataFrame, frame: int) -> DataFrame:
    """Mean square and peak of every ``frame`` samples (columns ``id``, ``samples``)."""
    # cut the array into frames and square within each: no row per sample
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("samples")), F.lit(frame))
    frames = F.transform(starts, lambda s: F.slice("samples", s, frame))
    rows = signals.where("size(samples) > 0").select("id", F.posexplode(frames).alias("frame", "x"))
    squares = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return rows.select(
        "id",
        F.col("frame").cast("long").alias("frame"),
        F.size("x").alias("n"),
        squares.alias("squares"),
        F.array_max(F.transform("x", lambda v: F.abs(v).cast("double"))).alias("peak"),
    )


def audio_quality(signals: DataFrame, rate: int, frame: int | None = None) -> DataFrame:
    """Level, peak, share of silent frames, signal-to-noise ratio and four judgements per signal."""
    frames = frame_energy(signals, frame or max(1, rate * 30 // 1000))
    level = decibels(F.sqrt(F.col("squares") / F.col("n")))
    energy = F.col("squares") / F.col("n")
    sums = frames.groupBy("id").agg(
        F.sum("n").alias("n"),
        F.sum("squares").alias("squares"),
        F.max("peak").alias("peak"),
        F.count_if(level < SILENCE_DB).alias("silent"),
        F.count("*").alias("frames"),
        F.avg(F.when(level >= SPEECH_DB, energy)).alias("speech"),
        F.avg(F.when(level < SPEECH_DB, energy)).alias("noise"),
    )
    rms, snr = decibels(F.sqrt(F.col("squares") / F.col("n"))), 10.0 * F.log10(F.col("speech") / F.col("noise"))
    snr = F.when((F.col("speech") > 0) & (F.col("noise") > 0), snr)
    return sums.select(
        "id",
        F.round(F.col("n") / rate, 3).alias("duration_sec"),
        F.round(rms, 3).alias("rms_db"),
        F.round(decibels(F.col("peak")), 3).alias("peak_db"),
        ratio(F.col("silent"), F.col("frames")).alias("silence_ratio"),
        F.round(snr, 3).alias("snr_db"),
        (rms <= SILENCE_DB).alias("is_silent"),
        ((rms > SILENCE_DB) & (rms <= NEAR_SILENCE_DB)).alias("is_near_silent"),
        F.coalesce(snr < 10, F.lit(False)).alias("low_snr"),
        F.coalesce(snr < 5, F.lit(False)).alias("very_low_snr"),
    )


def transcript_proxy(segments: DataFrame) -> DataFrame:
    """Length, pace and repetition of a transcript (columns ``session_id``, ``pos``, ``start_ms``, ``end_ms``, ``text``)."""
    by_session = segments.groupBy("session_id").agg(
        F.max_by("end_ms", "pos").alias("last"),
        F.count("*").alias("num_segments"),
        F.sum(F.col("end_ms") - F.col("start_ms")).alias("spoken"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ").alias("text"),
    )
    tokens = F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != "")
    seconds = F.greatest(F.col("last") / 1000, F.lit(1e-6))
    repeated = F.when(F.size(tokens) > 0, 1 - F.size(F.array_distinct(tokens)) / F.size(tokens)).otherwise(0.0)
    return by_session.select(
        "session_id",
        F.round(F.col("last") / 1000, 3).alias("duration_sec"),
        word_count(F.col("text")).alias("total_words"),
        "num_segments",
        round_binary(word_count(F.col("text")) / seconds, 3).alias("words_per_sec"),
        round_binary(F.col("spoken") / F.col("num_segments") / 1000, 3).alias("avg_segment_sec"),
        round_binary(repeated, 3).alias("repetition_ratio"),
    )


def diarization_proxy(diarized: DataFrame) -> DataFrame:
    """Speakers, segments and their mean length."""
    return diarized.groupBy("session_id").agg(
        F.count_distinct("speaker").alias("num_speakers"),
        F.count("*").alias("num_segments"),
        round_binary(F.avg(F.col("end_ms") - F.col("start_ms")) / 1000, 3).alias("avg_segment_sec"),
    )


def alignment_health(asr: DataFrame, aligned: DataFrame) -> DataFrame:
    """How many aligned segments there are for the recognised ones."""
    a = asr.groupBy("session_id").agg(F.count("*").alias("asr_segments"))
    s = aligned.groupBy("session_id").agg(F.count("*").alias("speaker_segments"))
    n = F.coalesce("speaker_segments", F.lit(0))
    return a.join(s, "session_id", "left").select(
        "session_id",
        "asr_segments",
        n.alias("speaker_segments"),
        ratio(n, F.col("asr_segments"), 3).alias("coverage"),
        F.greatest(F.col("asr_segments") - n, F.lit(0)).alias("unassigned_asr_segments_est"),
    )


def summary_proxy(texts: DataFrame) -> DataFrame:
    """Words of a session's ``transcript`` and ``summary`` and their ratio; null texts have none."""
    said, short = word_count(F.coalesce("transcript", F.lit(""))), word_count(F.coalesce("summary", F.lit("")))
    rows = texts.select("session_id", short.alias("summary_words"), said.alias("transcript_words"))
    return rows.withColumn("compression_ratio", ratio(F.col("summary_words"), F.col("transcript_words")))


def sentiment_proxy(turns: DataFrame) -> DataFrame:
    """How many turns of a session have a label, and the share of each label among them."""
    share = lambda name: ratio(F.count_if(F.col("sent_label") == name), F.count("sent_label")).alias(f"{name}_share")
    return turns.groupBy("session_id").agg(F.count("sent_label").alias("labelled"), *[share(name) for name in SENTIMENTS])


def edits(a: str, b: str) -> int:
    """Levenshtein distance of two texts; a whole column of its table is held in the bits of four numbers (Hyyro 2003)."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict[str, list[int]] = {}
    for i, c in enumerate(a):
        places.setdefault(c, []).append(i)
    masks = {}
    for c, at in places.items():
        bits = bytearray(len(a) // 8 + 1)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        masks[c] = int.from_bytes(bits, "little")
    full, last, found = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for c in b:
        equal = masks.get(c, 0)
        same = ((((equal & up) + up) ^ up) | equal | down) & full
        right, left = down | (full ^ (same | up)), same & up
        found += bool(right & last) - bool(left & last)
        right = (right << 1 | 1) & full
        up, down = (left << 1) & full | (full ^ (same | right)), right & same
    return found


def text_distance(a: Column, b: Column) -> Column:
    """``edits`` of long texts: 30 cells of the table at a time, where the built-in function fills them one by one."""

    def of(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else edits(x, y) for x, y in zip(left, right, strict=True)], dtype="Int64")

    return F.pandas_udf(of, LongType())(a, b)


def character_error_rate(truth: Column, said: Column) -> Column:
    return text_distance(truth, said) / F.nullif(F.length(truth), F.lit(0))


def word_error_rate(truth: Column, said: Column) -> Column:
    """Edits between words, by the number of true words; null without any.

    Each distinct word of both texts becomes one character, so that the built-in distance between texts counts words.
    """
    words = lambda text: F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")

    def character(number: Column) -> Column:
        point = F.when(number < 0xD800, number).otherwise(number + 0x800)  # over the surrogates
        return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")

    def rate(x: Column) -> Column:
        coded = lambda side: F.array_join(F.transform(x[side], lambda w: character(F.array_position(x["known"], w))), "")
        return F.levenshtein(coded("a"), coded("b")) / F.nullif(F.size(x["a"]), F.lit(0))

    both = F.struct(words(truth).alias("a"), words(said).alias("b"))
    numbered = F.transform(F.array(both), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.array_distinct(F.concat(x["a"], x["b"])).alias("known")))
    return F.element_at(F.transform(numbered, rate), 1)


def segment_stats(segments: DataFrame) -> DataFrame:
    """Speaking time, words, longest turn, pace and shares of each speaker of aligned segments."""
    duration = F.col("end_ms") - F.col("start_ms")
    sums = segments.groupBy("session_id", "speaker").agg(
        F.sum(duration).alias("ms"),
        F.count("*").alias("segment_count"),
        F.sum(word_count(F.col("text"))).alias("total_words"),
        F.max(duration).alias("longest"),
        F.min("start_ms").alias("first"),
        F.max("end_ms").alias("last"),
    )
    session = Window.partitionBy("session_id")
    at_least = lambda total: F.greatest(total, F.lit(1.0))
    return sums.select(
        "session_id",
        "speaker",
        (F.col("ms") / 1000).alias("total_speaking_time"),
        "segment_count",
        "total_words",
        (F.greatest(F.col("longest"), F.lit(0)) / 1000).alias("longest_monologue"),
        (F.col("first") / 1000).alias("first_spoke_at"),
        (F.col("last") / 1000).alias("last_spoke_at"),
        F.round(F.col("ms") / 1000 / F.col("segment_count"), 6).alias("avg_segment_length"),
        F.round(F.when(F.col("ms") > 0, F.col("total_words") / F.col("ms") * 60000).otherwise(0.0), 6).alias("wpm"),
        F.round(F.col("ms") / 1000 / at_least(F.sum("ms").over(session) / 1000), 6).alias("speaking_ratio"),
        F.round(F.col("total_words") / at_least(F.sum("total_words").over(session)), 6).alias("word_ratio"),
    )


def conversation_stats(segments: DataFrame, diarized: DataFrame) -> DataFrame:
    """Span from the first to the last diarized segment, segments, words, average turn and speakers."""
    span = diarized.groupBy("session_id").agg(F.min_by("start_ms", "pos").alias("first"), F.max_by("end_ms", "pos").alias("last"))
    said = segments.groupBy("session_id").agg(
        F.count("*").alias("total_segments"),
        F.sum(word_count(F.col("text"))).alias("total_words"),
        F.count_distinct("speaker").alias("speaker_count"),
    )
    total = F.col("last") - F.col("first")
    return said.join(span, "session_id").select(
        "session_id",
        (total / 1000).alias("total_duration"),
        "total_segments",
        "total_words",
        F.round(total / 1000 / F.col("total_segments"), 6).alias("avg_turn_length"),
        "speaker_count",
        (F.col("first") / 1000).alias("conversation_start"),
        (F.col("last") / 1000).alias("conversation_end"),
    )


def evaluation(
    asr: DataFrame,
    diarized: DataFrame,
    aligned: DataFrame,
    truth: DataFrame | None = None,
    turns: DataFrame | None = None,
    summaries: DataFrame | None = None,
) -> DataFrame:
    """One row per session: the proxies, those of sentiment and summary where ``turns`` and ``summaries`` (session_id,
    summary) are given, and error rates where ``truth`` (session_id, text) is known; a session without it has none."""
    rows = transcript_proxy(asr).withColumnRenamed("num_segments", "asr_count")
    diar = diarization_proxy(diarized).withColumnsRenamed({"num_segments": "diar_count", "avg_segment_sec": "avg_turn_sec"})
    rows = rows.join(diar, "session_id", "left").join(alignment_health(asr, aligned), "session_id", "left")
    said = asr.groupBy("session_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ").alias("said")
    )
    if turns is not None:
        rows = rows.join(sentiment_proxy(turns), "session_id", "left")
    if summaries is not None:
        texts = said.withColumnRenamed("said", "transcript").join(summaries.select("session_id", "summary"), "session_id", "left")
        rows = rows.join(summary_proxy(texts), "session_id", "left")
    return rows if truth is None else rows.join(error_rates(truth, said), "session_id", "left")


def error_rates(truth: DataFrame, said: DataFrame) -> DataFrame:
    """Word and character error rates of ``said`` against ``truth`` (session_id, text)."""
    return truth.join(said, "session_id").select(
        "session_id",
        word_error_rate(F.col("text"), F.col("said")).alias("wer"),
        character_error_rate(F.col("text"), F.col("said")).alias("cer"),
    )
