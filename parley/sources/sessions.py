"""Typed session documents: nested JSON or Parquet with an explicit schema, their faults, and their utterances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, LongType, MapType, StringType, StructField, StructType

from parley.operators.metrics import word_count
from parley.operators.payloads import SENTIMENTS, clean_speaker, clean_text


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


TEXT, REAL, WHOLE = StringType(), DoubleType(), LongType()
META = _struct(source=TEXT, language=TEXT, created_at=TEXT, pipeline_version=TEXT)
UTTERANCE = _struct(
    id=TEXT,
    speaker=TEXT,
    start=REAL,
    end=REAL,
    text=TEXT,
    word_count=WHOLE,
    sentiment=_struct(label=TEXT, score=REAL),
    emotion=_struct(values=MapType(TEXT, REAL)),
    overlap=BooleanType(),
    confidence=REAL,
    diarization_confidence=REAL,
)
SCHEMA = _struct(
    session_id=TEXT, duration_sec=REAL, speakers=ArrayType(TEXT), utterances=ArrayType(UTTERANCE), meta=META, warnings=ArrayType(TEXT)
)
CORRUPT = "malformed"


def read_sessions(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Sessions of a folder of JSON lines or Parquet files; ``malformed`` holds a line that does not fit the schema.

    Nothing is inferred, so one pass reads the files, and Parquet reads only the fields that are used.
    """
    if kind == "parquet":
        return spark.read.schema(SCHEMA).parquet(path).withColumn(CORRUPT, F.lit(None).cast("string"))
    if kind != "json":
        raise ValueError(f"sessions are read from json or parquet, not {kind}")
    with_corrupt = StructType([*SCHEMA.fields, StructField(CORRUPT, TEXT)])
    return spark.read.schema(with_corrupt).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def _fault(holds: Column, code: str) -> Column:
    return F.when(F.coalesce(holds, F.lit(False)), F.lit(code))


def _outside(value: Column) -> Column:
    return ~value.between(0, 1)


def _utterance_faults(u: Column) -> Column:
    """Codes of what is wrong with one utterance."""
    emotions = F.coalesce(F.map_values(u["emotion"]["values"]), F.array().cast("array<double>"))
    return F.array_compact(
        F.array(
            _fault(u["id"].isNull(), "missing_id"),
            _fault(u["speaker"].isNull(), "missing_speaker"),
            _fault(u["start"].isNull(), "missing_start"),
            _fault(u["end"].isNull(), "missing_end"),
            _fault((u["start"] < 0) | (u["end"] < 0), "negative_time"),
            _fault(u["end"] < u["start"], "end_before_start"),
            _fault(u["word_count"] < 0, "negative_word_count"),
            _fault(~u["sentiment"]["label"].isin(SENTIMENTS), "unknown_sentiment"),
            _fault(_outside(u["sentiment"]["score"]), "sentiment_out_of_range"),
            _fault(F.exists(emotions, lambda v: F.coalesce(_outside(v), F.lit(True))), "emotion_out_of_range"),
            _fault(_outside(u["confidence"]), "confidence_out_of_range"),
            _fault(_outside(u["diarization_confidence"]), "diarization_confidence_out_of_range"),
        )
    )


def with_faults(sessions: DataFrame) -> DataFrame:
    """Sessions with ``faults``, the distinct codes of what is wrong with them; an empty list if nothing is.

    A session is whole or rejected: one faulty utterance rejects it. A malformed line has that fault alone.
    """
    own = F.array_compact(F.array(_fault(F.col("session_id").isNull(), "missing_session_id"), _fault(F.col("duration_sec") < 0, "negative_duration")))
    utterances = F.coalesce("utterances", F.array().cast(SCHEMA["utterances"].dataType))
    nested = F.flatten(F.transform(utterances, lambda u: F.when(u.isNull(), F.array(F.lit("null_utterance"))).otherwise(_utterance_faults(u))))
    return sessions.withColumn("faults", F.when(F.col(CORRUPT).isNotNull(), F.array(F.lit(CORRUPT))).otherwise(F.array_distinct(F.concat(own, nested))))


def fault_counts(sessions: DataFrame) -> DataFrame:
    """How many sessions each fault rejects, and how many have none (``fault`` null)."""
    return with_faults(sessions).select(F.explode_outer("faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("sessions"))


def utterances_of(sessions: DataFrame) -> DataFrame:
    """Utterances of the sessions without a fault, in the columns that the operators take.

    Times become whole milliseconds and scores whole ten-thousandths. Utterances are placed by start, end and id; those
    without a word count get that of their text. A session without utterances gives none.
    """
    rows = with_faults(sessions).where(F.size("faults") == 0)
    # a map cannot be compared, so utterances are sorted by their keys and looked up by their place
    keyed = F.transform("utterances", lambda u, i: F.struct(u["start"].alias("start"), u["end"].alias("end"), u["id"].alias("id"), i.alias("i")))
    rows = rows.select("session_id", "utterances", F.posexplode(F.array_sort(keyed)).alias("pos", "k"))
    u = F.element_at("utterances", F.col("k.i") + 1)
    rows = rows.select("session_id", "pos", u.alias("u"))
    text = clean_text(F.col("u.text"))
    emotion = F.col("u.emotion.values")
    return rows.select(
        "session_id",
        F.col("u.id").alias("utt_id"),
        (F.col("pos") + 1).cast("long").alias("pos"),
        clean_speaker(F.col("u.speaker")).alias("speaker"),
        F.round(F.col("u.start") * 1000).cast("long").alias("start_ms"),
        F.round(F.col("u.end") * 1000).cast("long").alias("end_ms"),
        text.alias("text"),
        F.coalesce("u.word_count", word_count(text)).alias("word_count"),
        F.col("u.sentiment.label").alias("sent_label"),
        F.round(F.col("u.sentiment.score") * 10000).cast("long").alias("score_e4"),
        F.when(F.size(emotion) > 0, emotion).alias("emotion"),
        F.coalesce("u.overlap", F.lit(False)).alias("overlap"),
        F.col("u.confidence").alias("confidence"),
        F.col("u.diarization_confidence").alias("diarization_confidence"),
    )


def sessions_from(utterances: DataFrame) -> DataFrame:
    """Session documents of utterances, one per session; the other way round of ``utterances_of``."""
    optional = lambda c, kind: F.col(c) if c in utterances.columns else F.lit(None).cast(kind)
    item = F.struct(
        "pos",
        F.struct(
            F.col("utt_id").alias("id"), "speaker", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text", "word_count",
            F.struct(F.col("sent_label").alias("label"), (F.col("score_e4") / 10000).alias("score")).alias("sentiment"),
            F.struct(F.col("emotion").alias("values")).alias("emotion"), "overlap", "confidence",
            optional("diarization_confidence", "double").alias("diarization_confidence"),
        ).alias("u"),
    )
    grouped = utterances.groupBy("session_id").agg(
        (F.max("end_ms") / 1000).alias("duration_sec"), F.array_sort(F.collect_set("speaker")).alias("speakers"), F.collect_list(item).alias("items")
    )
    ordered = F.array_sort("items", lambda a, b: F.signum(a["pos"] - b["pos"]).cast("int"))
    return grouped.select(
        "session_id", "duration_sec", "speakers", F.transform(ordered, lambda x: x["u"]).alias("utterances"), F.lit(None).cast(META).alias("meta"),
        F.array().cast("array<string>").alias("warnings"),
    )
