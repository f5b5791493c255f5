"""Artefacts of recordings as tables, and the record that a session's tables make up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SEGMENT = "struct<start:double,end:double,text:string,avg_logprob:double,no_speech_prob:double>"


def _listed(value: Column) -> Column:
    """Segments in any of their containers: under ``segments``, under ``meta``, or a bare list."""
    inside = F.from_json(value, f"segments array<{_SEGMENT}>, meta struct<segments:array<{_SEGMENT}>>")
    bare = F.when(F.trim(value).startswith("["), F.from_json(value, f"array<{_SEGMENT}>"))
    return F.coalesce(bare, inside["segments"], inside["meta"]["segments"])


def read_segments(artefacts: DataFrame, key: str = "session_id", value: str = "value") -> DataFrame:
    """Recognised segments (or diarized turns) of artefacts in JSON, with their place ``pos`` from 0.

    Rows without start or end are dropped; what cannot be read gives none. Probabilities default to -1 and 0.
    """
    rows = artefacts.select(key, F.posexplode(_listed(F.col(value))).alias("pos", "s")).where("s.start is not null and s.end is not null")
    return rows.select(
        key,
        "pos",
        F.col("s.start").alias("start_sec"),
        F.col("s.end").alias("end_sec"),
        F.trim(F.coalesce("s.text", F.lit(""))).alias("text"),
        F.coalesce("s.avg_logprob", F.lit(-1.0)).alias("avg_logprob"),
        F.coalesce("s.no_speech_prob", F.lit(0.0)).alias("no_speech_prob"),
    )


def payload_meta(payloads: DataFrame, key: str = "payload_id", value: str = "value") -> DataFrame:
    """Trimmed meta strings of payloads in JSON (empty: null; language: ``unknown``), and their warnings without nulls."""

    def text(name: str) -> Column:
        return F.nullif(F.trim(F.get_json_object(value, f"$.meta.{name}")), F.lit(""))

    warnings = F.from_json(F.get_json_object(value, "$.warnings"), "array<string>")
    return payloads.select(
        key,
        text("source").alias("source"),
        F.coalesce(text("language"), F.lit("unknown")).alias("language"),
        text("created_at").alias("created_at"),
        text("pipeline_version").alias("pipeline_version"),
        F.coalesce(F.array_compact(warnings), F.array().cast("array<string>")).alias("warnings"),
    )


def utterances_from_segments(segments: DataFrame) -> DataFrame:
    """Speaker segments as utterances: ids by place where they lack one, sentiment and emotion packed where known."""
    number = F.concat(F.lit("utt_"), F.col("pos") + 1)
    return segments.select(
        "session_id",
        F.coalesce("utt_id", number).alias("utt_id"),
        "pos",
        "speaker",
        "start_ms",
        "end_ms",
        "text",
        F.when(F.col("sent_label").isNotNull(), F.struct(F.col("sent_label").alias("label"), F.col("score_e4").alias("score_e4"))).alias("sentiment"),
        F.when(F.size("emotion") > 0, F.col("emotion")).alias("emotion"),
    )


def session_heads(utterances: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Sorted speakers and the duration of each session: the given one (``duration_ms``), else the last end."""
    rows = utterances.groupBy("session_id").agg(
        F.array_sort(F.collect_set("speaker")).alias("speakers"), F.max("end_ms").alias("last_ms")
    )
    if given is None:
        return rows.withColumnRenamed("last_ms", "duration_ms")
    told = F.when(F.col("duration_ms") >= 0, F.col("duration_ms"))
    return rows.join(given.select("session_id", "duration_ms"), "session_id", "left").select(
        "session_id", "speakers", F.coalesce(told, "last_ms").alias("duration_ms")
    )


def measured(stats: DataFrame, keys: list[str], units: dict[str, str]) -> DataFrame:
    """One row per key and statistic: its name, value and unit."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value"), F.lit(u).alias("unit")) for n, u in units.items()])
    return stats.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")


def warning_codes(sessions: DataFrame, codes: dict[str, str], failing: tuple[str, ...] = ()) -> DataFrame:
    """``warnings`` (distinct codes whose condition holds, in order), ``skipped_steps`` and ``status`` of each session.

    ``codes`` maps a code to an SQL condition; a column ``skipped`` may list steps that did not run. A code in
    ``failing`` makes the status ``error``, any other ``warning``.
    """
    raised = F.array_compact(F.array_distinct(F.array(*[F.when(F.expr(holds), F.lit(code)) for code, holds in codes.items()])))
    skipped = F.array_distinct(F.coalesce("skipped", F.array().cast("array<string>"))) if "skipped" in sessions.columns else F.array().cast("array<string>")
    rows = sessions.select("session_id", raised.alias("warnings"), skipped.alias("skipped_steps"))
    fatal = F.arrays_overlap("warnings", F.array(*map(F.lit, failing))) if failing else F.lit(False)
    status = F.when(fatal, "error").when((F.size("warnings") > 0) | (F.size("skipped_steps") > 0), "warning").otherwise("ok")
    return rows.withColumn("status", status)


def newest_enrichment(*stages: DataFrame) -> DataFrame:
    """The rows of the first stage that has any for a session: the latest enrichment wins. All have equal columns."""
    rows = stages[0].withColumn("stage_", F.lit(0))
    for n, stage in enumerate(stages[1:], 1):
        rows = rows.unionByName(stage.withColumn("stage_", F.lit(n)))
    first = rows.groupBy("session_id").agg(F.min("stage_").alias("stage_"))
    return rows.join(first, ["session_id", "stage_"], "left_semi").drop("stage_")


def final_records(sessions: DataFrame, turns: DataFrame, **parts: DataFrame) -> DataFrame:
    """One row per session with its timeline, projected from ``turns`` with defaults, and a column for each part.

    A part has ``session_id`` and one more column; sessions without it get null.
    """
    known = set(turns.columns)
    default = lambda name, value: F.coalesce(F.col(name), F.lit(value)) if name in known else F.lit(value)
    entry = F.struct(
        "pos",
        default("start_ms", 0).alias("start_ms"),
        default("end_ms", 0).alias("end_ms"),
        default("speaker", "UNKNOWN").alias("speaker"),
        default("text", "").alias("text"),
        default("intent", "other").alias("intent"),
        default("overlap", False).alias("overlap"),
    )
    timeline = turns.groupBy("session_id").agg(F.array_sort(F.collect_list(entry)).alias("timeline"))
    rows = sessions.select("session_id").join(timeline, "session_id", "left")
    for name, part in parts.items():
        column = next(c for c in part.columns if c != "session_id")
        rows = rows.join(part.select("session_id", F.col(column).alias(name)), "session_id", "left")
    return rows


def flat_results(results: DataFrame, at: Column) -> DataFrame:
    """Fact-check results as they are stored: claim, evidence and confidence side by side, an id and two times."""
    evidence = F.when(F.col("source").isNotNull(), F.to_json(F.struct("source", "actual", "actual_text", "fetched_ms")))
    return results.select(
        F.sha2(F.concat_ws("|", "session_id", "utt_id", "claim_id"), 256).alias("id"),
        "session_id",
        "utt_id",
        "claim_id",
        "claim_type",
        "subject",
        "signature",
        F.col("value").alias("claimed_value"),
        F.col("value_text").alias("claimed_text"),
        F.col("actual").alias("actual_value"),
        "actual_text",
        "verdict",
        "diff_pct",
        "confidence",
        "confidence_label",
        "source",
        evidence.alias("evidence"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def results_of(stored: DataFrame, keys: DataFrame) -> DataFrame:
    """Stored results of the sessions (or sessions and utterances) in ``keys``, with a number, the newest first."""
    from pyspark.sql import Window

    order = Window.partitionBy(*keys.columns).orderBy(F.desc("created_at"), F.desc("id"))
    rows = stored.join(keys.distinct(), keys.columns, "left_semi").withColumn("number", F.row_number().over(order).cast("long"))
    return rows.withColumn("evidence", F.from_json("evidence", "source string, actual double, actual_text string, fetched_ms long"))
