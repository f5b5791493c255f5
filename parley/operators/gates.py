"""Gates: which rows go on, why the others do not, and both sides written and counted in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from parley.operators.payloads import payload_issues, read_payloads

SIDE = "accepted"
# What a recording is warned of.
SILENT, LOW_SNR, NOISE, UNKNOWN = "AUDIO_SILENT_OR_NEAR_SILENT", "LOW_SNR_AUDIO", "HEAVY_NOISE_AUDIO", "AUDIO_QUALITY_FAILED"


def gate_payloads(lines: DataFrame, id_col: str = "payload_id", json_col: str = "value") -> DataFrame:
    """Payloads with their ``issues`` in order and whether they are ``accepted``: one with an error is not, warnings are no reason."""
    lines = lines.withColumnsRenamed({id_col: "payload_id", json_col: "value"})
    issues = payload_issues(read_payloads(lines))
    listed = issues.groupBy("payload_id").agg(F.array_sort(F.collect_list(F.struct("field", "code", "severity"))).alias("issues"))
    rows = lines.join(listed, "payload_id", "left")
    rows = rows.withColumn("issues", F.coalesce("issues", F.array().cast(listed.schema["issues"].dataType)))
    return rows.withColumn(SIDE, ~F.exists("issues", lambda i: i["severity"] == "error"))


def gate_audio(sessions: DataFrame, quality: DataFrame) -> DataFrame:
    """Sessions with ``quality_warnings`` and whether they are ``accepted``: silent and nearly silent ones are not.

    Noise is a warning, and takes the emotion away where the table has one, as it cannot be heard. A session whose
    quality is not known goes on with a warning of its own.
    """
    marks = quality.select(F.col("id").alias("session_id"), (F.col("is_silent") | F.col("is_near_silent")).alias("silent"), "low_snr", "very_low_snr")
    rows = sessions.join(marks, "session_id", "left")
    silent, known = F.coalesce("silent", F.lit(False)), F.col("silent").isNotNull()
    noisy = F.coalesce(F.col("low_snr"), F.lit(False)) & ~silent
    heavy = F.coalesce(F.col("very_low_snr"), F.lit(False)) & ~silent
    warnings = F.array_compact(F.array(F.when(silent, SILENT), F.when(noisy, LOW_SNR), F.when(heavy, NOISE), F.when(~known, UNKNOWN)))
    rows = rows.withColumns({"quality_warnings": warnings, SIDE: ~silent})
    if "emotion" in sessions.columns:
        rows = rows.withColumn("emotion", F.when(~noisy, F.col("emotion")))
    return rows.select(*sessions.columns, "quality_warnings", SIDE)


def split(gated: DataFrame, path: str) -> dict[str, int]:
    """Write both sides of a gate under ``path`` in one pass; how many rows went to each.

    The counts are observed while the rows are written, so nothing is read or computed twice.
    """
    counted = Observation()
    rows = gated.observe(counted, F.count_if(F.col(SIDE)).alias("accepted"), F.count_if(~F.col(SIDE)).alias("rejected"))
    rows.write.mode("overwrite").partitionBy(SIDE).parquet(path)
    return counted.get


def side(rows: DataFrame, accepted: bool) -> DataFrame:
    """One side of a written split; only its files are read."""
    return rows.where(F.col(SIDE).cast("string") == str(accepted).lower()).drop(SIDE)
