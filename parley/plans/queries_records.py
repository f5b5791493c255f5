"""Registered queries over artefacts, stored results and final records, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import language, metrics, records
from parley.plans.oracles import sql
from parley.plans.oracles_text import ORACLES as TEXT_ORACLES
from parley.plans.queries import Query, claim_results, of_sequence
from parley.sources import store
from parley.sources.adapters import ASR_SQL, UTTERANCES_SQL, asr_from_utterances, utterances_from_events


def artefacts(spark: SparkSession, folder: str) -> DataFrame:
    """Recognised segments of each session as JSON, in one of three containers, some without an end."""
    segment = F.to_json(
        F.struct("avg_logprob", F.when(F.col("pos") % 11 != 3, F.col("end_ms") / 1000).alias("end"), (F.col("start_ms") / 1000).alias("start"), "text")
    )
    rows = asr_from_utterances(utterances_from_events(spark, folder))
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", segment.alias("j")))), lambda x: x["j"])
    rows = rows.groupBy("session_id").agg(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("list"))
    kind, listed = F.col("session_id").cast("long") % 3, F.col("list")
    wrap = lambda before, after: F.concat(F.lit(before), listed, F.lit(after))
    value = F.when(kind == 0, listed).when(kind == 1, wrap('{"segments":', "}")).otherwise(wrap('{"meta":{"segments":', "}}"))
    return rows.select("session_id", value.alias("value"))


def metas(spark: SparkSession, folder: str) -> DataFrame:
    """A payload head per session: languages with blanks, a warning list with nulls."""
    n = F.col("session_id").cast("long")
    language_ = F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, F.lit("  ")).otherwise(F.lit(" en "))
    head = F.struct(F.struct(F.concat(F.lit(" call-"), n).alias("source"), language_.alias("language")).alias("meta"), F.array(F.lit("A"), F.when(n % 2 == 0, F.lit("B"))).alias("warnings"))
    rows = utterances_from_events(spark, folder).select("session_id").distinct()
    return rows.select(F.col("session_id").alias("payload_id"), F.to_json(head, {"ignoreNullFields": "false"}).alias("value"))


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    return records.flat_results(claim_results(spark, folder), F.col("claim_ms"))


def _warnings(spark: SparkSession, folder: str) -> DataFrame:
    turns = utterances_from_events(spark, folder)
    # whole billionths, so that a mean of exactly a half does not depend on the order of rows
    mean = F.round(F.avg(F.col("confidence").cast("decimal(20,9)")), 6)
    facts = turns.groupBy("session_id").agg(F.count_distinct("speaker").alias("speakers"), F.count("*").alias("n"), mean.alias("confidence"))
    codes = {"SINGLE_SPEAKER_MODE": "speakers = 1", "SHORT_SESSION": "n < 60", "LOW_CONFIDENCE": "confidence < 0.5", "VERY_SHORT_SESSION": "n < 50"}
    rows = records.warning_codes(facts, codes, ("VERY_SHORT_SESSION",))
    return rows.select("session_id", F.array_join("warnings", ",").alias("warnings"), "status")


def _final(spark: SparkSession, folder: str) -> DataFrame:
    turns = utterances_from_events(spark, folder)
    with_intent = turns.withColumn("intent", language.intent_of(F.col("text"))).where("cast(session_id as long) % 2 = 0")
    plain = turns.withColumn("intent", F.lit(None).cast("string"))
    chosen = records.newest_enrichment(with_intent, plain)
    heads = records.session_heads(turns).select("session_id", F.col("speakers"))
    rows = records.final_records(turns.select("session_id").distinct(), chosen, speakers=heads)
    listed = lambda c: F.array_join(F.transform("timeline", lambda t: t[c]), ",")
    return rows.select("session_id", F.size("timeline").cast("long").alias("n"), listed("intent").alias("intents"), listed("speaker").alias("turns"), F.array_join("speakers", ",").alias("speakers"))


def _seconds(c: str) -> Column:
    return F.round(c, 3).alias(c)


UNITS = {"total_duration_sec": "seconds", "total_utterances": "count", "avg_pause_sec": "seconds"}

QUERIES: dict[str, Query] = {
    "artefact_segments": lambda spark, folder: records.read_segments(artefacts(spark, folder)).select(
        "session_id", F.col("pos").cast("long").alias("pos"), _seconds("start_sec"), _seconds("end_sec"), "text", "avg_logprob", "no_speech_prob"
    ),
    "payload_meta": lambda spark, folder: records.payload_meta(metas(spark, folder)).select(
        "payload_id", "source", "language", F.array_join("warnings", ",").alias("warnings")
    ),
    "session_heads": lambda spark, folder: records.session_heads(utterances_from_events(spark, folder)).withColumn("speakers", F.array_join("speakers", ",")),
    "measured_stats": of_sequence(lambda s: records.measured(metrics.session_metrics(s), ["session_id"], UNITS)),
    "warning_codes": _warnings,
    "final_records": _final,
    "stored_results": lambda spark, folder: _stored(spark, folder).drop("id", "evidence"),
    "newest_results": lambda spark, folder: records.results_of(
        _stored(spark, folder).withColumn("id", F.col("utt_id")), _stored(spark, folder).where("cast(session_id as long) % 2 = 1").select("session_id")
    ).select("session_id", "utt_id", "number", "verdict", F.col("evidence.source").alias("source")),
    "result_counts": lambda spark, folder: store.counts(_stored(spark, folder)),
}

_VERDICTS = TEXT_ORACLES["claim_verdicts"]
ORACLES: dict[str, str] = {
    "artefact_segments": f"WITH {UTTERANCES_SQL}, {ASR_SQL} SELECT session_id, pos, start_ms / 1000 start_sec, end_ms / 1000 end_sec, text, avg_logprob, 0.0::DOUBLE no_speech_prob "
    "FROM asr WHERE pos % 11 <> 3",
    "payload_meta": f"WITH {UTTERANCES_SQL} SELECT session_id payload_id, 'call-' || session_id source, CASE WHEN session_id::BIGINT % 5 < 2 THEN 'unknown' ELSE 'en' END AS language, "
    "CASE WHEN session_id::BIGINT % 2 = 0 THEN 'A,B' ELSE 'A' END warnings FROM (SELECT DISTINCT session_id FROM u)",
    "session_heads": f"WITH {UTTERANCES_SQL} SELECT session_id, string_agg(DISTINCT speaker, ',' ORDER BY speaker) speakers, max(end_ms) duration_ms FROM u GROUP BY 1",
    "measured_stats": sql(
        " UNION ALL ".join(f"SELECT session_id, '{n}' AS name, {n}::DOUBLE AS value, '{u}' AS unit FROM sm" for n, u in UNITS.items()), "sm"
    ),
    "warning_codes": f"""WITH {UTTERANCES_SQL} SELECT session_id, concat_ws(',', CASE WHEN s = 1 THEN 'SINGLE_SPEAKER_MODE' END, CASE WHEN n < 60 THEN 'SHORT_SESSION' END,
      CASE WHEN c < 0.5 THEN 'LOW_CONFIDENCE' END, CASE WHEN n < 50 THEN 'VERY_SHORT_SESSION' END) warnings,
      CASE WHEN n < 50 THEN 'error' WHEN s = 1 OR n < 60 OR c < 0.5 THEN 'warning' ELSE 'ok' END status
      FROM (SELECT session_id, count(DISTINCT speaker) s, count(*) n, round(avg(confidence::DECIMAL(20, 9)), 6) c FROM u GROUP BY 1)""",
    "stored_results": f"SELECT session_id, utt_id, claim_id, claim_type, subject, signature, \"value\" claimed_value, value_text claimed_text, actual actual_value, actual_text, verdict, "
    f"diff_pct, confidence, confidence_label, source, claim_ms created_at, claim_ms updated_at FROM ({_VERDICTS})",
    "newest_results": f"SELECT session_id, utt_id, row_number() OVER (PARTITION BY session_id ORDER BY claim_ms DESC, utt_id DESC) number, verdict, source FROM ({_VERDICTS}) "
    "WHERE session_id::BIGINT % 2 = 1",
    "result_counts": f"SELECT count(*) n_rows, count(DISTINCT session_id) n_keys FROM ({_VERDICTS})",
}
