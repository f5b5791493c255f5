"""Registered queries over typed session documents and stored insights, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import gates, quality
from parley.operators.evidence import evidence_from_responses
from parley.plans.bundle import build_bundle
from parley.plans.oracles import ORACLES as TABLES
from parley.plans.oracles_summary import ORACLES as TEXTS
from parley.plans.oracles_summary import SPEAKER_FLAG
from parley.plans.oracles_text import ORACLES as LANGUAGE
from parley.plans.queries import Query, signals_table
from parley.plans.queries_calls import ORACLES as CALLS
from parley.plans.queries_calls import FLAWS, payloads_from_utterances
from parley.sources import insights, sessions
from parley.sources.adapters import UTTERANCES_SQL, read_table, utterances_from_events
from parley.sources.scratch import shared_folder
from parley.thresholds import TenantThresholds

#: Folders of stored insights by application and source, so that several views of one session read one table.
_stored: dict[tuple[str, str], str] = {}


def stored_insights(spark: SparkSession, folder: str) -> DataFrame:
    """The stored bundle of the given utterances, written when it is first asked for."""
    own = (spark.sparkContext.applicationId, folder)
    if own not in _stored:
        path = f"{shared_folder(spark)}/insights-{uuid.uuid4().hex}"
        bundle = build_bundle(utterances_from_events(spark, folder))
        insights.store_insights(bundle, path, F.lit(0).cast("long"), parts=8)
        bundle.discard()
        _stored[own] = path
    return spark.read.parquet(_stored[own])


def _view(view: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: view(stored_insights(spark, folder))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """Session documents as JSON lines on disk: of ten sessions, one line is cut short and one has a negative duration."""
    documents = sessions.sessions_from(utterances_from_events(spark, folder))
    turn = F.col("session_id").cast("long") % 10
    documents = documents.withColumn("duration_sec", F.when(turn == 5, F.lit(-1.0)).otherwise(F.col("duration_sec")))
    line = F.to_json(F.struct(*documents.columns))
    line = F.when(turn == 3, F.substring(line, F.lit(1), F.length(line) - 2)).otherwise(line)
    path = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    documents.select(line.alias("value")).write.text(path)
    return sessions.read_sessions(spark, path)


def typed_utterances(spark: SparkSession, folder: str) -> DataFrame:
    rows = sessions.utterances_of(_documents(spark, folder))
    return rows.withColumn("emotions", F.coalesce(F.cardinality("emotion"), F.lit(0)).cast("long")).drop("emotion", "word_count", "diarization_confidence")


def service_responses(spark: SparkSession, folder: str) -> DataFrame:
    """A stored response for each event: five services in turn, with notes of limits and missing fields, and broken text."""
    v, turn = "cast(floor(value) as bigint)", "event_id % 6"
    bodies = f"""CASE {turn} WHEN 0 THEN format_string('{{"rates": {{"EUR": %d}}}}', {v}) WHEN 1 THEN format_string('{{"bitcoin": {{"usd": %d}}}}', {v})
        WHEN 2 THEN format_string('{{%s"Global Quote": {{"05. price": "%d.5"}}}}', CASE WHEN event_id % 4 = 0 THEN '"Note": "limit", ' ELSE '' END, {v})
        WHEN 3 THEN format_string('{{"%s": {{"temp": %d}}}}', CASE WHEN event_id % 9 = 0 THEN 'other' ELSE 'main' END, {v})
        WHEN 4 THEN CASE WHEN event_id % 10 = 0 THEN '{{"extract": "A country."}}' ELSE '{{"extract": "Its capital and largest city is Paris."}}' END
        ELSE '{{"rates"' END"""
    kinds = f"element_at(array('CURRENCY_RATE', 'CRYPTO_PRICE', 'STOCK_PRICE', 'WEATHER', 'STATIC_FACT', 'WEATHER'), cast({turn} as int) + 1)"
    subjects = f"element_at(array('USD/EUR', 'BTC', 'AAPL', 'Paris|C', 'France', 'Paris|C'), cast({turn} as int) + 1)"
    return read_table(spark, folder, "events").selectExpr(f"{kinds} claim_type", f"{subjects} subject", "event_id fetched_ms", f"{bodies} body")


def _split(spark: SparkSession, gated: DataFrame) -> DataFrame:
    path = f"{shared_folder(spark)}/split-{uuid.uuid4().hex}"
    gates.split(gated, path)
    return spark.read.parquet(path)


def _payload_side(accepted: bool) -> Query:
    """One side of the gate of payloads of eight turns or fewer."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        calls = utterances_from_events(spark, folder)
        calls = calls.withColumn("session_id", (F.col("session_id").cast("long") * 1000 + F.floor(F.col("pos") / 8)).cast("string"))
        written = _split(spark, gates.gate_payloads(payloads_from_utterances(calls)))
        return gates.side(written, accepted).select(
            "payload_id", F.array_join(F.array_sort(F.array_distinct("issues.code")), ",").alias("codes"), F.size("issues").cast("long").alias("n_issues")
        )

    return run


def gated_audio(spark: SparkSession, folder: str) -> DataFrame:
    """Both sides of the gate of recordings, from the written split."""
    recordings = signals_table(spark, folder)
    gated = gates.gate_audio(recordings.select(F.col("id").alias("session_id")), quality.audio_quality(recordings, 1600, 16))
    return _split(spark, gated).withColumns({"quality_warnings": F.array_join("quality_warnings", ","), gates.SIDE: F.col(gates.SIDE).cast("boolean")})


def tenant_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Flags of speakers, where sessions of one of two tenants have thresholds of their own."""
    turns = utterances_from_events(spark, folder)
    sessions_of = turns.select("session_id", F.when(F.col("session_id").cast("long") % 2 == 1, "strict").otherwise("usual").alias("tenant")).distinct()
    table = spark.createDataFrame([("strict", 1, 10), ("idle", 9, 9)], "tenant string, frequent_interruptions int, low_inquiry_utterances int")
    return build_bundle(turns, TenantThresholds(sessions_of, table)).speaker_flags.drop("place")


QUERIES: dict[str, Query] = {
    "tenant_flags": tenant_flags,
    "accepted_payloads": _payload_side(True),
    "rejected_payloads": _payload_side(False),
    "gated_audio": gated_audio,
    "service_evidence": lambda spark, folder: evidence_from_responses(service_responses(spark, folder)),
    "typed_utterances": typed_utterances,
    "session_faults": lambda spark, folder: sessions.fault_counts(_documents(spark, folder)),
    "stored_summaries": _view(lambda s: insights.summary_view(s).withColumns({c: F.array_join(c, " | ") for c in ("notable_concerns", "key_moments")})),
    "stored_speakers": _view(lambda s: insights.speakers_view(s).withColumn("flags", F.array_join("flags.type", ","))),
    "stored_timeline": _view(lambda s: insights.timeline_view(s).drop("evidence")),
}
def _side_sql(having: str) -> str:
    return f"""WITH {UTTERANCES_SQL}, v AS (SELECT * REPLACE (CAST(CAST(session_id AS BIGINT) * 1000 + pos // 8 AS VARCHAR) AS session_id) FROM u),
        i AS ({FLAWS.replace("FROM u", "FROM v")}), s AS (SELECT DISTINCT session_id payload_id FROM v)
        SELECT payload_id, coalesce(string_agg(DISTINCT code, ',' ORDER BY code), '') codes, count(code) n_issues FROM s LEFT JOIN i USING (payload_id)
        GROUP BY 1 HAVING {having}"""


ORACLES: dict[str, str] = {
    "tenant_flags": f"""WITH r AS (SELECT *, CAST(session_id AS BIGINT) % 2 = 1 strict FROM ({TABLES["speaker_metrics"]}) LEFT JOIN ({TABLES["speaker_emotion"]}) USING (session_id, speaker))
        SELECT session_id, speaker, 'frequent_interruptions' "type", 'medium' severity, speaker || ' shows repeated interruption behavior.' reason
          FROM r WHERE interruption_count >= CASE WHEN strict THEN 1 ELSE 2 END
        UNION ALL SELECT session_id, speaker, 'high_overlap_participation', 'medium', speaker || ' is frequently involved in overlapping turns.' FROM r WHERE overlap_count >= 2
        UNION ALL SELECT session_id, speaker, 'low_inquiry_behavior', 'low', speaker || ' asks very few or no questions.'
          FROM r WHERE question_count = 0 AND utterance_count >= CASE WHEN strict THEN 10 ELSE 4 END
        UNION ALL SELECT session_id, speaker, 'speaker_emotional_strain', 'low', speaker || ' shows repeated ' || dominant_emotion || ' emotional signals.'
          FROM r WHERE dominant_emotion IN ('angry', 'frustrated', 'anxious', 'upset') AND sample_count >= 2""",
    "accepted_payloads": _side_sql("count(*) FILTER (severity = 'error') = 0"),
    "rejected_payloads": _side_sql("count(*) FILTER (severity = 'error') > 0"),
    "gated_audio": f"""SELECT id session_id, array_to_string(list_filter(CASE WHEN is_silent OR is_near_silent THEN ['AUDIO_SILENT_OR_NEAR_SILENT'] ELSE
        [CASE WHEN low_snr THEN 'LOW_SNR_AUDIO' END, CASE WHEN very_low_snr THEN 'HEAVY_NOISE_AUDIO' END] END, lambda x: x IS NOT NULL), ',') quality_warnings,
        NOT (is_silent OR is_near_silent) accepted FROM ({LANGUAGE["audio_quality"]})""",
    "service_evidence": """SELECT ['CURRENCY_RATE', 'CRYPTO_PRICE', 'STOCK_PRICE', 'WEATHER', 'STATIC_FACT'][turn] claim_type,
        ['USD/EUR', 'BTC', 'AAPL', 'Paris|C', 'France'][turn] subject, event_id fetched_ms, CASE WHEN turn = 3 THEN floor(value) + 0.5 WHEN turn < 5 THEN floor(value) END value,
        CASE WHEN turn = 5 THEN 'Paris' END value_text, ['EUR', 'USD', 'USD', 'C', NULL][turn] unit, ['forex', 'crypto', 'stock', 'weather', 'facts'][turn] source
        FROM (SELECT *, event_id % 6 + 1 turn FROM events) WHERE turn < 6 AND NOT (turn = 3 AND event_id % 4 = 0) AND NOT (turn = 4 AND event_id % 9 = 0)
        AND NOT (turn = 5 AND event_id % 10 = 0)""",
    "typed_utterances": f"""WITH {UTTERANCES_SQL} SELECT session_id, utt_id, row_number() OVER (PARTITION BY session_id ORDER BY start_ms, end_ms, utt_id) pos,
        upper(speaker) speaker, start_ms, end_ms, text, sent_label, score_e4, overlap, confidence, CASE WHEN e1 IS NULL THEN 0 ELSE 2 END::BIGINT emotions
        FROM u WHERE CAST(session_id AS BIGINT) % 10 NOT IN (3, 5)""",
    "session_faults": """SELECT CASE user_id % 10 WHEN 3 THEN 'malformed' WHEN 5 THEN 'negative_duration' END fault, count(DISTINCT user_id) sessions
        FROM events GROUP BY 1""",
    "stored_summaries": f"""SELECT o.session_id, o.summary overall_summary, coalesce(c.t, '') notable_concerns, coalesce(m.t, '') key_moments
        FROM ({TEXTS["overall_summary"]}) o
        LEFT JOIN (SELECT session_id, string_agg(concern, ' | ' ORDER BY number) t FROM ({CALLS["notable_concerns"]}) GROUP BY 1) c USING (session_id)
        LEFT JOIN (SELECT session_id, string_agg(moment, ' | ' ORDER BY number) t FROM ({CALLS["key_moments"]}) GROUP BY 1) m USING (session_id)""",
    "stored_speakers": f"""SELECT sp.*, st.label sentiment, e.dominant_emotion emotion, coalesce(f.t, '') flags, x.summary FROM ({TABLES["speaker_metrics"]}) sp
        LEFT JOIN ({TABLES["speaker_sentiment"]}) st USING (session_id, speaker) LEFT JOIN ({TABLES["speaker_emotion"]}) e USING (session_id, speaker)
        LEFT JOIN (SELECT session_id, speaker, string_agg("type", ',' ORDER BY {SPEAKER_FLAG}) t FROM ({TABLES["speaker_flags"]}) GROUP BY ALL) f USING (session_id, speaker)
        LEFT JOIN ({TEXTS["speaker_summaries"]}) x USING (session_id, speaker)""",
    "stored_timeline": TABLES["timeline"],
}
