"""Streaming forms: at most one evidence request per claim within a minute, and insights of sessions as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.operators.recommend import export_rows
from parley.plans.bundle import Bundle, build_bundle
from parley.sources.scratch import discard, materialize
from parley.sources.store import upsert


def evidence_requests(claims: DataFrame, ttl: str = "60 seconds") -> DataFrame:
    """The first claim of each signature within ``ttl`` (columns ``signature`` and event time ``asked_at``).

    What arrives later than ``ttl`` after the newest claim seen is dropped with the state that it would need.
    """
    return claims.withWatermark("asked_at", ttl).dropDuplicatesWithinWatermark(["signature"])


def insight_records(b: Bundle) -> DataFrame:
    """One record per session: its scores and levels as JSON."""
    level = lambda df, name: df.select("session_id", F.col("level").alias(name))
    rows = b.scores.join(level(b.escalation, "escalation"), "session_id").join(level(b.inconsistency, "inconsistency"), "session_id")
    payload = F.to_json(F.struct(*[c for c in rows.columns if c != "session_id"]))
    now = F.current_timestamp()
    return rows.select("session_id", F.lit("ok").alias("status"), payload.alias("payload"), now.alias("created_at"), now.alias("updated_at"))


def insights_as_sessions_arrive(utterances: DataFrame, path: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Run the bundle over each batch of finished sessions and upsert the records at ``path``.

    A batch that runs again after a failure writes the same keys, so the table is the same.
    """

    def batch(rows: DataFrame, number: int) -> None:
        bundle = build_bundle(rows)
        records = materialize(insight_records(bundle), "insight-records")
        upsert(records, path)
        if then is not None:
            then(records)
        bundle.discard()
        discard(records)

    return utterances.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def export_recommendations(recommendations: DataFrame, path: str, min_confidence: float = 0.5) -> None:
    """Recommendations for the receiving side, as JSON lines."""
    export_rows(recommendations, min_confidence).write.mode("append").json(path)
