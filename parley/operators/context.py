"""What recommendations know about a session: transcript, insights and checked claims in one nested record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.recommend import STATUS, agent_context


def claim_status(verdict: Column) -> Column:
    """A verdict by the name that reviews use for it."""
    names = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return F.coalesce(F.element_at(names, verdict), verdict)


def session_context(
    turns: DataFrame, sentiment: DataFrame | None = None, flags: DataFrame | None = None, summaries: DataFrame | None = None,
    claims: DataFrame | None = None, language: str = "en",
) -> DataFrame:
    """One row per session of ``turns``: ``language``, ``transcript``, ``insights`` and ``claims``.

    ``sentiment`` has ``label``, ``flags`` ``type`` and ``place``, ``summaries`` ``summary``, ``claims`` ``utt_id``,
    ``claim_id``, ``claim_text``, ``verdict`` and ``confidence``, each by session. Every section has a default: null texts,
    and empty lists of flags and claims. The transcript is in the order of the input, flags in theirs, claims by utterance.
    """
    segment = F.struct("pos", "segment_id", "speaker", "start_time", "end_time", "text", "confidence")
    rows = agent_context(turns, "pos").groupBy("session_id").agg(F.array_sort(F.collect_list(segment)).alias("transcript"))
    parts = {
        "sentiment": None if sentiment is None else sentiment.select("session_id", F.col("label").alias("sentiment")),
        "summary": None if summaries is None else summaries.select("session_id", "summary"),
    }
    for name, part in parts.items():
        rows = rows.withColumn(name, F.lit(None).cast("string")) if part is None else rows.join(part, "session_id", "left")
    lists = {"escalation_flags": "array<string>", "checked": "array<struct<utt_id:string,claim_id:string,claim_text:string,status:string,confidence:double>>"}
    if flags is not None:
        marks = F.array_sort(F.collect_list(F.struct("place", "type")))
        rows = rows.join(flags.groupBy("session_id").agg(F.transform(marks, lambda f: f["type"]).alias("escalation_flags")), "session_id", "left")
    if claims is not None:
        claim = F.struct("utt_id", "claim_id", "claim_text", claim_status(F.col("verdict")).alias("status"), F.col("confidence").cast("double").alias("confidence"))
        rows = rows.join(claims.groupBy("session_id").agg(F.array_sort(F.collect_list(claim)).alias("checked")), "session_id", "left")
    rows = rows.withColumns({name: F.coalesce(name if name in rows.columns else F.lit(None).cast(kind), F.array().cast(kind)) for name, kind in lists.items()})
    return rows.select(
        "session_id", F.lit(language).alias("language"), "transcript", F.struct("summary", "sentiment", "escalation_flags").alias("insights"),
        F.col("checked").alias("claims"),
    )


def negative_sessions(context: DataFrame) -> DataFrame:
    """Sessions that are negative or flagged as a whole, which makes escalations more likely (``run_recommendations``)."""
    insights = F.col("insights")
    return context.where((F.lower(insights["sentiment"]) == "negative") | (F.size(insights["escalation_flags"]) > 0)).select("session_id")


def reviewed_claims(context: DataFrame) -> DataFrame:
    """The checked claims of the records as rows, for ``recommend.review_recommendations``."""
    rows = context.select("session_id", F.explode("claims").alias("c")).select("session_id", "c.*")
    return rows.withColumnRenamed("status", "verdict")
