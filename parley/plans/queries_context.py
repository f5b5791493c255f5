"""Registered queries over the nested record that recommendations read, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import context, keywords, recommend
from parley.plans.bundle import Bundle, build_bundle
from parley.plans.oracles import ORACLES as TABLES
from parley.plans.oracles_summary import ORACLES as TEXTS
from parley.plans.oracles_text import ORACLES as LANGUAGE
from parley.plans.queries import Query, checked_claims
from parley.sources.adapters import read_table, utterances_from_events
from parley.sources.scratch import materialize


def contexts(spark: SparkSession, bundle: Bundle) -> DataFrame:
    """The records of a bundle's sessions; its turns are those that the bundle wrote, so nothing is read or placed again."""
    turns = bundle.turns
    found = context.session_context(turns, bundle.session_sentiment, bundle.session_flags, bundle.overall, checked_claims(spark, turns))
    return materialize(found, "contexts")


def session_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """The records in flat columns."""
    claims = F.transform("claims", lambda c: F.concat_ws(" ", c["utt_id"], c["claim_id"], c["status"]))
    return contexts(spark, build_bundle(utterances_from_events(spark, folder))).select(
        "session_id", F.size("transcript").cast("long").alias("segments"), F.array_join(F.transform("transcript", lambda t: t["start_time"]), ",").alias("starts"),
        "insights.summary", "insights.sentiment", F.array_join("insights.escalation_flags", ",").alias("flags"), F.array_join(claims, ",").alias("claims"),
    )


def flagged_recommendations(spark: SparkSession, folder: str) -> DataFrame:
    """Recommendations from the records: checked claims are reviewed, flags and mood raise escalations."""
    bundle = build_bundle(utterances_from_events(spark, folder))
    known = contexts(spark, bundle)
    return recommend.run_recommendations(bundle.turns, context.reviewed_claims(known), negative=context.negative_sessions(known))


def negative_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Moods and flags decide; transcripts, summaries and claims are not made for it."""
    bundle = build_bundle(utterances_from_events(spark, folder))
    return context.negative_sessions(context.session_context(bundle.turns, bundle.session_sentiment, bundle.session_flags))


def phrase_keywords(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of neighbouring terms of every turn; turns and pairs have vectors of the embeddings table."""
    vectors = read_table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    n = vectors.count()
    event = F.substring("utt_id", 2, 20).cast("long")
    places = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # placed by turn once, so that its terms, phrases and places need no exchange of their own
    placed = utterances_from_events(spark, folder).select("session_id", "utt_id", "text").repartition(places, "session_id", "utt_id")
    turns = placed.withColumn("vec_id", event % n)
    terms = F.regexp_extract_all(F.lower("text"), F.lit(r"\b\w\w+\b"), 0)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("terms") - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get("terms", i - 1), F.get("terms", i)))
    found = turns.withColumn("terms", terms).where(F.size("terms") > 1).select("session_id", "utt_id", F.explode(F.array_distinct(pairs)).alias("phrase"))
    found = found.withColumn("vec_id", (F.length("phrase") * 31 + event) % n)
    return keywords.phrase_keywords(turns, found, 3, vectors)


QUERIES: dict[str, Query] = {
    "phrase_keywords": phrase_keywords,
    "session_contexts": session_contexts,
    "negative_sessions": negative_sessions,
    "flagged_recommendations": flagged_recommendations,
}
_FIXED = "list_position(['negative_session_mood', 'declining_session_tone', 'conversation_escalation', 'conversation_inconsistency'], \"type\")"
_ORDER = f"CASE WHEN speaker IS NULL THEN 1000000 + {_FIXED} ELSE first_seq * 10 + list_position(['speaker_dominance', 'high_tension'], \"type\") END"
ORACLES: dict[str, str] = {
    "phrase_keywords": f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] x FROM embeddings), k AS (SELECT count(*) n FROM v),
        tw AS ({LANGUAGE["term_weights"]}), t AS (SELECT session_id, utt_id, CAST(utt_id[2:] AS BIGINT) e, regexp_extract_all(lower(text), '\\b\\w\\w+\\b') w FROM ({TABLES["utterances"]})),
        p AS (SELECT DISTINCT session_id, utt_id, e, w[i] || ' ' || w[i + 1] phrase, [w[i], w[i + 1]] ws FROM (SELECT *, unnest(range(1, len(w))) i FROM t)),
        g AS (SELECT session_id, utt_id, phrase, sum(weight::DECIMAL(20, 6))::DOUBLE weight FROM (SELECT *, unnest(ws) term FROM p) JOIN tw USING (session_id, utt_id, term) GROUP BY ALL),
        s AS (SELECT p.session_id, p.utt_id, phrase, weight, round(list_cosine_similarity(a.x, b.x), 6) similarity FROM p JOIN g USING (session_id, utt_id, phrase), k
          JOIN v a ON a.vec_id = p.e % k.n JOIN v b ON b.vec_id = (length(phrase) * 31 + p.e) % k.n)
        SELECT *, round(weight + similarity, 6) score, row_number() OVER (PARTITION BY session_id, utt_id ORDER BY round(weight + similarity, 6) DESC, phrase) place FROM s QUALIFY place <= 3""",
    "session_contexts": f"""SELECT a.session_id, segments, starts, o.summary, s.label sentiment, coalesce(f.t, '') flags, coalesce(c.t, '') claims FROM
        (SELECT session_id, count(*) segments, string_agg(start_time, ',' ORDER BY start_time, end_time) starts FROM ({LANGUAGE["agent_context"]}) GROUP BY 1) a
        LEFT JOIN ({TEXTS["overall_summary"]}) o USING (session_id) LEFT JOIN ({TABLES["session_sentiment"]}) s USING (session_id)
        LEFT JOIN (SELECT session_id, string_agg("type", ',' ORDER BY {_ORDER}) t FROM ({TABLES["session_flags"]}) x
          LEFT JOIN (SELECT session_id, speaker, min(seq) first_seq FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY start_ms, end_ms, utt_id) seq
            FROM ({TABLES["utterances"]})) GROUP BY ALL) y USING (session_id, speaker) GROUP BY 1) f USING (session_id)
        LEFT JOIN (SELECT session_id, string_agg(utt_id || ' ' || claim_id || ' ' || CASE verdict WHEN 'UNSUPPORTED_CLAIM_TYPE' THEN 'UNVERIFIED' ELSE verdict END, ','
          ORDER BY utt_id, claim_id) t FROM ({LANGUAGE["claim_verdicts"]}) GROUP BY 1) c USING (session_id)""",
    "negative_sessions": f"""SELECT session_id FROM ({TABLES["session_sentiment"]}) WHERE label = 'negative' UNION SELECT session_id FROM ({TABLES["session_flags"]})""",
}
