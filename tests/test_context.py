"""The nested record that recommendations read."""

from pyspark.sql import functions as F

from parley.operators import context, keywords, recommend


def turns(spark):
    rows = [("s", "u2", 2, "b", 61_000, 3_661_500, "I want a refund, this is unacceptable", 0.5), ("s", "u1", 1, "a", 0, 900, "Hello", None), ("t", "u1", 1, "a", 5, 9, "Hi", 0.9)]
    return spark.createDataFrame(rows, "session_id string, utt_id string, pos long, speaker string, start_ms long, end_ms long, text string, confidence double")


def test_sections_have_defaults(spark):
    found = {r.session_id: r for r in context.session_context(turns(spark)).collect()}
    s = found["s"]
    assert [(t.segment_id, t.start_time, t.end_time) for t in s.transcript] == [("u1", "00:00:00", "00:00:00"), ("u2", "00:01:01", "01:01:01")]
    assert (s.language, s.insights.summary, s.insights.sentiment, s.insights.escalation_flags, s.claims) == ("en", None, None, [], [])
    assert context.session_context(turns(spark).limit(0)).count() == 0
    assert context.negative_sessions(context.session_context(turns(spark))).count() == 0


def test_insights_and_claims_are_side_by_side_and_raise_escalations(spark):
    sentiment = spark.createDataFrame([("s", "neutral"), ("t", "Negative")], "session_id string, label string")
    flags = spark.createDataFrame([("s", "late", 2), ("s", "early", 1)], "session_id string, type string, place long")
    claims = spark.createDataFrame(
        [("s", "u2", "claim_1", "x is 1", "UNSUPPORTED_CLAIM_TYPE", 0.0), ("s", "u1", "claim_2", "y is 2", "FALSE", 0.9), ("s", "u1", "claim_1", "z is 3", "TRUE", 1.0)],
        "session_id string, utt_id string, claim_id string, claim_text string, verdict string, confidence double",
    )
    summaries = spark.createDataFrame([("s", "short")], "session_id string, summary string")
    known = context.session_context(turns(spark), sentiment, flags, summaries, claims)
    s = known.where("session_id = 's'").first()
    assert s.insights.asDict() == {"summary": "short", "sentiment": "neutral", "escalation_flags": ["early", "late"]}
    assert [(c.utt_id, c.claim_id, c.status) for c in s.claims] == [("u1", "claim_1", "TRUE"), ("u1", "claim_2", "FALSE"), ("u2", "claim_1", "UNVERIFIED")]
    assert {r.session_id for r in context.negative_sessions(known).collect()} == {"s", "t"}
    found = recommend.run_recommendations(turns(spark), context.reviewed_claims(known), negative=context.negative_sessions(known))
    reviews = {r.claim_id for r in found.where("action_type = 'FACT_CHECK'").collect()}
    assert reviews == {"u1/claim_2", "u2/claim_1"}
    calm = recommend.run_recommendations(turns(spark)).where("action_type = 'SUPPORT'").first().confidence
    raised = found.where(F.col("action_type") == "SUPPORT").first().confidence
    assert abs(raised - calm - 0.1) < 1e-9


def test_keywords_add_weights_and_similarity(spark):
    turns = spark.createDataFrame(
        [("s", "u1", "red wine red", [1.0, 0.0]), ("s", "u2", "red wine", None), ("s", "u3", "a", [1.0, 1.0])], "session_id string, utt_id string, text string, vector array<double>"
    )
    phrases = [("s", "u1", "Red Wine", [0.0, 1.0]), ("s", "u1", "red", [1.0, 0.0]), ("s", "u1", "red", [1.0, 0.0]), ("s", "u1", "blue", [0.0, 0.0]), ("s", "u2", "wine", [1.0, 0.0]), ("s", "u2", "red", None)]
    df = spark.createDataFrame(phrases, "session_id string, utt_id string, phrase string, vector array<double>")
    found = {(r.utt_id, r.phrase): (r.weight, r.similarity, r.score, r.place) for r in keywords.phrase_keywords(turns, df).collect()}
    one, two, half = 0.447214, 0.894427, 0.707107
    assert found == {
        ("u1", "red"): (two, 1.0, 1.894427, 1), ("u1", "red wine"): (1.341641, 0.0, 1.341641, 2), ("u1", "blue"): (0.0, 0.0, 0.0, 3),
        ("u2", "red"): (half, 0.0, half, 1), ("u2", "wine"): (half, 0.0, half, 2),
    }
    assert abs(one + two - 1.341641) < 1e-9 and keywords.phrase_keywords(turns, df, 1).count() == 2
