"""What larger tables showed: ties of sums, and what travels through shuffles."""

import datetime
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from parley.operators import context, inconsistency, keywords, metrics, payloads, quality, recommend, timeline
from parley.plans import queries, queries_context, queries_records
from parley.sources import store
from parley.sources.adapters import utterances_from_events
from parley.sources.scratch import materialize
from parley.thresholds import Thresholds

FOLDER = "/root/testdata/sf0.001"


def test_a_mean_of_exactly_a_half_is_not_low(spark, tmp_path):
    first = datetime.datetime(2024, 1, 1)
    rows = [(e, first + datetime.timedelta(hours=i), 1, "view", 1.0, json.dumps({"k": 1})) for i, e in enumerate([73, 97 + 60, 194 + 11])]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert (73 / 96 + 60 / 96 + 11 / 96) / 3 < 0.5  # the sum of doubles, in this order
    found = queries_records.QUERIES["warning_codes"](spark, str(tmp_path)).first()
    assert found.warnings == "SINGLE_SPEAKER_MODE,SHORT_SESSION,VERY_SHORT_SESSION"


@pytest.mark.parametrize("most", [0, 100])
def test_keywords_by_vector_ids_equal_those_with_vectors(spark, monkeypatch, most):
    monkeypatch.setattr(keywords, "BROADCAST", most)
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None), (4, [0.0, 0.0])], "vec_id long, vector array<double>")
    turns = spark.createDataFrame([("s", "u1", "red wine red", 1), ("s", "u2", "red wine", 3)], "session_id string, utt_id string, text string, vec_id long")
    rows = [("s", "u1", "Red Wine", 2), ("s", "u1", "red", 1), ("s", "u1", "blue blue", 4), ("s", "u2", "wine", 1), ("s", "u2", "red red", 3)]
    phrases = spark.createDataFrame(rows, "session_id string, utt_id string, phrase string, vec_id long")
    plain = keywords.phrase_keywords(turns.join(vectors, "vec_id"), phrases.join(vectors, "vec_id"))
    found = keywords.phrase_keywords(turns, phrases, vectors=vectors)
    assert found.count() == 5 and found.exceptAll(plain.select(*found.columns)).count() == 0


def test_keywords_shuffle_no_vectors(spark):
    found = queries_context.phrase_keywords(spark, FOLDER)
    found.collect()
    exchanges = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert not any("phrase" in line for line in exchanges), exchanges


def test_the_distance_of_texts_is_the_builtin_one(spark):
    rng = random.Random(3)
    words = lambda: "".join(rng.choice("ab\u00e9\U0001f600 c") for _ in range(rng.choice([0, 1, 7, 8, 40, 130])))
    pairs = [(a, b) for a, b in ((words(), words()) for _ in range(150))] + [(a, a[:9] + "zz" + a[20:]) for a in (words() for _ in range(50))]
    df = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "a string, b string")
    found = df.select("a", "b", quality.text_distance(F.col("a"), F.col("b")).alias("ours"), F.levenshtein("a", "b").alias("builtin"))
    assert found.where("not ours <=> cast(builtin as long)").count() == 0


def test_long_sessions_are_evaluated_in_time(spark):
    """900 million cells; the built-in function takes some 0.1 s for the 10 million of a session of 67 turns."""
    rng = random.Random(5)
    one = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    start = time.process_time()
    assert quality.edits(one, one[:500] + "xyz" + one[500:-100]) == 103
    assert time.process_time() - start < 4
    plan = quality.error_rates(*(spark.createDataFrame([("s", one)], f"session_id string, {c} string") for c in ("text", "said"))).select("cer")
    assert "levenshtein" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_payloads_are_parsed_once_and_keep_their_issues(spark):
    values = [
        "[1]", "7", "{", '{"utterances": null}', '{"session_id": 1, "utterances": []}', '{"session_id": 1.5, "utterances": {}, "speakers": 1, "duration_sec": -1}',
        '{"session_id": "s", "utterances": [null, 3, {"start": 2, "end": 1.5}, {"start": 1, "end": "x", "overlap": 0, "word_count": -1}]}',
        '{"session_id": "s", "utterances": [{"start": 0, "end": 1e0, "confidence": 2, "emotion": []}]}',
    ]
    lines = spark.createDataFrame([*enumerate(values), (8, None)], "payload_id int, value string")
    issues = payloads.payload_issues(payloads.read_payloads(lines))
    found = {}
    for r in issues.collect():
        found.setdefault(r.payload_id, set()).add((r.code, r.field))
    u = "utterances"
    assert found == {
        0: {("invalid_payload_type", "root")}, 1: {("invalid_payload_type", "root")}, 2: {("invalid_payload_type", "root")}, 8: {("invalid_payload_type", "root")},
        3: {("missing_required_field", "session_id"), ("invalid_utterances", u)}, 4: {("empty_utterances", u)},
        5: {("invalid_session_id", "session_id"), ("invalid_utterances", u), ("invalid_speakers", "speakers"), ("invalid_duration", "duration_sec")},
        6: {("invalid_utterance_type", f"{u}[0]"), ("invalid_utterance_type", f"{u}[1]"), ("end_before_start", f"{u}[2].end"), ("irregular_order", f"{u}[3].start"),
            ("invalid_end", f"{u}[3].end"), ("invalid_overlap", f"{u}[3].overlap"), ("invalid_word_count", f"{u}[3].word_count")},
        7: {("invalid_confidence", f"{u}[0].confidence"), ("invalid_emotion", f"{u}[0].emotion")},
    }
    plan = issues._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 2 and "Union" not in plan


def test_turns_in_sequence_are_placed_once(spark):
    plan = metrics.sequence(utterances_from_events(spark, FOLDER))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_new_records_are_placed_only_where_a_key_repeats(spark, tmp_path, monkeypatch):
    asked, newest = [], store.latest_by_key
    monkeypatch.setattr(store, "latest_by_key", lambda *args: asked.append(1) or newest(*args))
    schema = "session_id string, created_at long, updated_at long, text string"
    rows = [("a", 1, 1, "x"), ("b", 1, 1, "y")]
    store.upsert(spark.createDataFrame(rows, schema), str(tmp_path / "one"))
    assert not asked and spark.read.parquet(str(tmp_path / "one")).count() == 2
    store.upsert(spark.createDataFrame([*rows, ("a", 2, 5, "z")], schema), str(tmp_path / "two"))
    found = {(r.session_id, r.created_at, r.text) for r in spark.read.parquet(str(tmp_path / "two")).collect()}
    assert asked and found == {("a", 1, "z"), ("b", 1, "y")}


def test_detectors_take_a_text_once_for_all_phrases(spark):
    """The filter on phrases names the text's own expression once, however many phrases there are."""
    for name in ("task", "meeting", "email", "escalation"):
        found = queries.QUERIES[f"{name}_recommendations"](spark, FOLDER)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.splitlines() if "Filter" in line]
        assert filters and all(line.count("get_json_object") <= 1 and line.count("regexp_replace") <= 1 for line in filters), filters
    rows = [("s", "u1", "\t Please SEND the file \n"), ("s", "u2", "  "), ("s", "u3", None), ("s", "u4", "nothing here")]
    turns = spark.createDataFrame(rows, "session_id string, utt_id string, text string")
    assert [(r.segment_id, r.title) for r in recommend.task_recommendations(turns).collect()] == [("u1", "Please SEND the file")]


def test_a_transcript_has_each_turn_once_and_needs_no_join(spark):
    rows = [("s", "u1", 1, "a", 0, 900, "Hello", 1.0), ("s", "u1", 2, "a", 1000, 1900, "Hello", 1.0)]  # an id that repeats
    turns = spark.createDataFrame(rows, "session_id string, utt_id string, pos long, speaker string, start_ms long, end_ms long, text string, confidence double")
    found = context.session_context(turns)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [t.pos for t in found.first().transcript] == [1, 2]


def test_records_read_the_events_once(spark, monkeypatch):
    """What recommendations and claims read are the turns that the bundle wrote; moods and flags need no claims."""
    reads, checked = [], []
    monkeypatch.setattr(queries_context, "utterances_from_events", lambda *a: reads.append(1) or utterances_from_events(*a))
    monkeypatch.setattr(queries, "utterances_from_events", lambda *a: reads.append(1) or utterances_from_events(*a))
    monkeypatch.setattr(queries_context, "checked_claims", lambda *a: checked.append(1) or queries.checked_claims(*a))
    queries_context.flagged_recommendations(spark, FOLDER)
    assert (len(reads), len(checked)) == (1, 1)
    queries_context.QUERIES["negative_sessions"](spark, FOLDER)
    assert (len(reads), len(checked)) == (2, 1)


def test_markers_of_turns_are_placed_once_and_hits_made_once(spark):
    turns = materialize(metrics.sequence(utterances_from_events(spark, FOLDER)), "turns")
    plan = timeline.turn_markers(turns, Thresholds())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    hits = inconsistency.inconsistent_turns(inconsistency.read_turns(turns))._jdf.queryExecution().optimizedPlan().toString()
    assert hits.count("disagrees with lexical tone") == 1, hits
