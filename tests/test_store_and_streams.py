import datetime as dt

from pyspark.sql import functions as F

from parley.operators import payloads
from parley.sources import store
from parley.sources.adapters import utterances_from_events
from parley.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


def test_upsert_keeps_one_row_a_key(spark, tmp_path):
    path = str(tmp_path / "records")
    schema = "session_id string, created_at int, updated_at int, payload string"
    store.upsert(spark.createDataFrame([("a", 1, 1, "x"), ("b", 1, 1, "y"), ("a", 2, 2, "z")], schema), path, parts=4)
    store.upsert(spark.createDataFrame([("b", 5, 5, "new"), ("c", 5, 5, "c")], schema), path, parts=4)
    rows = {r.session_id: (r.created_at, r.updated_at, r.payload) for r in spark.read.parquet(path).collect()}
    assert rows == {"a": (1, 2, "z"), "b": (1, 5, "new"), "c": (5, 5, "c")}
    table = spark.read.parquet(path)
    assert [r.session_id for r in store.newest_first(table, 2).collect()] == ["b", "c"]
    keys = spark.createDataFrame([("a",), ("q",)], "session_id string")
    assert [r.session_id for r in store.lookup(spark, path, keys).collect()] == ["a"]
    assert sorted(r.session_id for r in store.without(table, keys).collect()) == ["b", "c"]


def test_evidence_is_asked_for_once_a_minute(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    rows = [("s1", at + dt.timedelta(seconds=k)) for k in (0, 10, 20)] + [("s2", at)]
    source, sink = str(tmp_path / "claims"), str(tmp_path / "asked")
    claims = spark.createDataFrame(rows, "signature string, asked_at timestamp")
    claims.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(claims.schema).parquet(source)
    query = jobs.evidence_requests(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(sink)
    query.awaitTermination(120)
    assert sorted(r.signature for r in spark.read.parquet(sink).collect()) == ["s1", "s2"]


def test_insights_follow_arriving_sessions(spark, tmp_path):
    source, path = str(tmp_path / "turns"), str(tmp_path / "insights")
    turns = utterances_from_events(spark, FOLDER).where("session_id in ('1', '2', '3')")
    turns.write.parquet(source)
    stream = spark.readStream.schema(turns.schema).parquet(source)
    jobs.insights_as_sessions_arrive(stream, path, str(tmp_path / "state")).awaitTermination(300)
    found = spark.read.parquet(path)
    assert {r.session_id for r in found.collect()} == {r.session_id for r in turns.select("session_id").distinct().collect()}
    assert found.where(F.get_json_object("payload", "$.escalation").isNull()).count() == 0


def test_payload_types_and_order(spark):
    lines = [
        ("ok", '{"session_id": "s", "utterances": [{"id": "a", "start": 1, "end": 2.5, "speaker": "the  agent-x", "text": " hi\\n you ", "overlap": "yes"}]}'),
        ("list", "[1]"), ("broken", "{"), ("none", '{"session_id": 5}'), ("empty", '{"session_id": "s", "utterances": []}'),
        ("bad", '{"session_id": true, "duration_sec": -1, "speakers": {}, "utterances": [3, {"start": true, "end": 1}, {"start": 5, "end": 4}, {"start": "1", "end": 9, "confidence": 2}]}'),
    ]
    p = payloads.read_payloads(spark.createDataFrame(lines, "payload_id string, value string"))
    issues = payloads.payload_issues(p)
    found = {}
    for r in issues.collect():
        found.setdefault(r.payload_id, set()).add((r.code, r.field))
    assert found["ok"] == {("invalid_overlap", "utterances[0].overlap")}
    assert found["list"] == {("invalid_payload_type", "root")} == found["broken"]
    assert found["none"] == {("missing_required_field", "utterances")} and found["empty"] == {("empty_utterances", "utterances")}
    assert found["bad"] >= {
        ("invalid_session_id", "session_id"), ("invalid_duration", "duration_sec"), ("invalid_speakers", "speakers"), ("invalid_utterance_type", "utterances[0]"),
        ("invalid_start", "utterances[1].start"), ("end_before_start", "utterances[2].end"), ("invalid_start", "utterances[3].start"),
        ("invalid_confidence", "utterances[3].confidence"),
    }
    assert {r.payload_id: r.status for r in payloads.payload_status(p, issues).collect()}["ok"] == "warning"
    row = payloads.normalize(p.where("payload_id = 'ok'")).first()
    assert (row.speaker, row.text, row.start_ms, row.end_ms, row.overlap, row.word_count) == ("THE_AGENT_X", "hi you", 1000, 2500, True, 2)
