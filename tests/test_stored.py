"""Typed session documents and stored insights."""

import json
import re

import pytest
from pyspark.sql import functions as F

from parley.plans.bundle import build_bundle
from parley.sources import insights, sessions
from parley.sources.adapters import utterances_from_events

FOLDER = "/root/testdata/sf0.001"


def utterance(**changes):
    return {"id": "u1", "speaker": "agent a", "start": 0.5, "end": 2.25, "text": " hi  there ", "sentiment": {"label": "positive", "score": 0.81234},
            "emotion": {"values": {"calm": 0.4, "happy": 0.6}}} | changes


def read(spark, tmp_path, *documents):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.json").write_text("\n".join(d if isinstance(d, str) else json.dumps(d) for d in documents))
    return sessions.read_sessions(spark, str(path))


def test_json_and_parquet_give_the_utterances_they_were_made_of(spark, tmp_path):
    given = utterances_from_events(spark, FOLDER)
    documents = sessions.sessions_from(given)
    documents.select(F.to_json(F.struct(*documents.columns)).alias("value")).write.text(str(tmp_path / "json"))
    documents.write.parquet(str(tmp_path / "parquet"))
    rows = {}
    for kind in ("json", "parquet"):
        found = sessions.utterances_of(sessions.read_sessions(spark, str(tmp_path / kind), kind))
        rows[kind] = sorted(found.drop("pos").collect(), key=lambda r: (r.session_id, r.utt_id))
    assert rows["json"] == rows["parquet"] and len(rows["json"]) == given.count()
    want = {(r.session_id, r.utt_id): r for r in given.collect()}
    for r in rows["json"]:
        w = want[r.session_id, r.utt_id]
        assert (r.start_ms, r.end_ms, r.sent_label, r.score_e4, r.emotion, r.overlap, r.confidence) == (
            w.start_ms, w.end_ms, w.sent_label, w.score_e4, w.emotion, w.overlap, w.confidence,
        )
        assert r.speaker == w.speaker.upper() and r.word_count == len(w.text.split())
    with pytest.raises(ValueError, match="csv"):
        sessions.read_sessions(spark, "x", "csv")


def test_faults_reject_whole_sessions_and_are_counted(spark, tmp_path):
    found = read(
        spark, tmp_path,
        {"session_id": "good", "utterances": [utterance(), utterance(id="u0", start=0.5), {"id": "u2", "speaker": "b", "start": 3, "end": 3}], "extra": 1},
        {"session_id": "late", "utterances": [utterance(end=0.1), utterance()]},
        {"session_id": "score", "utterances": [utterance(sentiment={"label": "glad", "score": 1.5}, emotion={"values": {"x": -0.1}})]},
        {"session_id": "none", "utterances": [], "duration_sec": -1},
        {"utterances": [utterance(id=None, speaker=None, start=None, end=None), None]},
        {"session_id": "type", "utterances": "text"},
        {"session_id": "empty"},
        '{"session_id": "cut", "utterances": [',
    )
    faults = {r.session_id or str(i): sorted(r.faults) for i, r in enumerate(sessions.with_faults(found).collect())}
    assert faults["good"] == faults["empty"] == []
    assert faults["late"] == ["end_before_start"] and faults["none"] == ["negative_duration"]
    assert faults["score"] == ["emotion_out_of_range", "sentiment_out_of_range", "unknown_sentiment"]
    assert ["missing_end", "missing_id", "missing_session_id", "missing_speaker", "missing_start", "null_utterance"] in faults.values()
    counted = {r.fault: r.sessions for r in sessions.fault_counts(found).collect()}
    assert counted["malformed"] == 2 and counted[None] == 2
    rows = sessions.utterances_of(found).orderBy("pos").collect()
    assert [(r.session_id, r.utt_id, r.pos) for r in rows] == [("good", "u0", 1), ("good", "u1", 2), ("good", "u2", 3)]
    assert (rows[1].speaker, rows[1].text, rows[1].start_ms, rows[1].end_ms, rows[1].score_e4, rows[1].word_count) == ("AGENT_A", "hi there", 500, 2250, 8123, 2)
    assert rows[2].sent_label is None and rows[2].emotion is None and rows[2].overlap is False


def test_parquet_reads_only_the_fields_in_use(spark, tmp_path):
    sessions.sessions_from(utterances_from_events(spark, FOLDER)).write.parquet(str(tmp_path / "p"))
    some = sessions.read_sessions(spark, str(tmp_path / "p"), "parquet").select("session_id", F.col("utterances.text"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<session_id:string,utterances:array<struct<text:string>>>" in plan


def read_schema(df):
    return re.search(r"ReadSchema: (.*)", df._jdf.queryExecution().executedPlan().toString()).group(1)


def test_views_of_stored_insights_read_their_part(spark, tmp_path):
    path = str(tmp_path / "stored")
    utterances = utterances_from_events(spark, FOLDER).cache()
    bundle = build_bundle(utterances)
    insights.store_insights(bundle, path, F.lit(1).cast("long"), parts=4)
    stored = spark.read.parquet(path)
    assert stored.count() == utterances.select("session_id").distinct().count()
    summaries, speakers, timeline = insights.summary_view(stored), insights.speakers_view(stored), insights.timeline_view(stored)
    assert "analytics" not in read_schema(summaries) and "insights" not in read_schema(summaries) and "speakers" not in read_schema(summaries)
    assert "summaries" not in read_schema(timeline) and "flags" not in read_schema(timeline)
    assert "timeline" not in read_schema(speakers) and "overall" not in read_schema(speakers)
    assert timeline.count() == bundle.timeline.count() and speakers.count() == bundle.speakers.count()
    assert insights.flags_view(stored).count() == bundle.session_flags.count()
    shown = {(r.session_id, r.speaker): r.word_count for r in speakers.collect()}
    assert shown == {(r.session_id, r.speaker): r.word_count for r in bundle.speakers.collect()}
    sessions_before = stored.count()
    # one session again, shorter: its record is replaced, the others stay
    one = utterances.first().session_id
    again = build_bundle(utterances.where((F.col("session_id") == one) & (F.col("pos") <= 2)))
    insights.store_insights(again, path, F.lit(2).cast("long"), parts=4)
    after = {r.session_id: (r.created_at, r.updated_at, r.n) for r in spark.read.parquet(path).select("session_id", "created_at", "updated_at", F.col("analytics.session.total_utterances").alias("n")).collect()}
    assert len(after) == sessions_before and after[one] == (1, 2, 2) and sum(v[1] == 2 for v in after.values()) == 1
    bundle.discard()
    again.discard()
