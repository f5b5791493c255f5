"""Sessions cut into chunks give the results of whole ones."""

import pytest
from pyspark.sql import functions as F

from parley.operators import chunks
from parley.operators.metrics import ORDER, sequence
from parley.plans.bundle import build_bundle
from parley.sources.adapters import utterances_from_events

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect()))


@pytest.mark.parametrize("chunk", [3, 20])
def test_chunks_change_no_table(spark, monkeypatch, chunk):
    given = utterances_from_events(spark, FOLDER)
    # ties of starts, and one session of several times the others' length
    given = given.withColumn("start_ms", F.col("start_ms") - F.col("start_ms") % 50).withColumn("session_id", F.when(F.col("session_id") % 3 == 0, "0").otherwise(F.col("session_id")))
    given = given.withColumn("utt_id", F.concat("utt_id", F.lit("_"), "session_id")).cache()
    whole = build_bundle(given)
    assert whole.bounds is None and "chunk" not in whole.turns.columns
    monkeypatch.setattr(chunks, "CHUNK", chunk)
    cut = build_bundle(given)
    assert cut.turns.select("session_id", "chunk").distinct().count() > 2 * cut.turns.select("session_id").distinct().count()
    assert rows_of(cut.turns.drop("chunk", "emotion")) == rows_of(whole.turns.drop("emotion"))
    for table in ("markers", "inconsistent_turns", "inconsistency_windows", "timeline", "escalation", "session_flags"):
        assert rows_of(getattr(cut, table)) == rows_of(getattr(whole, table)), table
    whole.discard()
    cut.discard()


def test_one_long_session_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK", 5000)
    rows = spark.range(100_000).selectExpr("'s' session_id", "concat('u', id) utt_id", "concat('p', id % 3) speaker", "id * 700 start_ms", "id * 700 + 900 end_ms", "'hi?' text", "CAST(NULL AS BIGINT) word_count")
    turns = sequence(rows, chunks.long_sessions(rows))
    sizes = [r["count"] for r in turns.groupBy("chunk").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1.2 * min(sizes)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = [r["count"] for r in turns.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) == 4 and max(tasks) < 60_000
    last = turns.orderBy(F.desc("seq")).first()
    assert (last.seq, last.prev_utt_id, turns.where("gap_ms = -200").count()) == (100_000, "u99998", 99_999)
    assert turns.selectExpr("count(DISTINCT seq)", "min(seq)").first()[:] == (100_000, 1)
    assert ORDER == ("start_ms", "end_ms", "utt_id")
