"""Gates that lose no row, and tables of the embedded database."""

import json

from pyspark.sql import functions as F

from parley.operators import gates
from parley.sources import database, sessions


def test_both_sides_of_the_payload_gate(spark, tmp_path):
    item = {"id": "u", "speaker": "a", "start": 0, "end": 1, "text": "hi"}
    lines = [
        (1, json.dumps({"session_id": "s", "utterances": [item]})),
        (2, json.dumps({"session_id": "s", "utterances": [item | {"confidence": 7}]})),
        (3, json.dumps({"session_id": "s", "utterances": [item | {"end": None}, 5]})),
        (4, "{broken"), (5, None), (6, json.dumps({"session_id": "s", "utterances": []})),
    ]
    rows = spark.createDataFrame(lines, "n int, line string")
    counts = gates.split(gates.gate_payloads(rows, "n", "line"), str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out"))
    assert counts == {"accepted": 2, "rejected": 4} and written.count() == 6
    good = {r.payload_id: [i.code for i in r.issues] for r in gates.side(written, True).collect()}
    bad = {r.payload_id: [i.code for i in r.issues] for r in gates.side(written, False).collect()}
    assert good == {1: [], 2: ["invalid_confidence"]}
    assert bad == {3: ["missing_end", "invalid_utterance_type"], 4: ["invalid_payload_type"], 5: ["invalid_payload_type"], 6: ["empty_utterances"]}
    assert {r.payload_id: r.value for r in written.collect()} == dict(lines)
    plan = gates.side(written, True)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(accepted" in plan


def test_both_sides_of_the_audio_gate(spark, tmp_path):
    quality = spark.createDataFrame(
        [("a", False, False, False, False), ("b", True, False, True, True), ("c", False, True, False, False), ("d", False, False, True, False), ("e", False, False, True, True)],
        "id string, is_silent boolean, is_near_silent boolean, low_snr boolean, very_low_snr boolean",
    )
    rows = spark.createDataFrame([(x, "calm") for x in "abcdef"], "session_id string, emotion string")
    gated = gates.gate_audio(rows, quality)
    assert gates.split(gated, str(tmp_path / "a")) == {"accepted": 4, "rejected": 2}
    found = {r.session_id: (r.accepted, r.quality_warnings, r.emotion) for r in gated.collect()}
    assert found == {
        "a": (True, [], "calm"), "b": (False, ["AUDIO_SILENT_OR_NEAR_SILENT"], "calm"), "c": (False, ["AUDIO_SILENT_OR_NEAR_SILENT"], "calm"),
        "d": (True, ["LOW_SNR_AUDIO"], None), "e": (True, ["LOW_SNR_AUDIO", "HEAVY_NOISE_AUDIO"], None), "f": (True, ["AUDIO_QUALITY_FAILED"], "calm"),
    }


def test_a_table_is_read_in_parts_and_its_payload_parsed(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    payload = F.when(F.col("id") % 10 == 3, F.lit('{"session_id": ')).otherwise(F.concat(F.lit('{"session_id": "s'), "id", F.lit('", "utterances": [{"id": "u", "start": 1.5}]}')))
    rows = spark.range(10, 110).select("id", F.concat(F.lit("s"), "id").alias("session_id"), payload.alias("payload"))
    database.write_table(rows, url, "insights", properties=driver)
    read = database.read_in_parts(spark, url, "insights", parts=4, properties=driver)
    assert read.rdd.getNumPartitions() == 4
    sizes = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
    assert sorted(sizes) == [25, 25, 25, 25]
    parsed = database.with_payload(read.withColumnsRenamed({c: c.lower() for c in read.columns}), sessions.SCHEMA)
    found = parsed.orderBy("id").collect()
    assert [r.id for r in found] == list(range(10, 110))
    assert all((r.malformed is not None) == (r.id % 10 == 3) for r in found)
    assert all(r.payload.session_id == r.session_id and r.payload.utterances[0].start == 1.5 for r in found if r.malformed is None)
    database.write_table(rows.limit(0), url, "nothing", properties=driver)
    assert database.read_in_parts(spark, url, "nothing", parts=4, properties=driver).count() == 0
