"""Deletion, stages and appended results of stored tables."""

from pyspark.sql import functions as F

from parley.sources import store


def records(spark, *rows):
    return spark.createDataFrame(list(rows), "session_id string, created_at long, updated_at long, text string")


def test_delete_tells_what_existed_and_empties_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    store.upsert(records(spark, *[(f"s{i}", 1, 1, "x") for i in range(12)]), path, parts=4)
    keys = spark.createDataFrame([("s3",), ("s3",), ("nobody",)], "session_id string")
    found = {r.session_id: r.existed for r in store.delete(spark, path, keys, parts=4).collect()}
    assert found == {"s3": True, "nobody": False}
    left = {r.session_id for r in spark.read.parquet(path).collect()}
    assert left == {f"s{i}" for i in range(12)} - {"s3"}
    everyone = spark.createDataFrame([(f"s{i}",) for i in range(12)], "session_id string")
    store.delete(spark, path, everyone, parts=4)
    assert store._read(spark, path) is None or spark.read.parquet(path).count() == 0
    assert {r.existed for r in store.delete(spark, str(tmp_path / "none"), keys).collect()} == {False}


def test_a_stage_of_a_day_is_replaced_and_other_days_stay(spark, tmp_path):
    path = str(tmp_path / "stages")
    assert store.read_stage(spark, path, "asr") is None
    store.write_stage(spark.range(3), path, "asr", "2026-01-01")
    store.write_stage(spark.range(5), path, "asr", "2026-01-02")
    store.write_stage(spark.range(2), path, "asr", "2026-01-01")
    days = {str(r.run_date): r["count"] for r in store.read_stage(spark, path, "asr").groupBy("run_date").count().collect()}
    assert days == {"2026-01-01": 2, "2026-01-02": 5}


def test_results_are_appended_by_day_and_pages_are_the_newest(spark, tmp_path):
    path = str(tmp_path / "results")
    for start in (0, 10):
        rows = records(spark, *[(f"s{i}", i, i, "x") for i in range(start, start + 10)])
        store.append_results(rows, path, F.lit("2026-01-01") if start else F.lit("2025-12-31"))
    stored = spark.read.parquet(path)
    assert stored.count() == 20 and stored.select("day").distinct().count() == 2
    assert [r.session_id for r in store.newest_first(stored, 3).collect()] == ["s19", "s18", "s17"]
    assert store.counts(stored).first()[:] == (20, 20)
