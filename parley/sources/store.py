"""Tables of stored results: upsert, lookup, deletion and listing by key, and append-only results.

A stored table is split by a hash of the key into a fixed number of partitions, so that an upsert reads and rewrites
only the partitions that its keys fall into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.sources.scratch import discard, materialize

PARTITIONS = 64


def _part(key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def latest_by_key(rows: DataFrame, key: str = "session_id", at: str = "updated_at", created: str = "created_at") -> DataFrame:
    """The newest row of each key, with the time of its first."""
    mine = Window.partitionBy(key)
    rows = rows.withColumn(created, F.min(created).over(mine))
    newest = F.row_number().over(mine.orderBy(F.desc(at), F.xxhash64(*rows.columns)))
    return rows.withColumn("place_", newest).where("place_ = 1").drop("place_")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as error:  # a table that no one has written yet
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def upsert(records: DataFrame, path: str, key: str = "session_id", parts: int = PARTITIONS) -> None:
    """Insert or replace by key (columns ``key``, ``created_at``, ``updated_at`` and others).

    The records, and the merged rows of the partitions that they fall into, are written aside first: what is new is
    computed once, and the table is only replaced by rows that are already whole.
    """
    spark = records.sparkSession
    records = materialize(records.withColumn("part", _part(F.col(key), parts)), "upsert")
    stored = _read(spark, path)
    if stored is None:
        # whole records are only placed by key where a key has several
        repeated = records.groupBy(key).count().where("count > 1").limit(1).count() > 0
        _write(latest_by_key(records, key) if repeated else records, path)
    else:
        touched = [r["part"] for r in records.select("part").distinct().collect()]  # at most ``parts``
        merged = stored.where(F.col("part").isin(touched)).unionByName(records, allowMissingColumns=True)
        merged = materialize(latest_by_key(merged, key), "merged")
        _write(merged, path)
        discard(merged)
    discard(records)


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "session_id") -> DataFrame:
    """Stored rows whose key is in ``keys``."""
    return spark.read.parquet(path).join(keys.select(key), key, "left_semi")


def without(rows: DataFrame, keys: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows whose key is not among those to delete."""
    return rows.join(keys.select(key), key, "left_anti")


def delete(spark: SparkSession, path: str, keys: DataFrame, key: str = "session_id", parts: int = PARTITIONS) -> DataFrame:
    """Delete by key and rewrite the partitions that held one; each of ``keys`` and whether it ``existed``."""
    keys = keys.select(key).distinct()
    stored = _read(spark, path)
    if stored is None:
        return keys.withColumn("existed", F.lit(False))
    held = materialize(stored.join(keys, key, "left_semi").select(key, "part"), "deleted")
    touched = [r["part"] for r in held.select("part").distinct().collect()]  # at most ``parts``
    if touched:
        rest = materialize(without(stored.where(F.col("part").isin(touched)), held, key), "rest")
        left = {r["part"] for r in rest.select("part").distinct().collect()}
        _write(rest, path)
        for part in set(touched) - left:  # partitions that the deletion leaves empty
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={part}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return keys.join(held.select(key, F.lit(True).alias("existed")).distinct(), key, "left").withColumn("existed", F.coalesce("existed", F.lit(False)))


def counts(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """Number of rows and of keys of a stored table."""
    return rows.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"))


def write_stage(rows: DataFrame, path: str, stage: str, run_date: str) -> None:
    """A stage's output for a day; running the day again replaces it."""
    day = rows.withColumn("run_date", F.lit(run_date))
    day.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(f"{path}/{stage}")


def read_stage(spark: SparkSession, path: str, stage: str) -> DataFrame | None:
    """All days of a stage, or nothing if it never ran."""
    return _read(spark, f"{path}/{stage}")


def newest_first(rows: DataFrame, n: int, key: str = "session_id", at: str = "updated_at") -> DataFrame:
    """The page of the ``n`` rows updated last: keys and times are sorted, and only the page's rows are fetched.

    The page is as large as the caller asks for, so Spark chooses the join by its size.
    """
    page = rows.select(key, at).orderBy(F.desc(at), key).limit(n)
    return rows.join(page, [key, at], "left_semi").orderBy(F.desc(at), key)


def append_results(results: DataFrame, path: str, day: Column) -> None:
    """Append fact-check results, by day."""
    results.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)
