"""Windows over sessions that are too long for one task.

A long session's turns are cut into chunks of time, so that a chunk follows from a turn's start and turns of one start
stay together. A window runs over (session, chunk); what it needs from earlier chunks, the last value of each chunk and
the number of its rows, is a small table with a row for each chunk, and is joined back. Results equal those of windows
over whole sessions. Turns without a ``chunk`` column are of sessions that fit a task, and have the plain windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a chunk, about, and chunks of a session at most.
CHUNK, PARTS = 100_000, 1000


def long_sessions(utterances: DataFrame) -> DataFrame | None:
    """``session_id`` and ``bounds``, the starts at which a session of more than ``CHUNK`` turns is cut; None if there is none."""
    sizes = utterances.groupBy("session_id").count().where(F.col("count") > CHUNK)
    most = sizes.agg(F.max("count")).first()[0]
    if most is None:
        return None
    parts = min(PARTS, -(-most // CHUNK))
    shares = [k / parts for k in range(1, parts)] or [0.5]
    times = utterances.join(sizes.select("session_id"), "session_id", "left_semi").groupBy("session_id")
    cuts = F.percentile_approx("start_ms", F.array(*map(F.lit, shares)), F.lit(20 * parts))
    return times.agg(F.array_distinct(cuts).alias("bounds"))


def in_chunks(rows: DataFrame, bounds: DataFrame, ms: str | Column = "start_ms") -> DataFrame:
    """``rows`` with their ``chunk``, placed by session and chunk; 0 for sessions that are not cut."""
    ms = F.col(ms) if isinstance(ms, str) else ms
    cut = F.size(F.filter("bounds", lambda b: b <= ms))
    rows = rows.join(bounds, "session_id", "left").withColumn("chunk", F.coalesce(cut, F.lit(0))).drop("bounds")
    return rows.repartition("session_id", "chunk")


def running(rows: DataFrame, keys: list[str], order: tuple[str, ...], before: dict[str, Column] | None = None, number: str | None = None) -> DataFrame:
    """``rows`` with the last value before each row that is not null, and the row's ``number``, among the rows of its keys.

    ``order`` has no ties within ``keys`` and never goes back to an earlier chunk. Without a ``chunk`` column these are
    plain windows.
    """
    before, chunked = before or {}, "chunk" in rows.columns
    part = [*keys, "chunk"] if chunked else keys
    within = Window.partitionBy(*part).orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    if not chunked:
        found = {name: F.last(value, ignorenulls=True).over(earlier) for name, value in before.items()}
        return rows.withColumns(found | ({number: F.row_number().over(within)} if number else {}))
    rows = rows.withColumns({f"{name}_own": value for name, value in before.items()})
    last = lambda name: F.max_by(f"{name}_own", F.when(F.col(f"{name}_own").isNotNull(), F.struct(*order)))
    sums = rows.groupBy(*part).agg(F.count("*").alias("n_own"), *[last(name).alias(f"{name}_last") for name in before])
    chunks = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"{name}_carried": F.last(f"{name}_last", ignorenulls=True).over(chunks) for name in before}
    sums = sums.select(*part, F.coalesce(F.sum("n_own").over(chunks), F.lit(0)).alias("n_before"), *[c.alias(n) for n, c in carried.items()])
    rows = rows.withColumns(
        {name: F.last(f"{name}_own", ignorenulls=True).over(earlier) for name in before}
        | ({number: F.row_number().over(within)} if number else {})
    ).join(sums, part)
    rows = rows.withColumns({name: F.coalesce(name, f"{name}_carried") for name in before} | ({number: F.col(number) + F.col("n_before")} if number else {}))
    return rows.drop("n_before", *[f"{name}_{s}" for name in before for s in ("own", "carried")])
