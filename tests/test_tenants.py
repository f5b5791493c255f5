"""Thresholds by tenant: one run gives what a run for each tenant gives."""

import pytest
from pyspark.sql import functions as F

from parley.plans.bundle import build_bundle
from parley.sources.adapters import utterances_from_events
from parley.thresholds import TenantThresholds, Thresholds

OWN = {"long_pause_ms": 900, "severe_pause_ms": 2000, "dominance_speaking_ratio": 0.35, "shift_e4": 2500, "tension_interruptions": 1, "low_inquiry_utterances": 2}


def rows_of(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def test_two_tenants_in_one_run(spark):
    turns = utterances_from_events(spark, "/root/testdata/sf0.001").cache()
    tenant = F.when(F.col("session_id").cast("long") % 2 == 1, "b").when(F.col("session_id").cast("long") % 4 == 0, "a")
    sessions = turns.select("session_id", tenant.alias("tenant"))
    table = spark.createDataFrame([("b", *OWN.values()), ("c", *[1] * 2, 1.0, *[1] * 3)], "tenant string, " + ", ".join(f"{n} {'double' if 'ratio' in n else 'int'}" for n in OWN))
    together = build_bundle(turns, TenantThresholds(sessions, table))
    odd = F.col("session_id").cast("long") % 2 == 1
    apart = [build_bundle(turns.where(odd), Thresholds(**OWN)), build_bundle(turns.where(~odd), Thresholds())]
    for name in ("markers", "speaker_flags", "session_flags"):
        found, want = rows_of(getattr(together, name)), rows_of(getattr(apart[0], name)) + rows_of(getattr(apart[1], name))
        assert found == sorted(want), name
    assert rows_of(build_bundle(turns, Thresholds()).markers) != rows_of(together.markers)
    with pytest.raises(AttributeError):
        TenantThresholds(sessions, table).no_such_threshold  # noqa: B018
    for bundle in (together, *apart):
        bundle.discard()
