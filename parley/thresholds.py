"""Parameters of the rules."""

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """Fixed values unless a caller has reasons of its own; ratios in [0, 1], times in milliseconds."""

    dominance_speaking_ratio: float = 0.60
    dominance_word_ratio: float = 0.60
    long_pause_ms: int = 3000
    severe_pause_ms: int = 6000
    tension_interruptions: int = 2
    tension_overlaps: int = 2
    shift_e4: int = 4500
    severe_shift_e4: int = 7000
    frequent_interruptions: int = 2
    overlap_participation: int = 2
    low_inquiry_utterances: int = 4

    def on(self, rows: DataFrame) -> DataFrame:
        """Rows by session as they are: these thresholds are the same for all."""
        return rows


NAMES = [f.name for f in fields(Thresholds)]


class TenantThresholds:
    """Thresholds that differ by tenant, used as ``Thresholds`` are: their values are columns of the rows that ``on`` returns.

    ``sessions`` has ``session_id`` and ``tenant``, ``table`` a row of thresholds for each ``tenant`` under the names of
    ``Thresholds``. What a tenant or the table leaves open, and sessions without a tenant, have those of ``default``. Of
    several rows of a tenant the largest of each value counts, of several tenants of a session the first by name.
    """

    def __init__(self, sessions: DataFrame, table: DataFrame, default: Thresholds | None = None):
        self.default = default or Thresholds()
        given = [n for n in NAMES if n in table.columns]
        table = table.groupBy("tenant").agg(*[F.max(n).alias(n) for n in given], F.lit(True).alias("known"))
        sessions = sessions.groupBy("session_id").agg(F.min("tenant").alias("tenant"))
        self.rows = sessions.join(table, "tenant").select("session_id", F.struct("known", *given).alias("threshold"))
        self._given = set(given)

    def __getattr__(self, name: str) -> Column:
        if name not in NAMES:
            raise AttributeError(name)
        usual = F.lit(getattr(self.default, name))
        return F.coalesce(F.col(f"threshold.{name}"), usual) if name in self._given else usual

    def on(self, rows: DataFrame) -> DataFrame:
        """Rows by session with the thresholds of their tenant."""
        return rows.join(self.rows, "session_id", "left")
