"""Tables of a database, read in parts by key, and the payloads that they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CORRUPT = "malformed"


def read_in_parts(spark: SparkSession, url: str, table: str, key: str = "id", parts: int = 8, properties: dict[str, str] | None = None) -> DataFrame:
    """A table read by ``parts`` connections side by side, each with a range of a whole-number ``key``.

    The ranges are even between the key's smallest and largest value, which one small query fetches; rows without a key
    are in the first part. An empty table is read by one connection. Filters and columns go to the database.
    """
    name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    bounds = spark.read.jdbc(url, f"(SELECT MIN({name}) AS low, MAX({name}) AS high FROM {table}) bounds", properties=properties)
    low, high = bounds.first()
    if low is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column=key, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=parts, properties=properties)


def write_table(rows: DataFrame, url: str, table: str, mode: str = "append", properties: dict[str, str] | None = None) -> None:
    rows.write.jdbc(url, table, mode=mode, properties=properties)


def with_payload(rows: DataFrame, schema: StructType, payload_col: str = "payload") -> DataFrame:
    """The JSON text of ``payload_col`` as a struct, and the text itself in ``malformed`` where it does not fit the schema."""
    kept = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    parsed = F.from_json(payload_col, kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = rows.withColumn(payload_col, parsed)
    return rows.withColumns({CORRUPT: F.col(f"{payload_col}.{CORRUPT}"), payload_col: F.col(payload_col).dropFields(CORRUPT)})
