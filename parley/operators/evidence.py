"""Stored responses of evidence services as one table of evidence.

A response is a row of ``claim_type``, ``subject`` (as claims have it), ``fetched_ms`` and ``body``, the JSON text as it
came. Bodies are read as VARIANT, since services send numbers as numbers or as text, and name fields by what was asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.claims import ASSETS, capital_in
from parley.operators.payloads import real_number

#: What the service of coin prices calls a symbol: its long name.
COINS = {symbol: name for name, symbol in ASSETS.items() if name != symbol.lower()}
COLUMNS = ["claim_type", "subject", "fetched_ms", "value", "value_text", "unit", "source"]
# Fields by which a service says that its limit is reached.
LIMIT_FIELDS = ("Note", "Information")


def _named(body: Column, path: str, name: Column) -> Column:
    """The field ``name`` of an object; null if the object or the field is missing."""
    return F.element_at(F.try_variant_get(body, path, "map<string,variant>"), name)


def _rows(responses: DataFrame, kind: str, value: Column, text: Column, unit: Column, source: str) -> DataFrame:
    rows = responses.where(F.col("claim_type") == kind).withColumn("b", F.try_parse_json("body"))
    found = rows.select("claim_type", "subject", "fetched_ms", value.alias("value"), text.alias("value_text"), unit.alias("unit"), F.lit(source).alias("source"))
    return found.where("value IS NOT NULL OR value_text IS NOT NULL")



def exchange_rates(responses: DataFrame) -> DataFrame:
    """``rates`` by currency; a claim's subject is ``base/quote``."""
    quote = F.element_at(F.split("subject", "/"), -1)
    return _rows(responses, "CURRENCY_RATE", real_number(_named(F.col("b"), "$.rates", quote), "$"), F.lit(None).cast("string"), quote, "forex")


def coin_prices(responses: DataFrame) -> DataFrame:
    """Dollars by the coin's long name; symbols without one have no evidence."""
    names = F.create_map(*[F.lit(x) for pair in COINS.items() for x in pair])
    coin = _named(F.col("b"), "$", F.element_at(names, F.upper("subject")))
    return _rows(responses, "CRYPTO_PRICE", real_number(coin, "$.usd"), F.lit(None).cast("string"), F.lit("USD"), "crypto")


def stock_quotes(responses: DataFrame) -> DataFrame:
    """A quote, unless the service says that its limit is reached."""
    body = F.col("b")
    limited = F.lit(False)
    for name in LIMIT_FIELDS:
        limited = limited | F.try_variant_get(body, f"$.{name}", "variant").isNotNull()
    price = real_number(body, "$['Global Quote']['05. price']")
    return _rows(responses, "STOCK_PRICE", F.when(~limited, price), F.lit(None).cast("string"), F.lit("USD"), "stock")


def temperatures(responses: DataFrame) -> DataFrame:
    """``main.temp``, in the unit that the claim's subject (``city|unit``) asks for."""
    return _rows(responses, "WEATHER", real_number(F.col("b"), "$.main.temp"), F.lit(None).cast("string"), F.element_at(F.split("subject", r"\|"), -1), "weather")


def capitals(responses: DataFrame) -> DataFrame:
    """The capital that an article's ``extract`` names."""
    extract = F.try_variant_get("b", "$.extract", "string")
    return _rows(responses, "STATIC_FACT", F.lit(None).cast("double"), F.nullif(capital_in(extract), F.lit("")), F.lit(None).cast("string"), "facts")


ADAPTERS = (exchange_rates, coin_prices, stock_quotes, temperatures, capitals)


def evidence_from_responses(responses: DataFrame) -> DataFrame:
    """Evidence for ``claims.with_evidence`` from the responses of all services.

    A body that is null, no JSON or no object, a missing field, a value that is no number and a note of a reached limit
    give no evidence, so that claims about the subject stay without a source. Several responses about a subject are
    snapshots of their times.
    """
    rows = None
    for adapter in ADAPTERS:
        part = adapter(responses)
        rows = part if rows is None else rows.unionByName(part)
    return rows.select(*COLUMNS)
