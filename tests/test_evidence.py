"""Stored responses of services and what claims make of them."""

import json

from parley.operators import claims, evidence


def test_each_service_and_what_it_lacks(spark):
    rows = [
        ("CURRENCY_RATE", "USD/EUR", 1, {"base": "USD", "rates": {"EUR": 0.92, "GBP": "0.79"}}),
        ("CURRENCY_RATE", "USD/GBP", 2, {"base": "USD", "rates": {"EUR": 0.92, "GBP": "0.79"}}),
        ("CURRENCY_RATE", "USD/JPY", 3, {"rates": {"EUR": 1}}),
        ("CURRENCY_RATE", "USD/PKR", 3, {"rates": None}),
        ("CRYPTO_PRICE", "BTC", 4, {"bitcoin": {"usd": 64000}}),
        ("CRYPTO_PRICE", "ETH", 4, {"bitcoin": {"usd": 64000}}),
        ("CRYPTO_PRICE", "XYZ", 4, {"xyz": {"usd": 1}}),
        ("STOCK_PRICE", "AAPL", 5, {"Global Quote": {"01. symbol": "AAPL", "05. price": "175.20"}}),
        ("STOCK_PRICE", "MSFT", 5, {"Note": "limit", "Global Quote": {"05. price": "1"}}),
        ("STOCK_PRICE", "IBM", 5, {"Information": "limit"}),
        ("STOCK_PRICE", "AMD", 5, {"Global Quote": {"05. price": ""}}),
        ("WEATHER", "Paris|C", 6, {"main": {"temp": 21.5}}),
        ("WEATHER", "Paris|F", 6, {"main": {"temp": True}}),
        ("WEATHER", "Lima|C", 6, {"cod": 404}),
        ("STATIC_FACT", "France", 7, {"title": "France", "extract": "France is a country. Its capital, largest city and main cultural centre is Paris."}),
        ("STATIC_FACT", "Pakistan", 7, {"extract": "Islamabad is the nation's capital."}),
        ("STATIC_FACT", "Nowhere", 7, {"extract": "A place."}),
        ("COMMODITY_PRICE", "XAU", 8, {"gold": 1}),
        ("WEATHER", "Rome|C", 9, [1, 2]),
        ("WEATHER", "Oslo|C", 9, None),
    ]
    texts = [(k, s, t, None if b is None else json.dumps(b)) for k, s, t, b in rows] + [("WEATHER", "Bonn|C", 9, "{not json"), (None, None, None, None)]
    responses = spark.createDataFrame(texts, "claim_type string, subject string, fetched_ms long, body string")
    found = {r.subject: (r.value, r.value_text, r.unit, r.source) for r in evidence.evidence_from_responses(responses).collect()}
    assert found == {
        "USD/EUR": (0.92, None, "EUR", "forex"),
        "USD/GBP": (0.79, None, "GBP", "forex"),
        "BTC": (64000.0, None, "USD", "crypto"),
        "AAPL": (175.2, None, "USD", "stock"),
        "Paris|C": (21.5, None, "C", "weather"),
        "France": (None, "Paris", None, "facts"),
        "Pakistan": (None, "Islamabad", None, "facts"),
    }
    said = spark.createDataFrame([(1, 10, "Bitcoin is at 64000"), (2, 10, "The capital of France is Paris"), (3, 10, "MSFT is at 1")], "id int, claim_ms long, text string")
    held = claims.with_evidence(claims.detect_claims(said, ["id", "claim_ms"]), evidence.evidence_from_responses(responses))
    assert {r.id: r.verdict for r in claims.verdicts(held).collect()} == {1: "TRUE", 2: "TRUE", 3: "SOURCE_UNAVAILABLE"}
