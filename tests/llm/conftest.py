import pytest

LONG = "Zebra licht und die anderen worte sind hier " * 3000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHING = ["fp", "key", "root", "words", "n_words", "label", "shard", "slot", "line", "h", "text_key", "found", "group", "score", "bad_id"]


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and blank and very long texts, repeated rows and ids, and clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 3),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 3),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, " \n\t ", "fr", "b", 5),
        (None, "Released under the MIT License.", "en", None, 7),
        (5, LONG, "de", "b", len(LONG)),
        (6, "12345 !!! ...", None, "a", 3),
        (7, "one\ntwo\n\nthree", "en", "c", 1),
        (8, "\u00c9t\u00e9 \u4e2d\u6587 \U0001f600 na\u00efve", "fr", "c", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.selectExpr("*", *[f"'x' as `{c}`" for c in CLASHING])


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
