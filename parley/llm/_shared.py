"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.sources.scratch import discard, materialize

__all__ = ["discard", "materialize"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words made of digits, ASCII letters and everything outside ASCII.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text that has not been lower-cased.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


#: What is not ASCII, Latin-1 without capitals, punctuation or CJK: where a text has none of it, ``lower`` changes A-Z alone.
OTHER = r"[^\x00-\x7F\u00A0-\u00BF\u00D7\u00DF-\u00FF\u2000-\u206F\u3000-\u9FFF]"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    return F.when(text.rlike(OTHER), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (null id: as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Node and smallest node reachable, for every node of ``edges`` (columns ``a``, ``b``, of one type).

    Alternating large-star and small-star rounds: every round is a grouped minimum (combined before the
    shuffle) and a join, and its result is written to the shared folder. The number of rounds grows with
    the logarithm of a component's size. Nodes without an edge to another node are not returned.
    """
    larger, smaller = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    stars = materialize(edges.where("a != b").select(larger, smaller).distinct(), name)
    before = None
    while True:
        both = stars.select("a", "b").unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # large star: the larger neighbours of a node move to the smallest node around it
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, name)
        # small star: a node and its smaller neighbours move to the smallest of them
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before_stars, stars = stars, materialize(small.unionAll(root.select("a", F.col("m").alias("b"))).distinct(), name)
        discard(before_stars, large)
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = state
