"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits come from the word shingles of the whole text. Two fingerprints link when they
differ in at most ``radius`` bits. The 64 bits are cut into segments and each segment gets a Hamming radius
so that the radii plus one add up to ``radius + 1``: a linked pair must agree within the radius of at least
one segment. A table per segment holds the fingerprints by their bits there; each fingerprint enumerates the
Hamming ball of each of its segments, fetches what the tables hold and verifies the complete distance.

Large groups of copies stay cheap: equal fingerprints are one node; the members of a bucket first link to the
bucket's most frequent fingerprint (a star, not all pairs); and the probes then skip what is already joined,
so that a bucket full of one component is never paired with itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from parley.llm._shared import connected_components, materialize

#: (first bit, bits, radius within the segment) for linked distances up to 4: 2 + 2 + 1 = 4 + 1.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
SHINGLE, SEED, RADIUS = 4, 42, 4
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text, as a signed long; 0 if it has no word."""
    words = (text or "").encode().lower().split()  # of bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    last = len(words) - width + 1
    begin, end, digest = starts[:last].tolist(), ends[width - 1 :].tolist(), xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, last, CHUNK):
        spans = zip(begin[at : at + CHUNK], end[at : at + CHUNK], strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > last, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprints(text: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(x) for x in text], dtype="int64")


def _segment(fp, first: int, bits: int):
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def _key(number: int, value):
    """One long for a segment's number and its bits."""
    return value.bitwiseOR(F.lit(number << 32).cast("long"))


def _table(nodes: DataFrame) -> DataFrame:
    """A row for each fingerprint and segment."""
    fp = F.col("fp")
    keys = [_key(k, _segment(fp, first, bits)) for k, (first, bits, _) in enumerate(SEGMENTS)]
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "*")


def _probes(nodes: DataFrame) -> DataFrame:
    """A row for each fingerprint and each value in its Hamming balls.

    Of two values that differ in one bit only the one with a 0 there asks, so a pair is met once.
    """

    def ball(number: int, first: int, bits: int, radius: int):
        own = _segment(F.col("fp"), first, bits)
        if not radius:
            return F.array(_key(number, own))
        flips = F.array(*[F.lit(1 << i).cast("long") for i in range(bits)])
        unset = F.filter(flips, lambda bit: own.bitwiseAND(bit) == 0)
        return F.concat(F.array(_key(number, own)), F.transform(unset, lambda bit: _key(number, own.bitwiseOR(bit))))

    balls = F.concat(*[ball(k, *segment) for k, segment in enumerate(SEGMENTS)])
    return nodes.select(F.explode(balls).alias("key"), "*")


def link_fingerprints(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Each fingerprint (column ``fp``, distinct, with its number of documents ``n``) and its group's ``root``."""
    if radius > sum(r + 1 for *_, r in SEGMENTS) - 1:
        raise ValueError(f"the segments find distances up to {sum(r + 1 for *_, r in SEGMENTS) - 1}")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius
    table = _table(nodes)
    pivots = table.groupBy("key").agg(F.max(F.struct("n", "fp")).alias("p"), F.count("*").alias("k")).where("k > 1")
    stars = table.join(pivots.select("key", F.col("p.fp").alias("other")), "key").where("fp != other").where(near)
    stars = stars.select(F.col("fp").alias("a"), F.col("other").alias("b"))
    roots = connected_components(stars, "simhash-stars")
    known = materialize(
        nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "n", F.coalesce("root", "fp").alias("root")),
        "simhash-nodes",
    )
    # what the stars have not joined: pairs of different groups only
    table = _table(known)
    buckets = table.groupBy("key").agg(
        F.max(F.struct("n", "fp", "root")).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi")
    )
    buckets = buckets.select("key", F.col("p.root").alias("major"), (F.col("lo") != F.col("hi")).alias("mixed"))
    asked = _probes(known).join(buckets, "key").withColumn("inside", F.col("root") == F.col("major"))
    asked = asked.where("mixed or not inside").select("key", "inside", "fp", "root")
    # a probe of the bucket's main group asks for the others only
    held = table.join(buckets.where("mixed"), "key").where("root != major").select(
        "key", F.lit(True).alias("inside"), F.col("fp").alias("other"), F.col("root").alias("other_root")
    )
    held = held.unionAll(
        table.select("key", F.lit(False).alias("inside"), F.col("fp").alias("other"), F.col("root").alias("other_root"))
    )
    links = asked.join(held, ["key", "inside"]).where("root != other_root").where(near)
    merged = connected_components(
        links.select(F.col("root").alias("a"), F.col("other_root").alias("b")).distinct(), "simhash-links"
    ).withColumnRenamed("root", "top")
    return known.join(merged, known.root == merged.node, "left").select("fp", F.coalesce("top", "root").alias("root"))


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links, itself included. Null and blank texts have the
    fingerprint 0 and link like any other; repeated rows get the same values; null ids are never the smallest;
    an empty table gives no rows. Only the two named columns are read, so others cannot clash.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), fingerprints(F.col(text_col)).alias("fp"))
    rows = materialize(rows, "simhash-fingerprints")
    nodes = rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    roots = materialize(link_fingerprints(nodes.select("fp", "n"), radius), "simhash-roots")
    least = nodes.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    of = roots.join(least, "root").select("fp", "component_id")
    return rows.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near copies, with all its columns.

    It is the row of the smallest id (null ids come last) and, of several texts of that id, of the smallest text
    hash; of rows that repeat both, one.
    """
    key = {"k_id": docs[id_col], "k_text": F.xxhash64(docs[text_col])}
    rows = docs.select(*[c.alias(n) for n, c in key.items()], fingerprints(docs[text_col]).alias("fp"))
    # a row for each id and text, with the number of its copies
    rows = materialize(rows.groupBy("k_id", "k_text", "fp").agg(F.count("*").alias("copies")), "simhash-rows")
    roots = materialize(link_fingerprints(rows.groupBy("fp").agg(F.sum("copies").alias("n"))), "simhash-roots")
    first = F.min(F.struct(F.col("k_id").isNull().alias("last"), "k_id", "k_text", "copies")).alias("k")
    keepers = rows.join(roots, "fp").groupBy("root").agg(first).select("k.k_id", "k.k_text", "k.copies")
    keepers = materialize(keepers, "simhash-keepers")
    on = docs[id_col].eqNullSafe(keepers.k_id) & (key["k_text"] == keepers.k_text)
    kept = docs.join(keepers.where("copies = 1"), on, "left_semi")
    row = F.struct(*[docs[c] for c in docs.columns])
    several = docs.join(keepers.where("copies > 1"), on, "left_semi").select(*[c.alias(n) for n, c in key.items()], row.alias("row"))
    several = several.groupBy("k_id", "k_text").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.unionAll(several.select("row.*"))
