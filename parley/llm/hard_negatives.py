"""Hard negatives by Four-Russians scoring.

Components become whole numbers. A candidate is packed as bit planes: byte ``g`` of plane ``b`` holds bit ``b`` of its
dimensions ``8 g`` to ``8 g + 7``. For an anchor, every group of eight dimensions gets a table of the 256 sums of its
subsets, so a plane's product with the anchor is one lookup a byte, and the planes are added up by shifts. The scores are
the exact inner products.

Anchors and candidates meet in blocks of bounded size. Positives are looked for among rows of the anchor's label only,
negatives among the rows of other labels once the anchor's positives are known, so every score is computed once. A
block returns its first few rows for each anchor, and a window takes the first of all blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm._shared import materialize

GROUP = 8
#: Anchors and candidates in a block, on average.
ANCHORS, ROWS = 1024, 8192
#: Scale of the components; every which id is an anchor; positives of an anchor, negatives of a positive.
SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: A negative's score lies between these percentages of the positive's.
LOW, HIGH = 50, 95
#: Stands for a null id, behind all others.
LAST = (1 << 63) - 1


def planes_for(least: int, most: int, dims: int) -> int:
    """Bits of the whole numbers from ``least`` to ``most`` in two's complement."""
    planes = max(int(most).bit_length(), (-int(least) - 1).bit_length() if least < 0 else 0) + 1
    if dims.bit_length() + 2 * (planes - 1) > 62:
        raise ValueError(f"inner products of {dims} components from {least} to {most} do not fit in 64 bits")
    return planes


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """Bytes by (row, plane, group) of whole numbers by (row, dimension)."""
    bits = (values[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def unpack(packed: np.ndarray, dims: int) -> np.ndarray:
    """The whole numbers that ``pack`` was given."""
    planes = packed.shape[1]
    bits = np.unpackbits(packed, axis=2, bitorder="little", count=dims).astype(np.int64)
    weights = np.int64(1) << np.arange(planes)
    weights[-1] = -weights[-1]
    return np.einsum("rpd,p->rd", bits, weights)


def subset_sums(anchor: np.ndarray) -> np.ndarray:
    """By group of eight dimensions, the sum over each of their 256 subsets; bit ``k`` of a subset is dimension ``k``."""
    groups = np.zeros((-(-len(anchor) // GROUP), GROUP), np.int64)
    groups.reshape(-1)[: len(anchor)] = anchor
    sums = np.zeros((len(groups), 1), np.int64)
    for k in range(GROUP):
        sums = np.concatenate([sums, sums + groups[:, k : k + 1]], axis=1)
    return sums


def scores(tables: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Inner products of an anchor (its ``subset_sums``) with candidates, whose bytes are by (plane, group, row)."""
    planes, groups, rows = places.shape
    total, plane, found = np.zeros(rows, np.int64), np.empty(rows, np.int64), np.empty(rows, np.int64)
    for b in reversed(range(planes)):
        plane[:] = 0
        for g in range(groups):
            np.take(tables[g], places[b, g], out=found, mode="clip")
            plane += found
        np.left_shift(total, 1, out=total)
        if b == planes - 1:  # the sign's plane
            total -= plane
        else:
            total += plane
    return total


def first_rows(at: np.ndarray, score: np.ndarray, ids: np.ndarray, rids: np.ndarray, most: int) -> np.ndarray:
    """Of the rows ``at``, the ``most`` with the highest scores, smaller ids first among equals."""
    if len(at) > most:
        own = score[at]
        at = at[own >= np.partition(own, len(at) - most)[len(at) - most]]
    return at[np.lexsort((rids[at], ids[at], -score[at]))[:most]]


def _codes(codes: pd.Series, dims: int, planes: int) -> np.ndarray:
    groups = -(-dims // GROUP)
    return np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), planes, groups)


def _scored(anchors: pd.DataFrame, rows: pd.DataFrame, planes: int) -> Iterator[tuple[int, np.ndarray]]:
    """Place and scores of each anchor against all rows."""
    dims = int(anchors["dims"].iloc[0])
    places = np.ascontiguousarray(_codes(rows["code"], dims, planes).transpose(1, 2, 0)).astype(np.intp)
    for k, anchor in enumerate(unpack(_codes(anchors["code"], dims, planes), dims)):
        yield k, scores(subset_sums(anchor), places)


def _nearest(planes: int, most: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def find(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(anchors) and len(rows):
            ids, rids, own = rows["place"].to_numpy(), rows["rid"].to_numpy(), anchors["rid"].to_numpy()
            for k, score in _scored(anchors, rows, planes):
                at = first_rows(np.flatnonzero(rids != own[k]), score, ids, rids, most)
                found.append(pd.DataFrame({"anchor": own[k], "other": rids[at], "place": ids[at], "score": score[at]}))
        return pd.concat(found) if found else pd.DataFrame({"anchor": [], "other": [], "place": [], "score": []}, dtype="int64")

    return find


def _within(planes: int, most: int, low: int, high: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def find(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(anchors) and len(rows):
            ids, rids, labels = rows["place"].to_numpy(), rows["rid"].to_numpy(), rows["label"].to_numpy()
            for k, score in _scored(anchors, rows, planes):
                anchor = anchors.iloc[k]
                others = np.flatnonzero(labels != anchor["label"])
                for positive in {int(p) for p in anchor["positives"]}:
                    least, greatest = -(-low * positive // 100), high * positive // 100
                    at = others[(score[others] >= least) & (score[others] <= greatest)]
                    at = first_rows(at, score, ids, rids, most)
                    found.append(
                        pd.DataFrame({"anchor": anchor["rid"], "positive": positive, "other": rids[at], "place": ids[at], "score": score[at]})
                    )
        names = ["anchor", "positive", "other", "place", "score"]
        return pd.concat(found) if found else pd.DataFrame({n: [] for n in names}, dtype="int64")

    return find


def _blocks(rows: Column, most: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / most)).cast("int")


def _meet(anchors: DataFrame, rows: DataFrame, keys: list[str], find: Callable, schema: str) -> DataFrame:
    """``find`` over every block of anchors with every block of rows of the same ``keys``.

    A row is in the block that a hash of its row id names, once for each block of the other side.
    """

    def dealt(table: DataFrame, own: str, other: str, kept: list[str]) -> DataFrame:
        own_block = F.pmod(F.xxhash64("rid"), F.col(f"{own}_blocks")).cast("int").alias(own)
        other_block = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)).alias(other)
        return table.select(own_block, other_block, *[F.col(c).alias(c) for c in dict.fromkeys([*keys, *kept])])

    asked = dealt(anchors, "a", "r", [c for c in anchors.columns if c in ("rid", "label", "dims", "code", "positives")])
    held = dealt(rows, "r", "a", ["rid", "label", "dims", "code", "place"])
    return asked.groupBy(*keys, "a", "r").cogroup(held.groupBy(*keys, "a", "r")).applyInPandas(find, schema)


def _first(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "place", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine_hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    scale: float = SCALE,
) -> DataFrame:
    """The first ``negatives`` rows of other labels for each anchor and positive: ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    A component ``x`` becomes ``floor(scale * x)``; a score is the inner product of these whole numbers. Higher scores
    come first, ties by smaller id. Anchors are the rows whose id is divisible by ``every``; an anchor's positives are
    its first ``positives`` other rows of its label. A negative scores ``LOW`` to ``HIGH`` percent of the positive's
    score; a positive with a negative score has none.

    Rows with a null label, a null vector or a null or non-finite component take no part. Vectors of different lengths
    do not meet; empty ones score 0. A row with a null id is no anchor, comes last among equal scores, and has a null id
    in the result. Rows that repeat an id are rows of their own. Components so large that scores leave 64 bits raise an
    error. An empty table gives no rows. Only the three named columns are read.
    """
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.col("label").isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).alias("label"))
    rows = rows.where(sound).select(
        "vec_id", "label", F.size("embedding").alias("dims"), F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale)))).alias("values")
    )
    span = rows.agg(F.min(F.array_min("values")), F.max(F.array_max("values")), F.max("dims")).first()
    planes = planes_for(span[0] or 0, span[1] or 0, span[2] or 1)

    def packed(values: pd.Series) -> pd.Series:
        return pd.Series([pack(np.asarray(x, np.int64).reshape(1, -1), planes).tobytes() for x in values], dtype=object)

    coded = rows.select(
        F.monotonically_increasing_id().alias("rid"),
        F.coalesce("vec_id", F.lit(LAST)).alias("place"),
        "label",
        "dims",
        F.coalesce(F.col("vec_id") % every == 0, F.lit(False)).alias("is_anchor"),
        F.pandas_udf(packed, "binary")("values").alias("code"),
    )
    coded = materialize(coded, "negatives-coded")
    here = ["dims", "label"]
    sizes = coded.groupBy(*here).agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("m"))
    sizes = sizes.where("m > 0").select(*here, _blocks(F.col("m"), ANCHORS).alias("a_blocks"), _blocks(F.col("n"), ROWS).alias("r_blocks"))
    near = coded.join(sizes, here)
    nearest = _meet(near.where("is_anchor"), near, here, _nearest(planes, positives), "anchor long, other long, place long, score long")
    chosen = materialize(_first(nearest, ["anchor"], positives), "negatives-positives")

    wanted = chosen.groupBy("anchor").agg(F.collect_set("score").alias("positives"))
    anchors = coded.where("is_anchor").join(wanted.withColumnRenamed("anchor", "rid"), "rid")
    totals = coded.groupBy("dims").agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("m")).where("m > 0")
    totals = totals.select("dims", _blocks(F.col("m"), ANCHORS).alias("a_blocks"), _blocks(F.col("n"), ROWS).alias("r_blocks"))
    find, schema = _within(planes, negatives, LOW, HIGH), "anchor long, positive long, other long, place long, score long"
    within = _meet(anchors.join(totals, "dims"), coded.join(totals, "dims"), ["dims"], find, schema)
    best = _first(within, ["anchor", "positive"], negatives).select(
        "anchor", F.col("positive").alias("positive_score"), F.col("place").alias("negative"), "rank", F.col("score").alias("negative_score")
    )
    of = chosen.select("anchor", F.col("place").alias("positive"), F.col("score").alias("positive_score"))
    names = coded.where("is_anchor").select(F.col("rid").alias("anchor"), F.col("place").alias("anchor_id"))
    found = of.join(best, ["anchor", "positive_score"]).join(names, "anchor")
    return found.select(
        "anchor_id",
        F.nullif("positive", F.lit(LAST)).alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.nullif("negative", F.lit(LAST)).alias("negative_id"),
        "positive_score",
        "negative_score",
    )
