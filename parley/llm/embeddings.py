"""Near-duplicate embeddings by randomised-rotation binary codes.

A vector is rotated at random and its signs are its code; stored with it is how well the code points along the
vector (the correction factor). The product of a code with another rotated vector, divided by the factor, is an
unbiased estimate of their cosine with a known confidence bound. Pairs whose upper bound stays below the threshold
are dropped; the others are computed exactly in double precision, and that value alone decides.

Pairs are met in tables of random hyperplanes: a table's key is a few signs, and the number of signs and of tables
follows from the size of the largest label, so that a pair at the threshold shares no table with a probability of
``miss`` at most and buckets stay small. A pair counts in the first table that it shares. Equal vectors are one
weighted row, and a large bucket is split into blocks that are compared two at a time, so that no task and no row of
output grows with the number of pairs: a block gives a count and a local root for each of its vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm._shared import connected_components, materialize

THRESHOLD, MISS, SEED = 0.93, 1e-4, 42
#: Vectors that a bucket should hold, and vectors above which it is split.
BUCKET, BLOCK = 256, 2048
#: Width of the confidence bound in standard errors, and bits of a quantised vector.
ERRORS, QUERY_BITS = 4.0, 6


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix over the dimensions, filled up to a multiple of 64."""
    wide = -(-dims // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng([SEED, dims]).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:dims]


def encode(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign codes (64 bits a word) and correction factors of rotated unit vectors."""
    factors = np.abs(rotated).sum(axis=1) / math.sqrt(rotated.shape[1])
    return np.packbits(rotated > 0, axis=1, bitorder="little").view("<u8"), factors


def estimate(codes: np.ndarray, factors: np.ndarray, rotated: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the cosines between coded vectors (rows) and rotated unit vectors (columns).

    The latter are quantised to ``QUERY_BITS`` bits a dimension with random rounding, and the products are counts
    of common bits.
    """
    wide = rotated.shape[1]
    low, high = rotated.min(axis=1, keepdims=True), rotated.max(axis=1, keepdims=True)
    step = np.maximum((high - low) / ((1 << QUERY_BITS) - 1), 1e-12)
    noise = np.random.default_rng(SEED).random(rotated.shape)
    levels = np.clip(np.floor((rotated - low) / step + noise), 0, (1 << QUERY_BITS) - 1).astype(np.uint8)
    common = np.zeros((len(codes), len(rotated)), np.int64)
    for bit in range(QUERY_BITS):
        plane = np.packbits((levels >> bit) & 1, axis=1, bitorder="little").view("<u8")
        for word in range(codes.shape[1]):
            common += np.bitwise_count(codes[:, word, None] & plane[None, :, word]).astype(np.int64) << bit
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)[:, None]
    total = levels.sum(axis=1, dtype=np.int64)[None]
    # sum over dimensions of sign * (low + step * level), where sign is 2 * bit - 1
    dot = low.T * (2 * ones - wide) + step.T * (2 * common - total)
    return dot / math.sqrt(wide) / factors[:, None]


def bound(factors: np.ndarray, wide: int) -> np.ndarray:
    """Half the width of the confidence interval for each coded vector."""
    return ERRORS * np.sqrt(np.maximum(0, 1 - factors**2)) / factors / math.sqrt(max(1, wide - 1))


def tables_for(largest: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Signs in a key and number of tables for a label of ``largest`` vectors."""
    signs = max(1, math.ceil(math.log2(max(2, largest) / BUCKET)))
    both = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, max(1, math.ceil(math.log(miss) / math.log1p(-both)))


def _unit(vectors: pd.Series) -> np.ndarray:
    found = np.stack([np.asarray(v, np.float64) for v in vectors])
    # by a power of two, which is exact, so that squares of huge and tiny components stay in range
    _, exponent = np.frexp(np.abs(found).max(axis=1, keepdims=True))
    found = np.ldexp(found, -exponent)
    return found / np.sqrt((found * found).sum(axis=1, keepdims=True))


def _coder(signs: int, tables: int) -> Callable[[pd.Series], pd.DataFrame]:
    def code(vectors: pd.Series) -> pd.DataFrame:
        keys: list = [None] * len(vectors)
        codes: list = [None] * len(vectors)
        factors = np.zeros(len(vectors))
        dims = vectors.map(len).to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            unit = _unit(vectors.iloc[at])
            own, factors[at] = encode(unit @ rotation(d))
            planes = np.random.default_rng([SEED, d, 1]).standard_normal((d, tables * signs))
            bits = (unit @ planes > 0).reshape(len(at), tables, signs)
            key = bits @ (1 << np.arange(signs))
            for k, i in enumerate(at):
                keys[i], codes[i] = key[k].tolist(), own[k].tobytes()
        return pd.DataFrame({"keys": keys, "code": codes, "factor": factors})

    return code


def _roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place that each place reaches over the pairs."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _linker(threshold: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def link(rows: pd.DataFrame) -> pd.DataFrame:
        first, second, table = rows["first"].iloc[0], rows["second"].iloc[0], int(rows["table"].iloc[0])
        rows = rows.sort_values("rid", ignore_index=True)
        unit = _unit(rows["embedding"])
        rotated = unit @ rotation(unit.shape[1])
        codes = np.stack([np.frombuffer(c, "<u8") for c in rows["code"]])
        factors, weight = rows["factor"].to_numpy(), rows["weight"].to_numpy()
        keys, block = np.stack(rows["keys"]), rows["block"].to_numpy()
        left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
        links, pairs = np.zeros(len(rows), np.int64), []
        for at in range(0, len(left), 512):
            some = left[at : at + 512]
            high = estimate(codes[some], factors[some], rotated[right]) + bound(factors[some], rotated.shape[1])[:, None]
            i, j = np.nonzero(high >= threshold)
            i, j = some[i], right[j]
            if first == second:
                i, j = i[i < j], j[i < j]
            for part in range(0, len(i), 1 << 17):
                a, b = i[part : part + (1 << 17)], j[part : part + (1 << 17)]
                exact = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
                earlier = (keys[a, :table] == keys[b, :table]).any(axis=1)
                a, b = a[exact & ~earlier], b[exact & ~earlier]
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                # a spanning forest of what was found is enough for the components
                pairs = [np.concatenate(x) for x in zip((a, b), *([pairs] if pairs else []), strict=True)]
                root = _roots(len(rows), *pairs)
                pairs = [np.flatnonzero(root != np.arange(len(rows))), root[root != np.arange(len(rows))]]
        rid = rows["rid"].to_numpy()
        root = _roots(len(rows), *pairs) if pairs else np.arange(len(rows))
        return pd.DataFrame({"rid": rid, "links": links, "root": rid[root]})[links > 0]

    return link


def link_embeddings(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
    miss: float = MISS,
) -> DataFrame:
    """Links of every row of ``vectors`` to rows with an equal label and a cosine of ``threshold`` at least.

    Columns: ``vec_id``; ``n_links`` (other rows linked directly); ``component_id`` (the smallest id reachable,
    itself included); ``kept`` (whether that is its own). Rows with a null label and vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, as do vectors of different lengths. Rows that
    repeat a vector link with each other, whatever their ids. A null id is never the smallest, and not kept beside
    others. An empty table gives no rows. Only the three named columns are read.
    """
    v = F.col("embedding")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(
        F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label")
    ).withColumn("sound", F.coalesce(sound & F.col("label").isNotNull(), F.lit(False)))
    distinct = rows.where("sound").groupBy("label", "embedding").agg(
        F.count("*").alias("weight"), F.min("vec_id").alias("least")
    )
    distinct = materialize(distinct.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    largest = distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    signs, tables = tables_for(largest, threshold, miss)
    coder = F.pandas_udf(_coder(signs, tables), "keys array<long>, code binary, factor double")
    coded = distinct.withColumn("c", coder("embedding"))
    coded = materialize(coded.select("rid", "label", "weight", "embedding", "c.keys", "c.code", "c.factor"), "vector-codes")
    bucket = ["label", "dims", "table", "key"]
    slots = coded.select("*", F.size("embedding").alias("dims"), F.posexplode("keys").alias("table", "key"))
    crowded = slots.groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    dealt = slots.join(crowded, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other)
    dealt = dealt.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    found = dealt.groupBy(*bucket, "first", "second").applyInPandas(_linker(threshold), "rid long, links long, root long")
    found = materialize(found, "vector-links")
    groups = connected_components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")), "vector-groups")
    counts = found.groupBy("rid").agg(F.sum("links").alias("links"))
    known = distinct.join(counts, "rid", "left").join(groups, distinct.rid == groups.node, "left")
    known = known.select("label", "embedding", "weight", "least", "links", F.coalesce("root", "rid").alias("root"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select(
        "label",
        "embedding",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        "component_id",
        F.lit(True).alias("sound"),
    )
    linked = rows.join(known, ["label", "embedding", "sound"], "left")
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id"))
    return linked.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
