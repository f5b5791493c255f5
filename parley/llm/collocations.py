"""Collocations counted in counting quotient filters.

Texts are cut into shards of bounded size. A shard lists its own words with their counts, so the words of the corpus are
counted from lists, and only words that are frequent enough to be part of a candidate get a number. Phrases of two and
three numbered words are packed into keys and permuted invertibly: the first part of the permuted key is its quotient,
the rest its whole remainder, so a filter is lossless. A filter holds the remainders in the order of their quotients, the
length of each quotient's run in unary, and the counts above one. A shard's filter is dealt out by ranges of quotients;
filters of one range are merged in sorted order, and frequent keys are turned back into words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm._shared import materialize

#: Occurrences of a candidate; share in percent of a longer candidate that drops it; rows of a language in the result.
LEAST, SHARE, TOP = 10, 50, 2000
#: Characters of a shard and phrases merged by one task, about.
SHARD, MERGED = 1 << 22, 1 << 21
#: What ends a piece, and what stands between words.
PIECE_END, SPACES = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
#: Rows for partitions up to 2 ** 33 each, as ``monotonically_increasing_id`` deals them.
ROW_BITS = 33
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in order, and whether each is the first of its piece."""
    lower = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    pieces = pc.split_pattern_regex(lower, PIECE_END).flatten()
    words = pc.split_pattern_regex(pieces, SPACES)
    piece = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
    words = words.flatten()
    held = pc.not_equal(words, "")
    piece = piece[held.to_numpy(zero_copy_only=False)]
    return words.filter(held), np.append(True, piece[1:] != piece[:-1])[: len(piece)]


def _shard(texts: dict[str, list[pa.Array]], number: int) -> pa.RecordBatch:
    """One row: words with counts, and each text's words as places in that list from 1; 0 stands before a piece."""
    langs, listed, counts, sequence, size = [], [], [], [], 0
    for lang, arrays in texts.items():
        words, first = words_of(pa.chunked_array(arrays).combine_chunks())
        coded = words.dictionary_encode()
        places = coded.indices.to_numpy().astype(np.int64)
        part = np.zeros(len(places) + int(first.sum()), np.uint32)
        part[np.arange(len(places)) + np.cumsum(first)] = places + size + 1
        sequence.append(part)
        langs.append(pa.repeat(lang, len(coded.dictionary)))
        listed.append(coded.dictionary.cast(pa.string()))
        counts.append(np.bincount(places, minlength=len(coded.dictionary)))
        size += len(coded.dictionary)
    words = pa.StructArray.from_arrays([pa.concat_arrays(langs), pa.concat_arrays(listed), pa.array(np.concatenate(counts))], ["lang", "word", "n"])
    places = np.concatenate(sequence)
    row = [
        pa.array([number]),
        pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), words),
        pa.array([size]),
        pa.array([len(places)]),
        pa.array([pa.compress(places.tobytes(), codec="zstd", asbytes=True)]),
    ]
    return pa.RecordBatch.from_arrays(row, ["shard", "words", "size", "length", "sequence"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size, made = defaultdict(list), 0, 0
    own = TaskContext.get().partitionId() << 24
    for batch in batches:
        lengths = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy())
        start = 0
        while start < batch.num_rows:
            before = lengths[start - 1] if start else 0
            stop = min(batch.num_rows, int(np.searchsorted(lengths, before + SHARD - size)) + 1)
            part = batch.slice(start, stop - start)
            for lang in part["lang"].unique().to_pylist():
                held[lang].append(part["text"].filter(pc.equal(part["lang"], lang)))
            size, start = size + int(lengths[stop - 1] - before), stop
            if size >= SHARD:
                yield _shard(held, own + made)
                held, size, made = defaultdict(list), 0, made + 1
    if held:
        yield _shard(held, own + made)


def _mixed(x: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The upper ``bits`` of a mixed ``x``."""
    x = (x ^ (x >> np.uint64(29))) * _ODD[k]
    x = (x ^ (x >> np.uint64(32))) * _ODD[(k + 1) % 3]
    return x >> np.uint64(64 - bits)


def permute(first: np.ndarray, rest: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Quotient (``width`` bits) and remainder (twice that) of packed phrases; each half is mixed into the other."""
    first = first ^ _mixed(rest, 0, width)
    rest = rest ^ _mixed(first, 1, 2 * width)
    return first ^ _mixed(rest, 2, width), rest


def unpermute(quotient: np.ndarray, remainder: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    first = quotient ^ _mixed(remainder, 2, width)
    rest = remainder ^ _mixed(first, 1, 2 * width)
    return first ^ _mixed(rest, 0, width), rest


def merged(quotient: np.ndarray, remainder: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in sorted order with the sums of their counts."""
    if not len(quotient):
        return quotient, remainder, counts
    if 3 * width <= 64:  # both in one number
        key = (quotient << np.uint64(2 * width)) | remainder
        order = np.argsort(key, kind="stable") if (counts != 1).any() else None
        key = np.sort(key) if order is None else key[order]
        new = np.append(True, key[1:] != key[:-1])
        quotient, remainder = key[new] >> np.uint64(2 * width), key[new] & np.uint64((1 << 2 * width) - 1)
    else:
        order = np.lexsort((remainder, quotient))
        quotient, remainder = quotient[order], remainder[order]
        new = np.append(True, (quotient[1:] != quotient[:-1]) | (remainder[1:] != remainder[:-1]))
        quotient, remainder = quotient[new], remainder[new]
    at = np.flatnonzero(new)
    if order is None:
        return quotient, remainder, np.diff(np.append(at, len(new)))
    return quotient, remainder, np.add.reduceat(counts[order], at)


def encode(quotient: np.ndarray, remainder: np.ndarray, counts: np.ndarray, low: int, slots: int, width: int) -> bytes:
    """A filter over ``slots`` quotients (a power of two) from ``low``: runs in unary, remainders, counts above one.

    Where slots outnumber the keys, they are joined, and the lower bits of the quotients become part of the remainders.
    """
    n, whole, odd = len(quotient), 2 * width // 8, 2 * width % 8
    joined = max(0, slots.bit_length() - max(2, n.bit_length() + 1))
    own = quotient - np.uint64(low)
    runs = np.bincount((own >> np.uint64(joined)).astype(np.int64), minlength=slots >> joined)
    unary = np.ones(n + (slots >> joined), np.uint8)
    unary[np.cumsum(runs) + np.arange(slots >> joined)] = 0
    parts = [np.array([n, joined], "<u4").tobytes(), np.packbits(unary).tobytes(), remainder.view(np.uint8).reshape(n, 8)[:, :whole].tobytes()]
    rest = ((own & np.uint64((1 << joined) - 1)) << np.uint64(odd)) | (remainder >> np.uint64(8 * whole) if odd else np.uint64(0))
    bits = (rest[:, None] >> np.arange(joined + odd, dtype=np.uint64)) & np.uint64(1)
    many = counts > 1
    parts += [np.packbits(bits.astype(np.uint8)).tobytes(), np.packbits(many).tobytes()]
    parts.append(counts[many].astype("<u4" if counts.max(initial=0) < 1 << 32 else "<u8").tobytes())
    return b"".join(parts)


def decode(data: bytes, low: int, slots: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted keys and counts that ``encode`` was given."""
    n, joined = (int(x) for x in np.frombuffer(data, "<u4", 2))
    whole, odd, at, runs_in = 2 * width // 8, 2 * width % 8, 8, slots >> joined

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(data, np.uint8, size, at - size)

    def bits_of(rows: int, columns: int) -> np.ndarray:
        return np.unpackbits(take(-(-rows * columns // 8)), count=rows * columns).reshape(rows, columns)

    ends = np.flatnonzero(bits_of(1, n + runs_in)[0] == 0)
    slot = np.repeat(np.arange(runs_in, dtype=np.uint64), np.diff(ends - np.arange(runs_in), prepend=0))
    held = np.zeros((n, 8), np.uint8)
    held[:, :whole] = take(n * whole).reshape(n, whole)
    remainder = held.view("<u8").reshape(n).astype(np.uint64)
    rest = (bits_of(n, joined + odd).astype(np.uint64) << np.arange(joined + odd, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    if odd:
        remainder |= (rest & np.uint64((1 << odd) - 1)) << np.uint64(8 * whole)
    quotient = np.uint64(low) + (slot << np.uint64(joined)) + (rest >> np.uint64(odd))
    many = bits_of(1, n)[0].astype(bool)
    counts = np.ones(n, np.int64)
    counts[many] = np.frombuffer(data, "<u4" if len(data) - at == 4 * many.sum() else "<u8", offset=at)
    return quotient, remainder, counts


def phrases(numbers: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed phrases of two and three numbered words that stand together: the first word, and the others (third: 0)."""
    numbers = numbers.astype(np.uint64)
    two = (numbers[:-1] > 0) & (numbers[1:] > 0)
    three = two[:-1] & two[1:]
    pairs = numbers[1:] << np.uint64(width)
    return (
        np.concatenate([numbers[:-1][two], numbers[:-2][three]]),
        np.concatenate([pairs[two], pairs[:-1][three] | numbers[2:][three]]),
    )


def _filters(width: int, block_bits: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    slots = 1 << width - block_bits

    def make(shards: pd.DataFrame, numbers: pd.DataFrame) -> pd.DataFrame:
        found = {"block": [], "filter": []}
        for size, length, sequence in zip(shards["size"], shards["length"], shards["sequence"], strict=True):
            number = np.zeros(size + 1, np.uint64)
            number[numbers["place"].to_numpy() + 1] = numbers["number"].to_numpy()
            places = np.frombuffer(pa.decompress(sequence, 4 * length, codec="zstd"), np.uint32)
            quotient, remainder = permute(*phrases(number[places], width), width)
            quotient, remainder, counts = merged(quotient, remainder, np.ones(len(quotient), np.int64), width)
            block = quotient >> np.uint64(width - block_bits)
            ends = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)) if len(block) else []
            start = 0
            for end in ends:
                own = int(block[start])
                found["block"].append(own)
                found["filter"].append(encode(quotient[start:end], remainder[start:end], counts[start:end], own * slots, slots, width))
                start = end
        return pd.DataFrame(found)

    return make


def _frequent(width: int, block_bits: int, least: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    slots = 1 << width - block_bits

    def merge(filters: pd.DataFrame) -> pd.DataFrame:
        low = int(filters["block"].iloc[0]) * slots
        parts = [decode(data, low, slots, width) for data in filters["filter"]]
        quotient, remainder, counts = merged(*[np.concatenate(x) for x in zip(*parts, strict=True)], width)
        enough = counts >= least
        first, rest = unpermute(quotient[enough], remainder[enough], width)
        second, third = rest >> np.uint64(width), rest & np.uint64((1 << width) - 1)
        return pd.DataFrame({"w1": first, "w2": second, "w3": third, "a": counts[enough]}).astype("int64")

    return merge


def numbered(counts: DataFrame) -> tuple[DataFrame, int]:
    """``counts`` with a ``number`` from 1, without gaps, and how many there are.

    Rows are numbered within their partitions; the driver gets one count for each partition.
    """
    rows = materialize(counts.withColumn("row", F.monotonically_increasing_id()), "phrase-words")
    sizes = rows.groupBy(F.shiftright("row", ROW_BITS).alias("part")).count().orderBy("part").collect()
    starts = np.cumsum([0, *[r["count"] for r in sizes]])
    offsets = rows.sparkSession.createDataFrame([(r["part"], int(s)) for r, s in zip(sizes, starts)], "part long, start long")
    rows = rows.withColumn("part", F.shiftright("row", ROW_BITS)).join(F.broadcast(offsets), "part")
    within = F.col("row").bitwiseAND((1 << ROW_BITS) - 1)
    return rows.withColumn("number", within + F.col("start") + 1).drop("row", "part", "start"), int(starts[-1])


def association(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)), exact for counts below 10 ** 16."""
    whole = a.cast("decimal(16,0)")
    above = whole * whole * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", above, left.cast("decimal(19,0)") * right.cast("decimal(19,0)"))


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (``number``, ``lang``, ``word``, ``f``), phrases (``w1``, ``w2``, ``w3`` or 0, ``a``) and the words of each language.

    ``docs`` has ``lang`` and ``text`` without nulls. Words and phrases occur ``least`` times in their language.
    """
    shards = materialize(docs.select("lang", "text").mapInArrow(_shards, "shard long, words array<struct<lang:string,word:string,n:long>>, size long, length long, sequence binary"), "phrase-shards")
    listed = shards.select("shard", F.posexplode("words").alias("place", "of")).select("shard", "place", "of.*")
    sizes = listed.groupBy("lang").agg(F.sum("n").alias("n"))
    counts = listed.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words, number_of_words = numbered(counts)
    width = max(2, number_of_words.bit_length())
    total = shards.select(F.aggregate("words", F.lit(0).cast("long"), lambda t, w: t + w.n).alias("n")).agg(F.sum("n")).first()[0] or 0
    block_bits = min(width, max(0, (2 * total // MERGED).bit_length()))
    numbers = listed.join(words, ["lang", "word"]).select(F.col("shard").alias("of"), "place", "number")
    filters = shards.select("shard", "size", "length", "sequence").groupBy("shard").cogroup(numbers.groupBy("of")).applyInPandas(
        _filters(width, block_bits), "block long, filter binary"
    )
    found = filters.groupBy("block").applyInPandas(_frequent(width, block_bits, least), "w1 long, w2 long, w3 long, a long")
    return materialize(words, "phrase-numbers"), materialize(found, "phrases"), sizes


def mine_collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, share: int = SHARE, top: int = TOP
) -> DataFrame:
    """The ``top`` phrases of two and three words of each language by association: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A-Z are lower-cased; ``.,;:!?`` and line ends end a piece, spaces and tabs stand between words, and a phrase lies
    within a piece. ``a`` counts a phrase, ``l`` and ``r`` its parts at the cut with the lowest score (the first among
    equals), ``n`` all words of the language; the score is ``floor(1000000 a a / (l r))``. Phrases with ``a`` under
    ``least`` are no candidates; those inside a longer candidate with ``share`` percent of their count are dropped. Ties
    go to the larger ``a``, then to the first phrase in byte order.

    A null text is empty, a null language ``und``; a text without words adds nothing; repeated rows count each time. Very
    long texts are counted whole, in a shard of their own. An empty table gives no rows. Only the two named columns are
    read.
    """
    text = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words, found, sizes = frequent_phrases(text, least)

    def word(k: int) -> DataFrame:
        return words.select(F.col("number").alias(f"w{k}"), F.col("word").alias(f"word{k}"), F.col("f").alias(f"f{k}"), *(["lang"] if k == 1 else []))

    pairs = found.where("w3 = 0").select("w1", "w2", "a")
    triples = found.where("w3 > 0")
    left = pairs.select("w1", "w2", F.col("a").alias("f12"))
    right = pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23"))
    inside = triples.select(F.explode(F.array(F.struct("w1", "w2", "a"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))).alias("p"))
    inside = inside.groupBy("p.w1", "p.w2").agg(F.max("p.a").alias("longer"))
    two = pairs.join(inside, ["w1", "w2"], "left").where(f"longer IS NULL OR 100 * longer < {share} * a").join(word(1), "w1").join(word(2), "w2")
    two = two.select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), association(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))
    three = triples.join(left, ["w1", "w2"]).join(right, ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
    three = three.withColumn("s1", association(F.col("a"), F.col("f1"), F.col("f23"))).withColumn("s2", association(F.col("a"), F.col("f12"), F.col("f3")))
    early = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang",
        F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"),
        "a",
        F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = two.unionAll(three).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
