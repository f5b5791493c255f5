"""Candidates that repeat each other, for groups too large for one task.

Two candidates of a group are the same if they share a mark, or if their titles are similar: twice the characters that
``SequenceMatcher`` matches are ``SIMILAR`` of both titles' lengths at least. Matched characters are common to both
titles, whatever their order, so the characters in common bound the ratio. Titles therefore meet only those of their own
and the neighbouring bands of lengths, a packed count of their characters drops nearly all of these, and what stays is
compared in full. (Common q-grams bound this ratio too weakly for a prefix join: two titles of 40 characters at 0.82 may
have 15 of 39 bigrams in common.)

Whether a candidate stays depends on those before it. Only candidates that repeat another take part; the first of each
group are settled in order, what they exclude goes, and so on with the rest: a round excludes by joins on marks and by
comparing titles with those just kept, so a group of many similar titles ends after one round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.numbers import round_binary
from parley.sources.scratch import discard, materialize

SIMILAR, REPEAT, MOST = 0.82, 0.03, 2
#: Titles compared with each other by one task; candidates settled in the first round and in a round at most.
BLOCK, FIRST, ROUND = 8192, 512, 16384
#: Titles that are compared before the others are looked at.
AHEAD = 64
#: Titles of lengths a and b can be similar only if the shorter has this share of the longer's length.
SHORTER = SIMILAR / (2 - SIMILAR)
TITLE = "title "

_LETTERS = {"etaoinsr": 6, " ": 8, "0123456789": 8, "ldcumphg": 4}


def _signature_bits() -> tuple[np.ndarray, np.ndarray]:
    """First bit and number of bits of each character's class; all of them make 128 bits."""
    first, size, at = np.zeros(129, np.int64), np.zeros(129, np.int64), 0
    rest = sorted({chr(c) for c in range(97, 123)} - set("".join(_LETTERS)))
    classes = [(c, n) for s, n in _LETTERS.items() for c in ([s] if s.startswith("0") else s)] + [(c, 2) for c in rest]
    other = 128 - sum(n for _, n in classes)
    first[:], size[:] = 128 - other, other
    for chars, n in classes:
        for c in chars:
            first[ord(c)], size[ord(c)] = at, n
        at += n
    return first, size


_FIRST, _SIZE = _signature_bits()


class Titles:
    """Titles with what bounds their similarity: characters by class in unary (128 bits) and hashed pairs of neighbours (512 bits).

    ``spare`` counts what found no bit of its own, so what two titles have in common is at most the bits that both have
    and the smaller spare.
    """

    def __init__(self, titles: list[str]):
        self.titles, n = titles, len(titles)
        self.lengths = np.array([len(t) for t in titles], np.int32)
        points = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        row = np.repeat(np.arange(n), self.lengths)
        kind = _FIRST[np.minimum(points, 128)]
        counts = np.bincount(row * 128 + kind, minlength=n * 128).reshape(n, 128)
        held = np.minimum(counts, _ROOM[:128])
        self.spare = (counts - held).sum(axis=1, dtype=np.int32)
        bits = np.zeros((n, 128), bool)
        for start in np.unique(_FIRST):
            for k in range(_ROOM[start]):
                bits[:, start + k] = held[:, start] > k
        self.bits = np.ascontiguousarray(np.packbits(bits, axis=1).view("<u8").T)  # a word of all titles in a row
        pair = ((points[:-1] * 31 + points[1:]) * 0x9E3779B1 >> 7) % 512
        inside = row[:-1] == row[1:]
        pairs = np.zeros((n, 512), bool)
        pairs[row[:-1][inside], pair[inside]] = True
        self.pair_spare = np.maximum(self.lengths - 1, 0) - pairs.sum(axis=1)
        self.pairs = np.packbits(pairs, axis=1).view("<u8")

    def close(self, i: int, others: Titles, among: np.ndarray | slice = slice(None)) -> Iterator[int]:
        """Places of the titles that title ``i`` may be similar to, the ``AHEAD`` closest by their characters first.

        ``m`` matched characters lie in at most one block more than there are unmatched ones, and a block of ``k``
        characters has ``k - 1`` pairs, so of ``both`` characters ``3 m - both - 1`` pairs are common.
        """
        both = others.lengths[among] + self.lengths[i]
        common = np.minimum(others.spare[among], self.spare[i])
        for word, other in zip(self.bits[:, i], others.bits, strict=True):
            common += np.bitwise_count(other[among] & word)
        at = np.flatnonzero(common >= np.float32(SIMILAR / 2 - 1e-6) * both)
        if len(at) > AHEAD:
            at = at[np.argpartition(-common[at] / np.maximum(both[at], 1), AHEAD)]
        places = np.arange(len(others.titles))[among]
        for some in (at[:AHEAD], at[AHEAD:]):
            near = places[some]
            pairs = np.bitwise_count(self.pairs[i] & others.pairs[near]).sum(axis=1, dtype=np.int64) + np.minimum(self.pair_spare[i], others.pair_spare[near])
            yield from near[pairs >= (1.5 * SIMILAR - 1) * both[some] - 1 - 1e-9].tolist()


_ROOM = np.zeros(129, np.int64)
_ROOM[_FIRST] = _SIZE


def similar(one: str, two: str) -> bool:
    match = SequenceMatcher(None, one, two)
    return match.real_quick_ratio() >= SIMILAR and match.quick_ratio() >= SIMILAR and match.ratio() >= SIMILAR


def matches(own: list[str], others: list[str], most: int, both_ways: bool = False) -> tuple[list[list[int]], list[bool]]:
    """For each title, the places of ``most`` other titles that it is similar to, and whether any is (``both_ways``: or to it).

    Equal titles are left out. What comes after ``most`` is not compared.
    """
    asked, held = Titles(own), Titles(others)
    found: list[list[int]] = []
    linked: list[bool] = []
    for i, title in enumerate(own):
        here, some = [], False
        for j in asked.close(i, held):
            if len(here) == most:
                break
            other = others[j]
            if other == title:
                continue
            if similar(title, other):
                here.append(j)
            some = some or bool(here) or (both_ways and similar(other, title))
        found.append(here)
        linked.append(some)
    return found, linked


def _band(title: Column) -> Column:
    """Lengths by a geometric series: titles two bands apart cannot be similar."""
    return F.floor(F.log(F.greatest(F.length(title), F.lit(1)).cast("double")) / -float(np.log(SHORTER)) + 1e-9).cast("int")


def _compare(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
    if not len(asked) or not len(held):
        return pd.DataFrame({"tid": [], "near": [], "linked": []})
    found, linked = matches(asked["title"].tolist(), held["title"].tolist(), MOST, both_ways=True)
    ids = held["tid"].tolist()
    rows = pd.DataFrame({"tid": asked["tid"], "near": [[ids[j] for j in f] for f in found], "linked": linked})
    return rows[rows["linked"]]


def _cogroup(one: DataFrame, two: DataFrame, on: list[str], function: Callable, schema: str) -> DataFrame:
    """A cogroup whose groups are spread over all shuffle partitions: they are few bytes and much work, so they are not coalesced."""
    tasks = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one, two = (t.select(*[F.col(c).alias(c) for c in t.columns]).repartition(tasks, *on).groupBy(*on) for t in (one, two))
    return one.cogroup(two).applyInPandas(function, schema)


def near_titles(titles: DataFrame, keys: list[str]) -> DataFrame:
    """``tid``, ``near`` (ids of two titles of its group at most that it is similar to) and ``linked`` (whether any is, or is to it).

    ``titles`` has ``keys``, ``tid`` and distinct ``title``. Titles that are like no other are not returned. A block of
    titles is compared with itself first; only those with fewer than two similar ones go on to other blocks.
    """
    schema = "tid long, near array<long>, linked boolean"
    titles = titles.withColumn("band", _band(F.col("title")))
    blocks = titles.groupBy(*keys, "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    titles = materialize(titles.join(blocks, [*keys, "band"]).withColumn("block", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int")), "titles")

    def meet(asked: DataFrame, held: DataFrame, on: list[str]) -> DataFrame:
        return _cogroup(asked, held, on, _compare, schema)

    place = [*keys, "band", "block"]
    inside = titles.select(*place, "tid", "title")
    first = materialize(meet(inside, inside, place), "titles-near")
    done = first.where(F.size("near") >= MOST).select("tid")
    asked = titles.join(done, "tid", "left_anti")
    # every block within reach of a block, but itself
    here = asked.groupBy(*place).count().drop("count")
    there = blocks.select(*keys, F.col("band").alias("to_band"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to_block"))
    reach = here.join(there, keys).where("abs(band - to_band) <= 1 AND (band != to_band OR block != to_block)")
    out = asked.join(reach, place).select(*place, "to_band", "to_block", "tid", "title")
    back = titles.select(*keys, F.col("band").alias("to_band"), F.col("block").alias("to_block"), "tid", "title").join(reach, [*keys, "to_band", "to_block"])
    second = meet(out, back.select(*place, "to_band", "to_block", "tid", "title"), [*place, "to_band", "to_block"])
    both = materialize(first.unionAll(second).groupBy("tid").agg(F.flatten(F.collect_list("near")).alias("near"), F.max("linked").alias("linked")), "titles-linked")
    discard(titles, first)
    return both.withColumn("near", F.slice(F.array_distinct("near"), 1, MOST))


def _settle(keys: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The first candidates of a group, in order: who stays."""

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at", ignore_index=True)
        seen: set[str] = set()
        own = Titles([m[-1][len(TITLE) :] for m in rows["marks"]])
        kept = np.zeros(0, np.int64)
        for i, marks in enumerate(rows["marks"]):
            if seen.isdisjoint(marks) and not any(similar(own.titles[i], own.titles[j]) for j in own.close(i, own, kept)):
                seen.update(marks)
                kept = np.append(kept, i)
        return rows.iloc[kept][["cid"]]

    return settle


def _excluded(rest: pd.DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
    if not len(rest) or not len(kept):
        return pd.DataFrame({"cid": []}, dtype="int64")
    own = rest["title"].unique().tolist()
    gone = {t for t, some in zip(own, matches(own, kept["title"].unique().tolist(), 1)[1], strict=True) if some}
    return rest.loc[rest["title"].isin(gone), ["cid"]]


def _keep_in_order(linked: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``cid`` of the candidates that stay, in rounds over tables in the shared folder."""
    active, kept, size = materialize(linked, "linked"), None, FIRST
    while not active.isEmpty():
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        front = active.withColumn("at", place).where(F.col("at") <= size)
        stay = front.groupBy(*keys).applyInPandas(_settle(keys), "cid long")
        front = materialize(front.join(stay.withColumn("stays", F.lit(True)), "cid", "left"), "front")
        new = front.where("stays").select(*keys, "cid", "marks")
        kept = new.select("cid") if kept is None else kept.unionAll(new.select("cid"))
        rest = active.join(front.select("cid"), "cid", "left_anti")
        taken = new.select(*keys, F.explode("marks").alias("mark")).distinct()
        by_mark = rest.select(*keys, "cid", F.explode("marks").alias("mark")).join(taken, [*keys, "mark"], "left_semi").select("cid")
        rest = materialize(rest.join(by_mark, "cid", "left_anti"), "rest")
        title = F.substring(F.element_at("marks", -1), len(TITLE) + 1, 1 << 30).alias("title")
        blocks = rest.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = rest.join(blocks, keys).select(*keys, F.pmod(F.xxhash64("cid"), "blocks").cast("int").alias("block"), "cid", title)
        asked = new.join(blocks, keys).select(*keys, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), title)
        place = [*keys, "block"]
        gone = _cogroup(dealt, asked, place, _excluded, "cid long")
        before, active = active, materialize(rest.join(gone, "cid", "left_anti"), "linked")
        discard(before, rest)
        size = min(ROUND, 4 * size)
    return kept if kept is not None else active.select("cid")


def keep_distinct(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The candidates that stay, with what repetition adds to their confidence.

    ``rows`` has ``keys``, ``confidence``, ``marks`` (the last is ``TITLE`` and the lower-case title) and the columns of
    ``order``, which places candidates of equal confidence. A candidate that is the same as others gains ``REPEAT`` for
    each, two at most. In the order of their confidence, candidates stay if they are the same as none that stays. No task
    holds more than a block of titles or a round's candidates of a group. An empty table gives no rows.
    """
    rows = materialize(rows.withColumn("cid", F.monotonically_increasing_id()), "candidates")
    marks = rows.select(*keys, "cid", F.explode("marks").alias("mark"))
    first = F.row_number().over(Window.partitionBy(*keys, "mark").orderBy("cid"))
    holders = marks.withColumn("k", first).where(F.col("k") <= MOST + 2).groupBy(*keys, "mark").agg(F.array_sort(F.collect_list("cid")).alias("holders"))
    holders = materialize(holders, "marks")
    titles = holders.where(F.startswith("mark", F.lit(TITLE))).withColumn("tid", F.element_at("holders", 1))
    near = near_titles(titles.select(*keys, "tid", F.substring("mark", len(TITLE) + 1, 1 << 30).alias("title")), keys)
    of = titles.select(F.col("tid").alias("to"), F.slice("holders", 1, MOST + 1).alias("of"))
    like = near.select("tid", "linked", F.explode_outer("near").alias("to")).join(of, "to", "left")
    like = like.groupBy("tid").agg(F.max("linked").alias("linked"), F.flatten(F.collect_list("of")).alias("like"))
    like = titles.join(like, "tid").select(*keys, "mark", "like", "linked")
    shared = marks.join(holders, [*keys, "mark"]).join(like, [*keys, "mark"], "left")
    shared = shared.groupBy("cid").agg(F.flatten(F.collect_list(F.concat("holders", F.coalesce("like", F.array().cast("array<long>"))))).alias("same"), F.max("linked").alias("linked"))
    others = F.size(F.array_remove(F.array_distinct("same"), F.col("cid")))
    gain = REPEAT * F.least(F.lit(MOST), others)
    score = round_binary(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence") + gain)), 4)
    scored = rows.join(shared, "cid").withColumns({"confidence": score, "linked": F.coalesce("linked", F.lit(False)) | (others > 0)}).drop("same")
    scored = materialize(scored, "scored")
    kept = _keep_in_order(scored.where("linked").select(*keys, "cid", "marks", "confidence", *order), keys, [F.desc("confidence"), *order, F.col("cid")])
    discard(rows, holders)
    return scored.where("NOT linked").unionAll(scored.join(kept, "cid", "left_semi").select(*scored.columns)).drop("cid", "linked", "marks")
