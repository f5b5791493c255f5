"""Best-fit packing of documents into training sequences under conflicts.

A sequence (bin) holds ``capacity`` words, at most one document of each source and at most one of each cluster of
duplicates. Documents longer than a bin are cut into full pieces and a rest. Pieces go, the largest first, into the
bin with the least room that still takes them: the bins are kept in the order of their room, and the search goes
on to the next larger room until a bin without a conflict is found; if there is none, a bin is opened.

Packing is sequential, so the pieces are dealt by a hash into groups of bounded size, and each group is packed on
its own. A group is large next to a bin, so that what its last bins leave empty is small.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm._shared import materialize

CAPACITY = 2048
#: Pieces in a group, on average.
GROUP_PIECES = 4000
#: Group number and bin number within the group share a long.
GROUP_SHIFT = 32


class Bins:
    """Open bins by their room. Sources and clusters are bits of two bitmaps per bin."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.rooms = 0  # bit r is set if a bin has room r
        self.by_room: dict[int, dict[int, list[int]]] = {}  # room, bitmap of sources, bins
        self.clusters: list[int] = []
        self.used: list[int] = []

    def _put(self, number: int, room: int, sources: int) -> None:
        self.by_room.setdefault(room, {}).setdefault(sources, []).append(number)
        self.rooms |= 1 << room

    def _tightest(self, size: int, source: int, cluster: int) -> tuple[int, int, int, int] | None:
        """Room, sources, place and number of the first compatible bin in the order of room."""
        left = self.rooms >> size
        room = size
        while left:
            step = (left & -left).bit_length() - 1
            room, left = room + step, left >> step
            for sources, numbers in self.by_room[room].items():
                if sources & source:
                    continue
                for place, number in enumerate(numbers):
                    if not self.clusters[number] & cluster:
                        return room, sources, place, number
            room, left = room + 1, left >> 1
        return None

    def add(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Number of the bin that takes the piece, and the piece's offset in it."""
        found = self._tightest(size, source, cluster)
        if found is None:
            number, room, sources = len(self.used), self.capacity, 0
            self.used.append(0)
            self.clusters.append(0)
        else:
            room, sources, place, number = found
            numbers = self.by_room[room][sources]
            numbers[place] = numbers[-1]
            numbers.pop()
            if not numbers:
                del self.by_room[room][sources]
                if not self.by_room[room]:
                    del self.by_room[room]
                    self.rooms ^= 1 << room
        offset = self.used[number]
        self.used[number] += size
        self.clusters[number] |= cluster
        self._put(number, room - size, sources | source)
        return number, offset


def _bits(values: pd.Series) -> list[int]:
    """A bit for each distinct value; null conflicts with nothing."""
    codes, _ = pd.factorize(values)
    return [1 << int(code) if code >= 0 else 0 for code in codes]


def _alone(values: pd.Series) -> pd.Series:
    """Values that occur once cannot conflict: null."""
    return values.where(values.duplicated(keep=False))


def pack_documents(
    docs: DataFrame,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cluster_col: str | None = None,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Where every piece of every row of ``docs`` goes: at least one output row per input row.

    Columns: ``doc_id``; ``piece`` and ``n_pieces``; ``n_words`` (of the piece; words are separated by white
    space); ``first_word`` (where the piece begins in the document); ``bin_id``; ``bin_offset``; ``group``.
    ``cluster_col`` names the cluster of duplicates; by default equal texts are one. A null source conflicts with
    nothing. A null or blank text is one piece of no words. Rows that repeat a text are each packed, in different
    bins. Pieces of equal size go in the order of ids (null first), text hashes and places. The tightest bin is searched
    in the piece's own group, of ``group_pieces`` pieces on average. An empty table gives no rows.
    Only the named columns are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    text_hash = F.xxhash64(text)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.size(F.regexp_extract_all(text, F.lit(r"\S+"), 0)).cast("long").alias("words"),
        F.col(source_col).cast("string").alias("source"),
        (text_hash if cluster_col is None else F.xxhash64(cluster_col)).alias("cluster"),
        text_hash.alias("text_hash"),
    )
    n_pieces = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("words") / capacity))
    rows = materialize(rows.withColumn("n_pieces", n_pieces), "packing-rows")
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_pieces") - 1)))
    pieces = pieces.withColumn("first_word", F.col("piece") * capacity)
    pieces = pieces.withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("first_word")))
    # pieces of a text that repeats are dealt apart as well, so that no group fills with one cluster
    groups = max(1, (rows.agg(F.sum("n_pieces")).first()[0] or 0) // group_pieces)
    deal = F.pmod(F.xxhash64("doc_id", "piece", "text_hash"), F.lit(groups)).cast("int")
    pieces = pieces.select(
        "doc_id", "piece", "n_pieces", "n_words", "first_word", "source", "cluster", "text_hash", deal.alias("group")
    )

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(size=-group["n_words"]).sort_values(["size", "doc_id", "text_hash", "piece"], na_position="first")
        sources, clusters = _bits(group["source"]), _bits(_alone(group["cluster"]))
        bins = Bins(capacity)
        placed = [bins.add(*x) for x in zip(group["n_words"].tolist(), sources, clusters, strict=True)]
        group = group.assign(bin_id=[b for b, _ in placed], bin_offset=[o for _, o in placed])
        group["bin_id"] += group["group"].astype("int64") * (1 << GROUP_SHIFT)
        return group[["doc_id", "piece", "n_pieces", "n_words", "first_word", "bin_id", "bin_offset", "group"]]

    schema = (
        f"doc_id {dict(rows.dtypes)['doc_id']}, piece long, n_pieces long, n_words long, first_word long, "
        "bin_id long, bin_offset long, group int"
    )
    return pieces.groupBy("group").applyInPandas(pack, schema)
