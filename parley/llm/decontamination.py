"""Benchmark decontamination by a prefix-filtered join of word shingles.

Items are cut into windows of ``window`` words (a shorter item is one window) and windows into shingles of
``shingle`` words. In the order of rarity over the benchmark, a window's first shingle is necessary: a document that
holds the window holds it. These prefixes alone are joined with the documents; a match in a place that leaves room
for the window makes a candidate, with the place where the item would start. Only the documents of candidates meet
all the shingles of the benchmark, which are then laid along the candidate items; a run without a gap and of a
window's length is an exact occurrence of the windows inside it.

Everything is DataFrame expressions. Shingles are compared by their hashes; what is shuffled are the places of
matching shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm._shared import ALNUM_WORD, ANY_CASE_WORD, ascii_lower, materialize

WINDOW, SHINGLE = 13, 5
#: Shingles of the benchmark up to which they are broadcast (some 20 MB); beyond, Spark joins by shuffle.
BROADCAST_ROWS = 200_000


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(ALNUM_WORD), 0)


def _shingles(words: Column, lengths: list[int]) -> Column:
    """Place and hash of every run of ``k`` words, for each ``k`` of ``lengths``."""

    def of(k: int) -> Column:
        last = F.size(words) - k
        made = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.lit(k), F.slice(words, i + 1, k)).alias("sid")))
        return F.when(last >= 0, made).otherwise(F.array().cast("array<struct<pos:int,sid:bigint>>"))

    return F.concat(*map(of, lengths))


def _same(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & left[c].eqNullSafe(right[c])
    return on


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> DataFrame:
    """How much of every row of ``docs`` lies inside windows of ``benchmark``.

    Columns: ``doc_id``; ``n_words``; ``n_hit`` (words inside an occurrence of a window); ``n_items`` (items with
    an occurring window); ``items_sha256`` (of their ids, sorted as text and comma-joined; of the empty text if
    there are none); ``contaminated`` (``n_hit`` > 0 and at least a twentieth of the words); ``text_key`` (a hash
    of the text). Null and empty texts have no words; an item without words has no window; items that share an id
    count once and an item without an id marks words but is not counted. Rows that repeat id and text get equal
    results. Without benchmark rows nothing is hit; an empty table gives no rows. Only the named columns are read.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), _words(F.col(item_text_col)).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("item", F.monotonically_increasing_id())
    items = materialize(items.withColumn("k", F.least(F.size("words"), F.lit(shingle))), "benchmark-items")
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())  # of 1 to ``shingle``
    texts = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("text_key"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"),
    )
    nothing = F.sha2(F.lit(""), 256)
    if not lengths:
        zero = F.lit(0).cast("long")
        return texts.select(
            "doc_id", "n_words", zero.alias("n_hit"), zero.alias("n_items"), nothing.alias("items_sha256"),
            F.lit(False).alias("contaminated"), "text_key",
        )
    placed = None
    for k in lengths:
        one = items.where(F.col("k") == k).select("item_id", "item", "k", F.size("words").alias("item_words"), F.explode(_shingles(F.col("words"), [k])).alias("s"))
        placed = one if placed is None else placed.unionAll(one)
    placed = placed.select("item_id", "item", "k", "item_words", F.col("s.pos").alias("at"), F.col("s.sid").alias("sid"))
    run = F.least(F.lit(window), F.col("item_words")) - F.col("k") + 1
    placed = materialize(placed.withColumn("run", run), "benchmark-shingles")

    # the rarest shingle of each window, over the benchmark
    frequency = placed.groupBy("sid").agg(F.count("*").alias("df"))
    ahead = Window.partitionBy("item").orderBy("at").rangeBetween(Window.currentRow, window - shingle)
    windows = placed.join(frequency, "sid").withColumn("in_window", F.count("df").over(ahead))
    windows = windows.withColumn("rarest", F.min(F.struct("df", "at", "sid")).over(ahead)).where("in_window = run")
    necessary = windows.select(
        "item",
        F.col("rarest.at").alias("at"),
        F.col("rarest.sid").alias("sid"),
        F.col("at").alias("first"),
        (F.col("at") + F.least(F.lit(window), F.col("item_words"))).alias("end"),
    )
    necessary = materialize(necessary, "benchmark-prefixes")

    def matches(of: DataFrame, known: DataFrame) -> DataFrame:
        """Where documents hold a shingle of ``known``; one pass over their texts."""
        known = known.select("sid").distinct()
        known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
        words = of.select("doc_id", "text_key", _words(F.col("text")).alias("words"))
        each = words.select("doc_id", "text_key", F.size("words").alias("n"), F.explode(_shingles(F.col("words"), lengths)).alias("s"))
        return each.select("doc_id", "text_key", "n", F.col("s.pos").alias("pos"), F.col("s.sid").alias("sid")).join(known, "sid")

    whole = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    start = F.col("pos") - F.col("at")
    candidates = matches(whole, necessary).join(necessary, "sid").where((start + F.col("first") >= 0) & (start + F.col("end") <= F.col("n")))
    candidates = materialize(candidates.select("doc_id", "text_key", "item", start.alias("start")).distinct(), "benchmark-candidates")

    # all the shingles of the benchmark, in the documents of candidates only
    few = candidates.select("doc_id", "text_key").distinct()
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    met = whole.join(few, _same(whole, few, "doc_id", "text_key"), "left_semi")
    matched = materialize(matches(met, placed), "benchmark-matches")

    # verify: matching shingles along the item, without a gap
    laid = candidates.join(placed, "item").withColumn("pos", F.col("start") + F.col("at")).drop("at")
    laid = laid.join(matched, _same(laid, matched, "doc_id", "text_key", "pos", "sid"), "left_semi").drop("sid", "item_words")
    along = Window.partitionBy("doc_id", "text_key", "item", "start").orderBy("pos")
    laid = laid.withColumn("island", F.col("pos") - F.row_number().over(along))
    runs = laid.groupBy("doc_id", "text_key", "item_id", "item", "start", "island", "k", "run").agg(
        F.min("pos").alias("first"), F.max("pos").alias("last")
    )
    runs = runs.where("last - first + 1 >= run")
    runs = runs.select("doc_id", "text_key", "item_id", "first", (F.col("last") + F.col("k")).alias("end"))

    # words inside any of them
    before = Window.partitionBy("doc_id", "text_key").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest("first", F.coalesce(F.max("end").over(before), "first"))
    runs = runs.withColumn("fresh", F.greatest(F.lit(0), F.col("end") - covered))
    hits = runs.groupBy("doc_id", "text_key").agg(
        F.sum("fresh").cast("long").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )
    found = texts.join(hits, _same(texts, hits, "doc_id", "text_key"), "left").select(
        texts["doc_id"],
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.sha2(F.array_join("items", ","), 256), nothing).alias("items_sha256"),
        texts["text_key"],
    )
    contaminated = (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", contaminated.alias("contaminated"), "text_key")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns as they are."""
    bad = find_contamination(docs, benchmark, id_col, text_col).where("contaminated")
    bad = bad.select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    on = docs[id_col].eqNullSafe(bad.bad_id) & (F.xxhash64(docs[text_col]) == bad.bad_key)
    return docs.join(bad, on, "left_anti")
