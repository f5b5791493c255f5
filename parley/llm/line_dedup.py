"""Line dedup by a segment-partition edit join.

Lines link within one character, and from six words on also when few of their words differ: one word edit in 20
words, one at least. Edits are insertions, deletions and substitutions. Classes are what links join, and a corpus
keeps one occurrence of each class.

A line of few words is cut into ``max_edits + 1`` segments of characters, a line of up to 39 words into two segments
of words, so that one segment of a linked pair is unchanged. An index maps length, segment number and segment to
lines; each line probes it with the substrings at the few starts where a match can lie, for its own length and the
one below. In longer lines a linked pair shares 13 words in a row, so that both choose the same word of a window
(the one of the smallest hash), from which on seven words are a key of both.

Buckets of up to ``BUCKET`` lines are settled pair by pair. Lines of larger ones meet by exact keys instead: two of up
to 39 words share what is left without the word that differs, or one becomes the other by one deletion, so no other
pair is made; two longer ones share one of their rarest runs of words, where members first link to a few lines of
their run and then only lines of different classes are paired. What pairs up is checked by the parity of its words, by
strings of a character a word, and verified by a banded bit-parallel edit distance, or by the distance of words.

Everything is DataFrame expressions. Texts are read once for the keys, which are hashes; copies of a line are
combined before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm._shared import connected_components, discard, materialize

MAX_EDITS, MIN_CHARS = 1, 20
#: A word edit is allowed for so many words, and one from ``FEW_WORDS`` on.
WORDS_AN_EDIT, FEW_WORDS = 20, 6
#: Words from which lines meet by windows (two word edits are allowed from there), words of a window and of a key:
#: lines of 40 words within the allowed edits share 13 words in a row at least.
LONG, WINDOW, GRAM = 2 * WORDS_AN_EDIT, 7, 7
#: Lines of a bucket above which it is not settled pair by pair.
BUCKET = 32
#: Words of the runs by which long lines of such buckets meet, and lines of a run that the others are compared with first.
RUN, PIVOTS = 2, 4
#: Rows up to which keys or ids are broadcast (some 50 MB); beyond, Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000


def _hash(line: Column) -> list[Column]:
    """Two independent hashes that stand for a line."""
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("h2")]


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _segment(length: Column, number: int, segments: int) -> tuple[Column, Column]:
    """Start (from 1) and length of a segment; the later ones are one longer if the line can't be cut evenly."""
    each, spare = F.floor(length / segments).cast("int"), (length % segments).cast("int")
    even = segments - spare
    longer = F.greatest(F.lit(0), F.lit(number) - even)
    return F.lit(1) + each * number + longer, each + (F.lit(number) >= even).cast("int")


def _index_keys(line: Column, length: Column, max_edits: int) -> Column:
    keys = []
    for i in range(max_edits + 1):
        start, size = _segment(length, i, max_edits + 1)
        keys.append(F.xxhash64(length, F.lit(i), F.substr(line, start, size)))
    return F.array(*keys)


def _probe_keys(line: Column, length: Column, max_edits: int, least: int = 0) -> Column:
    """Keys in the indexes of lines that are as long (with ``least`` 0) or up to ``max_edits`` shorter.

    With i segments before and k behind a match, at most i edits lie before it or at most k behind, which leaves
    few starts.
    """
    keys = []
    for shorter in range(least, max_edits + 1):
        other = length - shorter
        for i in range(max_edits + 1):
            start, size = _segment(other, i, max_edits + 1)
            behind = max_edits - i
            for shift in range(max(-i, shorter - behind), min(i, shorter + behind) + 1):
                at = start + shift
                inside = (at >= 1) & (at + size - 1 <= length)
                keys.append(F.when(inside, F.xxhash64(other, F.lit(i), F.substr(line, at, size))))
    return F.array_compact(F.array_distinct(F.array(*keys)))


def edit_distance_within(a: Column, b: Column, max_edits: int) -> Column:
    """The edit distance of two strings if it is at most ``max_edits`` (up to 30), else a larger number.

    Bit t of the vectors stands for row j - max_edits + t of column j of the distance table, so the band moves
    down one row a column. ``up`` and ``down`` hold where a row's value exceeds or falls short of the row above.
    The result follows the diagonal that ends in the last cell: it grows where a cell differs from the one before.
    """
    band = (1 << (2 * max_edits + 1)) - 1
    mask = F.lit(band).cast("long")

    def chars(s: Column) -> Column:
        return F.regexp_extract_all(s, F.lit("(?s)."), 0)

    def prefix(x: Column, y: Column) -> Column:
        """Number of equal characters at the front."""
        n = F.least(F.size(x), F.size(y))
        first = F.array_position(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p == q), False)
        return F.when(first == 0, n).otherwise(first - 1).cast("int")

    def cut(x: Column, n: Column) -> Column:
        return F.slice(x, n + 1, F.size(x))

    def trimmed(pair: Column) -> Column:
        """Both without what they share at the front; then reversed."""
        return _let(
            prefix(pair["x"], pair["y"]),
            lambda n: F.struct(F.reverse(cut(pair["x"], n)).alias("x"), F.reverse(cut(pair["y"], n)).alias("y")),
        )

    def walk(x: Column, y: Column) -> Column:
        shift = F.size(x) - F.size(y)
        start = F.struct(
            F.lit(band & ~((1 << (max_edits + 1)) - 1)).cast("long").alias("up"),
            F.lit((1 << (max_edits + 1)) - 1).cast("long").alias("down"),
            F.abs(shift).alias("d"),
        )

        def column(state: Column, j: Column) -> Column:
            c = F.get(y, j - 1)
            same = F.lit(0).cast("long")
            for t in range(2 * max_edits + 1):
                here = F.get(x, j - 1 - max_edits + t) == c
                same = same.bitwiseOR(F.when(F.coalesce((j - 1 - max_edits + t >= 0) & here, F.lit(False)), F.lit(1 << t)).otherwise(F.lit(0)).cast("long"))
            # the column before, one row down; the row that enters the band counts as one more than the row above
            up = F.shiftright(state["up"], 1).bitwiseOR(F.lit(1 << (2 * max_edits)).cast("long"))
            down = F.shiftright(state["down"], 1)

            def step(v: Column) -> Column:
                hit = v["same"].bitwiseOR(v["down"])
                carried = (v["up"] + hit.bitwiseAND(v["up"])).bitwiseXOR(v["up"]).bitwiseOR(hit).bitwiseAND(mask)

                def after(diagonal: Column) -> Column:
                    falls = v["up"].bitwiseAND(diagonal)
                    grows = v["down"].bitwiseOR(F.bitwise_not(v["up"].bitwiseOR(diagonal))).bitwiseAND(mask)
                    grows = F.shiftleft(grows, 1).bitwiseOR(F.lit(1).cast("long"))
                    at = F.call_function("shiftright", diagonal, shift + max_edits).bitwiseAND(F.lit(1).cast("long"))
                    return F.struct(
                        F.shiftleft(falls, 1).bitwiseOR(F.bitwise_not(grows.bitwiseOR(diagonal))).bitwiseAND(mask).alias("up"),
                        grows.bitwiseAND(diagonal).bitwiseAND(mask).alias("down"),
                        (state["d"] + 1 - at.cast("int")).alias("d"),
                    )

                return _let(carried, after)

            vectors = F.struct(same.alias("same"), up.alias("up"), down.alias("down"))
            return F.when(state["d"] > max_edits, state).otherwise(_let(vectors, step))

        walked = F.aggregate(F.sequence(F.lit(1), F.size(y)), start, column, lambda s: s["d"])
        return F.when(F.abs(shift) > max_edits, max_edits + 1).when(F.size(y) == 0, F.abs(shift)).otherwise(walked)

    pair = F.struct(chars(a).alias("x"), chars(b).alias("y"))
    return _let(pair, lambda p: _let(trimmed(p), lambda q: _let(trimmed(q), lambda r: walk(r["x"], r["y"]))))


def _in_size(table: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """``table`` joined by ``key`` with ``other``, which is broadcast up to a checked size."""
    return table.join(F.broadcast(other) if other.count() <= BROADCAST_ROWS else other, key)


def allowed_word_edits(words: Column) -> Column:
    """Word edits up to which lines link, of which the one with fewer words has ``words``."""
    return F.when(words < FEW_WORDS, 0).otherwise(F.greatest(F.lit(1), F.floor(words / WORDS_AN_EDIT).cast("int")))


def line_keys(line: Column, max_edits: int = MAX_EDITS) -> Column:
    """A line's keys, each an array of the key and whether it is in the index (1) or only asks (0)."""
    words = F.split(line, " ")

    def entries(keys: Column, held: int) -> Column:
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(bool(held)).alias("held")))

    def by_chars() -> Column:
        n = F.length(line)
        keys = F.concat(entries(_index_keys(line, n, max_edits), 1), entries(_probe_keys(line, n, max_edits, 1), 0))
        return F.when(n > max_edits, keys).otherwise(none)

    def words_from(side: str, n: Column) -> Column:
        """The first or last ``n`` words, found without an array of words."""
        return F.call_function("substring_index", line, F.lit(" "), n if side == "front" else -n)

    def by_halves(w: Column, shorter: int) -> Column:
        """For pairs of which the one with fewer words has as many as this line, or one less."""
        least = F.size(w) - shorter
        half = F.floor(least / 2).cast("int")
        front = F.xxhash64(F.lit("front"), least, words_from("front", half))
        back = F.xxhash64(F.lit("back"), least, words_from("back", half))
        return F.when((least >= FEW_WORDS) & (least < LONG), entries(F.array(front, back), 1 - shorter)).otherwise(none)

    def by_windows(w: Column) -> Column:
        """The words of a key from each word that has the smallest hash of some window.

        Words of small hashes are looked at first (one in four): such a word is the smallest of a window unless two
        smaller ones stand close around it. A window without any is told by its last word. A few words more than
        the smallest are chosen, which does no harm.
        """
        mask = (1 << 32) - 1
        # hash and place of a word in one number
        hashes = F.transform(w, lambda x, i: F.xxhash64(x).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))

        def place(x: Column) -> Column:
            return x.bitwiseAND(F.lit(mask)).cast("int")

        def gaps(bounds: Column) -> Column:
            """Last words of the windows between two neighbouring ``bounds``."""
            wide = F.filter(F.sequence(F.lit(1), F.size(bounds) - 1), lambda k: F.get(bounds, k) - F.get(bounds, k - 1) > WINDOW)
            return F.flatten(F.transform(wide, lambda k: F.sequence(F.get(bounds, k - 1) + WINDOW, F.get(bounds, k) - 1)))

        def chosen(small: Column) -> Column:
            def smallest(x: Column, k: Column) -> Column:
                before = [F.when(F.get(small, k - j) < x, place(F.get(small, k - j))) for j in (1, 2)]
                behind = [F.when(F.get(small, k + j) < x, place(F.get(small, k + j))) for j in (1, 2)]
                from_, to = F.coalesce(*before, place(x) - WINDOW), F.coalesce(*behind, place(x) + WINDOW)
                return to - from_ > WINDOW

            bounds = F.concat(F.array(F.lit(-1)), F.transform(small, place), F.array(F.size(w)))
            places = F.concat(F.transform(F.filter(small, smallest), place), _let(bounds, gaps))
            places = F.filter(places, lambda i: i <= F.size(w) - GRAM)
            return entries(F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.slice(w, i + 1, GRAM)))), 1)

        return _let(F.filter(hashes, lambda x: x < F.lit(-(1 << 62))), chosen)

    none = F.array().cast("array<struct<key:bigint,held:boolean>>")

    def of(w: Column) -> Column:
        n = F.size(w)
        return F.when((n > LONG) & F.lit(max_edits == 1), by_windows(w)).otherwise(
            F.concat(
                F.when((n <= FEW_WORDS) | F.lit(max_edits > 1), by_chars()).otherwise(none),
                F.when(n >= FEW_WORDS, by_halves(w, 0)).otherwise(none),
                F.when(n > FEW_WORDS, by_halves(w, 1)).otherwise(none),
                F.when(n >= LONG, by_windows(w)).otherwise(none),
            )
        )

    return _let(words, of)


def word_distance_within(a: Column, b: Column, most: Column) -> Column:
    """Whether two arrays of words are within ``most`` insertions, deletions and substitutions of words.

    Each word is written as one character, its number among the words of both.
    """

    def letters(words: Column, known: Column) -> Column:
        def letter(word: Column) -> Column:
            code = F.array_position(known, word) + 255
            code = F.when(code >= 0xD800, code + 0x800).otherwise(code)  # not those of surrogates
            return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

        return F.array_join(F.transform(words, letter), "")

    def rest(pair: Column) -> Column:
        """Both without the words they share at the front; then reversed."""
        x, y = pair["x"], pair["y"]
        n = F.least(F.size(x), F.size(y))
        first = F.array_position(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p == q), False)
        same = F.when(first == 0, n).otherwise(first - 1).cast("int")
        return _let(
            same,
            lambda k: F.struct(F.reverse(F.slice(x, k + 1, F.size(x))).alias("x"), F.reverse(F.slice(y, k + 1, F.size(y))).alias("y")),
        )

    def close(pair: Column) -> Column:
        known = F.array_distinct(F.concat(pair["x"], pair["y"]))
        return _let(known, lambda k: F.call_function("levenshtein", letters(pair["x"], k), letters(pair["y"], k), most) >= 0)

    pair = F.struct(a.alias("x"), b.alias("y"))
    return _let(pair, lambda p: _let(rest(p), lambda q: _let(rest(q), close)))


#: What tells of a line, without its text, that it is too far from another: its number of words, and longs whose bits
#: say of which hashes it holds an odd number of words.
PARITY = ("parity_0", "parity_1")
SKETCH = ("n", *PARITY)


def _sketches(texts: DataFrame) -> DataFrame:
    """``lid`` and ``SKETCH`` of every line."""
    words = texts.select("lid", F.explode(F.split("line", " ")).alias("word")).select("lid", F.xxhash64("word").alias("w"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("w").bitwiseAND(F.lit(63)).cast("int"))
    which = F.shiftright("w", 6).bitwiseAND(F.lit(len(PARITY) - 1))
    odd = [F.bit_xor(F.when(which == k, bit).otherwise(F.lit(0).cast("long"))).alias(name) for k, name in enumerate(PARITY)]
    return words.groupBy("lid").agg(F.count("*").cast("int").alias("n"), *odd)


def _alike(max_edits: int) -> Column:
    """Whether the sketches of two lines (``n_a``, ``n_b`` and so on) let them be linked.

    A word that takes another's place changes two parities, one that is added or missing changes one.
    """
    most, apart = allowed_word_edits(F.least("n_a", "n_b")), F.abs(F.col("n_a") - F.col("n_b"))
    bits = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITY), F.lit(0))
    return (apart <= F.greatest(most, F.lit(max_edits))) & (bits <= F.greatest(2 * most - apart, F.lit(3 * max_edits)))


def _letter(word: Column) -> Column:
    """A number of four hexadecimal digits for a word, no surrogate."""
    return F.pmod(F.xxhash64(word), F.lit(0xD800 - 0x1000)) + 0x1000


def _code(words: Column) -> Column:
    """A string with a character for each word: equal words have equal ones, different words nearly always others."""
    return F.decode(F.unhex(F.array_join(F.transform(words, lambda w: F.hex(_letter(w))), "")), "UTF-16BE")


def _told_apart(line: Column, other: Column) -> Column:
    """Whether all different words of two lines have different letters in their codes."""
    words = F.array_distinct(F.concat(F.split(line, " "), F.split(other, " ")))
    return _let(words, lambda w: F.size(F.array_distinct(F.transform(w, _letter))) == F.size(w))


def _side(rows: DataFrame, side: str, *columns: str) -> DataFrame:
    """``columns`` and the sketch of ``rows`` under names that end in ``side``, beside their ``key``."""
    return rows.select("key", *[F.col(c).alias(f"{c}_{side}") for c in ("lid", *columns, *SKETCH)])


def _met(one: DataFrame, two: DataFrame, wanted: Column, max_edits: int) -> DataFrame:
    """Pairs ``a``, ``b`` of lines of two ``_side`` tables whose keys and sketches agree."""
    return one.join(two, "key").where(wanted & _alike(max_edits)).select(F.least("lid_a", "lid_b").alias("a"), F.greatest("lid_a", "lid_b").alias("b"))


def _verified(pairs: DataFrame, texts: DataFrame, max_edits: int) -> DataFrame:
    """Those ``pairs`` of ids that the allowed word edits or ``max_edits`` characters part, as a table.

    The distance of their codes is no larger than that of their words and drops most pairs that do not link. Where
    no two words of a pair share a letter it is the distance of their words.
    """
    one, two = (texts.select(F.col("lid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "line", "code")]) for x in "ab")
    most = allowed_word_edits(F.least("n_a", "n_b"))

    def codes_within(edits: Column) -> Column:
        return F.call_function("levenshtein", F.col("code_a"), F.col("code_b"), edits) >= 0

    exact = _told_apart(F.col("line_a"), F.col("line_b")) | word_distance_within(F.split("line_a", " "), F.split("line_b", " "), most)
    by_words = (F.abs(F.col("n_a") - F.col("n_b")) <= most) & codes_within(most) & exact
    by_chars = (F.abs(F.length("line_a") - F.length("line_b")) <= max_edits) & (edit_distance_within(F.col("line_a"), F.col("line_b"), max_edits) <= max_edits)
    met = pairs.where("a != b").distinct().join(one, "a").join(two, "b")
    return materialize(met.where(codes_within(F.greatest(most, F.lit(2 * max_edits))) & (by_words | by_chars)).select("a", "b"), "line-links")


def _one_edit_pairs(texts: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` that join all lines of at most ``LONG`` words which one edit parts.

    Lines that differ in one word share what is left without it; of such a group one line stands for all. Of
    lines of different numbers of words one becomes the other by one deletion, of a word or of a space, or where a
    space takes the place of a character. Lines of few words do the same with characters. No other pair is made.
    """
    line, n, words, length = F.col("line"), F.col("n"), F.split("line", " "), F.length("line")
    none = F.array().cast("array<bigint>")
    few = (n <= FEW_WORDS) & (length > MAX_EDITS)

    def each(last: Column, key) -> Column:
        return F.transform(F.sequence(F.lit(1), last), key)

    def without(w: Column, i: Column) -> list[Column]:
        return [F.slice(w, F.lit(1), i - 1), F.slice(w, i + 1, F.size(w))]

    def chars(p: Column, instead: str) -> Column:
        return F.concat(F.substr(line, F.lit(1), p - 1), F.lit(instead), F.substr(line, p + 1))

    def joined(w: Column, i: Column) -> Column:
        """The line without the space behind its word ``i``."""
        return F.concat(F.array_join(F.slice(w, F.lit(1), i), " "), F.array_join(F.slice(w, i + 1, F.size(w)), " "))

    shared = _let(words, lambda w: F.concat(
        F.when((n >= FEW_WORDS) & (n < LONG), each(n, lambda i: F.xxhash64(F.lit("word"), n, i, *without(w, i)))).otherwise(none),
        F.when(few, each(length, lambda p: F.xxhash64(F.lit("char"), length, p, chars(p, "")))).otherwise(none),
    ))
    asked = _let(words, lambda w: F.concat(
        F.when(n > FEW_WORDS, each(n, lambda i: F.xxhash64(F.array_join(F.concat(*without(w, i)), " ")))).otherwise(none),
        F.when(n > FEW_WORDS, each(n - 1, lambda i: F.xxhash64(joined(w, i)))).otherwise(none),
        F.when(n >= FEW_WORDS, each(length, lambda p: F.xxhash64(chars(p, " ")))).otherwise(none),
        F.when(few & (length > MAX_EDITS + 1), each(length, lambda p: F.xxhash64(chars(p, "")))).otherwise(none),
    ))
    short = texts.where(n <= LONG)
    groups = short.select("lid", F.explode(shared).alias("key"))
    stars = groups.select(F.min("lid").over(Window.partitionBy("key")).alias("a"), F.col("lid").alias("b")).where("a != b")
    whole = short.select(F.col("lid").alias("a"), F.xxhash64("line").alias("key"))
    found = _in_size(short.select(F.col("lid").alias("b"), F.explode(asked).alias("key")), "key", whole)
    return stars.unionByName(found.select("a", "b"))


def _rare_grams(texts: DataFrame, sketches: DataFrame) -> DataFrame:
    """Keys of lines of ``LONG`` words and more: their rarest runs of ``RUN`` words, as many for each edit, and one.

    An edit takes ``RUN`` of them from a line at most, so lines within t edits share one of their RUN * t + 1 rarest.
    An edit also makes runs of a line's own, so lines of more edits soon have nothing but those. Of edited copies the
    one that has no run of its own is nearest to all: ``rank`` is how often a line's rarest run occurs.
    """
    grams = _let(F.split("line", " "), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - RUN + 1), lambda i: F.xxhash64(F.slice(w, i, RUN)))))
    grams = materialize(texts.where(F.col("n") >= LONG).select("lid", "n", F.explode(grams).alias("key")), "line-grams")
    own = Window.partitionBy("lid")
    ranked = grams.join(grams.groupBy("key").agg(F.count("*").alias("df")), "key")
    ranked = ranked.select("lid", "n", "key", "df", F.row_number().over(own.orderBy("df", "key")).alias("place"), F.min("df").over(own).alias("rank"))
    rare = ranked.where((F.col("place") <= RUN * allowed_word_edits(F.col("n")) + 1) & (F.col("df") > 1)).select("key", "lid", "rank")
    rare = materialize(rare.join(sketches, "lid"), "line-rare")
    discard(grams)
    return rare


def line_buckets(keyed: DataFrame) -> DataFrame:
    """The lines of every key that different lines have and one of them holds, as a table with the number of lines (``size``).

    The keys are shuffled once; their lines are told from the same exchange.
    """
    keyed = keyed.repartition("key")
    several = keyed.groupBy("key").agg(F.min("lid").alias("lo"), F.max("lid").alias("hi"), F.max("held").alias("any"))
    several = several.where("lo != hi and any").select("key")
    rows = keyed.join(several.hint("shuffle_hash"), "key").groupBy("key", "lid").agg(F.max("held").alias("held"))
    return materialize(rows.select("*", F.count("*").over(Window.partitionBy("key")).alias("size")), "line-buckets")


def link_bucketed_lines(buckets: DataFrame, lines: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """Pairs ``a``, ``b`` of ids that join lines into classes (not every pair of a class).

    ``buckets`` has a row (``key``, ``lid``, ``held``, ``size``) for each line of a shared key, ``lines`` their texts
    (``lid``, ``line``).
    """
    texts = lines.select("lid", "line", _let(F.split("line", " "), lambda w: F.struct(F.size(w).alias("n"), _code(w).alias("code"))).alias("w"))
    texts = materialize(texts.select("lid", "line", "w.*"), "line-texts")
    sketches = materialize(_sketches(texts), "line-sketches")
    cold = buckets.where(F.col("size") <= BUCKET) if max_edits == 1 else buckets
    cold = _in_size(cold, "lid", sketches)
    pairs = _met(_side(cold, "a", "held"), _side(cold, "b", "held"), F.expr("lid_a < lid_b and (held_a or held_b)"), max_edits)
    hot = buckets.where(F.col("size") > BUCKET).select("lid").distinct() if max_edits == 1 else None
    if hot is None or hot.isEmpty():
        links = _verified(pairs, texts, max_edits)
        discard(texts, sketches)
        return links

    hot = materialize(_in_size(texts, "lid", hot), "line-hot")
    rare = _rare_grams(hot, sketches)
    nearest = Window.partitionBy("key").orderBy(F.desc("rank"), "lid")
    pivots = rare.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= PIVOTS)
    stars = _met(_side(pivots, "a"), _side(rare, "b"), F.expr("lid_a != lid_b"), max_edits)
    links = _verified(pairs.unionByName(stars).unionByName(_one_edit_pairs(hot)), texts, max_edits)
    # what the stars have not joined: lines of different classes only, each bucket's largest class never with itself
    roots = connected_components(links, "line-star-classes")
    known = rare.join(roots, rare.lid == roots.node, "left").select("key", "lid", *SKETCH, F.coalesce("root", "lid").alias("root"))
    known = materialize(known, "line-known")
    major = known.groupBy("key", "root").agg(F.count("*").alias("k")).groupBy("key").agg(F.max(F.struct("k", "root")).alias("m"), F.count("*").alias("classes"))
    mixed = known.join(major.where("classes > 1").select("key", F.col("m.root").alias("major")), "key")
    more = _met(_side(mixed.where("root != major"), "a", "root"), _side(mixed, "b", "root"), F.expr("root_a != root_b"), max_edits)
    more = _verified(more, texts, max_edits)
    discard(texts, sketches, hot, rare, roots, known)
    return links.unionAll(more)


def link_lines(lines: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """``link_bucketed_lines`` of different lines (columns ``lid``, ``line``)."""
    keyed = lines.select("lid", F.explode(line_keys(F.col("line"), max_edits)).alias("k")).select("k.key", "lid", "k.held")
    return link_bucketed_lines(line_buckets(keyed), lines, max_edits)


def find_duplicate_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_edits: int = MAX_EDITS,
    min_chars: int = MIN_CHARS,
    exact_chars: int | None = None,
) -> DataFrame:
    """Which lines of every row of ``docs`` repeat a line that is kept.

    Columns: ``doc_id``; ``n_lines``; ``n_exact`` and ``n_near`` (lines to drop whose kept line is equal, or not);
    ``dropped`` (their numbers from 0, in order); ``text_key`` (a hash of the text). Lines are what newlines
    separate, compared character by character. Of a class of lines the one in the document with the smallest id
    stays (of several there, that of the smallest hash, at its first place); null ids come last. Lines of fewer
    than ``exact_chars`` characters (``min_chars`` if not given; 1: all that are not empty) all stay; those of fewer
    than ``min_chars`` repeat only lines equal to them. Null text has no lines. Rows that repeat id and text count as one
    document and get equal results; an empty table gives no rows. Only the two named columns are read.
    """
    return _found(docs, id_col, text_col, max_edits, min_chars, exact_chars)[0]


def _found(docs: DataFrame, id_col: str, text_col: str, max_edits: int, min_chars: int, exact_chars: int | None) -> tuple[DataFrame, list[DataFrame]]:
    """The result of ``find_duplicate_lines`` and the tables that it still reads."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    key = ["doc_id", "text_key"]
    lines = texts.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.where(F.length("line") >= (min_chars if exact_chars is None else exact_chars))
    near = F.length("line") >= min_chars
    placed = lines.select(*key, "at", *_hash(F.col("line")), F.when(near, line_keys(F.col("line"), max_edits)).alias("keys"))
    placed = materialize(placed, "line-places")
    distinct = placed.groupBy("h", "h2").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    distinct = materialize(distinct, "lines")

    # different lines that share a key, and their texts
    buckets = line_buckets(placed.select(F.explode("keys").alias("k"), F.col("h").alias("lid")).select("k.key", "lid", "k.held"))
    ids = materialize(buckets.select("lid").distinct(), "line-ids")
    met = lines.where(near).select(F.xxhash64("line").alias("lid"), "line")
    met = _in_size(met, "lid", ids).groupBy("lid").agg(F.min("line").alias("line"))
    links = link_bucketed_lines(buckets, met, max_edits)
    discard(buckets, ids)
    classes = connected_components(links, "line-classes")
    # one line of each class stays; lines without a link are a class of their own
    joined = distinct.join(classes, distinct.h == classes.node, "left").where("copies > 1 or root is not null")
    member = materialize(joined.select("least", "h", "h2", F.coalesce("root", "h").alias("root"), F.when(F.col("root").isNull(), F.col("h2")).alias("own")), "line-members")
    discard(distinct, links, classes)
    keeper = member.groupBy("root", "own").agg(F.min(F.struct(F.col("least").isNull(), "least", "h", "h2")).alias("k"))
    keeper = keeper.select(F.col("root").alias("k_root"), F.col("own").alias("k_own"), F.col("k.h").alias("k_h"), F.col("k.h2").alias("k_h2"))
    stays = (F.col("h") == F.col("k_h")) & (F.col("h2") == F.col("k_h2"))
    verdict = member.join(keeper, (F.col("root") == F.col("k_root")) & F.col("own").eqNullSafe(F.col("k_own"))).select("h", "h2", "least", stays.alias("stays"))

    doubtful = placed.select(*key, "at", "h", "h2").join(verdict, ["h", "h2"])
    places = Window.partitionBy(*key, "h", "h2").orderBy("at")
    doubtful = doubtful.withColumn("first", F.rank().over(places) == 1)
    stays = F.col("stays") & F.col("doc_id").eqNullSafe(F.col("least")) & F.col("first")
    dropped = doubtful.where(~stays).groupBy(*key).agg(
        F.array_sort(F.collect_set("at")).alias("dropped"), F.array_sort(F.collect_set(F.when(~F.col("stays"), F.col("at")))).alias("near")
    )
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    counted = texts.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce(n_lines, F.lit(0)).alias("n_lines"))
    on = counted.doc_id.eqNullSafe(dropped.doc_id) & (counted.text_key == dropped.text_key)
    none = F.array().cast("array<int>")
    n_near = F.coalesce(F.size("near"), F.lit(0))
    found = counted.join(dropped, on, "left").select(
        counted.doc_id,
        F.col("n_lines").cast("long").alias("n_lines"),
        (F.coalesce(F.size("dropped"), F.lit(0)) - n_near).cast("long").alias("n_exact"),
        n_near.cast("long").alias("n_near"),
        F.coalesce("dropped", none).alias("dropped"),
        counted.text_key,
    )
    return found, [placed, member]


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars", exact_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the lines that repeat a kept one, all columns in place; ``n_chars_col`` is counted anew.

    A document whose every line repeats a kept line goes, for nothing of it is left. Lines under ``exact_chars``
    characters are not dropped: a corpus keeps its list marks, braces and one-word lines.
    """
    found, tables = _found(docs, id_col, text_col, MAX_EDITS, MIN_CHARS, exact_chars)
    found = found.where("size(dropped) > 0").distinct().select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "dropped", "n_lines")
    found = materialize(found, "line-drops")
    discard(*tables)
    # the row goes through the join as one column, so no name of the user's can clash
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.struct(*docs.columns).alias("row"))
    on = rows.id.eqNullSafe(found.id) & (rows.key == found.key)
    joined = rows.join(found, on, "left").where("dropped is null or size(dropped) < n_lines").select("row", "dropped")
    text = F.col("row")[text_col]
    # the dropped numbers are in order: each kept piece lies between two of them
    lines = F.split(text, "\n")
    bounds = F.concat(F.array(F.lit(-1)), F.col("dropped"), F.array(F.size(lines)))
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(bounds) - 1),
        lambda k: _let(F.element_at(bounds, k), lambda before: F.slice(lines, before + 2, F.element_at(bounds, k + 1) - before - 1)),
    )
    kept = F.when(F.col("dropped").isNull(), text).otherwise(F.array_join(F.flatten(pieces), "\n"))
    rows = joined.select(F.col("row"), kept.alias("kept"))
    columns = {c: F.col("row")[c] for c in docs.columns} | {text_col: F.col("kept")}
    if n_chars_col in docs.columns:
        columns[n_chars_col] = F.coalesce(F.length("kept"), F.col("row")[n_chars_col]).cast(docs.schema[n_chars_col].dataType)
    return rows.select(*[c.alias(name) for name, c in columns.items()])
