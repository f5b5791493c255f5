import random

import pytest
from pyspark.sql import functions as F

from parley.llm import line_dedup
from parley.llm.line_dedup import drop_duplicate_lines, edit_distance_within, find_duplicate_lines, link_lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def variants(rng, n):
    pairs = []
    for _ in range(n):
        a = [rng.choice("ab c\u00e9") for _ in range(rng.randrange(14))]
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "\u00e9", " "])
        pairs.append(("".join(a), "".join(b)))
    return pairs


def test_banded_distance_is_the_edit_distance_within_the_band(spark):
    pairs = variants(random.Random(1), 300)
    for most in (1, 2, 3):
        rows = spark.createDataFrame(pairs, "a string, b string")
        rows = rows.select("a", "b", edit_distance_within(F.col("a"), F.col("b"), most).alias("d")).collect()
        assert all(min(r.d, most + 1) == min(distance(r.a, r.b), most + 1) for r in rows)


def classes(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def near(a, b, most=1):
    """The rule in plain Python."""
    x, y = a.split(" "), b.split(" ")
    few = min(len(x), len(y))
    words = 0 if few < 6 else max(1, few // 20)
    if abs(len(a) - len(b)) <= most and min(len(a), len(b)) > most and distance(a, b) <= most:
        return True
    return bool(words) and abs(len(x) - len(y)) <= words and distance(x, y) <= words


def linked(spark, lines, most=1):
    """Classes that the operator finds; all its links follow the rule."""
    rows = link_lines(spark.createDataFrame(list(enumerate(lines)), "lid long, line string"), most).collect()
    assert all(near(lines[r.a], lines[r.b], most) for r in rows)
    return classes(len(lines), [(r.a, r.b) for r in rows])


def brute(lines, most=1):
    return classes(len(lines), [(i, j) for i, a in enumerate(lines) for j, b in enumerate(lines[:i]) if near(a, b, most)])


@pytest.mark.parametrize("bucket", [256, 3])
def test_classes_are_those_of_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(line_dedup, "BUCKET", bucket)
    lines = sorted({x for pair in variants(random.Random(2), 150) for x in pair})
    for most in (1, 2) if bucket > 3 else (1,):
        assert linked(spark, lines, most) == brute(lines, most)


def test_hot_segments_are_split(spark, monkeypatch):
    """Families that share most of their words and differ in one place, in two, or in characters of one word."""
    monkeypatch.setattr(line_dedup, "BUCKET", 8)
    rng = random.Random(5)
    key = lambda: "%06x" % rng.randrange(1 << 24)
    lines = set()
    for _ in range(24):
        lines.add(f"the reading of the station near the river was {key()} today")
        lines.add(f"the reading of the station near the lake was {key()} {key()} today")
        lines.add(f"a reading of {key()} near the small river {key()} was good today")
        lines.add(f"posted on {key()} by {key()}")
        lines.add("in the long line " + "many words are the same in all of the lines " * 5 + f"but {key()} and {key()} and {key()} and {key()} are not")
    for line in rng.sample(sorted(lines), 24):
        at = rng.randrange(len(line))
        lines.add(line[:at] + rng.choice(["", "x", " "]) + line[at + 1 :])
        lines.add(line.replace(" by ", "by ", 1))
    lines = sorted(lines)
    assert linked(spark, lines) == brute(lines)


LINE = "this line stands in several documents of the corpus"
SLIP = "this line stands in several documents of the korpus"


def test_one_line_of_each_class_stays(spark):
    docs = spark.createDataFrame(
        [(3, f"{LINE}\nonly here, a line of its own kind\nshort", 0), (1, f"{SLIP}\nshort\n{LINE}", 0), (2, LINE, 0), (9, f"short\n{LINE}\n{LINE}", 0)],
        "doc_id long, text string, n_chars int",
    )
    found = {r.doc_id: (r.n_lines, r.n_exact + r.n_near, list(r.dropped)) for r in find_duplicate_lines(docs).collect()}
    assert found[3] == (3, 1, [0]) and found[2] == (1, 1, [0]) and found[9] == (3, 2, [1, 2])
    assert found[1][1] == 1  # one of the two alike
    kept = {r.doc_id: r for r in drop_duplicate_lines(docs).collect()}
    assert kept[3].text == "only here, a line of its own kind\nshort" and kept[3].n_chars == len(kept[3].text)
    assert kept[9].text == "short" and 2 not in kept


def test_odd_rows(spark, odd, none):
    assert find_duplicate_lines(odd).count() == 10
    kept = drop_duplicate_lines(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.text) for r in kept.collect()) == sorted(str(r.text) for r in odd.collect())  # repeats are one document
    assert find_duplicate_lines(none).count() == 0 and drop_duplicate_lines(none).count() == 0


def test_one_word_in_twenty_may_differ(spark):
    rng = random.Random(3)
    words = ["alpha", "b", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    lines = set()
    for n in [*range(5, 24), *range(37, 43), 59, 60, 61, 80, 119, 120]:
        for _ in range(2):
            base = [rng.choice(words) + str(rng.randrange(50)) for _ in range(n)]
            lines.add(" ".join(base))
            for edits in (1, 2, 3, 4, 6, 7):
                copy = list(base)
                for _ in range(edits):
                    at = rng.randrange(len(copy))
                    copy[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
                lines.add(" ".join(copy))
            at = " ".join(base).index(" ")
            lines.add(" ".join(base)[:at] + " ".join(base)[at + 1 :])  # one character
    lines = sorted(lines)
    assert linked(spark, lines) == brute(lines)


def test_a_line_with_one_word_swapped_is_near(spark):
    a = "A reed ntre is the one that stands in the middle of this line"
    docs = spark.createDataFrame([(1, a), (2, a.replace("A reed", "The reed")), (3, "quite another line with some words in it")], "doc_id long, text string")
    assert {r.doc_id: r.n_near for r in find_duplicate_lines(docs).collect()} == {1: 0, 2: 1, 3: 0}


def test_short_lines_repeat_too(spark):
    docs = spark.createDataFrame([(1, "short\n\nshort"), (2, "\nshort\nshorx")], "doc_id long, text string")
    found = {r.doc_id: (r.n_exact, r.n_near, list(r.dropped)) for r in find_duplicate_lines(docs, exact_chars=1).collect()}
    assert found == {1: (1, 0, [2]), 2: (1, 0, [1])}
    assert {r.text for r in drop_duplicate_lines(docs).collect()} == {r.text for r in docs.collect()}


def test_helper_names_may_be_columns_of_the_table(spark):
    docs = spark.createDataFrame([(1, LINE, 1, 2, 3, 4), (2, LINE + "\nsomething else that stays here", 1, 2, 3, 4)],
                                 "doc_id long, text string, dropped int, d_lines int, row int, id int")
    kept = drop_duplicate_lines(docs)
    assert kept.columns == docs.columns and {r.text for r in kept.collect()} == {LINE, "something else that stays here"}


def test_permuted_lines_are_not_paired(spark, monkeypatch):
    """Lines of one front half and the same words in other orders: as many pairs as lines are compared, not their square."""
    monkeypatch.setattr(line_dedup, "BUCKET", 8)
    rng, verify, compared = random.Random(7), line_dedup._verified, []

    def counted(pairs, *rest):
        compared.append(pairs.distinct().count())
        return verify(pairs, *rest)

    monkeypatch.setattr(line_dedup, "_verified", counted)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    lines = sorted({" ".join(["this", "front", "half", "is", "in", "all", "the", "lines", *rng.sample(words, 8)]) for _ in range(150)})
    lines.append(lines[0] + "s")
    assert linked(spark, lines) == brute(lines)
    assert sum(compared) < 3 * len(lines)
