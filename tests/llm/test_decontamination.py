import hashlib
import random
import re

import pytest

from parley.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def expected(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(item)
    rows = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        n_items = len(found - {None})
        rows.append((doc, len(w), len(hit), n_items, hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(rows, key=str)


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_matches_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(d, "BROADCAST_ROWS", broadcast)
    rng = random.Random(8)
    vocabulary = ["a", "b", "c", "d", "e", "f1", "\u00e9"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 4, 5, 8, 12, 13, 14, 30]))) for i in range(30)]
    items += [(3, text(20)), (None, text(16)), (50, None), (51, "..."), (52, "a a a a a a a a a a a a a a a a")]
    docs = [(i, text(rng.randrange(60))) for i in range(60)]
    docs += [(100 + i, f"{text(20)}. {items[i % len(items)][1]}, {text(9)}") for i in range(60)]
    docs += [(300, "a " * 40), (301, f"{items[9][1].upper()} x " * 3), (302, text(400) + " " + items[31][1])]
    found = d.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, rows), key=str) == expected(docs, items)


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the river bank today")], "item_id long, text string")
    rows = d.find_contamination(odd, bench).collect()
    assert len(rows) == 10 and [r.n_hit for r in rows if r.doc_id == 1] == [13, 13]
    assert all(r.n_words == 0 and not r.contaminated for r in rows if r.doc_id in (2, 3, 4))
    assert d.find_contamination(none, bench).count() == 0
    assert {r.n_hit for r in d.find_contamination(odd, bench.limit(0)).collect()} == {0}
    kept = d.keep_uncontaminated(odd, bench)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(["2", "3", "4", "None", "5", "6", "7", "8"])
