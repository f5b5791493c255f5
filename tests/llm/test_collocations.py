import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import collocations as c


def expected(rows, least=10, share=50, top=2000):
    """The plain rule, from dictionaries of all phrases."""
    found = []
    for lang in {l or "und" for l, _ in rows}:
        f, n = Counter(), 0
        for own, text in rows:
            if (own or "und") == lang:
                lower = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
                for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
                    words = re.findall(r"[^\x20\x09]+", piece)
                    n += len(words)
                    f.update(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
        some = [p for p, a in f.items() if len(p) > 1 and a >= least]
        scored = []
        for p in some:
            a = f[p]
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * f[q] >= share * a for q in some):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        found += [(lang, i, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(found)


def corpus(n=400, seed=2):
    rng = random.Random(seed)
    words = ["New", "york", "of", "the", "é", "Straße", "a b", "ÉTÉ", "red", "wine", "x"] + [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words[: rng.choice([5, 11, 71])]) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " - "]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "en", "de", None]), text + " New York of the" * rng.randrange(3)))
    return rows


@pytest.mark.parametrize(("shard", "merged"), [(1 << 22, 1 << 21), (900, 64)])
def test_phrases_match_plain_counts(spark, monkeypatch, shard, merged):
    monkeypatch.setattr(c, "SHARD", shard)
    monkeypatch.setattr(c, "MERGED", merged)
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3).selectExpr("*", "'x' n", "'x' word", "'x' shard")
    found = sorted(tuple(r) for r in c.mine_collocations(df).collect())
    assert found == expected(rows) and len(found) > 50
    few = c.mine_collocations(df, least=4, top=7)
    assert sorted(tuple(r) for r in few.collect()) == expected(rows, least=4, top=7)
    assert [x for _, x in few.dtypes] == ["string", "bigint", "string"] + ["bigint"] * 5


@pytest.mark.parametrize("width", [2, 9, 16, 18, 21, 22, 27, 32])
def test_filters_are_lossless(width):
    rng = np.random.default_rng(width)
    numbers = rng.integers(0, 1 << width, 5000).astype(np.uint64)
    numbers[::7] = 0
    numbers[100:400] = numbers[1000:1300]
    first, rest = c.phrases(numbers, width)
    quotient, remainder = c.permute(first, rest, width)
    assert all((x == y).all() for x, y in zip(c.unpermute(quotient, remainder, width), (first, rest), strict=True))
    once = np.ones(len(quotient), np.int64)
    key = c.merged(quotient, remainder, once, width)
    plain = Counter(zip(first.tolist(), rest.tolist(), strict=True))
    for weight in (1, 1 << 33):
        low, slots = (1 << width) // 2, (1 << width) // 2
        some = key[0] >= low
        own = (key[0][some], key[1][some], key[2][some] * weight)
        back = c.decode(c.encode(*own, low, slots, width), low, slots, width)
        assert all((x == y).all() for x, y in zip(own, back, strict=True))
    half = len(quotient) // 2
    parts = [c.merged(quotient[s], remainder[s], once[s], width) for s in (slice(0, half), slice(half, None))]
    both = c.merged(*[np.concatenate(x) for x in zip(*parts, strict=True)], width)
    assert all((x == y).all() for x, y in zip(both, key, strict=True))
    assert Counter(dict(zip(zip(*[x.tolist() for x in c.unpermute(both[0], both[1], width)], strict=True), both[2].tolist(), strict=True))) == plain


def test_scores_of_products_beyond_64_bits(spark):
    rows = [(5 * 10**12, 9 * 10**12, 7 * 10**12), (10**15, 10**15, 10**15), (3, 7, 11)]
    df = spark.createDataFrame(rows, "a long, l long, r long")
    found = [r[0] for r in df.select(c.association(F.col("a"), F.col("l"), F.col("r"))).collect()]
    assert found == [10**6 * a * a // (l * r) for a, l, r in rows]


def test_odd_rows(spark, odd, none):
    found = c.mine_collocations(odd, least=2)
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert sorted(tuple(r) for r in found.collect()) == expected(rows, least=2) != []
    assert c.mine_collocations(none).count() == 0
    assert c.mine_collocations(odd.where("text is null")).count() == 0
