import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from parley.llm.language_id import Profiles, grams, held_out, keep_identified, predict_languages, ranked


def test_grams_and_ranks():
    text = "Ab, ab!"
    codes = grams(text)
    a, b = ord("a"), ord("b")
    front, two, back = (1 << 21) | a, (a << 21) | b, (b << 21) | 1
    assert sorted(codes.tolist()) == sorted([a, b, front, two, back, (front << 21) | b, (two << 21) | 1] * 2)
    assert len(grams(None)) == len(grams("12 ,")) - len(grams("12 ,")) == 0
    assert ranked(np.array([5, 3, 3, 9, 9, 1])).tolist() == [3, 9, 1, 5]


def test_out_of_place_distance():
    p = Profiles({"x": ranked(grams("aaaa bbb cc")), "y": ranked(grams("zzzz yyy xx"))})
    assert p.predict("aaa bb")[0] == "x" and p.predict("zz yyy")[0] == "y" and p.predict("zzzz yyy xx") == ("y", 1.0)
    assert p.predict("") == ("und", 0.0)


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    parts = {"en": ["the", "ing", "and", "tion", "er"], "de": ["sch", "ung", "der", "ein", "\u00fc"], "fr": ["que", "eau", "les", "ment", "\u00e9"]}
    rows = [
        (i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(30)), lang)
        for i, lang in enumerate(rng.choices(list(parts), k=400))
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = predict_languages(docs).collect()
    unseen = [r for r in found if r.held_out]
    assert len(unseen) > 50 and all(r.lang_pred == rows[r.doc_id][2] for r in unseen)
    turned = docs.selectExpr("doc_id", "text", "lang as was").withColumn("out", held_out(docs.doc_id)).selectExpr("doc_id", "text", "if(out, 'xx', was) lang")
    assert {(r.doc_id, r.lang_pred, r.score) for r in predict_languages(turned).collect()} == {(r.doc_id, r.lang_pred, r.score) for r in found}


def test_odd_rows(spark, odd, none):
    rows = predict_languages(odd).collect()
    assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 4, 6)} == {"und"}
    assert predict_languages(none).count() == 0
    kept = keep_identified(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, None, 5, 7, 8}
    assert {r.lang_pred for r in predict_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} <= {"und"}


def test_predictions_are_those_of_plain_python(spark):
    rng = random.Random(8)
    alphabet = {"en": "etaoinsh ", "de": "enisratuü ", "xx": "aeiz "}
    rows = [(i, "".join(rng.choices(alphabet[lang], k=rng.randrange(3, 60))), lang) for i, lang in enumerate(rng.choices(list(alphabet), k=120))]

    def counted(texts):
        found = Counter()
        for text in texts:
            for word in re.findall(r"[^\W\d_]+", text.lower()):
                edged = f"\1{word}\1"
                some = [*word, *(edged[k : k + 2] for k in range(len(word) + 1)), *(edged[k : k + 3] for k in range(len(word)))]
                found.update(some)
        order = sorted(found, key=lambda g: (-found[g], code(g)))
        return order[:400]

    def code(gram):
        value = 0
        for c in gram:
            value = (value << 21) | ord(c)
        return value

    profiles = {lang: counted(t for i, t, own in rows if own == lang and zlib.crc32(str(i).encode()) % 4 != 2) for lang in sorted(alphabet)}
    longest = max(map(len, profiles.values()))
    for r in predict_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect():
        own = counted([rows[r.doc_id][1]])[:longest]
        away = {lang: sum(abs(p.index(g) - k) if g in p else longest for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get) if own else "und"
        assert r.lang_pred == best
        assert abs(r.score - (1 - away[best] / (longest * len(own)) if own else 0)) < 1e-12
