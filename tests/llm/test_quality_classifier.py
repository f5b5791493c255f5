import random
from collections import Counter

import numpy as np

from parley.llm import quality_classifier as q


def corpus(spark, n=500):
    rng = random.Random(4)
    words = ["water", "table", "Green", "house", "train", "paper", "river", "stone", "light", "bread"]
    rows, labels = [], []
    for i in range(n):
        text, good = [rng.choice(words) for _ in range(30)], int(i % 4 != 0)
        if not good:
            text = [w + "%%%" if i % 8 else w.upper() for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, good))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def plain(text):
    """The features one by one."""
    points = lambda x: [ord(c) + 1 for c in x]
    mask, odd = (1 << 64) - 1, int(q._ODD)
    bucket = lambda code: (((code ^ (code >> 31)) * odd) & mask) >> (64 - q.BITS)
    words = text.split()
    hashes = [sum(p * odd ** (k + 1) for k, p in enumerate(points(w))) & mask for w in words]
    found = [bucket(h) for h in hashes]
    found += [q.REPEATED if a == b else bucket((a * 31 + b) & mask) for a, b in zip(hashes, hashes[1:], strict=False)]
    for n in q.LENGTHS:
        codes = [0]
        for w in words:
            codes += [*points(w), 0]
        for k in range(len(codes) - n + 1):
            if all(codes[k + 1 : k + n - 1]):
                code = n
                for c in codes[k : k + n]:
                    code = (code * 0x100000001B3 + c) & mask
                found.append(bucket(code))
    return Counter(found)


def test_features_are_those_of_plain_loops():
    for text in ["", "  ", "a", " a  bb\n\ncc cc ", "Été %%% straße \U0001f600 x", "word " * 50]:
        assert Counter(q.features(text).tolist()) == (plain(text) if text.split() else Counter())
    assert len(q.features(None)) == 0 and q.REPEATED in q.features("no no")


def test_held_out_accuracy_and_labels_that_must_not_be_seen(spark):
    docs, labels = corpus(spark)
    found = {r.doc_id: r for r in q.score_quality(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    unseen = [r for r in found.values() if r.held_out]
    assert len(unseen) > 60 and sum(r.predicted == truth[r.doc_id] for r in unseen) >= 0.98 * len(unseen)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    turned = labels.withColumn("quality", (labels.quality + q.held_out(labels.doc_id).cast("int")) % 2)
    again = {r.doc_id: r.score for r in q.score_quality(docs.repartition(3), turned).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in found.items())


def test_one_number_a_feature_scores_as_the_whole_network():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(1 << q.BITS, 20, replace=False)), np.full(20, 0.05, np.float32)) for _ in range(40)]
    good = rng.integers(0, 2, 40)
    model = q.fit(rows, good, np.ones(40, np.float32))
    found = np.array([model.weights[at].mean() + model.bias for at, _ in rows])
    assert ((found > 0) == (good == 1)).all()


def test_copies_count_once_and_a_rare_class_is_always_in_the_sample(spark):
    docs, _ = corpus(spark, 400)
    copies = spark.range(1000, 4000).selectExpr("id doc_id", "'the same words again' text")
    docs = docs.unionAll(copies).unionAll(docs.where("doc_id = 5"))
    labels = docs.selectExpr("doc_id", "int(doc_id != 5) good")
    some, share = q.sample_labels(labels.unionAll(labels), 400)
    assert share == {0: 1.0, 1: 399 / 3399} and 300 < some.count() < 500
    found = q.fit_sample(docs, some).collect()
    assert sum(r.good == 0 for r in found) == 1
    assert len(found) == len({(r.key, r.good) for r in found}) <= 90
    assert 0 < q.train(docs, labels, fit_rows=400).score("some words") < 1


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(None, 1), (1, None), (5, 0), (7, 1), (8, 1), (8, 0), (4, 7)], "doc_id long, quality int")
    rows = q.score_quality(odd, labels).collect()
    assert len(rows) == 10 and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1 and len({r.score for r in rows if r.doc_id == 1}) == 1
    assert q.score_quality(none, labels).count() == 0
    assert {r.score for r in q.score_quality(odd, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in q.score_quality(odd, labels.where("quality = 1")).collect()} == {0.5}
