import math
import random

from parley.llm import toxicity
from parley.llm.toxicity import buckets, held_out, log_count_ratios, score_documents, train


def corpus(spark, n=600):
    rng = random.Random(5)
    words = ["water", "table", "green", "house", "train", "paper", "river", "stone", "light", "bread"]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(40)]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(3):
                text[rng.randrange(40)] = "vile" + rng.choice(words)
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_labels_that_must_not_be_seen(spark):
    docs, labels = corpus(spark)
    found = {r.doc_id: r for r in score_documents(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    unseen = [r for r in found.values() if r.held_out]
    assert len(unseen) > 100 and sum(r.predicted == truth[r.doc_id] for r in unseen) >= 0.98 * len(unseen)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found.values())
    turned = labels.withColumn("toxic", (labels.toxic + held_out(labels.doc_id).cast("int")) % 2)
    again = {r.doc_id: r.score for r in score_documents(docs, turned).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in found.items())


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(None, 1), (1, None), (5, 0), (7, 1)], "doc_id long, toxic int")
    rows = score_documents(odd, labels).collect()
    assert len(rows) == 10 and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert score_documents(none, labels).count() == 0
    assert {r.score for r in score_documents(odd, labels.limit(0)).collect()} == {0.5}


def test_counts_and_ratios_are_those_of_brute_force(spark):
    docs, labels = corpus(spark, 80)
    rows = docs.join(labels, "doc_id").repartition(3)
    seen = [(set(buckets(r.text).tolist()), r.toxic) for r in rows.collect()]
    n = [sum(t == c for _, t in seen) for c in (0, 1)]
    expected = {}
    for b in set().union(*[x for x, _ in seen]):
        k = [sum(b in x for x, t in seen if t == c) for c in (0, 1)]
        share, gap = sum(k) / sum(n), abs(k[1] / n[1] - k[0] / n[0])
        clear = gap / math.sqrt(share * (1 - share) * (1 / n[1] + 1 / n[0]) + 1e-12)
        expected[b] = (math.log((k[1] + 1) / (n[1] + 2)) - math.log((k[0] + 1) / (n[0] + 2)), clear)
    found = {r.bucket: (r.ratio, r.clear) for r in log_count_ratios(rows, {0: n[0], 1: n[1]}).collect()}
    assert found.keys() == expected.keys()
    assert all(abs(x - y) < 1e-9 * (1 + abs(y)) for b in found for x, y in zip(found[b], expected[b], strict=True))


def test_a_rare_class_is_always_in_the_sample(spark):
    docs, _ = corpus(spark, 400)
    rows = docs.selectExpr("doc_id", "text", "int(doc_id = 5) toxic")
    totals = {0: 399, 1: 1}
    sample = toxicity.fit_sample(rows, totals, 40).collect()
    assert sum(r.toxic for r in sample) == 1 and 15 < len(sample) < 75
    assert train(rows, fit_rows=2).score("vile words") <= 1
