import numpy as np
import pytest

from parley.llm import embeddings as e


def expected(rows):
    links = {i: set() for i, _, _ in rows}
    for a, (i, x, l) in enumerate(rows):
        for j, y, m in rows[a + 1 :]:
            if l is not None and l == m and len(x) == len(y):
                x_, y_ = np.float64(np.float32(x)), np.float64(np.float32(y))
                if x_ @ y_ / np.sqrt(x_ @ x_) / np.sqrt(y_ @ y_) >= 0.93:
                    links[i].add(j)
                    links[j].add(i)
    component = {}
    for i in sorted(links):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        component[i] = min(seen)
    return {i: (len(links[i]), component[i]) for i in links}


@pytest.mark.parametrize("block", [40, 2048])
def test_links_near_the_threshold_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(e, "BLOCK", block)
    monkeypatch.setattr(e, "BUCKET", 16)
    rng = np.random.default_rng(1)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(48)
        for _ in range(rng.integers(1, 12)):
            noise = rng.standard_normal(48) * rng.uniform(0.1, 0.35)
            rows.append((len(rows), (centre + noise).tolist(), c % 3))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(60)] + [(5000, rows[0][1], 1), (5001, [1.0, 2.0], 0)]
    want = expected(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: (r.n_links, r.component_id) for r in e.link_embeddings(df).collect()}
    assert sum(n for n, _ in found.values()) >= 0.999 * sum(n for n, _ in want.values())
    assert all(found[i][0] <= want[i][0] for i in want)  # none below the threshold
    assert found == want


def test_estimates_are_unbiased_and_within_their_bounds(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 64))
    x[200:] = x[:200] + 0.3 * x[200:]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turned = x @ e.rotation(64)
    codes, factors = e.encode(turned)
    error = e.estimate(codes[:200], factors[:200], turned[200:]) - x[:200] @ x[200:].T
    assert abs(error.mean()) < 0.005
    assert (np.abs(error) <= e.bound(factors[:200], 64)[:, None]).mean() > 0.999


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1, "x"), (2, [1.0, 0.0], None, "x"), (3, None, 1, "x"), (4, [0.0, 0.0], 1, "x"), (5, [nan, 1.0], 1, "x"),
        (6, [inf, 1.0], 1, "x"), (7, [None, 1.0], 1, "x"), (8, [], 1, "x"), (9, [2.0, 0.0], 1, "x"), (9, [2.0, 0.0], 1, "x"),
        (None, [1.0, 0.01], 1, None), (10, [0.0, 1.0], 2, None),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, key string")
    found = e.link_embeddings(df).collect()
    assert len(found) == 12
    assert {(r.n_links, r.component_id, r.kept) for r in found if r.vec_id == 9} == {(3, 1, False)}
    assert [(r.n_links, r.component_id, r.kept) for r in found if r.vec_id == 1] == [(3, 1, True)]
    assert [r.component_id for r in found if r.vec_id is None] == [1]
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in found if r.vec_id in (2, 3, 4, 5, 6, 7, 8, 10))
    assert e.link_embeddings(df.limit(0)).count() == 0


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e200, 0.0], 1), (2, [1e200, 1e199], 1), (3, [1e-200, 1e-201], 1), (4, [0.0, 5e-324], 1)]
    found = e.link_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found.collect()) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]
