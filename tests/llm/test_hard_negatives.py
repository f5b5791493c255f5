import math

import numpy as np
import pytest

from parley.llm import hard_negatives as h


def expected(rows, positives=5, negatives=3):
    """The plain rule over all pairs."""
    sound = [(i, l, [math.floor(256 * x) for x in v]) for i, l, v in rows if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    order = lambda pair: (-pair[0], pair[1] is None, pair[1] or 0)
    for a, (i, l, x) in enumerate(sound):
        if i is None or i % 50:
            continue
        others = [(sum(p * q for p, q in zip(x, y, strict=True)), j, m) for b, (j, m, y) in enumerate(sound) if b != a and len(x) == len(y)]
        others.sort(key=order)
        for p, j, _ in [o for o in others if o[2] == l][:positives]:
            inside = [(s, k) for s, k, m in others if m != l and 50 * p <= 100 * s <= 95 * p][:negatives]
            found += [(i, j, n, k, p, s) for n, (s, k) in enumerate(inside, 1)]
    return sorted(found, key=str)


def mined(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "'x' rid", "1 place", "'y' code")
    return sorted([tuple(r) for r in h.mine_hard_negatives(df).collect()], key=str)


def vectors(n, dims, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dims))
    return [(i, int(rng.integers(0, 4)), (centres[rng.integers(0, 6)] + 0.5 * rng.standard_normal(dims)).tolist()) for i in range(n)]


def test_planes_and_subset_sums_give_exact_products():
    rng = np.random.default_rng(1)
    values = rng.integers(-1000, 1000, (40, 19))
    planes = h.planes_for(values.min(), values.max(), 19)
    packed = h.pack(values, planes)
    assert (h.unpack(packed, 19) == values).all()
    for anchor in values[:5]:
        found = h.scores(h.subset_sums(anchor), packed.transpose(1, 2, 0).astype(np.intp))
        assert (found == values @ anchor).all()
    assert h.planes_for(-256, 255, 64) == 9 and h.planes_for(0, 0, 1) == 1
    with pytest.raises(ValueError, match="64 bits"):
        h.planes_for(0, 1 << 40, 64)


@pytest.mark.parametrize("sizes", [(2, 16), (1024, 8192)])
def test_negatives_match_all_pairs(spark, monkeypatch, sizes):
    monkeypatch.setattr(h, "ANCHORS", sizes[0])
    monkeypatch.setattr(h, "ROWS", sizes[1])
    rows = vectors(300, 19)
    rows += [(1000 + k, 2, rows[0][2]) for k in range(30)] + [(2000 + k, 3, rows[0][2]) for k in range(30)]  # ties
    rows += [(50, 1, rows[7][2]), (50, 1, rows[7][2])]  # rows that repeat an id
    assert mined(spark, rows) == expected(rows) != []


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(120, 8, 5) + [
        (150, None, [1.0] * 8), (200, 1, None), (250, 1, [nan] * 8), (300, 1, [inf] + [0.0] * 7), (350, 1, [None] * 8), (None, 1, [0.5] * 8),
        (None, 2, [0.4] * 8), (400, 1, []), (401, 1, []), (402, 2, []), (450, 1, [0.5, 0.25]), (451, 1, [0.5, 0.25]), (452, 2, [0.25, 0.25]), (500, 9, [0.1] * 8), (-50, 1, [0.3] * 8),
    ]
    found = mined(spark, rows)
    assert found == expected(rows)
    assert {r[0] for r in found} >= {-50, 0, 400, 450} and (400, 401, 1, 402, 0, 0) in found
    assert mined(spark, []) == [] and mined(spark, rows[1:40]) == []
