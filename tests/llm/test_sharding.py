import zlib
from collections import Counter

import numpy as np

from parley.llm import sharding as s


def slow_jump(key, shards):
    key, b, j = key % (1 << 64), -1, 0
    while j < shards:
        b = j
        key = (key * s.MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_moves_rows_to_the_new_shard_only():
    keys = np.array([0, 1, -1, 7, 2**62, -(2**63), *range(1000, 6000)], np.int64)
    small, large = s.jump(keys, 40), s.jump(keys, 41)
    assert [slow_jump(int(k), 40) for k in keys[:300]] == small[:300].tolist()
    moved = small != large
    assert set(large[moved]) == {40} and 0.015 < moved.mean() < 0.035


def test_slots_are_gapless_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(s, "BLOCK_ROWS", 5)
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('t', id % 7) as text")
    rows = s.shard_documents(docs, 8).collect()
    for shard, n in Counter(r.shard for r in rows).items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    assert all(r.size == len(f"t{r.doc_id % 7}") + 16 and r.text_crc32 == zlib.crc32(f"t{r.doc_id % 7}".encode()) for r in rows)


def test_odd_rows(spark, odd, none):
    rows = s.shard_documents(odd).collect()
    assert len(rows) == 10 and {r.size for r in rows if r.doc_id in (2, 3)} == {16}
    assert len({(r.shard, r.slot) for r in rows}) == 10
    assert len({r.shard for r in rows if r.doc_id == 1}) == 1
    assert s.shard_documents(none).count() == 0
