import random
import re

import xxhash

from parley.llm.simhash import fingerprint, keep_one_of_each, link_fingerprints, simhash_components


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint(spark):
    for text in (None, "", " \n", "One", "One two Three", "a b c d", "a b c d e f a b c d", "\u00c9\u00a0x y z w v \u0130"):
        assert fingerprint(text) % (1 << 64) == slow(text)


def test_groups_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    centres = [rng.getrandbits(64) for _ in range(40)]
    values = set(centres)
    for c in centres[:20]:
        for _ in range(60):  # dense groups, and chains of them
            for bit in rng.sample(range(64), rng.randrange(1, 7)):
                c ^= 1 << bit
            values.add(c)
            c = rng.choice([c, centres[0], centres[1]])
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if ((a ^ b) % (1 << 64)).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    nodes = spark.createDataFrame([(v, 1 + v % 3) for v in values], "fp long, n long")
    found = {r.fp: r.root for r in link_fingerprints(nodes).collect()}
    groups = lambda of: sorted(sorted(v for v in values if of(v) == r) for r in {of(v) for v in values})
    assert groups(found.get) == groups(find)


def test_odd_rows(spark, odd, none):
    rows = simhash_components(odd).collect()
    assert len(rows) == 10
    assert {r.component_id for r in rows if r.doc_id in (2, 3, 4)} == {2}
    assert {r.fingerprint for r in rows if r.doc_id in (2, 3, 4)} == {"0" * 16}
    assert simhash_components(none).count() == 0
    kept = keep_one_of_each(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 2, None, 5}
    assert 3 not in {r.doc_id for r in kept.collect()}


def test_rows_are_kept_not_ids(spark):
    x, y, z = (" ".join(f"{w}{i}" for i in range(60)) for w in ("ox", "yak", "zebu"))
    rows = [(1, x, "a"), (2, x, "b"), (2, y, "c"), (3, z, "d"), (3, z, "d"), (None, "one " + y, "e"), (None, "q w e r t", "f"), (None, "q w e r t", "f")]
    kept = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, root string")).collect()
    near = (fingerprint(y) ^ fingerprint("one " + y)) % (1 << 64)
    expected = [rows[0], rows[2], rows[3], rows[6]] + ([rows[5]] if near.bit_count() > 4 else [])
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, expected))
