import random
from collections import defaultdict

from parley.llm.packing import Bins, pack_documents


def test_tightest_compatible_bin():
    bins = Bins(10)
    assert [bins.add(7, 1, 0), bins.add(5, 2, 0), bins.add(3, 4, 0)] == [(0, 0), (1, 0), (0, 7)]
    assert bins.add(5, 2, 0)[0] == 2  # the tightest has the source
    assert bins.add(5, 8, 1)[0] == 1 and bins.add(4, 8, 1)[0] == 2 and bins.add(1, 16, 1)[0] == 3  # and the cluster


def test_each_piece_goes_where_brute_force_finds_least_room():
    rng = random.Random(4)
    for capacity in (12, 64):
        bins, room, held = Bins(capacity), [], []
        for _ in range(1500):
            size, source, cluster = rng.randrange(capacity + 1), rng.choice([0, 1, 2, 4, 8]), rng.choice([0, 0, 1, 2])
            fits = [r for r, (s, c) in zip(room, held, strict=True) if r >= size and not (s & source or c & cluster)]
            number, offset = bins.add(size, source, cluster)
            if fits:
                assert room[number] == min(fits)
            else:
                assert number == len(room)
                room.append(capacity)
                held.append((0, 0))
            assert offset == capacity - room[number] and not (held[number][0] & source or held[number][1] & cluster)
            room[number] -= size
            held[number] = (held[number][0] | source, held[number][1] | cluster)


def test_ids_may_be_texts_with_nulls(spark):
    docs = spark.createDataFrame([("b", "x y", "s"), (None, "x z", "s"), ("a", "y z", None)], "doc_id string, text string, source string")
    assert sorted(str(r.doc_id) for r in pack_documents(docs).collect()) == ["None", "a", "b"]


def test_bins_hold_their_constraints_and_every_word(spark):
    rows = [(i, " ".join(["w"] * (i * 37 % 90 + 1)), f"s{i % 5 if i % 3 else 0}") for i in range(700)]
    rows += [(1000 + i, "same text here", None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = pack_documents(docs, capacity=64, group_pieces=200).collect()
    text, source = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    words, bins = defaultdict(int), defaultdict(list)
    for r in found:
        words[r.doc_id] += r.n_words
        bins[r.bin_id].append(r)
    assert words == {i: len(t.split()) for i, t in text.items()}
    for held in bins.values():
        held.sort(key=lambda r: r.bin_offset)
        assert all(a.bin_offset + a.n_words == b.bin_offset for a, b in zip(held, held[1:], strict=False)) and held[0].bin_offset == 0
        assert sum(r.n_words for r in held) <= 64
        sources = [source[r.doc_id] for r in held if source[r.doc_id]]
        assert len(set(sources)) == len(sources)
        assert sum(text[r.doc_id] == "same text here" for r in held) <= 1
    assert {r.group for r in found} == set(range(len(found) // 200))  # groups follow pieces, not documents


def test_odd_rows(spark, odd, none):
    rows = pack_documents(odd).collect()
    assert sum(r.n_words for r in rows if r.doc_id == 5) == 8 * 3000
    assert [(r.n_pieces, r.n_words) for r in rows if r.doc_id in (2, 3, 4)] == [(1, 0)] * 3
    assert len({r.bin_id for r in rows if r.doc_id == 1}) == 2
    assert pack_documents(none).count() == 0
