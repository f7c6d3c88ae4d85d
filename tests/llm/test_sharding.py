"""Best-fit-decreasing against placing pieces one by one; shards of documents."""

import random
import zlib

import pytest

from mixolve.llm.sharding import RoomTree, best_fit_decreasing, into_bins, shard, shard_documents


def one_by_one(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            best = min(fits, key=lambda i: (rooms[i], i))
            rooms[best] -= s
        else:
            rooms.append(capacity - s)
    return rooms


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_packed_as_single_pieces_would_be(seed):
    rng = random.Random(seed)
    runs = [(s, rng.randint(1, 30)) for s in rng.sample(range(1, 90), 12)]
    placed = best_fit_decreasing(runs, 100)
    rooms = {}
    for k, a, b, which in placed:
        rooms[which] = rooms.get(which, 100) - runs[k][0] * (b - a)
    assert sorted(rooms.values()) == sorted(one_by_one([s for s, n in runs for _ in range(n)], 100))
    for k, (_, n) in enumerate(runs):
        assert sorted(i for r, a, b, _ in placed if r == k for i in range(a, b)) == list(range(n))


def test_tree_gives_the_tightest_bin():
    rng, tree, plain = random.Random(1), RoomTree(), set()
    for i in range(500):
        if plain and rng.random() < 0.4:
            size = rng.randint(0, 50)
            want = min((x for x in plain if x[0] >= size), default=None)
            assert tree.take(size) == want
            plain.discard(want)
        else:
            plain.add((rng.randint(0, 60), i))
            tree.add(max(plain, key=lambda x: x[1])[0], i)


def test_a_group_over_an_even_share_gets_its_own_bin():
    placed = into_bins([(1000, 1), (10, 300)], 4)
    totals = {}
    for k, a, b, which in placed:
        totals[which] = totals.get(which, 0) + (1000, 10)[k] * (b - a)
    assert sorted(totals.values()) == [1000, 1000, 1000, 1000]
    assert best_fit_decreasing([(5, 1)], 4) is None


def test_documents(spark):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 400), "c") for i in range(600)] + [(1000 + i, "same text", "c") for i in range(300)]
    rows += [(2000, None, None), (2001, "", None), (None, "é", None), (5, "twice", None), (5, "twice", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = shard_documents(df, 8).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == sorted((i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    homes = {}
    for r in got:
        homes.setdefault(r.digest, set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    totals = [sum(r.size for r in got if r.shard == k) for k in range(8)]
    assert max(totals) - min(totals) < 0.02 * sum(totals)


def test_empty_and_capacity(spark):
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string"), 16).count() == 0
    df = spark.createDataFrame([(i, f"g{i % 7}", 10) for i in range(70)], "id long, g string, n long")
    got = shard(df, group_col="g", size_col="n", capacity=200).collect()
    assert {r.g: r.shard for r in got} and len({r.shard for r in got}) == 4


def test_ranks_are_gapless_over_slices(spark):
    from mixolve.llm.common import ranked

    df = spark.createDataFrame([(None if i % 3 == 0 else i % 3, i // 2) for i in range(3000)], "k int, v int")
    got = {}
    for r in ranked(df, ["k"], ["v"], "rank", 50).collect():
        got.setdefault(r.k, []).append(r.rank)
    assert {k: sorted(v) for k, v in got.items()} == {None: list(range(1000)), 1: list(range(1000)), 2: list(range(1000))}


def test_capacity_is_never_passed(spark):
    rng = random.Random(4)
    sizes = [rng.randint(50_000, 90_000) for _ in range(400)] + [2_000_000]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "g long, size long, _class string")
    held = {}
    for r in shard(df, group_col="g", size_col="size", capacity=1_000_000).collect():
        held.setdefault(r.shard, []).append(r.size)
    assert all(sum(v) <= 1_000_000 or v == [2_000_000] for v in held.values()) and len(held) <= sum(sizes) / 1_000_000 * 1.05 + 3


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "é" * 2_000_000), (2, "a"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r["size"] for r in shard_documents(df, 2).collect()} == {1: 4_000_001, 2: 2, 3: 1}
