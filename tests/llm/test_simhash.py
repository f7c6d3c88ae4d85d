"""Fingerprints and components against brute force."""

import re

import numpy as np
import pytest
import xxhash

from mixolve.llm.simhash import GrayTree, fingerprint, groups, one_of_each, simhash_groups


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(ids, codes, limit):
    codes = np.array(codes, np.int64).view(np.uint64)
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= limit
    now = np.array(ids)
    while True:
        new = np.array([now[row].min() for row in near])
        if (new == now).all():
            return now
        now = new


def codes(seed, n=30):
    rng, out = np.random.default_rng(seed), []
    for b in rng.integers(-(1 << 63), (1 << 63) - 1, n):
        now = int(b) & (1 << 64) - 1
        for _ in range(rng.integers(1, 40)):
            for bit in rng.integers(0, 64, rng.integers(0, 4)):
                now ^= 1 << int(bit)
            out.append(now - (1 << 64) if now >> 63 else now)
    return out + [0] * 20 + [-1, -2, -4]


def test_fingerprints():
    for t in [None, "", "One", "a b", "A b\tC d", "é É Ä", "x\x0by\x0cz w" * 40, "nb sp one\x1ctwo three four"]:
        assert fingerprint(t) & (1 << 64) - 1 == plain_fingerprint(t), t


@pytest.mark.parametrize("limit, part_rows", [(2, None), (2, 9), (3, 50)])
def test_components_are_those_of_all_pairs(spark, limit, part_rows):
    made = codes(limit)
    ids = np.random.default_rng(0).permutation(len(made)).tolist()
    df = spark.createDataFrame(list(zip(ids, made)), "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in groups(df, limit=limit, part_rows=part_rows).collect()}
    assert [got[i] for i in ids] == plain_components(ids, made, limit).tolist()


def test_tree_finds_all_within_the_limit():
    c = np.unique(np.array(codes(7), np.int64)).view(np.uint64)
    found = {(int(a), int(b)) for q, leaf in GrayTree(c, c, 4).search(c, 3, most=64) for a, b in zip(q, leaf)}
    near = np.bitwise_count(c[:, None] ^ c[None]) <= 3
    assert found == set(zip(*map(lambda x: x.tolist(), np.nonzero(near))))


def test_odd_rows(spark):
    rows = [(3, "a b c d"), (1, "A b C d"), (None, "a b c d"), (7, None), (6, ""), (9, " \n"), (3, "a b c d")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component_id int")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash_groups(df).collect())
    assert got == [(-1, 1), (1, 1), (3, 1), (3, 1), (6, 6), (7, 6), (9, 6)]
    kept = one_of_each(df).collect()
    assert len(kept) == 2 and kept[0].asDict().keys() == {"doc_id", "text", "component_id"}
    assert simhash_groups(df.limit(0)).count() == 0 and one_of_each(df.limit(0)).count() == 0


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 977} x{i % 31}" for i in range(150_000))
    assert fingerprint(long) & (1 << 64) - 1 == plain_fingerprint(long)
    df = spark.createDataFrame([(1, long), (2, long.upper()), (3, "something else in here")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in simhash_groups(df).collect()) == [(1, 1), (2, 1), (3, 3)]
