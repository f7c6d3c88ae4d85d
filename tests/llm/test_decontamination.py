"""Winnowed windows against comparing all windows."""

import hashlib
import random
import re

import pytest

from mixolve.llm.decontamination import report, scan


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    windows = {}
    for name, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w and name is not None else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(name))
    for name, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= names
        yield name, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_same_as_all_windows(spark, block_bytes):
    rng = random.Random(block_bytes)
    vocabulary = ["a", "b", "c", "Über", "x1", "日本"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "\n"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 4, 9, 10, 11, 30, 60]))) for i in range(12)] + [(3, "a b"), (None, "c c c"), (77, None), (78, "...")]
    docs = [(i, text(rng.randint(0, 300)) + " " + rng.choice(items)[1].__str__() + " " + text(5)) for i in range(60)] + [(100, None), (101, ""), (102, "none of it")]
    got = report(scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes))
    assert sorted(map(tuple, got.collect())) == sorted(plain(docs, items))


def test_empty_tables_and_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, _leak int")
    none = spark.createDataFrame([], "item_id long, text string")
    got = scan(docs, none)
    assert got.columns == ["doc_id", "text", "_leak"] and report(got).collect()[0].contaminated is False
    assert scan(docs.limit(0), none).count() == 0


def test_a_phrase_of_many_items_and_many_blocks(spark):
    import time

    phrase = " ".join(f"p{i}" for i in range(12))
    items = [(str(i), f"a{i} b{i} {phrase} c{i} d{i}") for i in range(3000)] + [("x", "short one"), ("y", None), (None, phrase)]
    docs = [(1, f"z {phrase} " * 400), (2, f"a7 b7 {phrase} c7"), (3, "short one " * 5000 + "short"), (4, None), (5, phrase[:-4])]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, _leak int")
    bench = spark.createDataFrame(items, "item_id string, text string")
    began = time.time()
    for size in (1 << 25, 20_000):
        got = {r.doc_id: r for r in report(scan(df, bench, block_bytes=size)).collect()}
        assert [(got[i].n_words, got[i].n_hit, got[i].n_items) for i in (1, 2, 3, 4, 5)] == [(5200, 4800, 3000), (15, 15, 3000), (10001, 10000, 1), (0, 0, 0), (11, 11, 3000)]
    assert time.time() - began < 120


def test_a_very_long_text(spark):
    item = " ".join(f"q{i}" for i in range(30))
    long = "none of this " * 100_000
    docs = spark.createDataFrame([(1, long + item + " " + long), (2, long)], "doc_id long, text string")
    bench = spark.createDataFrame([("a", item), ("b", "elsewhere only")], "item_id string, text string")
    for size in (1 << 20, 50):
        got = {r.doc_id: r for r in report(scan(docs, bench, block_bytes=size)).collect()}
        assert (got[1].n_words, got[1].n_hit, got[1].n_items) == (600_030, 30, 1) and (got[2].n_words, got[2].n_hit) == (300_000, 0)
