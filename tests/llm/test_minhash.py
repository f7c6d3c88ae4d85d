"""Near copies by Jaccard similarity, planted between 0.8 and 0.95 and below."""

import random

import numpy as np

import corpus_pipeline
from mixolve.llm.common import components
from mixolve.llm.minhash import shingles, similar_edges


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both)


def test_the_stage_drops_copies_of_similarity_080_and_more(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeiorstln") for _ in range(7))
    docs, drop = [], 0
    for i in range(60):
        words = [word() for _ in range(200)]
        docs.append((2 * i, " ".join(words)))
        changed = list(words)
        for k in range(1 + i % 7):  # of 196 shingles each change takes five
            changed[10 + 25 * k] = word()
        docs.append((2 * i + 1, " ".join(changed)))
        drop += similarity(docs[-2][1], docs[-1][1]) >= 0.8
    assert 0.8 <= min(s for i in range(60) if (s := similarity(docs[2 * i][1], docs[2 * i + 1][1])) >= 0.8) < 0.85 and 30 <= drop < 60
    docs += [(1000, "Few words"), (1001, "few  WORDS"), (1002, "few other"), (1003, None), (1004, " ")]
    kept = corpus_pipeline.distinct(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    assert sum(r.doc_id < 1000 for r in kept) == 120 - drop
    assert len({r.doc_id for r in kept} & {1000, 1001}) == 1 and len({r.doc_id for r in kept} & {1003, 1004}) == 1


def test_pairs_of_a_bucket_that_its_neighbours_do_not_link_are_compared(spark):
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**9)}" for _ in range(204)]
    docs = []
    for i in range(40):  # 40 ends of 0.7 to each other, each with one twin of 0.85 or more
        words = list(base)
        for k in range(4):
            words[10 + rng.randrange(38) * 5] = f"x{i}y{k}"
        docs.append(words)
        docs.append([*words[:198], f"t{i}", *words[199:]])
    texts = [" ".join(w) for w in docs]
    root = list(range(80))
    for a in range(80):
        for b in range(a):
            if similarity(texts[a], texts[b]) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string")
    linked = components(similar_edges(rows, spark.createDataFrame([], "a long, b long")), "a", "b")  # SimHash links would join more
    found = {r.node: r.root for r in linked.collect()}
    assert [found.get(i, i) for i in range(80)] == root and len(set(root)) > 1
