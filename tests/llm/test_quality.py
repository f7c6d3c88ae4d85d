"""Held-out accuracy, compiled rules, and tables without labels."""

import random
import zlib

from mixolve.llm.quality import Rule, RuleEnsemble, keep_good, score_documents


def corpus(n=400):
    rng, docs, labels = random.Random(6), [], []
    for i in range(n):
        words = ["".join(rng.choice("aeiorstln") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 200))]
        kind = i % 4
        text = " ".join(words) + "."
        if kind == 0:
            text = rng.choice([" ".join(w.upper() + "!!" for w in words), " | ".join(words), " ".join([words[0]] * 150)])
        docs.append((i, text, 1))
        labels.append((i, int(kind != 0)))
    return docs, labels


def test_learns_on_one_fold_and_scores_all(spark):
    docs, labels = corpus()
    more = [(1000, None, 1), (1001, "", 1), (None, "some words here", 1), (3, docs[3][1], 1), (1002, "long " * 200_000, 1)]
    d = spark.createDataFrame(docs + more, "doc_id long, text string, score int")
    l = spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, quality int")
    got = score_documents(d, l).collect()
    assert len(got) == len(docs) + len(more) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and len(held) > 50
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    kept = keep_good(d, l)
    assert kept.columns == ["doc_id", "text", "score"]
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in got if r.predicted)


def test_without_labels_the_score_is_constant(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score_documents(d, none).collect()} == {0.5}
    assert score_documents(d.limit(0), none).count() == 0


def test_rules_are_columns(spark):
    rule = Rule((("a", 1.0, 2.0), ("b", float("-inf"), 0.0)))
    df = spark.createDataFrame([(1.5, 0.0), (1.0, 0.0), (2.0, -1.0), (1.5, 0.1)], "a double, b double")
    assert [r[0] for r in df.select(rule.column()).collect()] == [True, False, True, False]
    scores = [r[0] for r in df.select(RuleEnsemble(0.0, [(rule, 2.0)]).score()).collect()]
    assert [round(s, 4) for s in scores] == [0.8808, 0.5, 0.8808, 0.5]
