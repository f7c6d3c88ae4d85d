"""Paths of reply trees, ranks, and the template read back."""

import hashlib

from mixolve.llm.chat import conversations, paths, read_back, threads

TREE = [("t", 1, None), ("t", 2, 1), ("t", 3, 1), ("t", 4, 3), ("t", 5, 99), ("u", 1, None), (None, 1, None), (None, 2, 1), ("c", 1, 2), ("c", 2, 1), ("c", 3, 2)]


def test_paths_of_trees(spark):
    got = {}
    for r in paths(spark.createDataFrame(TREE, "tree string, node long, parent long")).collect():
        got.setdefault((r.tree, r.leaf), []).append((r.up, r.node))
    assert {k: [n for _, n in sorted(v, reverse=True)] for k, v in got.items()} == {("t", 2): [1, 2], ("t", 4): [1, 3, 4], ("t", 5): [5], ("u", 1): [1], (None, 2): [1, 2]}


def test_long_threads_take_few_rounds(spark):
    rows = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)], "conv_id long, turn long, role string, text string")
    got = read_back(conversations(threads(rows))).first()
    assert [t.text for t in got.turns] == [f"t{i}" for i in range(300)]
    assert got.loss_text == "".join(f"t{i}" for i in range(1, 300, 2))


def test_branches_are_ranked_by_score(spark):
    rows = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 1.0), ("t", 3, 1, "assistant", "good", 5.0), ("t", 4, 1, "assistant", "none", None)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    assert [(r.leaf, r.branch, r.score) for r in conversations(df).orderBy("branch").collect()] == [(3, 1, 5.0), (2, 2, 1.0), (4, 3, 0.0)]
    best = conversations(df, branches=1).collect()
    assert [r.leaf for r in best] == [3] and best[0].formatted == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\ngood<|im_end|>\n"
    span = best[0].loss[0]
    assert best[0].formatted[span.start : span.start + span.length] == "good"


def test_control_strings_come_back(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "&lt;|&amp;<|", "&amp;lt;|", "a<", "", "😀é\n<|im_end|>\n", "&nl;"]
    rows = [(1, i, "assistant", t, 9) for i, t in enumerate(odd)] + [(2, 0, None, None, 9), (2, None, "us\ner&nl;", "first", 9), (None, 0, "user", "x", 9), (2, 0, "assistant", "same turn", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, leaf int")
    got = {r.tree: r for r in read_back(conversations(threads(df))).collect()}
    assert [t.text for t in got[1].turns] == odd and got[1].loss_text == "".join(odd)
    assert [(t.role, t.text) for t in got[2].turns] == [("us\ner&nl;", "first"), ("", ""), ("assistant", "same turn")]
    assert hashlib.sha256(got[None].loss_text.encode()).hexdigest() == hashlib.sha256(b"").hexdigest()
    assert conversations(threads(df.limit(0))).count() == 0


def test_a_very_long_text_comes_back(spark):
    long = "word <|im_end|> & " * 60_000
    rows = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    got = read_back(conversations(threads(rows))).first()
    assert [t.text for t in got.turns] == [long, long] and got.loss_text == long
