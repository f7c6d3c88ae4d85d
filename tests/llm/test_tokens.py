"""Token output against encode() on whole texts."""

import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

from mixolve.llm.queries import tokenizer_file
from mixolve.llm.tokens import UNSAFE, Encoder, read_tokens, token_output, write_tokens

BITS = ["the", "Word", "it's", "'s", "é", "über", "日本語", "1234", "½", " ", "  ", "\n", "\t", " ", "\u0085", "\x1c", "̈", "á", ",", "...", "%%%", "_", "<", "<|endoftext|>", "<|", "😀", "x" * 80, "\nline", "\nB,", "\n\n", "don't!!", "(a)", "Ⅷ", "＝", "≠"]


def texts():
    rng = random.Random(5)
    made = ["", " ", "a", " a", "a ", "a  b", "a   b", "a\n b", "a \nb", "x's y", "end.", "... ...", "a b c" * 50]
    return made + ["".join(rng.choice(BITS) + rng.choice(["", " ", " ", " "]) for _ in range(rng.randint(1, 30))) for _ in range(600)]


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_encoding_equals_encoding_whole_texts(name, spaced):
    enc = Encoder(tokenizer_file(name), spaced, entries=50)
    some = texts()
    for at in range(0, len(some), 37):
        part = some[at : at + 37]
        ids, ends = enc.encode(pa.array(part, pa.string()))
        for i, t in enumerate(part):
            assert ids[ends[i] : ends[i + 1]].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_met_before_take_no_step_of_python_each(name, spaced):
    enc = Encoder(tokenizer_file(name), spaced)
    words = [f"{chr(97 + i % 26)}x{i}" for i in range(10_000)]
    enc.encode(pa.array([" ".join(words)]))
    steps = 0

    def count(frame, event, arg):
        nonlocal steps
        steps += event in ("call", "c_call")

    text = " ".join(w + p for w in words for p in ("", ".", ",", "!?"))
    sys.setprofile(count)
    try:
        ids, ends = enc.encode(pa.array([text]))
    finally:
        sys.setprofile(None)
    assert ids.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids and ends.tolist() == [0, len(ids)]
    assert steps < 2000


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_columns_of_words_are_cut_as_single_words_are(name, spaced):
    enc = Encoder(tokenizer_file(name), spaced)
    rng = random.Random(6)
    bits = [*"aZé1½Ⅷ日", *".,'_<%`", "!?", "\n", "\t", "\x1c", "\u0085", "\u3000", "\u0308", "＝", "😀"]
    words = sorted({"", *("".join(rng.choices(bits, k=rng.randint(1, 5))) for _ in range(5000))})
    odd, base, tail = enc._cut(pa.array(["left out", *words]).slice(1), enc.lead)
    made = enc._learn(words, enc.lead)
    assert [made[w] is UNSAFE for w in words] == odd.tolist()
    for w, o, b, t in zip(words, odd, base.to_pylist(), tail.to_pylist()):
        assert (b, t) == ("", "") if o else b + t == w and (not t or b[-1].isalnum() and not t.strip(enc.PUNCTUATION)), repr(w)
    assert enc.SPACE == "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())


def test_memory_is_bounded_and_keeps_what_most_batches_hold():
    enc = Encoder(tokenizer_file("byte_bpe_50k.json"), True, entries=100)
    for i in range(30):
        texts = ["first " + " ".join(["often", "seen,", *(f"rare{i}x{j}" for j in range(70))])]
        ids, _ = enc.encode(pa.array(texts))
        assert ids.tolist() == enc.tokenizer.encode(texts[0], add_special_tokens=False).ids
        assert len(enc.memory.pieces) == len(enc.memory.size) <= 100 and len(enc.memory.flat) == enc.memory.size.sum()
        assert {"often", "seen"} <= set(enc.memory.pieces.to_pylist())
    enc.encode(pa.array(["a " + "y" * 65]))
    assert "y" * 65 not in enc.memory.pieces.to_pylist()
    assert [x.tolist() for x in enc.encode(pa.array([], pa.string()))] == [[], [0]]
    assert [x.tolist() for x in enc.encode(pa.array(["", ""]))] == [[], [0, 0, 0]]


def test_token_files_hold_every_document_in_order(spark):
    enc = Encoder(tokenizer_file("byte_bpe_50k.json"), True)
    rows = [(7, "seven of them"), (3, None), (5, ""), (None, "no id"), (7, "seven of them"), (7, "another"), (1, "word " * 5000)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_tokens int, part string")
    got = token_output(spark, docs, tokenizer_file("byte_bpe_50k.json")).collect()
    want = {}
    for i, t in rows:
        ids = np.array([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted(x for v in want.values() for x in v)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, 1, 3, 5, 7, 7, 7]


def test_empty_table_and_selective_read(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_output(spark, docs, tokenizer_file("byte_bpe_50k.json")).count() == 0
    path = str(tmp_path / "t")
    write_tokens(spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string"), path, tokenizer_file("byte_bpe_50k.json"))
    plan = read_tokens(spark, path, tokens=False)
    assert plan.columns == ["id", "start", "n_tokens"]
    assert "tokens:array" not in plan._jdf.queryExecution().executedPlan().toString()
    assert [(r.id, r.start) for r in plan.orderBy("id").collect()] == [(1, 0), (2, 3)]
