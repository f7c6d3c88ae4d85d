"""Every figure of the alignment against token by token loops; remembered words against whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from mixolve.llm.alignment import Pair, align, linked, token_alignment
from mixolve.llm.queries import tokenizer_file

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a", " a", "  a", "a ", "a  b", "\n", "\na", "a\n", "a\nb\n\nc", "a \n b", "\ta\tb", "a b", "a　b", "x▁y", "▁", "<s> </s> <unk> <0x41> <|endoftext|>", "<|endoftext|>", "é é ﬁ",
    "日本語 テキスト", "😀😀 👩‍👩‍👧", "don't. ... 'll ''s", "=" * 300, "ab" * 400, " " * 50 + "x", "\x00\x01 \x7f", "Ǆ ß ẞ İ", "a\r\nb", "12345 6,789.0", "﻿x", "𐍈", "ก็ ที่",
]


def sample(n=150, seed=1):
    rng = random.Random(seed)
    words = ["one", "Two", "three,", "vier!", "don't", "naïve", "日本", "\nLine", "x\ny", "(see", "1234", "http://a.b/c?d=e", "...", "ultracrepidarian", "'s", "a\tb", "Größe."]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 30, 200]))) for _ in range(n)]


def byte_level():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back, extra = {}, 256
    for b in range(256):
        back[chr(b) if b in shown else chr(extra)] = b
        extra += b not in shown
    return back


def brute(rows):
    tok, sp, back = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_level()
    tok.encode_special_tokens = True
    docs, counts = [], Counter()
    for i, text in rows:
        want = (" " + (text or "")).encode()
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        bytes_a = [bytes(back[c] for c in tok.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(b, sp.id_to_piece(b))]
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            docs.append((i, 0, 0, [], []))
            continue
        groups, x, y, x0, y0 = [], 0, 0, 0, 0
        here, there = 0, 0
        while x < len(a) or y < len(b):
            if here <= there:
                here += len(bytes_a[x])
                x += 1
            else:
                there += len(bytes_b[y])
                y += 1
            if here == there:
                groups.append((a[x0:x], b[y0:y]))
                x0, y0 = x, y
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        counts.update(set(links))
        docs.append((i, len(a), len(b), groups, links))
    top = Counter()
    for (p, _), n in counts.items():
        top[p] = max(top[p], n)
    out = []
    for i, n, m, groups, links in docs:
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((i, n, m, len(groups), len(links), sum(counts[x] == top[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("parts", [1, 5])
def test_as_token_by_token(spark, parts):
    rows = [(i, t) for i, t in enumerate(ODD + sample())] + [(3, "a"), (3, "a"), (None, "one Two")]
    docs = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, chunk int, keys string, place int").repartition(parts)
    got = token_alignment(docs, A, B).collect()
    assert in_order(got) == in_order(brute(rows))
    assert [r.n_a for r in got if r.doc_id == ODD.index("x▁y")] == [0]


def test_remembered_words_give_what_whole_texts_give():
    texts = [t for t in ODD if t] + sample(300, 7)
    both = Pair(A, B, 50)
    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    for some in (texts[:100], texts[100:], texts):
        (ids, at), (ids_b, at_b) = both.encode(pa.array(some))
        assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == [tok.encode(" " + t, add_special_tokens=False).ids for t in some]
        assert [ids_b[i:j].tolist() for i, j in zip(at_b[:-1], at_b[1:])] == [sp.encode(t) for t in some]


def test_links_of_large_groups_and_in_blocks():
    rng = np.random.default_rng(3)
    sizes = [(2, 3), (90, 70), (1, 1), (40, 40), (1, 2)]
    ga, gb = (np.repeat(np.arange(5), [s[i] for s in sizes]) for i in (0, 1))
    a, b = rng.integers(0, 9, len(ga)), rng.integers(0, 7, len(gb))
    doc = np.array([0, 0, 1, 2, 2])
    want = Counter(doc[g] * 63 + x * 7 + y for g, x in zip(ga, a) for h, y in zip(gb, b) if g == h)
    for most in (1, 50, 1 << 20):
        keys, times = linked(ga, a, gb, b, doc, 7, 63, most)
        assert dict(zip(keys.tolist(), times.tolist())) == want


def test_empty_and_a_very_long_text(spark):
    assert token_alignment(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    rows = [(1, "one Two\nthree, " * 100_000), (2, "one Two")]
    assert in_order(token_alignment(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()) == in_order(brute(rows))
    none = align(pa.array([""]), Pair(A, B))
    assert none["n_links"].tolist() == [0] and none["groups_sha256"] == [""]
