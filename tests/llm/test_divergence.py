"""Every value of the audit against whole sums in plain Python, with light and heavy terms and small tiles."""

import random
import re
from collections import Counter, defaultdict

import pytest

from mixolve.llm.divergence import audit, words


def brute(rows, least, top=50):
    groups, docs, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", low)
        groups[lang, source].update(found)
        docs[lang].update(set(found))
        total[lang].update(found)
    out = []
    for (lang, source), count in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = lambda c: sum(c[t] for t in kept)
        p = lambda c, t: 1 + 10**9 * (c[t] + 5) // (whole(c) + 5 * len(kept))
        pairs = [(sum(abs(p(count, t) - p(c, t)) for t in kept), s) for (l, s), c in groups.items() if l == lang and s != source]
        terms = [(p(count, t) - p(total[lang], t), t) for t in kept if count[t]]
        for part, found in (("pair", pairs), ("term", [x for x in terms if x[0] > 0])):
            ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ordered) if part == "pair" or i < top]
    return sorted(out)


@pytest.mark.parametrize("cuts", [{}, {"light": 2, "block": 3, "terms_per_chunk": 5, "values_per_chunk": 2}, {"light": 100}, {"light": 0, "terms_per_chunk": 7}])
def test_as_whole_sums(spark, cuts):
    rng = random.Random(4)
    vocabulary = [f"w{'abcdefghij'[i % 10]}{'klmnopq'[i // 10]}" for i in range(60)]
    rows = []
    for i in range(700):
        source = f"s{min(int(rng.expovariate(0.4)), 10)}"
        near = vocabulary[: 8 + 4 * int(source[1:])] if rng.random() < 0.8 else vocabulary
        rows.append((rng.choice(["en", "en", "de"]), source, " ".join(rng.choice(near) for _ in range(rng.randint(0, 12)))))
    rows += [(None, None, None), ("", None, "lone"), ("xx", "one", "A b1c ÄÖ\u00a0é 日本-Z"), ("xx", "two", ""), ("en", "quiet", "!!"), ("en", "s0", rows[0][2]), ("en", "s0", rows[0][2])]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "lang string, source string, text string, term int, n int, g int")
    got = sorted(tuple(r) for r in audit(docs, least_docs=30, **cuts).collect())
    assert got == brute(rows, 30)
    assert {r[2] for r in got} == {"pair", "term"}


def test_all_terms_kept_and_ranks_end_at_top(spark):
    rows = [("en", f"s{i % 3}", f"{'abcdefgh'[i % 8]} {'ijklm'[i % 5]}") for i in range(60)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert sorted(tuple(r) for r in audit(docs, least_docs=1, top=2).collect()) == brute(rows, 1, 2)


def test_empty_table_and_tables_without_terms(spark):
    schema = "lang string, source string, text string"
    assert audit(spark.createDataFrame([], schema)).count() == 0
    got = audit(spark.createDataFrame([("en", "a", "x"), ("en", "b", None), ("de", "a", "y")], schema)).collect()
    assert sorted(tuple(r) for r in got) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_very_long_texts_are_cut_between_words():
    text = ("Word\u00e9 two3four " * 1000).encode()
    assert [w for some in words(text, 100) for w in some] == text.lower().replace(b"3", b" ").split()
    assert list(words(b"")) == []
