"""Plans hold every piece and waste little; pieces are placed without gaps."""

import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from mixolve.llm import packing
from mixolve.llm.packing import best_pattern, column_generation, cut_pieces, inverse_of, pack, pack_documents, plan_sequences
from mixolve.llm.queries import tokenizer_file

FILE = tokenizer_file("word_bpe_49k.json")


def test_knapsack_is_the_best():
    duals, sizes = np.array([0.3, 0.21, 0.5]), np.array([3, 2, 5])
    value, pattern = best_pattern(duals, sizes, 11)
    best = max(a * 0.3 + b * 0.21 + c * 0.5 for a in range(4) for b in range(6) for c in range(3) if 3 * a + 2 * b + 5 * c <= 11)
    assert abs(value - best) < 1e-12 and pattern @ sizes <= 11


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece_near_the_bound(seed):
    rng = random.Random(seed)
    histogram = {s: rng.randint(1, 400) for s in rng.sample(range(1, 65), 20)}
    plan, sizes = plan_sequences(histogram, 64)
    held = sum(p * t for p, t in plan)
    assert dict(zip(sizes.tolist(), held.tolist())) == histogram
    assert all(p @ sizes <= 64 for p, _ in plan)
    basis, x = column_generation(sizes, np.array([histogram[s] for s in sizes], float), 64)
    assert sum(t for _, t in plan) <= x.sum() + len(sizes)
    assert np.allclose(basis @ x, [histogram[s] for s in sizes], atol=1e-6)


def test_many_sizes_are_planned_in_a_process_that_started_spark(spark):
    rng = random.Random(9)
    histogram = {s: rng.randint(1, 200) for s in range(1, 257)}
    began = time.time()
    plan, sizes = plan_sequences(histogram, 256)
    assert time.time() - began < 60
    assert dict(zip(sizes.tolist(), sum(p * t for p, t in plan).tolist())) == histogram


def test_inverse_by_elimination():
    rng = np.random.default_rng(1)
    matrix = rng.integers(0, 5, (40, 40)) * (rng.random((40, 40)) < 0.2) + np.eye(40)[rng.permutation(40)] * 7
    assert np.abs((inverse_of(matrix)[:, :, None] * matrix[None]).sum(axis=1) - np.eye(40)).max() < 1e-9


def test_documents_are_packed_whole(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["one", "Two", "three,", "vier!"]) for _ in range(rng.choice([0, 3, rng.randint(10, 900), rng.randint(10, 900), 5000])))) for i in range(300)]
    rows += [(500, None), (501, ""), (None, "x"), (7, "again"), (7, "again")]
    got = pack_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), FILE).collect()
    tok = Tokenizer.from_file(FILE)
    want = {}
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(i, []).append([(a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes()), len(ids)) for a in range(0, len(ids), 4096)])
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(p for d in v for p in d) for k, v in want.items()}
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= sum(r.length for r in got) / 4096 * 1.05 + 1


def test_empty_table_and_ids(spark):
    assert pack_documents(spark, spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0
    piece = cut_pieces(spark.createDataFrame([(1, "one two")], "doc_id long, text string"), FILE, keep_ids=True).first()
    assert piece.ids == [*Tokenizer.from_file(FILE).encode("one two").ids, 2]


def test_filled_sequences_hold_every_id_with_little_padding(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["one", "Two", "three,", "vier!"]) for _ in range(rng.choice([0, 1, 17, rng.randint(10, 900), 2500, 9000])))) for i in range(400)]
    rows += [(500, None), (501, ""), (None, "x"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows], "doc_id long, text string, piece int, used int, size int, offset int")
    got = pack_documents(spark, docs, FILE, fill=True).collect()
    tok = Tokenizer.from_file(FILE)
    left = {}
    for i, t in rows:
        left.setdefault(i, []).append(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    held = {}
    for r in got:
        assert any(zlib.crc32(d[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(d) == r.doc_tokens for d in left[r.doc_id])
        held.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, docs_of in left.items():
        assert sorted(x for a, n in held[i] for x in range(a, a + n)) == sorted(x for d in docs_of for x in range(len(d)))
    sequences, padding = {}, 0
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding < 0.005 * sum(r.length for r in got)
    assert pack_documents(spark, docs.limit(0), FILE, fill=True).count() == 0


def test_equal_lengths_that_fit_badly_are_cut(spark):
    docs = spark.createDataFrame([(i, "one " * 2499) for i in range(30)], "doc_id long, text string")
    n = len(Tokenizer.from_file(FILE).encode("one " * 2499, add_special_tokens=False).ids) + 1
    got = pack_documents(spark, docs, FILE, fill=True).collect()
    assert sum(r.length for r in got) == 30 * n and len({r.sequence_id for r in got}) <= 30 * n // 4096 + 12


def test_columns_of_any_name_stay(spark):
    names = ["size", "rank", "slot", "lo", "hi", "base", "each", "_size", "_p", "_rank"]
    pieces = spark.createDataFrame([(i, 0, 1 + 40 * i % 900, i, *range(len(names))) for i in range(60)], ["doc_id", "start", "length", "ids_crc32", *names])
    got = pack(pieces)
    assert got.columns == [*pieces.columns, "sequence_id", "offset"]
    assert sorted(got.drop("sequence_id", "offset").collect()) == sorted(pieces.collect())


def test_encoding_takes_texts_in_small_slices_and_batches(spark, monkeypatch):
    class Caught:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    sizes, texts = [], ["one two, three. " * 6000] * 60  # 5.8 million characters
    real = packing.encoder(FILE, False)
    seen = type("Seen", (), {"encode": lambda self, t: sizes.append(sum(map(len, t.to_pylist()))) or real.encode(t)})()
    monkeypatch.setattr(packing, "encoder", lambda *a, **b: seen)
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts)], names=["id", "text"])
    rows = sum(b.num_rows for b in cut_pieces(Caught(), FILE)([batch]))
    n = len(real.encode(pa.array(texts[:1]))[0]) + 1
    assert rows == 60 * -(-n // 4096) and sum(sizes) == 60 * len(texts[0]) and max(sizes) <= 2 << 20

    key, asked = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    written = packing.scratch
    monkeypatch.setattr(packing, "scratch", lambda df, name, **o: asked.append((name, int(spark.conf.get(key)))) or written(df, name, **o))
    got = pack_documents(spark, spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), FILE).count()
    assert got == 2 and asked == [("pieces", 1000)] and spark.conf.get(key) == before
