"""Steps that operators share, and what they shuffle."""

import random
import uuid

import pytest

from mixolve.llm import common, packing, simhash
from mixolve.llm.common import among, components
from mixolve.llm.minhash import BANDS, alike, bucket_rows
from mixolve.llm.queries import tokenizer_file


@pytest.fixture
def no_broadcasts(spark):
    """As with tables too large for Spark to send to all tasks by itself."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled(df):
    """Bytes that making df shuffles."""
    sc, group = df.sparkSession.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "")
    df.write.format("noop").mode("overwrite").save()
    sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    assert stages
    return sum(sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteBytes() for s in stages)


def words(rng, n):
    return " ".join("".join(rng.choice("aeiorstlnm") for _ in range(8)) for _ in range(n))


def test_components_of_some_edges_take_no_rounds(spark, monkeypatch):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(rng.randrange(-400, 0), rng.randrange(-400, 0)) for _ in range(150)] + [(7, 7), (None, 3), (5000, 5000)]
    want = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in want:
        for a, b in edges:
            if a in want and b in want:
                want[a] = want[b] = min(want[a], want[b])
    made, plain = [], common.scratch
    monkeypatch.setattr(common, "scratch", lambda df, name, **how: made.append(name) or plain(df, name, **how))
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in components(df, "a", "b").collect()} == want and "large-star" not in made
    assert {r.node: r.root for r in components(df, "a", "b", share=40).collect()} == want and "large-star" in made
    assert components(df.limit(0), "a", "b").count() == 0


def test_rows_among_numbers_are_those_of_a_join(spark):
    held = [*range(0, 300, 3), *range((1 << 33) + 5, (1 << 33) + 200, 7), -1, -64, -65]
    rows = spark.createDataFrame([(i, str(i)) for i in [*range(-130, 400), *range(1 << 33, (1 << 33) + 300), 5, 6]] + [(None, "none")], "n long, said string")
    numbers = spark.createDataFrame([(i,) for i in held * 2], "id long")
    for most in (500_000, 0):
        got = {keep: among(rows, "n", numbers, of="id", keep=keep, most=most) for keep in (True, False)}
        assert all(df.columns == ["n", "said"] for df in got.values())
        for keep in got:
            assert sorted(r.said for r in got[keep].collect()) == sorted(r.said for r in rows.collect() if (r.n in held) == keep)


def test_rows_of_a_bucket_are_found_with_all_its_rows(spark):
    keys = {i: [i % 5 + 100 * k if k < 2 else 10_000 + 100 * i + k for k in range(BANDS)] for i in range(40)} | {i: [10**6 + i] for i in range(40, 60)}
    rows = spark.createDataFrame([(i, 9, k) for i, k in keys.items()], "row long, n int, keys array<long>")
    want = sorted((k, i, 9) for i in range(40) for k in keys[i][:2])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for some in (4, 10_000):  # a batch holds a part of a bucket, or the whole
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", some)
        assert sorted(map(tuple, bucket_rows(rows.repartition(3)).collect())) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_near_copies_are_dropped_without_a_shuffle_of_texts(spark, no_broadcasts):
    rng = random.Random(4)
    texts = [words(rng, 150) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:200])), "doc_id long, text string")
    kept = simhash.one_of_each(docs)
    assert kept.count() == 400 and shuffled(kept) < 20_000  # of 600 texts, 0.8 MB


def test_sets_are_shuffled_once(spark, no_broadcasts):
    rng = random.Random(5)
    sets = spark.createDataFrame([(i, bytearray(rng.randbytes(1600) if i % 2 == 0 else bytes(1600))) for i in range(600)], "row long, s binary")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 300) for i in range(150)], "a long, b long")
    assert shuffled(alike(sets, pairs, 0.8)) < 1.5 * 1600 * 300 < shuffled(alike(sets, pairs, 0.8, most=0))


def test_only_what_is_cut_is_shuffled(spark, no_broadcasts):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, words(rng, rng.randint(20, 900))) for i in range(600)], "doc_id long, text string")
    packed = packing.pack_documents(spark, docs, tokenizer_file("word_bpe_49k.json"), fill=True)
    tokens = docs.join(packed.groupBy("doc_id").agg({"length": "sum"}), "doc_id").agg({"sum(length)": "sum"}).first()[0]
    assert tokens > 500_000 and shuffled(packed) < 4 * tokens / 4
