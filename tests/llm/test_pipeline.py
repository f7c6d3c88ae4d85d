"""The whole pipeline on planted documents, stage by stage."""

import random
import threading

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_keep_the_clean_and_drop_the_planted(spark, tmp_path):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("aeiorstln") for _ in range(rng.randint(2, 8))) for _ in range(n)) + "."
    clean = {i: text(120) for i in range(150)}
    junk = {i: " | ".join(text(60).upper().split()) for i in range(1000, 1050)}
    items = [(i, text(30)) for i in range(5)]
    leaks = {2000 + i: text(40) + " " + t + " " + text(40) for i, t in items}
    copies = {3000 + i: clean[i] for i in range(10)}
    secret = {4000: text(50) + " password=hunter2345 " + text(50)}
    docs = [(i, t, "en", "s", len(t)) for d in (clean, junk, leaks, copies, secret) for i, t in d.items()] + [(9000, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i not in junk), 0) for i in [*clean, *junk]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        left[name] = now.collect()
        if name != "packing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: {r.doc_id for r in left[name]} - {9000}
    assert ids("quality") == {*clean, *leaks, *copies, *secret}
    assert len(ids("near_duplicates")) == len(clean) + len(leaks) + len(secret)
    assert ids("decontamination") == ids("near_duplicates") - set(leaks)
    masked = next(r for r in left["secrets"] if r.doc_id == 4000)
    assert "hunter" not in masked.text and "[SECRET]" in masked.text and masked.n_chars == len(masked.text)
    assert {r.text for r in left["secrets"] if r.doc_id != 4000} == {r.text for r in left["decontamination"] if r.doc_id != 4000}
    assert {r.doc_id for r in left["packing"]} == {r.doc_id for r in left["secrets"]}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.count() == len(left["packing"])


def _corpus(path, spark, n, salt):
    text = lambda i: " ".join(f"{salt}{i}w{j}" for j in range(40)) + "."
    spark.createDataFrame([(i, text(i), "en", "s", 1) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(n)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "none of it stands in any document of these")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def test_a_stage_deletes_only_what_its_own_documents_were_made_from(spark, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    one, two = (_corpus(tmp_path / name, spark, n, name) for name, n in (("a", 40), ("b", 50)))
    lazy = stages["quality"](spark, one, str(tmp_path / "a"))
    other = stages["quality"](spark, two, str(tmp_path / "b"))
    other.write.parquet(str(tmp_path / "other"))
    handed_on = spark.read.parquet(str(tmp_path / "other"))
    assert stages["decontamination"](spark, handed_on, str(tmp_path / "b")).count() == handed_on.count()
    assert lazy.count() <= 40  # what it reads is still there
    kept = stages["near_duplicates"](spark, one, str(tmp_path / "a"))
    threads = [threading.Thread(target=lambda d=d: stages["near_duplicates"](spark, d, str(tmp_path)).count()) for d in (one, two)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert kept.count() == 40
    from mixolve.llm.common import _made

    noted = other.schema.fields[0].metadata["mixolve.made_from"]
    assert noted and not _made & set(noted) and set(lazy.schema.fields[0].metadata["mixolve.made_from"]) <= _made


def test_an_empty_table_and_clashing_columns_pass_all_stages(spark, tmp_path):
    names = ["_row", "_fp", "_doc", "spans", "base", "_leak", "_stats", "piece", "used", "node", "t.x"]
    docs = _corpus(tmp_path, spark, 60, "c")
    for n, some in (("full", docs), ("none", docs.limit(0))):
        now = some.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, str(tmp_path))
            if name != "packing":
                assert out.columns == now.columns
            out.write.parquet(f"{tmp_path}/{n}-{name}")
            now = spark.read.parquet(f"{tmp_path}/{n}-{name}")
        assert (now.count() > 0) == (n == "full")
