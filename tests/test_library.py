"""Reads, atlas policies, sources, simulation, networks and the stream, on small made tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixolve.functions import expressions as X
from mixolve.operators import atlas as A
from mixolve.operators import metrics as M
from mixolve.operators import network as N
from mixolve.operators import reads as R
from mixolve.operators import simulate as G
from mixolve.sources import files
from mixolve.streaming.score import score_stream

TYPES = ["a", "b", "c"]


def test_classifier_counts_each_overlap_once(spark):
    markers = [("c1", "m1", "U", 995, 1010), ("c1", "m2", "M", 2000, 2003), ("c2", "m1x", "U", 995, 1010)]
    reads = [("s", "c1", 990, 1005, 0, 16), ("s", "c1", 998, 2001, 1000, 1004), ("s", "c1", 1009, 1012, 2, 4), ("s", "c1", 1000, 1002, 0, 3), ("s", "c1", 1010, 1500, 0, 9)]
    got = R.classify(spark.createDataFrame(reads, "sample string, chr string, first long, last long, methylated long, n_sites long"), spark.createDataFrame(markers, "chr string, marker string, direction string, startCpG long, endCpG long"))
    assert {(r.marker, r.u, r.x, r.m) for r in got.collect()} == {("m1", 1, 1, 1), ("m2", 0, 0, 1)}


def test_fraction_by_direction_and_without_reads(spark):
    df = spark.createDataFrame([("s", "m1", "U", 1, 2, 1), ("s", "m2", "M", 1, 2, 5), ("s", "m3", "U", 0, 0, 0)], "sample string, marker string, direction string, u long, x long, m long")
    assert [(r.x, r.c) for r in R.observed(df).orderBy("marker").collect()] == [(0.25, 4), (0.625, 8), (None, 0)]


def test_fill_policies(spark):
    rows = [("m1", "a", 0.5), ("m1", "b", 0.1), ("m2", "a", None), ("m2", "b", 0.3), ("m3", "a", 0.5), ("m3", "b", 0.1)]
    atlas = spark.createDataFrame(rows, "marker string, cell_type string, h double")
    said = lambda p: {(r.marker, r.cell_type, r.h) for r in A.fill(atlas, p).collect()}
    assert said("drop") == {("m1", "a", 0.5), ("m1", "b", 0.1)}
    assert ("m2", "a", 0.5) in said("mean") and len(said("mean")) == 6
    assert {m for m, _, _ in said("mean_cell_type")} == {"m1", "m2"}
    with pytest.raises(ValueError):
        A.fill(atlas, "median")


def test_groups_take_known_pairs_first(spark):
    corr = spark.createDataFrame([(x, y, 0.9 if {x, y} in ({"a", "b"}, {"c", "d"}) else 0.0) for x in "abcd" for y in "abcd"], "a string, b string, corr double")
    assert A.greedy_groups(corr, list("abcd"), [["b", "c"]]) == [["b", "c"], ["a"], ["d"]]
    assert A.greedy_groups(corr, list("abcd")) == [["a", "b"], ["c", "d"]]


def test_dilution_metrics_hold_their_identity(spark):
    rng = np.random.default_rng(1)
    rows = [(d, float(d + rng.uniform(0, 0.02))) for d in (0.0, 0.01, 0.1) for _ in range(30)]
    got = M.dilution_metrics(spark.createDataFrame(rows, "dilution double, contribution double")).collect()
    for r in got:
        assert abs(r.mse - ((r.mean_pred - r.dilution) ** 2 + r.std_pred**2)) < 1e-12
        assert (r.ratio_error == float("inf")) == (r.dilution == 0)


def test_constant_sides_and_empty_ranges(spark):
    pairs = spark.createDataFrame([("a", 0.5, 0.5), ("a", 0.5, 0.5), ("b", 1.0, 0.2), ("b", 0.05, 0.1)], "cell_type string, truth double, pred double")
    scores = {r.cell_type: r for r in M.cell_type_metrics(pairs).collect()}
    assert scores["a"].r2 == 0 and scores["a"].correlation == 0
    assert {r.cell_type: r.r2 for r in M.evaluate(pairs).collect()}["a"] is None
    ranges = {(r.cell_type, r.range_name): r for r in M.range_metrics(pairs, M.ranges(spark)).collect()}
    assert len(ranges) == 10 and ranges["b", "High"].n_samples == 0 and ranges["b", "High"].mae is None and ranges["b", "Medium"].n_samples == 1


def test_expressions(spark):
    row = spark.range(1).select(
        X.softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("s"), X.softplus(F.lit(1000.0)).alias("p"), X.logspace(-4, -1, 4).alias("l"), X.close(F.lit(1.0), F.lit(1.0 + 1e-9)).alias("c"),
        X.relu(F.lit(-2.0)).alias("r"), X.sigmoid(F.lit(0.0)).alias("g"), X.dilution_of(F.lit("d1e-04_7")).alias("d"), X.replicate_of(F.lit("d1e-04_7")).alias("i"), X.sample_name(F.lit("x/ab.c.pat.gz")).alias("n"), X.ratio(F.lit(1.0), F.lit(0.0)).alias("z"),
    ).first()
    assert row.s == [0.5, 0.5] and row.p == 1000.0 and np.allclose(row.l, [1e-4, 1e-3, 1e-2, 1e-1]) and row.c and row.r == 0 and row.g == 0.5
    assert (row.d, row.i, row.n, row.z) == (1e-4, 7, "ab.c", None)


def atlas_of(spark, h):
    return spark.createDataFrame([(f"m{i:03d}", t, float(h[i, k])) for i in range(len(h)) for k, t in enumerate(TYPES)], "marker string, cell_type string, h double")


def test_simulation_keeps_its_invariants(spark):
    from mixolve.operators.linear import mixture

    prop = G.proportions(spark, 200, TYPES)
    again = {(r.sample, r.cell_type): r.w for r in G.proportions(spark, 200, TYPES).repartition(7).collect()}
    assert {(r.sample, r.cell_type): r.w for r in prop.collect()} == again
    sums = prop.groupBy("sample").agg(F.sum("w").alias("t"), F.min("w").alias("low")).collect()
    assert len(sums) == 200 and all(abs(r.t - 1) < 1e-9 and r.low >= 0 for r in sums)
    made = G.methylation(G.coverage(mixture(prop, atlas_of(spark, np.random.default_rng(0).uniform(0, 1, (30, 3)))))).collect()
    assert all((r.x is None) == (r.c == 0) and r.c >= 0 and (r.x is None or 0 <= r.x <= 1) for r in made)
    assert 0.08 < np.mean([r.c == 0 for r in made]) < 0.3 and 4 < np.mean([r.c for r in made]) < 15
    assert G.sample_grid(spark).count() == 700


def test_resampling_follows_the_weights(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0)], "k string, w double")
    n = {r.k: r["count"] for r in R.weighted_resample(df, "k", "w", 4000).groupBy("k").count().collect()}
    assert sum(n.values()) == 4000 and "c" not in n and abs(n["b"] / 4000 - 0.75) < 0.05


def test_training_lowers_the_loss_and_parameters_come_back(spark, tmp_path):
    rng = np.random.default_rng(4)
    h = rng.uniform(0, 1, (12, 3))
    y = rng.dirichlet([1, 1, 1], 80)
    rows = spark.createDataFrame([(f"s{i}", (h @ y[i]).tolist(), y[i].tolist()) for i in range(80)], "sample string, x array<double>, y array<double>")
    model = N.Perceptron(12, 3, 16)
    flat = {k: v.copy() for k, v in model.p.items()}
    g, _ = model.gradient(h[:, :].T[:3] @ np.eye(12), y[:3])
    step = 1e-6
    model.p["w2"][0, 0] += step
    up = ((model.forward(h.T[:3]) - y[:3]) ** 2).sum()
    model.p["w2"][0, 0] -= 2 * step
    down = ((model.forward(h.T[:3]) - y[:3]) ** 2).sum()
    model.p = flat
    assert abs((up - down) / (2 * step) - g["w2"][0, 0]) < 1e-5
    losses = N.train(model, rows, epochs=15, rate=0.05)
    assert losses[-1] < 0.8 * losses[0]
    N.save(model, spark, str(tmp_path / "m"))
    same = N.load(spark, str(tmp_path / "m"))
    assert all(np.allclose(same.p[k], model.p[k]) for k in model.p)
    assert model.score(rows, TYPES).count() == 240


def test_sources_round_trip(spark, tmp_path):
    (tmp_path / "atlas.tsv").write_text("chr\tstart\tend\tstartCpG\tendCpG\tname\tdirection\tx\tA\tB\nc1\t1\t2\t3\t4\tm1\tU\t.\t0.5\tNA\n")
    assert [(r.marker, r.cell_type, r.h) for r in files.read_atlas(spark, str(tmp_path / "atlas.tsv")).orderBy("cell_type").collect()] == [("m1", "A", 0.5), ("m1", "B", None)]
    (tmp_path / "counts").mkdir()
    import gzip

    with gzip.open(tmp_path / "counts" / "s1.uxm.gz", "wt") as f:
        f.write("# made\nc1\t1\t2\t3\t4\t5\t6\t7\n")
    row = files.read_counts(spark, str(tmp_path / "counts")).first()
    assert (row.sample, row.u, row.x, row.m) == ("s1", 5, 6, 7)
    (tmp_path / "counts" / "s2.pat.gz").write_bytes(b"x")
    found = files.find_samples(spark, str(tmp_path / "counts"))
    assert [r.sample for r in found.collect()] == ["s2"]
    cached = spark.createDataFrame([("s2", "2001-01-01")], "sample string, cached_at string").withColumn("cached_at", F.to_timestamp("cached_at"))
    assert files.stale(found, cached).count() == 1
    counts = spark.createDataFrame([("s1", "m", 1, 0, 0), ("s9", "m", 0, 0, 0)], "sample string, marker string, u long, x long, m long").withColumn("cached_at", F.current_timestamp())
    files.write_cache(counts, str(tmp_path / "cache"))
    assert {r.sample for r in spark.read.parquet(str(tmp_path / "cache")).collect()} == {"s1"}
    obs = spark.createDataFrame([("train", "s"), ("val", "t")], "split string, sample string")
    files.write_dataset({"obs": obs, "prop": obs, "atlas": obs.select("sample")}, str(tmp_path / "set"))
    assert files.read_dataset(spark, str(tmp_path / "set"), "val")["obs"].count() == 1
    (tmp_path / "est.csv").write_text("CellType,d0.1_1,d0.1_2\nA,0.5,0.25\n")
    assert {(r.sample, r.w) for r in files.read_estimates_csv(spark, str(tmp_path / "est.csv")).collect()} == {("d0.1_1", 0.5), ("d0.1_2", 0.25)}
    for form in ("csv", "json", "parquet"):
        files.write_report(obs, str(tmp_path / form), form)
    files.track(spark, str(tmp_path / "log"), 1, {"loss": 0.5})
    files.track(spark, str(tmp_path / "log"), 2, {"loss": 0.25})
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_stream_scores_what_arrives(spark, tmp_path):
    h = np.random.default_rng(0).uniform(0, 1, (20, 3))
    w = np.array([0.2, 0.3, 0.5])
    rows = [(f"s{s}", f"m{i:03d}", float((h @ w)[i]), 9) for s in range(3) for i in range(20)]
    spark.createDataFrame(rows, "sample string, marker string, x double, c long").write.parquet(str(tmp_path / "in"))
    score_stream(spark, str(tmp_path / "in"), atlas_of(spark, h), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 9 and all(abs(r.w - dict(zip(TYPES, w))[r.cell_type]) < 1e-6 for r in got)


def test_command_line(spark, tmp_path):
    from mixolve.__main__ import main

    rng = np.random.default_rng(0)
    lines = ["chr\tstart\tend\tstartCpG\tendCpG\tname\tdirection\tx\tA\tB\tC"] + [f"c1\t{i}\t{i + 1}\t{i}\t{i + 1}\tm{i}\tU\t.\t" + "\t".join(f"{v:.3f}" for v in rng.uniform(0, 1, 3)) for i in range(25)]
    (tmp_path / "atlas.tsv").write_text("\n".join(lines) + "\n")
    main(["generate", str(tmp_path / "atlas.tsv"), str(tmp_path / "set"), "--train", "5", "--val", "12"])
    main(["solve", str(tmp_path / "set"), str(tmp_path / "out"), "--solver", "simplex", "--regularisation", "ridge"])
    assert spark.read.parquet(str(tmp_path / "out/estimates")).count() == 36
    assert spark.read.csv(str(tmp_path / "out/cell_types"), header=True).count() == 3
    spark.createDataFrame([("d0.1_1", "A", 0.2), ("d0.1_2", "A", 0.1), ("d0_1", "A", 0.0)], "sample string, cell_type string, w double").write.parquet(str(tmp_path / "est"))
    main(["dilutions", str(tmp_path / "est"), "A", str(tmp_path / "dil")])
    assert spark.read.csv(str(tmp_path / "dil/metrics"), header=True).count() == 2
    with pytest.raises(SystemExit):
        main(["dilutions", str(tmp_path / "est"), "Z", str(tmp_path / "dil2")])
    for kind in ("perceptron", "unrolled"):
        main(["train", str(tmp_path / "set"), str(tmp_path / kind), "--kind", kind, "--epochs", "2", "--hidden", "8", "--steps", "5", "--step", "1e-3"])
        main(["predict", str(tmp_path / "set"), str(tmp_path / kind / "model"), str(tmp_path / kind / "out"), "--type", "A"])
        assert spark.read.parquet(str(tmp_path / kind / "out/estimates")).count() == 36 and spark.read.csv(str(tmp_path / kind / "out/contributions"), header=True).count() == 12
    main(["variance", str(tmp_path / "set"), str(tmp_path / "var"), "--epochs", "2"])
    assert spark.read.parquet(str(tmp_path / "var/estimates")).count() == 36 and spark.read.json(str(tmp_path / "var/history")).count() == 2
    main(["limits", str(tmp_path / "atlas.tsv"), str(tmp_path / "lim")])
    assert spark.read.csv(str(tmp_path / "lim"), header=True).count() == 150


def test_correlation_and_r2_of_small_spread(spark):
    from mixolve.functions.expressions import correlation, r2

    near = [("a", 0.9 + i * 1e-9, float(i)) for i in range(50)] + [("b", 1.0, 1.0), ("b", 1.0000000000000002, 2.0)] + [("c", 0.5, 1.0), ("c", 0.5, 2.0)] + [("d", 1.0, 1.0)] + [("e", None, 1.0), ("e", 1.0, None)]
    df = spark.createDataFrame(near, "k string, x double, y double")
    got = {r.k: r for r in df.groupBy("k").agg(correlation("x", "y").alias("c"), r2("x", "x").alias("r")).collect()}
    assert abs(got["a"].c - 1) < 1e-6 and abs(got["b"].c - 1) < 1e-6 and got["c"].c is None and got["d"].c is None and got["e"].c is None
    assert got["a"].r == 1 and got["b"].r == 1 and got["c"].r is None


def test_ultra_low_shares_are_capped_before_their_sum(spark):
    from mixolve.operators.simulate import proportions

    shares = {}
    for r in proportions(spark, 400, list("abcde")).where("stratum = 'Ultra-low'").collect():
        shares.setdefault(r.sample, []).append(r.w)
    assert shares and all(abs(sum(w) - 1) < 1e-9 for w in shares.values())
    assert sum(max(w) < 0.51 for w in shares.values()) > 0.9 * len(shares)  # most have two types or more at the cap


def test_what_must_be_raised(spark):
    import pytest

    from mixolve.operators import atlas, metrics, reads
    from mixolve.sources import files

    none = spark.createDataFrame([("m", "a", None)], "marker string, cell_type string, h double")
    prop = spark.createDataFrame([("s", "a", 0.4)], "sample string, cell_type string, w double")
    obs = spark.createDataFrame([("s", "m", 0.5, 3)], "sample string, marker string, x double, c long")
    for bad in (lambda: atlas.some_markers(none), lambda: reads.checked(prop, obs), lambda: reads.checked(prop.limit(0), obs), lambda: metrics.dilution_frame(prop, "z"), lambda: metrics.checked_pairs(prop, prop.limit(0)), lambda: files.some(obs.limit(0), "rows")):
        with pytest.raises(ValueError):
            bad()


def test_orders_stamps_and_buckets(spark):
    from pyspark.sql import functions as F

    from mixolve.functions.expressions import bucket, cache_name, time_stamp
    from mixolve.operators import reads

    one = spark.createDataFrame([("/run.1/s7.pat.gz",)], "p string").select(cache_name("p"), time_stamp(F.lit("2024-05-06 07:08:09").cast("timestamp")), time_stamp()).first()
    assert one[0] == "s7.mem." + __import__("hashlib").md5(b"/run.1").hexdigest()[:6] and one[1] == "20240506_070809" and len(one[2]) == 15
    df = spark.createDataFrame([(float(x),) for x in (0, 0.019, 0.02, 1, 1.1)] + [(None,)], "x double")
    assert [r[0] for r in df.select(bucket("x", 0, 1, 50)).collect()] == [0, 0, 1, 49, None, None]
    rows = spark.createDataFrame([("chr2", 1, 2, 3, 4), ("chr1", 5, 6, 7, 8), ("chr1", 1, 2, 3, 4)], "chr string, start int, end int, startCpG int, endCpG int")
    assert [(r.chr, r.start) for r in reads.in_site_order(rows).collect()] == [("chr1", 1), ("chr1", 5), ("chr2", 1)]
    mixed = [[r.start for r in reads.shuffled(spark.range(30).selectExpr("id AS start").repartition(n), "start").collect()] for n in (1, 4)]
    assert mixed[0] == mixed[1] != sorted(mixed[0]) and sorted(mixed[0]) == list(range(30))


def test_cache_classes_only_what_lacks_and_can_be_run_again(spark, tmp_path):
    path = str(tmp_path / "cache")
    stamp = lambda year: F.lit(f"{year}-01-01 00:00:00").cast("timestamp")
    reads = spark.createDataFrame([(s, "c", 10 * i, 10 * i + 5, 0, 6) for s in ("s1", "s2") for i in range(3)], "sample string, chr string, first long, last long, methylated long, n_sites long")
    markers = spark.createDataFrame([("c", f"m{i}", "U", 10 * i, 10 * i + 5) for i in range(4)], "chr string, marker string, direction string, startCpG long, endCpG long")
    samples = spark.createDataFrame([("s1",), ("s2",), ("none",)], "sample string").withColumn("modified", stamp(2020))
    said = lambda df: {(r.sample, r.marker): (r.u, r.cached_at.year) for r in df.collect()}
    first = said(files.refresh_cache(reads, markers.where("marker < 'm2'"), samples, path, stamp(2021)))
    assert first == {(s, m): (1, 2021) for s in ("s1", "s2") for m in ("m0", "m1")}  # a sample without any reads isn't cached
    changed = samples.withColumn("modified", F.when(F.col("sample") == "s2", stamp(2022)).otherwise(stamp(2020)))
    want = {("s1", m): (int(m < "m3"), 2021 if m < "m2" else 2023) for m in ("m0", "m1", "m2", "m3")} | {("s2", m): (int(m < "m3"), 2023) for m in ("m0", "m1", "m2", "m3")}
    assert said(files.refresh_cache(reads, markers, changed, path, stamp(2023))) == want
    parts = sorted(str(p) for p in (tmp_path / "cache").rglob("*.parquet"))
    assert said(files.refresh_cache(reads, markers, changed, path, stamp(2024))) == want  # nothing lacks, nothing is written
    assert sorted(str(p) for p in (tmp_path / "cache").rglob("*.parquet")) == parts
    import shutil

    shutil.rmtree(tmp_path / "cache" / "sample=s1")  # as after a job that was cut short
    again = said(files.refresh_cache(reads, markers, changed, path, stamp(2024)))
    assert {k: v[0] for k, v in again.items()} == {k: v[0] for k, v in want.items()} and {v[1] for k, v in again.items() if k[0] == "s1"} == {2024}


def test_scaling_and_levels(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", 5.0), ("b", 5.0), ("c", None)], "k string, v double")
    got = sorted((r.k, -1 if r.s is None else round(r.s, 6)) for r in A.min_max(rows, ["k"], "v", "s").collect())
    assert got == [("a", 0.0), ("a", 0.5), ("a", 1.0), ("b", 0.0), ("b", 0.0), ("c", -1)]
    told = spark.createDataFrame([(0.1,), (0.0,), (0.1,)], "dilution double")
    assert sorted(map(tuple, M.dilution_levels(told).collect())) == [(0.0, 1), (0.1, 2)]


def test_marker_correlations_by_blocks(spark):
    from mixolve.operators.distinguish import mean_correlation

    rng = np.random.default_rng(3)
    h = rng.uniform(0, 1, (17, 5))
    h[4] = 0.3
    atlas = spark.createDataFrame([(f"m{i:02d}", t, float(h[i, k])) for i in range(17) for k, t in enumerate("abcde")], "marker string, cell_type string, h double")
    z = h - h.mean(axis=1, keepdims=True)
    size = np.sqrt((z * z).sum(axis=1))
    corr = np.abs(z @ z.T) / np.where(np.outer(size, size) > 1e-12, np.outer(size, size), np.inf)
    np.fill_diagonal(corr, 0)
    for block in (512, 4):
        got = {r.marker: r.mean_corr for r in mean_correlation(atlas, block=block).collect()}
        assert np.allclose([got[f"m{i:02d}"] for i in range(17)], corr.sum(axis=1) / 16)


def test_folders_are_cleared(spark):
    import os

    before = list(files._written)
    path = files.written(spark.range(3).toDF("x"), "some").inputFiles()[0].rpartition("/")[0]
    mine = [f for f in files._written if f not in before]
    assert len(mine) == 1 and os.path.isdir(path.removeprefix("file://").removeprefix("file:"))
    files.clear(spark, mine)
    assert not os.path.isdir(path.removeprefix("file://").removeprefix("file:")) and files._written == before
