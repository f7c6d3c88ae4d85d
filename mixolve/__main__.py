"""Command line: python -m mixolve COMMAND ... over datasets (obs, prop, atlas as Parquet) and marker tables."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixolve.operators import atlas, linear, metrics, network, reads, simulate, solvers
from mixolve.sources import files


def generate(spark: SparkSession, a) -> None:
    """Simulate a training and a validation split from a marker table and write the dataset."""
    profiles = atlas.fill(files.read_atlas(spark, a.atlas), a.fill)
    types = [r[0] for r in profiles.select("cell_type").distinct().orderBy("cell_type").collect()]
    obs: DataFrame | None = None
    prop: DataFrame | None = None
    for split, n, seed in (("train", a.train, a.seed), ("val", a.val, a.seed + 1)):
        w = simulate.proportions(spark, n, types, seed=seed).withColumn("split", F.lit(split))
        x = simulate.methylation(simulate.coverage(linear.mixture(w, profiles), seed=seed), seed=seed).withColumn("split", F.lit(split))
        prop, obs = (w, x) if prop is None or obs is None else (prop.unionByName(w), obs.unionByName(x))
    obs, prop = files.written(obs, "obs"), files.written(prop, "prop")
    for split in ("train", "val"):
        reads.checked(prop.where(F.col("split") == split), obs.where(F.col("split") == split))  # before anything is in its place
    files.write_dataset({"obs": obs, "prop": prop, "atlas": profiles}, a.out)


def solve(spark: SparkSession, a) -> None:
    """Solve a split of a dataset, write estimates and, where the truth is there, scores per type and range."""
    data = files.read_dataset(spark, a.dataset, a.split)
    options = {"nnls": {}, "iterative": {"weight": "pow1.5", "rounds": 7, "base": 0.005, "least": 7}, "simplex": {"regularisation": a.regularisation, "alpha": a.alpha, "l1_ratio": a.l1_ratio}}[a.solver]
    found = solvers.solve(data["obs"], data["atlas"], a.solver, **options)
    files.write_report(found, f"{a.out}/estimates", "parquet")
    pairs = spark.read.parquet(f"{a.out}/estimates").withColumnRenamed("w", "pred").join(data["prop"].select("sample", "cell_type", F.col("w").alias("truth")), ["sample", "cell_type"])
    files.write_report(metrics.cell_type_metrics(pairs), f"{a.out}/cell_types")
    files.write_report(metrics.range_metrics(pairs, metrics.ranges(spark)), f"{a.out}/ranges")


def dilutions(spark: SparkSession, a) -> None:
    """Score estimates of samples named d<dilution>_<i> for one type."""
    try:
        told = metrics.dilution_frame(spark.read.parquet(a.estimates), a.type)
    except ValueError as e:
        raise SystemExit(str(e)) from e
    files.write_report(told, f"{a.out}/contributions")
    files.write_report(metrics.dilution_metrics(told), f"{a.out}/metrics")


def limits(spark: SparkSession, a) -> None:
    """Detection limits of every type of a marker table."""
    files.write_report(atlas.detection_limits(atlas.fill(files.read_atlas(spark, a.atlas), a.fill)), a.out)


def counts(spark: SparkSession, a) -> None:
    """Class reads (Parquet) by the markers of a table (Parquet) into a cache, a folder a sample; what is there and no older than the reads' table stays."""
    rows = files.some(spark.read.parquet(a.reads), "reads")
    samples = rows.groupBy("sample").agg(F.max(F.col("_metadata.file_modification_time")).alias("modified"))
    files.some(files.refresh_cache(rows, spark.read.parquet(a.markers), samples, a.out), "reads on markers")


def _rows(data: dict) -> DataFrame:
    """(sample, x, y, weight) of a dataset's split."""
    y = data["prop"].groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_type", "w"))), lambda s: s["w"]).alias("y"))
    return network.features(data["obs"]).join(y, "sample").join(reads.sample_weights(data["prop"]), "sample")


def _unrolled_rows(data: dict, markers: list[str]) -> DataFrame:
    """(sample, x, y) for the unrolled solver: x holds values and then coverages."""
    y = data["prop"].groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_type", "w"))), lambda s: s["w"]).alias("y"))
    return network.aligned(data["obs"], markers).join(y, "sample").select("sample", F.concat("x", "c").alias("x"), "y")


def train(spark: SparkSession, a) -> None:
    """Train a perceptron or an unrolled solver on a dataset's training split, judged on its validation split; writes model and history."""
    data, held = files.read_dataset(spark, a.dataset, "train"), files.read_dataset(spark, a.dataset, "val")
    types = linear.types_of(data["atlas"])
    told = files.some(atlas.profiles(data["atlas"]).orderBy("marker"), "markers").collect()  # types x markers numbers
    markers, how = [r["marker"] for r in told], {"epochs": a.epochs, "rate": a.rate}
    if a.kind == "unrolled":
        import numpy as np

        model = network.UnrolledSolver.untrained(np.array([r["profile"] for r in told], float).T, a.steps, a.step)
        rows, judged = _unrolled_rows(data, markers), _unrolled_rows(held, markers)
    else:
        model = network.Perceptron(len(markers), len(types), a.hidden, a.seed)
        rows, judged, how = _rows(data), _rows(held), how | {"dropout": a.dropout}
    history = network.fit(model, files.some(rows, "training rows"), validation=judged, **how)
    network.save(model, spark, f"{a.out}/model", markers=markers, types=types)
    files.write_report(spark.createDataFrame(history, "epoch int, rate double, train_loss double, val_loss double"), f"{a.out}/history")


def predict(spark: SparkSession, a) -> None:
    """Score a split of a dataset with a trained model, markers met by name; a type's name adds its contributions by dilution."""
    data = files.read_dataset(spark, a.dataset, a.split)
    found = network.predict(network.load(spark, a.model), data["obs"], least=a.least)
    files.write_report(found, a.out if not a.type else f"{a.out}/estimates", "parquet")
    if a.type:
        files.write_report(metrics.dilution_frame(spark.read.parquet(f"{a.out}/estimates"), a.type), f"{a.out}/contributions")


def group(spark: SparkSession, a) -> None:
    """Grouped factorisation of a split, groups by correlation of profiles."""
    data = files.read_dataset(spark, a.dataset, a.split)
    groups = atlas.greedy_groups(atlas.correlations(data["atlas"]), linear.types_of(data["atlas"]), threshold=a.threshold)
    files.write_report(solvers.grouped(data["obs"], data["atlas"], groups)[0], a.out, "parquet")


def variance(spark: SparkSession, a) -> None:
    """Learn the weights of groups of correlated types on a dataset's training split, judged on its validation split; writes model, history and estimates of the latter."""
    from mixolve.operators import regularised

    data, held = files.read_dataset(spark, a.dataset, "train"), files.read_dataset(spark, a.dataset, "val")
    profiles = atlas.fixed(data["atlas"])
    model = regularised.new_model(profiles, threshold=a.threshold, penalty=a.penalty, seed=a.seed)
    rows, judged = (regularised.batches(d["obs"], profiles, d["prop"], batch=a.batch) for d in (data, held))
    model, history = regularised.fit(model, rows, judged, epochs=a.epochs, rate=a.rate, patience=a.patience)
    regularised.save(model, spark, f"{a.out}/model")
    files.write_report(spark.createDataFrame(history, regularised.HISTORY), f"{a.out}/history", "json")
    files.write_report(regularised.predict(model, judged), f"{a.out}/estimates", "parquet")


def maps(spark: SparkSession, a) -> None:
    """Principal components and metric scaling of a marker table's types."""
    import numpy as np

    profiles = atlas.some_markers(files.read_atlas(spark, a.atlas))
    names = linear.types_of(profiles)
    square = lambda df, v: (lambda found: np.array([[found[x, y] for y in names] for x in names]))({(r["a"], r["b"]): r[v] for r in df.collect()})  # noqa: E731  K x K
    scores = solvers.principal_components(square(atlas.gram_of_types(atlas.standardised(profiles)), "g"), 2)
    points, _ = solvers.multidimensional_scaling(square(atlas.distances(profiles), "distance"))
    files.write_report(spark.createDataFrame([(n, *map(float, p), *map(float, q)) for n, p, q in zip(names, scores, points)], "cell_type string, pc1 double, pc2 double, x double, y double"), a.out)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="mixolve", description=__doc__)
    commands = parser.add_subparsers(required=True)
    for run, options in (
        (generate, {"atlas": str, "out": str, "--fill": "drop", "--train": 100_000, "--val": 20_000, "--seed": 42}),
        (solve, {"dataset": str, "out": str, "--solver": "nnls", "--split": "val", "--regularisation": "none", "--alpha": 0.1, "--l1-ratio": 0.5}),
        (dilutions, {"estimates": str, "type": str, "out": str}),
        (limits, {"atlas": str, "out": str, "--fill": "drop"}),
        (counts, {"reads": str, "markers": str, "out": str}),
        (train, {"dataset": str, "out": str, "--hidden": 256, "--epochs": 100, "--rate": 1e-3, "--dropout": 0.2, "--seed": 42, "--kind": "perceptron", "--steps": 100, "--step": 0.1}),
        (predict, {"dataset": str, "model": str, "out": str, "--split": "val", "--type": "", "--least": 0.0}),
        (variance, {"dataset": str, "out": str, "--threshold": 0.3, "--penalty": 0.1, "--batch": 32, "--epochs": 100, "--rate": 1e-3, "--patience": 10, "--seed": 42}),
        (group, {"dataset": str, "out": str, "--split": "val", "--threshold": 0.3}),
        (maps, {"atlas": str, "out": str}),
    ):
        command = commands.add_parser(run.__name__, help=run.__doc__)
        for name, kind in options.items():
            command.add_argument(name, **({"type": type(kind), "default": kind} if name[0] == "-" else {"type": kind}))
        command.set_defaults(run=run)
    a = parser.parse_args(argv)
    a.run(SparkSession.builder.appName("mixolve").getOrCreate(), a)


if __name__ == "__main__":
    main()
