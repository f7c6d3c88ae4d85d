"""Linear algebra as joins and sums: products, Gram matrices, residuals, and fixed-step solvers inside Catalyst."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixolve.functions.expressions import array_sum, correlation, dot, normalised
from mixolve.operators import atlas as A
from mixolve.operators.atlas import profiles
from mixolve.sources.files import written


def mixture(prop: DataFrame, atlas: DataFrame) -> DataFrame:
    """(sample, marker, mix): proportions times profiles.

    A sample's proportions are gathered into one row of a few types, as are a marker's values, and each meets each: what is shuffled are
    samples by types, not samples by markers, and no task holds sums of pairs. A pair without a type in common gives no row.
    """
    told = prop.where(F.col("cell_type").isNotNull()).groupBy("sample").agg(F.collect_list(F.struct("cell_type", "w")).alias("p"))
    each = atlas.where(F.col("cell_type").isNotNull()).groupBy("marker", "cell_type").agg(F.sum("h").alias("h"))
    held = written(each.groupBy("marker").agg(F.map_from_entries(F.collect_list(F.struct("cell_type", "h"))).alias("h")), "profiles")
    terms = F.transform(F.filter("p", lambda t: F.map_contains_key("h", t["cell_type"])), lambda t: t["w"] * F.col("h")[t["cell_type"]])
    met = told.crossJoin(held).select("sample", "marker", terms.alias("terms")).where(F.size("terms") > 0)
    known = F.filter("terms", lambda x: x.isNotNull())
    return met.select("sample", "marker", F.when(F.size(known) > 0, array_sum(known)).alias("mix"))


def types_of(atlas: DataFrame) -> list[str]:
    """Names of the cell types in order: one a column of the problem."""
    return [r["cell_type"] for r in atlas.select("cell_type").distinct().orderBy("cell_type").collect()]


def _name(types: list[str], number: str) -> Column:
    return F.element_at(F.array(*map(F.lit, types)), F.col(number) + 1)


#: Rows of one sample that are summed by one task at most, but for chance.
ROWS_PER_TASK = 4096


def moments_by_sample(obs: DataFrame, atlas: DataFrame, weights: list[Column], seen: Column | str = "c > 0", block: int = 100_000) -> DataFrame:
    """(sample, m): for each weight the sums over markers of weight * z z', z being the K profile values, x and 1, in order of types.

    m is an array with (K + 2) squared numbers for each weight. Profiles are written once and sent in blocks of some `block`
    markers; observations are shuffled once, by sample and slice of its markers, summed there against the slice's block, and only
    sums are shuffled again. So a sample of many markers isn't one task.
    """
    spark = obs.sparkSession
    told = written(profiles(atlas), "profiles")
    markers = told.count()
    if not markers:
        return spark.createDataFrame([], "sample string, m array<array<double>>")
    k = told.select(F.size("profile")).first()[0]
    z, blocks = k + 2, 1 + markers // block
    slices = blocks * (1 + min(markers, block) // ROWS_PER_TASK)
    names = [f"w{i}" for i in range(len(weights))]
    of = lambda n: F.pmod(F.xxhash64("marker"), F.lit(n))
    rows = obs.where(seen).select("sample", "marker", F.coalesce("x", F.lit(0.0)).alias("x"), *[w.cast("double").alias(n) for w, n in zip(weights, names)])
    if blocks > 1:
        rows = written(rows.withColumn("block", of(slices) % blocks).repartition("block", "sample", of(slices)), "observations", "block")
    parts = []
    for n in range(blocks):
        some = told.where(of(slices) % blocks == n).collect()  # block markers at most, but for chance
        sent = spark.sparkContext.broadcast(({r["marker"]: i for i, r in enumerate(some)}, np.array([r["profile"] for r in some], float).reshape(-1, k)))
        mine = rows.where(F.col("block") == n).drop("block") if blocks > 1 else rows

        def run(frames: Iterable[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            index, matrix = sent.value
            now, total = None, np.zeros((len(names), z * z))
            for frame in frames:
                out = []
                at = frame["marker"].map(index).to_numpy(float)
                known = ~np.isnan(at)
                samples = frame["sample"].to_numpy()[known]
                each = np.column_stack([matrix[at[known].astype(np.int64)], frame["x"].to_numpy()[known], np.ones(len(samples))])
                w = frame[names].to_numpy()[known]
                cuts = np.flatnonzero(samples[1:] != samples[:-1]) + 1
                for a, b in zip([0, *cuts], [*cuts, len(samples)]):
                    if a == b:
                        continue
                    if samples[a] != now:
                        if now is not None:
                            out.append((now, total.tolist()))
                        now, total = samples[a], np.zeros((len(names), z * z))
                    for i in range(len(names)):
                        total[i] += ((each[a:b] * w[a:b, i, None]).T @ each[a:b]).ravel()
                yield pd.DataFrame(out, columns=["sample", "m"])
            if now is not None:
                yield pd.DataFrame([(now, total.tolist())], columns=["sample", "m"])

        parts.append(mine.repartition("sample", of(slices)).sortWithinPartitions("sample").mapInPandas(run, "sample string, m array<array<double>>"))
    if slices == 1:
        return parts[0]

    def add_up(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        for frame in frames:
            out = []
            for sample, m in zip(frame["sample"], frame["m"]):
                m = np.stack(m)
                if sample != now:
                    if now is not None:
                        out.append((now, total.tolist()))
                    now, total = sample, m
                else:
                    total = total + m
            yield pd.DataFrame(out, columns=["sample", "m"])
        if now is not None:
            yield pd.DataFrame([(now, total.tolist())], columns=["sample", "m"])

    return reduce(DataFrame.unionAll, parts).repartition("sample").sortWithinPartitions("sample").mapInPandas(add_up, "sample string, m array<array<double>>")


def sums_by_sample(obs: DataFrame, atlas: DataFrame, weight: Column, seen: Column | str = "c > 0", block: int = 100_000) -> DataFrame:
    """(sample, gram, rhs, xx, n): sums over markers of weight^2 h_a h_b (K x K, flat), weight^2 h_a x and weight^2 x x, types in order, and of weight^2."""
    told = moments_by_sample(obs, atlas, [weight * weight], seen, block).select("sample", F.col("m")[0].alias("m"), F.sqrt(F.size(F.col("m")[0])).cast("int").alias("z"))
    row = lambda i, size: F.slice("m", i * F.col("z") + 1, size)
    k = F.col("z") - 2
    gram = F.flatten(F.transform(F.sequence(F.lit(0), k - 1), lambda i: row(i, k)))
    last = F.element_at(row(k, F.col("z")), -2)
    return told.select("sample", gram.alias("gram"), row(k, k).alias("rhs"), last.alias("xx"), F.element_at("m", -1).alias("n"))


def gram(obs: DataFrame, atlas: DataFrame, weight: Column, seen: Column | str = "c > 0") -> DataFrame:
    """(sample, a, b, g) for a <= b: sums over markers of weight^2 h_a h_b. Markers without coverage add nothing, unless `seen` says so."""
    atlas = A.fixed(atlas)
    types = types_of(atlas)
    rows = sums_by_sample(obs, atlas, weight, seen).select("sample", F.posexplode("gram").alias("n", "g"))
    rows = rows.select("sample", F.floor(F.col("n") / len(types)).cast("int").alias("i"), (F.col("n") % len(types)).alias("j"), "g").where("i <= j")
    return rows.select("sample", _name(types, "i").alias("a"), _name(types, "j").alias("b"), "g")


def gram_rhs(obs: DataFrame, atlas: DataFrame, weight: Column, seen: Column | str = "c > 0") -> DataFrame:
    """(sample, a, r): sums over markers of weight^2 h_a x."""
    atlas = A.fixed(atlas)
    types = types_of(atlas)
    return sums_by_sample(obs, atlas, weight, seen).select("sample", F.posexplode("rhs").alias("i", "r")).select("sample", _name(types, "i").alias("a"), "r")


def systems(obs: DataFrame, atlas: DataFrame, weight: Column, seen: Column | str = "c > 0") -> DataFrame:
    """(sample, types, gram ARRAY<ARRAY>, rhs ARRAY): the normal equations of each sample, K x K values a row."""
    atlas = A.fixed(atlas)
    types = types_of(atlas)
    rows = F.transform(F.sequence(F.lit(0), F.lit(len(types) - 1)), lambda i: F.slice("gram", i * len(types) + 1, len(types)))
    return sums_by_sample(obs, atlas, weight, seen).select("sample", F.array(*map(F.lit, types)).alias("types"), rows.alias("gram"), "rhs")


def multiplicative_updates(system: DataFrame, steps: int = 60) -> DataFrame:
    """Non-negative least squares by a fixed number of multiplicative updates, folded inside Catalyst; then sum 1."""
    start = F.transform("rhs", lambda _: F.lit(1.0) / F.size("rhs"))
    step = lambda w, _: F.transform(w, lambda x, i: x * F.col("rhs")[i] / (dot(F.col("gram")[i], w) + 1e-10))
    w = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return system.select("sample", "types", normalised(w).alias("w"))


def projected_gradient(system: DataFrame, steps: int = 100, rate: float = 0.1) -> DataFrame:
    """Unrolled projected gradient: step, cut at 0, divide by the sum; from 0, as many steps as asked."""
    start = F.transform("rhs", lambda _: F.lit(0.0))

    def step(w: Column, _: Column) -> Column:
        moved = F.transform(w, lambda x, i: F.greatest(x - rate * (dot(F.col("gram")[i], w) - F.col("rhs")[i]), F.lit(0.0)))
        total = F.aggregate(moved, F.lit(0.0), lambda s, x: s + x) + 1e-8
        return F.transform(moved, lambda x: x / total)

    return system.select("sample", "types", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step).alias("w"))


def unpacked(solved: DataFrame) -> DataFrame:
    """(sample, cell_type, w) from arrays."""
    return solved.select("sample", F.explode(F.arrays_zip(F.col("types").alias("cell_type"), "w")).alias("z")).select("sample", "z.cell_type", "z.w")


def normalise(prop: DataFrame) -> DataFrame:
    """Proportions divided by their sum in the sample; left as they are where that is 0."""
    total = prop.groupBy("sample").agg(F.sum("w").alias("total"))
    return prop.join(total, "sample").withColumn("w", F.when(F.col("total") != 0, F.col("w") / F.when(F.col("total") != 0, F.col("total"))).otherwise(F.col("w"))).drop("total")


def residuals(obs: DataFrame, prop: DataFrame, atlas: DataFrame) -> DataFrame:
    return obs.join(mixture(prop, atlas), ["sample", "marker"]).withColumn("residual", F.coalesce("x", F.lit(0.0)) - F.col("mix"))


def weighted_sse(obs: DataFrame, prop: DataFrame, atlas: DataFrame) -> DataFrame:
    return residuals(obs, prop, atlas).groupBy("sample").agg(F.sum(F.col("c") * F.col("residual") * F.col("residual")).alias("sse"))


def residual_correlation(obs: DataFrame, prop: DataFrame, atlas: DataFrame) -> DataFrame:
    """|correlation| of sqrt(coverage)-weighted residuals with each profile; 0 where undefined."""
    r = residuals(obs, prop, atlas).select("sample", "marker", (F.col("residual") * F.sqrt("c")).alias("wr"))
    return r.join(atlas, "marker").groupBy("sample", "cell_type").agg(F.abs(correlation("wr", "h", 0.0)).alias("corr"))


def candidates(corr: DataFrame, prop: DataFrame, *, round_no: int = 0, least: int = 3, base: float = 1e-4) -> DataFrame:
    """Types worth keeping in a refinement round: near the best correlation, among the `least` best, or active."""
    from pyspark.sql import Window as W

    w = W.partitionBy("sample")
    ranked = corr.withColumn("top", F.max("corr").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("corr"), "cell_type")))
    ranked = ranked.withColumn("near", F.col("corr") > F.col("top") * (0.3 + 0.1 * round_no)).withColumn("n_near", F.count_if("near").over(w))
    both = ranked.join(prop, ["sample", "cell_type"])
    return both.where(F.col("near") | ((F.col("n_near") < least) & (F.col("rank") <= least)) | (F.col("w") > base * (1.0 + round_no))).select("sample", "cell_type")


def diffnnls_loss(prop: DataFrame, recon: DataFrame, sparsity: float = 0.01) -> DataFrame:
    """recon(sample, marker, target, recon): mean squared error plus sparsity times the mean size of proportions."""
    gap = F.col("recon") - F.col("target")
    return recon.agg(F.avg(gap * gap).alias("recon_loss")).join(prop.agg((sparsity * F.avg(F.abs("w"))).alias("sparsity_loss"))).withColumn("loss", F.col("recon_loss") + F.col("sparsity_loss"))
