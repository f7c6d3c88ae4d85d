"""Which markers tell a type's presence from its absence, by simulated mixtures and Welch's test."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mixolve.operators import atlas as A
from mixolve.sources.files import written


def student_tail(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p-values of Student's t: the regularised incomplete beta function by its continued fraction."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    x = df / (df + t * t)
    a, b = df / 2, np.full(df.shape, 0.5)
    swap = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(np.maximum(x, 1e-300)) + b * np.log1p(-np.minimum(x, 1 - 1e-16))) / a
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            out = out * c * d
    value = np.where(x <= 0, 0.0, front * out)
    return np.clip(np.where(swap, 1 - value, value), 0, 1)


def blocks_of(rows: DataFrame, key: str, values: str, size: int = 512) -> DataFrame:
    """(block, keys, v): rows of a key and an array of numbers, dealt by a hash into blocks of some `size`, one row a block; written."""
    rows = written(rows.select(F.col(key).alias("key"), F.col(values).alias("value")), "keys")
    count = rows.count()
    number = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-count // size)))).cast("int")
    held = rows.groupBy(number.alias("block")).agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("s"))
    return written(held.select("block", F.transform("s", lambda x: x["key"]).alias("keys"), F.flatten(F.transform("s", lambda x: x["value"])).alias("v"), F.lit(count).alias("count")), "blocks")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """Each block met with each, itself included: (a, b, count, keys, v, other): a row a pair of blocks."""
    left = blocks.crossJoin(F.broadcast(blocks.agg((F.max("block") + 1).alias("n")))).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))  # one number
    right = blocks.select(F.col("block").alias("b"), F.col("v").alias("other"))
    return left.withColumnRenamed("block", "a").join(right, "b").select("a", "b", "count", "keys", "v", "other")


def correlation_sums(h: np.ndarray, other: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """For each row of h the sum over rows of other of |h S o| / sqrt(h S h * o S o); rows without spread count as 0."""
    one, two = (np.einsum("mk,kl,ml->m", x, spread, x) for x in (h, other))
    scale = lambda v: np.where(v > 1e-24, 1 / np.sqrt(np.where(v > 1e-24, v, 1)), 0.0)
    return np.abs((h @ spread @ other.T) * scale(one)[:, None] * scale(two)).sum(axis=1)


def mean_correlation(atlas: DataFrame, *, block: int = 512) -> DataFrame:
    """(marker, mean_corr): the mean absolute correlation, over types, of each marker with all others; 0 for constant markers.

    A block product: each pair of blocks of markers is one row, so no task holds all markers.
    """
    centred = A.profiles(atlas).select("marker", F.transform("profile", lambda x: x - F.aggregate("profile", F.lit(0.0), lambda s, y: s + y) / F.size("profile")).alias("profile"))
    pairs = block_pairs(blocks_of(centred, "marker", "profile", block))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                h = np.asarray(row.v, float).reshape(len(row.keys), -1)
                other = np.asarray(row.other, float).reshape(-1, h.shape[1])
                sums = correlation_sums(h, other, np.eye(h.shape[1]))
                own = (h * h).sum(axis=1) > 1e-24 if row.a == row.b else np.zeros(len(h), bool)
                yield pd.DataFrame({"marker": row.keys, "part": (sums - own) / max(row.count - 1, 1)})

    return pairs.mapInPandas(run, "marker string, part double").groupBy("marker").agg(F.greatest(F.sum("part"), F.lit(0.0)).alias("mean_corr"))


def draw_moments(spark: SparkSession, k: int, conditions: int, draws: int, seed: int, chunk: int = 1000) -> DataFrame:
    """(target, condition, side, mean, spread): mean and covariance of `draws` even Dirichlet draws over the types but the target.

    A row a chunk of draws, seeded by target, condition, side and chunk; chunks are summed by Spark. Arrays have k and k x k numbers, 0 at the target.
    """
    chunks = -(-draws // chunk)
    grid = spark.range(k * conditions * 2 * chunks).select((F.col("id") % chunks).alias("chunk"), F.expr(f"id div {chunks} % 2").cast("int").alias("side"), F.expr(f"id div {2 * chunks} % {conditions}").cast("int").alias("condition"), F.expr(f"id div {2 * chunks * conditions}").cast("int").alias("target"))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for target, condition, side, number in zip(frame["target"], frame["condition"], frame["side"], frame["chunk"]):
                n = min(chunk, draws - int(number) * chunk)
                d = np.insert(np.random.default_rng([seed, int(target), int(condition), int(side), int(number)]).dirichlet(np.ones(k - 1), n), int(target), 0.0, axis=1)
                out.append((target, condition, side, [n, *d.sum(axis=0), *(d.T @ d).ravel()]))
            yield pd.DataFrame(out, columns=["target", "condition", "side", "sums"])

    sums = grid.repartition("target", "condition").mapInPandas(run, "target int, condition int, side int, sums array<double>")
    whole = sums.select("target", "condition", "side", F.posexplode("sums").alias("i", "v")).groupBy("target", "condition", "side", "i").agg(F.sum("v").alias("v"))
    told = whole.groupBy("target", "condition", "side").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("s"))
    mean = F.transform(F.slice("s", 2, k), lambda x: x / F.col("s")[0])
    centred = F.transform(F.slice("s", k + 2, k * k), lambda x, i: (x - F.col("s")[0] * F.element_at("mean", (F.floor(i / k) + 1).cast("int")) * F.element_at("mean", (i % k + 1).cast("int"))) / (F.col("s")[0] - 1))
    return told.withColumn("mean", mean).select("target", "condition", "side", "mean", centred.alias("spread"))


def distinguishability(atlas: DataFrame, *, low: float = 1e-4, high: float = 0.2, steps: int = 50, draws: int = 10_000, top: int = 10, seed: int = 42, block: int = 512) -> DataFrame:
    """(cell_type, step, concentration, n_distinguishable, top_markers) over types and concentrations.

    Even Dirichlet mixtures of the other types, without and with the type, are drawn; every marker is tested (p < 0.05 by Welch's t and an
    effect over 0.5) and ranked by effect times independence, which is 1 less its min-max scaled mean absolute correlation with all others.
    Mixtures are linear in the draws, so a marker's mean, variance and correlations follow from the draws' means and covariances,
    types x types numbers summed over chunks of draws. Correlations are a product of blocks of markers, a row for each pair of
    blocks and type; no task and not the driver holds all markers.
    """
    spark = atlas.sparkSession
    atlas = A.fixed(atlas)
    types = [r["cell_type"] for r in atlas.select("cell_type").distinct().orderBy("cell_type").collect()]
    k = len(types)
    moments = written(draw_moments(spark, k, steps, draws, seed), "moments")
    per_type = moments.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("condition", "side", "mean", "spread"))).alias("s"))  # 2 x steps covariances
    per_type = per_type.select("target", F.flatten(F.transform("s", lambda x: x["mean"])).alias("means"), F.flatten(F.transform("s", lambda x: x["spread"])).alias("spreads"))
    pairs = block_pairs(blocks_of(A.profiles(atlas), "marker", "profile", block)).withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).join(per_type, "target")
    concentration = [10 ** (math.log10(low) + (math.log10(high) - math.log10(low)) * i / max(steps - 1, 1)) for i in range(steps)]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                h, other = (np.asarray(v, float).reshape(-1, k) for v in (row.v, row.other))
                means, spreads = np.asarray(row.means, float).reshape(steps, 2, k), np.asarray(row.spreads, float).reshape(steps, 2, k, k)
                for step, c in enumerate(concentration):
                    shared = np.zeros(len(h))
                    for side in (0, 1):
                        own = np.einsum("mk,kl,ml->m", h, spreads[step, side], h) > 1e-24 if row.a == row.b else 0
                        shared += (correlation_sums(h, other, spreads[step, side]) - own) / max(row.count - 1, 1) / 2
                    out = {"target": row.target, "step": step, "marker": row.keys, "shared": shared, "p": np.nan, "effect": np.nan}
                    if row.b == 0:
                        without, there = (np.einsum("mk,kl,ml->m", h, spreads[step, side], h) for side in (0, 1))
                        va, vb = there * (1 - c) ** 2 / draws, without / draws
                        error = np.maximum(va + vb, 1e-300)
                        gap = c * h[:, row.target] + (1 - c) * (h @ means[step, 1]) - h @ means[step, 0]
                        out["p"] = student_tail(gap / np.sqrt(error), error**2 / np.maximum((va**2 + vb**2) / (draws - 1), 1e-300))
                        out["effect"] = np.abs(gap) / (np.sqrt(np.maximum(without, 0) * (draws - 1) / draws) + 1e-10)
                    yield pd.DataFrame(out)

    parts = pairs.mapInPandas(run, "target int, step int, marker string, shared double, p double, effect double")
    known = lambda c: F.max(F.when(~F.isnan(c), F.col(c)))
    told = parts.groupBy("target", "step", "marker").agg(F.sum("shared").alias("shared"), known("p").alias("p"), known("effect").alias("effect"))
    scored = A.min_max(told, ["target", "step"], "shared", "scaled").withColumn("score", F.col("effect") * (1 - F.col("scaled")))
    order = W.partitionBy("target", "step").orderBy(F.desc("score"), "marker")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).groupBy("target", "step").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "marker"))), lambda s: s["marker"]).alias("top_markers"))
    told = scored.groupBy("target", "step").agg(F.count_if((F.col("p") < 0.05) & (F.col("effect") > 0.5)).cast("int").alias("n_distinguishable"))
    name, level = F.element_at(F.array(*map(F.lit, types)), F.col("target") + 1), F.element_at(F.array(*map(F.lit, concentration)), F.col("step") + 1)
    return told.join(best, ["target", "step"]).select(name.alias("cell_type"), "step", level.alias("concentration"), "n_distinguishable", "top_markers")
