"""Synthetic mixtures, coverage and reads. Every draw is seeded by (seed, id), so batches don't matter."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of samples for each range of proportions, what is left going to the first (fixed values).
STRATA = [(0.0, 1e-4, "Ultra-low", 0.3), (1e-4, 1e-3, "Very-low", 0.25), (1e-3, 1e-2, "Low", 0.2), (1e-2, 1e-1, "Medium", 0.15), (1e-1, 1.0, "High", 0.1)]

#: Levels of the dilution sweep (fixed values).
SWEEP = (1e-4, 1e-3, 5e-3, 0.01, 0.05, 0.1, 0.15, 0.2)


def proportions(spark: SparkSession, n: int, types: list[str], *, seed: int = 42, strata: list = STRATA) -> DataFrame:
    """(sample, stratum, cell_type, w): n samples, some types drawn in the sample's range, the rest by a Dirichlet; sums are 1."""
    k = len(types)
    cuts = np.cumsum([int(n * s[3]) for s in strata[1:]])

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i in frame["id"]:
                rng = np.random.default_rng([seed, int(i)])
                which = int(np.searchsorted(cuts, i, "right")) + 1
                low, high, name, _ = strata[which if which < len(strata) else 0]
                if which >= len(strata):
                    w = np.minimum(rng.dirichlet(np.full(k, 0.1)), high)  # all types are brought to the range's top, then divided by their sum
                    w = w if w.sum() > 0 else np.ones(k)
                else:
                    w = np.zeros(k)
                    r = int(rng.integers(1, max(2, k // 2)))
                    chosen = rng.choice(k, r, replace=False)
                    drawn = rng.uniform(low, high, r)
                    if drawn.sum() >= 1:
                        drawn *= 0.9 / drawn.sum()
                    w[chosen] = drawn
                    rest = np.setdiff1d(np.arange(k), chosen)
                    w[rest] = rng.dirichlet(np.ones(len(rest))) * (1 - drawn.sum())
                w = w / w.sum()
                out += [(f"s{i}", name, t, float(v)) for t, v in zip(types, w)]
            yield pd.DataFrame(out, columns=["sample", "stratum", "cell_type", "w"])

    return spark.range(n).mapInPandas(run, "sample string, stratum string, cell_type string, w double")


def coverage(mixes: DataFrame, *, mean: float = 5.0, spread: float = 1.0, factor: float = 1.0, dropout: float = 0.15, dropout_spread: float = 0.05, seed: int = 42) -> DataFrame:
    """mixes(sample, marker, mix) with integer coverage c.

    Normal base, grown by the mixture, one log-normal bias a marker, a dropout rate a sample; normal and
    uniform draws come from hashes of what they belong to, so they are the same in any partitioning.
    """
    u = lambda *cols, salt: (F.pmod(F.xxhash64(*cols, F.lit(f"{seed}{salt}")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    normal = lambda *cols, salt: F.sqrt(-2 * F.log(u(*cols, salt=salt + "a"))) * F.cos(2 * np.pi * u(*cols, salt=salt + "b"))
    base = F.greatest(mean + spread * normal("sample", "marker", salt="base"), F.lit(0.0))
    grown = base * (1 + F.log1p(F.col("mix") * factor)) * F.exp(0.5 * normal("marker", salt="bias"))
    rate = F.least(F.greatest(dropout + dropout_spread * normal("sample", salt="rate"), F.lit(0.0)), F.lit(1.0))
    return mixes.withColumn("c", F.when(u("sample", "marker", salt="drop") < rate, 0).otherwise(F.bround(grown)).cast("long"))


def uniforms(keys: np.ndarray, n: int, seed: int) -> np.ndarray:
    """n uniform draws for each key (a 64-bit hash), mixed from key, number and seed, so that batches don't matter."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed) * np.uint64(0xD1342543DE82EF95)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53)


def methylation(covered: DataFrame, *, seed: int = 42) -> DataFrame:
    """(sample, marker, x, c): binomial shares of c reads at probability mix, a draw a read; NULL without reads."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n, p, hits = frame["c"].to_numpy(), frame["mix"].clip(0, 1).to_numpy(), np.zeros(len(frame))
            order = np.argsort(n, kind="stable")
            for at in np.array_split(order, max(1, len(order) // 500)):  # rows of like coverage together
                most = int(n[at].max(initial=0))
                hits[at] = ((uniforms(frame["key"].to_numpy()[at], most, seed) < p[at][:, None]) & (np.arange(most) < n[at][:, None])).sum(axis=1)
            yield pd.DataFrame({"sample": frame["sample"], "marker": frame["marker"], "x": np.where(n > 0, hits / np.maximum(n, 1), np.nan), "c": n})

    keyed = covered.select("sample", "marker", "mix", "c", F.xxhash64("sample", "marker").alias("key"))
    made = keyed.mapInPandas(run, "sample string, marker string, x double, c long")
    return made.withColumn("x", F.when(F.col("c") > 0, F.col("x")))


def dilutions(spark: SparkSession, types: list[str], target: str, levels: list[float], repeats: int, *, seed: int = 42) -> DataFrame:
    """(sample, dilution, replicate, cell_type, w): the target at each level, the others near even in what is left."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i in frame["id"]:
                level, rep = levels[int(i) // repeats], int(i) % repeats + 1
                rng = np.random.default_rng([seed, int(i)])
                others = rng.uniform(0.25, 0.35, len(types) - 1)
                left = iter(others / others.sum() * (1 - level))
                out += [(f"d{level:g}_{rep}", level, rep, t, level if t == target else float(next(left))) for t in types]
            yield pd.DataFrame(out, columns=["sample", "dilution", "replicate", "cell_type", "w"])

    return spark.range(len(levels) * repeats).mapInPandas(run, "sample string, dilution double, replicate int, cell_type string, w double")


def dilution_sweep(spark: SparkSession, types: list[str], *, levels: tuple = SWEEP, repeats: int = 5, samples: int = 100, seed: int = 42) -> DataFrame:
    """(sample, dilution, target, repeat, cell_type, w): `samples` mixtures for each type, level and repeat, the target at its level, the others near even."""
    k, each = len(types), repeats * samples

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            i = frame["id"].to_numpy()
            target, level = i // (len(levels) * each), np.array(levels)[i // each % len(levels)]
            w = np.stack([np.random.default_rng([seed, int(n)]).uniform(0.25, 0.35, k) for n in i]) if len(i) else np.zeros((0, k))
            w[np.arange(len(i)), target] = 0
            w = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-300) * (1 - level)[:, None]
            w[np.arange(len(i)), target] = level
            told = {"sample": [f"x{n}" for n in i], "dilution": level, "target": [types[t] for t in target], "repeat": (i // samples % repeats + 1).astype(np.int32)}
            yield pd.DataFrame({n: np.repeat(np.asarray(v), k) for n, v in told.items()} | {"cell_type": types * len(i), "w": w.ravel()})

    return spark.range(k * len(levels) * each).mapInPandas(run, "sample string, dilution double, target string, repeat int, cell_type string, w double")


def negative_binomial_coverage(mixes: DataFrame, *, mean: float = 30.0, r: int = 5, empty: float = 0.1, seed: int = 42) -> DataFrame:
    """Coverage by a negative binomial draw, the sum of r geometric ones; a share `empty` of the cells has none."""
    u = lambda salt: (F.pmod(F.xxhash64("sample", "marker", F.lit(f"{seed}cover{salt}")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    waits = [F.floor(F.log(u(i)) / float(np.log(mean / (mean + r)))) for i in range(r)]
    return mixes.select("sample", "marker", "mix", F.when(u("empty") < empty, 0).otherwise(sum(waits[1:], waits[0])).cast("long").alias("c"))


#: Levels of the dilution benchmark as its sample names have them (fixed values).
LEVEL_NAMES = ("0", "1e-04", "0.001", "0.005", "0.01", "0.05", "0.1")


def sample_grid(spark: SparkSession, levels: tuple[str, ...] = LEVEL_NAMES, repeats: int = 100) -> DataFrame:
    """(name, dilution, replicate) of the dilution benchmark's samples."""
    told = spark.createDataFrame([(x, float(x)) for x in levels], "level string, dilution double")
    return told.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).select(F.concat(F.lit("d"), "level", F.lit("_"), F.col("replicate").cast("string")).alias("name"), "dilution", "replicate")
