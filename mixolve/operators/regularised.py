"""Least squares with a penalty on how much a group's types vary within a batch of samples; the groups' weights are learned.

A batch is solved from its samples' types x types sums alone. Training passes over the batches once an epoch: tasks solve them and sum
losses and gradients of the shared weights, of which a few numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixolve.operators import atlas as A
from mixolve.operators import linear
from mixolve.sources.files import written


@dataclass(frozen=True)
class GroupedModel:
    """Types, their groups, a raw weight of each group (its softplus counts), and how a batch is solved."""

    types: list[str]
    groups: list[list[str]]
    raw: np.ndarray
    penalty: float = 0.1
    steps: int = 100
    rate: float = 0.01
    seed: int = 42

    @property
    def inside(self) -> np.ndarray:
        """groups x types: 1 / size where the type is in the group."""
        member = np.array([[t in g for t in self.types] for g in self.groups], float)
        return member / member.sum(axis=1, keepdims=True)

    @property
    def weights(self) -> np.ndarray:
        return np.logaddexp(0, self.raw)


def variances(p: np.ndarray) -> np.ndarray:
    """Sample variance of each type over a batch; a batch of one sample has none."""
    return p.var(axis=0, ddof=1) if len(p) > 1 else np.zeros(p.shape[1])


def solve_batch(model: GroupedModel, q: np.ndarray, r: np.ndarray, n: float, number: int) -> np.ndarray:
    """Proportions (samples x types) of one batch: Adam from a start seeded by the batch's number; q and r are the samples' sums, n their markers seen."""
    b, k = r.shape
    w = np.random.default_rng([model.seed, number]).random((b, k))
    first, second = np.zeros_like(w), np.zeros_like(w)
    pull = model.penalty / len(model.groups) * (model.weights @ model.inside)
    for step in range(1, model.steps + 1):
        up = np.maximum(w, 0)
        total = np.maximum(up.sum(axis=1, keepdims=True), 1e-12)
        p = up / total
        g = 2 * (np.einsum("bkl,bl->bk", q, p) - r) / max(n, 1)
        if b > 1:
            g += pull * 2 * (p - p.mean(axis=0)) / (b - 1)
        g = (g - (g * p).sum(axis=1, keepdims=True)) / total * (w > 0)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - model.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    up = np.maximum(w, 0)
    return up / np.maximum(up.sum(axis=1, keepdims=True), 1e-12)


def losses(model: GroupedModel, p: np.ndarray, q: np.ndarray, r: np.ndarray, xx: np.ndarray, n: float, y: np.ndarray, supervised: float = 1.0) -> np.ndarray:
    """A batch's loss, and its parts: squared error a marker seen, squared error of proportions, weighted variance of groups (a type's mean over its group's size)."""
    fit = (xx.sum() - 2 * (p * r).sum() + np.einsum("bk,bkl,bl->", p, q, p)) / max(n, 1)
    miss = ((p - y) ** 2).mean()
    size = np.array([len(g) for g in model.groups])
    spread = (model.weights * (model.inside @ variances(p)) / size).mean()
    return np.array([fit + supervised * miss + model.penalty * spread, fit, miss, spread])


def gradient(model: GroupedModel, batch: tuple, number: int, supervised: float = 1.0, through: bool = True, width: float = 1e-2) -> np.ndarray:
    """Gradient of a batch's loss by the raw weights.

    `through`: with the solution that follows from the weights, by central differences (a solution for each side of each weight).
    Without it the solution counts as fixed, so only the penalty itself pulls and weights can but fall.
    """
    q, r, xx, n, y = batch
    if not through:
        p = solve_batch(model, q, r, n, number)
        size = np.array([len(g) for g in model.groups])
        return model.penalty / len(size) / (1 + np.exp(-model.raw)) * (model.inside @ variances(p)) / size
    out = np.zeros(len(model.raw))
    for i in range(len(out)):
        sides = [replace(model, raw=model.raw + s * width * (np.arange(len(out)) == i)) for s in (1, -1)]
        up, down = (losses(m, solve_batch(m, q, r, n, number), *batch, supervised)[0] for m in sides)
        out[i] = (up - down) / (2 * width)
    return out


def batches(obs: DataFrame, atlas: DataFrame, prop: DataFrame | None = None, *, batch: int = 32, seed: int = 42) -> DataFrame:
    """(number, samples, q, r, xx, n, y): samples dealt by a hash into batches of about `batch`, with their sums over seen markers; written.

    prop (sample, cell_type, w) is the truth, a type without a row being 0; without it y is null. A sample without a truth is left out.
    """
    atlas = A.fixed(atlas)
    types = linear.types_of(atlas)
    rows = linear.sums_by_sample(obs, atlas, F.lit(1.0))
    if prop is not None:
        at = F.create_map(*[x for i, t in enumerate(types) for x in (F.lit(t), F.lit(i))])
        pairs = prop.where(F.col("cell_type").isin(types)).groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct(at[F.col("cell_type")], "w"))).alias("told"))
        rows = rows.join(pairs, "sample").withColumn("y", F.transform(F.sequence(F.lit(0), F.lit(len(types) - 1)), lambda i: F.coalesce(F.col("told")[i], F.lit(0.0)))).drop("told")
    else:
        rows = rows.withColumn("y", F.lit(None).cast("array<double>"))
    rows = written(rows, "samples")
    count = rows.count()
    number = F.pmod(F.xxhash64("sample", F.lit(seed)), F.lit(max(1, -(-count // batch))))
    held = rows.groupBy(number.alias("number")).agg(F.array_sort(F.collect_list(F.struct("sample", "gram", "rhs", "xx", "n", "y"))).alias("s"))
    field = lambda name: F.transform("s", lambda x: x[name])
    told = held.select("number", field("sample").alias("samples"), F.flatten(field("gram")).alias("q"), F.flatten(field("rhs")).alias("r"), field("xx").alias("xx"), F.array_size("s").cast("double").alias("size"), F.aggregate(field("n"), F.lit(0.0), lambda a, x: a + x).alias("n"), F.flatten(field("y")).alias("y"))
    return written(told.drop("size"), "batches")


def _arrays(row, k: int) -> tuple:
    b = len(row.samples)
    y = np.asarray(row.y, float).reshape(b, k) if row.y is not None else np.zeros((b, k))
    return np.asarray(row.q, float).reshape(b, k, k), np.asarray(row.r, float).reshape(b, k), np.asarray(row.xx, float), float(row.n), y


def fit(model: GroupedModel, train: DataFrame, validation: DataFrame, *, epochs: int = 100, rate: float = 1e-3, patience: int = 10, supervised: float = 1.0, through: bool = True) -> tuple[GroupedModel, list[dict]]:
    """The model with weights learned by Adam, and a row for each epoch; train and validation as batches() gives them, with truths.

    Each epoch is one pass over both: losses of the weights as they are, and the training batches' mean gradient. Training ends after
    `patience` epochs without a better validation loss; the best weights stay.
    """
    both = train.withColumn("held", F.lit(False)).unionByName(validation.withColumn("held", F.lit(True)))
    k, m = len(model.types), len(model.groups)
    first, second, best, kept, stale, history = np.zeros(m), np.zeros(m), np.inf, model, 0, []
    for epoch in range(1, epochs + 1):

        def run(frames: Iterable[pd.DataFrame], model=model) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row in frame.itertuples():
                    batch = _arrays(row, k)
                    told = losses(model, solve_batch(model, *batch[:2], batch[3], row.number), *batch, supervised)
                    pulls = np.zeros(m) if row.held else gradient(model, batch, row.number, supervised, through)
                    yield pd.DataFrame({"held": row.held, "i": np.arange(5 + m), "v": np.concatenate([[1.0], told, pulls])})

        sums = both.mapInPandas(run, "held boolean, i int, v double").groupBy("held", "i").agg(F.sum("v").alias("v")).collect()  # twice (5 + groups) numbers
        told = {(r["held"], r["i"]): r["v"] for r in sums}
        if (False, 0) not in told or (True, 0) not in told:
            raise ValueError("no batches to train on or to judge by")
        mean = {side: np.array([told[side, i] for i in range(1, 5 + m)]) / told[side, 0] for side in (False, True)}
        history.append({"epoch": epoch, **{f"{name}_{part}": float(mean[side][i]) for side, name in ((False, "train"), (True, "val")) for i, part in enumerate(("loss", "fit", "truth", "spread"))}, "weights": model.weights.tolist()})
        if mean[True][0] < best:
            best, kept, stale = mean[True][0], model, 0
        else:
            stale += 1
            if stale >= patience:
                break
        g = mean[False][4:]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        model = replace(model, raw=model.raw - rate * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.999**epoch)) + 1e-8))
    return kept, history


HISTORY = "epoch int, " + ", ".join(f"{s}_{p} double" for s in ("train", "val") for p in ("loss", "fit", "truth", "spread")) + ", weights array<double>"


def predict(model: GroupedModel, told: DataFrame) -> DataFrame:
    """(sample, cell_type, w) of batches()."""
    k = len(model.types)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                q, r, _, n, _ = _arrays(row, k)
                p = solve_batch(model, q, r, n, row.number)
                yield pd.DataFrame({"sample": np.repeat(np.asarray(row.samples, object), k), "cell_type": model.types * len(p), "w": p.ravel()})

    return told.mapInPandas(run, "sample string, cell_type string, w double")


def new_model(atlas: DataFrame, groups: list[list[str]] | None = None, *, threshold: float = 0.3, known: list[list[str]] = (), **options) -> GroupedModel:
    """A model before training, weights at raw 0; groups by correlation of profiles unless given."""
    types = linear.types_of(atlas)
    groups = A.greedy_groups(A.correlations(atlas), types, known, threshold) if groups is None else groups
    return GroupedModel(types, groups, np.zeros(len(groups)), **options)


def solve_with_group_variance(obs: DataFrame, atlas: DataFrame, groups: list[list[str]], *, group_weights: list[float] | None = None, penalty: float = 0.1, steps: int = 100, rate: float = 0.01, batch: int = 32, seed: int = 42) -> DataFrame:
    """(sample, cell_type, w) by the given groups and raw weights: reconstruction error plus softplus-weighted variance of each group's types within a batch."""
    atlas = A.fixed(atlas)
    model = GroupedModel(linear.types_of(atlas), groups, np.array(group_weights or [0.0] * len(groups)), penalty, steps, rate, seed)
    return predict(model, batches(obs, atlas, batch=batch, seed=seed))


def save(model: GroupedModel, spark: SparkSession, path: str) -> None:
    """One row a group, as Parquet."""
    rows = [(i, g, float(w), model.types, model.penalty, model.steps, model.rate, model.seed) for i, (g, w) in enumerate(zip(model.groups, model.raw))]
    spark.createDataFrame(rows, "i int, types array<string>, raw double, all_types array<string>, penalty double, steps int, rate double, seed int").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> GroupedModel:
    rows = spark.read.parquet(path).orderBy("i").collect()  # one row a group
    one = rows[0]
    return GroupedModel(list(one["all_types"]), [list(r["types"]) for r in rows], np.array([r["raw"] for r in rows]), one["penalty"], one["steps"], one["rate"], one["seed"])
