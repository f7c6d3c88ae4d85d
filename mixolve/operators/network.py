"""A perceptron and an unrolled solver over observed fractions: scoring by Spark, training by gradients summed where rows lie."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixolve.sources.files import written


def features(obs: DataFrame, *, log_coverage: bool = True) -> DataFrame:
    """(sample, x): each sample's values in order of marker; fractions times log1p(coverage), 0 without reads. Samples need the same markers."""
    value = F.coalesce("x", F.lit(0.0)) * (F.log1p(F.col("c").cast("double")) if log_coverage else F.lit(1.0))
    return obs.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("marker", value.alias("v"), "c"))), lambda s: s["v"]).alias("x"))


#: Rows of features that a task works on at a time: what a training step keeps of them doesn't grow with the batches that Arrow brings.
ROWS_AT_ONCE = 1024


def slices(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Frames cut to ROWS_AT_ONCE rows; empty ones are left out."""
    for frame in frames:
        for at in range(0, len(frame), ROWS_AT_ONCE):
            yield frame.iloc[at : at + ROWS_AT_ONCE]


class Perceptron:
    """Linear, layer norm, ReLU, linear, softmax."""

    def __init__(self, markers: int, types: int, hidden: int = 256, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.p = {
            "w1": rng.normal(size=(markers, hidden)) / np.sqrt(markers), "b1": np.zeros(hidden), "g": np.ones(hidden), "s": np.zeros(hidden),
            "w2": rng.normal(size=(hidden, types)) / np.sqrt(hidden), "b2": np.zeros(types),
        }

    def forward(self, x: np.ndarray, parts: bool = False, keep: np.ndarray | None = None):
        z = x @ self.p["w1"] + self.p["b1"]
        sd = np.sqrt(z.var(axis=1, keepdims=True) + 1e-5)
        n = (z - z.mean(axis=1, keepdims=True)) / sd
        a = n * self.p["g"] + self.p["s"]
        r = np.maximum(a, 0) * (1 if keep is None else keep)
        o = r @ self.p["w2"] + self.p["b2"]
        e = np.exp(o - o.max(axis=1, keepdims=True))
        y = e / e.sum(axis=1, keepdims=True)
        return (y, n, sd, a, r) if parts else y

    @property
    def width(self) -> int:
        return self.p["w1"].shape[1]

    def loss(self, x: np.ndarray, truth: np.ndarray, criterion: Callable | None = None) -> np.ndarray:
        return (criterion or squared_error)(self.forward(x), truth)[0]

    def gradient(self, x: np.ndarray, truth: np.ndarray, criterion: Callable | None = None, weights: np.ndarray | None = None, keep: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], float]:
        """Summed gradient of the summed, weighted loss, and the loss; `keep` scales hidden values (dropout)."""
        y, n, sd, a, r = self.forward(x, True, keep)
        loss, dy = (criterion or squared_error)(y, truth)
        if weights is not None:
            loss, dy = loss * weights, dy * weights[:, None]
        do = y * (dy - (dy * y).sum(axis=1, keepdims=True))
        da = (do @ self.p["w2"].T) * (1 if keep is None else keep) * (a > 0)
        dn = da * self.p["g"]
        dz = (dn - dn.mean(axis=1, keepdims=True) - n * (dn * n).mean(axis=1, keepdims=True)) / sd
        g = {"w1": x.T @ dz, "b1": dz.sum(axis=0), "g": (da * n).sum(axis=0), "s": da.sum(axis=0), "w2": r.T @ do, "b2": do.sum(axis=0)}
        return g, float(loss.sum())

    def score(self, rows: DataFrame, types: list[str]) -> DataFrame:
        """(sample, cell_type, w) of rows(sample, x)."""
        sent = rows.sparkSession.sparkContext.broadcast(self)  # markers x hidden numbers

        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in slices(frames):
                y = sent.value.forward(np.stack(f["x"].to_numpy()).astype(float))
                yield pd.DataFrame({"sample": np.repeat(f["sample"].to_numpy(), len(types)), "cell_type": np.tile(types, len(f)), "w": y.ravel()})

        return rows.mapInPandas(run, "sample string, cell_type string, w double")


class UnrolledSolver:
    """Projected gradient, unrolled: a step size for each step, corrections to the profiles, and a two-layer transform of the input.

    A step moves against the gradient of the coverage-weighted error, cuts at 0 and divides by the sum. Parameters are given or
    trained (see fit); without `first` and `second` the transform is the identity and stays so. Rows to train on hold x, the markers'
    values followed by their coverages.
    """

    def __init__(self, profiles: np.ndarray, steps: np.ndarray, correction: np.ndarray | None = None, first: tuple[np.ndarray, np.ndarray] | None = None, second: tuple[np.ndarray, np.ndarray] | None = None, sparsity: float = 0.01):
        k, m = profiles.shape
        self.profiles, self.sparsity = np.asarray(profiles, float), sparsity
        self.p = {"steps": np.asarray(steps, float), "correction": np.zeros((k, m)) if correction is None else correction}
        #: What a training rate is multiplied by: step sizes move in proportion to what they are.
        self.scale = {"steps": float(np.abs(self.p["steps"]).mean())}
        for name, layer in (("1", first), ("2", second)):
            if layer is not None:
                self.p |= {f"w{name}": layer[0], f"b{name}": layer[1]}

    @classmethod
    def untrained(cls, profiles: np.ndarray, steps: int = 100, rate: float = 0.1, **options) -> UnrolledSolver:
        """Equal steps, no corrections, and a transform that is the identity before training."""
        m = profiles.shape[1]
        return cls(profiles, np.full(steps, rate), None, (np.eye(m), np.zeros(m)), (np.eye(m), np.zeros(m)), **options)

    @property
    def corrected(self) -> np.ndarray:
        return self.profiles + 1 / (1 + np.exp(-self.p["correction"]))

    def _transformed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inner = np.maximum(x if "w1" not in self.p else x @ self.p["w1"] + self.p["b1"], 0)
        return inner, (inner if "w2" not in self.p else inner @ self.p["w2"] + self.p["b2"])

    def forward(self, x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(proportions, coverage-weighted reconstruction by the given profiles) of rows of values and coverage."""
        z = self._transformed(x)[1] * c
        w, h = np.zeros((len(x), len(self.profiles))), self.corrected
        for step in self.p["steps"]:
            w = np.maximum(w - step * (((w @ h) * c - z) @ h.T), 0)
            w = w / (w.sum(axis=1, keepdims=True) + 1e-8)
        return w, (w @ self.profiles) * c

    def loss(self, rows: np.ndarray, truth: np.ndarray | None = None, criterion: Callable | None = None) -> np.ndarray:
        """Each row's loss: by `criterion` of proportions and truth if one is given, else mean squared error of the reconstruction plus sparsity times the mean size of proportions."""
        x, c = np.split(rows, 2, axis=1)
        w, back = self.forward(x, c)
        return criterion(w, truth)[0] if criterion else ((back - x * c) ** 2).mean(axis=1) + self.sparsity * np.abs(w).mean(axis=1)

    def gradient(self, rows: np.ndarray, truth: np.ndarray | None = None, criterion: Callable | None = None, weights: np.ndarray | None = None, keep: np.ndarray | None = None) -> tuple[dict[str, np.ndarray], float]:
        """Summed gradient of the summed, weighted loss, and the loss: a reverse pass through all steps. Of the steps only their starts are kept."""
        x, c = np.split(rows, 2, axis=1)
        inner, outer = self._transformed(x)
        z, h, starts = outer * c, self.corrected, [np.zeros((len(x), len(self.profiles)))]

        def moved(w: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            gap = (w @ h) * c - z
            slope = gap @ h.T
            return gap, slope, np.maximum(w - step * slope, 0)

        for step in self.p["steps"]:
            v = moved(starts[-1], step)[2]
            starts.append(v / (v.sum(axis=1, keepdims=True) + 1e-8))
        w = starts.pop()
        if criterion:
            loss, dw = criterion(w, truth)
        else:
            miss = (w @ self.profiles) * c - x * c
            loss = (miss**2).mean(axis=1) + self.sparsity * np.abs(w).mean(axis=1)
            dw = (2 / miss.shape[1] * miss * c) @ self.profiles.T + self.sparsity * np.sign(w) / w.shape[1]
        if weights is not None:
            loss, dw = loss * weights, dw * weights[:, None]
        dh, dz, dsteps = np.zeros_like(h), np.zeros_like(z), np.zeros(len(starts))
        for i in reversed(range(len(starts))):
            start, step = starts[i], self.p["steps"][i]
            gap, slope, v = moved(start, step)
            total = v.sum(axis=1, keepdims=True) + 1e-8
            du = (dw - (dw * v).sum(axis=1, keepdims=True) / total) / total * (v > 0)
            dsteps[i] = -(du * slope).sum()
            dslope = -step * du
            dgap = dslope @ h
            dh += dslope.T @ gap + start.T @ (dgap * c)
            dz -= dgap
            dw = du + (dgap * c) @ h.T
        bent = self.corrected - self.profiles
        out = {"steps": dsteps, "correction": dh * bent * (1 - bent)}
        d = dz * c
        if "w2" in self.p:
            out |= {"w2": inner.T @ d, "b2": d.sum(axis=0)}
            d = d @ self.p["w2"].T
        if "w1" in self.p:
            d = d * (inner > 0)
            out |= {"w1": x.T @ d, "b1": d.sum(axis=0)}
        return out, float(loss.sum())

    def score(self, rows: DataFrame, types: list[str]) -> DataFrame:
        """(sample, cell_type, w) of rows(sample, x, c), arrays in the order of the profiles' markers."""
        sent = rows.sparkSession.sparkContext.broadcast(self)  # types x markers numbers, and a transform of markers x markers if there is one

        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in slices(frames):
                w, _ = sent.value.forward(np.stack(f["x"].to_numpy()).astype(float), np.stack(f["c"].to_numpy()).astype(float))
                yield pd.DataFrame({"sample": np.repeat(f["sample"].to_numpy(), len(types)), "cell_type": np.tile(types, len(f)), "w": w.ravel()})

        return rows.mapInPandas(run, "sample string, cell_type string, w double")


def squared_error(y: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(loss of each row, its gradient by the outputs)."""
    return ((y - truth) ** 2).sum(axis=1), 2 * (y - truth)


def fit(model, rows: DataFrame, *, validation: DataFrame | None = None, criterion: Callable | None = None, epochs: int = 20, rate: float = 1e-2, patience: int = 10, halve_after: int = 5, clip: float = 1.0, decay: float = 1e-4, dropout: float = 0.0, seed: int = 42, checkpoint: str | None = None) -> list[dict]:
    """Adam on gradients that tasks sum where their rows lie; one summed gradient comes back an epoch.

    rows(sample, x, y[, weight]) and validation alike. `model` has parameters p, loss(x, truth, criterion) and gradient(x, truth, criterion,
    weights, keep); `criterion` gives each row's loss and gradient, the model's own is taken without one. Rows are written once, so a
    lost executor costs a reread. Dropout is drawn by epoch and task. The rate halves after `halve_after` epochs without a better
    validation loss (training loss without validation), training ends after `patience`, and the best parameters stay and are
    saved to `checkpoint` when they are found. Returns epoch, rate, train_loss and val_loss of each epoch.
    """
    weighted = lambda df: df.select("x", "y", (F.col("weight") if "weight" in df.columns else F.lit(1.0)).cast("double").alias("weight"))
    data, held = written(weighted(rows), "training"), written(weighted(validation), "validation") if validation is not None else None
    first, second, history, best, kept, stale = {}, {}, [], np.inf, None, 0
    context = rows.sparkSession.sparkContext
    for epoch in range(1, epochs + 1):
        sent = context.broadcast(model)

        def run(frames: Iterable[pd.DataFrame], sent=sent, epoch=epoch) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            rng, total, loss, n = np.random.default_rng([seed, epoch, TaskContext.get().partitionId()]), None, 0.0, 0
            for f in slices(frames):
                x = np.stack(f["x"].to_numpy()).astype(float)
                keep = (rng.random((len(f), sent.value.width)) >= dropout) / (1 - dropout) if dropout else None
                g, miss = sent.value.gradient(x, np.stack(f["y"].to_numpy()).astype(float), criterion, f["weight"].to_numpy(), keep)
                flat = np.concatenate([g[k].ravel() for k in sorted(g)])
                total, loss, n = flat if total is None else total + flat, loss + miss, n + len(f)
            if n:
                yield pd.DataFrame({"i": np.arange(-2, len(total)), "v": np.concatenate([[loss, n], total])})

        sums = data.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
        told = np.array([r["v"] for r in sums.orderBy("i").collect()])  # one number a parameter
        if not len(told):
            raise ValueError("no rows to train on")
        flat, loss = told[2:] / told[1], told[0] / told[1]
        judged = mean_loss(model, held, criterion) if held is not None else loss
        history.append({"epoch": epoch, "rate": rate, "train_loss": float(loss), "val_loss": float(judged)})
        if judged < best:
            best, kept, stale = judged, {k: v.copy() for k, v in model.p.items()}, 0
            if checkpoint:
                save(model, rows.sparkSession, checkpoint)
        else:
            stale += 1
            if stale % halve_after == 0:
                rate /= 2
            if stale >= patience:
                break
        flat *= min(1.0, clip / max(float((flat * flat).sum()) ** 0.5, 1e-12))
        at = 0
        for k in sorted(model.p):
            g = flat[at : at + model.p[k].size].reshape(model.p[k].shape) + decay * model.p[k]
            at += model.p[k].size
            first[k] = 0.9 * first.get(k, 0) + 0.1 * g
            second[k] = 0.999 * second.get(k, 0) + 0.001 * g * g
            model.p[k] = model.p[k] - rate * getattr(model, "scale", {}).get(k, 1.0) * (first[k] / (1 - 0.9**epoch)) / (np.sqrt(second[k] / (1 - 0.999**epoch)) + 1e-8)
        sent.unpersist()
    model.p = kept or model.p
    return history


def train(model, rows: DataFrame, **how) -> list[float]:
    """fit, but only the training losses."""
    return [h["train_loss"] for h in fit(model, rows, **how)]


def mean_loss(model, rows: DataFrame, criterion: Callable | None = None) -> float:
    """The weighted loss a row of rows(x, y, weight), summed where they lie."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames):
            loss = sent.value.loss(np.stack(f["x"].to_numpy()).astype(float), np.stack(f["y"].to_numpy()).astype(float), criterion)
            yield pd.DataFrame({"loss": [float((loss * f["weight"].to_numpy()).sum())], "n": [len(f)]})

    told = rows.mapInPandas(run, "loss double, n long").agg(F.sum("loss"), F.sum("n")).first()
    return told[0] / told[1] if told[1] else float("nan")


def save(model, spark: SparkSession, path: str, *, markers: list[str] | None = None, types: list[str] | None = None) -> None:
    """One row an array of parameters, as Parquet; with the names of its markers and types, if given, in order."""
    rows = [(k, list(v.shape), v.ravel().tolist(), None) for k, v in model.p.items()]
    if isinstance(model, UnrolledSolver):
        rows.append(("profiles", list(model.profiles.shape), model.profiles.ravel().tolist(), None))
    rows += [(name, [len(names)], None, list(names)) for name, names in (("markers", markers), ("types", types)) if names is not None]
    spark.createDataFrame(rows, "name string, shape array<int>, value array<double>, names array<string>").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str):
    """The model that save() wrote, a Perceptron or an UnrolledSolver, with attributes markers and types (None if they weren't saved)."""
    rows = spark.read.parquet(path).collect()  # one row an array
    made = {r["name"]: np.array(r["value"], float).reshape(r["shape"]) for r in rows if r["value"] is not None}
    if "profiles" in made:
        model = UnrolledSolver(made.pop("profiles"), made["steps"])
    else:
        model = Perceptron(made["w1"].shape[0], made["w2"].shape[1], made["w1"].shape[1])
    model.p = made
    names = {r["name"]: list(r["names"]) for r in rows if r["value"] is None}
    model.markers, model.types = names.get("markers"), names.get("types")
    return model


def aligned(obs: DataFrame, markers: list[str], *, least: float = 0.0) -> DataFrame:
    """(sample, x, c): each sample's values and coverages in the order of `markers`, by name.

    A marker that a sample lacks, or that has no value, counts as without coverage: 0 and 0. Markers that aren't asked for are left out; a sample
    without any of them is left out, and if a sample has coverage at less than the share `least` of them, that raises.
    """
    spark = obs.sparkSession
    wanted = spark.createDataFrame(list(enumerate(markers)), "i int, marker string")
    there = F.col("x").isNotNull() & (F.col("c") > 0)
    met = obs.join(wanted, "marker").select("sample", "i", F.when(there, F.col("x")).otherwise(0.0).alias("x"), F.when(there, F.col("c").cast("double")).otherwise(0.0).alias("c"))
    told = met.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("x", "c")))).alias("m"), F.count_if(F.col("c") > 0).alias("n"))
    if least > 0:
        few = told.where(F.col("n") < least * len(markers)).select("sample").limit(1).collect()
        if few:
            raise ValueError(f"sample {few[0][0]!r} has coverage at less than {least:.0%} of the model's markers")
    each = lambda f: F.transform(F.sequence(F.lit(0), F.lit(len(markers) - 1)), lambda i: F.coalesce(F.col("m")[i][f], F.lit(0.0)))
    return told.select("sample", each("x").alias("x"), each("c").alias("c"))


def predict(model, obs: DataFrame, *, least: float = 0.0) -> DataFrame:
    """(sample, cell_type, w) by a loaded model, markers aligned by name; raises if the model was saved without names."""
    if not model.markers or not model.types:
        raise ValueError("the model was saved without the names of its markers and types")
    rows = aligned(obs, model.markers, least=least)
    if isinstance(model, Perceptron):
        rows = rows.select("sample", F.zip_with("x", "c", lambda x, c: x * F.log1p(c)).alias("x"))
    return model.score(rows, model.types)
