"""Constrained solvers for each sample: small numpy problems inside tasks, samples spread by Spark.

The named solvers work on sums of types x types numbers a sample, formed where observations lie; a callable of the user's
gets a sample's markers (rows) by the cell types (columns).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixolve.operators import linear
from mixolve.operators.atlas import fixed, profiles
from mixolve.operators.reads import WEIGHTS
from mixolve.sources.files import clear, written


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-10) -> np.ndarray:
    """min |a w - b| with w >= 0, by active sets: free the steepest variable, step back to the boundary when one turns negative."""
    k = a.shape[1]
    w, free = np.zeros(k), np.zeros(k, bool)
    scale = max(1.0, float(np.abs(a.T @ b).max(initial=0.0)))
    for _ in range(10 * k + 30):
        slope = a.T @ (b - a @ w)
        slope[free] = -np.inf
        if free.all() or slope.max() <= tolerance * scale:
            break
        free[int(slope.argmax())] = True
        while True:
            s = np.zeros(k)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            low = free & (s <= 0)
            if not low.any():
                w = s
                break
            share = (w[low] / np.maximum(w[low] - s[low], 1e-300)).min()
            w = w + share * (s - w)
            free &= w > 1e-14
            w[~free] = 0.0
    return w


def nnls_of_sums(q: np.ndarray, r: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """min w q w - 2 r w with w >= 0, by the same active sets, from the sums q = a'a and r = a'b alone."""
    k = len(r)
    w, free = np.zeros(k), np.zeros(k, bool)
    scale = max(float(np.abs(r).max(initial=0.0)), 1e-300)
    for _ in range(10 * k + 30):
        slope = r - q @ w
        slope[free] = -np.inf
        if free.all() or slope.max() <= tolerance * scale:
            break
        free[int(slope.argmax())] = True
        while True:
            s = np.zeros(k)
            s[free] = np.linalg.lstsq(q[np.ix_(free, free)], r[free], rcond=None)[0]
            low = free & (s <= 0)
            if not low.any():
                w = s
                break
            share = (w[low] / np.maximum(w[low] - s[low], 1e-300)).min()
            w = w + share * (s - w)
            free &= w > 1e-14
            w[~free] = 0.0
    return w


def on_simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point with w >= 0 and sum 1."""
    u = np.sort(v)[::-1]
    gap = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - gap[np.flatnonzero(u > gap)[-1]], 0.0)


def simplex_least_squares(q: np.ndarray, r: np.ndarray, steps: int = 3000) -> np.ndarray:
    """min w q w - 2 r w on the simplex: accelerated projected gradient, then exact on its support."""
    k = len(r)
    rate = 1.0 / max(float(np.linalg.eigvalsh(q)[-1]), 1e-12)
    w = z = np.full(k, 1.0 / k)
    t = 1.0
    for _ in range(steps):
        new = on_simplex(z - rate * (q @ z - r))
        if (z - new) @ (new - w) > 0:
            t, z = 1.0, w
            new = on_simplex(w - rate * (q @ w - r))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, gap, w, t = new + (t - 1) / t2 * (new - w), float(np.abs(new - w).max()), new, t2
        if gap < 1e-13:
            break
    on = w > 1e-9
    n = int(on.sum())
    system = np.block([[q[np.ix_(on, on)], np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    exact = np.zeros(k)
    exact[on] = np.linalg.lstsq(system, np.append(r[on], 1.0), rcond=None)[0][:n]
    better = exact.min() >= 0 and abs(exact.sum() - 1) < 1e-9 and exact @ q @ exact - 2 * r @ exact <= w @ q @ w - 2 * r @ w + 1e-15
    return exact if better else w


def share(w: np.ndarray) -> np.ndarray:
    return w / w.sum() if w.sum() > 0 else w


def weights(c: np.ndarray, how: str) -> np.ndarray:
    return {"none": np.ones_like(c), "linear": c, "sqrt": np.sqrt(c), "pow1.5": c**1.5}[how]


def solve_nnls(h, x, c, weight: str = "linear") -> np.ndarray:
    """Non-negative least squares with the weight inside the norm, divided by its sum."""
    u = weights(c, weight)
    return share(nnls(h * u[:, None], x * u))


def solve_simplex(h, x, c, weight: str = "linear", regularisation: str = "none", alpha: float = 0.0, l1_ratio: float = 0.5) -> np.ndarray:
    """Regularised least squares on the simplex, where the absolute sum is constant: lasso equals none, elastic net a weaker ridge."""
    ridge = ridge_of(regularisation, alpha, l1_ratio)
    u = weights(c, weight)
    a, b = h * u[:, None], x * u
    return simplex_least_squares(a.T @ a + ridge * np.eye(h.shape[1]), a.T @ b)


def solve_iterative(h, x, c, weight: str = "sqrt", rounds: int = 3, base: float = 1e-4, least: int = 3, one_round: bool = True) -> np.ndarray:
    """Non-negative least squares refined on candidate types: those whose profile follows the residual, or that are active.

    Keeps the round with the least coverage-weighted error. `one_round` stops when a round is the best
    so far, as the published method does in its first round; without it all rounds are run.
    """
    u = weights(c, weight)
    a, b = h * u[:, None], x * u
    now = nnls(a, b)
    best, least_error = now, np.inf
    for k in range(rounds):
        r = (x - h @ now) * np.sqrt(c)
        corr = np.zeros(h.shape[1])
        if r.std() > 0:
            varied = h.std(axis=0) > 0
            corr[varied] = np.abs((h[:, varied] - h[:, varied].mean(axis=0)).T @ (r - r.mean())) / (len(r) * r.std() * h[:, varied].std(axis=0))
        chosen = corr > corr.max() * (0.3 + 0.1 * k)
        if chosen.sum() < least:
            chosen[np.argsort(-corr, kind="stable")[:least]] = True
        chosen |= now > base * (1 + k)
        now = np.zeros(h.shape[1])
        now[chosen] = nnls(a[:, chosen], b)
        error = float((c * (x - h @ now) ** 2).sum())
        if error < least_error:
            least_error, best = error, now
        if one_round and np.allclose(now, best, rtol=1e-5, atol=1e-8):
            break
    return share(best)


def refined_of_moments(own: np.ndarray, root: np.ndarray, linear: np.ndarray, plain: np.ndarray, rounds: int = 3, base: float = 1e-4, least: int = 3, one_round: bool = True) -> np.ndarray:
    """solve_iterative from a sample's sums alone (see linear.moments_by_sample): of the solver's squared weight, of sqrt(c), of c and of 1.

    A residual's sums are those of x less those of the mixture, so its mean, spread and covariance with each profile follow from
    the sums of sqrt(c), c and 1, and so does the coverage-weighted error. A spread under what rounding leaves of the sums counts as none.
    """
    k = len(own) - 2
    x, one = k, k + 1
    now = nnls_of_sums(own[:k, :k], own[:k, x])
    n = plain[one, one]
    mean_h = plain[:k, one] / n
    spread_h = np.diag(plain)[:k] / n - mean_h**2
    varied = spread_h > 1e-13 * np.maximum(np.diag(plain)[:k] / n, 1e-300)
    best, least_error = now, np.inf
    for t in range(rounds):
        squares = linear[x, x] - 2 * now @ linear[:k, x] + now @ linear[:k, :k] @ now
        mean = (root[one, x] - now @ root[:k, one]) / n
        spread = squares / n - mean**2
        corr = np.zeros(k)
        if spread > 1e-13 * linear[x, x] / n:
            together = (root[:k, x] - root[:k, :k] @ now) / n - mean * mean_h
            corr[varied] = np.minimum(np.abs(together[varied]) / np.sqrt(spread * spread_h[varied]), 1)
        chosen = corr > corr.max() * (0.3 + 0.1 * t)
        if chosen.sum() < least:
            chosen[np.argsort(-corr, kind="stable")[:least]] = True
        chosen |= now > base * (1 + t)
        now = np.zeros(k)
        now[chosen] = nnls_of_sums(own[:k, :k][np.ix_(chosen, chosen)], own[:k, x][chosen])
        error = float(linear[x, x] - 2 * now @ linear[:k, x] + now @ linear[:k, :k] @ now)
        if error < least_error:
            least_error, best = error, now
        if one_round and np.allclose(now, best, rtol=1e-5, atol=1e-8):
            break
    return share(best)


def ridge_of(regularisation: str, alpha: float, l1_ratio: float) -> float:
    """On the simplex the absolute sum is constant: lasso equals none, elastic net a weaker ridge."""
    if regularisation not in ("none", "ridge", "lasso", "elasticnet"):
        raise ValueError(f"unknown regularisation {regularisation!r}; one of none, ridge, lasso, elasticnet")
    return {"ridge": alpha, "elasticnet": alpha * (1 - l1_ratio)}.get(regularisation, 0.0)


def sums_nnls(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    return share(nnls_of_sums(q, r))


def sums_simplex(q: np.ndarray, r: np.ndarray, regularisation: str = "none", alpha: float = 0.0, l1_ratio: float = 0.5) -> np.ndarray:
    return simplex_least_squares(q + ridge_of(regularisation, alpha, l1_ratio) * np.eye(len(r)), r)


#: Solvers that need a sample's K x K sums alone, with their usual weighting and what other weights (of c, not squared) they need sums of.
OF_SUMS: dict[str, tuple[Callable, str, tuple]] = {
    "nnls": (lambda m, **o: sums_nnls(m[:-2, :-2], m[:-2, -2], **o), "linear", ()),
    "simplex": (lambda m, **o: sums_simplex(m[:-2, :-2], m[:-2, -2], **o), "linear", ()),
    "iterative": (refined_of_moments, "sqrt", (F.sqrt, lambda c: c, lambda c: F.lit(1.0))),
}


def solve(obs: DataFrame, atlas: DataFrame, solver: str | Callable = "nnls", *, weight: str | Callable | None = None, **options) -> DataFrame:
    """(sample, cell_type, w): each sample's mixture.

    obs(sample, marker, x, c) joins profiles on marker; x without coverage counts as 0. `weight` is a
    name of WEIGHTS or, for the solvers of OF_SUMS, a function of the coverage column. Those are solved from sums of
    types x types numbers a sample, formed where rows lie; any other callable (h, x, c, **options) -> w gets a sample's
    rows, at most the atlas's markers, in one task. A sample
    with no markers in the atlas gives no rows; one with no coverage at all gives zeros (nnls).
    """
    atlas = fixed(atlas)
    types = linear.types_of(atlas)
    if isinstance(solver, str):
        run, usual, more = OF_SUMS[solver]
        u = (WEIGHTS[weight or usual] if not callable(weight) else weight)(F.col("c"))
        filled = obs.withColumn("x", F.coalesce(F.when(F.col("c") > 0, F.col("x")), F.lit(0.0)))
        told = linear.moments_by_sample(filled, atlas, [u * u, *[f(F.col("c")) for f in more]], F.lit(True))

        def each(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                w = [run(*[np.asarray(one, float).reshape(len(types) + 2, -1) for one in m], **options) for m in frame["m"]]
                yield pd.DataFrame({"sample": np.repeat(frame["sample"].to_numpy(), len(types)), "cell_type": types * len(frame), "w": np.concatenate(w) if w else np.zeros(0)})

        return told.mapInPandas(each, "sample string, cell_type string, w double")
    if callable(weight):
        raise ValueError("a weighting function is for solvers of sums; others take the name of one")
    options |= {} if weight is None else {"weight": weight}
    rows = obs.select("sample", "marker", F.coalesce(F.when(F.col("c") > 0, F.col("x")), F.lit(0.0)).alias("x"), F.col("c").cast("double").alias("c")).join(profiles(atlas), "marker")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("marker")
        h = np.stack(frame["profile"].to_numpy()).astype(float)
        w = solver(h, frame["x"].to_numpy(float), frame["c"].to_numpy(float), **options)
        return pd.DataFrame({"sample": frame["sample"].iloc[0], "cell_type": types, "w": w})

    return rows.groupBy("sample").applyInPandas(one, "sample string, cell_type string, w double")


def grouped(obs: DataFrame, atlas: DataFrame, groups: list[list[str]], *, steps: int = 1000, tolerance: float = 1e-6) -> tuple[DataFrame, np.ndarray]:
    """Grouped factorisation x ~ A B h: A per sample over groups, B shared by all samples within groups.

    Multiplicative updates, A first, then B by the mixtures before A's step, each divided by its sum; ends when the loss after both changes
    by less than tolerance, or by less than single precision tells. A sample is its K x K sums, formed once by Spark, and its row of A; a step maps them to the new A, of which
    only sums of (groups x types) numbers reach the driver. A's rows are written to storage each twenty
    steps, so a step never goes back further than that. Returns (sample, cell_type, w) and B.
    """
    atlas = fixed(atlas)
    types = linear.types_of(atlas)
    k, m = len(types), len(groups)
    inside = np.array([[t in g for t in types] for g in groups], float)
    b = inside / inside.sum(axis=1, keepdims=True)
    rows = linear.sums_by_sample(obs, atlas, F.lit(1.0)).select("sample", F.col("gram").alias("q"), "rhs", "xx", F.array(*[F.lit(1.0 / m)] * m).alias("a"))
    now = written(rows, "grouped")

    def moved(frame: pd.DataFrame, past: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(A after a step for each B of past, A before the last step, sums, right sides) of a frame of samples."""
        a, q, r = (np.stack(frame[c].to_numpy()).astype(float) for c in ("a", "q", "rhs"))
        q, before = q.reshape(-1, k, k), a
        for old in past:
            before = a
            a = a * (r @ old.T) / (np.einsum("nk,nkl,gl->ng", a @ old, q, old) + 1e-10)
            a = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-12)
        return a, before, q, r

    def sums(past: list[np.ndarray]) -> np.ndarray:
        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    a, before, q, r = moved(frame, past)
                    up, down = a.T @ r, np.einsum("ng,nkl,nl->gk", a, q, before @ past[-1])
                    pairs = np.einsum("ng,nkl,nh->ghkl", a, q, a)  # with B, the loss after its step
                    flat = np.concatenate([up.ravel(), down.ravel(), pairs.ravel(), [frame["xx"].sum()]])
                    yield pd.DataFrame({"i": np.arange(len(flat)), "v": flat})

        parts = now.mapInPandas(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i")
        return np.array([r["v"] for r in parts.collect()])  # (groups x types) squared numbers

    past, last = [], None
    for step in range(steps):
        past.append(b)
        flat = sums(past)
        if not len(flat):
            break
        up, down, pairs, xx = flat[: m * k].reshape(m, k), flat[m * k : 2 * m * k].reshape(m, k), flat[2 * m * k : -1].reshape(m, m, k, k), flat[-1]
        b = b * inside * up / (down + 1e-10)
        b = b / np.maximum(b.sum(axis=1, keepdims=True), 1e-12)
        loss = float(xx - 2 * (b * up).sum() + np.einsum("gk,ghkl,hl->", b, pairs, b))
        done = last is not None and abs(last - loss) < max(tolerance, loss * 2.0**-24 if tolerance else 0)
        last = loss
        if done or len(past) == 20 or step == steps - 1:
            ready = list(past)

            def forward(frames: Iterable[pd.DataFrame], ready=ready) -> Iterator[pd.DataFrame]:
                for frame in frames:
                    if len(frame):
                        yield frame.assign(a=moved(frame, ready)[0].tolist())

            before, now, past = now, written(now.mapInPandas(forward, rows.schema), "grouped"), []
            clear(now.sparkSession, [before.inputFiles()[0].rpartition("/")[0]] if before.inputFiles() else [])
        if done:
            break
    grouped.steps = step + 1 if steps else 0
    spread = F.explode(F.arrays_zip(F.array(*map(F.lit, types)).alias("cell_type"), F.array(*[sum((F.col("a")[g] * float(b[g, t]) for g in range(m)), F.lit(0.0)) for t in range(k)]).alias("w")))
    return now.select("sample", spread.alias("z")).select("sample", "z.cell_type", "z.w"), b


def eigen(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, descending, and eigenvectors (columns) of a symmetric matrix, by cyclic Jacobi rotations.

    For K x K matrices in the driver, where the JVM was started from the same process: threads of a linear-algebra library can stand still there, and
    rotations need none.
    """
    a, n = np.array(a, float), len(a)
    v = np.eye(n)
    for _ in range(sweeps):
        if (np.triu(a, 1) ** 2).sum() <= 1e-28 * max((a * a).sum(), 1e-300):
            break
        for i in range(n - 1):
            for j in range(i + 1, n):
                if abs(a[i, j]) <= 1e-18 * max(abs(a[i, i]) + abs(a[j, j]), 1e-300):
                    continue
                turn = (a[j, j] - a[i, i]) / (2 * a[i, j])
                t = (1.0 if turn >= 0 else -1.0) / (abs(turn) + (turn * turn + 1) ** 0.5)
                c = 1 / (t * t + 1) ** 0.5
                s = t * c
                for m in (a, a.T, v):
                    x, y = m[:, i].copy(), m[:, j].copy()
                    m[:, i], m[:, j] = c * x - s * y, s * x + c * y
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[:, order]


def principal_components(gram: np.ndarray, n: int) -> np.ndarray:
    """Scores of the types on n components from their K x K inner products; a component's largest loading is positive."""
    centred = gram - gram.mean(axis=0) - gram.mean(axis=1)[:, None] + gram.mean()
    values, vectors = (x[..., :n] for x in eigen(centred))
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
    return vectors * np.sqrt(np.maximum(values, 0))


def multidimensional_scaling(d: np.ndarray, dims: int = 2, seed: int = 42, steps: int = 300) -> tuple[np.ndarray, float]:
    """Metric scaling by stress majorisation of a K x K distance matrix: (points, stress)."""
    k = len(d)
    x = np.random.default_rng(seed).normal(size=(k, dims))
    for _ in range(steps):
        now = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        b = -np.where(now > 1e-12, d / np.maximum(now, 1e-12), 0.0)
        np.fill_diagonal(b, 0.0)
        np.fill_diagonal(b, -b.sum(axis=1))
        x = np.einsum("ij,jd->id", b, x) / k
    now = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return x, float(((now - d) ** 2).sum() / 2)
