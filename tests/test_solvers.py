"""Solvers against optimality conditions and known mixtures."""

import itertools

import numpy as np
import pytest

from mixolve.operators import solvers as S


def problem(seed, m=40, k=4):
    rng = np.random.default_rng(seed)
    return rng.uniform(0, 1, (m, k)), rng.uniform(0, 1, m), rng.integers(0, 30, m).astype(float)


@pytest.mark.parametrize("seed", range(8))
def test_nnls_is_the_best_active_set(seed):
    h, x, _ = problem(seed)
    b = h @ np.array([0.5, -0.4, 0.3, 0.1]) + 0.05 * x
    w = S.nnls(h, b)
    slope = h.T @ (b - h @ w)
    assert (w >= 0).all() and (slope <= 1e-7).all() and np.allclose(slope[w > 1e-9], 0, atol=1e-7)
    best = np.inf
    for n in range(5):
        for on in itertools.combinations(range(4), n):
            s = np.zeros(4)
            if on:
                s[list(on)] = np.linalg.lstsq(h[:, on], b, rcond=None)[0]
            if (s >= 0).all():
                best = min(best, ((h @ s - b) ** 2).sum())
    assert ((h @ w - b) ** 2).sum() <= best + 1e-9


@pytest.mark.parametrize("seed", range(8))
def test_simplex_meets_its_conditions(seed):
    h, x, c = problem(seed)
    q, r = (h * c[:, None]).T @ (h * c[:, None]), (h * c[:, None]).T @ (x * c)
    w = S.simplex_least_squares(q, r)
    slope = q @ w - r
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
    on = w > 1e-7
    level = slope[on].mean()
    scale = np.abs(slope).max() + 1
    assert np.allclose(slope[on], level, atol=1e-5 * scale) and (slope[~on] >= level - 1e-5 * scale).all()


def test_every_solver_recovers_a_noiseless_mixture():
    h, _, c = problem(3, 30, 3)
    w = np.array([0.2, 0.3, 0.5])
    c[0] = 0
    x = np.where(c > 0, h @ w, 0)
    for run in (S.solve_nnls, S.solve_simplex, lambda *a: S.solve_iterative(*a, weight="sqrt"), lambda *a: S.solve_iterative(*a, rounds=7, one_round=False)):
        assert np.allclose(run(h, x, c), w, atol=1e-6)


def test_regularisation_on_the_simplex():
    h, x, c = problem(5)
    plain = S.solve_simplex(h, x, c)
    assert np.allclose(plain, S.solve_simplex(h, x, c, regularisation="lasso", alpha=3.0), atol=1e-9)
    assert np.allclose(S.solve_simplex(h, x, c, regularisation="elasticnet", alpha=4.0, l1_ratio=0.5), S.solve_simplex(h, x, c, regularisation="ridge", alpha=2.0), atol=1e-9)
    assert np.abs(S.solve_simplex(h, x, c, regularisation="ridge", alpha=1e9) - 0.25).max() < 1e-3
    with pytest.raises(ValueError):
        S.solve_simplex(h, x, c, regularisation="huber")


def test_no_coverage_gives_zeros_and_duplicated_profiles_still_solve():
    h, x, c = problem(6)
    assert not S.solve_nnls(h, 0 * x, 0 * c).any()
    twice = np.hstack([h, h[:, :1]])
    w = S.solve_nnls(twice, x, c)
    assert np.isfinite(w).all() and abs(w.sum() - 1) < 1e-9


def test_scaling_and_components_keep_distances():
    rng = np.random.default_rng(0)
    p = rng.normal(size=(7, 2))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    _, stress = S.multidimensional_scaling(d, steps=2000)
    assert stress < 1e-3
    scores = S.principal_components(p @ p.T, 2)
    assert np.allclose(np.sqrt(((scores[:, None] - scores[None]) ** 2).sum(-1)), d)


def test_eigen_by_rotations(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 150):  # in a process that started a JVM
        x = rng.normal(size=(n, n + 3))
        a = (x[:, None] * x[None]).sum(-1)
        values, vectors = S.eigen(a)
        assert (np.diff(values) <= 1e-9).all() and np.allclose((a[:, :, None] * vectors[None]).sum(axis=1), vectors * values, atol=1e-8 * max(values[0], 1))
    assert S.eigen(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_grouped_factorisation_fits_its_own_model(spark):
    rng = np.random.default_rng(2)
    h = rng.uniform(0, 1, (20, 3))
    b = np.array([[0.7, 0.3, 0], [0, 0, 1.0]])
    rows = []
    for s in range(8):
        a = rng.dirichlet([1, 1])
        x = h @ (b.T @ a)
        rows += [(f"s{s}", f"m{i:02d}", float(x[i]), 10) for i in range(20)]
    obs = spark.createDataFrame(rows, "sample string, marker string, x double, c long")
    atlas = spark.createDataFrame([(f"m{i:02d}", t, float(h[i, k])) for i in range(20) for k, t in enumerate("abc")], "marker string, cell_type string, h double")
    w, found = S.grouped(obs, atlas, [["a", "b"], ["c"]], steps=40, tolerance=0)
    assert np.allclose(found.sum(axis=1), 1) and abs(found[0, 0] - 0.7) < 0.1
    totals = {}
    for r in w.collect():
        totals[r.sample] = totals.get(r.sample, 0) + r.w
    assert len(totals) == 8 and all(abs(t - 1) < 1e-6 for t in totals.values())


def test_student_tail_known_values():
    from mixolve.operators.distinguish import student_tail

    t, df = np.array([0.0, 2.0, -2.228, 1.96, 12.706, 50.0]), np.array([5.0, 10.0, 10.0, 1e6, 1.0, 30.0])
    assert np.allclose(student_tail(t, df), [1.0, 0.07339, 0.05001, 0.05000, 0.05000, 0.0], atol=2e-5)


def test_distinguishing_markers_are_found(spark):
    from mixolve.operators.distinguish import distinguishability

    rows = [(f"m{i}", t, 0.9 if (t, i) == ("a", 3) else 0.1 + 0.05 * ((i + k) % 3)) for i in range(6) for k, t in enumerate("abc")]
    got = {(r.cell_type, r.step): r for r in distinguishability(spark.createDataFrame(rows, "marker string, cell_type string, h double"), steps=3, draws=500).collect()}
    assert got["a", 2].top_markers[0] == "m3" and got["a", 2].n_distinguishable >= 1 and len(got) == 9


def test_group_variance_solver_recovers_a_mixture(spark):
    from mixolve.operators.regularised import solve_with_group_variance

    rng = np.random.default_rng(0)
    h, w = rng.uniform(0, 1, (40, 3)), np.array([0.2, 0.3, 0.5])
    obs = spark.createDataFrame([(f"s{s}", f"m{i}", float((h @ w)[i]), 5) for s in range(6) for i in range(40)], "sample string, marker string, x double, c long")
    atlas = spark.createDataFrame([(f"m{i}", t, float(h[i, k])) for i in range(40) for k, t in enumerate("abc")], "marker string, cell_type string, h double")
    got = solve_with_group_variance(obs, atlas, [["a", "b"], ["c"]], steps=600, penalty=0.001).collect()
    assert len(got) == 18 and all(abs(r.w - dict(zip("abc", w))[r.cell_type]) < 0.03 for r in got)


def from_rows(h, x, c, squared):
    z = np.column_stack([h, x, np.ones(len(x))])
    return (z * squared[:, None]).T @ z


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("how", [{}, {"weight": "pow1.5", "rounds": 7, "base": 0.005, "least": 2, "one_round": False}])
def test_refinement_from_sums_is_that_from_rows(seed, how):
    h, x, c = problem(seed, 60, 6)
    x = np.where(c > 0, np.clip(h @ np.random.default_rng(seed).dirichlet(np.full(6, 0.4)) + 0.05 * (x - 0.5), 0, 1), 0)
    options = {k: v for k, v in how.items() if k != "weight"}
    sums = [from_rows(h, x, c, s) for s in (S.weights(c, how.get("weight", "sqrt")) ** 2, np.sqrt(c), c, np.ones_like(c))]
    assert np.allclose(S.refined_of_moments(*sums, **options), S.solve_iterative(h, x, c, **how), atol=1e-7)


def test_refinement_from_sums_of_awkward_samples():
    h, x, c = problem(2, 30, 3)
    h[:, 1] = 0.4  # a constant profile
    flat = [from_rows(h, 0 * x, 0 * c, s) for s in (0 * c, 0 * c, 0 * c, np.ones_like(c))]
    assert not S.refined_of_moments(*flat).any()
    w = np.array([0.2, 0.3, 0.5])
    exact = [from_rows(h, h @ w, c, s) for s in (c, np.sqrt(c), c, np.ones_like(c))]
    assert np.allclose(S.refined_of_moments(*exact, one_round=False), w, atol=1e-6)


def test_sums_in_slices_and_blocks_are_whole_sums(spark, monkeypatch):
    from pyspark.sql import functions as F

    from mixolve.operators import linear as L

    rng = np.random.default_rng(4)
    h, rows = rng.uniform(0, 1, (90, 3)), []
    x, c = rng.uniform(0, 1, (5, 90)), rng.integers(0, 4, (5, 90))
    for s in range(5):
        rows += [(f"s{s}", f"m{i}", float(x[s, i]) if c[s, i] else None, int(c[s, i])) for i in range(90)]
    rows += [("s0", "unknown", 0.5, 9), ("lost", "unknown", 0.5, 9)]
    obs = spark.createDataFrame(rows, "sample string, marker string, x double, c long")
    atlas = spark.createDataFrame([(f"m{i}", t, float(h[i, k])) for i in range(90) for k, t in enumerate("abc")], "marker string, cell_type string, h double")
    for per_task, block in ((4096, 100_000), (20, 100_000), (10, 40)):
        monkeypatch.setattr(L, "ROWS_PER_TASK", per_task)
        told = {r.sample: r.m for r in L.moments_by_sample(obs, atlas, [F.col("c").cast("double"), F.lit(1.0)], F.lit(True), block).collect()}
        assert set(told) == {f"s{s}" for s in range(5)}
        for s in range(5):
            filled = np.where(c[s] > 0, x[s], 0)
            assert np.allclose(np.array(told[f"s{s}"]), [from_rows(h, filled, c[s], w).ravel() for w in (c[s], np.ones(90))])
        sums = {r.sample: r for r in L.sums_by_sample(obs, atlas, F.sqrt("c"), "c > 0", block).collect()}
        one = from_rows(h, np.where(c[1] > 0, x[1], 0), c[1], c[1] * 1.0)
        assert np.allclose(sums["s1"].gram, one[:3, :3].ravel()) and np.allclose(sums["s1"].rhs, one[:3, 3]) and np.allclose([sums["s1"].xx, sums["s1"].n], [one[3, 3], one[4, 4]])
    assert L.moments_by_sample(obs, atlas.limit(0), [F.lit(1.0)]).count() == 0


def test_any_callable_solves(spark):
    h, x, c = problem(1, 20, 3)
    obs = spark.createDataFrame([("s", f"m{i:02d}", float(x[i]), int(c[i])) for i in range(20)], "sample string, marker string, x double, c long")
    atlas = spark.createDataFrame([(f"m{i:02d}", t, float(h[i, k])) for i in range(20) for k, t in enumerate("abc")], "marker string, cell_type string, h double")
    for name, run in (("nnls", S.solve_nnls), ("simplex", S.solve_simplex), ("iterative", S.solve_iterative)):
        told, by_rows = ({r.cell_type: r.w for r in S.solve(obs, atlas, how).collect()} for how in (name, run))
        assert all(abs(told[t] - by_rows[t]) < 1e-6 for t in "abc")


def test_p_values_in_catalyst(spark):
    from mixolve.functions.expressions import student_p
    from mixolve.operators.distinguish import student_tail

    rng = np.random.default_rng(0)
    t = np.concatenate([[0.0, 2.0, -2.228, 1.96, 12.706, 50.0, 1e-9, 700.0], rng.normal(0, 3, 40)])
    df = np.concatenate([[5.0, 10.0, 10.0, 1e6, 1.0, 30.0, 3.3, 2.0], rng.uniform(0.5, 5000, 40)])
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(t, df)] + [(None, 1.0), (1.0, None), (1.0, 0.0)], "t double, df double")
    got = [r.p for r in student_p(rows, "t", "df", "p").collect()]
    assert np.allclose(got[:-3], student_tail(t, df), atol=1e-9) and got[-3:] == [None] * 3


def test_group_weights_are_found_again(spark):
    """Truths solved with planted weights: the learned ones come near, the loss falls, training stops by its rule."""
    from mixolve.operators import regularised as V

    rng = np.random.default_rng(1)
    h, types = rng.uniform(0, 1, (30, 4)), list("abcd")
    atlas = spark.createDataFrame([(f"m{i}", t, float(h[i, k])) for i in range(30) for k, t in enumerate(types)], "marker string, cell_type string, h double")
    w = rng.dirichlet(np.ones(4), 64)
    rows = [(f"s{s}", f"m{i}", float(h[i] @ w[s]), 5) for s in range(64) for i in range(30)]
    obs = spark.createDataFrame(rows, "sample string, marker string, x double, c long")
    groups = [["a", "b"], ["c", "d"]]
    planted = V.GroupedModel(types, groups, np.array([2.0, -2.0]), penalty=2.0, rate=0.02)
    told = V.batches(obs, atlas)
    truth = V.predict(planted, told)
    assert truth.count() == 256
    train = V.batches(obs, atlas, truth)
    start = V.GroupedModel(types, groups, np.zeros(2), penalty=2.0, rate=0.02)
    found, history = V.fit(start, train, train, epochs=40, rate=0.25, patience=5, supervised=1e4)
    assert np.abs(found.weights - planted.weights).max() < 0.35 and found.weights[0] > 3 * found.weights[1]
    assert history[-1]["train_truth"] < 0.2 * history[0]["train_truth"] and min(x["val_loss"] for x in history) < history[0]["val_loss"]


def test_gradient_of_group_weights():
    from dataclasses import replace

    from mixolve.operators import regularised as V

    rng = np.random.default_rng(3)
    h, y = rng.uniform(0, 1, (20, 3)), rng.dirichlet(np.ones(3), 8)
    q, r = np.stack([h.T @ h] * 8), y @ h.T @ h + rng.normal(0, 0.05, (8, 3))
    batch = (q, r, ((y @ h.T) ** 2).sum(axis=1), 160.0, y)
    model = V.GroupedModel(list("abc"), [["a", "b"], ["c"]], np.array([0.3, -0.5]), penalty=1.0)
    p = V.solve_batch(model, q, r, 160.0, 0)
    fixed = V.gradient(model, batch, 0, through=False)
    for i in range(2):
        sides = [V.losses(replace(model, raw=model.raw + s * 1e-6 * (np.arange(2) == i)), p, *batch)[0] for s in (1, -1)]
        assert abs((sides[0] - sides[1]) / 2e-6 - fixed[i]) < 1e-6
    assert (fixed > 0).all() and np.isfinite(V.gradient(model, batch, 0)).all()
    assert V.variances(p[:1]).tolist() == [0, 0, 0]


def test_group_model_round_trip(spark, tmp_path):
    from mixolve.operators import regularised as V

    model = V.GroupedModel(list("abc"), [["a", "b"], ["c"]], np.array([0.3, -0.5]), penalty=0.7, steps=9)
    V.save(model, spark, str(tmp_path / "m"))
    back = V.load(spark, str(tmp_path / "m"))
    assert (back.types, back.groups, back.penalty, back.steps) == (model.types, model.groups, 0.7, 9) and np.array_equal(back.raw, model.raw)


@pytest.mark.parametrize("criterion", [None, "truth"])
def test_gradient_through_the_unrolled_steps(criterion):
    from mixolve.operators import network as N

    rng = np.random.default_rng(5)
    model = N.UnrolledSolver.untrained(rng.uniform(0, 1, (3, 6)), 7, 0.02)
    model.p = {k: v + rng.normal(0, 0.02, v.shape) * (0.1 if k == "steps" else 1) for k, v in model.p.items()}
    rows, truth = np.hstack([rng.uniform(0, 1, (4, 6)), rng.integers(1, 5, (4, 6))]), rng.dirichlet(np.ones(3), 4)
    how, weights = N.squared_error if criterion else None, rng.uniform(0.5, 2, 4)
    told, loss = model.gradient(rows, truth, how, weights)
    assert abs(loss - (model.loss(rows, truth, how) * weights).sum()) < 1e-12
    for name, value in model.p.items():
        flat, want = value.reshape(-1), told[name].reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            was, sides = flat[i], []
            for s in (1, -1):
                flat[i] = was + s * 1e-6
                sides.append((model.loss(rows, truth, how) * weights).sum())
            flat[i] = was
            assert abs((sides[0] - sides[1]) / 2e-6 - want[i]) < 1e-5 * max(1, abs(want[i])), name


def test_trained_unrolled_solver_beats_the_untrained_on_held_out_samples(spark, tmp_path):
    from mixolve.operators import network as N

    rng = np.random.default_rng(2)
    h, w = rng.uniform(0, 1, (3, 12)), rng.dirichlet(np.ones(3), 150)
    c = rng.integers(3, 30, (150, 12))
    x = rng.binomial(c, w @ h) / c
    rows = spark.createDataFrame([(f"s{i}", [*map(float, x[i]), *map(float, c[i])], [*map(float, w[i])]) for i in range(150)], "sample string, x array<double>, y array<double>")
    train, held = rows.where("cast(substr(sample, 2) as int) < 100"), rows.where("cast(substr(sample, 2) as int) >= 100")
    model = N.UnrolledSolver.untrained(h, 15, 2e-4)
    history = N.fit(model, train, validation=held, criterion=N.squared_error, epochs=25, rate=3e-3, decay=0.0)
    assert min(r["val_loss"] for r in history) < 0.6 * history[0]["val_loss"]
    N.save(model, spark, str(tmp_path / "m"), markers=[f"m{i}" for i in range(12)], types=list("abc"))
    back = N.load(spark, str(tmp_path / "m"))
    assert np.allclose(back.forward(x, c)[0], model.forward(x, c)[0])
    obs = spark.createDataFrame([("s", f"m{i}", float(x[0, i]), int(c[0, i])) for i in range(11, 1, -1)] + [("s", "other", 0.1, 4), ("s", "m1", None, 0)], "sample string, marker string, x double, c long")
    seen = np.arange(12) >= 2
    want = model.forward(x[:1] * seen, c[:1] * seen)[0][0]
    assert np.allclose([r.w for r in sorted(N.predict(back, obs).collect(), key=lambda r: r.cell_type)], want)
    with pytest.raises(ValueError):
        N.predict(back, obs, least=0.9).collect()
