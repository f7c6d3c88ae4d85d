"""What must not grow with a group, a sample or the number of tables read: counted on plans, or run at a size that shows it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from mixolve.functions import expressions as X
from mixolve.plans.queries import ORACLES, QUERIES
from test_queries import DATA, rows


@pytest.fixture
def duck():
    return duckdb.connect()


def against_sql(spark, duck, folder, name, **views):
    """The query over tables in a folder has the rows of its SQL."""
    for table, text in views.items():
        duck.sql(f"COPY ({text}) TO '{folder}/{table}.parquet'")
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got, want = QUERIES[name](spark, str(folder)), duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_softmax_of_an_array_is_linear_in_its_length(spark):
    """With the total worked out for each element, this would take hours."""
    a = F.transform(F.sequence(F.lit(1), F.lit(20000)), lambda i: F.log(i.cast("double")))
    s = spark.range(1).select(X.softmax(a).alias("s"), X.normalised(F.transform(a, F.exp)).alias("n")).first()
    total = 20000 * 20001 / 2
    for told in (s.s, s.n):
        assert abs(told[0] - 1 / total) < 1e-12 and abs(told[-1] - 20000 / total) < 1e-12


def test_activations_of_large_groups_are_those_of_the_sql(spark, duck, tmp_path):
    """Groups of 300 rows and more; no row is collected into an array."""
    events = f"SELECT e.* REPLACE (event_id + i * 1000 AS event_id, CASE WHEN event_id % 3 = 0 THEN user_id ELSE 7 END AS user_id) FROM '{DATA}/events.parquet' e, range(3) r(i)"
    against_sql(spark, duck, tmp_path, "activations", events=events)
    assert "collect_list" not in QUERIES["activations"](spark, str(tmp_path))._jdf.queryExecution().toString()


def test_detection_metrics_are_infinite_at_a_truth_of_zero_as_in_the_sql(spark, duck, tmp_path):
    events = f"SELECT e.* REPLACE (CASE WHEN event_id % 97 = 1 THEN 0 ELSE value END AS value) FROM '{DATA}/events.parquet' e WHERE event_id % 13 <> 0"
    against_sql(spark, duck, tmp_path, "detection_metrics", events=events)
    told = {r.cell_type: r for r in QUERIES["detection_metrics"](spark, str(tmp_path)).collect()}
    assert told["click"].ratio_error == told["click"].relative_error == float("inf")
    assert told["signup"].ratio_error < 1


def test_quotients_are_those_of_doubles(spark):
    given = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (3.0, 2.0), (-3.0, -2.0), (None, 0.0), (1.0, None), (0.0, 0.0)], "a double, b double")
    told = [r[0] for r in given.select(X.quotient("a", "b")).collect()]
    assert told[:6] == [float("inf"), float("-inf"), 1.5, 1.5, None, None] and told[6] != told[6]


def test_training_works_on_bounded_slices_of_what_arrow_brings(spark):
    """One task gets all 5000 rows in one batch; no step sees more than a slice of it."""
    from mixolve.operators import network as N

    def criterion(y, truth):
        assert len(y) <= 1024
        return ((y - truth) ** 2).sum(axis=1), 2 * (y - truth)

    made = spark.range(5000, numPartitions=1).select(F.col("id").cast("string").alias("sample"), F.array(F.rand(1), F.rand(2)).alias("x"), F.array(F.lit(0.3), F.lit(0.7)).alias("y"))
    model = N.Perceptron(2, 2, 4)
    history = N.fit(model, made, validation=made, criterion=criterion, epochs=2)
    assert len(history) == 2 and all(h["val_loss"] >= 0 for h in history)
    assert model.score(made, ["a", "b"]).count() == 10000


def test_mixtures_meet_profiles_without_a_shuffle_of_pairs(spark):
    """Samples are gathered by sample alone; a type that a marker lacks, or without a value, adds nothing, and a pair without a type in common is no row."""
    from mixolve.operators import linear as L

    prop = spark.createDataFrame([("s1", "a", 0.25), ("s1", "b", 0.75), ("s2", "b", 0.5), ("s2", "c", 0.5), ("s3", "d", 1.0), ("s4", "a", None)], "sample string, cell_type string, w double")
    atlas = spark.createDataFrame([("m1", "a", 1.0), ("m1", "b", 0.5), ("m2", "b", None), ("m2", "c", 0.25), ("m3", "b", None), ("m1", "c", 0.1)], "marker string, cell_type string, h double")
    got = L.mixture(prop, atlas)
    want = prop.join(atlas, "cell_type").groupBy("sample", "marker").agg(F.sum(F.col("w") * F.col("h")).alias("mix"))
    plain = lambda df: sorted((r.sample, r.marker, None if r.mix is None else round(r.mix, 12)) for r in df.collect())
    assert plain(got) == plain(want) and len(plain(got)) == 7
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sample" in plan and "hashpartitioning(cell_type" not in plan and "marker" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)


OF_READS = {
    "F3": "grouped_nmf", "F4": "model_dilutions", "F5": "diffnnls_score", "F6": "sim_coverage", "F7": "sim_methylation", "F8": "group_variance_fit", "F10": "predict_dilutions", "F11": "atlas_file",
    "F12": "checked_predictions", "F13": "dataset_round_trip", "F15": "residual_corr", "F16": "diffnnls_loss", "F17": "weighted_sse", "F18": "candidate_types",
    "same step": "solve_group_variance", "same step too": "complete_grid",
}


@pytest.mark.parametrize("name", OF_READS.values())
def test_reads_are_joined_once(spark, name, monkeypatch):
    """However many tables a query makes of the reads: they are counted once, and what follows reads the counts."""
    from mixolve.plans import tables as T

    joined, reads = [], T.reads
    monkeypatch.setattr(T, "reads", lambda *how: joined.append(how) or reads(*how))
    made = QUERIES[name](spark, DATA)
    assert len(joined) == 1 and "lineitem" not in made._jdf.queryExecution().toString()


def test_tables_of_counts_are_those_of_the_folder(spark):
    from mixolve.plans import tables as T

    for samples in (20, None):
        counts = T.counted(spark, DATA, samples)
        told = lambda df: sorted(map(tuple, df.collect()))
        assert told(T.uxm(spark, counts)) == told(T.uxm(spark, DATA, samples))
        assert told(T.atlas(spark, counts)) == told(T.atlas(spark, DATA))
        direct = T.reads(spark, DATA, samples).groupBy("sample", "cell_type").count().collect()
        totals = {}
        for r in direct:
            totals[r[0]] = totals.get(r[0], 0) + r[2]
        assert {(r[0], r[1]): r[2] for r in T.prop(spark, counts).collect()} == {(a, b): n / totals[a] for a, b, n in direct}
