"""Queries over the test tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixolve.functions import expressions as X
from mixolve.operators import atlas as A
from mixolve.operators import distinguish as D
from mixolve.operators import linear as L
from mixolve.operators import metrics as M
from mixolve.operators import network as N
from mixolve.operators import reads as R
from mixolve.operators import regularised as V
from mixolve.operators import simulate as G
from mixolve.operators import solvers as S
from mixolve.plans import tables as T
from mixolve.plans.tables import sql
from mixolve.sources import files
from mixolve.sources.files import written
from mixolve.streaming.score import score_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# Reads, counts, fractions, weights -------------------------------------------------------------


@query("uxm_counts", sql("reads uxm", "SELECT * FROM uxm"))
def uxm_counts(spark, d):
    return T.uxm(spark, d)


@query("marker_fraction", sql("reads uxm obs", "SELECT sample, marker, direction, round(x, 6) AS x, c FROM obs"))
def marker_fraction(spark, d):
    return rounded(T.obs(spark, d))


@query("complete_grid", sql("reads uxm obs", """SELECT s.sample, m.marker, m.direction, round(o.x, 6) AS x, coalesce(o.c, 0)::BIGINT AS c
FROM (SELECT DISTINCT sample FROM reads) s CROSS JOIN (SELECT DISTINCT marker, direction FROM reads) m LEFT JOIN obs o ON o.sample = s.sample AND o.marker = m.marker"""))
def complete_grid(spark, d):
    t = T.counted(spark, d)
    o = T.obs(spark, t)
    return rounded(R.complete(o, o, o))


@query("marker_weights", sql("reads uxm obs", """SELECT sample, marker, round(x, 6) AS x, c, round(c * coalesce(x, 0e0), 6) AS x_linear, round(sqrt(c) * coalesce(x, 0e0), 6) AS x_sqrt,
round(pow(c, 1.5e0) * coalesce(x, 0e0), 6) AS x_pow15, round(coalesce(x, 0e0) * ln(1 + CASE WHEN x IS NULL THEN 0 ELSE c END), 6) AS x_log1p FROM obs"""))
def marker_weights(spark, d):
    return rounded(R.weighted(T.obs(spark, d)))


@query("sample_matrix", sql("reads uxm obs", "SELECT marker, " + ", ".join(f"round(max(x) FILTER (sample = 's{i}'), 6) AS s{i}" for i in range(20)) + " FROM obs GROUP BY marker"))
def sample_matrix(spark, d):
    return rounded(T.obs(spark, d).groupBy("marker").pivot("sample", [f"s{i}" for i in range(20)]).agg(F.max("x")))


@query("coverage_hist", sql("reads uxm obs", "SELECT c, count(*) AS cells FROM obs GROUP BY c"))
def coverage_hist(spark, d):
    return R.coverage_histogram(T.obs(spark, d))


@query("summary_stats", sql("reads uxm obs", "SELECT count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS low, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS q2, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS high, max(c) + 1 AS bins FROM obs"))
def summary_stats(spark, d):
    q = lambda p: F.percentile("x", F.lit(p))
    return rounded(T.obs(spark, d).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("low"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.max("x").alias("high"), (F.max("c") + 1).alias("bins")))


@query("integrity_checks", sql("reads uxm obs prop", """SELECT * FROM (SELECT count(*) AS n_samples, count_if(abs(t - 1) > 1e-3)::BIGINT AS bad_sums FROM (SELECT sum(w) AS t FROM prop GROUP BY sample)),
(SELECT count(*) AS n_cells, count_if(c < 5)::BIGINT AS low_coverage FROM obs)"""))
def integrity_checks(spark, d):
    t = T.counted(spark, d)
    return R.integrity(T.prop(spark, t), T.obs(spark, t), least_coverage=5)


@query("sample_weight", sql("reads prop", "SELECT sample, round(raw / avg(raw) OVER (), 6) AS weight FROM (SELECT sample, least(pow(min(w) + 1e-6, -0.5e0), 10e0) AS raw FROM prop GROUP BY sample)"))
def sample_weight(spark, d):
    return rounded(R.sample_weights(T.prop(spark, d)))


@query("low_conc_augment", sql("reads prop", """SELECT p.sample, p.cell_type, round(p.w, 6) AS w, g.copy::INT AS copy FROM prop p
JOIN (SELECT sample, bool_or(w < 0.19e0) AS low FROM prop GROUP BY sample) l USING (sample) JOIN (SELECT unnest([0, 1, 2]) AS copy) g ON g.copy = 0 OR l.low"""))
def low_conc_augment(spark, d):
    return rounded(R.augment_low(T.prop(spark, d), 3, 0.19))


@query("missing_markers", sql("reads uxm", "SELECT DISTINCT marker, direction FROM reads WHERE marker NOT IN (SELECT marker FROM uxm WHERE sample = 's1' AND u + x + m >= 18)"))
def missing_markers(spark, d):
    t = T.counted(spark, d)
    u = T.uxm(spark, t)
    cache = u.where((F.col("sample") == "s1") & (R.coverage() >= 18))
    return R.missing_markers(u.select("marker", "direction").distinct(), cache, ["marker"])


@query("merge_cache", sql("reads uxm", """SELECT m.marker, m.direction, coalesce(a.u, b.u) AS u, coalesce(a.x, b.x) AS x, coalesce(a.m, b.m) AS m FROM (SELECT DISTINCT marker, direction FROM reads) m
LEFT JOIN (SELECT * FROM uxm WHERE sample = 's1' AND u + x + m >= 18) a ON a.marker = m.marker LEFT JOIN (SELECT * FROM uxm WHERE sample = 's2') b ON b.marker = m.marker"""))
def merge_cache(spark, d):
    t = T.counted(spark, d)
    u = T.uxm(spark, t)
    of = lambda s: u.where(F.col("sample") == s).select("marker", "u", "x", "m")
    return R.merge_cache(of("s1").where(R.coverage() >= 18), of("s2"), u.select("marker", "direction").distinct(), ["marker"])


@query("dup_coords", "SELECT p_brand, p_type, count(*) AS count FROM part GROUP BY ALL HAVING count(*) > 1")
def dup_coords(spark, d):
    return R.duplicates(T.load(spark, d, "part"), ["p_brand", "p_type"])


@query("atlas_semi", sql("reads atlas", "SELECT marker, cell_type, round(h, 6) AS h FROM atlas WHERE marker IN (SELECT p_brand || '|' || p_type FROM part WHERE p_size < 3)"))
def atlas_semi(spark, d):
    small = T.load(spark, d, "part").where("p_size < 3").select(F.concat("p_brand", F.lit("|"), "p_type").alias("marker"))
    return rounded(R.only_known(T.atlas(spark, d), small).select("marker", "cell_type", "h"))


_LEVEL = "(['0', '1e-04', '0.001', '0.005', '0.01', '0.05', '0.1'])[(event_id % 7 + 1)::INT]"


def _named(spark, d):
    """(event_id, name): a sample name for each event, its level by number and its replicate by user."""
    level = F.element_at(F.array(*map(F.lit, G.LEVEL_NAMES)), (F.col("event_id") % 7 + 1).cast("int"))
    return T.load(spark, d, "events").select("event_id", F.concat(F.lit("d"), level, F.lit("_"), (F.col("user_id") % 110).cast("string")).alias("name"))


@query("sample_grid", f"""WITH n AS (SELECT 'd' || {_LEVEL} || '_' || (user_id % 110) AS name FROM events)
SELECT 'd' || level || '_' || i AS name, level::DOUBLE AS dilution, i::INT AS replicate, count(n.name) AS n_results FROM (SELECT unnest(['0', '1e-04', '0.001', '0.005', '0.01', '0.05', '0.1']) AS level) CROSS JOIN range(1, 101) r(i) LEFT JOIN n ON n.name = 'd' || level || '_' || i GROUP BY level, i""")
def sample_grid(spark, d):
    """The samples of the dilution series, and how many results there are of each."""
    told = _named(spark, d).groupBy("name").agg(F.count("*").alias("n"))
    return G.sample_grid(spark).join(told, "name", "left").select("name", "dilution", "replicate", F.coalesce("n", F.lit(0)).alias("n_results"))


@query("parse_dilution", f"""WITH n AS (SELECT DISTINCT {_LEVEL} AS level, user_id % 110 AS i FROM events)
SELECT 'd' || level || '_' || i AS name, level::DOUBLE AS dilution, i::INT AS replicate, 'd' || level || '_' || i AS from_path, 'd' || level || '_' || i || '.mem.' || left(md5('/data/run.1'), 6) AS cache FROM n
UNION ALL SELECT DISTINCT event_type, NULL, NULL, event_type, event_type || '.mem.' || left(md5('/data/run.1'), 6) FROM events""")
def parse_dilution(spark, d):
    """Dilution, replicate and name read from sample names and paths; other names have none."""
    names = _named(spark, d).select("name").unionAll(T.load(spark, d, "events").select("event_type")).distinct()
    path = F.concat(F.lit("/data/run.1/"), "name", F.lit(".pat.gz"))
    return names.select("name", X.dilution_of("name").alias("dilution"), X.replicate_of("name").alias("replicate"), X.sample_name(path).alias("from_path"), X.cache_name(path).alias("cache"))


@query("activations", """WITH v AS (SELECT event_id, ts, value / 100e0 - 2 AS x, user_id % 100 AS g FROM events), t AS (SELECT g, max(x) AS top, sum(exp(x)) AS total FROM v GROUP BY g)
SELECT event_id, round(greatest(x, 0), 6) AS relu, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(ln(1 + exp(x)), 6) AS softplus, round(exp(x) / total, 6) AS softmax, round(least(greatest(x, -1), 1.5), 6) AS clipped, abs(x - round(x, 1)) <= 1e-8 + 0.01e0 * abs(round(x, 1)) AS near,
round_even(event_id / 2e0, 0) AS half, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM v JOIN t USING (g)""")
def activations(spark, d):
    """The scalar functions of the networks, and the softmax of each group of users."""
    v = T.load(spark, d, "events").select("event_id", "ts", (F.col("value") / 100 - 2).alias("x"), (F.col("user_id") % 100).alias("g"))
    told = X.softmax_within(v, ["g"], "x", "softmax")
    return rounded(told.select("event_id", X.relu("x").alias("relu"), X.sigmoid("x").alias("sigmoid"), X.softplus("x").alias("softplus"), "softmax", X.clip("x", -1.0, 1.5).alias("clipped"), X.close("x", F.round("x", 1), 0.01).alias("near"), F.bround(F.col("event_id") / 2).alias("half"), X.time_stamp(F.col("ts")).alias("stamp")))


# Atlas -------------------------------------------------------------------------------------------


@query("atlas_long", sql("reads atlas", "SELECT marker, cell_type, round(h, 6) AS h FROM atlas"))
def atlas_long(spark, d):
    types = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return rounded(A.to_long(A.to_wide(T.atlas(spark, d), ["marker"], types), ["marker"]))


@query("atlas_fill_mean", sql("reads atlas gaps", "SELECT marker, cell_type, round(coalesce(h, avg(h) OVER (PARTITION BY cell_type)), 6) AS h FROM gaps"))
def atlas_fill_mean(spark, d):
    return rounded(A.fill(T.atlas_gaps(spark, d), "mean").select("marker", "cell_type", "h"))


@query("atlas_kept_markers", sql("reads atlas gaps", "SELECT marker FROM gaps GROUP BY marker HAVING count(h) = count(*)"))
def atlas_kept_markers(spark, d):
    return A.full_markers(T.atlas_gaps(spark, d))


@query("atlas_drop_na", sql("reads atlas gaps", """SELECT marker, cell_type, round(h, 6) AS h FROM gaps WHERE marker IN (SELECT min(marker) FROM
(SELECT marker, list(h ORDER BY cell_type) AS p FROM gaps GROUP BY marker HAVING count(h) = count(*)) GROUP BY p)"""))
def atlas_drop_na(spark, d):
    return rounded(A.fill(T.atlas_gaps(spark, d), "drop").select("marker", "cell_type", "h"))


@query("atlas_distinct_profiles", sql("reads atlas", """SELECT marker, cell_type, r AS h FROM (SELECT *, round(h, 1) AS r FROM atlas) WHERE marker IN (SELECT min(marker) FROM
(SELECT marker, list(round(h, 1) ORDER BY cell_type) AS p FROM atlas GROUP BY marker) GROUP BY p)"""))
def atlas_distinct_profiles(spark, d):
    return A.distinct_profiles(T.atlas(spark, d).withColumn("h", F.round("h", 1))).select("marker", "cell_type", "h")


PAIR = "p AS (SELECT x.marker, x.cell_type AS a, y.cell_type AS b, x.h AS ha, y.h AS hb FROM embedded x JOIN embedded y USING (marker))"


@query("profile_corr", sql("embedded", f", {PAIR} SELECT a, b, round(corr(ha, hb), 6) AS corr FROM p GROUP BY a, b"))
def profile_corr(spark, d):
    return rounded(A.correlations(T.embedded_atlas(spark, d)))


@query("profile_distance", sql("embedded", f", {PAIR} SELECT a, b, round(sqrt(sum((ha - hb) * (ha - hb))), 6) AS distance FROM p GROUP BY a, b"))
def profile_distance(spark, d):
    return rounded(A.distances(T.embedded_atlas(spark, d)))


@query("corr_edges", sql("embedded", f", {PAIR} SELECT a, b, round(corr(ha, hb), 6) AS corr FROM p WHERE a < b GROUP BY a, b HAVING abs(corr(ha, hb)) > 0.1"))
def corr_edges(spark, d):
    return rounded(A.correlated_pairs(A.correlations(T.embedded_atlas(spark, d)), 0.1))


# Greedy groups in SQL: the types in turn; one that isn't taken yet takes all others that correlate with it and aren't taken.
@query("group_summary", sql("embedded", f""", {PAIR}, c AS (SELECT a, b, corr(ha, hb) AS corr FROM p GROUP BY a, b), t AS (SELECT list(DISTINCT cell_type ORDER BY cell_type) AS types FROM embedded),
near AS (SELECT map_from_entries(list((a, bs))) AS m FROM (SELECT a, list(b ORDER BY b) FILTER (a <> b AND abs(corr) > 0.1) AS bs FROM c GROUP BY a)),
it AS (SELECT 0 AS i, []::VARCHAR[] AS used, []::VARCHAR[][] AS groups UNION ALL SELECT i + 1, list_concat(used, new), CASE WHEN len(new) > 0 THEN list_append(groups, new) ELSE groups END FROM (SELECT i, used, groups,
    CASE WHEN list_contains(used, types[i + 1]) THEN []::VARCHAR[] ELSE list_concat([types[i + 1]], list_filter(coalesce(m[types[i + 1]], []), lambda o: NOT list_contains(used, o))) END AS new FROM it, t, near WHERE i < len(types))),
g AS (SELECT grp, unnest(groups[grp]) AS cell_type FROM (SELECT groups, unnest(range(1, len(groups) + 1)) AS grp FROM it, t WHERE i = len(types)))
SELECT x.grp::INT AS grp, any_value(n)::INT AS n_types, x.cell_type AS a, y.cell_type AS b, round(corr, 6) AS corr FROM g x JOIN g y USING (grp) JOIN c ON a = x.cell_type AND b = y.cell_type JOIN (SELECT grp, count(*) AS n FROM g GROUP BY grp) USING (grp) GROUP BY x.grp, x.cell_type, y.cell_type, corr""", recursive=True))
def group_summary(spark, d):
    """Correlations within each group of types that correlate by more than 0.1."""
    atlas = A.fixed(T.embedded_atlas(spark, d))
    corr = written(A.correlations(atlas), "correlations")
    return rounded(A.group_correlations(corr, A.group_table(spark, A.greedy_groups(corr, L.types_of(atlas), threshold=0.1))))


Z = "z AS (SELECT marker, cell_type, (h - avg(h) OVER (PARTITION BY marker)) / CASE WHEN stddev_pop(h) OVER (PARTITION BY marker) = 0 THEN 1 ELSE stddev_pop(h) OVER (PARTITION BY marker) END AS h FROM embedded)"


@query("pca_gram", sql("embedded", f", {Z} SELECT x.cell_type AS a, y.cell_type AS b, round(sum(x.h * y.h), 5) AS g FROM z x JOIN z y USING (marker) GROUP BY ALL"))
def pca_gram(spark, d):
    return rounded(A.gram_of_types(A.standardised(T.embedded_atlas(spark, d))), 5)


@query("marker_importance", sql("embedded", f", {PAIR}, g AS (SELECT marker, sum(abs(ha - hb)) AS gap FROM p WHERE a < b GROUP BY marker) SELECT marker, round(gap / sum(gap) OVER (), 6) AS importance FROM g"))
def marker_importance(spark, d):
    return rounded(A.importance(T.embedded_atlas(spark, d)))


LOO = "loo AS (SELECT marker, cell_type, h, (sum(h) OVER (PARTITION BY marker) - h) / (count(*) OVER (PARTITION BY marker) - 1) AS others FROM embedded)"
TOP = "SELECT cell_type, marker, row_number() OVER (PARTITION BY cell_type ORDER BY round(abs(h - others), 9) DESC, marker) AS rank FROM loo"


@query("leave_one_out", sql("embedded", f", {LOO} SELECT marker, cell_type, round(h, 6) AS h, round(others, 6) AS others FROM loo"))
def leave_one_out(spark, d):
    return rounded(A.leave_one_out(T.embedded_atlas(spark, d)))


def _tops(spark, d, k):
    gaps = A.leave_one_out(T.embedded_atlas(spark, d)).select("cell_type", "marker", F.round(F.abs(F.col("h") - F.col("others")), 9).alias("gap"))
    return A.top_markers(gaps, ["cell_type"], "gap", k)


@query("top_markers", sql("embedded", f", {LOO} SELECT cell_type, marker, rank::INT AS rank FROM ({TOP}) WHERE rank <= 10"))
def top_markers(spark, d):
    return _tops(spark, d, 10).select("cell_type", "marker", "rank")


@query("marker_overlap", sql("embedded", f""", {LOO}, t AS ({TOP}), w AS (SELECT cell_type, list(marker ORDER BY marker) AS wanted FROM t WHERE rank <= 10 GROUP BY cell_type),
s AS (SELECT cell_type, list(marker) AS seen FROM loo WHERE right(marker, 1) IN ('0', '3', '5', '8') GROUP BY cell_type)
SELECT cell_type, len(list_filter(wanted, lambda x: list_contains(seen, x)))::INT AS n_shared, array_to_string(list_filter(wanted, lambda x: NOT list_contains(seen, x)), ',') AS ignored FROM w JOIN s USING (cell_type)"""))
def marker_overlap(spark, d):
    seen = T.embedded_atlas(spark, d).where(F.right("marker", F.lit(1)).isin("0", "3", "5", "8"))
    return A.overlap(seen, _tops(spark, d, 10), ["cell_type"])


@query("detection_limits", sql("embedded", f""", {LOO}, x AS (SELECT cell_type, i AS step, pow(10e0, -4e0 + 3e0 * i / 49) AS conc, h, others FROM loo, range(50) r(i)), y AS (SELECT cell_type, step, conc, abs((1 - conc) * others + conc * h - others) AS delta FROM x)
SELECT cell_type, step::INT AS step, round(conc, 6) AS concentration, round(max(delta), 6) AS max_delta, round(avg(delta), 6) AS mean_delta, count_if(delta > 0.01)::BIGINT AS n_markers_above_threshold,
round(max(delta * sqrt(30e0)), 6) AS max_snr, round(avg(delta * sqrt(30e0)), 6) AS mean_snr FROM y GROUP BY cell_type, step, conc"""))
def detection_limits(spark, d):
    return rounded(A.detection_limits(T.embedded_atlas(spark, d), threshold=0.01))


# The p-value in SQL: the share of cos^(df - 1) beyond atan(t / sqrt(df)), by Simpson's rule of 4000 steps.
@query("welch_effect", """WITH m AS (SELECT user_id % 20 AS k, avg(value) FILTER (event_type = 'click') AS ma, avg(value) FILTER (event_type = 'view') AS mb, var_samp(value) FILTER (event_type = 'click') AS va, var_samp(value) FILTER (event_type = 'view') AS vb,
count(*) FILTER (event_type = 'click') AS na, count(*) FILTER (event_type = 'view') AS nb, stddev_pop(value) FILTER (event_type = 'view') AS sb FROM events GROUP BY 1),
w AS (SELECT k, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df, abs(ma - mb) / (sb + 1e-10) AS effect FROM m),
p AS (SELECT k, sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(cos(lo + (pi() / 2 - lo) * i / 4000), 0), df - 1)) * (pi() / 2 - lo) / 4000 / 3 / exp(0.5e0 * ln(pi()) + lgamma(df / 2) - lgamma((df + 1) / 2)) * 2 AS p
    FROM (SELECT k, df, atan(abs(t) / sqrt(df)) AS lo FROM w), range(0, 4001) r(i) GROUP BY k, df, lo)
SELECT k, round(t, 6) AS t, round(df, 4) AS df, round(p, 6) AS p, round(effect, 6) AS effect FROM w JOIN p USING (k)""")
def welch_effect(spark, d):
    e = T.load(spark, d, "events").withColumn("k", F.col("user_id") % 20)
    return rounded(A.welch(e, ["k"], "value", "event_type", "click", "view")).withColumn("df", F.round("df", 4))


@query("min_max_gaps", sql("embedded", f""", {LOO}, g AS (SELECT cell_type, marker, abs(h - others) AS gap FROM loo)
SELECT cell_type, marker, round((gap - min(gap) OVER w) / (max(gap) OVER w - min(gap) OVER w + 1e-10), 6) AS scaled FROM g WINDOW w AS (PARTITION BY cell_type)"""))
def min_max_gaps(spark, d):
    gaps = A.leave_one_out(T.embedded_atlas(spark, d)).select("cell_type", "marker", F.abs(F.col("h") - F.col("others")).alias("gap"))
    return rounded(A.min_max(gaps, ["cell_type"], "gap", "scaled").drop("gap"))


@query("mean_marker_corr", sql("embedded", """, c AS (SELECT x.marker, coalesce(abs(corr(x.h, y.h)), 0) AS corr FROM embedded x JOIN embedded y ON x.cell_type = y.cell_type AND x.marker <> y.marker GROUP BY x.marker, y.marker)
SELECT marker, round(avg(corr), 6) AS mean_corr FROM c GROUP BY marker"""))
def mean_marker_corr(spark, d):
    return rounded(D.mean_correlation(T.embedded_atlas(spark, d)))


# Linear algebra and solvers -------------------------------------------------------------------


GRAM = "g AS (SELECT o.sample, x.cell_type AS a, y.cell_type AS b, sum(o.c * o.c * x.h * y.h)::DOUBLE AS g FROM obs o JOIN atlas x USING (marker) JOIN atlas y USING (marker) WHERE o.c > 0 GROUP BY ALL)"
RHS = "r AS (SELECT sample, cell_type AS a, sum(c * c * o.x * h)::DOUBLE AS r FROM obs o JOIN atlas USING (marker) WHERE c > 0 GROUP BY ALL)"
MIX = "mix AS (SELECT sample, marker, sum(w * h) AS mix FROM prop JOIN atlas USING (cell_type) GROUP BY ALL)"


@query("gram", sql("reads uxm obs atlas", f", {GRAM} SELECT sample, a, b, round(g, 4) AS g FROM g WHERE a <= b"))
def gram(spark, d):
    t = T.counted(spark, d)
    return rounded(L.gram(T.obs(spark, t), T.atlas(spark, t), F.col("c").cast("double")), 4)


@query("gram_rhs", sql("reads uxm obs atlas", f", {RHS} SELECT sample, a, round(r, 4) AS r FROM r"))
def gram_rhs(spark, d):
    t = T.counted(spark, d)
    return rounded(L.gram_rhs(T.obs(spark, t), T.atlas(spark, t), F.col("c").cast("double")), 4)


@query("mixture_product", sql("reads atlas prop", f", {MIX} SELECT sample, marker, round(mix, 6) AS mix FROM mix"))
def mixture_product(spark, d):
    t = T.counted(spark, d)
    return rounded(L.mixture(T.prop(spark, t), T.atlas(spark, t)))


@query("weighted_sse", sql("reads uxm obs atlas prop", f", {MIX} SELECT sample, round(sum(c * (coalesce(x, 0) - mix) * (coalesce(x, 0) - mix)), 5) AS sse FROM obs JOIN mix USING (sample, marker) GROUP BY sample"))
def weighted_sse(spark, d):
    t = T.counted(spark, d)
    return rounded(L.weighted_sse(T.obs(spark, t), T.prop(spark, t), T.atlas(spark, t)), 5)


RCORR = f"{MIX}, q AS (SELECT sample, cell_type, abs(corr((coalesce(o.x, 0) - mix) * sqrt(c), h)) AS corr FROM obs o JOIN mix USING (sample, marker) JOIN atlas USING (marker) GROUP BY ALL)"


@query("residual_corr", sql("reads uxm obs atlas prop", f", {RCORR} SELECT sample, cell_type, round(corr, 6) AS corr FROM q"))
def residual_corr(spark, d):
    t = T.counted(spark, d)
    return rounded(L.residual_correlation(T.obs(spark, t), T.prop(spark, t), T.atlas(spark, t)))


@query("candidate_types", sql("reads uxm obs atlas prop", f""", {RCORR}, s AS (SELECT *, max(corr) OVER w AS top, row_number() OVER (PARTITION BY sample ORDER BY corr DESC, cell_type) AS rank FROM q WINDOW w AS (PARTITION BY sample)),
t AS (SELECT *, corr > top * 0.3e0 AS near, count_if(corr > top * 0.3e0) OVER (PARTITION BY sample) AS n_near FROM s)
SELECT sample, cell_type FROM t JOIN prop USING (sample, cell_type) WHERE near OR (n_near < 3 AND rank <= 3) OR w > 0.2e0"""))
def candidate_types(spark, d):
    t = T.counted(spark, d)
    prop = T.prop(spark, t)
    return L.candidates(L.residual_correlation(T.obs(spark, t), prop, T.atlas(spark, t)), prop, base=0.2)


def systems(spark, d, weight="linear"):
    t = T.counted(spark, d)
    return L.systems(T.obs(spark, t), T.atlas(spark, t), R.WEIGHTS[weight](F.col("c")))


ROWS_SYS = """rw AS (SELECT sample, a, list(g ORDER BY b) AS row FROM g GROUP BY sample, a),
sys AS (SELECT sample, list(a ORDER BY a) AS types, list(row ORDER BY a) AS gram, list(r ORDER BY a) AS rhs FROM rw JOIN r USING (sample, a) GROUP BY sample)"""
SYSTEM = f"{GRAM}, {RHS}, {ROWS_SYS}"


def GRAM_OF(power: float) -> str:
    return GRAM.replace("o.c * o.c *", f"pow(o.c, {power}) *")


def RHS_OF(power: float) -> str:
    return RHS.replace("c * c *", f"pow(c, {power}) *")


@query("solve_weighted_fixed", sql("reads uxm obs atlas", f""", {SYSTEM}, it AS (SELECT sample, 0 AS k, [1e0 / len(rhs) FOR x IN rhs] AS w FROM sys
UNION ALL SELECT it.sample, k + 1, list_transform(range(1, len(w) + 1), lambda i: w[i] * rhs[i] / (list_dot_product(gram[i], w) + 1e-10)) FROM it JOIN sys USING (sample) WHERE k < 60),
w AS (SELECT sample, types, [x / list_sum(w) FOR x IN w] AS w FROM it JOIN sys USING (sample) WHERE k = 60)
SELECT sample, unnest(types) AS cell_type, round(unnest(w), 6) AS w FROM w""", recursive=True))
def solve_weighted_fixed(spark, d):
    return rounded(L.unpacked(L.multiplicative_updates(systems(spark, d), 60)))


@query("solve_projected_fixed", sql("reads uxm obs atlas", f""", {SYSTEM.replace('o.c * o.c * x.h', 'x.h').replace('c * c * o.x', 'o.x')}, it AS (SELECT sample, 0 AS k, [0e0 FOR x IN rhs] AS w FROM sys
UNION ALL SELECT sample, k, [x / (list_sum(v) + 1e-8) FOR x IN v] FROM (SELECT it.sample, k + 1 AS k, list_transform(range(1, len(w) + 1), lambda i: greatest(w[i] - 0.01e0 * (list_dot_product(gram[i], w) - rhs[i]), 0e0)) AS v FROM it JOIN sys USING (sample) WHERE k < 40))
SELECT sample, unnest(types) AS cell_type, round(unnest(w), 6) AS w FROM it JOIN sys USING (sample) WHERE k = 40""", recursive=True))
def solve_projected_fixed(spark, d):
    return rounded(L.unpacked(L.projected_gradient(systems(spark, d, "none"), 40, 0.01)))


def _unweighted(text: str) -> str:
    return text.replace("o.c * o.c * x.h", "x.h").replace("c * c * o.x", "o.x")


def _leaves(name: str, system: str) -> str:
    """Every set of the five types with its exact weights and error (less a constant): elimination of the types in turn, each with and without."""
    return f"""{name}_it AS (SELECT sample, types, 1 AS j, []::INT[] AS free, list_append(list_transform(gram, lambda row, i: list_append(row, rhs[i])), list_append(rhs, 0e0)) AS a FROM {system}
UNION ALL SELECT sample, types, j + 1, CASE WHEN t THEN list_append(free, j) ELSE free END, CASE WHEN t THEN
    list_transform(a, lambda row, i: list_transform(row, lambda x, c: CASE WHEN i = j THEN a[j][c] / a[j][j] ELSE x - row[j] * a[j][c] / a[j][j] END)) ELSE a END FROM {name}_it, (VALUES (true), (false)) s(t) WHERE j <= 5),
{name} AS (SELECT sample, types, free, a[6][6] AS miss, list_transform(range(1, 6), lambda i: CASE WHEN list_contains(free, i) THEN a[i][6] ELSE 0e0 END) AS w FROM {name}_it WHERE j = 6)"""


_SHARED = "[x / CASE WHEN list_sum(w) > 0 THEN list_sum(w) ELSE 1 END FOR x IN w]"


def _nnls_sql(system: str) -> str:
    """Of all sets of types, that of the least error whose weights aren't negative."""
    return sql("reads uxm obs atlas", f""", {system}, {_leaves("leaf", "sys")}, best AS (SELECT sample, any_value(types) AS types, arg_min(w, miss) AS w FROM leaf WHERE list_min(w) >= 0 GROUP BY sample)
SELECT sample, unnest(types) AS cell_type, round(unnest({_SHARED}), 5) AS w FROM best""", recursive=True)


def _iterative_sql(power: float, rounds: int, base: float, least: int) -> str:
    """Rounds of candidate types by the residual's correlation; a round's best set is among those of candidates alone."""
    told = [f"{GRAM_OF(2 * power)}, {RHS_OF(2 * power)}, {ROWS_SYS}, {_leaves('leaf', 'sys')}", "n0 AS (SELECT sample, any_value(types) AS types, arg_min(w, miss) AS w FROM leaf WHERE list_min(w) >= 0 GROUP BY sample)"]
    error = "SELECT sample, sum(c * (coalesce(x, 0) - mix) * (coalesce(x, 0) - mix)) AS error FROM f{} GROUP BY sample"
    for k in range(rounds):
        fit = "f{} AS (SELECT o.sample, o.marker, any_value(o.x) AS x, any_value(o.c) AS c, sum(u.w * h) AS mix FROM obs o JOIN (SELECT sample, unnest(types) AS cell_type, unnest(w) AS w FROM n{}) u USING (sample) JOIN atlas a ON a.cell_type = u.cell_type AND a.marker = o.marker GROUP BY ALL)"
        told += [
            fit.format(k, k),
            f"c{k} AS (SELECT sample, cell_type, coalesce(abs(corr((coalesce(x, 0) - mix) * sqrt(c), h)), 0) AS corr FROM f{k} JOIN atlas USING (marker) GROUP BY ALL)",
            f"""k{k} AS (SELECT c.sample, list(i::INT) AS chosen FROM (SELECT *, max(corr) OVER s AS top, row_number() OVER (PARTITION BY sample ORDER BY corr DESC, cell_type) AS rank, count_if(corr > m * {0.3 + 0.1 * k}e0) OVER s AS near
FROM (SELECT *, max(corr) OVER (PARTITION BY sample) AS m FROM c{k}) WINDOW s AS (PARTITION BY sample)) c JOIN (SELECT sample, unnest(types) AS cell_type, unnest(w) AS w, unnest(range(1, 6)) AS i FROM n{k}) USING (sample, cell_type)
WHERE corr > top * {0.3 + 0.1 * k}e0 OR (near < {least} AND rank <= {least}) OR w > {base * (1 + k)}e0 GROUP BY c.sample)""",
            f"n{k + 1} AS (SELECT sample, any_value(types) AS types, arg_min(w, miss) AS w FROM leaf JOIN k{k} USING (sample) WHERE list_min(w) >= 0 AND len(list_filter(free, lambda i: NOT list_contains(chosen, i))) = 0 GROUP BY sample)",
        ]
    told.append(fit.format(rounds, rounds))
    each = " UNION ALL ".join(f"SELECT sample, types, w, error, {k} AS k FROM n{k} JOIN ({error.format(k)}) USING (sample)" for k in range(1, rounds + 1))
    return sql("reads uxm obs atlas", f""", {", ".join(told)}, best AS (SELECT sample, any_value(types) AS types, arg_min(w, round(error, 9) + k * 1e-12) AS w FROM ({each}) GROUP BY sample)
SELECT sample, unnest(types) AS cell_type, round(unnest({_SHARED}), 5) AS w FROM best""", recursive=True)


def _simplex_sql(system: str, ridge: float = 0.0) -> str:
    """Pairwise descent: each step moves what is best between two weights, pairs taken in turn."""
    return sql("reads uxm obs atlas", f""", {system}, pairs AS (SELECT list([i, j] ORDER BY i, j) AS ij FROM range(1, 6) a(i), range(1, 6) b(j) WHERE i < j),
rr AS (SELECT sample, types, rhs, list_transform(gram, lambda row, i: list_transform(row, lambda x, j: CASE WHEN i = j THEN x + {ridge}e0 ELSE x END)) AS gram FROM sys),
it AS (SELECT sample, 0 AS k, [1e0 / len(rhs) FOR x IN rhs] AS w FROM rr
UNION ALL SELECT sample, k + 1, list_transform(range(1, len(w) + 1), lambda n: CASE WHEN n = i THEN w[n] + t WHEN n = j THEN w[n] - t ELSE w[n] END) FROM (SELECT sample, k, w, i, j, greatest(-w[i], least(w[j],
((rhs[i] - list_dot_product(gram[i], w)) - (rhs[j] - list_dot_product(gram[j], w))) / (gram[i][i] + gram[j][j] - 2 * gram[i][j]))) AS t FROM
(SELECT it.sample, k, w, rhs, gram, ij[k % 10 + 1][1] AS i, ij[k % 10 + 1][2] AS j FROM it JOIN rr USING (sample), pairs WHERE k < 4000)))
SELECT sample, unnest(types) AS cell_type, round(unnest(w), 5) AS w FROM it JOIN rr USING (sample) WHERE k = 4000""", recursive=True)


def _solved(spark, d, solver, **options):
    t = T.counted(spark, d)
    return S.solve(T.obs(spark, t), T.atlas(spark, t), solver, **options)


for _name, _solver, _options, _sql in [
    ("solve_nnls", "nnls", {}, _nnls_sql(SYSTEM)), ("solve_nnls_unweighted", "nnls", {"weight": "none"}, _nnls_sql(_unweighted(SYSTEM))), ("solve_simplex", "simplex", {}, _simplex_sql(SYSTEM)),
    ("solve_ridge", "simplex", {"regularisation": "ridge", "alpha": 1.0}, _simplex_sql(SYSTEM, 1.0)), ("solve_lasso", "simplex", {"regularisation": "lasso", "alpha": 1.0}, _simplex_sql(SYSTEM)),
    ("solve_elasticnet", "simplex", {"regularisation": "elasticnet", "alpha": 1.0}, _simplex_sql(SYSTEM, 0.5)), ("solve_nmf", "simplex", {"weight": "linear"}, _simplex_sql(SYSTEM)),
    ("solve_iterative", "iterative", {}, _iterative_sql(0.5, 1, 1e-4, 3)),
    ("solve_iterative_pow15", "iterative", {"weight": "pow1.5", "rounds": 7, "base": 0.005, "least": 7, "one_round": False}, _iterative_sql(1.5, 7, 0.005, 7)),
    ("solve_own_weighting", "nnls", {"weight": lambda c: F.sqrt(c)}, _nnls_sql(SYSTEM.replace("o.c * o.c * x.h", "o.c * x.h").replace("c * c * o.x", "c * o.x"))),
]:
    QUERIES[_name] = lambda spark, d, s=_solver, o=_options, n=5 if _sql else 6: rounded(_solved(spark, d, s, **o), n)
    if _sql:
        ORACLES[_name] = _sql


_GROUPS = [["1-URGENT", "2-HIGH"], ["3-MEDIUM"], ["4-NOT SPECIFIED", "5-LOW"]]


@query("grouped_nmf")
def grouped_nmf(spark, d):
    """Groups by correlation, what is known first; forty steps, of which each is a pass over the samples."""
    t = T.counted(spark, d)
    atlas = T.atlas(spark, t)
    groups = A.greedy_groups(A.correlations(atlas), L.types_of(atlas), _GROUPS)
    return rounded(S.grouped(T.obs(spark, t), atlas, groups, steps=40)[0])


@query("solve_group_variance")
def solve_group_variance(spark, d):
    t = T.counted(spark, d)
    return rounded(V.solve_with_group_variance(T.obs(spark, t), T.atlas(spark, t), _GROUPS))


def _halves(spark, t):
    """(obs, prop) of every supplier as a sample: a fifth of them held out. t: counts of suppliers."""
    held = F.pmod(F.xxhash64("sample"), F.lit(5)) == 0
    obs, prop = written(T.obs(spark, t), "supplier-obs"), written(T.prop(spark, t), "supplier-prop")
    return (obs.where(~held), prop.where(~held)), (obs.where(held), prop.where(held))


def _group_model(spark, d):
    t = T.counted(spark, d, None)
    atlas = A.fixed(T.atlas(spark, t))
    (obs, prop), (held_obs, held_prop) = _halves(spark, t)
    train, held = V.batches(obs, atlas, prop), V.batches(held_obs, atlas, held_prop)
    return *V.fit(V.new_model(atlas, _GROUPS), train, held, epochs=12, rate=0.1, patience=4), held


@query("group_variance_fit")
def group_variance_fit(spark, d):
    """Weights of three groups learned on every supplier's sample but a fifth: losses and weights by epoch."""
    return spark.createDataFrame(_group_model(spark, d)[1], V.HISTORY)


@query("group_variance_score")
def group_variance_score(spark, d):
    """The held-out samples by the learned weights."""
    model, _, held = _group_model(spark, d)
    return V.predict(model, held)


@query("distinguishability")
def distinguishability(spark, d):
    return D.distinguishability(T.embedded_atlas(spark, d))


@query("mds")
def mds(spark, d):
    import numpy as np

    rows = {(r.a, r.b): r.distance for r in A.distances(T.embedded_atlas(spark, d)).collect()}  # K x K
    names = sorted({a for a, _ in rows})
    points, stress = S.multidimensional_scaling(np.array([[rows[a, b] for b in names] for a in names]))
    return spark.createDataFrame([(n, float(p[0]), float(p[1]), stress) for n, p in zip(names, points)], "cell_type string, x double, y double, stress double")


@query("pca")
def pca(spark, d):
    import numpy as np

    rows = {(r.a, r.b): r.g for r in A.gram_of_types(A.standardised(T.embedded_atlas(spark, d))).collect()}  # K x K
    names = sorted({a for a, _ in rows})
    scores = S.principal_components(np.array([[rows[a, b] for b in names] for a in names]), 2)
    return spark.createDataFrame([(n, float(p[0]), float(p[1])) for n, p in zip(names, scores)], "cell_type string, pc1 double, pc2 double")


# Metrics -------------------------------------------------------------------------------------------


@query("dilution_summary", sql("results", "SELECT dilution, round(avg(contribution), 6) AS mean, round(stddev_samp(contribution), 6) AS std, round(quantile_cont(contribution, 0.25), 6) AS q1, round(quantile_cont(contribution, 0.5), 6) AS q2, round(quantile_cont(contribution, 0.75), 6) AS q3 FROM results GROUP BY dilution"))
def dilution_summary(spark, d):
    return rounded(M.dilution_summary(T.results(spark, d)))


@query("dilution_metrics", sql("results", """, t AS (SELECT max(dilution) AS max_d, max(contribution) AS max_c FROM results), s AS (SELECT *, contribution / max_c * max_d AS scaled FROM results, t),
o AS (SELECT 1 - sum((dilution - scaled) * (dilution - scaled)) / (sum(dilution * dilution) - sum(dilution) * sum(dilution) / count(*)) AS r2 FROM s)
SELECT dilution, round(avg((contribution - dilution) * (contribution - dilution)), 6) AS mse, round(sqrt(avg((contribution - dilution) * (contribution - dilution))), 6) AS rmse,
CASE WHEN dilution = 0 THEN 'inf'::DOUBLE ELSE round(abs(dilution / any_value(max_d) - avg(contribution) / any_value(max_c)) / (dilution / any_value(max_d)), 6) END AS ratio_error,
CASE WHEN dilution = 0 THEN 'inf'::DOUBLE ELSE round(avg(abs(contribution - dilution) / dilution), 5) END AS relative_error, round(avg(contribution), 6) AS mean_pred, round(quantile_cont(contribution, 0.5), 6) AS median_pred,
round(stddev_pop(contribution), 6) AS std_pred, count(*) AS n_samples, round(any_value(r2), 6) AS overall_r2 FROM s, o GROUP BY dilution"""))
def dilution_metrics(spark, d):
    made = M.dilution_metrics(T.results(spark, d)).withColumn("relative_error", F.round("relative_error", 5))
    return made.select(*[F.when(F.col(c) == float("inf"), F.col(c)).otherwise(F.round(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in made.dtypes])


R2 = "1 - sum((truth - pred) * (truth - pred)) / (sum(truth * truth) - sum(truth) * sum(truth) / count(*))"
MOVES = "min(truth) < max(truth) AND min(pred) < max(pred)"


@query("celltype_metrics", sql("pairs", f"""SELECT cell_type, round(sqrt(avg((pred - truth) * (pred - truth))), 6) AS rmse, round(avg(abs(pred - truth)), 6) AS mae, CASE WHEN {MOVES} THEN round(corr(truth, pred), 6) ELSE 0 END AS correlation,
CASE WHEN {MOVES} THEN round({R2}, 6) ELSE 0 END AS r2 FROM pairs GROUP BY cell_type"""))
def celltype_metrics(spark, d):
    return rounded(M.cell_type_metrics(T.pairs(spark, d)))


@query("overall_metrics", sql("pairs", f""", c AS (SELECT CASE WHEN {MOVES} THEN corr(truth, pred) ELSE 0 END AS correlation, CASE WHEN {MOVES} THEN {R2} ELSE 0 END AS r2 FROM pairs GROUP BY cell_type)
SELECT * FROM (SELECT round(sqrt(avg((pred - truth) * (pred - truth))), 6) AS rmse, round(avg(abs(pred - truth)), 6) AS mae FROM pairs), (SELECT round(avg(r2), 6) AS mean_r2, round(avg(correlation), 6) AS mean_correlation FROM c)"""))
def overall_metrics(spark, d):
    return rounded(M.overall_metrics(T.pairs(spark, d)))


@query("eval_predictions", sql("pairs", f"""SELECT cell_type, round(avg(abs(pred - truth)), 6) AS mae, round(sqrt(avg((pred - truth) * (pred - truth))), 6) AS rmse, CASE WHEN min(truth) < max(truth) THEN round({R2}, 6) END AS r2,
CASE WHEN {MOVES} THEN round(corr(truth, pred), 6) END AS correlation, round(avg(truth), 6) AS mean_true, round(avg(pred), 6) AS mean_pred FROM pairs GROUP BY cell_type"""))
def eval_predictions(spark, d):
    return rounded(M.evaluate(T.pairs(spark, d)))


@query("range_metrics", sql("pairs ranges", f""", f AS (SELECT cell_type, range_name, avg(abs(pred - truth)) AS mae, sqrt(avg((pred - truth) * (pred - truth))) AS rmse, CASE WHEN min(truth) < max(truth) THEN {R2} END AS r2, avg(truth) AS mean_true, avg(pred) AS mean_pred,
quantile_cont(pred, 0.5) AS median_pred, count(*) AS n FROM pairs JOIN ranges ON truth >= lo AND truth < hi GROUP BY ALL)
SELECT g.cell_type, g.range_name, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(r2, 4) AS r2, round(mean_true, 6) AS mean_true, round(mean_pred, 6) AS mean_pred, round(median_pred, 6) AS median_pred, coalesce(n, 0) AS n_samples
FROM (SELECT * FROM (SELECT DISTINCT cell_type FROM pairs), (SELECT range_name FROM ranges)) g LEFT JOIN f USING (cell_type, range_name)"""))
def range_metrics(spark, d):
    return rounded(M.range_metrics(T.pairs(spark, d), M.ranges(spark))).withColumn("r2", F.round("r2", 4))


_P = [50, 90, 95, 99]


@query("range_metrics_uncertainty", sql("pairs ranges", """, e AS (SELECT *, abs(pred - truth) AS error FROM pairs JOIN ranges ON truth >= lo AND truth < hi), q AS (SELECT cell_type, range_name, """
+ ", ".join(f"quantile_cont(uncertainty, {p / 100}) AS u{p}, quantile_cont(error, {p / 100}) AS e{p}" for p in _P) + """ FROM e GROUP BY ALL)
SELECT cell_type, range_name, round(avg(error), 6) AS mae, round(avg(uncertainty), 6) AS mean_uncertainty, round(quantile_cont(uncertainty, 0.5), 6) AS median_uncertainty, round(stddev_pop(uncertainty), 6) AS uncertainty_std,
CASE WHEN min(uncertainty) < max(uncertainty) AND min(error) < max(error) THEN round(corr(uncertainty, error), 6) END AS uncertainty_corr, round(sum(truth * uncertainty) / sum(truth), 6) AS weighted_uncertainty, round(sum(truth * error) / sum(truth), 6) AS weighted_error, count(*) AS n_samples, """
+ ", ".join(f"round(avg((error <= u{p})::INT), 6) AS calibration_{p}, round(any_value(e{p}), 6) AS error_p{p}, round(any_value(u{p}), 6) AS uncertainty_p{p}" for p in _P) + " FROM e JOIN q USING (cell_type, range_name) GROUP BY cell_type, range_name"))
def range_metrics_uncertainty(spark, d):
    return rounded(M.range_metrics_uncertain(T.pairs(spark, d), M.ranges(spark)))


@query("error_analysis", sql("pairs error_ranges", """SELECT range_name, round(avg(pred - truth), 6) AS mean_error, round(quantile_cont(pred - truth, 0.5), 6) AS median_error, round(stddev_pop(pred - truth), 6) AS std_error, round(avg((pred > truth)::INT), 6) AS bias,
round(avg(abs(pred - truth)), 6) AS mae, round(avg(truth), 6) AS mean_true, round(avg(pred), 6) AS mean_pred, count(*) AS n_samples FROM pairs JOIN ranges ON truth >= lo AND truth < hi GROUP BY range_name"""))
def error_analysis(spark, d):
    return rounded(M.error_analysis(T.pairs(spark, d), M.ranges(spark, M.ERROR_RANGES)))


@query("detection_metrics", sql("pairs", """, r AS (SELECT cell_type, repeat, avg((pred - truth) * (pred - truth)) AS mse, avg(pred / truth) AS ratio_error, avg(abs(pred - truth) / truth) AS relative_error, avg(pred) AS mean_pred, stddev_pop(pred) AS std_pred FROM pairs GROUP BY ALL),
p AS (SELECT cell_type, CASE WHEN min(pred) < max(pred) THEN 1 - avg((pred - truth) * (pred - truth)) / var_pop(pred) ELSE 0 END AS r2 FROM pairs GROUP BY cell_type)
SELECT cell_type, round(avg(mse), 6) AS mse, round(avg(ratio_error), 3) AS ratio_error, round(avg(relative_error), 3) AS relative_error, round(avg(mean_pred), 6) AS mean_pred, round(avg(std_pred), 6) AS std_pred, round(any_value(r2), 6) AS r2 FROM r JOIN p USING (cell_type) GROUP BY cell_type"""))
def detection_metrics(spark, d):
    return rounded(M.detection_metrics(T.pairs(spark, d), zero_truth=True)).withColumn("ratio_error", F.round("ratio_error", 3)).withColumn("relative_error", F.round("relative_error", 3))


@query("uncertainty_by_epoch", sql("pairs", "SELECT epoch, cell_type, round(avg(uncertainty), 6) AS mean, round(quantile_cont(uncertainty, 0.5), 6) AS median, CASE WHEN min(truth) < max(truth) AND min(uncertainty) < max(uncertainty) THEN round(corr(uncertainty, truth), 6) END AS corr FROM pairs GROUP BY ALL"))
def uncertainty_by_epoch(spark, d):
    return rounded(M.uncertainty_by_epoch(T.pairs(spark, d)))


@query("best_worst3", sql("pairs", """, s AS (SELECT cell_type, avg((pred - truth) * (pred - truth)) AS mse FROM pairs GROUP BY cell_type), n AS (SELECT *, row_number() OVER (ORDER BY mse, cell_type) AS up, row_number() OVER (ORDER BY mse DESC, cell_type) AS down FROM s)
SELECT cell_type, round(mse, 6) AS mse, CASE WHEN up <= 3 THEN 'best' ELSE 'worst' END AS side FROM n WHERE up <= 3 OR down <= 3"""))
def best_worst3(spark, d):
    return rounded(M.best_and_worst(T.pairs(spark, d).groupBy("cell_type").agg(F.avg(M.err() * M.err()).alias("mse")), "mse", 3))


@query("topk_mae", sql("pairs", "SELECT cell_type, round(avg(abs(pred - truth)), 6) AS mae FROM pairs GROUP BY cell_type ORDER BY mae DESC, cell_type LIMIT 3"))
def topk_mae(spark, d):
    return rounded(T.pairs(spark, d).groupBy("cell_type").agg(F.avg(F.abs(M.err())).alias("mae"))).orderBy(F.desc("mae"), "cell_type").limit(3)


@query("sorted_types", sql("reads prop", "SELECT cell_type, round(avg(w), 6) AS mean_w FROM prop GROUP BY cell_type ORDER BY mean_w DESC, cell_type"))
def sorted_types(spark, d):
    return rounded(T.prop(spark, d).groupBy("cell_type").agg(F.avg("w").alias("mean_w"))).orderBy(F.desc("mean_w"), "cell_type")


@query("target_contribution", sql("reads prop", "SELECT sample, round(w, 6) AS w FROM prop WHERE cell_type = '2-HIGH'"))
def target_contribution(spark, d):
    return rounded(T.prop(spark, d).where(F.col("cell_type") == "2-HIGH").select("sample", "w"))


LOSSES = "losses AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS epoch, value AS loss FROM events)"


def _losses(spark, d):
    from pyspark.sql import Window as W

    return T.load(spark, d, "events").select(F.col("user_id").alias("run"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("epoch"), F.col("value").alias("loss"))


@query("early_stop", f"""WITH {LOSSES}, b AS (SELECT *, min(loss) OVER w AS best FROM losses WINDOW w AS (PARTITION BY run ORDER BY epoch)), i AS (SELECT *, coalesce(loss < lag(best) OVER (PARTITION BY run ORDER BY epoch), true) AS improved FROM b),
s AS (SELECT *, sum(improved::INT) OVER (PARTITION BY run ORDER BY epoch) AS streak FROM i), t AS (SELECT *, row_number() OVER (PARTITION BY run, streak ORDER BY epoch) - 1 AS waited FROM s)
SELECT run, epoch::INT AS epoch, loss, best, improved, waited::INT AS waited, max(waited) OVER (PARTITION BY run ORDER BY epoch) >= 10 AS stopped FROM t""")
def early_stop(spark, d):
    return M.early_stop(_losses(spark, d))


@query("running_loss", f"WITH {LOSSES}, m AS (SELECT run, max(epoch) AS n FROM losses GROUP BY run) SELECT run, round(sum(loss * 0.02e0 * pow(0.98e0, n - epoch)), 6) AS loss FROM losses JOIN m USING (run) GROUP BY run")
def running_loss(spark, d):
    ordered = _losses(spark, d).groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("epoch", "loss"))), lambda s: s["loss"]).alias("l"))
    return rounded(ordered.select("run", X.running_loss("l").alias("loss")))


@query("diffnnls_loss", sql("reads uxm obs atlas prop", f", {MIX} SELECT round(a.v, 6) AS recon_loss, round(b.v, 6) AS sparsity_loss, round(a.v + b.v, 6) AS loss FROM (SELECT avg((mix * c - o.x * c) * (mix * c - o.x * c)) AS v FROM obs o JOIN mix USING (sample, marker)) a, (SELECT 0.01e0 * avg(abs(w)) AS v FROM prop) b"))
def diffnnls_loss(spark, d):
    t = T.counted(spark, d)
    prop = T.prop(spark, t)
    recon = T.obs(spark, t).join(L.mixture(prop, T.atlas(spark, t)), ["sample", "marker"]).select("sample", "marker", (F.col("x") * F.col("c")).alias("target"), (F.col("mix") * F.col("c")).alias("recon"))
    return rounded(L.diffnnls_loss(prop, recon))


# Simulation and networks ------------------------------------------------------------------------

_TYPES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _made(spark, d):
    """(mixtures, atlas): as many mixtures as there are suppliers, of the atlas's types."""
    atlas = T.atlas(spark, T.counted(spark, d))
    return G.proportions(spark, T.load(spark, d, "supplier").count(), L.types_of(atlas)), atlas


@query("sim_proportions")
def sim_proportions(spark, d):
    """As many mixtures as there are suppliers, of the atlas's types."""
    return _made(spark, d)[0]


@query("sim_coverage")
def sim_coverage(spark, d):
    """Coverage of as many mixtures as there are suppliers."""
    return G.coverage(L.mixture(*_made(spark, d)))


@query("sim_methylation")
def sim_methylation(spark, d):
    return G.methylation(sim_coverage(spark, d))


@query("sim_dilution")
def sim_dilution(spark, d):
    w = G.dilutions(spark, _TYPES, "2-HIGH", T.LEVELS, 5)
    return G.methylation(G.negative_binomial_coverage(L.mixture(w, T.atlas(spark, d))))


@query("detection_sweep")
def detection_sweep(spark, d):
    """Every type at eight levels, five repeats of a hundred mixtures: simulated, solved and scored."""
    atlas = T.embedded_atlas(spark, d)
    w = G.dilution_sweep(spark, L.types_of(atlas))
    made = G.methylation(G.negative_binomial_coverage(L.mixture(w, atlas)))
    truth = w.where("cell_type = target").select("sample", "dilution", F.col("target").alias("cell_type"), "repeat", F.col("w").alias("truth"))
    told = S.solve(made, atlas, "nnls", weight="none").join(truth, ["sample", "cell_type"])
    return M.detection_metrics(told.select("dilution", "cell_type", "repeat", "truth", F.col("w").alias("pred")), ("dilution", "cell_type"))


_UNROLLED = {"steps": 60, "rate": 2e-5}


@query("diffnnls_score", sql("reads uxm obs atlas", f""", {SYSTEM.replace('o.c * o.c * x.h * y.h', 'o.c * (x.h + 0.5e0) * (y.h + 0.5e0)').replace('c * c * o.x * h', 'c * o.x * (h + 0.5e0)')}, it AS (SELECT sample, 0 AS k, [0e0 FOR x IN rhs] AS w FROM sys
UNION ALL SELECT sample, k, [x / (list_sum(v) + 1e-8) FOR x IN v] FROM (SELECT it.sample, k + 1 AS k, list_transform(range(1, len(w) + 1), lambda i: greatest(w[i] - {_UNROLLED['rate']} * (list_dot_product(gram[i], w) - rhs[i]), 0e0)) AS v FROM it JOIN sys USING (sample) WHERE k < {_UNROLLED['steps']}))
SELECT sample, unnest(types) AS cell_type, round(unnest(w), 6) AS w FROM it JOIN sys USING (sample) WHERE k = {_UNROLLED['steps']}""", recursive=True))
def diffnnls_score(spark, d):
    """The unrolled solver with equal steps, its transform and corrections as they are before training."""
    import numpy as np

    t = T.counted(spark, d)
    o, atlas = T.obs(spark, t), T.atlas(spark, t)
    told = A.profiles(atlas).orderBy("marker").collect()  # types x markers numbers
    model = N.UnrolledSolver(np.array([r["profile"] for r in told], float).T, np.full(_UNROLLED["steps"], _UNROLLED["rate"]))
    filled = R.complete(o, o, o).withColumn("x", F.coalesce("x", F.lit(0.0))).withColumn("c", F.col("c").cast("double"))
    return rounded(model.score(N.features(filled, log_coverage=False).join(N.features(filled.withColumn("x", F.col("c")), log_coverage=False).withColumnRenamed("x", "c"), "sample"), L.types_of(atlas)))


def _unrolled(spark, t, steps: int, rate: float):
    """An untrained unrolled solver of the atlas of counts t, its markers and types."""
    import numpy as np

    atlas = A.fixed(T.atlas(spark, t))
    told = A.profiles(atlas).orderBy("marker").collect()  # types x markers numbers
    return N.UnrolledSolver.untrained(np.array([r["profile"] for r in told], float).T, steps, rate), [r["marker"] for r in told], L.types_of(atlas)


@query("unrolled_fit")
def unrolled_fit(spark, d):
    """The unrolled solver trained on every supplier's sample but a fifth, by the error of proportions: losses by epoch, the first before any step."""
    t = T.counted(spark, d, None)
    model, markers, types = _unrolled(spark, t, 20, 2e-5)
    (obs, prop), (held_obs, held_prop) = _halves(spark, t)

    def rows(obs, prop):
        y = prop.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("cell_type", "w"))).alias("m"))
        told = N.aligned(obs, markers).join(y, "sample")
        return told.select("sample", F.concat("x", "c").alias("x"), F.array(*[F.coalesce(F.col("m")[t], F.lit(0.0)) for t in types]).alias("y"))

    history = N.fit(model, rows(obs, prop), validation=rows(held_obs, held_prop), criterion=N.squared_error, epochs=10, rate=3e-3, decay=0.0)
    return spark.createDataFrame(history, "epoch int, rate double, train_loss double, val_loss double")


@query("model_dilutions", sql("reads uxm obs atlas", f""", o2 AS (SELECT * FROM obs WHERE length(marker) % 5 <> 0), {SYSTEM.replace('obs o', 'o2 o').replace('o.c * o.c * x.h * y.h', 'o.c * (x.h + 0.5e0) * (y.h + 0.5e0)').replace('c * c * o.x * h', 'c * o.x * (h + 0.5e0)')}, it AS (SELECT sample, 0 AS k, [0e0 FOR x IN rhs] AS w FROM sys
UNION ALL SELECT sample, k, [x / (list_sum(v) + 1e-8) FOR x IN v] FROM (SELECT it.sample, k + 1 AS k, list_transform(range(1, len(w) + 1), lambda i: greatest(w[i] - {_UNROLLED['rate']} * (list_dot_product(gram[i], w) - rhs[i]), 0e0)) AS v FROM it JOIN sys USING (sample) WHERE k < {_UNROLLED['steps']})),
u AS (SELECT sample, unnest(types) AS cell_type, unnest(w) AS w FROM it JOIN sys USING (sample) WHERE k = {_UNROLLED['steps']}), f AS (SELECT 'd0.0' || (substr(sample, 2)::INT % 5) || '_' || substr(sample, 2) AS sample, ('0.0' || (substr(sample, 2)::INT % 5))::DOUBLE AS dilution, substr(sample, 2)::INT AS replicate, w FROM u WHERE cell_type = '2-HIGH')
SELECT sample, dilution, replicate, round(w, 6) AS contribution, dense_rank() OVER (ORDER BY dilution)::INT AS level FROM f ORDER BY dilution, replicate""", recursive=True))
def model_dilutions(spark, d):
    """A model file, loaded, meets samples that lack a fifth of its markers and have others; one type's contributions by dilution, levels numbered."""
    t = T.counted(spark, d)
    model, markers, types = _unrolled(spark, t, **_UNROLLED)
    path = files.shared_folder(spark, "model")
    N.save(model, spark, path, markers=markers, types=types)
    obs = T.obs(spark, t).where(F.length("marker") % 5 != 0).select("sample", "marker", "x", "c")
    strange = obs.withColumn("marker", F.concat(F.lit("other "), "marker"))
    n = F.substring("sample", 2, 9)
    found = N.predict(N.load(spark, path), obs.unionAll(strange)).withColumn("sample", F.concat(F.lit("d0.0"), (n.cast("int") % 5).cast("string"), F.lit("_"), n))
    told = M.dilution_frame(found, "2-HIGH")
    return rounded(told.join(M.dilution_levels(told), "dilution").select("sample", "dilution", "replicate", "contribution", "level").orderBy("dilution", "replicate"))


def _simulated(spark, d, n: int, seed: int):
    """(sample, x, y, weight) of simulated mixtures of the embedded atlas."""
    atlas = T.embedded_atlas(spark, d)
    w = G.proportions(spark, n, L.types_of(atlas), seed=seed)
    made = G.methylation(G.coverage(L.mixture(w, atlas), seed=seed), seed=seed)
    y = w.groupBy("sample").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_type", "w"))), lambda s: s["w"]).alias("y"))
    return N.features(made).join(y, "sample").join(R.sample_weights(w), "sample")


def _trained(spark, d):
    model = N.Perceptron(64, 10, 64)
    return model, N.fit(model, _simulated(spark, d, 2000, 1), validation=_simulated(spark, d, 400, 2), epochs=15, dropout=0.2)


@query("training_history")
def training_history(spark, d):
    """A perceptron trained on 2000 simulated mixtures and judged on 400: losses and rate by epoch."""
    return spark.createDataFrame(_trained(spark, d)[1], "epoch int, rate double, train_loss double, val_loss double")


@query("mlp_score")
def mlp_score(spark, d):
    """Trained on simulated mixtures, scoring others."""
    return _trained(spark, d)[0].score(_simulated(spark, d, 500, 3), L.types_of(T.embedded_atlas(spark, d)))


@query("predict_dilutions", sql("reads uxm obs atlas", f""", {SYSTEM}, it AS (SELECT sample, 0 AS k, [1e0 / len(rhs) FOR x IN rhs] AS w FROM sys
UNION ALL SELECT it.sample, k + 1, list_transform(range(1, len(w) + 1), lambda i: w[i] * rhs[i] / (list_dot_product(gram[i], w) + 1e-10)) FROM it JOIN sys USING (sample) WHERE k < 60),
w AS (SELECT sample, types, [x / list_sum(w) FOR x IN w] AS w FROM it JOIN sys USING (sample) WHERE k = 60), u AS (SELECT sample, unnest(types) AS cell_type, unnest(w) AS w FROM w)
SELECT 'd0.0' || (substr(sample, 2)::INT % 5) || '_' || substr(sample, 2) AS sample, ('0.0' || (substr(sample, 2)::INT % 5))::DOUBLE AS dilution, substr(sample, 2)::INT AS replicate, round(w, 6) AS contribution FROM u WHERE cell_type = '2-HIGH' ORDER BY dilution, replicate""", recursive=True))
def predict_dilutions(spark, d):
    """Estimates of samples with dilution names, one type, in order of dilution and replicate."""
    n = F.substring("sample", 2, 9)
    named = L.unpacked(L.multiplicative_updates(systems(spark, d), 60)).withColumn("sample", F.concat(F.lit("d0.0"), (n.cast("int") % 5).cast("string"), F.lit("_"), n))
    return rounded(M.dilution_frame(named, "2-HIGH"))


@query("fraction_hist", sql("reads uxm obs", "SELECT sample, least(floor(x * 50), 49)::INT AS bin, count(*) AS n, round(least(floor(x * 50), 49) * 0.02e0, 6) AS lo FROM obs WHERE x IS NOT NULL GROUP BY ALL"))
def fraction_hist(spark, d):
    return rounded(M.histogram(T.obs(spark, d), ["sample"], "x"))


@query("checked_predictions", sql("reads uxm obs atlas prop", f""", {SYSTEM}, {_leaves("leaf", "sys")}, best AS (SELECT sample, any_value(types) AS types, arg_min(w, miss) AS w FROM leaf WHERE list_min(w) >= 0 GROUP BY sample),
e AS (SELECT sample, unnest(types) AS cell_type, unnest({_SHARED}) AS pred FROM best) SELECT sample, cell_type, round(w, 5) AS truth, round(pred, 5) AS pred FROM prop JOIN e USING (sample, cell_type)""", recursive=True))
def checked_predictions(spark, d):
    """Truth beside estimates, after checks that the dataset is sound and that both have the same samples and types, each once."""
    t = T.counted(spark, d)
    prop, obs = written(T.prop(spark, t), "prop"), written(T.obs(spark, t), "obs")
    R.checked(prop, obs)
    return rounded(M.checked_pairs(prop, written(S.solve(obs, T.atlas(spark, t)), "estimates")), 5)


# Files ---------------------------------------------------------------------------------------------


def _sites(df):
    """Coordinates of a marker by a rule: chromosome, start, end, startCpG, endCpG."""
    at = F.crc32(F.col("marker").cast("binary")) % 100000
    told = [F.lit("chr1").alias("chr"), at.cast("int").alias("start"), (at + 50).cast("int").alias("end"), (at * 2).cast("int").alias("startCpG"), (at * 2 + 5).cast("int").alias("endCpG")]
    return df.select(*told, "*")


@query("atlas_file", sql("reads atlas", "SELECT marker, cell_type, round(h, 6) AS h FROM atlas"))
def atlas_file(spark, d):
    """A marker table written as TSV (eight columns of metadata, NA for NULL) and read back."""
    atlas = T.atlas(spark, d)
    wide = _sites(A.to_wide(atlas, ["marker", "direction"], L.types_of(atlas))).select("chr", "start", "end", "startCpG", "endCpG", F.lit("t").alias("target"), F.col("marker").alias("name"), "direction", *L.types_of(atlas))
    path = files.shared_folder(spark, "atlas")
    wide.write.csv(path, sep="\t", header=True, nullValue="NA")
    return rounded(files.read_atlas(spark, path).select("marker", "cell_type", "h"))


@query("count_files", sql("reads uxm", "SELECT sample, u::INT AS u, x::INT AS x, m::INT AS m, count(*) AS n FROM uxm GROUP BY ALL"))
def count_files(spark, d):
    """Count tables, a gzipped file a sample, found by name and read in one scan."""
    path = files.shared_folder(spark, "count-files")
    files.write_counts(_sites(T.uxm(spark, d)), path)
    found = files.some(files.find_samples(spark, path, "*.counts.gz"), "files").select("sample")
    rows = files.some(files.read_counts(spark, path), "counts").join(found, "sample", "left_semi")
    return rows.groupBy("sample", "u", "x", "m").agg(F.count("*").alias("n"))


@query("stale_samples", """WITH f AS (SELECT 's' || user_id % 50 AS sample, max(ts) AS modified FROM events WHERE event_type = 'click' GROUP BY 1), c AS (SELECT 's' || user_id % 50 AS sample, max(ts) AS cached_at FROM events WHERE event_type = 'view' AND user_id % 50 < 40 GROUP BY 1)
SELECT sample FROM f LEFT JOIN c USING (sample) WHERE cached_at IS NULL OR cached_at < modified""")
def stale_samples(spark, d):
    """Samples without a cache, or with one that is older than their file; times from events."""
    e = T.load(spark, d, "events").withColumn("sample", F.concat(F.lit("s"), (F.col("user_id") % 50).cast("string")))
    there = e.where("event_type = 'click'").groupBy("sample").agg(F.max("ts").alias("modified"))
    cached = e.where("event_type = 'view' AND user_id % 50 < 40").groupBy("sample").agg(F.max("ts").alias("cached_at"))
    return files.stale(there, cached).select("sample")


def _classified(spark, d):
    """(reads, markers): line items as reads with site ranges, and a hundred markers on them."""
    l = T.load(spark, d, "lineitem")  # noqa: E741
    first = F.col("l_orderkey") * 7 % 5000
    rows = l.select(F.concat(F.lit("s"), (F.col("l_suppkey") % 20).cast("string")).alias("sample"), F.lit("chr1").alias("chr"), first.alias("first"), (first + F.col("l_linenumber") + 2).alias("last"), (F.col("l_quantity").cast("int") % (F.col("l_linenumber") + 3)).alias("methylated"), (F.col("l_linenumber") + 3).alias("n_sites"))
    i = F.col("id")
    return rows, spark.range(100).select(F.lit("chr1").alias("chr"), F.concat(F.lit("m"), i.cast("string")).alias("marker"), F.when(i % 2 == 0, "U").otherwise("M").alias("direction"), (i * 50).alias("startCpG"), (i * 50 + 20).alias("endCpG"))


_JOINED = """WITH r AS (SELECT 's' || (l_suppkey % 20) AS sample, (l_orderkey * 7 % 5000) AS first, (l_orderkey * 7 % 5000) + l_linenumber + 2 AS last, l_quantity::INT % (l_linenumber + 3) AS methylated, l_linenumber + 3 AS n_sites FROM lineitem),
m AS (SELECT 'm' || i AS marker, i, CASE WHEN i % 2 = 0 THEN 'U' ELSE 'M' END AS direction, i * 50 AS a, i * 50 + 20 AS z FROM range(0, 100) t(i)), j AS (SELECT sample, marker, direction, methylated::DOUBLE / n_sites AS s FROM r JOIN m ON first < z AND last >= a WHERE n_sites >= 4),
c AS (SELECT sample, marker, direction, count_if(s <= 0.25)::BIGINT AS u, count_if(s > 0.25 AND s < 0.75)::BIGINT AS x, count_if(s >= 0.75)::BIGINT AS m FROM j GROUP BY ALL)"""


@query("incremental_cache", _JOINED + """ SELECT g.sample, k.marker, coalesce(u, 0) AS u, coalesce(x, 0) AS x, coalesce(c.m, 0) AS m, CASE WHEN k.i < 60 AND substr(g.sample, 2)::INT % 2 = 1 THEN 1 ELSE 2 END AS run
FROM (SELECT DISTINCT sample FROM r) g CROSS JOIN m k LEFT JOIN c ON c.sample = g.sample AND c.marker = k.marker""")
def incremental_cache(spark, d):
    """A cache brought up to date twice: the second time half of the samples have changed and forty markers are new, and only those are classed."""
    rows, markers = _classified(spark, d)
    path = files.shared_folder(spark, "cache")
    stamp = lambda year: F.lit(f"{year}-01-01 00:00:00").cast("timestamp")
    samples = rows.select("sample").distinct()
    files.refresh_cache(rows, markers.where("startCpG < 3000"), samples.withColumn("modified", stamp(2020)), path, stamp(2021))
    changed = F.when(F.substring("sample", 2, 9).cast("int") % 2 == 0, stamp(2022)).otherwise(stamp(2020))
    told = files.refresh_cache(rows, markers, samples.withColumn("modified", changed), path, stamp(2023))
    return told.select("sample", "marker", "u", "x", "m", F.when(F.col("cached_at") == stamp(2021), 1).otherwise(2).alias("run"))


@query("stream_scores", _nnls_sql(SYSTEM))
def stream_scores(spark, d):
    """Samples dropped as files in two turns and scored as they come: the batch answer, each sample once."""
    t = T.counted(spark, d)
    atlas, obs = A.fixed(T.atlas(spark, t)), written(T.obs(spark, t).select("sample", "marker", "x", "c"), "observations")
    folder = files.shared_folder(spark, "arriving")
    for turn in (0, 1):
        obs.where(F.substring("sample", 2, 9).cast("int") % 2 == turn).repartition(4, "sample").write.mode("append").parquet(f"{folder}/in")
        score_stream(spark, f"{folder}/in", atlas, f"{folder}/out", f"{folder}/state").awaitTermination()
    return rounded(spark.read.parquet(f"{folder}/out").select("sample", "cell_type", "w"), 5)


@query("solve_callable", _nnls_sql(SYSTEM))
def solve_callable(spark, d):
    """A solver that is handed in as a function of a sample's rows."""
    t = T.counted(spark, d)
    return rounded(S.solve(T.obs(spark, t), T.atlas(spark, t), S.solve_nnls), 5)


@query("tracked", "SELECT event_id % 5 AS step, event_type AS name, round(avg(value), 6) AS value FROM events GROUP BY ALL")
def tracked(spark, d):
    """Mean values of each kind of event, logged for five steps and read back."""
    path = files.shared_folder(spark, "tracker")
    told = T.load(spark, d, "events").groupBy((F.col("event_id") % 5).alias("step"), "event_type").agg(F.avg("value").alias("v")).collect()  # five steps of a few numbers
    for step in range(5):
        files.track(spark, path, step, {r["event_type"]: r["v"] for r in told if r["step"] == step})
    return rounded(spark.read.parquet(path))


@query("ordered_sites", sql("reads", "SELECT 'chr' || length(marker) % 3 AS chr, length(marker) AS start, length(marker) + 50 AS end, 1 AS startCpG, 2 AS endCpG, marker FROM (SELECT DISTINCT marker FROM reads) ORDER BY ALL"))
def ordered_sites(spark, d):
    """Markers in the order of made coordinates, after a seeded shuffle."""
    names = T.reads(spark, d).select("marker").distinct()
    size = F.length("marker")
    sites = names.select(F.concat(F.lit("chr"), (size % 3).cast("string")).alias("chr"), size.alias("start"), (size + 50).alias("end"), F.lit(1).alias("startCpG"), F.lit(2).alias("endCpG"), "marker")
    return R.in_site_order(R.shuffled(sites, "marker"))


@query("dataset_round_trip", sql("reads uxm obs", "SELECT 'train' AS split, sample, marker, round(x, 6) AS x, c FROM obs WHERE substr(sample, 2)::INT % 2 = 0"))
def dataset_round_trip(spark, d):
    """A dataset written by split; one split read back."""
    t = T.counted(spark, d)
    path = files.shared_folder(spark, "dataset")
    split = F.when(F.substring("sample", 2, 9).cast("int") % 2 == 0, "train").otherwise("val")
    files.write_dataset({"obs": T.obs(spark, t).withColumn("split", split), "prop": T.prop(spark, t).withColumn("split", split), "atlas": T.atlas(spark, t)}, path)
    return rounded(files.read_dataset(spark, path, "train")["obs"].select("split", "sample", "marker", "x", "c"))


@query("estimates_csv", sql("reads prop", "SELECT cell_type, sample, round(w, 6) AS w FROM prop"))
def estimates_csv(spark, d):
    """Estimates as a wide CSV, a column a sample, read back as rows."""
    t = T.counted(spark, d)
    path = files.shared_folder(spark, "estimates")
    wide = T.prop(spark, t).groupBy(F.col("cell_type").alias("CellType")).pivot("sample", [f"s{i}" for i in range(20)]).agg(F.first("w"))
    files.write_report(wide, path)
    return rounded(files.read_estimates_csv(spark, path).where("w IS NOT NULL"))


@query("reports", sql("results", "SELECT form, dilution, n FROM (SELECT dilution, count(*) AS n FROM results GROUP BY dilution), (SELECT unnest(['csv', 'json', 'parquet']) AS form)"))
def reports(spark, d):
    """A table written in each form of report and read back."""
    told = T.results(spark, d).groupBy("dilution").agg(F.count("*").alias("n"))
    out = None
    for form in ("csv", "json", "parquet"):
        path = files.shared_folder(spark, form)
        files.write_report(told, path, form)
        reader = spark.read.schema("dilution double, n long")
        read = (reader.csv(path, header=True) if form == "csv" else getattr(reader, form)(path)).select(F.lit(form).alias("form"), "dilution", "n")
        out = read if out is None else out.unionAll(read)
    return out


@query("read_classes", _JOINED + " SELECT * FROM c")
def read_classes(spark, d):
    """Reads met with markers by an interval join, classed by their methylated share."""
    return R.classify(*_classified(spark, d))


@query("resample")
def resample(spark, d):
    return R.weighted_resample(R.sample_weights(T.prop(spark, d)), "sample", "weight", 200)
