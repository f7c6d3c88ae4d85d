"""Reference atlas analytics. Long table: atlas(marker, direction, cell_type, h)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mixolve.functions.expressions import correlation, logspace, ratio, student_p


def to_long(wide: DataFrame, ids: list[str], name: str = "cell_type", value: str = "h") -> DataFrame:
    """A column for each cell type to a row for each; text that is no number becomes NULL."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")  # noqa: E731  names may hold dots
    cells = [F.struct(F.lit(c).alias(name), quoted(c).cast("string").try_cast("double").alias(value)) for c in wide.columns if c not in ids]
    rows = wide.select(*map(quoted, ids), F.explode(F.array(*cells)).alias("_cell"))
    return rows.select(*map(quoted, ids), f"_cell.{name}", F.nanvl(f"_cell.{value}", F.lit(None)).alias(value))


def to_wide(long: DataFrame, ids: list[str], types: list[str]) -> DataFrame:
    return long.groupBy(*ids).pivot("cell_type", types).agg(F.first("h"))


def fixed(atlas: DataFrame) -> DataFrame:
    """The atlas written once to the shared folder, so that what reads it several times doesn't make it anew."""
    from mixolve.sources.files import written

    return written(atlas.select("marker", "cell_type", "h"), "atlas")


def full_markers(atlas: DataFrame) -> DataFrame:
    """Markers without a NULL in any cell type."""
    return atlas.groupBy("marker").agg(F.count_if(F.col("h").isNull()).alias("n")).where("n = 0").select("marker")


def some_markers(atlas: DataFrame) -> DataFrame:
    """The atlas of markers without a NULL; raises where there is none."""
    kept = full_markers(atlas)
    if not kept.limit(1).count():
        raise ValueError("no marker has a value in every cell type")
    return atlas.join(kept, "marker", "left_semi")


def fill(atlas: DataFrame, policy: str) -> DataFrame:
    """NULL profiles: `drop` their markers and repeated profiles, `mean_cell_type` fills and drops repeats, `mean` fills."""
    if policy == "drop":
        return distinct_profiles(atlas.join(full_markers(atlas), "marker", "left_semi"))
    if policy not in ("mean_cell_type", "mean"):
        raise ValueError(f"unknown policy {policy!r}; one of drop, mean_cell_type, mean")
    means = atlas.groupBy(F.col("cell_type").alias("_type")).agg(F.avg("h").alias("_mean"))  # partial sums: no task holds a type's markers
    filled = atlas.join(means, F.col("cell_type") == F.col("_type")).withColumn("h", F.coalesce("h", "_mean")).drop("_type", "_mean")
    return distinct_profiles(filled) if policy == "mean_cell_type" else filled


def profiles(atlas: DataFrame) -> DataFrame:
    """(marker, profile): the values of all cell types, ordered by type."""
    return atlas.groupBy("marker").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_type", "h"))), lambda s: s["h"]).alias("profile"))


def distinct_profiles(atlas: DataFrame) -> DataFrame:
    """Of markers with the same values in all types, the first by name."""
    first = profiles(atlas).groupBy("profile").agg(F.min("marker").alias("marker")).select("marker")
    return atlas.join(first, "marker", "left_semi")


def pairs(atlas: DataFrame, *, ordered: bool = False) -> DataFrame:
    """The self-join of types on marker: (marker, a, b, ha, hb), a before b unless `ordered`."""
    left = atlas.select("marker", F.col("cell_type").alias("a"), F.col("h").alias("ha"))
    right = atlas.select("marker", F.col("cell_type").alias("b"), F.col("h").alias("hb"))
    both = left.join(right, "marker")
    return both if ordered else both.where("a < b")


def correlations(atlas: DataFrame) -> DataFrame:
    return pairs(atlas, ordered=True).groupBy("a", "b").agg(correlation("ha", "hb").alias("corr"))


def distances(atlas: DataFrame) -> DataFrame:
    gap = F.col("ha") - F.col("hb")
    return pairs(atlas, ordered=True).groupBy("a", "b").agg(F.sqrt(F.sum(gap * gap)).alias("distance"))


def standardised(atlas: DataFrame) -> DataFrame:
    """z-score of each marker over the types (population deviation; a constant marker is only centred)."""
    w = W.partitionBy("marker")
    sd = F.stddev_pop("h").over(w)
    flat = F.min("h").over(w) == F.max("h").over(w)
    return atlas.select("marker", "cell_type", ((F.col("h") - F.avg("h").over(w)) / F.when(flat | (sd == 0), 1.0).otherwise(sd)).alias("h"))


def gram_of_types(z: DataFrame) -> DataFrame:
    """Inner products of types over markers, the K x K matrix from which principal components follow."""
    return pairs(z, ordered=True).groupBy("a", "b").agg(F.sum(F.col("ha") * F.col("hb")).alias("g"))


def importance(atlas: DataFrame) -> DataFrame:
    """Share of each marker in the summed differences between types."""
    gaps = pairs(atlas).groupBy("marker").agg(F.sum(F.abs(F.col("ha") - F.col("hb"))).alias("gap"))
    return gaps.join(gaps.agg(F.sum("gap").alias("total"))).select("marker", ratio("gap", "total").alias("importance"))


def leave_one_out(atlas: DataFrame) -> DataFrame:
    """(marker, cell_type, h, others): the mean profile of the other types."""
    w = W.partitionBy("marker")
    return atlas.select("marker", "cell_type", "h", ratio(F.sum("h").over(w) - F.col("h"), (F.count("h").over(w) - 1).cast("double")).alias("others"))


def detection_limits(atlas: DataFrame, *, coverage: int = 30, low: float = -4, high: float = -1, steps: int = 50, threshold: float = 0.1) -> DataFrame:
    """What a type's presence at each concentration changes, over markers: sizes of change and signal to noise."""
    mixed = leave_one_out(atlas).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    mixed = mixed.withColumn("concentration", F.element_at(logspace(low, high, steps), F.col("step") + 1))
    delta = F.abs((1 - F.col("concentration")) * F.col("others") + F.col("concentration") * F.col("h") - F.col("others"))
    d = mixed.select("cell_type", "step", "concentration", delta.alias("delta"))
    root = float(coverage) ** 0.5
    return d.groupBy("cell_type", "step", "concentration").agg(
        F.max("delta").alias("max_delta"), F.avg("delta").alias("mean_delta"), F.count_if(F.col("delta") > threshold).alias("n_markers_above_threshold"),
        F.max(F.col("delta") * root).alias("max_snr"), F.avg(F.col("delta") * root).alias("mean_snr"),
    )


def group_table(spark: SparkSession, groups: list[list[str]]) -> DataFrame:
    """(grp, cell_type) of groups numbered from 1: a row a type."""
    return spark.createDataFrame([(i + 1, t) for i, g in enumerate(groups) for t in g], "grp int, cell_type string")


def group_correlations(corr: DataFrame, groups: DataFrame) -> DataFrame:
    """(grp, n_types, a, b, corr): the correlations of all pairs of a group's types, each type with itself included."""
    sized = groups.join(groups.groupBy("grp").agg(F.count("*").cast("int").alias("n_types")), "grp")
    one, two = sized.withColumnRenamed("cell_type", "a"), groups.select(F.col("grp").alias("_grp"), F.col("cell_type").alias("b"))
    return corr.join(one, "a").join(two, "b").where(F.col("grp") == F.col("_grp")).select("grp", "n_types", "a", "b", "corr")


def min_max(rows: DataFrame, keys: list[str], value: str, out: str, least: float = 1e-10) -> DataFrame:
    """rows with `out`: value scaled to [0, 1] by its least and largest within the keys; 0 where they are equal, NULL stays NULL."""
    w = W.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return rows.withColumn(out, (F.col(value) - low) / (high - low + least))


def top_markers(scores: DataFrame, keys: list[str], score: str, k: int = 10) -> DataFrame:
    """The k best markers of each key, ties by name."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(score), "marker"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def overlap(attended: DataFrame, discriminative: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: discriminative markers that are attended to, and those that are ignored."""
    lists = lambda df, name: df.groupBy(*keys).agg(F.array_sort(F.collect_set("marker")).alias(name))
    both = lists(discriminative, "wanted").join(lists(attended, "seen"), keys, "left")
    seen = F.coalesce("seen", F.array().cast("array<string>"))
    return both.select(*keys, F.size(F.array_intersect("wanted", seen)).alias("n_shared"), F.array_join(F.array_sort(F.array_except("wanted", seen)), ",").alias("ignored"))


def correlated_pairs(corr: DataFrame, threshold: float = 0.3) -> DataFrame:
    return corr.where((F.col("a") < F.col("b")) & (F.abs("corr") > threshold))


def greedy_groups(corr: DataFrame, types: list[str], known: list[list[str]] = (), threshold: float = 0.3) -> list[list[str]]:
    """Known groups first; then each unused type takes all unused types that correlate with it. corr has K*K rows."""
    near = {(r["a"], r["b"]) for r in corr.where((F.col("a") != F.col("b")) & (F.abs("corr") > threshold)).select("a", "b").collect()}  # K*K at most
    out, used = [], set()
    for group in known:
        there = [t for t in types if t in group]
        if len(there) > 1:
            out.append(there)
            used |= set(there)
    for t in types:
        if t not in used:
            group = [t] + [o for o in types if o not in used and o != t and (t, o) in near]
            out.append(group)
            used |= set(group)
    return out


def welch(rows: DataFrame, keys: list[str], value: str, group: str, a: str, b: str) -> DataFrame:
    """Welch's t, its degrees of freedom, two-sided p-value and the effect size |mean difference| / (population deviation of b + 1e-10) per key."""
    side = lambda g, f, n: f(F.when(F.col(group) == g, F.col(value))).alias(n)
    moments = rows.groupBy(*keys).agg(
        side(a, F.avg, "ma"), side(b, F.avg, "mb"), side(a, F.var_samp, "va"), side(b, F.var_samp, "vb"), side(a, F.count, "na"), side(b, F.count, "nb"), side(b, F.stddev_pop, "sb"),
    )
    error = F.when((F.col("na") > 1) & (F.col("nb") > 1), F.col("va") / F.col("na") + F.col("vb") / F.col("nb"))
    terms = F.when((F.col("na") > 1) & (F.col("nb") > 1), F.pow(F.col("va") / F.col("na"), 2) / (F.col("na") - 1) + F.pow(F.col("vb") / F.col("nb"), 2) / (F.col("nb") - 1))
    told = moments.select(*keys, ratio(F.col("ma") - F.col("mb"), F.sqrt(error)).alias("t"), ratio(error * error, terms).alias("df"), (F.abs(F.col("ma") - F.col("mb")) / (F.col("sb") + 1e-10)).alias("effect"))
    return student_p(told, "t", "df", "p")
