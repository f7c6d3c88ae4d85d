"""From reads to counts, fractions, coverage and weights. Long tables: uxm(sample, marker, direction, u, x, m)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mixolve.functions.expressions import ratio

COORDS = ["chr", "start", "end", "startCpG", "endCpG"]


def classify(reads: DataFrame, markers: DataFrame, *, least_sites: int = 4, low: float = 0.25, high: float = 0.75, bin_sites: int = 1000) -> DataFrame:
    """U, X and M counts per sample and marker from reads with site ranges.

    reads: sample, chr, first, last (sites, inclusive), methylated, n_sites; markers: chr, marker,
    direction, startCpG, endCpG (half open). An interval join on site bins (no cross join); a read
    counts if it has least_sites sites. Its methylated share decides: at most `low` U, at least `high` M, else X.
    """
    binned = reads.where(F.col("n_sites") >= least_sites).withColumn("bin", F.explode(F.sequence(F.floor(F.col("first") / bin_sites), F.floor(F.col("last") / bin_sites))))
    wanted = markers.withColumn("bin", F.explode(F.sequence(F.floor(F.col("startCpG") / bin_sites), F.floor((F.col("endCpG") - 1) / bin_sites))))
    once = F.col("bin") == F.greatest(F.floor(F.col("first") / bin_sites), F.floor(F.col("startCpG") / bin_sites))
    met = binned.join(wanted, ["chr", "bin"]).where((F.col("first") < F.col("endCpG")) & (F.col("last") >= F.col("startCpG")) & once)
    share = F.col("methylated") / F.col("n_sites")
    kind = F.when(share <= low, "U").when(share >= high, "M").otherwise("X")
    return count_kinds(met.withColumn("kind", kind))


def count_kinds(reads: DataFrame, kind: str = "kind", *more: str) -> DataFrame:
    """U, X and M counts per sample and marker, and by more columns if asked."""
    count = lambda k: F.count_if(F.col(kind) == k)
    return reads.groupBy("sample", "marker", "direction", *more).agg(count("U").alias("u"), count("X").alias("x"), count("M").alias("m"))


def coverage() -> Column:
    return F.col("u") + F.col("x") + F.col("m")


def fraction() -> Column:
    """Share of reads in the marker's direction; NULL without reads."""
    return ratio(F.when(F.col("direction") == "U", F.col("u")).otherwise(F.col("m")), coverage())


def observed(uxm: DataFrame) -> DataFrame:
    """obs(sample, marker, direction, x, c): x is NULL where c is 0."""
    return uxm.select("sample", "marker", "direction", fraction().alias("x"), coverage().alias("c"))


def complete(obs: DataFrame, samples: DataFrame, markers: DataFrame) -> DataFrame:
    """obs with a row for every sample and marker, coverage 0 where there was none (a stated grid)."""
    grid = samples.select("sample").distinct().join(markers.select("marker", "direction").distinct())
    return grid.join(obs.drop("direction"), ["sample", "marker"], "left").withColumn("c", F.coalesce("c", F.lit(0)))


WEIGHTS = {
    "none": lambda c: F.lit(1.0),
    "linear": lambda c: c.cast("double"),
    "sqrt": lambda c: F.sqrt(c),
    "pow1.5": lambda c: F.pow(c, F.lit(1.5)),
}


def weighted(obs: DataFrame) -> DataFrame:
    """The coverage weightings of x side by side; without coverage x counts as 0."""
    x, c = F.coalesce("x", F.lit(0.0)), F.col("c")
    told = [(w(c) * x).alias(f"x_{name.replace('.', '')}") for name, w in WEIGHTS.items() if name != "none"]
    return obs.select("sample", "marker", "x", "c", *told, (x * F.log1p(F.when(F.col("x").isNull(), 0).otherwise(c).cast("double"))).alias("x_log1p"))


def missing_markers(markers: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Markers that the cache has no counts for."""
    return markers.join(cache.where(F.col("u").isNotNull()), keys, "left_anti")


def merge_cache(cache: DataFrame, fresh: DataFrame, markers: DataFrame, keys: list[str]) -> DataFrame:
    """All markers with counts, from the cache or computed anew; cached rows win, keys may be NULL."""
    both = cache.withColumn("_age", F.lit(0)).unionByName(fresh.withColumn("_age", F.lit(1)))
    first = both.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("_age", "u", "x", "m"))).where("_n = 1").drop("_age", "_n")
    values = [c for c in first.columns if c not in keys]
    named = first.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *values)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return markers.join(named, same, "left").select(*markers.columns, *values)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def only_known(rows: DataFrame, names: DataFrame, key: str = "marker") -> DataFrame:
    return rows.join(names.select(key).distinct(), key, "left_semi")


def sample_weights(prop: DataFrame, cap: float = 10.0) -> DataFrame:
    """Weight of each sample by its smallest proportion: 1/sqrt, capped, mean 1."""
    least = prop.groupBy("sample").agg(F.min("w").alias("least"))
    raw = least.select("sample", F.least(F.pow(F.col("least") + 1e-6, F.lit(-0.5)), F.lit(cap)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(mean).select("sample", ratio("raw", "mean").alias("weight"))


def augment_low(prop: DataFrame, factor: int = 3, below: float = 0.01) -> DataFrame:
    """Samples with any proportion under `below` appear `factor` times (copy 0 is the original)."""
    low = prop.groupBy("sample").agg(F.bool_or(F.col("w") < below).alias("low"))
    copies = F.explode(F.sequence(F.lit(0), F.when(F.col("low"), factor - 1).otherwise(0)))
    return prop.join(low.select("sample", copies.alias("copy")), "sample")


def integrity(prop: DataFrame, obs: DataFrame, tolerance: float = 1e-3, least_coverage: int = 0) -> DataFrame:
    """Counts of violations: proportions that don't sum to 1, coverage below the least."""
    sums = prop.groupBy("sample").agg(F.sum("w").alias("total")).agg(F.count("*").alias("n_samples"), F.count_if(F.abs(F.col("total") - 1) > tolerance).alias("bad_sums"))
    return sums.join(obs.agg(F.count("*").alias("n_cells"), F.count_if(F.col("c") < least_coverage).alias("low_coverage")))


def checked(prop: DataFrame, obs: DataFrame, tolerance: float = 1e-3) -> None:
    """Raises if there are no samples, proportions don't sum to 1, or a value with coverage is missing."""
    told = integrity(prop, obs, tolerance).first()
    missing = obs.where(F.col("x").isNull() != (F.col("c") == 0)).limit(1).count()
    if not told["n_samples"] or not told["n_cells"] or told["bad_sums"] or missing:
        raise ValueError(f"bad dataset: {told.asDict()}, {'values and coverage disagree' if missing else 'values are complete'}")


def in_site_order(rows: DataFrame) -> DataFrame:
    """Rows sorted by their coordinates."""
    return rows.orderBy(*COORDS)


def shuffled(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in a random order that depends on key and seed alone."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key)


def coverage_histogram(obs: DataFrame) -> DataFrame:
    return obs.groupBy("c").agg(F.count("*").alias("cells"))


def weighted_resample(rows: DataFrame, key: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """n draws with replacement, in proportion to weight: cumulative weights by partial sums, draws ranged over them.

    Slices of the key order get their cumulative start from a small table, so no task holds all
    rows. A draw finds its slice in that table and its row by an equi-join on the slice. Draws come
    from a hash of their number, so partitions don't matter.
    """
    slices = rows.select(key, F.col(weight).cast("double").alias("wt"), F.pmod(F.xxhash64(key), F.lit(64)).alias("slice"))
    ends = slices.groupBy("slice").agg(F.sum("wt").alias("total")).withColumn("hi", F.sum("total").over(W.orderBy("slice"))).withColumn("lo", F.col("hi") - F.col("total"))
    inside = slices.withColumn("up", F.sum("wt").over(W.partitionBy("slice").orderBy(key))).withColumn("down", F.col("up") - F.col("wt"))
    total = ends.agg(F.max("hi").alias("all"))
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), ((F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)).alias("r")).join(F.broadcast(total)).withColumn("at", F.col("r") * F.col("all")).join(F.broadcast(ends), (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    placed = draws.select("draw", "slice", (F.col("at") - F.col("lo")).alias("off"))
    return placed.join(inside, "slice").where((F.col("off") >= F.col("down")) & (F.col("off") < F.col("up"))).select("draw", key)
