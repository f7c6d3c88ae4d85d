"""Stand-ins for reads, atlas, observations and estimates made from the test tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixolve.operators import reads as R
from mixolve.sources.files import written


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str, samples: int | None = 20) -> DataFrame:
    """One row a read: line items, marker from the part, type from the order, U/X/M from the return flag; suppliers fall into `samples`, or are each one.

    Orders come first, parts last: names of markers are the widest column, so they take part in no more shuffles than they must.
    """
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    parts = load(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("|"), "p_type").alias("marker"), F.when(F.length("p_type") % 2 == 0, "U").otherwise("M").alias("direction"))
    orders = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("cell_type"))
    of = F.col("l_suppkey") % samples if samples else F.col("l_suppkey")
    kind = F.when(F.col("l_returnflag") == "N", "U").when(F.col("l_returnflag") == "R", "X").otherwise("M")
    typed = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_partkey", of.alias("n"), kind.alias("kind"), "cell_type")
    return typed.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.concat(F.lit("s"), F.col("n").cast("string")).alias("sample"), "marker", "direction", "cell_type", "kind")


def counted(spark: SparkSession, sf_dir: str, samples: int | None = 20) -> DataFrame:
    """(sample, marker, direction, cell_type, u, x, m), written: reads are joined once, and uxm, obs, atlas and prop are sums of this.

    The functions below take it in place of the folder. Of suppliers as samples few reads are alike, so these are dealt
    by sample before they are counted, which later sums by sample profit from.
    """
    rows = reads(spark, sf_dir, samples)
    return written(R.count_kinds(rows if samples else rows.repartition("sample"), "kind", "cell_type"), "counted")


def _sums(counts: DataFrame, *keys: str) -> DataFrame:
    return counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("u", "x", "m")])


def uxm(spark: SparkSession, source: str | DataFrame, samples: int | None = 20) -> DataFrame:
    return R.count_kinds(reads(spark, source, samples)) if isinstance(source, str) else _sums(source, "sample", "marker", "direction")


def obs(spark: SparkSession, source: str | DataFrame, samples: int | None = 20) -> DataFrame:
    return R.observed(uxm(spark, source, samples))


def atlas(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Directed fraction of each marker and type; cells without reads are 0."""
    per = _sums(counted(spark, source) if isinstance(source, str) else source, "cell_type", "marker", "direction")
    grid = per.select("marker", "direction").distinct().join(per.select("cell_type").distinct())
    known = per.select(F.col("marker").alias("m"), F.col("cell_type").alias("ct"), R.fraction().alias("f"))
    return grid.join(known, (F.col("marker") == F.col("m")) & (F.col("cell_type") == F.col("ct")), "left").select("marker", "direction", "cell_type", F.coalesce("f", F.lit(0.0)).alias("h"))


def atlas_gaps(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """The atlas with NULLs by a stated rule, and every value rounded to a tenth so that profiles repeat."""
    gap = (F.length("marker") + F.length("cell_type")) % 7 == 0
    return atlas(spark, source).withColumn("h", F.when(~gap, F.round("h", 1)))


def prop(spark: SparkSession, source: str | DataFrame, samples: int | None = 20) -> DataFrame:
    """Proportions of types among a sample's reads."""
    counts = counted(spark, source, samples) if isinstance(source, str) else source
    n = counts.groupBy("sample", "cell_type").agg(F.sum(R.coverage()).alias("n"))
    total = n.groupBy("sample").agg(F.sum("n").alias("total"))
    return n.join(total, "sample").select("sample", "cell_type", (F.col("n") / F.col("total")).alias("w"))


LEVELS = [0.0, 1e-4, 1e-3, 5e-3, 1e-2, 5e-2, 1e-1]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dilution results from events."""
    levels = F.array(*[F.lit(x) for x in LEVELS])
    e = load(spark, sf_dir, "events")
    return e.select(F.col("event_id"), F.element_at(levels, (F.col("event_id") % 7 + 1).cast("int")).alias("dilution"), (F.col("value") / 1000).alias("contribution"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth, prediction and uncertainty from events: truth spans all ranges, one type has constant truth."""
    e = load(spark, sf_dir, "events")
    flat = F.when(F.col("event_type") == "signup", F.lit(0.25)).otherwise(F.col("value") * F.col("value") / 240200.0)
    return e.select(
        F.col("event_id"), F.col("event_type").alias("cell_type"), (F.col("user_id") % 5).alias("repeat"), (F.col("event_id") % 10).alias("epoch"), flat.alias("truth"),
        (F.col("value") / 1000 + (F.col("event_id") % 13) / 500.0).alias("pred"), ((F.col("event_id") % 17) / 170.0 + F.col("value") / 5000).alias("uncertainty"),
    )


def embedded_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label centroids of the embeddings as types, dimensions as markers, mapped to [0, 1]."""
    e = load(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    name = F.concat(F.lit("m"), F.lpad(F.col("i").cast("string"), 2, "0"))
    return e.groupBy(name.alias("marker"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("cell_type")).agg((F.avg((F.col("v").cast("double") + 1) / 2)).alias("h"))


#: The same tables as DuckDB common table expressions.
SQL = {
    "reads": """reads AS (SELECT 's' || (l_suppkey % 20) AS sample, p_brand || '|' || p_type AS marker, CASE WHEN length(p_type) % 2 = 0 THEN 'U' ELSE 'M' END AS direction,
        o_orderpriority AS cell_type, CASE l_returnflag WHEN 'N' THEN 'U' WHEN 'R' THEN 'X' ELSE 'M' END AS kind
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)""",
    "uxm": "uxm AS (SELECT sample, marker, direction, count_if(kind = 'U')::BIGINT AS u, count_if(kind = 'X')::BIGINT AS x, count_if(kind = 'M')::BIGINT AS m FROM reads GROUP BY ALL)",
    "obs": "obs AS (SELECT sample, marker, direction, CASE WHEN u + x + m > 0 THEN (CASE direction WHEN 'U' THEN u ELSE m END)::DOUBLE / (u + x + m) END AS x, u + x + m AS c FROM uxm)",
    "atlas": """atlas AS (SELECT g.marker, g.direction, g.cell_type, coalesce(f.h, 0e0) AS h FROM (SELECT * FROM (SELECT DISTINCT marker, direction FROM reads), (SELECT DISTINCT cell_type FROM reads)) g
        LEFT JOIN (SELECT marker, cell_type, count_if(kind = direction)::DOUBLE / count(*) AS h FROM reads GROUP BY ALL) f USING (marker, cell_type))""",
    "gaps": "gaps AS (SELECT marker, direction, cell_type, CASE WHEN (length(marker) + length(cell_type)) % 7 <> 0 THEN round(h, 1) END AS h FROM atlas)",
    "prop": "prop AS (SELECT sample, cell_type, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY sample) AS w FROM reads GROUP BY sample, cell_type)",
    "results": "results AS (SELECT event_id, ([0e0, 1e-4, 1e-3, 5e-3, 1e-2, 5e-2, 1e-1])[(event_id % 7 + 1)::INT] AS dilution, value / 1000e0 AS contribution FROM events)",
    "pairs": """pairs AS (SELECT event_id, event_type AS cell_type, user_id % 5 AS repeat, event_id % 10 AS epoch, CASE WHEN event_type = 'signup' THEN 0.25e0 ELSE value * value / 240200e0 END AS truth,
        value / 1000e0 + (event_id % 13) / 500e0 AS pred, (event_id % 17) / 170e0 + value / 5000e0 AS uncertainty FROM events)""",
    "embedded": """embedded AS (SELECT 'm' || lpad((i - 1)::VARCHAR, 2, '0') AS marker, 't' || label AS cell_type, avg((embedding[i]::DOUBLE + 1) / 2) AS h
        FROM embeddings, range(1, 65) r(i) GROUP BY i, label)""",
    "ranges": "ranges AS (SELECT * FROM (VALUES (0e0, 1e-4, 'Ultra-low'), (1e-4, 1e-3, 'Very-low'), (1e-3, 1e-2, 'Low'), (1e-2, 1e-1, 'Medium'), (1e-1, 1e0, 'High')) t(lo, hi, range_name))",
    "error_ranges": "ranges AS (SELECT * FROM (VALUES (0e0, 1e-4, '0-1e-4'), (1e-4, 1e-3, '1e-4-1e-3'), (1e-3, 5e-3, '1e-3-5e-3'), (5e-3, 1e-2, '5e-3-1e-2'), (1e-2, 5e-2, '1e-2-5e-2'), (5e-2, 1e0, '5e-2-1')) t(lo, hi, range_name))",
}


def sql(tables: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(SQL[t] for t in tables.split()) + ("\n" if tables else "") + body
