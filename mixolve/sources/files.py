"""Readers and writers: marker tables, count tables, datasets, caches and reports."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixolve.functions.expressions import sample_name
from mixolve.operators.atlas import to_long

COUNTS = T.StructType([T.StructField("chr", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("start", "end", "startCpG", "endCpG", "u", "x", "m")]])


def read_atlas_wide(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated with a header; NA is NULL."""
    return spark.read.csv(path, sep="\t", header=True, nullValue="NA")


def read_atlas(spark: SparkSession, path: str, metadata: int = 8) -> DataFrame:
    """The long atlas of a marker table whose first `metadata` columns describe the marker."""
    wide = read_atlas_wide(spark, path)
    return to_long(wide, wide.columns[:metadata]).withColumnRenamed("name", "marker")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Count tables without a header, # comments, also gzipped; `sample` comes from the file's name. Bad rows fail the read."""
    rows = spark.read.schema(COUNTS).csv(path, sep="\t", comment="#", mode="FAILFAST")
    return rows.select("*", sample_name(F.col("_metadata.file_path")).alias("sample"))


def some(rows: DataFrame, what: str) -> DataFrame:
    """rows, or an error that names what is missing."""
    if not rows.limit(1).count():
        raise ValueError(f"no {what}")
    return rows


def find_samples(spark: SparkSession, folder: str, pattern: str = "*.pat.gz") -> DataFrame:
    """(path, sample, modified) of a folder's sample files, once each, in order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("modificationTime").alias("modified"))
    return files.distinct().select("path", sample_name("path").alias("sample"), "modified").orderBy("path")


def stale(samples: DataFrame, cached: DataFrame, force: bool = False) -> DataFrame:
    """Samples whose cache is missing or older than their file. cached(sample, cached_at)."""
    both = samples.join(cached, "sample", "left")
    return both if force else both.where(F.col("cached_at").isNull() | (F.col("cached_at") < F.col("modified")))


#: Columns of a cache, a folder a sample.
CACHE = "marker string, u long, x long, m long, cached_at timestamp, sample string"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache at a path; empty where there is none."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def write_cache(counts: DataFrame, path: str) -> None:
    """Replace the folders of the samples in counts (columns of CACHE), all at the end of the job, so that a retry writes the same; samples without any reads are left out."""
    some = counts.groupBy("sample").agg(F.sum(F.col("u") + F.col("x") + F.col("m")).alias("n")).where("n > 0")
    kept = counts.join(some, "sample", "left_semi").select("marker", "u", "x", "m", "cached_at", "sample")
    kept.repartition("sample").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sample").parquet(path)


def refresh_cache(reads: DataFrame, markers: DataFrame, samples: DataFrame, path: str, now: Column | None = None, **how) -> DataFrame:
    """Bring the cache at a path up to date and return it.

    reads, markers and `how` as classify() takes them; samples(sample, modified): each sample's file and when it changed. A row of the cache
    counts if it is no older than its sample's file. What lacks for a sample is classed anew, and nothing else: all markers
    of samples that are new or changed, the new markers of the others. A marker without reads is a row of zeros. Folders of samples
    that lacked something are replaced, the others not touched; run again, a job that was cut short does what is left.
    """
    from mixolve.operators.reads import classify

    spark = reads.sparkSession
    wanted = written(markers.dropDuplicates(["marker"]), "markers")
    cached = read_cache(spark, path)
    valid = cached.join(samples, "sample").where(F.col("cached_at") >= F.col("modified")).join(wanted.select("marker"), "marker", "left_semi").select("sample", "marker", "u", "x", "m", "cached_at")
    whole = valid.groupBy("sample").agg(F.countDistinct("marker").alias("n")).where(F.col("n") == wanted.count()).select("sample")
    lacking = samples.select("sample").distinct().join(whole, "sample", "left_anti")
    todo = written(lacking.join(wanted.select("marker")).join(valid.select("sample", "marker"), ["sample", "marker"], "left_anti"), "todo")
    mine = reads.join(todo.select("sample").distinct(), "sample", "left_semi")
    classed = classify(mine, wanted.join(todo.select("marker").distinct(), "marker", "left_semi"), **how).select("sample", "marker", "u", "x", "m")
    some = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    fresh = todo.join(classed, ["sample", "marker"], "left").select("sample", "marker", some("u"), some("x"), some("m"), (F.current_timestamp() if now is None else now).alias("cached_at"))
    kept = valid.join(todo.select("sample").distinct(), "sample", "left_semi")
    write_cache(written(kept.unionByName(fresh), "refreshed"), path)  # written first: what is read here is replaced there
    return read_cache(spark, path)


def write_counts(counts: DataFrame, path: str, ending: str = "counts.gz") -> None:
    """Count tables without a header, gzipped, one file a sample: <path>/<sample>.<ending>. counts: sample and the columns of COUNTS.

    Spark writes a folder a sample; the driver then renames one file each.
    """
    spark = counts.sparkSession
    away = shared_folder(spark, "counts")
    counts.select(*COUNTS.names, "sample").repartition("sample").write.partitionBy("sample").option("compression", "gzip").csv(away, sep="\t")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = hadoop.Path(away).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(hadoop.Path(path))
    for folder in system.globStatus(hadoop.Path(f"{away}/sample=*")):
        parts = system.globStatus(hadoop.Path(f"{folder.getPath()}/part-*"))
        if len(parts) != 1:
            raise ValueError(f"{folder.getPath()} has {len(parts)} files")
        system.rename(parts[0].getPath(), hadoop.Path(f"{path}/{folder.getPath().getName().partition('=')[2]}.{ending}"))


def write_dataset(tables: dict[str, DataFrame], base: str) -> None:
    """obs, prop and atlas as Parquet; those with a split are laid out by it."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("split") if "split" in df.columns else writer).parquet(f"{base}/{name}")


def read_dataset(spark: SparkSession, base: str, split: str | None = None) -> dict[str, DataFrame]:
    """The tables of a dataset; with a split only its files are read. Raises if there is none."""
    out = {}
    for name in ("obs", "prop", "atlas"):
        df = spark.read.parquet(f"{base}/{name}")
        out[name] = df.where(F.col("split") == split) if split and "split" in df.columns else df
    return out


def read_estimates_csv(spark: SparkSession, path: str) -> DataFrame:
    """A table of cell types by samples to (cell_type, sample, w)."""
    return to_long(spark.read.csv(path, header=True), ["CellType"], "sample", "w").withColumnRenamed("CellType", "cell_type")


def write_report(df: DataFrame, path: str, form: str = "csv") -> None:
    """CSV with a header, JSON lines or Parquet."""
    writer = df.write.mode("overwrite")
    {"csv": lambda: writer.option("header", True).csv(path), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[form]()


def track(spark: SparkSession, path: str, step: int, values: dict[str, float]) -> None:
    """Append (step, name, value) rows to a metrics table."""
    spark.createDataFrame([(step, k, float(v)) for k, v in values.items()], "step long, name string, value double").write.mode("append").parquet(path)


#: Folders of tables that this process wrote for itself and didn't delete yet.
_written: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or where all runs in one process a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="mixolve-")
    _written.append(f"{named}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Cut the lineage: df as a Parquet table in the shared folder, laid out by some columns if asked."""
    path = shared_folder(df.sparkSession, name)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, folders: list[str] | None = None) -> None:
    """Delete folders made by shared_folder, all by default: for use when what reads them is written or done with."""
    for folder in list(_written) if folders is None else folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if folder in _written:
            _written.remove(folder)
