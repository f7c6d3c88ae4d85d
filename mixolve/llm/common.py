"""Shared pieces: reading tables, scratch tables in the shared folder, distributed ranks, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in spark.checkpoint.dir. Only where that is unset and all runs in one process
    (tests, one machine) a temporary folder is made and set; elsewhere that raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mixolve-"))
    return spark.sparkContext.getCheckpointDir()


#: Scratch folders that this process has made and not deleted yet.
_made: set[str] = set()
#: Where this thread's scratch folders are listed (see owning).
_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@contextmanager
def owning() -> Iterator[list[str]]:
    """A list of the scratch folders that this thread makes inside, so that who made them can delete them and nobody else's.

    At the end they are the caller's as well, if it lists its own.
    """
    outer, mine = _owner.get(), []
    token = _owner.set(mine)
    try:
        yield mine
    finally:
        _owner.reset(token)
        if outer is not None:
            outer.extend(mine)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.add(path)
    mine = _owner.get()
    if mine is not None:
        mine.append(path)
    return path


def scratch(df: DataFrame, name: str, **options) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs started inside send Python batches of at most so many rows, so that long texts take little memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Hand freed memory back to the system: a Python worker stays for later tasks, and shares its executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def _delete(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _made.discard(folder)


def _read_by(df: DataFrame) -> set[str]:
    """Names of the folders whose files df reads."""
    return {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a scratch table that nothing reads any more."""
    names = _read_by(df)
    _delete(df.sparkSession, [m for m in list(_made) if m.rpartition("/")[2] in names])


def clear_scratch(spark: SparkSession, folders: list[str] | None = None, *, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete scratch folders, all that this process made by default, but those that `keep` reads: for use when results that read them are written."""
    names = {n for df in keep for n in _read_by(df)}
    _delete(spark, [m for m in (list(_made) if folders is None else folders) if m in _made and m.rpartition("/")[2] not in names])


#: Key of a column's metadata, which Parquet files keep: the scratch folders that a stage's result was made from.
MADE_FROM = "mixolve.made_from"


def signed(result: DataFrame, folders: list[str]) -> DataFrame:
    """result with a note, in its first column's metadata, of the scratch folders that it reads."""
    return result.withMetadata(result.columns[0], {MADE_FROM: [f for f in folders if f in _made]})


def release(docs: DataFrame) -> None:
    """Delete the scratch folders that docs is a written copy of a result of: the note came back from the files, and docs doesn't read them.

    So they go when their own result was written and handed on, and with nobody else's.
    """
    noted = docs.schema.fields[0].metadata.get(MADE_FROM, []) if docs.columns else []
    names = _read_by(docs) if noted else set()
    if names and not any(f.rpartition("/")[2] in names for f in noted):
        _delete(docs.sparkSession, [f for f in noted if f in _made])


def named(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(docs: DataFrame, text_col: str, **more: str) -> DataFrame:
    """docs as _doc (a struct of all columns but the text), _said (the text) and copies of columns under new names.

    So that operators can add columns of their own whatever those of docs are called; see restored.
    """
    others = [F.col(named(c)) for c in docs.columns if c != text_col]
    return docs.select(F.struct(F.lit(True).alias("_"), *others).alias("_doc"), F.col(named(text_col)).alias("_said"), *[F.col(named(c)).alias(n) for n, c in more.items()])


def restored(rows: DataFrame, columns: list[str], text_col: str, **changed: Column) -> DataFrame:
    """The columns of the table that carried() took, some of them changed."""
    return rows.select(*[changed.get(c, F.col("_said") if c == text_col else F.col(f"_doc.{named(c)}")).alias(c) for c in columns])


def _same(keys: list[str], prefix: str) -> Column:
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"{prefix}{i}")) for i, k in enumerate(keys)])


def _renamed(keys: list[str], prefix: str) -> list[Column]:
    return [F.col(k).alias(f"{prefix}{i}") for i, k in enumerate(keys)]


def sliced(df: DataFrame, keys: list[str], order: list[str], rows_per_slice: int) -> DataFrame:
    """df with _slice: a key's rows dealt by a hash of `order` over as many slices as its count asks for. Keys must be few."""
    counts = df.groupBy(*keys).count() if keys else df.groupBy().count()
    slices = counts.select(*_renamed(keys, "_n"), F.expr(f"1 + count div {rows_per_slice}").alias("_slices"))
    joined = df.join(F.broadcast(slices), _same(keys, "_n")) if keys else df.crossJoin(F.broadcast(slices))  # one row a key
    return joined.select(*df.columns, F.pmod(F.xxhash64(*order), F.col("_slices")).alias("_slice"))


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, rows_per_slice: int = 2000) -> DataFrame:
    """Add the sum of `value` over the rows before this one within keys, in whatever order, without a task for a whole key.

    Sums run within a slice (see sliced) and start at the sum of the key's earlier slices. `order`
    should identify a row; rows that agree in all of it are alike and come in any order. Keys must
    be few (a row a key goes to all tasks), rows may be many; with no keys all rows are one.
    """
    parts = sliced(df.withColumn("_value", value.cast("long")), keys, order, rows_per_slice)
    whole = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    before = parts.groupBy(*keys, "_slice").agg(F.sum("_value").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(whole), F.lit(0)))
    before = before.select(*_renamed(keys, "_k"), F.col("_slice").alias("_s"), "_before")
    inside = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = parts.withColumn("_inner", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    found = F.col("_slice") == F.col("_s")
    return summed.join(before, (_same(keys, "_k") & found) if keys else found).select(*df.columns, (F.col("_inner") + F.col("_before")).alias(out))


def ranked(df: DataFrame, keys: list[str], order: list[str], out: str, rows_per_slice: int = 2000) -> DataFrame:
    """A gapless rank from 0 within keys: the running sum of ones."""
    return running_sum(df, keys, order, F.lit(1), out, rows_per_slice)


def spread_join(big: DataFrame, small: DataFrame, on: list[tuple[str, str]], how: str = "inner", share: int = 1000, counts: DataFrame | None = None) -> DataFrame:
    """big joined with small on pairs of columns (null-safe), keys of more than 1/share of big's rows split.

    At most `share` keys can be so heavy, so their table is broadcast; such a key's rows are dealt
    over salts, and the few rows of small that have it are repeated for each. `how`: inner or left.
    Columns of the two sides must differ in name; small should have few rows a key. `counts` (the
    keys of big and count; those that small lacks may be left out), where it is known and written, saves counting: big isn't computed for that.
    """
    left, right = [a for a, _ in on], [b for _, b in on]
    total = big.count() if counts is None else counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    counts = big.groupBy(*left).count() if counts is None else counts
    heavy = counts.where(F.col("count") > max(1000, total // share)).select(*_renamed(left, "_h"), F.expr(f"1 + count div {max(1000, total // share)}").alias("_salts"))
    many = F.coalesce("_salts", F.lit(1))
    dealt = big.join(F.broadcast(heavy), _same(left, "_h"), "left").select(*big.columns, F.pmod(F.monotonically_increasing_id(), many).alias("_salt"))
    repeated = small.join(F.broadcast(heavy), _same(right, "_h"), "left").select(*small.columns, F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("_copy"))
    match = reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in on]) & (F.col("_salt") == F.col("_copy"))
    return dealt.join(repeated, match, how).drop("_salt", "_copy")


def among(rows: DataFrame, col: str, numbers: DataFrame, *, of: str, keep: bool = True, most: int = 500_000) -> DataFrame:
    """The rows whose number in `col` is among those in column `of` of `numbers`, which may repeat, or with keep=False those whose isn't.

    For numbers given by monotonically_increasing_id: 64 neighbours are bits of one long, so what is sent to the
    rows is a long pair for each 64 of them at most, and the rows aren't shuffled. Beyond `most` such pairs, some tens of MB, they are.
    """
    bits = numbers.select(F.shiftright(of, 6).alias("_word"), F.expr(f"shiftleft(1L, cast({named(of)} & 63 as int))").alias("_bit"))
    words = scratch(bits.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")), "number-bits")
    if words.count() > most:
        return rows.join(numbers.select(F.col(of).alias("_number")).distinct(), F.col(col) == F.col("_number"), "left_semi" if keep else "left_anti")
    met = rows.join(F.broadcast(words), F.shiftright(col, 6) == F.col("_word"), "inner" if keep else "left")
    set_ = F.getbit("_bits", F.expr(f"cast({named(col)} & 63 as int)")) == 1
    return met.where(set_ if keep else ~F.coalesce(set_, F.lit(False))).select(*rows.columns)


def join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of a and b: label holds each item's class, by its least member."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up
    return label


def stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (hi, lo) that connect what a task's edges connect: each node with the smallest that it reaches by them."""
    held = [(b.column("hi").to_numpy(), b.column("lo").to_numpy()) for b in batches]
    if held:
        hi, lo = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([hi, lo]), return_inverse=True)
        label = join_labels(np.arange(len(nodes)), at[: len(hi)], at[len(hi) :])
        apart = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(nodes[label[apart]])], names=["hi", "lo"])


def components(edges: DataFrame, a: str, b: str, share: int = 250_000) -> DataFrame:
    """Connected components of an edge list of longs: (node, root), root being the component's smallest node.

    Tasks of some `share` edges (4 MB) first join what their own edges connect. Where there is more than one such task,
    large-star and small-star rounds alternate, each a shuffle by node with sums made before it,
    until nothing changes; every round is written to the shared folder. Only nodes with an edge to
    another node are returned. Null ends are ignored; loops and repeated edges are harmless.
    """
    first = scratch(
        edges.select(F.greatest(a, b).cast("long").alias("hi"), F.least(a, b).cast("long").alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(),
        "edges",
    )
    tasks = -(-first.count() // share)
    now = scratch((first.repartition(tasks) if tasks > 1 else first.coalesce(1)).mapInArrow(stars, first.schema), "stars")
    drop_scratch(first)
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    state = mark(now) if tasks > 1 else None
    while state:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        rooted = spread_join(both.where("v > u"), least.withColumnRenamed("u", "node"), [("u", "node")])
        large = rooted.select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = scratch(large.where("hi > lo").distinct(), "large-star")
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi > lo")
        nxt = scratch(small.unionAll(down.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")
        drop_scratch(now)
        drop_scratch(large)
        now, before, state = nxt, state, mark(nxt)
        if state == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
