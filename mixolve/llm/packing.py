"""Packing token pieces into fixed-length sequences by cutting-stock column generation."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mixolve.llm.common import among, arrow_rows, give_back, ranked, running_sum, scratch
from mixolve.llm.tokens import encoder, slices


def best_pattern(duals: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable multiset of sizes within capacity."""
    value, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = sizes <= room
        value[room], took[room] = value[room - 1], -1
        if fit.any():
            gain = np.where(fit, duals + value[np.maximum(room - sizes, 0)], -1.0)
            best = int(gain.argmax())
            if gain[best] > value[room] + 1e-12:
                value[room], took[room] = gain[best], best
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            pattern[took[room]] += 1
            room -= int(sizes[took[room]])
    return float(value[capacity]), pattern


def inverse_of(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row exchanges by elementwise steps.

    The planner runs in the driver, where the JVM was started from the same process: threads of a linear-algebra
    library can stand still there, so the plan uses none.
    """
    n = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(n)])
    for k in range(n):
        pivot = k + int(np.abs(work[k:, k]).argmax())
        if work[pivot, k] == 0:
            raise np.linalg.LinAlgError("singular basis")
        work[[k, pivot]] = work[[pivot, k]]
        work[k] /= work[k, k]
        rest = work[:, k].copy()
        rest[k] = 0
        work -= rest[:, None] * work[k]
    return work[:, n:]


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Solve the cutting-stock linear program: (patterns as columns, how often each is used).

    Revised simplex from one-size patterns; each entering column is the one that the knapsack
    prices highest under the present duals. Ends when no pattern is worth more than 1 + tolerance,
    which bounds the sequences above the optimum by that share, or after `rounds`.
    """
    basis = np.diag(np.floor(capacity / sizes)).astype(float)
    inverse, x = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    for k in range(rounds):
        worth, column = best_pattern(inverse.sum(axis=0), sizes, capacity)
        if worth <= 1 + tolerance:
            break
        d = (inverse * column).sum(axis=1)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = np.maximum(x - step * d, 0)
        x[out] = step
        basis[:, out] = column
        if k % 100 == 99:
            inverse = inverse_of(basis)
            x = np.maximum((inverse * demand).sum(axis=1), 0)
        else:
            row = inverse[out] / d[out]
            inverse -= d[:, None] * row
            inverse[out] = row
    return basis, x


def best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Pieces, largest first, each into the fullest sequence that has room: a pattern for each sequence."""
    bins: list[list] = []  # room, pattern
    for i, size in enumerate(sizes):
        for _ in range(int(left[i])):
            fits = [b for b in bins if b[0] >= size]
            if fits:
                best = min(fits, key=lambda b: b[0])
            else:
                bins.append(best := [capacity, np.zeros(len(sizes), np.int64)])
            best[0] -= int(size)
            best[1][i] += 1
    return [b[1] for b in bins]


def fullest(sizes: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """The pieces that fill most of capacity: sums reached size by size, each with the piece that reached it first."""
    back: dict[int, tuple[int, int] | None] = {0: None}
    for i, size in enumerate(sizes.tolist()):
        for _ in range(min(int(left[i]), capacity // size)):
            new = [r + size for r in back if r + size <= capacity and r + size not in back]
            if not new or capacity in back:
                break
            back.update((r, (i, r - size)) for r in new)
    pattern, at = np.zeros(len(sizes), np.int64), max(back)
    while (step := back[at]) is not None:
        pattern[step[0]] += 1
        at = step[1]
    return pattern


def least_slack(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """The largest piece left opens a sequence, and what fills its room best goes with it."""
    left, out = left.copy(), []
    while left.any():
        first = int(np.flatnonzero(left)[0])
        left[first] -= 1
        pattern = np.minimum(fullest(sizes, left, capacity - int(sizes[first])), left)
        left -= pattern
        pattern[first] += 1
        out.append(pattern)
    return out


def plan_sequences(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """Whole-number patterns that hold exactly the histogram's pieces: ([(pattern, times)], sizes).

    Linear-program uses are rounded down; what is left (a number of pieces bounded by what the
    patterns of a basis hold, whatever the input) goes into sequences of its own, by best-fit or by
    least slack. Patterns used less than 1, 2 or 4 times are given up too; the best of all is taken.
    """
    sizes = np.array(sorted(histogram, reverse=True), dtype=np.int64)
    demand = np.array([histogram[s] for s in sizes], dtype=np.int64)
    if not len(sizes):
        return [], sizes
    basis, x = column_generation(sizes, demand.astype(float), capacity)
    best: list[tuple[np.ndarray, int]] | None = None
    for least in (1, 2, 4):
        plan, left = [], demand.copy()
        for j in np.argsort(-x):
            pattern = np.rint(basis[:, j]).astype(np.int64)
            used = pattern > 0
            times = min(int(x[j] + 1e-6), int((left[used] // pattern[used]).min()))
            if times >= least:
                plan.append((pattern, times))
                left -= pattern * times
        for rest in (best_fit, least_slack):
            whole = plan + [(p, 1) for p in rest(sizes, left, capacity)]
            if best is None or sum(t for _, t in whole) < sum(t for _, t in best):
                best = whole
    return best or [], sizes


def cut_pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, length: int = 4096, spaced: bool = False, keep_ids: bool | str = False) -> DataFrame:
    """Encode docs, append end_id, and cut each into pieces of `length` and a shorter last one.

    Columns: doc_id, start, length, ids_crc32, doc_tokens and, with keep_ids, ids: a list, or with
    "binary" little-endian unsigned 32-bit integers. Null texts are empty (one piece of end_id alone); very long texts give as many pieces
    as they need; repeated rows are cut each on its own; an empty table gives none; other columns of
    docs, whatever their names, are left out.
    """
    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()  # what tasks of other stages left free in this worker
        enc = encoder(tokenizer, spaced, entries=200_000)
        for batch in batches:
            for few in slices(batch, "text", 2 << 20):
                ids, ends = enc.encode(few.column("text"))
                ids, ends = np.insert(ids, ends[1:], end_id).astype("<u4"), ends + np.arange(len(ends))
                cut = []
                for doc, a, b in zip(few.column("id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                    for at in range(a, b, length):
                        cut.append((doc, at - a, min(b - at, length), zlib.crc32(ids[at : min(b, at + length)]), b - a))
                columns = [pa.array(c, pa.int64()) for c in zip(*cut)]
                bounds = np.cumsum([0] + [c[2] for c in cut]).astype(np.int32)
                if keep_ids == "binary":
                    columns.append(pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(4 * bounds), pa.py_buffer(ids)]))
                elif keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.view("<i4"))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])
                give_back()

    return kept.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (f", ids {'binary' if keep_ids == 'binary' else 'array<int>'}" if keep_ids else ""))


def pack(pieces: DataFrame, *, capacity: int = 4096, unit: int = 16) -> DataFrame:
    """Give every piece (doc_id, start, length, ids_crc32, ...) a sequence_id and an offset in it.

    Lengths are rounded up to `unit`; their histogram (capacity / unit rows at most) goes to the
    driver, which plans patterns by column generation. Pieces of a size, ranked, then take the
    places of that size in the planned sequences in turn: an equi-join on size with the plan's rank
    ranges, whose number depends on capacity / unit alone. Pieces must be 1 to capacity long. Other
    columns are kept whatever their names; sequence_id and offset are replaced; an empty table stays
    empty; pieces that agree in all four columns are alike and get places of their own.
    """
    spark = pieces.sparkSession
    keep = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    sized = pieces.select(F.struct(*keep).alias("_piece"), F.ceil(F.col("length") / unit).cast("long").alias("_size"))
    histogram = {r["_size"]: r["count"] for r in sized.groupBy("_size").count().collect()}  # capacity / unit rows at most
    plan, sizes = plan_sequences(histogram, capacity // unit)
    taken, base, places = np.zeros(len(sizes), np.int64), 0, []
    for pattern, times in plan:
        slot = 0
        for i in np.flatnonzero(pattern):
            each = int(pattern[i])
            places.append((int(sizes[i]), int(taken[i]), int(taken[i]) + each * times, base, each, slot))
            taken[i] += each * times
            slot += each
        base += times
    rows = spark.createDataFrame(places, "_p long, _lo long, _hi long, _base long, _each long, _slot long")
    ordered = ranked(sized, ["_size"], [f"_piece.{c}" for c in ("doc_id", "start", "ids_crc32")], "_rank")
    placed = ordered.join(F.broadcast(rows), (F.col("_size") == F.col("_p")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    nth = F.col("_rank") - F.col("_lo")
    placed = placed.select("_piece", (F.col("_base") + F.floor(nth / F.col("_each"))).alias("_sequence"), (F.col("_slot") + nth % F.col("_each")).alias("_slot"))
    inside = W.partitionBy("_sequence").orderBy("_slot")
    return placed.select("_piece.*", F.col("_sequence").alias("sequence_id"), (F.sum("_piece.length").over(inside) - F.col("_piece.length")).alias("offset"))


def fill_sequences(packed: DataFrame, ids: DataFrame, *, capacity: int = 4096, sliver: int = 16) -> DataFrame:
    """Break up the emptiest sequences and cut their pieces to fill the room of the others.

    packed: piece (a number of its own), doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, used (tokens of the sequence); ids: piece, ids. Both are read several times, so give
    written tables. Of sequences in order of tokens held, as many are broken up as the
    others have room for; rooms under `sliver` tokens stay padded, so padding is under sliver / capacity.
    The freed pieces stand on one line and the rooms on another, both by running sums; a piece is cut
    where a room ends. What the rooms don't take becomes full sequences, the last of it sequences
    of a power of two. Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; an
    empty table stays empty; other columns are left out.
    """
    spark = packed.sparkSession
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    heads = packed.where("offset = 0").select("sequence_id", "used")
    held = sorted((r["used"], r["count"]) for r in heads.groupBy("used").count().collect())  # capacity rows at most
    room = sum((capacity - u) * n for u, n in held if capacity - u >= sliver)
    free, limit = 0, 0
    for u, n in held:
        if free >= room or capacity - u < sliver:
            break
        free, room, limit = free + u * n, room - (capacity - u) * n, u
    rooms = heads.where((F.col("used") > limit) & (F.col("used") <= capacity - sliver)).select("sequence_id", F.col("used").alias("at"), (capacity - F.col("used")).alias("size"))
    rooms = running_sum(rooms, [], ["sequence_id"], F.col("size"), "lo").withColumn("hi", F.col("lo") + F.col("size")).drop("size")
    full, tail = divmod(free - room, capacity)
    top = 1 + (heads.agg(F.max("sequence_id")).first()[0] or 0)
    more = spark.range(full).select((F.col("id") + top).alias("sequence_id"), F.lit(0).cast("long").alias("at"), (F.col("id") * capacity + room).alias("lo"), ((F.col("id") + 1) * capacity + room).alias("hi"))
    last, at = [], room + full * capacity
    for bit in range(tail.bit_length() - 1, -1, -1):
        if tail >> bit & 1:
            last.append((top + full + len(last), 0, at, at + (1 << bit)))
            at += 1 << bit
    rooms = rooms.unionByName(more).unionByName(spark.createDataFrame(last, "sequence_id long, at long, lo long, hi long"))
    freed = packed.where(F.col("used") <= limit).select("piece", "doc_id", "start", "length", "doc_tokens")
    line = running_sum(freed, [], ["piece"], F.col("length"), "from").withColumn("to", F.col("from") + F.col("length"))
    steps = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / capacity), F.floor((F.col(b) - 1) / capacity)))
    met = line.withColumn("bin", steps("from", "to")).join(rooms.withColumn("rbin", steps("lo", "hi")), (F.col("bin") == F.col("rbin")) & (F.col("from") < F.col("hi")) & (F.col("lo") < F.col("to")))
    a, b = F.greatest("from", "lo"), F.least("to", "hi")
    cut = met.where(F.floor(a / capacity) == F.col("bin")).select(
        F.col("piece").alias("p"), (a - F.col("from")).alias("skip"), (b - a).alias("length"), (F.col("start") + a - F.col("from")).alias("start"), "doc_id", "doc_tokens", "sequence_id", (F.col("at") + a - F.col("lo")).alias("offset")
    )
    ids = among(ids.select("piece", "ids"), "piece", freed, of="piece")  # only what is cut is shuffled
    part = F.substring("ids", (4 * F.col("skip") + 1).cast("int"), (4 * F.col("length")).cast("int"))
    cut = cut.join(ids, F.col("p") == F.col("piece")).withColumn("ids_crc32", F.crc32(part))
    return packed.where(F.col("used") > limit).select(*out).unionByName(cut.select(*out))


def pack_documents(spark: SparkSession, docs: DataFrame, tokenizer: str, *, capacity: int = 4096, unit: int = 16, fill: bool = False, **how) -> DataFrame:
    """Encode, cut and pack docs: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are cut at multiples of `capacity`; with `fill`, those of the emptiest sequences are
    cut anywhere, so that the others are full (fill_sequences). Pieces are written to the shared
    folder, so that texts are encoded once.
    """
    with arrow_rows(spark, 1000):
        pieces = scratch(cut_pieces(docs, tokenizer, length=capacity, keep_ids="binary" if fill else False, **how).withColumn("piece", F.monotonically_increasing_id()), "pieces", compression="zstd")
    packed = pack(pieces.drop("ids"), capacity=capacity, unit=unit)
    if not fill:
        return packed.drop("piece")
    packed = packed.withColumn("used", F.sum("length").over(W.partitionBy("sequence_id")))
    return fill_sequences(scratch(packed, "packed"), pieces, capacity=capacity)
