"""Sharding indivisible groups by best-fit-decreasing bin packing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixolve.llm.common import ranked, scratch, spread_join

#: Sizes are told apart to this many leading bits: at most 2**BITS classes an octave of size.
BITS = 9


class RoomTree:
    """Open bins in a treap, ordered by (room, bin): the tightest bin that a size fits into in O(log n)."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]
        self.seed = 1

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return [a[0], a[1], a[2], self._merge(a[3], b)]
        return [b[0], b[1], self._merge(a, b[2]), b[3]]

    def add(self, room: int, which: int) -> None:
        self.seed = self.seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        low, high = self._split(self.root, (room, which))
        self.root = self._merge(self._merge(low, [(room, which), self.seed >> 20, None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin (room, which) with the least room of at least size."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        first = high
        while first[2] is not None:
            first = first[2]
        _, rest = self._split(high, (first[0][0], first[0][1] + 1))
        self.root = self._merge(low, rest)
        return first[0]


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, most_bins: int | None = None, first_bin: int = 0) -> list[tuple[int, int, int, int]] | None:
    """Pack runs (size, how many alike), largest size first: [(run, from, to, bin)].

    The tightest bin stays the tightest while it takes pieces of one size, so a run fills it in one
    step; the result is that of placing the pieces one by one. None if most_bins don't hold them.
    """
    tree, bins, out = RoomTree(), 0, []
    for k in sorted(range(len(runs)), key=lambda k: -runs[k][0]):
        size, n = runs[k]
        at = 0
        while at < n:
            found = tree.take(size)
            if found is None:
                if bins == most_bins or size > capacity:
                    return None
                found, bins = (capacity, bins), bins + 1
            room, which = found
            fit = min(n - at, room // size)
            out.append((k, at, at + fit, first_bin + which))
            tree.add(room - fit * size, which)
            at += fit
    return out


def into_bins(runs: list[tuple[int, int]], bins: int, tolerance: float = 1e-4) -> list[tuple[int, int, int, int]]:
    """Pack runs into a fixed number of bins, near equal: the least capacity at which best-fit-decreasing needs no more.

    A piece of more than an even share of what is left gets a bin to itself first.
    """
    left = {k: [size, n] for k, (size, n) in enumerate(runs)}
    done: list[tuple[int, int, int, int]] = []
    used = 0
    for k in sorted(left, key=lambda k: -runs[k][0]):
        size, n = left[k]
        while n and used < bins - 1 and size * (bins - used) > sum(s * m for s, m in left.values()):
            done.append((k, runs[k][1] - n, runs[k][1] - n + 1, used))
            n, used = n - 1, used + 1
            left[k][1] = n
        if n:
            break
    keys = [k for k in left if left[k][1]]
    rest = [(left[k][0], left[k][1]) for k in keys]
    if not rest:
        return done
    low = max(max(s for s, _ in rest), -(-sum(s * n for s, n in rest) // (bins - used)))
    high = 2 * low
    best = best_fit_decreasing(rest, low, bins - used, used)
    if best is None:
        best = best_fit_decreasing(rest, high, bins - used, used)
        while high - low > max(1, int(tolerance * low)):
            middle = (low + high) // 2
            found = best_fit_decreasing(rest, middle, bins - used, used)
            if found is None:
                low = middle
            else:
                high, best = middle, found
    taken = {k: runs[k][1] - left[k][1] for k in left}
    return done + [(keys[i], taken[keys[i]] + a, taken[keys[i]] + b, which) for i, a, b, which in best]


def shard(rows: DataFrame, *, group_col: str, size_col: str, shards: int | None = None, capacity: int | None = None) -> DataFrame:
    """Add `shard` and `slot` (gapless from 0 in its shard) to rows; rows of a group share a shard.

    Either `shards`, filled near equally, or `capacity`, which opens as few as best-fit-decreasing
    needs (a larger group gets one of its own size). Groups are summed where they lie, then counted
    by size class. A class counts with its mean size for `shards` and with its largest for `capacity`, which
    therefore is never passed. Only the classes' counts (at most 2**BITS an octave of size) go to the driver,
    are packed, and come back as ranges of ranks within a class. No group's rows meet in one task.
    Null groups are one group, null sizes count 0; an empty table stays empty. Extra columns are
    kept; `shard` and `slot` in the input are replaced. The input is read three times, so give a
    scratch table.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    rows = rows.select(*kept)
    size = F.greatest(F.coalesce(F.sum(size_col), F.lit(0)), F.lit(1)).alias("_bytes")
    groups = rows.groupBy(F.col(group_col).alias("_group")).agg(size)
    shift = F.greatest(F.length(F.bin("_bytes")) - BITS - 1, F.lit(0))
    groups = scratch(groups.withColumn("_class", F.expr(f"shiftright(_bytes, int(greatest(length(bin(_bytes)) - {BITS + 1}, 0)))") + shift * (1 << BITS + 1)), "groups")
    classes = groups.groupBy("_class").agg((F.ceil(F.avg("_bytes")) if capacity is None else F.max("_bytes")).cast("long").alias("size"), F.count("*").alias("n")).collect()  # bounded by the classes
    runs = [(r["size"], r["n"]) for r in classes]
    if shards is not None:
        placed = into_bins(runs, shards)
    else:
        placed = best_fit_decreasing([(min(s, capacity), n) for s, n in runs], capacity)
    spark = rows.sparkSession
    ranges = spark.createDataFrame([(classes[k]["_class"], a, b, w) for k, a, b, w in placed], "_c long, _from long, _to long, shard int")
    order = ranked(groups.select("_group", "_class"), ["_class"], ["_group"], "_rank")
    homes = order.join(F.broadcast(ranges), (F.col("_class") == F.col("_c")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).select("_group", "shard")
    placed_rows = scratch(spread_join(rows, homes, [(group_col, "_group")]).drop("_group"), "placed")
    return ranked(placed_rows, ["shard"], kept, "slot")


def shard_documents(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put documents into shards of near equal bytes, equal texts together.

    Columns: doc_id, size (UTF-8 bytes plus 1; a null text has none), text_crc32, digest, shard,
    slot. A null text and an empty one are alike. Repeated rows get slots of their own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("digest"))
    return shard(scratch(rows, "digests"), group_col="digest", size_col="size", shards=shards)
