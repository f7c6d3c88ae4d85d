"""Near copies by Jaccard similarity of word shingles: MinHash bands find candidates, whole shingle sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mixolve.llm.common import among, components, scratch, spread_join

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bands of WIDTH minima each: a pair at similarity 0.8 shares none with probability (1 - 0.8**5)**28 = 1.5e-5.
BANDS, WIDTH = 28, 5
_DRAWN = np.random.default_rng(42).integers(0, 1 << 63, (3, BANDS * WIDTH), dtype=np.uint64)
TIMES, PLUS, MIX = _DRAWN[0] * np.uint64(2) + np.uint64(1), _DRAWN[1], _DRAWN[2] * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 values of a text's word shingles, words as in the SimHash; fewer words than a shingle are one."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n))


def band_keys(s: np.ndarray) -> np.ndarray:
    """A key for each band of a set's minima; the band's number is part of it."""
    least = np.full(BANDS * WIDTH, ~np.uint64(0))
    for at in range(0, len(s), 1000):
        least = np.minimum(least, (s[at : at + 1000, None] * TIMES + PLUS).min(axis=0))
    least ^= least >> np.uint64(31)
    keys = (least * MIX).reshape(BANDS, WIDTH).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    keys ^= keys >> np.uint64(29)
    return (keys * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def sketches(rows: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(row, n, whole, keys) of rows with words: the size of the shingle set, a 128-bit hash of it, its band keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for row, text in zip(b.column(0).to_pylist(), b.column(1)):
                s = shingles(text.as_py(), shingle)
                if len(s):
                    for held, value in zip(out, (row, len(s), xxhash.xxh3_128_digest(s.tobytes()), band_keys(s))):
                        held.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())))], names=["row", "n", "whole", "keys"])
        pa.default_memory_pool().release_unused()

    return rows.select(F.col("_row").alias("row"), F.col(text_col).alias("text")).mapInArrow(run, "row long, n int, whole binary, keys array<long>")


def bucket_rows(sketched: DataFrame) -> DataFrame:
    """(key, row, n) of the rows, for each of their keys that another row has as well.

    Of a batch's rows with the same key one stands for all, with their number; the others have company for sure. So all rows
    are shuffled once, and a key has no more rows in a task than there are batches.
    """

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("keys")
            key = lists.flatten().to_numpy()
            lengths = np.diff(lists.offsets.to_numpy())
            row, n = (np.repeat(b.column(c).to_numpy(), lengths) for c in ("row", "n"))
            count = np.zeros(len(key), np.int32)
            _, at, many = np.unique(key, return_index=True, return_counts=True)
            count[at] = many
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(row), pa.array(n, pa.int32()), pa.array(count), pa.array(row, mask=count > 0)], names=["key", "row", "n", "count", "other"])

    rows = sketched.select("row", "n", "keys").mapInArrow(counted, "key long, row long, n int, count int, other long")
    whole = rows.withColumn("whole", F.sum("count").over(W.partitionBy("key", "other")))
    return whole.where((F.col("whole") > 1) | F.col("other").isNotNull()).select("key", "row", "n")


def shingle_sets(rows: DataFrame, ids: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """(row, s) of the rows whose number is in ids (column row): the shingle set as bytes. The texts aren't shuffled (see among)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), shingle).tobytes() for t in b.column(1)], pa.binary())], names=["row", "s"])
        pa.default_memory_pool().release_unused()

    texts = among(rows.select(F.col("_row").alias("row"), F.col(text_col).alias("text")), "row", ids, of="row")
    return texts.mapInArrow(run, "row long, s binary")


def alike(sets: DataFrame, pairs: DataFrame, similarity: float, most: int = 250_000) -> DataFrame:
    """Those (a, b) of pairs whose shingle sets have at least the similarity.

    Pairs are dealt into cells of two sides by hashes of a and b, and a set goes once to each cell
    that asks for it, so a row of many pairs is no hot key. Who asks is sent to the sets for up to
    `most` pairs, some 30 MB; beyond that the sets are shuffled by row before they are by cell.
    """

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, here = None, {}
        for b in batches:
            firsts, seconds = [], []
            for now, x, y, s in zip(b.column("cell").to_pylist(), b.column("a").to_pylist(), b.column("b").to_pylist(), b.column("s")):
                if now != cell:
                    cell, here = now, {}
                if y is None:
                    here[x] = np.frombuffer(s.as_py(), np.uint64)
                    continue
                p, q = here[x], here[y]
                both = len(np.intersect1d(p, q, assume_unique=True))
                if both >= similarity * (len(p) + len(q) - both) - 1e-9:
                    firsts.append(x)
                    seconds.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(firsts, pa.int64()), pa.array(seconds, pa.int64())], names=["a", "b"])
        pa.default_memory_pool().release_unused()

    size, many = sets.agg(F.coalesce(F.sum(F.length("s")), F.lit(0))).first()[0], pairs.count()
    sides = max(8, -(-size // (8 << 20)), math.isqrt(many // 5000))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(sides))
    dealt = pairs.select((part("a") * sides + part("b")).alias("cell"), "a", "b")
    needed = dealt.select("cell", F.col("a").alias("id")).unionAll(dealt.select("cell", F.col("b").alias("id"))).distinct()
    sent = sets.join(F.broadcast(needed) if many <= most else needed, F.col("id") == F.col("row")).select("cell", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "s")
    both = sent.unionAll(dealt.select("*", F.lit(None).cast("binary").alias("s")))
    return both.repartition("cell").sortWithinPartitions("cell", F.col("b").isNotNull()).mapInArrow(compare, "a long, b long")


#: 64-bit words of a parity bitmap: enough to rule out pairs at 0.7 of sets up to some 500 shingles; they are shuffled with every bucket of a row.
PARITY_WORDS = 6


def parities(sets: DataFrame) -> DataFrame:
    """(row, bits): a bitmap of each set in which a shingle flips the bit that its hash names.

    Two bitmaps differ in no more bits than the sets differ in shingles, so a pair whose bitmaps differ in too many isn't similar.
    """
    size = 64 * PARITY_WORDS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(np.bincount((np.frombuffer(s.as_py(), np.uint64) % np.uint64(size)).astype(np.int64), minlength=size) & 1).view(np.int64) for s in b.column("s")]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(bits, pa.list_(pa.int64()))], names=["row", "bits"])
        pa.default_memory_pool().release_unused()

    return sets.select("row", "s").mapInArrow(run, "row long, bits array<long>")


def shared_counts(sets: DataFrame) -> DataFrame:
    """(row, shared): how many shingles of a set are in another set as well. Sums are made before the shuffle by shingle."""

    def values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                held = [np.frombuffer(s.as_py(), np.int64) for s in b.column("s")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(np.repeat(b.column("row").to_numpy(), [len(h) for h in held]))], names=["x", "row"])

    alone = sets.select("row", "s").mapInArrow(values, "x long, row long").groupBy("x").agg(F.count("*").alias("c"), F.first("row").alias("row")).where("c = 1")
    alone = alone.groupBy("row").agg(F.count("*").alias("alone")).withColumnRenamed("row", "r")
    return sets.join(alone, F.col("row") == F.col("r"), "left").select("row", (F.length("s").cast("long") / 8 - F.coalesce("alone", F.lit(0))).cast("int").alias("shared"))


def similar_edges(rows: DataFrame, known: DataFrame, *, text_col: str = "text", shingle: int = 5, similarity: float = 0.8, block: int = 5000) -> DataFrame:
    """Edges (a, b), those of `known` included, that connect all rows (column _row) whose shingle sets are at least so similar.

    Equal sets are one. Rows that share a band key are candidates; each candidate pair ends up linked
    (by whatever path), compared, or ruled out by a bound that holds for sure:

    1. Each row is compared with one other: the least row of its buckets, unless a known edge joins the two or both to a third.
    2. In buckets that still hold rows apart, the shingles that no other such row has are counted. A
       pair of similarity t shares t / (1 + t) of the sum of the two sizes, so both need as many
       shingles that are shared at all; rows short of it with every partner are left out.
    3. Each row is compared with one that it isn't linked to yet: that with the fewest shingles alone.
    4. What is then still apart and may be similar is compared pair by pair. Of such a pair one is
       outside the bucket's largest component, so only those rows meet the whole bucket, dealt in blocks of
       `block` by `block` rows. Where parity bitmaps differ in more bits than sets of that similarity could in shingles, the pair is ruled out.

    So nothing is left out than pairs that share no band.
    """
    told = scratch(sketches(rows, text_col, shingle), "sketches")
    equal = told.groupBy("whole").agg(F.min("row").alias("least"), F.count("*").alias("count")).where("count > 1")
    copies = told.select("row", "whole").join(equal.select(F.col("whole").alias("w"), "least"), F.col("whole") == F.col("w")).where("row <> least")
    copies = scratch(copies.select(F.col("row").alias("a"), F.col("least").alias("b")), "equal-sets")
    edges = known.select("a", "b").unionAll(copies)

    def apart(members: DataFrame, best: Column) -> tuple[DataFrame, DataFrame]:
        """Buckets that hold more than one component, one row each with its best row; and their rows."""
        buckets = members.groupBy("key").agg(F.count("*").alias("count"), F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct(best.alias("rank"), "row", "root")).alias("hub")).where("low < high")
        buckets = scratch(buckets.select("key", "count", "hub"), "open-buckets")
        return buckets, spread_join(members, buckets.select(F.col("key").alias("k"), "hub"), [("key", "k")], counts=buckets).drop("k")

    def rooted(rows: DataFrame, stars: DataFrame) -> DataFrame:
        bare = rows.drop("root")
        return bare.join(stars.select(F.col("a").alias("node"), F.col("b").alias("root")), F.col("row") == F.col("node"), "left").select(*bare.columns, F.coalesce("root", "row").alias("root"))

    def merged(edges: DataFrame) -> DataFrame:
        """Edges from each linked row to its root, so the next round starts from stars."""
        return scratch(components(edges, "a", "b").where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "stars")

    def to_hubs(found: DataFrame) -> DataFrame:
        """A pair for each row that isn't linked to the best row of all its buckets."""
        return found.where(F.col("hub.root") != F.col("root")).groupBy(F.col("row").alias("a")).agg(F.min("hub")["row"].alias("b"))

    links = known.groupBy("a").agg(F.min("b").alias("b"))
    buckets = scratch(rooted(bucket_rows(among(told, "row", copies, of="a", keep=False)), links), "buckets")
    _, found = apart(buckets, F.lit(0))
    found = scratch(found, "open-rows")
    sets = scratch(shingle_sets(rows, found, text_col, shingle), "shingle-sets")
    edges = merged(edges.unionAll(alike(sets, scratch(to_hubs(found), "first-pairs"), similarity)))

    _, found = apart(rooted(found.drop("hub"), edges), F.lit(0))
    found = scratch(found.drop("hub"), "open-rows")
    counts = shared_counts(among(sets, "row", found, of="row"))
    found = found.join(counts.withColumnRenamed("row", "r"), F.col("row") == F.col("r")).drop("r")
    may = scratch(found.where(F.col("shared") >= similarity * F.col("n") - 1e-9), "may-link")  # of a pair the union holds all n, and no more than `shared` are common
    _, found = apart(may, F.col("n") - F.col("shared"))
    edges = merged(edges.unionAll(alike(sets, scratch(to_hubs(found), "second-pairs"), similarity)))

    sizes, found = apart(rooted(may, edges), F.lit(0))
    found = scratch(found.drop("hub"), "open-rows")
    by_root = found.groupBy("key", "root").count().groupBy(F.col("key").alias("k")).agg(F.sum("count").alias("size"), F.max(F.struct("count", "root")).alias("top"))
    bits = parities(among(sets, "row", found, of="row")).withColumnRenamed("row", "r")
    found = found.join(bits, F.col("row") == F.col("r")).drop("r")
    by_root = by_root.select("k", F.col("top.root").alias("most"), F.expr(f"1 + (size - top.count) div {block}").alias("ls"), F.expr(f"1 + size div {block}").alias("rs"))
    dealt = scratch(spread_join(found, by_root, [("key", "k")], counts=sizes).drop("k"), "dealt")
    numbers = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = dealt.where("root <> most").select("key", F.col("row").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"), F.col("root").alias("ra"), F.col("bits").alias("pa"), F.pmod(F.xxhash64("row"), "ls").alias("i"), numbers("rs").alias("j"))
    right = dealt.select(F.col("key").alias("k"), F.col("row").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"), F.col("root").alias("rb"), F.col("bits").alias("pb"), (F.col("root") == F.col("most")).alias("main"), F.pmod(F.xxhash64("row"), "rs").alias("j2"), numbers("ls").alias("i2"))
    meet = (F.col("key") == F.col("k")) & (F.col("i") == F.col("i2")) & (F.col("j") == F.col("j2")) & (F.col("ra") != F.col("rb")) & (F.col("main") | (F.col("a") > F.col("b")))
    enough = F.least("sa", "sb") >= (F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) - 1e-9
    differ = F.aggregate(F.zip_with("pa", "pb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    near = differ <= (F.col("na") + F.col("nb")) * ((1 - similarity) / (1 + similarity)) + 1e-9
    rest = left.join(right, meet & enough & (F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9) & near).select("a", "b").distinct()
    return edges.unionAll(alike(sets, scratch(rest, "apart"), similarity))
