"""SimHash near-duplicates through a Gray-order hierarchical index."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixolve.llm.common import among, carried, clear_scratch, components, drop_scratch, join_labels, owning, restored, scratch, spread_join
from mixolve.llm.minhash import similar_edges

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles, repeats counted; 0 without words.

    Words part at ASCII white space, A-Z lowered; fewer words than a shingle are one shingle. A bit
    is set if it is set in over half of the shingles' XXH64 values (seed 42).
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    joined = b" ".join(words)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 100_000):
        h = np.fromiter([digest(joined[a:b], 42) for a, b in zip(starts[at : at + 100_000], stops[at : at + 100_000])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fp", shingle: int = 3, keep_text: bool = False) -> DataFrame:
    """docs, by default without the text, with the fingerprint as a signed long in `out` (replaced if it is there)."""
    keep = [c for c in docs.columns if c != out and (keep_text or c != text_col)]
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = rows.select(*keep).schema.add(out, "long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in b.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fps], names=schema.names)
        pa.default_memory_pool().release_unused()  # the worker stays, and shares its executor's memory

    return rows.mapInArrow(run, schema)


def gray_rank(fp: Column) -> Column:
    """Place of a code word in the reflected Gray sequence, as a long that sorts like the unsigned rank."""
    r = fp
    for s in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, s))
    return r.bitwiseXOR(F.lit(-(1 << 63)))


class GrayTree:
    """Groups of neighbours in Gray order, level over level, each with the bits that all below it share.

    A node is known by the AND and the OR of what is below: bits where these agree are its pattern.
    Going down, only bits that the parent didn't already share are compared and their differences
    added up; a group whose sum is over the limit, or that differs in a bit of `lead`, is left with
    all below it. A leaf is a fingerprint or, in the upper tree, a whole part of the index.
    """

    def __init__(self, low: np.ndarray, high: np.ndarray, fan: int = 8, lead: int = 0):
        self.fan, self.lead = fan, np.uint64(lead)
        self.levels = [(low.astype(np.uint64), high.astype(np.uint64))]
        while len(self.levels[-1][0]) > fan:
            a, o = self.levels[-1]
            at = np.arange(0, len(a), fan)
            self.levels.append((np.bitwise_and.reduceat(a, at), np.bitwise_or.reduceat(o, at)))

    def search(self, queries: np.ndarray, limit: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query number, leaf number) of leaves within limit of a query, in blocks of bounded size."""
        queries = queries.astype(np.uint64)
        top = len(self.levels) - 1
        width = len(self.levels[top][0])
        if not width or not len(queries):
            return
        step = max(1, most // width)
        for at in range(0, len(queries), step):
            q = np.repeat(np.arange(at, min(at + step, len(queries))), width)
            node = np.tile(np.arange(width), len(q) // width)
            yield from self._down(queries, top, q, node, np.zeros(len(q), np.int64), np.zeros(len(q), np.uint64), limit, most)

    def _down(self, queries, level, q, node, sums, known, limit, most):
        a, o = self.levels[level]
        shared = ~(a[node] ^ o[node])
        apart = (queries[q] ^ a[node]) & shared & ~known
        sums = sums + np.bitwise_count(apart)
        near = (sums <= limit) & (apart & self.lead == 0)
        q, node, sums, shared = q[near], node[near], sums[near], shared[near]
        if level == 0:
            if len(q):
                yield q, node
            return
        step = max(1, most // self.fan)
        size = len(self.levels[level - 1][0])
        for at in range(0, len(q), step):
            part = slice(at, at + step)
            child = (node[part][:, None] * self.fan + np.arange(self.fan)).ravel()
            real = child < size
            again = lambda x: np.repeat(x[part], self.fan)[real]  # noqa: E731, B023
            yield from self._down(queries, level - 1, again(q), child[real], again(sums), again(shared), limit, most)


def turns(limit: int) -> list[tuple[int, int]]:
    """(bits to turn left by, mask of leading bits) of each table: the leading bits of limit + 1 tables share out the 64."""
    cuts = [64 * t // (limit + 1) for t in range(limit + 2)]
    return [(at, ((1 << (end - at)) - 1) << (64 - end + at)) for at, end in zip(cuts, cuts[1:])]


def turned(fp: Column, by: int) -> Column:
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by)) if by else fp


def near_edges(codes: DataFrame, limit: int = 2, part_rows: int | None = None) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (column fp, distinct, not null) within `limit` bits.

    There are limit + 1 tables, each with the fingerprints turned so that other bits lead. At most `limit`
    bits differ, so in one table at least two near fingerprints agree in all leading bits, and stand
    in the same run of its Gray order: a table is searched for those alone. So a fingerprint visits
    few parts however many there are. Each table is dealt into parts by ranges of Gray rank. The bits that an eighth of a part
    shares form the leaves of an upper tree, which is sent to all; it tells each fingerprint which
    parts it must visit. A part has part_rows fingerprints, or by default the square root of their
    number (8000 at least), so the upper trees have no more than some eight times that root of rows a table. In a part the residents build a tree of their own and visitors stream through it.
    Residents that are linked are merged in place, so a dense group gives an edge a member and not
    an edge a pair.
    """
    spark = codes.sparkSession
    n = codes.count()
    part_rows = part_rows or max(8000, math.isqrt(n))
    tables = turns(limit)
    parts, eighth = max(1, -(-n // part_rows)) * len(tables), max(1, part_rows // 8)
    schema = "part long, visit boolean, fp long"

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, at = TaskContext.get().partitionId(), 0
        for b in batches:
            part = task * len(tables) + b.column("t").to_numpy().astype(np.int64)  # a task may hold the end of one table and the start of the next
            leaf = np.arange(at, at + b.num_rows, dtype=np.int64) // eighth
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(leaf), b.column("fp")], names=["part", "leaf", "fp"])
            at += b.num_rows

    each = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), turned(F.col("fp"), by).alias("fp")) for t, (by, _) in enumerate(tables)])).alias("c")
    dealt = codes.select(each).select("c.t", "c.fp", gray_rank(F.col("c.fp")).alias("rank")).repartitionByRange(parts, "t", "rank").sortWithinPartitions("t", "rank").select("t", "fp")
    home = scratch(dealt.mapInArrow(number, "part long, leaf long, fp long"), "gray-parts")
    leaves = home.groupBy("part", "leaf").agg(F.bit_and("fp").alias("a"), F.bit_or("fp").alias("o"))
    roots = np.array([(r["part"], r["a"], r["o"]) for r in sorted(leaves.collect(), key=lambda r: (r["part"], r["leaf"]))], np.int64).reshape(-1, 3)  # some eight rows a part
    sent = spark.sparkContext.broadcast(roots)

    def visits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_leaves = sent.value
        upper = []
        for t, (_, lead) in enumerate(tables):
            of = all_leaves[all_leaves[:, 0] % len(tables) == t]
            upper.append((of[:, 0], GrayTree(of[:, 1].view(np.uint64), of[:, 2].view(np.uint64), lead=lead)))
        for b in batches:
            every, home_of = b.column("fp").to_numpy(), b.column("part").to_numpy()
            for t, (numbers, tree) in enumerate(upper):
                mine = home_of % len(tables) == t
                fps, own = every[mine], home_of[mine]
                for q, leaf in tree.search(fps.view(np.uint64), limit):
                    q, there = np.unique(np.stack([q, numbers[leaf]]), axis=1)
                    here = own[q]  # of two parts one visits the other: which, alternates, so parts have like shares
                    go = (there != here) & ((there > here) == ((there // len(tables) + here // len(tables)) % 2 == 0))
                    yield pa.RecordBatch.from_arrays([pa.array(there[go]), pa.array(np.ones(int(go.sum()), bool)), pa.array(fps[q[go]])], names=["part", "visit", "fp"])

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, tree, label, fps = None, [], None, None, None

        def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            by = tables[part % len(tables)][0]
            back = lambda x: ((x.view(np.uint64) >> np.uint64(by)) | (x.view(np.uint64) << np.uint64(64 - by)) if by else x).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(back(a)), pa.array(back(b))], names=["a", "b"])

        def settle() -> pa.RecordBatch:
            nonlocal tree, label, fps
            fps = np.concatenate(held)
            rank = fps.view(np.uint64).copy()
            for s in (1, 2, 4, 8, 16, 32):
                rank ^= rank >> np.uint64(s)
            fps = fps[np.argsort(rank)]
            codes = fps.view(np.uint64)
            tree, label = GrayTree(codes, codes, lead=tables[part % len(tables)][1]), np.arange(len(fps))
            for q, leaf in tree.search(codes, limit):
                label = join_labels(label, q, leaf)
            apart = np.flatnonzero(label != np.arange(len(fps)))
            return edges(fps[apart], fps[label[apart]])

        for b in batches:
            numbers, visiting, values = b.column("part").to_numpy(), b.column("visit").to_numpy(zero_copy_only=False), b.column("fp").to_numpy()
            cuts = np.flatnonzero(np.diff(numbers) | np.diff(visiting.astype(np.int8))) + 1
            for i, j in zip([0, *cuts], [*cuts, len(numbers)]):
                if i == j:
                    continue
                if numbers[i] != part:
                    if held and tree is None:
                        yield settle()
                    part, held, tree = numbers[i], [], None
                if not visiting[i]:
                    held.append(values[i:j])
                    continue
                if tree is None:
                    yield settle()
                some = values[i:j]
                for q, leaf in tree.search(some.view(np.uint64), limit):
                    pairs = np.unique(np.stack([q, label[leaf]]), axis=1)
                    yield edges(some[pairs[0]], fps[pairs[1]])
                    same = np.flatnonzero(np.diff(pairs[0]) == 0)
                    label = join_labels(label, pairs[1][same], pairs[1][same + 1])
        if held and tree is None:
            yield settle()

    both = home.select("part", F.lit(False).alias("visit"), "fp").unionAll(home.select("part", "fp").mapInArrow(visits, schema))
    return both.repartition(parts, "part").sortWithinPartitions("part", "visit").mapInArrow(link, "a long, b long")


def groups(docs: DataFrame, *, id_col: str = "doc_id", fp_col: str = "fp", limit: int = 2, part_rows: int | None = None) -> DataFrame:
    """Add component_id to docs with fingerprints: the smallest ID reachable by links of at most `limit` bits.

    Equal fingerprints are one code, so copies cost no pairs. Rows with a null ID get the component
    of the others of their group (null if there are none); repeated rows are kept; a null
    fingerprint is not linked and its component is its own ID. An empty table stays empty. The input
    is read twice, so give a scratch table.
    """
    codes = scratch(docs.where(F.col(fp_col).isNotNull()).groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least")), "codes")
    linked = components(near_edges(codes.select("fp"), limit, part_rows), "a", "b")
    rooted = codes.join(linked, codes.fp == linked.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("_group_fp"), "component_id")
    keep = [c for c in docs.columns if c != "component_id"]
    out = spread_join(docs.select(*keep), named, [(fp_col, "_group_fp")], "left")  # copies of one text are split
    return out.select(*keep, F.when(F.col("_group_fp").isNull(), F.col(id_col)).otherwise(F.col("component_id")).alias("component_id"))


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, limit: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every document; null and empty texts have fingerprint 0 and are linked by it."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return groups(scratch(with_fingerprint(rows, shingle=shingle), "fingerprints"), limit=limit)


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, limit: int = 3, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, all columns, less all but one row of each group of near copies: the one of the least ID (null IDs last, ties by a hash of the text).

    Links are SimHashes of `shingle` words at most `limit` bits apart, and shingle sets of `words`
    words of at least the Jaccard similarity. Texts without words are linked by their fingerprint of zero. Repeated
    rows are copies of each other; an empty table stays empty; columns of docs may have any name.
    """
    whole = carried(docs, text_col, _id=id_col)
    with owning() as mine:
        rows = scratch(with_fingerprint(whole, "_said", "_fp", shingle, keep_text=True).withColumn("_row", F.monotonically_increasing_id()), "fingerprinted")
        found = groups(rows.select("_row", "_fp"), id_col="_row", fp_col="_fp", limit=limit)
        known = scratch(found.where(F.col("_row") != F.col("component_id")).select(F.col("_row").alias("a"), F.col("component_id").alias("b")), "simhash-links")
        linked = scratch(components(similar_edges(rows, known, text_col="_said", shingle=words, similarity=similarity), "a", "b"), "near-copies")
        clear_scratch(docs.sparkSession, mine, keep=(rows, linked))
    members = rows.select("_row", "_id", F.xxhash64("_said").alias("_tie")).join(linked, F.col("_row") == F.col("node"))
    first = members.groupBy("root").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_tie").alias("tie"), F.col("_row").alias("row")))["row"].alias("stays"))
    gone = linked.join(first.select(F.col("root").alias("r"), "stays"), F.col("root") == F.col("r")).where("node <> stays").select("node")
    gone = scratch(gone, "gone")
    drop_scratch(linked)
    return among(rows, "_row", gone, of="node", keep=False).transform(restored, docs.columns, text_col)
