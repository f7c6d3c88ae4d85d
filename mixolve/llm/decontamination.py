"""Benchmark decontamination by winnowed k-gram fingerprints and extended hits."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mixolve.llm.common import carried, named, restored, scratch

#: Words are runs of 0-9, a-z and everything beyond ASCII, A-Z being lowered first.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Odd multipliers, one for each place in a k-gram, drawn by a rule.
PLACES = np.random.default_rng(17).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


def grams(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each k-gram of ids, whether it is one: 0 marks an unknown word or a border)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    for j in range(k):
        whole &= ids[j : j + n] != 0
        h += mixed[j : j + n] * PLACES[j]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h, whole


def winnow(h: np.ndarray, whole: np.ndarray, w: int) -> np.ndarray:
    """Places of the least hash (the last of equals) in each run of w whole k-grams."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    full = np.cumsum(np.concatenate([[0], whole]))
    at = np.flatnonzero(full[w:] - full[:-w] == w)
    least, place = h[at], at.copy()
    for j in range(1, w):
        other = h[at + j]
        lower = other <= least
        least, place = np.where(lower, other, least), np.where(lower, at + j, place)
    return np.unique(place)


class Index:
    """Fingerprints of a block of benchmark items, and the items' windows to extend hits to.

    An item's windows are its runs of `window` words, or all its words if it has fewer. With k-grams
    kept as the minimum of window - k + 1 neighbours, any shared run of window words shares a kept
    k-gram. Shorter items are looked up by the hash of all their words. Windows of the same words are
    one class with a set of items, and equal sets are one, so a phrase that many items share is met
    once at each place and not once an item.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int, k: int):
        self.window, self.k = window, k
        self.vocabulary: dict[bytes, int] = {}
        flat: list[int] = [0]
        where: list[int] = [-1]
        self.names: list[str] = []
        short: dict[int, list[int]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not ids:
                continue
            if len(ids) < window:
                short.setdefault(len(ids), []).append(len(flat))
            flat += [*ids, 0]
            where += [len(self.names)] * (len(ids) + 1)
            self.names.append(name)
        self.ids, self.item = np.array(flat, np.int64), np.array(where, np.int64)
        self.sets: list[np.ndarray] = []
        self._known: dict[bytes, int] = {}
        h, whole = grams(self.ids, k)
        self.keys = np.unique(h[winnow(h, whole, window - k + 1)])
        h, whole = grams(self.ids, window)
        self.windows = self._classes(h, np.flatnonzero(whole), window)
        self.short = {n: self._classes(grams(self.ids, n)[0], np.array(at), n) for n, at in short.items()}

    def _classes(self, h: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, a place, number of the set of items) of each class of windows that begin at these places."""
        pairs = np.unique(np.stack([h[at].view(np.int64), self.item[at], at]), axis=1)
        alike = np.flatnonzero(np.diff(pairs[0]) == 0)
        if any((self.ids[pairs[2, alike] + j] != self.ids[pairs[2, alike + 1] + j]).any() for j in range(n)):
            raise ValueError("two windows share a 64-bit hash: draw other multipliers")
        new = np.ones(pairs.shape[1], bool)
        new[1:] = (pairs[0, 1:] != pairs[0, :-1]) | (pairs[1, 1:] != pairs[1, :-1])
        hashes, items, places = pairs[:, new]  # sorted by hash, then item
        heads = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] - 1 if len(hashes) else 0))
        sets = np.empty(len(heads), np.int64)
        for i, (a, z) in enumerate(zip(heads.tolist(), [*heads[1:].tolist(), len(items)])):
            some = items[a:z]
            sets[i] = self._known.setdefault(some.tobytes(), len(self.sets))
            if sets[i] == len(self.sets):
                self.sets.append(some)
        return hashes[heads], places[heads], sets

    def _found(self, ids: np.ndarray, at: np.ndarray, n: int, classes: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(place, set) of those places at which the n words are a window's, compared word for word."""
        hashes, places, sets = classes
        if not len(hashes) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = grams(ids[at[:, None] + np.arange(n)].ravel(), n)[0][::n].view(np.int64)
        k = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        near = np.flatnonzero(hashes[k] == own)
        step = np.arange(n)
        near = near[(ids[at[near][:, None] + step] == self.ids[places[k[near]][:, None] + step]).all(axis=1)]
        return at[near], sets[k[near]]

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, set of items) of every window of an item that stands in the document words."""
        h, whole = grams(ids, self.k)
        at = winnow(h, whole, self.window - self.k + 1)
        at = at[np.isin(h[at], self.keys)]
        at = np.unique(at[:, None] - np.arange(self.window - self.k + 1))  # windows around a shared fingerprint
        at = at[(at >= 0) & (at <= len(ids) - self.window)]
        start, sets = self._found(ids, at, self.window, self.windows)
        found = [(start, start + self.window, sets)]
        for n, classes in self.short.items():
            start, sets = self._found(ids, np.flatnonzero(grams(ids, n)[1]), n, classes)
            found.append((start, start + n, sets))
        return tuple(np.concatenate(x) for x in zip(*found))


def _merge(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def scan(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", out: str = "_leak", item_col: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """Add to docs the struct `out`: n_words, spans (flat, disjoint word ranges that items' windows cover), items.

    The benchmark is broadcast as an index, in blocks of about block_bytes of text each, one pass
    over the documents a block, so one index is held at a time, however large the benchmark. With one block the
    documents are neither written nor shuffled. With more they are written once; a pass writes what it finds of the rows that it hits,
    by row number, and the last pass adds it up. Null and empty texts have no words and no hits; very long ones are
    searched whole; benchmark rows with a
    null ID or no words are ignored; repeated items and rows count as they are; without benchmark
    rows nothing is hit. A column named like `out` is replaced, all others are kept.
    """
    spark = docs.sparkSession
    shape = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
    rows = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    keep = [c for c in docs.columns if c != out]
    known = carried(docs.select(*map(named, keep)), text_col)
    known = known.withColumn("_row", F.monotonically_increasing_id()) if blocks > 1 else known.withColumn("_row", F.lit(None).cast("long"))
    known = known.select("_doc", F.col("_said").alias("_text"), "_row")
    if blocks > 1:
        known = scratch(known, "documents")
    parts: list[DataFrame] = []
    for block in range(blocks):
        mine = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast(Index([(r["item"], r["text"]) for r in mine.collect()], window, k))  # block_bytes of text
        last = block == blocks - 1
        now = known if last else known.select("_row", "_text")
        if last and parts:
            told = reduce(DataFrame.unionAll, parts).groupBy(F.col("_row").alias("_r")).agg(F.flatten(F.collect_list("found.spans")).alias("spans"), F.flatten(F.collect_list("found.items")).alias("items"))
            told = scratch(told.select("_r", F.struct(F.lit(0).cast("long").alias("n_words"), "spans", "items").alias("_found")), "found")  # written, so its size is known: texts are shuffled only where hits are too many to send
            now = now.join(told, F.col("_row") == F.col("_r"), "left").drop("_r")
        shown = T.StructType([*[f for f in now.schema.fields if f.name not in ("_found", "_text", *(() if last else ("_doc",)))], *([now.schema["_text"]] if last else []), T.StructField("found", shape)])

        def run(batches: Iterable[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            index: Index = sent.value
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    yield _scanned(whole.slice(at, 1000), index, shape, last)

        found = now.mapInArrow(run, shown)
        if not last:
            parts.append(scratch(found, "scanned"))
            sent.unpersist()
    return restored(found.withColumnRenamed("_text", "_said"), [*keep, out], text_col, **{out: F.col("found")})


def _scanned(batch: pa.RecordBatch, index: Index, shape: T.StructType, last: bool) -> pa.RecordBatch:
    """The batch with `found` for each row, joined with what _found has of earlier passes; before the last pass, row numbers and findings of the rows hit alone."""
    from pyspark.sql.pandas.types import to_arrow_type

    words = [words_of(t) for t in batch.column("_text").to_pylist()]
    n = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(n + 1) - n  # a border before each document
    flat = np.zeros(int((n + 1).sum()) + 1, np.int64)
    if len(words):
        inside = np.ones(len(flat), bool)
        inside[first - 1] = False
        inside[-1] = False
        flat[inside] = np.fromiter(map(index.vocabulary.get, chain.from_iterable(words), repeat(0)), np.int64, int(n.sum()))
    start, end, sets = index.hits(flat)
    doc = np.searchsorted(first, start, "right") - 1
    earlier = batch.column("_found").to_pylist() if "_found" in batch.schema.names else [None] * len(words)
    spans: dict[int, list] = {}
    items: dict[int, set] = {}
    for d, a, b in np.unique(np.stack([doc, start - first[doc], end - first[doc]]), axis=1).T.tolist():
        spans.setdefault(d, []).append((a, b))
    for d, k in np.unique(np.stack([doc, sets]), axis=1).T.tolist():
        items.setdefault(d, set()).update(map(index.names.__getitem__, index.sets[k].tolist()))
    for d, e in enumerate(earlier):
        if e:
            spans.setdefault(d, []).extend(zip(e["spans"][::2], e["spans"][1::2]))
            items.setdefault(d, set()).update(e["items"])
    which = range(len(words)) if last else sorted(items)
    found = [{"n_words": int(n[d]), "spans": _merge(spans.get(d, [])), "items": sorted(items.get(d, ()))} for d in which]
    kept = [c for c in ("_doc", "_row", "_text") if c in batch.schema.names] if last else ["_row"]
    some = batch if last else batch.take(pa.array(list(which), pa.int64()))
    return pa.RecordBatch.from_arrays([*[some.column(c) for c in kept], pa.array(found, to_arrow_type(shape))], names=[*kept, "found"])


def report(scanned: DataFrame, out: str = "_leak", id_col: str = "doc_id") -> DataFrame:
    """A row for each document: words, words hit, items found and whether there are any."""
    spans = F.col(f"{out}.spans")
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: x - s)  # e1-(s1-0)... alternating sum
    return scanned.select(
        F.col(id_col).alias("doc_id"), F.col(f"{out}.n_words").alias("n_words"), hit.alias("n_hit"),
        F.size(f"{out}.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.col(f"{out}.items")), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def drop_hit(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns whatever their names, that hold no window of a benchmark item."""
    scanned = scan(carried(docs, text_col), benchmark, text_col="_said", **how)
    return restored(scanned.where(F.size("_leak.items") == 0), docs.columns, text_col)
