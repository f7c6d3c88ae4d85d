"""URL rules through a cascade of Bloom filters: exact membership of all keys that a corpus can ask for, without joins."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixolve.llm.common import drop_scratch, scratch

#: More levels than this mean that two keys agree in all 128 bits of their hashes.
MOST_LEVELS = 100


def key_hashes(key: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a key, from which every level draws its own places."""
    return F.xxhash64(key), F.xxhash64(key, F.lit("second"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Bloom:
    """One level: `bits` bits in 64-bit words, `hashes` places a key, drawn anew for each level."""

    level: int
    bits: int
    hashes: int
    words: np.ndarray

    @classmethod
    def empty(cls, level: int, keys: int, rate: float) -> Bloom:
        """A filter that lets pass about `rate` of the keys that aren't among its `keys`."""
        bits = 64 * max(1, math.ceil(keys * -math.log(rate) / math.log(2) ** 2 / 64))
        return cls(level, bits, max(1, round(bits / max(keys, 1) * math.log(2))) if keys > 8 else max(1, round(-math.log2(rate))), np.zeros(bits // 64, np.uint64))

    def places(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        salt = _mixed(np.array([self.level], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        a, b = _mixed(h1.view(np.uint64) ^ salt), _mixed(h2.view(np.uint64) + salt) | np.uint64(1)
        for i in range(self.hashes):
            yield (a + np.uint64(i) * b) % np.uint64(self.bits)

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), bool)
        for at in self.places(h1, h2):
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return out


@dataclass
class Cascade:
    """Levels that encode, in turn, the listed keys, the other keys that pass, the listed ones that pass again, and so on.

    A key that stops at an odd level (the first is 1) isn't listed, one that stops at an even level is; of those that pass all, no
    key of the universe is of the kind that the next level would have held.
    """

    levels: list[Bloom] = field(default_factory=list)

    @property
    def size(self) -> int:
        return sum(b.words.nbytes for b in self.levels)

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h1), bool)
        open_ = np.arange(len(h1))
        for i, level in enumerate(self.levels):
            passed = level.has(h1[open_], h2[open_])
            out[open_[~passed]] = i % 2 == 1
            open_ = open_[passed]
        out[open_] = len(self.levels) % 2 == 1
        return out


def _filled(bloom: Bloom, keys: DataFrame) -> Bloom:
    """The bits of keys (columns h1, h2), joined by OR where they lie, then word by word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for at in bloom.places(b.column("h1").to_numpy(), b.column("h2").to_numpy()):
                word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
                order = np.argsort(word, kind="stable")
                first = np.flatnonzero(np.diff(word[order], prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array(word[order][first]), pa.array(np.bitwise_or.reduceat(bit[order], first).view(np.int64) if len(first) else np.zeros(0, np.int64))], names=["word", "bits"])

    words = keys.select("h1", "h2").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()  # bits / 64 rows, bounded by the list's block
    bloom.words[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return bloom


def _passing(keys: DataFrame, bloom: Bloom) -> DataFrame:
    """The keys that a level lets pass, all columns."""
    sent = keys.sparkSession.sparkContext.broadcast(bloom)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sent.value.has(b.column("h1").to_numpy(), b.column("h2").to_numpy())))

    return keys.mapInArrow(run, keys.schema)


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade over the distinct keys (column key) of both: exact for every key of the universe.

    The first level lets pass so many of the universe's other keys as there are listed ones, at most a
    half; the others let pass a half. Keys that pass are written to the shared folder, each level
    reads those of the level before the last: half as many each time.
    """
    h1, h2 = key_hashes(F.col("key"))
    listed = scratch(listed.where("key is not null").select("key").distinct().withColumn("h1", h1).withColumn("h2", h2), "listed")
    others = universe.where("key is not null").select("key").distinct().withColumn("h1", h1).withColumn("h2", h2)
    n, cascade = listed.count(), Cascade()
    if not n:
        return cascade
    first = _filled(Bloom.empty(1, n, min(0.5, max(n / max(universe.count(), 1), 1e-4))), listed)
    cascade.levels.append(first)
    # of the universe only what passes the first level is set against the list
    now = scratch(_passing(others, first).join(listed.select(F.col("key").alias("k")), F.col("key") == F.col("k"), "left_anti"), "passing")
    waiting = listed
    while n := now.count():
        if len(cascade.levels) == MOST_LEVELS:
            raise ValueError("two keys have the same hashes")
        level = _filled(Bloom.empty(len(cascade.levels) + 1, n, 0.5), now)
        cascade.levels.append(level)
        now, before, waiting = scratch(_passing(waiting, level), "passing"), waiting, now
        drop_scratch(before)
    drop_scratch(now)
    drop_scratch(waiting)
    return cascade


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (between the first :// and /, ?, # or the end, A-Z lower-cased) and path (from there to ?, # or the end); both '' without ://, for null too."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\.")).cast("int")


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys under which rules could stand that fit: for each shape (labels, characters) the host's last labels and the path's first characters, longest key first."""
    found = [F.when((_labels(host) >= k) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, m))) for k, m in shapes]
    return F.sort_array(F.filter(F.transform(F.array_distinct(F.array(*found)), lambda k: F.struct(F.length(k).alias("size"), k.alias("key"))), lambda s: s["key"].isNotNull()), False)


def judge(urls: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow", block_rows: int = 4_000_000, most_shapes: int = 500) -> DataFrame:
    """urls with host, path, rule and verdict.

    rules: verdict (any word, such as block and allow), host, path. A rule fits its host and all its subdomains where the URL's path starts with the
    rule's; the longest rule wins (of equally long ones, by different hosts, the greater string; of one rule with several verdicts, the
    greatest verdict). Without a rule `rule` is null and the verdict `default`. Rules with null host are
    ignored, a null path is ''; hosts of rules are lower-cased; a rule with an empty host fits nothing.

    Each verdict has a cascade over its rules and all keys under which the URLs could be listed, so a
    URL is judged where it lies. Rules beyond `block_rows` (some 10 MB of filters) are taken a block
    after the other, each a pass over what the passes before wrote; more than `most_shapes` pairs of (labels of a host, length of a path) among rules raise.
    Null URLs have an empty host and path; repeated rows are kept; an empty table stays empty; other
    columns are kept but those named host, path, rule and verdict.
    """
    low = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = rules.where("host is not null and host <> ''").select(low.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    known = scratch(known.groupBy(F.concat("host", "path").alias("key")).agg(F.max("verdict").alias("verdict"), F.max(_labels(F.col("host"))).alias("labels"), F.max(F.length("path")).alias("chars")), "rules")
    shapes = [tuple(r) for r in known.select("labels", "chars").distinct().limit(most_shapes + 1).collect()]
    if len(shapes) > most_shapes:
        raise ValueError(f"more than {most_shapes} shapes of rules")
    verdicts = [r[0] for r in known.groupBy("verdict").count().orderBy("verdict").limit(100).collect()]
    keep = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(url_col))
    rows = urls.select(F.struct(*[F.col(c) for c in keep]).alias("_row"), host.alias("_host"), path.alias("_path"))
    rows = rows.withColumn("_best", F.lit(None).cast("struct<size:int,key:string,verdict:string>"))
    keys = candidates(F.col("_host"), F.col("_path"), shapes) if shapes else F.array().cast("array<struct<size:int,key:string>>")
    universe = scratch(rows.select(F.explode(keys).alias("k")).select("k.key").distinct(), "universe")
    blocks = 1 + known.count() // block_rows
    for k in range(blocks):
        mine = lambda df: df.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == k)  # noqa: B023, E731
        for verdict in verdicts:
            cascade = build(mine(known.where(F.col("verdict") == verdict)), mine(universe))
            rows = _judged(rows, keys, cascade, verdict, (k, blocks))
        if blocks > 1:
            rows = scratch(rows, "judged")
    best = F.col("_best")
    return rows.select("_row.*", F.col("_host").alias("host"), F.col("_path").alias("path"), best["key"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))


def _judged(rows: DataFrame, keys: Column, cascade: Cascade, verdict: str, block: tuple[int, int]) -> DataFrame:
    """rows, _best replaced by the longest candidate that the cascade lists, if that is longer."""
    if not cascade.levels:
        return rows
    sent = rows.sparkSession.sparkContext.broadcast(cascade)

    @F.arrow_udf("array<boolean>")
    def is_listed(h1: pa.Array, h2: pa.Array) -> pa.Array:
        ends = np.cumsum([0, *pc.list_value_length(h1).to_numpy(zero_copy_only=False)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(sent.value.listed(h1.flatten().to_numpy(), h2.flatten().to_numpy())))

    k, blocks = block
    mine = F.filter(keys, lambda s: F.pmod(F.xxhash64(s["key"]), F.lit(blocks)) == k) if blocks > 1 else keys
    asked = rows.withColumn("_keys", mine)
    asked = asked.withColumn("_listed", is_listed(F.transform("_keys", lambda s: key_hashes(s["key"])[0]), F.transform("_keys", lambda s: key_hashes(s["key"])[1])))
    hit = F.filter("_keys", lambda s, i: F.element_at("_listed", i + 1))
    found = F.when(F.size(hit) > 0, F.struct(hit[0]["size"].alias("size"), hit[0]["key"].alias("key"), F.lit(verdict).alias("verdict")))
    return asked.withColumn("_best", F.greatest("_best", found)).drop("_keys", "_listed")
