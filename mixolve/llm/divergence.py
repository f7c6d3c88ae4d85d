"""Divergence of sources within a language: smoothed term shares compared between all pairs of sources."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from mixolve.llm.common import ranked, scratch, spread_join
from mixolve.llm.tokens import slices

#: What a byte of a text becomes before it is cut at spaces: A-Z lower-cased, other letters and all
#: bytes of non-ASCII characters as they are, the rest a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))

#: Shares are whole numbers of this.
UNIT = 1_000_000_000
#: Added to each count.
PSEUDO = 5


def words(text: bytes, most: int = 4 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, some `most` bytes at a time, so that a very long one is never a list of all its words."""
    text, at = text.translate(FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + most)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", entries: int = 500_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, several rows a key.

    A task counts into a table of at most `entries` terms before it hands them on, so a hot source
    shuffles few rows. Each (lang, source) of a task also gives a row with a null term, so that groups
    without terms are there. Null texts, languages and sources are ''.
    """
    kept = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def rows(held: dict) -> pa.RecordBatch:
        sizes = [len(count) + 1 for count, _ in held.values()]
        name = lambda i: pa.chunked_array([pa.repeat(group[i], n) for group, n in zip(held, sizes)], pa.string()).combine_chunks()
        flat = lambda parts, end, kind: pa.chunked_array([pa.array([*part, end], kind) for part in parts]).combine_chunks()
        terms = flat((count for count, _ in held.values()), None, pa.binary()).cast(pa.string())
        n, docs = flat((count.values() for count, _ in held.values()), 0, pa.int64()), flat((map(seen.get, count) for count, seen in held.values()), 0, pa.int64())
        return pa.RecordBatch.from_arrays([name(0), name(1), terms, n, docs], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for few in slices(batch, "text"):
                groups = zip(few.column("lang").to_pylist(), few.column("source").to_pylist())
                for group, text in zip(groups, pc.cast(few.column("text"), pa.binary())):
                    count, seen = held.setdefault(group, (Counter(), Counter()))
                    size -= len(count)
                    here: set[bytes] = set()
                    for some in words(text.as_py()):
                        count.update(some)
                        here.update(some)
                    seen.update(here)
                    size += len(count)
                    if size > entries:
                        yield rows(held)
                        held, size = {}, 0
        if held:
            yield rows(held)
        pa.default_memory_pool().release_unused()  # the worker stays, and shares its executor's memory

    return kept.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + PSEUDO) / (total + PSEUDO * terms)), exact beyond 64 bits."""
    wide = lambda c, digits: c.cast(f"decimal({digits},0)")
    top = wide(F.lit(UNIT), 10) * wide(count + PSEUDO, 20)
    bottom = wide(total, 20) + wide(F.lit(PSEUDO), 1) * wide(terms, 19)
    return F.call_function("div", top, bottom) + 1


def kept_counts(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n) of the terms in at least `least_docs` documents of their language, with total (n in the language) and spread (its sources)."""
    per = W.partitionBy("lang", "term")
    kept = counts.where("term is not null").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return kept.select("*", *[f(c).over(per).alias(o) for f, c, o in ((F.sum, "n", "total"), (F.sum, "docs", "held"), (F.count, "n", "spread"))]).where(F.col("held") >= least_docs).drop("docs", "held")


def _tile(table: pa.Table) -> pa.Table:
    """Partial sums for pairs of groups of two blocks from the rows of one tile (see pair_sums)."""
    first = {c: table.column(c)[0].as_py() for c in ("lang", "a", "b", "chunk")}
    kind, g, p, n, block, terms = (table.column(c).to_numpy() for c in ("kind", "g", "p", "n", "block", "terms"))
    base = np.flatnonzero(kind == 2)
    base = base[np.argsort(g[base])]
    groups, at, of = g[base], p[base], block[base]
    left, right = np.flatnonzero(of == first["a"]), np.flatnonzero(of == first["b"])
    sums = np.zeros((len(groups), len(right)), np.int64)
    gap = np.abs(at[:, None] - at[right][None])
    if first["chunk"] == 0:
        sums += terms[base[0]] * gap
    heavy = kind == 0
    if heavy.any():  # a dense tile: all groups of both blocks, by term, less what the line above counts
        _, term = np.unique(table.column("term").filter(pa.array(heavy)).combine_chunks().dictionary_encode().indices.to_numpy(), return_inverse=True)
        dense = np.repeat(at[:, None], term.max() + 1, axis=1)
        dense[np.searchsorted(groups, g[heavy]), term] = p[heavy]
        for i in left:
            sums[i] += np.abs(dense[i] - dense[right]).sum(axis=1) - dense.shape[1] * gap[i]
    light = np.flatnonzero(kind == 1)
    light = light[np.argsort(g[light], kind="stable")]
    begin, end = (np.searchsorted(g[light], groups, side) for side in ("left", "right"))
    for mine, others, flip in ((left, right, False), (right, left, True)):  # what a posting changes against a group without the term
        for i in mine:
            his = light[begin[i] : end[i]]
            if len(his):
                step = ((np.abs(p[his][:, None] - at[others][None]) - np.abs(at[i] - at[others])[None]) * n[his][:, None]).sum(axis=0)
                if flip:
                    sums[others, np.searchsorted(right, i)] += step
                else:
                    sums[i] += step
    x, y = np.repeat(left, len(right)), np.tile(right, len(left))
    once = x < y
    x, y = x[once], y[once]
    return pa.table({
        "lang": pa.array([first["lang"]] * len(x), pa.string()), "g": pa.array(groups[x], pa.int64()), "o": pa.array(groups[y], pa.int64()),
        "f": pa.array(sums[x, np.searchsorted(right, y)], pa.int64()),
    })


def pair_sums(postings: DataFrame, groups: DataFrame, *, block: int = 512) -> DataFrame:
    """(lang, g, o, f) for g < o: the sum over all kept terms of |p of g - p of o|, exact.

    postings: lang, term, g, p, base, heavy (whether the term is in many groups), spread (in how many),
    dense_chunks, value_chunks, last (the language's last block of groups); groups: lang, g, base (a group's p where a
    term doesn't occur), terms (kept terms of the language) and the last three. Were no term anywhere, f would be
    terms * |base difference|. To that come, for heavy terms, dense tiles of groups by terms; for light terms, what a posting changes
    against a group without the term, from counts of equal p, and what is left of that in pairs of
    groups that both have it. Tiles hold `block` groups a side and one of the chunks of terms or values.
    """
    blocked, none, zero = F.expr(f"g div {block}"), F.lit(None).cast("string"), F.lit(0).cast("long")
    row = lambda df, kind, chunk, term, p, n: df.select(
        "lang", F.lit(kind).alias("kind"), chunk.alias("chunk"), "g", blocked.alias("block"), term.alias("term"), p.alias("p"), n.alias("n"), "last",
        (F.col("terms") if kind == 2 else zero).alias("terms"),
    )
    few = postings.where("not heavy").groupBy("lang", "g", "p", "last", "value_chunks").agg(F.count("*").alias("n"))
    every = F.explode(F.sequence(zero, F.greatest("dense_chunks", "value_chunks") - 1))
    rows = (
        row(postings.where("heavy"), 0, F.pmod(F.xxhash64("term"), F.col("dense_chunks")), F.col("term"), F.col("p"), zero)
        .unionAll(row(few, 1, F.pmod(F.xxhash64("p"), F.col("value_chunks")), none, F.col("p"), F.col("n")))
        .unionAll(row(groups, 2, every, none, F.col("base"), zero))
    )
    # a group's block meets each block: as the first of the pair up to its own place, as the second from it on
    rows = rows.withColumn("other", F.explode(F.sequence(zero, F.col("last")))).withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other"))
    tiles = rows.groupBy("lang", "chunk", "a", "b").applyInArrow(_tile, "lang string, g long, o long, f long")
    both = postings.where("not heavy and spread > 1").groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "base")).alias("has"))  # as many as a light term's groups
    pair = both.select("lang", F.explode("has").alias("x"), "has").select("lang", "x", F.explode(F.filter("has", lambda y: y["g"] > F.col("x.g"))).alias("y"))
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    fixes = pair.select("lang", F.col("x.g").alias("g"), F.col("y.g").alias("o"), (gap("x.p", "y.p") - gap("x.p", "y.base") - gap("y.p", "x.base") + gap("x.base", "y.base")).alias("f"))
    return tiles.unionAll(fixes).groupBy("lang", "g", "o").agg(F.sum("f").alias("f"))


def with_groups(counts: DataFrame, kept: DataFrame, *, light: int, block: int, terms_per_chunk: int, values_per_chunk: int) -> DataFrame:
    """A row for each (lang, source): its number g, base, totals, and how its language's terms are cut up.

    A term is heavy if more than max(`light`, a sixteenth of the language's groups) have it (`most`).
    """
    some = lambda *names: [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names]
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("own_total"), F.countDistinct("n").alias("values"))
    named = counts.select("lang", "source").distinct().join(own, ["lang", "source"], "left").select("lang", "source", *some("own_total", "values"))
    of_lang = named.groupBy("lang").agg(F.sum("own_total").alias("lang_total"), F.max("values").alias("values"), F.greatest(F.lit(light), F.expr("count(*) div 16")).alias("most"), F.count("*").alias("many"))
    # one row for each number of groups that terms of a language have
    spread = kept.groupBy("lang", "term").agg(F.first("spread").alias("spread")).groupBy("lang", "spread").agg(F.count("*").alias("terms")).join(of_lang.select("lang", "most"), "lang")
    cut = spread.groupBy("lang").agg(F.sum("terms").alias("terms"), F.sum(F.when(F.col("spread") > F.col("most"), F.col("terms"))).alias("dense"))
    of_lang = of_lang.join(cut, "lang", "left").select(
        "lang", "lang_total", "most", *some("terms"), F.expr(f"1 + coalesce(dense, 0) div {terms_per_chunk}").alias("dense_chunks"),
        F.expr(f"1 + coalesce(values, 0) div {values_per_chunk}").alias("value_chunks"), F.expr(f"(many - 1) div {block}").alias("last"),
    )
    full = named.drop("values").join(of_lang, "lang")
    base = F.when(F.col("terms") > 0, share(F.lit(0), F.col("own_total"), F.greatest("terms", F.lit(1)))).otherwise(0)
    return ranked(full, ["lang"], ["source"], "g").withColumn("base", base)


def audit(docs: DataFrame, *, least_docs: int = 30, top: int = 50, light: int = 8, block: int = 512, terms_per_chunk: int = 512, values_per_chunk: int = 4096, **columns: str) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from the others, and by which terms.

    Terms are runs of letters (all non-ASCII characters count as such), A-Z lower-cased; a language keeps those in at
    least `least_docs` of its documents. p = 1 + floor(UNIT * (count + PSEUDO) / (N + PSEUDO * V)), N the counts of
    the source's kept terms, V their number in the language. Part `pair`: item is each other source,
    value the sum of |p - its p| over all kept terms (0 without any). Part `term`: the `top` terms that
    occur and whose p is greater than the language's, value the difference. Equal values rank by
    item in UTF-8 order. Null texts, languages and sources are ''; repeated rows count each; a source
    without terms has its pairs; a language of one source has none; an empty table gives no rows; other
    columns are ignored.
    """
    cuts = {"light": light, "block": block, "terms_per_chunk": terms_per_chunk, "values_per_chunk": values_per_chunk}
    counts = scratch(term_counts(docs, **columns), "term-counts", compression="zstd")
    kept = scratch(kept_counts(counts, least_docs), "kept-terms", compression="zstd")
    groups = scratch(with_groups(counts, kept, **cuts), "groups")
    right = groups.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[c for c in groups.columns if c not in ("lang", "source")])
    priced = spread_join(kept, right, [("lang", "_lang"), ("source", "_source")])
    p, q = share(F.col("n"), F.col("own_total"), F.col("terms")), share(F.col("total"), F.col("lang_total"), F.col("terms"))
    found = priced.select("lang", "source", "term", "g", p.alias("p"), "base", "spread", (F.col("spread") > F.col("most")).alias("heavy"), "dense_chunks", "value_chunks", "last", (p - q).alias("value"))
    postings = scratch(found, "postings", compression="zstd")
    named = pair_sums(postings, groups, block=block)
    for side, number in (("one", "g"), ("two", "o")):
        names = groups.select(F.col("lang").alias(f"_{side}"), F.col("g").alias(f"_{side}_g"), F.col("source").alias(side))
        named = named.join(names, (F.col("lang") == F.col(f"_{side}")) & (F.col(number) == F.col(f"_{side}_g")))
    turned = F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = named.select("lang", F.explode(turned).alias("_"), "f").select("lang", "_.source", F.lit("pair").alias("part"), "_.item", F.col("f").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = postings.where("value > 0").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionAll(terms)
