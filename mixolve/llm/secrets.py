"""Secret scans: base patterns, and multipart credentials linked by interval joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixolve.llm.common import carried, restored, scratch, spread_join

#: Kinds in their order. The first three are the base; of the others a span is reported only where
#: complementary parts stand within its scope.
KINDS = ["assign", "access", "hex", "secret", "ident", "endpoint"]
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
SECRET = r"[A-Za-z0-9+/_-]{32,}"
IDENT = r"""(?:[aA]ccess_?[kK]ey(?:_?[iI]d)?|[cC]lient_?[iI]d|[aA]ccount(?:_?[iI]d)?|[uU]ser(?:_?name)?|[lL]ogin)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}"""
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~%/-]*)?"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once however often body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running combination (sum, maximum) of an array of ints: root-n chunks are folded, then shifted by the chunks before."""

    def folded(chunk: Column) -> Column:
        return F.aggregate(F.slice(chunk, 2, F.size(chunk)), F.slice(chunk, 1, 1), lambda out, x: F.array_append(out, combine(F.element_at(out, -1), x)))

    def shifted(inner: Column) -> Column:
        last = F.transform(inner, lambda c: F.element_at(c, -1))
        before = F.concat(F.array(F.lit(None).cast("int")), folded(last))
        return F.flatten(F.zip_with(inner, F.slice(before, 1, F.size(inner)), lambda c, b: F.transform(c, lambda x: F.when(b.isNull(), x).otherwise(combine(b, x)))))

    def split(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        return bound(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / w).cast("int")), lambda k: bound(F.slice(v, k * w + 1, w), folded)))

    return bound(values, lambda v: F.when(F.size(v) > 0, bound(split(v), shifted)).otherwise(v))


def _places(text: Column, pattern: str, hits: Column, good: Column | None = None) -> Column:
    """array<struct<start,end>> of a pattern's matches, leftmost and not overlapping, in code points.

    What lies between matches is what split() leaves, so running sums of lengths give the places;
    `good` (array of boolean) says which matches count. The work is in proportion to the text and n ** 1.5 of its matches.
    """
    sizes = F.transform(hits, F.length)
    gaps = F.transform(F.slice(F.split(text, pattern), 1, F.size(hits)), F.length)
    ends = running(F.zip_with(gaps, sizes, lambda g, n: g + n), lambda a, b: a + b)
    told = F.arrays_zip(ends.alias("end"), sizes.alias("size"), (good if good is not None else F.transform(hits, lambda h: F.lit(True))).alias("good"))
    found = F.transform(F.filter(told, lambda x: x["good"]), lambda x: F.struct((x["end"] - x["size"]).alias("start"), x["end"].alias("end")))
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def find_parts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with _key and, for each kind, an array of spans (_assign, ...), in one pass over the texts.

    _key, a hash of the row's text, is null unless parts of different kinds could be linked.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "secret": SECRET, "ident": IDENT, "endpoint": ENDPOINT}
    hits = docs.select("*", *[F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_h_{k}") for k, p in every.items()])
    long = F.when(F.size("_h_assign") > 0, F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1)), lambda v: F.length(v) >= 6)).otherwise(F.array().cast("array<boolean>"))
    mixed = F.transform("_h_secret", lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]"))
    spans = {k: _places(text, p, F.col(f"_h_{k}"), long if k == "assign" else mixed if k == "secret" else None).alias(f"_{k}") for k, p in every.items()}
    some = lambda *ks: F.greatest(F.lit(0), *[F.size(F.col(f"_h_{k}")) for k in ks]) > 0
    linkable = some("assign", "hex", "secret") & some("access", "ident", "endpoint")
    return hits.select(*docs.columns, F.when(linkable, F.md5(text.cast("binary"))).alias("_key"), *spans.values())


def numbered(kinds: list[str]) -> Column:
    """The spans of several kinds' columns in one array, as struct<start, kind, end>."""

    def of(kind: str) -> Column:
        return F.transform(f"_{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))

    return F.concat(*map(of, kinds))


def link(parts: DataFrame, scope: int = 256) -> DataFrame:
    """(key, linked) of weak parts that stand within `scope` code points of complementary ones.

    A weak secret (long random-looking run) counts beside an access identifier or an endpoint; a
    weak identifier beside a secret; an endpoint beside a secret and an identifier. The interval
    join is an equi-join on text and scope-wide bins, those that the left part lies in and those that
    the right part reaches with the scope, and keeps left rows once (semi-join): no pairs are made.
    """
    once = parts.where(F.col("_key").isNotNull()).select(F.col("_key").alias("key"), *[f"_{k}" for k in KINDS]).dropDuplicates(["key"])
    rows = once.select("key", F.explode(numbered(KINDS)).alias("p")).select("key", "p.*")
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    covered = rows.where(F.col("kind") < 3).select(F.col("key").alias("ck"), F.col("start").alias("cs"), F.col("end").alias("ce")).withColumn("cb", bins(F.col("cs"), F.col("ce") - 1))
    inside = (F.col("key") == F.col("ck")) & (F.floor(F.col("start") / scope) == F.col("cb")) & (F.col("start") >= F.col("cs")) & (F.col("start") < F.col("ce"))
    weak_secret = rows.where(F.col("kind") == 3).join(covered, inside, "left_anti")  # not what the base has found already
    pool = rows.where(F.col("kind") != 3).unionByName(weak_secret)
    right = pool.select(F.col("key").alias("rk"), F.col("kind").alias("rkind"), F.col("start").alias("rs"), F.col("end").alias("re")).withColumn("rb", bins(F.col("rs") - scope, F.col("re") + scope))
    close = (F.col("key") == F.col("rk")) & (F.col("bin") == F.col("rb")) & (F.col("rs") - F.col("end") <= scope) & (F.col("start") - F.col("re") <= scope)

    def beside(left: DataFrame, kinds: list[int]) -> DataFrame:
        placed = left.withColumn("bin", bins(F.col("start"), F.col("end")))
        return placed.join(right.where(F.col("rkind").isin(kinds)), close, "left_semi").drop("bin").distinct()

    secrets, idents = [0, 2, 3], [1, 4]
    linked = beside(weak_secret, [*idents, 5])
    linked = linked.unionByName(beside(rows.where(F.col("kind") == 4), secrets))
    linked = linked.unionByName(beside(beside(rows.where(F.col("kind") == 5), secrets), idents))
    return linked.groupBy("key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def scan(docs: DataFrame, *, text_col: str = "text", keep_text: bool = False, scope: int = 256) -> DataFrame:
    """docs (without the text, unless it is kept) with `base` and `spans`: arrays of struct<start, kind, end>.

    Both are sorted by start, then kind, which numbers KINDS; `base` has the assign, access and hex
    matches, `spans` the linked weak parts as well. Null and empty texts have none; very long texts with
    any number of matches are searched whole; equal texts have
    the same; repeated rows are reported each; nothing is capped. Columns named base or spans are
    replaced. What is found is written to the shared folder, so texts are searched once.
    """
    keep = [c for c in docs.columns if c not in ("base", "spans") and (keep_text or c != text_col)]
    parts = scratch(find_parts(docs, text_col).select(*keep, "_key", *[f"_{k}" for k in KINDS]), "parts")
    rows = parts.select(*keep, "_key", F.array_sort(numbered(KINDS[:3])).alias("base"))
    alone = rows.where(F.col("_key").isNull()).select(*keep, "base", F.col("base").alias("spans"))
    more = link(parts, scope).withColumnRenamed("key", "_k")
    both = spread_join(rows.where(F.col("_key").isNotNull()), more, [("_key", "_k")], "left")
    return alone.unionAll(both.select(*keep, "base", F.array_sort(F.when(F.col("linked").isNull(), F.col("base")).otherwise(F.concat("base", "linked")))))


def spans_text(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]", block: int = 512) -> Column:
    """text with each run of overlapping spans (sorted by start) replaced by mask.

    The text is cut into blocks once, so that a piece between spans is taken from its own blocks and not
    counted from the text's beginning; a text of any length with any number of spans takes time in proportion.
    """

    def piece(parts: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / block).cast("int"), F.floor((b - 1) / block).cast("int")
        head = F.element_at(parts, first + 1)
        across = F.concat(
            F.substring(head, a - first * block + 1, F.lit(block)), F.array_join(F.slice(parts, first + 2, last - first - 1), ""), F.substring(F.element_at(parts, last + 1), F.lit(1), b - last * block)
        )
        return F.when(a >= b, "").when(first == last, F.substring(head, a - first * block + 1, b - a)).otherwise(across)

    def masked(s: Column) -> Column:
        tops = running(F.transform(s["spans"], lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        before = F.concat(F.array(F.lit(0)), F.slice(tops, 1, F.size(tops) - 1))
        runs = F.filter(F.zip_with(s["spans"], before, lambda x, at: F.struct(x["start"].alias("start"), at.alias("at"))), lambda x: x["start"] >= x["at"])
        kept = F.transform(runs, lambda x: F.concat(piece(s["parts"], x["at"], x["start"]), F.lit(mask)))
        return F.concat(F.array_join(kept, ""), piece(s["parts"], F.array_max(tops), s["length"]))

    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, bound(F.struct(spans.alias("spans"), parts.alias("parts"), F.length(text).alias("length")), masked)).otherwise(text)


def mask_secrets(docs: DataFrame, *, text_col: str = "text", length_col: str = "n_chars", scope: int = 256) -> DataFrame:
    """All rows of docs, all columns whatever their names, secrets masked and length_col, if it is there, counted anew where they are."""
    found = scan(carried(docs, text_col), text_col="_said", keep_text=True, scope=scope)
    found = found.withColumn("_hit", F.size("spans") > 0).withColumn("_said", redact(F.col("_said"), F.col("spans")))
    length = {length_col: F.when(F.col("_hit"), F.length("_said").cast("long")).otherwise(F.col(f"_doc.`{length_col}`"))} if length_col in docs.columns else {}
    return restored(found, docs.columns, text_col, **length)
