"""Main text of web pages: markup where it speaks, a suffix array of the host's pages where it doesn't."""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixolve.llm.common import scratch, spread_join

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is not text, elements that are never main text, and elements without content (fixed values).
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noframes", "noembed"}
CHROME = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "canvas", "object", "head", "audio", "video", "datalist"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "output", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "meta", "link", "source", "track", "param",
}
#: Words of class, id and role that mark what isn't main text (fixed values).
MARKS = set(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer masthead "
    "cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription share sharing social related recommended comment comments respond disqus widget widgets "
    "pagination pager toolbar login signup search contentinfo complementary header reply replies discussion".split()
)
#: Those of them that inside an article may as well name a part of it (fixed values).
DOUBTFUL = set("header masthead banner notice notices alert social widget widgets toolbar search complementary contentinfo promo promotion discussion".split())
#: Words that may stand beside them in a name without saying that it is something else (fixed values).
BESIDE = set(
    "area bar block body bottom box button buttons card cell col column container content footer form global group head header heading icon icons inner item items left line link links list lists "
    "local main mobile module outer page pages panel post posts primary reader readers right row secondary section sections site slot small table text thread title top unit user wide wrap wrapper".split()
)
CLOSED_BY_BLOCK = {"p"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What a block is: unmarked text outside an article, article text, never main text, article text under a doubtful name, text under
#: a name of chrome outside an article, and an article in there. Of the last two blocks() makes one of the others.
OUT, MAIN, SKIP, WEAK, SOFT, INNER = range(6)


def decode(text: str) -> str:
    """Character references decoded, white space runs as one space, trimmed."""
    if "&" in text:
        text = text.replace("&amp;", "&") if text.count("&") == text.count("&amp;") else html.unescape(text)
    return " ".join(text.split())


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def marked(value: str) -> tuple[int, set[str]]:
    """SKIP if a class, id or role names chrome and nothing else, WEAK if it does so beside other words, as in related-work, else OUT; and the words of it that name chrome."""
    found, said = OUT, set()
    for token in value.split():
        parts = [w for w in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", token) if w]
        words = {w.lower() for w in parts if not w.isdigit()}
        if words & MARKS and parts[0].lower() not in ("has", "no", "with", "without", "is"):
            found = SKIP if words <= MARKS | BESIDE else found or WEAK
            said |= words & MARKS if words <= MARKS | BESIDE else set()
    return found, said


def kind_of(name: str, source: str, inside: int) -> int:
    """What an element's text is, by its name, its attributes and what it stands in."""
    article = inside in (MAIN, WEAK, INNER)
    if inside == SKIP or name in CHROME and name != "form" and not (name == "header" and article):
        return SKIP
    found = attributes(source) if source.strip(" /") else {}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return SKIP
    told = [marked(found[a]) for a in ("class", "id", "role") if a in found] if name not in ("html", "body", "main") else []
    mark = max((m for m, _ in told), key=(OUT, WEAK, SKIP).index, default=OUT)
    begins = name in ("article", "main") or found.get("role") in ("main", "article") or found.get("itemprop") == "articleBody"
    if article:
        if name == "form":
            return SKIP
        if mark == OUT or name in HEADINGS or inside == INNER and mark == WEAK:
            return inside
        if mark == SKIP and not set().union(*(w for _, w in told)) <= DOUBTFUL:
            return SKIP
        return WEAK if inside == MAIN else inside
    if begins:
        return SKIP if mark == SKIP else MAIN if inside == OUT else INNER
    return SOFT if mark == SKIP or name == "form" else inside


def settled(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Blocks without SOFT and INNER.

    An article under a name of chrome (a page's frame called right-sidebar) is the article if there is no other, else a card. Text
    under such a name is chrome, but for a page without an article of which it is the larger part: there it is unmarked.
    """
    inner = SKIP if any(k == MAIN for k, _ in found) else MAIN
    found = [(inner if k == INNER else k, t) for k, t in found]
    words = lambda *kinds: sum(len(t.split(" ")) for k, t in found if k in kinds)
    soft = OUT if not words(MAIN) and words(SOFT) > words(OUT) else SKIP
    return [(soft if k == SOFT else k, t) for k, t in found]


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of every block of a page in order, without empty ones; kinds are OUT, MAIN, SKIP and WEAK."""
    source = page or ""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    now, at = OUT, 0

    def close() -> None:
        if held:
            text = decode("".join(held))
            if text:
                out.append((now, text))
            held.clear()

    def pop_to(place: int) -> None:
        nonlocal now
        kind = stack[place - 1][1] if place else OUT
        if kind != now:
            close()
        del stack[place:]
        now = kind

    while True:
        m = TAG.search(source, at)
        if m is None:
            held.append(source[at:])
            break
        if m.start() > at:
            held.append(source[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if name in RAW:
            if not (m[1] or m[4]):
                end = re.compile(f"</{re.escape(name)}", re.I).search(source, at)
                stop = TAG.match(source, end.start()) if end else None
                at = stop.end() if stop else len(source)
            continue
        inline = name in INLINE
        if not inline:
            close()
        if m[1] or m[4]:
            for place in range(len(stack) - 1, -1, -1):
                if stack[place][0] == name:
                    pop_to(place)
                    break
            continue
        if name in VOID:
            continue
        if not inline:
            while stack and stack[-1][0] in CLOSED_BY_BLOCK or stack and name in SIBLINGS and stack[-1][0] in SIBLINGS[name]:
                pop_to(len(stack) - 1)
        kind = kind_of(name, m[3] or m[6] or "", now)
        if inline and kind == now:
            continue
        if kind != now:
            close()
        stack.append((name, kind))
        now = kind
    close()
    return settled(out)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def parse(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """A row for each page: host, page (a hash of its html), and what its blocks say.

    `main` is the article text of a page on which nothing else is open to doubt; of other pages
    `blocks` has all blocks that may be text, (kind, text) in order. `others` has the distinct texts outside the article, `skipped`
    all those that markup drops.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("page", F.xxhash64("html"))
    pair = pa.struct([("kind", pa.int32()), ("text", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                hosts, mains, doubtful, others, skipped = [], [], [], [], []
                for url, page in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
                    found = blocks(page)
                    hosts.append(host_of(url))
                    doubt = any(k in (OUT, WEAK) for k, _ in found)
                    mains.append(None if doubt else " ".join(t for k, t in found if k == MAIN))
                    doubtful.append([{"kind": k, "text": t} for k, t in found if k != SKIP] if doubt else None)
                    others.append(list(dict.fromkeys(t for k, t in found if k != MAIN)))
                    skipped.append([t for k, t in found if k == SKIP])
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id"), b.column("url"), b.column("page"), pa.array(hosts, pa.string()), pa.array(mains, pa.string()), pa.array(doubtful, pa.list_(pair)), *(pa.array(x, pa.list_(pa.string())) for x in (others, skipped))],
                    names=["page_id", "url", "page", "host", "main", "blocks", "others", "skipped"],
                )

    return rows.mapInArrow(run, "page_id long, url string, page long, host string, main string, blocks array<struct<kind:int,text:string>>, others array<string>, skipped array<string>")


def _common(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows of a and b, of which na and nb words count."""
    same = (a == b) & (np.arange(a.shape[1]) < np.minimum(na, nb)[:, None])
    return np.logical_and.accumulate(same, axis=1).sum(axis=1)


def repeats(texts: DataFrame, least: int = 6, depth: int = 8) -> DataFrame:
    """(id, place, length, head): the longest common prefix, of `least` words or more, of each suffix with any other of its host.

    texts: host, id, words (hashes). The suffix array of each host: every suffix of every text, known by its first `depth`
    words, is dealt by range and sorted (suffixes that agree, by text and place), so a host of any size and a key of any number
    of suffixes is spread; neighbours in that order have the longest common prefixes. Where a task's rows end, its first and last suffix go to the
    driver (two rows a task) and are compared there. A repeat of over `depth` words shows as
    overlapping ones. `head` is a hash of the first `least` words.
    """
    spark = texts.sparkSession
    places = F.sequence(F.lit(0), F.size("words") - least)
    suffixes = texts.where(F.size("words") >= least).select("host", "id", F.explode(F.transform(places, lambda i: F.struct(i.alias("place"), F.slice("words", i + 1, depth).alias("key")))).alias("s"))
    suffixes = suffixes.select("host", "id", "s.place", "s.key", F.xxhash64(F.slice("s.key", 1, least)).alias("head"))
    ordered = suffixes.repartitionByRange("host", "key", "id", "place").sortWithinPartitions("host", "key", "id", "place")
    names = ["id", "place", "length", "head", "host", "key", "part", "last"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, carry = TaskContext.get().partitionId(), None

        def edge(b: pa.RecordBatch, i: int, last: bool) -> pa.RecordBatch:
            one = b.slice(i, 1)
            told = [one.column("id"), one.column("place"), pa.array([0], pa.int32()), one.column("head"), one.column("host"), one.column("key"), pa.array([part], pa.int32()), pa.array([last])]
            return pa.RecordBatch.from_arrays(told, names=names)

        for b in batches:
            if not b.num_rows:
                continue
            if carry is None:
                yield edge(b, 0, False)
            both = b if carry is None else pa.Table.from_batches([carry, b]).combine_chunks().to_batches()[0]
            n = np.diff(both.column("key").offsets.to_numpy())
            rows = np.repeat(np.arange(both.num_rows), n)
            keys = np.zeros((both.num_rows, depth), np.int64)
            keys[rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)] = both.column("key").flatten().to_numpy()
            host = both.column("host").dictionary_encode().indices.to_numpy()
            length = np.where(host[:-1] == host[1:], _common(keys[:-1], n[:-1], keys[1:], n[1:]), 0)
            at = np.flatnonzero(length >= least)
            for side in (at, at + 1):
                told = both.select(["id", "place", "head"]).take(pa.array(side))
                empty = [pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.list_(pa.int64())), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.bool_())]
                yield pa.RecordBatch.from_arrays([told.column("id"), told.column("place"), pa.array(length[at].astype(np.int32)), told.column("head"), *empty], names=names)
            carry = b.slice(b.num_rows - 1, 1)
        if carry is not None:
            yield edge(carry, 0, True)

    found = scratch(ordered.mapInArrow(run, "id long, place int, length int, head long, host string, key array<long>, part int, last boolean"), "suffixes")
    edges = sorted(found.where("last IS NOT NULL").collect(), key=lambda r: (r["part"], r["last"]))  # two rows a task
    across = []
    for a, b in zip(edges, edges[1:]):
        if a["last"] and not b["last"] and a["host"] == b["host"]:
            n = next((i for i, (x, y) in enumerate(zip(a["key"], b["key"])) if x != y), min(len(a["key"]), len(b["key"])))
            across += [(r["id"], r["place"], n, r["head"]) for r in (a, b) if n >= least]
    pairs = found.where("last IS NULL").select("id", "place", "length", "head").unionAll(spark.createDataFrame(across, "id long, place int, length int, head long"))
    return pairs.groupBy("id", "place", "head").agg(F.max("length").alias("length"))


def boilerplate(parsed: DataFrame, least: int, share: float) -> DataFrame:
    """(host, text) of block texts that host repeats cover: half of the words or more, on `share` of the host's pages (2 at least).

    Pages that are the same count once, and a text once with the number of pages that have it, so
    that what stands on all pages meets in sums and not in a task. A text of under `least` words
    must repeat as a whole.
    """
    pages = parsed.select("host", "page", "others").dropDuplicates(["host", "page"])
    hosts = pages.groupBy(F.col("host").alias("h")).agg(F.greatest(F.lit(2), F.ceil(F.count("*") * share)).alias("enough"))
    texts = pages.select("host", "page", F.explode("others").alias("text")).groupBy("host", "text").agg(F.count("*").alias("pages"), F.min("page").alias("low"), F.max("page").alias("high"))
    texts = scratch(texts.withColumn("id", F.monotonically_increasing_id()).withColumn("words", F.transform(F.split("text", " "), lambda w: F.xxhash64(w))), "host-texts")
    found = repeats(texts.select("host", "id", "words"), least)
    whole = texts.where((F.size("words") >= least) & (F.col("low") != F.col("high")))  # stands for its copies on other pages
    whole = whole.select("id", F.lit(0).alias("place"), F.xxhash64(F.slice("words", 1, least)).alias("head"), F.size("words").alias("length"))
    found = found.unionByName(whole).groupBy("id", "place", "head").agg(F.max("length").alias("length"))
    told = found.join(texts.select(F.col("id").alias("i"), "host", "pages", "low", "high"), F.col("id") == F.col("i"))
    told = scratch(told.select("host", "id", "place", "length", "head", "pages", "low", "high"), "repeats")
    heads = told.groupBy("host", "head").agg(F.sum("pages").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    heads = spread_join(heads, hosts, [("host", "h")]).where("pages >= enough").select(F.col("host").alias("hh"), F.col("head").alias("g"))
    spans = spread_join(told.select("host", "id", "place", "length", "head"), heads, [("host", "hh"), ("head", "g")])
    spans = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", (F.col("place") + F.col("length")).alias("end")))).alias("s"))
    covered = F.aggregate("s", F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), lambda a, x: F.struct(F.greatest(a["at"], x["end"]).alias("at"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["at"], x["place"]))).alias("n")))
    long = texts.join(spans.select(F.col("id").alias("i"), covered["n"].alias("n")), F.col("id") == F.col("i")).where(2 * F.col("n") >= F.size("words"))
    short = spread_join(texts.where((F.size("words") < least) & (F.col("low") < F.col("high"))), hosts, [("host", "h")]).where("pages >= enough")
    return long.select("host", "text").unionAll(short.select("host", "text"))


def dropped_words(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", length: int = 6, share: float = 0.1) -> DataFrame:
    """(page_id, n_main, n_open, n_by_array, n_by_markup): words of each page's article, words that markup leaves open, and of the rest those that the
    host's suffix array covers and those that markup alone drops. A report of what decides; null and empty pages have zeros."""
    parsed = scratch(parse(pages, id_col, url_col, html_col).withColumn("row", F.monotonically_increasing_id()), "pages")
    gone = boilerplate(parsed, length, share)
    size = lambda text: F.when(F.length(text) > 0, F.size(F.split(text, " "))).otherwise(0)
    rest = parsed.select("row", "host", F.explode("skipped").alias("text"))
    met = spread_join(rest, gone.select(F.col("host").alias("h"), F.col("text").alias("t")).distinct(), [("host", "h"), ("text", "t")], "left")
    sums = met.groupBy(F.col("row").alias("r")).agg(F.sum(F.when(F.col("t").isNotNull(), size(F.col("text"))).otherwise(0)).alias("a"), F.sum(F.when(F.col("t").isNull(), size(F.col("text"))).otherwise(0)).alias("b"))
    said = lambda test: F.aggregate(F.filter(F.coalesce("blocks", F.array()), test), F.lit(0).cast("long"), lambda n, x: n + size(x["text"]))
    told = parsed.select("row", "page_id", (size(F.coalesce("main", F.lit(""))) + said(lambda x: x["kind"] == MAIN)).alias("n_main"), said(lambda x: x["kind"] != MAIN).alias("n_open"))
    some = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return told.join(sums, F.col("row") == F.col("r"), "left").select("page_id", "n_main", "n_open", some("a").alias("n_by_array"), some("b").alias("n_by_markup"))


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", length: int = 6, share: float = 0.1, prose: int = 25) -> DataFrame:
    """(page_id, url, text) of every page: its blocks in order, less what markup or the host's repeats say is not main text.

    Menus, headers, footers, notices, adverts, forms, comments and the like go by their markup; a name of chrome on what
    holds the page's only article says nothing, nor does one on a heading in it. Article
    (or main) elements stay, also where other pages repeat them: syndicated text does. All other
    blocks, and those in an article under a doubtful name, are decided by the host's suffix array:
    they go where runs of `length` words or more that `share` of the host's pages have (2 at least) cover half of
    them. Unmarked blocks beside an article stay only if they hold more words than it. Where nothing
    would be left of a page, its blocks of at least `prose` words stay: it is a copy of another page. Pages with the same
    html are one page of the host. Words are compared by 64-bit hashes. Null and empty pages
    give an empty text; repeated rows each give theirs; other columns are ignored; an empty table
    stays empty. Parsed pages are written once to the shared folder.
    """
    parsed = scratch(parse(pages, id_col, url_col, html_col).drop("skipped").withColumn("row", F.monotonically_increasing_id()), "pages")
    gone = boilerplate(parsed, length, share)
    sure = parsed.where(F.col("blocks").isNull()).select("page_id", "url", F.col("main").alias("text"))
    parts = parsed.where(F.col("blocks").isNotNull()).select("row", "page_id", "url", "host", F.posexplode("blocks").alias("at", "b")).select("row", "page_id", "url", "host", "at", "b.*")
    asked = spread_join(parts.withColumn("asked", F.when(F.col("kind") != MAIN, F.col("text"))), gone.select(F.col("host").alias("h"), F.col("text").alias("t")), [("host", "h"), ("asked", "t")], "left")
    told = F.struct("at", "kind", "text", F.col("t").isNull().alias("own"), F.size(F.split("text", " ")).alias("n"))
    whole = asked.groupBy("row", "page_id", "url").agg(F.array_sort(F.collect_list(told)).alias("b"))
    words = lambda test: F.aggregate(F.filter("b", test), F.lit(0), lambda s, x: s + x["n"])
    whole = whole.withColumn("beside", words(lambda x: (x["kind"] == OUT) & x["own"]) > words(lambda x: (x["kind"] == MAIN) | ((x["kind"] == WEAK) & x["own"])))
    kept = F.filter("b", lambda x: (x["kind"] == MAIN) | (x["own"] & ((x["kind"] == WEAK) | F.col("beside"))))
    whole = whole.withColumn("kept", kept)
    last = F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.filter("b", lambda x: x["n"] >= prose))
    return sure.unionAll(whole.select("page_id", "url", F.array_join(F.transform(last, lambda x: x["text"]), " ").alias("text")))
