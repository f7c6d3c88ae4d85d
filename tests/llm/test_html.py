"""Main text of pages."""

import random

from pyspark.sql import functions as F

from mixolve.llm.html_text import blocks, dropped_words, host_of, main_text, repeats

PAGES = [
    (1, "http://a.x/1", "<body><div id=top>Home About News Contact Us Now please</div><div>unique words of one page here</div><div class='comments'><p>nice one</p></div></body>"),
    (2, "http://A.x:80/2", "<body><div id=top>Home About News Contact Us Now please</div><p>another text &lt;b&gt; stands&nbsp;here<p>and more <i>in</i>line</body>"),
    (3, "http://a.x/3", None),
    (4, None, ""),
    (5, "http://b.x", "<nav>menu</nav><main><h1>T &amp;amp; &#233;</h1><aside>no</aside><div class='share-box'>no<div>no</div></div><p>yes<!-- no --> <script>var a='</p>no';</script>ok<form>no</form>\n\tfine</p></main><p>out</p><footer>&copy; no</footer>"),
    (6, "http://c.x/1", "<article><p>same text in two pages of a host stays</p></article>"),
    (7, "http://c.x/2", "<article><p>same text in two pages of a host stays</p></article>"),
    (8, "http://d.x", "<article><p><b>unclosed<br><p>next</p><p hidden>no<p style='display:none'>no</p><p>a &lt; b"),
    (1, "http://a.x/1", "plain < text & more"),
    (9, "http://e.x", "<div class='page has-sidebar'><article>kept<div class='related posts'>no</div></article><div class='sidebar'>no</div></div>"),
]
WANT = {
    (1, "unique words of one page here"), (2, "another text <b> stands here and more inline"), (3, ""), (4, ""), (5, "T &amp; é yes ok fine"), (6, "same text in two pages of a host stays"),
    (7, "same text in two pages of a host stays"), (8, "unclosed next a < b"), (1, "plain < text & more"), (9, "kept"),
}


def test_pages(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, text string")
    assert {(r.page_id, r.text) for r in main_text(df).collect()} == WANT
    assert main_text(df.limit(0)).count() == 0


def test_long_and_broken_pages():
    assert blocks("<p>" + "word " * 200_000)[0][1].count("word") == 200_000
    assert blocks("<a href='x>" * 300 + "end")
    assert blocks("<" * 2000) and blocks("<!-- open") == [] and blocks("<script>x") == []
    assert host_of("https://u:p@Ex.com:8/x?y") == "ex.com" and host_of("//h/x") == "h" and host_of("no") == ""


def test_names_that_only_resemble_chrome_stay(spark):
    page = "<article><p>one</p><section class='related-work'>two</section><p class='share-price'>three</p><div id='menu-prices'>four</div><div class='relatedPosts'>no</div><p id='comment-12'>no</p></article>"
    card = "<div>the body of this page stands in no article at all</div><article class='comment'>no</article><article>card</article>"
    df = spark.createDataFrame([(1, "http://a.x", page), (2, "http://a.x/2", card)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in main_text(df).collect()} == {1: "one two three four", 2: "the body of this page stands in no article at all card"}


def test_repeats_decide_where_markup_does_not(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    notice, quote, body = prose(40), prose(8), [prose(60) for _ in range(30)]
    html = lambda i, text: f"<div>Home News Shop</div><div>{text}</div><div>{notice}</div><div>All rights kept by this host for {word()} {i}</div>"
    rows = [(i, "http://h.x", html(i, body[i] + (" " + quote if i % 3 == 0 else ""))) for i in range(30)]
    rows += [(100, "http://h.x", f"<div>Home News Shop</div><div>{body[0]} {quote}</div><div>{notice}</div>")]  # a copy of page 0's body
    rows += [(i, "http://h.x", "<article><p>" + body[3] + "</p><div class='related-reading'>see also the other pages of h</div></article>") for i in range(200, 210)]
    rows += [(300, "http://other.x", f"<div>Home News Shop</div><p>{notice}</p>")]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(30):
        assert got[i] == body[i] + (" " + quote if i % 3 == 0 else "")
    assert got[100] == got[0] and got[300] == f"Home News Shop {notice}"
    assert got[200] == body[3] + " see also the other pages of h"  # the same html ten times is one page


def test_suffix_array_against_brute_force(spark):
    rng = random.Random(6)
    texts = [(rng.choice("ab"), i, [rng.randint(0, 3) for _ in range(rng.randint(0, 60))]) for i in range(60)]
    texts += [("c", 900, [5] * 300), ("c", 901, [5] * 40 + [6])]
    df = spark.createDataFrame(texts, "host string, id long, words array<long>").repartition(5)
    for least, depth in ((4, 32), (6, 8)):
        got = {(r.id, r.place): r.length for r in repeats(df, least, depth).collect()}
        want = {}
        suffixes = [(h, i, p, tuple(w[p : p + depth])) for h, i, w in texts for p in range(len(w) - least + 1)]
        for h, i, p, key in suffixes:
            best = 0
            for h2, i2, p2, other in suffixes:
                if h == h2 and (i, p) != (i2, p2) and key[:least] == other[:least]:
                    best = max(best, next((k for k, (x, y) in enumerate(zip(key, other)) if x != y), min(len(key), len(other))))
            if best >= least:
                want[i, p] = best
        assert got == want
    assert repeats(df.limit(0)).count() == 0 and repeats(df.where(F.size("words") < 3)).count() == 0


def test_names_of_chrome_never_cost_the_article(spark):
    pages = [
        ("<div id='page' class='right-sidebar'><article><h2 class='section-header'>One</h2><p>two</p></article></div>", "One two"),
        ("<article><h1 class='header'>Head</h1><div class='content-header'><h1>Inner</h1></div><p class='notice'>stands</p><p>body</p></article>", "Head Inner stands body"),
        ("<article><p>text</p><div class='reader-reply'>no</div><section class='replies'><p>no</p></section></article>", "text"),
        ("<form action='x'><div class='header'>no</div><main>in a form that wraps the page</main></form>", "in a form that wraps the page"),
        ("<article>only</article><div class='related'><article>a card</article></div>", "only"),
        ("<div class='notice'><p>the whole of this page stands in a box of that name and in no article</p></div><p>short</p>", "the whole of this page stands in a box of that name and in no article short"),
        ("<div class='sidebar'><article hidden>no</article><article>yes</article></div><div class='ad'>no</div>", "yes"),
        ("<main class='header'>main stays</main><header>no</header>", "main stays"),
        ("<article>a<form><label>no</label></form><div class='ad-box'>no</div><div class='social-box'>b</div></article>", "a b"),
    ]
    df = spark.createDataFrame([(i, f"http://h{i}.x", h) for i, (h, _) in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(df).collect()}
    assert [got[i] for i in range(len(pages))] == [want for _, want in pages]


def test_doubtful_names_in_articles_go_where_the_host_repeats_them(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    notice, own = prose(20), [prose(30) for _ in range(12)]
    rows = [(i, "http://h.x", f"<nav>Home News Contact and more of it</nav><article><p>{t}</p><p class='notice'>{notice if i % 2 else t[:70]}</p></article>") for i, t in enumerate(own)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(df).collect()}
    assert all(got[i] == own[i] + ("" if i % 2 else " " + " ".join(own[i][:70].split())) for i in range(12))
    told = dropped_words(df).collect()
    assert all((r.n_main, r.n_by_array, r.n_by_markup) == (30, 7, 0) and r.n_open in (10, 11, 20) for r in told)


def test_a_key_of_many_suffixes_is_spread(spark):
    texts = [("h", i, [7, 8, 9, 10, 11, 12, 13, 14, 100 + i]) for i in range(400)]
    got = {(r.id, r.place): r.length for r in repeats(spark.createDataFrame(texts, "host string, id long, words array<long>"), 6, 8).collect()}
    assert got == {(i, p): 8 - p for i in range(400) for p in (0, 1, 2)}
