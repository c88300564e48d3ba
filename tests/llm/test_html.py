import html
import re

from kbspark.llm import html_extract
from kbspark.llm.html_extract import main_blocks
from kbspark.llm.html_pages import read_page

SCHEMA = "page_id long, url string, html string, host string, fixed string, body string, path string"


def text_of(page):
    return " ".join(b.text for b in main_blocks(read_page(page)[0], set(), None))


def extract(spark, rows, **kw):
    return html_extract.extract_pages(spark.createDataFrame([(*r, "h", "f", "b", "p") for r in rows], SCHEMA), **kw).collect()


def test_furniture_goes_and_the_article_stays():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><!-- <p>comment</p> --><div class="cookie-notice">Cookies</div>
    <article><header><h1>Title &amp; more</h1></header><p>One <b>bo</b>ld<br>two&nbsp; three &lt;x&gt;</p><div class="ad">Buy</div><p hidden>no</p>
    <form><input><button>Go</button></form><ul><li>a<li>b</ul><p style="display: none">no<p title="a > b">last &copy; &eacute; &#233; &#xe9;
    <aside>side</aside><section id="comments"><p>troll</p></section></article><div class="sidebar">S</div><footer>F</footer></body></html>"""
    assert text_of(page) == "Title & more One bold two three <x> a b last © é é é"


def test_broken_pages():
    assert text_of("") == ""
    assert text_of("plain < text > & more") == "plain < text > & more"
    assert text_of("<nav><li>menu<article><p>kept <b>open<p>next") == "kept open next"
    assert text_of("<article><p>a</article><footer>f<p>g") == "a"
    assert text_of("<article>x<script>never closed <p>y") == "x"
    assert text_of("<article><p>" + "word " * 100_000 + "</p></article>") == ("word " * 100_000).strip()
    assert text_of("<p>" * 30_000 + "deep") == "deep"


def reference(page):
    inner = re.sub(r"</?(?:p|h1)>|<br>", "\0", re.search(r"<article>(.*)</article>", page, re.S)[1])
    parts = (" ".join(html.unescape(x).split()) for x in re.sub(r"<[^>]*>", "", inner).split("\0"))
    return " ".join(p for p in parts if p)


def test_whole_pages(spark):
    from kbspark.llm.queries import QUERIES

    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = QUERIES["op5_html_extraction"](spark, "/root/testdata/sf0.01").collect()
    assert {r.page_id: r.text for r in got} == {i: reference(p.html) for i, p in pages.items()}
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)


def test_hosts_without_a_content_element_use_their_template(spark):
    def page(k):
        return (f"<html><body><div class=top>Brand</div><div class=lead>Fixed words on every page</div><div class=story><h2>Head {k}</h2>"
                f"<p>Story number {k} is long enough to be the text.</p><p>Read our rules.</p></div><div class=end>Office hours</div></body></html>")

    rows = [(k, "https://Example.com:80/a", page(k)) for k in range(30)] + [(99, "https://alone.org/", page(5))]
    got = {r.id: r.text for r in extract(spark, rows)}
    assert got[7] == "Head 7 Story number 7 is long enough to be the text."
    assert got[99] == "Head 5 Story number 5 is long enough to be the text. Read our rules."


def test_copies_of_one_page_do_not_make_its_text_fixed(spark):
    page = "<article><h1>T</h1><p>the same text</p></article>"
    assert {r.text for r in extract(spark, [(k, "http://c/", page) for k in range(40)])} == {"T the same text"}


def test_nulls_repeats_and_empty_tables(spark):
    got = extract(spark, [(1, None, None), (2, "not a url", "<article>x</article>"), (2, "not a url", "<article>x</article>"), (None, "http://h/", "")])
    assert sorted((str(r.id), r.text) for r in got) == [("1", ""), ("2", "x"), ("2", "x"), ("None", "")]
    assert extract(spark, []) == []


def test_unmarked_pages_keep_all_their_slots(spark):
    def post(k):
        return f"<body><div class=top>Brand</div><div class=post><p>Post {k} has quite a long text for a page of this host.</p></div><div class=by>Author {k}</div></body>"

    def story(k):
        return f"<body><div class=top>Brand</div><div class=story><p>Story {k}.</p></div><div class=end>Office hours</div></body>"

    split = "<body><section id=history><p>Long history of the place.</p></section><section id=plan><p>Plan.</p></section><div>a<br>b</div><div class=top>Brand</div></body>"
    rows = [(k, "http://two/", post(k)) for k in range(25)] + [(100 + k, "http://two/", story(k)) for k in range(25)]
    rows += [(200, None, split), (201, "no url", "<body><div class=other><p>Elsewhere.</p></div></body>"), (202, "", "<body><div class=only>Only this</div></body>")]
    got = {r.id: r.text for r in extract(spark, rows)}
    assert got[3] == "Post 3 has quite a long text for a page of this host. Author 3"
    assert got[103] == "Story 3."
    assert got[200] == "Long history of the place. Plan. a b"
    assert (got[201], got[202]) == ("Elsewhere.", "Only this")


def test_names_inside_an_article_drop_clear_furniture_only():
    page = """<body><div class="site-header"><p>Site</p></div><article><header class="entry-header"><h1>Title</h1></header><div class="article-header">By Jo</div>
    <h2 id="search-engines">Search</h2><section id="social-impact"><p>Impact</p></section><section id="related-work" class="related"><p>Work</p></section>
    <section id="advertising"><p>History of ads</p></section><h2 class="widget" id="comments">Remarks</h2><div class="share-price">Price</div>
    <div class="ad-banner">Buy</div><div id="comments">troll</div><div class="box sidebar">Side</div><p>End</p></article></body>"""
    assert text_of(page) == "Title By Jo Search Impact Work History of ads Remarks Price End"
    assert text_of("<body><h2 id='social'>Social</h2><section id='search-engines'><p>Engines</p></section><div class='site-search'>Go</div></body>") == "Social Engines"


def test_class_names_by_all_they_say():
    gone = ["cookie-notice", "advertising", "sponsored", "newsletter", "share", "social", "replies", "entry-comments", "comment-list", "notice", "Main-Menu", "post_share links"]
    stay = ["share-price", "market-share", "entry-header", "section-header", "social-history", "cookie-recipe", "research", "story", "menu-history"]
    for name in gone + stay:
        want = "Title kept" if name in gone else "Title kept inner"
        assert text_of(f"<body><article><h1>Title</h1><p>kept</p><div class='{name}'><p>inner</p></div></article></body>") == want, name
    outside = ["site-search", "cookie-notice", "advertising", "social", "site-header", "header", "left-sidebar", "comment-list", "menu"]
    for name in outside + stay:
        got = text_of(f"<body><div class='text'><p>The text goes on here.</p></div><div class='{name}'><p>And the rest.</p></div></body>")
        assert got == ("The text goes on here." if name in outside else "The text goes on here. And the rest."), name


def test_support_is_an_exact_number_of_different_pages(spark):
    def page(h, k):
        return f"<article><h1>Page {k} of {h}</h1><p>The same words.</p></article>"

    rows = [(h, f"http://h{h}/", page(h, k)) for h in range(200) for k in range(20)]
    rows += [(500 + h, f"http://g{h}/", page(h, k)) for h in range(50) for k in range(19) for _ in range(1 + k % 3)]
    got = extract(spark, rows)
    assert len(got) == len(rows)
    assert all(r.text.endswith("The same words.") == (r.id >= 500) for r in got)


def test_the_template_names_its_slots_by_path(spark):
    rows = [(k, f"<body><div class=by>Author {k}</div><div class=t>T</div></body>") for k in range(20)] + [(99, "<body><div class=once>Once</div></body>")]
    (host,) = html_extract.deduce_templates(spark.createDataFrame([("h", p) for _, p in rows], "host string, html string")).collect()
    place = html_extract.token
    assert set(host.slots) == {place("/body/div.by"), place("/body/div.t")} and set(host.fixed) == {place("/body/div.t", "T")}
