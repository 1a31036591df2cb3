from html.parser import HTMLParser

import duckdb
import pytest

from kindred.llm import html as H

ARTICLE = "<article><h1>Title &amp; more</h1><p>First   para\nwith <b>bold</b>text.</p><p>Second &eacute; para<br>after break.</article>"
PAGES = {
    "plain": f"<html><body><nav><a href=x>Menu</a></nav><div class='ad'>Buy now</div>{ARTICLE}<footer>foot</footer></body></html>",
    "wrapped": f"<body><header>Site</header><div id=wrap><aside>side</aside><main>{ARTICLE}</main><section class='comments'><p>{'reader says ' * 40}</p></section></div></body>",
    "notices": f"<body><div class='cookie-notice'>We use cookies</div><form><p>Name</p><input name=q></form>{ARTICLE.replace('</h1>', '</h1><div class=share-buttons>Share</div><script>var t = \"</p>\";</script><style>p{{}}</style><!-- <p>no</p> -->')}</body>",
    "broken": f"<body><nav><ul><li>a<li>b</ul></nav>{ARTICLE[:-10]}",
    "cut": f"<body>{ARTICLE}<footer>&am",
}
WANT = "Title & more\nFirst para with boldtext.\nSecond é para after break."


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    assert H.Page(PAGES[name]).text(None) == WANT


@pytest.mark.parametrize("page", ["", " ", "no markup at all", "<", "<p", "<!--", "<script>", "</div></div>", "<p class='ad>x", "<nav>all menu</nav>", "<div/>x<br/>y", "&am", "<a b=c"])
def test_odd_pages_do_not_crash(page):
    assert isinstance(H.Page(page).text("/nowhere"), str)
    assert H.Page("no markup at all").text(None) == "no markup at all"


def test_consensus_beats_a_single_page(spark, scratch):
    """One page's widget is longer than its article: the host's other pages show where the article is."""
    page = lambda body, side: f"<body><div class='post7'>{body}</div><div class='box'><p>{side}</p></div></body>"
    rows = [(k, "http://h.example/1", page(f"<p>{'article ' * 30}{k}</p>", "short side")) for k in range(9)] + [(9, "http://h.example/2", page("<p>tiny article</p>", "long side " * 50))]
    rows += [(10, None, None), (11, "not a url", "<p>text</p>"), (11, "not a url", "<p>text</p>"), (None, "http://H.example:80/x", page("<p>null id</p>", "s" * 300))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = [(r["page_id"], r["text"]) for r in H.extract(df, scratch).collect()]
    assert (9, "tiny article") in got and (10, "") in got and got.count((11, "text")) == 2 and (None, "null id") in got and len(got) == len(rows)
    assert H.extract(df.limit(0), scratch).count() == 0


def test_hot_host(spark, scratch):
    df = spark.createDataFrame([(k, "http://hot.example/", f"<article><p>{k}</p></article>") for k in range(300)], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"]) for r in H.extract(df, scratch).collect()) == [(k, str(k)) for k in range(300)]


class Article(HTMLParser):
    """An independent reading of the blocks of a page's articles; for pages whose other text stands outside of them."""

    BREAKS = {"p", "h1", "h2", "div", "ul", "li", "section", "article"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth = self.raw = 0
        self.parts = [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.raw += tag in ("script", "style")
        if tag in self.BREAKS:
            self.parts.append("")
        if tag == "br":
            self.parts[-1] += " "

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.raw -= tag in ("script", "style")
        if tag in self.BREAKS:
            self.parts.append("")

    def handle_data(self, data):
        if self.depth > 0 and not self.raw:
            self.parts[-1] += data

    def text(self):
        blocks = (" ".join(p.split()) for p in self.parts)
        return "\n".join(b for b in blocks if b)


MALFORMED = {
    "unquoted apostrophe": "<body><nav>menu</nav><article><p>First <a title=don't>one</a> text.</p><p>Second para here</p><p class=can't>Third para</p></article></body>",
    "entry header": "<body><nav>menu</nav><article><div class='entry-header'><h1>Title</h1></div><p>Some text of the article.</p></article></body>",
    "slash in value": "<body><article><p>see <a href=/x/>here</a> and <a href=x/>there</a></p><p>more</p></article><footer>f</footer></body>",
    "odd quotes": "<body><article><p data-x=\"a'b>c\">one</p><p title='d\"e>f'>two</p><p a=b\"c>three</p><p =x>four</p></article></body>",
    "comments": "<body><article><!--><p>one</p><!-- <p>no</p> --><p>two</p><!-- a > b --!><p>three</p></article></body>",
    "empty value": "<body><article><p class=>one</p><p id = >two</p><p/>three</article></body>",
}


@pytest.mark.parametrize("name", MALFORMED)
def test_malformed_attributes(name):
    want = {"comments": "one\ntwo\nthree", "empty value": "one\ntwo\nthree"}.get(name) or Article(MALFORMED[name]).text()
    assert H.Page(MALFORMED[name]).text(None) == want


def test_split_article():
    part = lambda k: f"<div class='part{k}'><p>{'part of the article ' * 20}{k}</p></div>"
    page = f"<body><div class='menu'>menu</div><div id=c>{part(1)}<div class='ad'>buy</div>{part(2)}{part(3)}</div><footer>f</footer></body>"
    want = "\n".join(f"{'part of the article ' * 20}{k}" for k in (1, 2, 3))
    assert H.Page(page).text(None) == want and H.Page(page).text("/body/div/div.part0") == want


def test_marks_inside_an_article():
    inside = "<h1>T</h1><div class=share-buttons>Share</div><div class='post-comments'>no</div><div class=related-posts>no</div><p>Text of it.</p><div class=newsletter-signup>no</div>"
    assert H.Page(f"<body><article>{inside}</article></body>").text(None) == "T\nText of it."
    assert H.Page(f"<body><div class=page-header>Site</div><article>{inside}</article></body>").text(None) == "T\nText of it."


def test_long_and_clashing(spark, scratch):
    page = "<body><nav>m</nav><article>" + "<p>a paragraph &amp; more</p>" * 40_000 + "</article></body>"
    names = ["host", "path", "blocks", "keys", "spans", "voters", "key", "votes", "text", "n_chars"]
    df = spark.createDataFrame([(k, "http://x.example/", page, *names) for k in (1, None, None)], "page_id long, url string, html string, " + ", ".join(f"{n} string" for n in names))
    got = H.extract(df, scratch).collect()
    assert [r["page_id"] for r in got].count(None) == 2 and {r["text"] for r in got} == {"\n".join(["a paragraph & more"] * 40_000)}


def test_whole_table(spark, sf):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{sf.replace('0.001', '0.01')}/pages.parquet'").fetchall())
    rows = H.op5_html_host_paths(spark, sf.replace("0.001", "0.01")).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["n_chars"] == len(r["text"])
        assert r["text"] == Article(pages[r["page_id"]]).text()
