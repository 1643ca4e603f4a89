import pytest

from foldspark.llm import html_text, registry

LONG = "This is a paragraph of the story, long enough to be told from a menu by its density alone. "
CASES = {
    "article": ("<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Head  line</h1><p>One &amp; two.<p><b>Three</b><br>four</article><footer>&copy; x</footer>", "Head line\nOne & two.\nThree four"),
    "no article": (f"<body><div class=sidebar><p>{LONG}</p></div><div id=content><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div><a href=a>x</a> <a href=b>y</a></div></body>", f"Title\n{LONG.strip()}\n{LONG.strip()}"),
    "inside": (f"<article><header><h1>T</h1></header><p>{LONG}<div class='ad banner'>Buy now</div><aside>More</aside><form><input>Send</form><p>end<section id=comments><p>{LONG}{LONG}</section></article>", f"T\n{LONG.strip()}\nend"),
    "scripts": ("<title>t</title><style>p{}</style><script>var a='</p><p>no';</script><p>yes &#65;&eacute;&nbsp;z<!-- <p>no -->", "yes Aé z"),
    "never closed menu": (f"<nav><ul><li><a href=x>m</a><article><p>{LONG}</article>", LONG.strip()),
    "broken": ("a < b <b>c</b> <i", "a < b c <i"),
    "list": ("<article><ul><li>one<li>two</ul><table><tr><td>a</td><td>b</td></tr></table></article>", "one\ntwo\na\nb"),
    "hidden": ("<article><p>seen</p><p style='display: none'>not</p><p hidden>not</p></article>", "seen"),
    "only menus": ("<nav><a href=x>y</a></nav>", ""),
    "plain": ("just text", "just text"),
    "null": (None, ""),
    "blank": ("  \n", ""),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    html, want = CASES[name]
    assert html_text.main_text(html) == want


def test_deep_and_long_pages_end():
    assert html_text.main_text("<div>" * 20_000 + "core" + "</div>" * 20_000) == "core"
    assert html_text.main_text("<p>" + "word " * 200_000).count("word") == 200_000
    assert html_text.main_text('<a "' * 20_000) is not None


def test_table(spark, sf_dir):
    rows = [(1, "u", CASES["article"][0]), (None, None, None), (1, "u", CASES["article"][0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'old' AS text", "5 AS n_chars")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in html_text.extract_text(df, keep=["page_id", "url"]).collect()), key=str)
    assert got == sorted([(1, CASES["article"][1], 31), (1, CASES["article"][1], 31), (None, "", 0)], key=str)
    whole = html_text.extract_text(df.withColumn("at", df.url))
    assert whole.columns == ["page_id", "url", "html", "at", "text", "n_chars"] and sorted(r.n_chars for r in whole.collect()) == [0, 31, 31]
    assert html_text.extract_text(df.limit(0)).count() == 0
    pages = registry.op2_text_density(spark, sf_dir)
    assert pages.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").count() and pages.where("n_chars = 0").count() == 0


def test_test_pages_give_their_article(spark, sf_dir):
    import html
    import re

    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in registry.op2_text_density(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_sections_of_unequal_length_without_an_article():
    part = [("word%d and more of it " % k * 20)[:300].strip() for k in range(4)]
    html = f"<html><body><div><section><p>{part[0]}</p><p>{part[1]}</p><p>{part[2]}</p></section><section><p>{part[3]}</p></section></div></body></html>"
    assert html_text.main_text(html).split("\n") == part


def plain_densities(html):
    """The paper's formulas over a tree of its own, for pages without text to leave out: {(tag, text): (density, sum)} by node."""
    from html.parser import HTMLParser
    from math import e, log

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.root = self.at = {"tag": "#root", "of": None, "parts": []}

        def handle_starttag(self, tag, attrs):
            self.at["parts"].append(node := {"tag": tag, "of": self.at, "parts": []})
            self.at = node

        def handle_endtag(self, tag):
            self.at = self.at["of"]

        def handle_data(self, data):
            self.at["parts"].append(data)

    def size(x):
        return len("".join(x.split()))

    def text(x):
        return x if isinstance(x, str) else "".join(map(text, x["parts"]))

    def count(x, what):
        return 0 if isinstance(x, str) else sum((what == "*" or p["tag"] == what) + count(p, what) for p in x["parts"] if not isinstance(p, str))

    def linked(x):
        return 0 if isinstance(x, str) else size(text(x)) if x["tag"] == "a" else sum(map(linked, x["parts"]))

    tree = Tree()
    tree.feed(html)
    share = linked(tree.root) / max(size(text(tree.root)), 1)

    def density(x):
        c, t, lc, lt = size(text(x)), max(count(x, "*"), 1), linked(x), count(x, "a")
        if isinstance(x, str):
            return c * log(max(c, 1)) / max(log(log(share * c + e)), 1)
        if x["tag"] == "a":
            lc = c
        base = log(c / max(c - lc, 1) * lc + share * c + e)
        return c / t * log(max(c / max(lc, 1) * t / max(lt, 1), 1)) / max(log(base), 1) if c else 0.0

    out = []

    def walk(x):
        link = x["tag"] == "a"
        out.append((x["tag"], size(text(x)), round(density(x), 6), round(sum(density(p) for p in x["parts"] if size(text(p)) and not (link and isinstance(p, str))), 6)))
        for p in x["parts"]:
            if not isinstance(p, str):
                walk(p)

    for p in tree.root["parts"]:
        walk(p)
    return out


def page(seed):
    import random

    r = random.Random(seed)
    words = lambda n: " ".join("w%d" % r.randrange(1000) for _ in range(n))

    def block(depth):
        kind = r.randrange(4)
        if depth == 0 or kind == 0:
            return f"<p>{words(r.randrange(1, 60))}</p>"
        if kind == 1:
            return "<ul>" + "".join(f"<li><a href=x>{words(r.randrange(1, 4))}</a></li>" for _ in range(r.randrange(1, 6))) + "</ul>"
        return "<div>" + "".join(block(depth - 1) for _ in range(r.randrange(1, 5))) + "</div>"

    return "<html><body>" + "".join(block(3) for _ in range(r.randrange(1, 5))) + "</body></html>"


@pytest.mark.parametrize("seed", range(30))
def test_densities_are_the_formulas(seed):
    """The densities and sums by which main_text chooses, against the formulas over another parser's tree."""
    html = page(seed)
    nodes = html_text.measured(html)[0]
    assert [(x.tag, x.chars, round(x.density, 6), round(x.total, 6)) for x in nodes[1:]] == plain_densities(html)


def test_article_element_decides_nothing(spark):
    """Every test page gives the same text with its article element renamed."""
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        assert html_text.main_text(r.html) == html_text.main_text(r.html.replace("<article>", "<div>").replace("</article>", "</div>"))


WRAPPED = {
    "form around the page": f"<body><form id=aspnet><div class=nav><a href=x>m</a></div><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div></form></body>",
    "name on the content": f"<body><div class='notice story'><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div class=ad>Buy</div></body>",
    "sidebar of links": f"<body><div><ul><li><a href=a>one</a></li><li><a href=b>two</a></li></ul></div><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div><p><a href=c>{LONG}</a></p></div></body>",
    "comments longer than the text": f"<body><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div id=comments>{f'<p>{LONG}</p>' * 9}</div></body>",
}


#: Names of headings, quotations and sections of a text, as generators of slugs give them.
SLUGGED = ["<h2 id='social-science'>S</h2>", "<h2 id='related-work'>S</h2>", "<h2 id=menu-planning>S</h2>", "<pre class='language-menu'>S</pre>", "<section class='related-work'><p>S</p></section>", "<blockquote class='notice-of-appeal'>S</blockquote>", "<h3 class=comments id=comments>S</h3>", "<p class=notice>S</p>"]


@pytest.mark.parametrize("block", SLUGGED)
def test_names_of_text_leave_nothing_out(block):
    for outer in ("article", "div"):
        assert html_text.main_text(f"<body><nav><a href=x>m</a></nav><{outer}><h1>T</h1><p>{LONG}</p>{block}<p>{LONG}</p></{outer}></body>") == f"T\n{LONG.strip()}\nS\n{LONG.strip()}"


@pytest.mark.parametrize("block", ["<div class='related-stories-5'><a href=a>one</a> <a href=b>two</a></div>", "<div class='signup-now'>Join <input name=x></div>", "<div class='comment-list'><p>reader</p></div>", "<ul class='share-buttons'><li>Tell</li></ul>", "<div class='ad-banner-top'>Buy</div>"])
def test_names_with_a_structure_that_agrees(block):
    assert html_text.main_text(f"<body><article><h1>T</h1><p>{LONG}</p>{block}<p>{LONG}</p></article></body>") == f"T\n{LONG.strip()}\n{LONG.strip()}"


@pytest.mark.parametrize("comment", ["<!-->", "<!--->", "<!---->", "<!-- x -->", "<!-- a --!>"])
def test_empty_comments_end_at_once(comment):
    assert html_text.main_text(f"<article><p>one</p>{comment}<p>two</p><p>three</p></article>") == "one\ntwo\nthree"


def test_slugs_on_every_page_change_nothing(spark, sf_dir):
    """Names of menus, adverts and comments on every heading and paragraph of the test pages."""
    import itertools
    import re

    names = itertools.cycle(["related-work", "social-science", "menu-planning", "share-of-trade", "notice-of-appeal", "skip-lists", "ads-in-history", "comments"])
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        named = re.sub(r"<(h1|p)>", lambda m: f'<{m[1]} id="{next(names)}" class="{next(names)}">', r.html)
        assert html_text.main_text(named) == html_text.main_text(r.html)


@pytest.mark.parametrize("name", WRAPPED)
def test_structure_over_names(name):
    assert html_text.main_text(WRAPPED[name]) == f"T\n{LONG.strip()}\n{LONG.strip()}"
