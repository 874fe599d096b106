import re

import pytest

from fileloom.llm import html_extract as he
from fileloom.llm import queries

HTML = """<!DOCTYPE html><html lang="en"><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li>About</ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><div id="sidebar">side</div>
<article class='post'><h1>Ti&shy;tle &lt;b&gt;</h1><p><b>First  line.<br>second<p>A <i>b</i>c
 d&nbsp;e &copy; x</p><div class="ad">Buy</div><ul><li>one<li>two</ul><form>Name <input name=a></form>
<aside>more</aside><section class="comments"><article><p>reader</p></article></section><table><tr><td>1<td>2</table>tail</article>
<div class="comments"><p>me too</p></div><footer>&copy; foot</footer></body></html>"""


def test_page():
    assert he.main_text(HTML) == "Ti\xadtle <b>\nFirst line. second\nA bc d e © x\none\ntwo\nmore\n1\n2\ntail"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a<p>b</b>c</p>d", "a\nbc\nd"),
        ("<main><p>x</main><p>y", "x"),
        ("<p>1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("<p title='a>b'>x<script>never closed <p>y", "x"),
        ("<p>x<!-- open <p>y", "x"),
        ("<b><p>x</b>y</p>", "xy"),
        ("<div><nav>a<div>b</div></nav>c</div>", "c"),
        ("<p \"unbalanced>x</p>", "x"),
        ("<svg><text>no</text></svg>a<span hidden>no</span>b", "ab"),
        ("</div></p>x</article>", "x"),
        ("<div class='content no-sidebar'><p>own words", "own words"),
        ("<article class='post has-comments'><p>own words", "own words"),
        ("<div class=share-price-report><p>own words", "own words"),
        ("<form id=aspnetForm><nav>menu</nav><h1>Title</h1><p>own words</form>", "Title\nown words"),
        ("<article><p>x<aside>y</aside><p role=note>z</article>", "x\ny\nz"),
        ("<body><p>" + "own words of the page " * 9 + "<article><a>teaser</a></article>", ("own words of the page " * 9).strip() + "\nteaser"),
        ("<p>a <span class=ad>b</span> c", "a c"),
        ("<p>a<<b>b</b>", "a<b"),
    ],
)
def test_markup(html, text):
    assert he.main_text(html) == text


def test_pages(spark, sf_dir):
    """On the driver's template the article is what a plain search finds."""
    pages = queries.table(spark, sf_dir.replace("0.001", "0.01"), "pages")
    got = {r.page_id: r for r in he.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", r.html).group(1)
        from html import unescape

        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert (got[r.page_id].url, got[r.page_id].n_chars) == (r.url, len(got[r.page_id].text))


def test_style_tree_cuts_what_repeats(spark, monkeypatch):
    rows = [(i, f"http://Site.org:80/{i}", f"<body><div class=x><p>All rights of every page.</p></div><div class=y><p>Own words of page {i}.</p><p>again {i % 7}</p></div>") for i in range(60)]
    rows += [(100 + i, "http://few.org/", "<div class=x>same</div>") for i in range(5)] + [(200, None, None), (201, None, ""), (200, None, None)]
    rows += [(300 + i, "http://copies.org/", "<p>one text on all pages") for i in range(40)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    want = sorted([(i, f"Own words of page {i}.\nagain {i % 7}") for i in range(60)] + [(100 + i, "same") for i in range(5)] + [(200, ""), (201, ""), (200, "")] + [(300 + i, "one text on all pages") for i in range(40)])
    for most in (he.BROADCAST_ROWS, -1):
        monkeypatch.setattr(he, "BROADCAST_ROWS", most)
        assert sorted((r.page_id, r.text) for r in he.extract(pages).collect()) == want
    assert he.extract(pages.limit(0)).count() == 0


def test_tree_alone_removes_what_only_a_host_shows(spark, sf_dir):
    """Pages of the table in which nothing is named: notes that a host's pages share go, what they say themselves stays."""
    rows = [tuple(r) for r in queries.table(spark, sf_dir.replace("0.001", "0.1"), "pages").select("page_id", "url", "html").collect()]
    plain = {k: he.main_text(h) for k, _, h in rows}
    seen = {}
    for _, u, _ in rows:
        seen[he.host_of(u)] = seen.get(he.host_of(u), 0) + 1
    made = []
    for k, u, h in rows:
        article = re.search(r"(?s)<article>(.*?)(?:</article>|\Z)", h).group(1)
        made.append((k, u, f"<body><div class=q1><p>All of {he.host_of(u)} is free.</p></div><div class=q2>{article}</div><div class=q3><ul><li>One<li>Two of {he.host_of(u)}</ul></div>"))
    got = {r.page_id: r.text for r in he.extract(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    several = [(k, he.host_of(u)) for k, u, _ in rows if seen[he.host_of(u)] >= he.FEW_PAGES]
    assert len(several) > 2000 and all(got[k] == plain[k] for k, _ in several)
    assert all(plain[k] in got[k] for k in got)


def test_tree_decides_on_the_driver_template(spark, sf_dir):
    """The noise nodes of hosts cover what stands around the articles; without them pages have another text."""
    pages = queries.table(spark, sf_dir.replace("0.001", "0.01"), "pages")
    noise = {r.host: set(r.styles) for r in he.noise_nodes(he.style_tree(pages)).collect()}
    texts = [(he.Page(r.html).text(), he.main_text(r.html, noise[he.host_of(r.url)])) for r in pages.where("html not like '%<article>%'").collect()]
    assert all(any("nav" in s for s in styles) and any("footer" in s for s in styles) for styles in noise.values())
    bare = [(r.url, r.html.replace("<article>", "<div>").replace("</article>", "</div>")) for r in pages.collect()]
    assert all(he.main_text(h, noise[he.host_of(u)]) != he.Page(h).text() for u, h in bare)
    assert not texts


def entropies(pages):
    """(pages, entropy) of each host and style by plain counts."""
    import math
    from collections import Counter, defaultdict

    seen = defaultdict(lambda: (Counter(), Counter()))
    for url, html in pages:
        for style, presentation, content, _ in he.Page(html or "").nodes():
            for c, v in zip(seen[he.host_of(url), style], (presentation, content), strict=True):
                c[v] += 1
    share = lambda c: (1.0 if c.total() == 1 else -sum(n / c.total() * math.log(n / c.total()) for n in c.values()) / math.log(c.total()))
    return {k: (c.total(), round(0.25 * share(p) + 0.75 * share(c), 9)) for k, (p, c) in seen.items()}


def test_entropies_against_plain_counts(spark, sf_dir):
    pages = queries.table(spark, sf_dir.replace("0.001", "0.01"), "pages")
    got = {(r.host, r.style): (int(r.pages), round(r.entropy, 9)) for r in he.style_tree(pages).collect()}
    want = entropies([(r.url, r.html) for r in pages.collect()])
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-8 for k in want)


SLOW = ["<div>" * 20000 + "x", "<b>" * 20000 + "x", "<p>x</section>" * 20000, "<div><p>x" * 5000, "<a \"" * 3000 + "x", "<!--" * 5000, "&amp" * 50000, "<ul><li>" * 5000 + "x"]
SLOW += ["<a " * 333_000, "<a '" * 200_000 + ">", "<" * 1_000_000, "<b>" * 20_000 + "<p><td>" + "<b>" * 20_000 + "<p></p>" * 20_000]


@pytest.mark.parametrize("html", SLOW, ids=range(len(SLOW)))
def test_deep_and_broken_pages_end(html):
    import time

    began = time.time()
    assert isinstance(he.main_text(html), str)
    assert time.time() - began < 8
