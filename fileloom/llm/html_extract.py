"""HTML extraction with a site style tree.

All pages of a host are merged into one tree of style nodes: a node is the path of tag names, classes and ids from the
body on, so that elements of the same style are one node. On each page a node has a presentation (the sequence of its
children's styles) and a content (its text). Over a host's pages the entropy of both, as a share of the greatest
possible one, is the node's importance: what looks and reads the same on every page carries nothing. Nodes with an
importance under ``LOW`` of the host's most important node are noise, and their branches are cut from each page.

Entropies need pages. A node on ``MIN_PAGES`` pages or more is judged by them; one on ``FEW_PAGES`` or more only if it is
the same on all of them, and counts as fully important otherwise. What an element is named (by tag, role, class or id:
menus, footers, sidebars, adverts, comments and the like) weighs in as a prior: its entropy counts ``NAMED`` only, so that
named branches go however varied they are, unless they hold the page (a form around everything, a class that names what
a page has). Only markup that is never text (scripts, styles, controls, what is hidden) is left out before the tree.

Of what the tree leaves the articles count if they hold a quarter of it, else the main element likewise, else the body.
Texts: character references are decoded, white space within a block becomes one space, blocks are trimmed and joined
in page order by a newline; <br> is white space.

The entropies come from two grouped counts, so a host with a third of all pages is summed before it is shuffled. The
noise nodes of all hosts are broadcast only if they are at most ``BROADCAST_ROWS``; else pages and nodes meet by host.

Edge cases: null or empty html has an empty text; a null url belongs to the host ''; repeated pages each get a row; an
empty table gives an empty result; extra columns are not looked at. Broken markup never fails: unclosed elements end
with their parent, what is left open by an unterminated comment or script is dropped, and elements within over
``STACK`` others are taken for siblings, as browsers do. Reading is linear in the page.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileloom.llm.common import materialize

MIN_PAGES, FEW_PAGES = 20, 3
LOW = 0.3
#: How much presentation counts against content.
PRESENTATION = 0.25
#: What the importance of an element that is named as noise is multiplied by.
NAMED = 0.25
#: Share of the text that articles, or else the main element, must hold to be the main text.
HELD = 0.25
#: Levels of a style's path; deeper elements share their ancestor's style. Most elements that are open at a time.
DEPTH, STACK = 48, 512
BROADCAST_ROWS = 20_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table caption tbody thead tfoot tr td th ul".split()
)
#: An element of the first kind that opens ends an open one of the second.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = frozenset("ul ol dl table div section article main body td".split())

#: Never text.
NEVER = frozenset("head script style title textarea noscript template iframe xmp noframes svg math canvas object audio video map button select datalist".split())
#: Named as noise by tag or role.
NAMED_TAGS = frozenset("nav footer aside form dialog menu search".split())
NAMED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog status".split())
#: Named as noise by class or id: every part of the name is one of these words or says where it stands, and one is of these.
NAMED_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager footer sidebar sidenav aside ad ads advert adverts advertisement "
    "advertising adsense adsbygoogle sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription comment comments respond disqus replies share sharing social related recommended widget widgets login signup searchform toolbar skip".split()
)
PLACE_WORDS = frozenset(
    "main top bottom left right upper lower site page global primary secondary first second outer inner container wrapper wrap box block area section bar inline "
    "list item items link links posts slot unit banner bubble form panel column col region content title header heading body group button buttons icons js css div id".split()
)
#: Noise outside an article only: inside, they head or foot the article itself.
OUTER_TAGS = frozenset({"header"})
OUTER_WORDS = frozenset({"header", "masthead", "banner", "topbar"})
#: What shows that a named branch holds the page.
HOLDS_FORM = frozenset("h1 main article nav header footer".split())
HOLDS_CLASS = frozenset("h1 main".split())

_HEAD = re.compile(r"/?([A-Za-z][^\s/>]*)")
_INSIDE = re.compile(r"(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for t in RAW}
_SPLIT = re.compile(r"[^a-z]+")
#: Numbers that tell elements apart, not styles: post-4711 and post-4712 are one style, col-1 and col-2 are two.
_DIGITS = re.compile(r"[0-9]{3,}")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m.group(1).lower() if m else ""


@lru_cache(1 << 14)
def names_noise(token: str, words: frozenset = NAMED_WORDS) -> bool:
    """Whether a class or id means such a part of a page: cookie-notice does, no-sidebar or share-price-report does not."""
    parts = [w for w in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if w]
    return any(w in words for w in parts) and all(w in words or w in PLACE_WORDS for w in parts)


class Node:
    """An element while it is open.

    style and path: its own and all styles from the body on; named: what it is named noise by ('' if it is not); holds: tags
    in it that show that it holds the page; never, article, main: whether it or what it is in is such.
    """

    __slots__ = ("article", "depth", "holds", "main", "named", "never", "path", "style", "tag")

    def __init__(self, tag: str, attributes: str, parent: Node | None) -> None:
        found: dict[str, str] = {}
        if attributes and not attributes.isspace():
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                found.setdefault(name.lower(), unescape(a or b or c))
        self.tag = tag
        self.holds: set[str] | None = None
        if parent is None:
            self.depth, self.article, self.main, self.never = 0, False, False, tag in NEVER
        else:
            self.depth, self.article, self.main, self.never = parent.depth + 1, parent.article, parent.main, parent.never or tag in NEVER
        own, role, names = tag, "", []
        if found:
            classes, key, role = found.get("class", "").split(), found.get("id", ""), found.get("role", "").lower()
            self.never |= "hidden" in found or found.get("aria-hidden") == "true"
            own += "".join(f".{c}" for c in sorted(_DIGITS.sub("0", c) for c in classes)) + (f"#{_DIGITS.sub('0', key)}" if key else "")
            names = [*classes, key]
        whole = tag in ("html", "body")
        self.named = "" if whole else self._named_by(tag, role, names)
        if parent is None or whole:
            self.style, self.path = own, (own,) if tag in BLOCK else ()
        elif self.depth < DEPTH:
            self.style = f"{parent.style}/{own}"
            self.path = (*parent.path, self.style) if tag in BLOCK or self.named else parent.path
        else:
            self.style, self.path = parent.style, parent.path
        self.article |= tag == "article"
        self.main |= tag == "main" or role == "main"

    def _named_by(self, tag: str, role: str, names: list[str]) -> str:
        if tag in NAMED_TAGS or role in NAMED_ROLES:
            # an aside in an article may be part of it: only the tree can tell
            return "" if tag == "aside" and self.article and not role else "form" if tag == "form" else "tag"
        if not self.article and tag in OUTER_TAGS:
            return "outer"
        if not names:
            return ""
        if not self.article and any(names_noise(x, OUTER_WORDS) for x in names):
            return "outer"
        return "class" if any(map(names_noise, names)) else ""

    def prior(self) -> float:
        held = self.holds or frozenset()
        if not self.named or (self.named == "form" and held & HOLDS_FORM) or (self.named == "class" and held & HOLDS_CLASS) or (self.named == "outer" and "main" in held):
            return 1.0
        return NAMED


class Page:
    """What a page consists of: blocks of pieces of text with the elements they are in, and each style's sequence of children."""

    def __init__(self, html: str) -> None:
        self.blocks: list[list[tuple[str, Node | None]]] = []
        self.children: dict[str, list[str]] = {}
        self.named: list[Node] = []
        self._stack: list[Node] = []
        self._open: Counter[str] = Counter()
        self._pieces: list[tuple[str, Node | None]] = []
        self._read(html)
        self._ends_block()

    def _read(self, html: str) -> None:
        at, end, quotes = 0, len(html), True
        while at < end:
            begin = html.find("<", at)
            if begin < 0:
                self._said(html[at:])
                return
            m = _HEAD.match(html, begin + 1)
            if m is None:
                if html.startswith("<!--", begin):
                    stop = html.find("-->", begin + 4)
                    stop = end if stop < 0 else stop + 3
                elif html[begin + 1 : begin + 2] in ("!", "?", "/") and begin + 1 < end:
                    stop = html.find(">", begin) + 1 or end
                else:
                    self._said(html[at : begin + 1])
                    at = begin + 1
                    continue
                if begin > at:
                    self._said(html[at:begin])
                at = stop
                continue
            if begin > at:
                self._said(html[at:begin])
            stop = _INSIDE.match(html, m.end()).end() if quotes else end
            if html[stop : stop + 1] != ">":
                quotes = False  # a quote that is never closed: from here on quotes count as any character
                stop = html.find(">", m.end())
                if stop < 0:  # no tag ends any more
                    self._said(html[begin:])
                    return
            tag, at = m.group(1).lower(), stop + 1
            if html[begin + 1] == "/":
                self._closes(tag)
                continue
            self._opens(tag, html[m.end() : stop])
            if tag in RAW:
                done = _CLOSE[tag].search(html, at)
                at = done.end() if done else end

    def _said(self, text: str) -> None:
        top = self._stack[-1] if self._stack else None
        if not (top and top.never):
            self._pieces.append((unescape(text) if "&" in text else text, top))

    def _ends_block(self) -> None:
        if self._pieces:
            if any(not t.isspace() for t, _ in self._pieces):
                self.blocks.append(self._pieces)
                self._pieces = []
            else:
                self._pieces.clear()

    def _opens(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._said(" ")
            return
        block = tag in BLOCK
        if block and not (self._stack and self._stack[-1].never):
            self._ends_block()
        if block:
            self._pop_to({"p"}, SCOPE)
        if tag in ENDS:
            self._pop_to(ENDS[tag], SCOPE - {"td"} if tag in ("tr", "td", "th") else SCOPE)
        if tag in VOID or tag in RAW or (attributes.endswith("/") and tag in ("svg", "math", "path")):
            return
        if len(self._stack) >= STACK or (tag in ("html", "body") and any(x.tag == tag for x in self._stack)):
            return
        parent = self._stack[-1] if self._stack else None
        node = Node(tag, attributes, parent)
        if tag in HOLDS_FORM:
            for x in self._stack:
                if x.named:
                    x.holds = (x.holds or set()) | {tag}
        if node.named and not node.never:
            self.named.append(node)
        if block and not node.never and parent is not None:
            self.children.setdefault(parent.style, []).append(node.style.rpartition("/")[2])
        self._stack.append(node)
        self._open[tag] += 1

    def _pop_from(self, i: int) -> None:
        for x in self._stack[i:]:
            self._open[x.tag] -= 1
        del self._stack[i:]

    def _closes(self, tag: str) -> None:
        block = tag in BLOCK
        if block:
            self._ends_block()
        if not self._open[tag]:
            return
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i].tag == tag:
                if block or self._stack[i].never:
                    self._pop_from(i)
                else:
                    self._open[tag] -= 1
                    del self._stack[i]
                return
            if not block and self._stack[i].tag in BLOCK and self._stack[i].tag != "p":
                return

    def _pop_to(self, tags: frozenset | set, scope: frozenset | set) -> None:
        """Ends the nearest open element of tags and what is in it, if no element of scope is between."""
        for t in tags:
            if self._open[t]:
                break
        else:
            return
        for i in range(len(self._stack) - 1, -1, -1):
            if self._stack[i].tag in tags:
                self._pop_from(i)
                return
            if self._stack[i].tag in scope:
                return

    def text(self, noise: frozenset | set = frozenset()) -> str:
        """The main text without the branches of noise."""
        cut: dict[tuple, bool] = {}

        def gone(node: Node | None) -> bool:
            if node is None or not noise:
                return False
            if node.path not in cut:
                cut[node.path] = not noise.isdisjoint(node.path)
            return cut[node.path]

        left = []
        for pieces in self.blocks:
            own = [x for x in pieces if not gone(x[1])]
            if text := " ".join("".join(t for t, _ in own).split()):
                left.append((text, own[0][1]))
        size = sum(len(t) for t, _ in left)
        for kind in ("article", "main"):
            held = [t for t, n in left if n is not None and getattr(n, kind)]
            if held and sum(map(len, held)) >= HELD * size:
                return "\n".join(held)
        return "\n".join(t for t, _ in left)

    def nodes(self):
        """(style, presentation, content, prior) of each style on the page, presentation and content as hashes."""
        content: dict[str, list[str]] = {}
        for pieces in self.blocks:
            for text, node in pieces:
                if node is not None and not text.isspace():
                    for s in node.path:
                        content.setdefault(s, []).append(text)
        prior = {x.style: x.prior() for x in self.named}
        for s, texts in content.items():
            yield s, _hash("\x00".join(self.children.get(s, ()))), _hash("\x00".join(texts)), prior.get(s, 1.0)


def main_text(html: str | None, noise: frozenset | set | None = None) -> str:
    """The main text of a page; without noise nodes it is judged as a host of one page is, by priors."""
    page = Page(html or "")
    if noise is None:
        noise = {s for s, _, _, prior in page.nodes() if prior < LOW}
    return page.text(noise)


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "replace")) - (1 << 63)


def _nodes(batches):
    for batch in batches:
        rows = []
        for url, html in zip(batch.column(0), batch.column(1), strict=True):
            host = host_of(url.as_py())
            rows += [(host, *x) for x in Page(html.as_py() or "").nodes()]
        if rows:
            cols = zip(*rows, strict=True)
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "style", "presentation", "content", "prior"])


def style_tree(pages: DataFrame) -> DataFrame:
    """host, style, pages, entropy (0 to 1), prior and importance of each style node."""
    nodes = pages.select("url", "html").mapInArrow(_nodes, "host string, style string, presentation long, content long, prior double")
    # both features in one pass; a feature's count is summed before it is shuffled
    each = nodes.select("host", "style", "prior", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("presentation").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("value")))).alias("f"))
    counts = each.groupBy("host", "style", "f.kind", "f.value").agg(F.count("*").cast("double").alias("n"), F.sum("prior").alias("prior"))
    by_kind = counts.groupBy("host", "style", "kind").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.count("*").alias("values"), F.sum("prior").alias("prior"))
    entropy = F.when(F.col("values") == 1, F.when(F.col("pages") > 1, 0.0).otherwise(1.0)).otherwise((F.log("pages") - F.col("nlogn") / F.col("pages")) / F.log("pages"))
    weight = F.when(F.col("kind") == 0, PRESENTATION).otherwise(1 - PRESENTATION)
    tree = by_kind.groupBy("host", "style").agg(F.max("pages").alias("pages"), F.sum(entropy * weight).alias("entropy"), F.max(F.col("prior") / F.col("pages")).alias("prior"))
    judged = (F.col("pages") >= MIN_PAGES) | ((F.col("pages") >= FEW_PAGES) & (F.col("entropy") == 0))
    return tree.withColumn("importance", F.when(judged, F.col("entropy")).otherwise(1.0) * F.col("prior"))


def noise_nodes(tree: DataFrame) -> DataFrame:
    """host and styles, the list of its noise nodes."""
    most = tree.groupBy("host").agg(F.max("importance").alias("most"))
    low = tree.where(~F.col("style").rlike(r"^(html|body)[^/]*$")).join(most, "host").where(F.col("importance") < LOW * F.col("most"))
    return low.groupBy("host").agg(F.sort_array(F.collect_set("style")).alias("styles"))


def _extract(shared, has_styles: bool):
    def run(batches):
        known = None if has_styles else {h: frozenset(s) for h, s in shared.value}
        for batch in batches:
            url, html = batch.column(1), batch.column(2)
            texts = []
            for i in range(batch.num_rows):
                noise = frozenset(batch.column(3)[i].as_py() or ()) if has_styles else known.get(host_of(url[i].as_py()), frozenset())
                texts.append(main_text(html[i].as_py(), noise))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), url.cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""
    tree = materialize(style_tree(pages), "tree")  # read twice, so that pages are not
    noise = materialize(noise_nodes(tree), "noise")
    out = "page_id long, url string, text string, n_chars long"
    rows = pages.select("page_id", "url", "html")
    size = noise.agg(F.coalesce(F.sum(F.size("styles")), F.lit(0)).alias("n"), F.count("*").alias("hosts")).first()
    if size.n + size.hosts <= BROADCAST_ROWS:
        shared = pages.sparkSession.sparkContext.broadcast([(r.host, list(r.styles)) for r in noise.collect()])
        return rows.mapInArrow(_extract(shared, False), out)
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    met = rows.withColumn("host", F.coalesce(host, F.lit(""))).join(noise, "host", "left")
    return met.select("page_id", "url", "html", "styles").mapInArrow(_extract(None, True), out)
