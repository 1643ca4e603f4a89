"""Main text of web pages by composite text density.

Sun, Song and Liao, "DOM Based Content Extraction via Text Density" (SIGIR
2011). Every node of the DOM has a composite density: its characters per tag,
times a logarithm that falls with the share of characters and tags in links, to
a base that grows with the links of the node and the whole body. A node's sum is
that of its children's densities, its own text counting as a child. The subtree
with the largest sum is the main text. The least density on its path to the body
is the threshold for other subtrees to be taken besides.

Additions, none of which looks at more than structure and these densities:

* Subtrees whose tag, role or name says that they are no content (menus,
  adverts, forms, comments and so on) are left out beforehand, but a name or a
  wrapping tag never leaves out the page's heading or nearly all of its text. A
  name that says so only in part, as slugs of headings do, counts only for what is
  mostly links or holds a form, and so does any name of a heading, paragraph,
  preformatted text or quotation.
* The base is at least e, so a page with next to no links doesn't divide by next
  to nothing.
* What the densities choose is made whole: paragraphs, headings, lists and the
  like beside a chosen one, blocks between chosen ones, both unless they are
  mostly links, the page's heading before them, and the rest of an article element
  that holds all of them. An article element alone chooses nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, spread

_TAG = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/><]*)((?:"[^"<]*"|'[^'<]*'|[^<>"'])*+)>|(/?)([a-zA-Z][^\s/><]*)([^<>]*)>|[!?/][^>]*(?:>|\Z))""", re.S
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: What a start tag closes, up to the tags that hold it in.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist", "optgroup"})}
ENDS_P = BLOCK - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend"}
HOLDS_P = frozenset({"table", "td", "th", "caption", "button", "object", "body", "html"})
CLOSED_BY_HEAD = frozenset("head".split())

NEVER = frozenset("head script style noscript template nav footer aside form iframe object svg canvas button select textarea input dialog audio video map menu datalist xmp noembed noframes title".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts of class and id names. The second set counts only outside article elements.
NEVER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion nav navbar navigation menu menus sidebar sidebars sidenav breadcrumb breadcrumbs comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices newsletter subscribe subscription share sharing social related recommended pagination pager popup modal overlay skip login signup footer masthead toolbar".split()
)
NEVER_OUTSIDE = frozenset("header banner widget widgets alert".split())
#: Words of names that say where something stands or what shape it has.
PLAIN = frozenset("area bar block body bottom box button buttons col container content dark fixed form global group icon icons inner item items large left light link links list main mini outer page panel post posts primary reader right row secondary section site slot small sticky sub text thread toggle top unit user wide wrap wrapper".split())
#: What a name alone never leaves out: text, whose names are mostly slugs of what it says.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote".split())
CONTROLS = frozenset("form input select textarea button".split())
#: Tags and names whose subtrees are left out whatever they hold.
ALWAYS = frozenset("head script style noscript template iframe object svg canvas select textarea audio video map datalist xmp noembed noframes title comment comments commentlist disqus respond reply replies".split())
#: A subtree with this share of the page's text outside links isn't left out for its name or tag.
NEARLY_ALL = 0.8
CONTENT = frozenset("html body main article".split())
#: Blocks of running text; those of one parent belong together.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())


class _Node:
    __slots__ = ("tag", "parent", "at", "never", "named", "linked", "controls", "chars", "link_chars", "tags", "link_tags", "density", "total", "held")

    def __init__(self, tag: str, parent: int, at: int):
        self.tag, self.parent, self.at, self.never = tag, parent, at, ""
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.held = self.linked = 0  # characters outside links and in them, of what may be left out too
        self.named, self.controls = False, 0  # named in part like what is no content; form controls


def _never(tag: str, attributes: str, in_article: bool) -> tuple[str, bool]:
    """What says that an element is no content, its tag or a name of it, empty if nothing does; and whether a name says so in part.

    A name is one word of a class or an id. It says so if all its parts are of
    menus, adverts and the like, or of places and shapes (``comment-list``), and in
    part if only some are (``related-work``). On text it only ever says so in part.
    """
    if tag in NEVER or (tag == "header" and not in_article):
        return tag, False
    if not attributes or tag in CONTENT:
        return "", False
    partly = False
    for m in _NAMES.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            whole: list[str] = []
            for word in value.split():
                parts = _PART.findall(word)
                found = [x for x in parts if x in NEVER_NAMES or (not in_article and x in NEVER_OUTSIDE)]
                if found and tag not in TEXT and all(x in NEVER_NAMES or x in NEVER_OUTSIDE or x in PLAIN for x in parts):
                    whole += found
                partly = partly or bool(found)
            if whole:
                return min(whole, key=lambda x: x not in ALWAYS), False
        elif name == "role":
            if value in NEVER_ROLES:
                return value, False
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return "template", False
    return "", partly


def parse(html: str) -> tuple[list[_Node], list[tuple[int, str]], list[int]]:
    """Nodes in page order; texts and block edges in page order as (node, text), an edge having text ""; the nodes' last places in that list."""
    nodes = [_Node("#root", -1, 0)]
    events: list[tuple[int, str]] = []
    stack = [0]
    articles = 0
    ends = [0]
    opened: dict[str, int] = {}  # so that nothing is searched in a deep stack that isn't there

    def close(depth: int) -> None:
        nonlocal articles
        while len(stack) > depth:
            k = stack.pop()
            ends[k] = len(events)
            opened[nodes[k].tag] -= 1
            if nodes[k].tag in BLOCK:
                events.append((k, ""))
                ends[k] += 1
            articles -= nodes[k].tag in ("article", "main")

    def close_tags(tags: set | frozenset, until: set | frozenset) -> None:
        if not any(opened.get(t) for t in tags):
            return
        for d in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[d]].tag
            if tag in until:
                return
            if tag in tags:
                close(d)
                return

    at, end = 0, len(html)
    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            events.append((stack[-1], html[at:]))
            break
        if m.start() > at:
            events.append((stack[-1], html[at : m.start()]))
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag == "br":
                events.append((stack[-1], " "))
            for d in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                other = nodes[stack[d]].tag
                if other == tag:
                    close(d)
                    break
                if other in ("table", "article", "main", "body") and tag not in ("table", "article", "main", "body", "html"):
                    break
            continue
        if tag == "br":
            events.append((stack[-1], " "))
        if tag in ENDS_P:
            close_tags({"p"}, HOLDS_P)
            if tag == "body":
                close_tags(CLOSED_BY_HEAD, frozenset())
        if tag in CLOSES:
            close_tags(*CLOSES[tag])
        if tag == "body":
            close_tags(CLOSED_BY_HEAD, frozenset())
        attributes = m[3] if m[2] else m[6]
        node = _Node(tag, stack[-1], len(events))
        node.never, node.named = _never(tag, attributes, articles > 0)
        nodes.append(node)
        ends.append(len(events))
        k = len(nodes) - 1
        if tag in BLOCK:
            events.append((k, ""))
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag not in RAW and tag not in ("a", "b", "i", "span"):
            ends[k] = len(events)
            continue
        if tag in RAW:
            close_at = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, at)
            at = close_at.start() if close_at else end
            stack.append(k)
            opened[tag] = opened.get(tag, 0) + 1
            continue
        articles += tag in ("article", "main")
        stack.append(k)
        opened[tag] = opened.get(tag, 0) + 1
    close(1)
    ends[0] = len(events)
    return nodes, events, ends


def measured(html: str) -> tuple[list[_Node], list[tuple[int, str]], list[int], list[bool]]:
    """What ``parse`` gives, with densities and sums of all nodes, and which nodes are left out."""
    nodes, events, ends = parse(html)
    n = len(nodes)
    in_link, raw = [False] * n, [False] * n
    for k in range(1, n):
        in_link[k] = in_link[nodes[k].parent] or nodes[k].tag == "a"
        raw[k] = raw[nodes[k].parent] or nodes[k].never in ALWAYS
    sizes = [(k, sum(map(len, unescape(text).split()))) if text and not text.isspace() else (k, 0) for k, text in events]
    for k, size in sizes:
        if size and not raw[k]:
            if in_link[k]:
                nodes[k].linked += size
            else:
                nodes[k].held += size
    holds_heading = [False] * n
    for k in range(n - 1, 0, -1):
        up = nodes[k].parent
        nodes[up].held += nodes[k].held
        nodes[up].linked += nodes[k].linked
        nodes[up].controls += nodes[k].controls + (nodes[k].tag in CONTROLS)
        if holds_heading[k] or nodes[k].tag in ("article", "main") or (nodes[k].tag == "h1" and nodes[up].tag not in ("header", "nav", "aside", "footer")):
            holds_heading[up] = True
    dropped = [False] * n
    for k in range(1, n):
        why = nodes[k].never
        if nodes[k].named and (nodes[k].linked > nodes[k].held or (nodes[k].controls and nodes[k].tag not in TEXT)):
            why = "menu"  # a name in part, and a structure that agrees: mostly links, or a form
        whole = why not in ALWAYS and why != "header" and (holds_heading[k] or nodes[k].held >= NEARLY_ALL * nodes[0].held > 0)
        dropped[k] = dropped[nodes[k].parent] or (why != "" and not whole)
    own = [0] * n
    all_chars = all_links = 0
    for k, size in sizes:
        if size and not (dropped[k] and nodes[k].tag in RAW):
            all_chars += size
            all_links += size if in_link[k] else 0
        if not dropped[k]:
            own[k] += size
    for k in range(n - 1, -1, -1):
        node = nodes[k]
        node.chars += own[k]
        if in_link[k]:
            node.link_chars += own[k]
        if node.parent >= 0 and not dropped[k]:
            up = nodes[node.parent]
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags + (node.tag == "a")
    share = all_links / max(all_chars, 1)
    for k in range(n - 1, -1, -1):
        node = nodes[k]
        if dropped[k]:
            continue
        if node.chars:
            tags = max(node.tags, 1)
            base = log(node.chars / max(node.chars - node.link_chars, 1) * node.link_chars + share * node.chars + e)
            node.density = node.chars / tags * log(max(node.chars / max(node.link_chars, 1) * tags / max(node.link_tags, 1), 1.0)) / max(log(base), 1.0)
            if own[k] and not in_link[k]:
                node.total += own[k] * log(max(own[k], 1.0)) / max(log(log(share * own[k] + e)), 1.0)
        if node.parent >= 0:
            nodes[node.parent].total += node.density
    return nodes, events, ends, dropped


def main_text(html: str | None) -> str:
    """The article's blocks, one a line; empty if there is none."""
    if not html:
        return ""
    nodes, events, ends, dropped = measured(html)
    n, best = len(nodes), -1
    for k in range(n):
        if not dropped[k] and nodes[k].chars and (best < 0 or nodes[k].total >= nodes[best].total):
            best = k
    if best < 0:
        return ""
    # The threshold: the least density on the way to the body. Above it, subtrees besides the best one count too.
    least, k, article, path = nodes[best].density, best, -1, set()
    while k >= 0:
        path.add(k)
        if k and nodes[k].tag not in ("body", "html"):
            least = min(least, nodes[k].density)
            if nodes[k].tag == "article" or (nodes[k].tag == "main" and article < 0):
                article = k
        elif nodes[k].tag == "body":
            least = min(least, nodes[k].density)
        k = nodes[k].parent
    chosen, inside = [], [False] * n
    for k in range(1, n):
        inside[k] = inside[nodes[k].parent]
        if not inside[k] and not dropped[k] and (k == best or (k not in path and nodes[k].density >= least)):
            chosen.append(k)
            inside[k] = True
    if not chosen:
        chosen = [best]
    # What lies between chosen blocks, or beside one as a block of the same text, is content unless it is mostly links.
    first, last, parents = min(chosen), max(chosen), set()
    for k in chosen:
        while k > 0 and nodes[k].tag not in RUNNING:
            k = nodes[k].parent
        parents.add(nodes[k].parent if k > 0 else -1)
    for k in range(1, n):
        node = nodes[k]
        inside[k] = inside[k] or inside[node.parent]
        beside = node.tag in RUNNING and node.parent in parents or first < k < last and node.parent in path
        if beside and not inside[k] and not dropped[k] and k not in path and node.chars and 2 * node.link_chars < node.chars:
            chosen.append(k)
            inside[k] = True
    # A chosen part of a running block brings the whole of it.
    for k in [k for k in path if nodes[k].tag in RUNNING and nodes[k].parent in parents]:
        chosen = [c for c in chosen if not (nodes[k].at <= nodes[c].at and ends[c] <= ends[k])] + [k]
    heading = max((k for k in range(1, first) if nodes[k].tag == "h1" and not dropped[k] and not inside[k]), default=-1)
    if heading > 0:
        chosen.append(heading)
    if article > 0 and all(nodes[article].at <= nodes[k].at and ends[k] <= ends[article] for k in chosen):
        chosen = [article]
    lines: list[str] = []
    for top in sorted(chosen):
        parts: list[str] = []
        for k, text in events[nodes[top].at : ends[top]]:
            if not text:
                line = " ".join(unescape("".join(parts)).split())
                if line:
                    lines.append(line)
                parts = []
            elif not dropped[k]:
                parts.append(text)
        line = " ".join(unescape("".join(parts)).split())
        if line:
            lines.append(line)
    return "\n".join(lines)


def extract_text(df: DataFrame, html: str = "html", keep: list[str] | None = None, to: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Columns ``keep`` (default: all but these two), the main text of each page (``to``) and its code points (``n_chars``).

    Columns of df named ``to`` or ``n_chars`` are replaced; other columns stay as
    they are. Null, empty and blank pages, and pages of nothing but menus, have an
    empty text. Rows are independent: repeated rows and null ids stay, an empty
    table gives none. A page's nodes are kept while it is read, one page at a time, whatever its length.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in (to, n_chars)]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(to, T.StringType()), T.StructField(n_chars, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array(np.array([len(x) for x in texts], np.int64))], names=[*keep, to, n_chars])

    return spread(df.select(*keep, F.col(html).alias("__html"))).mapInArrow(released(run), schema)
