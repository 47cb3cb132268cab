"""Main text of web pages: templates of a site are found as subtrees that many of its pages share."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from weir.llm.common import ROWS_PER_STEP, pinned

MIN_PAGES = 5                  # distinct pages of a host from which a subtree can be a template
OUTSIDE_SHARE = 0.01           # share of the host's distinct pages, for parts outside the article
INSIDE_SHARE = 0.3             # and for containers inside it, whole paragraphs and table rows
INSIDE_PAGES = 10              # or, for containers inside it, so many distinct pages
INSIDE_FEW = 0.001             # that are this share of them

# Element names of the published HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp".split())
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption address summary".split())
CONTAINERS = set("div section ul ol dl table tbody thead tfoot tr form fieldset nav aside header footer figure details "
                 "menu dialog center".split())
BLOCKS = PARAGRAPHS | CONTAINERS | set("html head body article main hr option".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}}
NEVER_TEXT = RAW | set("head nav footer aside button select option menu dialog template svg canvas audio video "
                       "object applet map".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                      "toolbar".split())
FURNITURE = set(
    "ad ads advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs comment "
    "comments commentlist consent cookie cookies copyright disqus footer gdpr masthead menu menus modal nav navbar navigation "
    "newsletter notice notices notification pagination pager popup promo promos promotion recommended related replies respond "
    "share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription teaser teasers "
    "toolbar topbar widget widgets".split())
ROWS = set("tr tbody thead tfoot".split())        # equal rows are data, not notices
CONTENT_NAMES = set("article articlebody body content entry main post story text".split())
#: never taken for furniture by their names, as those of a heading or paragraph tell what it is about
OWN_TEXT = set("article html body main p h1 h2 h3 h4 h5 h6".split())

_STOPS = CONTAINERS | set("article main body html td th li dd blockquote".split())
_DECIDING = _STOPS | set(CLOSES) | {"p"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMING = {"class", "id", "role", "itemprop"}
_WORD = re.compile(r"[a-z0-9]+")


def called(names: set[str], kinds: set[str]) -> bool:
    """Whether a whole name is one of ``kinds``, or made of nothing else (cookie-notice)."""
    return any(words and kinds.issuperset(words) for words in map(_WORD.findall, names))


class _Node:
    __slots__ = ("tag", "names", "role", "up", "near", "items", "size", "hash", "off")

    def __init__(self, tag: str, attributes: str, up: "_Node | None"):
        self.tag, self.up, self.items, self.size, self.hash, self.off = tag, up, [], 0, 0, False
        #: the innermost element, itself included, that decides where a block goes
        self.near = self if tag in _DECIDING or up is None else up.near
        self.names, self.role, seen = set(), "", set()
        for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
            name = name.lower()
            if name not in _NAMING or name in seen:
                continue
            seen.add(name)
            value = next(filter(None, values), "").lower()
            if name == "role":
                self.role = value
            # the id of a section may be that of its heading
            if name != "id" or tag != "section":
                self.names |= set(value.split())


def parse(page: str) -> _Node:
    """The element tree; elements that were left open end where their parent does.  Every step moves on
    in the page or closes elements, so the work grows with the page's length."""
    root = node = _Node("", "", None)
    at, end, last = 0, len(page), page.rfind(">")
    open_ = Counter()              # how many elements of a name are open

    def closed(upto: _Node) -> _Node:
        """Closes the open elements up to this one."""
        other = node
        while True:
            open_[other.tag] -= 1
            if other is upto:
                return other.up
            other = other.up

    while at < end:
        found = _TOKEN.search(page, at) if at <= last else None
        stop = found.start() if found else _open_comment(page, at)
        if stop > at:
            node.items.append(page[at:stop])
        if not found:
            break
        at = found.end()
        closing, tag, attributes = found[1] if found[2] else found[4], found[2] or found[5], found[3] if found[2] else found[6]
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if open_[tag]:
                other = node
                while other.tag != tag:
                    other = other.up
                node = closed(other)
            continue
        if tag in BLOCKS:
            ended = _ended(node, tag)
            if ended is not None:
                node = closed(ended)
        child = _Node(tag, attributes, node)
        node.items.append(child)
        if tag in RAW:
            raw_end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = raw_end.end() if raw_end else end
        elif tag not in VOID and not attributes.endswith("/"):
            node = child
            open_[tag] += 1
    return root


def _open_comment(page: str, at: int) -> int:
    """Where text without further tags ends: a comment that is never closed takes the rest."""
    start = page.find("<!--", at)
    return len(page) if start < 0 else start


def _ended(node: _Node, tag: str) -> _Node | None:
    """The open element that ends before a new block: a paragraph, or an item of its kind."""
    ends, other = CLOSES.get(tag, ()), node.near
    while other.up is not None:
        if other.tag == "p" or other.tag in ends:
            return other
        if other.tag in _STOPS:
            return None
        other = other.up.near
    return None


def _walk(root: _Node) -> list[_Node]:
    """Every element, parents first."""
    out, left = [], [root]
    while left:
        node = left.pop()
        out.append(node)
        left.extend(x for x in reversed(node.items) if not isinstance(x, str))
    return out


def measured(root: _Node) -> list[_Node]:
    """Marks what is never article text, and gives each subtree its hash and the size of its text."""
    nodes = _walk(root)
    inside, named = {id(root): False}, set()
    for node in nodes[1:]:
        inside[id(node)] = within = inside[id(node.up)] or node.up.tag in ("article", "main")
        node.off = node.tag in NEVER_TEXT or node.tag == "header" and not within
        if node.off or node.tag in OWN_TEXT:
            continue
        # whole pages are wrapped in forms, and roles are given like names
        if node.tag == "form" or node.role in FURNITURE_ROLES or node.names and (
                called(node.names, FURNITURE) or not within and "header" in node.names):
            named.add(id(node))
    if named:
        _keep_article(nodes, named)
    for node in nodes:
        node.off = node.off or id(node) in named
    for node in reversed(nodes):
        parts, size = [node.tag], 0
        for item in node.items:
            if isinstance(item, str):
                text = " ".join(html.unescape(item).split())
                if text:
                    parts.append(text)
                    size += len(text)
            else:
                parts.append(f"\x00{item.hash:x}")
                size += 0 if item.off else item.size
        node.size = size
        node.hash = xxhash.xxh64_intdigest("\x01".join(parts).encode("utf-8", "replace"))
    return nodes


def _keep_article(nodes: list[_Node], named: set[int]) -> None:
    """Takes out of ``named`` what holds the article, or most of the page's text where no article is left."""
    sizes: dict[int, int] = {}
    for node in reversed(nodes):
        sizes[id(node)] = sum(
            len(" ".join(x.split())) if isinstance(x, str) else 0 if x.off else sizes[id(x)] for x in node.items)
    most = sizes[id(nodes[0])] / 2

    def free(node: _Node | None) -> None:
        while node is not None:
            named.discard(id(node))
            node = node.up

    off = _hidden(nodes)
    wide = [n for n in nodes if n.tag in ("article", "main") and sizes[id(n)] and id(n) not in off]
    for node in wide:
        if sizes[id(node)] > most:
            free(node)
    gone = _hidden(nodes, named)
    if any(id(n) not in gone and sizes[id(n)] and any(fits(n) for fits in ARTICLES) for n in nodes):
        return
    if wide:
        free(max(wide, key=lambda n: (n.tag == "article", sizes[id(n)])))
    else:
        named -= {id(n) for n in nodes if sizes[id(n)] > most}


def _hidden(nodes: list[_Node], named: set[int] = frozenset()) -> set[int]:
    """The elements that are off or named, and those inside them; ``nodes`` has parents first."""
    out: set[int] = set()
    for node in nodes:
        if node.off or id(node) in named or id(node.up) in out:
            out.add(id(node))
    return out


ARTICLES = (lambda n: n.tag == "article", lambda n: n.tag == "main" or n.role == "main",
            lambda n: n.tag in CONTAINERS and called(n.names, CONTENT_NAMES))


def articles(nodes: list[_Node]) -> list[_Node]:
    """The element that holds the article: of the visible ones the one with most text.  Article elements
    beside it, under the same parent, belong to it: a page may hold its text in several."""
    off = _hidden(nodes)
    for fits in (*ARTICLES, lambda n: n.tag == "body"):
        found = [n for n in nodes if fits(n) and n.size and id(n) not in off]
        if found:
            main = max(found, key=lambda n: n.size)
            return [n for n in found if n.up is main.up] if main.tag == "article" else [main]
    return nodes[:1]


def _above(mains: list[_Node]) -> set[int]:
    """The article's elements and those around them, which are never cut."""
    out: set[int] = set()
    for node in mains:
        while node is not None and id(node) not in out:
            out.add(id(node))
            node = node.up
    return out


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def subtrees(page: str) -> tuple[int, list[int], list[int], list[int]]:
    """Hash of the article's element; of the subtrees that count as parts outside, as containers inside,
    and as whole paragraphs outside or table rows inside."""
    nodes = measured(parse(page))
    mains = articles(nodes)
    above = _above(mains)
    inside, outer, inner, plain = {id(n) for n in mains}, set(), set(), set()
    for node in nodes[1:]:
        if id(node.up) in inside:
            inside.add(id(node))
        if id(node) in above or not node.size or node.tag not in CONTAINERS | PARAGRAPHS:
            continue
        if id(node) in inside and mains[0].tag in ("article", "main"):
            if node.tag in CONTAINERS:
                (plain if node.tag in ROWS else inner).add(_signed(node.hash))
        else:
            (outer if node.tag in CONTAINERS else plain).add(_signed(node.hash))
    whole = mains[0].hash if len(mains) == 1 else xxhash.xxh64_intdigest("".join(f"{n.hash:x}\x01" for n in mains))
    return _signed(whole), sorted(outer - inner - plain), sorted(inner), sorted(plain)


def main_text(page: str, templates: set[int]) -> str:
    """The article's blocks without furniture and without the given subtrees, one to a line."""
    mains = articles(measured(parse(page)))
    above = _above(mains)
    blocks: list[str] = []
    current: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(current)).split())
        current.clear()
        if text:
            blocks.append(text)

    left: list = mains[::-1]
    while left:
        item = left.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            current.append(item)
        elif id(item) not in above and (item.off or item.tag in CONTAINERS | PARAGRAPHS and _signed(item.hash) in templates):
            if item.tag in BLOCKS:
                end()
        elif item.tag == "br":
            current.append(" ")
        else:
            if item.tag in BLOCKS:
                end()
                left.append(None)
            left.extend(reversed(item.items))
    end()
    return "\n".join(blocks)


def _host(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, outside: float = OUTSIDE_SHARE,
              inside: float = INSIDE_SHARE, inside_pages: int = INSIDE_PAGES, inside_few: float = INSIDE_FEW) -> DataFrame:
    """``(key, subtrees)``: which subtrees of each of ``pages(key, host, body)`` are templates.

    A subtree counts once for every different article it stands beside, so copies of a page do not
    make its article a template.  Outside the article ``outside`` of the host's articles make a template,
    inside it ``inside`` of them or, for containers, ``inside_pages`` that are at least ``inside_few`` of
    them; fewer than ``min_pages`` never do.  Counts combine before each shuffle; the key of a count holds the
    subtree, so a host with a third of all pages is spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_STEP):
                part = batch.slice(at, ROWS_PER_STEP)
                main, outer, inner, plain = zip(*map(subtrees, part.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(main, pa.int64()), pa.array(outer, pa.list_(pa.int64())),
                     pa.array(inner, pa.list_(pa.int64())), pa.array(plain, pa.list_(pa.int64()))],
                    names=["key", "host", "main", "outer", "inner", "plain"])

    lists = "outer array<long>, inner array<long>, plain array<long>"
    found = pinned(pages.mapInArrow(run, f"key long, host long, main long, {lists}"), "subtrees")
    each = lambda name: found.select("key", "host", "main", F.explode(name).alias("subtree"), F.lit(name).alias("part"))
    rows = each("outer").union(each("inner")).union(each("plain"))
    sizes = found.select("host", "main").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("articles"))
    counts = rows.select("host", "subtree", "part", "main").distinct().groupBy("host", "subtree", "part").agg(
        F.count(F.lit(1)).alias("n"))
    least = F.when(F.col("part") == "outer", F.col("articles") * outside).when(F.col("part") == "inner", F.least(
        F.col("articles") * inside, F.greatest(F.lit(float(inside_pages)), F.col("articles") * inside_few))).otherwise(
        F.col("articles") * inside)
    many = pinned(counts.filter(F.col("n") >= min_pages), "many").join(pinned(sizes, "hosts"), "host").filter(F.col("n") >= least)
    often = pinned(many.select("host", "subtree", "part"), "templates")
    return rows.join(often, ["host", "subtree", "part"], "left_semi").groupBy("key").agg(
        F.collect_set("subtree").alias("subtrees"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_pages: int = MIN_PAGES, outside: float = OUTSIDE_SHARE, inside: float = INSIDE_SHARE) -> DataFrame:
    """Per page: id, url, ``text`` of its article and ``n_chars``.

    The element tree is hashed bottom up, subtrees are counted per host over its different articles,
    and those that recur are cut out together with elements that HTML or their class names call menus,
    notices, adverts, comments and the like.  NULL and empty pages, and pages without text, give an
    empty text.  Pages without a host share one.  Repeated rows are extracted each.  Other columns are
    left out, so names cannot clash; an empty table gives no rows.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    keyed = pages.select(
        F.col(id_col), F.col(url_col), F.xxhash64(F.col(url_col), body).alias("key"),
        F.xxhash64(_host(url_col)).alias("host"), body.alias("body"))
    cut = templates(keyed.select("key", "host", "body"), min_pages, outside, inside)
    rows = keyed.join(cut, "key", "left").select(F.struct(id_col, url_col).alias("kept"), "body", "subtrees")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_PER_STEP):
                part = batch.slice(at, ROWS_PER_STEP)
                texts = [main_text(p, set(s or ())) for p, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["kept", "text"])

    out = rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, text string")
    return out.select(F.col(f"kept.{id_col}"), F.col(f"kept.{url_col}"), "text", F.length("text").cast("long").alias("n_chars"))
