"""Operator 11: main text of web pages, with each site's template removed.

Pages are parsed once. The parse cuts the main text in blocks and hashes the subtree of
every block element in it (its tag, texts and inner subtrees, not the attributes). A subtree
comes with the blocks it spans and its setting, the longest block of the page outside it.
Spark counts per host in how many different settings a subtree stands, and deletes subtrees
that stand in at least ``MIN_SETTINGS`` of them and in ``MIN_SHARE`` of those of the host:
menus, notices, footers. Copies of a page repeat its settings too, so they do not make its
text a template.

What the markup says itself counts first: scripts, styles, navigation, forms and the like
go by their tag, and elements whose class, id or role names them so (``PARTS``). An article
or main element, where there is one, is the main text. Inside it, only containers can be
template, never paragraphs, headings or list items: a passage many articles quote is text.

Defined cases: null or empty html has an empty text; pages without a host are counted
together; tags that are never closed end where an outer one does, or with the page; unclosed
comments and scripts reach to its end; repeated rows each get a row; of no rows come none;
other columns do not matter. A worker holds one page at a time, whole.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loglantern.llm.common import pick, saved, table

MIN_SETTINGS = 4
MIN_SHARE = 0.2
OUT_BYTES = 1 << 22

#: Elements of HTML by what they mean for text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
GONE = frozenset(
    "head script style template noscript iframe object embed svg math canvas audio video map nav aside footer form "
    "button select option textarea input dialog menu noembed noframes datalist title".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr table tbody thead tfoot caption figcaption ul ol dl".split())
BLOCKS = TEXT_BLOCKS | frozenset(
    "html body div section article main header footer nav aside form figure address hgroup fieldset details summary "
    "dialog menu center hr search".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What opening a tag closes, if it is open inside the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Words in class, id or role that name a part of a page that is no main text.
PARTS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toc masthead banner topbar footer foot "
    "colophon contentinfo sidebar aside complementary rail widget widgets ad ads advert adverts advertisement "
    "advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup "
    "modal overlay dialog newsletter subscribe subscription signup login signin register search searchbox form social "
    "share sharing sharebar follow related recommended recommendations trending popular comment comments commentlist "
    "disqus replies respond discussion skip skiplink copyright legal disclaimer toolbar print hidden".split()
)
#: Words that do so outside the main text only; inside it they stand for its own head.
OUTER_PARTS = frozenset("header head top".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)"
    r"(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


@dataclass(slots=True)
class Element:
    tag: str
    names: frozenset = frozenset()
    hidden: bool = False
    children: list = field(default_factory=list)  # elements and texts


def parse(page: str) -> Element:
    """The tree of a page; never fails."""
    root = Element("")
    open_: list[Element] = [root]
    at, end = 0, len(page)
    while at < end:
        token = _TOKEN.search(page, at)
        text = page[at : token.start() if token else end]
        if text:
            open_[-1].children.append(entities.unescape(text) if "&" in text else text)
        if token is None:
            break
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if token["end"]:
            _close(open_, tag)
        else:
            at = _open(open_, tag, token["attributes"], page, at)
    return root


def _open(open_: list[Element], tag: str, attributes: str, page: str, at: int) -> int:
    if tag in CLOSES:
        _close_implied(open_, *CLOSES[tag])
    elif tag in BLOCKS:
        _close_implied(open_, {"p", *HEADINGS} if tag in HEADINGS else {"p"}, {"table", "td", "th", "li", "button", "object"})
    names, hidden = _named(attributes)
    element = Element(tag, names, hidden)
    open_[-1].children.append(element)
    if tag in RAW:
        close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
        body = page[at : close.start() if close else len(page)]
        element.children.append(body)
        return close.end() if close else len(page)
    if tag not in VOID:
        open_.append(element)
    return at


def _close_implied(open_: list[Element], tags: set[str], within: set[str]) -> None:
    """Closes what is open of the tags, outermost first, inside the nearest of ``within``."""
    outermost = 0
    for i in range(len(open_) - 1, 0, -1):
        if open_[i].tag in within:
            break
        if open_[i].tag in tags:
            outermost = i
    if outermost:
        del open_[outermost:]


def _close(open_: list[Element], tag: str) -> None:
    for i in range(len(open_) - 1, 0, -1):
        if open_[i].tag == tag:
            del open_[i:]
            return
        if open_[i].tag in BLOCKS and tag not in BLOCKS:
            return  # an inline end tag does not end a block


def _named(attributes: str) -> tuple[frozenset, bool]:
    if "=" not in attributes and "hidden" not in attributes.lower():
        return frozenset(), False
    words: list[str] = []
    hidden = False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id", "role", "data-role"):
            words += _NAME_WORD.findall(value)
            words += re.findall("[A-Za-z]+", value)  # sideBar is a sidebar too
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
        elif name == "itemprop" and value == "articleBody":
            words.append("articlebody")
    return frozenset(w.lower() for w in words), hidden


# --- main part, subtrees and blocks --------------------------------------------------------


def _is_part(element: Element, inside: bool) -> bool:
    """Whether tag or names say that this is no main text."""
    if element.tag in GONE or element.hidden:
        return True
    if element.tag in ("html", "body", "main", ""):
        return False
    if element.tag == "article":
        return bool(element.names & {"comment", "comments", "related", "sponsored", "advertisement", "ad", "promo"})
    if element.names & PARTS:
        return True
    return not inside and (element.tag == "header" or bool(element.names & OUTER_PARTS))


def _elements(element: Element) -> Iterator[Element]:
    return (c for c in element.children if isinstance(c, Element))


def main_parts(root: Element) -> tuple[list[Element], bool]:
    """The elements that hold the main text, and whether the page names them so."""
    for wanted in (lambda e: e.tag == "article" or "articlebody" in e.names, lambda e: e.tag == "main" or e.names == {"main"}):
        found: list[Element] = []
        stack = [root]
        while stack:
            element = stack.pop()
            if element is not root and wanted(element) and not _is_part(element, True):
                found.append(element)
            elif not (element.tag in GONE or element.hidden or (element.names & PARTS and element.tag not in ("html", "body"))):
                stack.extend(reversed(list(_elements(element))))
        if any(_text_of(e) for e in found):
            return found, True
    return [root], False


def _text_of(element: Element) -> bool:
    stack = [element]
    while stack:
        for child in stack.pop().children:
            if isinstance(child, str):
                if not child.isspace():
                    return True
            elif not _is_part(child, True):
                stack.append(child)
    return False


def _hash(data: str) -> int:
    return int.from_bytes(blake2b(data.encode(), digest_size=8).digest(), "big", signed=True)


class Reader:
    """Walks elements in page order, cuts their text in blocks and hashes subtrees."""

    def __init__(self) -> None:
        self.blocks: list[str] = []
        self.subtrees: list[tuple[int, int, int]] = []  # hash, first block, block after the last
        self.run: list[str] = []

    def _end_block(self, parts: list[str]) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            self.run = []
            if text:
                self.blocks.append(text)
                parts.append(text)

    def read(self, root: Element, named: bool) -> None:
        """``named`` says that the page names its main part, which ``root`` then is. Texts
        inside inline elements belong to the block around them."""
        stack = [(root, iter(root.children), [root.tag], 0)]
        while stack:
            element, children, parts, first = stack[-1]
            child = next(children, None)
            if child is None:
                stack.pop()
                if element.tag in BLOCKS or not stack:
                    self._end_block(parts)
                    self._leave(element, parts, first, named, stack)
            elif isinstance(child, str):
                self.run.append(child)
            elif child.tag in VOID:
                if child.tag == "br":
                    self.run.append(" ")
            elif not _is_part(child, named):
                if child.tag in BLOCKS:
                    self._end_block(parts)
                    stack.append((child, iter(child.children), [child.tag], len(self.blocks)))
                else:
                    stack.append((child, iter(child.children), parts, first))

    def _leave(self, element: Element, parts: list[str], first: int, named: bool, stack: list) -> None:
        if len(self.blocks) == first or not stack:
            return
        key = _hash("\x00".join(parts))
        stack[-1][2].append(f"<{key}>")
        if not (named and element.tag in TEXT_BLOCKS):
            self.subtrees.append((key, first, len(self.blocks)))


def read_page(page: str) -> tuple[list[str], list[tuple[int, int, int, int]]]:
    """The blocks of a page's main text, and for each subtree that may be template its hash,
    the hash of its setting, and the blocks it spans (from first to before last)."""
    parts, named = main_parts(parse(page))
    reader = Reader()
    for part in parts:
        reader.read(part, named)
    blocks = reader.blocks
    longest = sorted(range(len(blocks)), key=lambda i: (-len(blocks[i]), i)) if reader.subtrees else []
    hashes: dict[int, int] = {}
    found = []
    for key, first, last in reader.subtrees:
        setting = next((i for i in longest if not first <= i < last), None)
        if setting is not None:  # what holds the whole text stands in no setting
            if setting not in hashes:
                hashes[setting] = _hash(blocks[setting])
            found.append((key, hashes[setting], first, last))
    return blocks, found


# --- Spark ---------------------------------------------------------------------------------

_TREE = "struct<tree: long, setting: long, first: int, last: int>"
_TREES = pa.list_(pa.struct([("tree", pa.int64()), ("setting", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user and port; empty where there is none."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.lower(host)


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, blocks, trees of each page."""
    rows = pick(pages, "page_id", "url", "html")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begun, size, read_ = 0, 0, []
            for i, page in enumerate(batch.column("html")):
                read_.append(read_page(page.as_py() or ""))
                size += sum(map(len, read_[-1][0]))
                if size >= OUT_BYTES or i + 1 == len(batch):
                    blocks, trees = zip(*read_)
                    trees = [[dict(zip(("tree", "setting", "first", "last"), t)) for t in page] for page in trees]
                    kept = [batch.column(c).slice(begun, len(read_)) for c in ("page_id", "url", "host")]
                    yield pa.RecordBatch.from_arrays(
                        [*kept, pa.array(blocks, pa.list_(pa.string())), pa.array(trees, _TREES)], names=["page_id", "url", "host", "blocks", "trees"]
                    )
                    begun, size, read_ = i + 1, 0, []

    kind = dict(rows.dtypes)["page_id"]
    with_host = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    return with_host.mapInArrow(read, f"page_id {kind}, url string, host string, blocks array<string>, trees array<{_TREE}>")


def site_templates(read: DataFrame, min_settings: int = MIN_SETTINGS, min_share: float = MIN_SHARE) -> DataFrame:
    """host, template: the hashes of each host's recurring subtrees. Each of them stands in a
    share of the host's settings, so there are no more than a page's subtrees over
    ``min_share`` on the average, whatever the number of pages."""
    found = read.select("host", F.explode("trees").alias("t")).select("host", "t.tree", "t.setting").distinct()
    counted = found.groupBy("host", "tree").agg(F.count(F.lit(1)).alias("settings")).where(F.col("settings") >= min_settings)
    sizes = found.select("host", "setting").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all_settings"))
    often = counted.join(sizes, "host").where(F.col("settings") >= F.col("all_settings") * min_share)
    return often.groupBy("host").agg(F.sort_array(F.collect_list("tree")).alias("template"))


def extract(pages: DataFrame, min_settings: int = MIN_SETTINGS, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars of each page. Where all templates together are small,
    Spark sends them to the pages; else pages meet them by host, large hosts split."""
    read = saved(read_pages(pages), "site-pages")
    templates = saved(site_templates(read, min_settings, min_share), "site-templates")
    joined = read.join(templates, "host", "left")
    gone = F.filter("trees", lambda t: F.array_contains("template", t.tree))
    joined = joined.withColumn("gone", F.when(F.col("template").isNotNull(), gone))
    kept = F.filter("blocks", lambda _, i: ~F.exists("gone", lambda t: (t.first <= i) & (i < t.last)))
    blocks = F.when(F.size("gone") > 0, kept).otherwise(F.col("blocks"))
    text = F.array_join(blocks, "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


SQL = None  # trees
