"""Main text of web pages by site template removal.

1. Every page is parsed into elements and every element subtree is hashed
   (tag, classes, text, child hashes).
2. Spark counts, per host, on how many different pages a subtree occurs;
   copies of one page count once. Subtrees on a share of the host's pages are
   its template.
3. A second pass deletes template subtrees and elements whose tag or class
   says that they are no main text, takes the article (else ``main``, else the
   whole body) and writes its blocks line by line.

Paragraphs, headings and other prose inside an article are never template:
a passage that many articles share is their text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.bpe import chunks, raw_texts
from marquee.llm.common import pick, text_or_empty
from marquee.session import materialize

#: A subtree is template from so many pages and such a share of the host's.
MIN_PAGES, MIN_SHARE = 5, 0.1
#: Most template hashes (8 bytes each) that are broadcast.
BROADCAST_HASHES = 1_000_000
SALTS = 32

_words = lambda text: frozenset(text.split())
VOID = _words("area base br col embed hr img input link meta param source track wbr")
BLOCK = _words(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul"
)
#: Elements that are not text, or not main text, whatever they hold.
DROPPED = _words(
    "head script style noscript template svg math iframe object canvas audio video map select textarea button "
    "nav header footer aside form menu dialog"
)
#: Words of class, id and role that say the same.
DROPPED_NAMES = _words(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar widget ad ads advert adverts advertisement "
    "banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended comment comments disqus replies respond pagination pager "
    "toolbar complementary contentinfo search dialog"
)
#: Containers that can be template inside an article too, if they are named.
_CONTAINERS = _words("div section ul ol table")
_CLOSED_BY = {  # an open element that a new one ends, up to the nearest limit
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_P_LIMIT = _words("article aside body button caption dd div figure footer form header html li main nav section table td th ul ol blockquote")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Element:
    __slots__ = ("children", "hash", "names", "tag")

    def __init__(self, tag: str, names: frozenset[str] = frozenset()):
        self.tag, self.names, self.children, self.hash = tag, names, [], 0


#: A tag (with its quoted values), a comment, or other markup.
_MARKUP = re.compile(
    r"""<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
    r"""|<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z>][^>]*+(?:>|\Z)|</>|<(?P<odd_end>/?)(?P<odd_tag>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = _words("script style textarea title noscript iframe xmp noembed noframes")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in _RAW}


def _names(attrs: str) -> frozenset[str]:
    """Lower-case words of class, id and role."""
    found = (value for groups in _ATTRIBUTE.findall(attrs) for value in groups)
    return frozenset(w.lower() for value in found for w in _NAME.findall(value))


def parse(html: str) -> Element:
    """Element tree of a page; broken markup gives the tree it suggests.

    End tags that HTML lets one omit are supplied, others end at the end of
    what holds them; end tags without a start are ignored.
    """
    root = Element("html-root")
    stack = [root]

    def close(tags, limit) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in limit:
                return

    def text(a: int, b: int) -> None:
        if a < b:
            data = html[a:b]
            stack[-1].children.append(unescape(data) if "&" in data else data)

    at = 0
    while m := _MARKUP.search(html, at):
        text(at, m.start())
        at = m.end()
        tag = m["tag"] or m["odd_tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"] or m["odd_end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in BLOCK:
            close({"p"}, _P_LIMIT)
        if tag in _CLOSED_BY:
            for _ in range(2):  # a row also ends the cell in it
                close(*_CLOSED_BY[tag])
        attrs = m["attrs"]
        element = Element(tag, _names(attrs) if attrs and "=" in attrs else frozenset())
        stack[-1].children.append(element)
        if tag in _RAW:
            end = _RAW_END[tag].search(html, at)
            stop = end.start() if end else len(html)
            stack.append(element)
            text(at, stop)
            stack.pop()
            at = stop
        elif tag not in VOID:
            stack.append(element)
    text(at, len(html))
    return root


def _ordered(root: Element) -> list[tuple[Element, bool]]:
    """All elements, parents first, with whether they are inside an article
    or ``main`` (no recursion: nesting may be deep)."""
    out, todo = [], [(root, False)]
    while todo:
        element, inside = todo.pop()
        out.append((element, inside))
        inside = inside or element.tag in ("article", "main")
        todo += [(c, inside) for c in element.children if isinstance(c, Element)]
    return out


def _may_be_template(element: Element, inside: bool) -> bool:
    if element.tag in ("html-root", "html", "body", "article", "main"):
        return False
    return not inside or (element.tag in _CONTAINERS and bool(element.names))


def _hash_templates(ordered: list[tuple[Element, bool]]) -> list[Element]:
    """Hash the subtrees that may be a template part, from the leaves up (0:
    no text inside), and return those with text. What is in none of them,
    such as the prose of an article, isn't hashed."""
    roots = [e for e, inside in ordered if _may_be_template(e, inside)]
    wanted, todo = set(), list(roots)
    while todo:
        e = todo.pop()
        if id(e) not in wanted:
            wanted.add(id(e))
            todo += [c for c in e.children if isinstance(c, Element)]
    for element, _ in reversed(ordered):
        if id(element) not in wanted:
            continue
        parts, filled = [element.tag, *sorted(element.names)], False
        for c in element.children:
            if isinstance(c, Element):
                filled |= c.hash != 0
                parts.append(str(c.hash))
            elif not c.isspace():
                filled = True
                parts.append(" ".join(c.split()))
        element.hash = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "replace"), 1) or 1 if filled else 0
    return [e for e in roots if e.hash]


def subtree_hashes(html: str) -> list[int]:
    """Distinct hashes of the subtrees that may be a template part."""
    return list({e.hash for e in _hash_templates(_ordered(parse(html)))})


def _has_title(element: Element) -> bool:
    return any(e.tag == "h1" for e, _ in _ordered(element))


def main_text(html: str, template: set[int]) -> str:
    """Main text without ``template`` subtrees: blocks joined by newlines."""
    root = parse(html)
    ordered = _ordered(root)
    recurring = {id(e) for e in _hash_templates(ordered) if e.hash in template} if template else ()
    place = {id(e): inside for e, inside in ordered}

    def dropped(e: Element) -> bool:
        inside = place[id(e)]
        if id(e) in recurring:
            return True
        if e.tag in ("html-root", "html", "body", "main"):
            return False
        named = e.tag in DROPPED or (e.names & DROPPED_NAMES and not (e.tag == "article" and not inside))
        # the title of an article may stand in a header of its own
        return bool(named) and not (inside and (e.tag == "header" or "header" in e.names) and _has_title(e))

    starts: list[Element] = []
    for wanted in ("article", "main", None):
        todo = [root]
        while todo:
            e = todo.pop()
            if e is not root and dropped(e):
                continue
            if e.tag == wanted or (wanted == "main" and "main" in e.names):
                starts.append(e)
            else:
                todo += [c for c in reversed(e.children) if isinstance(c, Element)]
        if starts or wanted is None:
            break
    blocks: list[str] = []
    line: list[str] = []

    def end_block() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            blocks.append(text)

    for start in starts or [root]:
        todo = [start]
        while todo:
            item = todo.pop()
            if item is None:
                end_block()
            elif isinstance(item, str):
                line.append(item)
            elif item is start or not dropped(item):
                if item.tag == "br":
                    line.append(" ")
                    continue
                if item.tag in BLOCK:
                    end_block()
                    todo.append(None)
                todo += reversed(item.children)
        end_block()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without port; empty for none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def site_templates(pages: DataFrame) -> DataFrame:
    """(host, hash, n_pages): subtrees that recur on a host's pages.

    ``pages``: (host, html). A host has at most (subtrees of its average page
    / MIN_SHARE) of them, however many pages it has. Counts are of distinct
    pages and partial before the shuffle by host, so a hot host is one row
    per subtree from each task.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                raws = list(raw_texts(part.column(1)))
                hashes = [subtree_hashes(raw.decode("utf-8", "replace")) for raw in raws]
                # hash 0 stands for the page itself
                n = [len(h) + 1 for h in hashes]
                flat = np.array([x for h in hashes for x in (0, *h)], np.uint64).view(np.int64)
                pages_ = np.repeat(np.array([xxhash.xxh64_intdigest(raw) for raw in raws], np.uint64).view(np.int64), n)
                hosts = part.column(0).take(pa.array(np.repeat(np.arange(len(raws)), n)))
                yield pa.RecordBatch.from_arrays([hosts, pa.array(flat), pa.array(pages_)], ["host", "hash", "page"])

    found = pages.mapInArrow(work, "host string, hash bigint, page bigint")
    counted = found.distinct().groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n_pages"))
    per_host = counted.where("hash = 0").select("host", F.col("n_pages").alias("all_pages"))
    often = counted.where((F.col("hash") != 0) & (F.col("n_pages") >= MIN_PAGES))
    return often.join(per_host, "host").where(F.col("n_pages") >= MIN_SHARE * F.col("all_pages")).select("host", "hash", "n_pages")


def extract_pages(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) for every row; text is empty where there is none
    (null or empty html among them). Pages without a host form one host.
    Repeated rows give repeated rows.

    The templates per host are written to the shared folder first; their
    number decides between a broadcast and a salted join with the pages.
    """
    pages = pick(df, page_id, url, html).toDF("page_id", "url", "html")
    pages = pages.withColumn("html", text_or_empty("html")).withColumn("host", host_of(F.col("url")))
    templates = materialize(site_templates(pages.select("host", "html")), "site-templates")
    per_host = templates.groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("template"))
    if templates.count() <= BROADCAST_HASHES:
        joined = pages.join(F.broadcast(per_host), "host", "left")
    else:  # a hot host is spread over several tasks
        salted = per_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        joined = pages.withColumn("salt", salt).join(salted, ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "template")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 2):
                templates_ = [frozenset(x % 2**64 for x in t or ()) for t in part.column(3).to_pylist()]
                texts = [main_text(raw.decode("utf-8", "replace"), t) for raw, t in zip(raw_texts(part.column(2)), templates_)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(work, f"page_id {kind}, url string, text string")
