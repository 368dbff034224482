"""Main text of web pages by removing what a site repeats.

Every page becomes a tree of elements; each element's subtree (tags and text) has a hash.  Spark counts, per host, the
pages that have a hash; ``templates`` keeps those on a large part of the host's pages.  ``extract`` drops these subtrees,
elements that are no article by their tag or naming (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments), and joins the blocks of the rest.

Null html is an empty page with empty text.  A null url belongs to an empty host.  Repeated rows are pages of their own.
Unclosed elements end with their parent.  Only id, url and html are read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.session import durable

#: A subtree is a template if it stands on so many pages of its host, and on so large a part of them.
LEAST_PAGES, SHARE = 5, 0.5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("head nav footer aside form script style textarea title noscript iframe template button select svg canvas object menu dialog audio video".split())
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|cookies?|consent|notice|gdpr|popup|modal|"
    r"comments?|disqus|replies|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|widget|masthead|topbar)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Quotes count where a value is given only; all repeats are possessive, so a tag that never ends costs one pass.
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>", re.S
)
ATTRIBUTE = re.compile(r"(?<![^\s=/>\"'])([^\s=/>\"']++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))")


class Element:
    __slots__ = ("tag", "dropped", "content", "hash", "title")

    def __init__(self, tag: str, dropped: bool = False) -> None:
        self.tag, self.dropped = tag, dropped
        self.content: list[Element | str] = []
        self.hash = 0


def parse(html: str) -> Element:
    """The tree of a page, as far as its text needs."""
    top = Element("html")
    stack, at, end = [top], 0, len(html)
    standing: Counter[str] = Counter()

    def cut(k: int) -> None:
        standing.subtract(e.tag for e in stack[k:])
        del stack[k:]

    while at < end:
        m, begin = _token(html, at)
        if begin > at:
            stack[-1].content.append(unescape(html[at:begin]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if standing[tag]:
                cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        names = {}
        if m[3] and "=" in m[3]:
            names = {a[0].lower(): a[1] or a[2] or a[3] for a in ATTRIBUTE.findall(m[3])}
        for closed in ({"p"} if tag in CLOSES_P else set(), SELF_CLOSING.get(tag, set())):
            while any(standing[c] for c in closed) and (k := next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in closed or stack[k].tag in ("table", "ul", "ol", "dl", "select", "article", "div", "section", "main", "body")), 0)):
                if stack[k].tag not in closed:
                    break
                cut(k)
        hidden = "hidden" in m[3].lower() and bool(re.search(r"(?:^|\s)hidden(?:\s|=|$|/)", m[3], re.I)) or names.get("aria-hidden") == "true"
        hidden = hidden or "display:none" in names.get("style", "").replace(" ", "")
        kind = f"{names.get('class', '')} {names.get('id', '')}"
        dropped = tag in DROPPED or hidden or names.get("role", "").lower() in ROLES or (tag not in ("html", "body", "article", "main") and bool(NAMED.search(kind)))
        # A page's header is dropped; an article's own header holds its title.
        if tag == "header":
            dropped = dropped or not any(e.tag in ("article", "main") for e in stack)
        element = Element(tag, dropped)
        stack[-1].content.append(element)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            if not close:
                break
            at = html.find(">", close.start()) + 1 or end
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(element)
            standing[tag] += 1
    _hash(top)
    return top


def _token(html: str, at: int) -> tuple[re.Match | None, int]:
    """The next piece of markup and where the text before it ends; a tag that is open at the page's end is text."""
    begin = html.find("<", at)
    while begin >= 0:
        if m := TOKEN.match(html, begin):
            return m, begin
        if html[begin + 1 : begin + 3].lstrip("/")[:1].isalpha() or html[begin + 1 : begin + 2] in ("!", "?"):
            break
        begin = html.find("<", begin + 1)
    return None, len(html)


def _hash(top: Element) -> None:
    """Hashes of all subtrees, from the leaves up, without recursion."""
    order, stack = [], [top]
    while stack:
        e = stack.pop()
        order.append(e)
        stack += [c for c in e.content if isinstance(c, Element)]
    for e in reversed(order):
        inner = "\0".join(" ".join(c.split()) if isinstance(c, str) else str(c.hash) for c in e.content)
        e.hash = int.from_bytes(hashlib.blake2b(f"{e.tag}\0{inner}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def subtree_hashes(top: Element) -> set[int]:
    """Of blocks with text below them, apart from the page as a whole; a word in bold is no template."""
    out, stack = set(), [c for c in top.content if isinstance(c, Element)]
    while stack:
        e = stack.pop()
        if e.content:
            if e.tag in BLOCKS:
                out.add(e.hash)
            stack += [c for c in e.content if isinstance(c, Element)]
    return out


def main_text(top: Element, repeated: set[int]) -> str:
    """Blocks of the article, or of the page where it has none."""
    articles, stack = [], [top]
    while stack:
        e = stack.pop()
        if e.dropped or e.hash in repeated:
            continue
        if e.tag in ("article", "main"):
            articles.append(e)
            continue
        stack += [c for c in reversed(e.content) if isinstance(c, Element)]
    blocks: list[list[str]] = [[]]
    work: list[Element | str | None] = list(reversed(articles)) if articles else [top]
    while work:
        x = work.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif x.tag == "br":
            blocks[-1].append(" ")
        elif not x.dropped and x.hash not in repeated:
            edge = [None] if x.tag in BLOCKS else []
            work += [*edge, *reversed(x.content), *edge]
    texts = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def _hosted(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    host = F.coalesce(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(host, hashes): subtrees on at least ``share`` of a host's pages; so a host has a bounded number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, hashes = [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = subtree_hashes(parse(html or ""))
                hosts += [host] * len(own)
                hashes += own
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64())], names=["host", "hash"])

    hosted = _hosted(pages)
    sizes = hosted.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    counts = hosted.select("host", "html").mapInArrow(run, "host string, hash long").groupBy("host", "hash").agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") >= least_pages).join(sizes, "host").where(F.col("n") >= share * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def extract(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """(page_id, url, text) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(parse(h or ""), set(r or ())) for h, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    joined = _hosted(pages).join(repeated, "host", "left").select("page_id", "url", "html", "hashes")
    return joined.mapInArrow(run, "page_id long, url string, text string")


def main_texts(pages: DataFrame) -> DataFrame:
    return extract(pages, durable(templates(pages)))
