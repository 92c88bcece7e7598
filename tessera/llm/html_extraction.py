"""Operator 12, HTML extraction by site template removal.

The subtrees of a page's elements are hashed from their tags, texts and children, bottom up. Spark counts
for each host how many different pages have a subtree, and those that recur on ``least`` pages
and on ``percent`` hundredths of the host's pages are its template and go. A page that is a copy
of another counts once, so copied articles aren't taken for a template. What a
host has too few pages to show goes by what its tag, role or class names: menus, headers,
footers, sidebars, notices, adverts, forms, comments, scripts and styles.

The text is that of the page's ``article`` elements, or else of what is marked as main; there
paragraphs, headings, lists and tables are the author's and stay, however often they
recur, and only boxes (``BOXES``) can be template. Where nothing is marked, all of the body is
looked at, and every element can be template.

Pages are parsed once, and written with the hashes above each piece of text. A host's template has
at most ``100 / percent`` times the subtrees of a mean page, so it is one bounded row, joined by host:
below its threshold the planner broadcasts the templates, beyond it the join splits hosts of many pages.

Defined cases: null or empty html, or html without text, gives an empty text; a page without markup is
one block; a null url, or one without a host, is of the host ``''``; rows that repeat an id are pages each; unclosed
elements, comments and tags end as a browser ends them; beyond a depth of ``DEPTH`` elements nest no
deeper; white space is what Unicode calls so; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table, written

DEPTH = 512
#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEAD = frozenset("base link meta noscript script style template title".split())
#: An open element of the first kind ends where one of the second kind starts inside it, unless one of the third lies between.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}), "option": ({"option"}, {"select"}),
}
#: What is no main text, by tag, role, and words of class or id.
GONE_TAGS = frozenset("aside audio button canvas dialog embed footer form head iframe math menu nav noscript object script select style svg template textarea title video xmp".split())
GONE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
GONE_WORDS = frozenset(
    """ad ads adsense advert advertisement advertisements advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu menus modal nav
    navbar navigation newsletter notice notices pager pagination popup promo recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget""".split()
)
MAIN_CLASSES = frozenset("article article-body article-content article-text content entry entry-content main main-content page-content post post-body post-content story story-body".split())
BOXES = frozenset("aside center details div footer form header nav section".split())

TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile("[a-z]+|[A-Z][a-z]*")
RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*>?|\\Z", re.I) for tag in RAW}


class Page:
    """The elements of a page in the order of their starts, and its pieces of text."""

    def __init__(self, html: str):
        self.tag, self.parent, self.marks, self.hash, self.has_text = [], [], [], [], []
        self.pieces: list[tuple[int, int, str]] = []  # element, block, text
        self.open: list[int] = []
        self.inner: list[list[str]] = []  # of each open element: its texts and its children's hashes
        self.block = 0
        self.read(html)
        while self.open:
            self.end()

    def start(self, tag: str, attributes: str) -> None:
        self.tag.append(tag)
        self.parent.append(self.open[-1] if self.open else -1)
        self.marks.append(marks(attributes) if "=" in attributes else {})
        self.hash.append(0)
        self.has_text.append(False)
        self.open.append(len(self.tag) - 1)
        self.inner.append([])

    def end(self) -> None:
        i, inner = self.open.pop(), self.inner.pop()
        value = xxhash.xxh3_64_intdigest("\0".join([self.tag[i], *inner])) - (1 << 63)
        self.hash[i] = value
        if self.inner:
            self.inner[-1].append(f"\1{value}")
            self.has_text[self.open[-1]] |= self.has_text[i]

    def end_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self.end()

    def nearest(self, wanted, barrier) -> int | None:
        """The depth of the innermost open element of ``wanted``, if none of ``barrier`` lies inside it."""
        for depth in range(len(self.open) - 1, -1, -1):
            tag = self.tag[self.open[depth]]
            if tag in wanted:
                return depth
            if tag in barrier:
                return None
        return None

    def text(self, raw: str) -> None:
        value = unescape(raw) if "&" in raw else raw
        own = " ".join(value.split())
        at = self.open[-1] if self.open else -1
        if own and self.open:
            self.inner[-1].append(own)
            self.has_text[at] = True
        self.pieces.append((at, self.block, value))

    def read(self, html: str) -> None:
        at = 0
        while at < len(html):
            found = TOKEN.search(html, at)
            if found is None:
                self.text(html[at:])
                return
            if found.start() > at:
                self.text(html[at : found.start()])
            at, tag = found.end(), (found[2] or "").lower()
            if not tag or at == len(html) and html[-1] != ">":
                continue
            if found[1]:
                self.end_tag(tag)
            else:
                self.start_tag(tag, found[3])
                if tag in RAW:
                    at = RAW_END[tag].search(html, at).end()
                    self.end_tag(tag)

    def start_tag(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self.nearest({tag}, ()) is not None:
            return
        if tag not in HEAD and (head := self.nearest({"head"}, ())) is not None:
            self.end_to(head)
        if tag in BLOCKS:
            self.block += 1
            if (p := self.nearest({"p"}, BLOCKS)) is not None:
                self.end_to(p)
        if tag in ENDED_BY and (other := self.nearest(*ENDED_BY[tag])) is not None:
            self.end_to(other)
        if tag in VOID:
            if tag == "br":
                self.text(" ")
        elif len(self.open) < DEPTH:
            self.start(tag, attributes)

    def end_tag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.block += 1
        if tag in ("html", "body"):
            return
        depth = self.nearest({tag}, () if tag in BLOCKS or tag in RAW or tag == "head" else BLOCKS)
        if depth is not None:
            self.end_to(depth)


def marks(attributes: str) -> dict[str, set[str]]:
    """Of an element's class, id and role: the whole ``names``, their ``words``, and its ``roles``."""
    out = {"names": set(), "words": set(), "roles": set()}
    for name, *values in ATTRIBUTE.findall(attributes):
        value = unescape("".join(values))
        if name.lower() == "role":
            out["roles"].update(value.lower().split())
        else:
            out["names"].update(value.lower().split())
            out["words"].update(w.lower() for w in WORD.findall(value))
    return out


def main_text(page: Page) -> tuple[list[tuple[int, str, list[int]]], list[int]]:
    """The pieces of text that rules keep, each with its block and the hashes of the elements above that can be template, and the
    hashes of all subtrees that can be."""
    n = len(page.tag)
    by_tag, by_name, in_article, holds = [False] * n, [False] * n, [False] * n, [False] * n
    for i in range(n):
        tag, own, up = page.tag[i], page.marks[i], page.parent[i]
        in_article[i] = up >= 0 and (in_article[up] or page.tag[up] == "article")
        by_tag[i] = tag in GONE_TAGS or (tag == "header" and not in_article[i]) or (up >= 0 and by_tag[up])
        words = own and tag not in ("html", "body") and (own["roles"] & GONE_ROLES or own["words"] & GONE_WORDS or (not in_article[i] and "header" in own["words"]))
        by_name[i] = bool(words)
    under = [0] * n  # how many elements that names take away it lies in
    for i in range(n):
        under[i] = by_name[i] + (under[page.parent[i]] if page.parent[i] >= 0 else 0)

    def outermost(test) -> list[int]:
        # One within an element that names take away counts if no other does: that element is the page's layout.
        fit = [i for i in range(n) if test(i) and not by_tag[i] and not by_name[i]]
        least = min((under[i] for i in fit), default=0)
        fit = [i for i in fit if under[i] == least]
        inside = [False] * n
        chosen = set(fit)
        for i in range(n):
            up = page.parent[i]
            inside[i] = up >= 0 and (inside[up] or up in chosen)
        return [i for i in fit if not inside[i]]

    main = (
        outermost(lambda i: page.tag[i] == "article")
        or outermost(lambda i: page.tag[i] == "main" or (page.marks[i] and "main" in page.marks[i]["roles"]))
        or outermost(lambda i: page.tag[i] in ("div", "section", "td") and page.marks[i] and page.marks[i]["names"] & MAIN_CLASSES)
    )
    for i in main:
        up = page.parent[i]
        while up >= 0 and not holds[up]:
            holds[up] = True
            up = page.parent[up]
    chosen, above, within, gone = set(main), [()] * n, [not main] * n, [False] * n
    able = []
    for i in range(n):
        up = page.parent[i]
        within[i] = within[i] or i in chosen or (up >= 0 and within[up])
        gone[i] = by_tag[i] or (by_name[i] and not holds[i]) or (up >= 0 and gone[up])
        can = page.has_text[i] and not holds[i] and i not in chosen and page.tag[i] not in ("html", "body", "head", "title", "script", "style") and (not main or not within[i] or page.tag[i] in BOXES)
        above[i] = (*above[up], page.hash[i]) if can and up >= 0 else (page.hash[i],) if can else above[up] if up >= 0 else ()
        if can:
            able.append(page.hash[i])
    pieces: list[tuple[int, str, list[int]]] = []
    for i, block, text in page.pieces:
        if not main if i < 0 else within[i] and not gone[i]:
            over = above[i] if i >= 0 else ()
            if pieces and pieces[-1][0] == block and pieces[-1][2] == over:
                pieces[-1] = (block, pieces[-1][1] + text, over)
            else:
                pieces.append((block, text, over))
    return pieces, able


def joined(blocks: list[int], texts: list[str]) -> str:
    """Pieces of one block make one text with single spaces; blocks are two line feeds apart."""
    out: list[list[str]] = []
    last = None
    for block, text in zip(blocks, texts):
        if block != last:
            out.append([])
            last = block
        out[-1].append(text)
    return "\n\n".join(t for t in (" ".join("".join(b).split()) for b in out) if t)


def host_of(url: str | Column) -> Column:
    found = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(F.coalesce(found, F.lit("")))


PARSED = "page_id long, url string, host string, content long, subtrees array<long>, blocks array<int>, texts array<string>, above array<array<long>>"


def parsed(pages: DataFrame) -> DataFrame:
    """The pieces of text of each page that rules keep, and what can be template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                content, subtrees, blocks, texts, above = [], [], [], [], []
                for html in part.column("html"):
                    pieces, able = main_text(Page(html.as_py()))
                    blocks.append([p[0] for p in pieces])
                    texts.append([p[1] for p in pieces])
                    above.append([list(p[2]) for p in pieces])
                    subtrees.append(list(dict.fromkeys(able)))
                    content.append(xxhash.xxh3_64_intdigest(joined(blocks[-1], texts[-1])) - (1 << 63))
                longs = pa.list_(pa.int64())
                columns = [pa.array(content, pa.int64()), pa.array(subtrees, longs), pa.array(blocks, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string())), pa.array(above, pa.list_(longs))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("page_id", "url", "host")), *columns], ["page_id", "url", "host", "content", "subtrees", "blocks", "texts", "above"])

    return pages.mapInArrow(run, PARSED)


def templates(pages: DataFrame, least: int, percent: int) -> DataFrame:
    """``host, template``: the subtrees that recur on many different pages of a host."""
    seen = pages.select("host", "content", F.explode("subtrees").alias("subtree")).distinct().groupBy("host", "subtree").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least)
    sizes = pages.select("host", "content").distinct().groupBy("host").agg(F.count("*").alias("all"))
    return seen.join(sizes, "host").filter(100 * F.col("pages") >= percent * F.col("all")).groupBy("host").agg(F.collect_list("subtree").alias("template"))


def extract(pages: DataFrame, *, least: int = 10, percent: int = 5, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_templates`` for each row of ``pages``; the last counts
    the page's different subtrees that are template of its host."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    read = written(parsed(rows), "parsed", "zstd")
    found = written(templates(read, least, percent), "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, known = [], []
            for blocks, texts, above, subtrees, template in zip(*(batch.column(c).to_pylist() for c in ("blocks", "texts", "above", "subtrees", "template"))):
                gone = set(template or ())
                kept = [k for k, over in enumerate(above) if gone.isdisjoint(over)] if gone else range(len(texts))
                out.append(joined([blocks[k] for k in kept], [texts[k] for k in kept]))
                known.append(len(gone.intersection(subtrees)))
            text = pa.array(out, pa.string())
            columns = [batch.column("page_id"), batch.column("url"), text, pa.array(map(len, out), pa.int64()), pa.array(known, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "n_templates"])

    whole = read.join(found, "host", "left").select("page_id", "url", "subtrees", "blocks", "texts", "above", "template")
    return whole.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_templates long")


def op12_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


#: The pages of the given tables mark their text as one ``article`` of headings and paragraphs, which SQL can cut out.
OP12_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS html FROM pages
), b AS (
  SELECT page_id, url, list_transform(string_split_regex(html, '</?(p|h[1-6])>'), lambda x: regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')) AS blocks FROM a
), c AS (
  SELECT page_id, url, list_transform(blocks, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM b
), d AS (
  SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) AS text FROM c
)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""
