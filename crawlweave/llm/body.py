"""The page's own body: which lines of an HTML page are content (problem 5).

`split_page` builds the page tree (implied tags, visibility) and lays the visible text out in blocks; the block that
holds the page's own content is found in the tree, and the laid-out blocks inside it are kept or dropped by their
structure. Two things a page alone can't tell come from the other pages: where a site's template puts the body
(`site_blocks`, for pages without a main heading), and which closing lines are prompts that many pages repeat.
Work on a page is linear in its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from crawlweave.functions.common import salted_join, site_key, written
from crawlweave.llm import pagetree as P
from crawlweave.llm import prose

DATE = re.compile(r"\d{4}-\d\d?-\d\d?|\d\d?[./]\d\d?[./]\d{2,4}")
# Class names by which templates mark bylines, share links, pointers to other pages, notices and side boxes.
BY_CLASS = re.compile(r"\b(by|byline|author|dateline|posted|meta)\b", re.I)
SHARE_CLASS = re.compile(r"\b(share|sharing|social|soc)\b", re.I)
POINT_CLASS = re.compile(r"\b(rel|related|more|see-also|readmore|recommend\w*)\b", re.I)
NOTE_CLASS = re.compile(r"\b(cookie\w*|consent|note|notice|banner|news|newsletter|subscribe)\b", re.I)
SIDE_CLASS = re.compile(r"\b(box|side|sidebar|widget|note|news|foot|footer|menu|rel|share)\b", re.I)
SHARE_HREF = re.compile(r"[/.]share(r|\b)", re.I)
SENTENCE_END = re.compile(r"[.!?…»”\"][)\]]*$")
DIGITS = re.compile(r"\d+")
HEADING = re.compile(r"<h1\b", re.I)
LINES = "item_id long, site string, lines array<bigint>, closing array<bigint>, closing_text long, shared boolean"
BOXES = frozenset("article main section div td".split())
APART = frozenset("nav aside footer".split())
APART_HEADER = APART | {"header"}
ASIDE, SHARE, BY, OTHER, ITEM, FORM = 1, 2, 4, 8, 16, 32
TAG_FLAGS = {"aside": ASIDE, "footer": ASIDE, "nav": ASIDE, "noscript": ASIDE, "li": ITEM, "form": FORM}


def host(url: str | None) -> str:
    m = re.match(r"\s*[a-zA-Z][\w+.-]*://([^/?#]*)", url or "")
    return m[1].lower() if m else ""


class Split:
    """Lines of a page. body: 1-based numbers of body lines; closing: those of a closing line that is a prompt if many pages
    end so, with the hash of its text and whether share links follow; block: signature of the body's block;
    how: `heading`, `site`, `alone` or ``; blocks: the page's layout."""

    __slots__ = ("page", "blocks", "body", "closing", "closing_text", "shared", "block", "how", "_texts", "_parts")

    def __init__(self, page: P.Page) -> None:
        self.page, self.blocks = page, P.layout(page)
        self.body: list[int] = []
        self.closing: list[int] = []
        self.closing_text: int | None = None
        self.shared = False
        self.block = self.how = ""
        self._texts: dict[int, str] = {}
        self._parts: dict[int, list[tuple[str, list[str]]]] = {}

    def text(self, row: int) -> str:
        """The text of a source line, counted from 0."""
        got = self._texts.get(row)
        if got is None:
            got = self._texts[row] = P.line_text(self.page.lines[row])
        return got

    def parts(self, row: int) -> list[tuple[str, list[str]]]:
        """A source line cut at closing marks (`prose.parts`)."""
        got = self._parts.get(row)
        if got is None:
            got = self._parts[row] = prose.parts(self.text(row).lower())
        return got

    def words(self, row: int) -> list[str]:
        """The words of a source line."""
        return [w for _, ws in self.parts(row) for w in ws]

    @property
    def lines(self) -> list[str]:
        """The texts of the body lines."""
        return [self.text(n - 1) for n in self.body]


def _text_sizes(page: P.Page, weight: int) -> list[int]:
    """Running text lengths by node; text in links counts `weight` times."""
    own = [0] * len(page.tag)
    for node, _, t, link in page.pieces:
        if t != "\n" and not page.hidden[node]:
            own[node] += len(t) * (weight if link else 1)
    return page.running(own)


def _heading_box(page: P.Page) -> tuple[int, int]:
    """The block that holds the main heading, and the heading; (0, 0) without one."""
    n = next((k for k, t in enumerate(page.tag) if t == "h1" and not page.hidden[k]), 0)
    if not n:
        return 0, 0
    box = next((a for a in page.up(page.parent[n]) if page.tag[a] in P.CONTAINER), 0)
    total: list[int] = []

    def held(k: int) -> int:
        total.extend(() if total else _text_sizes(page, 1))
        return total[page.end[k] + 1] - total[k]

    while box and page.tag[box] in ("header", "div") and page.tag[page.parent[box]] in BOXES and held(box) - held(n) < 40:
        box = page.parent[box]
    return box, n


def _after_header(page: P.Page, header: int) -> int:
    """The heading stands in a page header: the block after it with the most text outside links is the body."""
    best, most = 0, 0
    total, apart = _text_sizes(page, -1), page.nearest(APART)
    for n in range(page.end[header] + 1, len(page.tag)):
        if page.tag[n] not in ("div", "section", "article", "main", "center", "td") or page.hidden[n] or apart[n]:
            continue
        if best and page.inside(n, best) or SIDE_CLASS.search(page.attr(n, "class") or ""):
            continue
        size = total[page.end[n] + 1] - total[n]
        if size > most:
            best, most = n, size
    return best


def _alone(page: P.Page) -> int:
    """Without heading or site: the one block left when menus, side boxes, notices and footers are put aside."""
    found = 0
    apart = page.nearest(APART_HEADER)
    outer = page.running([t in ("h3", "table", "td", "section", "main", "article", "center") for t in page.tag])
    blocks = page.running([t in ("p", "div", "li", "pre", "br", "form") for t in page.tag])
    own, marks = [0] * len(page.tag), [0] * len(page.tag)
    for node, _, t, _ in page.pieces:
        own[node] += t != "\n"
        marks[node] += "©" in t or "&copy;" in t
    texts, marks = page.running(own), page.running(marks)
    for n in range(1, len(page.tag)):
        t = page.tag[n]
        if t in ("article", "main"):
            return n
        if t == "h4":
            found = found or -1
        if found or t not in ("div", "section", "center", "td") or page.hidden[n] or apart[n] or t == "div" and SIDE_CLASS.search(page.attr(n, "class") or ""):
            continue
        last = page.end[n] + 1
        if outer[last] == outer[n + 1] and blocks[last] > blocks[n + 1] and texts[last] > texts[n] and marks[last] == marks[n]:
            found = n
    return max(0, found)


def split_page(raw: str, url: str | None = None, site_block: str | None = None) -> Split:
    """Label the lines of a page. `site_block`: signature of the block in which the site's pages hold their body."""
    page = P.parse(raw)
    out = Split(page)
    box, head = _heading_box(page)
    if box and page.tag[box] == "header":
        box = _after_header(page, box) or box
    out.how = "heading" if box else ""
    if not box and site_block:
        tag = site_block.split(" ", 1)[0]
        box = next((n for n in range(1, len(page.tag)) if page.tag[n] == tag and not page.hidden[n] and page.signature(n) == site_block), 0)
        out.how = "site" if box else ""
    if not box:
        box = _alone(page)
        out.how = "alone" if box else ""
    if box:
        out.block = page.signature(box)
        _label(out, box, head)
    return out


@lru_cache(4096)
def _class_flags(classes: str) -> int:
    return SHARE * bool(SHARE_CLASS.search(classes)) | BY * bool(BY_CLASS.search(classes)) | OTHER * bool(NOTE_CLASS.search(classes) or POINT_CLASS.search(classes))


def _flags(page: P.Page, box: int) -> list[int]:
    """What surrounds each node inside the box, the box itself left out."""
    out = [0] * (page.end[box] + 1 - box)
    for n in range(box + 1, page.end[box] + 1):
        f = out[page.parent[n] - box] | TAG_FLAGS.get(page.tag[n], 0)
        if page.attrs[n] and (names := page.attr(n, "class")):
            f |= _class_flags(names)
        out[n - box] = f
    return out


def _label(out: Split, box: int, head: int) -> None:
    page = out.page
    stop = page.end[box]
    own = [b for b in out.blocks if box <= b.nodes[0] <= stop]
    anchors: dict[int, list[int]] = {}
    for n in range(box + 1, page.end[box] + 1):
        if page.tag[n] == "a":
            anchors.setdefault(page.line[n], []).append(n)
    flags = _flags(page, box)
    at = [b.nodes[0] if len(b.nodes) == 1 else b.nodes[(sizes := [len(p) for p in b.parts]).index(max(sizes))] for b in own]  # the node of a block's longest piece
    around = [flags[n - box] if n >= box else 0 for n in at]
    share = [bool(b.linked and f & ITEM and b.linked == b.size and (f & SHARE or _share_link(page, anchors.get(b.rows[0], ())))) for b, f in zip(own, around)]
    verdicts: list[bool] = []
    last = -1  # the last block that is kept
    for k, (b, f) in enumerate(zip(own, around)):
        plain = not b.linked and not f & ITEM
        keep = not (f & (ASIDE | OTHER) or share[k] or not b.linked and f & SHARE)
        if keep and f & BY:
            keep = bool(SENTENCE_END.search(b.text))
        if keep and plain and k and head and page.inside(at[k - 1], head):
            keep = not _byline(b.text)
        if keep and b.linked and not f & ITEM and len(anchors.get(b.rows[0], ())) == 1:
            keep = not _pointer(page, b, anchors[b.rows[0]][0])
        verdicts.append(keep)
        last = k if keep else last
    rows: dict[int, tuple[int, int]] = {}  # line -> (its longest part, that part's block)
    for k, b in enumerate(own):
        for part, row in zip(b.parts, b.rows):
            if len(part) > rows.get(row, (0, 0))[0]:
                rows[row] = (len(part), k)
    lines = {row for row, (_, k) in rows.items() if verdicts[k] and out.text(row)}
    if head and not page.inside(head, box) and not page.hidden[head] and out.text(page.line[head]):
        lines.add(page.line[head])
    if last > 0 and not own[last].linked and not around[last] & (ITEM | FORM) and not own[last].pre and not (head and page.inside(at[last], head)):
        text = own[last].text
        closing = {row for row, (_, k) in rows.items() if k == last and row in lines}
        if closing and not re.search(r"[.…]$", text):
            # A closing line without a full stop: a prompt if many pages end so.
            out.closing = [row + 1 for row in sorted(closing)]
            out.closing_text = xxhash.xxh3_64_intdigest(DIGITS.sub("0", text.lower()).encode("utf-8", "surrogatepass")) - (1 << 63)
            out.shared = share[last + 1 : last + 2] == [True]
            lines -= closing
    out.body = [row + 1 for row in sorted(lines)]


def _share_link(page: P.Page, links: list[int]) -> bool:
    return any(SHARE_HREF.search(page.attr(a, "href") or "") for a in links)


def _byline(text: str) -> bool:
    """A date, or one comma and a count of something after it; no sentence, and no value after its label."""
    if SENTENCE_END.search(text) or re.search(r":\s*\d[\d.,]*\b", text):
        return False
    return bool(DATE.search(text) or re.match(r"[^,]*,\s*(\d+\s+\S+|\S+\s+\d+)$", text))


def _pointer(page: P.Page, b: P.Block, link: int) -> bool:
    """A lead and one longer link to another article, alone in a block."""
    if not b.node or page.line[b.node] != b.rows[0]:
        return False
    label = " ".join(part for part, node in zip(b.parts, b.nodes) if page.inside(node, link))
    lead = b.text.removesuffix(label).strip()
    return b.text.endswith(label) and 0 < len(lead) < len(label) and not re.search(r"[.!?…]$", lead)


SITE = r"^\s*[a-z][a-z0-9+.-]*://(?:www\.)?([^/?#:]*)"


def _source(items: DataFrame, id_col: str, url_col: str, domain_col: str, text_col: str) -> DataFrame:
    """(item_id, url, site, raw); the site is the address's host, else the domain."""
    site = F.regexp_extract(F.lower(F.col(url_col)), SITE, 1)
    site = F.when(site != "", site).otherwise(site_key(F.col(domain_col)))
    return items.select(F.col(id_col).cast("long").alias("item_id"), F.col(url_col).alias("url"), site.alias("site"), F.col(text_col).alias("raw")).where("item_id is not null and raw is not null and raw <> ''")


def site_blocks(pages: DataFrame) -> DataFrame:
    """(site, block): per site the block that most of its pages hold the main heading in; one row a site."""
    seen = pages.where("_site is not null and _block <> ''").groupBy(F.col("_site").alias("site"), F.col("_block").alias("block")).count()
    return seen.groupBy("site").agg(F.max_by("block", F.struct("count", "block")).alias("block"))


def map_pages(items: DataFrame, fn, schema: str, id_col: str = "item_id", url_col: str = "url", domain_col: str = "domain", text_col: str = "raw_content") -> DataFrame:
    """Rows that `fn(item_id, site, url, Split)` yields for every page with text.

    The pages are read and parsed once: a page with a main heading gives its rows and the block that it found. Only pages
    without one (error pages and the like) are kept in the written table and parsed again, with their site's block.
    """
    src = _source(items, id_col, url_col, domain_col, text_col)
    full = "_site string, _block string, _item long, _url string, _raw string, _own boolean, " + schema
    fields = [f.name for f in T._parse_datatype_string(schema).fields]
    arrow = to_arrow_schema(T._parse_datatype_string(full))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], names=arrow.names)

    none = (None,) * len(fields)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item, url, site, raw in zip(*(c.to_pylist() for c in batch.columns)):
                s = split_page(raw, url) if HEADING.search(raw) else None
                if s is None or s.how != "heading":
                    rows.append((site, None, item, url, raw, False, *none))
                    continue
                got = list(fn(item, site, url, s))
                rows.append((site, s.block, None, None, None, bool(got), *(got[0] if got else none)))
                rows.extend((None, None, None, None, None, True, *r) for r in got[1:])
            yield batch_of(rows)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, url, site, raw, block in zip(*(c.to_pylist() for c in batch.columns)):
                rows.extend((None, None, None, None, None, True, *r) for r in fn(item, site, url, split_page(raw, url, block)))
            yield batch_of(rows)

    pages = written(src.mapInArrow(first, full), "pages")
    bare = pages.where("_raw is not null").select(F.col("_item").alias("item_id"), F.col("_url").alias("url"), F.col("_site").alias("site"), F.col("_raw").alias("raw"))
    bare = salted_join(bare, site_blocks(pages), ["site"], F.xxhash64("item_id")).select("item_id", "url", "site", "raw", "block")
    rest = written(bare.mapInArrow(again, full), "bare-pages")
    return pages.where("_own").select(*fields).unionByName(rest.select(*fields))


def _line_rows(item, site, url, page):
    return [(item, site, page.body, page.closing, page.closing_text, page.shared)] if page.body or page.closing else ()


def _prompts(pages: DataFrame, min_sites: int) -> DataFrame:
    """(closing_text, prompt): closing lines that pages of `min_sites` sites end with, before share links more often than not.

    Hot lines merge map-side, one row a line and site.
    """
    seen = pages.where("closing_text is not null").groupBy("closing_text", "site").agg(F.count("*").alias("n"), F.sum(F.col("shared").cast("long")).alias("shared"))
    seen = seen.groupBy("closing_text").agg(F.count("site").alias("sites"), F.sum("n").alias("n"), F.sum("shared").alias("shared"))
    return seen.where((F.col("sites") >= min_sites) & (2 * F.col("shared") > F.col("n"))).select("closing_text", F.lit(True).alias("prompt"))


def body_lines(items: DataFrame, id_col: str = "item_id", url_col: str = "url", domain_col: str = "domain", text_col: str = "raw_content", min_sites: int = 3) -> DataFrame:
    """(item_id, line_no): the source lines, counted from 1, that belong to the page's own body.

    A closing line of the body without a full stop is a prompt to share, and no body, where pages of `min_sites` sites
    end with it (numbers aside), mostly before share links, and the page has other body lines.
    Null and empty pages give no rows; so does a page in which no block can be told to be the body.
    Rows that come twice come out twice. Any text is accepted: broken or missing tags never raise.
    """
    per = map_pages(items, _line_rows, LINES, id_col, url_col, domain_col, text_col)
    sure = per.select("item_id", F.explode("lines").alias("line_no"))
    doubt = per.where("closing_text is not null").select("item_id", "closing_text", F.size("lines").alias("others"), "closing")
    told = salted_join(doubt, _prompts(per, min_sites), ["closing_text"], F.xxhash64("item_id"))
    return sure.unionByName(told.where("prompt is null or others = 0").select("item_id", F.explode("closing").alias("line_no")))


def _text_rows(item, site, url, page):
    rest = P.render(page.page, {n - 1 for n in page.closing}) if page.closing else ""
    return [(item, site, page.how, page.block, P.render(page.page, {n - 1 for n in page.body}), rest, page.closing_text, page.shared)]


def body_text(items: DataFrame, id_col: str = "item_id", url_col: str = "url", domain_col: str = "domain", text_col: str = "raw_content", min_sites: int = 3) -> DataFrame:
    """(item_id, how, block, body): the body of every page with text, laid out as a reader sees it; lines as in `body_lines`.

    how: `heading`, `site` or `alone` (the way the block was found), `` where none was found and body is empty.
    """
    per = map_pages(items, _text_rows, "item_id long, site string, how string, block string, body string, rest string, closing_text long, shared boolean", id_col, url_col, domain_col, text_col)
    out = salted_join(per.drop("site", "shared"), _prompts(per, min_sites), ["closing_text"], F.xxhash64("item_id"))
    rest = F.when(F.col("prompt").isNull() | (F.col("body") == ""), F.col("rest")).otherwise("")
    gap = F.when((F.col("body") != "") & (rest != ""), "\n\n").otherwise("")
    return out.select("item_id", "how", "block", F.concat("body", gap, rest).alias("body"))


def _visible_rows(item, site, url, page):
    return [(item, P.render_blocks(page.page, page.blocks))]


def visible_text(items: DataFrame, id_col: str = "item_id", url_col: str = "url", domain_col: str = "domain", text_col: str = "raw_content") -> DataFrame:
    """(item_id, text): all visible text of every page, boilerplate included, with its layout."""
    return map_pages(items, _visible_rows, "item_id long, text string", id_col, url_col, domain_col, text_col)
