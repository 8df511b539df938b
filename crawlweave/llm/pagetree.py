"""Page tree: turn HTML into blocks that know their place on the page.

A small forgiving tree builder (implied end tags, void elements, raw-text
elements, misnested closers) that keeps the source line of every piece of text.
`parse` builds the tree, `line_text` is the text of one source line, `render`
lays the visible text out (block spacing, list markers, aligned table cells).
Pure Python on strings: the Spark side calls it from Arrow batches.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

TAG = re.compile(r"(<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
STRIP = re.compile(r"<[^>]*>")
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAWTEXT = frozenset("script style textarea title template noembed noframes iframe svg".split())
UNSEEN = frozenset("head script style title template noembed noframes iframe svg".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article blockquote body center div main section td th form fieldset details figure aside footer header nav".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("body html noscript".split())
#: opening tag -> (open tags it ends, tags at which the search for them stops)
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu table td th div section article main center aside footer nav body".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "body"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "body"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table", "body"])),
    "td": (frozenset("td th".split()), frozenset("tr table body".split())),
    "th": (frozenset("td th".split()), frozenset("tr table body".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th".split()), frozenset(["table", "body"])),
    "option": (frozenset(["option"]), frozenset(["select", "body"])),
    "body": (frozenset(["head"]), frozenset()),
}
CLOSE_STOP = {t: frozenset(["table", "td", "th", "body"]) for t in ("p", "li", "div", "span", "a", "b", "i", "small")}
HIDE = re.compile(r"\shidden(\s|=|/|$)")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def line_text(line: str) -> str:
    """Text of one source line: tags off, entities decoded, white space collapsed and trimmed."""
    if "<" in line:
        line = STRIP.sub("", line)
    if "&" in line:
        line = html.unescape(line)
    return " ".join(line.split())


class Page:
    """Parallel lists of nodes and of text pieces. Node 0 is the root.

    A node comes before what it holds, and `end` is the last node inside it, so that containment is two comparisons.
    """

    __slots__ = ("lines", "tag", "parent", "attrs", "line", "hidden", "pieces", "end")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.tag, self.parent, self.attrs, self.line, self.hidden = ["#root"], [-1], [""], [0], [False]
        #: (node, line index, text, inside a link); the text of a line break element is "\n"
        self.pieces: list[tuple[int, int, str, bool]] = []
        self.end: list[int] = []

    def attr(self, node: int, name: str) -> str | None:
        if not self.attrs[node]:
            return None
        for m in ATTR.finditer(self.attrs[node]):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None

    def up(self, node: int):
        while node > 0:
            yield node
            node = self.parent[node]

    def inside(self, node: int, box: int) -> bool:
        return box <= node <= self.end[box]

    def nearest(self, tags: frozenset[str]) -> list[int]:
        """Per node the nearest node around it, or itself, with one of these tags; 0 without."""
        out = [0] * len(self.tag)
        if tags.isdisjoint(self.tag):
            return out
        tag, parent = self.tag, self.parent
        for n in range(1, len(out)):
            out[n] = n if tag[n] in tags else out[parent[n]]
        return out

    def running(self, values: list[int]) -> list[int]:
        """Running totals of a value per node: what a node holds is `total[end + 1] - total[node]`."""
        out = [0]
        for v in values:
            out.append(out[-1] + v)
        return out

    def signature(self, node: int) -> str:
        """Tag with its attributes as written: how a site's template names this block."""
        return " ".join([self.tag[node], *self.attrs[node].lower().split()])


def _out_of_sight(attrs: str) -> bool:
    low = attrs.lower()
    return "style" in low and HIDDEN.search(low) is not None or "hidden" in low and HIDE.search(low) is not None


class _Kinds(dict):
    """Tag name as written -> (name, block, closes p, heading, void, raw text, unseen, implied ends); refilled when it has grown."""

    def __missing__(self, written: str) -> tuple:
        if len(self) > 5_000:
            self.clear()
        t = written.lower()
        kind = self[written] = (t, t in BLOCK, t in CLOSES_P, t in HEADINGS, t in VOID, t in RAWTEXT, t in UNSEEN, IMPLIED.get(t))
        return kind


_kinds = _Kinds()


def parse(raw: str) -> Page:
    """Build the page tree, in time linear in the text. Any string gives a tree; nothing raises."""
    page = Page()
    page.lines = raw.split("\n")
    tags, parent, attrs, lines, hidden, pieces = page.tag, page.parent, page.attrs, page.line, page.hidden, page.pieces
    stack = [0]
    open_at: dict[str, list[int]] = {}  # tag -> places on the stack where it is open
    blocks: list[int] = []  # places of open block tags
    ended: set[int] = set()  # links ended by another link while tags inside them are still open
    links, skip, row = 0, None, 0
    unread: list[str] = []  # what stands inside a raw-text element

    def cut(k: int) -> None:
        """Close what is open from place k on."""
        nonlocal links
        while len(stack) > k or stack[-1] in ended:
            gone = stack.pop()
            if gone in ended:
                ended.discard(gone)
                continue
            t = tags[gone]
            open_at[t].pop()
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            links -= t == "a"

    def lowest(names, default: int = 0) -> int:
        """The place of the innermost open tag of these names."""
        best = default
        for t in names:
            p = open_at.get(t)
            if p and p[-1] > best:
                best = p[-1]
        return best

    def text(chunk: str) -> None:
        for k, part in enumerate(chunk.split("\n"), row):
            if part and not part.isspace():
                pieces.append((stack[-1], k, part, links > 0))

    # Texts and tags in turn: a text, then what TAG's groups hold.
    read = TAG.split(raw)
    rest = read.pop()
    read = iter(read)
    for chunk, other, closing, name, given in zip(read, read, read, read, read):
        if skip:
            if not (name and closing and name.lower() == skip):
                unread += (chunk, other or f"<{closing}{name}{given}>")
                continue
            if unread:
                chunk = "".join(unread) + chunk
                unread.clear()
            skip = None
        if chunk:
            if "\n" not in chunk:
                if not chunk.isspace():
                    pieces.append((stack[-1], row, chunk, links > 0))
            else:
                if not chunk.isspace():
                    text(chunk)
                row += chunk.count("\n")
        at_row = row
        if not name:
            row += other.count("\n")
            continue
        if "\n" in given:
            row += given.count("\n")
        name, block, closes, heading, void, raw_text, unseen, implied = _kinds[name]
        if closing:
            at = open_at.get(name)
            if not at:
                continue
            k = at[-1]
            if k == len(stack) - 1 and not ended:  # the usual case: the innermost tag
                stack.pop()
                at.pop()
                if block:
                    blocks.pop()
                elif name == "a":
                    links -= 1
            elif name not in CLOSE_STOP or lowest(CLOSE_STOP[name]) < k:
                cut(k)
            continue
        if closes and blocks:
            t = tags[stack[blocks[-1]]]
            if t == "p" or heading and t in HEADINGS:
                cut(blocks[-1])
        if implied:
            ends, stop = implied
            held = [p for t in ends if (p := open_at.get(t))]
            if held:
                floor = lowest(stop)
                at = min((p[k] for p in held if (k := bisect_right(p, floor)) < len(p)), default=0)
                if at:
                    cut(at)
        elif name == "a" and links:
            ended.add(stack[open_at["a"].pop()])
            links -= 1
            if stack[-1] in ended:
                cut(len(stack))
        top = stack[-1]
        if name == "br":
            pieces.append((top, at_row, "\n", False))
        tags.append(name)
        parent.append(top)
        attrs.append(given)
        lines.append(at_row)
        hidden.append(hidden[top] or unseen or bool(given) and _out_of_sight(given))
        if void or given.endswith("/") and name in ("svg", "iframe"):
            continue
        if name in open_at:
            open_at[name].append(len(stack))
        else:
            open_at[name] = [len(stack)]
        if block:
            blocks.append(len(stack))
        elif name == "a":
            links += 1
        stack.append(len(tags) - 1)
        if raw_text:
            skip = name
    text("".join(unread) + rest)
    page.end = end = list(range(len(tags)))
    for n in range(len(tags) - 1, 0, -1):
        k = parent[n]
        if end[n] > end[k]:
            end[k] = end[n]
    return page


class Block:
    """A block as a reader sees it: `node` of the tree, `kind` (its tag, `cell` in a data table), its text pieces in order."""

    __slots__ = ("node", "kind", "cell", "table", "pre", "parts", "rows", "nodes", "linked", "size")

    def __init__(self, node: int, kind: str, cell: int, table: int, pre: bool) -> None:
        self.node, self.kind, self.cell, self.table, self.pre = node, kind, cell, table, pre
        self.parts: list[str] = []
        self.rows: list[int] = []
        self.nodes: list[int] = []
        self.linked = self.size = 0

    @property
    def text(self) -> str:
        if not self.pre:
            return " ".join(self.parts)
        out = self.parts[0]
        for k in range(1, len(self.parts)):
            out += ("\n" if self.rows[k] != self.rows[k - 1] else " ") + self.parts[k]
        return out


CELLS, TABLES, PRE = frozenset(["td", "th"]), frozenset(["table"]), frozenset(["pre"])
HOLDS_BLOCKS = frozenset("div p h1 h2 h3 h4 li ul form section".split())
ROW = frozenset(["tr"])


def layout(page: Page, keep: set[int] | None = None) -> list[Block]:
    """The visible text (of the source lines in `keep`, when given) as blocks in reading order.

    A block ends where a block tag begins or ends and at line breaks; text that stands bare in a container is cut at
    source lines. Table cells whose table holds no blocks of its own are cells of a data table.
    """
    tags, hidden = page.tag, page.hidden
    around, cells, tables, pres = page.nearest(BLOCK), page.nearest(CELLS), page.nearest(TABLES), page.nearest(PRE)
    holds = page.running([t in HOLDS_BLOCKS for t in tags]) if any(tables) else [0]
    out: list[Block] = []
    prev, breaks = None, 0
    for node, row, chunk, link in page.pieces:
        if hidden[node] or keep is not None and row not in keep:
            continue
        if chunk == "\n":
            breaks += 1
            continue
        pre = pres[node] > 0
        if "&" in chunk:
            chunk = html.unescape(chunk)
        chunk = chunk.rstrip() if pre else " ".join(chunk.split())
        if not chunk:
            continue
        block, table = around[node], tables[node]
        cell = cells[node] if cells[node] > table else 0
        kind = tags[block] if block else "p"
        key = (block, cell, row if kind in CONTAINER and kind != "td" else -1, 0 if pre else breaks)
        if key != prev:
            data = cell and (not table or holds[page.end[table] + 1] == holds[table + 1])
            out.append(Block(block, "cell" if data else kind, cell, table, pre))
            prev = key
        b = out[-1]
        b.parts.append(chunk)
        b.rows.append(row)
        b.nodes.append(node)
        b.size += len(chunk)
        b.linked += len(chunk) * link
    return out


def render(page: Page, keep: set[int] | None = None) -> str:
    """All visible text (of the source lines in `keep`, when given) laid out as a reader sees it.

    A blank line parts paragraphs, headings and tables; list items start with "- "; cells of a table
    row stand in columns as wide as their widest cell; `pre` keeps its white space.
    """
    return render_blocks(page, layout(page, keep))


def render_blocks(page: Page, blocks: list[Block]) -> str:
    trs = page.nearest(ROW)
    rows: dict[int, list[tuple[int, str]]] = {}
    widths: dict[int, list[int]] = {}
    for b in blocks:
        if b.kind == "cell":
            row = rows.setdefault(trs[b.node], [])
            w = widths.setdefault(b.table, [])
            text = b.text
            w.extend([0] * (len(row) + 1 - len(w)))
            w[len(row)] = max(w[len(row)], len(text))
            row.append((b.table, text))
    out: list[str] = []
    done: set[int] = set()
    was = ""
    for b in blocks:
        kind = b.kind
        if kind == "cell":
            row = trs[b.node]
            if row in done:
                continue
            done.add(row)
            text = "  ".join(c.ljust(widths[t][k]) for k, (t, c) in enumerate(rows[row])).rstrip()
        else:
            text = f"- {b.text}" if kind == "li" else b.text
        if out and not (kind == was and kind in ("li", "cell")):
            out.append("")
        out.append(text)
        was = kind
    return "\n".join(out)
