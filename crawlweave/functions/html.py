"""Links of an HTML page: one pass over its tags, in document order, in Arrow batches."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa

TAG = re.compile(r"<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTR = re.compile(r"([a-zA-Z_:@][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SILENT = frozenset(["script", "style"])

LINK = "struct<pos:int,href:string,attrs:map<string,string>,inside_text:string>"


def anchors(page: str) -> list[tuple[int, str, list[tuple[str, str]], str]]:
    """(pos, href, other attributes, text) of every anchor with an href; the text ends with the alt of a first image child."""
    out: list[tuple[int, str, list[tuple[str, str]], str]] = []
    open_: tuple[str, list[tuple[str, str]]] | None = None
    text: list[str] = []
    alt, depth, last, skip = "", 0, 0, ""

    def close() -> None:
        nonlocal open_
        if open_ is not None:
            href, attrs = open_
            inside = " ".join(html.unescape("".join(text)).split())
            out.append((len(out), href, attrs, f"{inside} {alt}".strip()))
            open_ = None

    for m in TAG.finditer(page):
        if open_ is not None and not skip:
            text.append(page[last : m.start()])
        last = m.end()
        name = (m[2] or "").lower()
        if skip:
            if name == skip and m[1]:
                skip = ""
            continue
        if name in SILENT and not m[1]:
            skip = name
        elif name == "a":
            close()
            if not m[1]:
                found = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in reversed(list(ATTR.finditer(m[3])))}
                if "href" in found:
                    href = found.pop("href").strip()
                    open_, text, alt, depth = (href, list(reversed(found.items()))), [], "", 0
        elif open_ is not None:
            if name == "img":
                if depth == 0 and not alt:
                    alt = next((html.unescape(a[2] or a[3] or a[4] or "") for a in ATTR.finditer(m[3]) if a[1].lower() == "alt"), "").strip()
            elif name and name not in ("br", "input", "hr"):
                depth += -1 if m[1] else 1
    if open_ is not None and not skip:
        text.append(page[last:])
    close()
    return out


def anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow in: key columns and the page last; out: key columns and `links`."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("href", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("inside_text", pa.string())]))
    for batch in batches:
        pages = batch.column(batch.num_columns - 1).to_pylist()
        found = [[dict(pos=p, href=h, attrs=a, inside_text=t) for p, h, a, t in anchors(page)] if page else [] for page in pages]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=[*batch.schema.names[:-1], "links"])
