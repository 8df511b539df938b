"""Template residue and error-page text (problem 6).

Slots: body lines outside code that stand in the same place of a site's pages are aligned by their tokens. Tokens that nearly
all of them hold are the template, what stands between two such tokens is a slot. A slot that keeps a variable's name, a
default or nothing where other records hold a value is residue. A name in the marks of a template language is residue
wherever it stands, also where every record shows it, unless the text names it as an example ("write {{ name }} here").

Whole pages: sentences with their slots (numbers, addresses, ids) left out are counted over sites. A page of nothing but
sentences that several sites show, or of standard messages of servers and interpreters, is an error page, notice or default page.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.functions.common import salted_join, small, written
from crawlweave.llm import pagetree as P
from crawlweave.llm.body import map_pages
from crawlweave.llm.prose import STOP, WORD, full, parts

# Ways in which template languages write a place to be filled.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]+\}\}|\{%[^%\n]+%\}|<%[^%\n]+%>|\$\{[^{}\n]+\}|#\{[^{}\n]+\}|\[\[[\w .:-]+\]\]|\[%[^%\n]+%\]"
    r"|%%[\w .-]+%%|@@[\w .-]+@@|(?<![\w%])%[A-Za-z_][\w.]+%(?![\w%])|__[A-Z][A-Z_]{2,}__|[{\[][a-z]+(?:[_.][a-z]+)+[}\]]|[{\[][A-Z][A-Z_]{3,}[}\]]"
    r"|[{\[](?:insert|enter|your|add|put)\b[^}\]\n]+[}\]]|<(?:insert|enter|your)\b[^>\n]+>",
)
SIGN = re.compile(r"[{\[<%@_$]")
# Words right before a placeholder that is written about, not left unfilled.
NAMED = re.compile(
    r"\b(writes?|puts?|uses?|using|inserts?|replaces?|placeholder|variable|syntax|schreib\w*|verwende\w*|ersetz\w*|platzhalter|écrivez|écrire|utilis\w+|remplac\w+"
    r"|escrib\w+|escrev\w+|utiliz\w+|reemplaz\w+|substitu\w+|variável|marcador|напишите|пишите|введите|используйте|замените|переменн\w+)[\s«„“\"'‘`(]*$",
    re.I,
)
#: Bracketed names that are variables only where other records hold a value in their place.
DOUBTFUL = re.compile(r"[{\[<]\s*[A-Za-z][\w. -]*[}\]>]|\$[A-Za-z_]\w*")
# What unset variables print as.
UNSET = frozenset(["undefined", "null", "nan", "[object object]", "#ref!", "#n/a", "(null)"])
UNSET_SIGNS = ("undefined", "null", "nan", "object]", "#ref!", "n/a")
EMPTY_SIGNS = (" ,", " .", " )", "()", "( )", '""', '" "')
UNSET_SPAN = re.compile(r"[\[(#]?\w[\w/ ]*?[\])!]|[\w/]+")
EMPTY = re.compile(r"(?<=\S)\s+(?=[,.)])|\(\s*\)|\"\s*\"|:\s*$")
# Standard wordings of servers, browsers and interpreters: status codes and reasons, script notices, traces.
STANDARD = re.compile(
    r"\b(error|fehler|erreur|erro|http)\s*[45]\d\d\b|ошибка\s*[45]\d\d|^\W*[45]\d\d\b\W*(-|–|:|not|page|gone|forbidden|$|\w+ \w+$)|\bnot found\b|nicht gefunden|introuvable|no se encontr|no encontrad|не найден|não encontrad"
    r"|access denied|permission denied|forbidden|zugriff verweigert|accès refusé|acceso denegado|доступ запрещ|acesso negado"
    r"|bad gateway|gateway time-?out|service (is )?unavailable|internal (server )?error|error interno|erreur interne|interner fehler|внутренняя ошибка|erro interno"
    r"|(enable|activate|turn on|without|requires?) (java)?scripts?\b|javascript"
    r"|^traceback\b|^fatal error|^warning: |\bsql error\b|stack trace|^\W*#\d+ \S+\(|unhandled exception",
    re.I,
)
# Every STANDARD wording holds one of these, or begins with a number, so that running text is passed over quickly.
STANDARD_SIGNS = "not found,gefunden,introuvable,encontr,найден,denied,forbidden,verweigert,refusé,denegado,запрещ,negado,gateway,unavailable,intern,внутренняя,script,traceback,fatal,warning,sql,stack,unhandled,erro,fehler,erreur,http,шибка".split(",")
NUMBER_SIGN = re.compile(r"\W*(?:[45]\d\d|#\d)")
# The words of the usual filler text.
FILLER = frozenset("lorem ipsum dolor amet consectetur adipiscing elit".split())
CUT = re.compile(r"(?<=[.!?…])\s+")
VARYING = re.compile(r"\d|[/()\"_.:#].*\w")
CODE = frozenset(["pre", "code"])
TOKEN = re.compile(r"\w+|[^\w\s]")
#: Full sentences from which a body that stands at one address a site is taken for an article that sites copy.
ARTICLE = 2
EMPHASIS = frozenset("b i em strong dd h1 h2".split())
VALUE, BLANK = 1, 2

SCHEMA = (
    "item_id long, site string, path long, words int, filler int, article boolean, open boolean, whole long, units array<struct<line:long,words:int,known:boolean>>,"
    " recs array<struct<place:long,form:long,text:string,cands:array<struct<lo:int,hi:int,kind:int>>>>, held array<struct<place:long,gap:boolean>>"
)


def _h(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def standard_sign(low: str, signs: list[str] = STANDARD_SIGNS) -> bool:
    return NUMBER_SIGN.match(low) is not None or any(w in low for w in signs)


def _code(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) - (1 << 31)


class _Kinds(dict):
    """token -> 1: a word, 0: none, -1: left out; refilled when it has grown."""

    def __missing__(self, token: str) -> int:
        if len(self) > 200_000:
            self.clear()
        kind = self[token] = -1 if VARYING.search(token) else int(WORD.search(token) is not None)
        return kind


_kinds = _Kinds()


def masked(text: str) -> tuple[str, int]:
    """A sentence without what differs between two uses of one message (numbers, addresses, ids), and its number of words."""
    toks = text.lower().split()
    kinds = list(map(_kinds.__getitem__, toks))
    if -1 in kinds:
        toks = [t for t, kind in zip(toks, kinds) if kind >= 0]
    return " ".join(toks), kinds.count(1)


def unfilled(text: str) -> bool:
    """Whether a line holds a placeholder that the text doesn't name as an example."""
    return any(not NAMED.search(text[: m.start()]) for m in PLACEHOLDER.finditer(text))


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Parts of a line that may be open slots, as token positions (the tokens lo + 1 to hi): names, defaults, nothing."""
    found = []
    if SIGN.search(text):
        found += [(m.start(), m.end(), VALUE) for r in (PLACEHOLDER, DOUBTFUL) for m in r.finditer(text)]
    low = text.lower()
    if any(w in low for w in UNSET_SIGNS):
        found += [(m.start(), m.end(), VALUE) for m in UNSET_SPAN.finditer(text) if m[0].lower() in UNSET]
    if text[-1] == ":" or any(w in text for w in EMPTY_SIGNS):
        for m in EMPTY.finditer(text):
            at = m.start() + (m[0][0] in '(":')
            found.append((at, at, BLANK))
    if not found:
        return []
    spans = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    begins, ends = [a for a, _ in spans], [b for _, b in spans]
    out = []
    for a, b, kind in found:
        lo = bisect_right(ends, a)
        out.append((lo, lo if kind == BLANK else max(lo, bisect_left(begins, b)), kind))
    return out


def page_row(item, site, url, split):
    page = split.page
    body = {n - 1 for n in split.body} | {n - 1 for n in split.closing}
    code: dict[int, list[str]] = {}
    lines: dict[int, list[str]] = {}
    where: dict[int, int] = {}
    pre = page.nearest(CODE)
    for b in split.blocks:
        for node, row, piece in zip(b.nodes, b.rows, b.parts):
            if row in body:
                if row not in where:
                    where[row] = node  # the first piece's place stands for the line
                side = code if pre[node] else lines
                if row in side:
                    side[row].append(piece)
                else:
                    side[row] = [piece]
    paths: dict[int, str] = {}
    spots: dict[str, int] = {}

    def place(node: int) -> str:
        """Tags from the root; shared prefixes are built once."""
        chain = []
        while node > 0 and node not in paths:
            chain.append(node)
            node = page.parent[node]
        got = paths.get(node, "")
        for n in reversed(chain):
            # Deep nesting is folded into a hash, so that the path's length stays bounded.
            got = paths[n] = f"{got if len(got) < 256 else _h(got)}/{page.tag[n]}"
        return got

    texts = {row: (" ".join(" ".join(pieces).split()) if row in code else split.text(row)) for row, pieces in lines.items()}
    texts = {row: texts[row] for row in sorted(texts) if texts[row]}
    pieces_of = [parts(text.lower()) if row in code else split.parts(row) for row, text in texts.items()]
    words = sum(len(ws) for got in pieces_of for _, ws in got)
    together = "\n".join(texts.values())
    low = together.lower()
    # What no line of the page holds isn't looked for line by line.
    signs = [w for w in STANDARD_SIGNS if w in low]
    marked, doubt = SIGN.search(together) is not None, any(w in low for w in UNSET_SIGNS) or any(w in together for w in EMPTY_SIGNS)
    units, whole = [], []
    for text in texts.values():
        for part in CUT.split(text):
            bare, size = masked(part)
            whole.append(bare)
            told = standard_sign(part.lower(), signs) if signs else NUMBER_SIGN.match(part) is not None
            units.append((_h(bare), size, not bare or told and STANDARD.search(part) is not None))
    cut = [[w for _, ws in got for w in ws] for got in pieces_of] if any(w in low for w in FILLER) else []
    known = {w for ws in cut if not FILLER.isdisjoint(ws) for w in ws}
    filler = sum(len(ws) for ws in cut if ws and sum(w in known for w in ws) >= 0.4 * len(ws) and sum(w in STOP for w in ws) <= 0.1 * len(ws)) if known else 0
    opened, recs = False, []
    for row, text in texts.items():
        sign = marked and SIGN.search(text) is not None
        if sign and not opened and PLACEHOLDER.search(text) and unfilled(text):
            opened = True
        spot = f"{site}|{place(where[row])}"
        if spot not in spots:
            spots[spot] = _h(spot)
        recs.append((spots[spot], _h(f"{spot}|{TOKEN.search(text)[0]}"), text, candidates(text) if sign or doubt or text[-1] == ":" else []))
    held = []
    if body:
        filled = sorted({node for node, _, piece, _ in page.pieces if piece != "\n"})
        for n, t in enumerate(page.tag):
            if t in EMPHASIS and page.line[n] in body and not page.hidden[n]:
                k = bisect_left(filled, n)
                gap = k == len(filled) or filled[k] > page.end[n]
                if not gap or page.end[n] == n:
                    held.append((_h(f"{site}|blank|{place(n)}"), gap))
    seen = 0
    for got in pieces_of:
        seen += full(got)
        if seen >= ARTICLE:
            break
    article = seen >= ARTICLE and not any(known and size for _, size, known in units)
    return [(item, site, _h((url or "").split("#")[0].split("?")[0]), words, filler, article, opened, _h("\n".join(whole)), units, recs, held)]


def _token_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toks = [[_code(t) for t in TOKEN.findall(x)] for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("g"), batch.column("cands"), pa.array(toks, pa.list_(pa.int32()))], ["row", "g", "cands", "toks"])


def open_slots(pages: DataFrame, blank_share: float, min_uses: int, constant: float = 0.9, only: DataFrame | None = None) -> DataFrame:
    """(row) of the records that leave a slot open which other records of their place fill.

    Only places with a candidate take part. Lines of a place, and those of them that begin alike, are aligned: tokens that the
    share `constant` of at least 3 lines hold are the template. Counts merge map-side, so a hot site is no hot group.
    """
    recs = pages.select("row", F.explode("recs").alias("r")).select("row", "r.*")
    asked = recs.where("size(cands) > 0")
    if only is not None:
        asked = asked.join(only, "row", "left_semi")
    marked = asked.select(F.explode(F.array("place", "form")).alias("g")).distinct()
    marked = written(marked, "marked-places")
    lines = recs.select("row", "text", F.to_json("cands").alias("cands"), F.explode(F.array("place", "form")).alias("g"))
    lines = salted_join(lines, marked, ["g"], F.xxhash64("row"), how="inner")
    lines = lines.select("row", "g", "cands", "text").mapInArrow(_token_codes, "row long, g long, cands string, toks array<int>")
    lines = written(lines.withColumn("cands", F.from_json("cands", "array<struct<lo:int,hi:int,kind:int>>")), "aligned")
    uses = lines.groupBy("g").agg(F.count("*").alias("uses")).where("uses >= 3")
    held = lines.select("g", F.explode(F.array_distinct("toks")).alias("t")).groupBy("g", "t").agg(F.count("*").alias("n"))
    fixed = held.join(small(uses), "g").where(F.col("n") >= constant * F.col("uses")).groupBy("g").agg(F.collect_set("t").alias("fixed"))  # no more than a line has tokens, / 0.9
    groups = uses.join(fixed, "g", "left").select("g", "uses", F.coalesce("fixed", F.array().cast("array<int>")).alias("fixed"))
    cut = salted_join(lines, groups, ["g"], F.xxhash64("row"), how="inner")
    # Positions of template tokens, with the line's edges; the slots lie between neighbours.
    cut = cut.withColumn("at", F.expr("concat(array(0), filter(transform(toks, (t, i) -> if(array_contains(fixed, t), i + 1, -1)), p -> p > 0), array(size(toks) + 1))"))
    slots = cut.select(
        "row", "g", "uses", "cands",
        F.explode(F.expr("transform(sequence(1, size(at) - 1), k -> struct(at[k - 1] as a, at[k] as b, if(at[k - 1] = 0, 0L, xxhash64(toks[at[k - 1] - 1])) as l, if(at[k] > size(toks), 0L, xxhash64(toks[at[k] - 1])) as r, xxhash64(slice(toks, at[k - 1] + 1, at[k] - at[k - 1] - 1)) as v))")).alias("s"),
    ).select("row", "g", "uses", "cands", "s.*")
    slots = written(slots, "slots")
    stats = slots.groupBy("g", "l", "r").agg(F.sum(F.expr("if(b > a + 1, 1L, 0L)")).alias("filled"), F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    mine = slots.where("size(cands) > 0").select("row", "g", "l", "r", "a", "b", F.explode("cands").alias("c")).where("c.lo = a and c.hi = b - 1")
    told = mine.join(stats, ["g", "l", "r"])
    value = F.expr(f"c.kind = {VALUE} and least <> most")
    blank = F.expr(f"c.kind = {BLANK} and n >= {int(min_uses)} and filled >= {float(blank_share)} * n")
    return told.where(value | blank).select("row").distinct()


def page_rows(items: DataFrame, id_col: str = "item_id", url_col: str = "url", domain_col: str = "domain", text_col: str = "raw_content") -> DataFrame:
    """What `residue_of` needs of every page with text; a row a page."""
    return map_pages(items, page_row, SCHEMA, id_col, url_col, domain_col, text_col)


def residue(items: DataFrame, min_sites: int = 3, blank_share: float = 0.95, rest_words: int = 3, min_paths: int = 5, min_uses: int = 20, id_col: str = "item_id", url_col: str = "url", domain_col: str = "domain", text_col: str = "raw_content") -> DataFrame:
    """(item_id, reason) of pages to exclude; reason: `slot`, `filler` or `message`.

    slot: a placeholder stands unfilled, in whatever place; a default (`null`), a bracketed word, or a placeholder that the
    text names as an example, counts only as the whole value of a slot that other records of the site fill otherwise; nothing
    counts in a slot, or an emphasised place, that holds text in `blank_share` of at least `min_uses` uses.
    filler: half of the body is filler. message: all but `rest_words` words of the body (numbers, addresses and ids aside)
    stand in sentences that pages of `min_sites` sites show, or in standard messages; or the whole body stands at `min_paths`
    addresses of one site. A body of 2 full sentences without a standard message that only ever comes whole, at one address a
    site, is an article that sites copy and no message. Sentences and bodies count at any length. Addresses count without query and fragment.
    Code is never looked at. Null and empty pages, and pages without body, give no rows. Rows that come twice give one.
    """
    pages = written(page_rows(items, id_col, url_col, domain_col, text_col).withColumn("row", F.monotonically_increasing_id()), "residue")
    return residue_of(pages, min_sites, blank_share, rest_words, min_paths, min_uses)


def residue_of(pages: DataFrame, min_sites: int = 3, blank_share: float = 0.95, rest_words: int = 3, min_paths: int = 5, min_uses: int = 20, only: DataFrame | None = None) -> DataFrame:
    """`residue` of written page rows with a unique `row`. `only`: the rows (a column `row`) that need an answer; all are compared with."""
    mine = pages.join(only, "row", "left_semi") if only is not None else pages
    why = lambda df, reason: df.select("item_id", F.lit(reason).alias("reason"))
    sure = why(mine.where("open"), "slot")
    ids = mine.select("row", "item_id")
    slot = why(ids.join(small(open_slots(pages, blank_share, min_uses, only=only)), "row"), "slot")
    held = pages.where("size(held) > 0").select("item_id", F.explode("held").alias("h")).select("item_id", "h.*")
    gaps = held.groupBy("place").agg(F.count("*").alias("n"), F.sum(F.col("gap").cast("long")).alias("gaps")).where(f"gaps > 0 and n >= {int(min_uses)} and n - gaps >= {float(blank_share)} * n").select("place", F.lit(True).alias("filled"))
    blank = why(salted_join(held.where("gap"), gaps, ["place"], F.xxhash64("item_id")).where("filled"), "slot")
    filler = why(mine.where("filler > 0 and filler * 2 >= words"), "filler")
    # Whole bodies: the addresses of each site that show it.
    copies = pages.where("words > 0").groupBy("whole", "site").agg(F.count_distinct("path").alias("paths"))
    copies = copies.groupBy("whole").agg(F.count("site").alias("sites"), F.sum("paths").alias("paths"), F.max("paths").alias("most"))
    template = copies.where((F.col("most") >= min_paths) | (F.col("sites") >= min_sites) & (F.col("paths") >= 2 * F.col("sites"))).select("whole", F.lit(True).alias("template"))
    units = pages.where("words > 0").select("site", "whole", "article", F.explode("units").alias("u")).select("site", "whole", "article", "u.*")
    # A sentence that always comes within the same long body is a copied article's.
    shown = units.where("not known").groupBy("line", "site").agg(F.min("whole").alias("w0"), F.max("whole").alias("w1"), F.min("article").alias("copied"))
    shown = shown.groupBy("line").agg(F.count("site").alias("sites"), F.min("w0").alias("w0"), F.max("w1").alias("w1"), F.min("copied").alias("copied"))
    shown = shown.where((F.col("sites") >= min_sites) & ((F.col("w0") != F.col("w1")) | ~F.col("copied"))).select("line", F.lit(True).alias("shown"))
    own = salted_join(mine.where("words > 0").select("row", "item_id", "whole", "units"), template, ["whole"], F.xxhash64("row"))
    asked = own.where("template is null").select("row", "item_id", F.explode("units").alias("u")).select("row", "item_id", "u.*")
    told = salted_join(asked, shown, ["line"], F.xxhash64("row")).withColumn("told", F.col("known") | F.col("shown").isNotNull())
    rest = told.groupBy("row", "item_id").agg(F.sum(F.when(F.col("told"), 0).otherwise(F.col("words"))).alias("rest"), F.max("told").alias("any"))
    message = why(rest.where(F.col("any") & (F.col("rest") <= rest_words)), "message").unionByName(why(own.where("template"), "message"))
    return sure.unionByName(slot).unionByName(blank).unionByName(filler).unionByName(message).groupBy("item_id").agg(F.max("reason").alias("reason"))
