"""Address functions as Column expressions: they stay in the JVM and in whole-stage codegen."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels under which countries register names, and the countries (top-level domains) that do so.
SECOND_LEVEL = "ac ad asn ed edu co com go gob gov gouv gv ltd me mil ne net nhs nic nom or org plc sch school web".split()
SECOND_LEVEL_COUNTRIES = (
    "ae af ag ai al ar at au ba bb bd bh bn bo br bs bw bz ci ck cn co cr cu cy do dz ec eg et fj fk ge gh gi gr gt gy hk hn hr hu id il in iq ir jm jo jp ke kh kr kw kz lb lc lk ls ly ma mg mk ml mm mo mt mu mv mw mx my mz na ng ni np nz om"
    " pa pe pf pg ph pk pl pr ps pt py qa ro rs ru rw sa sb sc sd sg sl sn sv sy sz th tj tm tn to tr tt tw tz ua ug uk uy uz ve vi vn ws ye za zm zw"
).split()
#: Further suffixes of two labels; `add_suffixes` adds those of a private or test network.
_more_suffixes: set[str] = set()
# File extensions that hold no pages.
IGNORED_EXTENSIONS = (
    "7z 7zip bz2 rar tar gz xz zip tgz mng pct bmp gif jpg jpeg png pst psp tif tiff ai drw dxf eps ps svg cdr ico webp mp3 wma ogg wav ra aac mid au aiff 3gp asf asx avi mov mp4 mpg qt rm swf wmv m4a m4v flv webm"
    " xls xlsx ppt pptx pps doc docx odt ods odg odp css pdf exe bin rss dmg iso apk"
).split()
# Fixed value: words in an address that promise a sign-up or log-in page.
PROMISING = "(regi|join|create|sign|account|user|login|recover|password)"

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def add_suffixes(*suffixes: str) -> None:
    """Treat these (two labels each) as public suffixes too."""
    _more_suffixes.update(s.strip().lower() for s in suffixes)


def public_suffix(two: Column) -> Column:
    """Whether two labels are a public suffix together: a registry label of a country that has those, or an added suffix."""
    rule = F.substring_index(two, ".", 1).isin(SECOND_LEVEL) & F.substring_index(two, ".", -1).isin(SECOND_LEVEL_COUNTRIES)
    return rule | two.isin(sorted(_more_suffixes)) if _more_suffixes else rule


def host(url: Column) -> Column:
    """Host in lower case, without user and port; '' where there is none."""
    auth = F.lower(F.regexp_extract(url, AUTHORITY, 1))
    return F.regexp_replace(F.regexp_replace(auth, "^.*@", ""), ":[0-9]*$", "")


def registered_domain(url: Column) -> Column:
    """The label in front of the public suffix with the suffix, lower-cased; '' for IP addresses and single labels. Null stays null."""
    h = host(url)
    labels = F.split(h, r"\.")
    two = F.concat_ws(".", F.slice(labels, -2, 2))
    three = F.concat_ws(".", F.slice(labels, -3, 3))
    out = (
        F.when(h.rlike(r"^[0-9.]+$") | h.contains("[") | (F.size(labels) < 2), F.lit(""))
        .when(public_suffix(two), F.when(F.size(labels) >= 3, three).otherwise(F.lit("")))
        .otherwise(two)
    )
    return F.when(url.isNotNull(), out)


def response_domain(domain: Column, url: Column) -> Column:
    """The domain a request was made for, else the address's own."""
    return F.coalesce(domain, registered_domain(url))


# Characters that addresses write without an escape.
UNRESERVED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~"


def escapes(part: Column) -> Column:
    """One way to write escapes: unreserved characters plain, hex digits in upper case, white space escaped."""
    plain = F.create_map(*[F.lit(x) for c in UNRESERVED for x in (f"{ord(c):02X}", c)])

    def one(p: Column, i: Column) -> Column:
        code = F.upper(F.substr(p, F.lit(1), F.lit(2)))
        rest = F.substr(p, F.lit(3))
        return F.when(i == 0, p).when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.coalesce(F.try_element_at(plain, code), F.concat(F.lit("%"), code)), rest)).otherwise(F.concat(F.lit("%"), p))

    out = F.when(part.contains("%"), F.array_join(F.transform(F.split(part, "%", -1), one), "")).otherwise(part)
    return F.when(out.contains(" "), F.replace(out, F.lit(" "), F.lit("%20"))).otherwise(out)


def canonical(url: Column) -> Column:
    """One form of equal addresses: no fragment, scheme and host in lower case, no default port, `/` for an empty path,
    one way to write escapes, arguments sorted."""
    bare = F.substring_index(F.trim(url), "#", 1)
    head = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?]*)?", 0)
    rest = F.substr(bare, F.length(head) + 1)
    path = F.substring_index(rest, "?", 1)
    query = F.substr(rest, F.length(path) + 2)
    args = F.array_join(F.array_sort(F.filter(F.split(escapes(query), "&"), lambda a: a != "")), "&")
    low = F.regexp_replace(F.lower(head), r"^(http(?=:.*:80$)|https(?=:.*:443$))(:.*):[0-9]+$", "$1$2")
    return F.concat(low, F.when((path == "") & head.contains("//"), F.lit("/")).otherwise(escapes(path)), F.when(args != "", F.concat(F.lit("?"), args)).otherwise(F.lit("")))


def path_query(url: Column) -> Column:
    """Path, `?` and query, decoded (`+` as a space) and lower-cased; the `?` is always there."""
    bare = F.regexp_replace(F.substring_index(url, "#", 1), AUTHORITY, "")
    path = F.substring_index(bare, "?", 1)
    query = F.substr(bare, F.length(path) + 2)
    whole = F.concat(path, F.lit("?"), query)
    return F.lower(F.coalesce(F.try_url_decode(whole), whole))


def js_target(href: Column) -> Column:
    """The address in `location.href='...'`, wherever it stands; null without one."""
    hit = F.regexp_extract(href, r"(javascript:)?location\.href=['\"](.+)['\"]", 2)
    return F.when(hit != "", hit)


def ignored_extension(url: Column) -> Column:
    """Whether the address's path ends in an extension that holds no page."""
    path = F.substring_index(F.substring_index(F.regexp_replace(url, AUTHORITY, ""), "#", 1), "?", 1)
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return ext.isin(IGNORED_EXTENSIONS)


def base_url(html: Column, url: Column) -> Column:
    """`<base href>` within the first 4096 characters, else the page's own address."""
    base = F.regexp_extract(F.substring(html, 1, 4096), r"(?is)<base\s[^>]*?href\s*=\s*[\"']?\s*([^\"'\s>]+)", 1)
    return F.when(base != "", base).otherwise(url)


def no_dots(path: Column) -> Column:
    """A path from the root without `.` and `..` segments."""
    parts = F.split(path, "/", -1)
    up = lambda acc: F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == ".", acc).when(p == "..", up(acc)).otherwise(F.concat(acc, F.array(p))))
    ends = F.when(path.rlike(r"/\.{1,2}$"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.array_join(ends, "/")).otherwise(path)


def resolve(base: Column, href: Column) -> Column:
    """href against base, dot segments resolved, as a Column expression."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    root = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    bare = F.substring_index(base, "#", 1)
    no_query = F.substring_index(bare, "?", 1)
    folder = F.regexp_replace(F.substr(no_query, F.length(root) + 1), r"[^/]*$", "")
    own_path = F.regexp_extract(href, r"^[^?#]*", 0)
    tail = F.substr(href, F.length(own_path) + 1)
    whole = F.when(own_path.startswith("/"), own_path).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), own_path))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href == "", bare)
        .when(href.startswith("#"), F.concat(bare, href))
        .when(href.startswith("?"), F.concat(no_query, href))
        .otherwise(F.concat(root, no_dots(whole), tail))
    )


def resolve_exact(base: Column, href: Column) -> Column:
    """Resolution by the standard library, in Arrow batches: also the odd forms (scheme-only bases, path parameters)."""

    @F.pandas_udf("string")
    def run(b: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _join(x, y) for x, y in zip(b, h)], dtype=object)

    return run(base, href)


def _join(base: str, href: str) -> str:
    try:
        return urljoin(base, href)
    except ValueError:
        return href


def promising(url: Column) -> Column:
    """1 if path, query or fragment holds a sign-up or log-in word, else 0."""
    return F.when(F.regexp_replace(url, AUTHORITY, "").rlike(PROMISING), 1).otherwise(0)
