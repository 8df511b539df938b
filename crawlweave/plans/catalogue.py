"""Queries of the core operators on the driver's tables, each with the SQL that states the same result.

`QUERIES` and `SQL` are filled by the modules of this package; a query without SQL can't be stated in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crawlweave.functions.urls import add_suffixes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: SQL pieces: authority, host, registered domain and canonical form of an address.
AUTH = "'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)'"


def host(u: str) -> str:
    return f"regexp_replace(regexp_replace(lower(regexp_extract({u}, {AUTH}, 1)), '^.*@', ''), ':[0-9]*$', '')"


#: The suffix of the test tables' invented network.
TEST_SUFFIX = "co.example"
add_suffixes(TEST_SUFFIX)


def registered(u: str) -> str:
    """Label and suffix; the suffixes of two labels that the tables hold are `co.example` and none of a country."""
    h = f"string_split({host(u)}, '.')"
    last = lambda k: f"array_to_string(list_slice({h}, -{k}, -1), '.')"
    return (
        f"CASE WHEN {u} IS NULL THEN NULL WHEN regexp_matches({host(u)}, '^[0-9.]+$') OR contains({host(u)}, '[') OR len({h}) < 2 OR {host(u)} = 'co.example' THEN ''"
        f" WHEN {host(u)} LIKE '%.co.example' THEN {last(3)} ELSE {last(2)} END"
    )


def escapes(x: str) -> str:
    """Escapes of unreserved characters undone, the others in upper case, spaces escaped."""
    code = "('0x' || substr(p, 1, 2))::INT"
    one = f"CASE WHEN i = 1 THEN p WHEN regexp_matches(p, '^[0-9A-Fa-f]{{2}}') THEN CASE WHEN regexp_matches(chr(greatest({code}, 1)), '^[A-Za-z0-9._~-]$') THEN chr({code}) ELSE '%' || upper(substr(p, 1, 2)) END || substr(p, 3) ELSE '%' || p END"
    return f"replace(array_to_string(list_transform(string_split({x}, '%'), lambda p, i: {one}), ''), ' ', '%20')"


def canonical(u: str) -> str:
    bare = f"split_part(trim({u}), '#', 1)"
    head = f"regexp_extract({bare}, '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/?]*)?', 0)"
    rest = f"substr({bare}, length({head}) + 1)"
    path = f"split_part({rest}, '?', 1)"
    query = f"substr({rest}, length({path}) + 2)"
    args = f"array_to_string(list_sort(list_filter(string_split({escapes(query)}, '&'), lambda a: a <> '')), '&')"
    low = f"CASE WHEN regexp_matches(lower({head}), '^http:.*:80$') OR regexp_matches(lower({head}), '^https:.*:443$') THEN regexp_replace(lower({head}), ':[0-9]+$', '') ELSE lower({head}) END"
    return f"{low} || CASE WHEN {path} = '' AND contains({head}, '//') THEN '/' ELSE {escapes(path)} END || CASE WHEN {args} <> '' THEN '?' || {args} ELSE '' END"


def site(c: str) -> str:
    return f"nullif(lower(trim({c})), '')"


def uniform(seed: str, expr: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || {expr}), 1, 13))::BIGINT / 4503599627370496.0)"


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn

    return add


def load() -> None:
    """Import the modules that fill the catalogue."""
    from crawlweave.plans import crawl_queries, io_queries, learn_queries, link_queries, stream_queries  # noqa: F401
