"""Text functions: tokens, n-grams, link text, keyword relevancy, text of HTML."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def squash(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def link_text(inside_text: Column, attrs: Column) -> Column:
    """Text of a link for features: anchor text and title, normalised."""
    return squash(F.concat_ws(" ", inside_text, F.try_element_at(attrs, F.lit("title"))))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores, as they are written."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside the lambdas of `body` a plain Column would be evaluated per element."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def _char_gram(text: Column, k: int):
    return lambda i: F.substr(text, i, F.lit(k))


def ngrams(words: Column, n: int) -> Column:
    """All 1..n word n-grams, joined by a space; shorter ones first. Null words have none."""
    return let(words, lambda w: _ngrams(w, n))


def _ngrams(words: Column, n: int) -> Column:
    """Longer grams grow from shorter ones: a gram and the word after it, pair by pair."""
    grams, parts = words, [words]
    for k in range(2, n + 1):
        left = F.greatest(F.size(words) - (k - 1), F.lit(0))
        grams = F.zip_with(F.slice(grams, F.lit(1), left), F.slice(words, F.lit(k), left), lambda g, w: F.concat(g, F.lit(" "), w))
        parts.append(grams)
    return F.coalesce(F.concat(*parts), F.array().cast("array<string>"))


def char_ngrams(text: Column, lo: int, hi: int) -> Column:
    """Distinct character n-grams of lengths lo..hi."""
    return let(text, lambda t: _char_ngrams(t, lo, hi))


def _char_ngrams(text: Column, lo: int, hi: int) -> Column:
    parts = []
    for k in range(lo, hi + 1):
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(1)))
        parts.append(F.when(F.length(text) >= k, F.transform(starts, _char_gram(text, k))).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(F.array(*parts)))


def parse_keywords(lines: list[str]) -> tuple[list[str], list[str]]:
    """Positive and negative terms of a keyword list; a leading `-` makes a term negative. Blank lines are skipped."""
    terms = [t.strip() for t in lines if t.strip()]
    return [t.lower() for t in terms if not t.startswith("-")], [t[1:].strip().lower() for t in terms if t.startswith("-")]


def max_ngram(terms: list[str]) -> int:
    """Most words of a term; 1 for an empty list."""
    return max([len(t.split()) for t in terms] or [1])


def log_scale(count: Column, n_terms: int) -> Column:
    """ln(count + 1) to the base n_terms / 2 + 2."""
    return F.log(count + 1) / F.log(F.lit(n_terms / 2.0 + 2))


def relevancy(text: Column, positive: list[str], negative: list[str], negative_weight: float = 0.33) -> Column:
    """max(0, scaled positive hits - 0.33 x scaled negative hits); 0 for null text.

    A term hits where its words (those that single spaces part) stand in a row in the text: looked up as text among the joined
    words, so no list of n-grams is built. A term listed twice counts twice.
    """

    def score(line: Column) -> Column:
        def hits(terms: list[str]) -> Column:
            out = F.lit(0)
            for t in terms:
                out = out + F.contains(line, F.lit(f" {t} ")).cast("int")
            return out

        return F.greatest(F.lit(0.0), log_scale(hits(positive), len(positive)) - F.lit(negative_weight) * log_scale(hits(negative), len(negative)))

    words = F.concat(F.lit(" "), F.array_join(tokens(F.lower(text)), " "), F.lit(" "))
    return F.when(text.isNull(), F.lit(0.0)).otherwise(let(words, score))


def unescape(text: Column) -> Column:
    """All entities of HTML decoded, in Arrow batches."""

    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: html.unescape(x) if x is not None and "&" in x else x)

    return run(text)


def html_text(page: Column) -> Column:
    """Visible text of a page, lower-cased: no scripts, styles, comments or tags; entities decoded; white space collapsed."""
    out = F.regexp_replace(page, r"(?is)<(script|style|noscript)\b[^>]*>.*?</(script|style|noscript)\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(F.lower(unescape(out)), r"[\s\u00A0]+", " "))
