"""Evaluation texts leaking into training text (problem 8): winnowed fingerprints, joined and extended.

Every text is cut into words; of each window of `span - k + 1` successive k-gram hashes the smallest is kept.
Any `span` words that two texts share contain one whole window, so they share a fingerprint: no leak is missed.
Hits are then extended over the words themselves, so no report is wrong.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.functions.common import salted_join, small, written

FORMAT = regex.compile(r"\p{Cf}+")
WORD = regex.compile(r"[\p{L}\p{Nd}]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits after dropping format characters, NFKC and lower-casing."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", FORMAT.sub("", text))
    return WORD.findall(text.lower())


def _grams(ws: list[str], k: int, known: dict[str, int]) -> np.ndarray:
    codes = np.empty(len(ws), np.uint64)
    for n, w in enumerate(ws):
        c = known.get(w)
        if c is None:
            if len(known) > 200_000:
                known.clear()
            c = known[w] = xxhash.xxh3_64_intdigest(w)
        codes[n] = c
    h = np.zeros(len(ws) - k + 1, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def fingerprints(ws: list[str], k: int, span: int, known: dict[str, int] | None = None) -> np.ndarray:
    """Distinct winnowed k-gram hashes of a word list; none when it is shorter than `span`."""
    if len(ws) < span:
        return np.empty(0, np.int64)
    h = _grams(ws, k, {} if known is None else known)
    return np.unique(sliding_window_view(h, span - k + 1).min(1)).view(np.int64)


def _prints(k: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            ids, out = [], []
            for i, text in zip(*(c.to_pylist() for c in batch.columns)):
                f = fingerprints(words(text), k, span, known)
                ids.append(np.full(len(f), i, np.int64))
                out.append(f)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids) if ids else np.empty(0, np.int64)), pa.array(np.concatenate(out) if out else np.empty(0, np.int64))], ["id", "fp"])

    return run


def shared_span(a: list[str], b: list[str], span: int) -> tuple[int, int, int]:
    """(length, start in a, start in b) of the longest run of words in both, or zeros when shorter than `span`."""
    if len(a) < span or len(b) < span:
        return 0, 0, 0
    at: dict[tuple, list[int]] = {}
    for j in range(len(b) - span + 1):
        at.setdefault(tuple(b[j : j + span]), []).append(j)
    best, ends = (0, 0, 0), {}
    for i in range(len(a) - span + 1):
        for j in at.get(tuple(a[i : i + span]), ()):
            if ends.get(i - j, -1) > i:  # inside a run already extended
                continue
            n = span
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            ends[i - j] = i + n - span + 1
            if n > best[0]:
                best = (n, i, j)
    return best


def _extend(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut: dict[str, list[str]] = {}
        for batch in batches:
            out = []
            last, mine = None, []
            for doc, item, text, passage in zip(*(c.to_pylist() for c in batch.columns)):
                if text is not last:
                    last, mine = text, words(text)
                if len(cut) > 5000:
                    cut.clear()
                theirs = cut.get(passage)
                if theirs is None:
                    theirs = cut[passage] = words(passage)
                n, i, j = shared_span(mine, theirs, span)
                if n:
                    out.append((doc, item, n, i, j, len(theirs)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(6)], ["doc_id", "item_id", "span", "doc_at", "item_at", "item_words"])

    return run


def leaks(docs: DataFrame, items: DataFrame, span: int = 12, k: int = 6, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, span, doc_at, item_at, item_words): every document and item with `span` or more words in a row in common.

    span: length of the longest shared run; doc_at, item_at: its first word in either (from 0). Null texts, and texts
    of fewer words, have no leak. Rows that come twice give one row a pair. Empty tables give an empty result.
    The items' fingerprints, and the hit pairs, are broadcast only when counted and measured small; else they are joined by shuffle.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).alias("text")).where("id is not null and text is not null")
    e = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null and text is not null")
    run = _prints(k, span)
    test = written(e.mapInArrow(run, "id long, fp long").distinct(), "test-prints")
    # A fingerprint is one key of the join, with the items that hold it beside it, so that a hot one can be dealt over copies.
    keyed = written(test.withColumn("lot", F.pmod(F.xxhash64("id"), F.lit(64))).groupBy("fp", "lot").agg(F.collect_list("id").alias("items")).drop("lot"), "keyed-prints")
    hits = salted_join(d.mapInArrow(run, "id long, fp long"), keyed, ["fp"], F.xxhash64("id"), "inner").select("id", F.explode("items").alias("item_id"))
    pairs = written(hits.select(F.col("id").alias("doc_id"), "item_id").distinct(), "hits")
    texts = d.withColumnRenamed("id", "doc_id").join(small(pairs), "doc_id")
    both = texts.join(small(e.select(F.col("id").alias("item_id"), F.col("text").alias("passage"))), "item_id")
    found = both.select("doc_id", "item_id", "text", "passage").mapInArrow(_extend(span), "doc_id long, item_id long, span long, doc_at long, item_at long, item_words long")
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("span", "doc_at", "item_at", "item_words")).alias("s")).select("doc_id", "item_id", "s.*")


def leaked_items(found: DataFrame) -> DataFrame:
    """(item_id, docs, longest, share): per leaked item its documents and the largest leaked part."""
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"), F.max("span").alias("longest"), F.max(F.col("span") / F.col("item_words")).alias("share"))
