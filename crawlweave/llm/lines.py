"""Lines repeated across one site's documents (problem 1).

Normalised lines are hashed next to the data (an Arrow batch at a time), documents are counted per
(site, line) with map-side partial counts, and only the ids of the lines come back from the join.
A hot site is no hot key: the key is site and line, and the count of a line that a third of all
documents hold is merged from one partial row per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.functions.common import salted_join, site_key, written
from crawlweave.llm.pagetree import line_text

DIGITS = re.compile("[0-9]+")
LINES = "item_id long, line_no int, site long, line long"


def line_key(text: str) -> str:
    """The form in which lines are compared: lower case, every run of digits as one 0."""
    return DIGITS.sub("0", text.lower())


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, nos, sites, lines = [], [], [], []
        for item, site, raw in zip(*(c.to_pylist() for c in batch.columns)):
            h = _hash(site)
            for no, line in enumerate(raw.split("\n"), 1):
                text = line_text(line)
                if text:
                    ids.append(item)
                    nos.append(no)
                    sites.append(h)
                    lines.append(_hash(line_key(text)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(nos, np.int32)), pa.array(sites, pa.int64()), pa.array(lines, pa.int64())], ["item_id", "line_no", "site", "line"])


def line_hashes(items: DataFrame, id_col: str = "item_id", site_col: str = "domain", text_col: str = "raw_content") -> DataFrame:
    """(item_id, line_no, site, line): a row per line with text; items without id, site or text give none."""
    src = items.select(F.col(id_col).cast("long").alias("item_id"), site_key(F.col(site_col)).alias("site"), F.col(text_col).alias("raw")).where("item_id is not null and site is not null and raw is not null and raw <> ''")
    return src.mapInArrow(_lines, LINES)


def repeated_lines(items: DataFrame, min_docs: int = 5, min_share: float = 0.0, id_col: str = "item_id", site_col: str = "domain", text_col: str = "raw_content") -> DataFrame:
    """(item_id, line_no) of every line that at least `min_docs` documents, and at least the share `min_share`
    of the documents, of its site hold.

    Documents are told apart by id, so a row that comes twice counts once. Null id, site or text: no rows.
    Lines without text (only tags or white space) are never reported. An empty table gives an empty result.
    Hashes have 64 bits for the site and 64 for the line; only equal pairs meet.
    """
    lines = written(line_hashes(items, id_col, site_col, text_col), "lines")
    counts = lines.groupBy("site", "line").agg(F.count_distinct("item_id").alias("docs"))
    if min_share > 0:
        sites = lines.groupBy("site").agg(F.count_distinct("item_id").alias("site_docs"))
        counts = counts.where(F.col("docs") >= min_docs).join(sites, "site").where(F.col("docs") >= F.col("site_docs") * min_share)
    else:
        counts = counts.where(F.col("docs") >= min_docs)
    # One row a frequent line and site: broadcast when small, else the rows of a hot line are dealt over copies of it.
    frequent = written(counts.select("site", "line"), "frequent")
    found = salted_join(lines, frequent, ["site", "line"], F.xxhash64("item_id", "line_no"), "inner")
    out = found.select("item_id", F.col("line_no").cast("long").alias("line_no"))
    return out.dropDuplicates() if _repeats(items, id_col) else out


def _repeats(items: DataFrame, id_col: str) -> bool:
    """Whether an id comes twice; counted, so that tables with unique ids spare a shuffle of the result."""
    return items.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).count() > 0


def strip_repeated_lines(items: DataFrame, min_docs: int = 5, min_share: float = 0.0, id_col: str = "item_id", site_col: str = "domain", text_col: str = "raw_content") -> DataFrame:
    """(item_id, removed, text): every document rebuilt without its site's repeated lines.

    Documents without site keep all lines; null text stays null with 0 removed. A row for every row of `items`.
    """
    gone = repeated_lines(items, min_docs, min_share, id_col, site_col, text_col).groupBy("item_id").agg(F.collect_set(F.col("line_no").cast("int")).alias("gone"))
    src = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("raw"))
    return src.join(gone, "item_id", "left").mapInArrow(_rebuild, "item_id long, removed long, text string")


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without their repeated lines, in time linear in their lines."""
    for batch in batches:
        texts, removed = [], []
        for raw, gone in zip(batch.column("raw").to_pylist(), batch.column("gone").to_pylist()):
            removed.append(len(gone or ()))
            if gone and raw is not None:
                drop = set(gone)
                raw = "\n".join(line for no, line in enumerate(raw.split("\n"), 1) if no not in drop)
            texts.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["item_id", "removed", "text"])
