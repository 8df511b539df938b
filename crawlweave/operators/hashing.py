"""Link features hashed into 2^20 buckets, and scores by a broadcast weight array.

One Arrow pass turns the texts of a link into buckets: nothing is exploded and nothing shuffled on a feature, and a
model has the same size (8 MB) however many n-grams the crawl has seen.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.functions import text as T
from crawlweave.functions import urls
from crawlweave.operators.features import check_blocks

BUCKETS = 1 << 20
_known: dict[tuple[str, str], int] = {}


def bucket(block: str, gram: str) -> int:
    """The first 20 bits of md5(block:gram)."""
    key = (block, gram)
    got = _known.get(key)
    if got is None:
        if len(_known) > 500_000:
            _known.clear()
        got = _known[key] = int(hashlib.md5(f"{block}:{gram}".encode("utf-8", "surrogatepass")).hexdigest()[:5], 16)
    return got


def char_vector(block: str, text: str | None, lo: int, hi: int) -> dict[int, float]:
    """Distinct character n-grams, each 1/sqrt(n); grams that share a bucket add up."""
    text = text or ""
    grams = {text[i : i + k] for k in range(lo, hi + 1) for i in range(len(text) - k + 1)}
    out: dict[int, float] = {}
    for g in sorted(grams):
        b = bucket(block, g)
        out[b] = out.get(b, 0.0) + 1 / math.sqrt(len(grams))
    return out


@dataclass(frozen=True)
class Hashed:
    """Which parts of a link (inside_text, attrs, url, domain_from, domain_to, page_url) become features."""

    use_link_text: bool = True
    use_url: bool = False
    use_full_url: bool = False
    use_page_url: bool = False
    use_same_domain: bool = True

    def columns(self) -> dict[str, Column]:
        """The texts, computed in the JVM."""
        check_blocks(self.use_url, self.use_full_url, self.use_link_text, self.use_same_domain)
        out: dict[str, Column] = {}
        if self.use_link_text:
            out["text"] = T.link_text(F.col("inside_text"), F.col("attrs"))
        if self.use_url or self.use_full_url:
            out["url"] = urls.canonical(F.col("url")) if self.use_full_url else urls.path_query(F.col("url"))
        if self.use_page_url:
            out["page_url"] = urls.path_query(F.col("page_url"))
        if self.use_same_domain:
            out["same_domain"] = F.when(F.lower(F.trim("domain_from")) == F.lower(F.trim("domain_to")), "1").otherwise("")
        return out

    def vector(self, row: dict[str, str | None]) -> dict[int, float]:
        out: dict[int, float] = {}
        for block, text in row.items():
            part = {bucket(block, ""): 1.0} if block == "same_domain" and text else {} if block == "same_domain" else char_vector(block, text, *((3, 5) if block == "text" else (4, 5)))
            for b, v in part.items():
                out[b] = out.get(b, 0.0) + v
        return out


def _rows(batch: pa.RecordBatch, names: list[str], spec: Hashed) -> Iterator[dict[int, float]]:
    for values in zip(*(batch.column(n).to_pylist() for n in names)):
        yield spec.vector({n.removeprefix("__"): v for n, v in zip(names, values)})


def vectors(links: DataFrame, row_id: str, spec: Hashed = Hashed()) -> DataFrame:
    """(row_id, buckets, values): the sparse vector of every link. Null texts give no features; an empty table gives none."""
    cols = spec.columns()
    src = links.select(F.col(row_id).alias("row_id"), *[c.alias(f"__{n}") for n, c in cols.items()])
    names = [f"__{n}" for n in cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vs = [sorted(v.items()) for v in _rows(batch, names, spec)]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array([[b for b, _ in v] for v in vs], pa.list_(pa.int32())), pa.array([[x for _, x in v] for v in vs], pa.list_(pa.float64()))], ["row_id", "buckets", "values"])

    kind = src.schema["row_id"].dataType.simpleString()
    return src.mapInArrow(run, f"row_id {kind}, buckets array<int>, values array<double>").withColumnRenamed("row_id", row_id)


def weight_array(weights: DataFrame) -> np.ndarray:
    """(bucket, w) as an array; no more than 2^20 rows, whatever the data."""
    out = np.zeros(BUCKETS)
    for r in weights.select("bucket", "w").where(F.col("bucket").between(0, BUCKETS - 1)).toLocalIterator():
        out[r.bucket] = r.w
    return out


def scores(links: DataFrame, row_id: str, weights: np.ndarray, intercept: float, spec: Hashed = Hashed()) -> DataFrame:
    """(row_id, q): linear scores in one narrow pass over the links, the weights broadcast (8 MB)."""
    cols = spec.columns()
    src = links.select(F.col(row_id).alias("row_id"), *[c.alias(f"__{n}") for n, c in cols.items()])
    names = [f"__{n}" for n in cols]
    w = links.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = [intercept + sum(w.value[b] * x for b, x in v.items()) for v in _rows(batch, names, spec)]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(q, pa.float64())], ["row_id", "q"])

    kind = src.schema["row_id"].dataType.simpleString()
    return src.mapInArrow(run, f"row_id {kind}, q double").withColumnRenamed("row_id", row_id)


def rescored(table: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """`table` with `q` from its stored `buckets` and `values`."""
    w = table.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(b, v):
        return (b.combine(v, lambda x, y: float(w.value[np.asarray(x, int)] @ np.asarray(y)) if x is not None and len(x) else 0.0)).astype(float) + intercept

    return table.withColumn("q", score("buckets", "values"))
