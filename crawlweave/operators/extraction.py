"""Items out of pages: a Python extractor over Arrow batches, and what is done with the items."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def items(pages: DataFrame, extract: Callable[[str, str], Iterable[dict]], schema: str, page_id: str = "page_id", url: str = "url", html: str = "html", on_item: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(page_id, item_no, fields of `schema`): what `extract(html, url)` yields for every page with text, in its order.

    A page on which the extractor raises gives no items (as a crawl goes on), fields that an item lacks are null, others are
    left out. `on_item` gets the items and may filter or change them. Null and empty pages have none.
    """
    fields = T._parse_datatype_string(schema)
    src = pages.where(F.col(html).isNotNull() & (F.col(html) != "")).select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    out = T.StructType([src.schema["page_id"], T.StructField("item_no", T.LongType()), *fields.fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, u, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    found = [dict(x) for x in extract(text, u)]
                except Exception:  # noqa: BLE001 - one bad page must not end the crawl
                    found = []
                rows += [{"page_id": i, "item_no": k, **{f.name: x.get(f.name) for f in fields.fields}} for k, x in enumerate(found)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    got = src.mapInArrow(run, out)
    return on_item(got) if on_item else got
