"""Top N rows within every group by statistics-guided skipping (problem 2).

`cluster` writes the table sorted by (group, score down, ties) into range-partitioned Parquet files with
small row groups, so a hot group is split over files and its best rows lie in few row groups.
`top_n` reads the footers, derives from them, per group, a score that N rows are known to reach, and then
reads row groups in descending maximum score; a row group strictly below the N-th score of every group it
holds is skipped unread. Each file gives at most N rows a group; a window over those settles the order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlweave.functions.common import partitions, scratch_path

FOOTERS = "file string, rg int, rows long, g_min string, g_max string, s_min double, s_max double"


#: A row group holds at most this part of the largest group, within these bytes.
PART, LEAST_BYTES, MOST_BYTES = 16, 8 << 10, 128 << 20
ROW_BYTES = 48


def cluster(df: DataFrame, row_group_bytes: int | None = None) -> str:
    """Write (grp string, score double, tie string, id long) clustered by group; returns the path, which `top_n` takes again.

    Null groups and null or NaN scores do not compete and are left out here. Without `row_group_bytes` row groups are cut so that
    the largest group fills several (its counted rows merge map-side): only then is there something to skip.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "clustered")
    order = [F.asc("grp"), F.desc("score"), F.asc_nulls_last("tie"), F.asc("id")]
    src = df.where(F.col("grp").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    if row_group_bytes is None:
        most = src.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
        row_group_bytes = min(MOST_BYTES, max(LEAST_BYTES, most * ROW_BYTES // PART))
    (
        src.repartitionByRange(partitions(spark), *order)
        .sortWithinPartitions(*order)
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", max(1 << 10, min(1 << 20, row_group_bytes // 8)))
        .option("parquet.enable.dictionary", "true")
        .option("parquet.column.statistics.enabled", "true")
        .parquet(path)
    )
    return path


def _open(uri: str) -> pq.ParquetFile:
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1))
    return pq.ParquetFile(fs.open_input_file(path))


def _footers(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for uri in frame["file"]:
            with _open(uri) as f:
                meta, names = f.metadata, f.schema_arrow.names
                g, s = names.index("grp"), names.index("score")
                for k in range(meta.num_row_groups):
                    rg = meta.row_group(k)
                    gs, ss = rg.column(g).statistics, rg.column(s).statistics
                    known = gs is not None and gs.has_min_max
                    scored = ss is not None and ss.has_min_max
                    out.append((uri, k, rg.num_rows, gs.min if known else None, gs.max if known else None, ss.min if scored else None, ss.max if scored else None))
        yield pd.DataFrame(out, columns=["file", "rg", "rows", "g_min", "g_max", "s_min", "s_max"])


def _read(n: int):
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One file a row: its row groups with their statistics and the known N-th scores."""
        for frame in frames:
            for uri, groups in zip(frame["file"], frame["groups"]):
                best: dict[str, list[tuple]] = {}  # group -> heap of its n best, worst first
                seen, skipped = 0, 0
                with _open(uri) as f:
                    for rg in sorted(groups, key=lambda r: (-(r["s_max"] if r["s_max"] is not None else float("inf")), r["rg"])):
                        lo, top = rg["g_min"], rg["s_max"]
                        if top is not None and lo is not None and _below(f, rg, best, n):
                            skipped += 1
                            continue
                        seen += 1
                        t = f.read_row_group(rg["rg"], columns=["grp", "score", "tie", "id"])
                        for g, s, tie, i in zip(*(c.to_pylist() for c in _leading(t, n).columns)):
                            heap = best.setdefault(g, [])
                            row = (s, _Rev(tie), -i)
                            if len(heap) < n:
                                heapq.heappush(heap, row)
                            elif row > heap[0]:
                                heapq.heapreplace(heap, row)
                rows = [(g, s, tie.text, -i) for g, heap in best.items() for s, tie, i in heap]
                out = pd.DataFrame(rows, columns=["grp", "score", "tie", "id"])
                out["rg_read"], out["rg_skipped"], out["file"] = seen, skipped, uri
                yield out

    return read


def _below(f: pq.ParquetFile, rg: dict, best: dict[str, list[tuple]], n: int) -> bool:
    """Whether the row group's best score is strictly below the N-th score known of every group in it.

    With one group the footer tells which. With several, the group column alone is read, and only if the first and the
    last group leave it possible.
    """
    def beaten(g: str, floor: float | None = None) -> bool:
        known = best.get(g, ())
        nth = known[0][0] if len(known) == n else None
        if floor is not None and (nth is None or floor > nth):
            nth = floor
        return nth is not None and rg["s_max"] < nth

    if rg["g_min"] == rg["g_max"]:
        return beaten(rg["g_min"], rg["floor"])
    if not (beaten(rg["g_min"]) and beaten(rg["g_max"])):
        return False
    return all(beaten(g) for g in f.read_row_group(rg["rg"], columns=["grp"]).column("grp").unique().to_pylist())


def _leading(t: pa.Table, n: int) -> pa.Table:
    """The rows that reach their group's n-th score inside this row group, ties included."""
    if t.num_rows <= n:
        return t
    codes = t.column("grp").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    score = t.column("score").to_numpy()
    order = np.lexsort((-score, codes))
    c, s = codes[order], score[order]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    size = np.diff(np.r_[first, len(c)])
    nth = np.repeat(s[first + np.minimum(size, n) - 1], size)
    return t.take(pa.array(np.sort(order[s >= nth])))


class _Rev:
    """A tie key that compares backwards: the smaller text is the better row; null is worst."""

    __slots__ = ("text",)

    def __init__(self, text: str | None) -> None:
        self.text = text

    def __lt__(self, other: _Rev) -> bool:
        if self.text is None or other.text is None:
            return self.text is None and other.text is not None
        return self.text.encode() > other.text.encode()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Rev) and self.text == other.text


def _candidates(spark: SparkSession, path: str, n: int) -> DataFrame:
    names = spark.read.parquet(path).inputFiles()  # from the listing: as many as the table has files
    files = spark.createDataFrame([(f,) for f in names], "file string")
    spread = files.repartition(max(1, min(len(names), partitions(spark))), "file")
    foot = spread.mapInPandas(_footers, FOOTERS)
    # A row group of one group with at least n rows shows that the group's n-th score is no less than its minimum.
    floor = foot.where((F.col("g_min") == F.col("g_max")) & (F.col("rows") >= n) & F.col("s_min").isNotNull()).groupBy(F.col("g_min").alias("g")).agg(F.max("s_min").alias("floor"))
    foot = foot.join(floor, F.col("g_min").eqNullSafe(F.col("g")), "left")
    # Row groups of a file are few (file size over row group size), whatever the data.
    work = foot.groupBy("file").agg(F.collect_list(F.struct("rg", "g_min", "g_max", "s_max", F.when(F.col("g_min") == F.col("g_max"), F.col("floor")).alias("floor"))).alias("groups"))
    return work.mapInPandas(_read(n), "grp string, score double, tie string, id long, rg_read long, rg_skipped long, file string")


def keyed(df: DataFrame, group_cols: list[str], score: str, tie: str, row_id: str) -> DataFrame:
    """(grp, score, tie, id): the group columns as one text that tells them apart whatever they hold."""
    some = F.lit(True)
    for g in group_cols:
        some &= F.col(g).isNotNull()
    return df.where(some).select(
        F.to_json(F.array(*[F.col(g).cast("string") for g in group_cols])).alias("grp"), F.col(score).cast("double").alias("score"), F.col(tie).cast("string").alias("tie"), F.col(row_id).cast("long").alias("id")
    )


def top_n(df: DataFrame, group_cols: list[str], score: str, tie: str, row_id: str, n: int = 3, row_group_bytes: int | None = None) -> DataFrame:
    """The `n` best rows of every group: score descending, then `tie` (a string) ascending, then `row_id` ascending.

    Columns: the group columns as strings, `score`, `row_id` (both by their names), `rank` from 1.
    Null group columns, null scores and NaN do not compete. A null tie comes after every other. Rows that come
    twice compete as they are. Strings are ordered by their UTF-8 bytes. An empty table gives an empty result.
    """
    path = cluster(keyed(df, group_cols, score, tie, row_id), row_group_bytes)
    return top_n_of(df.sparkSession, path, group_cols, score, row_id, n)


def top_n_of(spark: SparkSession, path: str, group_cols: list[str], score: str, row_id: str, n: int = 3) -> DataFrame:
    """`top_n` of a table that `cluster` wrote from `keyed` rows: for any n, and as often as wanted."""
    best = _candidates(spark, path, n)
    w = Window.partitionBy("grp").orderBy(F.desc("score"), F.asc_nulls_last("tie"), F.asc("id"))
    parts = F.from_json("grp", "array<string>")
    return (
        best.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= n)
        .select(*[parts[k].alias(g) for k, g in enumerate(group_cols)], F.col("score").alias(score), F.col("id").alias(row_id), F.col("rank").cast("long").alias("rank"))
    )


def skipping_report(df: DataFrame, group_cols: list[str], score: str, tie: str, row_id: str, n: int = 3, row_group_bytes: int | None = None) -> DataFrame:
    """(files, row_groups_read, row_groups_skipped) of one `top_n` run over the clustered table."""
    path = cluster(keyed(df, group_cols, score, tie, row_id), row_group_bytes)
    per = _candidates(df.sparkSession, path, n).groupBy("file").agg(F.max("rg_read").alias("r"), F.max("rg_skipped").alias("s"))
    return per.agg(F.count("*").alias("files"), F.coalesce(F.sum("r"), F.lit(0)).alias("row_groups_read"), F.coalesce(F.sum("s"), F.lit(0)).alias("row_groups_skipped"))
