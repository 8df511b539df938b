"""Helpers shared by all operators: scratch tables, key normalising, bounded broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most rows of a side that may be broadcast after its rows were counted.
BROADCAST_ROWS = 200_000
#: Most bytes of such a side.
BROADCAST_BYTES = 32 << 20

_local: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session (`spark.checkpoint.dir`); a local folder only where none is set."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not given:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        given = got.get() if got.isDefined() else None
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not given:
        given = "file://" + tempfile.mkdtemp(prefix="crawlweave-")
        _local.append(given.removeprefix("file://"))
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{scratch_root(spark)}/crawlweave/{name}-{uuid.uuid4().hex}"
    if path.startswith("file:"):
        _local.append(path.split(":", 1)[1].replace("///", "/", 1).replace("//", "/", 1))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path in _local:
        if os.path.isdir(path):
            shutil.rmtree(path, ignore_errors=True)


def site_key(domain: Column) -> Column:
    """A domain as compared everywhere: trimmed, lower-cased; blank and null belong to no site."""
    key = F.lower(F.trim(domain))
    return F.when(key != "", key)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint when both the counted rows and the measured bytes stay within bounds; else the plan's own join is used."""
    return F.broadcast(df) if fits(df, rows, size) else df


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most `rows` rows and `size` bytes (text and nested values measured, 16 bytes for any other)."""
    plain = {"bigint", "int", "double", "float", "boolean", "date", "timestamp", "smallint", "tinyint"}
    width = F.lit(0)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        width = width + (F.lit(16) if kind in plain else F.coalesce(F.octet_length(c if kind in ("string", "binary") else c.cast("string")), F.lit(0)) + 16)
    got = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("b")).first()
    return got.n <= rows and got.b <= size


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = 16) -> DataFrame:
    """Join a table with hot keys to one with a row a key, without all rows of a key meeting in one task.

    The one-row side is broadcast when it was counted and measured small. Else each of its rows is copied `salts` times
    and a key's rows of the other side are dealt over the copies by `spread`, a hash of something that differs among them.
    """
    if fits(one):
        return many.join(F.broadcast(one), keys, how)
    left = many.withColumn("__salt", F.pmod(spread, F.lit(salts)).cast("int"))
    right = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str = "running") -> DataFrame:
    """`df` with running sums in a global order, without one task that holds all rows.

    The table is range-partitioned and written; sums run inside each part and start from the totals of the parts before
    it (one row a part). Rows that are equal in `order` must not exist.
    """
    parts = df.select("*", *[c.alias(f"__{k}") for k, c in sums.items()]).repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    parts = written(parts, name)
    totals = parts.groupBy("__part").agg(*[F.sum(f"__{k}").alias(f"__{k}_sum") for k in sums])
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", *[F.coalesce(F.sum(f"__{k}_sum").over(before), F.lit(0)).alias(f"__{k}_start") for k in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parts.join(F.broadcast(starts), "__part")  # as many rows as shuffle partitions
    return out.select(*df.columns, *[(F.sum(f"__{k}").over(inside) + F.col(f"__{k}_start")).alias(k) for k in sums])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
