"""Streaming operators as queries: the tables are read as streams to their end and the outcome is given as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave.functions import urls as U
from crawlweave.functions.common import scratch_path, site_key, table
from crawlweave.plans.catalogue import canonical, query, registered, site
from crawlweave.streaming import stateful as S


#: Micro-batches of a streamed table.
BATCHES = 4


def stream(spark: SparkSession, d: str, name: str, order: str) -> DataFrame:
    """A table as a stream of several files, one a micro-batch: its rows in the order of a column, cut into range parts."""
    path = scratch_path(spark, f"stream-{name}")
    src = table(spark, d, name)
    src.repartitionByRange(BATCHES, order).write.parquet(path)
    return spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(path)


def outcome(df: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over all that is there; every batch's rows, with the batch's number, from the shared folder."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    S.use_rocksdb(spark)
    try:
        q = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(schema.add("epoch", "long")).parquet(f"{path}/rows")


@query(f"SELECT DISTINCT {canonical('url')} AS canonical FROM links WHERE url IS NOT NULL")
def stream_dedup(spark, d):
    """Addresses as a stream meets them first."""
    return outcome(S.first_seen(stream(spark, d, "links", "link_id").select("url"), U.canonical(F.col("url"))), "append", "stream-dedup").select("canonical")


@query(f"SELECT {site('domain')} AS domain, count(*)::BIGINT AS requests, coalesce(count_if(metadata.stats.reward >= 0.1), 0)::BIGINT AS relevant, count(*) >= 20 OR coalesce(count_if(metadata.stats.reward >= 0.1), 0) >= 5 AS achieved FROM cdr_items WHERE {site('domain')} IS NOT NULL GROUP BY 1")
def stream_domain_goals(spark, d):
    """Goal counters per domain, kept as state."""
    pages = stream(spark, d, "cdr_items", "item_id").select(site_key(F.col("domain")).alias("domain"), F.col("metadata.stats.reward").alias("reward")).where("domain is not null")
    out = outcome(S.domain_goals(pages, 0.1, 20, 5), "update", "stream-goals")
    return out.groupBy("domain").agg(F.max("requests").alias("requests"), F.max("relevant").alias("relevant"), F.max("achieved").alias("achieved"))


@query("SELECT count(*)::BIGINT AS pages, round(sum(coalesce(reward, 0.0)), 6) AS reward FROM nodes")
def stream_statistics(spark, d):
    """Running totals of a crawl."""
    pages = stream(spark, d, "nodes", "node_id").select("url", F.col("reward"), F.col("original_url").alias("domain"))
    out = outcome(S.crawl_statistics(pages), "complete", "stream-statistics")
    return out.orderBy(F.desc("epoch")).limit(1).select("pages", F.round("reward", 6).alias("reward"))


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, count(*)::BIGINT AS n FROM events GROUP BY 1, 2".replace("date_trunc('day', ts)::TIMESTAMP AS day", "strftime(date_trunc('day', ts), '%Y-%m-%d') AS day"))
def stream_windows(spark, d):
    """Daily counts with a watermark."""
    out = outcome(S.windowed_counts(stream(spark, d, "events", "event_id").select("ts", "event_type"), "ts", "40 days", "1 day", "event_type"), "update", "stream-windows")
    return out.groupBy("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day")).agg(F.max("n").alias("n"))


@query(
    f"""WITH n AS (SELECT {registered('url')} AS slot, node_id, priority FROM nodes WHERE url IS NOT NULL), r AS (SELECT slot, row_number() OVER (PARTITION BY slot ORDER BY priority DESC, node_id) AS k, node_id, priority FROM n)
    SELECT slot, node_id AS seq, priority, CASE WHEN k <= 3 THEN 'popped' ELSE 'dropped' END AS state FROM r"""
)
def stream_frontier(spark, d):
    """Requests through slot queues over several batches: all pushed, the best three of each slot popped, the rest dropped on closing."""
    slot = U.registered_domain(F.col("url")).alias("slot")
    nodes = table(spark, d, "nodes").where("url is not null")
    most = F.lit(1 << 40)
    new = nodes.select(slot, F.lit("push").alias("op"), F.col("node_id").alias("seq"), "url", "priority", F.col("node_id").alias("op_no"))
    slots = nodes.select(slot).distinct()
    none = [F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("url")]
    pops = slots.select("slot", F.lit("pop").alias("op"), *none, F.lit(3).alias("priority"), most.alias("op_no"))
    shut = slots.select("slot", F.lit("close").alias("op"), *none, F.lit(0).alias("priority"), (most + 1).alias("op_no"))
    path = scratch_path(spark, "stream-ops")
    new.repartition(BATCHES - 1).write.parquet(path)
    pops.unionByName(shut).coalesce(1).write.mode("append").parquet(path)  # the source takes files in the order of their writing
    ops = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    return outcome(S.frontier_queues(ops), "update", "stream-frontier").select("slot", "seq", "priority", "state")
