"""Sources and sinks: seeds, tolerant JSON lines, experiments, checkpoints, queue dumps, plugins."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlweave.functions.common import running_sums
from crawlweave.functions.rand import order_key

SEED_PRIORITY = 50_000

PAGES = "page_id long, url string, html string, status int, depth int, is_text boolean, from_link_id long"
FRONTIER = "slot string, seq long, url string, priority int, is_seed boolean, removed boolean, from_random boolean, run_id string"
EXPERIENCE = "t long, action array<struct<f:string,v:double>>, next_actions array<array<struct<f:string,v:double>>>, reward double"
CRAWL_LOG = "t long, `return` double, domains_open int, domains_closed int, enqueued long, processed long, item_scraped_count long, response_received_count long, dropped long, todo long, crawled_domains int, relevant_domains int, ts double, is_seed boolean, rss long, reward double, url string, q double, eps_policy boolean"
ITEMS = "run_id string, key string, item string, url string"


def seeds(spark: SparkSession, path: str | None = None, url: str | None = None) -> DataFrame:
    """(url): a list of addresses, one a line, or one address. Blank lines and a `url` header are skipped; `http://` is
    added where there is no scheme."""
    if (path is None) == (url is None):
        raise ValueError("give either a seed list or a seed address")
    lines = spark.read.text(path).select(F.trim("value").alias("url")) if path else spark.createDataFrame([(url.strip(),)], "url string")
    kept = lines.where((F.col("url") != "") & (F.col("url") != "url"))
    return kept.select(F.when(F.col("url").contains("://"), F.col("url")).otherwise(F.concat(F.lit("http://"), F.col("url"))).alias("url"))


def shuffled_seeds(seed_list: DataFrame, seed: str = "1") -> DataFrame:
    """Seeds in seeded random order with their fixed priority."""
    return seed_list.orderBy(order_key(seed, F.col("url")), "url").withColumn("priority", F.lit(SEED_PRIORITY))


def replicated(seed_list: DataFrame, copies: int) -> DataFrame:
    """Every seed once per run, `run-0` to `run-(n-1)`."""
    return seed_list.withColumn("run_id", F.explode(F.array(*[F.lit(f"run-{k}") for k in range(copies)])))


def live(pages: DataFrame, url: str = "url", text: str = "html") -> DataFrame:
    """(url) of the pages that gave text."""
    return pages.where(F.col(text).isNotNull() & (F.col(text) != "")).select(url)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, gzipped or not; broken lines and truncated archives give what can be read."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", "true").json(path)


def repaired(lines: DataFrame, order: str, line: str = "value", file: str | None = None) -> DataFrame:
    """The lines before the first that is no JSON, per file. The first bad line is a merged minimum, not a running window."""
    keys = [file] if file else []
    bad = F.when(F.try_parse_json(line).isNull(), F.col(order))
    first = lines.groupBy(*keys).agg(F.min(bad).alias("__first"))
    joined = lines.join(F.broadcast(first), keys) if keys else lines.withColumn("__k", F.lit(1)).join(F.broadcast(first.withColumn("__k", F.lit(1))), "__k").drop("__k")
    return joined.where(F.col("__first").isNull() | (F.col(order) < F.col("__first"))).select(*lines.columns)


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("compression", "gzip").json(path)


def sliced(df: DataFrame, order: list, offset: int = 0, limit: int = 0) -> DataFrame:
    """Rows offset .. offset + limit of a table in a given order; limit 0 means all."""
    out = df.orderBy(*order).offset(offset)
    return out.limit(limit) if limit else out


def write_outputs(pages: DataFrame, path: str, export_items: bool) -> None:
    """One page stream, one of two projections: crawled documents or statistics rows."""
    cols = ["url", "raw_content", "metadata"] if export_items else [c for c in pages.columns if c != "raw_content"]
    write_json_lines(pages.select(*[c for c in cols if c in pages.columns]), path)


def items_only(items: DataFrame, requests: DataFrame) -> DataFrame:
    """New items and requests, without statistics rows."""
    return items.select(F.lit("item").alias("kind"), F.to_json(F.struct("*")).alias("body")).unionByName(requests.select(F.lit("request").alias("kind"), F.to_json(F.struct("*")).alias("body")))


def write_queue(frontier: DataFrame, path: str, buffer: DataFrame | None = None) -> None:
    """priority,slot,url with a header, gzipped."""
    from crawlweave.operators.frontier import dump

    dump(frontier, buffer).write.mode("overwrite").option("header", "true").option("compression", "gzip").csv(path)


def save_model(weights: DataFrame, meta: dict, path: str, t: int, every: int = 1000, latest: bool = False) -> bool:
    """Checkpoint weights and parameters every so many steps, never at step 0; under the step's number or `latest`."""
    if t == 0 or t % every:
        return False
    at = f"{path}/{'latest' if latest else t}"
    weights.write.mode("overwrite").parquet(f"{at}/weights")
    weights.sparkSession.createDataFrame([(json.dumps(meta | {"t": t}),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{at}/meta")
    return True


def load_model(spark: SparkSession, path: str, at: str = "latest") -> tuple[DataFrame, dict]:
    meta = json.loads(spark.read.text(f"{path}/{at}/meta").first()[0])
    return spark.read.parquet(f"{path}/{at}/weights"), meta


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def experiments(spark: SparkSession, root: str, log_schema: str) -> DataFrame:
    """Crawl logs of all runs below a folder, with the run's name, the input size in it and its parameters.

    Runs that lack a log or parameters drop out by the join.
    """
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    logs = spark.read.schema(log_schema).option("mode", "DROPMALFORMED").json(f"{root}/*/stats.jl*").select("*", name.alias("run"))
    params = spark.read.text(f"{root}/*/params.json", wholetext=True).select(name.alias("run"), F.from_json("value", "map<string,string>").alias("params"))
    return logs.join(params, "run").withColumn("input_size", F.regexp_extract("run", r"(\d+)", 1).cast("int"))


def write_params(spark: SparkSession, params: dict, path: str) -> None:
    """Parameters of a run, or the command, time and input of a started one, as one JSON document."""
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "params string").coalesce(1).write.mode("overwrite").text(path)


def load_classifier(path: str):
    """A fitted ML pipeline by path."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def plugin(name: str) -> Callable:
    """`module:function`, imported."""
    module, _, function = name.partition(":")
    if not function:
        raise ValueError("expected module:function")
    return getattr(importlib.import_module(module), function)


def allowed_arguments(given: dict, allowed: set[str]) -> dict:
    """The given arguments; any other name is an error."""
    extra = set(given) - allowed
    if extra:
        raise ValueError(f"unknown arguments: {', '.join(sorted(extra))}")
    return given


def first_pages(pages: DataFrame, order: str, max_items: int) -> DataFrame:
    """Pages before the response limit (0: no limit); the page that reaches it is not parsed."""
    return pages.orderBy(order).limit(max_items - 1) if max_items else pages


def numbered(df: DataFrame, order: str, name: str = "seq") -> DataFrame:
    """Row numbers from 1 in the order of a unique column."""
    return running_sums(df, [F.asc(order)], {name: F.lit(1)}, "numbered")
