"""The crawl graph: nodes, edges, and what can be learned along them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(pages: DataFrame, links: DataFrame, key: str = "url") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from pages (page_id, url, ok) and their links (page_id, url): a node per address, an edge per link.

    Ids are hashes of the address, so building twice, or in parts, gives the same graph.
    """
    node = lambda c: F.xxhash64(c)
    seen = pages.groupBy(F.col(key).alias("url")).agg(F.max("ok").alias("ok")).withColumn("visited", F.lit(True))
    new = links.select("url").distinct().join(seen.select("url"), "url", "left_anti").select("url", F.lit(None).cast("boolean").alias("ok"), F.lit(False).alias("visited"))
    nodes = seen.unionByName(new).withColumn("node_id", node(F.col("url")))
    edges = links.join(pages.select("page_id", F.col(key).alias("__from")), "page_id").select(node(F.col("__from")).alias("src"), node(F.col("url")).alias("dst"), F.struct("url").alias("link"))
    return nodes, edges


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, in_degree, out_degree); repeated edges count each."""
    i = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("i"))
    o = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("o"))
    return nodes.select("node_id").join(i, "node_id", "left").join(o, "node_id", "left").select("node_id", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))


def edge_rewards(nodes: DataFrame, edges: DataFrame, reward: str = "reward") -> DataFrame:
    """(src, dst, source, target, delta): rewards at both ends of edges between rewarded nodes, and the gain."""
    r = nodes.where(F.col(reward).isNotNull()).select("node_id", F.col(reward).alias("r"))
    a = edges.select("src", "dst").join(r.withColumnRenamed("node_id", "src").withColumnRenamed("r", "source"), "src")
    b = a.join(r.withColumnRenamed("node_id", "dst").withColumnRenamed("r", "target"), "dst")
    return b.select("src", "dst", "source", "target", F.greatest(F.lit(0.0), F.col("target") - F.col("source")).alias("delta"))


def best_successor(nodes: DataFrame, edges: DataFrame, reward: str = "reward") -> DataFrame:
    """(node_id, successors, best, mean): rewards one link further."""
    return edge_rewards(nodes, edges, reward).groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("successors"), F.max("target").alias("best"), F.avg("target").alias("mean"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes."""
    ids = nodes.select("node_id").distinct()
    return edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def state_counts(nodes: DataFrame) -> DataFrame:
    """(created, visited, ok, err)."""
    return nodes.agg(F.count("*").alias("created"), F.count_if("visited").alias("visited"), F.count_if(F.col("ok")).alias("ok"), F.count_if(~F.col("ok")).alias("err"))


def choices(edges: DataFrame) -> DataFrame:
    """(node_id, url): the different addresses a node links to; a row each, so a hub is no large value."""
    return edges.select(F.col("src").alias("node_id"), F.col("link.url").alias("url")).where("url is not null").distinct()


def examples(nodes: DataFrame, edges: DataFrame, graph: str | None = None) -> DataFrame:
    """(node_id, via, reward, choices): an example per in-edge of a visited, good node, with how many addresses it
    offers; the addresses themselves are in `choices`, or in `with_offers`. `graph`: a column that tells several graphs apart."""
    keys = [graph] if graph else []
    good = nodes.where("visited and ok").select(*keys, "node_id", "reward")
    into = edges.select(*keys, F.col("dst").alias("node_id"), F.col("src").alias("via"))
    offers = edges.where("link.url is not null").select(*keys, F.col("src").alias("node_id"), F.col("link.url").alias("url")).distinct().groupBy(*keys, "node_id").agg(F.count("*").alias("choices"))
    return good.join(into, [*keys, "node_id"]).join(offers, [*keys, "node_id"], "left").select(*keys, "node_id", "via", "reward", F.coalesce("choices", F.lit(0)).alias("choices"))


def with_offers(found: DataFrame, edges: DataFrame) -> DataFrame:
    """`examples` with `offers`, the sorted array of the addresses that the node's page links to: one value holds the links of
    one page."""
    offers = choices(edges).groupBy("node_id").agg(F.sort_array(F.collect_list("url")).alias("offers"))
    return found.join(offers, "node_id", "left").withColumn("offers", F.coalesce("offers", F.array().cast("array<string>")))


def merged(graphs: dict[str, tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of several graphs with a `graph` column, so that equal ids don't meet; for `examples(..., graph="graph")`."""
    nodes = edges = None
    for name, (n, e) in graphs.items():
        n, e = n.withColumn("graph", F.lit(name)), e.withColumn("graph", F.lit(name))
        nodes = n if nodes is None else nodes.unionByName(n)
        edges = e if edges is None else edges.unionByName(e)
    return nodes, edges


def positive_domains(nodes: DataFrame, domain, cut: float = 0.5) -> DataFrame:
    """(domain, n): where rewards above the cut come from."""
    return nodes.where(F.col("reward") > cut).groupBy(domain.alias("domain")).agg(F.count("*").alias("n"))
