"""Queries through sources and sinks (written to the shared folder and read back), feature blocks and frozen scoring."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from crawlweave.functions import numeric as N
from crawlweave.functions import text as T
from crawlweave.functions import urls as U
from crawlweave.functions.common import scratch_path, table
from crawlweave.operators import evaluation as E
from crawlweave.operators import extraction as EX
from crawlweave.operators import features as X
from crawlweave.operators import frontier as FR
from crawlweave.operators import graph as GR
from crawlweave.operators import hashing as H
from crawlweave.plans import spiders as P
from crawlweave.plans.catalogue import canonical, query, registered, site
from crawlweave.sources import tables as S


@query("SELECT CASE WHEN contains(u, '://') THEN u ELSE 'http://' || u END AS url FROM (SELECT CASE WHEN node_id % 2 = 0 THEN url ELSE regexp_replace(url, '^[a-zA-Z]+://', '') END AS u FROM nodes WHERE url IS NOT NULL AND trim(url) <> '')")
def seed_file(spark, d):
    """A seed list as a text file: header, blank lines, addresses with and without a scheme."""
    path = scratch_path(spark, "seeds")
    nodes = table(spark, d, "nodes").where("url is not null and trim(url) <> ''")
    lines = nodes.select(F.when(F.col("node_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^[a-zA-Z]+://", "")).alias("value"))
    lines.unionByName(spark.createDataFrame([("url",), ("",), ("  ",)], "value string")).write.text(path)
    return S.seeds(spark, path)


@query("SELECT url, 50000 AS priority, (row_number() OVER (ORDER BY md5('7:' || url), url))::BIGINT AS place FROM (SELECT DISTINCT n_name AS url FROM nation)")
def seeds_shuffled(spark, d):
    """Seeds in seeded order (a small table; the place shows the order)."""
    got = S.shuffled_seeds(table(spark, d, "nation").select(F.col("n_name").alias("url")).distinct(), "7")
    return S.numbered(got.withColumn("k", F.md5(F.concat(F.lit("7:"), F.col("url")))), "k", "place").select("url", "priority", "place")


@query("SELECT node_id, url, ok, reward FROM nodes")
def json_lines_round_trip(spark, d):
    """Rows as gzipped JSON lines and back, with broken lines between them."""
    path = scratch_path(spark, "jl")
    S.write_json_lines(table(spark, d, "nodes").select("node_id", "url", "ok", "reward"), path)
    spark.createDataFrame([('{"node_id": 1, "url": ',), ("no json",)], "value string").write.mode("append").text(path)
    return S.json_lines(spark, path, "node_id long, url string, ok boolean, reward double").where("node_id is not null")


@query("SELECT event_id FROM events WHERE event_id < (SELECT coalesce(min(event_id), 4611686018427387904) FROM events WHERE event_id % 1009 = 1008)")
def repaired_log(spark, d):
    """The lines of a log before the first broken one."""
    lines = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 1009 == 1008, F.lit("{broken")).otherwise(F.to_json(F.struct("event_id"))).alias("value"))
    return S.repaired(lines, "event_id").select("event_id")


@query("SELECT node_id, url FROM nodes ORDER BY node_id LIMIT 100 OFFSET 50")
def sliced_rows(spark, d):
    """Rows 50 to 149 in arrival order (offset and limit are the feature)."""
    return S.sliced(table(spark, d, "nodes").select("node_id", "url"), ["node_id"], 50, 100)


@query("SELECT item_id FROM cdr_items ORDER BY item_id LIMIT 99")
def first_pages(spark, d):
    """Pages before the response limit (the limit is the feature)."""
    return S.first_pages(table(spark, d, "cdr_items").select("item_id"), "item_id", 100)


@query(f"SELECT priority::VARCHAR AS priority, {registered('url')} AS slot, url FROM nodes WHERE url IS NOT NULL AND node_id % 3 <> 0")
def queue_file(spark, d):
    """The live entries of the queues as a gzipped file with a header, read back."""
    path = scratch_path(spark, "queue")
    nodes = table(spark, d, "nodes").where("url is not null")
    S.write_queue(nodes.select(U.registered_domain(F.col("url")).alias("slot"), "priority", "url", (F.col("node_id") % 3 == 0).alias("removed")), path)
    got = spark.read.option("header", "true").csv(path)
    return got.select("priority", F.coalesce("slot", F.lit("")).alias("slot"), "url")


@query("SELECT n_name AS feature, n_nationkey / 10.0::DOUBLE AS w, 2000::BIGINT AS t FROM nation")
def model_checkpoint(spark, d):
    """Weights saved at a step that is due, and loaded; steps that aren't due and step 0 save nothing."""
    path = scratch_path(spark, "models")
    w = table(spark, d, "nation").select(F.col("n_name").alias("feature"), (F.col("n_nationkey") / 10.0).alias("w"))
    assert not S.save_model(w, {}, path, 0) and not S.save_model(w, {}, path, 1500)
    S.save_model(w, {"gamma": 0.4}, path, 2000)
    got, meta = S.load_model(spark, path, "2000")
    return got.withColumn("t", F.lit(meta["t"]).cast("long"))


@query("SELECT node_id AS id, 'node' AS kind FROM nodes UNION ALL SELECT src, 'edge' FROM edges")
def graph_files(spark, d):
    """A crawl graph saved and read back."""
    path = scratch_path(spark, "graph")
    S.save_graph(table(spark, d, "nodes"), table(spark, d, "edges"), path)
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    return nodes.select(F.col("node_id").alias("id"), F.lit("node").alias("kind")).unionByName(edges.select(F.col("src").alias("id"), F.lit("edge").alias("kind")))


@query("SELECT 'run' || k AS run, k::INT AS input_size, '0.' || k AS epsilon, count(*)::BIGINT AS n, round(sum(coalesce(reward, 0.0)), 6) AS reward FROM nodes, range(3) r(k) WHERE node_id % 3 = k GROUP BY 1, 2, 3")
def experiment_folders(spark, d):
    """Logs and parameters of several runs, found by their folders; a run without parameters drops out."""
    root = scratch_path(spark, "runs")
    nodes = table(spark, d, "nodes").select("node_id", F.coalesce("reward", F.lit(0.0)).alias("reward"))
    for k in range(4):
        rows = nodes.where(F.col("node_id") % 3 == k % 3)
        rows.coalesce(1).write.mode("overwrite").json(f"{root}/tmp{k}")
        _move_one(spark, f"{root}/tmp{k}", f"{root}/run{k}/stats.jl")
        if k < 3:
            S.write_params(spark, {"epsilon": f"0.{k}"}, f"{root}/tmp{k}")
            _move_one(spark, f"{root}/tmp{k}", f"{root}/run{k}/params.json")
    got = S.experiments(spark, root, "node_id long, reward double")
    return got.groupBy("run", "input_size", F.col("params")["epsilon"].alias("epsilon")).agg(F.count("*").alias("n"), F.round(F.sum("reward"), 6).alias("reward"))


def _move_one(spark, folder: str, to: str) -> None:
    """The one part file of a small written folder, under a name of its own."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    src = path(folder)
    fs = src.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(f.getPath() for f in fs.listStatus(src) if f.getPath().getName().startswith("part-"))
    fs.mkdirs(path(to).getParent())
    fs.rename(part, path(to))
    fs.delete(src, True)


@query("SELECT kind, count(*)::BIGINT AS n FROM (SELECT 'item' AS kind FROM cdr_items UNION ALL SELECT 'request' FROM links WHERE url IS NOT NULL) GROUP BY 1")
def items_and_requests(spark, d):
    """Items and requests side by side, without statistics rows."""
    out = S.items_only(table(spark, d, "cdr_items").select("item_id", "url"), table(spark, d, "links").where("url is not null").select("link_id", "url"))
    return out.groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT url, raw_content FROM cdr_items")
def exported_documents(spark, d):
    """Crawled documents as they are exported."""
    path = scratch_path(spark, "export")
    S.write_outputs(table(spark, d, "cdr_items").select("item_id", "url", "raw_content"), path, True)
    return S.json_lines(spark, path, "url string, raw_content string")


@query(f"SELECT item_id, coalesce({site('domain')}, {registered('url')}) AS domain FROM cdr_items")
def response_domains(spark, d):
    """The domain a page was asked for, else its address's."""
    from crawlweave.functions.common import site_key

    return table(spark, d, "cdr_items").select("item_id", U.response_domain(site_key(F.col("domain")), F.col("url")).alias("domain"))


@query("SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'http://base.test/' || item_id || '/' ELSE url END AS base FROM cdr_items WHERE raw_content IS NOT NULL")
def base_urls(spark, d):
    """`<base href>`, put into every fifth page's head, against the page's own address."""
    head = F.when(F.col("item_id") % 5 == 0, F.concat(F.lit("<BASE target='x' HREF = 'http://base.test/"), F.col("item_id"), F.lit("/'>"))).otherwise("")
    pages = table(spark, d, "cdr_items").where("raw_content is not null")
    return pages.select("item_id", U.base_url(F.concat(head, F.col("raw_content")), F.col("url")).alias("base"))


@query("SELECT node_id, CASE WHEN node_id % 2 = 0 THEN 'http://a.test/x/' || node_id || '/p' ELSE 'http://a.test/q?n=' || node_id END AS url FROM nodes")
def relative_links(spark, d):
    """Dot segments and relative paths against a page's address."""
    base = F.concat(F.lit("http://a.test/x/y/"), F.col("node_id"), F.lit("/z.html"))
    href = F.when(F.col("node_id") % 2 == 0, F.concat(F.lit("../../"), F.col("node_id"), F.lit("/./o/../p"))).otherwise(F.concat(F.lit("/b/../q?n="), F.col("node_id")))
    return table(spark, d, "nodes").select("node_id", U.resolve(base, href).alias("url"))


@query(
    f"""WITH l AS (SELECT page_url, url, attrs, inside_text FROM links WHERE url IS NOT NULL AND {registered('url')} = {registered('page_url')})
    SELECT {registered('url')} AS domain, count(*) > 0 AS linked FROM l WHERE {registered('url')} <> '' GROUP BY 1"""
)
def onsite_domains(spark, d):
    """Domains whose links stay on the site, from the link dicts."""
    l = table(spark, d, "links").where("url is not null").select(U.registered_domain(F.col("url")).alias("domain"), U.registered_domain(F.col("page_url")).alias("own")).where("domain = own and domain <> ''")
    return l.groupBy("domain").agg((F.count("*") > 0).alias("linked"))


@query("SELECT node_id, (row_number() OVER (ORDER BY md5('s:' || node_id), node_id))::BIGINT AS place FROM nodes WHERE visited")
def shuffled_batch(spark, d):
    """A batch in seeded order."""
    got = FR.shuffled(table(spark, d, "nodes").where("visited").select("node_id"), "s", "node_id")
    return S.numbered(got.withColumn("k", F.concat(F.md5(F.concat(F.lit("s:"), F.col("node_id"))))), "k", "place").select("node_id", "place")


def _grams(text: str, lo: int, hi: int) -> str:
    parts = " || ".join(f"list_transform(range(1, greatest(length({text}) - {k - 2}, 1)), lambda i: substr({text}, i, {k}))" for k in range(lo, hi + 1))
    return f"list_distinct({parts})"


@query(f"WITH t AS (SELECT node_id, coalesce({canonical('url')}, '') AS t FROM nodes), g AS (SELECT node_id, {_grams('t', 4, 5)} AS g FROM t) SELECT node_id, len(g)::BIGINT AS features, round(1 / sqrt(len(g)), 6) AS value FROM g WHERE len(g) > 0")
def url_ngrams(spark, d):
    """Character 4- and 5-grams of whole addresses."""
    f = X.url_features(table(spark, d, "nodes").select("node_id", "url"), "node_id", full=True)
    return f.groupBy("node_id").agg(F.count("*").alias("features"), F.round(F.max("value"), 6).alias("value"))


_TXT = "coalesce(trim(regexp_replace(lower(concat_ws(' ', inside_text, attrs['title'])), '\\s+', ' ', 'g')), '')"
_SAME = "CASE WHEN lower(trim(domain_from)) = lower(trim(domain_to)) THEN 1.0 ELSE 0.0 END"
_BUCKET = "('0x' || substr(md5('text:' || x), 1, 5))::INT"
_SAME_BUCKET = "('0x' || substr(md5('same_domain:'), 1, 5))::INT"


def _w(b: str) -> str:
    return f"(({b} % 1001) - 500) / 1000.0"


@query(
    f"""WITH t AS (SELECT link_id, {_TXT} AS t, {_SAME} AS same FROM links), g AS (SELECT link_id, {_grams('t', 3, 5)} AS g FROM t), u AS (SELECT link_id, len(g) AS n, unnest(g) AS x FROM g),
    s AS (SELECT link_id, sum({_w(_BUCKET)} / sqrt(n)) AS q FROM u GROUP BY 1)
    SELECT link_id, round(0.25 + coalesce(q, 0.0) + same * {_w(_SAME_BUCKET)}, 6)::DOUBLE AS q FROM t LEFT JOIN s USING (link_id)"""
)
def hashed_scores(spark, d):
    """Scores of all links from hashed features and a broadcast weight array: one pass, no shuffle."""
    import numpy as np

    w = ((np.arange(H.BUCKETS) % 1001) - 500) / 1000.0
    return H.scores(table(spark, d, "links"), "link_id", w, 0.25).select("link_id", F.round("q", 6).alias("q"))


@query(f"WITH t AS (SELECT link_id, {_TXT} AS t FROM links), g AS (SELECT link_id, unnest({_grams('t', 3, 5)}) AS x FROM t) SELECT {_BUCKET} AS bucket, count(DISTINCT link_id)::BIGINT AS links FROM g GROUP BY 1")
def hashed_buckets(spark, d):
    """Links per bucket of the hashed text features."""
    v = H.vectors(table(spark, d, "links"), "link_id", H.Hashed(use_same_domain=False))
    return v.select("link_id", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("links"))


@query(
    """WITH a AS (SELECT item_id, unnest(regexp_extract_all(raw_content, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) AS h FROM cdr_items WHERE raw_content IS NOT NULL)
    SELECT item_id AS page_id, count(*)::BIGINT AS links, 0.05::DOUBLE AS score FROM a WHERE NOT contains(h, 'mailto:') AND (NOT regexp_matches(h, '^(tel|skype|fb|javascript):') OR regexp_matches(h, 'location\\.href='))
    AND NOT regexp_matches(regexp_replace(split_part(split_part(h, '#', 1), '?', 1), '^[A-Za-z]+://[^/]*', ''), '(?i)\\.(pdf|zip|jpg|png|gif|css|doc|xls|exe|mp3|mp4|gz|rar|jpeg|svg|ico|tar|7z|apk|iso|rss|docx|xlsx|ppt|pptx|odt|webp|bmp|avi|mov|wmv|flv|swf|ogg|wav|dmg|bin|ps|eps|ai|tif|tiff)$') GROUP BY 1"""
)
def frozen_scores(spark, d):
    """Every link of every page scored with a model that is not fit yet: document order, repeats kept."""
    pages = table(spark, d, "cdr_items").select(F.col("item_id").alias("page_id"), "url", F.col("raw_content").alias("html"))
    none = spark.createDataFrame([], "feature string, w double")
    out = P.extract_urls(pages, none, None)
    return out.groupBy("page_id").agg(F.count("*").alias("links"), F.max("score").alias("score"))


@query("SELECT n_nationkey AS k, trunc(n_nationkey * 60000 / 30000.0 / (0.33 / 0.67) / 0.1)::INT AS responses FROM nation")
def reschedule_intervals(spark, d):
    """Responses between two re-scorings of queues of several sizes."""
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), N.reschedule_interval(F.col("n_nationkey") * 60000).alias("responses"))


@query("SELECT item_id, lower(trim(domain)) AS domain FROM cdr_items WHERE nullif(trim(domain), '') IS NOT NULL")
def plugin_domains(spark, d):
    """A column function found by name."""
    key = S.plugin("crawlweave.functions.common:site_key")
    return table(spark, d, "cdr_items").select("item_id", key(F.col("domain")).alias("domain")).where("domain is not null")


@query("SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: w NOT IN ('the', 'of', 'and', 'a', 'der', 'die', 'und', 'le', 'la', 'et', 'el', 'y', 'и', 'в')))::BIGINT AS words FROM documents WHERE text IS NOT NULL")
def content_words(spark, d):
    """Words without a few stop words, all of which are in the list of all languages."""
    few = ["the", "of", "and", "a", "der", "die", "und", "le", "la", "et", "el", "y", "и", "в"]
    assert set(few) <= set(X.stop_words())
    words = T.tokens(F.lower("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(F.filter(words, lambda w: ~w.isin(few))).cast("long").alias("words"))


@query("SELECT n.node_id, e.src AS via, n.reward, coalesce(c.u, []) AS offers FROM nodes n JOIN edges e ON e.dst = n.node_id LEFT JOIN (SELECT src, list_sort(list_distinct(list(link.url) FILTER (link.url IS NOT NULL))) AS u FROM edges GROUP BY 1) c ON c.src = n.node_id WHERE n.visited AND n.ok")
def graph_offers(spark, d):
    """Training examples from the graph with the addresses each node offers."""
    edges = table(spark, d, "edges")
    return GR.with_offers(GR.examples(table(spark, d, "nodes"), edges), edges).select("node_id", "via", "reward", "offers")


@query("SELECT g.graph, n.node_id, e.src AS via, coalesce(c.k, 0)::BIGINT AS choices FROM (VALUES ('a', 0), ('b', 1)) g(graph, odd), nodes n, edges e LEFT JOIN (SELECT graph, src, count(DISTINCT link.url) AS k FROM edges, (VALUES ('a', 0), ('b', 1)) h(graph, odd) WHERE src % 2 = odd GROUP BY 1, 2) c ON c.src = e.dst AND c.graph = CASE WHEN e.src % 2 = 0 THEN 'a' ELSE 'b' END WHERE e.dst = n.node_id AND e.src % 2 = g.odd AND n.visited AND n.ok")
def graphs_examples(spark, d):
    """Examples of two graphs together: the links of even and of odd nodes."""
    nodes, edges = table(spark, d, "nodes"), table(spark, d, "edges")
    n, e = GR.merged({"a": (nodes, edges.where("src % 2 = 0")), "b": (nodes, edges.where("src % 2 = 1"))})
    return GR.examples(n, e, "graph").select("graph", "node_id", "via", "choices")


@query("SELECT form_id, ('0x' || substr(md5('split:' || page_id), 1, 13))::BIGINT / 4503599627370496.0 < 0.2 AS test FROM forms")
def train_test_split(spark, d):
    """Forms of a fifth of the pages are held out."""
    train, test = E.split(table(spark, d, "forms"), F.col("page_id"), 0.2, "split")
    return train.select("form_id", F.lit(False).alias("test")).unionByName(test.select("form_id", F.lit(True).alias("test")))


def _titles(html: str, url: str):
    """The headings of a page as items; every seventh page breaks the extractor."""
    if url and len(url) % 7 == 0:
        raise ValueError(url)
    for m in re.finditer(r"(?is)<title>([^<]*)</title>", html):
        yield {"title": m[1], "other": 1}


@query("WITH t AS (SELECT item_id AS page_id, unnest(regexp_extract_all(raw_content, '(?is)<title>([^<]*)</title>', 1)) AS title FROM cdr_items WHERE raw_content IS NOT NULL AND (url IS NULL OR length(url) % 7 <> 0)) SELECT page_id, title FROM t WHERE title <> ''")
def extracted_items(spark, d):
    """A Python extractor over all pages, with a callback that drops empty items."""
    pages = table(spark, d, "cdr_items").select(F.col("item_id").alias("page_id"), "url", F.col("raw_content").alias("html"))
    return EX.items(pages, _titles, "title string", on_item=lambda df: df.where("title <> ''")).select("page_id", "title")


_ENT = [("&copy;", "©"), ("&raquo;", "»"), ("&laquo;", "«"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def _page_text(x: str) -> str:
    out = f"regexp_replace(regexp_replace({x}, '(?is)<(script|style|noscript)\\b[^>]*>.*?</(script|style|noscript)\\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"
    for a, b in _ENT:
        out = f"replace({out}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace(lower({out}), '[\\s\\x{{a0}}]+', ' ', 'g'))"


@query(f"SELECT item_id, {_page_text('raw_content')} AS text FROM cdr_items WHERE raw_content IS NOT NULL")
def page_texts(spark, d):
    """Visible text of every page for text features."""
    return table(spark, d, "cdr_items").where("raw_content is not null").select("item_id", T.html_text(F.col("raw_content")).alias("text"))
