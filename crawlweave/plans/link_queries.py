"""Queries on pages, links and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlweave.functions import numeric as N
from crawlweave.functions import text as T
from crawlweave.functions import urls as U
from crawlweave.functions.common import site_key, table
from crawlweave.operators import features as X
from crawlweave.operators import links as L
from crawlweave.operators import skew as K
from crawlweave.plans.catalogue import canonical, host, query, registered, site
from crawlweave.sources import tables as S

IGNORED = ", ".join(f"'{e}'" for e in U.IGNORED_EXTENSIONS)
PATHQ = "regexp_replace(split_part(url, '#', 1), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', '')"


@query(
    """WITH a AS (SELECT item_id, url AS page_url, unnest(regexp_extract_all(raw_content, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) AS href FROM cdr_items WHERE raw_content IS NOT NULL)
    SELECT item_id, href, count(*)::BIGINT AS n FROM a GROUP BY 1, 2"""
)
def page_hrefs(spark, d):
    """Anchors of every page by the cheap path."""
    return L.hrefs(table(spark, d, "cdr_items"), "item_id", "url", "raw_content").groupBy("item_id", "href").agg(F.count("*").alias("n"))


@query(
    f"""WITH a AS (SELECT item_id, url AS page_url, unnest(regexp_extract_all(raw_content, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) AS h FROM cdr_items WHERE raw_content IS NOT NULL),
    b AS (SELECT item_id, page_url, replace(h, '&amp;', '&') AS h FROM a WHERE NOT contains(h, 'mailto:')),
    c AS (SELECT item_id, page_url, regexp_extract(h, '(javascript:)?location\\.href=[''"](.+)[''"]', 2) AS js, h FROM b),
    e AS (SELECT item_id, page_url, CASE WHEN js <> '' THEN js ELSE h END AS h, js <> '' AS js FROM c),
    f AS (SELECT item_id, js, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h ELSE regexp_extract(page_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', 0) || h END AS url FROM e WHERE NOT regexp_matches(h, '^(tel|skype|fb|javascript):')),
    g AS (SELECT *, lower(regexp_extract(split_part({PATHQ}, '?', 1), '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM f)
    SELECT item_id, url, count(*)::BIGINT AS n, count_if(js)::BIGINT AS js FROM g WHERE ext NOT IN ({IGNORED}) GROUP BY 1, 2"""
)
def link_extract(spark, d):
    """All links of all pages: extracted, resolved and filtered."""
    out = L.usable(L.extract(table(spark, d, "cdr_items"), "item_id", "url", "raw_content"))
    return out.groupBy(F.col("page_id").alias("item_id"), "url").agg(F.count("*").alias("n"), F.count_if(F.coalesce("js", F.lit(False))).alias("js"))


@query(f"SELECT link_id, url FROM (SELECT link_id, url, row_number() OVER (PARTITION BY page_url, {canonical('url')} ORDER BY pos, link_id) AS rn FROM links WHERE url IS NOT NULL) WHERE rn = 1")
def link_dedup_local(spark, d):
    """The first link of every address on its page."""
    links = table(spark, d, "links").withColumn("order", F.struct("pos", "link_id"))
    return L.first_on_page(links, U.canonical(F.col("url")), "page_url", "order").select("link_id", "url")


@query(f"SELECT min(link_id) AS link_id FROM links WHERE url IS NOT NULL GROUP BY {canonical('url')}")
def link_dedup_global(spark, d):
    """The first link of every address in the crawl."""
    return L.first_in_crawl(table(spark, d, "links").select("link_id", "url"), U.canonical(F.col("url")), "link_id").select("link_id")


@query(f"SELECT link_id FROM links WHERE url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes WHERE {canonical('nodes.url')} = {canonical('links.url')})")
def links_unseen(spark, d):
    """Links to addresses that are no node of the graph yet."""
    nodes = table(spark, d, "nodes").select(U.canonical(F.col("url")).alias("c"))
    links = table(spark, d, "links").where("url is not null").select("link_id", "url")
    return L.unseen(links, U.canonical(F.col("url")), nodes, "c").select("link_id")


@query(f"SELECT {site('domain_from')} AS domain, count(*)::BIGINT AS links, count(DISTINCT page_url)::BIGINT AS pages FROM links WHERE {site('domain_from')} = {site('domain_to')} GROUP BY 1")
def links_same_domain(spark, d):
    """On-site links per domain."""
    l = table(spark, d, "links").select(site_key(F.col("domain_from")).alias("domain"), site_key(F.col("domain_to")).alias("to"), "page_url").where("domain = to")
    return l.groupBy("domain").agg(F.count("*").alias("links"), F.count_distinct("page_url").alias("pages"))


@query(f"SELECT {site('domain_from')} AS domain, count(*)::BIGINT AS offsite FROM links WHERE {site('domain_from')} <> {site('domain_to')} GROUP BY 1")
def offsite_rejected(spark, d):
    """Links that leave their site, which still count toward the response limit."""
    l = table(spark, d, "links").select(site_key(F.col("domain_from")).alias("domain"), site_key(F.col("domain_to")).alias("to")).where("domain <> to")
    return l.groupBy("domain").agg(F.count("*").alias("offsite"))


@query(f"SELECT {registered('url')} AS domain, count(*)::BIGINT AS n FROM links WHERE url IS NOT NULL GROUP BY 1")
def registered_domains(spark, d):
    """Links per registered domain of their target."""
    return table(spark, d, "links").where("url is not null").groupBy(U.registered_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


@query(f"SELECT link_id, {canonical('url')} AS canonical FROM links")
def url_canonical(spark, d):
    return table(spark, d, "links").select("link_id", U.canonical(F.col("url")).alias("canonical"))


@query(f"SELECT link_id, lower(url_decode(replace(split_part({PATHQ}, '?', 1) || '?' || substr({PATHQ}, length(split_part({PATHQ}, '?', 1)) + 2), '+', ' '))) AS path_query FROM links")
def url_path_query(spark, d):
    return table(spark, d, "links").select("link_id", U.path_query(F.col("url")).alias("path_query"))


@query(f"SELECT ext IN ({IGNORED}) AS ignored, count(*)::BIGINT AS n FROM (SELECT lower(regexp_extract(split_part({PATHQ}, '?', 1), '\\.([A-Za-z0-9]+)$', 1)) AS ext FROM links WHERE url IS NOT NULL) GROUP BY 1")
def ignored_extension_counts(spark, d):
    return table(spark, d, "links").where("url is not null").groupBy(U.ignored_extension(F.col("url")).alias("ignored")).agg(F.count("*").alias("n"))


@query("SELECT link_id, CASE WHEN regexp_matches(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', ''), '(regi|join|create|sign|account|user|login|recover|password)') THEN 1 ELSE 0 END AS priority FROM links")
def priority_heuristic(spark, d):
    """Baseline priority by promising words."""
    return table(spark, d, "links").select("link_id", U.promising(F.col("url")).alias("priority"))


@query("SELECT link_id, (-floor(pos / 5))::INT AS priority FROM links")
def decreasing_priority(spark, d):
    """Priorities that fall by one every five links of a page; the position is a column, so no window is needed."""
    return table(spark, d, "links").select("link_id", N.decreasing_priority(F.col("pos")).alias("priority"))


@query("SELECT item_id, url FROM cdr_items WHERE raw_content IS NOT NULL AND raw_content <> ''")
def liveness(spark, d):
    """Addresses that gave text."""
    t = table(spark, d, "cdr_items")
    return t.select("item_id", "url", "raw_content").where(F.col("raw_content").isNotNull() & (F.col("raw_content") != "")).select("item_id", "url")


@query("SELECT url, count(*)::BIGINT AS n, max(priority) AS priority FROM (SELECT DISTINCT split_part(url, '?', 1) AS url, 50000 AS priority FROM nodes WHERE url IS NOT NULL) GROUP BY 1")
def seed_table(spark, d):
    """A seed list with its fixed priority."""
    urls = table(spark, d, "nodes").where("url is not null").select(F.substring_index("url", "?", 1).alias("url")).distinct()
    return urls.withColumn("priority", F.lit(S.SEED_PRIORITY)).groupBy("url").agg(F.count("*").alias("n"), F.max("priority").alias("priority"))


@query("SELECT n_name AS url, 'run-' || k AS run_id FROM nation, range(3) AS r(k)")
def seeds_replicated(spark, d):
    """Every seed once per run."""
    return S.replicated(table(spark, d, "nation").select(F.col("n_name").alias("url")), 3)


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))::BIGINT AS tokens FROM documents WHERE text IS NOT NULL")
def token_counts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(T.tokens(F.lower("text"))).cast("long").alias("tokens"))


POSITIVE, NEGATIVE = ["password", "login", "the account", "session", "login"], ["cookie", "in both versions"]
_G = "w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i+1]) || list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2])"


@query(
    f"""WITH t AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents),
    g AS (SELECT doc_id, text, {_G} AS g FROM t),
    h AS (SELECT doc_id, text, len(list_filter({POSITIVE}, lambda k: list_contains(g, k))) AS p, len(list_filter({NEGATIVE}, lambda k: list_contains(g, k))) AS n FROM g)
    SELECT doc_id, CASE WHEN text IS NULL THEN 0.0 ELSE round(greatest(0.0, ln(p + 1) / ln({len(POSITIVE)} / 2.0 + 2) - 0.33 * ln(n + 1) / ln({len(NEGATIVE)} / 2.0 + 2)), 6) END::DOUBLE AS relevancy FROM h"""
)
def keyword_relevancy(spark, d):
    """Keyword score of every document."""
    return table(spark, d, "documents").select("doc_id", F.round(T.relevancy(F.col("text"), POSITIVE, NEGATIVE), 6).alias("relevancy"))


@query(
    """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
    g AS (SELECT doc_id, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i+1])) AS gram FROM t)
    SELECT doc_id, count(*)::BIGINT AS grams, count(DISTINCT gram)::BIGINT AS different FROM g GROUP BY 1"""
)
def token_ngrams(spark, d):
    """Word uni- and bigrams of every document."""
    g = table(spark, d, "documents").where("text is not null").select("doc_id", T.ngrams(T.tokens(F.lower("text")), 2).alias("g")).where("size(g) > 0")
    return g.select("doc_id", F.size("g").cast("long").alias("grams"), F.size(F.array_distinct("g")).cast("long").alias("different"))


_TXT = "trim(regexp_replace(lower(concat_ws(' ', inside_text, attrs['title'])), '\\s+', ' ', 'g'))"


@query(
    f"""WITH t AS (SELECT link_id, coalesce({_TXT}, '') AS t FROM links),
    g AS (SELECT link_id, list_distinct(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substr(t, i, 3)) || list_transform(range(1, greatest(length(t) - 2, 1)), lambda i: substr(t, i, 4)) || list_transform(range(1, greatest(length(t) - 3, 1)), lambda i: substr(t, i, 5))) AS g FROM t)
    SELECT link_id, len(g)::BIGINT AS features, round(1 / sqrt(len(g)), 6) AS value FROM g WHERE len(g) > 0"""
)
def link_text_ngrams(spark, d):
    """Character 3- to 5-grams of link texts, every row of length 1."""
    f = X.link_text_features(table(spark, d, "links"), "link_id")
    return f.groupBy("link_id").agg(F.count("*").alias("features"), F.round(F.max("value"), 6).alias("value"))


@query("SELECT link_id, CASE WHEN lower(trim(domain_from)) = lower(trim(domain_to)) THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM links")
def same_domain_feature(spark, d):
    return X.same_domain_feature(table(spark, d, "links"), "link_id").select("link_id", "value")


@query(
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, w, count(*)::DOUBLE AS c FROM t GROUP BY 1, 2), n AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM c GROUP BY 1)
    SELECT doc_id, w AS feature, round(c / n, 6) AS value FROM c JOIN n USING (doc_id)"""
)
def page_bow_l2(spark, d):
    """Word counts of every document, every row of length 1."""
    docs = table(spark, d, "documents").where("text is not null")
    return X.bag_of_words(docs, "doc_id", F.col("text")).select("doc_id", "feature", F.round("value", 6).alias("value"))


_U = {"host": host("url")}
_W = "round(('0x' || substr(md5('w:' || gram), 1, 13))::BIGINT / 4503599627370496.0 - 0.5, 9)"


@query(
    f"""WITH t AS (SELECT link_id, {site('domain_from')} AS domain, coalesce({_TXT}, '') AS t FROM links WHERE {site('domain_from')} IS NOT NULL),
    g AS (SELECT link_id, domain, list_distinct(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substr(t, i, 3))) AS g FROM t),
    e AS (SELECT link_id, domain, len(g) AS n, unnest(g) AS gram FROM g),
    s AS (SELECT link_id, domain, round(sum({_W} / sqrt(n)), 6) AS q FROM e GROUP BY 1, 2),
    a AS (SELECT g.link_id, g.domain, coalesce(s.q, 0.0) AS q FROM g LEFT JOIN s USING (link_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY q DESC, link_id) AS rank FROM a)
    SELECT domain, link_id, q, trunc(q * 10000)::INT AS priority, rank::BIGINT AS rank FROM r WHERE rank <= 5"""
)
def scored_links_topk(spark, d):
    """The flagship: score every link by its text with a linear model and give the five best of each site.

    The weights are hashed uniforms of the features, so that any engine has the same model.
    """
    from pyspark.sql import Window

    from crawlweave.functions.rand import uniform

    text = F.coalesce(T.link_text(F.col("inside_text"), F.col("attrs")), F.lit(""))
    links = table(spark, d, "links").select("link_id", site_key(F.col("domain_from")).alias("domain"), text.alias("text")).where("domain is not null")
    # Anchor texts repeat (menus): each text is cut and scored once, then joined back.
    texts = links.select("text").distinct()
    f = X.char_features(texts, "text", F.col("text"), "text", 3, 3)
    # A hashed weight is a function of the feature: no weight table has to be joined.
    f = f.withColumn("value", F.col("value") * F.round(uniform("w", F.substr("feature", F.lit(6))) - 0.5, 9)).groupBy("text").agg(F.round(F.sum("value"), 6).alias("q"))
    q = links.join(f, "text", "left").select("link_id", "domain", F.coalesce("q", F.lit(0.0)).alias("q"))
    w = Window.partitionBy("domain").orderBy(F.desc("q"), "link_id")
    top = q.withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    return top.select("domain", "link_id", "q", N.score_to_priority(F.col("q")).alias("priority"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT link_id FROM links WHERE url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes WHERE visited AND nodes.url IS NOT NULL AND {canonical('nodes.url')} = {canonical('links.url')})")
def new_requests(spark, d):
    """Links as requests that were not made before, by request fingerprint."""
    done = table(spark, d, "nodes").where("visited and url is not null").select(L.fingerprint(F.lit("GET"), F.col("url")).alias("fingerprint"))
    r = table(spark, d, "links").where("url is not null").select("link_id", L.fingerprint(F.lit("GET"), F.col("url")).alias("fingerprint"), F.lit(False).alias("dont_filter"))
    return L.new_requests(r, done).select("link_id")


_RUN = "CASE WHEN js THEN 'run-1' ELSE 'run-0' END"


@query(f"SELECT link_id FROM links WHERE url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes WHERE visited AND nodes.url IS NOT NULL AND {canonical('nodes.url')} = {canonical('links.url')} AND {_RUN} = 'run-0')")
def new_requests_by_run(spark, d):
    """The same with a history per run: only one run has one."""
    done = table(spark, d, "nodes").where("visited and url is not null").select(F.lit("run-0").alias("run_id"), L.fingerprint(F.lit("GET"), F.col("url")).alias("fingerprint"))
    r = table(spark, d, "links").where("url is not null").select("link_id", F.expr(_RUN).alias("run_id"), L.fingerprint(F.lit("GET"), F.col("url")).alias("fingerprint"), F.lit(False).alias("dont_filter"))
    return L.new_requests(r, done, "run_id").select("link_id")


@query(f"SELECT link_id, (3 + CASE WHEN {canonical('url')} IN (SELECT {canonical('url')} FROM nodes WHERE NOT visited AND url IS NOT NULL) THEN 0 ELSE 1 END)::INT AS depth FROM links WHERE url IS NOT NULL")
def pagination_depth(spark, d):
    """Depth of links when links to one kind of page keep it."""
    from crawlweave.plans.spiders import breadth_first

    l = table(spark, d, "links").where("url is not null").select("link_id", "url", F.lit(3).alias("depth"))
    return breadth_first(l, table(spark, d, "nodes").where("not visited and url is not null").select("url")).select("link_id", "depth")


@query(f"SELECT link_id, {registered('url')} AS slot, trunc(least(length(inside_text), 90) / 100.0 * 10000)::INT AS priority FROM links WHERE url IS NOT NULL")
def link_requests(spark, d):
    """Links as requests with slot and priority."""
    l = table(spark, d, "links").where("url is not null")
    score = F.least(F.length("inside_text"), F.lit(90)) / F.lit(100.0)
    return l.select("link_id", U.registered_domain(F.col("url")).alias("slot"), N.score_to_priority(score).alias("priority"))


@query("SELECT link_id, 2::BIGINT AS features, round(CASE WHEN lower(trim(domain_from)) = lower(trim(domain_to)) THEN 1.0 ELSE 0.0 END + n, 6)::DOUBLE AS total FROM links JOIN (SELECT page_url, count(*)::DOUBLE AS n FROM links GROUP BY 1) USING (page_url)")
def joined_page_features(spark, d):
    """State beside action: link features with those of their page."""
    l = table(spark, d, "links")
    pages = l.groupBy("page_url").agg(F.count("*").cast("double").alias("value")).withColumn("feature", F.lit("links"))
    f = X.join_page(X.same_domain_feature(l, "link_id"), l, pages, "link_id", "page_url")
    return f.groupBy("link_id").agg(F.count("*").alias("features"), F.round(F.sum("value"), 6).alias("total"))


@query(
    """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, w, count(*)::DOUBLE AS c FROM t GROUP BY 1, 2),
    p AS (SELECT doc_id, w, c * (('0x' || substr(md5('c:' || w), 1, 13))::BIGINT / 4503599627370496.0 - 0.5) AS part FROM c)
    SELECT doc_id, feature, part, rank::BIGINT AS rank FROM (SELECT doc_id, w AS feature, round(part, 6) AS part, row_number() OVER (PARTITION BY doc_id ORDER BY abs(part) DESC, w) AS rank FROM p) WHERE rank <= 3"""
)
def score_contributions(spark, d):
    """The three words that move every document's score the most."""
    from crawlweave.functions.rand import uniform
    from crawlweave.operators.qmodel import contributions

    docs = table(spark, d, "documents").where("text is not null")
    counts = docs.select("doc_id", F.explode(T.tokens(F.lower("text"))).alias("feature")).groupBy("doc_id", "feature").agg(F.count("*").cast("double").alias("value"))
    weights = counts.select("feature").distinct().withColumn("w", uniform("c", F.col("feature")) - 0.5)
    return contributions(counts, weights, "doc_id", 3).select("doc_id", "feature", F.round("part", 6).alias("part"), "rank")


@query(
    f"""WITH s AS (SELECT 'from' AS side, {site('domain_from')} AS domain FROM links UNION ALL SELECT 'to', {site('domain_to')} FROM links),
    c AS (SELECT side, domain, count(*) AS n FROM s WHERE domain IS NOT NULL GROUP BY 1, 2)
    SELECT side, domain FROM (SELECT *, sum(n) OVER (PARTITION BY side) AS total FROM c) WHERE n >= 0.0125 * total"""
)
def p7_found(spark, d):
    """Domains that hold at least 1.25 percent of a side's links."""
    return K.hot_keys(_sides_profile(spark, d, None), 0.0125).select("side", "domain")


def _sides(spark, d):
    ends = F.explode(F.array(F.struct(F.lit("from").alias("side"), site_key(F.col("domain_from")).alias("domain")), F.struct(F.lit("to").alias("side"), site_key(F.col("domain_to")).alias("domain")))).alias("e")
    return table(spark, d, "links").select("page_url", F.col("pos"), ends).select("page_url", "pos", "e.side", "e.domain").where("domain is not null")


def _sides_profile(spark, d, distinct):
    return K.key_profile(_sides(spark, d), ["side", "domain"], "pos", [0.5, 0.9], ["side"], distinct)


@query(
    f"""WITH s AS (SELECT 'from' AS side, {site('domain_from')} AS domain, page_url, pos FROM links UNION ALL SELECT 'to', {site('domain_to')}, page_url, pos FROM links)
    SELECT side, domain, count(*)::BIGINT AS n, count(DISTINCT page_url)::BIGINT AS page_urls, quantile_disc(pos, 0.5)::DOUBLE AS q1, quantile_disc(pos, 0.9)::DOUBLE AS q2,
    round(count(*) / sum(count(*)) OVER (PARTITION BY side), 9) AS share FROM s WHERE domain IS NOT NULL GROUP BY 1, 2"""
)
def p7_profile(spark, d):
    """Links, pages and exact quantiles of the link position per domain and side."""
    return _sides_profile(spark, d, "page_url").select("side", "domain", "n", "page_urls", "q1", "q2", F.round("share", 9).alias("share"))
