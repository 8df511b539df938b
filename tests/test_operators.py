import math

import pytest
from pyspark.sql import functions as F

from crawlweave.operators import crawllog as C
from crawlweave.operators import frontier as Q
from crawlweave.operators import goals as G
from crawlweave.operators import graph as H
from crawlweave.operators import links as L
from crawlweave.operators import metrics as M
from crawlweave.operators import qmodel as Z
from crawlweave.operators import skew as K
from crawlweave.plans import spiders as P
from crawlweave.sources import tables as S

QUEUE = "slot string, seq bigint, url string, priority int, is_seed boolean, removed boolean"


def queue(spark, rows):
    return spark.createDataFrame([("s", i, u, p, False, False) for i, (u, p) in enumerate(rows)], QUEUE)


def test_queue_order(spark):
    q = queue(spark, [("a", 1), ("b", 1), ("c", -1), ("d", 2), ("e", 0)])
    assert [r.url for r in Q.pop_order(q, 9).orderBy("place").collect()] == ["d", "a", "b", "e", "c"]
    assert [r.url for r in Q.pop_order(q, 9, lifo=True).orderBy("place").collect()] == ["d", "b", "a", "e", "c"]


def test_random_pop_returns_each_once(spark):
    q = queue(spark, [("a", 1), ("b", 2), ("c", 3)])
    assert sorted(r.url for r in Q.pop_random(q, "1", 5).collect()) == ["a", "b", "c"]
    gone = Q.remove(q, q)
    assert Q.pop_random(gone, "1", 5).count() == 0
    assert Q.queue_stats(gone).first().max_priority == -150_000_000


def test_empty_frontier(spark):
    q = queue(spark, [])
    assert Q.pop_order(q, 3).count() == 0 and Q.trim(q, 3).count() == 0 and Q.sample_slots(Q.queue_stats(q), 10, "s").count() == 0


def test_slot_sampling_follows_the_weights(spark):
    q = spark.createDataFrame([("a", 0, "u", 10_000, False, False), ("b", 1, "v", 0, False, False)], QUEUE)
    got = {r.slot: r.n for r in Q.sample_slots(Q.queue_stats(q), 4000, "s").groupBy("slot").agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == 4000 and got["a"] / 4000 == pytest.approx(math.e / (1 + math.e), abs=0.03)


def test_dcg(spark):
    df = lambda t, s: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, s))], "i int, t double, s double")
    for t, s, k in (([5, 3, 2], [2, 1, 0], 10), ([2, 3, 5], [0, 1, 2], 10), ([5, 3, 2], [2, 1, 0], 2)):
        assert M.ndcg(df(t, s), "t", "s", k, "i").first()[0] == pytest.approx(1.0)
    good, bad = (M.dcg(df([5, 3, 2], s), "t", "s", 10, "i").first()[0] for s in ([2, 1, 0], [0, 1, 2]))
    assert good > bad
    assert M.ndcg(df([0, 0], [1, 2]), "t", "s", 5, "i").first()[0] is None


def test_auc_and_curve(spark):
    df = spark.createDataFrame([(True, 0.9), (True, 0.5), (False, 0.5), (False, 0.1)], "t boolean, s double")
    assert M.roc_auc(df, F.col("t"), "s").first()[0] == pytest.approx(0.875)
    assert M.roc_auc(df.where("t"), F.col("t"), "s").first()[0] is None


def test_max_scores(spark):
    df = spark.createDataFrame([("foo", 0.2), ("foo", 0.1), ("bar", 0.5), ("bar", 0.6), ("low", -1.0)], "k string, v double")
    best = G.max_scores(df, "k", "v")
    assert {r.k: r.max_score for r in best.collect()} == {"foo": 0.2, "bar": 0.6, "low": 0.0}
    s = G.max_score_summary(best.where("k <> 'low'")).first()
    assert (s["keys"], s.total, s.average) == (2, pytest.approx(0.8), pytest.approx(0.4))


def test_merge_max(spark):
    df = spark.createDataFrame([(1, {"x": 1.0, "z": 2.0}), (1, {"x": 3.0, "y": 5.0, "z": 1.0}), (2, None), (3, {"x": float("nan")})], "p int, m map<string,double>")
    assert {r.p: r.scores for r in G.merge_max(df, "p", "m").collect()} == {1: {"x": 3.0, "y": 5.0, "z": 2.0}}


def test_link_pipeline(spark):
    html = """<base href="http://ex.com/d/"><a href="/page-good" title="t">decent <img alt="pic"></a><a href="mailto:a@b.c">m</a><a href="tel:1">t</a>
    <a href="javascript:location.href='/js'">j</a><a href="javascript:void(0)">v</a><a href="x.pdf">p</a><a>none</a><a href="http://other.org/#f">o</a><a href="/page-good#x">again</a>"""
    pages = spark.createDataFrame([(1, "http://ex.com/", html), (2, "http://ex.com/2", None), (3, "http://ex.com/3", "")], "page_id bigint, url string, html string")
    links = L.page_links(pages)
    got = [(r.url, r.js, r.inside_text, r.domain_to) for r in links.orderBy("pos").collect()]
    assert got == [
        ("http://ex.com/page-good", None, "decent pic", "ex.com"),
        ("http://ex.com/js", True, "j", "ex.com"),
        ("http://other.org/#f", None, "o", "other.org"),
        ("http://ex.com/page-good#x", None, "again", "ex.com"),
    ]
    from crawlweave.functions.urls import canonical

    assert L.first_on_page(links, canonical(F.col("url")), "page_id", "pos").count() == 3
    assert L.page_links(pages, same_domain=True).count() == 3


def test_td_targets(spark):
    exp = spark.createDataFrame([(1, 1.0), (2, 0.5)], "p int, reward double")
    sc = spark.createDataFrame([(1, 0, 0.9, 0.1), (1, 1, 0.9, 0.7), (1, 2, 0.2, 0.8)], "p int, pos int, o double, t double")
    d = {r.p: r.y for r in Z.td_targets(exp, sc, "p", "pos", "o", "t").collect()}
    v = {r.p: r.y for r in Z.td_targets(exp, sc, "p", "pos", "o", None).collect()}
    assert d == {1: pytest.approx(1.04), 2: 0.5} and v == {1: pytest.approx(1.36), 2: 0.5}
    same = {r.p: r.y for r in Z.td_targets(exp, sc, "p", "pos", "o", "o").collect()}
    assert same == v


def test_sgd_and_gradient_agree_on_one_example(spark):
    ex = spark.createDataFrame([(1, 1.0, {"a": 1.0, "b": 0.5})], "id int, y double, features map<string,double>")
    w = {r.feature: r.w for r in Z.sgd(ex, "id").collect()}
    assert w["a"] == pytest.approx(0.1) and w["b"] == pytest.approx(0.05) and w["(intercept)"] == pytest.approx(0.1)
    feats = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.5)], "id int, feature string, value double")
    new, b = Z.gradient_step(ex.select("id", "y"), feats, "id", spark.createDataFrame([], "feature string, w double"), 0.0)
    assert {r.feature: r.w for r in new.collect()} == {"a": pytest.approx(0.1), "b": pytest.approx(0.05)} and b.first()[0] == pytest.approx(0.1)


def test_replay_memory_is_bounded_and_recent(spark):
    m = Z.replay_memory(S.numbered(spark.range(1000).withColumnRenamed("id", "e"), "e", "t"), 50, "m", "e", "t")
    rows = m.collect()
    assert len(rows) == 50 and len({r.place for r in rows}) == 50


def test_running_windows_match_plain_ones(spark):
    log = spark.range(1000).selectExpr("id as t", "case when id % 7 = 0 then null else cast(id % 13 as double) end as reward")
    from pyspark.sql import Window

    w = Window.orderBy("t")
    want = log.where("reward is not null").select("t", F.avg("reward").over(w.rowsBetween(-99, 0)).alias("m")).toPandas().set_index("t").m
    got = C.rolling_mean(log, "t", "reward", 100).toPandas().set_index("t").run_average.sort_index()
    assert ((want - got).abs() < 1e-9).all() and len(want) == len(got)
    total = C.running_sums(log, [F.asc("t")], {"s": F.coalesce("reward", F.lit(0.0))}).agg(F.max("s")).first()[0]
    assert total == log.agg(F.sum("reward")).first()[0]


def test_graph(spark):
    pages = spark.createDataFrame([(1, "u1", True), (2, "u2", False)], "page_id bigint, url string, ok boolean")
    links = spark.createDataFrame([(1, "u2"), (1, "u3"), (2, "u1"), (1, "u2")], "page_id bigint, url string")
    nodes, edges = H.build(pages, links)
    assert nodes.count() == 3 and edges.count() == 4
    s = H.state_counts(nodes).first()
    assert (s.created, s.visited, s.ok, s.err) == (3, 2, 1, 1)
    assert H.degrees(nodes, edges).agg(F.sum("in_degree"), F.sum("out_degree")).first() == (4, 4)


def test_quantiles_of_hot_and_odd_keys(spark):
    rows = [("hot", float(i % 977)) for i in range(20_000)] + [("one", 5.0), ("ties", 1.0), ("ties", 1.0), ("none", None), ("nan", float("nan")), (None, 3.0), ("neg", -1e300), ("neg", 1e300), ("neg", 0.5)]
    df = spark.createDataFrame(rows, "k string, v double").withColumn("n", F.lit("clash"))
    got = {r.k: r for r in K.key_quantiles(df, ["k"], "v", [0.0, 0.5, 1.0]).collect()}
    hot = sorted(v for k, v in rows if k == "hot")
    assert (got["hot"].q1, got["hot"].q2, got["hot"].q3) == (hot[0], hot[len(hot) // 2 - 1], hot[-1])
    assert (got["one"].q2, got["ties"].q2, got["none"].q2, got["nan"].q2, got["neg"].q2) == (5.0, 1.0, None, None, 0.5)
    assert None not in got and got["none"].n == 1
    assert K.key_quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


def test_quantiles_with_infinite_values_and_any_key_names(spark):
    inf = float("inf")
    rows = [("a", 1, v) for v in (-inf, -1.7e308, -5e-324, 0.0, 5e-324, 1.7e308, inf)] + [("b", 1, 2.0)] * 3
    df = spark.createDataFrame(rows, "v string, n int, p double").withColumn("rank", F.lit("x"))
    got = {r["v"]: r for r in K.key_quantiles(df, ["v", "n"], "p", [0.01, 0.2, 0.5, 0.7, 0.8, 1.0]).select("v", "q1", "q2", "q3", "q4", "q5", "q6").collect()}
    assert tuple(got["a"])[1:] == (-inf, -1.7e308, 0.0, 5e-324, 1.7e308, inf) and tuple(got["b"])[1:] == (2.0,) * 6


def test_profile_with_few_states_broadcast_or_not(spark, monkeypatch):
    df = spark.range(5000).selectExpr("case when id % 3 = 0 then 'hot' else concat('k', id % 400) end as k", "id * 7 % 1001 as v", "id % 50 as page")
    a = K.key_profile(df, ["k"], "v", [0.25, 0.9], distinct="page").toPandas().sort_values("k").reset_index(drop=True)
    monkeypatch.setattr(K, "BROADCAST_ROWS", 1)
    b = K.key_profile(df, ["k"], "v", [0.25, 0.9], distinct="page").toPandas().sort_values("k").reset_index(drop=True)
    assert a.equals(b[a.columns]) and abs(a.share.sum() - 1) < 1e-9
    assert [r.k for r in K.hot_keys(K.key_profile(df, ["k"], "v", [0.5]), 0.2).collect()] == ["hot"]


def test_salted_agg(spark):
    df = spark.range(1000).selectExpr("'k' as k", "cast(id % 10 as string) as v")
    got = K.salted_agg(df, ["k"], [F.collect_set("v").alias("s")], [F.size(F.array_distinct(F.flatten(F.collect_list("s")))).alias("n")]).first()
    assert got.n == 10


def test_frozen_model_scores_good_links_higher(spark):
    html = '<a href="/page-good">decent page</a><a href="/page-bad">awful page</a>'
    pages = spark.createDataFrame([(1, "http://ex.com", html)], "page_id bigint, url string, html string")
    weights = spark.createDataFrame([("text:dec", 1.0), ("text:awf", -1.0)], "feature string, w double")
    got = {r.url: r.score for r in P.extract_urls(pages, weights, 0.0).collect()}
    assert len(got) == 2 and got["http://ex.com/page-good"] > got["http://ex.com/page-bad"]
    assert {r.score for r in P.extract_urls(pages, weights, None).collect()} == {0.05}


def test_crawl_step(spark):
    from crawlweave.functions.text import html_text

    pages = spark.createDataFrame([(1, "http://ex.com/", '<a href="/g">good</a><a href="/g">good</a><a href="/s">seen</a> good', 7), (2, "http://ex.com/b", "bad", 8)], "page_id bigint, url string, html string, from_link_id bigint")
    goal = G.keyword_goal(html_text(F.col("html")), ["good", "awesome"], ["bad"], max_relevant=1)
    seen = spark.createDataFrame([("http://ex.com/s",)], "canonical string")
    out = P.crawl_step(pages, seen, spark.createDataFrame([], "feature string, w double"), None, goal, P.KEYWORDS)
    assert [(r.url, r.priority) for r in out["requests"].collect()] == [("http://ex.com/g", 500)]
    assert out["links"].count() == 2
    reward = {r.page_id: r.reward for r in out["experience"].collect()}
    assert reward[1] > 0.5 and reward[2] == 0.0 and [r.domain for r in out["achieved"].collect()] == ["ex.com"]


def test_settings():
    assert P.KINDS["extraction"].penalty == "l1" and P.KINDS["extraction"].replay_maxlinks == 500_000 and not P.KINDS["all"].learn
    with pytest.raises(ValueError):
        S.allowed_arguments({"x": 1}, {"y"})
    from crawlweave.operators.features import check_blocks

    with pytest.raises(ValueError):
        check_blocks(True, True, True, True)
    with pytest.raises(ValueError):
        check_blocks(False, False, False, False)


def test_request_history(spark):
    done = spark.createDataFrame([("r0", "a"), (None, "z")], "run_id string, fingerprint string")
    reqs = spark.createDataFrame([("r0", "a", False), ("r1", "a", False), ("r0", "b", False), ("r0", "a", True)], "run_id string, fingerprint string, dont_filter boolean")
    assert L.new_requests(reqs, done).count() == 2
    assert sorted((r.run_id, r.fingerprint, r.dont_filter) for r in L.new_requests(reqs, done, "run_id").collect()) == [("r0", "a", True), ("r0", "b", False), ("r1", "a", False)]


def test_breadth_first_and_depth_penalty(spark):
    links = spark.createDataFrame([("http://e.x/next", 2), ("http://e.x/item", 2), (None, 2)], "url string, depth int")
    pages = spark.createDataFrame([("http://E.x/next#1",)], "url string")
    got = {r.url: (r.depth, r.priority) for r in P.breadth_first(links, pages).collect()}
    assert got == {"http://e.x/next": (2, -200), "http://e.x/item": (3, -300), None: (3, -300)}
    req = spark.createDataFrame([(500, 2)], "priority int, depth int")
    assert P.with_depth_penalty(req).first().priority == 498


def test_first_in_crawl_keeps_extra_columns_and_ties(spark):
    from crawlweave.functions.urls import canonical

    df = spark.createDataFrame([(2, "http://e.x/a#1", "b"), (1, "http://E.x/a", "a"), (3, None, "c"), (1, "http://E.x/a", "a")], "order bigint, url string, r string")
    assert [tuple(r) for r in L.first_in_crawl(df, canonical(F.col("url")), "order").collect()] == [(1, "http://E.x/a", "a")]
    assert L.first_in_crawl(df.limit(0), canonical(F.col("url")), "order").count() == 0


def test_extraction_rewards(spark):
    items = spark.createDataFrame([("r", "k1", 1, 1), ("r", "k2", 1, 2), ("r", "k1", 2, 3), ("s", "k1", 3, 4)], "run_id string, key string, page_id int, seq int")
    assert {(r.run_id, r.page_id): r.reward for r in G.ExtractionGoal().reward(items).collect()} == {("r", 1): 1.0, ("r", 2): -1.0, ("s", 3): 0.0}
    assert sorted(r.key for r in G.unique_items(items).collect()) == ["k1", "k2"]


def test_forms_goal_threshold_is_strict(spark):
    df = spark.createDataFrame([("a", {"login": 0.7}), ("b", {"login": 0.71}), ("c", None), ("d", {"search": 1.0})], "domain string, form map<string,double>")
    goal = G.FormGoal("login")
    assert [r.domain for r in goal.achieved(goal.reward(df), "domain").collect()] == ["b"]


def test_close_times_and_versions(spark):
    log = spark.createDataFrame([("a", t, 0.1 * (t % 2)) for t in range(1, 9)] + [("b", 3, 0.0)], "domain string, t bigint, reward double")
    assert {r.domain: r.closed_at for r in C.close_times(log, "domain", "t", "reward", 0.1, None, 2).collect()} == {"a": 3}
    assert {r.domain: r.closed_at for r in C.close_times(log, "domain", "t", "reward", 0.1, 1, None).collect()} == {"a": 1, "b": 3}
    assert C.close_times(log, "domain", "t", "reward", 0.1, None, None).count() == 0
    assert [r.t for r in C.every(log, "t", 4, skip_zero=True).orderBy("t").collect()] == [4, 8]


def test_priority_updates_spare_seeds(spark):
    q = spark.createDataFrame([("s", 1, "u", 50_000, True, False), ("s", 2, "v", 1, False, False), ("s", 3, "w", 1, False, False)], QUEUE)
    scores = spark.createDataFrame([(1, 0.1), (2, 0.12349)], "seq bigint, q double")
    assert {r.seq: r.priority for r in Q.reprioritise(q, scores).collect()} == {1: 50_000, 2: 1234, 3: 1}
    kept, rejected = Q.push(q, q.withColumn("seq", F.col("seq") + 10), spark.createDataFrame([("s",)], "slot string"))
    assert kept.count() == 3 and rejected.count() == 3


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "i int, t double, s double")
    assert M.ndcg(none, "t", "s", 5, "i").first()[0] is None and M.drift(none, "t", "s").first().n == 0
    assert M.change_counts(none, "t", "s").where("changed = 0").count() == 7
    with pytest.raises(ValueError):
        M.dcg(none, "t", "s", 5, "i", "odd")
