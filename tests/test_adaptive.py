"""The learning crawl on a small made-up web, and hashed features against plain sums."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlweave.operators import frontier as FR
from crawlweave.operators import hashing as H
from crawlweave.operators.goals import RelevancyGoal
from crawlweave.plans.adaptive import AdaptiveCrawl
from crawlweave.plans.spiders import ADAPTIVE, Settings

PAGE = "seq long, page_id long, url string, html string, status int, depth int"


def html(url):
    """A site whose 'treasure' links lead to what is wanted and whose 'dull' links lead to nothing."""
    k = sum(map(ord, url)) % 97
    links = "".join(f'<a href="/treasure/{k}-{i}">hidden treasure {i}</a> <a href="/dull/{k}-{i}">dull corner {i}</a>' for i in range(4))
    return f"<p>{'gold ' * 5 if 'treasure' in url else 'mud'}</p>{links}"


def fetch(spark, requests, bad=()):
    rows = [(r.seq, 1000 * (r.depth + 1) + r.seq, r.url, html(r.url), 500 if r.seq in bad else 200, r.depth) for r in requests]
    return spark.createDataFrame(rows, PAGE)


def goal(**limits):
    return RelevancyGoal(F.when(F.col("html").contains("gold"), 1.0).otherwise(0.0), **limits)


def test_good_links_score_above_bad_ones_and_a_restart_goes_on(spark, tmp_path):
    path = f"file://{tmp_path}/crawl"
    settings = Settings(sample_size=50, steps_before_switch=10, epsilon=0.2, eta=0.1, replay_maxsize=40)
    crawl = AdaptiveCrawl(spark, path, goal(), settings, batch=8)
    asked = crawl.start(spark.createDataFrame([("http://a.test/",), ("http://a.test/",), ("http://b.test/",)], "url string")).collect()
    assert len(asked) == 2
    seen = {r.url for r in asked}
    for k in range(4):
        if k == 2:  # another process takes over
            crawl = AdaptiveCrawl(spark, path, goal(), settings, batch=8)
            assert crawl.t > 0 and crawl.model.fitted
        asked = crawl.step(fetch(spark, asked)).collect()
        assert asked and not seen & {r.url for r in asked}
        seen |= {r.url for r in asked}
    f = H.rescored(crawl._read("frontier").where("not is_seed"), crawl.model.w, crawl.model.b)
    good, bad = (f.where(F.col("url").contains(x)).agg(F.avg("q")).first()[0] for x in ("treasure", "dull"))
    assert good > bad + 0.2
    assert crawl._read("memory").count() <= 40 and crawl.model.target.any()


def test_limits_of_a_crawl(spark, tmp_path):
    settings = Settings(depth_limit=1, queue_maxsize=3, replay_maxlinks=20, penalty="l1", double=False, epsilon=0.0, use_url=True)
    crawl = AdaptiveCrawl(spark, f"file://{tmp_path}/c", goal(max_requests=3), settings, batch=2)
    asked = crawl.start(spark.createDataFrame([("http://a.test/",), ("http://b.test/",)], "url string")).collect()
    asked = crawl.step(fetch(spark, asked, bad={1})).collect()
    assert asked and all(r.depth == 1 and not r.from_random for r in asked)
    waiting = crawl._read("frontier").where("not removed").groupBy("slot").count().collect()
    assert all(r["count"] <= 3 for r in waiting) and len(waiting) == 1  # the failed seed offers nothing
    assert crawl.step(fetch(spark, asked)).count() <= 2
    left = crawl._read("frontier").where("depth > 1").count()
    assert left == 0 and crawl._read("memory").selectExpr("sum(size(choices) + 1)").first()[0] <= 20
    assert crawl.step(spark.createDataFrame([], PAGE)).count() >= 0


def test_random_requests_are_binomial(spark):
    f = spark.range(500).selectExpr("id as seq", "'s' as slot", "false as removed")
    sizes = [FR.random_requests(f, 50, 0.2, str(k)).count() for k in range(12)]
    assert len(set(sizes)) > 3 and 8 < sum(sizes) / 12 < 17
    assert FR.random_requests(f, 50, 0.0, "1").count() == 0


def test_hashed_vectors_and_scores(spark):
    rows = [(1, "Log in", {"title": "Here"}, "http://a.test/x?y=1", "a.test", "A.test", "http://a.test/"), (2, None, None, None, None, None, None), (3, "", {}, "http://b.test/", "a.test", "b.test", "http://a.test/")]
    df = spark.createDataFrame(rows, "id long, inside_text string, attrs map<string,string>, url string, domain_from string, domain_to string, page_url string").withColumn("buckets", F.lit(1))
    spec = H.Hashed(use_url=True, use_page_url=True)
    got = {r.id: dict(zip(r.buckets, r["values"])) for r in H.vectors(df, "id", spec).collect()}
    text = "log in here"
    grams = {text[i : i + k] for k in (3, 4, 5) for i in range(len(text) - k + 1)}
    for g in grams:
        assert got[1][H.bucket("text", g)] == pytest.approx(1 / math.sqrt(len(grams)))
    assert got[1][H.bucket("same_domain", "")] == 1.0 and got[2] == {} and H.bucket("same_domain", "") not in got[3]
    w = np.random.default_rng(1).normal(size=H.BUCKETS)
    score = {r.id: r.q for r in H.scores(df, "id", w, 0.5, spec).collect()}
    assert score == {i: pytest.approx(0.5 + sum(w[b] * v for b, v in vec.items())) for i, vec in got.items()}
    stored = H.rescored(H.vectors(df, "id", spec), w, 0.5)
    assert {r.id: r.q for r in stored.collect()} == {i: pytest.approx(q) for i, q in score.items()}
    assert H.vectors(df.limit(0), "id").count() == 0
    with pytest.raises(ValueError):
        H.vectors(df, "id", H.Hashed(use_url=True, use_full_url=True))
    weights = spark.createDataFrame([(5, 0.25), (1 << 21, 9.0)], "bucket int, w double")
    assert H.weight_array(weights)[5] == 0.25 and len(H.weight_array(weights)) == 1 << 20
    assert ADAPTIVE.sample_size == 300
