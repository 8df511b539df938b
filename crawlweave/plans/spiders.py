"""Ready-made crawls: settings of each kind and the plan of one micro-batch.

A crawl is a loop over micro-batches of fetched pages: links out, rewards, learning, requests in. `crawl_step` is the
plan of one batch; the fetcher itself is an input.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlweave.functions import urls
from crawlweave.functions.numeric import score_to_priority
from crawlweave.operators import features as X
from crawlweave.operators import links as L
from crawlweave.operators import qmodel as Q
from crawlweave.operators.goals import Goal


@dataclass(frozen=True)
class Settings:
    """What a crawl may be told; the defaults are those of the general adaptive crawl."""

    epsilon: float = 0.2
    gamma: float = 0.4
    temperature: float = 1.0
    sample_size: int = 300
    replay_maxsize: int | None = 100_000
    replay_maxlinks: int | None = None
    steps_before_switch: int = 100
    checkpoint_interval: int = 1000
    double: bool = True
    use_link_text: bool = True
    use_url: bool = False
    use_full_url: bool = False
    use_page_url: bool = False
    use_same_domain: bool = True
    learn: bool = True
    offsite: bool = False
    penalty: str = "l2"
    alpha: float = 1e-6
    eta: float = 0.1
    queue_maxsize: int | None = None
    depth_limit: int | None = None


ADAPTIVE = Settings()
KEYWORDS = replace(ADAPTIVE, temperature=0.1, sample_size=50, use_full_url=True, offsite=True)
CLASSIFIER = KEYWORDS
FORMS = ADAPTIVE
EXTRACTION = replace(ADAPTIVE, temperature=5.0, replay_maxsize=5000, replay_maxlinks=500_000, use_url=True, use_page_url=True, use_same_domain=False, penalty="l1", alpha=1e-4, queue_maxsize=500_000)
AUTOPAGER = replace(EXTRACTION, epsilon=0.0, learn=False)
BASELINE = replace(ADAPTIVE, learn=False, depth_limit=1)
KINDS = {"relevant-keywords": KEYWORDS, "relevant": CLASSIFIER, "forms": FORMS, "extraction": EXTRACTION, "autopager_extraction": AUTOPAGER, "all": BASELINE, "checker": replace(BASELINE, depth_limit=0)}


def extract_urls(pages: DataFrame, weights: DataFrame, intercept: float | None, settings: Settings = ADAPTIVE) -> DataFrame:
    """(page_id, pos, score, url): every link of every page scored with a frozen model, in document order, repeats kept."""
    links = L.page_links(pages).withColumn("link_id", F.concat_ws(":", "page_id", "pos"))
    f = X.link_vectors(links, "link_id", settings.use_link_text, settings.use_url, settings.use_full_url, settings.use_same_domain)
    page_f = X.page_url_features(pages, "page_id", "url", settings.use_full_url) if settings.use_page_url else None
    return Q.predict(links, "link_id", f, weights, intercept, "page_id" if page_f is not None else None, page_f).select("page_id", "pos", F.col("q").alias("score"), "url")


def crawl_step(pages: DataFrame, seen: DataFrame, weights: DataFrame, intercept: float | None, goal: Goal, settings: Settings = ADAPTIVE) -> dict[str, DataFrame]:
    """One micro-batch: `links`, new `requests`, `experience` with rewards, `achieved` domains.

    An experience's choices are the first links of each address on the page; requests are the first in the crawl.
    """
    links = L.page_links(pages, same_domain=not settings.offsite).withColumn("link_id", F.concat_ws(":", "page_id", "pos"))
    key = urls.canonical(F.col("url"))
    choices = L.first_on_page(links, key, "page_id", "pos")
    fresh = L.unseen(L.first_in_crawl(links, key, "link_id"), key, seen, "canonical")
    f = X.link_vectors(fresh, "link_id", settings.use_link_text, settings.use_url, settings.use_full_url, settings.use_same_domain)
    scored = Q.predict(fresh, "link_id", f, weights, intercept if settings.learn else None)
    requests = scored.select("url", F.col("domain_to").alias("slot"), score_to_priority(F.col("q")).alias("priority"), F.lit(False).alias("is_seed"), F.lit(False).alias("removed"))
    rewarded = goal.reward(pages).withColumn("domain", urls.registered_domain(F.col("url")))
    taught = rewarded.where(F.col("from_link_id").isNotNull()).select("page_id", "domain", "reward", "from_link_id")
    return {"links": choices, "requests": requests, "experience": taught, "achieved": goal.achieved(rewarded, "domain")}


def breadth_first(links: DataFrame, pagination: DataFrame, depth: str = "depth") -> DataFrame:
    """Baseline without learning: pagination keeps the depth, other links add one; priority falls by 100 a level."""
    marked = L.mark_members(links, urls.canonical(F.col("url")), pagination.select(urls.canonical(F.col("url")).alias("c")), "c", "is_pagination")
    out = marked.withColumn(depth, F.col(depth) + F.when(F.col("is_pagination"), 0).otherwise(1))
    return out.withColumn("priority", (-100 * F.col(depth)).cast("int"))


def with_depth_penalty(requests: DataFrame, depth: str = "depth") -> DataFrame:
    """Each level of depth costs one step of priority, so equal scores give breadth-first order."""
    return requests.withColumn("priority", (F.col("priority") - F.col(depth)).cast("int"))
