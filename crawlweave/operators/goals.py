"""Rewards and stop rules: what a crawl is after and when a domain has given it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.functions.text import relevancy


class Goal(Protocol):
    """What a crawl needs of a goal."""

    def reward(self, pages: DataFrame) -> DataFrame:
        """`pages` with a `reward` column."""

    def achieved(self, rewarded: DataFrame, domain: str) -> DataFrame:
        """(domain): those that need no further requests."""


@dataclass
class RelevancyGoal:
    """Relevant pages; a domain is done after so many requests or relevant pages (count of pages at the threshold or above)."""

    score: Callable[[], Column] | Column
    threshold: float = 0.1
    max_requests: int | None = None
    max_relevant: int | None = None

    def reward(self, pages: DataFrame) -> DataFrame:
        return pages.withColumn("reward", self.score() if callable(self.score) else self.score)

    def achieved(self, rewarded: DataFrame, domain: str) -> DataFrame:
        c = domain_counts(rewarded, domain, self.threshold)
        done = F.lit(False)
        if self.max_requests is not None:
            done |= F.col("requests") >= self.max_requests
        if self.max_relevant is not None:
            done |= F.col("relevant") >= self.max_relevant
        return c.where(done).select(domain)


def keyword_goal(text: Column, positive: list[str], negative: list[str], **limits) -> RelevancyGoal:
    return RelevancyGoal(relevancy(text, positive, negative), **limits)


@dataclass
class FormGoal:
    """A form of one type; a domain is done when its best probability is above the threshold."""

    form_type: str
    threshold: float = 0.7
    form_map: str = "form"

    def reward(self, pages: DataFrame) -> DataFrame:
        return pages.withColumn("reward", F.coalesce(F.try_element_at(self.form_map, F.lit(self.form_type)), F.lit(0.0)))

    def achieved(self, rewarded: DataFrame, domain: str) -> DataFrame:
        return max_scores(rewarded, domain, "reward").where(F.col("max_score") > self.threshold).select(domain)


@dataclass
class ExtractionGoal:
    """New items; every page costs 1."""

    page_cost: float = 1.0
    max_requests: int | None = None

    def reward(self, items: DataFrame, run: str = "run_id", key: str = "key", page: str = "page_id", order: str = "seq") -> DataFrame:
        """(run, page, reward): items first seen in the run, less the cost of the page."""
        firsts = items.groupBy(run, key).agg(F.min_by(page, order).alias(page))
        found = firsts.groupBy(run, page).agg(F.count("*").alias("new"))
        pages = items.select(run, page).distinct()
        return pages.join(found, [run, page], "left").select(run, page, (F.coalesce("new", F.lit(0)) - F.lit(self.page_cost)).alias("reward"))

    def achieved(self, rewarded: DataFrame, domain: str) -> DataFrame:
        return rewarded.groupBy(domain).count().where(F.col("count") >= (self.max_requests or 1 << 62)).select(domain)


def unique_items(items: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """The first item of every key: what is exported (keys count across runs)."""
    row = F.struct(*[F.col(c) for c in items.columns])
    return items.groupBy(F.col(key).alias("__key")).agg(F.min_by(row, order).alias("r")).select("r.*")


def domain_counts(rewarded: DataFrame, domain: str, threshold: float = 0.1) -> DataFrame:
    """(domain, requests, relevant)."""
    return rewarded.groupBy(domain).agg(F.count("*").alias("requests"), F.count_if(F.col("reward") >= threshold).alias("relevant"))


def max_scores(rows: DataFrame, key: str, score: str, default: float = 0.0) -> DataFrame:
    """(key, max_score): the best score of every key; nothing is below the default."""
    return rows.groupBy(key).agg(F.greatest(F.coalesce(F.max(score), F.lit(default)), F.lit(default)).alias("max_score"))


def max_score_summary(best: DataFrame) -> DataFrame:
    """(keys, total, average) of `max_scores`."""
    return best.agg(F.count("*").alias("keys"), F.coalesce(F.sum("max_score"), F.lit(0.0)).alias("total"), F.coalesce(F.avg("max_score"), F.lit(0.0)).alias("average"))


def merge_max(rows: DataFrame, key: str, maps: str) -> DataFrame:
    """(key, scores): per key the largest value of every map entry; null maps, null and NaN values are passed over."""
    flat = rows.where(F.col(maps).isNotNull()).select(key, F.explode(maps).alias("k", "v")).where("v is not null and not isnan(v)")
    best = flat.groupBy(key, "k").agg(F.max("v").alias("v"))
    return best.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("scores"))


def classifier_goal(model, features: str = "features", **limits) -> RelevancyGoal:
    """Reward by a fitted classifier: its probability of class 1 (the model's output column `probability`)."""
    from pyspark.ml.functions import vector_to_array

    return RelevancyGoal(vector_to_array(F.col("probability"))[1], **limits)
