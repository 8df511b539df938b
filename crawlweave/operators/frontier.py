"""The frontier: one priority queue per slot, balanced and exploratory selection.

A frontier is a table (slot, seq, url, priority, is_seed, removed ...). Entries are tombstoned, not deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.functions.common import running_sums
from crawlweave.functions.numeric import EMPTY_PRIORITY, PRIORITY_SCALE, score_to_priority
from crawlweave.functions.rand import order_key, uniform


def _best_first(slot: str, lifo: bool):
    return Window.partitionBy(slot).orderBy(F.desc("priority"), F.desc("seq") if lifo else F.asc("seq"))


def pop_order(frontier: DataFrame, n: int, slot: str = "slot", lifo: bool = False) -> DataFrame:
    """The next n entries of every slot with their `place` (from 1). Tombstones are passed over; equal priorities leave
    in arrival order, or newest first with `lifo`. The rank limit works on each task before the shuffle, so a slot that
    holds a third of all entries sends n rows a task."""
    live = frontier.where(~F.coalesce(F.col("removed"), F.lit(False)))
    return live.withColumn("place", F.row_number().over(_best_first(slot, lifo))).where(F.col("place") <= n).withColumn("place", F.col("place").cast("long"))


def pop_random(frontier: DataFrame, seed: str, n: int = 1, slot: str = "slot") -> DataFrame:
    """n live entries of every slot in seeded random order; none where a slot has no live entry."""
    w = Window.partitionBy(slot).orderBy(order_key(seed, F.col("seq")), "seq")
    return frontier.where(~F.coalesce(F.col("removed"), F.lit(False))).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).withColumn("place", F.col("place").cast("long"))


def trim(frontier: DataFrame, maxsize: int, slot: str = "slot") -> DataFrame:
    """Each queue cut to its `maxsize` best entries (oldest first on ties)."""
    return frontier.withColumn("__rn", F.row_number().over(_best_first(slot, False))).where(F.col("__rn") <= maxsize).drop("__rn")


def remove(frontier: DataFrame, gone: DataFrame, key: str = "seq") -> DataFrame:
    """Tombstone the entries whose key is in `gone`."""
    hit = gone.select(key).distinct().withColumn("__hit", F.lit(True))
    return frontier.join(hit, key, "left").withColumn("removed", F.coalesce("removed", F.lit(False)) | F.coalesce("__hit", F.lit(False))).drop("__hit")


def reprioritise(frontier: DataFrame, scores: DataFrame, key: str = "seq", score: str = "q") -> DataFrame:
    """New priorities from new scores; seeds and entries without score keep theirs."""
    out = frontier.join(scores.select(key, F.col(score).alias("__q")), key, "left")
    return out.withColumn("priority", F.when(F.col("is_seed") | F.col("__q").isNull(), F.col("priority")).otherwise(score_to_priority(F.col("__q")))).drop("__q")


def queue_stats(frontier: DataFrame, slot: str = "slot") -> DataFrame:
    """(slot, entries, live, max_priority): tombstones count as entries; a queue without live entry has the sentinel."""
    live = ~F.coalesce(F.col("removed"), F.lit(False))
    return frontier.groupBy(slot).agg(F.count("*").alias("entries"), F.count_if(live).alias("live"), F.coalesce(F.max(F.when(live, F.col("priority"))), F.lit(EMPTY_PRIORITY)).alias("max_priority"))


def close_slots(frontier: DataFrame, closed: DataFrame, slot: str = "slot") -> tuple[DataFrame, DataFrame]:
    """(open entries, (slot, dropped)): entries of closed slots go; `dropped` counts tombstones too."""
    shut = closed.select(slot).distinct()
    return frontier.join(shut, slot, "left_anti"), frontier.join(shut, slot, "left_semi").groupBy(slot).agg(F.count("*").alias("dropped"))


def push(frontier: DataFrame, new: DataFrame, closed: DataFrame, slot: str = "slot") -> tuple[DataFrame, DataFrame]:
    """(frontier, rejected): entries for closed slots are rejected; they count as enqueued and as dropped."""
    shut = closed.select(slot).distinct()
    return frontier.unionByName(new.join(shut, slot, "left_anti"), allowMissingColumns=True), new.join(shut, slot, "left_semi")


def slot_weights(stats: DataFrame, temperature: float = 1.0, slot: str = "slot") -> DataFrame:
    """`stats` with `p`: softmax of the slots' best priorities, as scores, at a temperature.

    The maximum and the sum are single numbers, aggregated with partial sums; no window gathers all slots.
    """
    z = F.col("max_priority") / F.lit(float(PRIORITY_SCALE) * temperature)
    top = stats.agg(F.max(z)).first()[0] if stats is not None else None
    e = F.exp(z - F.lit(top if top is not None else 0.0))
    total = stats.agg(F.sum(e)).first()[0]
    return stats.withColumn("p", e / F.lit(total if total else 1.0))


def sample_slots(stats: DataFrame, n: int, seed: str, temperature: float = 1.0, slot: str = "slot") -> DataFrame:
    """(draw, slot): n draws with replacement, slot k with probability p of `slot_weights`.

    Cumulative ranges (in slot order) meet the seeded uniforms by an equi-join on 4096 bins of [0, 1); a range spans as
    many bins as its probability, so all of them together at most slots + 4096.
    """
    w = slot_weights(stats, temperature, slot).select(slot, "p")
    ranges = running_sums(w, [F.asc(slot)], {"hi": F.col("p")}, "ranges").withColumn("lo", F.col("hi") - F.col("p"))
    at = lambda c: F.least(F.lit(4095), F.floor(c * 4096)).cast("int")
    ranges = ranges.withColumn("bin", F.explode(F.sequence(at(F.col("lo")), at(F.col("hi")))))
    draws = stats.sparkSession.range(1, n + 1).select(F.col("id").alias("draw"), uniform(seed, F.col("id")).alias("u"))
    met = draws.withColumn("bin", at(F.col("u"))).join(ranges, "bin")
    return met.where("u >= lo and u < hi").select("draw", slot)


def epsilon_mix(greedy: DataFrame, others: DataFrame, eps: float, seed: str, key: str = "seq") -> DataFrame:
    """Greedy requests and seeded random extras (each with probability eps), flagged `from_random`."""
    extra = others.where(uniform(seed, F.col(key)) < eps).withColumn("from_random", F.lit(True))
    return greedy.withColumn("from_random", F.lit(False)).unionByName(extra, allowMissingColumns=True)


def random_requests(frontier: DataFrame, n: int, eps: float, seed: str, key: str = "seq") -> DataFrame:
    """Exploration beside a batch of n: as many seeded random live entries as n (1 + eps) draws with probability eps give,
    flagged `from_random`. The number is a binomial of the seed, the entries a top-k of hashes."""
    import numpy as np

    rng = np.random.default_rng(list(seed.encode()))
    k = int(rng.binomial(round(n * (1 + eps)), eps))
    live = frontier.where(~F.coalesce(F.col("removed"), F.lit(False)))
    return live.orderBy(order_key(f"{seed}:random", F.col(key)), key).limit(k).withColumn("from_random", F.lit(True))


def shuffled(batch: DataFrame, seed: str, key: str = "seq") -> DataFrame:
    return batch.orderBy(order_key(seed, F.col(key)), key)


def dump(frontier: DataFrame, buffer: DataFrame | None = None, slot: str = "slot") -> DataFrame:
    """(priority, slot, url): live entries, and those of the pop buffer under `<BUFFER>`."""
    rows = frontier.where(~F.coalesce(F.col("removed"), F.lit(False))).select("priority", F.col(slot).alias("slot"), "url")
    return rows if buffer is None else rows.unionByName(buffer.select("priority", F.lit("<BUFFER>").alias("slot"), "url"))


def domain_counts(slots: DataFrame, closed: DataFrame, slot: str = "slot") -> DataFrame:
    """(open, closed): numbers of active and closed slots."""
    mark = closed.select(slot).distinct().withColumn("__shut", F.lit(True))
    return slots.select(slot).distinct().join(mark, slot, "left").agg(F.count_if(F.col("__shut").isNull()).alias("open"), F.count_if(F.col("__shut").isNotNull()).alias("closed"))


def todo(log: DataFrame, enqueued: Column, dequeued: Column, dropped: Column) -> DataFrame:
    """(enqueued, processed, dropped, todo): what is left to do."""
    out = log.agg(F.count_if(enqueued).alias("enqueued"), F.count_if(dequeued).alias("processed"), F.count_if(dropped).alias("dropped"))
    return out.withColumn("todo", F.expr("enqueued - processed - dropped"))
