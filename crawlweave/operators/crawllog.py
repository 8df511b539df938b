"""The crawl log: running totals over an event log ordered by step.

A running window over the whole log would be one task; `common.running_sums` cuts the log into range parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.functions.common import running_sums

def returns(log: DataFrame, t: str, reward: str) -> DataFrame:
    """`log` with `return` (sum of rewards so far) and `average` (per step; steps without reward count)."""
    out = running_sums(log, [F.asc(t)], {"return": F.coalesce(F.col(reward), F.lit(0.0)), "steps": F.lit(1)})
    return out.withColumn("average", F.try_divide("return", "steps"))


def rolling_mean(log: DataFrame, t: str, reward: str, n: int = 100) -> DataFrame:
    """(t, position, run_average): mean of the last n rewards (fewer at the start). Steps without reward are not in the list.

    Running sums at positions p and p - n, met by an equi-join: no window reaches over chunks.
    """
    got = running_sums(log.where(F.col(reward).isNotNull()).select(t, reward), [F.asc(t)], {"s": F.col(reward), "position": F.lit(1)})
    past = got.select((F.col("position") + n).alias("position"), F.col("s").alias("past"))
    out = got.join(past, "position", "left")
    return out.select(t, "position", ((F.col("s") - F.coalesce("past", F.lit(0.0))) / F.least(F.col("position"), F.lit(n))).alias("run_average"))


def distinct_so_far(log: DataFrame, t: str, keys: dict[str, Column]) -> DataFrame:
    """(t, key columns): how many different values each key took up to t. First steps are merged map-side, then summed."""
    out = log.select(t)
    parts = None
    for name, key in keys.items():
        first = log.select(t, key.alias("k")).where("k is not null").groupBy("k").agg(F.min(t).alias(t)).groupBy(t).agg(F.count("*").alias(name))
        parts = first if parts is None else parts.join(first, t, "full")
    marked = out.join(parts, t, "left").select(t, *[F.coalesce(n, F.lit(0)).alias(f"__new_{n}") for n in keys])
    return running_sums(marked, [F.asc(t)], {n: F.col(f"__new_{n}") for n in keys}).select(t, *keys)


def close_times(log: DataFrame, domain: str, t: str, reward: str, threshold: float, max_requests: int | None, max_relevant: int | None) -> DataFrame:
    """(domain, closed_at): the step at which a domain reached its limit of requests or relevant pages.

    The n-th smallest step of a group is found from its n first rows only (rank limit before the shuffle).
    """
    def nth(rows: DataFrame, n: int) -> DataFrame:
        w = Window.partitionBy(domain).orderBy(t)
        return rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).where(F.col("__rn") == n).select(domain, t)

    parts = []
    if max_requests is not None:
        parts.append(nth(log, max_requests))
    if max_relevant is not None:
        parts.append(nth(log.where(F.col(reward) >= threshold), max_relevant))
    if not parts:
        return log.select(domain, F.lit(None).cast("long").alias("closed_at")).limit(0)
    both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return both.groupBy(domain).agg(F.min(t).alias("closed_at"))


def every(log: DataFrame, t: str, k: int, skip_zero: bool = False) -> DataFrame:
    """The rows of every k-th step (log lines, fits, checkpoints); checkpoints never come at step 0."""
    return log.where((F.col(t) % k == 0) & (F.col(t) > 0 if skip_zero else F.lit(True)))


def scalars(log: DataFrame, t: str, names: list[str], k: int = 20) -> DataFrame:
    """(name, step, value): the log's columns as time series, every k-th step."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names])).alias("r")
    return every(log, t, k).select(F.col(t).alias("step"), rows).select("r.name", "step", "r.value")


def model_version(t: Column, steps_before_switch: int = 100) -> Column:
    return F.floor(t / steps_before_switch).cast("long")
