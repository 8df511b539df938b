"""A few keys holding most records (problem 7): per-key results without per-key tasks.

Counts, extremes and histograms are mergeable, so every task sends at most one row per key and bin. Exact quantiles
come from refining the histogram around the wanted rank until one value is left; the values of a key are never
brought together, however many rows it holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.functions.common import BROADCAST_ROWS, written

#: Bins a histogram is refined into each round.
BINS = 64
#: A key with this share of the rows is hot; at most 1 / HOT_SHARE keys can be.
HOT_SHARE = 1e-4


def key_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, values, least, most): rows, non-null values and their extremes per key; one partial row a task and key."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count(v).alias("values"), F.min(v).alias("least"), F.max(v).alias("most"))


def _with_state(data: DataFrame, state: DataFrame, keys: list[str], rows: int, states: int) -> DataFrame:
    """Rows with their key's intervals. All keys are broadcast when counted and few; else only the hot ones, of which
    there are at most 1 / HOT_SHARE, and the others, each below that share, meet by shuffle."""
    if states <= BROADCAST_ROWS:
        return data.join(F.broadcast(state), keys)
    hot = state.where(F.col("n") >= rows * HOT_SHARE)
    cold = state.where(F.col("n") < rows * HOT_SHARE)
    warm = data.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return data.join(F.broadcast(hot), keys).unionByName(warm.join(cold, keys))


def _bin(v: Column, lo: Column, hi: Column) -> Column:
    """The bin of v between lo and hi. The two ends have bins of their own, so every round parts them, infinite ones too."""
    part = F.coalesce(F.try_divide(v / 2 - lo / 2, hi / 2 - lo / 2), F.lit(float("nan")))
    inner = F.when(F.isnan(part) | (part < 0) | (part > 1), F.lit(BINS // 2)).otherwise(1 + F.least(F.lit(BINS - 3), F.floor(part * (BINS - 2))))
    return F.when(v == lo, 0).when(v == hi, BINS - 1).otherwise(inner).cast("int")


def key_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """(keys, n, values, least, most, q1 .. qk): exact quantiles of `value` per key, as doubles.

    The quantile of p is the value of rank ceil(p * values), 1 at least, in ascending order. Null and NaN values have
    no rank; a key without values gets null quantiles. Rows with a null key column are left out. An empty table gives an
    empty result. Key columns may have any names.
    """
    names, keys = keys, [f"__k{i}" for i in range(len(keys))]
    df = df.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], F.col(value).alias("__value"))
    value = "__value"
    some = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    v = F.col(value).cast("double")
    data = written(df.where(some).select(*keys, F.when(~F.isnan(v), v).alias("v")), "key-values")
    counts = written(key_counts(data, keys, "v"), "key-counts")
    rows, states = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    wants = F.array(*[F.struct(F.lit(k).alias("p"), F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("values"))).cast("long").alias("rank")) for k, p in enumerate(probs, 1)])
    state = counts.where("values > 0").select(*keys, "n", F.explode(wants).alias("w"), "least", "most").select(*keys, "n", "w.p", "w.rank", F.col("least").alias("lo"), F.col("most").alias("hi"))
    state = written(state, "ranks")
    done: list[DataFrame] = [state.where("lo = hi")]
    state, left = state.where("lo < hi"), None
    while left is None or left:
        if left is None and state.isEmpty():
            break
        packed = state.groupBy(*keys).agg(F.first("n").alias("n"), F.collect_list(F.struct("p", "rank", "lo", "hi")).alias("at"))  # len(probs) entries a key
        joined = _with_state(data.where("v is not null"), packed, keys, rows, states)
        inside = joined.select(*keys, "n", "v", F.explode(F.filter("at", lambda a: (F.col("v") >= a["lo"]) & (F.col("v") <= a["hi"]))).alias("a"))
        bin_ = _bin(F.col("v"), F.col("a.lo"), F.col("a.hi"))
        hist = inside.groupBy(*keys, "n", F.col("a.p").alias("p"), F.col("a.rank").alias("rank"), bin_.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "p").orderBy("bin"))
        cut = hist.withColumn("upto", upto).where("upto >= rank and upto - c < rank").select(*keys, "n", "p", (F.col("rank") - (F.col("upto") - F.col("c"))).alias("rank"), "lo", "hi")
        cut = written(cut, "ranks")
        done.append(cut.where("lo = hi"))
        state = cut.where("lo < hi")
        left = not state.isEmpty()
    found = reduce(DataFrame.unionByName, done)
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == k, F.col("lo"))).alias(f"q{k}") for k in range(1, len(probs) + 1)])
    out = counts.join(wide, keys, "left")
    return out.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in out.columns if c not in keys])


def key_profile(df: DataFrame, keys: list[str], value: str, probs: list[float], within: list[str] | None = None, distinct: str | None = None) -> DataFrame:
    """`key_quantiles` with `share` (of the rows, or of the rows with equal `within` columns) and, if asked, the
    number of distinct values of `distinct` per key (counted in two steps, first by key and value)."""
    out = key_quantiles(df, keys, value, probs)
    if within:
        totals = out.groupBy(*within).agg(F.sum("n").alias("all_rows"))
        out = out.join(F.broadcast(totals) if totals.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else totals, within)
    else:
        out = out.withColumn("all_rows", F.lit(out.agg(F.sum("n")).first()[0]).cast("long"))
    out = out.withColumn("share", F.col("n") / F.col("all_rows")).drop("all_rows")
    if distinct:
        pairs = df.where(F.col(distinct).isNotNull()).select(*keys, F.col(distinct).alias("__distinct")).distinct()
        out = out.join(pairs.groupBy(*keys).agg(F.count("*").alias(f"{distinct}s")), keys, "left").na.fill(0, [f"{distinct}s"])
    return out


def hot_keys(profile: DataFrame, share: float) -> DataFrame:
    """The keys of a profile that hold at least `share` of the rows."""
    return profile.where(F.col("share") >= share)


def salted_agg(df: DataFrame, keys: list[str], aggs: list[Column], merge: list[Column], salts: int = 32) -> DataFrame:
    """Two-step aggregation for functions without map-side merging: first by key and salt, then by key.

    `aggs` are computed per (keys, salt), `merge` over their results. The salt is a hash of the row, so reruns agree.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)).cast("int")
    return df.withColumn("__salt", salt).groupBy(*keys, "__salt").agg(*aggs).groupBy(*keys).agg(*merge)
