"""Offline evaluation of crawls: form expectations, timelines, histograms, runs side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.functions.rand import uniform


def spread_forms(forms: DataFrame, names: dict[str, str], form: str = "form", default: float = 0.0) -> DataFrame:
    """Form maps as columns: {type in the map: column name}. Types a map lacks get the default; null maps, null for all."""
    cols = [F.when(F.col(form).isNotNull(), F.coalesce(F.try_element_at(form, F.lit(t)), F.lit(default))).alias(c) for t, c in names.items()]
    return forms.select(*[c for c in forms.columns if c != form], *cols)


def flatten_forms(pages: DataFrame, forms: str = "forms") -> DataFrame:
    """A row per form of every page, with the form's map and hash; pages without forms give none."""
    return pages.select(*[c for c in pages.columns if c != forms], F.explode(forms).alias("__f")).select("*", F.col("__f.form").alias("form"), F.col("__f.hash").alias("hash")).drop("__f")


def _clean(c: str) -> Column:
    return F.when(~F.isnan(c), F.col(c))


def expectation(rows: DataFrame, domain: str, columns: list[str]) -> DataFrame:
    """(columns, domains): per domain the best probability of every class, summed; one row."""
    best = rows.groupBy(domain).agg(*[F.max(_clean(c)).alias(c) for c in columns])
    return best.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in columns], F.count(F.col(domain)).alias("domains"))


def expectation_timeline(rows: DataFrame, domain: str, step: str, columns: list[str], bins: int = 20) -> DataFrame:
    """(upto, columns, domains) at `bins` cut points: the expectation over the rows up to each.

    Rows go to the first cut that holds them and are merged there; only (domain, cut) rows are carried forward.
    """
    top = rows.agg(F.max(step)).first()[0]
    if top is None:
        return expectation(rows, domain, columns).limit(0).withColumn("upto", F.lit(0).cast("long"))
    width = max(1, int(top) // bins)
    cuts = [*range(width, int(top), width), int(top)]
    first = F.least(F.greatest(F.lit(1), F.ceil(F.col(step) / width)), F.lit(len(cuts))).cast("int")
    small_ = rows.where(F.col(domain).isNotNull()).groupBy(domain, first.alias("cut")).agg(*[F.max(_clean(c)).alias(c) for c in columns])
    w = Window.partitionBy(domain).orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)  # at most `bins` rows a domain
    run = small_.select(domain, "cut", *[F.max(c).over(w).alias(c) for c in columns], (F.coalesce(F.lead("cut").over(Window.partitionBy(domain).orderBy("cut")), F.lit(len(cuts) + 1)) - 1).alias("last"))
    at = run.select(domain, F.explode(F.sequence("cut", "last")).alias("cut"), *columns)
    sums = at.groupBy("cut").agg(*[F.sum(c).alias(c) for c in columns], F.count("*").alias("domains"))
    upto = F.element_at(F.array(*[F.lit(c).cast("long") for c in cuts]), F.col("cut"))
    return sums.select(upto.alias("upto"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns], "domains")


def value_counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"))


def count_histogram(rows: DataFrame, key: str, width: int = 5) -> DataFrame:
    """(bin, keys): how many keys have a count in each bin of `width`."""
    return value_counts(rows, key).groupBy((F.floor(F.col("n") / width) * width).alias("bin")).agg(F.count("*").alias("keys"))


def share_above(rows: DataFrame, column: str, cut: float) -> DataFrame:
    """(n, above, share)."""
    return rows.agg(F.count(column).alias("n"), F.count_if(F.col(column) > cut).alias("above")).withColumn("share", F.try_divide("above", "n"))


def describe(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, mean, std, least, most); NaN counts as missing. One pass."""
    aggs = []
    for c in columns:
        v = _clean(c)
        aggs.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("least"), F.max(v).alias("most")))
    return rows.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("r")).select("r.*")


def unique_with(rows: DataFrame, keys: list[str], column: str, cut: float) -> DataFrame:
    """Distinct values of each key among the rows whose column is above the cut."""
    return rows.where(F.col(column) > cut).where(~F.isnan(column)).agg(*[F.count_distinct(k).alias(k + "s") for k in keys])


def label_runs(runs: DataFrame, params: str, defaults: dict[str, str]) -> Column:
    """A run's label: its parameters that differ from the defaults, as text in key order."""
    d = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    entries = F.filter(F.array_sort(F.map_entries(params)), lambda e: ~F.coalesce(F.try_element_at(d, e["key"]) == e["value"], F.lit(False)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")


def group_runs(labelled: DataFrame, label: str, run: str) -> DataFrame:
    """(label, runs): the runs of every label, in order."""
    return labelled.groupBy(label).agg(F.sort_array(F.collect_list(run)).alias("runs"))


def run_band(logs: DataFrame, step: str, value: str) -> DataFrame:
    """(step, runs, mean, std, least, most, low, high): across runs, with the band of two standard deviations."""
    g = logs.groupBy(step).agg(F.count(value).alias("runs"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))
    return g.withColumn("low", F.col("mean") - 2 * F.col("std")).withColumn("high", F.col("mean") + 2 * F.col("std"))


def side_by_side(logs: DataFrame, step: str, run: str, value: str, runs: list[str]) -> DataFrame:
    """One column a run, aligned by step; steps that a run lacks are null."""
    return logs.groupBy(step).pivot(run, runs).agg(F.first(value))


def fold(key: Column, k: int) -> Column:
    """Fold of a group, the same for all its rows."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")


def split(df: DataFrame, key: Column, share: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): `share` of the keys go to the test part, by a seeded hash, the same in every run."""
    held = uniform(seed, key) < share
    return df.where(~held | key.isNull()), df.where(held)
