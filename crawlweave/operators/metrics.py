"""Ranking and error metrics as plans of aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.functions.common import running_sums


def _gain(truth: str, gains: str) -> Column:
    if gains == "exponential":
        return F.pow(F.lit(2.0), F.col(truth)) - 1
    if gains == "linear":
        return F.col(truth).cast("double")
    raise ValueError("gains are exponential or linear")


def dcg(rows: DataFrame, truth: str, score: str, k: int, tie: str, gains: str = "exponential") -> DataFrame:
    """(dcg): discounted gain of the k best rows by score; of equal scores the larger `tie` comes first.

    Only the k best rows are ranked (top-k selection, no global sort), so k bounds the one-partition window.
    """
    best = rows.select(truth, score, tie).orderBy(F.desc(score), F.desc(tie)).limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc(score), F.desc(tie)))
    return best.withColumn("rank", rank).agg(F.coalesce(F.sum(_gain(truth, gains) / F.log2(F.col("rank") + 1)), F.lit(0.0)).alias("dcg"))


def ndcg(rows: DataFrame, truth: str, score: str, k: int, tie: str, gains: str = "exponential") -> DataFrame:
    """(ndcg): dcg over the best possible one; null when that is 0."""
    actual = dcg(rows, truth, score, k, tie, gains).withColumn("one", F.lit(1))
    best = dcg(rows, truth, truth, k, tie, gains).withColumnRenamed("dcg", "best").withColumn("one", F.lit(1))
    return actual.join(best, "one").select(F.try_divide("dcg", "best").alias("ndcg"))


def drift(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """(n, rmse, mae) of score changes."""
    d = F.col(new) - F.col(old)
    return pairs.agg(F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"))


def change_counts(pairs: DataFrame, old: str, new: str, thresholds=(0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5)) -> DataFrame:
    """(threshold, changed, share): how many scores changed by more than each threshold. One pass."""
    d = F.abs(F.col(new) - F.col(old))
    one = pairs.agg(F.count("*").alias("n"), *[F.count_if(d > t).alias(f"c{k}") for k, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"c{k}").alias("changed")) for k, t in enumerate(thresholds)])
    return one.select("n", F.explode(rows).alias("r")).select("r.threshold", "r.changed", F.try_divide("r.changed", "n").alias("share"))


def weighted_mse(rows: DataFrame, truth: str, guess: str, heavy: float = 10.0, cut: float = 0.5) -> DataFrame:
    """(mse, weighted, zero, mean): errors of the guess, weighted by `heavy` where the truth is above `cut`, and of guessing 0 or the mean."""
    e, w = F.col(guess) - F.col(truth), F.when(F.col(truth) > cut, heavy).otherwise(1.0)
    t = F.col(truth)
    return rows.agg(F.avg(e * e).alias("mse"), (F.sum(w * e * e) / F.sum(w)).alias("weighted"), F.avg(t * t).alias("zero"), F.var_pop(t).alias("mean"))


def confusion(rows: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """(truth, guess, n)."""
    return rows.groupBy(truth.alias("truth"), guess.alias("guess")).agg(F.count("*").alias("n"))


def class_report(rows: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """(precision, recall, f1, accuracy) of boolean columns."""
    c = rows.agg(F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count("*").alias("n"), F.count_if(truth == guess).alias("ok"))
    p, r = F.try_divide("tp", F.expr("tp + fp")), F.try_divide("tp", F.expr("tp + fn"))
    return c.select(p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"), F.try_divide("ok", "n").alias("accuracy"))


def curve_points(rows: DataFrame, truth: Column, score: str) -> DataFrame:
    """(score, p, n, tp, fp, positives, negatives) per distinct score: the cumulative counts above it.

    Rows are first counted per score; the running sums then go part by part over the sorted scores.
    """
    per = rows.groupBy(F.col(score).alias("score")).agg(F.count_if(truth).alias("p"), F.count_if(~truth).alias("n"))
    run = running_sums(per, [F.desc("score")], {"tp": F.col("p"), "fp": F.col("n")}, "curve")
    total = per.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives")).withColumn("one", F.lit(1))
    return run.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").drop("one")


def precision_recall(rows: DataFrame, truth: Column, score: str) -> DataFrame:
    """(score, precision, recall) when everything at `score` or above is taken."""
    return curve_points(rows, truth, score).select("score", F.try_divide("tp", F.expr("tp + fp")).alias("precision"), F.try_divide("tp", "positives").alias("recall"))


def roc_auc(rows: DataFrame, truth: Column, score: str) -> DataFrame:
    """(auc): area under the curve by the rank-sum over distinct scores (ties count half); null without both classes."""
    c = curve_points(rows, truth, score)
    area = F.col("n") * (2 * F.col("tp") - F.col("p")) / 2
    return c.withColumn("a", area).agg(F.try_divide(F.sum("a"), F.max(F.col("positives") * F.col("negatives"))).alias("auc"))
