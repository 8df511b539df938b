"""Linear action values: scoring, temporal-difference targets, replay, learning.

Q(state, action) is linear, so it splits into a link term and a page term: each is summed once and they are added,
instead of copying the page's features to every link.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlweave.functions.common import salted_join, small
from crawlweave.functions.numeric import UNFIT_SCORE
from crawlweave.functions.rand import order_key, uniform


def linear_terms(features: DataFrame, weights: DataFrame, row_id: str) -> DataFrame:
    """(row_id, term): sum of weight times value; features without weight count 0, rows without any weight are absent."""
    met = salted_join(features, weights.select("feature", "w"), ["feature"], F.xxhash64(F.col(row_id)), "inner")  # a feature of all rows is a hot key
    return met.groupBy(row_id).agg(F.sum(F.col("w") * F.col("value")).alias("term"))


def predict(rows: DataFrame, row_id: str, features: DataFrame, weights: DataFrame, intercept: float | None, page_id: str | None = None, page_features: DataFrame | None = None) -> DataFrame:
    """`rows` with `q`. intercept None: the model is not fit and every score is 0.05."""
    if intercept is None:
        return rows.withColumn("q", F.lit(UNFIT_SCORE))
    out = rows.join(linear_terms(features, weights, row_id), row_id, "left").withColumnRenamed("term", "__link")
    if page_features is not None:
        out = out.join(linear_terms(page_features, weights, page_id).withColumnRenamed("term", "__page"), page_id, "left")
    else:
        out = out.withColumn("__page", F.lit(0.0))
    return out.withColumn("q", F.coalesce("__link", F.lit(0.0)) + F.coalesce("__page", F.lit(0.0)) + F.lit(float(intercept))).drop("__link", "__page")


def best_links(scored: DataFrame, page: str, score: str, pos: str) -> DataFrame:
    """(page, best pos, best score): the best link of a page, the first on ties; merged map-side."""
    top = F.max_by(F.struct(F.col(pos).alias("pos"), F.col(score).alias("q")), F.struct(F.col(score), -F.col(pos)))
    return scored.groupBy(page).agg(top.alias("b")).select(page, F.col("b.pos").alias("best_pos"), F.col("b.q").alias("best_q"))


def td_targets(experience: DataFrame, scored: DataFrame, page: str, pos: str, online: str, target: str | None, gamma: float = 0.4) -> DataFrame:
    """`experience` (page, reward) with `q_next` and `y = reward + gamma q_next`.

    Double learning: the online score picks the link, the target score values it; with target None the online maximum
    counts. Pages without links have q_next 0.
    """
    value = F.col(target) if target else F.col(online)
    top = scored.groupBy(page).agg(F.max_by(value, F.struct(F.col(online), -F.col(pos))).alias("q_next"))
    out = experience.join(top, page, "left").withColumn("q_next", F.coalesce("q_next", F.lit(0.0)))
    return out.withColumn("y", F.col("reward") + F.lit(float(gamma)) * F.col("q_next"))


def weight_norm(weights: DataFrame) -> DataFrame:
    """(norm): length of the weight vector, 0 for an empty one."""
    return weights.agg(F.coalesce(F.sqrt(F.sum(F.col("w") * F.col("w"))), F.lit(0.0)).alias("norm"))


def replay_sample(memory: DataFrame, k: int, seed: str, row_id: str) -> DataFrame:
    """min(k, n) examples, each set of them equally likely: the first in the seeded shuffle (top-k, no full sort)."""
    return memory.orderBy(order_key(seed, F.col(row_id)), row_id).limit(k)


def replay_memory(stream: DataFrame, maxsize: int, seed: str, row_id: str, t: str) -> DataFrame:
    """The memory after all of `stream` went through random replacement with room for `maxsize`.

    Each arrival after the memory is full takes the place of slot floor(u * maxsize); a slot holds its latest arrival.
    So the memory is the last example of every slot: one groupBy with map-side merging instead of a serial loop.
    """
    place = F.when(F.col(t) <= maxsize, F.col(t) - 1).otherwise(F.floor(uniform(seed, F.col(row_id)) * maxsize))
    row = F.struct(*[F.col(c) for c in stream.columns])
    return stream.groupBy(place.cast("long").alias("place")).agg(F.max_by(row, F.col(t)).alias("r")).select("place", "r.*")


def sync_steps(t: Column, every: int = 100) -> Column:
    """How often the target model was replaced up to step t."""
    return F.floor(t / every).cast("long")


#: Most examples of one ordered pass.
SGD_ROWS = 100_000


def sgd(examples: DataFrame, order: str, eta: float = 0.1, alpha: float = 1e-6, l1: bool = False) -> DataFrame:
    """(feature, w): one ordered pass of squared-loss steps with a constant rate over (order, y, features map).

    The steps depend on each other, so this is one group by nature; its size is the replay sample. More than 100,000
    examples are refused: `gradient_step` takes any number.
    """
    if examples.limit(SGD_ROWS + 1).count() > SGD_ROWS:
        raise ValueError("too many examples for one ordered pass; draw a replay sample or use gradient_step")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w: dict[str, float] = {}
        b, scale = 0.0, 1.0
        for y, f in zip(pdf.sort_values(order)["y"], pdf.sort_values(order)["features"]):
            items = list(dict(f).items())
            err = scale * sum(w.get(k, 0.0) * v for k, v in items) + b - y
            if l1:
                for k, v in items:
                    g = w.get(k, 0.0) - eta * err * v
                    w[k] = np.sign(g) * max(0.0, abs(g) - eta * alpha)
            else:
                scale *= 1 - eta * alpha
                for k, v in items:
                    w[k] = w.get(k, 0.0) - eta * err * v / scale
            b -= eta * err
        names = ["(intercept)", *w]
        return pd.DataFrame({"feature": names, "w": [b, *(float(scale * x) for x in w.values())]})

    return examples.groupBy().applyInPandas(run, "feature string, w double")


def gradient_step(examples: DataFrame, features: DataFrame, row_id: str, weights: DataFrame, intercept: float, eta: float = 0.1, alpha: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """One distributed mini-batch step: (weights, (intercept)). The gradient is a join and a sum, of any size."""
    scored = predict(examples, row_id, features, weights, intercept)
    err = scored.select(row_id, (F.col("q") - F.col("y")).alias("e"))
    n = F.lit(float(max(1, examples.count())))
    grad = features.join(err, row_id).groupBy("feature").agg((F.sum(F.col("e") * F.col("value")) / n).alias("g"))
    new = weights.select("feature", "w").join(grad, "feature", "full").select("feature", (F.coalesce("w", F.lit(0.0)) * (1 - eta * alpha) - eta * F.coalesce("g", F.lit(0.0))).alias("w"))
    return new, err.agg((F.lit(intercept) - eta * F.coalesce(F.avg("e"), F.lit(0.0))).alias("intercept"))


def credit_table(spark, gamma: float = 0.4, steps: int = 10) -> DataFrame:
    """(n, credit): percent of a reward that reaches the n-th step before it."""
    return spark.range(steps).select(F.col("id").alias("n"), (100 * F.pow(F.lit(float(gamma)), F.col("id"))).alias("credit"))


def link_count(memory: DataFrame, choices: str) -> DataFrame:
    """(links): links held in the replay memory."""
    return memory.agg(F.coalesce(F.sum(F.greatest(F.size(choices), F.lit(0))), F.lit(0)).cast("long").alias("links"))


def informative(weights: DataFrame, n: int) -> DataFrame:
    """(feature, w, sign, rank): the n largest positive and the n smallest negative weights."""
    pos = weights.where("w > 0").orderBy(F.desc("w"), "feature").limit(n).withColumn("sign", F.lit("+"))
    neg = weights.where("w < 0").orderBy("w", "feature").limit(n).withColumn("sign", F.lit("-"))
    w = Window.partitionBy("sign").orderBy(F.desc(F.abs("w")), "feature")
    return pos.unionByName(neg).withColumn("rank", F.row_number().over(w).cast("long"))


def contributions(features: DataFrame, weights: DataFrame, row_id: str, n: int) -> DataFrame:
    """(row_id, feature, part, rank): the n features that move a row's score the most."""
    parts = features.join(small(weights), "feature").select(row_id, "feature", (F.col("w") * F.col("value")).alias("part"))
    w = Window.partitionBy(row_id).orderBy(F.desc(F.abs("part")), "feature")
    return parts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def experience(pages: DataFrame, is_seed: Column, is_text: Column, reward: Column) -> DataFrame:
    """Pages to learn from, with `reward` and `has_choices`: seeds teach nothing; a page without text teaches reward 0
    and offers no links."""
    rows = pages.where(~is_seed)
    return rows.withColumn("reward", F.when(is_text, F.coalesce(reward, F.lit(0.0))).otherwise(F.lit(0.0))).withColumn("has_choices", is_text)


def sync_target(weights: DataFrame) -> DataFrame:
    """(model, feature, w) with the target model as a copy of the online one."""
    online = weights.where("model = 'online'")
    return online.unionByName(online.withColumn("model", F.lit("target")))


def text_regressor(text: str, label: str, features: int = 1 << 18, ngram: int = 2):
    """Baseline: hashed 1- to n-grams and a linear regression; an unfitted ML pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import HashingTF, NGram, SQLTransformer, RegexTokenizer
    from pyspark.ml.regression import LinearRegression

    from crawlweave.functions.text import TOKEN

    stages = [RegexTokenizer(inputCol=text, outputCol="w1", pattern=TOKEN, gaps=False, toLowercase=True)]
    stages += [NGram(n=n, inputCol="w1", outputCol=f"w{n}") for n in range(2, ngram + 1)]
    stages.append(SQLTransformer(statement=f"SELECT *, concat({', '.join(f'w{n}' for n in range(1, ngram + 1))}) AS grams FROM __THIS__"))
    stages += [HashingTF(inputCol="grams", outputCol="features", numFeatures=features), LinearRegression(labelCol=label, regParam=1e-4, maxIter=20)]
    return Pipeline(stages=stages)
