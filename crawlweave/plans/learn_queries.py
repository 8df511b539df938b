"""Queries on models, rewards and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from crawlweave.functions import numeric as N
from crawlweave.functions.common import table
from crawlweave.functions.rand import uniform as unit
from crawlweave.operators import goals as G
from crawlweave.operators import metrics as M
from crawlweave.operators import qmodel as Q
from crawlweave.plans.catalogue import query, uniform

# --- links of pages with two hashed scores -------------------------------------------------------------------------

SCORED = f"(SELECT page_url, link_id, {uniform('online', 'link_id')} AS q_online, {uniform('target', 'link_id')} AS q_target FROM links)"
EXPERIENCE = "(SELECT node_id, url AS page_url, coalesce(reward, 0.0) AS reward FROM nodes)"


def scored(spark, d):
    l = table(spark, d, "links")
    return l.select("page_url", "link_id", unit("online", F.col("link_id")).alias("q_online"), unit("target", F.col("link_id")).alias("q_target"))


def experience(spark, d):
    return table(spark, d, "nodes").select("node_id", F.col("url").alias("page_url"), F.coalesce("reward", F.lit(0.0)).alias("reward"))


@query(f"SELECT page_url, link_id AS best_pos, round(q_online, 6) AS best_q FROM (SELECT *, row_number() OVER (PARTITION BY page_url ORDER BY q_online DESC, link_id) AS rn FROM {SCORED}) WHERE rn = 1")
def best_link(spark, d):
    """The best link of every page."""
    b = Q.best_links(scored(spark, d), "page_url", "q_online", "link_id")
    return b.select("page_url", "best_pos", F.round("best_q", 6).alias("best_q"))


@query(f"SELECT node_id, round(reward + 0.4 * coalesce(q, 0.0), 6) AS y FROM {EXPERIENCE} LEFT JOIN (SELECT page_url, q_target AS q FROM (SELECT *, row_number() OVER (PARTITION BY page_url ORDER BY q_online DESC, link_id) AS rn FROM {SCORED}) WHERE rn = 1) USING (page_url)")
def td_target_double(spark, d):
    """Targets with double learning."""
    return Q.td_targets(experience(spark, d), scored(spark, d), "page_url", "link_id", "q_online", "q_target").select("node_id", F.round("y", 6).alias("y"))


@query(f"SELECT node_id, round(reward + 0.4 * coalesce(q, 0.0), 6) AS y FROM {EXPERIENCE} LEFT JOIN (SELECT page_url, max(q_online) AS q FROM {SCORED} GROUP BY 1) USING (page_url)")
def td_target_vanilla(spark, d):
    """Targets with the online maximum."""
    return Q.td_targets(experience(spark, d), scored(spark, d), "page_url", "link_id", "q_online", None).select("node_id", F.round("y", 6).alias("y"))


@query("SELECT vec_id, round(0.25 + sum(v * (f - 31.5) / 100), 4) AS q FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS f FROM embeddings) GROUP BY 1")
def linear_score(spark, d):
    """Linear scores of dense rows: features joined with weights."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    feats = e.select("vec_id", (F.col("k") + 1).cast("string").alias("feature"), F.col("v").cast("double").alias("value"))
    weights = spark.range(1, 65).select(F.col("id").cast("string").alias("feature"), ((F.col("id") - 31.5) / 100).alias("w"))
    return Q.predict(table(spark, d, "embeddings").select("vec_id"), "vec_id", feats, weights, 0.25).select("vec_id", F.round("q", 4).alias("q"))


@query(f"SELECT round(sqrt(sum(w * w)), 6) AS norm FROM (SELECT {uniform('w', 'link_id')} - 0.5 AS w FROM links)")
def weight_norm(spark, d):
    w = table(spark, d, "links").select((unit("w", F.col("link_id")) - 0.5).alias("w"))
    return Q.weight_norm(w).select(F.round("norm", 6).alias("norm"))


@query("SELECT node_id, reward FROM nodes ORDER BY md5('r:' || node_id), node_id LIMIT 300")
def replay_sample_seeded(spark, d):
    """A sample of the replay memory."""
    return Q.replay_sample(table(spark, d, "nodes").select("node_id", "reward"), 300, "r", "node_id")


@query(f"WITH s AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS t FROM events), p AS (SELECT event_id, t, CASE WHEN t <= 500 THEN t - 1 ELSE floor({uniform('m', 'event_id')} * 500)::BIGINT END AS place FROM s) SELECT place, arg_max(event_id, t) AS event_id FROM p GROUP BY 1")
def replay_memory_final(spark, d):
    """The replay memory of size 500 after all events."""
    from crawlweave.sources.tables import numbered

    e = numbered(table(spark, d, "events").select("event_id"), "event_id", "t")
    return Q.replay_memory(e, 500, "m", "event_id", "t").select("place", "event_id")


@query("SELECT n AS n, 100 * pow(0.4, n) AS credit FROM range(10) r(n)".replace("100 * pow(0.4, n)", "round(100 * pow(0.4, n), 6)"))
def gamma_credit_table(spark, d):
    """How far a reward reaches back."""
    return Q.credit_table(spark).select("n", F.round("credit", 6).alias("credit"))


@query("SELECT sum(n)::BIGINT AS links FROM (SELECT len(list_distinct(list(link.url))) AS n FROM edges GROUP BY src)")
def replay_link_count(spark, d):
    """Links in the replay memory."""
    from crawlweave.operators.graph import choices

    return choices(table(spark, d, "edges")).agg(F.count("*").alias("links"))


_WT = f"(SELECT DISTINCT url AS feature, round({uniform('i', 'url')} - 0.5, 9) AS w FROM links WHERE url IS NOT NULL)"


@query(f"WITH w AS {_WT}, t AS (SELECT * FROM (SELECT feature, w, '+' AS sign FROM w WHERE w > 0 ORDER BY w DESC, feature LIMIT 20) UNION ALL SELECT * FROM (SELECT feature, w, '-' FROM w WHERE w < 0 ORDER BY w, feature LIMIT 20)) SELECT feature, w, sign, (row_number() OVER (PARTITION BY sign ORDER BY abs(w) DESC, feature))::BIGINT AS rank FROM t")
def informative_features(spark, d):
    """The largest positive and negative weights."""
    w = table(spark, d, "links").where("url is not null").select(F.col("url").alias("feature")).distinct()
    return Q.informative(w.withColumn("w", F.round(unit("i", F.col("feature")) - 0.5, 9)), 20).select("feature", "w", "sign", "rank")


@query("SELECT floor(t / 100)::BIGINT AS syncs, count(*)::BIGINT AS n FROM nodes WHERE t IS NOT NULL GROUP BY 1")
def target_syncs(spark, d):
    """Replacements of the target model up to every step."""
    return table(spark, d, "nodes").where("t is not null").groupBy(Q.sync_steps(F.col("t")).alias("syncs")).agg(F.count("*").alias("n"))


# --- unique items --------------------------------------------------------------------------------------------------


@query(
    """WITH f AS (SELECT l_orderkey % 7 AS run, l_partkey AS k, arg_min(l_orderkey, l_orderkey * 10 + l_linenumber) AS page FROM lineitem GROUP BY 1, 2), n AS (SELECT run, page, count(*) AS n FROM f GROUP BY 1, 2)
    SELECT p.run AS run_id, p.page AS page_id, (coalesce(n.n, 0) - 1.0)::DOUBLE AS reward FROM (SELECT DISTINCT l_orderkey % 7 AS run, l_orderkey AS page FROM lineitem) p LEFT JOIN n USING (run, page)"""
)
def item_unique_reward(spark, d):
    """Rewards of pages by the items that are new in their run."""
    l = table(spark, d, "lineitem").select((F.col("l_orderkey") % 7).alias("run_id"), F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("page_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return G.ExtractionGoal().reward(l).select("run_id", "page_id", "reward")


@query("SELECT l_partkey AS key, min(l_orderkey * 10 + l_linenumber)::BIGINT AS seq FROM lineitem GROUP BY 1")
def item_export_unique(spark, d):
    """The first item of every key, across runs."""
    l = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    return G.unique_items(l).select("key", "seq")


# --- metrics -------------------------------------------------------------------------------------------------------

PAIRS = f"(SELECT node_id, round(reward, 4) AS truth, round({uniform('g', 'node_id')}, 4) AS guess FROM nodes WHERE reward IS NOT NULL)"


def pairs(spark, d):
    n = table(spark, d, "nodes").where("reward is not null")
    return n.select("node_id", F.round("reward", 4).alias("truth"), F.round(unit("g", F.col("node_id")), 4).alias("guess"))


def _dcg(score: str, gain: str) -> str:
    return f"(SELECT sum(({gain}) / log2(rank + 1)) FROM (SELECT truth, row_number() OVER (ORDER BY {score} DESC, node_id DESC) AS rank FROM {PAIRS}) WHERE rank <= 100)"


@query(f"SELECT round({_dcg('guess', 'pow(2.0, truth) - 1')} / {_dcg('truth', 'pow(2.0, truth) - 1')}, 6) AS ndcg")
def ndcg_at_k(spark, d):
    """Ranking quality of the guesses at 100."""
    return M.ndcg(pairs(spark, d), "truth", "guess", 100, "node_id").select(F.round("ndcg", 6).alias("ndcg"))


@query(f"SELECT round({_dcg('guess', 'truth')}, 6) AS dcg")
def dcg_linear(spark, d):
    """Discounted gain with linear gains."""
    return M.dcg(pairs(spark, d), "truth", "guess", 100, "node_id", "linear").select(F.round("dcg", 6).alias("dcg"))


@query(f"SELECT count(*)::BIGINT AS n, round(sqrt(avg((guess - truth) * (guess - truth))), 6) AS rmse, round(avg(abs(guess - truth)), 6) AS mae FROM {PAIRS}")
def rescoring_drift(spark, d):
    """How far scores moved."""
    return M.drift(pairs(spark, d), "truth", "guess").select("n", F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"))


@query(f"SELECT k::DOUBLE AS threshold, count_if(abs(guess - truth) > k)::BIGINT AS changed, round(count_if(abs(guess - truth) > k) / count(*), 6) AS share FROM {PAIRS}, (SELECT unnest([0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5]::DOUBLE[]) AS k) GROUP BY 1")
def threshold_changes(spark, d):
    """Scores that moved by more than each threshold."""
    return M.change_counts(pairs(spark, d), "truth", "guess").select("threshold", "changed", F.round("share", 6).alias("share"))


@query(f"SELECT round(avg(e * e), 6) AS mse, round(sum(w * e * e) / sum(w), 6) AS weighted, round(avg(truth * truth), 6) AS zero, round(var_pop(truth), 6) AS mean FROM (SELECT truth, guess - truth AS e, CASE WHEN truth > 0.5 THEN 10.0 ELSE 1.0 END AS w FROM {PAIRS})")
def weighted_mse(spark, d):
    """Errors of the guesses and of the two plain guesses."""
    return M.weighted_mse(pairs(spark, d), "truth", "guess").select(*[F.round(c, 6).alias(c) for c in ("mse", "weighted", "zero", "mean")])


@query(f"SELECT truth > 0.2 AS truth, guess > 0.5 AS guess, count(*)::BIGINT AS n FROM {PAIRS} GROUP BY 1, 2")
def confusion_matrix(spark, d):
    return M.confusion(pairs(spark, d), F.col("truth") > 0.2, F.col("guess") > 0.5)


@query(f"SELECT round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(ok / n, 6) AS accuracy FROM (SELECT count_if(a AND b) AS tp, count_if(NOT a AND b) AS fp, count_if(a AND NOT b) AS fn, count_if(a = b) AS ok, count(*) AS n FROM (SELECT truth > 0.2 AS a, guess > 0.5 AS b FROM {PAIRS}))")
def class_report(spark, d):
    """Precision, recall, F1 and accuracy."""
    return M.class_report(pairs(spark, d), F.col("truth") > 0.2, F.col("guess") > 0.5).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


_CURVE = f"(SELECT guess AS score, sum(count_if(truth > 0.2)) OVER (ORDER BY guess DESC) AS tp, sum(count_if(NOT truth > 0.2)) OVER (ORDER BY guess DESC) AS fp, sum(count_if(truth > 0.2)) OVER () AS pos FROM {PAIRS} GROUP BY 1)"


@query(f"SELECT score, round(tp / (tp + fp), 6) AS precision, round(tp / pos, 6) AS recall FROM {_CURVE}")
def precision_recall_curve(spark, d):
    return M.precision_recall(pairs(spark, d), F.col("truth") > 0.2, "guess").select("score", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query(f"SELECT round(sum(CASE WHEN a.guess > b.guess THEN 1.0 WHEN a.guess = b.guess THEN 0.5 ELSE 0 END) / count(*), 6)::DOUBLE AS auc FROM {PAIRS} a, {PAIRS} b WHERE a.truth > 0.2 AND NOT b.truth > 0.2")
def roc_auc(spark, d):
    """Area under the ROC curve."""
    return M.roc_auc(pairs(spark, d), F.col("truth") > 0.2, "guess").select(F.round("auc", 6).alias("auc"))


@query(f"SELECT node_id, round(-(t * ln(guess + 1e-8) + (1 - t) * ln(1 - guess + 1e-8)), 6) AS entropy, round((guess - truth) * (guess - truth), 6) AS squared, round(greatest(guess - 0.3, 0.0), 6) AS clipped FROM (SELECT *, CASE WHEN truth > 0.2 THEN 1.0 ELSE 0.0 END AS t FROM {PAIRS})")
def row_errors(spark, d):
    """Cross entropy, squared error and clipping per row."""
    p = pairs(spark, d)
    t, g = F.when(F.col("truth") > 0.2, 1.0).otherwise(0.0), F.col("guess")
    return p.select("node_id", F.round(N.cross_entropy(t, g), 6).alias("entropy"), F.round(N.squared_error(F.col("truth"), g), 6).alias("squared"), F.round(N.clip0(g - 0.3), 6).alias("clipped"))


@query(None)
def sgd_weights(spark, d):
    """One ordered pass of learning over a replay sample of named features."""
    from crawlweave.operators.features import char_features
    from crawlweave.functions.text import squash

    sample = Q.replay_sample(table(spark, d, "nodes").where("reward is not null").select("node_id", "url", "reward"), 300, "r", "node_id")
    f = char_features(sample, "node_id", squash(F.col("url")), "url", 4, 4).groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "value"))).alias("features"))
    return Q.sgd(sample.join(f, "node_id").select("node_id", F.col("reward").alias("y"), "features"), "node_id")


@query(None)
def lda_topics(spark, d):
    """Topic shares of every document, summing to 1."""
    from crawlweave.operators.features import topic_shares, topics

    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return topic_shares(topics(docs, "text")).select("doc_id", F.transform("topics", lambda x: F.round(x, 4)).alias("topics"))


@query(None)
def classifier_reward(spark, d):
    """Probability that a document is of the biggest source, by a fitted text classifier, as reward."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, Tokenizer

    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.when(F.lower(F.trim("lang")) == "en", 1.0).otherwise(0.0).alias("label"))
    model = Pipeline(stages=[Tokenizer(inputCol="text", outputCol="words"), HashingTF(inputCol="words", outputCol="features", numFeatures=1 << 14), LogisticRegression(maxIter=10)]).fit(docs)
    return G.classifier_goal(model).reward(model.transform(docs)).select("doc_id", F.round("reward", 4).alias("reward"))
