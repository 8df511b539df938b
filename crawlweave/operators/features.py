"""Sparse features of links and pages as long tables of named features.

Names instead of hash buckets: no collisions, and a weight can be read back. Block names keep the parts apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlweave.functions import text as T
from crawlweave.functions import urls
from crawlweave.operators import topicmodel


def char_features(links: DataFrame, row_id: str, text: Column, block: str, lo: int, hi: int) -> DataFrame:
    """(row_id, feature, value): distinct character n-grams, each 1/sqrt(n), so that every row has length 1."""
    src = links.select(F.col(row_id).alias("row_id"), F.coalesce(text, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [list({t[i : i + k]: 0 for k in range(lo, hi + 1) for i in range(len(t) - k + 1)}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array([1 / math.sqrt(len(g)) if g else 0.0 for g in grams]), pa.array(grams, pa.list_(pa.string()))], ["row_id", "value", "grams"])

    kind = src.schema["row_id"].dataType.simpleString()
    got = src.mapInArrow(run, f"row_id {kind}, value double, grams array<string>")
    return got.select(F.col("row_id").alias(row_id), F.explode("grams").alias("gram"), "value").select(row_id, F.concat(F.lit(f"{block}:"), F.col("gram")).alias("feature"), "value")


def link_text_features(links: DataFrame, row_id: str) -> DataFrame:
    """Anchor text and title, character 3- to 5-grams."""
    return char_features(links, row_id, T.link_text(F.col("inside_text"), F.col("attrs")), "text", 3, 5)


def same_domain_feature(links: DataFrame, row_id: str) -> DataFrame:
    """One feature: 1 where the link stays on the domain, else 0."""
    same = F.when(F.lower(F.trim("domain_from")) == F.lower(F.trim("domain_to")), 1.0).otherwise(0.0)
    return links.select(row_id, F.lit("same_domain").alias("feature"), same.alias("value"))


def url_features(links: DataFrame, row_id: str, url: str = "url", full: bool = False, block: str = "url") -> DataFrame:
    """Path and query (or the whole canonical address), character 4- to 5-grams."""
    u = urls.canonical(F.col(url)) if full else urls.path_query(F.col(url))
    return char_features(links, row_id, u, block, 4, 5)


def page_url_features(pages: DataFrame, page_id: str, url: str, full: bool = False) -> DataFrame:
    """The page's own address, once a page."""
    return url_features(pages, page_id, url, full, "page_url")


def bag_of_words(pages: DataFrame, page_id: str, text: Column) -> DataFrame:
    """(page_id, feature, value): word counts, scaled to length 1 per page. The length comes from the same array, without a window."""
    words = pages.select(F.col(page_id), T.tokens(F.lower(text)).alias("w"))
    counts = words.select(page_id, F.explode("w").alias("feature")).groupBy(page_id, "feature").agg(F.count("*").cast("double").alias("c"))
    norm = counts.groupBy(page_id).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
    return counts.join(norm, page_id).select(page_id, "feature", (F.col("c") / F.col("n")).alias("value"))


def check_blocks(use_url: bool, use_full_url: bool, use_link_text: bool, use_same_domain: bool) -> None:
    """Exactly one address block at most, one block at least."""
    if use_url and use_full_url:
        raise ValueError("choose path features or whole-address features, not both")
    if not (use_url or use_full_url or use_link_text or use_same_domain):
        raise ValueError("no features chosen")


def link_vectors(links: DataFrame, row_id: str, use_link_text: bool = True, use_url: bool = False, use_full_url: bool = False, use_same_domain: bool = True) -> DataFrame:
    """The chosen blocks of every link, in one long table."""
    check_blocks(use_url, use_full_url, use_link_text, use_same_domain)
    parts = []
    if use_link_text:
        parts.append(link_text_features(links, row_id))
    if use_same_domain:
        parts.append(same_domain_feature(links, row_id))
    if use_url or use_full_url:
        parts.append(url_features(links, row_id, full=use_full_url))
    return reduce(DataFrame.unionByName, parts)


def join_page(link_features: DataFrame, links: DataFrame, page_features: DataFrame, row_id: str, page_id: str) -> DataFrame:
    """State beside action: every link's features with those of its page."""
    pages = links.select(row_id, page_id).join(page_features, page_id).select(row_id, "feature", "value")
    return link_features.unionByName(pages)


def topics(docs: DataFrame, text: str, n_topics: int = 50, vocabulary: int = 100_000, min_df: float = 4, iterations: int = 20, seed: int = 1):
    """Topic model of texts: stop words out, counts, online LDA, topic shares that sum to 1. Returns the fitted pipeline.

    Every iteration draws as many documents as there are, with replacement: a document is in none of n with probability
    exp(-n). Learning offset 10 and decay 0.7 let so few and large steps move the model. The fit is `topicmodel.fit`;
    `topic_shares` applies the model in the same way.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer, Normalizer, RegexTokenizer, StopWordsRemover

    stages = [
        RegexTokenizer(inputCol=text, outputCol="words", pattern=T.TOKEN, gaps=False, toLowercase=True),
        StopWordsRemover(inputCol="words", outputCol="content", stopWords=stop_words()),
        CountVectorizer(inputCol="content", outputCol="counts", vocabSize=vocabulary, minDF=min_df),
    ]
    lda = LDA(featuresCol="counts", topicDistributionCol="raw_topics", k=n_topics, maxIter=iterations, optimizer="online", subsamplingRate=1.0, learningOffset=10.0, learningDecay=0.7, seed=seed)
    texts = docs.where(F.col(text).isNotNull())
    counter = Pipeline(stages=stages).fit(texts)
    keep = [c for c, kind in docs.dtypes if c != text and kind != "void"]
    fitted = topicmodel.fit(counter.transform(texts).select(*[f"`{c}`" for c in keep], "counts"), lda, len(counter.stages[2].vocabulary))
    return PipelineModel([*counter.stages, fitted, Normalizer(inputCol="raw_topics", outputCol="topics", p=1.0)])


def topic_shares(model, docs: DataFrame | None = None, text: str = "text", name: str = "topics") -> DataFrame:
    """Documents with the topic shares of a `topics` pipeline, an array, in place of the text; without `docs` those it was fitted on, whose words are counted already."""
    from pyspark.ml import PipelineModel

    if docs is None:
        return topicmodel.shares(model.stages[3].counted, "counts", model.stages[3], name)
    counted = PipelineModel(model.stages[:3]).transform(docs)
    return topicmodel.shares(counted.select(*[c for c in docs.columns if c != text], "counts"), "counts", model.stages[3], name)


def stop_words() -> list[str]:
    """The stop words of all languages Spark has."""
    from pyspark.ml.feature import StopWordsRemover

    known = "danish dutch english finnish french german hungarian italian norwegian portuguese russian spanish swedish turkish".split()
    return sorted({w for lang in known for w in StopWordsRemover.loadDefaultStopWords(lang)})


def topic_words(model, n: int = 10, least: float = 0.0) -> DataFrame:
    """(topic, word, weight, rank) of a fitted `topics` pipeline: the n heaviest words of every topic above `least`.

    Topics times vocabulary is the model's own size, not the data's.
    """
    words = model.stages[2].vocabulary
    best = model.stages[3].describeTopics(maxTermsPerTopic=min(n, len(words)))
    flat = best.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("k", "t"))
    names = best.sparkSession.createDataFrame(list(enumerate(words)), "index int, word string")
    flat = flat.select("topic", F.col("t.termIndices").alias("index"), F.col("t.termWeights").alias("weight"), (F.col("k") + 1).cast("long").alias("rank"))
    return flat.where(F.col("weight") > least).join(names, "index").select("topic", "word", "weight", "rank")
