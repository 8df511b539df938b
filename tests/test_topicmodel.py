import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import LDA
from pyspark.ml.functions import vector_to_array

from crawlweave.operators import features as X
from crawlweave.operators import topicmodel as TM

AREAS = ["harbour ship sailor anchor mast", "oven bread flour yeast crust", "goal striker referee league penalty"]


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(AREAS[i % 3].split()) for _ in range(5 + r.randrange(20)))) for i in range(300)]
    return spark.createDataFrame([*rows, (300, ""), (301, "unseen"), (302, None)], "id int, text string")


@pytest.fixture(scope="module")
def model(texts):
    return X.topics(texts, "text", n_topics=3, vocabulary=50, min_df=2)


def test_texts_are_read_twice_whatever_the_iterations(spark, texts):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    X.topics(texts.mapInArrow(count, texts.schema), "text", n_topics=2, vocabulary=50, min_df=2, iterations=6)
    assert read.value <= 2 * texts.count()  # for the vocabulary, for the counts


def test_shares_are_those_of_spark(texts, model):
    got = {r.id: r.topics for r in X.topic_shares(model, texts.where("text is not null"), "text").collect()}
    want = {r.id: r.t for r in model.transform(texts.where("text is not null")).select("id", vector_to_array("topics").alias("t")).collect()}
    assert got.keys() == want.keys() and len(got) == 302
    assert max(np.abs(np.subtract(got[k], want[k])).max() for k in want) < 2e-3
    assert got[300] == got[301] == [0, 0, 0] and all(sum(got[i]) == pytest.approx(1) for i in range(300))
    assert {r.id: r.topics for r in X.topic_shares(model).collect()} == got
    best = [{int(np.argmax(got[i])) for i in range(300) if i % 3 == k} for k in range(3)]
    assert sorted(map(sorted, best)) == [[0], [1], [2]]


def test_fit_is_as_good_as_that_of_spark(texts, model):
    counts = PipelineModel(model.stages[:3]).transform(texts.where("text is not null")).select("counts").cache()
    spark_fit = LDA(featuresCol="counts", k=3, maxIter=20, optimizer="online", subsamplingRate=1.0, learningOffset=10.0, learningDecay=0.7, seed=1).fit(counts)
    assert model.stages[3].logPerplexity(counts) == pytest.approx(spark_fit.logPerplexity(counts), rel=0.05)
    assert model.stages[3].estimatedDocConcentration().toArray() == pytest.approx(spark_fit.estimatedDocConcentration().toArray(), rel=0.5)


def test_shares_don_t_depend_on_the_documents_beside(model):
    beta, rng = model.stages[3].word_weights, np.random.default_rng(1)
    docs = [rng.choice(len(beta), rng.integers(1, len(beta)), replace=False) for _ in range(200)]
    alpha, start = np.full(3, 0.1), np.ones(3)

    def run(some):
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in some])])
        out = np.zeros((len(some), 3))
        words = np.concatenate(some).astype(np.int32)
        for rows, gamma, *_ in TM.infer(beta, alpha, start, words, np.ones(len(words), np.float32), offsets, np.arange(len(some))):
            out[rows] = gamma
        return out

    alone = np.concatenate([run([d]) for d in docs])
    assert run(docs) == pytest.approx(alone, rel=1e-3, abs=1e-3) and alone.sum(1) == pytest.approx([0.3 + len(d) for d in docs], rel=1e-4)


def test_fit_of_no_words_and_saved_model(spark, texts, model, tmp_path):
    empty = X.topics(spark.createDataFrame([(1, "one two")] * 4 + [(2, "")], "id int, text string"), "text", n_topics=2, vocabulary=5, min_df=4, iterations=1)
    assert X.topic_shares(empty).count() == 5
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    rows = texts.where("id < 20")
    a, b = ({r.id: r.topics for r in X.topic_shares(m, rows, "text").collect()} for m in (model, again))
    assert all(a[k] == pytest.approx(b[k], abs=1e-6) for k in a)
    assert again.stages[3].getMaxIter() == 20


def test_an_iteration_without_draws_doesn_t_end_the_fit(spark, monkeypatch):
    weights, calls = TM.word_weights, []
    monkeypatch.setattr(TM, "word_weights", lambda lam: calls.append(1) or weights(lam))
    X.topics(spark.createDataFrame([(1, "one two")], "id int, text string"), "text", n_topics=2, vocabulary=5, min_df=1, iterations=12)
    assert len(calls) == 13  # one an iteration, one for the model
