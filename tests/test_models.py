import pytest
from pyspark.sql import functions as F

from crawlweave.operators import evaluation as E
from crawlweave.operators import features as X
from crawlweave.operators import goals as G
from crawlweave.operators import qmodel as Z
from crawlweave.sources import tables as S


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, "good awesome decent page" if i % 2 else "bad awful broken page", float(i % 2)) for i in range(40)]
    return spark.createDataFrame(rows, "id int, text string, label double")


def test_topics_and_their_words(texts):
    model = X.topics(texts, "text", n_topics=2, vocabulary=50, min_df=1, iterations=5)
    shares = model.transform(texts).select("topics").first()[0]
    assert sum(shares) == pytest.approx(1.0)
    words = X.topic_words(model, 3).collect()
    assert {r.topic for r in words} == {0, 1} and max(r["rank"] for r in words) == 3 and all(r.weight > 0 for r in words)
    assert "the" in X.stop_words() and "und" in X.stop_words()


def test_registered_topics_use_the_whole_job(monkeypatch):
    from unittest.mock import MagicMock

    from crawlweave.plans import learn_queries as L

    seen = {}

    def stop(docs, text, **k):
        seen.update(k)
        raise StopIteration

    monkeypatch.setattr(X, "topics", stop)
    monkeypatch.setattr(L, "table", MagicMock())
    with pytest.raises(StopIteration):
        L.lda_topics(None, "")
    assert seen == {}


def test_every_document_is_drawn(texts):
    lda = X.topics(texts, "text", n_topics=2, vocabulary=50, min_df=1, iterations=2).stages[3]
    assert lda.getOrDefault("subsamplingRate") == 1.0


def test_text_regressor_and_classifier_by_path(spark, texts, tmp_path):
    model = Z.text_regressor("text", "label", 1 << 10).fit(texts)
    got = {r.id: r.prediction for r in model.transform(texts).collect()}
    assert got[1] > 0.9 and got[0] < 0.1
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, Tokenizer

    Pipeline(stages=[Tokenizer(inputCol="text", outputCol="w"), HashingTF(inputCol="w", outputCol="features", numFeatures=256), LogisticRegression()]).fit(texts).write().overwrite().save(str(tmp_path / "m"))
    clf = S.load_classifier(str(tmp_path / "m"))
    reward = {r.id: r.reward for r in G.classifier_goal(clf, threshold=0.5).reward(clf.transform(texts)).collect()}
    assert reward[1] > 0.5 > reward[0]


def test_sync_and_experience(spark):
    w = spark.createDataFrame([("online", "a", 1.0), ("target", "b", 2.0)], "model string, feature string, w double")
    assert sorted(tuple(r) for r in Z.sync_target(w).collect()) == [("online", "a", 1.0), ("target", "a", 1.0)]
    pages = spark.createDataFrame([(1, True, True, 0.9), (2, False, False, 0.9), (3, False, True, 0.4), (4, False, True, None)], "id int, seed boolean, text boolean, r double")
    got = {r.id: (r.reward, r.has_choices) for r in Z.experience(pages, F.col("seed"), F.col("text"), F.col("r")).collect()}
    assert got == {2: (0.0, False), 3: (0.4, True), 4: (0.0, True)}


def test_linear_scores_split_into_link_and_page_terms(spark):
    links = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "link string, page int")
    lf = spark.createDataFrame([("a", "x", 2.0), ("b", "unknown", 1.0)], "link string, feature string, value double")
    pf = spark.createDataFrame([(1, "p", 1.0)], "page int, feature string, value double")
    w = spark.createDataFrame([("x", 0.5), ("p", 0.25)], "feature string, w double")
    got = {r.link: r.q for r in Z.predict(links, "link", lf, w, 0.1, "page", pf).collect()}
    assert got == {"a": pytest.approx(1.35), "b": pytest.approx(0.35), "c": pytest.approx(0.1)}
    long = X.join_page(lf, links, pf, "link", "page")
    flat = {r.link: r.q for r in Z.predict(links, "link", long, w, 0.1).collect()}
    assert flat == got


def test_evaluation_of_nested_forms(spark):
    pages = spark.createDataFrame([(1, [({"login": 0.9}, "h1"), (None, "h2")]), (2, None), (3, [])], "page_id int, forms array<struct<form:map<string,double>,hash:string>>")
    flat = E.flatten_forms(pages)
    assert flat.count() == 2
    wide = E.spread_forms(flat, {"login": "login", "search": "search"})
    assert sorted(((r.login, r.search) for r in wide.collect()), key=str) == [(0.9, 0.0), (None, None)]


def test_timeline_ends_with_the_expectation(spark):
    rows = [("a", k, 0.1 * (k % 7)) for k in range(1, 101)] + [("b", 60, 0.9), (None, 61, 1.0)]
    df = spark.createDataFrame(rows, "domain string, req_id int, p double")
    line = E.expectation_timeline(df, "domain", "req_id", ["p"], 10).orderBy("upto").collect()
    assert len(line) == 10 and line[-1].upto == 100 and line[-1].p == pytest.approx(1.5) and line[4].domains == 1
    assert E.expectation_timeline(df.limit(0), "domain", "req_id", ["p"]).count() == 0


def test_params(spark, tmp_path):
    S.write_params(spark, {"eps": 0.2}, str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).first()[0] == '{"eps": 0.2}'
