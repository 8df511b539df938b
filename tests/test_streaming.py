import pytest
from pyspark.sql import functions as F

from crawlweave.functions.urls import canonical
from crawlweave.streaming import stateful as S


@pytest.fixture()
def run(spark, tmp_path):
    """Feed a table as a stream of small files and give what a plan emitted."""

    def go(df, plan, mode="append", files=3):
        S.use_rocksdb(spark)
        src = str(tmp_path / "in")
        df.repartition(files).write.mode("overwrite").parquet(src)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
        name = "out" + str(abs(hash(str(tmp_path))))
        q = plan(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return spark.table(name)

    return go


def test_first_seen_equals_batch(spark, run):
    df = spark.createDataFrame([(i, f"http://ex.com/p?a={i % 7}#{i}") for i in range(60)] + [(99, None)], "id bigint, url string")
    got = run(df, lambda s: S.first_seen(s, canonical(F.col("url"))))
    assert got.count() == 7


def test_unique_items(spark, run):
    df = spark.createDataFrame([("r1", "a"), ("r1", "a"), ("r2", "a"), ("r1", "b")], "run_id string, key string")
    assert run(df, S.unique_items).count() == 3


def test_domain_goals(spark, run):
    df = spark.createDataFrame([("a", 0.2 * (i % 2)) for i in range(10)] + [("b", 0.0)], "domain string, reward double")
    got = run(df, lambda s: S.domain_goals(s, 0.1, None, 5), "update")
    last = {r.domain: r for r in got.groupBy("domain").agg(F.max("requests").alias("requests"), F.max("relevant").alias("relevant"), F.max("achieved").alias("achieved")).collect()}
    assert (last["a"].requests, last["a"].relevant, last["a"].achieved) == (10, 5, True)
    assert (last["b"].requests, last["b"].achieved) == (1, False)


def test_frontier_queue(spark, run):
    rows = [("s", "push", 1, "a", 1), ("s", "push", 2, "b", 5), ("s", "push", 3, "c", 5), ("s", "pop", 0, None, 2), ("s", "close", 0, None, 0), ("s", "push", 4, "d", 9)]
    df = spark.createDataFrame(rows, "slot string, op string, seq bigint, url string, priority int")
    got = run(df.coalesce(1), S.frontier_queues, "update", files=1)
    assert sorted((r.seq, r.state) for r in got.collect()) == [(1, "dropped"), (2, "popped"), (3, "popped"), (4, "rejected")]


def test_replay_is_bounded(spark, run):
    df = spark.createDataFrame([("m", i, float(i)) for i in range(40)], "model string, t bigint, reward double")
    got = run(df, lambda s: S.replay_memory(s, 10), "update")
    assert got.count() == 40 and got.agg(F.count_distinct("place")).first()[0] == 10


def test_statistics_and_windows(spark, run):
    df = spark.createDataFrame([("a", 1.0, "2024-01-01 00:00:01"), ("b", 0.0, "2024-01-01 00:07:00")], "domain string, reward double, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = run(df, S.crawl_statistics, "complete")
    assert got.agg(F.max("pages"), F.max("reward")).first() == (2, 1.0)


def test_windowed_counts(spark, run):
    df = spark.createDataFrame([("2024-01-01 00:00:01",), ("2024-01-01 00:02:00",), ("2024-01-01 00:07:00",)], "ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = run(df, lambda s: S.windowed_counts(s, "ts", "1 hour", "5 minutes"), "update", files=1)
    assert sorted(r.n for r in got.collect()) == [1, 2]


def test_learning_loop(spark, tmp_path):
    df = spark.range(250).withColumnRenamed("id", "t")
    src = str(tmp_path / "in")
    df.repartition(5).write.parquet(src)
    seen, switched = [], []
    monitor = S.Monitor()
    spark.streams.addListener(monitor)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = S.learn(stream, lambda b, e: seen.append(b.count()), str(tmp_path / "cp"), switched.append, 100, lambda: 0)
    q.awaitTermination(120)
    spark.streams.removeListener(monitor)
    assert q.exception() is None and sum(seen) == 250 and len(switched) == 2
