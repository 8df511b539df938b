"""Streams: seen addresses, domain goals, frontier, replay, model updates, statistics.

Everything runs on Structured Streaming with keyed state; each function takes and gives streaming DataFrames unless it
says otherwise. State stores need RocksDB for `transformWithStateInPandas` (`use_rocksdb`).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from crawlweave.functions.numeric import reschedule_interval


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def first_seen(links: DataFrame, key: Column, name: str = "canonical") -> DataFrame:
    """Links whose key was not in the stream before."""
    return links.withColumn(name, key).where(F.col(name).isNotNull()).dropDuplicates([name])


def unique_items(items: DataFrame, run: str = "run_id", key: str = "key") -> DataFrame:
    """Items that are new in their run."""
    return items.dropDuplicates([run, key])


class GoalCounters(StatefulProcessor):
    """Per domain: requests, relevant pages, and whether the goal is reached."""

    def __init__(self, threshold: float, max_requests: int | None, max_relevant: int | None) -> None:
        self.threshold, self.max_requests, self.max_relevant = threshold, max_requests, max_relevant

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "requests bigint, relevant bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        requests, relevant = self.counts.get() if self.counts.exists() else (0, 0)
        for pdf in rows:
            requests += len(pdf)
            relevant += int((pdf["reward"] >= self.threshold).sum())
        self.counts.update((requests, relevant))
        done = self.max_requests is not None and requests >= self.max_requests or self.max_relevant is not None and relevant >= self.max_relevant
        yield pd.DataFrame({"domain": [key[0]], "requests": [requests], "relevant": [relevant], "achieved": [bool(done)]})

    def close(self) -> None:
        pass


def domain_goals(pages: DataFrame, threshold: float = 0.1, max_requests: int | None = None, max_relevant: int | None = None) -> DataFrame:
    """(domain, requests, relevant, achieved) after every batch, from (domain, reward)."""
    return pages.groupBy("domain").transformWithStateInPandas(
        statefulProcessor=GoalCounters(threshold, max_requests, max_relevant), outputStructType="domain string, requests bigint, relevant bigint, achieved boolean", outputMode="Update", timeMode="None"
    )


class SlotQueue(StatefulProcessor):
    """Per slot: a priority queue. Rows: op `push` (seq, url, priority), `pop` (priority: how many), `close`."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "seq bigint", "url string, priority int")
        self.shut = handle.getValueState("shut", "closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Operations of a batch in the order of `op_no` where it is given. The queue is read once a batch, when something leaves it."""
        pdf = pd.concat(list(rows))
        if "op_no" in pdf:
            pdf = pdf.sort_values("op_no", kind="stable")
        out: list[tuple] = []
        heap: list[tuple] | None = None
        for op, seq, url, priority in zip(pdf["op"], pdf["seq"], pdf["url"], pdf["priority"]):
            if op != "push" and heap is None:
                heap = [(-v[1], k[0], v[0]) for k, v in self.entries.iterator()]
                heapq.heapify(heap)
            if op == "close":
                out += [(key[0], int(s), u, int(-p), "dropped") for p, s, u in sorted(heap)]
                heap = []
                self.entries.clear()
                self.shut.update((True,))
            elif op == "push":
                if self.shut.exists():
                    out.append((key[0], int(seq), url, int(priority), "rejected"))
                else:
                    self.entries.updateValue((int(seq),), (url, int(priority)))
                    if heap is not None:
                        heapq.heappush(heap, (-int(priority), int(seq), url))
            elif op == "pop":
                for _ in range(min(int(priority), len(heap))):
                    p, s, u = heapq.heappop(heap)
                    self.entries.removeKey((s,))
                    out.append((key[0], int(s), u, int(-p), "popped"))
        yield pd.DataFrame(out, columns=["slot", "seq", "url", "priority", "state"])

    def close(self) -> None:
        pass


def frontier_queues(ops: DataFrame) -> DataFrame:
    """(slot, seq, url, priority, state) of what left the queues, from (slot, op, seq, url, priority)."""
    return ops.groupBy("slot").transformWithStateInPandas(
        statefulProcessor=SlotQueue(), outputStructType="slot string, seq bigint, url string, priority int, state string", outputMode="Update", timeMode="None"
    )


class Replay(StatefulProcessor):
    """A bounded memory per model: a full one replaces a seeded random example."""

    def __init__(self, maxsize: int, seed: int) -> None:
        self.maxsize, self.seed = maxsize, seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.memory = handle.getMapState("memory", "place bigint", "t bigint, reward double")
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import numpy as np

        n = self.count.get()[0] if self.count.exists() else 0
        out = []
        for pdf in rows:
            for t, reward in zip(pdf["t"], pdf["reward"]):
                place = n if n < self.maxsize else int(np.random.default_rng((self.seed, n)).integers(self.maxsize))
                self.memory.updateValue((place,), (int(t), float(reward)))
                out.append((key[0], place, int(t), float(reward)))
                n += 1
        self.count.update((n,))
        yield pd.DataFrame(out, columns=["model", "place", "t", "reward"])

    def close(self) -> None:
        pass


def replay_memory(examples: DataFrame, maxsize: int, seed: int = 1) -> DataFrame:
    """(model, place, t, reward): where each example of (model, t, reward) was put."""
    return examples.groupBy("model").transformWithStateInPandas(
        statefulProcessor=Replay(maxsize, seed), outputStructType="model string, place bigint, t bigint, reward double", outputMode="Update", timeMode="None"
    )


def crawl_statistics(pages: DataFrame) -> DataFrame:
    """Running totals of the crawl (complete mode): (pages, reward, average, domains)."""
    return pages.agg(F.count("*").alias("pages"), F.coalesce(F.sum("reward"), F.lit(0.0)).alias("reward"), F.avg("reward").alias("average"), F.approx_count_distinct("domain").alias("domains"))


def windowed_counts(events: DataFrame, ts: str, late: str, size: str, *keys: str) -> DataFrame:
    """Counts per time window with a watermark for late rows; NTZ timestamps are taken as UTC."""
    at = F.col(ts).cast("timestamp")
    return events.withColumn(ts, at).withWatermark(ts, late).groupBy(F.window(ts, size), *keys).agg(F.count("*").alias("n"))


def _counters_path(spark: SparkSession, checkpoint: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}-counters")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _load_counters(spark: SparkSession, checkpoint: str) -> dict:
    path, fs = _counters_path(spark, checkpoint)
    if not fs.exists(path):
        return {}
    rows = [json.loads(r[0]) for r in spark.read.text(path.toString()).collect()]  # a few bytes a batch, the last two kept
    return max(rows, key=lambda r: r["epoch"], default={})


def _save_counters(spark: SparkSession, checkpoint: str, state: dict) -> None:
    path, fs = _counters_path(spark, checkpoint)
    spark.createDataFrame([(json.dumps(state),)], "c string").coalesce(1).write.mode("overwrite").text(f"{path.toString()}/epoch={state['epoch']}")
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path.toString()}/epoch={state['epoch'] - 2}")
    fs.delete(old, True)


def learn(batches: DataFrame, fit: Callable[[DataFrame, int], None], checkpoint: str, switch: Callable[[int], None] | None = None, steps_before_switch: int = 100, entries: Callable[[], int] | None = None):
    """Start the learning loop: `fit` gets every micro-batch; `switch` runs when the target model is to be replaced.

    The counters lie beside the checkpoint, so a restarted loop goes on counting.
    With `entries` (queue size) the switch is put off until the interval that keeps re-scoring within its share of time.
    """
    spark = batches.sparkSession
    state = {"t": 0, "wait": 0, "epoch": -1} | _load_counters(spark, checkpoint)

    def step(df: DataFrame, epoch: int) -> None:
        n = df.count()
        if not n or epoch <= state["epoch"]:  # a batch that is repeated after a failure counts once
            return
        before = state["t"] // steps_before_switch
        state.update(t=state["t"] + n, wait=state["wait"] - n, epoch=epoch)
        fit(df, epoch)
        if switch and state["t"] // steps_before_switch > before and state["wait"] <= 0:
            switch(state["t"])
            if entries:
                size = df.sparkSession.range(1).select(reschedule_interval(F.lit(entries())).alias("i")).first()[0]
                state["wait"] = int(size)
        _save_counters(spark, checkpoint, state)

    return batches.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Monitor(StreamingQueryListener):
    """Keeps the progress of every batch: rows in, rows a second, batch time."""

    def __init__(self) -> None:
        self.progress: list[dict] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.progress.append({"batch": p.batchId, "rows": p.numInputRows, "rate": p.processedRowsPerSecond, "ms": p.batchDuration})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
