"""The adaptive crawl: fetched pages in, learning, the next requests out; all state in the shared folder.

A step reads the state of the last finished step, so a crawl that stops goes on where it was. Tables that grow with the
crawl (frontier, seen addresses) stay tables; what has a fixed bound (the model: 2^20 weights; one replay sample) is
worked on by the driver.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlweave.functions import urls
from crawlweave.functions.numeric import UNFIT_SCORE, score_to_priority
from crawlweave.functions.rand import order_key, uniform
from crawlweave.operators import frontier as FR
from crawlweave.operators import hashing as H
from crawlweave.operators import links as L
from crawlweave.operators.goals import Goal
from crawlweave.plans.spiders import ADAPTIVE, Settings
from crawlweave.sources.tables import SEED_PRIORITY, numbered

ACTION = "struct<buckets:array<int>,values:array<double>>"
FRONTIER = "slot string, seq long, url string, canonical string, priority int, is_seed boolean, removed boolean, from_random boolean, depth int, buckets array<int>, values array<double>"
MEMORY = f"place long, t long, reward double, action {ACTION}, choices array<{ACTION}>"


class Model:
    """Online and target weights with the number of examples learned from."""

    def __init__(self) -> None:
        self.w, self.target = np.zeros(H.BUCKETS), np.zeros(H.BUCKETS)
        self.b = self.target_b = 0.0
        self.fitted = False

    def value(self, v, target: bool = False) -> float:
        w, b = (self.target, self.target_b) if target else (self.w, self.b)
        return float(w[v.buckets] @ np.asarray(v["values"])) + b if v.buckets else b

    def fit(self, rows: list, s: Settings) -> None:
        """Squared-loss steps at a constant rate over examples (action, choices, reward), with double or plain targets."""
        for r in rows:
            best = max(r.choices or [], key=self.value, default=None)
            q_next = 0.0 if best is None or not self.fitted else self.value(best, target=s.double)
            err = self.value(r.action) - (r.reward + s.gamma * q_next)
            at, x = np.asarray(r.action.buckets, int), np.asarray(r.action["values"])
            if s.penalty == "l1":
                g = self.w[at] - s.eta * err * x
                self.w[at] = np.sign(g) * np.maximum(0.0, np.abs(g) - s.eta * s.alpha)
            else:
                self.w *= 1 - s.eta * s.alpha
                self.w[at] -= s.eta * err * x
            self.b -= s.eta * err
        self.fitted = self.fitted or bool(rows)

    def switch(self) -> None:
        self.target, self.target_b = self.w.copy(), self.b


class AdaptiveCrawl:
    """One crawl below `path` (a folder that all executors share). `step` may be called by a new object after a restart."""

    def __init__(self, spark: SparkSession, path: str, goal: Goal, settings: Settings = ADAPTIVE, seed: str = "1", batch: int = 16) -> None:
        self.spark, self.path, self.goal, self.s, self.seed, self.batch = spark, path.rstrip("/"), goal, settings, seed, batch
        self.spec = H.Hashed(settings.use_link_text, settings.use_url, settings.use_full_url, settings.use_page_url, settings.use_same_domain)
        self.model, self.t, self.n, self.next_seq = Model(), 0, -1, 1
        self._resume()

    # --- state -------------------------------------------------------------------------------------------------

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _resume(self) -> None:
        fs, p = self._fs("")
        done = [int(f.getPath().getName()[5:]) for f in fs.listStatus(p) if f.getPath().getName().startswith("done-")] if fs.exists(p) else []
        if not done:
            return
        self.n = max(done)
        meta = json.loads(self.spark.read.text(f"{self.path}/done-{self.n}").first()[0])
        self.t, self.next_seq, self.model.b, self.model.target_b, self.model.fitted = meta["t"], meta["next_seq"], meta["b"], meta["target_b"], meta["fitted"]
        for r in self._read("model").toLocalIterator():  # at most 2^20 rows
            self.model.w[r.bucket], self.model.target[r.bucket] = r.w, r.target

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/step-{self.n}/{name}")

    def _write(self, frontier: DataFrame, seen: DataFrame, memory: DataFrame, closed: DataFrame) -> None:
        at = f"{self.path}/step-{self.n + 1}"
        for name, df in (("frontier", frontier), ("seen", seen), ("memory", memory), ("closed", closed)):
            df.write.mode("overwrite").parquet(f"{at}/{name}")
        used = np.flatnonzero((self.model.w != 0) | (self.model.target != 0))
        rows = [(int(k), float(self.model.w[k]), float(self.model.target[k])) for k in used]
        self.spark.createDataFrame(rows, "bucket int, w double, target double").write.mode("overwrite").parquet(f"{at}/model")
        meta = dict(t=self.t, next_seq=self.next_seq, b=self.model.b, target_b=self.model.target_b, fitted=self.model.fitted)
        self.spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{self.path}/done-{self.n + 1}")  # last: it makes the step count
        self.n += 1
        for old in (f"step-{self.n - 2}", f"done-{self.n - 2}"):
            fs, p = self._fs(old)
            fs.delete(p, True)

    # --- the crawl ---------------------------------------------------------------------------------------------

    def start(self, seeds: DataFrame) -> DataFrame:
        """(seq, url, slot, depth, from_random) of the seeds, which are all asked for first."""
        one = seeds.select("url").distinct().withColumn("canonical", urls.canonical(F.col("url")))
        rows = numbered(one, "canonical", "seq").withColumn("slot", urls.registered_domain(F.col("url")))
        empty = self.spark.createDataFrame([], FRONTIER)
        first = rows.select("slot", "seq", "url", "canonical", F.lit(SEED_PRIORITY).alias("priority"), F.lit(True).alias("is_seed"), F.lit(True).alias("removed"), F.lit(False).alias("from_random"), F.lit(0).alias("depth"))
        frontier = empty.unionByName(first, allowMissingColumns=True)
        self._write(frontier, one.select("canonical"), self.spark.createDataFrame([], MEMORY), self.spark.createDataFrame([], "slot string"))
        self.next_seq = 1 + (self._read("frontier").agg(F.max("seq")).first()[0] or 0)
        return self._read("frontier").select("seq", "url", "slot", "depth", "from_random")

    def step(self, pages: DataFrame) -> DataFrame:
        """The next requests (seq, url, slot, depth, from_random) after fetched `pages` (seq of the request, page_id, url,
        html, status, depth, and what the goal reads).

        Pages without text or with another status than 200 teach reward 0 and offer no links. Requests with equal priority
        leave in arrival order. An empty batch only draws requests.
        """
        s, model = self.s, self.model
        frontier, memory = self._read("frontier"), self._read("memory")
        ok = F.col("html").isNotNull() & (F.col("html") != "") & (F.col("status") == 200)
        links = L.page_links(pages.where(ok), same_domain=not s.offsite).join(pages.select("page_id", "depth"), "page_id")
        links = links.withColumn("depth", F.col("depth") + 1).withColumn("canonical", urls.canonical(F.col("url")))
        if s.depth_limit is not None:
            links = links.where(F.col("depth") <= s.depth_limit)
        first = L.first_on_page(links, F.col("canonical"), "page_id", "pos").withColumn("link_id", F.concat_ws(":", "page_id", "pos"))
        acts = first.join(H.vectors(first, "link_id", self.spec), "link_id")

        if s.learn:
            memory, count = self._remember(pages, ok, acts, frontier, memory)
            before = self.t // s.steps_before_switch
            if count:
                self.t += count
                rows = FR.shuffled(memory, f"{self.seed}:{self.t}", "t").limit(s.sample_size).collect()  # one replay sample
                model.fit(rows, s)
            if self.t // s.steps_before_switch > before:
                model.switch()
                # A new target model: all waiting requests are scored again.
                again = H.rescored(frontier.where("not is_seed"), model.w, model.b).select("seq", "q")
                frontier = FR.reprioritise(frontier, again)

        fresh = L.unseen(L.first_in_crawl(acts, F.col("canonical"), "link_id"), F.col("canonical"), self._read("seen"), "canonical")
        scored = H.rescored(fresh, model.w, model.b) if model.fitted else fresh.withColumn("q", F.lit(UNFIT_SCORE))
        priority = score_to_priority(F.col("q")) - (F.col("depth") * 100 if not s.learn else F.lit(0))
        new = numbered(scored.withColumn("priority", priority.cast("int")), "canonical", "seq").withColumn("seq", F.col("seq") + F.lit(self.next_seq - 1))
        new = new.select(F.col("domain_to").alias("slot"), "seq", "url", "canonical", "priority", F.lit(False).alias("is_seed"), F.lit(False).alias("removed"), F.lit(False).alias("from_random"), "depth", "buckets", "values")

        rewarded = self.goal.reward(pages.where(ok)).withColumn("slot", urls.registered_domain(F.col("url")))
        closed = self._read("closed").unionByName(self.goal.achieved(rewarded, "slot").select("slot")).distinct()
        open_, _ = FR.close_slots(frontier.where("not removed").unionByName(new), closed)
        if s.queue_maxsize is not None:
            open_ = FR.trim(open_, s.queue_maxsize)
        asked = frontier.where("removed")
        waiting = self._kept(open_, "waiting")
        seen = self._read("seen").unionByName(self._kept(new.select("canonical"), "new-seen"))
        drawn = self._draw(waiting)
        marked = FR.remove(waiting, drawn).drop("from_random").join(drawn.select("seq", "from_random"), "seq", "left").withColumn("from_random", F.coalesce("from_random", F.lit(False)))
        frontier = asked.select(*marked.columns).unionByName(marked)
        self._write(frontier, seen, memory, closed)
        self.next_seq = 1 + max(self.next_seq - 1, self._read("frontier").agg(F.max("seq")).first()[0] or 0)
        return drawn.select("seq", "url", "slot", "depth", "from_random")

    def _remember(self, pages: DataFrame, ok, acts: DataFrame, frontier: DataFrame, memory: DataFrame) -> tuple[DataFrame, int]:
        """The replay memory with this batch's examples, within its bounds of examples and links."""
        s = self.s
        reward = self.goal.reward(pages).select("page_id", "seq", F.when(ok, F.coalesce("reward", F.lit(0.0))).otherwise(F.lit(0.0)).alias("reward"))
        asked = frontier.where("removed and not is_seed").select("seq", F.struct("buckets", "values").alias("action"))
        offers = acts.groupBy("page_id").agg(F.collect_list(F.struct("buckets", "values")).alias("choices"))  # the links of one page
        rows = reward.join(asked, "seq").join(offers, "page_id", "left")
        new = numbered(rows, "page_id", "t").select((F.col("t") + F.lit(self.t)).alias("t"), "reward", "action", F.coalesce("choices", F.array().cast(f"array<{ACTION}>")).alias("choices"))
        new = self._kept(new, "new")
        count = new.count()
        t = F.col("t")
        place = t - 1 if s.replay_maxsize is None else F.when(t <= s.replay_maxsize, t - 1).otherwise(F.floor(uniform(f"{self.seed}:replay", t) * s.replay_maxsize))
        both = memory.unionByName(new.withColumn("place", place.cast("long")))
        row = F.struct("t", "reward", "action", "choices")
        out = both.groupBy("place").agg(F.max_by(row, "t").alias("r")).select("place", "r.*")
        if s.replay_maxlinks is not None:
            # In seeded order as many examples as the bound on links allows; a memory is bounded, and only ids are sorted.
            sizes = out.select("place", F.sum(F.size("choices") + 1).over(Window.orderBy(order_key(self.seed, F.col("t")), "t").rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
            out = out.join(sizes.where(F.col("total") <= s.replay_maxlinks).select("place"), "place", "left_semi")
        return self._kept(out, "memory-new"), count

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        """Written beside the state of the coming step and read back."""
        at = f"{self.path}/step-{self.n + 1}/{name}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.parquet(at)

    def _draw(self, live: DataFrame) -> DataFrame:
        """A batch of waiting requests: slots by the softmax of their best priorities, best first in a slot; random ones beside them."""
        s, key = self.s, f"{self.seed}:{self.n}"
        stats = FR.queue_stats(live).where("live > 0")
        draws = FR.sample_slots(stats, self.batch, key, s.temperature).groupBy("slot").agg(F.count("*").alias("k"))
        greedy = FR.pop_order(live, self.batch).join(F.broadcast(draws), "slot").where("place <= k").drop("place", "k").withColumn("from_random", F.lit(False))
        extra = FR.random_requests(live, self.batch, s.epsilon, key) if s.epsilon > 0 else None
        both = greedy if extra is None else greedy.join(extra.select("seq"), "seq", "left_anti").unionByName(extra, allowMissingColumns=True)
        return self._kept(both, "drawn")
