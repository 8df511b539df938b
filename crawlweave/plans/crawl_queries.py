"""Queries on crawl logs, frontiers, forms and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlweave.functions import numeric as N
from crawlweave.functions import urls as U
from crawlweave.functions.common import site_key, table
from crawlweave.functions.rand import uniform as unit
from crawlweave.operators import crawllog as C
from crawlweave.operators import evaluation as E
from crawlweave.operators import frontier as Q
from crawlweave.operators import goals as G
from crawlweave.operators import graph as H
from crawlweave.plans.catalogue import query, registered, site, uniform

# --- the crawl log: documents in crawl order -------------------------------------------------------------------

LOG = f"(SELECT item_id, metadata.stats.t AS t, metadata.stats.reward AS reward, metadata.stats.is_seed AS is_seed, metadata.depth AS depth, {site('domain')} AS domain, raw_content IS NOT NULL AND raw_content <> '' AS is_text FROM cdr_items)"


def log(spark, d):
    t = table(spark, d, "cdr_items")
    s = F.col("metadata.stats")
    return t.select("item_id", s["t"].alias("t"), s["reward"].alias("reward"), s["is_seed"].alias("is_seed"), F.col("metadata.depth").alias("depth"), site_key(F.col("domain")).alias("domain"), (F.col("raw_content").isNotNull() & (F.col("raw_content") != "")).alias("is_text"))


@query(f"SELECT item_id, round(sum(coalesce(reward, 0.0)) OVER w, 6) AS total, round(sum(coalesce(reward, 0.0)) OVER w / count(*) OVER w + 1e-9, 6) AS average FROM {LOG} WINDOW w AS (ORDER BY item_id ROWS UNBOUNDED PRECEDING)")
def cum_reward(spark, d):
    """Return and mean reward at every step."""
    return C.returns(log(spark, d), "item_id", "reward").select("item_id", F.round("return", 6).alias("total"), F.round(F.col("average") + 1e-9, 6).alias("average"))


@query(f"SELECT item_id, round(avg(reward) OVER (ORDER BY item_id ROWS 99 PRECEDING) + 1e-9, 6) AS run_average FROM {LOG} WHERE reward IS NOT NULL")
def rolling100(spark, d):
    """Mean of the last 100 rewards."""
    return C.rolling_mean(log(spark, d), "item_id", "reward", 100).select("item_id", F.round(F.col("run_average") + 1e-9, 6).alias("run_average"))


@query(
    f"""WITH l AS {LOG}, f AS (SELECT item_id, row_number() OVER (PARTITION BY domain ORDER BY item_id) = 1 AND domain IS NOT NULL AS a, domain IS NOT NULL AND reward > 0.5 AND row_number() OVER (PARTITION BY domain, reward > 0.5 ORDER BY item_id) = 1 AS b FROM l)
    SELECT item_id, sum(CASE WHEN a THEN 1 ELSE 0 END) OVER w::BIGINT AS crawled, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER w::BIGINT AS relevant FROM f WINDOW w AS (ORDER BY item_id ROWS UNBOUNDED PRECEDING)"""
)
def cum_distinct_domains(spark, d):
    """Crawled and relevant domains so far."""
    dom = F.col("domain")
    return C.distinct_so_far(log(spark, d), "item_id", {"crawled": dom, "relevant": F.when(F.col("reward") > 0.5, dom)})


@query(f"SELECT domain, count(*)::BIGINT AS requests, coalesce(count_if(reward >= 0.1), 0)::BIGINT AS relevant FROM {LOG} WHERE domain IS NOT NULL AND is_text AND NOT is_seed GROUP BY 1")
def domain_goal_counts(spark, d):
    """Requests and relevant pages per domain; only text pages that are no seeds."""
    return G.domain_counts(log(spark, d).where("domain is not null and is_text and not is_seed"), "domain")


@query(f"SELECT domain FROM {LOG} WHERE domain IS NOT NULL GROUP BY 1 HAVING count(*) >= 60 OR count_if(reward >= 0.1) >= 10")
def goal_achieved(spark, d):
    """Domains that are done."""
    goal = G.RelevancyGoal(F.col("reward"), max_requests=60, max_relevant=10)
    return goal.achieved(log(spark, d).where("domain is not null"), "domain")


@query(
    f"""WITH l AS (SELECT * FROM {LOG} WHERE domain IS NOT NULL), a AS (SELECT domain, item_id, row_number() OVER (PARTITION BY domain ORDER BY item_id) AS rn FROM l), b AS (SELECT domain, item_id, row_number() OVER (PARTITION BY domain ORDER BY item_id) AS rn FROM l WHERE reward >= 0.1)
    SELECT domain, min(item_id) AS closed_at FROM (SELECT domain, item_id FROM a WHERE rn = 15 UNION ALL SELECT domain, item_id FROM b WHERE rn = 5) GROUP BY 1"""
)
def goal_close_time(spark, d):
    """The step at which each domain reached its limit."""
    return C.close_times(log(spark, d).where("domain is not null"), "domain", "item_id", "reward", 0.1, 15, 5)


@query(f"SELECT name, item_id AS step, round(value, 6) AS value FROM (SELECT item_id, 'reward' AS name, reward AS value FROM {LOG} UNION ALL SELECT item_id, 'depth', depth::DOUBLE FROM {LOG}) WHERE item_id % 20 = 0")
def log_every_20(spark, d):
    """Time series of every 20th step."""
    return C.scalars(log(spark, d), "item_id", ["reward", "depth"]).select("name", "step", F.round("value", 6).alias("value"))


@query(f"SELECT floor(t / 100)::BIGINT AS version, count(*)::BIGINT AS n FROM {LOG} WHERE t IS NOT NULL GROUP BY 1")
def model_versions(spark, d):
    """Steps per version of the target model."""
    return log(spark, d).where("t is not null").groupBy(C.model_version(F.col("t")).alias("version")).agg(F.count("*").alias("n"))


@query(f"SELECT count(*)::BIGINT AS pages, count_if(is_text)::BIGINT AS good, count_if(NOT is_text)::BIGINT AS bad, count_if(is_seed AND NOT is_text)::BIGINT AS bad_seeds FROM {LOG}")
def response_counts(spark, d):
    """Text and other responses; a seed without text teaches nothing."""
    return log(spark, d).agg(F.count("*").alias("pages"), F.count_if("is_text").alias("good"), F.count_if(~F.col("is_text")).alias("bad"), F.count_if(F.col("is_seed") & ~F.col("is_text")).alias("bad_seeds"))


@query("SELECT count_if(event_type <> 'error')::BIGINT AS enqueued, count_if(event_type = 'purchase')::BIGINT AS processed, count_if(event_type = 'view')::BIGINT AS dropped, (count_if(event_type <> 'error') - count_if(event_type = 'purchase') - count_if(event_type = 'view'))::BIGINT AS todo FROM events")
def todo_balance(spark, d):
    """What is left in the queue."""
    e = F.col("event_type")
    return Q.todo(table(spark, d, "events"), e != "error", e == "purchase", e == "view")


@query(f"SELECT item_id, CASE WHEN is_text THEN coalesce(reward, 0.0) ELSE 0.0 END AS reward, is_text AS has_choices FROM {LOG} WHERE NOT is_seed")
def experience_rows(spark, d):
    """Pages to learn from; those without text teach reward 0."""
    from crawlweave.operators.qmodel import experience

    rows = experience(log(spark, d), F.col("is_seed"), F.col("is_text"), F.col("reward"))
    return rows.select("item_id", "reward", "has_choices")


# --- the frontier: nodes that were not visited -------------------------------------------------------------------

FRONTIER = f"(SELECT node_id AS seq, {registered('url')} AS slot, url, priority, priority >= 5000 AS is_seed, priority < 100 AS removed FROM nodes WHERE NOT visited AND url IS NOT NULL)"


def frontier(spark, d):
    n = table(spark, d, "nodes").where("not visited and url is not null")
    return n.select(F.col("node_id").alias("seq"), U.registered_domain(F.col("url")).alias("slot"), "url", "priority", (F.col("priority") >= 5000).alias("is_seed"), (F.col("priority") < 100).alias("removed"))


def _pop(order: str) -> str:
    return f"SELECT slot, seq, place::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY priority DESC, seq {order}) AS place FROM {FRONTIER} WHERE NOT removed) WHERE place <= 10"


@query(_pop("ASC"))
def frontier_pop_fifo(spark, d):
    """The ten next requests of every slot, oldest first on ties."""
    return Q.pop_order(frontier(spark, d), 10).select("slot", "seq", "place")


@query(_pop("DESC"))
def frontier_pop_lifo(spark, d):
    """The same, newest first on ties."""
    return Q.pop_order(frontier(spark, d), 10, lifo=True).select("slot", "seq", "place")


@query(f"SELECT slot, seq FROM (SELECT slot, seq, row_number() OVER (PARTITION BY slot ORDER BY md5('7:' || seq), seq) AS rn FROM {FRONTIER} WHERE NOT removed) WHERE rn <= 2")
def frontier_pop_random(spark, d):
    """Two random live entries of every slot."""
    return Q.pop_random(frontier(spark, d), "7", 2).select("slot", "seq")


@query(f"SELECT slot, seq FROM (SELECT slot, seq, row_number() OVER (PARTITION BY slot ORDER BY priority DESC, seq) AS rn FROM {FRONTIER}) WHERE rn <= 20")
def frontier_trim(spark, d):
    """Queues cut to 20 entries."""
    return Q.trim(frontier(spark, d), 20).select("slot", "seq")


@query(f"SELECT slot, count(*)::BIGINT AS entries, count_if(NOT removed)::BIGINT AS live, coalesce(max(priority) FILTER (NOT removed), -150000000)::INT AS max_priority FROM {FRONTIER} GROUP BY 1")
def frontier_maxprio(spark, d):
    """Size and best priority of every queue."""
    return Q.queue_stats(frontier(spark, d))


SHUT = f"(SELECT slot FROM {FRONTIER} GROUP BY 1 HAVING count(*) >= 30)"


def _shut(f):
    return f.groupBy("slot").count().where("count >= 30").select("slot")


@query(f"SELECT slot, count(*)::BIGINT AS dropped FROM {FRONTIER} WHERE slot IN {SHUT} GROUP BY 1")
def closed_slot_drop(spark, d):
    """What closing slots drops."""
    f = frontier(spark, d)
    return Q.close_slots(f, _shut(f))[1]


@query(f"SELECT slot, seq FROM {FRONTIER} WHERE slot NOT IN {SHUT} UNION ALL SELECT slot, seq + 1000000000 FROM {FRONTIER} WHERE slot NOT IN {SHUT}")
def push_rejection(spark, d):
    """New entries for open slots only."""
    f = frontier(spark, d)
    shut = _shut(f)
    new = f.withColumn("seq", F.col("seq") + 1_000_000_000)
    return Q.push(Q.close_slots(f, shut)[0], new, shut)[0].select("slot", "seq")


@query(f"SELECT seq, removed OR priority < 300 AS removed FROM {FRONTIER}")
def frontier_remove(spark, d):
    """Entries tombstoned by key."""
    f = frontier(spark, d)
    return Q.remove(f, f.where("priority < 300")).select("seq", "removed")


@query(f"SELECT seq, CASE WHEN is_seed THEN priority ELSE trunc({uniform('q', 'seq')} * 10000)::INT END AS priority FROM {FRONTIER}")
def frontier_reprioritise(spark, d):
    """New priorities from new scores; seeds keep theirs."""
    f = frontier(spark, d)
    return Q.reprioritise(f, f.select("seq", unit("q", F.col("seq")).alias("q"))).select("seq", "priority")


_Z = f"(SELECT slot, coalesce(max(priority) FILTER (NOT removed), -150000000) / 10000.0 AS z FROM {FRONTIER} GROUP BY 1)"


@query(f"SELECT slot, round(exp(z - max(z) OVER ()) / sum(exp(z)) OVER () * exp(max(z) OVER ()), 6) AS p FROM {_Z}")
def softmax_slots(spark, d):
    """Probability of every slot."""
    return Q.slot_weights(Q.queue_stats(frontier(spark, d))).select("slot", F.round("p", 6).alias("p"))


@query(
    f"""WITH p AS (SELECT slot, exp(z) / sum(exp(z)) OVER () AS p FROM {_Z}), c AS (SELECT slot, p, sum(p) OVER (ORDER BY slot ROWS UNBOUNDED PRECEDING) AS hi FROM p),
    d AS (SELECT k AS draw, {uniform('s', 'k')} AS u FROM range(1, 201) r(k)) SELECT draw, slot FROM d JOIN c ON u >= hi - p AND u < hi"""
)
def sample_slots_seeded(spark, d):
    """200 draws of a slot with replacement."""
    return Q.sample_slots(Q.queue_stats(frontier(spark, d)), 200, "s")


@query(f"SELECT seq, from_random FROM (SELECT seq, false AS from_random, row_number() OVER (PARTITION BY slot ORDER BY priority DESC, seq) AS rn FROM {FRONTIER} WHERE NOT removed) WHERE rn <= 3 UNION ALL SELECT seq, true FROM {FRONTIER} WHERE {uniform('e', 'seq')} < 0.2")
def eps_random_mix(spark, d):
    """Greedy requests and random extras."""
    f = frontier(spark, d)
    return Q.epsilon_mix(Q.pop_order(f, 3).drop("place"), f, 0.2, "e").select("seq", "from_random")


@query(f"SELECT priority, slot, url FROM {FRONTIER} WHERE NOT removed UNION ALL SELECT priority, '<BUFFER>', url FROM {FRONTIER} WHERE is_seed")
def queue_dump(spark, d):
    """The queue as it is written out, with the pop buffer."""
    f = frontier(spark, d)
    return Q.dump(f, f.where("is_seed"))


@query(f"SELECT count(*) FILTER (slot NOT IN {SHUT})::BIGINT AS open, count(*) FILTER (slot IN {SHUT})::BIGINT AS closed FROM (SELECT DISTINCT slot FROM {FRONTIER})")
def slot_counts(spark, d):
    """Open and closed slots."""
    f = frontier(spark, d)
    return Q.domain_counts(f, _shut(f))


@query("SELECT n, least(1000, greatest(1, n // 1000))::INT AS batch, trunc(n / 30000.0 / (0.33 / 0.67) / 0.1)::INT AS every, floor(n / 4096)::BIGINT AS chunk, (n * 12 + (n + 1) * 4)::BIGINT AS bytes FROM (SELECT o_orderkey * 977 AS n FROM orders)")
def queue_heuristics(spark, d):
    """Batch size, re-scoring interval, scoring chunk and memory for queue sizes."""
    n = F.col("n")
    return table(spark, d, "orders").select((F.col("o_orderkey") * 977).alias("n")).select("n", N.batch_size(n).alias("batch"), N.reschedule_interval(n).alias("every"), N.chunk(n).alias("chunk"), N.sparse_bytes(n, n).alias("bytes"))


@query("SELECT node_id, trunc(coalesce(reward, 0.05) * 10000)::INT AS priority, round(trunc(coalesce(reward, 0.05) * 10000) / 10000.0, 6) AS score, trunc(coalesce(reward, 0.05) * 20)::INT AS coarse FROM nodes")
def score_priorities(spark, d):
    """Scores as fixed-point priorities and back."""
    s = F.coalesce("reward", F.lit(N.UNFIT_SCORE))
    return table(spark, d, "nodes").select("node_id", N.score_to_priority(s).alias("priority"), F.round(N.priority_to_score(N.score_to_priority(s)), 6).alias("score"), N.coarse_priority(s).alias("coarse"))


# --- forms ---------------------------------------------------------------------------------------------------------

TYPES = {"login": "login", "registration": "registration", "password/login recovery": "recovery", "search": "search", "contact/comment": "contact"}
FORMS = "(SELECT form_id, page_id, " + site("domain") + " AS domain, req_id, " + ", ".join(f"CASE WHEN form IS NOT NULL THEN coalesce(form['{t}'], 0.0) END AS {c}" for t, c in TYPES.items()) + " FROM forms)"
COLS = list(TYPES.values())


def forms(spark, d):
    f = table(spark, d, "forms").select("form_id", "page_id", site_key(F.col("domain")).alias("domain"), "req_id", "form")
    return E.spread_forms(f, TYPES)


def _ok(c):
    return f"CASE WHEN NOT isnan({c}) THEN {c} END"


@query(f"SELECT page_id, hash, {_ok("form['login']")} AS login FROM forms WHERE form IS NOT NULL")
def forms_flatten(spark, d):
    """Nested forms of pages, a row per form."""
    pages = table(spark, d, "forms").where("form is not null").select("page_id", F.array(F.struct("form", "hash")).alias("forms"))
    login = F.try_element_at("form", F.lit("login"))
    return E.flatten_forms(pages).select("page_id", "hash", F.when(~F.isnan(login), login).alias("login"))


@query(f"SELECT form_id, {', '.join(COLS)} FROM {FORMS}")
def form_columns(spark, d):
    """Form maps as columns."""
    return forms(spark, d).select("form_id", *COLS)


@query(f"SELECT {', '.join(f'round(coalesce(sum({c}), 0.0), 6) AS {c}' for c in COLS)}, count(domain)::BIGINT AS domains FROM (SELECT domain, {', '.join(f'max({_ok(c)}) AS {c}' for c in COLS)} FROM {FORMS} GROUP BY 1)")
def form_expectation(spark, d):
    """Expected number of domains with each form type."""
    return E.expectation(forms(spark, d), "domain", COLS).select(*[F.round(c, 6).alias(c) for c in COLS], "domains")


@query(
    f"""WITH f AS (SELECT * FROM {FORMS} WHERE domain IS NOT NULL), m AS (SELECT max(req_id) AS top, greatest(1, max(req_id) // 20) AS w FROM {FORMS}),
    k AS (SELECT unnest(list_append(range(w, top, w), top)) AS upto FROM m),
    g AS (SELECT upto, domain, {', '.join(f'max({_ok(c)}) AS {c}' for c in COLS)} FROM k JOIN f ON req_id <= upto GROUP BY 1, 2)
    SELECT upto::BIGINT AS upto, {', '.join(f'round(coalesce(sum({c}), 0.0), 6) AS {c}' for c in COLS)}, count(*)::BIGINT AS domains FROM g GROUP BY 1"""
)
def form_timeline(spark, d):
    """The expectation at 20 points of the crawl."""
    return E.expectation_timeline(forms(spark, d), "domain", "req_id", COLS).select("upto", *[F.round(c, 6).alias(c) for c in COLS], "domains")


@query(f"SELECT form_id, round(s[1] - s[2], 6) AS margin FROM (SELECT form_id, list_reverse_sort([{', '.join(_ok(c) for c in COLS)}]) AS s FROM {FORMS} WHERE login IS NOT NULL)".replace("list_reverse_sort([", "list_sort(list_filter([").replace("]) AS s", "], lambda x: x IS NOT NULL), 'DESC') AS s"))
def margin_top2(spark, d):
    """How far the best class is ahead."""
    f = forms(spark, d).where("login is not null")
    scores = F.array_compact(F.array(*[F.when(~F.isnan(c), F.col(c)) for c in COLS]))
    return f.select("form_id", F.round(N.top2_margin(scores), 6).alias("margin"))


@query("SELECT n AS forms, count(*)::BIGINT AS pages FROM (SELECT page_id, count(*)::BIGINT AS n FROM forms GROUP BY 1) GROUP BY 1")
def value_count_hist(spark, d):
    """Pages by their number of forms."""
    return E.value_counts(E.value_counts(table(spark, d, "forms"), "page_id").withColumnRenamed("n", "forms"), "forms").withColumnRenamed("n", "pages")


@query(f"SELECT (floor(n / 5) * 5)::BIGINT AS bin, count(*)::BIGINT AS keys FROM (SELECT domain, count(*) AS n FROM {FORMS} GROUP BY 1) GROUP BY 1")
def domain_form_histogram(spark, d):
    """Domains by their number of forms, in bins of five."""
    return E.count_histogram(forms(spark, d), "domain")


@query("SELECT 'login' AS \"column\", count(v)::BIGINT AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS least, max(v) AS most FROM (SELECT CASE WHEN NOT isnan(login) THEN login END AS v FROM F) UNION ALL SELECT 'search', count(v)::BIGINT, round(avg(v), 6), round(stddev_samp(v), 6), min(v), max(v) FROM (SELECT CASE WHEN NOT isnan(search) THEN search END AS v FROM F)".replace("FROM F", f"FROM {FORMS}"))
def form_describe(spark, d):
    """Summary of two classes."""
    return E.describe(forms(spark, d), ["login", "search"]).select("column", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "least", "most")


@query(f"SELECT count(DISTINCT domain)::BIGINT AS domains, count(DISTINCT page_id)::BIGINT AS page_ids FROM {FORMS} WHERE login > 0.3 AND NOT isnan(login)")
def pages_with_login(spark, d):
    """Domains and pages with a likely log-in form."""
    return E.unique_with(forms(spark, d), ["domain", "page_id"], "login", 0.3)


@query("SELECT count(v)::BIGINT AS n, count_if(v > 0.3)::BIGINT AS above, round(count_if(v > 0.3) / count(v), 6) AS share FROM (SELECT CASE WHEN NOT isnan(login) THEN login END AS v FROM F)".replace("FROM F", f"FROM {FORMS}"))
def share_of_login(spark, d):
    """Share of forms that are likely log-in forms."""
    f = forms(spark, d).select(F.when(~F.isnan("login"), F.col("login")).alias("v"))
    return E.share_above(f, "v", 0.3).select("n", "above", F.round("share", 6).alias("share"))


@query("SELECT page_id, k AS form_type, max(v) AS score FROM (SELECT page_id, unnest(map_keys(form)) AS k, unnest(map_values(form)) AS v FROM forms WHERE form IS NOT NULL) WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1, 2")
def form_goal_max(spark, d):
    """The best probability of every form type on a page, over its forms."""
    m = G.merge_max(table(spark, d, "forms"), "page_id", "form")
    return m.select("page_id", F.explode("scores").alias("form_type", "score"))


@query(f"SELECT domain FROM (SELECT {site('domain')} AS domain, coalesce(form['login'], 0.0) AS s FROM forms WHERE form IS NOT NULL) WHERE domain IS NOT NULL AND NOT isnan(s) GROUP BY 1 HAVING greatest(max(s), 0) > 0.7")
def form_goal_achieved(spark, d):
    """Domains whose log-in form was found."""
    goal = G.FormGoal("login")
    f = table(spark, d, "forms").where("form is not null").select(site_key(F.col("domain")).alias("domain"), "form").where("domain is not null")
    return goal.achieved(goal.reward(f).where(~F.isnan("reward")), "domain")


@query(f"SELECT count(*)::BIGINT AS keys, round(sum(m), 6) AS total, round(avg(m), 6) AS average FROM (SELECT domain, greatest(coalesce(max(reward), 0.0), 0.0) AS m FROM {LOG} WHERE domain IS NOT NULL GROUP BY 1)")
def max_score_summary(spark, d):
    """Sum and mean of the domains' best rewards."""
    s = G.max_score_summary(G.max_scores(log(spark, d).where("domain is not null"), "domain", "reward"))
    return s.select("keys", F.round("total", 6).alias("total"), F.round("average", 6).alias("average"))


# --- runs side by side ---------------------------------------------------------------------------------------------

RUNS = "(SELECT 'run-' || (o_custkey % 4) AS run, (o_orderkey // 4) % 200 AS step, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2)"


def runs(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.concat(F.lit("run-"), (F.col("o_custkey") % 4).cast("string")).alias("run"), (F.floor(F.col("o_orderkey") / 4) % 200).alias("step")).agg(F.avg("o_totalprice").alias("value"))


@query(f"SELECT step, count(value)::BIGINT AS runs, round(avg(value) + 1e-7, 4) AS mean, round(stddev_samp(value) + 1e-7, 4) AS std, round(min(value) + 1e-7, 4) AS least, round(max(value) + 1e-7, 4) AS most FROM {RUNS} GROUP BY 1")
def run_band_stats(spark, d):
    """Mean, deviation and extremes across runs at every step."""
    return E.run_band(runs(spark, d), "step", "value").select("step", "runs", *[F.round(F.col(c) + 1e-7, 4).alias(c) for c in ("mean", "std", "least", "most")])


@query("SELECT step, " + ", ".join(f"round(max(value) FILTER (run = 'run-{k}') + 1e-7, 4) AS \"run-{k}\"" for k in range(4)) + f" FROM {RUNS} GROUP BY 1")
def run_pivot(spark, d):
    """One column a run."""
    names = [f"run-{k}" for k in range(4)]
    return E.side_by_side(runs(spark, d), "step", "run", "value", names).select("step", *[F.round(F.col(f"`{n}`") + 1e-7, 4).alias(n) for n in names])


@query("SELECT label, list_sort(list(run)) AS runs FROM (SELECT p_partkey AS run, concat_ws(', ', CASE WHEN p_brand <> 'Brand#11' THEN 'brand=' || p_brand END, CASE WHEN p_size % 5 <> 1 THEN 'size=' || (p_size % 5) END) AS label FROM part) GROUP BY 1")
def experiment_labels(spark, d):
    """Runs grouped by the parameters that differ from the defaults."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("run"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), (F.col("p_size") % 5).cast("string")).alias("params"))
    return E.group_runs(p.select("run", E.label_runs(p, "params", {"brand": "Brand#11", "size": "1"}).alias("label")), "label", "run")


@query(f"SELECT k AS fold, count(*)::BIGINT AS rows, count(DISTINCT domain)::BIGINT AS domains FROM (SELECT domain, ('0x' || substr(md5(domain), 1, 8))::BIGINT % 5 AS k FROM {LOG} WHERE domain IS NOT NULL) GROUP BY 1".replace("k AS fold", "k::INT AS fold"))
def group_kfold(spark, d):
    """Folds by domain."""
    l = log(spark, d).where("domain is not null").withColumn("fold", E.fold(F.col("domain"), 5))
    return l.groupBy("fold").agg(F.count("*").alias("rows"), F.count_distinct("domain").alias("domains"))


# --- the graph -----------------------------------------------------------------------------------------------------


@query("SELECT node_id, coalesce(i, 0)::BIGINT AS in_degree, coalesce(o, 0)::BIGINT AS out_degree FROM nodes LEFT JOIN (SELECT dst AS node_id, count(*) AS i FROM edges GROUP BY 1) USING (node_id) LEFT JOIN (SELECT src AS node_id, count(*) AS o FROM edges GROUP BY 1) USING (node_id)")
def graph_in_out_degree(spark, d):
    return H.degrees(table(spark, d, "nodes"), table(spark, d, "edges"))


@query("SELECT src, dst, round(greatest(0.0, b.reward - a.reward), 6) AS delta FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE a.reward IS NOT NULL AND b.reward IS NOT NULL")
def graph_reward_delta(spark, d):
    """Reward gained along every edge."""
    return H.edge_rewards(table(spark, d, "nodes"), table(spark, d, "edges")).select("src", "dst", F.round("delta", 6).alias("delta"))


@query("SELECT src AS node_id, count(*)::BIGINT AS successors, max(b.reward) AS best, round(avg(b.reward) + 1e-9, 6) AS mean FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst WHERE a.reward IS NOT NULL AND b.reward IS NOT NULL GROUP BY 1")
def graph_successors(spark, d):
    """Rewards one link further."""
    return H.best_successor(table(spark, d, "nodes"), table(spark, d, "edges")).select("node_id", "successors", "best", F.round(F.col("mean") + 1e-9, 6).alias("mean"))


@query("SELECT src, dst, link.url AS url FROM edges WHERE src IN (SELECT node_id FROM nodes WHERE visited AND ok) AND dst IN (SELECT node_id FROM nodes WHERE visited AND ok)")
def induced_subgraph(spark, d):
    """Edges between visited, good nodes."""
    good = table(spark, d, "nodes").where("visited and ok")
    return H.induced(table(spark, d, "edges"), good).select("src", "dst", F.col("link.url").alias("url"))


@query("SELECT count(*)::BIGINT AS created, count_if(visited)::BIGINT AS visited, count_if(ok)::BIGINT AS ok, count_if(NOT ok)::BIGINT AS err FROM nodes")
def visited_counts(spark, d):
    return H.state_counts(table(spark, d, "nodes"))


@query("SELECT n.node_id, e.src AS via, n.reward, coalesce(len(c.u), 0)::BIGINT AS choices FROM nodes n JOIN edges e ON e.dst = n.node_id LEFT JOIN (SELECT src, list_distinct(list(link.url)) AS u FROM edges GROUP BY 1) c ON c.src = n.node_id WHERE n.visited AND n.ok")
def graph_examples(spark, d):
    """Training examples from the graph."""
    return H.examples(table(spark, d, "nodes"), table(spark, d, "edges")).select("node_id", "via", "reward", "choices")


@query(f"SELECT {registered('url')} AS domain, count(*)::BIGINT AS n FROM nodes WHERE reward > 0.5 GROUP BY 1")
def positive_domains(spark, d):
    """Where high rewards come from."""
    return H.positive_domains(table(spark, d, "nodes"), U.registered_domain(F.col("url")))
