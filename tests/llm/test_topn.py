import math
import random

import pytest
from pyspark.sql import functions as F

from crawlweave.llm import topn as T


def brute(rows, n):
    by = {}
    for g, s, u, i in rows:
        if g is not None and s is not None and not math.isnan(s):
            by.setdefault(g, []).append((-s, u is None, (u or "").encode(), i))
    return sorted((g, i, k) for g, v in by.items() for k, (*_, i) in enumerate(sorted(v)[:n], 1))


def top(spark, rows, n, extra=False):
    df = spark.createDataFrame(rows, "g string, p double, url string, id bigint")
    if extra:
        for c in ("grp", "score", "tie", "rank", "file"):
            df = df.withColumn(c, F.lit("x"))
    return sorted((r.g, r.id, r["rank"]) for r in T.top_n(df, ["g"], "p", "url", "id", n, 4 << 10).collect())


@pytest.mark.parametrize("extra", [False, True])
def test_against_brute_force_with_ties_and_a_hot_group(spark, extra):
    rnd = random.Random(1)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", "ü"]), rnd.choice([0.1, 0.5, 0.9, rnd.random()]), rnd.choice(["u1", "u2", "Z", "é", None]), i) for i in range(6000)]
    rows += [(None, 0.9, "u", 1), ("a", None, "u", 2), ("a", float("nan"), "u", 3), ("b", float("inf"), "u", 4), ("b", -1.0, "u", 5)]
    assert top(spark, rows, 3, extra) == brute(rows, 3)


def test_rows_that_come_twice_compete_as_they_are(spark):
    rows = [("a", 0.5, "u", 1)] * 2 + [("a", 0.4, "u", 2)]
    assert top(spark, rows, 2) == [("a", 1, 1), ("a", 1, 2)]


def test_few_rows_and_none(spark):
    assert top(spark, [("a", 0.5, None, 1)], 3) == [("a", 1, 1)]
    assert top(spark, [], 3) == [] and top(spark, [("a", None, "u", 1)], 3) == []


def test_row_groups_are_skipped(spark):
    df = spark.range(200_000).selectExpr("'hot' as g", "cast((id * 7919) % 200000 as double) as p", "cast(id as string) as url", "id")
    r = T.skipping_report(df, ["g"], "p", "url", "id", 3, 16 << 10).first()
    assert r.row_groups_skipped > r.row_groups_read > 0


def test_groups_are_told_apart_whatever_they_hold(spark):
    rows = [("a\x01b", "c", 0.5, 1), ("a", "b\x01c", 0.6, 2), ("a", "b", 0.7, 3), ('a","b', "", 0.8, 4), ("", "", 0.9, 5)]
    df = spark.createDataFrame(rows, "g string, h string, p double, id bigint").withColumn("url", F.lit("u"))
    got = {(r.g, r.h): (r.id, r["rank"]) for r in T.top_n(df, ["g", "h"], "p", "url", "id", 3).collect()}
    assert got == {(g, h): (i, 1) for g, h, _, i in rows}


def test_a_clustered_table_is_used_again_and_skipped_by_itself(spark):
    df = spark.range(60_000).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 500)) as g", "cast((id * 7919) % 60000 as double) as p", "cast(id as string) as url", "id")
    path = T.cluster(T.keyed(df, ["g"], "p", "url", "id"))
    rows = [(r.g, r.p, r.url, r.id) for r in df.collect()]
    for n in (1, 4):
        assert sorted((r.g, r.id, r["rank"]) for r in T.top_n_of(spark, path, ["g"], "p", "id", n).collect()) == brute(rows, n)
    assert T.skipping_report(df, ["g"], "p", "url", "id", 3).first().row_groups_skipped > 0
