import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crawlweave.llm import cuckoo as C


def hashes(keys):
    rnd = np.random.default_rng(7)
    table = {k: rnd.integers(-(1 << 62), 1 << 62, 2) for k in sorted(set(keys))}
    return np.array([table[k][0] for k in keys]), np.array([table[k][1] for k in keys])


def test_filter_grows_and_never_forgets():
    f = C.Filter(bits=24, buckets=4)
    keys = list(range(5000))
    h1, h2 = hashes(keys)
    for a in range(0, 5000, 500):
        assert not f.step(h1[a : a + 500], h2[a : a + 500]).any()
    assert f.table.grown > 100 and f.contains(h1, h2).all() and f.table.used == 5000


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=200))
def test_filter_answers_as_a_set(keys):
    f, seen = C.Filter(bits=32, buckets=2), set()
    if keys:
        h1, h2 = hashes(keys)
        want = []
        for k in keys:
            want.append(k in seen)
            seen.add(k)
        assert f.step(h1, h2).tolist() == want


def test_deletion():
    f = C.Filter(buckets=8)
    h1, h2 = hashes([1, 2, 3])
    f.insert(h1, h2)
    assert f.delete(h1[1:2], h2[1:2]) == 1 and f.delete(h1[1:2], h2[1:2]) == 0
    assert f.contains(h1, h2).tolist() == [True, False, True]


def test_deletion_never_forgets_a_kept_key():
    """Short fingerprints and a table that doubled many times: keys inserted before and after share nothing by table."""
    f = C.Filter(bits=12, buckets=32)
    h1, h2 = hashes(list(range(4000)))
    for a in range(0, 4000, 100):
        f.insert(h1[a : a + 100], h2[a : a + 100])
    assert f.table.grown >= 32 and f.delete(h1[::2], h2[::2]) == 2000
    assert f.contains(h1[1::2], h2[1::2]).all() and f.contains(h1[::2], h2[::2]).mean() < 0.5


def test_state_tables_forget_keys(spark):
    _, state = C.remember(frame(spark, [(i, f"k{i}") for i in range(3000)]), F.col("k"), "rec_id", tables=3)
    gone = spark.createDataFrame([(f"k{i}",) for i in range(0, 3000, 2)] + [(None,), ("never",), ("k0",)], "k string")
    a, state = C.remember(frame(spark, [(5000 + i, f"k{i}") for i in range(0, 3000, 3)]), F.col("k"), "rec_id", tables=3, state=state, forget=gone)
    assert {r.rec_id for r in a.collect() if not r.seen} == {5000 + i for i in range(0, 3000, 6)}
    b, _ = C.remember(frame(spark, [(9000 + i, f"k{i}") for i in range(3000)]), F.col("k"), "rec_id", tables=3, state=state)
    assert {r.rec_id for r in b.collect() if not r.seen} == {9000 + i for i in range(0, 3000, 2) if i % 3}


def test_state_in_pieces(spark, monkeypatch):
    f = C.Filter(buckets=4)
    h1, h2 = hashes(list(range(500)))
    f.insert(h1, h2)
    monkeypatch.setattr(C, "PIECE", 16)
    assert len(f.dump()) > 3 and C.Filter.load(f.dump(), 32, 4).contains(h1, h2).all()


def brute(rows):
    first = {}
    for i, k in rows:
        if i is not None and k is not None:
            first[k] = min(i, first.get(k, i))
    return sorted(i for i, k in rows if i is not None and k is not None and i > first[k])


def frame(spark, rows):
    return spark.createDataFrame(rows, "rec_id bigint, k string")


def test_against_a_set_with_a_hot_key_in_any_order(spark):
    rnd = random.Random(3)
    rows = [(i, "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(3000)}") for i in range(20_000)]
    rnd.shuffle(rows)
    rows += [(90_000, None), (None, "hot"), (90_001, ""), (90_002, "")]
    df = frame(spark, rows).repartition(7).withColumn("part", F.lit("clash")).withColumn("seen", F.lit(1)).withColumn("h1", F.lit(None).cast("string"))
    assert sorted(r.rec_id for r in C.seen_before(df, F.col("k"), "rec_id", tables=5).collect()) == brute(rows)


def test_rows_that_come_twice_under_one_id(spark):
    rows = [(1, "a"), (1, "a"), (2, "a"), (2, "a"), (3, "b"), (3, "b")]
    assert sorted(r.rec_id for r in C.seen_before(frame(spark, rows).repartition(3), F.col("k"), "rec_id").collect()) == [2, 2]


def test_empty_table_and_long_keys(spark):
    assert C.seen_before(frame(spark, []), F.col("k"), "rec_id").count() == 0
    assert C.error_rate(frame(spark, []), F.col("k"), "rec_id").first().wrong_rate == 0.0
    assert [r.rec_id for r in C.seen_before(frame(spark, [(1, "x" * 1_000_000), (2, "x" * 1_000_000)]), F.col("k"), "rec_id").collect()] == [2]


def test_short_fingerprints_err_at_the_expected_rate_and_only_one_way(spark):
    df = spark.range(40_000).selectExpr("id as rec_id", "concat('k', id % 30000) as k")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")  # keys of one batch are compared whole
    r = C.error_rate(df, F.col("k"), "rec_id", bits=8, tables=4).first()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert r.new_keys == 30_000 and r.reported == 10_000 + r.wrong and 0 < r.wrong_rate < 8 * 6 / 2**8
    assert C.error_rate(df, F.col("k"), "rec_id", tables=4).first().wrong == 0


def test_history_is_carried_on(spark):
    a, state = C.remember(frame(spark, [(i, f"k{i % 900}") for i in range(2000)]), F.col("k"), "rec_id", tables=3)
    b, state = C.remember(frame(spark, [(5000 + i, f"k{i}") for i in range(1200)]), F.col("k"), "rec_id", tables=3, state=state)
    assert a.where("seen").count() == 1100 and b.where("seen").count() == 900
    c, _ = C.remember(frame(spark, [(9000, "k1100"), (9001, "new")]), F.col("k"), "rec_id", tables=3, state=state)
    assert {r.rec_id: r.seen for r in c.collect()} == {9000: True, 9001: False}


def test_url_key(spark):
    urls = {"HTTP://Ex.Test/A?b=2&a=1&a=0#x": "http://ex.test/A?a=0&a=1&b=2", "http://e/p/": "http://e/p/", "http://e/p?": "http://e/p?", "http://e": "http://e", "": "", "http://e?B#": "http://e?B", "/rel?z&y": "/rel?y&z"}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.k for r in df.select("u", C.url_key(F.col("u")).alias("k")).collect()} == urls
