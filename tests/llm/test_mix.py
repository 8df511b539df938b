import os

import pytest

from crawlweave.llm import mix as M

pytestmark = pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="no tokenizer here")


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_caps_and_report(spark):
    rows = [(i, " Big " if i % 2 else "BIG", f"some words of text number {i} and more of it") for i in range(3000)] + [(10_000 + i, "small", f"few other words here {i}") for i in range(120)]
    d = docs(spark, rows + [(1, None, "x y"), (2, "other", "x z"), (3, "big", None), (4, "big", " \n")])
    out, report = M.mix(d, targets(spark, [("big", 0.7, 1), ("small", 0.3, 4)]))
    r = {x.source: x for x in report.collect()}
    assert r["small"].rate == pytest.approx(4.0) and r["big"].rate < 1
    assert r["small"].share == pytest.approx(0.3, abs=0.03) and sum(x.share for x in r.values()) == pytest.approx(1)
    copies = out.groupBy("doc_id", "source").count().toPandas()
    assert copies[copies.source == "small"]["count"].max() == 4 and copies[copies.source == "big"]["count"].max() == 1
    tokens = out.groupBy("source").sum("tokens").toPandas().set_index("source")["sum(tokens)"]
    assert tokens["big"] == r["big"].mixed_tokens and tokens["small"] == r["small"].mixed_tokens
    assert sorted(map(tuple, M.mix(d, targets(spark, [("big", 0.7, 1), ("small", 0.3, 4)]))[0].collect())) == sorted(map(tuple, out.collect()))


def test_a_text_under_many_ids_is_used_once_as_often_as_allowed(spark):
    d = docs(spark, [(i, "a" if i < 50 else "b", "the very same text") for i in range(100)] + [(200, "b", "another text")])
    out, report = M.mix(d, targets(spark, [("a", 0.5, 2), ("b", 0.5, 2)]))
    assert {x.doc_id for x in out.collect()} <= {0, 200} and out.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2


def test_targets_without_documents_and_empty_tables(spark):
    t = targets(spark, [("a", 0.5, 1), ("gone", 0.5, 3), (None, 0.1, 1)])
    out, report = M.mix(docs(spark, [(1, "a", "one two")]), t)
    r = {x.source: x for x in report.collect()}
    assert out.count() == 1 and r["gone"].rate == 0 and r["gone"].mixed_tokens == 0 and r["a"].share == 1.0
    out, report = M.mix(docs(spark, []), t)
    assert out.count() == 0 and {x.share for x in report.collect()} == {0.0}
    assert M.mix(docs(spark, [(1, "a", "one")]), t.limit(0))[0].count() == 0


def test_counts_are_those_of_the_tokenizer(spark):
    d = docs(spark, [(1, "a", "Hello world"), (2, "a", "naïve café " * 3000), (3, "a", "a" * 20_000)])
    enc = M.encoder(M.TOKENIZER)
    got = {r.doc_id: r.tokens for r in M.token_counts(d.withColumn("tokens", d.doc_id).withColumn("h1", d.doc_id)).collect()}
    assert got == {r.doc_id: len(enc.encode_ordinary(r.text)) for r in d.collect()}


def test_a_wanted_total(spark):
    """Against the arithmetic on the tokens: rates, caps, shares, and every copy count within one of the rate."""
    rows = [(i, "big", f"some words of text number {i} and more of it") for i in range(4000)] + [(10_000 + i, "small", f"few other words here {i}") for i in range(150)]
    d = docs(spark, rows)
    want = targets(spark, [("big", 0.8, 2), ("small", 0.2, 3)])
    size = {r.source: r["sum(tokens)"] for r in M.token_counts(d).groupBy("source").sum("tokens").collect()}
    for total in (1000, 20_000, 10 * sum(size.values())):
        out, report = M.mix(d, want, total_tokens=total)
        r = {x.source: x for x in report.collect()}
        mixed = {s: r[s].mixed_tokens for s in size}
        for s, share, cap in (("big", 0.8, 2), ("small", 0.2, 3)):
            rate = min(cap, total * share / size[s])
            assert r[s].rate == pytest.approx(rate) and r[s].most_copies <= cap
            assert mixed[s] == pytest.approx(rate * size[s], rel=0.25) and r[s].share == pytest.approx(mixed[s] / sum(mixed.values()))
        copies = out.groupBy("source", "doc_id").count().collect()
        assert all(int(r[c.source].rate) <= c["count"] <= int(r[c.source].rate) + 1 for c in copies)
