import gzip

import pytest
from pyspark.sql import functions as F

from crawlweave.sources import tables as S


def test_seeds(spark, tmp_path):
    p = tmp_path / "seeds.txt"
    p.write_text("url\nexample.com\n\n https://a.test/x \n")
    assert sorted(r.url for r in S.seeds(spark, path=str(p)).collect()) == ["http://example.com", "https://a.test/x"]
    assert S.seeds(spark, url="a.b").first().url == "http://a.b"
    assert S.replicated(S.seeds(spark, path=str(p)), 3).count() == 6
    assert S.shuffled_seeds(S.seeds(spark, path=str(p))).first().priority == 50_000
    with pytest.raises(ValueError):
        S.seeds(spark)


def test_broken_json_lines(spark, tmp_path):
    p = tmp_path / "x.jl"
    p.write_text('{"a": 1}\n{"a": 2}\n{"a": \n{"a": 4}\n')
    assert S.json_lines(spark, str(p), "a int").where("a is not null").count() == 3
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(p.read_text().splitlines())], "n int, value string")
    assert [r.n for r in S.repaired(lines, "n").orderBy("n").collect()] == [0, 1]
    two = lines.withColumn("f", F.lit("a")).unionByName(lines.where("n < 2").withColumn("f", F.lit("b")))
    assert S.repaired(two, "n", file="f").count() == 4


def test_truncated_gzip_is_no_error(spark, tmp_path):
    p = tmp_path / "x.jl.gz"
    p.write_bytes(gzip.compress(b'{"a": 1}\n' * 5000)[:-40])
    assert S.json_lines(spark, str(p), "a int").count() >= 0


def test_model_round_trip(spark, tmp_path):
    w = spark.createDataFrame([("f", 1.5)], "feature string, w double")
    assert not S.save_model(w, {}, str(tmp_path), 0) and not S.save_model(w, {}, str(tmp_path), 999)
    assert S.save_model(w, {"gamma": 0.4}, str(tmp_path), 1000, latest=True)
    got, meta = S.load_model(spark, str(tmp_path))
    assert got.collect() == w.collect() and meta == {"gamma": 0.4, "t": 1000}


def test_queue_and_outputs(spark, tmp_path):
    q = spark.createDataFrame([("s", 1, "u", 5, False, False), ("s", 2, "v", 6, False, True)], "slot string, seq bigint, url string, priority int, is_seed boolean, removed boolean")
    S.write_queue(q, str(tmp_path / "q"), q.where("seq = 1"))
    got = spark.read.option("header", True).csv(str(tmp_path / "q")).collect()
    assert sorted((r.priority, r.slot, r.url) for r in got) == [("5", "<BUFFER>", "u"), ("5", "s", "u")]
    pages = spark.createDataFrame([("u", "<p>", 1)], "url string, raw_content string, t int")
    S.write_outputs(pages, str(tmp_path / "cdr"), True)
    S.write_outputs(pages, str(tmp_path / "stats"), False)
    assert spark.read.json(str(tmp_path / "cdr")).columns == ["raw_content", "url"] and spark.read.json(str(tmp_path / "stats")).columns == ["t", "url"]
    assert S.items_only(pages, q).count() == 3


def test_experiments(spark, tmp_path):
    for name, ok in (("size-10", True), ("size-20", False)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "stats.jl").write_text('{"t": 1, "reward": 0.5}\n')
        if ok:
            (tmp_path / name / "params.json").write_text('{"eps": "0.2"}')
    rows = S.experiments(spark, str(tmp_path), "t bigint, reward double").collect()
    assert [(r.run, r.input_size, r.params) for r in rows] == [("size-10", 10, {"eps": "0.2"})]


def test_slices_limits_plugins(spark):
    df = spark.range(10)
    assert [r.id for r in S.sliced(df, ["id"], 3, 2).collect()] == [3, 4] and S.sliced(df, ["id"], 8).count() == 2
    assert S.first_pages(df, "id", 4).count() == 3 and S.first_pages(df, "id", 0).count() == 10
    assert S.plugin("math:sqrt")(4) == 2
    with pytest.raises(ValueError):
        S.plugin("math")
    assert [r.seq for r in S.numbered(spark.range(100), "id").orderBy("id").collect()] == list(range(1, 101))
