from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brindle.operators import ordering, relational, sampling, similarity
from brindle.streaming import jobs


@pytest.mark.parametrize(("n", "want"), [(1, (0, 0, 1)), (2, (0, 0, 2)), (3, (1, 1, 1)), (9, (7, 1, 1)), (10, (8, 1, 1)), (35, (28, 3, 4))])
def test_split_sizes(spark, n, want):
    rows = sampling.stratified_split(spark.range(n).withColumn("g", F.lit("x")), "g", "id").groupBy("split").count().collect()
    counts = {r["split"]: r["count"] for r in rows}
    assert tuple(counts.get(s, 0) for s in ("train", "validation", "test")) == want


def test_keep_first_prefers_originals(spark):
    df = spark.createDataFrame([(1, "a" * 150 + "x", True), (2, "a" * 150 + "y", False), (3, None, False)], "id long, t string, aug boolean")
    assert {r["id"] for r in ordering.keep_first(df, F.left("t", F.lit(150)), [F.col("aug"), F.col("id")]).collect()} == {2, 3}


def test_key_table_rules(spark):
    at = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([("a", "created", at), ("a", "activated", at + dt.timedelta(1)), ("b", "created", at), ("b", "deleted", at + dt.timedelta(2)), ("c", "retired", at)], "key_id string, event string, at timestamp")
    states = ordering.key_states(events)
    assert {r["key_id"]: r["status"] for r in states.collect()} == {"a": "ACTIVE", "c": "RETIRED"}
    assert ordering.violations(states).count() == 0
    assert ordering.violations(states.filter("key_id = 'c'")).collect()[0]["rule"] == "one_active"
    now = F.lit("2024-02-01").cast("timestamp")
    due = ordering.due(states, now, F.expr("interval 10 days"), F.expr("interval 90 days"))
    assert {r["key_id"]: r["due"] for r in due.collect()} == {"a": "rotate", "c": None}


def test_live_at_the_moment_it_ends(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t), (2, t + dt.timedelta(seconds=1))], "id long, expires_at timestamp")
    assert [r["id"] for r in ordering.live(df, F.lit("2024-01-01").cast("timestamp")).collect()] == [2]


def test_replay_bases(spark):
    new, old = spark.range(100), spark.range(1000, 2000)
    assert sampling.replay_mix(new, old, "id").filter("is_replay").count() == 15
    assert sampling.replay_mix(new, old, "id", base="stage1").filter("is_replay").count() == 150
    assert sampling.replay_mix(new, spark.range(5), "id").filter("is_replay").count() == 5


def test_oversample_truncates(spark):
    assert sampling.oversample(spark.range(4), F.col("id") < 1, 2.5).count() == 5


def test_adapt_ratio(spark):
    r = spark.createDataFrame([(0.2, "severe"), (0.4, "severe"), (0.2, "moderate"), (0.28, "moderate"), (0.2, "none")], "r double, f string")
    assert [round(x["y"], 3) for x in r.select(sampling.adapt_ratio(F.col("r"), F.col("f")).alias("y")).collect()] == [0.3, 0.5, 0.24, 0.3, 0.2]


def test_fatal_lookup(spark):
    words = spark.createDataFrame([("a", "A")], "k string, v string")
    assert relational.fatal_lookup(spark.createDataFrame([("a",)], "k string"), words, "k", "v").collect()[0]["v"] == "A"
    with pytest.raises(Exception, match="no entry for b"):
        relational.fatal_lookup(spark.createDataFrame([("b",)], "k string"), words, "k", "v").collect()


def test_best_source(spark):
    scans = spark.createDataFrame([("app/src/main/A.kt",), ("none.kt",)], "path string")
    files = spark.createDataFrame([("x/src/main/A.kt",), ("y/A.kt",)], "file string")
    assert {r["path"]: r["file"] for r in relational.best_source(scans, files).collect()} == {"app/src/main/A.kt": "x/src/main/A.kt", "none.kt": None}


def test_routes_with_parameters(spark):
    paths = spark.createDataFrame([("/users/7",), ("/users/me",), ("/a/b/c",)], "path string")
    routes = spark.createDataFrame([("/users/{id}",), ("/users/:name",), ("/users/me",)], "route string")
    assert {r["path"]: r["route"] for r in relational.match_routes(paths, routes).collect()} == {"/users/7": "/users/{id}", "/users/me": "/users/me", "/a/b/c": None}


def test_cosine_zero_vector_and_ties(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [3.0, 0.0], "b"), (4, [0.0, 0.0], "c"), (5, None, "d")], "id long, vec array<double>, label string")
    rows = similarity.cosine_top_k(df, df.filter("id = 1"), 2).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in rows] == [(2, 1.0), (3, 1.0)]
    one_each = similarity.cosine_top_k(df, df.filter("id = 1"), 3, one_per="label").orderBy("rank").collect()
    assert [r["id"] for r in one_each] == [2, 3, 4]


def test_shards_are_contiguous(spark):
    rows = ordering.shards(spark.range(25), ["id"], 10).collect()
    assert {r["id"]: r["shard"] for r in rows} == {i: i // 10 for i in range(25)}


def test_new_files_resume(spark, tmp_path):
    src, out, point = (str(tmp_path / x) for x in ("src", "out", "point"))
    spark.range(3).write.parquet(f"{src}/1")
    for expected in (3, 5):
        jobs.run_available(jobs.new_files(spark, src, spark.range(1).schema), out, point)
        assert spark.read.parquet(out).count() == expected
        spark.range(3, 5).write.mode("overwrite").parquet(f"{src}/2")


def test_key_state_stream(spark, tmp_path):
    schema = "key_id string, event string, at timestamp"
    spark.createDataFrame([("a", "created", dt.datetime(2024, 1, 1)), ("a", "activated", dt.datetime(2024, 1, 2))], schema).write.parquet(str(tmp_path / "e"))
    stream = jobs.key_state_stream(jobs.new_files(spark, str(tmp_path / "e"), spark.read.parquet(str(tmp_path / "e")).schema))
    q = stream.writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert spark.table("states").collect()[0]["status"] == "ACTIVE"
