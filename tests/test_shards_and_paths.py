"""Shards by bytes, routes by equality and paths by their ends."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from brindle.functions.packages import source_candidates
from brindle.operators import relational, shards


def test_no_shard_is_above_the_target(spark, tmp_path):
    rng = random.Random(3)
    sizes = [rng.choice([0, 1, 5, 90, 400, 2500]) for _ in range(3000)] + [None, -4]
    frame = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "i long, size long, shard string").drop("shard")
    target = 1000
    rows = shards.by_bytes(frame, ["i"], F.col("size"), target).orderBy("i").collect()
    assert [r["i"] for r in rows] == list(range(3002))
    numbers = [r["shard"] for r in rows]
    assert numbers == sorted(numbers) and set(numbers) == set(range(rows[0]["n_shards"]))
    held = {}
    for r in rows:
        held.setdefault(r["shard"], []).append(max(r["size"] or 0, 0))
    for own in held.values():
        assert sum(own) <= target or sum(x > 0 for x in own) == 1
    full = [sum(x) for x in held.values()]
    assert sum(a + b > target * (1 - 1 / shards.CELLS_A_SHARD) for a, b in zip(full, full[1:], strict=False)) == len(full) - 1
    assert shards.by_bytes(frame.limit(0), ["i"], F.col("size"), target).collect() == []
    made = {r["name"]: (r["n_rows"], r["bytes"]) for r in shards.write(frame.fillna(0).filter("size >= 0"), str(tmp_path / "out"), ["i"], F.col("size"), target).collect()}
    back = spark.read.parquet(str(tmp_path / "out")).groupBy("name").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    assert {r["name"]: (r["n"], r["b"]) for r in back} == made
    assert sorted(made)[0] == f"train-00000-of-{len(made):05d}"


def test_routes_equal_patterns_without_a_nested_loop(spark):
    rng = random.Random(5)
    part = lambda: rng.choice(["a", "b", "c", "x1", "{id}", ":name", "v{n}.json", "a.b"])
    routes = sorted({"/" + "/".join(part() for _ in range(rng.randint(1, 4))) for _ in range(2000)} | {"/", ""})
    paths = sorted({"/" + "/".join(rng.choice(["a", "b", "c", "x1", "7", "v3.json", "{id}", "a.b", "aXb", ""]) for _ in range(rng.randint(1, 5))) for _ in range(300)}) + [None, "", "/"]
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    found = relational.match_routes(frame, spark.createDataFrame([(r,) for r in [*routes, None]], "route string"))
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    compiled = [(r, re.compile("[^/]+".join(map(re.escape, re.split(r"\{[^/}]+\}|:[^/]+", r))))) for r in routes]
    for row in found.collect():
        p = row["path"]
        fits = [] if p is None else [(p != r, len(r), r) for r, c in compiled if p == r or c.fullmatch(p)]
        assert row["route"] == (min(fits)[2] if fits else None), p


def test_candidates_in_order(spark):
    paths = ["/home/runner/work/app/app/mod/a/b.kt", "/x/github/workflows/ci.yml", "github/workflows/ci.yml", "src/a.kt", "/srv/a/b/c/d.ts", "", "/home/runner/work/app"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", F.filter(source_candidates(F.col("path")), lambda x: x.candidate.isNotNull()).alias("c")).collect()
    got = {r["path"]: [x["candidate"] for x in r["c"]] for r in rows}
    assert got[paths[0]] == ["mod/a/b.kt", "b.kt", "a/b.kt", "mod/a/b.kt"]
    assert got[paths[1]][0] == ".github/workflows/ci.yml" and got[paths[2]][:2] == [".github/workflows/ci.yml", "github/workflows/ci.yml"]
    assert got[paths[3]] == ["src/a.kt", "a.kt"] and got[paths[4]] == ["d.ts", "c/d.ts", "b/c/d.ts"]
    assert got[""] == [] and got[paths[6]][0] == "app"


def test_longest_end_wins_over_a_common_name(spark):
    files = [f"p{i}/index.ts" for i in range(500)] + ["web/a/index.ts", "deep/web/a/index.ts", "z/only.kt"]
    scans = ["/srv/x/a/index.ts", "/srv/web/a/index.ts", "/q/index.ts", "/q/none.ts", None, "/q/only.kt"]
    found = relational.resolve_sources(spark.createDataFrame([(s,) for s in scans], "path string"), spark.createDataFrame([(f,) for f in files], "file string"))
    got = {r["path"]: (r["file"], r["how"]) for r in found.collect()}
    assert got["/srv/x/a/index.ts"] == ("web/a/index.ts", "suffix")
    assert got["/srv/web/a/index.ts"] == ("web/a/index.ts", "end")
    assert got["/q/index.ts"] == ("p0/index.ts", "suffix")
    assert got["/q/none.ts"] == (None, None) and got[None] == (None, None) and got["/q/only.kt"] == ("z/only.kt", "suffix")
