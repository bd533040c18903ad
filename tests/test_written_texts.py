"""Diffs and their numbers against plain Python: repeated files, ties, odd lines, nothing at all."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from brindle.functions import packages
from brindle.operators import relational


def test_numstat_takes_the_last_line_of_a_file(spark):
    rng = random.Random(3)
    texts = ["", "bad line", "1\t2\ta\n-\t-\ta", "1\t2\t\n3\t4\t", "9\t9\tb\textra\n1\t1\ta\n"]
    texts += ["\n".join(f"{rng.choice(['-', '', '7', str(i)])}\t{i}\tf{rng.randrange(40)}" for i in range(300)) for _ in range(3)]
    number = lambda s: int(s) if s.isdigit() else 0
    want = [{p[2]: (number(p[0]), number(p[1])) for p in (line.split("\t") for line in t.split("\n")) if len(p) >= 3} for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", packages.numstat(F.col("t")).alias("m")).orderBy("i").collect()
    assert [{k: tuple(v) for k, v in r["m"].items()} for r in rows[:-1]] == want
    assert rows[-1]["m"] is None


def test_numstats_are_the_maps_rows(spark):
    rng = random.Random(4)
    texts = ["", "bad line", "1\t2\ta\n-\t-\ta", "1\t2\t\n3\t4\t", " 7\t+8\tb\textra\n9.5\t99999999999\tc\n\t\t", None]
    texts += ["\n".join(f"{rng.choice(['-', '', '7', str(i)])}\t{i}\tf{rng.randrange(40)}" for i in range(300)) for _ in range(3)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    maps = frame.select("i", F.explode(packages.numstat(F.col("t"))).alias("file", "s")).select("i", "file", "s.added", "s.deleted").collect()
    assert len(maps) > 50
    assert sorted(map(tuple, relational.numstats(frame, "i", "t").collect())) == sorted(map(tuple, maps))


def test_language_of_the_commonest_suffix(spark):
    rng = random.Random(5)
    known = {".py": "Python", ".kt": "Kotlin", ".rs": "Rust"}
    paths = [[], ["a.py"], ["a.rs", "b.kt"], ["x", "y", "z.py"], ["d.odd", "e.odd", "f.py"], [".hidden", "g.kt"]]
    paths += [[f"d/{i}{rng.choice([*known, '', '.odd'])}" for i in range(rng.randrange(1, 60))] for _ in range(30)]

    def plain(own):
        ends = Counter("." + n.rsplit(".", 1)[1] if "." in (n := p.rsplit("/", 1)[-1])[1:] else "" for p in own)
        return known.get(min(ends, key=lambda e: (-ends[e], e)), "Other") if own else "Unknown"

    diffs = ["".join(f"--- a/{p}\n+++ b/{p}\n+x\n" for p in own) for own in paths]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*diffs, None])], "i int, t string").select("i", packages.diff_language(F.col("t")).alias("l")).orderBy("i").collect()
    assert [r["l"] for r in rows] == [*map(plain, paths), "Unknown"]
