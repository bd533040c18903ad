"""What the line stage of the pipeline keeps of documents, and which lines it takes."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from test_corpus_operators import brute_lines
from test_text_operators import docs

import corpus_pipeline
from brindle.llm import lines


def stage(spark, texts):
    return {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs(spark, texts), "").collect()}


def test_a_document_stays_while_anything_is_left(spark):
    row = "the same line of words here"
    texts = [row, f"{row}\nrose\nwhite lily", f"{row}\n春眠不覚暁処処聞啼鳥", f"{row}\n \n　", row, None, ""]
    assert stage(spark, texts) == {0: row, 1: "rose\nwhite lily", 2: "春眠不覚暁処処聞啼鳥", 5: None, 6: ""}


def test_short_lines_leave_too(spark):
    texts = ["menu\nabout us\n春眠不覚暁処処聞啼鳥\na b c d e", "home\nAbout  us", "春眠不覚暁処処聞啼鳥\nhome\nus about", "us\na b c d f\na b c d"]
    got = {r["doc_id"]: r["gone_lines"] for r in lines.dedup_lines(docs(spark, texts), min_words=1).filter("size(gone_lines) > 0").collect()}
    assert got == brute_lines(enumerate(texts), least=1)
    assert stage(spark, texts) == {0: texts[0], 1: "home", 3: "us\na b c d f"}


def test_one_text_of_very_many_paired_lines(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(10_000):
        line = rng.sample(words, 12)
        rows += [" ".join(line), " ".join([*line[:-1], "other"])]
    out = lines.dedup_lines(docs(spark, ["\n".join(rows), rows[0]])).collect()
    gone = {r["doc_id"]: r["gone_lines"] for r in out}
    assert gone == {0: list(range(1, 20_000, 2)), 1: [0]}


def test_clashing_names(spark):
    row = "the same line of words here"
    df = docs(spark, [row, f"{row} again\nalone stands this line"]).withColumns({c: F.lit(3) for c in ("__id", "__hash", "gone", "text_hash", "hashed", "n", "line")})
    out = {r["doc_id"]: r for r in lines.dedup_lines(df).collect()}
    assert out[1]["text"] == "alone stands this line" and out[1]["gone"] == 3 and out[1]["text_hash"] == 3
    assert set(df.columns) | {"gone_lines"} == set(lines.dedup_lines(df).columns)


def test_no_python_on_executors(spark):
    join = lines.Join(docs(spark, ["one two three four five\nsix", "one two three four five six"]).localCheckpoint(), 80, 100, 1)
    plans = [df._jdf.queryExecution().toString() for df in (join.docs, join.known, join.similar())]
    assert not any(word in plan for plan in plans for word in ("InArrow", "InPandas", "PythonUDF"))
    assert not hasattr(lines, "np") and not hasattr(lines, "pa")  # sets were made in numpy


def test_posts_of_similar_sets_meet(spark):
    """Sets at the threshold, with the words that differ anywhere in the order, have a post in common."""
    rng, rows = random.Random(7), []
    for i in range(400):
        o, cut = rng.randint(4, 40), 0.25 * rng.random()
        x = rng.randint(0, int(o * cut))
        y = int(o * 0.25) - x
        words = rng.sample(range(-(10**6), 10**6), o + x + max(y, 0))
        rows += [(i, sorted(words[: o + x])), (i, sorted(words[:o] + words[o + x :]))]
    sets = spark.createDataFrame(rows, "i int, keys array<long>").selectExpr("i", "keys", "size(keys) n").withColumn("posts", lines.posts(80, 100))
    met = sets.groupBy("i").agg(F.collect_list("posts").alias("p"), F.collect_list("keys").alias("k")).collect()
    wide = [r for r in met if r["k"][0] != r["k"][1]]
    assert wide and all(set(r["p"][0]) & set(r["p"][1]) for r in wide)
