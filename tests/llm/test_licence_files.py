"""Real licence files, wrapped as they are published, and what their directories inherit."""

from __future__ import annotations

import textwrap

import pytest
from pyspark.sql import functions as F

from brindle.llm import licences


def wrapped(text, start=""):
    return "\n\n".join(textwrap.fill(p, 74, initial_indent=start, subsequent_indent=start) for p in text.split("\n\n"))


def test_whole_licence_files(spark):
    whole = licences.whole_texts()
    rows = [(i, wrapped("Copyright (c) 2020 Jane Roe\n\n" + whole[name][0]), f"{name}/LICENSE") for i, name in enumerate(sorted(whole))]
    notice = wrapped(whole["GPL-3.0"][-1])
    code = "\n\n" + "\n".join(f"int value{i} = read(stream, {i});" for i in range(60))
    rows += [(100, "some plain prose", "MIT/src/a.c"), (101, notice, "notice/COPYING"), (102, wrapped(whole["GPL-3.0"][-1], " * ") + code, "head/b.c"), (103, "nothing", "head/c.c"), (104, None, "MIT/d"), (105, "the copyright of the picture is not known and nobody has a licence", "x/e")]
    got = {r["doc_id"]: (r["licence"], r["origin"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string, path string")).collect()}
    assert {i: got[i] for i in range(len(whole))} == {i: (name, "file") for i, name in enumerate(sorted(whole))}
    assert got[100] == got[104] == ("MIT", "inherited")
    assert got[101] == ("GPL-3.0", "file")
    assert got[102] == ("GPL-3.0", "header")
    assert got[103] == got[105] == ("", "none")


def test_no_text_at_the_cosine_has_fewer_words(spark):
    rows, idf, other = licences.template_vectors(licences.whole_texts())
    fewest = licences.fewest_words(rows, licences.WHOLE)
    templates = {}
    for template, _, word, weight in rows:
        templates.setdefault(template, {})[word] = weight
    best = []
    for weights in templates.values():
        heavy = sorted(weights.values(), reverse=True)
        # The closest that a text of so many words can come has just the heaviest words, weighted alike.
        best.append(sum(w * w for w in heavy[: fewest - 1]) ** 0.5)
        assert sum(w * w for w in heavy) == pytest.approx(1)
    assert max(best) < licences.WHOLE and fewest > 5


def test_cues_are_those_of_the_pattern(spark):
    texts = ["LICENCE", "a LiCenSe.", "licenſe", "lİcense", "copyrıght", "PERMISSION", "Warranty", "redistributed", "public  domain", "Public Domain", "nothing", "", None, "x" * 300_000 + "copyRIGHT"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(licences.cued("text").alias("a"), F.col("text").rlike(licences.CUE).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got]


def test_a_notice_among_blank_lines_and_a_very_long_text(spark):
    notice = licences.whole_texts()["MIT"][-1]
    rows = [(1, f"\n\n{notice}\n\n", "a/LICENSE"), (2, f"{notice}", "b/LICENSE"), (3, "word " * 200_000 + "\n\n" + notice, "c/x"), (3, "word " * 200_000 + "\n\n" + notice, "c/x"), (4, "", "a/y"), (None, notice, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = sorted(((r["doc_id"] or 0), r["licence"], r["origin"]) for r in licences.scan(df).collect())
    assert got == [(0, "MIT", "file"), (1, "MIT", "file"), (2, "MIT", "file"), (3, "MIT", "header"), (3, "MIT", "header"), (4, "MIT", "inherited")]
