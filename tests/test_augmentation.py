"""Chat examples made larger: variants, openings, blends, and what equals what is there."""

from __future__ import annotations

import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

from brindle.functions import chat
from brindle.operators import augmentation, sampling
from brindle.plans import catalogue

SCHEMA = "id long, category string, messages array<struct<role string, content string>>"


def made(spark, rows, **how):
    out = augmentation.augmented_examples(spark.createDataFrame(rows, SCHEMA), "id", "category", **how).collect()
    return [(r["id"], r["kind"], r["variant"], [tuple(m) for m in r["messages"]]) for r in out]


@pytest.mark.parametrize("name", ["augmented_examples", "weighted_replay"])
def test_same_as_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert_same(catalogue.queries()[name](spark, folder), connect(folder), catalogue.oracle_sql()[name])


def test_terms_and_openings(spark):
    kinds = {"one": [("input", "user input")]}
    rows = [(1, "a", [("system", "input"), ("user", "Please Fix the following bug.\nInput input"), ("assistant", "no inputs here, input")]), (2, "a", [("user", "other"), ("assistant", "words")])]
    got = made(spark, rows, kinds=kinds, multiplier=2)
    terms = [g for g in got if g[1] == "one"]
    # Both variants are equal, so one stays; example 2 has none of the terms, and no known opening.
    assert terms == [(1, "one", 0, [("system", "input"), ("user", "Please Fix the following bug.\nuser input input"), ("assistant", "no inputs here, user input")])]
    (mixed,) = [g for g in got if g[1] == "mixed"]
    assert mixed[0] == 1 and mixed[3][1][1] in {f"{o}\nInput input" for o in chat.INTROS}
    assert {g[1] for g in got} <= {"one", "mixed", "blend"}


def test_blends_stay_in_their_category_and_reach_the_target(spark):
    rows = [(i, "ab"[i % 2], [("user", f"ask {i}\nmore"), ("assistant", f"answer {i}"), ("user", "again")]) for i in range(10)] + [(99, "alone", [("user", "ask 99"), ("assistant", "x")])]
    got = made(spark, rows, kinds={}, multiplier=5)
    assert {g[1] for g in got} == {"blend"}
    for id_, _, _, messages in got:
        first, second, blank, end = messages[0][1].split("\n")
        other = int(second.split()[1])
        assert first == f"ask {id_}" and other != id_ and other % 2 == id_ % 2 and 99 not in (id_, other)
        assert (blank, end) == ("", augmentation.BLEND_END)
        assert messages[1:] == [("assistant", f"answer {id_}"), ("user", "again")]
    # 33 blends were wanted; those that repeat are one.
    assert 20 < len(got) <= 33 and len({g[3][0][1] for g in got}) == len(got)


def test_blends_only_where_the_target_asks(spark):
    rows = [(i, None, [("user", f"Fix the following: the input {i}"), ("assistant", "the rights")]) for i in range(4)]
    got = made(spark, rows, multiplier=4)
    assert got and not [g for g in got if g[1] == "blend"]


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "a", []), (None, "a", [("user", None), (None, "input")]), (3, "a", [("user", ""), ("assistant", "input " * 50_000)]), (3, "a", [("user", ""), ("assistant", "input " * 50_000)])]
    got = made(spark, rows, multiplier=20)
    assert not [g for g in got if g[0] in (1, 2) or g[1] == "blend"]
    assert made(spark, [], multiplier=20) == []


def test_a_row_of_great_weight_is_drawn_by_pieces(spark, monkeypatch):
    monkeypatch.setattr(sampling, "PIECE", 7)
    df = spark.createDataFrame([(i, 1000.0 if i == 5 else 1.0) for i in range(20)], "id long, w double")
    out = sampling.weighted_draws(df, "id", F.col("w"), 500).collect()
    assert sorted(r["draw"] for r in out) == list(range(500))
    assert sum(r["id"] == 5 for r in out) > 460
