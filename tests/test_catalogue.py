"""Every named query against its SQL on the smallest tables; those without SQL by what must hold of them."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from compare import assert_same, connect

from brindle.plans import catalogue

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, con, name):
    assert_same(catalogue.queries()[name](spark, FOLDER), con, catalogue.oracle_sql()[name])


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_weighted_replay_follows_weights(spark):
    weights = {r["doc_id"]: r["weight"] for r in catalogue.queries()["importance_diversity"](spark, FOLDER).collect()}
    drawn = catalogue.queries()["weighted_replay"](spark, FOLDER).collect()
    assert sorted(r["draw"] for r in drawn) == list(range(1000))
    counts = Counter(r["doc_id"] for r in drawn)
    assert set(counts) <= set(weights)
    heavy = sorted(weights, key=weights.get)[len(weights) // 2 :]
    share = sum(weights[d] for d in heavy) / sum(weights.values())
    assert abs(sum(counts[d] for d in heavy) / 1000 - share) < 0.08


def test_stream_ttl_state_reads_once(spark):
    """The stream against a replay of the events in plain Python."""
    rows = catalogue.queries()["stream_ttl_state"](spark, FOLDER).collect()
    events = spark.read.parquet(f"{FOLDER}/events.parquet").orderBy("ts", "event_id").collect()
    held, want = {}, {}
    for e in events:
        if e["event_type"] == "signup":
            held[e["user_id"]] = (str(e["event_id"]), e["ts"])
        else:
            value = held.pop(e["user_id"], None)
            want[e["event_id"]] = value[0] if value and (e["ts"] - value[1]).total_seconds() < 300 else None
    assert {r["seq"]: r["value"] for r in rows} == want
