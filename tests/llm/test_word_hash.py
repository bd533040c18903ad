"""Words whose letters follow the Thue-Morse sequence and its complement: equal under polynomial hashes modulo 2^64, and different words."""

from __future__ import annotations

import pyarrow as pa
import pytest

from brindle.llm import decontam, jaccard, lines, packing
from brindle.llm.words import NOT_SPACE, Words


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


ONE, OTHER = thue_morse(4096, "ab"), thue_morse(4096, "ba")


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([(1, ONE, "x"), (2, OTHER, "y")], "doc_id long, text string, source string")


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1024, 4096, 65536])
def test_hashes_differ_and_don_t_depend_on_the_batch(n):
    a, b = thue_morse(n, "ab"), thue_morse(n, "ba")
    h = Words(pa.array([f"{a} {b}", f"x {a.upper()}"]), NOT_SPACE).hash
    assert h[0] != h[1] and h[0] == h[3] and len(h) == 4
    assert Words(pa.array([a]), NOT_SPACE).hash[0] == h[0]


def test_no_link(pair):
    assert sorted(tuple(r)[:3] for r in jaccard.link_digest(pair).collect()) == [(1, 1, 1), (2, 1, 2)]


def test_no_hit(spark, pair):
    items = spark.createDataFrame([(7, OTHER)], "item_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontam.decontaminate_digest(pair, items).collect()}
    assert got == {1: 0, 2: 1}


def test_no_equal_lines(pair):
    assert {r["n_gone"] for r in lines.dedup_digest(pair).collect()} == {0}


def test_no_near_copies(pair):
    rows = packing.pack_sized(packing.near_clusters(pair)).collect()
    assert len(rows) == 2 and len({r["bin_id"] for r in rows}) == 1  # no cluster keeps them apart
