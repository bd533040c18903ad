"""Near copies of different sources don't share a bin in op6."""

from __future__ import annotations

from test_text_operators import SCHEMA

from brindle.llm import registry


def test_near_copies_do_not_share_a_bin(spark, tmp_path):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(base).upper(), "É à la carte", "é À la carte", "something else", None, ""]
    rows = [(i, t, "en", f"s{i}", len(t or "")) for i, t in enumerate(texts)] + [(None, " ".join(["new", *base]), "en", "s9", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    bins = {r["doc_id"]: r["bin_id"] for r in registry.op6_best_fit_packing(spark, str(tmp_path)).collect()}
    assert set(bins) == {*range(8), None}
    assert len({bins[i] for i in (0, 1, 2, None)}) == 4
    assert bins[3] != bins[4]
    assert len(set(bins.values())) == 4
