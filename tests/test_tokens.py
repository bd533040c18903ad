"""Token counts equal those of whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from brindle.functions import tokens
from brindle.functions.tokens import Encoder, read_tokenizer, with_token_counts

FOLDER = "/root/testdata/sf0.001"


def test_counts_of_all_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("tokens", F.lit("replaced"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    plain = Encoder(read_tokenizer()).tokenizer
    want = {i: len(plain.encode(t or "", add_special_tokens=False).ids) for i, t in texts.items()}
    counted = with_token_counts(docs, "text", "tokens")
    assert counted.columns == ["doc_id", "text", "lang", "source", "n_chars", "tokens"]
    assert {r["doc_id"]: r["tokens"] for r in counted.collect()} == want


def test_nulls_empty_and_no_rows(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 100_000)], "i long, text string")
    got = {r["i"]: r["tokens"] for r in with_token_counts(frame, "text", "tokens").collect()}
    assert got[1] == got[2] == 0 and got[3] > 100_000
    assert with_token_counts(frame.limit(0), "text", "tokens").count() == 0


def test_few_pieces_are_held_and_encoded_at_a_time(monkeypatch):
    """Whatever is forgotten between slices, counts are those of whole texts."""
    monkeypatch.setattr(tokens, "CHUNK", 7)
    own = Encoder(read_tokenizer(), 1 << 10, 50)
    asked, plain = [], own.tokenizer

    class Counting:
        def encode_batch_fast(self, pieces, **more):
            asked.append(len(pieces))
            return plain.encode_batch_fast(pieces, **more)

    own.tokenizer = Counting()
    texts = [f"word{i} other{i * i} {i}, and so on\n" * (i % 5) for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    got = [n for _, _, first in own.slices(batch, "text") for n in np.diff(first)]
    assert got == [len(plain.encode(t, add_special_tokens=False).ids) for t in texts]
    assert max(asked) <= 7 and len(asked) > 100


def test_only_kept_columns_come_back(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "i long, text string")
    assert sorted(map(tuple, with_token_counts(frame, "text", "n", keep=["i"]).collect())) == [(1, 2), (2, 0)]
    assert sorted(map(tuple, with_token_counts(frame, "text", "n", keep=[]).collect())) == [(0,), (2,)]
