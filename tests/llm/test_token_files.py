"""Token files: what is read back is what the tokenizer gives, in id order, by runs and by random access."""

from __future__ import annotations

import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from brindle.functions.tokens import Encoder, read_tokenizer
from brindle.llm import tokenfiles

ALPHABET = " \n\t,.;:!?'aabbXs1 5-é 　中- <|>d\u0085𝒳'reñ×÷#%*\"(ʼЖÿ"


@pytest.fixture(scope="module")
def encoder():
    return Encoder(read_tokenizer())


def plain(encoder, texts):
    return [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_pieces_give_the_ids_of_whole_texts(encoder):
    rng = random.Random(2)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(4000)]
    texts += [None, "", " ", "a ", "\n", "<|endoftext|> a.<|endoftext|>", "it's 'tis we'll", "x" * 5000, "word, " * 5000]
    ids, first = encoder.encode(pa.array(texts))
    assert encoder.cuts
    assert [ids[a:z].tolist() for a, z in zip(first[:-1], first[1:], strict=True)] == plain(encoder, texts)


def test_other_tokenizers_get_whole_texts(encoder):
    said = json.loads(read_tokenizer())
    said["normalizer"] = {"type": "Lowercase"}
    other = Encoder(json.dumps(said))
    texts = ["Some TEXT, with. stops", None, "A\nb"]
    ids, first = other.encode(pa.array(texts))
    assert not other.cuts
    assert [ids[a:z].tolist() for a, z in zip(first[:-1], first[1:], strict=True)] == plain(other, texts)


def rows(encoder, docs):
    order = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    start, out = 0, []
    for (i, _), ids in zip(order, plain(encoder, [t for _, t in order]), strict=True):
        own = np.array([*ids, 2], "<u4")
        out.append((i, start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    return out


def test_digest_equals_plain_version(spark, encoder):
    rng = random.Random(3)
    docs = [(i * 7 % 1009, "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(200)))) for i in range(500)]
    docs += [(5000, None), (5001, ""), (5002, "many words here. " * 60_000), (None, "last")]
    got = tokenfiles.digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(rows(encoder, docs), key=str)


def test_repeated_ids_empty_tables_and_clashing_columns(spark, encoder):
    docs = [(1, "same"), (1, "same"), (1, "other text"), (0, "x")]
    frame = spark.createDataFrame([(*d, 1, "p", 2, "q") for d in docs], "doc_id long, text string, start int, ids_path string, shard int, mask string")
    got = sorted(tuple(r) for r in tokenfiles.digest(frame).collect())
    assert got[0] == rows(encoder, docs)[0]
    assert sorted(r[1] for r in got)[0] == 0 and sum(r[2] for r in got) == sum(r[2] for r in rows(encoder, docs))
    assert len({(r[1], r[2]) for r in got}) == 4
    assert tokenfiles.digest(frame.limit(0)).collect() == []


def test_random_access_masks_and_sequences(spark, encoder, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "BATCH", 3)
    docs = [(i, f"text number {i} " * (i % 9)) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    manifest = tokenfiles.write(frame, str(tmp_path), length=16)
    seen, all_ids = [], []
    for m in manifest.orderBy("start").collect():
        file = tokenfiles.Sequences(m["ids_path"])
        kept = [file[i] for i in range(len(file))]
        assert all(len(a) == len(b) == 16 for a, b in kept)
        assert all(mask.all() for _, mask in kept[:-1])
        assert not file[0][0].flags.owndata  # a view
        own = np.concatenate([ids[mask] for ids, mask in kept])
        assert len(own) == m["n_tokens"] == file.n_tokens()
        with pytest.raises(IndexError):
            file[len(file)]
        all_ids += own.tolist()
        seen += [(m["shard"], i, ids.tolist(), mask.tolist()) for i, (ids, mask) in enumerate(kept)]
    assert all_ids == [x for ids in plain(encoder, [t for _, t in docs]) for x in [*ids, 2]]
    assert sorted(tuple(r) for r in tokenfiles.read_sequences(manifest).collect()) == sorted(seen)


def test_files_of_lost_attempts_are_not_read(spark, encoder, tmp_path):
    docs = [(i, "a b c") for i in range(10)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    (tmp_path / "ids-00000-left-by-a-lost-task.arrow").write_bytes(b"half")
    manifest = tokenfiles.write(frame, str(tmp_path))
    assert sorted(tuple(r) for r in tokenfiles.read_documents(manifest).collect()) == rows(encoder, docs)
