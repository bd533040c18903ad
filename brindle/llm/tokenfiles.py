"""Token files: ids of whole documents in id order, cut into sequences of one length, in Arrow's file format.

A shard is a range of ids and has two files. In its ids file each row is a sequence: ``ids``, a
fixed-size list of the least unsigned integers that hold the vocabulary, and ``mask``, a fixed-size
list of booleans that are false on the padding after the last document. All batches but the last have
``BATCH`` sequences, none is compressed, and lists have no offsets, so sequence i of a mapped file is a
view at a place worked out from i (``Sequences``). Its documents file says where each document begins
and how many ids it has, the end id included.

A task takes texts in order, encodes them and writes as it goes, holding one batch; a shard's files
have a name of their own for each attempt, and only those that a finished task has reported belong to
the result, so a lost executor leaves nothing but files nobody reads. Folders may be of any store that
Arrow's file systems open; a local one must be shared. Texts are read in id order by ranges of (id, text
hash), so rows of one id can be on several shards; their order is by that hash, then text.
Null texts are empty, null ids come last, empty tables give no files and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.tokens import encoder, read_tokenizer
from brindle.llm.store import shared_folder, stored

LENGTH, END_ID = 2048, 2
#: Sequences of a batch of the ids file, and rows of one of the documents file.
BATCH, DOC_ROWS = 512, 65_536
MANIFEST = "shard int, ids_path string, docs_path string, n_docs long, n_tokens long"


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Writer:
    """Ids as they come, written a batch of sequences at a time."""

    def __init__(self, path: str, kind: np.dtype, length: int, end_id: int):
        self.length, self.kind, self.pending, self.waiting, self.n_tokens = length, kind, [], 0, 0
        of = pa.from_numpy_dtype(kind)
        meta = {"sequence_length": str(length), "batch": str(BATCH), "end_id": str(end_id)}
        self.schema = pa.schema([("ids", pa.list_(pa.field("item", of, False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))], meta)
        fs, at = opened(path)
        self.sink = fs.open_output_stream(at)
        self.file = pa.ipc.new_file(self.sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.waiting += len(ids)
        self.n_tokens += len(ids)
        if self.waiting >= BATCH * self.length:
            self._write(self.waiting // (BATCH * self.length) * BATCH * self.length)

    def _write(self, n: int) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, self.kind)
        self.pending, self.waiting = [ids[n:]], len(ids) - n
        for at in range(0, n, BATCH * self.length):
            own = ids[at : min(at + BATCH * self.length, n)]
            rows = -(-len(own) // self.length)
            padded, mask = np.zeros(rows * self.length, self.kind), np.zeros(rows * self.length, bool)
            padded[: len(own)], mask[: len(own)] = own, True
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=f.type) for v, f in zip((padded, mask), self.schema, strict=True)]
            self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        self._write(self.waiting)
        self.file.close()
        self.sink.close()


def _write(folder: str, shared, length: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        own, ids, docs, n_docs = encoder(shared.value), None, None, 0
        end = np.array([end_id], own.kind)
        for batch in batches:
            for part, found, first in own.slices(batch, "text"):
                if ids is None:  # a task without rows writes no files
                    name = f"{folder}/{{}}-{shard:05d}-{uuid.uuid4().hex}.arrow"
                    ids = _Writer(name.format("ids"), own.kind, length, end_id)
                    schema = pa.schema([pa.field("doc_id", part.schema.field("doc_id").type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                    fs, at = opened(name.format("docs"))
                    sink = fs.open_output_stream(at)
                    docs = pa.ipc.new_file(sink, schema)
                n = np.diff(first) + 1
                start = ids.n_tokens + np.cumsum(n) - n
                laid = np.full(n.sum(), end[0], own.kind)
                inside = np.ones(len(laid), bool)
                inside[np.cumsum(n) - 1] = False
                laid[inside] = found
                ids.add(laid)
                for a in range(0, part.num_rows, DOC_ROWS):
                    z = a + DOC_ROWS
                    docs.write_batch(pa.RecordBatch.from_arrays([part.column("doc_id")[a:z], pa.array(start[a:z]), pa.array(n[a:z])], schema=schema))
                n_docs += part.num_rows
        if ids is not None:
            ids.close(), docs.close(), sink.close()
            row = [[shard], [name.format("ids")], [name.format("docs")], [n_docs], [ids.n_tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["shard", "ids_path", "docs_path", "n_docs", "n_tokens"])

    return run


def write(docs: DataFrame, folder: str, tokenizer_json: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` (doc_id, text) to ``folder``; the manifest: one row (shard, ids_path, docs_path, n_docs, n_tokens, start) for each shard.

    ``start`` is the number of ids of all shards before it. Shards are as many as the session's shuffle
    partitions, or fewer where Spark joins small ones.
    """
    spark = docs.sparkSession
    fs, at = opened(folder)
    fs.create_dir(at)
    shared = spark.sparkContext.broadcast(tokenizer_json or read_tokenizer())
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    ranged = own.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    found = stored(ranged.mapInArrow(_write(folder, shared, length, end_id), MANIFEST)).orderBy("shard").collect()  # a row for each shard
    rows, start = [], 0
    for r in found:
        rows.append((*r, start))
        start += r["n_tokens"]
    return spark.createDataFrame(rows, MANIFEST + ", start long")


class Sequences:
    """An ids file by random access: ``file[i]`` is (ids, mask) of sequence i, the ids a view of the mapped file where it is local."""

    def __init__(self, path: str):
        fs, at = opened(path)
        self.source = pa.memory_map(at) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(at)
        self.file = pa.ipc.open_file(self.source)
        meta = self.file.schema.metadata
        self.length, self.batch_rows, self.end_id = (int(meta[k]) for k in (b"sequence_length", b"batch", b"end_id"))
        self.held: tuple[int, pa.RecordBatch] | None = None
        n = self.file.num_record_batches
        self.n = (n - 1) * self.batch_rows + self.batch(n - 1).num_rows if n else 0

    def __len__(self) -> int:
        return self.n

    def batch(self, i: int) -> pa.RecordBatch:
        if self.held is None or self.held[0] != i:
            self.held = (i, self.file.get_batch(i))
        return self.held[1]

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= i < self.n:
            raise IndexError(i)
        ids, mask = (self.batch(i // self.batch_rows).column(c)[i % self.batch_rows].values for c in ("ids", "mask"))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def run(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The n ids from place ``start`` of the shard on, in views of one batch each."""
        size = self.batch_rows * self.length
        while n > 0:
            flat = self.batch(start // size).column("ids").flatten().to_numpy()
            piece = flat[start % size : start % size + n]
            if not len(piece):
                raise ValueError("the file ends before its documents do")
            yield piece
            start, n = start + len(piece), n - len(piece)

    def n_tokens(self) -> int:
        """What the masks leave, read from the last sequence: all before it are full."""
        return (self.n - 1) * self.length + int(self[self.n - 1][1].sum()) if self.n else 0


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = Sequences(row["ids_path"])
            if ids.n_tokens() != row["n_tokens"]:
                raise ValueError(f"{row['ids_path']} holds {ids.n_tokens()} ids, not {row['n_tokens']}")
            fs, at = opened(row["docs_path"])
            with fs.open_input_file(at) as source, pa.ipc.open_file(source) as file:
                for i in range(file.num_record_batches):
                    part = file.get_batch(i)
                    crc = np.zeros(part.num_rows, np.int64)
                    for k, (start, n) in enumerate(zip(part.column("start").to_pylist(), part.column("n_tokens").to_pylist(), strict=True)):
                        own = 0
                        for piece in ids.run(start, n):
                            own = zlib.crc32(piece.astype("<u4").tobytes(), own)
                        crc[k] = own
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.compute.add(part.column("start"), row["start"]), part.column("n_tokens"), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(manifest: DataFrame, doc_id_type: str = "long") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files: a task for each shard."""
    return _by_shard(manifest).mapInArrow(_read_documents, f"doc_id {doc_id_type}, start long, n_tokens long, ids_crc32 long")


def _read_sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            file = Sequences(row["ids_path"])
            for i in range(file.file.num_record_batches):
                part = file.batch(i)
                number = pa.array(np.arange(part.num_rows) + i * file.batch_rows)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * file.length, pa.int32()), part.column(c).flatten().cast(t)) for c, t in (("ids", pa.int32()), ("mask", pa.bool_()))]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * part.num_rows, pa.int32()), number, *lists], ["shard", "sequence", "ids", "mask"])


def read_sequences(manifest: DataFrame) -> DataFrame:
    """shard, sequence, ids, mask of each sequence, from the files."""
    return _by_shard(manifest).mapInArrow(_read_sequences, "shard int, sequence long, ids array<int>, mask array<boolean>")


def _by_shard(manifest: DataFrame) -> DataFrame:
    return manifest.repartition(max(1, manifest.count()), "shard")


def digest(docs: DataFrame, tokenizer_json: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, written to a new folder of the shared one and read back."""
    manifest = write(docs, f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}", tokenizer_json)
    return read_documents(manifest, docs.schema["doc_id"].dataType.simpleString())
