"""Documents stored once as chunks, and messages between chunks and hash buckets.

Operators that compare every document with all others first write the texts as chunks of a few megabytes, bucketed by
chunk. What a chunk has to tell goes to hash buckets as one small binary per chunk and bucket, and answers come back to
the chunks in the same way: the texts themselves never travel again, and a value that many documents share counts once
for each chunk.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.llm.common import partitions_of, read_buckets, shared_dir, write_buckets
from shutterlake.llm.kernels import groups, text_bytes

CHUNK_BYTES = 4 << 20
#: Bits of a row's number within its chunk, and of a chunk's number within the task that wrote it.
ROW_BITS, NUMBER_BITS = 21, 20
#: Bytes of text whose fingerprints fall into one hash bucket.
BUCKET_BYTES = 16 << 20
_CHUNK = "chunk_id long, doc_ids binary, null_ids binary, offsets binary, data binary, others binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, n = TaskContext.get().partitionId(), 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    others: list[pa.RecordBatch] = []

    def flush() -> pa.RecordBatch:
        nonlocal n
        ids, nulls, sizes, data = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        table = pa.Table.from_batches(others).combine_chunks()
        others.clear()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        n += 1
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([(task << NUMBER_BITS) + n], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, nulls, offsets, data)), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
            names=["chunk_id", "doc_ids", "null_ids", "offsets", "data", "others"],
        )

    size = rows = 0
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        column = batch.column("doc_id").cast(pa.int64())
        nulls = column.is_null().to_numpy(zero_copy_only=False)
        ids = column.fill_null(np.iinfo(np.int64).max).to_numpy()
        for a, b in groups(offsets, CHUNK_BYTES):
            more = int(offsets[b] - offsets[a])
            if held and (size + more > CHUNK_BYTES or rows + b - a > 1 << ROW_BITS):
                yield flush()
                size = rows = 0
            # Copied, so that the batch itself can go.
            rest = batch.drop_columns(["text"]).slice(a, b - a).append_column("no_text", batch.column("text").slice(a, b - a).is_null())
            others.append(rest)
            held.append((ids[a:b].copy(), nulls[a:b].copy(), np.diff(offsets[a : b + 1]), data[offsets[a] : offsets[b]].copy()))
            size += more
            rows += b - a
    if held:
        yield flush()


def store_chunks(docs: DataFrame, name: str) -> DataFrame:
    """docs(doc_id, text, ...) as a table of chunks in the shared folder; a null doc_id is kept as the largest number and marked.

    Other columns are kept beside, unread by those who don't ask for them. The table is bucketed by chunk_id: joins on it move only what is joined to it.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/shutterlake-{name}-{uuid.uuid4().hex}"
    write_buckets(docs.mapInArrow(_pack, _CHUNK), path, "chunk_id", 2 * partitions_of(docs))
    return read_buckets(spark, path)


def buckets_for(chunks: DataFrame) -> int:
    """Hash buckets for what stored chunks have to tell: by their bytes, and as many as keep the cores busy."""
    return max(2 * chunks.sparkSession.sparkContext.defaultParallelism, -(-chunks.count() * CHUNK_BYTES // BUCKET_BYTES))


def row_id() -> F.Column:
    """chunk_id and row as one number."""
    return F.shiftleft(F.col("chunk_id"), ROW_BITS) + F.col("row")


class Chunk:
    """One chunk in memory."""

    def __init__(self, row: dict) -> None:
        self.id = row["chunk_id"]
        self.doc_ids = np.frombuffer(row["doc_ids"], np.int64)
        self.null_ids = np.frombuffer(row["null_ids"], bool)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.data = np.frombuffer(row["data"], np.uint8)
        self._others = row.get("others")

    def others(self) -> tuple[pa.Table, pa.Array]:
        """The rows' other columns, doc_id among them, and whether their text is null (the last column, whatever its name)."""
        table = pa.ipc.open_stream(pa.py_buffer(self._others)).read_all()
        return table.remove_column(table.num_columns - 1), table.column(table.num_columns - 1).combine_chunks()

    def texts(self) -> pa.Array:
        """The rows' texts, without regard to nulls."""
        return pa.LargeStringArray.from_buffers(len(self.doc_ids), pa.py_buffer(self.offsets.tobytes()), pa.py_buffer(self.data.tobytes()))

    def ids(self) -> pa.Array:
        return pa.array(self.doc_ids, pa.int64(), mask=self.null_ids)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time, binaries as buffers that aren't copied."""
    for batch in batches:
        names = batch.schema.names
        for i in range(len(batch)):
            yield {n: (v.as_buffer() if pa.types.is_binary(v.type) and v.is_valid else v.as_py()) for n in names for v in (batch.column(n)[i],)}


def with_messages(chunks: DataFrame, messages: DataFrame, keep_all: bool) -> DataFrame:
    """The chunks with the list of their messages (rows with a chunk_id); those without any only if keep_all."""
    rest = [c for c in messages.columns if c != "chunk_id"]
    lists = messages.groupBy("chunk_id").agg(F.collect_list(F.struct(*rest)).alias("messages"))
    return chunks.join(lists.hint("shuffle_hash"), "chunk_id", "left" if keep_all else "inner")


def bucketed(messages: DataFrame, reduce: Callable[[pa.Table], pa.Table], schema: str, buckets: int) -> DataFrame:
    """What `reduce` makes of each bucket's messages, one task for each of so many buckets."""
    return messages.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(reduce, schema)
