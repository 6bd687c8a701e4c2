"""Documents dealt to chunks by hash of their id, and counts looked up for a chunk's keys in hash-range shards.

A chunk sends each shard the sorted distinct keys that fall into the shard's range; the shard answers with one
number a key. Both sides are packed arrays, one row a chunk and shard, so the exchange moves a few bytes a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES, SHARD_BYTES = 6 << 20, 16 << 20
#: What a row of a chunk counts beside its text.
ROW_BYTES = 16


def plan_sizes(docs: DataFrame, text: str) -> tuple[int, int]:
    """(chunks, shards) for the bytes of text that ``docs`` holds."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return 1 + size // CHUNK_BYTES, 1 + size // SHARD_BYTES


def chunk_of(key: Column, chunks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(chunks))


def shard_bounds(keys: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """Where each shard's range of the sorted ``keys`` (of ``bits`` bits) begins, and the end."""
    edges = np.array([(s << bits) // shards for s in range(shards)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


def pack_sorted(keys: np.ndarray, kind: type) -> bytes:
    """Sorted keys as steps of an unsigned ``kind``; its largest value stands for itself less one key and goes on."""
    most = np.iinfo(kind).max
    steps = np.diff(keys.astype(np.int64), prepend=0)
    full = steps // most
    out = np.full(len(steps) + int(full.sum()), most, kind)
    out[np.cumsum(full + 1) - 1] = steps - full * most
    return out.tobytes()


def unpack_sorted(data: bytes, kind: type) -> np.ndarray:
    steps = np.frombuffer(data, kind).astype(np.int64)
    return np.cumsum(steps)[steps != np.iinfo(kind).max].astype(np.uint64)


def _packer(chunks: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = batch.column(0).to_numpy()
            order = np.argsort(chunk, kind="stable")
            names, starts = np.unique(chunk[order], return_index=True)
            rest = pa.RecordBatch.from_arrays(batch.columns[1:], names=batch.schema.names[1:])
            out = []
            for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
                sink = pa.BufferOutputStream()
                part = rest.take(pa.array(order[a:b]))
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(part)
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], names=["chunk", "data"])

    return pack


def packed_chunks(rows: DataFrame, chunks: int) -> DataFrame:
    """(chunk, data): the other columns of ``rows`` as compressed Arrow streams, one a batch and chunk."""
    return rows.select("chunk", *[c for c in rows.columns if c != "chunk"]).mapInArrow(_packer(chunks), "chunk long, data binary")


def _frame(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _gather(most: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([(part << 20) + count], pa.int64()), pa.array([_frame(pa.Table.from_batches(held))], pa.binary())], names=["chunk", "data"])

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES
            a = 0
            while a < batch.num_rows:
                room = np.searchsorted(np.cumsum(lengths[a:]), most - size, "right")
                b = a + int(room) if held or room else a + 1
                if b > a:
                    held.append(batch.slice(a, b - a))
                    size += int(lengths[a:b].sum())
                    a = b
                if a < batch.num_rows or size >= most:
                    yield chunk()
                    held, size, count = [], 0, count + 1
        if held:
            yield chunk()

    return gather


def local_chunks(rows: DataFrame) -> DataFrame:
    """(chunk, data): all of ``rows``, whose last column is text, as compressed Arrow streams of about ``CHUNK_BYTES``
    of text each, made where the rows are. Numbers name chunks only once the result is written and read back."""
    return rows.mapInArrow(_gather(CHUNK_BYTES), "chunk long, data binary")


def unpacked(messages: pa.Array) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(m).read_all() for m in messages.to_pylist()]).combine_chunks()
