"""Documents dealt into chunks, and lists of numbers that chunks send to blocks and get answered.

A chunk is a fixed group of a few thousand documents.  What a chunk finds is
sent to reducers as one binary row for each block of the key space, instead of
a row for each key; a block answers each chunk with one row, in the order of
the chunk's list.  The documents are shuffled once, by chunk, and that exchange
serves every pass over them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, chunk_count, keyed


def dealt(docs: DataFrame) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text) and the number of chunks.

    Rows that are equal in id and text differ in the input partition at best, so
    of them a chunk gets no more than one partition has.  All passes have to see
    the same partitions, so what comes out of a shuffle is fixed by a checkpoint first.
    """
    narrow = keyed(docs)
    if "Exchange" in narrow._jdf.queryExecution().executedPlan().toString():
        narrow = checkpointed(narrow)
    n = chunk_count(narrow)
    return narrow.select(F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n)).cast("int").alias("chunk"), "doc_id", "text"), n


def block_count(n_chunks: int) -> int:
    """Blocks for so many chunks; the messages are chunks times blocks."""
    return max(8, n_chunks // 4)


def in_order(chunk: pa.Table) -> pa.RecordBatch:
    """The chunk's rows in an order that doesn't depend on how they came."""
    chunk = chunk.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    return chunk.to_batches()[0] if chunk.num_rows else pa.RecordBatch.from_pylist([], chunk.schema)


_TOP = 0xFFFF


def packed(sorted_numbers: np.ndarray) -> bytes:
    """Ascending numbers below 2^32 as steps of two bytes, a step of 65535 or more in several, or of four, whichever is shorter.

    An odd length tells the four bytes: they are followed by one more byte.
    """
    steps = np.diff(sorted_numbers.astype(np.int64), prepend=0)
    full = steps // _TOP
    extra = int(full.sum())
    if extra > len(steps):
        return steps.astype("<u4").tobytes() + b"\0"
    if not extra:
        return steps.astype("<u2").tobytes()
    out = np.full(extra + len(steps), _TOP, np.int64)
    out[np.cumsum(full + 1) - 1] = steps % _TOP
    return out.astype("<u2").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if len(data) % 2:
        return np.cumsum(np.frombuffer(data, "<u4", len(data) // 4).astype(np.int64))
    steps = np.frombuffer(data, "<u2").astype(np.int64)
    return np.cumsum(steps)[steps < _TOP]


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def by_block(sorted_blocks: np.ndarray) -> list[tuple[int, int, int]]:
    """(block, start, end) of each run."""
    if not len(sorted_blocks):
        return []
    cut = np.flatnonzero(sorted_blocks[1:] != sorted_blocks[:-1]) + 1
    start, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(sorted_blocks)]))
    return list(zip(sorted_blocks[start].tolist(), start.tolist(), end.tolist(), strict=True))
