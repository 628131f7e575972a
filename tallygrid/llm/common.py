"""What the operators share: table access, size estimates, and vectorised byte-level text scanning.

Texts are handled as the raw UTF-8 buffer of an Arrow column.  A *word* is a
maximal run of bytes other than space and ``\\x09-\\x0D``; those six bytes are
ASCII, so byte runs and code-point runs are the same.  Word and window hashes
are 64-bit and computed with numpy over the buffer, never per Python object.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; the temporaries take some forty times as much.
SLICE_BYTES = 1 << 20
#: Text of a chunk, and the size of a corpus from which on chunks grow.
CHUNK_BYTES = 7 << 19
LARGE_BYTES = 64 << 30

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
_M1, _M2, _STEP = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of ``spark.checkpoint.dir``, or one in the warehouse where none is set."""
    context, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return df.checkpoint()


def boxed(df: DataFrame, name: str = "row") -> DataFrame:
    """All columns in one struct, so that no name of theirs can clash with one that is added."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them as far as columns have them already."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """At most n rows in an Arrow batch of what is run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts, measured by one pass over that column."""
    return int(df.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0)


def chunk_count(df: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Into how many chunks a corpus is dealt so that one holds about ``chunk_bytes`` of text, and each shuffle task some."""
    return max(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), chunks_for(text_bytes(df), chunk_bytes))


def chunks_for(total: int, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Chunks exchange messages with blocks, of which there are a quarter as many.  Beyond ``LARGE_BYTES`` of text a chunk
    grows with the square root of the corpus, so that the number of messages stays in proportion to the corpus."""
    return int(total / (chunk_bytes * max(1.0, (total / LARGE_BYTES) ** 0.5)))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of text; a longer document is a run of its own."""
    _, offsets = flat(batch.column(text))
    start, n = 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of each word, and the number of words before each document (one more entry at the end)."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (np.concatenate(([True], ~solid[:-1])) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(solid & (np.concatenate((~solid[1:], [True])) | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    return starts, ends - starts, np.searchsorted(starts, offsets)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes, eight bytes a step."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    h = mixed(lengths.astype(np.uint64) + np.uint64((seed + 1) * int(_STEP) % 2**64))
    todo, at = np.arange(len(starts)), 0
    while len(todo):
        left = lengths[todo] - at
        h[todo] = mixed((h[todo] ^ (eights[starts[todo] + at] & _MASKS[np.minimum(left, 8)])) + _STEP)
        todo, at = todo[left > 8], at + 8
    return h


def window_hashes(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each run of ``size`` words that lies in one document, in order."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.full(n, size, np.uint64) * _STEP
    for k in range(size):
        total = total * _M1 + h[k : k + n]
    crossing = np.zeros(len(h) + 1, bool)
    for k in range(1, size):
        at = first[1:-1] - k
        crossing[at[at >= 0]] = True
    at = np.flatnonzero(~crossing[:n])
    return mixed(total[at]), at


def run_ends(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(values)]))


def keyed(df: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, whatever other columns there are."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
