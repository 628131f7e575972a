"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

A short item inside a long document has a tiny Jaccard similarity to it, so
whole-document MinHash can't see it.  Items are therefore partitioned by their
number of shingles, the bound of a partition being ``u = 2^k``; for each
partition the document is read in windows of ``2u`` shingles at a stride of
``u``, one of which holds any passage of ``u`` shingles whole.  Within such a
window an item of more than ``u/2`` shingles contained to a degree ``t`` has a
Jaccard similarity of at least ``t/(5-t)`` (0.19 at 0.8), which turns the
containment threshold into a fixed collision probability for the whole
partition: with ``N_HASHES`` one-row bands a contained item is missed with
probability below ``(1-0.19)^64``, about 1e-6.  Every candidate is then
verified: the exact share of the item's distinct shingles (as strings) that
the whole document has.

The benchmark is a stated set of queries.  It is taken in blocks of about
``BLOCK_BYTES`` (one block where it is smaller), each sent to the tasks that
scan the documents; documents are neither shuffled nor collected.

Words are maximal runs of word characters, lower-cased, so punctuation and
layout do not hide a passage.

Defined results: null or empty texts match nothing, as do items of fewer words
than a shingle; very long texts are searched whole; repeated documents or items
are each reported, and so are ties, an item in several documents or a document
with several items; null ids are carried as null; an empty table on either side
gives no rows; other columns are ignored, and kept, whatever their names, by
:func:`without_contaminated`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _STEP, boxed, flat, mixed, slices, table, window_hashes, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
N_HASHES = 64
BLOCK_BYTES = 16 << 20

_WORD = re.compile(r"\w+")
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), 95, *range(97, 123), *range(128, 256)]] = True

SCHEMA = "doc_id {}, item_id long, shared long, item_shingles long, containment double"


def shingles_of(text: str, size: int = SHINGLE) -> set[str]:
    found = _WORD.findall(text.lower())
    return {" ".join(found[k : k + size]) for k in range(len(found) - size + 1)}


def _hashed_shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every shingle in order."""
    texts = [t.lower() for t in texts]
    data, offsets = flat(pa.array(texts, pa.large_string()))
    data = np.where(_wordy(data, texts), data, np.uint8(32))
    solid = data != 32
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid & (np.concatenate(([True], ~solid[:-1])) | edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(solid & (np.concatenate((~solid[1:], [True])) | edge[1:])) + 1 if len(data) else np.zeros(0, np.int64)
    first = np.searchsorted(starts, offsets)
    hashes, at = window_hashes(word_hashes(data, starts, ends - starts), first, size)
    return hashes, np.searchsorted(first, at, "right") - 1


def _wordy(data: np.ndarray, texts: list[str]) -> np.ndarray:
    """Which bytes belong to word characters.  Bytes over 127 do, except those of other characters, which are looked up."""
    wordy = _WORD_BYTE[data]
    odd = {c for c in set().union(*map(set, texts)) if ord(c) > 127 and not _WORD.match(c)} if texts else set()
    if odd:
        whole = data.tobytes()
        for c in odd:
            code = c.encode()
            for m in re.finditer(re.escape(code), whole):
                wordy[m.start() : m.end()] = False
    return wordy


class _Block:
    """Sketches of some items, by size partition."""

    def __init__(self, items: list[tuple[int | None, str]], size: int, n_hashes: int):
        self.size, self.n_hashes = size, n_hashes
        self.ids = [i for i, _ in items]
        self.shingles = [shingles_of(t, size) for _, t in items]
        self.partitions: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        hashes, rows = _hashed_shingles([t for _, t in items], size)
        by_bound: dict[int, list[int]] = {}
        for k, s in enumerate(self.shingles):
            if s:
                by_bound.setdefault((len(s) - 1).bit_length(), []).append(k)
        for power, members in by_bound.items():
            own = [np.unique(hashes[rows == k]) for k in members]
            self.partitions[1 << power] = []
            for j in range(n_hashes):
                least = np.array([_permuted(h, j).min() for h in own])
                order = np.argsort(least, kind="stable")
                self.partitions[1 << power].append((least[order], np.array(members)[order]))

    def candidates(self, hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> set[tuple[int, int]]:
        """(row, item) pairs whose sketches meet in some window."""
        found: set[tuple[int, int]] = set()
        if not len(hashes):
            return found
        firsts = np.searchsorted(rows, np.arange(n_rows + 1))
        for bound, sketches in self.partitions.items():
            # The blocks of ``bound`` shingles of each document; a window is a block and the next of the same document.
            counts = -(-np.diff(firsts) // bound)
            owner = np.repeat(np.arange(n_rows), counts)
            start = firsts[owner] + bound * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts))
            for j, (least, members) in enumerate(sketches):
                low = np.minimum.reduceat(_permuted(hashes, j), start)
                # An item's least value is some block's own least value where the window's is.
                lo, hi = np.searchsorted(least, low, "left"), np.searchsorted(least, low, "right")
                for b in np.flatnonzero(hi > lo):
                    found.update((int(owner[b]), int(m)) for m in members[lo[b] : hi[b]])
        return found


def _permuted(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th of a family of orders of the hashes."""
    h = (h ^ np.uint64((j + 1) * int(_STEP) % 2**64)) * (mixed(np.array([2 * j + 1], np.uint64)) | np.uint64(1))
    return h ^ (h >> np.uint64(32))


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in part.collect()]


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, n_hashes: int = N_HASHES, id_type: str = "long") -> DataFrame:
    """One row for each pair of a document and an item that it contains to a degree of ``threshold`` or more."""
    narrow, schema, parts = docs.select(F.col("doc_id").cast(id_type).alias("doc_id"), F.col("text").cast("string").alias("text")), SCHEMA.format(id_type), []
    for items_of_block in _blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(_Block(items_of_block, size, n_hashes)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = cloudpickle.loads(shared.value)
            for batch in batches:
                rows = []
                for part in slices(batch, "text"):
                    texts = [x or "" for x in part.column("text").to_pylist()]
                    ids = part.column("doc_id").to_pylist()
                    pairs, known = block.candidates(*_hashed_shingles(texts, size), len(texts)), {}
                    for r, k in sorted(pairs):
                        if r not in known:
                            known = {r: shingles_of(texts[r], size)}
                        both, all_of = len(block.shingles[k] & known[r]), len(block.shingles[k])
                        if both >= threshold * all_of:
                            rows.append((ids[r], block.ids[k], both, all_of, both / all_of))
                if rows:
                    kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "shared", "item_shingles", "containment"])

        parts.append(narrow.mapInArrow(search, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """The documents that contain no item to a degree of ``threshold``.

    Whether one does depends on its text alone, so documents go by a 128-bit digest of the text: null ids and rows that share an id are told apart.
    """
    rows = boxed(docs).withColumn("own", F.md5(F.encode(F.coalesce(F.col("row.text").cast("string"), F.lit("")), "UTF-8")))
    found = contaminated(rows.select(F.col("own").alias("doc_id"), F.col("row.text").alias("text")), items, threshold, size, id_type="string").select(F.col("doc_id").alias("own")).distinct()
    return rows.join(found, "own", "left_anti").select("row.*")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
