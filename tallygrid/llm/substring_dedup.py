"""Removal of passages that an earlier document has, with a count-min prefilter.

A window is ``WINDOW`` words in a row.  Every word covered by a window that
also starts in a document with a smaller ``doc_id`` goes.

1. Each chunk of documents makes a sketch: the cell of each of its windows (a
   slice of the window's hash), counted by documents and saturating at two,
   which is all that the question "repeated or not" needs.  The sketches go to
   the blocks of the cell space as 16-bit steps and are merged there.  Cells
   can collide, so a merged count is never too low; no repeated window is lost.
   A block answers each chunk with one bit for each cell it sent.
2. Each chunk sends only its windows in cells counted twice or more, by 96
   bits of hash, with the smallest ``doc_id`` that has the window in the
   chunk.  Blocks group them exactly and answer with one bit: whether a smaller
   ``doc_id`` has it elsewhere.
3. Each chunk removes the covered words.

Texts are shuffled once, by chunk.  A window that a third of all documents
share is one entry for each chunk, never one for each document.  The cell space
grows with the number of chunks, so the share of false alarms stays the same.

Defined results: null and empty texts have no words and the hash of the empty
string; documents with a null ``doc_id`` neither lose words nor take any;
rows with the same ``doc_id`` don't take from each other; of equal windows the one
of the least ``doc_id`` stays, ties of one id all do; a very long text is one of
its chunk's documents and read whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import bits, block_count, by_block, dealt, in_order, packed, unbits, unpacked
from .common import flat, run_ends, slices, table, window_hashes, word_hashes, words

WINDOW = 13
#: Cells of one block of the sketch.
CELL_BITS = 26

_SENT = "block int, chunk int, n int, keys binary, more binary, docs binary"
_ANSWER = "chunk int, block int, stage int, n int, answer binary"


class _Chunk:
    """The windows of a chunk: two hashes and the row each belongs to, and what else the passes need."""

    def __init__(self, rows: pa.RecordBatch, size: int):
        ids = rows.column("doc_id")
        self.valid = ~np.asarray(ids.is_null())
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.parts, one, two, row, word = [], [], [], [], []
        done_rows = done_words = 0
        for part in slices(rows, "text"):
            data, offsets = flat(part.column("text"))
            starts, lengths, first = words(data, offsets)
            a, at = window_hashes(word_hashes(data, starts, lengths), first, size)
            b, _ = window_hashes(word_hashes(data, starts, lengths, 1), first, size)
            one.append(a)
            two.append(b)
            row.append(np.searchsorted(first, at, "right") - 1 + done_rows)
            word.append(at + done_words)
            self.parts.append((data, offsets, starts, lengths, first))
            done_rows, done_words = done_rows + part.num_rows, done_words + len(starts)
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.one, self.two, self.row, self.word = join(one, np.uint64), join(two, np.uint64), join(row, np.int64), join(word, np.int64)
        self.n_words = done_words
        if not self.valid.all():
            keep = self.valid[self.row]
            self.one, self.two, self.row, self.word = (x[keep] for x in (self.one, self.two, self.row, self.word))

    def cells(self, n_blocks: int) -> None:
        """The distinct cells in order; which windows lie in each; whether documents of different id do."""
        full = (self.one >> np.uint64(64 - CELL_BITS)) | ((self.one % np.uint64(n_blocks)) << np.uint64(CELL_BITS))
        self.order = np.argsort(full, kind="stable")
        values = full[self.order]
        self.start, self.end = run_ends(values)
        self.cell = values[self.start]
        ids = self.ids[self.row[self.order]]  # ascending in each cell, as rows are in the order of their ids
        self.several = ids[self.start] != ids[self.end - 1] if len(ids) else np.zeros(0, bool)

    def repeated(self, flags: np.ndarray) -> None:
        """Keeps the windows in flagged cells, grouped exactly; of each group the smallest id."""
        size = self.end - self.start
        some = self.order[np.repeat(flags, size)]
        low = (self.two >> np.uint64(32))[some]
        order = np.lexsort((self.ids[self.row[some]], low, self.one[some]))
        self.some, low = some[order], low[order]
        one = self.one[self.some]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (low[1:] != low[:-1])
        at = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.key, self.low, self.least = one[at], low[at], self.ids[self.row[self.some[at]]]


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [{"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}[c.split()[1]] for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _answers(replies: pa.Table, stage: int, blocks: list[tuple[int, int, int]]) -> np.ndarray:
    """The bits of one stage's answers in the order of the chunk's list."""
    known = {b: (n, a) for b, s, n, a in zip(*(replies.column(c).to_pylist() for c in ("block", "stage", "n", "answer")), strict=True) if s == stage}
    parts = [unbits(known[b][1], known[b][0]) for b, _, _ in blocks]
    return np.concatenate(parts) if parts else np.zeros(0, bool)


def _cell_blocks(chunk: _Chunk) -> list[tuple[int, int, int]]:
    return by_block(chunk.cell >> np.uint64(CELL_BITS))


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by spaces)."""
    rows, n_chunks = dealt(docs)
    n_blocks = block_count(n_chunks)
    mask = np.uint64((1 << CELL_BITS) - 1)
    chunks = rows.groupBy("chunk")

    def sketch(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        chunk = _Chunk(in_order(own), size)
        chunk.cells(n_blocks)
        number = key[0].as_py()
        return _table(_SENT, [(b, number, e - s, packed(chunk.cell[s:e] & mask), bits(chunk.several[s:e]), b"") for b, s, e in _cell_blocks(chunk)])

    def merge(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        lists = [unpacked(x) for x in sent.column("keys").to_pylist()]
        sizes = sent.column("n").to_pylist()
        count = np.concatenate([unbits(x, n) for x, n in zip(sent.column("more").to_pylist(), sizes, strict=True)]).astype(np.int64) + 1
        cells, inverse = np.unique(np.concatenate(lists), return_inverse=True)
        twice = np.bincount(inverse, count, len(cells))[inverse] >= 2
        at = np.concatenate(([0], np.cumsum(sizes)))
        return _table(_ANSWER, [(c, key[0].as_py(), 1, n, bits(twice[a : a + n])) for c, n, a in zip(sent.column("chunk").to_pylist(), sizes, at.tolist(), strict=False)])

    def repeated(key: tuple[pa.Scalar, ...], own: pa.Table, replies: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _table(_SENT, [])
        chunk = _Chunk(in_order(own), size)
        chunk.cells(n_blocks)
        chunk.repeated(_answers(replies, 1, _cell_blocks(chunk)))
        number, order, blocks = key[0].as_py(), *_group_blocks(chunk, n_blocks)
        out = []
        for b, s, e in blocks:
            at = order[s:e]
            out.append((b, number, e - s, chunk.key[at].tobytes(), chunk.low[at].astype("<u4").tobytes(), chunk.least[at].tobytes()))
        return _table(_SENT, out)

    def group(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        one, low, ids = (np.concatenate([np.frombuffer(x, t) for x in sent.column(c).to_pylist()]) for c, t in (("keys", np.uint64), ("more", "<u4"), ("docs", np.int64)))
        order = np.lexsort((ids, low, one))
        a, b = one[order], low[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        smaller = np.zeros(len(a), bool)
        smaller[order] = least < ids[order]
        sizes = sent.column("n").to_pylist()
        at = np.concatenate(([0], np.cumsum(sizes)))
        return _table(_ANSWER, [(c, key[0].as_py(), 2, n, bits(smaller[s : s + n])) for c, n, s in zip(sent.column("chunk").to_pylist(), sizes, at.tolist(), strict=False)])

    def finish(key: tuple[pa.Scalar, ...], own: pa.Table, replies: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _table(_RESULT, [])
        ordered = in_order(own)
        chunk = _Chunk(ordered, size)
        chunk.cells(n_blocks)
        chunk.repeated(_answers(replies, 1, _cell_blocks(chunk)))
        order, blocks = _group_blocks(chunk, n_blocks)
        elsewhere = np.zeros(len(chunk.key), bool)
        elsewhere[order] = _answers(replies, 2, blocks)
        ids = chunk.ids[chunk.row[chunk.some]]
        gone = chunk.word[chunk.some[elsewhere[chunk.group] | (chunk.least[chunk.group] < ids)]]
        cover = np.zeros(chunk.n_words + 1, np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + size, -1)
        return _kept(ordered, chunk, np.cumsum(cover[:-1]) == 0)

    first = chunks.applyInArrow(sketch, _SENT).groupBy("block").applyInArrow(merge, _ANSWER)
    second = chunks.cogroup(first.groupBy("chunk")).applyInArrow(repeated, _SENT).groupBy("block").applyInArrow(group, _ANSWER)
    return chunks.cogroup(first.unionAll(second).groupBy("chunk")).applyInArrow(finish, _RESULT)


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _group_blocks(chunk: _Chunk, n_blocks: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    block = chunk.key % np.uint64(n_blocks)
    order = np.argsort(block, kind="stable")
    return order, by_block(block[order])


def _kept(rows: pa.RecordBatch, chunk: _Chunk, keep: np.ndarray) -> pa.Table:
    """The result rows; ``keep`` says of each word whether it stays."""
    out, at, row = [], 0, 0
    ids = rows.column("doc_id").to_pylist()
    for data, offsets, starts, lengths, first in chunk.parts:
        own = keep[at : at + len(starts)]
        left = np.diff(np.concatenate(([0], np.cumsum(own)))[first])
        s, e = starts[own], (starts + lengths)[own]
        last = np.cumsum(left) - 1
        inner = np.ones(len(s), bool)
        inner[last[left > 0]] = False  # no space after a document's last word
        text = np.append(data, np.uint8(32))
        text[e[inner]] = 32
        edge = np.zeros(len(data) + 2, np.int64)
        np.add.at(edge, s, 1)
        np.add.at(edge, e + inner, -1)
        mask = np.cumsum(edge[:-2]) > 0
        kept = text[:-1][mask].tobytes()
        cut = np.concatenate(([0], np.cumsum(mask)))[offsets]
        for k, n in enumerate(np.diff(first).tolist()):
            text_left = kept[cut[k] : cut[k + 1]]
            out.append((ids[row + k], n, n - int(left[k]), hashlib.sha256(text_left).hexdigest(), text_left.decode()))
        at, row = at + len(starts), row + len(offsets) - 1
    return _table(_RESULT, out)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.col("kept_sha256"))
