"""Exact Jaccard similarity join of documents' shingle sets, to connected components.

The Jaccard distance ``d`` is a metric, and the join uses it as one: documents
gather in Voronoi regions around pivots, and the triangle inequality says in
which windows of distance from the pivot two linked documents can lie.  Taken
alone, pivots cannot divide a text corpus: a document that shares no shingle
with a pivot is at distance exactly 1 from it, and nearly every pair is.  So
the places where documents may meet are found by prefix shingles, which is
exact as well: with shingles in one global order, two linked documents share
one of the first ``n - ceil(t n) + 1`` of their ``n``; and if their first
common shingle has ``i`` and ``j`` others before it, their sets differ in
``i + j`` shingles at least, of the share ``(1-t)/(1+t)`` of their sizes that
linked sets may differ in.

1. The order is rarest first.  Document frequencies come from merged count
   sketches, as in substring deduplication: chunks send cells and counts,
   blocks add up and answer.  Any order gives right results; and as counts are
   never too low, a shingle counted once has no partner and is dropped.
2. Of equal sets in a chunk, one sends its prefix shingles with their places to
   blocks, which keep those that several have and whose places leave room.
3. Of a shingle's documents the one whose shingles are the most frequent is a
   pivot: in a family of copies that is the least edited.  Each document is
   compared with the pivot it shares most prefix shingles with, and so has a
   region and its distance ``off`` from the region's pivot.  Those within ``1-t`` link with
   it: a group of copies costs its size, not its square.
4. The regions, merged by these links, join again: each document is compared
   with one pivot that it met in another component.
5. Documents of *different* components that share a prefix shingle join exactly.
   The join's key is the shingle, the region and a ring of width ``1-t`` in
   ``off``, a document being copied to each ring that its window
   ``off +- (1-t)`` reaches; for documents of two regions, the shingle alone.
   A pair's lesser place is below half the room, so of each shingle's documents
   those with a larger one (the followers) meet leaders only.  Places, ring and
   component are conditions of the join, so other pairs are never made.

Every comparison is of whole sets of 64-bit shingle hashes.  Documents of no
words link with nothing; those with fewer words than a shingle have their whole
word sequence as one.  Links within a component that its other links make
known are not looked for: the result is components, not all pairs.

Defined results: null texts are empty; rows with a null ``doc_id`` take part
and get the least id of their component, or null; rows with one ``doc_id`` are
separate documents; ties of place or distance go to the least node; very long
texts are one set like others; an empty table gives no rows; other columns are
ignored by :func:`similar_components` and kept, whatever their names, by
:func:`without_copies`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import block_count, by_block, dealt, in_order, packed, unpacked
from .common import arrow_rows, boxed, checkpointed, flat, lowered, slices, table, window_hashes, word_hashes, words
from .components import components

CELL_BITS = 26
_MOST = 0xFFFF

_SENT = "block int, chunk int, n int, keys binary, counts binary"
_ANSWER = "chunk int, block int, n int, counts binary"
#: kind 0: prefix shingles of documents for a block; kind 1: a document.
_FOUND = "kind int, block int, node long, doc_id long, print string, size long, twin long, active boolean, shingles binary, nodes binary, places binary, sizes binary, scores binary"
_MET = "shingle long, node long, first long, place int, size int"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data = lowered(data)
    starts, lengths, first = words(data, offsets)
    h = word_hashes(data, starts, lengths)
    hashes, at = window_hashes(h, first, size)
    cut = np.searchsorted(at, first)
    out = []
    for k, n in enumerate(np.diff(first).tolist()):
        if 0 < n < size:
            own = h[first[k] : first[k + 1]]
            out.append(window_hashes(own, np.array([0, n]), n)[0])
        else:
            out.append(np.unique(hashes[cut[k] : cut[k + 1]]))
    return out


class _Chunk:
    """The shingle sets of a chunk's documents."""

    def __init__(self, rows: pa.RecordBatch, size: int, n_blocks: int):
        self.ids = rows.column("doc_id").to_pylist()
        texts = [x or b"" for x in rows.column("text").cast(pa.large_binary()).to_pylist()]
        self.prints = [hashlib.md5(x).hexdigest() for x in texts]
        self.sets: list[np.ndarray] = []
        for part in slices(rows, "text"):
            self.sets += shingle_sets(*flat(part.column("text")), size)
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.all = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
        full = (self.all >> np.uint64(64 - CELL_BITS)) | ((self.all % np.uint64(n_blocks)) << np.uint64(CELL_BITS))
        self.cells, self.inverse, count = np.unique(full, return_inverse=True, return_counts=True)
        self.count = np.minimum(count, _MOST)
        self.blocks = by_block(self.cells >> np.uint64(CELL_BITS))


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.Table.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def _frequencies(docs_by_chunk, size: int, n_blocks: int) -> DataFrame:
    """Answers to the chunks: documents counted in each of their cells."""
    mask = np.uint64((1 << CELL_BITS) - 1)

    def sketch(key: tuple[pa.Scalar, ...], own: pa.Table) -> pa.Table:
        chunk, number = _Chunk(in_order(own), size, n_blocks), key[0].as_py()
        return _table(_SENT, [(b, number, e - s, packed(chunk.cells[s:e] & mask), chunk.count[s:e].astype("<u2").tobytes()) for b, s, e in chunk.blocks])

    def merge(key: tuple[pa.Scalar, ...], sent: pa.Table) -> pa.Table:
        sizes = sent.column("n").to_pylist()
        count = np.concatenate([np.frombuffer(x, "<u2") for x in sent.column("counts").to_pylist()]).astype(np.int64)
        cells, inverse = np.unique(np.concatenate([unpacked(x).astype(np.uint32) for x in sent.column("keys").to_pylist()]), return_inverse=True)
        total = np.minimum(np.bincount(inverse, count, len(cells)), _MOST).astype("<u2")[inverse]
        at = np.concatenate(([0], np.cumsum(sizes)))
        return _table(_ANSWER, [(c, key[0].as_py(), n, total[a : a + n].tobytes()) for c, n, a in zip(sent.column("chunk").to_pylist(), sizes, at.tolist(), strict=False)])

    return docs_by_chunk.applyInArrow(sketch, _SENT).groupBy("block").applyInArrow(merge, _ANSWER)


def _placed_prefixes(chunk: _Chunk, frequency: np.ndarray, number: int, percent: int, n_blocks: int) -> pa.Table:
    """The documents, and the prefix shingles that others may share, with the number of shingles before each."""
    least = frequency[chunk.inverse]  # of each document's shingles, in the order of chunk.all
    logs = np.log2(np.maximum(least, 1), dtype=np.float32)
    ends, first = np.cumsum(chunk.sizes), number << 32
    same: dict[bytes, int] = {}
    rows: list[tuple] = []
    shingles, nodes, places, sizes, scores = ([] for _ in range(5))
    for k, s in enumerate(chunk.sets):
        whole = s.tobytes()
        twin = same.setdefault(whole, k) if len(s) else k
        kept = 0
        if twin == k and len(s):
            own = least[ends[k] - len(s) : ends[k]]
            prefix = np.lexsort((s, own))[: len(s) - -(-percent * len(s) // 100) + 1]
            at = np.flatnonzero(own[prefix] > 1)
            if kept := len(at):
                shingles.append(s[prefix[at]])
                places.append(at)
                nodes.append(np.full(kept, first + k))
                sizes.append(np.full(kept, len(s)))
                scores.append(np.full(kept, 4000 * logs[ends[k] - len(s) : ends[k]].mean()))
        rows.append((1, None, first + k, chunk.ids[k], chunk.prints[k], len(s), first + twin, kept > 0, whole if kept else None, None, None, None, None))
    if shingles:
        t, node, place, size = np.concatenate(shingles), np.concatenate(nodes), np.concatenate(places).astype("<i4"), np.concatenate(sizes).astype("<i4")
        score = np.concatenate(scores).astype("<u2")
        block = t % np.uint64(n_blocks)
        order = np.lexsort((t, block))
        for b, s, e in by_block(block[order]):
            at = order[s:e]
            rows.append((0, b, None, None, None, None, None, None, t[at].tobytes(), node[at].tobytes(), place[at].tobytes(), size[at].tobytes(), score[at].tobytes()))
    return _table(_FOUND, rows)


def _met(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Of one block: the documents of each shingle that several have, and the first of them: the one whose shingles are the most frequent.

    Documents for which the places leave room for no other are left out.
    """
    types = {"shingles": np.uint64, "nodes": np.int64, "places": "<i4", "sizes": "<i4", "scores": "<u2"}
    parts: dict[str, list[np.ndarray]] = {c: [] for c in types}
    for batch in batches:
        for c, found in parts.items():
            found += [np.frombuffer(x, types[c]) for x in batch.column(c).to_pylist()]
    t, p, place, size, score = (np.concatenate(found) for found in parts.values())
    order = np.lexsort((p, place, t))
    t, p, place, size, score = (x[order] for x in (t, p, place, size, score))
    start = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(t))))
    second = np.append(place, 1 << 30)[start + 1]  # only of use where the run has a second
    other = np.where(np.arange(len(t)) == start[run], second[run], place[start][run])
    keep = (np.bincount(run)[run] > 1) & (place + other.astype(np.int64) <= share * (size + np.maximum.reduceat(size, start)[run].astype(np.int64)) + 1e-9)
    t, p, place, size, score = (x[keep] for x in (t, p, place, size, score))
    order = np.lexsort((p, -score.astype(np.int64), t))
    t, p, place, size = (x[order] for x in (t, p, place, size))
    new = np.concatenate(([True], t[1:] != t[:-1])) if len(t) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    several = np.bincount(run, minlength=1)[run] > 1 if len(t) else new
    columns = [t.view(np.int64), p, p[new][run] if len(t) else p, place, size]
    yield pa.RecordBatch.from_arrays([pa.array(c[several]) for c in columns], [c.split()[0] for c in _MET.split(", ")])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds both (size of the intersection) and union to distinct pairs (a, b)."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, union = [], []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both.append(_shared(x, y))
                union.append(len(x) + len(y) - both[-1])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(both, pa.int64()), pa.array(union, pa.int64())], ["a", "b", "both", "union"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(count, "a long, b long, both long, union long")


def links_and_documents(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) links enough for the components, and the documents: node, doc_id, print, size."""
    rows, n_chunks = dealt(docs)
    n_blocks = block_count(n_chunks)
    chunks = rows.groupBy("chunk")

    def placed(key: tuple[pa.Scalar, ...], own: pa.Table, answers: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _table(_FOUND, [])
        chunk = _Chunk(in_order(own), size, n_blocks)
        known = {b: np.frombuffer(c, "<u2") for b, c in zip(answers.column("block").to_pylist(), answers.column("counts").to_pylist(), strict=True)}
        frequency = np.concatenate([known[b] for b, _, _ in chunk.blocks]) if chunk.blocks else np.zeros(0, "<u2")
        return _placed_prefixes(chunk, frequency, key[0].as_py(), percent, n_blocks)

    found = checkpointed(chunks.cogroup(_frequencies(chunks, size, n_blocks).groupBy("chunk")).applyInArrow(placed, _FOUND))
    documents = found.filter("kind = 1").select("node", "doc_id", "print", "size", "twin")
    sets = found.filter("kind = 1 and active").select("node", "shingles")
    share = (100 - percent) / (100 + percent)

    def met(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _met(batches, share)

    groups = checkpointed(found.filter("kind = 0").select("block", "shingles", "nodes", "places", "sizes", "scores").groupBy("block").applyInArrow(met, _MET))
    equal = documents.filter("node != twin").select(F.col("node").alias("a"), F.col("twin").alias("b"))

    # Regions: each document and the pivot it shares most prefix shingles with.
    shared = groups.filter("node != first").groupBy(F.col("node").alias("b"), F.col("first").alias("a")).agg(F.count("*").alias("n"))
    regions = _tested(shared.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")), sets, percent)
    label = components(regions.filter("linked"))
    # Once more across components: a pivot met in another one.
    heads = label.select(F.col("node").alias("first"), F.col("component").alias("head"))
    other = _labelled(groups, label).join(heads, "first", "left").filter(F.coalesce("head", "first") != F.col("component"))
    second = _tested(other.groupBy(F.col("node").alias("b")).agg(F.max("first").alias("a")).join(regions, ["a", "b"], "left_anti"), sets, percent)
    tested = regions.unionAll(second)

    label = components(tested.filter("linked"))
    pairs = _crossing(_labelled(groups, label).join(regions.select(F.col("b").alias("node"), F.col("a").alias("pivot"), F.col("apart").alias("off")), "node", "left"), percent)
    crossing = _tested(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), sets, percent)
    return equal.unionAll(tested.unionAll(crossing).filter("linked").select("a", "b")), documents


def _crossing(placed: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of different components whose places, sizes and distances from a common pivot let them link.

    Columns shingle, node, place, size, component, pivot and off; a pivot without a region is its own.
    """
    slack, most = (100 - percent) / 100 + 1e-9, (100 - percent) / (100 + percent)
    kinds = placed.groupBy("shingle", "component").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("shingle").agg(F.count("*").alias("kinds"), F.max(F.struct("n", "component"))["component"].alias("largest")).filter("kinds > 1").select("shingle", "largest")
    ring = F.floor(F.coalesce("off", F.lit(0.0)) / slack).cast("int")
    placed = placed.join(kinds, "shingle").select(
        "shingle", "node", "place", "size", "component", "largest",
        F.coalesce("pivot", "node").alias("pivot"), F.coalesce("off", F.lit(0.0)).alias("off"), ring.alias("ring"),
        (F.col("place") <= most * F.col("size") * (1 + 100 / percent) / 2 + 1e-9).alias("leader"),
    )
    parts = ("node", "place", "size", "component", "pivot", "off", "leader")
    # The home ring on one side, all rings of the window on the other; -1 stands for other regions.
    cell = lambda pivot, ring: F.struct(F.lit(pivot).alias("pivot") if pivot == -1 else F.col(pivot).alias("pivot"), ring.alias("ring"))
    nowhere = cell(-1, F.lit(0))
    rings = F.transform(F.sequence(F.greatest(F.lit(0), F.floor((F.col("off") - slack) / slack)).cast("int"), F.floor((F.col("off") + slack) / slack).cast("int")), lambda r: cell("pivot", r))
    one = placed.filter("component != largest").select("shingle", F.explode(F.array(cell("pivot", F.col("ring")), nowhere)).alias("cell"), F.when(F.col("leader"), 0).otherwise(1).alias("among"), *[F.col(c).alias(f"{c}1") for c in parts])
    sides = F.when(F.col("leader"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    two = placed.select("shingle", F.explode(F.concat(rings, F.array(nowhere))).alias("cell"), sides.alias("sides"), *[F.col(c).alias(f"{c}2") for c in parts])
    two = two.select("shingle", "cell", F.explode("sides").alias("among"), *[f"{c}2" for c in parts])
    sizes = F.col("size1") + F.col("size2")
    may_link = (
        (F.col("component1") != F.col("component2"))
        & F.when(F.col("cell.pivot") == -1, F.col("pivot1") != F.col("pivot2")).otherwise(F.abs(F.col("off1") - F.col("off2")) <= slack)
        & (F.col("place1") + F.col("place2") <= most * sizes + 1e-9)
        & ((100 + percent) * F.least(F.col("size1") - F.col("place1"), F.col("size2") - F.col("place2")) >= percent * sizes)
    )
    return one.join(two, ["shingle", "cell", "among"]).filter(may_link).select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def _labelled(groups: DataFrame, label: DataFrame) -> DataFrame:
    """Adds the documents' components."""
    return groups.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _tested(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, apart, linked) of distinct pairs, fixed by a checkpoint."""
    apart, linked = 1 - F.col("both") / F.col("union"), F.col("both") * 100 >= F.col("union") * percent
    with arrow_rows(pairs.sparkSession, 500):
        return checkpointed(_compared(pairs.select("a", "b"), sets).select("a", "b", apart.alias("apart"), linked.alias("linked")))


def _placed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The documents and their component (a node)."""
    links, documents = links_and_documents(docs, size, percent)
    return documents.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))


def similar_components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id; two documents link if 100 * intersection >= percent * union."""
    placed = checkpointed(_placed(docs, size, percent))
    # Fixed on its own, so that both sides of the join are dealt out plainly and a large component can be split.
    least = checkpointed(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return placed.join(least, "component").select("doc_id", F.col("size").alias("n_shingles"), "component_id")


def without_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component: the one with the least ``doc_id`` (null comes last).

    Documents are told apart by id and a 128-bit digest of the text, so a row repeated as it is
    stays once, too.  Texts of no words are alike to none and all stay.
    """
    placed = checkpointed(_placed(docs, size, percent))
    own = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "print")
    kept = checkpointed(placed.groupBy("component").agg(F.min(own).alias("kept")))
    extra = placed.join(kept, "component").filter(~own.eqNullSafe(F.col("kept"))).select("doc_id", "print").distinct()
    repeated = placed.filter("size > 0").groupBy("doc_id", "print").count().filter("count > 1").drop("count")
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = boxed(docs).withColumns({"id": F.col("row.doc_id").cast("long"), "own": F.md5(F.encode(text, "UTF-8"))})

    def same(keys: DataFrame) -> Column:
        return rows["id"].eqNullSafe(keys["doc_id"]) & (rows["own"] == keys["print"])

    rows = rows.join(extra, same(extra), "left_anti")
    if not repeated.isEmpty():
        once = rows.join(repeated, same(repeated), "left_semi").dropDuplicates(["id", "own"])
        rows = rows.join(repeated, same(repeated), "left_anti").unionByName(once)
    return rows.select("row.*")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), 4, 85)
