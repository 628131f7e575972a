"""Near-duplicate groups by SuperMinHash signatures, banding, exact verification and union-find.

An element of a document's shingle set draws a random permutation of the
signature's places and a random fraction for each of its ranks; a place keeps
the least ``rank + fraction`` that falls on it.  The places of an element are
all different, so those of a signature hang together and estimate with less
variance than independent minima.  All elements take their first rank, then
their second, and so on; a place that a rank has filled can't change at a later
one, so a document stops as soon as all its places are filled: after one rank
if its set is large.

1. Each document is read once and gives a narrow row: id, digest of its text in
   lower case, set size and band keys, each a hash of ``ROWS`` places.  With 36
   bands of 5 places, a pair at the threshold of 0.85 shares none with
   probability 7e-10 (at 0.8 with 6e-7).
2. Equal texts are one node.  Band keys that several nodes have are the places
   where documents meet; a place's pivot is the node whose own places are the
   fullest: in a family of copies, the least edited one.
3. Every node is verified on full sets against the pivot it shares most places
   with, then against one of another group; links become groups by union-find,
   in rounds over a table.
4. Nodes of *different* groups that share a place are verified pairwise, as far
   as three bounds let them link: sizes; distances from a common pivot (Jaccard
   distance is a metric, so the join's key has a ring of distances, a node being
   copied to all rings of its window); and odd sketches, bitmaps of how often,
   modulo two, the set's shingles fall on each of 1,024 bits.  Two sets differ in
   at least as many shingles as their bitmaps in bits, so no link is lost.

So no group is expanded into its pairs, and links that others make known are
not looked for: the result is groups.

Defined results: null and empty texts have no set and are alone; texts of fewer
words than a shingle have their whole sequence as one; rows with one ``doc_id``
are separate documents; a null ``doc_id`` takes part and gets the least id of
its group, or null; repeated rows are in one group; ties go to the least node;
very long texts are hashed piece by piece and are one set; an empty table gives
no rows; other columns are ignored by :func:`near_duplicates` and kept, whatever
their names, by :func:`without_near_duplicates`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_BYTES, boxed, checkpointed, flat, lowered, mixed, slices, table, window_hashes, word_hashes, words
from .components import components
from .jaccard_join import _labelled, _tested

BANDS = 36
ROWS = 5
ODD_LONGS = 16

_STEP = 0x9E3779B97F4A7C15
_OPEN = np.uint64(2**64 - 1)
_FRACTION = 40
_LONG_WORD = 1 << 10
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def signatures(elements: np.ndarray, first: np.ndarray, places: int) -> np.ndarray:
    """(documents, places) of the sets ``elements[first[k]:first[k + 1]]`` of 64-bit hashes; an empty set leaves all places open."""
    n = len(first) - 1
    out = np.full(n * places, _OPEN)
    doc, h = np.repeat(np.arange(n), np.diff(first)), elements
    # An element's permutation is a shuffle that gets as far as it is needed; it is only kept for elements that go on.
    kind = np.uint8 if places <= 256 else np.uint16
    order = np.zeros((0, places), kind)
    for rank in range(places):
        if not len(h):
            break
        x = mixed(h + np.uint64((rank + 1) * _STEP % 2**64))
        pick = rank + ((x >> np.uint64(_FRACTION)) % np.uint64(places - rank)).astype(np.int64)
        own = np.arange(len(h))
        place = order[own, pick].astype(np.int64) if rank else pick
        np.minimum.at(out, doc * places + place, (x & np.uint64((1 << _FRACTION) - 1)) | np.uint64(rank << _FRACTION))
        on = (out == _OPEN).reshape(n, places).any(1)[doc]
        if rank:
            order[own, pick] = order[:, rank]
            order = order[on]
        else:
            order = np.tile(np.arange(places, dtype=kind), (int(on.sum()), 1))
            order[np.arange(len(order)), pick[on]] = 0
        doc, h = doc[on], h[on]
    return out.reshape(n, places)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """(documents, bands) 64-bit keys, each of its own run of places."""
    rows = signature.reshape(len(signature), bands, -1)
    key = np.tile(mixed(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_STEP)), (len(signature), 1))
    for k in range(rows.shape[2]):
        key = mixed((key ^ rows[:, :, k]) + np.uint64(_STEP))
    return key.view(np.int64)


def _hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts in lower case, and how many come before each text; a long text goes by pieces cut at white space."""
    if len(data) <= 2 * SLICE_BYTES or len(offsets) != 2:
        return _plain_hashes(data, offsets)
    parts, at = [], 0
    while at < len(data):
        end, gap = at + SLICE_BYTES, np.zeros(0, np.int64)
        while end < len(data) and not len(gap):
            gap = np.flatnonzero(np.isin(data[end : end + SLICE_BYTES], (32, 9, 10, 11, 12, 13)))
            end += int(gap[0]) if len(gap) else SLICE_BYTES
        piece = data[at:end]
        parts.append(_plain_hashes(piece, np.array([0, len(piece)]))[0])
        at = end
    h = np.concatenate(parts)
    return h, np.array([0, len(h)])


def _plain_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = lowered(data)
    starts, lengths, first = words(data, offsets)
    long = np.flatnonzero(lengths > _LONG_WORD)
    h = word_hashes(data, starts, np.minimum(lengths, _LONG_WORD))
    for k in long.tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : starts[k] + lengths[k]].tobytes(), digest_size=8).digest(), "little")
    return h, first


def shingle_sets(batch: pa.RecordBatch, size: int) -> Iterator[list[np.ndarray]]:
    """Sorted distinct shingle hashes of the batch's texts, some documents at a time."""
    for part in slices(batch, "text"):
        h, first = _hashed_words(*flat(part.column("text")))
        hashes, at = window_hashes(h, first, size)
        cut, out = np.searchsorted(at, first), []
        for k, n in enumerate(np.diff(first).tolist()):
            if 0 < n < size:
                out.append(window_hashes(h[first[k] : first[k + 1]], np.array([0, n]), n)[0])
            else:
                out.append(np.unique(hashes[cut[k] : cut[k + 1]]))
        yield out


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(F.translate(text, _UPPER, _UPPER.lower()), "UTF-8")))


def _narrow(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(text).alias("digest"), text.alias("text"))


def signed(docs: DataFrame, size: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, digest, size, bands) of each document; of equal texts in a batch one has bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, at, seen = batch.column("digest").to_pylist(), 0, set()
            for sets in shingle_sets(batch, size):
                own = digests[at : at + len(sets)]
                first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                keys = band_keys(signatures(np.concatenate(sets), first, bands * rows), bands)
                new = [len(s) > 0 and d not in seen and not seen.add(d) for s, d in zip(sets, own, strict=True)]
                listed = pa.array([k if there else None for k, there in zip(keys, new, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(sets)), pa.array(own, pa.binary()), pa.array(np.diff(first)), listed], ["doc_id", "digest", "size", "bands"])
                at += len(sets)

    return _narrow(docs).mapInArrow(sign, "doc_id long, digest binary, size long, bands array<long>")


def _places(nodes: DataFrame) -> DataFrame:
    """(shingle, node, first, size): the nodes of each band key that several have, and the key's pivot.

    A band key takes the part of a prefix shingle in the metric-space join, whose steps serve here too.
    """
    placed = nodes.select("node", "size", F.explode("bands").alias("shingle"))
    # Counts are fixed on their own, so that both sides of the joins are dealt out plainly and a frequent key can be split.
    counts = checkpointed(placed.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1"))
    met = checkpointed(placed.join(counts, "shingle"))
    full = met.groupBy("node").agg(F.sum(F.log2("n")).alias("full"))
    pivots = checkpointed(met.join(full, "node").groupBy("shingle").agg(F.max_by("node", F.struct("full", -F.col("node"))).alias("first")))
    return checkpointed(met.join(pivots, "shingle").select("shingle", "node", "first", "size"))


def _odd(elements: np.ndarray) -> np.ndarray:
    """The parity of the number of elements on each bit."""
    bits = np.bincount((elements % np.uint64(64 * ODD_LONGS)).astype(np.int64), minlength=64 * ODD_LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sets(docs: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """(node, shingles, odd): the full sets of the nodes that met another, from one document of each, and their odd sketches."""
    rows = _narrow(docs)
    own = (rows["digest"] == needed["digest"]) & rows["doc_id"].eqNullSafe(needed["doc_id"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for sets in shingle_sets(batch, size):
                odd = pa.array([_odd(s) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary()), odd], ["node", "shingles", "odd"])
                at += len(sets)

    return checkpointed(rows.join(needed, own).select("node", "text").mapInArrow(make, "node long, shingles binary, odd array<long>").dropDuplicates(["node"]))


def _apart(placed: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of different components that share a place and may link by size, distance from the pivot and odd sketch.

    Columns shingle, node, size, component, pivot, off and odd; a node without a pivot is its own.
    """
    slack = (100 - percent) / 100 + 1e-9
    kinds = placed.groupBy("shingle", "component").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.count("*").alias("kinds"), F.max(F.struct("n", "component"))["component"].alias("largest"))
    kinds = checkpointed(kinds.filter("kinds > 1").select("shingle", "largest"))
    placed = placed.join(kinds, "shingle").withColumns({"pivot": F.coalesce("pivot", "node"), "off": F.coalesce("off", F.lit(0.0))})
    parts = ("node", "size", "component", "pivot", "off", "odd")
    ring = lambda off: F.greatest(F.lit(0), F.floor(off / slack)).cast("int")
    cell = lambda pivot, ring: F.struct(pivot.alias("pivot"), ring.alias("ring"))
    nowhere = cell(F.lit(-1).cast("long"), F.lit(0))  # where nodes of two regions meet
    window = F.transform(F.sequence(ring(F.col("off") - slack), ring(F.col("off") + slack)), lambda r: cell(F.col("pivot"), r))
    # A pair of different components has one outside the largest at least: that one is in its home ring, the other one in its window.
    one = placed.filter("component != largest").select("shingle", F.explode(F.array(cell(F.col("pivot"), ring(F.col("off"))), nowhere)).alias("cell"), *[F.col(c).alias(f"{c}1") for c in parts])
    two = placed.select("shingle", F.explode(F.concat(window, F.array(nowhere))).alias("cell"), *[F.col(c).alias(f"{c}2") for c in parts])
    sizes = F.col("size1") + F.col("size2")
    differ = sum((F.bit_count(F.col("odd1")[k].bitwiseXOR(F.col("odd2")[k])) for k in range(1, ODD_LONGS)), F.bit_count(F.col("odd1")[0].bitwiseXOR(F.col("odd2")[0])))
    may_link = (
        (F.col("component1") != F.col("component2"))
        & F.when(F.col("cell.pivot") == -1, F.col("pivot1") != F.col("pivot2")).otherwise(F.abs(F.col("off1") - F.col("off2")) <= slack)
        & ((100 + percent) * F.least("size1", "size2") >= percent * sizes)
        & ((100 + percent) * differ <= (100 - percent) * sizes)
    )
    return one.join(two, ["shingle", "cell"]).filter(may_link).select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def grouped(docs: DataFrame, size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, digest, size), and (digest, component_id) of those with a set; both fixed."""
    rows = checkpointed(signed(docs, size))
    nodes = rows.filter("size > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"), F.max("bands").alias("bands"))
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    groups = _places(nodes)
    met = groups.select("node").distinct()
    sets = _sets(docs, checkpointed(nodes.join(met, "node").select("node", "digest", "doc_id")), size)

    shared = groups.filter("node != first").groupBy(F.col("node").alias("b"), F.col("first").alias("a")).agg(F.count("*").alias("n"))
    regions = _tested(shared.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")), sets, percent)
    label = components(regions.filter("linked"))
    heads = label.select(F.col("node").alias("first"), F.col("component").alias("head"))
    other = _labelled(groups, label).join(heads, "first", "left").filter(F.coalesce("head", "first") != F.col("component"))
    again = _tested(other.groupBy(F.col("node").alias("b")).agg(F.max("first").alias("a")).join(regions, ["a", "b"], "left_anti"), sets, percent)
    tested = regions.unionAll(again)

    label = components(tested.filter("linked"))
    off = regions.select(F.col("b").alias("node"), F.col("a").alias("pivot"), F.col("apart").alias("off"))
    placed = _labelled(groups, label).join(off, "node", "left").join(sets.select("node", "odd"), "node")
    crossing = _tested(_apart(placed, percent).join(tested.select("a", "b"), ["a", "b"], "left_anti"), sets, percent)
    label = components(tested.unionAll(crossing).filter("linked").select("a", "b"))

    placed = checkpointed(nodes.select("node", "digest", "doc_id").join(label, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = checkpointed(placed.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return rows.select("doc_id", "digest", "size"), checkpointed(placed.join(least, "component").select("digest", "component_id"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept; two documents link if 100 * intersection >= percent * union."""
    rows, groups = grouped(docs, size, percent)
    alone = rows.filter("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    found = rows.filter("size > 0").join(groups, "digest").select("doc_id", "size", "component_id").unionAll(alone)
    return found.select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows whose ``doc_id`` is the least of their group; texts without words all stay, and so do rows that repeat one that stays."""
    rows, groups = grouped(docs, size, percent)
    gone = rows.join(groups, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("size") > 0)).select("doc_id", "digest").distinct()
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    own = boxed(docs).withColumns({"id": F.col("row.doc_id").cast("long"), "own": _digest(text)})
    return own.join(gone, own["id"].eqNullSafe(gone["doc_id"]) & (own["own"] == gone["digest"]), "left_anti").select("row.*")


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 5, 85)
