"""Product codes of vectors by Lloyd rounds with the filtering algorithm.

Vectors become integers and are cut into equal parts, each with a codebook of
its own.  Every partition deals its vectors into blocks and builds, for each
part of a block, a kd-tree whose nodes hold the box, the sum and the count of
their points.  The trees are written once, as rows, and each round walks them:
of a node's candidates the one nearest the middle of the box stays, and another
goes if no corner of the box is nearer to it, so that it can be no point's
nearest.  A node with one candidate left is assigned as a whole, by its cached
sum and count; points are looked at only in leaves.  Corners that are as near
to both count for the lower index, so the walk gives exactly what comparing all
points with all entries does.

Only sums and counts for each part and entry are shuffled, a row for each task;
the driver holds the codebooks alone (entries x components).

Defined results: a vector that is null, or holds a null or a component that
isn't finite, is dropped, as is one whose length isn't that of the least kept
``vec_id`` (of those whose length the parts divide) and one with a component so
large that a squared distance may not fit in 64 bits (2^19 at 64 components);
fewer vectors than entries make a smaller codebook; an entry that nothing is
nearest to stays; ties of distance go to the lower index; rows with one
``vec_id`` are separate vectors and start the codebook in the order of their
components; a null ``vec_id`` comes last; null labels count as one label; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, checkpointed, table

SCALE = 256
N_PARTS = 16
N_ENTRIES = 64
ROUNDS = 2
#: Vectors of a block, points of a leaf, and blocks that a worker gets at once.
BLOCK, LEAF, BLOCKS_A_BATCH = 4096, 8, 4
#: Numbers in a temporary array.
_ROOM = 1 << 20
_FAR = np.iinfo(np.int64).max


class Forest:
    """A kd-tree for each part of a block of vectors, all of one shape.

    A level's nodes are runs of positions, the same for each part; ``order``
    says which vector stands at a part's position.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, low: list[np.ndarray], high: list[np.ndarray], total: list[np.ndarray]):
        self.points, self.order, self.low, self.high, self.total = points, order, low, high, total
        self.cuts = [_cuts(points.shape[1], 1 << k) for k in range(len(low))]

    @classmethod
    def grown(cls, vectors: np.ndarray, n_parts: int) -> Forest:
        n = len(vectors)
        points = np.ascontiguousarray(vectors.reshape(n, n_parts, -1).transpose(1, 0, 2))
        order = np.tile(np.arange(n), (n_parts, 1))
        depth = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
        for level in range(depth):
            cuts = _cuts(n, 1 << level)
            widest = (np.maximum.reduceat(points, cuts[:-1], 1) - np.minimum.reduceat(points, cuts[:-1], 1)).argmax(2)
            node = np.repeat(np.arange(1 << level), np.diff(cuts))
            along = np.take_along_axis(points, widest[:, node][:, :, None], 2)[:, :, 0]
            for p in range(n_parts):
                sort = np.lexsort((along[p], node))
                points[p], order[p] = points[p][sort], order[p][sort]
        leaves = _cuts(n, 1 << depth)[:-1]
        low, high, total = ([f.reduceat(points, leaves, 1)] for f in (np.minimum, np.maximum, np.add))
        for _ in range(depth):
            for levels, f in ((low, np.minimum), (high, np.maximum), (total, np.add)):
                levels.insert(0, f(levels[0][:, ::2], levels[0][:, 1::2]))
        return cls(points, order, low, high, total)

    def stored(self) -> bytes:
        kind = np.int16 if np.abs(self.points).max(initial=0) < 1 << 15 else np.int64
        out = io.BytesIO()
        boxes = {f"{name}{k}": x.astype(kind) for name, levels in (("low", self.low), ("high", self.high)) for k, x in enumerate(levels)}
        np.savez(out, points=self.points.astype(kind), order=self.order.astype(np.uint16), depth=len(self.low), **boxes, **{f"total{k}": x.astype(np.int32 if kind == np.int16 else np.int64) for k, x in enumerate(self.total)})
        return out.getvalue()

    @classmethod
    def read(cls, data: bytes) -> Forest:
        with np.load(io.BytesIO(data)) as found:
            levels = range(int(found["depth"]))
            low, high, total = ([found[f"{name}{k}"].astype(np.int64) for k in levels] for name in ("low", "high", "total"))
            return cls(found["points"].astype(np.int64), found["order"].astype(np.int64), low, high, total)

    def walked(self, entries: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(level, part, node, entry) of subtrees that are nearest to one entry as a whole, then (-1, part, position, entry) of single points.

        ``entries`` are (parts, entries, components).
        """
        n_parts, n_entries, width = entries.shape
        part, node = np.arange(n_parts), np.zeros(n_parts, np.int64)
        alive = np.ones((n_parts, n_entries), bool)
        step = max(1, _ROOM // (n_entries * width))
        for level in range(len(self.low)):
            best = np.empty(len(part), np.int64)
            for at in range(0, len(part), step):
                s = slice(at, at + step)
                best[s] = _filtered(entries[part[s]], self.low[level][part[s], node[s]], self.high[level][part[s], node[s]], alive[s])
            whole = alive.sum(1) == 1
            yield level, part[whole], node[whole], best[whole]
            part, node, alive = part[~whole], node[~whole], alive[~whole]
            if level < len(self.low) - 1:
                part, alive = np.repeat(part, 2), np.repeat(alive, 2, 0)
                node = np.repeat(2 * node, 2) + np.tile([0, 1], len(node))
        cuts = self.cuts[-1]
        by_count = np.argsort(alive.sum(1), kind="stable")
        for at in range(0, len(part), max(1, step // LEAF)):
            own = by_count[at : at + max(1, step // LEAF)]
            yield -1, *_leaf_points(self.points, entries, part[own], cuts[node[own]], cuts[node[own] + 1], alive[own])

    def summed(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (parts, entries) and sums (parts, entries, components) of what is nearest to each entry."""
        counts, sums = np.zeros(entries.shape[:2], np.int64), np.zeros(entries.shape, np.int64)
        for level, part, at, entry in self.walked(entries):
            np.add.at(counts, (part, entry), 1 if level < 0 else np.diff(self.cuts[level])[at])
            np.add.at(sums, (part, entry), self.points[part, at] if level < 0 else self.total[level][part, at])
        return counts, sums

    def coded(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (vectors, parts) and each vector's squared distances, summed over the parts."""
        n_parts, n, _ = self.points.shape
        code = np.zeros((n_parts, n), np.int64)  # by position
        for level, part, at, entry in self.walked(entries):
            if level < 0:
                code[part, at] = entry
            else:
                start, size = self.cuts[level][at], np.diff(self.cuts[level])[at]
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                code[np.repeat(part, size), np.repeat(start, size) + inside] = np.repeat(entry, size)
        off = ((self.points - entries[np.arange(n_parts)[:, None], code]) ** 2).sum(2)
        codes, error = np.empty((n, n_parts), np.uint8), np.zeros(n, np.int64)
        for p in range(n_parts):
            codes[self.order[p], p] = code[p]
            error[self.order[p]] += off[p]
        return codes, error


def _cuts(n: int, nodes: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end."""
    return n * np.arange(nodes + 1) // nodes


def _filtered(z: np.ndarray, low: np.ndarray, high: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """The candidate nearest each box's middle; candidates that can't be nearest in the box are struck from ``alive``."""
    off = ((2 * z - (low + high)[:, None]) ** 2).sum(2)
    off[~alive] = _FAR
    best = off.argmin(1)
    own = z[np.arange(len(z)), best][:, None]
    corner = np.where(z > own, high[:, None], low[:, None])  # of the box, the one most in z's favour
    gap = ((z - corner) ** 2).sum(2) - ((own - corner) ** 2).sum(2)
    alive &= (gap < 0) | ((gap == 0) & (np.arange(z.shape[1]) <= best[:, None]))
    return best


def _leaf_points(points: np.ndarray, entries: np.ndarray, part: np.ndarray, start: np.ndarray, end: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, position, nearest candidate) of the points of leaves."""
    size = int((end - start).max(initial=0))
    at = start[:, None] + np.arange(size)
    there = at < end[:, None]
    at = np.minimum(at, end[:, None] - 1)
    most = int(alive.sum(1).max(initial=0))
    candidate = np.argsort(~alive, 1, kind="stable")[:, :most]  # ascending
    z = entries[part[:, None], candidate]
    off = ((points[part[:, None], at][:, :, None] - z[:, None]) ** 2).sum(3)
    off[np.broadcast_to(~np.take_along_axis(alive, candidate, 1)[:, None], off.shape)] = _FAR
    nearest = np.take_along_axis(candidate, off.argmin(2), 1)
    return np.repeat(part, size).reshape(-1, size)[there], at[there], nearest[there]


def _integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def kept_vectors(df: DataFrame, n_parts: int = N_PARTS, n_entries: int = N_ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, v) with integer vectors, and the first ``n_entries`` of them in order of their ids."""
    plain = df.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("v"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    size = F.size("v")
    plain = plain.filter(F.col("v").isNotNull() & (size > 0) & (size % n_parts == 0) & ~F.exists("v", odd))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    least = plain.select(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", "v"))["v"].alias("v")).first()
    if least is None or least.v is None:
        return plain.limit(0).withColumn("v", _integers(F.col("v"))), np.zeros((0, 0), np.int64)
    width = len(least.v)
    limit = float(1 << ((62 - int(np.ceil(np.log2(width)))) // 2 - 1)) / SCALE
    plain = plain.filter((size == width) & F.forall("v", lambda x: F.abs(x) < limit))
    first = plain.orderBy(*order).limit(n_entries).select(_integers(F.col("v")).alias("v")).collect()
    return plain.withColumn("v", _integers(F.col("v"))), np.array([r.v for r in first], np.int64).reshape(len(first), width)


def grown_forests(kept: DataFrame, n_parts: int) -> DataFrame:
    """(ids, labels, forest): a row for each block of a partition's vectors, written once."""
    label = kept.schema["label"].dataType.simpleString()

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                vectors = own.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(own.num_rows, -1)
                lists = [pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), pa.concat_arrays([own.column(c)])) for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([Forest.grown(vectors, n_parts).stored()], pa.binary())], ["ids", "labels", "forest"])

    with arrow_rows(kept.sparkSession, BLOCK):
        return checkpointed(kept.select("vec_id", "label", "v").mapInArrow(grow, f"ids array<long>, labels array<{label}>, forest binary"))


def trained(forests: DataFrame, entries: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks (parts, entries, components) after so many Lloyd rounds."""
    width = entries.shape[2]
    schema = "part int, entry int, n long, " + ", ".join(f"s{k} long" for k in range(width))
    for _ in range(rounds):
        books = entries

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            counts, totals = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for batch in batches:
                for data in batch.column("forest").to_pylist():
                    n, s = Forest.read(data).summed(books)
                    counts, totals = counts + n, totals + s
            part, entry = np.nonzero(counts)
            columns = [part.astype(np.int32), entry.astype(np.int32), counts[part, entry], *totals[part, entry].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], [c.split()[0] for c in schema.split(", ")])

        with arrow_rows(forests.sparkSession, BLOCKS_A_BATCH):
            added = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", *(f"s{k}" for k in range(width)))]
            found = forests.select("forest").mapInArrow(sums, schema).groupBy("part", "entry").agg(*added).collect()
        entries = entries.copy()
        for r in found:
            entries[r.part, r.entry] = [int(r[f"s{k}"]) // int(r.n) for k in range(width)]
    return entries


def vector_codes(df: DataFrame, n_parts: int = N_PARTS, n_entries: int = N_ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every kept vector, fixed by a checkpoint, and the codebooks (parts, entries, components).

    ``code`` has two hex digits a part, so there may be 256 entries at most.
    """
    kept, first = kept_vectors(df, n_parts, n_entries)
    label = kept.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, code string, error long"
    if not len(first):
        return kept.sparkSession.createDataFrame([], schema), np.zeros((n_parts, 0, 0), np.int64)
    forests = grown_forests(kept, n_parts)
    entries = trained(forests, np.ascontiguousarray(first.reshape(len(first), n_parts, -1).transpose(1, 0, 2)), rounds)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in enumerate(batch.column("forest").to_pylist()):
                codes, error = Forest.read(data).coded(entries)
                own = [pa.concat_arrays([batch.column(c).slice(k, 1).flatten()]) for c in ("ids", "labels")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([row.tobytes().hex() for row in codes], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    with arrow_rows(df.sparkSession, BLOCKS_A_BATCH):
        return checkpointed(forests.mapInArrow(coded, schema)), entries


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, entries = vector_codes(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()
    # Fixed on its own, so that both sides of the join are dealt out plainly and a frequent label can be split.
    by_label = checkpointed(codes.groupBy("label").agg(F.sum("error").alias("label_error"))).withColumnRenamed("label", "own")
    return codes.join(by_label, codes["label"].eqNullSafe(by_label["own"])).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
