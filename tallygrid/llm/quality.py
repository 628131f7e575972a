"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

1. Statistics of each text (shares of letters, capitals, digits and symbols,
   word and line lengths, repetition) are computed once from its bytes and
   fixed by a checkpoint: some twenty numbers a document.
2. Labelled rows of the fit fold give means and deviations, then the normal
   equations of ``N_FEATURES`` cosines, which approximate a Gaussian kernel.
   Each task sums its rows' outer products; those sums are added by matrix row
   in a shuffle, so the driver gets one matrix of fixed size whatever the
   number of rows or tasks.
3. Labelled rows of the calibration fold are counted in ``N_BINS`` bins of the
   raw score; pool-adjacent-violators on the bins gives the probability.

Every labelled row outside the held-out fold is used; nothing is sampled.
Labels enter only as targets, and no other column than the text is an input.

Defined results: null and empty texts have all statistics 0 and are scored like
any other; rows without a label or with a null one are not trained on; several labels
of a document each count; with no labelled rows all scores are 0.5, with labels
of one kind all are near that kind; repeated rows and a null ``doc_id`` (never
held out) give a row each; equal statistics have equal scores; very long texts are
read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, flat, keyed, slices, table, word_hashes, words

N_FEATURES = 256
N_BINS = 400
SEED = 20
RIDGE = 1e-3

_CLASSES = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "stop": [*b".,;:"],
    "loud": [*b"!?"],
    "symbol": [*b"#*$%&|<>@^~_=+/\\{}[]()"],
    "wide": [*range(128, 256)],
    "line": [10],
}
STATISTICS = (
    "log_words", "log_bytes", "word_length", "word_length_spread", *_CLASSES, "distinct_words", "adjacent_equal",
    "commonest_word", "line_words", "capital_words", "short_words", "long_words", "equal_lines",
)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    starts, lengths, first = words(data, offsets)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(n), n_words)
    share = lambda x, of: np.divide(x, of, out=np.zeros(n), where=of > 0)
    per_doc = lambda mask, at: np.diff(np.concatenate(([0], np.cumsum(mask)))[at])
    mean = share(np.bincount(owner, lengths, n), n_words)
    spread = np.sqrt(np.maximum(0, share(np.bincount(owner, lengths.astype(float) ** 2, n), n_words) - mean**2))
    out = [np.log1p(n_words), np.log1p(size), mean, spread]
    for codes in _CLASSES.values():
        among = np.zeros(256, bool)
        among[codes] = True
        out.append(share(per_doc(among[data], offsets), size))
    h = word_hashes(data, starts, lengths)
    order = np.lexsort((h, owner))
    sorted_h, sorted_owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (sorted_h[1:] != sorted_h[:-1]) | (sorted_owner[1:] != sorted_owner[:-1])
    out.append(share(np.bincount(sorted_owner[new], minlength=n), n_words))
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    out.append(share(np.bincount(owner[same], minlength=n), n_words))
    at = np.flatnonzero(new)
    commonest = np.zeros(n)
    np.maximum.at(commonest, sorted_owner[at], np.diff(np.concatenate((at, [len(h)]))))
    out.append(share(commonest, n_words))
    lines = per_doc(data == 10, offsets) + 1
    out.append(np.log1p(share(n_words, lines)))
    capital = _capital(data, starts, lengths)
    for mask in (capital, lengths <= 2, lengths >= 14):
        out.append(share(np.bincount(owner[mask], minlength=n), n_words))
    out.append(_equal_lines(data, offsets, n))
    return np.column_stack(out).astype(float) if n else np.zeros((0, len(STATISTICS)))


def _capital(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Words of two or more letters without a lower-case ASCII letter and with an upper-case one."""
    upper = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    lower = np.concatenate(([0], np.cumsum((data >= 97) & (data <= 122))))
    return (upper[starts + lengths] - upper[starts] >= 2) & (lower[starts + lengths] == lower[starts])


def _equal_lines(data: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """Share of a text's lines that are equal to another of its lines."""
    cuts = np.union1d(np.flatnonzero(data == 10) + 1, offsets[:-1][np.diff(offsets) > 0])
    cuts = cuts[cuts < len(data)]
    if not len(cuts):
        return np.zeros(n)
    starts, ends = cuts, np.append(cuts[1:], len(data))
    h = word_hashes(data, starts, ends - starts - (data[ends - 1] == 10))
    owner = np.searchsorted(offsets, starts, "right") - 1
    order = np.lexsort((h, owner))
    a, b = h[order], owner[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    total = np.bincount(owner, minlength=n)
    return np.divide(total - np.bincount(b[new], minlength=n), total, out=np.zeros(n), where=total > 0)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x (STATISTICS)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = statistics(*flat(part.column("text")))
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(STATISTICS), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "x"])

    return keyed(docs).mapInArrow(run, "doc_id long, x array<double>")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(-1)).cast("int")


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


def summed(rows: DataFrame, columns: str, outer: Callable[[pa.RecordBatch], np.ndarray], height: int, width: int) -> np.ndarray:
    """The sum over all rows of a height x width matrix: each task sums its own, then the tasks' rows are added by index."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((height, width))
        some = False
        for batch in batches:
            if batch.num_rows:
                total, some = total + outer(batch), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(height)), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "v"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for v in batch.column("v").to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tobytes()], pa.binary())], ["i", "v"])

    out = np.zeros((height, width))
    parts = rows.select(*columns.split()).mapInArrow(partial, "i long, v binary")
    for r in parts.groupBy("i").applyInArrow(add, "i long, v binary").collect():  # height rows
        out[r["i"]] = np.frombuffer(r["v"])
    return out


class Model:
    """Raw scores of statistics, then probabilities."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray):
        rng = np.random.default_rng(SEED)
        d = len(mean)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.normal(size=(d, N_FEATURES)) / np.sqrt(d)
        self.b = rng.uniform(0, 2 * np.pi, N_FEATURES)
        self.beta = np.zeros(N_FEATURES + 1)
        self.knots = np.array([[0.0, 1.0], [0.5, 0.5]])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.column_stack((np.sqrt(2 / N_FEATURES) * np.cos(z @ self.w + self.b), np.ones(len(x))))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.beta, -0.5, 1.5)

    def probability(self, raw: np.ndarray) -> np.ndarray:
        """The calibrated value, with a thousandth of the raw score so that its order survives flat steps."""
        return np.clip(0.999 * np.interp(raw, *self.knots) + 0.001 * (raw + 0.5) / 2, 0.0, 1.0)


def isotonic(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: knots (2 x k) of a non-decreasing curve through the pooled blocks' centres."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, n, positive, strict=True):
        blocks.append([a * b, b, c])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    done = np.array(blocks)
    return np.array([done[:, 0] / done[:, 1], done[:, 2] / done[:, 1]])


def fit(labelled: DataFrame) -> Model:
    """``labelled`` has x, y (0 or 1) and fold (0: fit, otherwise calibration)."""
    d = len(STATISTICS)
    fitting, calibrating = labelled.filter("fold = 0"), labelled.filter("fold != 0")

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch)
        return np.vstack((x.sum(0), (x**2).sum(0), np.full(d, len(x))))

    total = summed(fitting, "x", moments, 3, d)
    count = max(1.0, total[2, 0])
    mean = total[0] / count
    model = Model(mean, np.sqrt(np.maximum(0, total[1] / count - mean**2)))
    if not total[2, 0]:
        return model

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z = model.features(_matrix(batch))
        return z.T @ np.column_stack((z, batch.column("y").to_numpy()))

    equations = summed(fitting, "x y", normal, N_FEATURES + 1, N_FEATURES + 2)
    penalty = np.full(N_FEATURES + 1, RIDGE * count)
    penalty[-1] = 1e-9 * count
    model.beta = np.linalg.solve(equations[:, :-1] + np.diag(penalty), equations[:, -1])

    def counts(batch: pa.RecordBatch) -> np.ndarray:
        raw = model.raw(_matrix(batch))
        k = np.minimum((raw + 0.5) * N_BINS / 2, N_BINS - 1).astype(int)
        return np.vstack([np.bincount(k, v, N_BINS) for v in (None, raw, batch.column("y").to_numpy().astype(float))])

    n, at, positive = summed(calibrating, "x y", counts, 3, N_BINS)
    if n.any():
        some = n > 0
        model.knots = isotonic(at[some] / n[some], n[some], positive[some])
    else:
        model.knots = np.array([[0.0, 1.0], [0.0, 1.0]])
    return model


def score(docs: DataFrame, labels: DataFrame, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted.  Labels of rows in the held-out fold are not read."""
    rows = checkpointed(document_statistics(docs).withColumn("fold", fold(F.col("doc_id"))))
    known = labels.filter("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    labelled = rows.filter(F.col("fold") != held_out).join(known, "doc_id").select("x", "y", F.when(F.col("fold") > 0, 1).otherwise(0).alias("fold"))
    model = fit(checkpointed(labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.probability(model.raw(_matrix(batch)))
            held = pa.array(batch.column("fold").to_numpy() == held_out)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), held, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
