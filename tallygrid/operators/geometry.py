"""Geometry of sources: kernels, embeddings, alignment of families.

Matrices are sources x sources, read from (left, right, value) rows behind a
check of their number, and worked on with numpy on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_POINTS = 2000


class NotAMatrix(ValueError):
    """A matrix lacks what a metric needs."""


def matrix(rows: DataFrame, value: str = "value", diagonal: float | None = 0.0) -> tuple[list, np.ndarray]:
    """Labels in order and the symmetric matrix of rows (left, right, value), each pair once; without a ``diagonal`` it is among the rows."""
    found = rows.select("left", "right", value).limit(MOST_POINTS**2 + 1).collect()
    if len(found) > MOST_POINTS**2:
        raise NotAMatrix(f"more than {MOST_POINTS} points")
    labels = sorted({r[k] for r in found for k in (0, 1)})
    place = {x: k for k, x in enumerate(labels)}
    out = np.full((len(labels), len(labels)), np.nan)
    if diagonal is not None:
        np.fill_diagonal(out, diagonal)
    for a, b, v in found:
        if a != b or diagonal is None:
            out[place[a], place[b]] = out[place[b], place[a]] = v
    return labels, out


def checked(m: np.ndarray, kind: str) -> np.ndarray:
    """The matrix, if it is a matrix of distances (0 to 1) or similarities (-1 to 1)."""
    one, low = (0.0, 0.0) if kind == "distance" else (1.0, -1.0)
    problems = [
        (m.ndim != 2 or m.shape[0] != m.shape[1], "it isn't square"),
        (not np.isfinite(m).all(), "an entry is missing"),
        (m.ndim == 2 and m.shape[0] == m.shape[1] and not np.allclose(m, m.T, rtol=0, atol=1e-12), "it isn't symmetric"),
        (m.ndim == 2 and not np.allclose(np.diag(m), one, rtol=0, atol=1e-12), "its diagonal is wrong"),
        (m.size and (np.nanmin(m) < low - 1e-12 or np.nanmax(m) > 1 + 1e-12), "an entry is out of range"),
    ]
    for wrong, why in problems:
        if wrong:
            raise NotAMatrix(f"{kind}: {why}")
    return m


def kernel(m: np.ndarray, kind: str = "distance") -> np.ndarray:
    """Double-centred kernel of distances, or of similarities through 2(1-s)."""
    squared = checked(m, kind) ** 2 if kind == "distance" else 2 * (1 - checked(m, kind))
    rows = squared.mean(1, keepdims=True)
    centred = -0.5 * (squared - rows - rows.T + squared.mean())
    return (centred + centred.T) / 2


def embedding(k: np.ndarray, dimensions: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates, all eigenvalues (falling), and the shares of those used among the positive ones."""
    values, vectors = np.linalg.eigh(k)
    values, vectors = values[::-1], vectors[:, ::-1]
    positive = values > 1e-12 * max(1.0, np.abs(values).max(initial=0.0))
    if positive.sum() < dimensions:
        raise NotAMatrix(f"only {positive.sum()} positive eigenvalues")
    used = np.flatnonzero(positive)[:dimensions]
    return vectors[:, used] * np.sqrt(values[used]), values, values[used] / values[positive].sum()


def oriented(x: np.ndarray) -> np.ndarray:
    """Each axis turned so that its entry of largest size is positive."""
    at = np.abs(x).argmax(0)
    return x * np.where(x[at, np.arange(x.shape[1])] < 0, -1.0, 1.0)


def anchored(coordinates: DataFrame, anchors: DataFrame) -> DataFrame:
    """Coordinates (source, axis, value) with each axis turned so that its high anchors don't lie below its low ones on average.

    ``anchors`` has axis, source and side ("high" or "low").  An axis one of whose sides has no source here is turned
    so that its entry of largest size, the first source's among equals, is positive.
    """
    side = lambda s: F.avg(F.when(F.col("side") == s, F.col("value")))
    axes = coordinates.join(anchors, ["axis", "source"], "left").groupBy("axis").agg(side("high").alias("high"), side("low").alias("low"), F.min_by("value", F.struct(-F.abs("value"), "source")).alias("largest"))
    down = F.coalesce(F.col("high") < F.col("low"), F.col("largest") < 0)
    return coordinates.join(axes.select("axis", F.when(down, -1.0).otherwise(1.0).alias("sign")), "axis").select("source", "axis", (F.col("value") * F.col("sign")).alias("value"))


def stress(m: np.ndarray, x: np.ndarray) -> float:
    """Root of the squared misfit over the squared targets."""
    upper = np.triu_indices(len(m), 1)
    shown = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))[upper]
    return float(np.sqrt(((m[upper] - shown) ** 2).sum() / (m[upper] ** 2).sum()))


def positive_part(k: np.ndarray) -> tuple[np.ndarray, float]:
    """The nearest positive semidefinite matrix, and the negative mass cut off."""
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    cut = values[values < -1e-10 * max(1.0, np.abs(values).max(initial=0.0))]
    out = (vectors * np.maximum(values, 0)) @ vectors.T
    return (out + out.T) / 2, float(-cut.sum())


def alignment(kernels: list[np.ndarray]) -> np.ndarray:
    """Centred kernel alignment of families: inner products of their kernels at unit norm."""
    flat = []
    for k in kernels:
        p = positive_part(k)[0]
        norm = np.linalg.norm(p)
        if norm <= 1e-15:
            raise NotAMatrix("a family's geometry is constant")
        flat.append(p.ravel() / norm)
    return np.array(flat) @ np.array(flat).T


def projected(m: np.ndarray, x: np.ndarray, values: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Coordinates of new points in an embedding, from their distances to its points."""
    squared = m**2
    centred = -0.5 * (new**2 - (new**2).mean(1, keepdims=True) - squared.mean(0) + squared.mean())
    used = values[values > 1e-12 * max(1.0, np.abs(values).max())][: x.shape[1]]
    return centred @ x / used


def gram_rows(values: DataFrame) -> DataFrame:
    """(left, right, value): inner products of sources over items, each item centred over the sources; ``values`` has source, item, value."""
    centred = values.withColumn("x", F.col("value") - F.avg("value").over(Window.partitionBy("item")))
    a, b = (centred.select("item", F.col("source").alias(s), F.col("x").alias(v)) for s, v in (("left", "p"), ("right", "q")))
    return a.join(b, "item").groupBy("left", "right").agg(F.sum(F.col("p") * F.col("q")).alias("value"))


def svd_projection(gram: np.ndarray, dimensions: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Sources on the first right singular vectors of the item table whose inner products are given, and the shares of variance."""
    values, vectors = np.linalg.eigh(gram)
    values, vectors = np.maximum(0, values[::-1]), vectors[:, ::-1]
    return oriented(vectors[:, :dimensions] * np.sqrt(values[:dimensions])), values[:dimensions] / max(values.sum(), 1e-300)


def mds(spark: SparkSession, rows: DataFrame, value: str) -> DataFrame:
    """(label, x, y, stress) of distances (left, right, value)."""
    labels, m = matrix(rows, value)
    x, _, _ = embedding(kernel(m))
    x = oriented(x)
    return spark.createDataFrame([(str(a), *map(float, p), stress(m, x)) for a, p in zip(labels, x, strict=True)], "label string, x double, y double, stress double")


def stress_rows(distances: DataFrame, points: DataFrame) -> DataFrame:
    """One row: how far distances (left, right, value) are from those between points (label, x, y), as a share of the former; and the number of pairs."""
    one = points.select(F.col("label").alias("left"), F.col("x").alias("_x1"), F.col("y").alias("_y1"))
    two = points.select(F.col("label").alias("right"), F.col("x").alias("_x2"), F.col("y").alias("_y2"))
    shown = F.sqrt((F.col("_x1") - F.col("_x2")) ** 2 + (F.col("_y1") - F.col("_y2")) ** 2)
    rows = distances.join(one, "left").join(two, "right").select("value", shown.alias("shown"))
    return rows.agg(F.sqrt(F.sum((F.col("value") - F.col("shown")) ** 2) / F.sum(F.col("value") ** 2)).alias("stress"), F.count("*").alias("pairs"))


def matrix_problems(rows: DataFrame, least: float = 0.0, most: float = 1.0, diagonal: float = 0.0) -> DataFrame:
    """(left, right, problem): cells that are repeated, out of range, off the diagonal's value, or without an equal one across the diagonal."""
    cells = rows.groupBy("left", "right").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    other = cells.select(F.col("right").alias("left"), F.col("left").alias("right"), "low", "high", F.lit(True).alias("there"))
    found = cells.join(other, ["left", "right", "low", "high"], "left")
    outside = (F.col("low") < least) | (F.col("high") > most)
    rules = [
        (F.col("n") > 1, "repeated"),
        (outside, "out_of_range"),
        ((F.col("left") == F.col("right")) & ((F.col("low") != diagonal) | (F.col("high") != diagonal)), "diagonal"),
        ((F.col("left") != F.col("right")) & F.col("there").isNull(), "asymmetric"),
    ]
    return found.select("left", "right", F.explode(F.array_compact(F.array(*[F.when(rule, text) for rule, text in rules]))).alias("problem"))
