"""Penalised choice and source regressions with leave-one-item-out validation.

The fits of tables are made by :mod:`newton`, on sums over blocks of items; :class:`Choice` and :class:`Source` are
the same models of one small matrix.  Newton steps are damped by backtracking; an intercept, if any, isn't penalised.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.functions import metrics as m

from . import newton
from .newton import MOST_STEPS, TOLERANCE

PENALTY = 1e-4


def minimise(value, derivatives, start: np.ndarray) -> tuple[np.ndarray, float, int]:
    """(argument, infinity norm of the gradient, steps) of a smooth convex function by damped Newton."""
    x, now = start.copy(), value(start)
    for step in range(MOST_STEPS):
        gradient, curvature = derivatives(x)
        size = np.abs(gradient).max(initial=0.0)
        if size <= TOLERANCE:
            return x, float(size), step
        try:
            move = -np.linalg.solve(curvature, gradient)
        except np.linalg.LinAlgError:
            move = -np.linalg.pinv(curvature) @ gradient
        slope, scale = gradient @ move, 1.0
        if slope >= 0:
            move, slope = -gradient, -(gradient @ gradient)
        if -slope <= 1e-12 * max(1.0, abs(now)):
            # What a step gains is below the value's own rounding, so halving would go on for nothing; this near, whole steps converge.
            x = x + move
            now = value(x)
            continue
        for _ in range(60):
            trial = value(x + scale * move)
            if trial <= now + 1e-4 * scale * slope:
                break
            scale /= 2
        else:
            return x, float(size), step
        x, now = x + scale * move, trial
    return x, float(np.abs(derivatives(x)[0]).max(initial=0.0)), MOST_STEPS


class Choice:
    """Conditional logit: shares of the candidates of each item, explained by their features."""

    def __init__(self, x: list[np.ndarray], q: list[np.ndarray], penalty: float = PENALTY):
        size = np.array([len(m) for m in x], np.int64)
        self._set(np.concatenate(x) if x else np.zeros((0, 0)), np.concatenate(q) if q else np.zeros(0), size, penalty)

    def _set(self, rows: np.ndarray, target: np.ndarray, size: np.ndarray, penalty: float) -> None:
        self.rows, self.target, self.size, self.penalty = rows, target, size, penalty
        self.width, self.head = rows.shape[1], np.cumsum(size) - size

    @property
    def x(self) -> list[np.ndarray]:
        return np.split(self.rows, self.head[1:]) if len(self.size) else []

    @property
    def q(self) -> list[np.ndarray]:
        return np.split(self.target, self.head[1:]) if len(self.size) else []

    def _shares(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shares and linear terms of all rows, and each item's log of the summed exponentials."""
        e = self.rows @ beta
        top = np.maximum.reduceat(e, self.head)
        p = np.exp(e - np.repeat(top, self.size))
        total = np.add.reduceat(p, self.head)
        return p / np.repeat(total, self.size), e, top + np.log(total)

    def shares(self, beta: np.ndarray) -> list[np.ndarray]:
        return np.split(self._shares(beta)[0], self.head[1:]) if len(self.size) else []

    def losses(self, beta: np.ndarray) -> np.ndarray:
        """Cross-entropy of each item, in nats."""
        if not len(self.size):
            return np.zeros(0)
        _, e, log_total = self._shares(beta)
        return log_total - np.add.reduceat(self.target * e, self.head)

    def fit(self, weights: np.ndarray | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, float, int]:
        w = np.ones(len(self.size)) if weights is None else weights
        w = w / w.sum()
        each = np.repeat(w, self.size)

        def value(beta: np.ndarray) -> float:
            return float(w @ self.losses(beta) + self.penalty / 2 * beta @ beta)

        def derivatives(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p = self._shares(beta)[0]
            mean = np.add.reduceat(self.rows * p[:, None], self.head)
            gradient = self.penalty * beta + self.rows.T @ (each * (p - self.target))
            curvature = self.penalty * np.eye(self.width) + (self.rows.T * (each * p)) @ self.rows - (mean.T * w) @ mean
            return gradient, curvature

        return minimise(value, derivatives, np.zeros(self.width) if start is None else start)

    def robust_errors(self, beta: np.ndarray) -> np.ndarray:
        """Standard errors from the items' own scores (each item a cluster); for fits without a penalty."""
        scores = np.array([x.T @ (p - q) for x, q, p in zip(self.x, self.q, self.shares(beta), strict=True)])
        curvature = sum((x.T * p) @ x - np.outer(x.T @ p, x.T @ p) for x, p in zip(self.x, self.shares(beta), strict=True))
        bread = np.linalg.pinv(curvature)
        return np.sqrt(np.maximum(0, np.diag(bread @ (scores.T @ scores) @ bread)))


def normal_p(z: float) -> float:
    """Two-sided p of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def unfinished(rows: DataFrame, done: DataFrame, task: str, fingerprint: str) -> DataFrame:
    """Rows of the tasks that have no finished fit of this fingerprint: what a resumed run has left to do."""
    return rows.join(done.filter(F.col("fingerprint") == fingerprint).select(task).distinct(), task, "left_anti")


class Source:
    """Weighted logistic regression of which source an answer came from, with an intercept."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float = PENALTY):
        self.x, self.y, self.w = np.column_stack((np.ones(len(x)), x)), y, w
        self.shrink = penalty * np.r_[0.0, np.ones(x.shape[1])]

    def probability(self, beta: np.ndarray) -> np.ndarray:
        return 0.5 * (1 + np.tanh(self.x @ beta / 2))

    def fit(self, times: np.ndarray | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, float, int]:
        w = self.w if times is None else self.w * times
        w = w / w.sum()

        def value(beta: np.ndarray) -> float:
            e = self.x @ beta
            return float(w @ (np.logaddexp(0, e) - self.y * e) + self.shrink @ beta**2 / 2)

        def derivatives(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p = self.probability(beta)
            return self.x.T @ (w * (p - self.y)) + self.shrink * beta, (self.x.T * (w * p * (1 - p))) @ self.x + np.diag(self.shrink)

        return minimise(value, derivatives, np.zeros(self.x.shape[1]) if start is None else start)


def _tasks(rows: DataFrame, task: str) -> DataFrame:
    """The names by which fits know the tasks."""
    return rows.select(task, F.to_json(F.struct(F.col(task).alias("task"))).alias("_t")).distinct()


def _points(spark: SparkSession, found: dict[str, newton.Steps], names: list[str]) -> DataFrame:
    point = [(t, place, name, float(s.x[0, place]), float(s.size[0]), int(s.steps[0])) for t, s in found.items() for place, name in enumerate(names)]
    return spark.createDataFrame(point, "_t string, place int, feature string, coefficient double, gradient double, steps long")


def _fits(kind: type, rows: DataFrame, task: str, item: str, order: str, target: str, features: list[str], repeats: int, seed: int, penalty: float, validate: bool) -> DataFrame:
    """Fits of all items of a task and of its draws by :mod:`newton`, how they do in sample, and their validation by items left out."""
    spark, names = rows.sparkSession, kind.names(features)
    blocks = newton.packed(rows, task, item, order, target, features, repeats, seed, ranked=kind is newton.ChoiceItems)
    found = newton.fits(blocks, kind, features, repeats, seed, penalty)
    points = _points(spark, found, names)
    # Tasks x draws x features, which a study fixes.
    drawn = [pd.DataFrame({"_t": t, "place": np.tile(np.arange(len(names), dtype=np.int32), repeats), "c": s.x[1:].ravel()}) for t, s in found.items()]
    kinds = "_t string, place int, c double"
    drawn = spark.createDataFrame(pd.concat(drawn), kinds) if drawn and repeats else spark.createDataFrame([], kinds)
    limits = drawn.groupBy("_t", "place").agg(F.percentile("c", [0.025, 0.975]).alias("c"))
    apart = newton.held_out(blocks, kind, features, repeats if validate else 0, seed, penalty, found).groupBy("_t")
    apart = apart.agg(F.max(F.when(F.col("rep") < 0, F.col("held_out"))).alias("held"), F.percentile(F.when(F.col("rep") >= 0, F.col("held_out")), [0.025, 0.975]).alias("h"))
    out = points.join(newton.measured(blocks, kind, features, seed, found), "_t").join(limits, ["_t", "place"], "left").join(apart, "_t", "left").join(_tasks(rows, task), "_t")
    name = f"held_out_{kind.metric}"
    return out.select(
        task, "feature", "coefficient", F.col("c")[0].alias("low"), F.col("c")[1].alias("high"), "items", *kind.measures,
        F.col("held").alias(name), F.col("h")[0].alias("held_out_low"), F.col("h")[1].alias("held_out_high"), "gradient", "steps",
    )


def choice_fits(rows: DataFrame, task: str, item: str, candidate: str, share: str, features: list[str], repeats: int = 2000, seed: int = 0, penalty: float = PENALTY, validate: bool = False) -> DataFrame:
    """Per task and feature: coefficient and interval (items drawn whole); per task: loss in and out of sample, of chance, and validation by items left out, in each draw too if ``validate``."""
    return _fits(newton.ChoiceItems, rows, task, item, candidate, share, features, repeats, seed, penalty, validate)


def stepped(rows: DataFrame, task: str, item: str, candidate: str, share: str, features: list[str], steps: int, penalty: float = PENALTY) -> DataFrame:
    """(task, feature, coefficient, gradient, steps) of the choice regression after so many Newton steps from 0 on, or fewer where the gradient vanishes before."""
    blocks = newton.packed(rows, task, item, candidate, share, features, 0, 0, ranked=True)
    found = newton.fits(blocks, newton.ChoiceItems, features, 0, 0, penalty, most=steps)
    return _points(rows.sparkSession, found, features).join(_tasks(rows, task), "_t").select(task, "feature", "coefficient", "gradient", "steps")


def source_fits(rows: DataFrame, task: str, item: str, is_first: str, weight: str, features: list[str], repeats: int = 0, seed: int = 0, penalty: float = PENALTY, validate: bool = False) -> DataFrame:
    """Per task and feature: coefficient of answering like the first source and its interval; accuracy in sample and with each item left out, in each draw too if ``validate``.

    ``rows`` has one row for each item, source and candidate, ``weight`` its share of the source's answers on the item, so each source has weight 1 an item.
    """
    ready = rows.withColumn(is_first, F.col(is_first).cast("double"))
    return _fits(newton.SourceItems, ready, task, item, is_first, weight, features, repeats, seed, penalty, validate)


def fingerprints(rows: DataFrame, task: str, parameters: str) -> DataFrame:
    """(task, fingerprint): what a task's rows and the parameters are, whatever the rows' order."""
    h = F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")
    return rows.groupBy(task).agg(F.sha2(F.concat_ws("|", F.lit(parameters), F.count("*").cast("string"), F.sum(h).cast("string"), F.bit_xor(F.xxhash64(*sorted(rows.columns))).cast("string")), 256).alias("fingerprint"))


def resumed_fits(rows: DataFrame, task: str, parameters: str, path: str, fit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The fits of all tasks: those that ``path`` has under their present fingerprint, and fresh ones, which are added to it."""
    spark, marks = rows.sparkSession, fingerprints(rows, task, parameters)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        done = spark.read.parquet(path).select(task, "fingerprint").distinct()
        rows = rows.join(marks.join(done, [task, "fingerprint"], "left_anti").select(task), task, "left_semi")
    fit(rows).join(marks, task).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(marks, [task, "fingerprint"], "left_semi")


def method(penalty: float = PENALTY) -> dict[str, str | float]:
    """How fits are made, to be kept with their results."""
    return {
        "method": "damped Newton", "penalty": penalty, "objective": "weighted mean negative log likelihood" + (" and half the penalty times the squared slopes" if penalty else ""),
        "gradient_tolerance": TOLERANCE, "line_search": "backtracking by halves, sufficient decrease 1e-4", "most_steps": MOST_STEPS,
        "validation": "each item left out with all its copies", "intervals": "percentiles of refits on whole items drawn with replacement, none of them dropped",
        "constant_features": "mean over the training items where the feature varies, 0.5 if there is none",
    }


class UnknownClass(ValueError):
    """An answer has a class that its item doesn't list."""


def observations(answers: DataFrame, conditions: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    """(source, item, klass, n) of the answers under listed conditions; a class that the catalog lacks is an error.

    ``answers`` has keys, source, item, klass; ``conditions`` the keys that count; ``catalog`` item and klass.
    """
    counted = answers.join(conditions, keys, "left_semi").filter("klass is not null").groupBy("source", "item", "klass").agg(F.count("*").alias("n"))
    if first := counted.join(catalog, ["item", "klass"], "left_anti").first():
        raise UnknownClass(f"{first['klass']!r} of {first['item']!r}")
    return counted


def choice_rows(counts: DataFrame, catalog: DataFrame, features: list[str]) -> DataFrame:
    """The choice design in rows: for each source with answers on an item all candidates of it, with features and share."""
    total = counts.groupBy("source", "item").agg(F.sum("n").alias("total"))
    rows = total.join(catalog.select("item", "klass", *features), "item").join(counts, ["source", "item", "klass"], "left")
    return rows.select("source", "item", "klass", *features, (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def source_rows(counts: DataFrame, first: str, second: str) -> DataFrame:
    """The source design in rows: classes of items that both sources answered, ``y`` 1 for the first; a source's weights add up to 1 on each item."""
    own = counts.filter(F.col("source").isin(first, second))
    both = own.groupBy("item").agg(F.count_distinct("source").alias("k")).filter("k = 2").select("item")
    return own.join(both, "item", "left_semi").select("item", "klass", (F.col("source") == first).cast("int").alias("y"), (F.col("n") / F.sum("n").over(Window.partitionBy("item", "source"))).alias("w"))


def filled(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """A feature that is the same for all candidates of an item takes the mean over the items where it varies, 0.5 if there is none.

    ``rows`` has keys, item and features.  The mean is over candidates of varying items, by key.
    """
    item, whole = Window.partitionBy(*keys, "item"), Window.partitionBy(*keys)
    for f in features:
        varies = F.max(f).over(item) > F.min(f).over(item)
        rows = rows.withColumn("_v", varies).withColumn(f, F.when(F.col("_v"), F.col(f)).otherwise(F.coalesce(F.avg(F.when(F.col("_v"), F.col(f))).over(whole), F.lit(0.5))))
    return rows.drop("_v")


def shares_at(rows: DataFrame, keys: list[str], beta: dict[str, float]) -> DataFrame:
    """Adds probability: what a conditional logit with coefficients ``beta`` gives each candidate of an item."""
    item = Window.partitionBy(*keys, "item")
    term = sum((F.col(f) * b for f, b in beta.items()), F.lit(0.0))
    rows = rows.withColumn("_e", term)
    rows = rows.withColumn("_e", F.col("_e") - F.max("_e").over(item))
    return rows.withColumn("probability", F.exp("_e") / F.sum(F.exp("_e")).over(item)).drop("_e")


def objective_at(rows: DataFrame, keys: list[str], beta: dict[str, float], penalty: float = PENALTY) -> DataFrame:
    """Per key: mean cross-entropy over items plus half the penalty times the squared coefficients; and the largest part of its gradient."""
    found = shares_at(rows, keys, beta).withColumn("_r", F.col("probability") - F.col("share"))
    items = found.groupBy(*keys, "item").agg(F.sum(-F.col("share") * F.log("probability")).alias("loss"), *[F.sum(F.col(f) * F.col("_r")).alias(f"_g{k}") for k, f in enumerate(beta)])
    slopes = [F.abs(F.avg(f"_g{k}") + penalty * b) for k, b in enumerate(beta.values())]
    largest = F.greatest(*slopes) if len(slopes) > 1 else slopes[0]
    return items.groupBy(*keys).agg(F.count("*").alias("items"), (F.avg("loss") + penalty / 2 * sum(b * b for b in beta.values())).alias("objective"), largest.alias("gradient"))


def selected_accuracy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and item: how well the candidate of the largest ``probability`` names what was selected, and what could be reached.

    ``rows`` has keys, item, share and probability, in sample or of items held out.  Candidates tied at the top share
    the selection.  Beside the accuracy: what chance gives, the accuracy relative to it, the largest share as the
    ceiling, the accuracy on the way from chance to the ceiling, the distance from uniform, and the bound 1 + candidates x
    distance that it puts on the relative accuracy.
    """
    top = F.abs(F.col("probability") - F.max("probability").over(Window.partitionBy(*keys, "item")))
    rows = rows.withColumn("_top", top <= 1e-12 + 1e-12 * F.abs("probability")).withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "item")))
    found = rows.groupBy(*keys, "item").agg(
        F.count("*").alias("candidates"),
        F.sum(F.col("_top").cast("int")).alias("top_size"),
        (F.sum(F.when(F.col("_top"), F.col("share")).otherwise(0.0)) / F.sum(F.col("_top").cast("int"))).alias("accuracy"),
        F.max("share").alias("ceiling"),
        (F.sum(F.abs(F.col("share") - 1 / F.col("_n"))) / 2).alias("distance"),
        F.sum(-F.col("share") * F.log(F.greatest(F.lit(1e-12), F.least(F.lit(1.0), "probability")))).alias("loss"),
    )
    chance = 1 / F.col("candidates")
    return found.select(
        *keys, "item", "candidates", "top_size", "accuracy", chance.alias("chance"), (F.col("accuracy") * F.col("candidates")).alias("relative"),
        m.chance_to_ceiling(F.col("accuracy"), chance, F.col("ceiling")).alias("normalized"), "ceiling", "distance",
        (1 + F.col("candidates") * F.col("distance")).alias("relative_bound"), "loss", F.log(F.col("candidates").cast("double")).alias("chance_loss"),
    )


def accuracy_summary(items: DataFrame, keys: list[str], times: str | None = None) -> DataFrame:
    """Means over items of :func:`selected_accuracy`, each item weighing as often as it was drawn (``times``) where that is given."""
    w = F.lit(1) if times is None else F.col(times)
    mean = lambda c: F.sum(c * w) / F.sum(w)
    names = ("loss", "chance_loss", "accuracy", "chance", "relative", "normalized", "relative_bound")
    gain = mean(F.col("chance_loss") - F.col("loss")).alias("loss_gain")
    return items.groupBy(*keys).agg(F.count("*").alias("items"), gain, *[mean(F.col(c)).alias(c) for c in names])


def uniform_information(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, item, i, j, value): each item's information matrix of a uniform choice, from sums over its candidates."""
    n = F.count("*")
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (F.sum(F.col(a) * F.col(b)) / n - F.avg(a) * F.avg(b)).alias("value")) for i, a in enumerate(features) for j, b in enumerate(features)]
    return rows.groupBy(*keys, "item").agg(F.array(*cells).alias("cells")).select(*keys, "item", F.explode("cells").alias("c")).select(*keys, "item", "c.i", "c.j", "c.value")


def design_diagnostics(rows: DataFrame, key: str, features: list[str], least: float = 1e-12) -> DataFrame:
    """Per key: least eigenvalue, condition number and rank of the pooled design; over designs with one item left out, the least eigenvalue and the largest condition number.

    Items come to Python as one small matrix each, a key's items in one group.  ``deficient`` is the first item whose
    absence leaves the design without full rank, or "pooled"; null for a sound design.
    """
    k = len(features)
    one = F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "value"))), lambda c: c["value"])
    items = uniform_information(rows, [key], features).groupBy(key, "item").agg(one.alias("m"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        each = np.array(pdf["m"].tolist(), float).reshape(-1, k, k)
        whole = each.sum(axis=0)
        values, held = np.linalg.eigvalsh(whole), np.linalg.eigvalsh(whole - each)
        short = held[:, 0] <= least
        ratio = np.where(short, np.inf, held[:, -1] / np.where(short, 1, held[:, 0]))
        deficient = "pooled" if values[0] <= least else str(pdf["item"].iloc[int(short.argmax())]) if short.any() else None
        return pd.DataFrame([{
            key: pdf[key].iloc[0], "items": len(pdf), "least": values[0], "condition": values[-1] / values[0] if values[0] > least else np.inf, "rank": int(np.linalg.matrix_rank(whole)),
            "held_least": held[:, 0].min(), "held_condition": ratio.max(), "deficient": deficient,
        }])

    kind = dict(rows.dtypes)[key]
    return items.groupBy(key).applyInPandas(run, f"{key} {kind}, items long, least double, condition double, rank int, held_least double, held_condition double, deficient string")
