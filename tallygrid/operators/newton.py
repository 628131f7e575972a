"""Many fits at once, by damped Newton steps on sums that Spark makes over blocks of items.

A fit belongs to a task and to a draw of the task's items; draw -1 takes each item once.  Items sit in blocks of a
bounded number, whatever a task's size, each block one packed row of a checkpoint.  A pass sends every open fit's
coefficients to the blocks; these answer with weight, loss, gradient and information, which are added up by task and draw
before the next step is taken, by task and a few draws side by side.  The driver holds coefficients only: tasks x draws x features.
Draws start at the fit of all items.  Fits without an item start there too, and need no pass: near that point the sums of all
items follow from their derivatives, with a bound on what that leaves out.
"""

from __future__ import annotations

import copy
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inference import block_counts, block_of, dealt, generator, people_blocks
from .lineage import fixed, spread

TOLERANCE = 1e-8
MOST_STEPS = 10_000
#: Items of a block, and of a group of left-out ones.
BLOCK = 128
#: Numbers of a message of sums, and of a worker's matrix of rows by draws.
MESSAGE, ROOM = 4096, 1 << 19


class ChoiceItems:
    """Items of a conditional logit: an item's candidates are a run of rows.

    Features count from their mean in the item, which leaves the shares as they are; one that doesn't vary
    inside an item says nothing of its choice, whatever constant stands for it.
    """

    metric, measures = "loss", ["loss", "chance_loss"]

    def __init__(self, x: np.ndarray, order: np.ndarray, target: np.ndarray, size: np.ndarray):
        self.size, self.head = size, np.cumsum(size) - size
        self.x = x - np.repeat(np.add.reduceat(x, self.head) / size[:, None], size, 0)
        self.q = target / np.repeat(np.add.reduceat(target, self.head), size)
        self.pairs = (self.x[:, :, None] * self.x[:, None, :]).reshape(len(x), -1)

    @staticmethod
    def names(features: list[str]) -> list[str]:
        return features

    @staticmethod
    def shrink(features: list[str], penalty: float) -> np.ndarray:
        return np.full(len(features), penalty)

    def _shares(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, draws) of shares and (items, draws) of cross-entropies in nats."""
        e = self.x @ beta.T
        top = np.maximum.reduceat(e, self.head)
        p = np.exp(e - np.repeat(top, self.size, 0))
        total = np.add.reduceat(p, self.head)
        return p / np.repeat(total, self.size, 0), top + np.log(total) - np.add.reduceat(self.q[:, None] * e, self.head)

    def sums(self, beta: np.ndarray, times: np.ndarray) -> np.ndarray:
        """For each draw: weight, loss, gradient and information, summed over the items as often as it took them."""
        p, loss = self._shares(_different(beta))
        t, k = times.T, beta.shape[1]
        each = np.repeat(t, self.size, 0)
        information = (each * p).T @ self.pairs
        means = [np.add.reduceat(p * self.x[:, a, None], self.head) for a in range(k)]
        for a in range(k):
            for b in range(k):
                information[:, a * k + b] -= (t * means[a] * means[b]).sum(0)
        return np.column_stack((t.sum(0), (t * loss).sum(0), (each * (p - self.q[:, None])).T @ self.x, information))

    def scores(self, beta: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Loss of items, each under its own coefficients."""
        return self._shares(beta)[1][items, np.arange(len(items))]

    #: Of the gradient's remainder after three orders: a fifth cumulant is at most 11 products of ranges, over 4!.
    REMAINDER = 11 / 24

    def ranges(self) -> np.ndarray:
        """Of each feature the largest range in an item."""
        return (np.maximum.reduceat(self.x, self.head) - np.minimum.reduceat(self.x, self.head)).max(0)

    def orders(self, beta: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
        """Weight, gradient and the next three orders of its derivatives at a point: sums of each item's joint cumulants of the features."""
        p = self._shares(beta[None])[0]
        t, each, k = times, np.repeat(times, self.size)[:, None] * p, len(beta)
        mean = np.add.reduceat(p * self.x, self.head)
        c = self.x - np.repeat(mean, self.size, 0)
        pairs = (c[:, :, None] * c[:, None, :]).reshape(len(c), -1)
        own = np.add.reduceat(p * pairs, self.head)
        return [np.array([t.sum()]), self.x.T @ (each[:, 0] - np.repeat(t, self.size) * self.q), each[:, 0] @ pairs, (each * c).T @ pairs, (each * pairs).T @ pairs - 3 * (t[:, None] * own).T @ own]

    def alone(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each item's weight, gradient, information and score under coefficients of its own (items, features)."""
        e = (self.x * np.repeat(beta, self.size, 0)).sum(1)
        top = np.maximum.reduceat(e, self.head)
        p = np.exp(e - np.repeat(top, self.size))
        total = np.add.reduceat(p, self.head)
        p = (p / np.repeat(total, self.size))[:, None]
        mean, k = np.add.reduceat(p * self.x, self.head), beta.shape[1]
        information = np.add.reduceat(p * self.pairs, self.head).reshape(-1, k, k) - mean[:, :, None] * mean[:, None, :]
        return np.ones(len(self.size)), mean - np.add.reduceat(self.q[:, None] * self.x, self.head), information, top + np.log(total) - np.add.reduceat(self.q * e, self.head)

    def measure(self, beta: np.ndarray) -> list[float]:
        """Number of items, and sums of what is averaged over them."""
        return [len(self.size), float(self._shares(beta[None])[1].sum()), float(np.log(self.size).sum())]


class SourceItems:
    """Items of a weighted logistic regression with an intercept, which isn't penalised; ``order`` is the outcome."""

    metric, measures = "accuracy", ["accuracy"]

    def __init__(self, x: np.ndarray, order: np.ndarray, target: np.ndarray, size: np.ndarray):
        self.size, self.head = size, np.cumsum(size) - size
        self.x, self.y, self.w = np.column_stack((np.ones(len(x)), x)), order, target
        self.pairs = (self.x[:, :, None] * self.x[:, None, :]).reshape(len(x), -1)

    @staticmethod
    def names(features: list[str]) -> list[str]:
        return ["intercept", *features]

    @staticmethod
    def shrink(features: list[str], penalty: float) -> np.ndarray:
        return penalty * np.r_[0.0, np.ones(len(features))]

    def sums(self, beta: np.ndarray, times: np.ndarray) -> np.ndarray:
        """For each draw: weight, loss, gradient and information."""
        e = self.x @ _different(beta).T
        p, w = 0.5 * (1 + np.tanh(e / 2)), np.repeat(times.T, self.size, 0) * self.w[:, None]
        y = self.y[:, None]
        return np.column_stack((w.sum(0), (w * (np.logaddexp(0, e) - y * e)).sum(0), (w * (p - y)).T @ self.x, (w * p * (1 - p)).T @ self.pairs))

    def _right(self, beta: np.ndarray) -> np.ndarray:
        """(rows, draws): the weight rightly told, a half at even chances."""
        p = 0.5 * (1 + np.tanh(self.x @ beta.T / 2))
        y = self.y[:, None]
        return self.w[:, None] * np.where(p > 0.5, y, np.where(p < 0.5, 1 - y, 0.5))

    def scores(self, beta: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Accuracy on items, each under its own coefficients."""
        right, weight = np.add.reduceat(self._right(beta), self.head), np.add.reduceat(self.w, self.head)
        return right[items, np.arange(len(items))] / weight[items]

    #: The logistic function's fourth derivative stays below a quarter; over 4!.
    REMAINDER = 0.25 / 24

    def ranges(self) -> np.ndarray:
        """Of each feature the largest size."""
        return np.abs(self.x).max(0)

    def orders(self, beta: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
        """Weight, gradient and the next three orders of its derivatives at a point."""
        p, w = 0.5 * (1 + np.tanh(self.x @ beta / 2)), np.repeat(times, self.size) * self.w
        one = p * (1 - p)
        return [np.array([w.sum()]), self.x.T @ (w * (p - self.y)), (w * one) @ self.pairs, (self.x.T * (w * one * (1 - 2 * p))) @ self.pairs, (self.pairs.T * (w * one * (1 - 6 * one))) @ self.pairs]

    def alone(self, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each item's weight, gradient, information and score under coefficients of its own (items, features)."""
        p, k = 0.5 * (1 + np.tanh((self.x * np.repeat(beta, self.size, 0)).sum(1) / 2)), beta.shape[1]
        add = lambda v: np.add.reduceat(v, self.head)
        right, weight = self.w * np.where(p > 0.5, self.y, np.where(p < 0.5, 1 - self.y, 0.5)), add(self.w)
        return weight, add((self.w * (p - self.y))[:, None] * self.x), add((self.w * p * (1 - p))[:, None] * self.pairs).reshape(-1, k, k), add(right) / weight

    def measure(self, beta: np.ndarray) -> list[float]:
        return [float(self.w.sum()), float(self._right(beta[None]).sum())]


def _different(beta: np.ndarray) -> np.ndarray:
    """One row for many that are the same."""
    return beta[:1] if (beta == beta[:1]).all() else beta


class Steps:
    """Where some fits are on their way: the last point taken, the point under trial, and how the trial is judged."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.x, self.trial, self.move = x, x.copy(), np.zeros_like(x)
        self.now, self.slope, self.scale, self.size = np.full(n, np.inf), np.zeros(n), np.ones(n), np.full(n, np.inf)
        self.halved, self.steps, self.whole = np.zeros(n, int), np.zeros(n, int), np.zeros(n, int)
        self.open = np.ones(n, bool)

    def advance(self, sums: np.ndarray, shrink: np.ndarray, most: int) -> None:
        """Takes or halves the step of each open fit, given the sums at its trial point in order."""
        k = self.x.shape[1]
        for i, s in zip(np.flatnonzero(self.open), sums, strict=True):
            if not s[0] > 0:
                self.x[i], self.open[i] = np.nan, False
                continue
            beta = self.trial[i]
            value = s[1] / s[0] + shrink @ beta**2 / 2
            if not self.whole[i] and not value <= self.now[i] + 1e-4 * self.scale[i] * self.slope[i]:
                self.halved[i] += 1
                self.scale[i] /= 2
                self.open[i] = self.halved[i] < 60
                self.trial[i] = self.x[i] + self.scale[i] * self.move[i]
                continue
            self.steps[i] += np.isfinite(self.now[i])
            self.x[i], self.now[i] = beta, value
            gradient, information = s[2 : 2 + k] / s[0] + shrink * beta, s[2 + k :].reshape(k, k) / s[0] + np.diag(shrink)
            self.size[i] = np.abs(gradient).max(initial=0.0)
            # A step that gains less than the value's rounding is taken whole; a few of them reach what can be reached.
            if self.size[i] <= TOLERANCE or self.steps[i] >= most or self.whole[i] >= 10:
                self.open[i] = False
                continue
            try:
                move = -np.linalg.solve(information, gradient)
            except np.linalg.LinAlgError:
                move = -np.linalg.pinv(information) @ gradient
            slope = gradient @ move
            if slope >= 0:
                move, slope = -gradient, -(gradient @ gradient)
            self.whole[i] = self.whole[i] + 1 if -slope <= 1e-12 * max(1.0, abs(value)) else 0
            self.move[i], self.slope[i], self.scale[i], self.halved[i] = move, slope, 1.0, 0
            self.trial[i] = beta + move


class _Named:
    """A packed row by name."""

    def __init__(self, row: tuple):
        self.t, self.block, self.n, self.size, self.x, self.order, self.target, self.counts = row


class Block:
    """A packed block: its items, and how often each draw takes them."""

    def __init__(self, kind: type, row: _Named, width: int, seed: int):
        size = np.frombuffer(row.size, np.int64)
        self.items = kind(np.frombuffer(row.x, float).reshape(-1, width), np.frombuffer(row.order, float), np.frombuffer(row.target, float), size)
        self.number, self.counts, self.seed = row.block, np.frombuffer(row.counts, np.int64), seed

    def times(self) -> np.ndarray:
        """(1 + draws, items): once each, then the draws' own share of the block, dealt to its items by the block's generator."""
        return dealt(self.counts, len(self.items.size), generator(str(self.seed), "items", str(self.number)))


_PACKED = "_t string, block long, n long, size binary, x binary, order binary, target binary, counts binary"


def packed(rows: DataFrame, task: str, item: str, order: str, target: str, features: list[str], repeats: int, seed: int, ranked: bool, block: int = BLOCK) -> DataFrame:
    """One row for each task and block of items; ``order`` ranks an item's rows (``ranked``) or is a number that the fit reads.

    Draws go down a splitting tree over the items' hashes, so that all blocks of a task share one multinomial of its items.
    """
    outcome = F.lit(0.0) if ranked else F.col(order).cast("double")
    ready = rows.select(
        F.to_json(F.struct(F.col(task).alias("task"))).alias("_t"), F.col(item).cast("string").alias("_item"), F.col(order).alias("_order"),
        outcome.alias("_outcome"), F.col(target).cast("double").alias("_target"), *[F.col(f).cast("double").alias(f"_x{k}") for k, f in enumerate(features)],
    ).withColumn("h", F.xxhash64(F.lit(seed), "_item"))
    ready = fixed(ready)
    items = ready.select("_t", "_item", "h").distinct()
    most = items.groupBy("_t").count().agg(F.max("count")).first()[0] or 1
    depth = max(0, math.ceil(math.log2(most / block)))
    columns = [f"_x{k}" for k in range(len(features))]

    def pack(key: tuple, own: pd.DataFrame, way: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["h", "_item", "_order"])
        size = np.bincount(own.groupby(["h", "_item"], dropna=False, sort=False).ngroup().to_numpy())
        counts = block_counts(list(way["path"].iloc[0]), repeats, seed, 0)
        data = {"size": size.astype(np.int64), "x": own[columns].to_numpy(float), "order": own["_outcome"].to_numpy(float), "target": own["_target"].to_numpy(float), "counts": counts}
        return pd.DataFrame([{"_t": key[0], "block": key[1], "n": len(size), **{c: np.ascontiguousarray(v).tobytes() for c, v in data.items()}}])

    mine = spread(ready.withColumn("block", block_of("h", depth)), "_t", "block").groupBy("_t", "block")
    ways = people_blocks(items, depth, ("_t",)).select(F.col("_t").alias("_of"), F.col("block").alias("_number"), "path")
    ways = spread(ways, "_of", "_number").groupBy("_of", "_number")
    return fixed(spread(mine.cogroup(ways).applyInPandas(pack, _PACKED), "_t", "block").sortWithinPartitions("_t", "block"))


def _message(t: str, held: dict[int, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"_t": t, "chunk": np.array(list(held), np.int32), "sums": [np.ascontiguousarray(v).tobytes() for v in held.values()]})


def _pass(blocks: DataFrame, kind: type, features: list[str], starts: list[range], seed: int, shrink: np.ndarray, most: int, shared) -> DataFrame:
    """(_t, chunk, state): the open fits one evaluation further."""
    width = len(features)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, of = {}, None
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                t = row[0]
                if held and t != of:
                    yield _message(of, held)
                    held = {}
                of, own = t, Block(kind, _Named(row), width, seed)
                times = own.times() if any(t == k and c for k, c in shared.value) else np.ones((1, len(own.items.size)))
                room = max(1, ROOM // max(1, len(own.items.x)))
                for c, numbers in enumerate(starts):
                    if (t, c) in shared.value:
                        here = shared.value[t, c]
                        open_, at = here.trial[here.open], times[numbers.start : numbers.stop][here.open]
                        found = np.concatenate([own.items.sums(open_[a : a + room], at[a : a + room]) for a in range(0, len(open_), room)])
                        held[c] = held[c] + found if c in held else found
        if held:
            yield _message(of, held)

    def advance(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        here = copy.deepcopy(shared.value[key[0], key[1]])  # a worker that runs a task again needs it as it was
        total = sum(np.frombuffer(b, float) for b in pdf["sums"])
        here.advance(total.reshape(int(here.open.sum()), -1), shrink, most)
        return pd.DataFrame([{"_t": key[0], "chunk": key[1], "state": pickle.dumps(here)}])

    sums = blocks.mapInPandas(partial, "_t string, chunk int, sums binary")
    return sums.groupBy("_t", "chunk").applyInPandas(advance, "_t string, chunk int, state binary")


def _run(blocks: DataFrame, kind: type, features: list[str], starts: list[range], seed: int, shrink: np.ndarray, most: int, state: dict, todo: dict) -> None:
    """Passes until the fits of ``todo`` are closed in ``state``."""
    while todo:
        shared = blocks.sparkSession.sparkContext.broadcast(dict(todo))
        for r in _pass(blocks, kind, features, starts, seed, shrink, most, shared).collect():
            state[r["_t"], r["chunk"]] = pickle.loads(r["state"])
        shared.unpersist()
        todo = {key: state[key] for key in todo if state[key].open.any()}


def fits(blocks: DataFrame, kind: type, features: list[str], repeats: int, seed: int, penalty: float, most: int = MOST_STEPS) -> dict[str, Steps]:
    """Every task's fits of all draws, by Newton steps; the first is that of each item once."""
    names = kind.names(features)
    k, shrink = len(names), kind.shrink(features, penalty)
    chunk = max(1, MESSAGE // (k * k + k + 2))
    starts = [range(0, 1), *(range(a, min(repeats + 1, a + chunk)) for a in range(1, repeats + 1, chunk))]
    tasks = [r["_t"] for r in blocks.select("_t").distinct().collect()]
    state = {(t, 0): Steps(np.zeros((1, k))) for t in tasks}
    _run(blocks, kind, features, starts, seed, shrink, most, state, state)
    start = {t: np.where(np.isfinite(state[t, 0].x).all(), state[t, 0].x, 0.0) for t in tasks}
    drawn = {(t, c): Steps(np.repeat(start[t], len(own), 0)) for t in tasks for c, own in enumerate(starts) if c}
    state.update(drawn)
    _run(blocks, kind, features, starts, seed, shrink, most, state, drawn)
    out: dict[str, Steps] = {}
    for t in dict.fromkeys(t for t, _ in state):
        parts = [state[t, c] for c in range(len(starts))]
        out[t] = Steps(np.concatenate([p.x for p in parts]))
        out[t].size, out[t].steps = (np.concatenate([getattr(p, c) for p in parts]) for c in ("size", "steps"))
    return out


def measured(blocks: DataFrame, kind: type, features: list[str], seed: int, found: dict[str, Steps]) -> DataFrame:
    """(_t, items, measures): how the fits of all items do on these, summed over blocks."""
    points, width = {t: s.x[0] for t, s in found.items()}, len(features)
    names = ["_w", *kind.measures]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(row[0], row[2], *Block(kind, _Named(row), width, seed).items.measure(points[row[0]])) for row in batch.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=["_t", "items", *names])

    sums = blocks.mapInPandas(measure, ", ".join(["_t string", "items long", *(f"{c} double" for c in names)]))
    return sums.groupBy("_t").agg(F.sum("items").alias("items"), *[(F.sum(c) / F.sum("_w")).alias(c) for c in kind.measures])


def _orders_at(blocks: DataFrame, kind: type, features: list[str], starts: dict[str, np.ndarray], seed: int) -> dict[tuple[str, int], tuple[np.ndarray, list[np.ndarray]]]:
    """For each task and draw (from 0, the first being each item once): the features' ranges, and the derivatives summed over all items."""
    width = len(features)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {}
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                own = Block(kind, _Named(row), width, seed)
                times = own.times() if len(starts[row[0]]) > 1 else np.ones((1, len(own.items.size)))
                ranges = own.items.ranges()
                for draw, beta in enumerate(starts[row[0]]):
                    found = np.concatenate([o.ravel() for o in own.items.orders(beta, times[draw])])
                    before = held.get((row[0], draw))
                    held[row[0], draw] = (ranges, found) if before is None else (np.maximum(ranges, before[0]), found + before[1])
        rows = [(t, draw, r.tolist(), v.tolist()) for (t, draw), (r, v) in held.items()]
        yield pd.DataFrame(rows, columns=["_t", "draw", "ranges", "sums"])

    parts = blocks.mapInPandas(partial, "_t string, draw int, ranges array<double>, sums array<double>").select("_t", "draw", F.posexplode("sums").alias("i", "v"), "ranges")
    sums = parts.groupBy("_t", "draw", "i").agg(F.sum("v").alias("v"))
    tops = parts.filter("i = 0").select("_t", "draw", F.posexplode("ranges").alias("i", "v")).groupBy("_t", "draw", "i").agg(F.max("v").alias("v"))
    found: dict[tuple[str, int], tuple[dict, dict]] = {}
    for which, rows in enumerate((tops, sums)):
        for r in rows.collect():  # tasks x draws x derivatives
            found.setdefault((r["_t"], r["draw"]), ({}, {}))[which][r["i"]] = r["v"]
    out = {}
    for key, (top, v) in found.items():
        k, flat = len(top), np.array([v[i] for i in range(len(v))])
        cuts = np.cumsum([1, k, k**2, k**3])
        shapes = [(), (k,), (k, k), (k, k, k), (k, k, k, k)]
        out[key] = np.array([top[i] for i in range(k)]), [x.reshape(shape) for x, shape in zip(np.split(flat, cuts), shapes, strict=True)]
    return out


def _without(items, times: np.ndarray, start: np.ndarray, about: tuple[np.ndarray, list[np.ndarray]], shrink: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score of each item under the fit without it, whether that fit is sure to meet the tolerance).

    The gradient of all items is expanded to three orders about ``start``, an item's own part is taken off as it is.
    A fit is sure if its gradient and the bound on the expansion's remainder are half the tolerance each at most.
    """
    ranges, (weight, gradient, second, third, fourth) = about
    beta, sure = np.repeat(start[None], len(items.size), 0), np.zeros(len(items.size), bool)
    with np.errstate(all="ignore"):
        for _ in range(30):
            d = beta - start
            own, mine, information, score = items.alone(beta)
            left = weight - times * own
            bent = np.einsum("abc,nc->nab", third, d)
            bent2 = np.einsum("abcd,nc,nd->nab", fourth, d, d)
            slope = gradient + np.einsum("nab,nb->na", second + bent / 2 + bent2 / 6, d) - times[:, None] * mine
            slope = slope / left[:, None] + shrink * beta
            rest = _remainder(items, ranges, d) * weight / left
            sure = (np.abs(slope).max(1, initial=0.0) <= TOLERANCE / 2) & (rest <= TOLERANCE / 2) & (left > 0)
            if sure.all():
                break
            curved = (second + bent - times[:, None, None] * information) / left[:, None, None] + np.diag(shrink)
            try:
                beta = beta - np.linalg.solve(curved, slope[:, :, None])[:, :, 0]
            except np.linalg.LinAlgError:
                break
    return score, sure & np.isfinite(score)


def _remainder(items, ranges: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The most that the gradient of one unit of weight is off after three orders, a step ``d`` away."""
    return items.REMAINDER * ranges.max(initial=0.0) * (np.abs(d) @ ranges) ** 4


def held_out(blocks: DataFrame, kind: type, features: list[str], reps: int, seed: int, penalty: float, found: dict[str, Steps]) -> DataFrame:
    """(_t, rep, held_out) of draw -1 and the first ``reps`` ones: the mean over drawn items of their score under the fit without the item (all its copies).

    Each block finds its items' fits from the derivatives of all items at the draw's own fit, so the work follows the items.
    Fits that aren't sure to meet the tolerance that way, those of few items mostly, are made on all other items: they are
    left out in groups side by side, each group's fits at once.  Such a group reads its task whole, as packed blocks.
    """
    starts, width, shrink = {t: s.x[: reps + 1] for t, s in found.items()}, len(features), kind.shrink(features, penalty)
    about = blocks.sparkSession.sparkContext.broadcast(_orders_at(blocks, kind, features, starts, seed))
    columns = blocks.columns
    drawn = {r["_t"]: r["n"] for r in blocks.groupBy("_t").agg(F.sum("n").alias("n")).collect()}

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                own, t = Block(kind, _Named(row), width, seed), row[0]
                times = own.times() if reps else np.ones((1, len(own.items.size)))
                for draw, start in enumerate(starts[t]):
                    score, sure = _without(own.items, times[draw], start, about.value[t, draw], shrink)
                    apart = (times[draw] > 0) & (times[draw] < drawn[t])
                    done = apart & sure
                    out.append((t, draw - 1, row[1], float(times[draw][done] @ score[done]), float(times[draw][done].sum()), np.flatnonzero(apart & ~sure).tolist()))
            yield pd.DataFrame(out, columns=["_t", "rep", "part", "total", "n", "places"])

    first = fixed(blocks.mapInPandas(near, "_t string, rep int, part long, total double, n double, places array<int>"))
    groups = first.filter(F.size("places") > 0).select("_t", "rep", "part", "places")

    def leave(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, rep, part = key
        pdf = pdf.sort_values("block")
        places, before = np.array(pdf["places"].iloc[0]), int(pdf.loc[pdf["block"] < part, "n"].sum())
        pdf = pdf[columns]
        times = np.concatenate([Block(kind, _Named(row), width, seed).times()[rep + 1] for row in pdf.itertuples(index=False, name=None)])
        whole = lambda c, of: np.frombuffer(b"".join(pdf[c]), of)
        items = kind(whole("x", float).reshape(-1, width), whole("order", float), whole("target", float), whole("size", np.int64))
        out = places + before
        total, room = 0.0, max(1, ROOM // max(1, len(items.x)))
        for a in range(0, len(out), room):
            some = out[a : a + room]
            others = np.repeat(times[None], len(some), 0)
            others[np.arange(len(some)), some] = 0
            way = Steps(np.repeat(starts[t][rep + 1][None], len(some), 0))
            while way.open.any():
                way.advance(items.sums(way.trial[way.open], others[way.open]), shrink, MOST_STEPS)
            total += float(times[some] @ items.scores(way.x, some))
        return pd.DataFrame([{"_t": t, "rep": rep, "total": total, "n": float(times[out].sum())}])

    apart = spread(blocks.join(groups, "_t"), "_t", "rep", "part").groupBy("_t", "rep", "part").applyInPandas(leave, "_t string, rep int, total double, n double")
    apart = first.select("_t", "rep", "total", "n").unionAll(apart)
    return apart.groupBy("_t", "rep").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("held_out"))
