"""Fits on sums over blocks against the same models fitted one by one on whole matrices."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tallygrid.operators import inference, integrity, logit, newton, puzzles


def _design(spark, n=60, seed=5):
    rng, rows = np.random.default_rng(seed), []
    for task in ("a", None):
        for i in range(n):
            item = f"i{i}" if i else None
            q = rng.dirichlet(np.ones(3 + i % 2))
            rows += [(task, item, k, float(v), float(rng.normal(2)), float(i % 5 if i % 4 == 0 else rng.normal())) for k, v in enumerate(q)]
    return spark.createDataFrame(rows, "task string, item string, k int, share double, f double, g double")


def _items(blocks, kind):
    """Each task's blocks, put together on the driver."""
    out = {}
    for r in sorted(blocks.collect(), key=lambda r: (r["_t"], r["block"])):
        out.setdefault(r["_t"], []).append(newton.Block(kind, newton._Named(tuple(r)), 2, 7))
    return out


def _matrices(blocks):
    x, q = [], []
    for b in blocks:
        x += np.split(b.items.x, b.items.head[1:])
        q += np.split(b.items.q, b.items.head[1:])
    return x, q


def test_draws_of_all_blocks_are_one_multinomial(spark):
    blocks = _items(newton.packed(_design(spark), "task", "item", "k", "share", ["f", "g"], 400, 7, ranked=True, block=8), newton.ChoiceItems)
    assert len(blocks) == 2
    for own in blocks.values():
        times = np.concatenate([b.times() for b in own], 1)
        assert len(own) >= 4 and times.shape == (401, 60) and (times[0] == 1).all() and (times.sum(1) == 60).all()
        assert times[1:].mean(0) == pytest.approx(np.ones(60), abs=0.25) and times[1:].var(0).mean() == pytest.approx(1 - 1 / 60, rel=0.06)


def test_choice_fits_equal_single_ones(spark):
    packed = newton.packed(_design(spark), "task", "item", "k", "share", ["f", "g"], 6, 7, ranked=True, block=8)
    found = newton.fits(packed, newton.ChoiceItems, ["f", "g"], 6, 7, 1e-4)
    held = {(r["_t"], r["rep"]): r.held_out for r in newton.held_out(packed, newton.ChoiceItems, ["f", "g"], 2, 7, 1e-4, found).collect()}
    seen = {r["_t"]: r for r in newton.measured(packed, newton.ChoiceItems, ["f", "g"], 7, found).collect()}
    for t, own in _items(packed, newton.ChoiceItems).items():
        model, times = logit.Choice(*_matrices(own)), np.concatenate([b.times() for b in own], 1)
        for rep in range(7):
            assert found[t].x[rep] == pytest.approx(model.fit(times[rep])[0], abs=1e-6)
        assert found[t].size.max() <= 1e-8
        assert seen[t]["items"] == 60 and seen[t].loss == pytest.approx(model.losses(found[t].x[0]).mean()) and seen[t].chance_loss == pytest.approx(np.log([len(q) for q in model.q]).mean())
        for rep in range(3):
            total = 0.0
            for k in np.flatnonzero(times[rep]):
                others = times[rep].copy()
                others[k] = 0
                total += times[rep][k] * model.losses(model.fit(others)[0])[k]
            assert held[t, rep - 1] == pytest.approx(total / 60, abs=1e-9)


def test_source_fits_equal_single_ones(spark):
    rng, rows = np.random.default_rng(2), []
    for i in range(40):
        for y in (0, 1):
            w = rng.dirichlet(np.ones(3))
            rows += [("t", i, y, float(v), float(rng.normal(0.5 * y)), float(rng.normal())) for v in w]
    df = spark.createDataFrame(rows, "task string, item int, y int, w double, f double, g double")
    packed = newton.packed(df, "task", "item", "y", "w", ["f", "g"], 5, 7, ranked=False, block=8)
    found = newton.fits(packed, newton.SourceItems, ["f", "g"], 5, 7, 1e-4)
    held = {r["rep"]: r.held_out for r in newton.held_out(packed, newton.SourceItems, ["f", "g"], 1, 7, 1e-4, found).collect()}
    ((t, own),) = _items(packed, newton.SourceItems).items()
    times = np.concatenate([b.times() for b in own], 1)
    x, y, w = (np.concatenate([getattr(b.items, c) for b in own]) for c in "xyw")
    of = np.repeat(np.arange(40), np.concatenate([b.items.size for b in own]))
    for rep in range(6):
        model = logit.Source(x[:, 1:], y, w * times[rep][of])
        assert found[t].x[rep] == pytest.approx(model.fit()[0], abs=1e-6)
    for rep in range(2):
        total = 0.0
        for k in np.flatnonzero(times[rep]):
            beta = logit.Source(x[:, 1:], y, w * times[rep][of] * (of != k)).fit()[0]
            p, mine = 0.5 * (1 + np.tanh(x @ beta / 2)), of == k
            total += times[rep][k] * (w * np.where(p > 0.5, y, 1 - y))[mine].sum() / w[mine].sum()
        assert held[rep - 1] == pytest.approx(total / 40, abs=1e-9)


def test_no_rows_and_a_single_item(spark):
    none = _design(spark).limit(0)
    assert logit.choice_fits(none, "task", "item", "k", "share", ["f", "g"], repeats=3).count() == 0
    one = _design(spark, n=1)
    rows = logit.choice_fits(one, "task", "item", "k", "share", ["f", "g"], repeats=3).collect()
    assert len(rows) == 4 and all(r.held_out_loss is None and r["items"] == 1 for r in rows)


def test_steps_are_halved_until_they_gain():
    """A step that overshoots is taken back by halves."""
    way = newton.Steps(np.zeros((1, 1)))
    shrink = np.zeros(1)
    way.advance(np.array([[1.0, 5.0, 1.0, 0.5]]), shrink, 99)  # slope 1, curvature 0.5: the step is -2
    assert way.trial[0, 0] == -2
    way.advance(np.array([[1.0, 9.0, 0.0, 0.0]]), shrink, 99)
    assert way.trial[0, 0] == -1 and way.steps[0] == 0 and way.open[0]
    way.advance(np.array([[1.0, 4.0, 0.0, 1.0]]), shrink, 99)
    assert way.x[0, 0] == -1 and way.steps[0] == 1 and not way.open[0]


def test_paired_correlations_from_sums(spark):
    rng = np.random.default_rng(8)
    values = {(s, t, i): float(rng.normal() + (i % 7 if s != "c" else 0)) for s in "abc" for t in ("x", None) for i in range(50)}
    df = spark.createDataFrame([(*k, v) for k, v in values.items()] + [("a", "x", 99, None), (None, "x", 1, 2.0)], "source string, stratum string, item int, value double")
    for block in (1024, 8):
        got = {(r.left, r.right): r for r in inference.paired_correlations(df, 600, 3, block).collect()}
        assert sorted(got) == [("a", "b"), ("a", "c"), ("b", "c")]
        for (left, right), r in got.items():
            x, y = (np.array([[values[s, t, i] for i in range(50)] for t in ("x", None)]) for s in (left, right))
            assert r.mean_r == pytest.approx(np.mean([np.corrcoef(a, b)[0, 1] for a, b in zip(x, y)])) and r.pooled_r == pytest.approx(np.corrcoef(x.ravel(), y.ravel())[0, 1])
            drawn = []
            for _ in range(600):
                at = rng.integers(0, 50, (2, 50))
                drawn.append(np.mean([np.corrcoef(a[k], b[k])[0, 1] for a, b, k in zip(x, y, at)]))
            assert (r.low, r.high) == pytest.approx(tuple(np.quantile(drawn, (0.025, 0.975))), abs=0.05)
    flat = df.withColumn("value", F.when(F.col("source") == "c", 4.0).otherwise(F.col("value")))
    assert inference.paired_correlations(flat, 20, 3).filter("left = 'a' and right = 'c'").first().mean_r is None


def test_agreeing_rows_are_counted_without_pairs(spark):
    rng = np.random.default_rng(9)
    rows = [(k, *(None if v == 3 else int(v) for v in rng.integers(0, 4, 4))) for k in range(80)]
    lists = [["a", "b"], ["b", "c"], ["d"]]
    at = {c: k + 1 for k, c in enumerate("abcd")}
    same = lambda p, q: any(all(p[at[c]] is not None and p[at[c]] == q[at[c]] for c in cs) for cs in lists)
    want = {p[0]: n for p in rows if (n := sum(same(p, q) for q in rows if q[0] != p[0]))}
    got = integrity.same_in_any(spark.createDataFrame(rows, "k int, a int, b int, c int, d int"), "k", lists, "others")
    assert {r.k: r.others for r in got.collect()} == want and got.columns == ["k", "others"]


def test_diverse_rows_are_the_farthest(spark):
    rng = np.random.default_rng(4)
    rows = [(g, k, [float(v) for v in rng.integers(0, 4, 2)] + [1.0]) for g in ("a", "b", None) for k in range(12)] + [("c", 5, [1.0, 2.0, 3.0])]
    got = {}
    for r in puzzles.diverse(spark.createDataFrame(rows, "g string, k int, v array<double>"), "g", "k", "v", 5).collect():
        got.setdefault(r.g, {})[r.place] = r.k
    assert got["c"] == {1: 5}
    for g in ("a", "b", None):
        x = np.array([v for h, _, v in rows if h == g])
        width = np.ptp(x, axis=0)
        x = (x - x.min(0)) / np.where(width > 0, width, 1)
        chosen = [0]
        while len(chosen) < 5:
            gap = ((x[:, None] - x[chosen]) ** 2).sum(2).min(1)
            gap[chosen] = -1
            chosen.append(int(gap.argmax()))
        assert [got[g][p] for p in range(1, 6)] == chosen


@pytest.mark.parametrize("kind", [newton.ChoiceItems, newton.SourceItems])
def test_items_left_out_need_no_other_items(kind):
    """Among many items each fit without one follows from the derivatives of all; among few that isn't sure."""
    rng = np.random.default_rng(3)

    def design(n):
        size = rng.integers(2, 5, n)
        size += size % 2 if kind is newton.SourceItems else 0
        x, order = rng.normal(size=(size.sum(), 2)), np.arange(size.sum()) % 2.0
        return kind(x, order, rng.random(size.sum()) + 0.1, size)

    def fitted(items, times):
        k = len(kind.names(["f", "g"]))
        way = newton.Steps(np.zeros((len(times), k)))
        while way.open.any():
            way.advance(items.sums(way.trial[way.open], times[way.open]), kind.shrink(["f", "g"], 1e-4), newton.MOST_STEPS)
        return way.x

    for n, surely in ((20_000, True), (6, False)):
        items, times = design(n), rng.poisson(1.0, n).astype(float)
        start = fitted(items, times[None])[0]
        orders = items.orders(start, times)
        k = len(start)
        about = items.ranges(), [o.reshape((k,) * j) for j, o in enumerate(orders)]
        score, sure = newton._without(items, times, start, about, kind.shrink(["f", "g"], 1e-4))
        assert sure.all() if surely else not sure.all()
        some = np.flatnonzero(sure)[:: max(1, n // 20)]
        others = np.repeat(times[None], len(some), 0)
        others[np.arange(len(some)), some] = 0
        assert score[some] == pytest.approx(items.scores(fitted(items, others), some), abs=1e-7)
