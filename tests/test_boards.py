"""Boards under relabelings, permuted squares, anchored axes and selected-answer accuracy against plain Python."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.operators import geometry, logit, puzzles


def least_board(rows):
    n, out = len(rows), []
    for turned in (rows, ["".join(x) for x in zip(*rows, strict=True)]):
        for p in itertools.permutations(range(n)):
            for q in itertools.permutations(range(n)):
                out.append(["".join(turned[r][c] for c in q) for r in p])
    return min(out)


def test_canonical_labels(spark):
    rng = random.Random(0)
    boards = [["".join(rng.choice(".X") for _ in range(4)) for _ in range(4)] for _ in range(12)]
    for b in boards[:6]:  # and the same with lines renamed
        p, q = rng.sample(range(4), 4), rng.sample(range(4), 4)
        boards.append(["".join(b[r][c] for r in p) for c in q])
    rows = spark.createDataFrame(list(enumerate(boards)), "k int, grid array<string>")
    got = {r.k: list(r.c) for r in rows.select("k", puzzles.canonical_labels("grid", 4).alias("c")).collect()}
    assert got == {k: least_board(b) for k, b in enumerate(boards)}
    assert all(got[k] == got[12 + k] for k in range(6))


def test_near_boards(spark):
    """Pairs of different boards stand for all pairs of grids that have them."""
    rng = random.Random(4)
    grids = [(k, "ab"[k % 2], "".join(rng.choice("..#") for _ in range(9))) for k in range(70)]
    rows = spark.createDataFrame([(k, g, [s[:3], s[3:6], s[6:]]) for k, g, s in grids], "k int, g string, grid array<string>")
    forms = lambda s: {"".join(s[x] for x in order) for order in puzzles.symmetries(3)}
    off = lambda x, y: min(sum(a != b for a, b in zip(x, f, strict=True)) for f in forms(y))
    classes = {r.k: (r.board, r.least) for r in puzzles.board_classes(rows, "g", "k", "grid", 3).collect()}
    assert {k: v[0] for k, v in classes.items()} == {k: min(forms(s)) for k, _, s in grids}
    assert all(v[1] == min(j for j, h, s in grids if h == dict((k, g) for k, g, _ in grids)[k] and min(forms(s)) == v[0]) for k, v in classes.items())
    expected = defaultdict(lambda: [9, 0])
    for (i, g, s), (j, h, t) in itertools.combinations(grids, 2):
        a, b = sorted((classes[i][1], classes[j][1]))
        if g == h and a != b and off(s, t) <= 2:
            expected[a, b] = [min(expected[a, b][0], off(s, t)), expected[a, b][1] + 1]
    assert {(r.a, r.b): [r.hamming, r.pairs] for r in puzzles.near_grids(rows, "g", "k", "grid", 3, 2).collect()} == expected


def test_permuted_squares(spark):
    full = ["123456", "456123", "231564", "564231", "312645", "645312"]
    board = ["".join(x if (i * 6 + j) % 3 else "." for j, x in enumerate(row)) for i, row in enumerate(full)]
    rows = spark.createDataFrame([(k, board, full) for k in range(30)], "k int, board array<string>, solution array<string>")
    out = puzzles.permuted_squares(rows, "k", ["board", "solution"], (2, 3), 5).withColumn("holds", puzzles.square_holds("solution", (2, 3))).collect()
    assert all(r.holds for r in out) and len({tuple(r.solution) for r in out}) > 25
    for r in out:
        assert sorted(r.row_order) == sorted(r.column_order) == list(range(6)) and sorted(r.digits) == list("123456")
        assert [x // 2 for x in r.row_order[::2]] == [x // 2 for x in r.row_order[1::2]]
        assert all(len({x // 3 for x in r.column_order[k : k + 3]}) == 1 for k in (0, 3))
        for i, j in itertools.product(range(6), range(6)):
            old, new = full[r.row_order[i]][r.column_order[j]], r.solution[i][j]
            assert r.digits[int(new) - 1] == old
            assert r.board[i][j] == ("." if board[r.row_order[i]][r.column_order[j]] == "." else new)
    broken = spark.createDataFrame([(full[:5] + ["645321"],)], "solution array<string>")
    assert not broken.select(puzzles.square_holds("solution", (2, 3)).alias("h")).first().h


def test_anchored_axes(spark):
    x = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 2.0), ("c", 0, -3.0), ("a", 1, 0.5), ("b", 1, -2.0), ("c", 1, 2.0), ("a", 2, 1.0), ("b", 2, -1.0)], "source string, axis int, value double")
    anchors = spark.createDataFrame([(0, "a", "low"), (0, "b", "low"), (0, "c", "high"), (1, "z", "high"), (1, "a", "low")], "axis int, source string, side string")
    got = {(r.axis, r.source): r.value for r in geometry.anchored(x, anchors).collect()}
    assert got == {(0, "a"): -1.0, (0, "b"): -2.0, (0, "c"): 3.0, (1, "a"): -0.5, (1, "b"): 2.0, (1, "c"): -2.0, (2, "a"): 1.0, (2, "b"): -1.0}


def test_selected_accuracy(spark):
    """Candidates tied at the top share the selection; the accuracy stays below its bound; drawn items weigh by their draws."""
    rng = np.random.default_rng(2)
    rows, expected = [], {}
    for item in range(9):
        k = int(rng.integers(2, 6))
        share, p = rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k))
        if item < 3:
            p = np.full(k, 1 / k)
        top = np.isclose(p, p.max(), rtol=1e-12, atol=1e-12)
        distance = np.abs(share - 1 / k).sum() / 2
        expected[item] = (share[top].sum() / top.sum(), k * share[top].sum() / top.sum(), 1 + k * distance, -(share @ np.log(p)), np.log(k))
        rows += [("s", item, float(a), float(b)) for a, b in zip(share, p, strict=True)]
    items = logit.selected_accuracy(spark.createDataFrame(rows, "source string, item int, share double, probability double"), ["source"])
    got = {r["item"]: (r.accuracy, r.relative, r.relative_bound, r.loss, r.chance_loss) for r in items.collect()}
    for k, v in expected.items():
        assert got[k] == pytest.approx(v) and got[k][1] <= got[k][2] + 1e-12
    plain, drawn = (logit.accuracy_summary(items.withColumn("times", t), ["source"], "times").first() for t in (F.lit(1), F.col("item") % 3))
    e, w = np.array([expected[k] for k in range(9)]), np.array([k % 3 for k in range(9)])
    assert [plain.accuracy, plain.relative, plain.relative_bound, plain.loss] == pytest.approx(e.mean(0)[:4].tolist())
    assert [drawn.accuracy, drawn.loss_gain] == pytest.approx([(w * e[:, 0]).sum() / w.sum(), (w * (e[:, 4] - e[:, 3])).sum() / w.sum()])
