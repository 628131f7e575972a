"""Greatest distances, scaled features and near boards against plain Python."""

import itertools
import math
import random

from tallygrid.operators import integrity, ordering, puzzles


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_max_contrast(spark):
    rng, rows = random.Random(1), []
    for g, shape in enumerate(("box", "disc", "copies", "same", "one", "member", "nan", "mixed")):
        for k in range(60):
            a, r = rng.random() * 2 * math.pi, math.sqrt(rng.random())
            v = [rng.random(), rng.random(), rng.random()] if shape == "box" else [r * math.cos(a), r * math.sin(a)]
            v = [float(k % 3), 0.0] if shape == "copies" else [1.0, 2.0] if shape in ("same", "one") else v
            v = [math.nan, 0.0] if shape == "nan" and k == 7 else v
            v = [[5.0], [None, 1.0], None][k % 3] if shape == "mixed" and k < 6 else v
            rows.append((g, 0 if shape == "member" and k < 50 else k, v))
            if shape == "one":
                break
    expected = {}
    for (g, a, x), (h, b, y) in itertools.combinations(rows, 2):
        if g == h and a != b:
            expected.setdefault(g, [])
            if x is not None and y is not None and len(x) == len(y) and None not in (*x, *y):
                expected[g].append(math.dist(x, y))
    got = {r.g: r.contrast for r in integrity.max_contrast(spark.createDataFrame(rows, "g int, k int, v array<double>"), "g", "k", "v").collect()}
    assert got.keys() == expected.keys() and math.isnan(got.pop(6))
    assert all(abs(v - max(expected[g])) < 1e-12 for g, v in got.items()) and got[3] == 0


def test_scaled_vectors(spark):
    """Ends are those of a group's rows, those that lack the name included, and no window holds a group."""
    cells = [("g", 1, "a", 2.0), ("g", 2, "a", 6.0), ("g", 3, "b", -1.0), ("g", 1, "b", -3.0), ("h", 1, "a", 4.0), ("h", 2, "a", 4.0)]
    out = ordering.scaled_vectors(spark.createDataFrame(cells, "g string, k int, name string, value double"), ["g"], ["k"])
    got = {(r.g, r.k, r.name): round(r.scaled, 6) for r in out.collect()}
    expected = {("g", 1, "a"): 2 / 6, ("g", 2, "a"): 1, ("g", 3, "a"): 0, ("g", 1, "b"): 0, ("g", 2, "b"): 1, ("g", 3, "b"): 2 / 3, ("h", 1, "a"): 0, ("h", 2, "a"): 0}
    assert got == {k: round(v, 6) for k, v in expected.items()} and "Window" not in plan(out)


def test_near_members(spark):
    """Every grid has all grids near it, copies included, as boards with their numbers of grids."""
    rng = random.Random(6)
    grids = [(k, "ab"[k % 2], "".join(rng.choice("..#") for _ in range(4))) for k in range(40)]
    rows = spark.createDataFrame([(k, g, [s[:2], s[2:]]) for k, g, s in grids], "k int, g string, grid array<string>")
    forms = lambda s: {"".join(s[x] for x in order) for order in puzzles.symmetries(2)}
    off = lambda x, y: min(sum(a != b for a, b in zip(x, f, strict=True)) for f in forms(y))
    expected = {}
    for (i, g, s), (j, h, t) in itertools.permutations(grids, 2):
        if g == h and off(s, t) <= 1:
            other = i, min(forms(t))
            expected[other] = off(s, t), expected.get(other, (0, 0))[1] + 1
    board = {k: min(forms(s)) for k, _, s in grids}
    got = {(r.k, board[r.other]): (r.hamming, r.grids) for r in puzzles.near_members(rows, "g", "k", "grid", 2, 1).collect()}
    assert got == expected
