"""Puzzles that many rows share are solved once, and what follows isn't pushed down into the solver."""

import itertools

import pytest
from pyspark.sql import functions as F

from tallygrid.functions import solvers
from tallygrid.operators import puzzles
from tallygrid.plans import catalog


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    rows = spark.range(1, 161).select(F.col("id").alias("p_partkey"), F.concat(F.lit("b"), F.col("id") % 2).alias("p_brand"), (F.col("id") % 50 + 1).cast("int").alias("p_size"), F.col("id").cast("double").alias("p_retailprice"))
    rows.write.parquet(str(folder / "part.parquet"))
    return str(folder)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_solved_once(spark):
    """Each different puzzle reaches the solver once, null ones too; a row has all its solutions, or none."""
    seen = []

    def solve(sets):
        seen.extend(r.n for r in sets.collect())
        return sets.filter("n is null or n > 0").select("n", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("found"))

    rows = spark.createDataFrame([(k, n) for k, n in enumerate([1, 0, 1, None, 1, None])], "k int, n int")
    got = sorted((r.k, r.found) for r in puzzles.solved_once(rows, "k", ["n"], solve).collect())
    assert sorted(seen, key=str) == [0, 1, None] and got == [(k, f) for k in (0, 2, 3, 4, 5) for f in "xy"]


@pytest.mark.parametrize(
    "name, step",
    [("canonical_boards", "array_sort"), ("solver_arithmetic", "arithmetic_solutions"), ("arithmetic_features", "arithmetic_classes"), ("solver_maze", "Window"), ("shortest_walks", "maze_solutions"), ("forced_mines", "mine_solutions"), ("grid_classes", "array_min")],
)
def test_rows_take_solutions_of_their_puzzle(spark, parts, name, step):
    assert step not in plan(catalog.QUERIES[name](spark, parts))


def test_near_boards_are_turned_once(spark):
    rows = spark.createDataFrame([(k, "a", ["#..", "...", s]) for k, s in enumerate(["...", "..#", "..."])], "k int, g string, grid array<string>")
    out = puzzles.near_grids(rows, "g", "k", "grid", 3, 2)
    assert "array_min" not in plan(out) and [tuple(r) for r in out.collect()] == [(0, 1, 1, 2)]


def test_walks_and_mines_of_copies(spark, parts):
    side, walks, mines = 5, {}, {}
    for r in catalog.QUERIES["shortest_walks"](spark, parts).collect():
        walks.setdefault(r.puzzle_id, []).append(r.moves)
    for r in catalog.QUERIES["forced_mines"](spark, parts).collect():
        mines.setdefault(r.p_partkey, set()).add((r.r, r.c, r.kind))
    for k in range(1, 161):
        mark = lambda r, c: "S" if r + c == 0 else "G" if r + c == 2 * side - 2 else "#" if k * (r * 7 + c * 3 + 1) % 5 == 0 else "."
        assert sorted(walks.get(k, [])) == sorted(solvers.shortest_paths(["".join(mark(r, c) for c in range(side)) for r in range(side)]))
        board = ["???", "".join(str((k * (j + 2) + j) % 4) for j in range(3)), "???"]
        assert mines.get(k, set()) == {(*cell, kind) for kind in ("safe", "mine") for cell in solvers.forced_cells(board, kind)}


def test_maze_features_of_copies(spark, parts):
    """A maze's paths and features are those of its grid, whichever row has it."""
    found = {}
    for r in catalog.QUERIES["solver_maze"](spark, parts).collect():
        found.setdefault(r.puzzle_id, set()).add(tuple(r)[1:])
    for a, b in itertools.combinations(range(1, 31), 2):
        if a % 5 == b % 5:
            assert found.get(a) == found.get(b)
