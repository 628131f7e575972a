"""Pools of mazes, digit boards and mine boards, and the pressure and difficulty scores of their puzzles, as columns of each board's own row.

Boards are arrays of rows of characters.  Nothing here meets another row but the removal of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import spread

#: Pressure of few solutions (up to 3, up to 6, more).
FEW = (18.0, 9.0, 2.0)
#: Terms (feature, low, high, weight) of a maze's pressure.
MAZE_TERMS = (("shortest", 7, 22, 35.0), ("branches", 2, 18, 25.0), ("dead_ends", 0, 12, 15.0), ("density", 0.15, 0.38, 10.0))
#: Where the difficulty of digit and mine boards becomes medium and hard.
CUTS = (30.0, 55.0)


def scaled(value: Column, low: float, high: float, weight: float) -> Column:
    """A weight's share: 0 below low, all of it above high."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low))) * weight


def few_solutions(n: Column) -> Column:
    return F.when(n <= 3, FEW[0]).when(n <= 6, FEW[1]).otherwise(FEW[2])


def level(difficulty: Column) -> Column:
    return F.when(difficulty < CUTS[0], "easy").when(difficulty < CUTS[1], "medium").otherwise("hard")


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once a row: a generator's output, which later filters and columns don't copy the expression of."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def without_copies(rows: DataFrame, key: Column) -> DataFrame:
    """The row of least puzzle_id of each key.

    Rows are spread over all tasks by the key, since what follows costs much a row.
    """
    dealt = spread(rows.withColumn("_key", key), "_key")
    first = F.row_number().over(Window.partitionBy("_key").orderBy("puzzle_id"))
    return dealt.withColumn("_r", first).filter("_r = 1").drop("_r", "_key")


def characters(board: str) -> Column:
    """A board's cells, row by row."""
    return F.split(F.array_join(board, ""), "")


def floods(cells: str, size: int) -> Column:
    """(d, w, open) of each cell of a square maze: steps from S, null where there is no way, how many shortest ways there are, and whether it is no wall.

    A frontier is carried over the board: a cell is reached one step after its first neighbour, by the sum of that step's ways.
    A maze has at most one S.
    """
    n = size * size
    start = F.transform(cells, lambda x: F.struct(F.when(x == "S", 0).cast("int").alias("d"), F.when(x == "S", 1).otherwise(0).cast("long").alias("w"), (x != "#").alias("open")))
    near = F.array(*[F.array(*map(F.lit, _beside(c, size))) for c in range(n)])
    none = F.lit(0).cast("long")

    def step(found: Column, number: Column) -> Column:
        def one(own: Column, k: Column) -> Column:
            ways = F.aggregate(F.element_at(near, k + 1), none, lambda s, j: s + F.when(F.element_at(found, j + 1)["d"] == number - 1, F.element_at(found, j + 1)["w"]).otherwise(none))
            # A cell that has no steps has no ways yet.
            return F.when(own["d"].isNotNull() | ~own["open"], own).otherwise(F.struct(F.when(ways > 0, number).alias("d"), ways.alias("w"), own["open"].alias("open")))

        return F.when(F.exists(found, lambda x: x["d"] == number - 1), F.transform(found, one)).otherwise(found)

    return F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), start, step)


def maze_pool(rows: DataFrame, size: int, shortest: tuple[int, int], solutions: tuple[int, int] = (3, 8), density: float = 0.2) -> DataFrame:
    """(puzzle_id, board, shortest, n_solutions, detour, dead_ends, branches, density, pressure) of mazes (puzzle_id, board) whose goal is reached in a fit length and number of ways.

    Dead ends are reached cells with one neighbour other than S and G, branches those with three or more.  Of mazes with
    the same board the least id stays; a maze without S or G, or with no way, goes.
    """
    n = size * size
    flat = F.array_join("board", "")
    dense = rows.select("puzzle_id", "board").filter((F.length(F.regexp_replace(flat, "[^#]", "")) / n >= density) & flat.contains("S") & flat.contains("G"))
    # Copies go before the flood, which is the costly part.
    found = once(without_copies(dense, flat), "_x", characters("board"))
    found = once(found, "_f", floods("_x", size))
    at = lambda x: F.array_position("_x", x).cast("int") - 1
    found = once(found, "_g", F.struct(at("S").alias("s"), at("G").alias("g"), F.element_at("_f", at("G") + 1).alias("end")))
    found = found.withColumns({"shortest": F.col("_g.end.d"), "n_solutions": F.col("_g.end.w")}).filter(F.col("shortest").between(*shortest) & F.col("n_solutions").between(*solutions))
    near = F.array(*[F.array(*map(F.lit, _beside(c, size))) for c in range(n)])
    degree = lambda k: F.size(F.filter(F.element_at(near, k + 1), lambda j: F.element_at("_f", j + 1)["open"]))
    reached = F.filter(F.transform("_f", lambda x, k: F.struct(x["d"].isNotNull().alias("there"), degree(k).alias("degree"), k.isin(F.col("_g.s"), F.col("_g.g")).alias("end"))), lambda x: x["there"])
    found = once(found, "_c", reached)
    s, g = F.col("_g.s"), F.col("_g.g")
    found = found.withColumns(
        {
            "dead_ends": F.size(F.filter("_c", lambda x: (x["degree"] == 1) & ~x["end"])),
            "branches": F.size(F.filter("_c", lambda x: x["degree"] >= 3)),
            "detour": (F.col("shortest") - F.abs(F.floor(s / size) - F.floor(g / size)) - F.abs(s % size - g % size)).cast("int"),
            "density": F.size(F.filter("_x", lambda x: x == "#")) / n,
        }
    )
    pressure = sum((scaled(F.col(c), low, high, weight) for c, low, high, weight in MAZE_TERMS), few_solutions(F.col("n_solutions")))
    return found.select("puzzle_id", "board", "shortest", "n_solutions", "detour", "dead_ends", "branches", "density", F.least(F.lit(100.0), pressure).alias("pressure"))


def empty_cells(cells: str, digit: str, box: tuple[int, int]) -> Column:
    """(cell, taken, visible) of each empty cell of a square board, by rows.

    ``cell`` is ``[row, column]`` from 1, ``taken`` says that its row, column or box has the digit, ``visible`` how many clues they have.
    """
    size = box[0] * box[1]
    peers = F.array(*[F.array(*map(F.lit, _peers(k, box))) for k in range(size * size)])
    clue = lambda j: F.element_at(cells, j + 1)

    def state(x: Column, k: Column) -> Column:
        own = F.element_at(peers, k + 1)
        place = F.array(F.floor(k / size).cast("int") + 1, k % size + 1)
        return F.struct(place.alias("cell"), F.exists(own, lambda j: clue(j) == digit).alias("taken"), F.size(F.filter(own, lambda j: clue(j) != ".")).alias("visible"), (x == ".").alias("empty"))

    return F.filter(F.transform(cells, state), lambda x: x["empty"])


def square_targets(rows: DataFrame, digit: str, box: tuple[int, int]) -> DataFrame:
    """(puzzle_id, r, c, box, options) of the cells of boards (puzzle_id, board) where a digit may go, ``options`` being how many digits may go there."""
    size = box[0] * box[1]
    digits = F.array(*[F.lit(str(d + 1)) for d in range(size)])
    peers = F.array(*[F.array(*map(F.lit, _peers(k, box))) for k in range(size * size)])
    found = once(rows.select("puzzle_id", "board"), "_x", characters("board"))
    free = F.filter(empty_cells("_x", digit, box), lambda x: ~x["taken"])
    found = found.select("puzzle_id", "_x", F.explode(F.transform(free, lambda x: x["cell"])).alias("_cell"))
    r, c = F.col("_cell")[0], F.col("_cell")[1]
    seen = F.transform(F.element_at(peers, (r - 1) * size + c), lambda j: F.element_at("_x", j + 1))
    number = F.floor((r - 1) / box[0]) * (size // box[1]) + F.floor((c - 1) / box[1])
    return found.select("puzzle_id", r.alias("r"), c.alias("c"), number.alias("box"), F.size(F.array_except(digits, seen)).alias("options"))


def square_pool(rows: DataFrame, digit: str, box: tuple[int, int], solutions: tuple[int, int] = (3, 8)) -> DataFrame:
    """Adds cells, decoys, n_solutions, n_empty, least_visible, most_visible, pressure, difficulty and level to boards (puzzle_id, board, more) with a fit number of cells for a digit.

    A cell is visible by the clues in its row, column and box.  ``decoys`` are the other empty cells.  Of equal boards the least id stays.
    """
    size = box[0] * box[1]
    found = once(without_copies(rows, F.array_join("board", "/")), "_x", characters("board"))
    found = once(found, "_e", empty_cells("_x", digit, box))
    free = F.filter("_e", lambda x: ~x["taken"])
    found = once(found, "_free", free).filter(F.size("_free").between(*solutions))
    visible = F.col("_free.visible")
    found = found.withColumns(
        {
            "cells": F.col("_free.cell"),
            "decoys": F.transform(F.filter("_e", lambda x: x["taken"]), lambda x: x["cell"]),
            "n_solutions": F.size("_free"),
            "n_empty": F.size("_e"),
            "least_visible": F.array_min(visible),
            "most_visible": F.array_max(visible),
        }
    ).drop("_x", "_e", "_free")
    pressure = F.lit({4: 10.0, 6: 28.0}.get(size, 20.0)) + scaled(F.col("n_empty"), 8, 28, 28.0) + F.when(F.col("most_visible") <= 3, 18.0).otherwise(0.0) + few_solutions(F.col("n_solutions"))
    hard = F.lit(10.0 + 4.0 * max(0, size - 4)) + 1.2 * F.col("n_empty") - 4.0 * F.col("most_visible") - 1.2 * F.greatest(F.lit(0), F.col("n_solutions") - 2)
    found = found.withColumns({"pressure": F.least(F.lit(100.0), pressure), "difficulty": F.greatest(F.lit(0.0), F.least(F.lit(100.0), hard))})
    return found.withColumn("level", level(F.col("difficulty")))


def assignments(unknown: Column, clues: Column) -> Column:
    """All sets of mines, as bits of cells, that agree with the clues.

    ``unknown`` are the open cells in order, ``clues`` (mask, n): the unknown cells about a clue and how many are mines.
    Cells are decided one by one, and a set is dropped as soon as a clue has too many mines, or too few cells left.
    """
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    count = lambda mask: F.bit_count(mask).cast("int")

    def decide(sets: Column, k: Column) -> Column:
        below = bit(k + 1) - 1
        holds = lambda s: F.forall(clues, lambda c: count(s.bitwiseAND(c["mask"])).between(c["n"] - count(c["mask"].bitwiseAND(F.bitwise_not(below))), c["n"]))
        return F.filter(F.concat(sets, F.transform(sets, lambda s: s.bitwiseOR(bit(k)))), holds)

    return F.aggregate(unknown, F.array(F.lit(0).cast("long")), decide)


def mine_pool(rows: DataFrame, shape: tuple[int, int], solutions: tuple[int, int] = (3, 8), most_unknown: int = 18) -> DataFrame:
    """Adds cells, n_unknown, n_assignments, n_solutions, most_clues, pressure, difficulty and level to boards (puzzle_id, board, kind, more) with a fit number of forced cells.

    ``?`` is an unknown cell and a digit a clue.  ``cells`` are those that are of the ``kind`` (safe or mine) in every set of mines that the
    clues allow; boards that allow none, or have more unknown cells than ``most_unknown``, and rows of another kind go.  Of equal boards of a kind the least id stays.
    """
    n = shape[0] * shape[1]
    near = F.array(*[F.array(*map(F.lit, _about(k, shape))) for k in range(n)])
    about = lambda k: F.element_at(near, k + 1)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    bits = lambda ks: F.aggregate(ks, F.lit(0).cast("long"), lambda s, k: s.bitwiseOR(bit(k)))
    rows = rows.filter(F.col("kind").isin("safe", "mine"))
    found = once(without_copies(rows, F.concat_ws("/", "kind", F.array_join("board", "/"))), "_x", characters("board"))
    char = lambda k: F.element_at("_x", k + 1)
    places = F.array(*map(F.lit, range(n)))
    found = once(found, "_u", F.filter(places, lambda k: char(k) == "?")).filter(F.size("_u").between(1, most_unknown))
    clue = F.filter(places, lambda k: char(k).rlike("[0-9]"))
    found = once(found, "_c", F.transform(clue, lambda k: F.struct(bits(F.filter(about(k), lambda j: char(j) == "?")).alias("mask"), char(k).cast("int").alias("n"))))
    found = once(found, "_s", assignments(F.col("_u"), F.col("_c"))).filter(F.size("_s") > 0)
    every = F.aggregate("_s", F.lit(-1).cast("long"), lambda a, s: a.bitwiseAND(s))
    some = F.aggregate("_s", F.lit(0).cast("long"), lambda a, s: a.bitwiseOR(s))
    found = once(found, "_f", F.when(F.col("kind") == "mine", every).otherwise(F.bitwise_not(some)))
    found = once(found, "_k", F.filter("_u", lambda k: F.col("_f").bitwiseAND(bit(k)) != 0)).filter(F.size("_k").between(*solutions))
    clues = lambda k: F.size(F.filter(about(k), lambda j: char(j).rlike("[0-9]")))
    found = found.withColumns(
        {
            "cells": F.transform("_k", lambda k: F.array(F.floor(k / shape[1]).cast("int") + 1, k % shape[1] + 1)),
            "n_unknown": F.size("_u"),
            "n_assignments": F.size("_s"),
            "n_solutions": F.size("_k"),
            "most_clues": F.array_max(F.transform("_k", clues)),
        }
    ).drop("_x", "_u", "_c", "_s", "_f", "_k")
    spread_of = F.log2("n_assignments")
    pressure = scaled(F.col("n_unknown"), 6, 16, 28.0) + scaled(spread_of, 0, 6, 28.0) + F.when(F.col("most_clues") <= 1, 18.0).otherwise(0.0) + few_solutions(F.col("n_solutions"))
    hard = 12.0 + 2.2 * F.col("n_unknown") + 8.0 * spread_of - 5.0 * F.col("most_clues") - 1.5 * F.greatest(F.lit(0), F.col("n_solutions") - 2)
    found = found.withColumns({"pressure": F.least(F.lit(100.0), pressure), "difficulty": F.greatest(F.lit(0.0), F.least(F.lit(100.0), hard))})
    return found.withColumn("level", level(F.col("difficulty")))


def ranked_simplicity(solutions: DataFrame, score: str, ties: list[str]) -> DataFrame:
    """Adds rank, percentile (0 for a lone solution) and bucket of each solution in its puzzle: the first is simplest, then simple, middle, complex by thirds."""
    w = Window.partitionBy("puzzle_id")
    total = F.count("*").over(w)
    rows = solutions.withColumns({"rank": F.row_number().over(w.orderBy(score, *ties)), "_n": total})
    rank, n = F.col("rank"), F.col("_n")
    bucket = F.when(rank == 1, "simplest").when(rank <= F.greatest(F.lit(2), F.ceil(n / 3)), "simple").when(rank >= F.greatest(F.lit(1), n - F.floor(n / 3) + 1), "complex").otherwise("middle")
    return rows.withColumns({"percentile": (rank - 1) / F.greatest(F.lit(1), n - 1), "bucket": bucket}).drop("_n")


def _beside(cell: int, size: int) -> list[int]:
    """The cells above, below, left and right of a cell of a square."""
    r, c = divmod(cell, size)
    return [x * size + y for x, y in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)) if 0 <= x < size and 0 <= y < size]


def _peers(cell: int, box: tuple[int, int]) -> list[int]:
    """The other cells of a cell's row, column and box."""
    size = box[0] * box[1]
    r, c = divmod(cell, size)
    alike = lambda x, y: x == r or y == c or (x // box[0], y // box[1]) == (r // box[0], c // box[1])
    return [x * size + y for x in range(size) for y in range(size) if (x, y) != (r, c) and alike(x, y)]


def _about(cell: int, shape: tuple[int, int]) -> list[int]:
    """The up to eight cells around a cell."""
    r, c = divmod(cell, shape[1])
    return [x * shape[1] + y for x in range(max(0, r - 1), min(shape[0], r + 2)) for y in range(max(0, c - 1), min(shape[1], c + 2)) if (x, y) != (r, c)]
