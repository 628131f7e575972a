"""Solvers as table functions, and features of candidate answers by family."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.functions import solvers

from .lineage import fixed, spread

#: Rows of solutions that are sent to all executors, in place of a shuffle by what few puzzles there are.
FEW = 1 << 17
_CELLS = T.ArrayType(T.ArrayType(T.IntegerType()))
_STRINGS = T.ArrayType(T.StringType())


def solved_once(rows: DataFrame, key: str, puzzle: list[str], solve: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows beside what ``solve`` finds for their puzzle, a row for each solution; rows with the same puzzle share one solving.

    ``solve`` gets the different puzzles, spread over the tasks, and returns them with their solutions in rows.  These are
    a checkpoint, so nothing that follows is pushed down into the solver.  ``key`` spreads the rows, whatever their puzzles.
    """
    found = fixed(solve(spread(rows.select(*puzzle).distinct(), *puzzle)))
    found = found.withColumnsRenamed({p: f"_of_{p}" for p in puzzle})
    same = functools.reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"_of_{p}")) for p in puzzle])
    return spread(rows, key).join(F.broadcast(found) if found.count() <= FEW else found, same).drop(*[f"_of_{p}" for p in puzzle])


@F.pandas_udf(_STRINGS)
def arithmetic_solutions(numbers: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([solvers.arithmetic(tuple(int(x) for x in n), int(t)) for n, t in zip(numbers, target, strict=True)], dtype=object)


_CLASSES = T.ArrayType(T.StructType([T.StructField("expression", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("divisions", "awkward", "balanced", "inversions")]]))


@F.pandas_udf(_CLASSES)
def arithmetic_classes(numbers: pd.Series, target: pd.Series) -> pd.Series:
    """The canonical solutions of numbers in the order shown, each with its counts over all trees."""
    return pd.Series([[(form, *map(int, counts)) for form, counts in sorted(solvers.arithmetic_features(tuple(int(x) for x in n), int(t)).items())] for n, t in zip(numbers, target, strict=True)], dtype=object)


def arithmetic_features(rows: DataFrame) -> DataFrame:
    """(puzzle_id, expression, divisions, balanced, inversions) of puzzles (puzzle_id, numbers, target); divisions and inversions also scaled in their puzzle."""
    from .ordering import minmax_scaled

    found = rows.select("puzzle_id", F.explode(arithmetic_classes("numbers", "target")).alias("c")).select("puzzle_id", "c.expression", "c.divisions", "c.balanced", "c.inversions", "c.awkward")
    for name in ("divisions", "inversions"):
        found = minmax_scaled(found, name, ["puzzle_id"])
    return found


@F.pandas_udf(_STRINGS)
def maze_solutions(grid: pd.Series) -> pd.Series:
    return grid.map(lambda g: solvers.shortest_paths(list(g)))


@F.pandas_udf(_CELLS)
def mine_solutions(board: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([solvers.forced_cells(list(b), k) for b, k in zip(board, kind, strict=True)], dtype=object)


@F.pandas_udf(_CELLS)
def sudoku_solutions(board: pd.Series, digit: pd.Series, box_rows: pd.Series, box_columns: pd.Series) -> pd.Series:
    return pd.Series([solvers.sudoku_cells(list(b), int(d), int(r), int(c)) for b, d, r, c in zip(board, digit, box_rows, box_columns, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(_CELLS))
def rook_solutions(board: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([list(solvers.rooks(list(b), int(k))) for b, k in zip(board, m, strict=True)], dtype=object)


def maze_features(paths: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Turns, mean load of shared steps, and mean centred distance to the goal of each path (puzzle_id, moves, start_r, start_c, goal_r, goal_c), scaled in its puzzle."""
    from .ordering import minmax_scaled

    # One shuffle by the puzzle serves all that follows.
    paths = paths.repartition("puzzle_id")
    step = paths.select("puzzle_id", "moves", "goal_r", "goal_c", "start_r", "start_c", F.posexplode(F.regexp_extract_all("moves", F.lit("."), F.lit(0))).alias("k", "m"))
    along = Window.partitionBy("puzzle_id", "moves").orderBy("k")
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    step = step.withColumns(
        {
            "r": F.col("start_r") + F.sum(F.when(F.col("m") == "D", 1).when(F.col("m") == "U", -1).otherwise(0)).over(so_far),
            "c": F.col("start_c") + F.sum(F.when(F.col("m") == "R", 1).when(F.col("m") == "L", -1).otherwise(0)).over(so_far),
            "turn": F.coalesce((F.lag("m").over(along) != F.col("m")).cast("int"), F.lit(0)),
        }
    )
    # A step is an edge whichever way it is walked: its cell and whether it lies down or right of it.
    edge = F.struct(
        F.when(F.col("m") == "D", F.col("r") - 1).otherwise(F.col("r")).alias("r"),
        F.when(F.col("m") == "R", F.col("c") - 1).otherwise(F.col("c")).alias("c"),
        F.col("m").isin("U", "D").alias("upright"),
    )
    away = F.abs(F.col("r") - F.col("goal_r")) + F.abs(F.col("c") - F.col("goal_c"))
    step = step.withColumns({"edge": edge, "away": away})
    step = step.withColumn("load", F.count("*").over(Window.partitionBy("puzzle_id", "edge")) - 1)
    step = step.withColumn("centred", F.col("away") - F.avg("away").over(Window.partitionBy("puzzle_id", "k")))
    out = step.groupBy("puzzle_id", "moves").agg(F.sum("turn").cast("double").alias("turns"), F.avg("load").alias("shared"), F.avg("centred").alias("distance"))
    for name in ("turns", "shared", "distance"):
        out = minmax_scaled(out, name, ["puzzle_id"], tolerance)
    return out


def rook_features(placements: DataFrame) -> DataFrame:
    """Rarity of cells, disorder and direction changes of each placement (puzzle_id, placement_id, cells in the order of rows)."""
    cell = placements.select("puzzle_id", "placement_id", F.posexplode("cells").alias("k", "cell"))
    total = placements.groupBy("puzzle_id").agg(F.count("*").alias("total"))
    often = F.count("*").over(Window.partitionBy("puzzle_id", "cell"))
    rare = cell.withColumn("often", often).join(total, "puzzle_id").groupBy("puzzle_id", "placement_id").agg(F.avg(-F.log(F.col("often") / F.col("total"))).alias("rarity"))
    columns = F.transform("cells", lambda x: x[1])
    m = F.size("cells")
    crossed = F.aggregate(F.transform(columns, lambda x, k: F.size(F.filter(F.slice(columns, k + 2, m), lambda y: y < x))), F.lit(0), lambda a, x: a + x)
    signs = F.zip_with(F.slice(columns, 2, m), F.slice(columns, F.lit(1), m - 1), lambda b, a: F.signum(b - a))
    changes = F.size(F.filter(F.zip_with(F.slice(signs, 2, m), F.slice(signs, F.lit(1), F.greatest(m - 2, F.lit(0))), lambda b, a: b != a), lambda x: x))
    shapes = placements.select(
        "puzzle_id",
        "placement_id",
        F.try_divide(F.least(crossed, m * (m - 1) / 2 - crossed).cast("double"), m * (m - 1) / 2).alias("disorder"),
        F.when(m > 2, changes / (m - 2)).otherwise(0.0).alias("changes"),
    )
    return rare.join(shapes, ["puzzle_id", "placement_id"])


def sudoku_features(cells: DataFrame) -> DataFrame:
    """Of each legal cell (puzzle_id, r, c, box): digits possible there if given as ``options``, and the fewest legal cells of its row, column and box."""
    size = lambda *keys: F.count("*").over(Window.partitionBy("puzzle_id", *keys))
    return cells.withColumn("least_targets", F.least(size("r"), size("c"), size("box")))


@F.pandas_udf(T.StructType([T.StructField("clues", T.IntegerType()), T.StructField("scope", T.IntegerType())]))
def mine_certificate(board: pd.Series, r: pd.Series, c: pd.Series, kind: pd.Series) -> pd.DataFrame:
    """Fewest clues, and among those fewest unknown cells, from which a cell follows."""
    found = [solvers.clue_certificates(list(b), (int(x), int(y)), k) or (None, None) for b, x, y, k in zip(board, r, c, kind, strict=True)]
    return pd.DataFrame(found, columns=["clues", "scope"]).astype("Int32")


def diverse(rows: DataFrame, within: str, key: str, vector: str, k: int) -> DataFrame:
    """Greedy choice of k rows a group, each the farthest from those chosen, coordinates scaled to 0 to 1 in the group; adds place.

    ``key`` tells a group's rows apart; the least one comes first and wins ties.  A group of fewer rows is taken whole.  Each of the k
    rounds brings a group's last choice to its rows and takes the farthest row by an aggregate, so no group is seen whole.
    """
    x = F.col(vector).cast("array<double>")
    own = rows.select(F.to_json(F.struct(F.col(within).alias("g"))).alias("_g"), F.col(key).alias("_k"), x.alias("_x"))
    ends = own.select("_g", F.posexplode("_x").alias("i", "v")).groupBy("_g", "i").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    # A coordinate's ends in order; a vector has few.
    ends = ends.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("_ends"))
    scale = lambda v, e: F.when(e["high"] > e["low"], (v - e["low"]) / (e["high"] - e["low"])).otherwise(0.0)
    left = fixed(own.join(ends, "_g", "left").select("_g", "_k", F.zip_with("_x", "_ends", scale).alias("_x"), F.lit(float("inf")).alias("_gap")))
    chosen = None
    for place in range(1, k + 1):
        best = left.groupBy("_g").agg(F.min_by(F.struct("_k", "_x"), F.struct(-F.col("_gap"), F.col("_k").isNull(), "_k")).alias("_b"))
        best = fixed(best.select("_g", F.col("_b._k").alias("_c"), F.col("_b._x").alias("_y"), F.lit(place).alias("place")))
        chosen = best.drop("_y") if chosen is None else chosen.unionAll(best.drop("_y"))
        if place < k:
            apart = F.aggregate(F.zip_with("_x", "_y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)
            others = left.join(best, "_g").filter(~F.col("_k").eqNullSafe(F.col("_c")))
            left = fixed(others.select("_g", "_k", "_x", F.least("_gap", F.coalesce(apart, F.lit(0.0))).alias("_gap")))
    if chosen is None:
        return rows.limit(0).withColumn("place", F.lit(0))
    mine = F.to_json(F.struct(F.col(within).alias("g"))).eqNullSafe(F.col("_g")) & F.col(key).eqNullSafe(F.col("_c"))
    return rows.join(chosen, mine).drop("_g", "_c")


def legal_cells(boards: DataFrame, digit: str, box_rows: int, box_columns: int) -> DataFrame:
    """(puzzle_id, r, c, box), from 1, of the empty cells where a digit may go: its row, column and box don't have it yet.

    ``boards`` has puzzle_id and board (rows of characters).
    """
    rows = boards.select("puzzle_id", F.posexplode("board").alias("r", "row"))
    cells = rows.select("puzzle_id", "r", F.posexplode(F.regexp_extract_all("row", F.lit("."), F.lit(0))).alias("c", "x"), (F.length("row") / box_columns).cast("int").alias("across"))
    cells = cells.withColumn("box", F.floor(F.col("r") / box_rows) * F.col("across") + F.floor(F.col("c") / box_columns))
    there = lambda key: F.max(F.col("x") == digit).over(Window.partitionBy("puzzle_id", key))
    free = cells.withColumn("taken", there("r") | there("c") | there("box")).filter((F.col("x") == ".") & ~F.col("taken"))
    return free.select("puzzle_id", (F.col("r") + 1).alias("r"), (F.col("c") + 1).alias("c"), "box")


def mirrored(grid: str) -> Column:
    """Map of the reflections of a grid (rows of characters)."""
    rows = F.col(grid)
    flipped = F.transform(rows, lambda x: F.reverse(x))
    return F.create_map(F.lit("mirror_v"), F.reverse(rows), F.lit("mirror_h"), flipped, F.lit("mirror_hv"), F.reverse(flipped))


def symmetries(size: int) -> list[list[int]]:
    """The eight symmetries of a square as orders of its cells, row by row."""
    cells, out = [[r * size + c for c in range(size)] for r in range(size)], []
    for _ in range(2):
        for _ in range(4):
            out.append([x for row in cells for x in row])
            cells = [list(row) for row in zip(*cells[::-1], strict=True)]
        cells = [row[::-1] for row in cells]
    return out


def canonical_labels(grid: str, size: int) -> Column:
    """The least of all boards that renaming rows and columns, or swapping the two, makes of a square grid (rows of characters).

    For an order of the rows the least board has its columns sorted, so only row orders are tried: size! of them, for boards of a
    puzzle's size.  A board's columns are read once, each row order then only picks from them.
    """
    lines = range(size)
    orders = F.array(*[F.array(*map(F.lit, p)) for p in itertools.permutations(lines)])
    columns = lambda rows: F.array(*[F.concat(*[F.substring(rows[r], c + 1, 1) for r in lines]) for c in lines])
    picked = lambda p: lambda column: F.concat(*[F.substr(column, p[r] + 1, F.lit(1)) for r in lines])
    least = lambda turned: F.array_min(F.transform(F.transform(orders, lambda p: F.array_sort(F.transform(turned, picked(p)))), columns))
    # Rows are the columns of the swapped board.
    return F.array_min(F.transform(F.array(columns(F.col(grid)), F.col(grid)), least))


def board_classes(rows: DataFrame, group: str, key: str, grid: str, size: int) -> DataFrame:
    """(g, k, board, least): each grid's board, the least of its symmetric forms, and the least key of the group that has it."""
    flat = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.array_join(grid, "").alias("s"))
    grids = _boards(flat, size, F.min("k").alias("_k")).withColumn("least", F.min("_k").over(Window.partitionBy("g", "board")))
    known = fixed(grids.select(F.col("g").alias("_g"), F.col("s").alias("_s"), "board", "least"))
    own = spread(flat, "k").join(F.broadcast(known) if known.count() <= FEW else known, F.col("g").eqNullSafe(F.col("_g")) & F.col("s").eqNullSafe(F.col("_s")))
    return own.select("g", "k", "board", "least")


def _boards(flat: DataFrame, size: int, *summary: Column) -> DataFrame:
    """(g, s, board) of the different grids of each group, with a summary of their rows: grids are turned once, not row by row."""
    return flat.groupBy("g", "s").agg(*summary).withColumn("board", F.array_min(_turned("s", size)))


def near_grids(rows: DataFrame, group: str, key: str, grid: str, size: int, most: int) -> DataFrame:
    """(a, b, hamming, pairs), a < b: different boards of a group that differ in 1 to ``most`` cells under a symmetry of the square.

    Boards stand for all grids that have them: a and b are their least keys, ``pairs`` says how many pairs of grids
    that makes; which grid has which board, :func:`board_classes` says.  Of ``most + 1`` bands of cells one must
    agree, and group, band and content are the join's key.
    """
    flat = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.array_join(grid, "").alias("s"))
    boards = _boards(flat, size, F.min("k").alias("k"), F.count("*").alias("n")).groupBy("g", F.col("board").alias("s")).agg(F.min("k").alias("k"), F.sum("n").alias("n"))
    boards = fixed(boards)
    n = size * size
    cuts = [n * b // (most + 1) for b in range(most + 2)]
    bands = lambda s: F.array(*[F.struct(F.lit(b).alias("band"), F.substring(s, cuts[b] + 1, cuts[b + 1] - cuts[b]).alias("part")) for b in range(most + 1)])
    one = boards.select("g", F.col("k").alias("a"), F.col("n").alias("na"), F.col("s").alias("x"), F.explode(bands(F.col("s"))).alias("by"))
    two = boards.select("g", F.col("k").alias("b"), F.col("n").alias("nb"), F.explode(F.array_distinct(_turned("s", size))).alias("y")).select("g", "b", "nb", "y", F.explode(bands(F.col("y"))).alias("by"))
    differing = sum((F.substring("x", k + 1, 1) != F.substring("y", k + 1, 1)).cast("int") for k in range(n))
    met = one.join(two, ["g", "by"]).filter((F.col("a") < F.col("b")) & (differing <= most))
    return met.groupBy("a", "b").agg(F.min(differing).alias("hamming"), F.max(F.col("na") * F.col("nb")).alias("pairs"))


def near_members(rows: DataFrame, group: str, key: str, grid: str, size: int, most: int) -> DataFrame:
    """(k, least, other, hamming, grids): for each grid the boards of its group that differ from its own in ``most`` cells at most, its own included.

    ``least`` and ``other`` are the least keys of the two boards, ``grids`` says how many grids have the other one, itself left
    out: no two grids are paired row by row, and none of their links is lost.
    """
    own = fixed(board_classes(rows, group, key, grid, size).select("k", "least"))
    sizes = own.groupBy(F.col("least").alias("other")).agg(F.count("*").alias("n"))
    pairs = near_grids(rows, group, key, grid, size, most).select("a", "b", "hamming")
    turned = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "hamming")
    same = sizes.select(F.col("other").alias("a"), F.col("other").alias("b"), F.lit(0).alias("hamming"))
    links = pairs.unionAll(turned).unionAll(same).toDF("least", "other", "hamming").join(sizes, "other")
    links = fixed(links.withColumn("grids", F.col("n") - (F.col("least") == F.col("other")).cast("long")).filter("grids > 0"))
    return own.join(F.broadcast(links) if links.count() <= FEW else links, "least").select("k", "least", "other", "hamming", "grids")


def _turned(s: str, size: int) -> Column:
    """The symmetric forms of a square written row by row."""
    return F.array(*[F.concat(*[F.substring(s, x + 1, 1) for x in order]) for order in symmetries(size)])


def shuffled_lines(size: int, band: int, *seed: Column) -> Column:
    """The lines 0 to size - 1 in a seeded order that keeps bands of lines together: bands by the rank of their hash, lines by theirs within."""
    hashed = lambda kind, k: F.sha2(F.concat_ws(":", *seed, F.lit(kind), k.cast("string")), 256)
    ranked = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.struct(hashed("band", F.floor(k / band).cast("int")).alias("b"), hashed("line", k).alias("l"), k.alias("k")))
    return F.transform(F.array_sort(ranked), lambda x: x["k"])


def permuted_squares(rows: DataFrame, key: str, grids: list[str], box: tuple[int, int], seed: int) -> DataFrame:
    """The grids of each row (a board and its solutions, say) with rows, columns and digits renamed alike.

    Bands and rows within them, stacks and columns within them, and digits are permuted by ranks of hashes of seed and key, so
    that a valid solution stays one.  Adds row_order, column_order (old lines in their new order) and digits (old digits in the order of the new ones).
    """
    size = box[0] * box[1]
    of = lambda kind: (F.lit(str(seed)), F.col(key).cast("string"), F.lit(kind))
    names = "".join(str(d + 1) for d in range(size))
    rows = rows.withColumns({"row_order": shuffled_lines(size, box[0], *of("row")), "column_order": shuffled_lines(size, box[1], *of("column")), "_d": shuffled_lines(size, 1, *of("digit"))})
    rows = rows.withColumn("digits", F.array_join(F.transform("_d", lambda d: (d + 1).cast("string")), "")).drop("_d")
    for g in grids:
        rows = rows.withColumn("_moved", _moved(g)).withColumn(g, F.transform("_moved", lambda x: F.call_function("translate", x, F.col("digits"), F.lit(names)))).drop("_moved")
    return rows


def _moved(grid: str) -> Column:
    """The grid with its lines in the orders of row_order and column_order."""
    cells = lambda row: F.transform("column_order", lambda c: F.substr(row, c + 1, F.lit(1)))
    return F.transform("row_order", lambda r: F.array_join(cells(F.element_at(grid, r + 1)), ""))


def square_holds(grid: str, box: tuple[int, int]) -> Column:
    """Whether each row, column and box of a full square has each digit once."""
    size = box[0] * box[1]
    at = lambda r, c: F.substring(F.element_at(grid, r + 1), c + 1, 1)
    lines = [[(r, c) for c in range(size)] for r in range(size)] + [[(r, c) for r in range(size)] for c in range(size)]
    lines += [[(r0 + r, c0 + c) for r in range(box[0]) for c in range(box[1])] for r0 in range(0, size, box[0]) for c0 in range(0, size, box[1])]
    return functools.reduce(lambda x, y: x & y, [F.size(F.array_distinct(F.array(*[at(r, c) for r, c in own]))) == size for own in lines])
