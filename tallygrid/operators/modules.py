"""Cue, pair and formulation modules: sources of a pool are chosen by family, freed of those used already, and dealt to arms by seeded ranks.

A pool has puzzle_id and family, and what a module shows.  All seeded orders are ranks of hashes of seed, puzzle and what is
ranked, so they are the same whatever the partitions.  Families without sources give no trials.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .puzzles import mirrored


def fresh(pool: DataFrame, used: DataFrame, board: str) -> DataFrame:
    """The pool's rows whose board no row of ``used`` has; a null board is never used already."""
    return pool.join(used.select(board).distinct(), board, "left_anti")


def first_of_families(pool: DataFrame, order: list[Column | str], count: int) -> DataFrame:
    """The first ``count`` sources of each family in an order, with their place from 1; ties go by puzzle_id."""
    place = F.row_number().over(Window.partitionBy("family").orderBy(*order, "puzzle_id"))
    return pool.withColumn("place", place).filter(F.col("place") <= count)


def shuffled(items: str | Column, text: Callable[[Column], Column], *seed: Column) -> Column:
    """The items in the order of the hashes of seed and text; equal items stay together."""
    keyed = F.transform(items, lambda x: F.struct(F.sha2(F.concat_ws(":", *seed, text(x)), 256).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def cell_text(cell: Column) -> Column:
    return F.concat_ws(",", F.transform(cell, lambda x: x.cast("string")))


def cue_module(pool: DataFrame, order: list[Column | str], count: int, seed: int, least: int = 4, most: int = 8) -> DataFrame:
    """Trials of a baseline and two cues, each of which shows one half of the valid cells among as many invalid ones.

    ``pool`` also has ``cells`` (valid) and ``decoys`` (invalid), both arrays of cells.  Sources need ``least`` to ``most``
    valid cells and at least as many invalid ones.  The first half has the odd cell; no cell is shown by both cues.
    """
    fit = pool.filter(F.size("cells").between(least, most) & (F.size("decoys") >= F.size("cells")))
    n, half = F.size("cells"), F.ceil(F.size("cells") / 2).cast("int")
    of = lambda c: shuffled(c, cell_text, F.lit(str(seed)), F.lit(c), F.col("puzzle_id").cast("string"))
    dealt = first_of_families(fit, order, count).withColumns({"cells": of("cells"), "decoys": of("decoys")})
    none = F.slice("cells", 1, 0)
    arm = lambda condition, valid, invalid: F.struct(F.lit(condition).alias("condition"), F.array_sort(valid).alias("valid"), F.array_sort(invalid).alias("invalid"))
    arms = F.array(
        arm("baseline", none, none),
        arm("half_a", F.slice("cells", F.lit(1), half), F.slice("decoys", F.lit(1), half)),
        arm("half_b", F.slice("cells", half + 1, n), F.slice("decoys", half + 1, n - half)),
    )
    rows = dealt.select("family", "puzzle_id", F.explode(arms).alias("a")).select("family", "puzzle_id", "a.*")
    return _named("cue", rows.withColumn("role", F.when(F.col("condition") == "baseline", "original").otherwise("variant")), "puzzle_id", "valid", "invalid")


def pair_module(pool: DataFrame, order: list[Column | str], count: int, seed: int) -> DataFrame:
    """Trials of a board after its source (related), after another puzzle (unrelated) and alone.

    ``pool`` also has ``board`` (rows of characters).  The second board of a pair is its source's reflection, the kinds in turns.
    The unrelated puzzle is of the same family, not itself chosen, and taken by seeded rank, each before any comes twice;
    a family without one gives no pairs.
    """
    placed = pool.withColumn("place", F.row_number().over(Window.partitionBy("family").orderBy(*order, "puzzle_id")))
    kinds = F.array(*map(F.lit, ("mirror_h", "mirror_v", "mirror_hv")))
    how = F.element_at(kinds, ((F.col("place") - 1) % 3 + 1).cast("int"))
    chosen = placed.filter(F.col("place") <= count).withColumn("how", how).withColumn("second", mirrored("board")[F.col("how")])
    tie = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("puzzle_id").cast("string")), 256)
    turn = Window.partitionBy("family").orderBy("tie", "puzzle_id")
    others = placed.filter(F.col("place") > count).withColumn("tie", tie).withColumn("k", F.row_number().over(turn) - 1).filter(F.col("k") < count)
    spare = others.groupBy("family").agg(F.count("*").alias("n"))
    others = others.select("family", "k", F.col("puzzle_id").alias("control_id"), F.col("board").alias("control"))
    pairs = chosen.join(spare, "family").withColumn("k", ((F.col("place") - 1) % F.col("n")).cast("int")).join(others, ["family", "k"])
    trial = lambda condition, role, position, shown, board: F.struct(F.lit(condition).alias("condition"), F.lit(role).alias("role"), F.lit(position).alias("position"), F.col(shown).alias("shown"), F.col(board).alias("board"))
    trials = F.array(
        trial("alone", "second", 1, "puzzle_id", "second"),
        trial("related", "first", 1, "puzzle_id", "board"),
        trial("related", "second", 2, "puzzle_id", "second"),
        trial("unrelated", "first", 1, "control_id", "control"),
        trial("unrelated", "second", 2, "puzzle_id", "second"),
    )
    rows = pairs.select("family", "puzzle_id", "how", F.explode(trials).alias("t")).select("family", "puzzle_id", "how", "t.*")
    return _named("pair", rows, "puzzle_id", "position", "shown", "how", "board")


def reflected_cell(cell: Column, how: Column, size: int) -> Column:
    """Where a cell (row, column, from 1) of a square lies after a reflection: the map of a pair's answers."""
    far = F.lit(size + 1)
    r = F.when(how.isin("mirror_v", "mirror_hv"), far - cell[0]).otherwise(cell[0])
    return F.array(r, F.when(how.isin("mirror_h", "mirror_hv"), far - cell[1]).otherwise(cell[1]))


def formulation_module(pool: DataFrame, order: list[Column | str], count: int, seed: int, least: int = 3, most: int = 8) -> DataFrame:
    """Trials of the same numbers in ascending and in a seeded other order.

    ``pool`` also has ``numbers`` and ``n_solutions``.  Where the seeded order is the ascending one it is turned by one place;
    sources whose numbers are all equal, or null, have no other order and aren't chosen.
    """
    fit = pool.filter(F.col("n_solutions").between(least, most) & (F.size(F.array_distinct("numbers")) > 1))
    chosen = first_of_families(fit, order, count).withColumn("numbers", F.array_sort("numbers"))
    # Places are ranked, not numbers, so that equal numbers may come apart.
    n = F.size("numbers")
    places = shuffled(F.sequence(F.lit(1), n), lambda k: k.cast("string"), F.lit(str(seed)), F.col("puzzle_id").cast("string"))
    chosen = chosen.withColumn("other", F.transform(places, lambda k: F.element_at("numbers", k)))
    turned = F.concat(F.slice("numbers", F.lit(2), n - 1), F.slice("numbers", 1, 1))
    chosen = chosen.withColumn("other", F.when(F.col("other") == F.col("numbers"), turned).otherwise(F.col("other")))
    arm = lambda condition, role, shown: F.struct(F.lit(condition).alias("condition"), F.lit(role).alias("role"), F.col(shown).alias("numbers"))
    rows = chosen.select("family", "puzzle_id", F.explode(F.array(arm("ascending", "original", "numbers"), arm("shuffled", "variant", "other"))).alias("a"))
    return _named("formulation", rows.select("family", "puzzle_id", "a.*"), "puzzle_id", "numbers")


def _named(module: str, rows: DataFrame, *more: str) -> DataFrame:
    """Trials (module, family, block, trial, condition, role) and what they show; a block is one source."""
    block = F.concat_ws("_", F.lit(module), F.col("puzzle_id").cast("string"))
    trial = F.concat_ws("/", block, "condition", *(["role"] if module == "pair" else []))
    return rows.select(F.lit(module).alias("module"), "family", block.alias("block"), trial.alias("trial"), "condition", "role", *more)
