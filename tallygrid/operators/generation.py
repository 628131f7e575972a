"""Generation of puzzle pools, probe scores and study modules, as tables: made from seeds, filtered, bucketed and paired by columns and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import fixed
from .ordering import minmax_scaled, numbered, pruned, thirds
from .puzzles import mirrored, rook_solutions, symmetries


def unit_of(*parts: Column) -> Column:
    """A number in [0, 1) made of a 64-bit hash of the parts: the same for the same seed, whatever the partitions."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def boards(spark: SparkSession, n: int, size: int, blocked: float, seed: int) -> DataFrame:
    """(puzzle_id, board): n square boards on which each cell is blocked (X) with a probability."""
    cell = lambda r, c: F.when(unit_of(F.lit(seed), F.col("id"), F.lit(r), F.lit(c)) < blocked, "X").otherwise(".")
    board = F.array(*[F.concat(*[cell(r, c) for c in range(size)]) for r in range(size)])
    return spark.range(n).select(F.concat(F.lit(f"rooks_{seed}_"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("puzzle_id"), board.alias("board"))


def canonical_board(board: str, size: int) -> Column:
    """The least of a square board's eight rotations and reflections, as one string."""
    flat = F.array_join(board, "")
    return F.array_min(F.array(*[F.concat(*[F.substring(flat, x + 1, 1) for x in order]) for order in symmetries(size)]))


def rook_pool(rows: DataFrame, size: int, m: int, least: int = 3, most: int = 8, per_bucket: int = 20) -> DataFrame:
    """(puzzle_id, board, n_solutions, blocked, score, difficulty): boards (puzzle_id, board) with a fit number of solutions.

    Of boards alike under a symmetry the one of the least id stays.  ``score`` weighs few solutions and many blocked
    cells, scaled in the pool; its tertiles are the difficulty, and each difficulty keeps its best ``per_bucket``.
    """
    solved = rows.select("puzzle_id", "board", F.size(rook_solutions("board", F.lit(m))).alias("n_solutions")).filter(F.col("n_solutions").between(least, most))
    solved = solved.withColumns({"canonical": canonical_board("board", size), "blocked": F.length(F.regexp_replace(F.array_join("board", ""), "[^X]", ""))})
    first = Window.partitionBy("canonical").orderBy("puzzle_id")
    # Two passes follow over what has been solved: the pool's bounds, four numbers and a count, and its order.
    unique = fixed(solved.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r"))
    columns = ("n_solutions", "blocked")
    bounds = unique.agg(F.count("*").alias("n"), *[f(c).alias(f"{c}_{name}") for c in columns for name, f in (("low", F.min), ("high", F.max))]).first()
    width = {c: (bounds[f"{c}_high"] or 0) - (bounds[f"{c}_low"] or 0) for c in columns}
    scaled = lambda c: (F.col(c) - bounds[f"{c}_low"]) / width[c] if width[c] else F.lit(0.0)
    scored = numbered(unique.withColumn("score", scaled("blocked") - scaled("n_solutions")), ["score", "puzzle_id"], "_place")
    bucketed = scored.withColumn("difficulty", thirds(F.col("_place"), bounds["n"]))
    return pruned(bucketed, "canonical", "difficulty", "score", ["puzzle_id"], per_bucket).select("puzzle_id", "board", "n_solutions", "blocked", "score", "difficulty")


def probe_scores(rows: DataFrame, within: list[str], weights: dict[str, float], name: str, names: tuple[str, ...] = ("low", "medium", "high")) -> DataFrame:
    """Adds a probe: the weighted mean of features scaled in their group, and its bucket by equal thirds of the scale."""
    for feature in weights:
        rows = minmax_scaled(rows, feature, within)
    total = sum(abs(w) for w in weights.values())
    score = sum((F.lit(w / total) * (F.col(f"{f}_scaled") if w >= 0 else F.col(f"{f}_scaled") - 1) for f, w in weights.items()), F.lit(0.0))
    place = F.least(F.lit(len(names) - 1), F.floor(score * len(names))).cast("int")
    return rows.withColumn(name, score).withColumn(f"{name}_bucket", F.element_at(F.array(*map(F.lit, names)), place + 1)).drop(*[f"{f}_scaled" for f in weights])


def spatial_module(pool: DataFrame) -> DataFrame:
    """Trials (module, block, trial, condition, role, board): each puzzle and its three reflections are a block."""
    original = pool.select("puzzle_id", F.lit("original").alias("condition"), F.lit("original").alias("role"), "board")
    turned = pool.select("puzzle_id", F.explode(mirrored("board")).alias("condition", "board")).select("puzzle_id", "condition", F.lit("variant").alias("role"), "board")
    return _trials("spatial", original.unionAll(turned))


def transfer_module(pool: DataFrame, related: str, order: list[str]) -> DataFrame:
    """Trials of a prime and a target: puzzles of one ``related`` value are paired in their order, an odd one out stays unused."""
    w = Window.partitionBy(related).orderBy(*order)
    placed = pool.withColumn("_k", F.row_number().over(w) - 1).withColumn("_b", F.floor(F.col("_k") / 2))
    prime, target = placed.filter("_k % 2 = 0"), placed.filter("_k % 2 = 1")
    pairs = prime.select(related, "_b", F.col("puzzle_id").alias("prime"), F.col("board").alias("_p")).join(target.select(related, "_b", F.col("puzzle_id").alias("target"), F.col("board").alias("_t")), [related, "_b"])
    arm = lambda name, board: F.struct(F.lit(name).alias("condition"), F.lit(name).alias("role"), F.col(board).alias("board"))
    rows = pairs.select(F.concat_ws("+", "prime", "target").alias("puzzle_id"), F.explode(F.array(arm("prime", "_p"), arm("target", "_t"))).alias("a")).select("puzzle_id", "a.*")
    return _trials("transfer", rows)


def _trials(module: str, rows: DataFrame) -> DataFrame:
    block = F.concat_ws("_", F.lit(module), "puzzle_id")
    return rows.select(F.lit(module).alias("module"), block.alias("block"), F.concat_ws("/", block, "condition").alias("trial"), "condition", "role", "board")


def module_blocks(trials: DataFrame) -> DataFrame:
    """(module, block, trial_ids): what a block shows, in the order of the trials' names."""
    return trials.groupBy("module", "block").agg(F.array_sort(F.collect_list("trial")).alias("trial_ids"))
