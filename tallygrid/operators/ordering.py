"""Ranks, buckets, scaling, interleaving and step-down adjustment."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import fixed, spread

#: Groups whose ends are sent to all executors, in place of a shuffle by the group.
FEW_GROUPS = 1 << 14


def numbered(rows: DataFrame, order: list[Column | str], place: str = "place") -> DataFrame:
    """Adds each row's place from 1 in one order of all rows, without a window over all of them.

    Rows are dealt to tasks by ranges of the order, which should be total, and the ranges are fixed by a checkpoint; places are
    counted in each range and moved on by what the ranges before hold.
    """
    ranged = _ranged(rows, order)
    before = _before(ranged.groupBy("_range").agg(F.count("*").alias("_n")), F.sum("_n"), "_base")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.join(F.broadcast(before), "_range").withColumn(place, F.coalesce("_base", F.lit(0)) + own).drop("_range", "_base")


def _ranged(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """The rows by ranges of an order, as many as a shuffle has tasks, with the range's number ``_range``."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fixed(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))


def _before(totals: DataFrame, fold: Column, name: str, *more: str) -> DataFrame:
    """(_range, more, name): totals of all earlier ranges; a row for each range, which bounds the window and what is broadcast."""
    return totals.select("_range", *more, fold.over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias(name))


def holm(tests: DataFrame, p: str, order: list[str], within: list[str] | None = None, included: Column | None = None) -> DataFrame:
    """Adds p_holm: step-down adjusted p over the included tests of each family; null for the others.

    Ties keep the order of ``order``.  Families run in parallel, each in a window of its own; without ``within`` all tests are
    one family, ranked by ranges of p as in :func:`numbered`.
    """
    chosen = tests.withColumn("_in", F.lit(True) if included is None else F.coalesce(included, F.lit(False)))
    tested = chosen.filter("_in")
    if within:
        family = Window.partitionBy(*within)
        steps = family.orderBy(p, *order)
        tested = tested.withColumn("_m", F.count("*").over(family)).withColumn("_k", F.row_number().over(steps) - 1)
        raised = F.max(F.least(F.lit(1.0), (F.col("_m") - F.col("_k")) * F.col(p))).over(steps.rowsBetween(Window.unboundedPreceding, 0))
        done = tested.withColumn("p_holm", raised).drop("_m", "_k")
    else:
        done = _holm_over_all(tested, p, order)
    return done.unionByName(chosen.filter("not _in").withColumn("p_holm", F.lit(None).cast("double"))).drop("_in")


def _holm_over_all(tested: DataFrame, p: str, order: list[str]) -> DataFrame:
    steps = [F.col(p), *map(F.col, order)]
    ranged = _ranged(tested, steps)
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    every = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = _before(counts.withColumn("_m", F.sum("_n").over(every)), F.sum("_n"), "_base", "_m")
    own = Window.partitionBy("_range").orderBy(*steps)
    left = F.col("_m") - F.coalesce("_base", F.lit(0)) - F.row_number().over(own) + 1
    scaled = ranged.join(F.broadcast(before), "_range").withColumn("_q", left * F.col(p)).withColumn("_q", F.least(F.lit(1.0), F.col("_q")))
    raised = scaled.withColumn("_q", F.max("_q").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    highest = _before(raised.groupBy("_range").agg(F.max("_q").alias("_top")), F.max("_top"), "_floor")
    return raised.join(F.broadcast(highest), "_range").withColumn("p_holm", F.greatest("_q", "_floor")).drop("_range", "_base", "_m", "_q", "_floor")


def minmax_scaled(rows: DataFrame, value: str, within: list[str], tolerance: float = 0.0) -> DataFrame:
    """Adds value_scaled: 0 to 1 in its group, 0 where the group is constant to the tolerance."""
    w = Window.partitionBy(*within)
    low, width = F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)
    return rows.withColumn(f"{value}_scaled", F.when(width > tolerance, F.try_divide(F.col(value) - low, width)).otherwise(0.0))


def tertiles(rows: DataFrame, score: str, ties: list[str], within: list[str]) -> DataFrame:
    """Adds tertile 1 to 3 by score in each group."""
    return rows.withColumn("tertile", F.ntile(3).over(Window.partitionBy(*within).orderBy(score, *ties)))


def thirds(place: Column, n: int) -> Column:
    """Tertile 1 to 3 of a place from 1 among n; the first ones have the rows that are over."""
    each, over = divmod(n, 3)
    head = over * (each + 1)
    low = F.floor((place - 1) / (each + 1)) + 1
    return F.when(place <= head, low).otherwise(F.floor((place - head - 1) / max(1, each)) + 1 + over).cast("int")


def rank_percentile(rows: DataFrame, score: str, ties: list[str], within: list[str]) -> DataFrame:
    """Adds rank (from 1) and percentile ((rank-1)/(n-1), 0 for a group of one)."""
    w = Window.partitionBy(*within)
    rank = F.row_number().over(w.orderBy(score, *ties))
    return rows.withColumn("rank", rank).withColumn("percentile", (F.col("rank") - 1) / F.greatest(F.lit(1), F.count("*").over(w) - 1))


def flattened(rows: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, name, value): numbers as they are, booleans as 0 and 1, lists item by item; other values and what isn't finite are left out."""
    kinds = {f.name: f.dataType for f in rows.schema}
    one = lambda name, value: F.array(F.struct(F.lit(name).alias("name"), value.cast("double").alias("value")))
    cells = []
    listed = lambda name: F.transform(F.coalesce(name, F.array()), lambda x, k: F.struct(F.concat(F.lit(f"{name}_"), k.cast("string")).alias("name"), x.cast("double").alias("value")))
    for name in features:
        if isinstance(kinds[name], T.ArrayType):
            cells.append(listed(name))
        elif isinstance(kinds[name], (T.NumericType, T.BooleanType)):
            cells.append(one(name, F.col(name)))
    flat = rows.select(*keys, F.explode(F.concat(*cells)).alias("cell")).select(*keys, "cell.name", "cell.value")
    return flat.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def scaled_vectors(cells: DataFrame, within: list[str], key: list[str]) -> DataFrame:
    """Adds scaled: 0 to 1 by group and name.  A row without a name that its group has counts as 0 there.

    A name's ends are an aggregate, which goes to the group's rows as a list of its few names; no group is sorted or held whole.
    One shuffle by the row's key serves all steps.
    """
    cells = fixed(spread(cells.withColumn("value", F.nanvl(F.coalesce("value", F.lit(0.0)), F.lit(0.0))), *within, *key))
    members = cells.select(*within, *key).distinct()
    each = cells.groupBy(*within, *key, "name").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    ends = each.filter("name is not null").groupBy(*within, "name").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n"))
    ends = ends.groupBy(*within).agg(F.collect_list(F.struct("name", "low", "high", "n")).alias("_ends"))
    ends = fixed(members.groupBy(*within).agg(F.count("*").alias("_members")).join(ends, within))
    dense = members.join(F.broadcast(ends) if ends.count() <= FEW_GROUPS else ends, within).select(*within, *key, "_members", F.explode("_ends").alias("_e"))
    lacking = F.col("_e.n") < F.col("_members")
    low, high = (F.when(lacking, end(F.col(f"_e.{c}"), F.lit(0.0))).otherwise(F.col(f"_e.{c}")) for c, end in (("low", F.least), ("high", F.greatest)))
    dense = dense.select(*within, *key, "_e.name", low.alias("_low"), high.alias("_high"))
    rows = dense.join(cells, [*within, *key, "name"], "left").fillna(0.0, ["value"])
    width = F.col("_high") - F.col("_low")
    scaled = F.when(width > 0, F.try_divide(F.col("value") - F.col("_low"), width)).otherwise(0.0)
    return rows.withColumn("scaled", scaled).select(*within, *key, "name", "value", "scaled")


def submatrix(rows: DataFrame, labels: list[str]) -> DataFrame:
    """The (left, right) rows among some labels, with their places (i, j) in the new order."""
    place = lambda c: F.array_position(F.array(*map(F.lit, labels)), F.col(c)).cast("int") - 1
    return rows.filter(F.col("left").isin(labels) & F.col("right").isin(labels)).withColumns({"i": place("left"), "j": place("right")})


def rebalanced(strata: DataFrame, bucket: str, target: str, available: str, total: int) -> DataFrame:
    """Adds chosen: how many to take of each bucket so that they are ``total``.

    Each gives its target, or what it has; what is missing is filled from the
    others, the largest shortage first, then the most available, then the later name.  Strata are a design's few rows.
    """
    have = strata.withColumn("base", F.least(target, available)).withColumn("spare", F.col(available) - F.col("base"))
    order = Window.orderBy(F.desc(F.col(target) - F.col("base")), F.desc(available), F.col(bucket))
    missing = F.lit(total) - F.sum("base").over(Window.partitionBy(F.lit(0)))
    before = F.sum("spare").over(order.rowsBetween(Window.unboundedPreceding, -1))
    left = F.greatest(F.lit(0), missing - F.coalesce(before, F.lit(0)))
    return have.withColumn("chosen", F.col("base") + F.least("spare", left)).drop("base", "spare")


def round_robin(rows: DataFrame, lane: str, order: list[str]) -> DataFrame:
    """Adds turn (place in its lane) and position fields: rows sorted by (turn, lane) take the lanes in turns."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(lane).orderBy(*order)))


def lowest_per_group(rows: DataFrame, score: str, ties: list[str], within: list[str], k: int, seed: int | None = None, key: list[str] = ()) -> DataFrame:
    """The k rows of each group with the least score.  With a seed, a column ``tie`` made of it and the key is there to order by."""
    if seed is not None:
        rows = rows.withColumn("tie", F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]), 256))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*within).orderBy(score, *ties))).filter(F.col("place") <= k)


def pruned(rows: DataFrame, key: str, bucket: str, quality: str, ties: list[str], limit: int) -> DataFrame:
    """One row of each key, the best; then the best ``limit`` of each bucket."""
    best = Window.partitionBy(key).orderBy(F.desc(quality), *ties)
    unique = rows.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")
    top = Window.partitionBy(bucket).orderBy(F.desc(quality), *ties)
    return unique.withColumn("place", F.row_number().over(top)).filter(F.col("place") <= limit)


def shared_with_others(rows: DataFrame, within: list[str], value: str) -> DataFrame:
    """Adds others: how many other rows of the group have the same value."""
    return rows.withColumn("others", F.count("*").over(Window.partitionBy(*within, value)) - 1)


def changes(rows: DataFrame, within: list[str], order: list[str], value: str) -> DataFrame:
    """Per group: rows and how often the value differs from the one before."""
    before = F.lag(value).over(Window.partitionBy(*within).orderBy(*order))
    marked = rows.withColumn("_c", F.when(before.isNotNull() & (before != F.col(value)), 1).otherwise(0))
    return marked.groupBy(*within).agg(F.count("*").alias("steps"), F.sum("_c").alias("changes"))


def histogram(rows: DataFrame, value: str, bins: int, low: float, high: float, within: list[str]) -> DataFrame:
    """Counts in equal bins; the last bin has both its ends."""
    cell = F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    return rows.filter((F.col(value) >= low) & (F.col(value) <= high)).groupBy(*within, cell.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def batches(rows: DataFrame, within: list[str], order: list[str], size: str, max_rows: int, max_size: int) -> DataFrame:
    """Adds batch: rows of each group in order, a new batch where the next row would break a cap on rows or size.

    The caps make it a left fold.  Groups are dealt out and sorted by Spark and pass through the fold
    row by row, so a task keeps three numbers and one Arrow batch, however large a group is.
    """

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, batch, n, total = None, 0, 0, 0
        for pdf in parts:
            out = []
            for key, s in zip(pdf[within].itertuples(index=False, name=None), pdf[size], strict=True):
                key = tuple(None if pd.isna(x) else x for x in key)
                if key != last:
                    last, batch, n, total = key, 0, 0, 0
                if n and (n + 1 > max_rows or total + s > max_size):
                    batch, n, total = batch + 1, 0, 0
                n, total = n + 1, total + s
                out.append(batch)
            yield pdf.assign(batch=out)

    dealt = rows.repartition(*within).sortWithinPartitions(*within, *order)
    return dealt.mapInPandas(fold, T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())]))
