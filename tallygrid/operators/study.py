"""A study's design: conditions, clusters, comparisons of arms, and the summaries made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallygrid.functions import metrics as m

from . import inference

#: Which rows of a block are compared: module -> (reference predicate, perturbed predicate).
COMPARISONS = {
    "cue": ("condition = 'baseline'", "condition != 'baseline'"),
    "spatial": ("role = 'original'", "role != 'original'"),
    "formulation": ("role = 'original'", "role != 'original'"),
    "pair": ("condition = 'alone'", "condition != 'alone' and coalesce(role, '') != 'first'"),
    "transfer": ("role = 'prime'", "role = 'target'"),
}


def clusters(items: DataFrame, item: str, module: str, stratum: str, suffix: str = r"_(NO_PRIME|REL|CTRL)$") -> DataFrame:
    """item, cluster, cluster_stratum: an item of the main part is its own cluster, those of a module family are one."""
    main = F.coalesce(F.col(module), F.lit("main")) == "main"
    return items.select(
        item,
        F.when(main, F.col(item)).otherwise(F.regexp_replace(item, suffix, "")).alias("cluster"),
        F.concat_ws("/", F.when(main, "main").otherwise("module"), F.coalesce(F.col(module), F.lit("main")), F.col(stratum)).alias("cluster_stratum"),
    )


def comparisons(trials: DataFrame) -> DataFrame:
    """module, block, reference, perturbed, arm: each block's reference trials against its perturbed ones.

    ``trials`` has trial, module, block, condition, role.
    """
    out = None
    for name, (before, after) in COMPARISONS.items():
        own = trials.filter(F.col("module") == name)
        a = own.filter(before).select("module", "block", F.col("trial").alias("reference"))
        b = own.filter(after).select("block", F.col("trial").alias("perturbed"), F.coalesce("condition", "role").alias("arm"))
        rows = a.join(b, "block").filter("reference != perturbed").select("module", "block", "reference", "perturbed", "arm")
        out = rows if out is None else out.unionAll(rows)
    return out


def arm_effects(pairs: DataFrame, dist: DataFrame) -> DataFrame:
    """Total variation of each comparison and source, from the item distributions of both trials."""
    a = dist.select("source", F.col("item").alias("reference"), "klass", F.col("p").alias("p"))
    b = dist.select("source", F.col("item").alias("perturbed"), "klass", F.col("p").alias("q"))
    keys = ["source", "module", "block", "arm", "reference", "perturbed"]
    shared = pairs.join(a, "reference").join(b, ["source", "perturbed", "klass"]).groupBy(*keys).agg(m.tv_shared(F.col("p"), F.col("q")).alias("tv"))
    there = pairs.join(a.select("source", "reference").distinct(), "reference").join(b.select("source", "perturbed").distinct(), ["source", "perturbed"])
    return there.join(shared, keys, "left").select(*keys, F.coalesce("tv", F.lit(1.0)).alias("tv"))


def nested_means(rows: DataFrame, keys: list[str], levels: list[str], value: str) -> DataFrame:
    """The mean over each level of the means over the next: levels are listed from the outermost."""
    for depth in range(len(levels), -1, -1):
        rows = rows.groupBy(*keys, *levels[:depth]).agg(F.avg(value).alias(value))
    return rows


def contrasts(rows: DataFrame, keys: list[str], condition: str, one: str, other: str, value: str) -> DataFrame:
    """one - other of a value by keys, where both are there."""
    pick = lambda c: F.max(F.when(F.col(condition) == c, F.col(value)))
    return rows.groupBy(*keys).agg(pick(one).alias("one"), pick(other).alias("other")).withColumn("difference", F.col("one") - F.col("other")).filter("difference is not null")


def gains(rows: DataFrame, keys: list[str], before: Column, after: Column) -> DataFrame:
    """Mean directional gain, how many were at the target already, and how many counted."""
    gain = m.directional_gain(before, after)
    return rows.groupBy(*keys).agg(F.avg(gain).alias("gain"), F.count(gain).alias("n"), F.count_if(gain.isNull()).alias("at_target"))


def cell(value: Column, low: Column, high: Column) -> Column:
    """A table's cell: the value with its interval, bold where that excludes 0; what would round to zero is zero."""
    clean = lambda c: F.when(F.abs(c) < 0.005, 0.0).otherwise(c)
    text = F.printf(F.lit("%.2f [%.2f, %.2f]"), clean(value), clean(low), clean(high))
    return F.when((low > 0) | (high < 0), F.concat(F.lit("**"), text, F.lit("**"))).otherwise(text)


def significance(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean p, and how many tests are below 0.05 as they are and adjusted."""
    return rows.groupBy(*keys).agg(F.avg("p").alias("mean_p"), F.count_if(F.col("p") < 0.05).alias("n_p"), F.count_if(F.col("p_holm") <= 0.05).alias("n_holm"), F.count("*").alias("n"))


def spread(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sample standard deviation (n-1) of a value, null for a single row."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd"))


def status_counts(fits: DataFrame, status: str, keys: list[str] = ()) -> DataFrame:
    """How many fits ended in each status of the optimizer."""
    return fits.groupBy(*keys, status).agg(F.count("*").alias("n"))


def with_mean(rows: DataFrame, keys: list[str], family: str, values: list[str], name: str = "Mean") -> DataFrame:
    """Per family the means of values, and a row ``name`` with the equal-family mean."""
    by = rows.groupBy(*keys, family).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n"))
    overall = by.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], F.sum("n").alias("n")).withColumn(family, F.lit(name))
    return by.withColumn(family, F.col(family).cast("string")).unionByName(overall)


def context_table(rows: DataFrame, keys: list[str], block: str, family: str, arm: str, value: str, before: str) -> DataFrame:
    """Matched blocks of a related and an unrelated arm: both values, their difference, and the related arm's normalised change from ``before``; by family and in mean."""
    return with_mean(_matched(rows, keys, block, family, arm, value, before), keys, family, ["related", "unrelated", "difference", "change"])


def _matched(rows: DataFrame, keys: list[str], block: str, family: str, arm: str, value: str, before: str) -> DataFrame:
    pick = lambda name, c: F.max(F.when(F.col(arm) == name, F.col(c)))
    blocks = rows.groupBy(*keys, block, family).agg(pick("related", value).alias("related"), pick("unrelated", value).alias("unrelated"), pick("related", before).alias("p"))
    blocks = blocks.filter("related is not null and unrelated is not null")
    return blocks.withColumns({"difference": F.col("related") - F.col("unrelated"), "change": m.directional_gain(F.col("p"), F.col("related"))})


def context_values(rows: DataFrame, keys: list[str], block: str, family: str, arm: str, value: str, before: str) -> DataFrame:
    """What the means of :func:`context_table` are taken of, for :func:`with_intervals`: keys, metric, stratum (family), cluster (block), value."""
    blocks = _matched(rows, keys, block, family, arm, value, before)
    return _long(blocks, keys, family, block, ["related", "unrelated", "difference", "change"])


def contrast_values(rows: DataFrame, keys: list[str], block: str, family: str, condition: str, pairs: list[tuple[str, str]], value: str) -> DataFrame:
    """Differences of a value between two arms of a block, for each pair of arms, as values for :func:`with_intervals`; a block without one of the two has none."""
    pick = lambda c: F.max(F.when(F.col(condition) == c, F.col(value)))
    named = {f"{one}-{other}": pick(one) - pick(other) for one, other in pairs}
    return _long(rows.groupBy(*keys, family, block).agg(*[x.alias(c) for c, x in named.items()]), keys, family, block, list(named)).filter("value is not null")


def module_values(arms: DataFrame, keys: list[str], block: str, family: str, arm: str, movement: str, gain: str, before: str) -> DataFrame:
    """What the means of :func:`module_summaries` are taken of, for :func:`with_intervals`: each metric's mean over a block's arms."""
    share = m.normalized_attraction(F.col(gain), F.col(before))
    metrics = F.array(
        F.struct(F.lit("movement").alias("metric"), F.col(movement).alias("value")),
        F.struct(F.concat(F.lit("movement_"), F.col(arm)).alias("metric"), F.col(movement).alias("value")),
        F.struct(F.lit("gain").alias("metric"), F.col(gain).alias("value")),
        F.struct(F.lit("normalized_gain").alias("metric"), share.alias("value")),
    )
    rows = arms.select(*keys, F.col(family).alias("stratum"), F.col(block).alias("cluster"), F.inline(metrics)).filter("value is not null")
    return rows.groupBy(*keys, "metric", "stratum", "cluster").agg(F.avg("value").alias("value"))


def _long(rows: DataFrame, keys: list[str], family: str, block: str, metrics: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in metrics])
    return rows.select(*keys, F.col(family).alias("stratum"), F.col(block).alias("cluster"), F.inline(cells))


def with_intervals(values: DataFrame, keys: list[str], drawn: Callable[[DataFrame], DataFrame], families: bool = True, name: str = "Mean") -> DataFrame:
    """(keys, metric, family, mean, low, high, replicates): the equal-family mean ``name`` and, if ``families``, each family's own mean, with intervals over drawn blocks.

    ``drawn`` makes draws (rep, index, times) of the numbered clusters (stratum, cluster, index); one draw of blocks serves all
    keys and metrics, so that intervals of a table belong together.  Null values count in no mean.
    """
    numbered, _ = inference.numbered_clusters(values)
    draws = drawn(numbered)
    out = inference.summarised(values, numbered, draws, [*keys, "metric"], True).withColumn("family", F.lit(name))
    if families:
        own = inference.summarised(values.withColumn("family", F.col("stratum").cast("string")), numbered, draws, [*keys, "metric", "family"], False)
        out = out.unionByName(own)
    return out.select(*keys, "metric", "family", "mean", "low", "high", "replicates")


def module_summaries(arms: DataFrame, keys: list[str], block: str, family: str, arm: str, movement: str, gain: str, before: str) -> DataFrame:
    """Per metric the equal-family mean over blocks: of all arms' movement, of each arm's, of the mass gained and of the normalised gain."""
    levels = [family, block]
    parts = [
        nested_means(arms, keys, levels, movement).select(*keys, F.lit("movement").alias("metric"), F.col(movement).alias("value")),
        nested_means(arms.withColumn("metric", F.concat(F.lit("movement_"), F.col(arm))), [*keys, "metric"], levels, movement).select(*keys, "metric", F.col(movement).alias("value")),
        nested_means(arms, keys, levels, gain).select(*keys, F.lit("gain").alias("metric"), F.col(gain).alias("value")),
        nested_means(arms.withColumn("_a", m.normalized_attraction(F.col(gain), F.col(before))).filter("_a is not null"), keys, levels, "_a").select(*keys, F.lit("normalized_gain").alias("metric"), F.col("_a").alias("value")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def design_problems(trials: DataFrame, arms: dict[str, list[str]], crossed: dict[str, str] | None = None) -> DataFrame:
    """(block, problem): blocks of a module that lack an arm, have one twice or one too many, and those whose columns named in ``crossed`` vary.

    ``trials`` has module, block, condition; ``arms`` the conditions a module's blocks must have, each once.
    """
    wanted = F.create_map(*[x for k, v in arms.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])
    varying = [(F.count_distinct(c) > 1, text) for c, text in (crossed or {}).items()]
    blocks = trials.groupBy("module", "block").agg(
        F.array_sort(F.collect_list("condition")).alias("found"), F.array_compact(F.array(*[F.when(test, text) for test, text in varying], F.lit(None).cast("string"))).alias("varying")
    )
    want = wanted[F.col("module")]
    rules = [
        (want.isNull(), "unknown_module"),
        (F.size(F.array_except(want, "found")) > 0, "missing_arm"),
        (F.size(F.array_except("found", want)) > 0, "unknown_arm"),
        (F.size("found") > F.size(F.array_distinct("found")), "repeated_arm"),
    ]
    found = F.concat(F.array_compact(F.array(*[F.when(rule, text) for rule, text in rules])), "varying")
    return blocks.select("module", "block", F.explode(found).alias("problem"))
