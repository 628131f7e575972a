"""From observations to distributions, their pairs, and means over strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallygrid.functions import metrics as m


def class_counts(bound: DataFrame) -> DataFrame:
    """n of each (source, item, class), with the item's stratum and cluster where bound; unresolved classes don't count."""
    keys = [c for c in ("source", "item", "klass", "stratum", "cluster") if c in bound.columns]
    return bound.filter("klass is not null").groupBy(*keys).agg(F.count("*").alias("n"))


def distributions(counts: DataFrame) -> DataFrame:
    """Adds total, p, and is_mode (ties are all modes)."""
    w = Window.partitionBy("source", "item")
    total = F.sum("n").over(w)
    return counts.withColumns({"total": total, "p": F.col("n") / total, "is_mode": F.col("n") == F.max("n").over(w)})


def catalog_sizes(counts: DataFrame) -> DataFrame:
    """Number of classes that any source gave for the item."""
    return counts.groupBy("item").agg(F.count_distinct("klass").alias("classes"))


def profiles(dist: DataFrame) -> DataFrame:
    """One row for each (source, item): total, support, entropy, modes."""
    keys = [c for c in ("source", "item", "stratum", "cluster") if c in dist.columns]
    return dist.groupBy(*keys).agg(
        F.max("total").alias("total"),
        F.count("*").alias("support"),
        m.entropy(F.col("p")).alias("entropy"),
        F.sum(m.smoothed(F.col("n"))).alias("sx"),
        F.sum(m.smoothed(F.col("n")) ** 2).alias("sxx"),
    )


def pairwise(dist: DataFrame) -> DataFrame:
    """All metrics of every pair of sources (left < right) on every item that both have.

    One inner self-join on (item, class) serves every metric; pairs without a
    shared class come from the join of the (source, item) profiles, which also
    brings the sums that the correlation needs.
    """
    keep = [c for c in ("stratum", "cluster") if c in dist.columns]
    left = dist.select("item", "klass", F.col("source").alias("left"), F.col("p").alias("lp"), F.col("n").alias("ln"), F.col("is_mode").alias("lm"))
    right = dist.select("item", "klass", F.col("source").alias("right"), F.col("p").alias("rp"), F.col("n").alias("rn"), F.col("is_mode").alias("rm"))
    p, q = F.col("lp"), F.col("rp")
    shared = (
        left.join(right, ["item", "klass"])
        .filter(F.col("left") < F.col("right"))
        .groupBy("left", "right", "item")
        .agg(
            *[f(p, q).alias(name) for name, f in m.PAIR_METRICS.items()],
            F.max(F.col("lm") & F.col("rm")).alias("modal_agreement"),
            F.sum(m.smoothed(F.col("ln")) * m.smoothed(F.col("rn"))).alias("sxy"),
        )
    )
    own = profiles(dist)
    a = own.select("item", *keep, F.col("source").alias("left"), F.col("sx").alias("sx"), F.col("sxx").alias("sxx"))
    b = own.select("item", F.col("source").alias("right"), F.col("sx").alias("sy"), F.col("sxx").alias("syy"))
    pairs = a.join(b, "item").filter(F.col("left") < F.col("right")).join(catalog_sizes(dist), "item")
    k = F.col("classes").cast("double")
    return pairs.join(shared, ["left", "right", "item"], "left").select(
        "left",
        "right",
        "item",
        *keep,
        F.coalesce("tv", F.lit(1.0)).alias("tv"),
        F.coalesce("js", F.lit(1.0)).alias("js"),
        F.coalesce("js_distance", F.lit(1.0)).alias("js_distance"),
        F.coalesce("hellinger", F.lit(1.0)).alias("hellinger"),
        F.coalesce("modal_agreement", F.lit(False)).alias("modal_agreement"),
        m.pearson(k, F.col("sx"), F.col("sy"), F.col("sxx"), F.col("syy"), F.coalesce("sxy", F.lit(0.0))).alias("log_density_correlation"),
    )


def stratum_means(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Means over items in each stratum (stratum set), and the equal-stratum mean of those (stratum null)."""
    by = rows.groupBy(*keys, "stratum").agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("items"))
    overall = by.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values], F.sum("items").alias("items"))
    kind = dict(by.dtypes)["stratum"]
    return by.unionByName(overall.withColumn("stratum", F.lit(None).cast(kind)))


def uniform_baseline(dist: DataFrame) -> DataFrame:
    """Total variation of each (source, item) from the uniform distribution on the item's catalog."""
    sized = dist.join(catalog_sizes(dist), "item")
    keys = [c for c in ("source", "item", "stratum") if c in dist.columns]
    return sized.groupBy(*keys).agg(
        F.first("classes").alias("classes"),
        (1 - F.sum(F.least(F.col("p"), 1 / F.col("classes")))).alias("tv_uniform"),
    )


def mixture(dist: DataFrame) -> DataFrame:
    """Equal-source mixture: the mean over the item's sources of their probabilities."""
    sources = dist.groupBy("item").agg(F.count_distinct("source").alias("sources"))
    return dist.groupBy("item", "klass").agg(F.sum("p").alias("mass")).join(sources, "item").select("item", "klass", (F.col("mass") / F.col("sources")).alias("p"))


def target_mass(counts: DataFrame, is_target: Column) -> DataFrame:
    """Share of each (source, item) that lies on target classes, with its exact numerator and denominator."""
    hit = F.coalesce(F.sum(F.when(is_target, F.col("n"))), F.lit(0))
    return counts.groupBy("source", "item").agg(hit.alias("hits"), F.sum("n").alias("total")).withColumn("mass", F.col("hits") / F.col("total"))


def joint_distribution(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Counts and shares of (a, b) within keys, and the marginals' shares."""
    cells = pairs.groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return cells.withColumns(
        {
            "p": F.col("n") / total,
            "pa": F.sum("n").over(Window.partitionBy(*keys, "a")) / total,
            "pb": F.sum("n").over(Window.partitionBy(*keys, "b")) / total,
        }
    )


def dependence(joint: DataFrame, keys: list[str]) -> DataFrame:
    """Mutual information (bits) and total variation from independence; only cells that occur are needed for either."""
    p, q = F.col("p"), F.col("pa") * F.col("pb")
    return joint.groupBy(*keys).agg(
        F.sum("n").alias("pairs"),
        F.sum(p * F.log2(p / q)).alias("mutual_information"),
        (1 - F.sum(F.least(p, q))).alias("independence_tv"),
    )


def repetition(joint: DataFrame, keys: list[str], answer_map: DataFrame | None = None) -> DataFrame:
    """Mass on b = map(a) and what independence would give; without a map, b = a."""
    rows = joint.withColumn("mapped", F.col("a")) if answer_map is None else joint.join(answer_map, "a")
    same = F.col("b") == F.col("mapped")
    return rows.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(same, F.col("p"))), F.lit(0.0)).alias("repetition"),
        F.coalesce(F.sum(F.when(same, F.col("pa") * F.col("pb"))), F.lit(0.0)).alias("expected_on_cells"),
    )


def paired_answers(first: DataFrame, second: DataFrame, key: list[str], order: str) -> DataFrame:
    """Inner join of two answers on a key; of several first answers of a key the last by ``order`` counts."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    last = first.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    return last.select(*key, F.col("klass").alias("a")).join(second.select(*key, F.col("klass").alias("b")), key)
