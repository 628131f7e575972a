"""Checks that return what is wrong, pairwise measures within small groups, and distances between groups."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import fixed, spread


def missing_crossing(rows: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, right) combinations that no row has; empty for a complete crossing.

    The right-hand values go along as one array, so nothing is crossed by a join;
    they are a design's levels, not data that grows.
    """
    (column,) = right.columns
    levels = right.distinct().groupBy(F.lit(1).alias("_k")).agg(F.collect_set(column).alias("_levels"))
    full = left.distinct().withColumn("_k", F.lit(1)).join(levels, "_k").select(*left.columns, F.explode("_levels").alias(column))
    return full.join(rows.select(*full.columns).distinct(), full.columns, "left_anti")


def overlap(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """How many keys both have; 0 for disjoint tables."""
    return a.select(*key).distinct().join(b.select(*key), key, "left_semi").agg(F.count("*").alias("n"))


def catalog_problems(rows: DataFrame, key: list[str], known: DataFrame, reference: list[str]) -> DataFrame:
    """Repeated keys, and rows whose reference isn't known."""
    repeated = rows.groupBy(*key).count().filter("count > 1").select(F.lit("duplicate").alias("problem"), *key)
    unknown = rows.join(known.select(*reference).distinct(), reference, "left_anti").select(F.lit("unknown").alias("problem"), *key)
    return repeated.unionAll(unknown)


def inversions(rows: DataFrame, within: list[str], order: str, value: str) -> DataFrame:
    """Pairs of a group in one order by ``order`` and the other by ``value``.

    A group is one array, sorted once, and the pairs are counted inside it; groups are short sequences.
    """
    groups = rows.groupBy(*within).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("_v"))
    after = lambda x, k: F.size(F.filter(F.slice("_v", k + 2, F.size("_v")), lambda y: y < x))
    return groups.select(*within, F.aggregate(F.transform("_v", after), F.lit(0).cast("long"), lambda a, x: a + x).alias("inversions"))


def pairwise_jaccard(rows: DataFrame, group: str, member: str, element: str) -> DataFrame:
    """Mean and greatest Jaccard distance between the members of each group."""
    sets = rows.groupBy(group, member).agg(F.collect_set(element).alias("xs"))
    a, b = sets.select(group, F.col(member).alias("a"), F.col("xs").alias("x")), sets.select(group, F.col(member).alias("b"), F.col("xs").alias("y"))
    d = 1 - F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    pairs = a.join(b, group).filter("a < b").select(group, d.alias("d"))
    return pairs.groupBy(group).agg(F.count("*").alias("pairs"), F.avg("d").alias("mean_distance"), F.max("d").alias("max_distance"))


#: Parts of a group's vectors that are paired side by side.
PARTS = 32


def max_contrast(vectors: DataFrame, group: str, member: str, vector: str) -> DataFrame:
    """Greatest Euclidean distance between members of each group.

    Equal vectors are one.  No vector is farther from another than its group's box, or the ball about the box, allows; those that
    this keeps below a distance already found (from the vector that may reach farthest, and on from there) aren't paired.
    The others are, in parts, so that a group's pairs are many tasks' work.
    """
    points = vectors.filter(F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("x")).agg(F.min(member).alias("lo"), F.max(member).alias("hi"))
    points = fixed(points.withColumns({"size": F.size("x"), "sound": F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))}))
    keys, own = ["g", "size"], points.filter("sound")
    box = own.select(*keys, F.posexplode("x").alias("i", "v")).groupBy(*keys, "i").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    box = box.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "low", "high"))), lambda e: F.struct(e["low"], e["high"], ((e["low"] + e["high"]) / 2).alias("mid"))).alias("box"))
    corner = F.zip_with("x", "box", lambda v, e: F.greatest(v - e["low"], e["high"] - v))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, d: s + d * d))
    own = own.join(box, keys).select(*keys, "x", "lo", "hi", norm(corner).alias("corner"), norm(F.zip_with("x", "box", lambda v, e: v - e["mid"])).alias("out"))
    ball = own.groupBy(*keys).agg(F.max("out").alias("radius"))
    own = fixed(own.join(ball, keys).select(*keys, "x", "lo", "hi", F.least("corner", F.col("out") + F.col("radius")).alias("reach")))
    # Two members are at least this far apart.
    apart = lambda p, q: norm(F.zip_with(p, q, lambda a, b: a - b))
    differ = F.least("lo", "_lo") < F.greatest("hi", "_hi")
    pole, found = own.groupBy(*keys).agg(F.max_by(F.struct("x", "lo", "hi"), "reach").alias("p")), None
    for _ in range(3):
        pole = fixed(pole.select(*keys, F.col("p.x").alias("_x"), F.col("p.lo").alias("_lo"), F.col("p.hi").alias("_hi")))
        far = F.when(differ, apart("x", "_x"))
        pole = fixed(own.join(pole, keys).groupBy(*keys).agg(F.max(far).alias("far"), F.max_by(F.struct("x", "lo", "hi"), far).alias("p")))
        found = pole.select(*keys, "far") if found is None else found.unionAll(pole.select(*keys, "far"))
        pole = pole.filter("p is not null")
    least = found.groupBy(*keys).agg(F.max("far").alias("far"))
    near = F.col("reach") < F.col("far") * (1 - 1e-9)
    kept = own.join(least, keys).filter(~F.coalesce(near, F.lit(False))).select("g", "x", "lo", "hi", "size")
    kept = fixed(kept.unionAll(points.filter("not sound").select("g", "x", "lo", "hi", "size")).withColumn("part", F.pmod(F.xxhash64("x"), F.lit(PARTS))))
    others = kept.select("g", "size", F.col("x").alias("_x"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("part").alias("_part"))
    # Each pair of parts meets once, at the one of the greater number.
    others = others.select("*", F.explode(F.sequence("_part", F.lit(PARTS - 1).cast("long"))).alias("part"))
    pairs = spread(kept, "g", "size", "part").join(spread(others, "g", "size", "part"), ["g", "size", "part"]).filter(differ)
    contrast = pairs.groupBy("g").agg(F.max(apart("x", "_x")).alias("contrast"))
    several = points.groupBy("g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("g")
    return several.join(contrast, "g", "left").select(F.col("g").alias(group), "contrast")


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, i, x): mean of each coordinate."""
    cells = vectors.select(group, F.posexplode(vector).alias("i", "v"))
    return cells.groupBy(group, "i").agg(F.avg(F.col("v").cast("double")).alias("x"))


def squared_distances(points: DataFrame, group: str) -> DataFrame:
    """(left, right, d2) between all points; one row for a coordinate of each comes in."""
    a, b = points.select("i", F.col(group).alias("left"), F.col("x").alias("x")), points.select("i", F.col(group).alias("right"), F.col("x").alias("y"))
    return a.join(b, "i").groupBy("left", "right").agg(F.sum((F.col("x") - F.col("y")) ** 2).alias("d2"))


def double_centred(distances: DataFrame) -> DataFrame:
    """(left, right, kernel): -1/2 of the squared distances, centred by rows and columns."""
    mean = lambda *keys: F.avg("d2").over(Window.partitionBy(*keys))
    return distances.select("left", "right", (-0.5 * (F.col("d2") - mean("left") - mean("right") + mean(F.lit(0)))).alias("kernel"))


def same_in_any(rows: DataFrame, key: str, columns: list[list[str]], name: str) -> DataFrame:
    """How many other rows agree with a row on one of the column lists at least; rows without any are left out, and nulls agree with nothing.

    ``key`` tells rows apart.  Rows that agree on one list or another are counted by inclusion and exclusion, from the numbers of
    rows that agree on all columns of some of the lists, so no pairs are made, however many rows agree.
    """
    lists = [k for size in range(1, len(columns) + 1) for k in itertools.combinations(columns, size)]
    agreeing = F.lit(0).cast("long")
    out = rows.select(key, *dict.fromkeys(c for cs in columns for c in cs))
    for k, some in enumerate(lists):
        cs = list(dict.fromkeys(c for one in some for c in one))
        n = rows.dropna(subset=cs).groupBy(*cs).agg((F.count("*") - 1).alias(f"_n{k}")).filter(f"_n{k} > 0")
        out = out.join(n, cs, "left")
        agreeing = agreeing + (1 if len(some) % 2 else -1) * F.coalesce(f"_n{k}", F.lit(0))
    return out.select(key, agreeing.alias(name)).filter(F.col(name) > 0)


def constraint_problems(name: str, rows: DataFrame, key: list[str], required: list[str] = (), references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(name, problem, n): repeated keys, nulls in required columns, and references to nothing; no row where all holds."""
    parts = [rows.groupBy(*key).count().filter("count > 1").agg(F.lit("repeated_key").alias("problem"), F.count("*").alias("n"))]
    if required:
        nulls = F.array(*[F.struct(F.lit(f"null_{c}").alias("problem"), F.count_if(F.col(c).isNull()).alias("n")) for c in required])
        parts.append(rows.agg(F.explode(nulls).alias("x")).select("x.problem", "x.n"))
    for column, (other, their) in (references or {}).items():
        missing = rows.filter(F.col(column).isNotNull()).join(other.select(F.col(their).alias(column)).distinct(), column, "left_anti")
        parts.append(missing.agg(F.lit(f"unknown_{column}").alias("problem"), F.count("*").alias("n")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out.filter("n > 0").select(F.lit(name).alias("name"), "problem", "n")
