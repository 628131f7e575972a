"""Queries that SQL can't express: resampling, permutation, geometry, regressions, solvers; tests hold them against brute force."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.operators import distributions as d
from tallygrid.operators import geometry, inference, logit, puzzles
from tallygrid.operators.lineage import fixed

from .tables import orders, shipments, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
REPEATS = 5000
FIT_REPEATS = 2000


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def _entropies(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = d.profiles(d.distributions(d.class_counts(orders(spark, sf_dir))))
    return own.select("source", "stratum", "item", F.col("item").alias("cluster"), F.col("entropy").alias("value"))


@query
def bootstrap_ci(spark, sf_dir):
    return inference.bootstrap(_entropies(spark, sf_dir).drop("item"), REPEATS, 0, ["source"], equal_strata=True)


@query
def bootstrap_pooled_ci(spark, sf_dir):
    return inference.bootstrap(_entropies(spark, sf_dir).drop("item"), REPEATS, 0, ["source"], equal_strata=False)


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = d.class_counts(orders(spark, sf_dir))
    one = lambda s: F.coalesce(F.sum(F.when(F.col("source") == s, F.col("n"))), F.lit(0))
    return counts.groupBy("item", "klass").agg(one("O").alias("before"), one("F").alias("after"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers: the status is the source, the customer the person, the nation the item; the lowest priority counts as no class."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    klass = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    return rows.groupBy(F.col("o_orderstatus").alias("source"), F.col("c_custkey").alias("person"), F.col("c_nationkey").alias("item"), klass.alias("klass")).agg(F.count("*").alias("n"))


@query
def response_bootstrap(spark, sf_dir):
    return inference.response_bootstrap(_answers(spark, sf_dir), REPEATS, 0, crossed="F")


@query
def joint_bootstrap(spark, sf_dir):
    """Answers and items drawn anew together: items within their region."""
    rows = _answers(spark, sf_dir)
    items = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cluster"), F.col("n_regionkey").alias("stratum")).join(rows.select(F.col("item").alias("cluster")).distinct(), "cluster")
    numbered, sizes = inference.numbered_clusters(fixed(items))
    drawn = inference.draws(spark, sizes, REPEATS, 0).join(numbered, "index").select("rep", F.col("cluster").alias("item"), "times")
    return inference.response_bootstrap(rows, REPEATS, 0, crossed="F", item_draws=drawn)


@query
def given_draw_intervals(spark, sf_dir):
    """Intervals over draws of people that a rule gives: each replicate takes a person none to three times."""
    rows = _answers(spark, sf_dir).filter("source = 'F' or person % 2 = 0")
    draws = F.explode(F.sequence(F.lit(0), F.lit(39))).alias("rep")
    picked = rows.select("*", draws).withColumn("w", F.col("n") * ((F.col("person") * 7 + F.col("rep") * 13 + F.col("person") * F.col("rep")) % 4))
    cells = picked.groupBy("rep", "source", "item", "klass").agg(F.sum("w").alias("w"))
    there = rows.filter("klass is not null").select("source", "item").distinct()
    out = inference.replicate_intervals(cells, there, 40)
    return out.select("left", "right", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


ORACLES["given_draw_intervals"] = """WITH a AS (SELECT o_orderstatus AS source, c_custkey AS person, c_nationkey AS item, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS klass, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' OR c_custkey % 2 = 0 GROUP BY ALL),
 c AS (SELECT rep, source, item, klass, sum(n * ((person * 7 + rep * 13 + person * rep) % 4)) AS w FROM a, range(40) AS r(rep) WHERE klass IS NOT NULL GROUP BY ALL HAVING w > 0),
 s AS (SELECT rep, source, item, klass, w / sum(w) OVER (PARTITION BY rep, source, item) AS p FROM c),
 t AS (SELECT DISTINCT source, item FROM a WHERE klass IS NOT NULL),
 k AS (SELECT item, klass FROM a WHERE klass IS NOT NULL GROUP BY ALL),
 x AS (SELECT l.source AS "left", r.source AS "right", l.item, rep, klass FROM t l JOIN t r ON l.item = r.item AND l.source < r.source JOIN k ON k.item = l.item, range(40) AS q(rep)),
 d AS (SELECT x.*, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q, (coalesce(a.p, 0) + coalesce(b.p, 0)) / 2 AS m FROM x LEFT JOIN s a ON a.rep = x.rep AND a.source = x."left" AND a.item = x.item AND a.klass = x.klass
  LEFT JOIN s b ON b.rep = x.rep AND b.source = x."right" AND b.item = x.item AND b.klass = x.klass),
 e AS (SELECT "left", "right", item, rep, sum(p) > 0 AND sum(q) > 0 AS met, sum(abs(p - q)) / 2 AS tv,
  (sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END)) / 2 AS js, sqrt(sum((sqrt(p) - sqrt(q)) ** 2) / 2) AS hellinger FROM d GROUP BY ALL),
 f AS (SELECT "left", "right", rep, avg(CASE WHEN met THEN tv ELSE 1 END) AS tv, avg(CASE WHEN met THEN js ELSE 1 END) AS js, avg(CASE WHEN met THEN hellinger ELSE 1 END) AS hellinger FROM e GROUP BY ALL)
 SELECT "left", "right", round(quantile_cont(tv, 0.025), 6) AS tv_low, round(quantile_cont(tv, 0.975), 6) AS tv_high, round(quantile_cont(js, 0.025), 6) AS js_low, round(quantile_cont(js, 0.975), 6) AS js_high,
  round(quantile_cont(hellinger, 0.025), 6) AS hellinger_low, round(quantile_cont(hellinger, 0.975), 6) AS hellinger_high FROM f GROUP BY ALL"""


@query
def permutation_tv(spark, sf_dir):
    return inference.tv_tests(_arms(spark, sf_dir), ["item"], 10_000)


@query
def permutation_mi(spark, sf_dir):
    from .distribution_queries import _event_pairs

    joint = _event_pairs(spark, sf_dir).groupBy("user_id", "a", "b").agg(F.count("*").alias("n"))
    return inference.joint_tests(joint, ["user_id"], 2000)


@query
def paired_correlations(spark, sf_dir):
    return inference.paired_correlations(_entropies(spark, sf_dir).select("source", "stratum", "item", "value"), REPEATS, 0)


def _distances(spark: SparkSession, sf_dir: str, stratum: bool) -> DataFrame:
    """Mean distances between priorities' suppliers as sources: nations over order priorities."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    bound = rows.select(F.col("c_mktsegment").alias("source"), F.col("c_nationkey").alias("item"), F.col("o_orderpriority").alias("klass"), (F.col("c_nationkey") % 5).alias("stratum"))
    pairs = d.pairwise(d.distributions(d.class_counts(bound)))
    return pairs.groupBy("left", "right", *(["stratum"] if stratum else [])).agg(F.avg("js_distance").alias("value"))


@query
def mds(spark, sf_dir):
    return geometry.mds(spark, _distances(spark, sf_dir, False), "value")


@query
def cka(spark, sf_dir):
    rows = _distances(spark, sf_dir, True)
    kernels = [geometry.kernel(geometry.matrix(rows.filter(F.col("stratum") == k), "value")[1]) for k in range(5)]
    found = geometry.alignment(kernels)
    return spark.createDataFrame([(a, b, float(found[a, b])) for a in range(5) for b in range(5)], "left int, right int, alignment double")


@query
def svd_projection(spark, sf_dir):
    rows = geometry.gram_rows(_entropies(spark, sf_dir).select("source", "item", "value"))
    labels, gram = geometry.matrix(rows, diagonal=None)
    x, shares = geometry.svd_projection(gram)
    return spark.createDataFrame([(s, *map(float, p), *map(float, shares)) for s, p in zip(labels, x, strict=True)], "source string, x double, y double, share_x double, share_y double")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = d.class_counts(shipments(spark, sf_dir))
    price = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("item"), F.col("l_linenumber").alias("klass")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    return counts.join(price, ["item", "klass"])


@query
def choice_logit(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumn("share", F.col("n").cast("double"))
    return logit.choice_fits(rows, "source", "item", "klass", "share", ["quantity", "discount"], repeats=FIT_REPEATS)


@query
def source_logit(spark, sf_dir):
    rows = _candidates(spark, sf_dir).filter("source != 'N'")
    rows = d.distributions(rows.select("source", "item", "klass", "n")).join(_candidates(spark, sf_dir).select("source", "item", "klass", "quantity", "discount"), ["source", "item", "klass"])
    rows = rows.withColumn("task", F.lit("A or R")).withColumn("first", F.col("source") == "A")
    return logit.source_fits(rows, "task", "item", "first", "p", ["quantity", "discount"], repeats=FIT_REPEATS)


def _priority_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as the candidates of each nation, with mean price and share of late orders as features."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    cells = rows.groupBy(F.col("o_orderstatus").alias("source"), F.col("c_nationkey").alias("item"), F.col("o_orderpriority").alias("klass")).agg(F.count("*").alias("n"))
    about = rows.groupBy(F.col("c_nationkey").alias("item"), F.col("o_orderpriority").alias("klass")).agg((F.avg("o_totalprice") / 100_000).alias("price"), F.avg((F.year("o_orderdate") > 1996).cast("double")).alias("late"))
    return logit.choice_rows(cells, about, ["price", "late"])


@query
def revalidated_fits(spark, sf_dir):
    """Refits with validation in each draw, as tasks that a later run takes up where this one stopped."""
    from .source_queries import scratch

    rows, path = _priority_choices(spark, sf_dir), scratch(spark, "fits")
    fit = lambda r: logit.choice_fits(r, "source", "item", "klass", "share", ["price", "late"], repeats=40, validate=True)
    logit.resumed_fits(rows.filter("source = 'F'"), "source", "choice 40", path, fit)
    return logit.resumed_fits(rows, "source", "choice 40", path, fit).drop("fingerprint")


@query
def design_diagnostics(spark, sf_dir):
    return logit.design_diagnostics(_priority_choices(spark, sf_dir), "source", ["price", "late"])


@query
def fit_method(spark, sf_dir):
    """How the fits of each source are made, beside the fingerprint of what they are made from."""
    counts = _answers(spark, sf_dir).filter("klass is not null").groupBy("source", "item", "klass").agg(F.sum("n").alias("n"))
    method = logit.method()
    about = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(str(v)).alias("value")) for k, v in sorted(method.items())])).alias("m")
    marks = logit.fingerprints(counts, "source", json.dumps(method, sort_keys=True))
    return marks.select("source", "fingerprint", about).select("source", "fingerprint", "m.name", "m.value")


@query
def solver_arithmetic(spark, sf_dir):
    digits = table(spark, sf_dir, "part").select("p_partkey", F.transform(F.array(*[F.lit(k) for k in range(4)]), lambda k: ((F.col("p_partkey") * (k + 3) + F.col("p_size") * k) % 9 + 1).cast("int")).alias("numbers"))
    # Numbers in another order have the same solutions, so each set of numbers is solved once.
    digits = digits.select("p_partkey", F.array_sort("numbers").alias("numbers"))
    solve = lambda sets: sets.select("numbers", F.explode(puzzles.arithmetic_solutions("numbers", F.lit(24))).alias("expression"))
    return puzzles.solved_once(digits, "p_partkey", ["numbers"], solve).select("p_partkey", "expression")


@query
def solver_maze(spark, sf_dir):
    side = 5
    rows = table(spark, sf_dir, "part").select("p_partkey", F.transform(F.array(*[F.lit(r) for r in range(side)]), lambda r: F.array_join(F.transform(F.array(*[F.lit(c) for c in range(side)]), lambda c: F.when((r == 0) & (c == 0), "S").when((r == side - 1) & (c == side - 1), "G").when((F.col("p_partkey") * (r * 7 + c * 3 + 1)) % 5 == 0, "#").otherwise(".")), "")).alias("grid"))
    ends = [F.lit(v).alias(n) for n, v in (("start_r", 0), ("start_c", 0), ("goal_r", side - 1), ("goal_c", side - 1))]

    def solve(mazes: DataFrame) -> DataFrame:
        """Mazes with the same grid have the same paths and features."""
        found = puzzles.maze_features(mazes.select(F.col("grid").alias("puzzle_id"), F.explode(puzzles.maze_solutions("grid")).alias("moves"), *ends))
        return found.withColumnRenamed("puzzle_id", "grid")

    found = puzzles.solved_once(rows, "p_partkey", ["grid"], solve)
    return found.select(F.col("p_partkey").alias("puzzle_id"), *[c for c in found.columns if c not in ("p_partkey", "grid")])


@query
def arithmetic_features(spark, sf_dir):
    """Features of the solutions of each order of numbers, which is solved once and joined back to its parts."""
    numbers = F.transform(F.array(*[F.lit(k) for k in range(4)]), lambda k: ((F.col("p_partkey") * (k + 3) + F.col("p_size") * k) % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array_join(numbers, ",").alias("puzzle_id"))
    solve = lambda sets: puzzles.arithmetic_features(sets.select("puzzle_id", F.split("puzzle_id", ",").cast("array<int>").alias("numbers"), F.lit(24).alias("target")))
    return puzzles.solved_once(rows, "p_partkey", ["puzzle_id"], solve).drop("puzzle_id")
