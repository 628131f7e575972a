"""Queries of the study design, resampling by given draws, regression designs, puzzles and scoring, each with its SQL.

Draws are made by a formula in both, so that a resampled interval has an exact counterpart in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions import answers as a
from tallygrid.functions import metrics as m
from tallygrid.operators import distributions as d
from tallygrid.operators import generation, geometry, inference, integrity, logit, ordering, puzzles, scoring, study

from .tables import DENSE_SQL, ORDERS_SQL, orders, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


@query("SELECT r AS n_regionkey, round(avg(v), 6) AS c_acctbal FROM (SELECT n_regionkey AS r, n_nationkey, avg(v) AS v FROM (SELECT c_nationkey, c_mktsegment, avg(c_acctbal) AS v FROM customer GROUP BY ALL) JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY ALL")
def nested_means(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    return rounded(study.nested_means(rows, ["n_regionkey"], ["n_nationkey", "c_mktsegment"], "c_acctbal"), "c_acctbal")


@query("SELECT c_mktsegment, count(c_acctbal) AS n, round(stddev_samp(c_acctbal), 6) AS sd FROM customer GROUP BY ALL")
def sample_spread(spark, sf_dir):
    return rounded(study.spread(table(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal"), "sd")


_P = "CAST((p_partkey * 7919) % 9973 + 1 AS DOUBLE) / 9974"


@query(
    f"""WITH t AS (SELECT p_partkey, p_brand, {_P} AS p FROM part), r AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS m, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS k FROM t),
 h AS (SELECT p_brand, p, max(least(1.0, (m - k + 1) * p)) OVER (PARTITION BY p_brand ORDER BY k) AS q FROM r)
 SELECT p_brand, round(avg(p), 6) AS mean_p, count(*) FILTER (p < 0.05) AS n_p, count(*) FILTER (q <= 0.05) AS n_holm, count(*) AS n FROM h GROUP BY ALL"""
)
def significance_rollup(spark, sf_dir):
    tests = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.expr(_P).alias("p"))
    return rounded(study.significance(ordering.holm(tests, "p", ["p_partkey"], ["p_brand"]), ["p_brand"]), "mean_p")


@query("SELECT o_orderpriority, CASE WHEN o_totalprice > 200000 THEN 'stalled' ELSE 'converged' END AS status, count(*) AS n FROM orders GROUP BY ALL")
def fit_statuses(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("status", F.when(F.col("o_totalprice") > 200000, "stalled").otherwise("converged"))
    return study.status_counts(rows, "status", ["o_orderpriority"])


_MASS = "least(1.0, l_discount * 10 + CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END)"


@query(
    f"""WITH g AS (SELECT l_returnflag, {_MASS} AS p, l_tax * 10 AS q FROM lineitem), h AS (SELECT l_returnflag, CASE WHEN greatest(0, 1 - p) > 1e-12 THEN (q - p) / (1 - p) END AS g FROM g)
 SELECT l_returnflag, round(avg(g), 6) AS gain, count(g) AS n, count(*) FILTER (g IS NULL) AS at_target FROM h GROUP BY ALL"""
)
def directional_gain(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.expr(_MASS).alias("p"), (F.col("l_tax") * 10).alias("q"))
    return rounded(study.gains(rows, ["l_returnflag"], F.col("p"), F.col("q")), "gain")


@query("SELECT p_partkey, round(CASE WHEN c - 0.25 > 1e-12 THEN (p_retailprice / 2000 - 0.25) / (c - 0.25) ELSE 0 END, 6) AS share FROM (SELECT *, CASE WHEN p_size % 5 = 0 THEN 0.25 ELSE p_size / 50.0 END AS c FROM part)")
def chance_to_ceiling(spark, sf_dir):
    ceiling = F.when(F.col("p_size") % 5 == 0, 0.25).otherwise(F.col("p_size") / 50.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(m.chance_to_ceiling(F.col("p_retailprice") / 2000, F.lit(0.25), ceiling), 6).alias("share"))


_ITEM = "'p' || (p_partkey % 40) || CASE p_partkey % 4 WHEN 0 THEN '_NO_PRIME' WHEN 1 THEN '_REL' WHEN 2 THEN '_CTRL' ELSE '' END"


@query(
    f"""SELECT item, CASE WHEN coalesce(module, 'main') = 'main' THEN item ELSE regexp_replace(item, '_(NO_PRIME|REL|CTRL)$', '') END AS cluster,
 CASE WHEN coalesce(module, 'main') = 'main' THEN 'main' ELSE 'module' END || '/' || coalesce(module, 'main') || '/' || family AS cluster_stratum
 FROM (SELECT {_ITEM} AS item, CASE WHEN p_size > 25 THEN 'transfer' END AS module, p_brand AS family FROM part)"""
)
def stimulus_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.expr(_ITEM).alias("item"), F.when(F.col("p_size") > 25, "transfer").alias("module"), F.col("p_brand").alias("family"))
    return study.clusters(rows, "item", "module", "family")


@query(
    f"""WITH {ORDERS_SQL}, {DENSE_SQL}, t AS (SELECT DISTINCT item, stratum, min(item) OVER (PARTITION BY stratum) AS first FROM obs),
 pr AS (SELECT b.stratum AS block, b.first AS reference, b.item AS perturbed FROM t b WHERE b.item <> b.first)
 SELECT l.source, 'spatial' AS module, pr.block, pr.reference, pr.perturbed, round(0.5 * sum(abs(coalesce(l.p, 0) - coalesce(r.p, 0))), 6) AS tv
 FROM pr JOIN (SELECT DISTINCT source, klass FROM (SELECT DISTINCT source FROM dist), (SELECT DISTINCT klass FROM dist)) k ON true
 LEFT JOIN dist l ON l.item = pr.reference AND l.source = k.source AND l.klass = k.klass LEFT JOIN dist r ON r.item = pr.perturbed AND r.source = k.source AND r.klass = k.klass
 WHERE EXISTS (SELECT 1 FROM src s WHERE s.source = k.source AND s.item = pr.reference) AND EXISTS (SELECT 1 FROM src s WHERE s.source = k.source AND s.item = pr.perturbed) AND l.source IS NOT NULL
 GROUP BY ALL"""
)
def arm_effects(spark, sf_dir):
    """Each region is a block: its first nation is the original, the others are perturbed."""
    from pyspark.sql import Window

    rows = orders(spark, sf_dir)
    items = rows.select("item", "stratum").distinct().withColumn("first", F.min("item").over(Window.partitionBy("stratum")))
    trials = items.select(F.col("item").alias("trial"), F.lit("spatial").alias("module"), F.col("stratum").alias("block"), F.lit(None).cast("string").alias("condition"), F.when(F.col("item") == F.col("first"), "original").otherwise("mirror").alias("role"))
    effects = study.arm_effects(study.comparisons(trials), d.distributions(d.class_counts(rows)))
    return rounded(effects.select("source", "module", "block", "reference", "perturbed", "tv"), "tv")


# Draws by formula: replicate, and place within a stratum of n clusters.
_REPS = 40


def _drawn(numbered: DataFrame) -> DataFrame:
    """(rep, index, times): replicate r draws, for the k-th cluster of a stratum of n from place f on, the one at (r*r*31 + k*17 + r*k*7) % n."""
    from pyspark.sql import Window

    placed = numbered.withColumns({"n": F.count("*").over(Window.partitionBy("stratum")), "f": F.min("index").over(Window.partitionBy("stratum"))}).withColumn("k", F.col("index") - F.col("f"))
    rows = placed.select("n", "f", "k", F.explode(F.sequence(F.lit(0), F.lit(_REPS - 1))).alias("rep"))
    return rows.groupBy("rep", (F.col("f") + (F.col("rep") * F.col("rep") * 31 + F.col("k") * 17 + F.col("rep") * F.col("k") * 7) % F.col("n")).alias("index")).agg(F.count("*").alias("times"))


_NATIONS_SQL = f"""v AS (SELECT o_orderstatus AS source, n_regionkey AS stratum, n_nationkey AS cluster, avg(o_totalprice) / 1000 AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
 c AS (SELECT stratum, cluster, row_number() OVER (PARTITION BY stratum ORDER BY cluster) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS n FROM (SELECT DISTINCT stratum, cluster FROM v)),
 dr AS (SELECT rep, c.stratum, (rep * rep * 31 + k * 17 + rep * k * 7) % n AS pick FROM c, range({_REPS}) r(rep)),
 pk AS (SELECT dr.rep, dr.stratum, t.cluster FROM dr JOIN c t ON t.stratum = dr.stratum AND t.k = dr.pick)"""


def _nation_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    return rows.groupBy(F.col("o_orderstatus").alias("source"), F.col("n_regionkey").alias("stratum"), F.col("n_nationkey").alias("cluster")).agg((F.avg("o_totalprice") / 1000).alias("value"))


@query(
    f"""WITH {_NATIONS_SQL}, mm AS (SELECT source, rep, avg(value) AS m FROM pk JOIN v USING (stratum, cluster) GROUP BY ALL)
 SELECT source, round((SELECT avg(value) FROM v WHERE v.source = mm.source), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS replicates FROM mm GROUP BY source"""
)
def cluster_interval(spark, sf_dir):
    values = _nation_values(spark, sf_dir)
    numbered, _ = inference.numbered_clusters(values)
    return rounded(inference.summarised(values, numbered, _drawn(numbered), ["source"], False), "mean", "low", "high")


@query(
    f"""WITH {_NATIONS_SQL}, ms AS (SELECT source, rep, stratum, avg(value) AS m FROM pk JOIN v USING (stratum, cluster) GROUP BY ALL), mm AS (SELECT source, rep, avg(m) AS m FROM ms GROUP BY ALL)
 SELECT source, round((SELECT avg(x) FROM (SELECT avg(value) AS x FROM v WHERE v.source = mm.source GROUP BY stratum)), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, count(*) AS replicates FROM mm GROUP BY source"""
)
def equal_family_interval(spark, sf_dir):
    values = _nation_values(spark, sf_dir)
    numbered, _ = inference.numbered_clusters(values)
    return rounded(inference.summarised(values, numbered, _drawn(numbered), ["source"], True), "mean", "low", "high")


@query(
    f"""WITH {_NATIONS_SQL}, x AS (SELECT source, rep, stratum, value FROM pk JOIN v USING (stratum, cluster)), w AS (SELECT source, rep, avg(value) AS whole FROM x GROUP BY ALL),
 mm AS (SELECT source, rep, stratum, avg(value) - any_value(whole) AS m FROM x JOIN w USING (source, rep) GROUP BY ALL),
 pt AS (SELECT source, stratum, avg(value - whole) AS mean FROM (SELECT source, stratum, value, avg(value) OVER (PARTITION BY source) AS whole FROM v) GROUP BY ALL)
 SELECT source, stratum, round(any_value(mean), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM mm JOIN pt USING (source, stratum) GROUP BY ALL"""
)
def recentred_interval(spark, sf_dir):
    values = _nation_values(spark, sf_dir)
    numbered, _ = inference.numbered_clusters(values)
    return rounded(inference.recentred_summary(values, _drawn(numbered), numbered), "mean", "low", "high")


@query(
    """WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, c_mktsegment AS key FROM orders JOIN customer ON o_custkey = c_custkey)
 SELECT key, a, b, CAST(row_number() OVER (PARTITION BY key ORDER BY a, b) AS BIGINT) AS place FROM c"""
)
def canonical_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    cells = rows.groupBy(F.col("c_mktsegment").alias("key"), F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b")).agg(F.count("*").alias("n"))
    return inference.canonical_pairs(cells, ["key"])


@query(
    """SELECT n_nationkey, CAST(('0x' || substr(h, 15, 2) || substr(h, 13, 2) || substr(h, 11, 2) || substr(h, 9, 2) || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::UBIGINT AS VARCHAR) AS seed
 FROM (SELECT n_nationkey, sha256(n_name || '|' || n_regionkey) AS h FROM nation)"""
)
def seed_numbers(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", inference.seed_of(F.col("n_name"), F.col("n_regionkey").cast("string")).cast("string").alias("seed"))


_ARM_SQL = """a AS (SELECT o_orderstatus AS source, n_regionkey AS family, n_nationkey AS block, CASE WHEN o_orderpriority < '3' THEN 'related' ELSE 'unrelated' END AS arm, avg(o_totalprice) / 400000 AS v, avg(CASE WHEN year(o_orderdate) > 1996 THEN 1.0 ELSE 0 END) AS p
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    keys = (F.col("o_orderstatus").alias("source"), F.col("n_regionkey").alias("family"), F.col("n_nationkey").alias("block"), F.when(F.col("o_orderpriority") < "3", "related").otherwise("unrelated").alias("arm"))
    return rows.groupBy(*keys).agg((F.avg("o_totalprice") / 400000).alias("v"), F.avg((F.year("o_orderdate") > 1996).cast("double")).alias("p"))


@query(f"""WITH {_ARM_SQL} SELECT source, block, round(max(v) FILTER (arm = 'related') - max(v) FILTER (arm = 'unrelated'), 6) AS difference FROM a GROUP BY ALL HAVING difference IS NOT NULL""")
def arm_contrasts(spark, sf_dir):
    return rounded(study.contrasts(_arms(spark, sf_dir), ["source", "block"], "arm", "related", "unrelated", "v").select("source", "block", "difference"), "difference")


@query(
    f"""WITH {_ARM_SQL}, b AS (SELECT source, block, family, max(v) FILTER (arm = 'related') AS related, max(v) FILTER (arm = 'unrelated') AS unrelated, max(p) FILTER (arm = 'related') AS p FROM a GROUP BY ALL HAVING related IS NOT NULL AND unrelated IS NOT NULL),
 f AS (SELECT source, family, avg(related) AS related, avg(unrelated) AS unrelated, avg(related - unrelated) AS difference, avg(CASE WHEN 1 - p > 1e-12 THEN (related - p) / (1 - p) END) AS change, count(*) AS n FROM b GROUP BY ALL),
 u AS (SELECT source, CAST(family AS VARCHAR) AS family, related, unrelated, difference, change, n FROM f UNION ALL SELECT source, 'Mean', avg(related), avg(unrelated), avg(difference), avg(change), sum(n) FROM f GROUP BY source)
 SELECT source, family, round(related, 6) AS related, round(unrelated, 6) AS unrelated, round(difference, 6) AS difference, round(change, 6) AS change, CAST(n AS BIGINT) AS n FROM u"""
)
def context_table(spark, sf_dir):
    out = study.context_table(_arms(spark, sf_dir), ["source"], "block", "family", "arm", "v", "p")
    return rounded(out.select("source", "family", "related", "unrelated", "difference", "change", "n"), "related", "unrelated", "difference", "change")


@query(
    f"""WITH {_ARM_SQL}, x AS (SELECT source, family, block, arm, v AS movement, v - p AS gain, p FROM a),
 y AS (SELECT source, 'movement' AS metric, family, block, movement AS value FROM x UNION ALL SELECT source, 'movement_' || arm, family, block, movement FROM x UNION ALL SELECT source, 'gain', family, block, gain FROM x
  UNION ALL SELECT source, 'normalized_gain', family, block, gain / (1 - p) FROM x WHERE p <> 1)
 SELECT source, metric, round(avg(value), 6) AS value FROM (SELECT source, metric, family, avg(value) AS value FROM (SELECT source, metric, family, block, avg(value) AS value FROM y GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"""
)
def module_summaries(spark, sf_dir):
    rows = _arms(spark, sf_dir).withColumn("gain", F.col("v") - F.col("p"))
    return rounded(study.module_summaries(rows, ["source"], "block", "family", "arm", "v", "gain", "p"), "value")


def _interval_sql(values: str, families: bool) -> str:
    """Means over families and their percentile intervals over the draws made by formula, of values (source, metric, stratum, cluster, value)."""
    own = """ UNION ALL SELECT source, metric, CAST(stratum AS VARCHAR), (SELECT avg(value) FROM vals v WHERE v.source = ms.source AND v.metric = ms.metric AND v.stratum = ms.stratum), quantile_cont(m, 0.025), quantile_cont(m, 0.975), count(*) FROM ms GROUP BY source, metric, stratum"""
    return f"""WITH {_ARM_SQL}, {values},
 c AS (SELECT stratum, cluster, row_number() OVER (PARTITION BY stratum ORDER BY cluster) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS n FROM (SELECT DISTINCT stratum, cluster FROM vals)),
 pk AS (SELECT d.rep, d.stratum, t.cluster FROM (SELECT rep, stratum, (rep * rep * 31 + k * 17 + rep * k * 7) % n AS pick FROM c, range({_REPS}) r(rep)) d JOIN c t ON t.stratum = d.stratum AND t.k = d.pick),
 ms AS (SELECT source, metric, rep, stratum, avg(value) AS m FROM pk JOIN vals USING (stratum, cluster) GROUP BY ALL), mm AS (SELECT source, metric, rep, avg(m) AS m FROM ms GROUP BY ALL),
 t AS (SELECT source, metric, 'Mean' AS family, (SELECT avg(x) FROM (SELECT avg(value) AS x FROM vals v WHERE v.source = mm.source AND v.metric = mm.metric GROUP BY stratum)) AS mean, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high, count(*) AS replicates FROM mm GROUP BY source, metric{own if families else ""})
 SELECT source, metric, family, round(mean, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high, replicates FROM t"""


@query(
    _interval_sql(
        """b AS (SELECT source, block, family, max(v) FILTER (arm = 'related') AS related, max(v) FILTER (arm = 'unrelated') AS unrelated, max(p) FILTER (arm = 'related') AS p FROM a GROUP BY ALL HAVING related IS NOT NULL AND unrelated IS NOT NULL),
 vals AS (SELECT source, family AS stratum, block AS cluster, metric, CASE metric WHEN 'related' THEN related WHEN 'unrelated' THEN unrelated WHEN 'difference' THEN related - unrelated WHEN 'change' THEN CASE WHEN 1 - p > 1e-12 THEN (related - p) / (1 - p) END END AS value FROM b, (VALUES ('related'), ('unrelated'), ('difference'), ('change')) m(metric))""",
        True,
    )
)
def context_intervals(spark, sf_dir):
    """The context table's means with intervals over drawn blocks, by family and in mean."""
    values = study.context_values(_arms(spark, sf_dir), ["source"], "block", "family", "arm", "v", "p")
    return rounded(study.with_intervals(values, ["source"], _drawn), "mean", "low", "high")


@query(_interval_sql("vals AS (SELECT source, family AS stratum, block AS cluster, 'related-unrelated' AS metric, max(v) FILTER (arm = 'related') - max(v) FILTER (arm = 'unrelated') AS value FROM a GROUP BY source, family, block HAVING max(v) FILTER (arm = 'related') - max(v) FILTER (arm = 'unrelated') IS NOT NULL)", False))
def contrast_intervals(spark, sf_dir):
    """The contrast of two arms with its interval."""
    values = study.contrast_values(_arms(spark, sf_dir), ["source"], "block", "family", "arm", [("related", "unrelated")], "v")
    return rounded(study.with_intervals(values, ["source"], _drawn, families=False), "mean", "low", "high")


@query(
    _interval_sql(
        """y AS (SELECT source, 'movement' AS metric, family, block, v AS value FROM a UNION ALL SELECT source, 'movement_' || arm, family, block, v FROM a UNION ALL SELECT source, 'gain', family, block, v - p FROM a
  UNION ALL SELECT source, 'normalized_gain', family, block, (v - p) / (1 - p) FROM a WHERE p <> 1),
 vals AS (SELECT source, metric, family AS stratum, block AS cluster, avg(value) AS value FROM y GROUP BY ALL)""",
        False,
    )
)
def module_intervals(spark, sf_dir):
    """The module summaries with intervals over drawn blocks."""
    rows = _arms(spark, sf_dir).withColumn("gain", F.col("v") - F.col("p"))
    values = study.module_values(rows, ["source"], "block", "family", "arm", "v", "gain", "p")
    return rounded(study.with_intervals(values, ["source"], _drawn, families=False), "mean", "low", "high")


@query(
    """WITH t AS (SELECT p_brand, count(*) AS have, CAST(right(p_brand, 1) AS INTEGER) * 2 AS target FROM part GROUP BY ALL), b AS (SELECT *, least(target, have) AS base FROM t),
 c AS (SELECT *, have - base AS spare, sum(have - base) OVER (ORDER BY target - base DESC, have DESC, p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, sum(base) OVER () AS given FROM b)
 SELECT p_brand, CAST(base + least(spare, greatest(0, 150 - given - coalesce(before, 0))) AS BIGINT) AS chosen FROM c"""
)
def rebalanced_targets(spark, sf_dir):
    strata = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("have")).withColumn("target", (F.expr("right(p_brand, 1)").cast("int") * 2).cast("long"))
    return ordering.rebalanced(strata, "p_brand", "target", "have", 150).select("p_brand", F.col("chosen").cast("long").alias("chosen"))


@query(
    """WITH b AS (SELECT p_brand AS block, CASE WHEN p_partkey % 2 = 0 THEN 'cue' ELSE 'other' END AS module, CASE p_size % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'cued' ELSE 'late' END AS condition, p_type FROM part),
 g AS (SELECT module, block, count(*) AS n, count(DISTINCT condition) AS k, max(CASE WHEN condition = 'baseline' THEN 1 ELSE 0 END) AS base, max(CASE WHEN condition = 'cued' THEN 1 ELSE 0 END) AS cued, max(CASE WHEN condition = 'late' THEN 1 ELSE 0 END) AS late, count(DISTINCT p_type) AS types FROM b GROUP BY ALL)
 SELECT module, block, unnest(list_filter([CASE WHEN module <> 'cue' THEN 'unknown_module' END, CASE WHEN module = 'cue' AND base + cued < 2 THEN 'missing_arm' END, CASE WHEN module = 'cue' AND late > 0 THEN 'unknown_arm' END, CASE WHEN n > k THEN 'repeated_arm' END, CASE WHEN types > 1 THEN 'varying_type' END], lambda x: x IS NOT NULL)) AS problem FROM g"""
)
def design_problems(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("block"), F.when(F.col("p_partkey") % 2 == 0, "cue").otherwise("other").alias("module"), F.element_at(F.array(*map(F.lit, ("baseline", "cued", "late"))), F.col("p_size") % 3 + 1).alias("condition"), "p_type")
    return study.design_problems(rows, {"cue": ["baseline", "cued"]}, {"p_type": "varying_type"})


_CHOICE_SQL = """cat AS (SELECT c_nationkey AS item, o_orderpriority AS klass, avg(o_totalprice) / 100000 AS price, avg(CASE WHEN year(o_orderdate) > 1996 THEN 1.0 ELSE 0 END) AS late FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
 cnt AS (SELECT o_orderstatus AS source, c_nationkey AS item, o_orderpriority AS klass, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority <> '5-LOW' GROUP BY ALL),
 ch AS (SELECT t.source, t.item, k.klass, k.price, k.late, coalesce(c.n, 0) / t.total AS share FROM (SELECT source, item, sum(n) AS total FROM cnt GROUP BY ALL) t JOIN cat k USING (item) LEFT JOIN cnt c ON c.source = t.source AND c.item = t.item AND c.klass = k.klass)"""


def _choices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Observed counts under the listed conditions, and the catalog of candidates with features."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
    catalog = rows.groupBy(F.col("c_nationkey").alias("item"), F.col("o_orderpriority").alias("klass")).agg((F.avg("o_totalprice") / 100000).alias("price"), F.avg((F.year("o_orderdate") > 1996).cast("double")).alias("late"))
    listed = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",), ("4-NOT SPECIFIED",)], "o_orderpriority string")
    answers = rows.select("o_orderpriority", F.col("o_orderstatus").alias("source"), F.col("c_nationkey").alias("item"), F.col("o_orderpriority").alias("klass"))
    return logit.observations(answers, listed, catalog, ["o_orderpriority"]), catalog


@query(f"WITH {_CHOICE_SQL} SELECT source, item, klass, n FROM cnt")
def observed_counts(spark, sf_dir):
    return _choices(spark, sf_dir)[0]


@query(f"WITH {_CHOICE_SQL} SELECT source, item, klass, round(price, 6) AS price, round(late, 6) AS late, round(share, 6) AS share FROM ch")
def choice_design(spark, sf_dir):
    return rounded(logit.choice_rows(*_choices(spark, sf_dir), ["price", "late"]), "price", "late", "share")


@query(
    f"""WITH {_CHOICE_SQL}, b AS (SELECT item FROM cnt WHERE source IN ('F', 'O') GROUP BY item HAVING count(DISTINCT source) = 2)
 SELECT item, klass, CASE WHEN source = 'F' THEN 1 ELSE 0 END AS y, round(n / sum(n) OVER (PARTITION BY item, source), 6) AS w FROM cnt JOIN b USING (item) WHERE source IN ('F', 'O')"""
)
def source_design(spark, sf_dir):
    return rounded(logit.source_rows(_choices(spark, sf_dir)[0], "F", "O"), "w")


@query(
    f"""WITH {_CHOICE_SQL}, x AS (SELECT source, item, klass, CASE WHEN item % 3 = 0 THEN 0.7 ELSE price END AS price FROM ch), v AS (SELECT *, max(price) OVER (PARTITION BY source, item) > min(price) OVER (PARTITION BY source, item) AS varies FROM x)
 SELECT source, item, klass, round(CASE WHEN varies THEN price ELSE coalesce(avg(CASE WHEN varies THEN price END) OVER (PARTITION BY source), 0.5) END, 6) AS price FROM v"""
)
def constant_features(spark, sf_dir):
    rows = logit.choice_rows(*_choices(spark, sf_dir), ["price"]).withColumn("price", F.when(F.col("item") % 3 == 0, 0.7).otherwise(F.col("price")))
    return rounded(logit.filled(rows, ["source"], ["price"]).select("source", "item", "klass", "price"), "price")


@query(f"WITH {_CHOICE_SQL}, e AS (SELECT *, exp(0.8 * price - 0.5 * late) AS e FROM ch) SELECT source, item, klass, round(e / sum(e) OVER (PARTITION BY source, item), 6) AS probability FROM e")
def choice_probabilities(spark, sf_dir):
    rows = logit.shares_at(logit.choice_rows(*_choices(spark, sf_dir), ["price", "late"]), ["source"], {"price": 0.8, "late": -0.5})
    return rounded(rows.select("source", "item", "klass", "probability"), "probability")


@query(
    f"""WITH {_CHOICE_SQL}, e AS (SELECT *, exp(0.8 * price - 0.5 * late) / sum(exp(0.8 * price - 0.5 * late)) OVER (PARTITION BY source, item) AS p FROM ch),
 i AS (SELECT source, item, sum(-share * ln(p)) AS loss, sum(price * (p - share)) AS g1, sum(late * (p - share)) AS g2 FROM e GROUP BY ALL)
 SELECT source, count(*) AS items, round(avg(loss) + 0.0001 / 2 * (0.64 + 0.25), 6) AS objective, round(greatest(abs(avg(g1) + 0.0001 * 0.8), abs(avg(g2) - 0.0001 * 0.5)), 6) AS gradient FROM i GROUP BY ALL"""
)
def choice_objective(spark, sf_dir):
    out = logit.objective_at(logit.choice_rows(*_choices(spark, sf_dir), ["price", "late"]), ["source"], {"price": 0.8, "late": -0.5})
    return rounded(out, "objective", "gradient")


def _newton_sql(steps: int) -> str:
    """Whole Newton steps of two slopes from 0 on, a few tables for each step."""
    out = [_CHOICE_SQL, "b0 AS (SELECT DISTINCT source, 0.0 AS x, 0.0 AS y FROM ch)"]
    for k in range(steps):
        out += [
            f"e{k} AS (SELECT ch.*, exp(x * price + y * late) AS e FROM ch JOIN b{k} USING (source))",
            f"p{k} AS (SELECT source, item, price, late, share, e / sum(e) OVER (PARTITION BY source, item) AS p FROM e{k})",
            f"""i{k} AS (SELECT source, item, sum(price * (p - share)) AS g, sum(late * (p - share)) AS h, sum(p * price * price) - sum(p * price) ** 2 AS a, sum(p * price * late) - sum(p * price) * sum(p * late) AS c,
  sum(p * late * late) - sum(p * late) ** 2 AS d FROM p{k} GROUP BY ALL)""",
            f"t{k} AS (SELECT source, x, y, avg(g) + 0.0001 * x AS g, avg(h) + 0.0001 * y AS h, avg(a) + 0.0001 AS a, avg(c) AS c, avg(d) + 0.0001 AS d FROM i{k} JOIN b{k} USING (source) GROUP BY source, x, y)",
            f"b{k + 1} AS (SELECT source, x - (d * g - c * h) / (a * d - c * c) AS x, y - (a * h - c * g) / (a * d - c * c) AS y FROM t{k})",
        ]
    return "WITH " + ",\n ".join(out) + f" SELECT source, unnest(['price', 'late']) AS feature, round(unnest([x, y]), 6) AS coefficient FROM b{steps}"


@query(_newton_sql(2))
def newton_steps(spark, sf_dir):
    """The fits of the choice regression after two steps."""
    out = logit.stepped(logit.choice_rows(*_choices(spark, sf_dir), ["price", "late"]), "source", "item", "klass", "share", ["price", "late"], 2)
    return rounded(out.select("source", "feature", "coefficient"), "coefficient")


@query(
    f"""WITH {_CHOICE_SQL}, s AS (SELECT source, item, count(*) AS n, sum(price * price) AS pp, sum(price * late) AS pl, sum(late * late) AS ll, avg(price) AS mp, avg(late) AS ml FROM ch GROUP BY ALL)
 SELECT source, item, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(CASE WHEN i = 0 AND j = 0 THEN pp / n - mp * mp WHEN i = 1 AND j = 1 THEN ll / n - ml * ml ELSE pl / n - mp * ml END, 6) AS value FROM s, range(2) a(i), range(2) b(j)"""
)
def uniform_information(spark, sf_dir):
    rows = logit.choice_rows(*_choices(spark, sf_dir), ["price", "late"])
    return rounded(logit.uniform_information(rows, ["source"], ["price", "late"]), "value")


# Three distinct cells of a 5 x 5 board for each part, one in each of three rows.
_CELL = "CAST((p_partkey * ({k} + 3) + {k} * {k}) % 5 + 1 AS INTEGER)"


@query(
    f"""WITH c AS (SELECT p_brand AS puzzle_id, p_partkey AS placement_id, k, {_CELL.format(k="k")} AS col FROM part, range(4) r(k)), n AS (SELECT p_brand AS puzzle_id, count(*) AS total FROM part GROUP BY ALL),
 o AS (SELECT puzzle_id, k, col, count(*) AS often FROM c GROUP BY ALL), r AS (SELECT c.puzzle_id, placement_id, avg(-ln(often / total)) AS rarity FROM c JOIN o USING (puzzle_id, k, col) JOIN n USING (puzzle_id) GROUP BY ALL),
 x AS (SELECT a.placement_id, count(*) AS inv FROM c a JOIN c b ON a.placement_id = b.placement_id AND a.k < b.k AND b.col < a.col GROUP BY ALL),
 s AS (SELECT placement_id, k, sign(col - lag(col) OVER (PARTITION BY placement_id ORDER BY k)) AS s FROM c), t AS (SELECT placement_id, sum(CASE WHEN s <> prev THEN 1 ELSE 0 END) AS changes FROM (SELECT placement_id, s, lag(s) OVER (PARTITION BY placement_id ORDER BY k) AS prev FROM s) GROUP BY ALL)
 SELECT r.puzzle_id, r.placement_id, round(rarity, 6) AS rarity, round(least(coalesce(inv, 0), 6 - coalesce(inv, 0)) / 6, 6) AS disorder, round(changes / 2, 6) AS changes FROM r LEFT JOIN x USING (placement_id) JOIN t USING (placement_id)"""
)
def rook_features(spark, sf_dir):
    cells = F.array(*[F.array(F.lit(k), F.expr(_CELL.format(k=k))) for k in range(4)])
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("puzzle_id"), F.col("p_partkey").alias("placement_id"), cells.alias("cells"))
    return rounded(puzzles.rook_features(rows), "rarity", "disorder", "changes")


@query(
    """WITH p AS (SELECT p_partkey, CASE WHEN (p_partkey * 7 + k * 3) % 11 < 3 THEN CAST((p_partkey + k) % 4 + 1 AS VARCHAR) ELSE '.' END AS x, CAST(k // 4 AS INTEGER) AS r, CAST(k % 4 AS INTEGER) AS c FROM part, range(16) t(k)),
 b AS (SELECT a.p_partkey AS puzzle_id, a.r + 1 AS r, a.c + 1 AS c, (a.r // 2) * 2 + a.c // 2 AS box FROM p a WHERE a.x = '.' AND NOT EXISTS (SELECT 1 FROM p o WHERE o.p_partkey = a.p_partkey AND o.x = '1' AND (o.r = a.r OR o.c = a.c OR (o.r // 2 = a.r // 2 AND o.c // 2 = a.c // 2))))
 SELECT puzzle_id, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, CAST(least(count(*) OVER (PARTITION BY puzzle_id, r), count(*) OVER (PARTITION BY puzzle_id, c), count(*) OVER (PARTITION BY puzzle_id, box)) AS BIGINT) AS least_targets FROM b"""
)
def sudoku_cells(spark, sf_dir):
    """The cells of a 4 x 4 board where a 1 may go, and the fewest such cells of a cell's row, column and box."""
    mark = lambda k: F.when((F.col("p_partkey") * 7 + k * 3) % 11 < 3, ((F.col("p_partkey") + k) % 4 + 1).cast("string")).otherwise(".")
    board = F.array(*[F.concat(*[mark(4 * r + c) for c in range(4)]) for r in range(4)])
    cells = puzzles.legal_cells(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("puzzle_id"), board.alias("board")), "1", 2, 2)
    return puzzles.sudoku_features(cells).select("puzzle_id", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("least_targets").cast("long").alias("least_targets"))


_MOVES = "CASE WHEN p_size % 3 = 0 THEN 'DDRR' WHEN p_size % 3 = 1 THEN 'RDRD' ELSE 'RRDD' END"


@query(
    f"""WITH w AS (SELECT DISTINCT p_brand AS puzzle_id, {_MOVES} AS moves FROM part), s AS (SELECT puzzle_id, moves, k, moves[k] AS m, sum(CASE WHEN moves[k] = 'D' THEN 1 ELSE 0 END) OVER q AS r, sum(CASE WHEN moves[k] = 'R' THEN 1 ELSE 0 END) OVER q AS c
  FROM w, range(1, 5) t(k) WINDOW q AS (PARTITION BY puzzle_id, moves ORDER BY k)),
 e AS (SELECT *, count(*) OVER (PARTITION BY puzzle_id, r, c, m) - 1 AS load, abs(r - 2) + abs(c - 2) AS away, CASE WHEN lag(m) OVER (PARTITION BY puzzle_id, moves ORDER BY k) <> m THEN 1 ELSE 0 END AS turn FROM s),
 d AS (SELECT *, away - avg(away) OVER (PARTITION BY puzzle_id, k) AS centred FROM e), f AS (SELECT puzzle_id, moves, CAST(sum(turn) AS DOUBLE) AS turns, avg(load) AS shared, avg(centred) AS distance FROM d GROUP BY ALL)
 SELECT puzzle_id, moves, round(turns, 6) AS turns, round(shared, 6) AS shared, round(CASE WHEN max(turns) OVER z - min(turns) OVER z > 1e-12 THEN (turns - min(turns) OVER z) / (max(turns) OVER z - min(turns) OVER z) ELSE 0 END, 6) AS turns_scaled FROM f WINDOW z AS (PARTITION BY puzzle_id)"""
)
def path_features(spark, sf_dir):
    paths = table(spark, sf_dir, "part").select(F.col("p_brand").alias("puzzle_id"), F.expr(_MOVES).alias("moves"), *[F.lit(v).alias(n) for n, v in (("start_r", 0), ("start_c", 0), ("goal_r", 2), ("goal_c", 2))]).distinct()
    return rounded(puzzles.maze_features(paths).select("puzzle_id", "moves", "turns", "shared", "turns_scaled"), "turns", "shared", "turns_scaled")


@query(
    """SELECT p_partkey, CASE WHEN text LIKE '%=%24%' THEN trim(split_part(text, '=', 1)) ELSE text END AS value, 'high' AS confidence FROM (SELECT p_partkey, '(' || p_size || '+' || p_partkey || ')*2' || CASE WHEN p_partkey % 2 = 0 THEN ' = 24' ELSE '' END AS text FROM part)"""
)
def expression_extract(spark, sf_dir):
    text = F.expr("concat('(', p_size, '+', p_partkey, ')*2', CASE WHEN p_partkey % 2 = 0 THEN ' = 24' ELSE '' END)")
    found = a.expression(text)
    return table(spark, sf_dir, "part").select("p_partkey", found["value"].alias("value"), found["confidence"].alias("confidence"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name ELSE '' END AS first, CASE p_partkey % 4 WHEN 0 THEN p_type WHEN 1 THEN '' WHEN 2 THEN p_type ELSE '' END AS second,
 CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence FROM part"""
)
def sequence_parts(spark, sf_dir):
    """Two answers by labels, one label alone, two lines, and one line."""
    text = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('Puzzle A: ', p_name, chr(10), 'B - ', p_type) WHEN 1 THEN concat('A: ', p_name) WHEN 2 THEN concat(p_name, chr(10), chr(10), ' ', p_type) ELSE p_brand END")
    found = a.sequence_parts(text, F.lit(2))
    return table(spark, sf_dir, "part").select("p_partkey", found["answers"][0].alias("first"), found["answers"][1].alias("second"), found["confidence"].alias("confidence"))


_R, _C = "CAST((p_partkey * ({k} + 2) + {k} * {k}) % 5 AS INTEGER)", "CAST((p_partkey * ({k} + 5) + 3 * {k}) % 5 AS INTEGER)"
_RS, _CS = (f"[{', '.join(x.format(k=k) for k in range(3))}]" for x in (_R, _C))
_TEXT = "concat('ANSWER: ', " + ", ', ', ".join(f"'(', {_R.format(k=k)}, ',', {_C.format(k=k)}, ')'" for k in range(2)) + f", CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat(', (', {_R.format(k=2)}, ',', {_C.format(k=2)}, ')') END)"


@query(
    f"""WITH x AS (SELECT p_partkey, {_RS} AS rs, {_CS} AS cs FROM part), y AS (SELECT *, list_transform([1, 2, 3], lambda k: rs[k] || ',' || cs[k]) AS cells,
  list_filter(list_transform([1, 2, 3], lambda k: CASE WHEN rs[k] < 1 OR rs[k] > 4 OR cs[k] < 1 OR cs[k] > 4 THEN 'coordinate_out_of_bounds' WHEN (p_partkey * 7 + rs[k] * 3 + cs[k] * 5) % 11 = 0 THEN 'forbidden_cell' END), lambda v: v IS NOT NULL)[1] AS bad FROM x),
 z AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'wrong_number_of_tokens' WHEN len(list_distinct(cells)) < 3 THEN 'duplicate_coordinate' WHEN len(list_distinct(rs)) < 3 THEN 'row_conflict' WHEN len(list_distinct(cs)) < 3 THEN 'column_conflict' ELSE bad END AS reason FROM y),
 q AS (SELECT p_partkey, reason IS NULL AND p_partkey % 2 = 0 AS valid, CASE WHEN reason IS NULL AND p_partkey % 2 <> 0 THEN 'valid_but_unmatched_solution' ELSE reason END AS reason FROM z)
 SELECT CAST(p_partkey AS VARCHAR) AS puzzle_id, CASE WHEN p_partkey % 13 = 0 THEN false WHEN p_partkey % 10 = 9 THEN false ELSE valid END AS is_valid,
 CASE WHEN p_partkey % 13 = 0 AND p_partkey % 2 = 0 THEN 'timeout_or_give_up' WHEN p_partkey % 13 = 0 THEN 'timeout' WHEN p_partkey % 10 = 9 THEN 'unknown_puzzle_id' ELSE reason END AS invalid_reason,
 CASE WHEN p_partkey % 13 <> 0 AND p_partkey % 10 <> 9 AND valid THEN 's1' END AS solution_id FROM q"""
)
def scored_placements(spark, sf_dir):
    """Placements of three rooks on a 4 x 4 board, made, scored and, where time ran out, overridden; every tenth puzzle isn't in the dataset."""
    parts = table(spark, sf_dir, "part")
    cell = lambda r, c: F.when((F.col("p_partkey") * 7 + r * 3 + c * 5) % 11 == 0, "X").otherwise(".")
    board = F.array(*[F.concat(*[cell(r, c) for c in range(1, 5)]) for r in range(1, 5)])
    own = F.array_sort(F.array(*[F.array(F.expr(_R.format(k=k)).cast("long"), F.expr(_C.format(k=k)).cast("long")) for k in range(3)]))
    answer = F.when(F.col("p_partkey") % 2 == 0, F.to_json(own)).otherwise("none")
    known = parts.filter("p_partkey % 10 <> 9").select(F.col("p_partkey").cast("string").alias("puzzle_id"), F.lit("grid_placement").alias("puzzle_type"), board.alias("board"), F.lit(3).alias("m"), F.array(F.struct(F.lit("s1").alias("solution_id"), F.lit("c1").alias("abstract_solution_id"), answer.alias("answer"))).alias("solutions"))
    late = F.col("p_partkey") % 13 == 0
    trials = parts.select(F.col("p_partkey").cast("string").alias("puzzle_id"), F.lit("single").alias("input_kind"), F.expr(_TEXT).alias("raw_answer"), F.lit(None).cast("string").alias("raw_response"), late.alias("timeout"), (late & (F.col("p_partkey") % 2 == 0)).alias("gave_up"))
    return scoring.ended_without_answer(scoring.scored(trials, known)).select("puzzle_id", "is_valid", "invalid_reason", "solution_id")


_GRID = ("S...", "..#.", "#...", "...G")
_PATH = "array_join(transform(sequence(0, 5), k -> element_at(array('R', 'D', 'R', 'D', 'L', 'U'), cast((p_partkey * (k + 1) + k) % 6 + 1 as int))), '')"


@query(
    """WITH s AS (SELECT p_partkey, k, ['R', 'D', 'R', 'D', 'L', 'U'][CAST((p_partkey * (k + 1) + k) % 6 + 1 AS INTEGER)] AS m FROM part, range(6) t(k)),
 w AS (SELECT p_partkey, k, sum(CASE m WHEN 'D' THEN 1 WHEN 'U' THEN -1 ELSE 0 END) OVER q AS r, sum(CASE m WHEN 'R' THEN 1 WHEN 'L' THEN -1 ELSE 0 END) OVER q AS c FROM s WINDOW q AS (PARTITION BY p_partkey ORDER BY k)),
 b AS (SELECT p_partkey, k, r, c, CASE WHEN r < 0 OR r > 3 OR c < 0 OR c > 3 THEN 'path_out_of_bounds' WHEN (r = 1 AND c = 2) OR (r = 2 AND c = 0) THEN 'path_hits_wall' END AS why FROM w),
 e AS (SELECT p_partkey, arg_min(why, k) FILTER (why IS NOT NULL) AS why, arg_max(r, k) AS r, arg_max(c, k) AS c FROM b GROUP BY ALL)
 SELECT CAST(p_partkey AS VARCHAR) AS puzzle_id, coalesce(why, CASE WHEN r <> 3 OR c <> 3 THEN 'does_not_reach_goal' ELSE 'valid_but_unmatched_solution' END) AS invalid_reason FROM e"""
)
def scored_walks(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    known = parts.select(F.col("p_partkey").cast("string").alias("puzzle_id"), F.lit("maze").alias("puzzle_type"), F.array(*map(F.lit, _GRID)).alias("grid"), F.lit(6).alias("shortest"), F.array(F.struct(*[F.lit("none").alias(n) for n in ("solution_id", "abstract_solution_id", "answer")])).alias("solutions"))
    trials = parts.select(F.col("p_partkey").cast("string").alias("puzzle_id"), F.lit("single").alias("input_kind"), F.concat(F.lit("ANSWER: "), F.expr(_PATH)).alias("raw_answer"), F.lit(None).cast("string").alias("raw_response"))
    return scoring.scored(trials, known).select("puzzle_id", "invalid_reason")


@query(
    """WITH p AS (SELECT c_nationkey AS k, avg(c_acctbal) / 1000 AS x, count(*) / 10 AS y FROM customer GROUP BY ALL), d AS (SELECT a.k AS "left", b.k AS "right", abs(a.x - b.x) AS value, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS shown FROM p a JOIN p b ON a.k < b.k)
 SELECT round(sqrt(sum((value - shown) * (value - shown)) / sum(value * value)), 6) AS stress, count(*) AS pairs FROM d"""
)
def embedding_stress(spark, sf_dir):
    """How far distances in the plane are from those on a line."""
    points = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("label")).agg((F.avg("c_acctbal") / 1000).alias("x"), (F.count("*") / 10).alias("y"))
    b = points.select(F.col("label").alias("right"), F.col("x").alias("bx"), F.lit(1).alias("k"))
    rows = points.select(F.col("label").alias("left"), "x", F.lit(1).alias("k")).join(b, "k").filter(F.col("left") < F.col("right")).select("left", "right", F.abs(F.col("x") - F.col("bx")).alias("value"))
    return rounded(geometry.stress_rows(rows, points), "stress")


@query(
    """WITH r AS (SELECT l_suppkey AS "left", l_partkey % 100 AS "right", CASE WHEN l_linenumber = 7 THEN -l_discount ELSE l_discount * 12 END AS value FROM lineitem),
 c AS (SELECT "left", "right", count(*) AS n, min(value) AS low, max(value) AS high FROM r GROUP BY ALL)
 SELECT CAST(l."left" AS BIGINT) AS "left", CAST(l."right" AS BIGINT) AS "right", unnest(list_filter([CASE WHEN n > 1 THEN 'repeated' END, CASE WHEN low < 0 OR high > 1 THEN 'out_of_range' END, CASE WHEN l."left" = l."right" AND (low <> 0 OR high <> 0) THEN 'diagonal' END,
  CASE WHEN l."left" <> l."right" AND (SELECT count(*) FROM c o WHERE o."left" = l."right" AND o."right" = l."left" AND o.low = l.low AND o.high = l.high) = 0 THEN 'asymmetric' END], lambda x: x IS NOT NULL)) AS problem FROM c l"""
)
def matrix_problems(spark, sf_dir):
    value = F.when(F.col("l_linenumber") == 7, -F.col("l_discount")).otherwise(F.col("l_discount") * 12)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("left"), (F.col("l_partkey") % 100).alias("right"), value.alias("value"))
    return geometry.matrix_problems(rows)


@query(
    """WITH g AS (SELECT p_brand AS block, p_partkey, list_transform(range(3), lambda r: array_to_string(list_transform(range(3), lambda c: CASE WHEN (p_partkey * (r * 3 + c + 1)) % 4 = 0 THEN '#' ELSE '.' END), '')) AS grid FROM part)
 SELECT p_partkey, how, array_to_string(CASE how WHEN 'mirror_v' THEN list_reverse(grid) WHEN 'mirror_h' THEN list_transform(grid, lambda x: reverse(x)) ELSE list_reverse(list_transform(grid, lambda x: reverse(x))) END, '/') AS grid FROM g, (VALUES ('mirror_v'), ('mirror_h'), ('mirror_hv')) v(how)"""
)
def grid_variants(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", _grid3().alias("grid"))
    return rows.select("p_partkey", F.explode(puzzles.mirrored("grid")).alias("how", "grid")).select("p_partkey", "how", F.array_join("grid", "/").alias("grid"))


def _grid3() -> Column:
    return F.array(*[F.concat(*[F.when((F.col("p_partkey") * (r * 3 + c + 1)) % 4 == 0, "#").otherwise(".") for c in range(3)]) for r in range(3)])


@query(
    """WITH g AS (SELECT p_brand AS block, p_partkey, array_to_string(list_transform(range(9), lambda k: CASE WHEN (p_partkey * (k + 1)) % 4 = 0 THEN '#' ELSE '.' END), '') AS s FROM part),
 i AS (SELECT * FROM (VALUES (0, [1,2,3,4,5,6,7,8,9]), (1, [7,4,1,8,5,2,9,6,3]), (2, [9,8,7,6,5,4,3,2,1]), (3, [3,6,9,2,5,8,1,4,7]), (4, [3,2,1,6,5,4,9,8,7]), (5, [7,8,9,4,5,6,1,2,3]), (6, [1,4,7,2,5,8,3,6,9]), (7, [9,6,3,8,5,2,7,4,1])) t(k, ix)),
 v AS (SELECT block, p_partkey, array_to_string(list_transform(ix, lambda x: s[x]), '') AS y FROM g, i),
 c AS (SELECT block, p_partkey, min(y) AS s FROM v GROUP BY ALL),
 u AS (SELECT block, s, min(p_partkey) AS least, count(*) AS n FROM c GROUP BY ALL),
 p AS (SELECT a.block, a.s, a.least, b.least AS other, b.n - CASE WHEN a.s = b.s THEN 1 ELSE 0 END AS grids, len(list_filter(range(1, 10), lambda j: a.s[j] <> b.s[ix[j]])) AS h FROM u a JOIN u b ON a.block = b.block, i),
 q AS (SELECT block, s, least, other, grids, min(h) AS hamming FROM p GROUP BY ALL HAVING min(h) <= 2)
 SELECT p_partkey, least, other, CAST(hamming AS INTEGER) AS hamming, grids FROM c JOIN q USING (block, s) WHERE grids > 0"""
)
def near_grids(spark, sf_dir):
    """Each grid beside the boards of its brand that differ from it in two cells at most under some rotation or reflection, its own included."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", _grid3().alias("grid"))
    return puzzles.near_members(rows, "p_brand", "p_partkey", "grid", 3, 2).withColumnRenamed("k", "p_partkey")


@query(
    """WITH g AS (SELECT p_brand AS block, p_partkey, array_to_string(list_transform(range(9), lambda k: CASE WHEN (p_partkey * (k + 1)) % 4 = 0 THEN '#' ELSE '.' END), '') AS s FROM part),
 i AS (SELECT * FROM (VALUES ([1,2,3,4,5,6,7,8,9]), ([7,4,1,8,5,2,9,6,3]), ([9,8,7,6,5,4,3,2,1]), ([3,6,9,2,5,8,1,4,7]), ([3,2,1,6,5,4,9,8,7]), ([7,8,9,4,5,6,1,2,3]), ([1,4,7,2,5,8,3,6,9]), ([9,6,3,8,5,2,7,4,1])) t(ix)),
 c AS (SELECT block, p_partkey, min(array_to_string(list_transform(ix, lambda x: s[x]), '')) AS board FROM g, i GROUP BY ALL)
 SELECT p_partkey, board, min(p_partkey) OVER (PARTITION BY block, board) AS least FROM c"""
)
def grid_classes(spark, sf_dir):
    """Which board each grid of a brand has: the boards that :func:`near_grids` pairs."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", _grid3().alias("grid"))
    return puzzles.board_classes(rows, "p_brand", "p_partkey", "grid", 3).select(F.col("k").alias("p_partkey"), "board", "least")


_BOARD_SQL = """g AS (SELECT p_partkey, list_transform(range(9), lambda k: CASE WHEN (p_partkey * p_partkey * (k + 1) + p_partkey * (k * k + 3) + k) % 23 < 9 THEN 'X' ELSE '.' END) AS b FROM part),
 ix AS (SELECT * FROM (VALUES ([1,2,3,4,5,6,7,8,9]), ([7,4,1,8,5,2,9,6,3]), ([9,8,7,6,5,4,3,2,1]), ([3,6,9,2,5,8,1,4,7]), ([3,2,1,6,5,4,9,8,7]), ([7,8,9,4,5,6,1,2,3]), ([1,4,7,2,5,8,3,6,9]), ([9,6,3,8,5,2,7,4,1])) t(x)),
 n AS (SELECT p_partkey, count(*) AS n_solutions FROM g, range(9) i(i), range(9) j(j) WHERE i < j AND i // 3 <> j // 3 AND i % 3 <> j % 3 AND b[i + 1] = '.' AND b[j + 1] = '.' GROUP BY ALL HAVING count(*) BETWEEN 3 AND 8),
 c AS (SELECT p_partkey, min(array_to_string(list_transform(x, lambda y: b[y]), '')) AS canonical, any_value(len(list_filter(b, lambda y: y = 'X'))) AS blocked FROM g, ix GROUP BY ALL),
 u AS (SELECT 'p' || lpad(CAST(min(p_partkey) AS VARCHAR), 9, '0') AS puzzle_id, canonical, any_value(blocked) AS blocked, any_value(n_solutions) AS n_solutions FROM c JOIN n USING (p_partkey) GROUP BY canonical),
 s AS (SELECT *, coalesce((blocked - min(blocked) OVER ()) / nullif(max(blocked) OVER () - min(blocked) OVER (), 0), 0) - coalesce((n_solutions - min(n_solutions) OVER ()) / nullif(max(n_solutions) OVER () - min(n_solutions) OVER (), 0), 0) AS score FROM u),
 t AS (SELECT *, ntile(3) OVER (ORDER BY score, puzzle_id) AS difficulty FROM s), pool AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY difficulty ORDER BY score DESC, puzzle_id) <= 5)"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda k: F.when((F.col("p_partkey") * F.col("p_partkey") * (k + 1) + F.col("p_partkey") * (k * k + 3) + k) % 23 < 9, "X").otherwise(".")
    board = F.array(*[F.concat(*[cell(3 * r + c) for c in range(3)]) for r in range(3)])
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("puzzle_id"), board.alias("board"))
    return generation.rook_pool(rows, 3, 2, per_bucket=5)


@query(f"WITH {_BOARD_SQL} SELECT puzzle_id, CAST(n_solutions AS INTEGER) AS n_solutions, CAST(blocked AS INTEGER) AS blocked, round(score, 6) AS score, CAST(difficulty AS INTEGER) AS difficulty FROM pool")
def puzzle_pool(spark, sf_dir):
    """Boards of two rooks: solved, freed of copies under symmetry, scored, and the best of each third."""
    return rounded(_pool(spark, sf_dir).drop("board"), "score")


@query(
    f"""WITH {_BOARD_SQL}, k AS (SELECT puzzle_id, difficulty, row_number() OVER (PARTITION BY difficulty ORDER BY puzzle_id) - 1 AS k FROM pool)
 SELECT 'spatial' AS module, 'spatial_' || puzzle_id AS block, 'spatial_' || puzzle_id || '/' || how AS trial FROM pool, (VALUES ('original'), ('mirror_v'), ('mirror_h'), ('mirror_hv')) v(how)
 UNION ALL SELECT 'transfer', 'transfer_' || a.puzzle_id || '+' || b.puzzle_id, 'transfer_' || a.puzzle_id || '+' || b.puzzle_id || '/' || how FROM k a JOIN k b ON a.difficulty = b.difficulty AND a.k % 2 = 0 AND b.k = a.k + 1, (VALUES ('prime'), ('target')) v(how)"""
)
def study_modules(spark, sf_dir):
    """Modules of a pool, as blocks of trials; their design has no problem."""
    pool = _pool(spark, sf_dir)
    trials = generation.spatial_module(pool).unionAll(generation.transfer_module(pool, "difficulty", ["puzzle_id"]))
    blocks = generation.module_blocks(trials)
    return blocks.select("module", "block", F.explode("trial_ids").alias("trial"))


@query(
    """WITH s AS (SELECT p_partkey, coalesce((p_size - min(p_size) OVER w) / nullif(max(p_size) OVER w - min(p_size) OVER w, 0), 0) AS a, coalesce((p_retailprice - min(p_retailprice) OVER w) / nullif(max(p_retailprice) OVER w - min(p_retailprice) OVER w, 0), 0) AS b FROM part WINDOW w AS (PARTITION BY p_brand)),
 t AS (SELECT p_partkey, 0.75 * a - 0.25 * (b - 1) AS pressure FROM s)
 SELECT p_partkey, round(pressure, 6) AS pressure, ['low', 'medium', 'high'][least(2, CAST(floor(pressure * 3) AS INTEGER)) + 1] AS pressure_bucket FROM t"""
)
def probe_scores(spark, sf_dir):
    rows = generation.probe_scores(table(spark, sf_dir, "part"), ["p_brand"], {"p_size": 3.0, "p_retailprice": -1.0}, "pressure")
    return rounded(rows.select("p_partkey", "pressure", "pressure_bucket"), "pressure")


@query("SELECT p_brand, p_partkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 3, sha256('7|' || p_partkey), p_partkey) AS place FROM part) WHERE place <= 3")
def seeded_topk(spark, sf_dir):
    """The lowest quotas of a group, ties in an order that a seed fixes."""
    rows = table(spark, sf_dir, "part").withColumn("quota", F.col("p_size") % 3)
    return ordering.lowest_per_group(rows, "quota", ["tie", "p_partkey"], ["p_brand"], 3, seed=7, key=["p_partkey"]).select("p_brand", "p_partkey", "place")


@query(
    f"""WITH {ORDERS_SQL}, {DENSE_SQL}, e AS (SELECT source, item, -sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END) AS v FROM dist GROUP BY ALL), c AS (SELECT source, item, v - avg(v) OVER (PARTITION BY item) AS x FROM e)
 SELECT a.source AS "left", b.source AS "right", round(sum(a.x * b.x), 6) AS value FROM c a JOIN c b ON a.item = b.item GROUP BY ALL"""
)
def entropy_gram(spark, sf_dir):
    """What the projection of sources is made of."""
    own = d.profiles(d.distributions(d.class_counts(orders(spark, sf_dir))))
    return rounded(geometry.gram_rows(own.select("source", "item", F.col("entropy").alias("value"))), "value")


@query(
    """WITH c AS (SELECT CAST(p_partkey AS BIGINT) AS p, CAST(k // 5 AS INTEGER) AS r, CAST(k % 5 AS INTEGER) AS c FROM part, range(25) t(k) WHERE (k = 0 OR k = 24 OR (p_partkey * ((k // 5) * 7 + (k % 5) * 3 + 1)) % 5 <> 0)),
 st AS (SELECT * FROM (VALUES (-1, 0, 'U'), (1, 0, 'D'), (0, -1, 'L'), (0, 1, 'R')) s(dr, dc, m)),
 e AS (SELECT a.p, a.r, a.c, b.r AS r2, b.c AS c2, m FROM c a, st JOIN c b ON b.p = a.p AND b.r = a.r + dr AND b.c = a.c + dc)"""
    + """,
 reach AS (WITH RECURSIVE w AS (SELECT DISTINCT p, 0 AS r, 0 AS c, 0 AS d FROM c UNION SELECT e.p, r2, c2, d + 1 FROM w JOIN e ON e.p = w.p AND e.r = w.r AND e.c = w.c WHERE d < 20) SELECT p, r, c, min(d) AS d FROM w GROUP BY ALL),
 walks AS (WITH RECURSIVE w AS (SELECT DISTINCT p, 0 AS r, 0 AS c, 0 AS d, '' AS moves FROM c UNION ALL SELECT e.p, r2, c2, w.d + 1, moves || m FROM w JOIN e ON e.p = w.p AND e.r = w.r AND e.c = w.c JOIN reach x ON x.p = e.p AND x.r = r2 AND x.c = c2 AND x.d = w.d + 1) SELECT p, moves FROM w WHERE r = 4 AND c = 4)
 SELECT p AS puzzle_id, moves FROM walks"""
)
def shortest_walks(spark, sf_dir):
    """All shortest walks of each 5 x 5 maze."""
    side = 5
    cell = lambda r, c: F.when(F.lit(r + c == 0), "S").when(F.lit(r + c == 2 * side - 2), "G").when((F.col("p_partkey") * (r * 7 + c * 3 + 1)) % 5 == 0, "#").otherwise(".")
    grid = F.array(*[F.concat(*[cell(r, c) for c in range(side)]) for r in range(side)])
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("puzzle_id"), grid.alias("grid"))
    solve = lambda mazes: mazes.select("grid", F.explode(puzzles.maze_solutions("grid")).alias("moves"))
    return puzzles.solved_once(rows, "puzzle_id", ["grid"], solve).select("puzzle_id", "moves")


# A board of three by three with a clue in its middle row and unknown cells in the two others.
_CLUE = "CAST((p_partkey * ({k} + 2) + {k}) % 4 AS INTEGER)"


@query(
    f"""WITH b AS (SELECT p_partkey, [{", ".join(_CLUE.format(k=k) for k in range(3))}] AS clue FROM part), a AS (SELECT p_partkey, s FROM b, range(64) t(s) WHERE
  bit_count((s & 3) | (s & 24)) = clue[1] AND bit_count(s & 63) = clue[2] AND bit_count((s & 6) | (s & 48)) = clue[3]),
 f AS (SELECT p_partkey, k, sum((s >> k) & 1) AS mines, count(*) AS n FROM a, range(6) u(k) GROUP BY ALL)
 SELECT p_partkey, CAST(CASE WHEN k < 3 THEN 1 ELSE 3 END AS INTEGER) AS r, CAST(k % 3 + 1 AS INTEGER) AS c, CASE WHEN mines = 0 THEN 'safe' ELSE 'mine' END AS kind FROM f WHERE mines = 0 OR mines = n"""
)
def forced_mines(spark, sf_dir):
    clues = F.concat(*[F.expr(_CLUE.format(k=k)).cast("string") for k in range(3)])
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.lit("???"), clues, F.lit("???")).alias("board"))
    kinds = F.explode(F.array(F.lit("safe"), F.lit("mine"))).alias("kind")
    solve = lambda boards: boards.select("board", kinds).select("board", "kind", F.explode(puzzles.mine_solutions("board", "kind")).alias("cell"))
    cells = puzzles.solved_once(rows, "p_partkey", ["board"], solve)
    return cells.select("p_partkey", F.col("cell")[0].alias("r"), F.col("cell")[1].alias("c"), "kind")


@query(
    """SELECT 'orders' AS name, 'repeated_key' AS problem, count(*) AS n FROM (SELECT o_custkey, o_orderdate FROM orders GROUP BY ALL HAVING count(*) > 1) HAVING count(*) > 0
 UNION ALL SELECT 'orders', 'unknown_o_custkey', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) HAVING count(*) > 0
 UNION ALL SELECT 'orders', 'null_note', count(*) FROM orders WHERE o_orderkey % 5 = 0 HAVING count(*) > 0"""
)
def constraint_problems(spark, sf_dir):
    """Orders as a table whose key is customer and date, whose customers are those with money, and whose note must be there."""
    rows = table(spark, sf_dir, "orders").withColumn("note", F.when(F.col("o_orderkey") % 5 != 0, "x"))
    people = table(spark, sf_dir, "customer").filter("c_acctbal > 0")
    return integrity.constraint_problems("orders", rows, ["o_custkey", "o_orderdate"], ["note"], {"o_custkey": (people, "c_custkey")})
