"""Queries of the distribution metrics, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.functions import metrics as m
from tallygrid.operators import distributions as d

from .tables import DENSE_SQL, ORDERS_SQL, PAIR_SQL, SHIPMENTS_SQL, orders, shipments, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PLACES = 6


def query(sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, PLACES) + F.lit(0.0) for c in columns})


def _ships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.distributions(d.class_counts(shipments(spark, sf_dir)))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.distributions(d.class_counts(orders(spark, sf_dir)))


_S = f"WITH {SHIPMENTS_SQL}, {DENSE_SQL}"
_O = f"WITH {ORDERS_SQL}, {DENSE_SQL}"


@query(f"WITH {SHIPMENTS_SQL} SELECT source, item, klass, stratum, count(*) AS n FROM obs GROUP BY ALL")
def class_counts(spark, sf_dir):
    return d.class_counts(shipments(spark, sf_dir))


@query(_S + " SELECT source, item, klass, n, round(p, 6) AS p FROM dist WHERE n > 0")
def distribution(spark, sf_dir):
    return rounded(_ships(spark, sf_dir).select("source", "item", "klass", "n", "p"), "p")


@query(_S + f", {PAIR_SQL} SELECT \"left\", \"right\", item, round(tv, 6) AS tv FROM pr")
def tv_pairwise(spark, sf_dir):
    return rounded(d.pairwise(_ships(spark, sf_dir)).select("left", "right", "item", "tv"), "tv")


@query(
    _S + f""", {PAIR_SQL}, st AS (SELECT "left", "right", stratum, avg(tv) AS tv, count(*) AS items FROM pr GROUP BY ALL)
 SELECT "left", "right", stratum, round(tv, 6) AS tv, items FROM st
 UNION ALL SELECT "left", "right", NULL, round(avg(tv), 6), CAST(sum(items) AS BIGINT) FROM st GROUP BY ALL"""
)
def tv_by_stratum(spark, sf_dir):
    return rounded(d.stratum_means(d.pairwise(_ships(spark, sf_dir)), ["left", "right"], ["tv"]), "tv")


@query(_O + ' SELECT source, item, k AS classes, round(0.5 * sum(abs(p - 1.0 / k)), 6) AS tv_uniform FROM dist GROUP BY source, item, k')
def tv_vs_uniform(spark, sf_dir):
    return rounded(d.uniform_baseline(_orders(spark, sf_dir)).select("source", "item", "classes", "tv_uniform"), "tv_uniform")


@query(_S + f', {PAIR_SQL} SELECT "left", "right", item, round(js, 6) AS js, round(sqrt(js), 6) AS js_distance FROM pr')
def js_distance(spark, sf_dir):
    return rounded(d.pairwise(_ships(spark, sf_dir)).select("left", "right", "item", "js", "js_distance"), "js", "js_distance")


@query(_S + f', {PAIR_SQL} SELECT "left", "right", item, round(hellinger, 6) AS hellinger FROM pr')
def hellinger(spark, sf_dir):
    return rounded(d.pairwise(_ships(spark, sf_dir)).select("left", "right", "item", "hellinger"), "hellinger")


_ENTROPY_SQL = "-sum(CASE WHEN p > 0 THEN p * log2(p) ELSE 0 END)"


@query(_O + f" SELECT source, item, round({_ENTROPY_SQL}, 6) AS entropy FROM dist GROUP BY ALL")
def entropy_bits(spark, sf_dir):
    return rounded(d.profiles(_orders(spark, sf_dir)).select("source", "item", "entropy"), "entropy")


@query(_O + f" SELECT source, item, round({_ENTROPY_SQL} / log2(k), 6) AS normalized_entropy FROM dist GROUP BY source, item, k HAVING k > 1")
def normalized_entropy(spark, sf_dir):
    return rounded(_normalized(_orders(spark, sf_dir)).select("source", "item", "normalized_entropy"), "normalized_entropy")


def _normalized(dist: DataFrame) -> DataFrame:
    own = d.profiles(dist).join(d.catalog_sizes(dist), "item").filter("classes > 1")
    return own.withColumn("normalized_entropy", m.normalized_entropy(F.col("entropy"), F.col("classes")))


@query(_S + f', {PAIR_SQL} SELECT "left", "right", CAST(sum(modal) AS BIGINT) AS agreed, count(*) AS items FROM pr GROUP BY ALL')
def modal_agreement(spark, sf_dir):
    rows = d.pairwise(_ships(spark, sf_dir)).select("left", "right", "modal_agreement")
    return rows.groupBy("left", "right").agg(F.count_if("modal_agreement").alias("agreed"), F.count("*").alias("items"))


@query(_S + f', {PAIR_SQL} SELECT "left", "right", item, round(ldc, 6) AS correlation FROM pr')
def log_density_corr(spark, sf_dir):
    rows = d.pairwise(_ships(spark, sf_dir)).select("left", "right", "item", F.col("log_density_correlation").alias("correlation"))
    return rounded(rows, "correlation")


@query(
    _S + f""", {PAIR_SQL} SELECT "left", "right", round(avg(tv), 6) AS tv, round(avg(js), 6) AS js, round(avg(sqrt(js)), 6) AS js_distance,
 round(avg(hellinger), 6) AS hellinger, round(avg(modal), 6) AS modal, round(avg(ldc), 6) AS correlation FROM pr GROUP BY ALL"""
)
def five_metric_matrix(spark, sf_dir):
    rows = d.pairwise(_ships(spark, sf_dir)).groupBy("left", "right")
    out = rows.agg(*[F.avg(c).alias(c) for c in ("tv", "js", "js_distance", "hellinger")], F.avg(F.col("modal_agreement").cast("int")).alias("modal"), F.avg("log_density_correlation").alias("correlation"))
    return rounded(out, "tv", "js", "js_distance", "hellinger", "modal", "correlation")


@query(_S + " SELECT item, klass, round(sum(p) / 3, 6) AS p FROM (SELECT *, count(DISTINCT source) OVER (PARTITION BY item) AS s FROM dist) WHERE s = 3 GROUP BY item, klass")
def source_mixture(spark, sf_dir):
    return rounded(d.mixture(_ships(spark, sf_dir)), "p")


_TARGET = ("1-URGENT", "2-HIGH")


@query(
    _O + """, ms AS (SELECT source, item, sum(CASE WHEN klass IN ('1-URGENT', '2-HIGH') THEN n ELSE 0 END) AS hits, sum(n) AS total FROM dist GROUP BY ALL)
 SELECT b.item, CAST(b.hits AS BIGINT) AS hits, CAST(b.total AS BIGINT) AS total, round(b.hits / b.total, 6) AS mass,
  round(b.hits / b.total - a.hits / a.total, 6) AS gain FROM ms a JOIN ms b ON a.item = b.item AND a.source = 'O' AND b.source = 'F'"""
)
def target_mass_gain(spark, sf_dir):
    return rounded(_masses(spark, sf_dir).select("item", "hits", "total", "mass", "gain"), "mass", "gain")


def _masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    masses = d.target_mass(d.class_counts(orders(spark, sf_dir)), F.col("klass").isin(*_TARGET))
    before = masses.filter("source = 'O'").select("item", F.col("mass").alias("before"))
    return masses.filter("source = 'F'").join(before, "item").withColumn("gain", F.col("mass") - F.col("before"))


@query(
    _O + """, ms AS (SELECT source, item, sum(CASE WHEN klass IN ('1-URGENT', '2-HIGH') THEN n ELSE 0 END) / sum(n) AS mass FROM dist GROUP BY ALL)
 SELECT b.item, round((b.mass - a.mass) / nullif(1 - a.mass, 0), 6) AS attraction,
  round(CASE WHEN greatest(0, 1 - a.mass) > 1e-12 THEN (b.mass - a.mass) / greatest(0, 1 - a.mass) END, 6) AS directional
 FROM ms a JOIN ms b ON a.item = b.item AND a.source = 'O' AND b.source = 'F'"""
)
def normalized_attraction(spark, sf_dir):
    rows = _masses(spark, sf_dir)
    out = rows.select("item", m.normalized_attraction(F.col("gain"), F.col("before")).alias("attraction"), m.directional_gain(F.col("before"), F.col("mass")).alias("directional"))
    return rounded(out, "attraction", "directional")


@query(
    _O + f""", e AS (SELECT source, item, stratum, {_ENTROPY_SQL} AS h FROM dist GROUP BY ALL), f AS (SELECT source, stratum, avg(h) AS h FROM e GROUP BY ALL)
 SELECT source, round(avg(h), 6) AS equal_family_mean, count(*) AS families FROM f GROUP BY ALL"""
)
def equal_family_mean(spark, sf_dir):
    rows = d.profiles(_orders(spark, sf_dir)).groupBy("source", "stratum").agg(F.avg("entropy").alias("h"))
    return rounded(rows.groupBy("source").agg(F.avg("h").alias("equal_family_mean"), F.count("*").alias("families")), "equal_family_mean")


@query(
    _O + f""", {PAIR_SQL} SELECT a.item, round(b.tv - a.tv, 6) AS contrast FROM pr a JOIN pr b ON a.item = b.item
 WHERE a."left" = 'F' AND a."right" = 'O' AND b."left" = 'F' AND b."right" = 'P'"""
)
def condition_contrast(spark, sf_dir):
    # One conditional aggregation instead of a second pass over the pairs.
    rows = d.pairwise(_orders(spark, sf_dir)).filter("left = 'F'").groupBy("item")
    one = lambda right: F.max(F.when(F.col("right") == right, F.col("tv")))
    return rounded(rows.agg((one("P") - one("O")).alias("contrast")).filter("contrast is not null"), "contrast")


@query(
    _O + f""", e AS (SELECT source, item, {_ENTROPY_SQL} / log2(k) AS h FROM dist GROUP BY source, item, k)
 SELECT source, round(quantile_cont(h, 0.25), 6) AS q1, round(quantile_cont(h, 0.5), 6) AS q2, round(quantile_cont(h, 0.75), 6) AS q3 FROM e GROUP BY ALL"""
)
def quartile_summary(spark, sf_dir):
    rows = _normalized(_orders(spark, sf_dir)).groupBy("source").agg(F.percentile("normalized_entropy", [0.25, 0.5, 0.75]).alias("q"))
    return rounded(rows.select("source", *[F.col("q")[k].alias(f"q{k + 1}") for k in range(3)]), "q1", "q2", "q3")


@query(
    """WITH d AS (SELECT event_type AS source, CAST(ts AS DATE) AS item, ln(greatest(median(value), 1.0)) AS log_median, count(*) AS n FROM events GROUP BY ALL)
 SELECT source, CAST(item AS VARCHAR) AS item, round(log_median, 6) AS log_median, round(log_median - avg(log_median) OVER (PARTITION BY source), 6) AS demeaned, n FROM d"""
)
def demeaned_log_median(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source"), F.to_date("ts").cast("string").alias("item"))
    days = rows.agg(F.log(F.greatest(F.median("value"), F.lit(1.0))).alias("log_median"), F.count("*").alias("n"))
    return rounded(days.withColumn("demeaned", F.col("log_median") - F.avg("log_median").over(Window.partitionBy("source"))), "log_median", "demeaned")


@query(
    _O + f""", e AS (SELECT source, item, {_ENTROPY_SQL} AS h FROM dist GROUP BY ALL)
 SELECT a.source AS "left", b.source AS "right", round(CASE WHEN var_pop(a.h) > 1e-12 AND var_pop(b.h) > 1e-12 THEN corr(a.h, b.h) END, 6) AS r, count(*) AS items
 FROM e a JOIN e b ON a.item = b.item AND a.source < b.source GROUP BY ALL"""
)
def entropy_correlation(spark, sf_dir):
    own = d.profiles(_orders(spark, sf_dir))
    a, b = (own.select("item", F.col("source").alias(s), F.col("entropy").alias(v)) for s, v in (("left", "x"), ("right", "y")))
    x, y = F.col("x"), F.col("y")
    rows = a.join(b, "item").filter(F.col("left") < F.col("right")).groupBy("left", "right")
    out = rows.agg(F.count("*").alias("items"), *[F.sum(c).alias(n) for n, c in (("sx", x), ("sy", y), ("sxx", x * x), ("syy", y * y), ("sxy", x * y))])
    r = m.pearson(*[F.col(c) for c in ("items", "sx", "sy", "sxx", "syy", "sxy")])
    return rounded(out.select("left", "right", r.alias("r"), "items"), "r")


_PAIRS_SQL = "pairs AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events QUALIFY b IS NOT NULL)"


def _event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("a"), after.alias("b")).filter("b is not null")


_JOINT_SQL = _PAIRS_SQL + """, j AS (SELECT user_id, a, b, count(*) AS n FROM pairs GROUP BY ALL),
 q AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p, sum(n) OVER (PARTITION BY user_id, a) / sum(n) OVER (PARTITION BY user_id) AS pa,
  sum(n) OVER (PARTITION BY user_id, b) / sum(n) OVER (PARTITION BY user_id) AS pb FROM j)"""


@query(f"WITH {_PAIRS_SQL} SELECT a, b, count(*) AS n FROM pairs GROUP BY ALL")
def joint_counts(spark, sf_dir):
    return _event_pairs(spark, sf_dir).groupBy("a", "b").agg(F.count("*").alias("n"))


@query(f"WITH {_JOINT_SQL} SELECT user_id, CAST(sum(n) AS BIGINT) AS pairs, round(sum(p * log2(p / (pa * pb))), 6) + 0.0 AS mutual_information FROM q GROUP BY ALL")
def mutual_information(spark, sf_dir):
    rows = d.dependence(d.joint_distribution(_event_pairs(spark, sf_dir), ["user_id"]), ["user_id"])
    return rounded(rows.select("user_id", "pairs", "mutual_information"), "mutual_information")


@query(
    f"""WITH {_JOINT_SQL}, ma AS (SELECT DISTINCT user_id, a, pa FROM q), mb AS (SELECT DISTINCT user_id, b, pb FROM q),
 g AS (SELECT ma.user_id, ma.a, mb.b, pa * pb AS e, coalesce(q.p, 0) AS p FROM ma JOIN mb ON ma.user_id = mb.user_id
  LEFT JOIN (SELECT user_id, a, b, p FROM q) q ON q.user_id = ma.user_id AND q.a = ma.a AND q.b = mb.b)
 SELECT user_id, round(0.5 * sum(abs(p - e)), 6) AS independence_tv FROM g GROUP BY ALL"""
)
def independence_tv(spark, sf_dir):
    rows = d.dependence(d.joint_distribution(_event_pairs(spark, sf_dir), ["user_id"]), ["user_id"])
    return rounded(rows.select("user_id", F.greatest(F.lit(0.0), "independence_tv").alias("independence_tv")), "independence_tv")


@query(f"WITH {_JOINT_SQL} SELECT user_id, round(sum(CASE WHEN a = b THEN p ELSE 0 END), 6) AS repetition FROM q GROUP BY ALL")
def repetition(spark, sf_dir):
    rows = d.repetition(d.joint_distribution(_event_pairs(spark, sf_dir), ["user_id"]), ["user_id"])
    return rounded(rows.select("user_id", "repetition"), "repetition")


@query(
    """WITH f AS (SELECT user_id, event_type AS a FROM events WHERE event_type <> 'purchase' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
 SELECT a, event_type AS b, count(*) AS n FROM f JOIN events e ON f.user_id = e.user_id WHERE e.event_type = 'purchase' GROUP BY ALL"""
)
def paired_answers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("klass"))
    pairs = d.paired_answers(rows.filter("klass != 'purchase'"), rows.filter("klass = 'purchase'"), ["user_id"], "event_id")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


@query(
    _O + f""", {PAIR_SQL} SELECT "left", "right", item, round(1.0 / 5 + tv, 6) AS choice_low, round(least(1.0, (1 + 5 * tv) / 5), 6) AS choice_high, round(0.5 * (1 + tv), 6) AS source_bound FROM pr"""
)
def accuracy_bounds(spark, sf_dir):
    rows = d.pairwise(_orders(spark, sf_dir))
    low, high = m.choice_accuracy_bounds(F.col("tv"), F.lit(5))
    out = rows.select("left", "right", "item", low.alias("choice_low"), high.alias("choice_high"), m.source_accuracy_bound(F.col("tv")).alias("source_bound"))
    return rounded(out, "choice_low", "choice_high", "source_bound")


@query(
    """WITH c AS (SELECT source AS item, lang AS klass, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
 SELECT item, CAST(sum(CASE WHEN quality = 1 THEN n ELSE 0 END) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY ALL"""
)
def labelled_mass(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    counts = docs.join(labels, "doc_id").groupBy(F.lit("all").alias("source"), F.col("source").alias("item"), F.col("quality").alias("klass")).agg(F.count("*").alias("n"))
    return d.target_mass(counts, F.col("klass") == 1).select("item", "hits", "total")
