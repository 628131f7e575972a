"""The driver's tables and the bindings of studies to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.binding import Binding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags over line numbers, by supplier; the stratum is the supplier's region."""
    rows = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "supplier"), F.expr("l_suppkey = s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey"))
    )
    return Binding("l_returnflag", "l_suppkey", "l_linenumber", "n_regionkey").apply(rows)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order status over priorities, by nation; the stratum is the region."""
    rows = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    )
    return Binding("o_orderstatus", "n_nationkey", "o_orderpriority", "n_regionkey").apply(rows)


#: The same two in SQL, as common table expressions named obs.
SHIPMENTS_SQL = """obs AS (SELECT l_returnflag AS source, l_suppkey AS item, l_linenumber AS klass, n_regionkey AS stratum
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""
ORDERS_SQL = """obs AS (SELECT o_orderstatus AS source, n_nationkey AS item, o_orderpriority AS klass, n_regionkey AS stratum
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
#: Dense scaffold over the catalog: every source x class of every item.
DENSE_SQL = """cnt AS (SELECT source, item, klass, count(*) AS n FROM obs GROUP BY ALL),
 cat AS (SELECT DISTINCT item, klass, stratum FROM obs),
 src AS (SELECT DISTINCT source, item FROM obs),
 dense AS (SELECT s.source, c.item, c.klass, c.stratum, coalesce(t.n, 0) AS n FROM src s JOIN cat c ON s.item = c.item
   LEFT JOIN cnt t ON t.source = s.source AND t.item = c.item AND t.klass = c.klass),
 dist AS (SELECT *, n / sum(n) OVER (PARTITION BY source, item) AS p, sum(n) OVER (PARTITION BY source, item) AS total,
   count(*) OVER (PARTITION BY source, item) AS k, n = max(n) OVER (PARTITION BY source, item) AS is_mode FROM dense)"""
PAIR_SQL = """pr AS (SELECT l.source AS "left", r.source AS "right", l.item, l.stratum,
   0.5 * sum(abs(l.p - r.p)) AS tv,
   greatest(0, 0.5 * sum(CASE WHEN l.p > 0 THEN l.p * log2(2 * l.p / (l.p + r.p)) ELSE 0 END + CASE WHEN r.p > 0 THEN r.p * log2(2 * r.p / (l.p + r.p)) ELSE 0 END)) AS js,
   sqrt(0.5 * sum((sqrt(l.p) - sqrt(r.p)) * (sqrt(l.p) - sqrt(r.p)))) AS hellinger,
   max(CASE WHEN l.is_mode AND r.is_mode THEN 1 ELSE 0 END) AS modal,
   CASE WHEN var_pop(ln((l.n + 0.5) / (l.total + 0.5 * l.k))) > 1e-12 AND var_pop(ln((r.n + 0.5) / (r.total + 0.5 * r.k))) > 1e-12
     THEN corr(ln((l.n + 0.5) / (l.total + 0.5 * l.k)), ln((r.n + 0.5) / (r.total + 0.5 * r.k))) END AS ldc
   FROM dist l JOIN dist r ON l.item = r.item AND l.klass = r.klass AND l.source < r.source GROUP BY ALL)"""
