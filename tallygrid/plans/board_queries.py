"""Queries of result tables of fits, of oriented coordinates, and of boards under relabelings, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.operators import geometry, logit, puzzles

from .study_queries import _CHOICE_SQL, _choices, rounded
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


#: Coefficients in sample, and by a rule for each item held out.
_PREDICTED_SQL = f"""{_CHOICE_SQL},
 e AS (SELECT *, 'in_sample' AS validation, exp(0.8 * price - 0.5 * late) AS e FROM ch UNION ALL
  SELECT *, 'held_out', exp((0.8 - 0.1 * (item % 7)) * price + (0.2 * (item % 5) - 0.5) * late) FROM ch),
 p AS (SELECT *, e / sum(e) OVER (PARTITION BY validation, source, item) AS p, count(*) OVER (PARTITION BY validation, source, item) AS k FROM e),
 t AS (SELECT *, p >= max(p) OVER (PARTITION BY validation, source, item) - 1e-12 AS top FROM p),
 i AS (SELECT validation, source, item, count(*) AS candidates, CAST(sum(CASE WHEN top THEN 1 ELSE 0 END) AS BIGINT) AS top_size, sum(CASE WHEN top THEN share ELSE 0 END) / sum(CASE WHEN top THEN 1 ELSE 0 END) AS accuracy,
  max(share) AS ceiling, sum(abs(share - 1.0 / k)) / 2 AS distance, sum(-share * ln(p)) AS loss FROM t GROUP BY ALL),
 r AS (SELECT *, 1.0 / candidates AS chance, accuracy * candidates AS relative, CASE WHEN ceiling - 1.0 / candidates > 1e-12 THEN (accuracy - 1.0 / candidates) / (ceiling - 1.0 / candidates) ELSE 0 END AS normalized,
  1 + candidates * distance AS relative_bound, ln(candidates) AS chance_loss FROM i)"""


def _accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logit.choice_rows(*_choices(spark, sf_dir), ["price", "late"])
    fitted = logit.shares_at(rows, ["source"], {"price": 0.8, "late": -0.5}).withColumn("validation", F.lit("in_sample"))
    held = logit.shares_at(rows, ["source"], {"price": 0.8 - 0.1 * (F.col("item") % 7), "late": 0.2 * (F.col("item") % 5) - 0.5}).withColumn("validation", F.lit("held_out"))
    return logit.selected_accuracy(fitted.unionByName(held), ["validation", "source"])


@query(f"WITH {_PREDICTED_SQL} SELECT validation, source, item, candidates, top_size, round(accuracy, 6) AS accuracy, round(relative, 6) AS relative, round(normalized, 6) AS normalized, round(distance, 6) AS distance, round(relative_bound, 6) AS relative_bound FROM r")
def item_accuracies(spark, sf_dir):
    """Accuracy of the likeliest candidate on each item, in sample and with coefficients of its own for each item held out."""
    names = ("accuracy", "relative", "normalized", "distance", "relative_bound")
    return rounded(_accuracies(spark, sf_dir).select("validation", "source", "item", "candidates", "top_size", *names), *names)


_MEANS = ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("loss", "chance_loss", "accuracy", "chance", "relative", "normalized", "relative_bound"))


@query(f"WITH {_PREDICTED_SQL} SELECT validation, source, count(*) AS items, round(avg(chance_loss - loss), 6) AS loss_gain, {_MEANS} FROM r GROUP BY ALL")
def selected_accuracy(spark, sf_dir):
    out = logit.accuracy_summary(_accuracies(spark, sf_dir), ["validation", "source"])
    return rounded(out, *[c for c in out.columns if c not in ("validation", "source", "items")])


@query(
    """WITH c AS (SELECT c_mktsegment AS source, c_nationkey AS axis, avg(c_acctbal) - 4500 AS value FROM customer GROUP BY ALL),
 s AS (SELECT *, CASE WHEN axis % 2 = 0 THEN CASE WHEN source IN ('BUILDING', 'MACHINERY') THEN 'high' WHEN source = 'AUTOMOBILE' THEN 'low' END WHEN axis % 3 = 0 AND source = 'HOUSEHOLD' THEN 'high' END AS side FROM c),
 a AS (SELECT axis, avg(value) FILTER (side = 'high') AS high, avg(value) FILTER (side = 'low') AS low, arg_min(value, (-abs(value), source)) AS largest FROM s GROUP BY axis)
 SELECT source, CAST(axis AS BIGINT) AS axis, round(CASE WHEN coalesce(high < low, largest < 0) THEN -value ELSE value END, 6) AS value FROM c JOIN a USING (axis)"""
)
def anchored_axes(spark, sf_dir):
    """Sources' coordinates turned by anchors: on even axes two sources lie above a third; other axes lack a side and go by the largest entry."""
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("source"), F.col("c_nationkey").cast("long").alias("axis")).agg((F.avg("c_acctbal") - 4500).alias("value"))
    even = [(k, s, side) for k in range(0, 25, 2) for s, side in (("BUILDING", "high"), ("MACHINERY", "high"), ("AUTOMOBILE", "low"))]
    anchors = spark.createDataFrame(even + [(k, "HOUSEHOLD", "high") for k in range(3, 25, 6)], "axis long, source string, side string")
    return rounded(geometry.anchored(rows, anchors), "value")


def _square3() -> Column:
    """Three rows of three cells of three kinds."""
    return F.array(*[F.concat(*[F.element_at(F.array(*map(F.lit, ".#o")), ((F.col("p_partkey") * (r * 3 + c + 2) + F.col("p_size") * r * c) % 3 + 1).cast("int")) for c in range(3)]) for r in range(3)])


@query(
    """WITH g AS (SELECT p_partkey, list_transform(range(9), lambda k: '.#o'[CAST((p_partkey * (k + 2) + p_size * (k // 3) * (k % 3)) % 3 AS BIGINT) + 1]) AS b FROM part),
 o AS (SELECT * FROM (VALUES ([0,1,2]), ([0,2,1]), ([1,0,2]), ([1,2,0]), ([2,0,1]), ([2,1,0])) t(o)),
 x AS (SELECT p_partkey, list_transform(range(9), lambda k: CASE WHEN turn = 0 THEN b[r.o[k // 3 + 1] * 3 + c.o[k % 3 + 1] + 1] ELSE b[c.o[k % 3 + 1] * 3 + r.o[k // 3 + 1] + 1] END) AS y FROM g, o r, o c, range(2) t(turn))
 SELECT p_partkey, min(array_to_string(y[1:3], '') || '/' || array_to_string(y[4:6], '') || '/' || array_to_string(y[7:9], '')) AS canonical FROM x GROUP BY p_partkey"""
)
def canonical_boards(spark, sf_dir):
    """The board that each part's grid is once rows and columns may be renamed or swapped."""
    rows = table(spark, sf_dir, "part").select("p_partkey", _square3().alias("grid"))
    solve = lambda boards: boards.select("grid", F.array_join(puzzles.canonical_labels("grid", 3), "/").alias("canonical"))
    return puzzles.solved_once(rows, "p_partkey", ["grid"], solve).select("p_partkey", "canonical")


def _order_sql(kind: str, band: int) -> str:
    hashed = lambda what, k: f"sha256('7:' || p_partkey || ':{kind}:{what}:' || {k})"
    return f"list_transform(list_sort(list_transform(range(4), lambda k: struct_pack(b := {hashed('band', f'(k // {band})')}, l := {hashed('line', 'k')}, k := k))), lambda x: x.k)"


@query(
    f"""WITH g AS (SELECT p_partkey, list_transform(range(16), lambda k: CAST(((k // 4) * 2 + k // 8 + k % 4 + p_partkey) % 4 + 1 AS VARCHAR)) AS solved, {_order_sql("row", 2)} AS ro, {_order_sql("column", 2)} AS co, {_order_sql("digit", 1)} AS d FROM part),
 m AS (SELECT *, list_transform(solved, lambda x, k: CASE WHEN (p_partkey * k) % 3 = 0 THEN '.' ELSE x END) AS board FROM g),
 n AS (SELECT p_partkey, ro, co, list_transform(range(16), lambda k: board[ro[k // 4 + 1] * 4 + co[k % 4 + 1] + 1]) AS b, list_transform(range(16), lambda k: solved[ro[k // 4 + 1] * 4 + co[k % 4 + 1] + 1]) AS f, array_to_string(list_transform(d, lambda x: x + 1), '') AS digits FROM m)
 SELECT p_partkey, translate(array_to_string(b, ''), digits, '1234') AS board, translate(array_to_string(f, ''), digits, '1234') AS solution, array_to_string(ro, '') AS row_order, array_to_string(co, '') AS column_order, digits, true AS holds FROM n"""
)
def permuted_squares(spark, sf_dir):
    """Boards of four digits and their solutions under one renaming of rows, columns and digits each; solutions still hold."""
    digit = lambda r, c: (((F.lit(r * 2 + r // 2 + c) + F.col("p_partkey")) % 4) + 1).cast("string")
    full = F.array(*[F.concat(*[digit(r, c) for c in range(4)]) for r in range(4)])
    board = F.array(*[F.concat(*[F.when(F.col("p_partkey") * (r * 4 + c + 1) % 3 == 0, ".").otherwise(digit(r, c)) for c in range(4)]) for r in range(4)])
    rows = puzzles.permuted_squares(table(spark, sf_dir, "part").select("p_partkey", board.alias("board"), full.alias("solution")), "p_partkey", ["board", "solution"], (2, 2), 7)
    flat = [F.array_join(c, "").alias(c) for c in ("board", "solution", "row_order", "column_order")]
    return rows.select("p_partkey", *flat, "digits", puzzles.square_holds("solution", (2, 2)).alias("holds"))


@query(
    """WITH s AS (SELECT s_nationkey AS g, s_suppkey AS k, CAST(s_acctbal AS DOUBLE) AS a, CAST(s_suppkey % 17 AS DOUBLE) AS b FROM supplier),
 x AS (SELECT g, k, CASE WHEN max(a) OVER w > min(a) OVER w THEN (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) ELSE 0 END AS a,
  CASE WHEN max(b) OVER w > min(b) OVER w THEN (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) ELSE 0 END AS b FROM s WINDOW w AS (PARTITION BY g)),
 p1 AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY g ORDER BY k) = 1),
 d1 AS (SELECT x.*, (x.a - p.a) * (x.a - p.a) + (x.b - p.b) * (x.b - p.b) AS gap FROM x JOIN p1 p ON x.g = p.g AND x.k <> p.k),
 p2 AS (SELECT * FROM d1 QUALIFY row_number() OVER (PARTITION BY g ORDER BY gap DESC, k) = 1),
 d2 AS (SELECT d.g, d.k, least(d.gap, (d.a - p.a) * (d.a - p.a) + (d.b - p.b) * (d.b - p.b)) AS gap FROM d1 d JOIN p2 p ON d.g = p.g AND d.k <> p.k),
 p3 AS (SELECT * FROM d2 QUALIFY row_number() OVER (PARTITION BY g ORDER BY gap DESC, k) = 1)
 SELECT g AS nation, k AS supplier, 1 AS place FROM p1 UNION ALL SELECT g, k, 2 FROM p2 UNION ALL SELECT g, k, 3 FROM p3"""
)
def diverse_suppliers(spark, sf_dir):
    """Three suppliers of each nation, each the farthest from those before."""
    vector = F.array(F.col("s_acctbal").cast("double"), (F.col("s_suppkey") % 17).cast("double")).alias("v")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("supplier"), vector)
    return puzzles.diverse(rows, "nation", "supplier", "v", 3).drop("v")
