"""Queries of puzzle pools, their scores, and the cue, pair and formulation modules, each with its SQL.

Boards are made of the hexadecimal digits of a part's hash, so that both forms have the same ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.operators import modules, ordering, pools, puzzles
from tallygrid.streaming import resume

from .source_queries import scratch
from .study_queries import rounded
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def whole(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.once(table(spark, sf_dir, "part"), "_h", F.sha2(F.col("p_partkey").cast("string"), 256))


def _digit(k: int) -> Column:
    return F.substring("_h", k + 1, 1)


def _boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of 4 x 4 cells, each a clue with a chance of five in sixteen."""
    cell = lambda k: F.when(_digit(2 * k) < "5", F.translate(_digit(2 * k + 1), "0123456789abcdef", "1234123412341234")).otherwise(".")
    board = F.array(*[F.concat(*[cell(4 * r + c) for c in range(4)]) for r in range(4)])
    return _hashed(spark, sf_dir).select(F.col("p_partkey").cast("long").alias("puzzle_id"), F.col("p_type").alias("family"), "p_size", board.alias("board"))


_SQUARE_SQL = """b AS (SELECT CAST(p_partkey AS BIGINT) AS puzzle_id, p_type AS family, p_size, array_to_string(list_transform(range(16), lambda k: CASE WHEN h[2 * k + 1] < '5' THEN translate(h[2 * k + 2], '0123456789abcdef', '1234123412341234') ELSE '.' END), '') AS s
  FROM (SELECT *, sha256(CAST(p_partkey AS VARCHAR)) AS h FROM part)),
 u AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY s ORDER BY puzzle_id) = 1),
 c AS (SELECT puzzle_id, k, k // 4 AS r, k % 4 AS c, s[k + 1] AS x FROM u, range(16) t(k)),
 e AS (SELECT a.puzzle_id, a.k, (a.r + 1) || ',' || (a.c + 1) AS t, bool_or(o.x = '1') AS taken, count(*) FILTER (o.x <> '.') AS visible
  FROM c a JOIN c o ON o.puzzle_id = a.puzzle_id AND (o.r = a.r OR o.c = a.c OR (o.r // 2 = a.r // 2 AND o.c // 2 = a.c // 2)) WHERE a.x = '.' GROUP BY ALL),
 q AS (SELECT puzzle_id, count(*) FILTER (NOT taken) AS n_solutions, count(*) AS n_empty, min(visible) FILTER (NOT taken) AS least_visible, max(visible) FILTER (NOT taken) AS most_visible FROM e GROUP BY ALL HAVING count(*) FILTER (NOT taken) BETWEEN 3 AND 8),
 pool AS (SELECT * FROM q JOIN u USING (puzzle_id))"""


def _square_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.square_pool(_boards(spark, sf_dir), "1", (2, 2))


_FEW_SQL = "CASE WHEN n_solutions <= 3 THEN 18 WHEN n_solutions <= 6 THEN 9 ELSE 2 END"


@query(
    f"""WITH {_SQUARE_SQL}, s AS (SELECT *, greatest(0, least(100, 10 + 1.2 * n_empty - 4 * most_visible - 1.2 * greatest(0, n_solutions - 2))) AS difficulty FROM pool)
 SELECT puzzle_id, s AS board, n_solutions, n_empty, least_visible, most_visible, round(CAST(least(100, 10 + greatest(0, least(1, (n_empty - 8) / 20)) * 28 + CASE WHEN most_visible <= 3 THEN 18 ELSE 0 END + {_FEW_SQL}) AS DOUBLE), 6) AS pressure,
  round(CAST(difficulty AS DOUBLE), 6) AS difficulty, CASE WHEN difficulty < 30 THEN 'easy' WHEN difficulty < 55 THEN 'medium' ELSE 'hard' END AS level FROM s"""
)
def square_pool(spark, sf_dir):
    """Boards on which a 1 may go in three to eight cells, with the pressure of the search and the difficulty."""
    rows = _square_pool(spark, sf_dir).select("puzzle_id", F.array_join("board", "").alias("board"), "n_solutions", "n_empty", "least_visible", "most_visible", "pressure", "difficulty", "level")
    return whole(rounded(rows, "pressure", "difficulty"), "n_solutions", "n_empty", "least_visible", "most_visible")


@query(
    f"""WITH RECURSIVE b AS (SELECT p_partkey AS p, array_to_string(list_transform(range(25), lambda k: CASE WHEN k = 0 THEN 'S' WHEN k = 24 THEN 'G' WHEN h[k + 1] < '6' THEN '#' ELSE '.' END), '') AS s FROM (SELECT *, sha256(CAST(p_partkey AS VARCHAR)) AS h FROM part)),
 u AS (SELECT min(p) AS p, s, len(replace(replace(replace(s, '.', ''), 'S', ''), 'G', '')) / 25 AS density FROM b GROUP BY s HAVING density >= 0.2),
 c AS (SELECT p, CAST(k // 5 AS INTEGER) AS r, CAST(k % 5 AS INTEGER) AS c FROM u, range(25) t(k) WHERE s[k + 1] <> '#'),
 e AS (SELECT a.p, a.r, a.c, b.r AS r2, b.c AS c2 FROM c a JOIN c b ON b.p = a.p AND abs(b.r - a.r) + abs(b.c - a.c) = 1),
 w AS (SELECT DISTINCT p, 0 AS r, 0 AS c, 0 AS d FROM c UNION SELECT e.p, r2, c2, d + 1 FROM w JOIN e ON e.p = w.p AND e.r = w.r AND e.c = w.c WHERE d < 24),
 reach AS (SELECT p, r, c, min(d) AS d FROM w GROUP BY ALL),
 v AS (SELECT DISTINCT p, 0 AS r, 0 AS c, 0 AS d, '' AS way FROM c UNION ALL SELECT e.p, r2, c2, v.d + 1, way || (r2 * 5 + c2) || ' ' FROM v JOIN e ON e.p = v.p AND e.r = v.r AND e.c = v.c JOIN reach x ON x.p = e.p AND x.r = r2 AND x.c = c2 AND x.d = v.d + 1),
 g AS (SELECT p, max(d) AS shortest, count(*) AS n_solutions FROM v WHERE r = 4 AND c = 4 GROUP BY ALL HAVING max(d) BETWEEN 8 AND 22 AND count(*) BETWEEN 3 AND 8),
 n AS (SELECT p, r, c, count(*) AS degree FROM e GROUP BY ALL),
 f AS (SELECT p, count(*) FILTER (degree = 1 AND r + c NOT IN (0, 8)) AS dead_ends, count(*) FILTER (degree >= 3) AS branches FROM reach JOIN n USING (p, r, c) GROUP BY ALL)
 SELECT CAST(p AS BIGINT) AS puzzle_id, s AS board, CAST(shortest AS BIGINT) AS shortest, n_solutions, CAST(shortest - 8 AS BIGINT) AS detour, dead_ends, branches, density,
  round(CAST(least(100, greatest(0, least(1, (shortest - 7) / 15)) * 35 + greatest(0, least(1, (branches - 2) / 16)) * 25 + greatest(0, least(1, dead_ends / 12)) * 15 + greatest(0, least(1, (density - 0.15) / 0.23)) * 10 + {_FEW_SQL}) AS DOUBLE), 6) AS pressure
 FROM g JOIN f USING (p) JOIN u USING (p)"""
)
def maze_pool(spark, sf_dir):
    """Mazes of 5 x 5 with three to eight shortest ways, their counts and the pressure of the search."""
    cell = lambda k: F.lit("S") if k == 0 else F.lit("G") if k == 24 else F.when(_digit(k) < "6", "#").otherwise(".")
    board = F.array(*[F.concat(*[cell(5 * r + c) for c in range(5)]) for r in range(5)])
    rows = _hashed(spark, sf_dir).select(F.col("p_partkey").cast("long").alias("puzzle_id"), board.alias("board"))
    found = pools.maze_pool(rows, 5, (8, 22)).withColumn("board", F.array_join("board", ""))
    return whole(rounded(found, "pressure"), "shortest", "n_solutions", "detour", "dead_ends", "branches")


@query(
    """WITH b AS (SELECT CAST(p_partkey AS BIGINT) AS puzzle_id, sha256(CAST(p_partkey AS VARCHAR)) AS h FROM part),
 c AS (SELECT puzzle_id, k // 4 AS r, k % 4 AS c, CASE WHEN h[2 * k + 1] < '5' THEN translate(h[2 * k + 2], '0123456789abcdef', '1234123412341234') ELSE '.' END AS x FROM b, range(16) t(k)),
 f AS (SELECT a.puzzle_id, a.r, a.c, 4 - count(DISTINCT o.x) FILTER (o.x <> '.') AS options FROM c a JOIN c o ON o.puzzle_id = a.puzzle_id AND (o.r = a.r OR o.c = a.c OR (o.r // 2 = a.r // 2 AND o.c // 2 = a.c // 2)) WHERE a.x = '.' GROUP BY ALL HAVING NOT bool_or(o.x = '1'))
 SELECT puzzle_id, r + 1 AS r, c + 1 AS c, options, least(count(*) OVER (PARTITION BY puzzle_id, r), count(*) OVER (PARTITION BY puzzle_id, c), count(*) OVER (PARTITION BY puzzle_id, r // 2, c // 2)) AS least_targets FROM f"""
)
def square_targets(spark, sf_dir):
    """The cells where a 1 may go: how many digits may go there, and the fewest such cells of a cell's row, column and box."""
    cells = puzzles.sudoku_features(pools.square_targets(_boards(spark, sf_dir), "1", (2, 2)))
    return whole(cells.select("puzzle_id", "r", "c", "options", "least_targets"), "r", "c", "options", "least_targets")


_ABOUT = {k: [j for j in range(12) if j != k and abs(j // 4 - k // 4) <= 1 and abs(j % 4 - k % 4) <= 1] for k in range(12)}
_NEAR_SQL = f"[{', '.join(str(_ABOUT[k]) for k in range(12))}]"


@query(
    f"""WITH h AS (SELECT CAST(p_partkey AS BIGINT) AS p, sha256(CAST(p_partkey AS VARCHAR)) AS h, {_NEAR_SQL} AS near FROM part),
 m AS (SELECT *, list_transform(range(12), lambda k: CASE WHEN h[2 * k + 1] < '4' OR h[2 * k + 2] < '6' THEN '?' ELSE CAST(len(list_filter(near[k + 1], lambda j: h[2 * j + 1] < '4')) AS VARCHAR) END) AS x FROM h),
 d AS (SELECT p, x, near, list_sum(list_transform(range(12), lambda k: CASE WHEN x[k + 1] = '?' THEN 1 << k ELSE 0 END)) AS unknown,
  list_transform(list_filter(range(12), lambda k: x[k + 1] <> '?'), lambda k: struct_pack(mask := CAST(coalesce(list_sum(list_transform(near[k + 1], lambda j: CASE WHEN x[j + 1] = '?' THEN 1 << j ELSE 0 END)), 0) AS BIGINT), n := CAST(x[k + 1] AS INTEGER))) AS clues FROM m),
 u AS (SELECT *, kind FROM d, (VALUES ('safe'), ('mine')) v(kind) QUALIFY row_number() OVER (PARTITION BY x, kind ORDER BY p) = 1),
 a AS (SELECT p, kind, s FROM u, range(4096) t(s) WHERE s & ~CAST(unknown AS BIGINT) = 0 AND len(list_filter(clues, lambda c: bit_count(s & c.mask) <> c.n)) = 0),
 f AS (SELECT p, kind, count(*) AS n_assignments, bit_and(s) AS every, bit_or(s) AS either FROM a GROUP BY ALL),
 g AS (SELECT f.*, x, near, len(list_filter(x, lambda y: y = '?')) AS n_unknown, list_filter(range(12), lambda k: x[k + 1] = '?' AND ((CASE WHEN kind = 'mine' THEN every ELSE ~either END) >> k) & 1 = 1) AS cells FROM f JOIN u USING (p, kind)),
 q AS (SELECT *, len(cells) AS n_solutions, list_max(list_transform(cells, lambda k: len(list_filter(near[k + 1], lambda j: x[j + 1] <> '?')))) AS most_clues FROM g WHERE len(cells) BETWEEN 3 AND 8),
 s AS (SELECT *, greatest(0, least(100, 12 + 2.2 * n_unknown + 8 * log2(n_assignments) - 5 * most_clues - 1.5 * greatest(0, n_solutions - 2))) AS difficulty FROM q)
 SELECT p AS puzzle_id, kind, array_to_string(x, '') AS board, array_to_string(list_transform(cells, lambda k: (k // 4 + 1) || ',' || (k % 4 + 1)), ' ') AS cells, n_unknown, n_assignments, n_solutions, CAST(most_clues AS BIGINT) AS most_clues,
  round(CAST(least(100, greatest(0, least(1, (n_unknown - 6) / 10)) * 28 + greatest(0, least(1, log2(n_assignments) / 6)) * 28 + CASE WHEN most_clues <= 1 THEN 18 ELSE 0 END + {_FEW_SQL}) AS DOUBLE), 6) AS pressure,
  round(CAST(difficulty AS DOUBLE), 6) AS difficulty, CASE WHEN difficulty < 30 THEN 'easy' WHEN difficulty < 55 THEN 'medium' ELSE 'hard' END AS level FROM s"""
)
def mine_pool(spark, sf_dir):
    """Boards of 3 x 4 with three to eight cells that are safe, or mines, in every way to lay the mines."""
    mine = lambda k: (_digit(2 * k) < "4").cast("int")
    cell = lambda k: F.when((_digit(2 * k) < "4") | (_digit(2 * k + 1) < "6"), "?").otherwise(sum((mine(j) for j in _ABOUT[k]), F.lit(0)).cast("string"))
    board = F.array(*[F.concat(*[cell(4 * r + c) for c in range(4)]) for r in range(3)])
    rows = pools.once(_hashed(spark, sf_dir), "board", board)
    rows = rows.select(F.col("p_partkey").cast("long").alias("puzzle_id"), "board", F.explode(F.array(F.lit("safe"), F.lit("mine"))).alias("kind"))
    found = pools.mine_pool(rows, (3, 4)).withColumns({"board": F.array_join("board", ""), "cells": F.array_join(F.transform("cells", modules.cell_text), " ")})
    return whole(rounded(found, "pressure", "difficulty"), "n_unknown", "n_assignments", "n_solutions", "most_clues")


@query(
    """WITH r AS (SELECT p_brand AS puzzle_id, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS rank, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
 SELECT puzzle_id, p_partkey, rank, round((rank - 1) / greatest(1, n - 1), 6) AS percentile, CASE WHEN rank = 1 THEN 'simplest' WHEN rank <= greatest(2, ceil(n / 3)) THEN 'simple' WHEN rank >= greatest(1, n - floor(n / 3) + 1) THEN 'complex' ELSE 'middle' END AS bucket FROM r"""
)
def ranked_simplicity(spark, sf_dir):
    """Places of a brand's parts, from the simplest to the complex third."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("puzzle_id"), "p_partkey", "p_size")
    return whole(rounded(pools.ranked_simplicity(rows, "p_size", ["p_partkey"]).drop("p_size"), "percentile"), "rank")


#: Sources of modules: boards that no part of the main study (sizes over 40) has.
_FRESH_SQL = _SQUARE_SQL + ", fresh AS (SELECT * FROM pool WHERE s NOT IN (SELECT s FROM b WHERE p_size > 40))"


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.fresh(_square_pool(spark, sf_dir), _boards(spark, sf_dir).filter("p_size > 40"), "board")


@query(
    f"""WITH {_FRESH_SQL}, f AS (SELECT * FROM fresh WHERE n_solutions BETWEEN 4 AND 8 AND n_empty >= 2 * n_solutions QUALIFY row_number() OVER (PARTITION BY family ORDER BY most_visible - least_visible DESC, puzzle_id) <= 5),
 v AS (SELECT f.*, t, taken, row_number() OVER (PARTITION BY puzzle_id, taken ORDER BY sha256('5:' || CASE WHEN taken THEN 'decoys' ELSE 'cells' END || ':' || puzzle_id || ':' || t)) AS j, (n_solutions + 1) // 2 AS half FROM f JOIN e USING (puzzle_id)),
 a AS (SELECT *, CASE WHEN j <= half THEN 'half_a' WHEN j <= n_solutions THEN 'half_b' END AS arm FROM v)
 SELECT family, 'cue_' || puzzle_id AS block, 'cue_' || puzzle_id || '/' || condition AS trial, condition, CASE WHEN condition = 'baseline' THEN 'original' ELSE 'variant' END AS role,
  coalesce(string_agg(t, ' ' ORDER BY t) FILTER (NOT taken AND arm = condition), '') AS valid, coalesce(string_agg(t, ' ' ORDER BY t) FILTER (taken AND arm = condition), '') AS invalid
 FROM a, (VALUES ('baseline'), ('half_a'), ('half_b')) x(condition) GROUP BY ALL"""
)
def cue_module(spark, sf_dir):
    """Five boards a family: bare, and with either half of the answers shown among as many wrong cells."""
    trials = modules.cue_module(_fresh(spark, sf_dir), [F.desc(F.col("most_visible") - F.col("least_visible"))], 5, 5)
    text = lambda c: F.array_join(F.transform(c, modules.cell_text), " ").alias(c)
    return trials.select("family", "block", "trial", "condition", "role", text("valid"), text("invalid"))


@query(
    f"""WITH {_FRESH_SQL}, p AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY most_visible - least_visible DESC, puzzle_id) AS place FROM fresh),
 a AS (SELECT *, ['mirror_h', 'mirror_v', 'mirror_hv'][CAST((place - 1) % 3 + 1 AS BIGINT)] AS how FROM p WHERE place <= 5),
 t AS (SELECT *, CASE how WHEN 'mirror_hv' THEN reverse(s) WHEN 'mirror_v' THEN s[13:16] || s[9:12] || s[5:8] || s[1:4] ELSE reverse(s[1:4]) || reverse(s[5:8]) || reverse(s[9:12]) || reverse(s[13:16]) END AS second FROM a),
 o AS (SELECT family, puzzle_id AS control_id, s AS control, row_number() OVER (PARTITION BY family ORDER BY sha256('6:' || puzzle_id), puzzle_id) - 1 AS k FROM p WHERE place > 5 QUALIFY k < 5),
 n AS (SELECT family, count(*) AS n FROM o GROUP BY ALL),
 m AS (SELECT t.*, control_id, control FROM t JOIN n USING (family) JOIN o ON o.family = t.family AND o.k = (t.place - 1) % n.n)
 SELECT family, 'pair_' || puzzle_id AS block, 'pair_' || puzzle_id || '/' || condition || '/' || role AS trial, condition, role, position, CASE WHEN condition = 'unrelated' AND role = 'first' THEN control_id ELSE puzzle_id END AS shown, how,
  CASE WHEN role = 'second' THEN second WHEN condition = 'related' THEN s ELSE control END AS board
 FROM m, (VALUES ('alone', 'second', 1), ('related', 'first', 1), ('related', 'second', 2), ('unrelated', 'first', 1), ('unrelated', 'second', 2)) x(condition, role, position)"""
)
def pair_module(spark, sf_dir):
    """Five boards a family: their reflection alone, after the board itself, and after another board."""
    trials = modules.pair_module(_fresh(spark, sf_dir), [F.desc(F.col("most_visible") - F.col("least_visible"))], 5, 6)
    return trials.select("family", "block", "trial", "condition", "role", "position", "shown", "how", F.array_join("board", "").alias("board"))


@query(
    """WITH r AS (SELECT p_type AS family, p_partkey, list_sort([p_partkey % 9 + 1, p_partkey % 7 + 1, p_partkey % 5 + 1, p_size % 3 + 1]) AS n, p_size % 10 AS k FROM part),
 f AS (SELECT * FROM r WHERE k BETWEEN 3 AND 8 AND n[1] <> n[4] QUALIFY row_number() OVER (PARTITION BY family ORDER BY abs(k - 5), p_partkey) <= 40),
 o AS (SELECT *, list_transform(list_sort(list_transform(range(1, 5), lambda j: struct_pack(h := sha256('9:' || p_partkey || ':' || j), j := j))), lambda x: n[x.j]) AS other FROM f),
 t AS (SELECT *, CASE WHEN other = n THEN [n[2], n[3], n[4], n[1]] ELSE other END AS turned FROM o)
 SELECT family, 'formulation_' || p_partkey AS block, 'formulation_' || p_partkey || '/' || condition AS trial, condition, role, array_to_string(CASE WHEN role = 'original' THEN n ELSE turned END, ' ') AS numbers FROM t, (VALUES ('ascending', 'original'), ('shuffled', 'variant')) x(condition, role)"""
)
def formulation_module(spark, sf_dir):
    """Forty sets of numbers a family, in ascending and in another order."""
    numbers = F.array(F.col("p_partkey") % 9 + 1, F.col("p_partkey") % 7 + 1, F.col("p_partkey") % 5 + 1, F.col("p_size") % 3 + 1)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("puzzle_id"), F.col("p_type").alias("family"), numbers.alias("numbers"), (F.col("p_size") % 10).alias("n_solutions"))
    trials = modules.formulation_module(rows, [F.abs(F.col("n_solutions") - 5)], 40, 9)
    return trials.select("family", "block", "trial", "condition", "role", F.concat_ws(" ", F.transform("numbers", lambda x: x.cast("string"))).alias("numbers"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def streamed_latest(spark, sf_dir):
    """Each user's last event, kept by a stream of four batches that rewrite the buckets they touch."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    log, kept = scratch(spark, "log"), scratch(spark, "kept")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(files, "event_id").write.parquet(log)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(log)
    resume.upserted(stream, kept, ["user_id"], ["ts", "event_id"], f"{kept}-checkpoint", buckets=16).awaitTermination()
    return resume.stored(spark, kept, rows.schema).select("user_id", "event_id", "event_type")


_P_SQL = "CAST((p_partkey * 7919) % 9973 + 1 AS DOUBLE) / 99740000"


@query(
    f"""WITH t AS (SELECT p_partkey, p_size, {_P_SQL} AS p FROM part), r AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, p_partkey) AS k FROM t WHERE p_size > 3)
 SELECT p_partkey, round(max(least(1.0, (m - k + 1) * p)) OVER (ORDER BY k), 9) AS p_holm FROM r UNION ALL SELECT p_partkey, NULL FROM t WHERE NOT p_size > 3"""
)
def holm_over_all(spark, sf_dir):
    """All parts' tests as one family, ranked by ranges; parts of the least sizes are left out of it."""
    tests = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.expr(_P_SQL).alias("p"))
    return ordering.holm(tests, "p", ["p_partkey"], None, F.col("p_size") > 3).select("p_partkey", (F.round("p_holm", 9) + F.lit(0.0)).alias("p_holm"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer")
def numbered_rows(spark, sf_dir):
    """Each customer's place in one order of all, by prefix sums of ranges."""
    return whole(ordering.numbered(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")]).drop("c_acctbal"), "place")
