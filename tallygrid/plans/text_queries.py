"""Queries of parsing, payloads and exports, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions import answers as a
from tallygrid.sources import records

from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


#: An answer line made from each order, so that the parser runs over a whole table.
_ANSWER = "concat('Line ', {k}, chr(10), 'ANSWER: (', {k} % 9 + 1, ',', {k} % 4 + 1, '), (2,', {k} % 3, ').', chr(10), 'answer : (', {k} % 7, ', 1)', CASE WHEN {k} % 2 = 0 THEN '.' ELSE '..' END)"


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ANSWER.format(k="o_orderkey")).alias("t"))


_ANSWERS_SQL = f"a AS (SELECT o_orderkey, {_ANSWER.format(k='o_orderkey')} AS t FROM orders)"


@query(
    f"""WITH {_ANSWERS_SQL}, l AS (SELECT o_orderkey, trim(list_last(regexp_extract_all(t, '(?im)^\\s*ANSWER\\s*:\\s*(.+?)\\s*$', 1))) AS line FROM a)
 SELECT o_orderkey, CASE WHEN line LIKE '%.' AND line NOT LIKE '%..' THEN rtrim(line[:-2]) ELSE line END AS answer, line LIKE '%.' AND line NOT LIKE '%..' AS stripped FROM l"""
)
def answer_line_extract(spark, sf_dir):
    line = a.final_line(F.col("t"))
    return _answers(spark, sf_dir).select("o_orderkey", a.without_period(line).alias("answer"), a.has_period(line).alias("stripped"))


@query(
    f"""WITH {_ANSWERS_SQL}, p AS (SELECT o_orderkey, unnest(regexp_extract_all(t, '\\(?\\s*(\\d+)\\s*,\\s*(\\d+)\\s*\\)?', 1)) AS r, unnest(regexp_extract_all(t, '\\(?\\s*(\\d+)\\s*,\\s*(\\d+)\\s*\\)?', 2)) AS c FROM a)
 SELECT o_orderkey, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, count(*) AS n FROM p GROUP BY ALL"""
)
def coordinate_extract(spark, sf_dir):
    rows = _answers(spark, sf_dir).select("o_orderkey", F.explode(a.coordinates(F.col("t"))["value"]).alias("p"))
    return rows.select("o_orderkey", F.col("p")[0].alias("r"), F.col("p")[1].alias("c")).groupBy("o_orderkey", "r", "c").agg(F.count("*").alias("n"))


@query(
    """WITH m AS (SELECT l_orderkey, l_linenumber, regexp_extract_all(upper(l_returnflag || repeat('u', CAST(l_linenumber AS INTEGER)) || ' ' || repeat('R', CAST(l_suppkey % 5 AS INTEGER)) || ' x'), '[UDLR]+') AS runs FROM lineitem)
 SELECT l_orderkey, l_linenumber, list_reduce(runs, lambda x, y: CASE WHEN len(y) > len(x) THEN y ELSE x END) AS moves, CASE WHEN len(runs) > 1 THEN 'medium' ELSE 'high' END AS confidence FROM m"""
)
def move_extract(spark, sf_dir):
    t = F.expr("concat(l_returnflag, repeat('u', cast(l_linenumber as int)), ' ', repeat('R', cast(l_suppkey % 5 as int)), ' x')")
    found = a.moves(t)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", found["value"].alias("moves"), found["confidence"].alias("confidence"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events")
def json_overlay(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    return records.overlaid(rows, "props", "k bigint, event_type string")


@query(
    """WITH s AS (SELECT c_nationkey, string_agg(CAST(c_custkey AS VARCHAR), '; ' ORDER BY c_custkey) AS ids FROM customer GROUP BY ALL)
 SELECT c_nationkey, trim(x) AS trial_id, CAST(k AS INTEGER) AS sequence_position FROM (SELECT c_nationkey, unnest(string_split(ids, ';')) AS x, generate_subscripts(string_split(ids, ';'), 1) AS k FROM s)"""
)
def sequence_explode(spark, sf_dir):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda x: x.cast("string")), "; ")
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(ids.alias("ids")).select("c_nationkey", F.posexplode(F.split("ids", ";")).alias("k", "x"))
    return rows.select("c_nationkey", F.trim("x").alias("trial_id"), (F.col("k") + 1).alias("sequence_position"))


@query("SELECT substr(sha256(CAST(event_id AS VARCHAR)), 1, 20) AS request_id, event_type, value FROM events")
def export_allowlist(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 20).alias("request_id"), "event_type", "value", "props")
    return records.exported(rows, ["request_id", "event_type", "value"], dropped=["props"])


@query(
    """SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS page,
 len(regexp_extract_all(html, '<a ')) AS links FROM pages"""
)
def page_fields(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"),
        F.lower(F.regexp_extract("url", "://([^/?#]+)", 1)).alias("host"),
        F.regexp_extract("url", "[?&]page=([0-9]+)", 1).alias("page"),
        F.size(F.regexp_extract_all("html", F.lit("<a "), F.lit(0))).cast("long").alias("links"),
    )


@query("SELECT role, count(*) AS n, CAST(sum(len(text)) AS BIGINT) AS characters, count(*) FILTER (turn = 0) AS first_turns FROM conversations GROUP BY ALL")
def turn_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("role")
    return rows.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"), F.count_if(F.col("turn") == 0).alias("first_turns"))


@query("SELECT c_custkey, CASE WHEN abs(c_acctbal / 100000) < 0.005 THEN 0.0 ELSE c_acctbal / 100000 END AS shown, printf('%.2f', CASE WHEN abs(c_acctbal / 100000) < 0.005 THEN 0 ELSE floor(abs(c_acctbal) / 1000) / 100 * sign(c_acctbal) END) AS cell FROM customer")
def display_cells(spark, sf_dir):
    x = F.col("c_acctbal") / 100000
    small = F.abs(x) < 0.005
    cell = F.when(small, 0.0).otherwise(F.floor(F.abs("c_acctbal") / 1000) / 100 * F.signum("c_acctbal"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(small, 0.0).otherwise(x).alias("shown"), F.printf(F.lit("%.2f"), cell).alias("cell"))


@query(
    """SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(value AS VARCHAR) END, '') IS NOT NULL, false) AS from_value,
 round(coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END, CAST(user_id AS DOUBLE)), 6) AS effort FROM events"""
)
def effort_projection(spark, sf_dir):
    first = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.nullif(first, F.lit("")).isNotNull().alias("from_value"), F.round(a.first_number(first, F.col("user_id")), 6).alias("effort"))


@query(
    """SELECT s_suppkey, n_name AS condition, CAST(l AS BIGINT) AS answers FROM (SELECT s_suppkey, s_nationkey, count(*) AS l FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)
 JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (0, 1)"""
)
def condition_decode(spark, sf_dir):
    # Rows whose code the dimension doesn't list are skipped: an inner join.
    listed = table(spark, sf_dir, "nation").filter("n_regionkey in (0, 1)").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("condition"))
    rows = table(spark, sf_dir, "supplier").join(listed, "s_nationkey").select("s_suppkey", "condition")
    loads = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("answers"))
    return rows.join(loads, "s_suppkey").select("s_suppkey", "condition", "answers")


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag <> 'N' AS valid, CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_linestatus END AS abstract, l_returnflag AS concrete FROM lineitem)
 SELECT l_orderkey, l_linenumber, CASE WHEN valid THEN coalesce(nullif(abstract, ''), nullif(concrete, '')) END AS klass FROM r"""
)
def class_resolution(spark, sf_dir):
    abstract = F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.col("l_linestatus"))
    klass = a.resolved_class(F.col("l_returnflag") != "N", abstract, F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", klass.alias("klass"))
