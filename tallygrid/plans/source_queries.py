"""Queries of the readers, writers, projections and record operators, each with its SQL.

What a query writes goes to a new folder in the warehouse and is read back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.functions import answers as a
from tallygrid.functions import usage as u
from tallygrid.operators import ordering, store
from tallygrid.sources import records

from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the warehouse."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


_EVENT = "event_id bigint, user_id bigint, event_type string, value double"


@query("SELECT event_id, user_id, event_type, value FROM events")
def jsonl_scan(spark, sf_dir):
    path = scratch(spark, "events")
    records.write_jsonl(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), path)
    return records.read_jsonl(spark, path, _EVENT).select("event_id", "user_id", "event_type", "value")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def jsonl_gzip_scan(spark, sf_dir):
    path = scratch(spark, "events")
    records.write_sorted(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), path, ["event_id"], compressed=True)
    rows = records.read_jsonl(spark, path, _EVENT)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_round_trip(spark, sf_dir):
    path = scratch(spark, "supplier")
    records.write_csv(table(spark, sf_dir, "supplier"), path)
    return records.read_csv(spark, path, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")


@query("SELECT o_orderstatus AS status, CASE WHEN o_orderstatus = 'P' THEN 'gz' ELSE 'plain' END AS kind, o_orderkey, o_custkey FROM orders")
def multi_input(spark, sf_dir):
    """One input for each status, one of them compressed."""
    folder, inputs = scratch(spark, "inputs"), {}
    for status in ("F", "O", "P"):
        rows = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == status).select("o_custkey", "o_orderkey")
        records.write_jsonl(rows, f"{folder}/{status}.jsonl{'.gz' if status == 'P' else ''}", compressed=status == "P")
        path = records.one_input(spark, folder, status)
        inputs[status, "gz" if path.endswith(".gz") else "plain"] = records.read_jsonl(spark, path, "o_custkey bigint, o_orderkey bigint")
    return records.labelled_union(inputs, ["status", "kind"])


@query("SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS price FROM part GROUP BY ALL")
def replaced_table(spark, sf_dir):
    """A table written whole, twice: what is read is the second."""
    path, rows = scratch(spark, "part"), table(spark, sf_dir, "part")
    records.write_whole(rows.filter("p_size > 10"), path)
    records.write_whole(rows, path)
    return spark.read.parquet(path).groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"))


@query("SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_orderkey) AS orders FROM orders GROUP BY ALL")
def appended_log(spark, sf_dir):
    path, rows = scratch(spark, "log"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    for k in range(3):
        records.append_log(rows.filter(F.pmod("o_orderkey", F.lit(3)) == k), path)
    return records.read_jsonl(spark, path, "o_orderkey bigint, o_orderstatus string").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("orders"))


@query("SELECT c_custkey, c_name FROM customer")
def private_sink(spark, sf_dir):
    path = scratch(spark, "private")
    records.write_private(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), path)
    return records.read_jsonl(spark, path, "c_custkey bigint, c_name string")


@query("SELECT 'nation' AS name, count(*) AS n, 0 AS different FROM nation UNION ALL SELECT 'supplier', count(*), 0 FROM supplier UNION ALL SELECT 'customer', count(*), 0 FROM customer")
def backed_up(spark, sf_dir):
    folder = scratch(spark, "backup")
    tables = {n: table(spark, sf_dir, n) for n in ("nation", "supplier", "customer")}
    records.backup(tables, folder)
    out = None
    for name, rows in tables.items():
        copy = spark.read.parquet(f"{folder}/{name}")
        wrong = store.set_difference(rows, copy).agg(F.count("*").cast("int").alias("different"))
        own = copy.agg(F.lit(name).alias("name"), F.count("*").alias("n")).join(wrong, F.lit(True))
        out = own if out is None else out.unionAll(own)
    return out


@query(
    """WITH s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k, l_linestatus, l_quantity, l_returnflag FROM lineitem)
 SELECT CAST(l_orderkey AS VARCHAR) AS puzzle_id, CAST(k AS INTEGER) AS solution_index, l_orderkey || '_sol_' || lpad(CAST(k AS VARCHAR), 2, '0') AS solution_id,
  CASE WHEN l_linestatus = 'O' THEN 'open' ELSE l_orderkey || '_sol_' || lpad(CAST(k AS VARCHAR), 2, '0') END AS abstract_solution_id, l_returnflag AS canonical_answer,
  l_quantity AS quantity, CASE WHEN l_quantity <= 10 THEN 'few' WHEN l_quantity <= 30 THEN 'some' ELSE 'many' END AS solution_cluster FROM s"""
)
def catalog_rows(spark, sf_dir):
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.lit(None).cast("string").alias("solution_id"), F.when(F.col("l_linestatus") == "O", "open").alias("abstract_solution_id"), F.col("l_returnflag").alias("answer"))
    puzzles = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("puzzle_id")).agg(F.array_sort(F.collect_list(one)).alias("solutions"))
    out = records.solution_catalog(puzzles, {"quantity": F.col("s.l_quantity")}, u.bucket(F.col("s.l_quantity"), [10, 30], ["few", "some", "many"]))
    return out.withColumn("quantity", F.col("solution_features")["quantity"]).drop("solution_features")


@query("""SELECT n_nationkey, sha256('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}') AS sha256 FROM nation""")
def row_hashes(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", records.stable_hash("n_nationkey", "n_name").alias("sha256"))


@query(
    """SELECT 'P' || lpad(CAST(row_number() OVER (ORDER BY c_name) AS VARCHAR), CAST(greatest(4, length(CAST(row_number() OVER (ORDER BY c_name) AS VARCHAR))) AS INTEGER), '0') AS participant_id, CAST(c_custkey AS VARCHAR) AS puzzle_id, c_acctbal > 0 AS is_valid,
 CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'class' END AS solution_id, CASE WHEN c_custkey % 3 = 0 THEN 'abstract' WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'class' END AS abstract_solution_id, 1 AS attempt_index, 'HUMAN' AS source FROM customer"""
)
def deidentified_rows(spark, sf_dir):
    """Customers as people: new aliases in the order of their names, an accepted class before the submitted one."""
    rows = table(spark, sf_dir, "customer").select(
        "c_name", F.col("c_custkey").cast("string").alias("puzzle_id"), (F.col("c_acctbal") > 0).alias("is_correct"), F.lit("class").alias("solution_id"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("accepted_solution_id"), F.when(F.col("c_custkey") % 3 == 0, "abstract").alias("abstract_solution_id"),
    )
    aliases = records.covered(rows, records.pseudonyms(rows, "c_name", None), "c_name")
    out = records.deidentified(rows, aliases, "c_name", "alias")
    return out.select("participant_id", "puzzle_id", "is_valid", "solution_id", "abstract_solution_id", "attempt_index", "source")


@query(
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 4 = 1 THEN nullif(substr(o_orderstatus, 2), '') END, o_orderstatus) AS klass FROM orders"""
)
def canonical_preference(spark, sf_dir):
    accepted = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority"))
    submitted = F.when(F.col("o_orderkey") % 4 == 1, F.expr("substr(o_orderstatus, 2)"))
    return table(spark, sf_dir, "orders").select("o_orderkey", a.preferred(accepted, submitted, F.col("o_orderstatus")).alias("klass"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def primary_condition(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey", "o_custkey")


@query("SELECT s.scope, p_partkey FROM part JOIN (VALUES ('all'), ('main'), ('modules')) s(scope) ON s.scope = 'all' OR (s.scope = 'main') = (p_size <= 25)")
def scope_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 25, "cue").alias("module"))
    out = None
    for scope in ("all", "main", "modules"):
        own = store.in_scope(rows, "module", scope).select(F.lit(scope).alias("scope"), "p_partkey")
        out = own if out is None else out.unionAll(own)
    return out


@query(
    """WITH d AS (SELECT a.o_orderstatus AS "left", b.o_orderstatus AS "right", abs(a.v - b.v) AS value
  FROM (SELECT o_orderstatus, avg(o_totalprice) AS v FROM orders GROUP BY ALL) a, (SELECT o_orderstatus, avg(o_totalprice) AS v FROM orders GROUP BY ALL) b)
 SELECT "left", "right", round(value, 4) AS value, CASE "left" WHEN 'P' THEN 0 ELSE 1 END AS i, CASE "right" WHEN 'P' THEN 0 ELSE 1 END AS j FROM d WHERE "left" IN ('P', 'F') AND "right" IN ('P', 'F')"""
)
def matrix_subset(spark, sf_dir):
    means = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    b = means.select(F.col("o_orderstatus").alias("right"), F.col("v").alias("w"), F.lit(1).alias("k"))
    full = means.withColumn("k", F.lit(1)).join(b, "k").select(F.col("o_orderstatus").alias("left"), "right", F.round(F.abs(F.col("v") - F.col("w")), 4).alias("value"))
    return ordering.submatrix(full, ["P", "F"])


@query(
    """SELECT event_id, event_id % 5 = 0 OR event_type = 'error' AND event_id % 2 = 0 AS mock FROM events"""
)
def mock_rows(spark, sf_dir):
    """Two markers: a flag, and a provider's name."""
    flag = F.when(F.col("event_id") % 5 == 0, "TRUE").otherwise("false")
    provider = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "openai-Mock/v1").otherwise("mockingbird")
    return table(spark, sf_dir, "events").select("event_id", u.is_mock({"mock": flag, "provider": provider}).alias("mock"))


@query(
    """SELECT user_id, count(*) AS rows_seen, count(*) FILTER (value BETWEEN 1 AND 20) AS fast, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value IS NULL OR value < 1) AS untimed FROM events GROUP BY ALL"""
)
def quality_flags(spark, sf_dir):
    return store.quality_flags(table(spark, sf_dir, "events"), "user_id", F.col("value"), 20, F.col("event_type") == "error")


@query(
    """SELECT CASE WHEN done < total THEN 'collection_started' ELSE 'collection_complete' END AS status, total AS queue_rows, done AS completed, total - done AS remaining, errors, failed AS error_requests, unresolved, round(unresolved / greatest(1, total), 6) AS error_rate, round(valid, 6) AS valid_rate
 FROM (SELECT (SELECT count(*) FROM orders) AS total, (SELECT count(DISTINCT l_orderkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber < 4) AS done,
  (SELECT count(*) FROM lineitem WHERE l_tax > 0.07) AS errors, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_tax > 0.07) AS failed,
  (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_tax > 0.07 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber < 4)) AS unresolved,
  (SELECT avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber < 4)) AS valid)"""
)
def run_summary(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    queue = orders.select(F.col("o_orderkey").alias("request_id"))
    done = lines.filter("l_linenumber < 4").select(F.col("l_orderkey").alias("request_id")).distinct()
    done = done.join(orders.select(F.col("o_orderkey").alias("request_id"), (F.col("o_orderstatus") == "F").alias("valid")), "request_id")
    errors = lines.filter("l_tax > 0.07").select(F.col("l_orderkey").alias("request_id"))
    out = store.run_summary(queue, done, errors, "request_id", F.col("valid"))
    return out.withColumns({c: F.round(c, 6) for c in ("error_rate", "valid_rate")})


@query(
    """SELECT o_orderkey, c_custkey, total FROM (SELECT o_orderkey, c_custkey, o_orderdate, count(*) OVER () AS total FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE c_mktsegment = 'BUILDING' AND o_orderdate >= TIMESTAMP '1995-01-01') ORDER BY c_custkey, o_orderkey LIMIT 50 OFFSET 20"""
)
def export_page(spark, sf_dir):
    """Rows of the people of a cohort since a time, a page of them, with how many there are in all."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    people = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    page = store.export_page(rows, people, "c_custkey", ["c_custkey", "o_orderkey"], 50, 20, F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp"))
    return page.select("o_orderkey", "c_custkey", "total")


@query("SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN value END AS value, NULL::VARCHAR AS note FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, event_type, NULL, 'new' FROM events WHERE event_id % 3 = 0")
def schema_evolution(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    old = rows.filter("event_id % 3 <> 0").select("event_id", "event_type", F.expr("CASE WHEN event_id % 2 = 0 THEN value END").alias("value"))
    return records.evolved([old, rows.filter("event_id % 3 = 0").select("event_id", "event_type", F.lit("new").alias("note"))])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN substr(sha256(s_suppkey || '|' || s_name), 1, 20) ELSE s_name END AS public_id FROM supplier")
def backfilled_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").withColumn("public_id", F.when(F.col("s_suppkey") % 4 == 0, "").when(F.col("s_suppkey") % 2 != 0, F.col("s_name")))
    return records.backfilled(rows, "public_id", "s_suppkey", "s_name").select("s_suppkey", "public_id")


@query("SELECT count(*) AS n, 'orders' AS name FROM orders UNION ALL SELECT count(*), 'customer' FROM customer UNION ALL SELECT count(*), 'events' FROM events")
def table_counts(spark, sf_dir):
    return store.row_counts({n: table(spark, sf_dir, n) for n in ("orders", "customer", "events")})


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7 OR l_orderkey = 5 AND l_linenumber = 3")
def point_lookup(spark, sf_dir):
    """By key, or by key and the alias of a place in the order (T003)."""
    rows = table(spark, sf_dir, "lineitem")
    by_key = store.lookup(rows, {"l_orderkey": 7})
    by_place = store.lookup(rows, {"l_orderkey": 5}, "T003", "l_linenumber")
    return by_key.unionAll(by_place).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT event_id, event_type, CAST(row_number() OVER (ORDER BY ts, event_id) AS INTEGER) AS place FROM events WHERE user_id = 8")
def ordered_history(spark, sf_dir):
    return store.history(table(spark, sf_dir, "events").filter("user_id = 8"), "user_id", ["ts", "event_id"]).select("event_id", "event_type", "place")


@query("SELECT c_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS INTEGER) AS trial_order FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0")
def new_assignments(spark, sf_dir):
    """Two appends, participants and then their assignments, and what the two tables hold together."""
    people, given = scratch(spark, "participants"), scratch(spark, "assignments")
    rows = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey")
    records.append_log(rows, people)
    owned = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey").join(rows, "c_custkey")
    records.append_log(store.history(owned, "c_custkey", ["o_orderkey"]).withColumnRenamed("place", "trial_order"), given)
    known = records.read_jsonl(spark, people, "c_custkey bigint")
    return records.read_jsonl(spark, given, "c_custkey bigint, o_orderkey bigint, trial_order int").join(known, "c_custkey", "left_semi").select("c_custkey", "o_orderkey", "trial_order")


_MODULE = "CASE WHEN p_size < 10 THEN 'cue' WHEN p_size < 20 THEN NULL ELSE '' END"


@query(
    f"""SELECT p_partkey, coalesce(nullif({_MODULE}, ''), CASE WHEN p_size < 15 THEN 'pair' END, CASE WHEN p_size < 40 THEN 'spatial' END, 'main') AS module,
 coalesce(nullif({_MODULE}, ''), CASE WHEN p_size > 30 THEN 'x' END, nullif(CASE WHEN p_size > 25 THEN 'y' ELSE '' END, ''), 'canonical') AS condition FROM part"""
)
def metadata_fallbacks(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumns({"module": F.expr(_MODULE), "shown": F.expr("CASE WHEN p_size < 15 THEN 'pair' END"), "feature": F.expr("CASE WHEN p_size < 40 THEN 'spatial' END")})
    return rows.select(
        "p_partkey",
        a.preferred(F.col("module"), F.col("shown"), F.col("feature"), F.lit("main")).alias("module"),
        a.preferred(F.col("module"), F.expr("CASE WHEN p_size > 30 THEN 'x' END"), F.expr("CASE WHEN p_size > 25 THEN 'y' ELSE '' END"), F.lit("canonical")).alias("condition"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, CASE how WHEN 'mirror_h' THEN r WHEN 'mirror_v' THEN 8 - r ELSE 8 - r END AS r, CASE how WHEN 'mirror_v' THEN c ELSE 51 - c END AS c, how
 FROM (SELECT l_orderkey, l_linenumber, l_linenumber AS r, CAST(l_quantity AS INTEGER) AS c, unnest(['mirror_h', 'mirror_v', 'mirror_hv']) AS how FROM lineitem)"""
)
def reflected_cells(spark, sf_dir):
    rows, out = table(spark, sf_dir, "lineitem"), None
    for how in ("mirror_h", "mirror_v", "mirror_hv"):
        r, c = a.reflected(F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.lit(7), F.lit(50), how)
        own = rows.select("l_orderkey", "l_linenumber", r.alias("r"), c.alias("c"), F.lit(how).alias("how"))
        out = own if out is None else out.unionAll(own)
    return out


@query(
    """WITH f AS (SELECT p_partkey, p_brand, p_size, p_retailprice, p_size % 2 = 0 AS even, CASE WHEN p_size > 5 THEN [p_size % 3, p_size % 7] ELSE [p_size % 3] END AS digits FROM part),
 v AS (SELECT p_partkey, p_brand, 'even' AS name, CASE WHEN even THEN 1.0 ELSE 0.0 END AS value FROM f UNION ALL SELECT p_partkey, p_brand, 'p_size', p_size FROM f UNION ALL SELECT p_partkey, p_brand, 'p_retailprice', p_retailprice FROM f
  UNION ALL SELECT p_partkey, p_brand, 'digits_' || (k - 1), digits[k] FROM (SELECT p_partkey, p_brand, digits, unnest(range(1, len(digits) + 1)) AS k FROM f)),
 k AS (SELECT DISTINCT p_brand, name FROM v), d AS (SELECT f.p_partkey, k.p_brand, k.name, coalesce(v.value, 0) AS value FROM f JOIN k ON f.p_brand = k.p_brand LEFT JOIN v ON v.p_partkey = f.p_partkey AND v.name = k.name)
 SELECT p_partkey, name, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0 END, 6) AS scaled FROM d WINDOW w AS (PARTITION BY p_brand, name)"""
)
def feature_vectors(spark, sf_dir):
    digits = F.when(F.col("p_size") > 5, F.array(F.col("p_size") % 3, F.col("p_size") % 7)).otherwise(F.array(F.col("p_size") % 3))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice", (F.col("p_size") % 2 == 0).alias("even"), digits.alias("digits"))
    out = ordering.scaled_vectors(ordering.flattened(rows, ["p_partkey", "p_brand"], ["even", "p_size", "p_retailprice", "digits"]), ["p_brand"], ["p_partkey"])
    return out.select("p_partkey", "name", F.round("scaled", 6).alias("scaled"))


@query("SELECT event_id, CASE WHEN value IS NULL THEN NULL WHEN value <= 10 THEN 'low' WHEN value <= 50 THEN 'medium' ELSE 'high' END AS bucket, least(2.0, 0.25 * pow(2, event_id % 6)) AS delay FROM events")
def buckets_and_delays(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", u.bucket(F.col("value"), [10, 50], ["low", "medium", "high"]).alias("bucket"), u.retry_delay(F.col("event_id") % 6).alias("delay"))


@query(
    """SELECT event_id, provider, event_id AS input_tokens, user_id AS output_tokens, CASE provider WHEN 'openai' THEN event_id % 7 WHEN 'anthropic' THEN NULL WHEN 'gemini' THEN event_id % 5 END AS reasoning_tokens
 FROM (SELECT event_id, user_id, ['openai', 'anthropic', 'gemini'][CAST(event_id % 3 AS INTEGER) + 1] AS provider FROM events)"""
)
def usage_tokens(spark, sf_dir):
    payload = (
        F.when(F.col("provider") == "openai", F.printf(F.lit('{"input_tokens": %d, "output_tokens": %d, "output_tokens_details": {"reasoning_tokens": %d}}'), "event_id", "user_id", F.col("event_id") % 7))
        .when(F.col("provider") == "anthropic", F.printf(F.lit('{"input_tokens": %d, "output_tokens": %d}'), "event_id", "user_id"))
        .otherwise(F.printf(F.lit('{"promptTokenCount": %d, "candidatesTokenCount": %d, "thoughtsTokenCount": %d}'), "event_id", "user_id", F.col("event_id") % 5))
    )
    rows = table(spark, sf_dir, "events").withColumn("provider", F.element_at(F.array(*map(F.lit, ("openai", "anthropic", "gemini"))), (F.col("event_id") % 3 + 1).cast("int")))
    found = u.usage(F.col("provider"), payload)
    return rows.select("event_id", "provider", *[found[t].alias(t) for t in ("input_tokens", "output_tokens", "reasoning_tokens")])
