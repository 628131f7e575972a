"""Queries of the store, ordering and integrity operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallygrid.operators import integrity as i
from tallygrid.operators import ordering as o
from tallygrid.operators import store as st

from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return put


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


# Each part stands for a test of its brand's family; its p-value is made from its price, and size 1 is the control.
_P = "CAST((p_partkey * 7919) % 9973 + 1 AS DOUBLE) / 9974"


@query(
    f"""WITH t AS (SELECT p_partkey, p_brand, {_P} AS p FROM part WHERE p_size > 1),
 r AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS m, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_partkey) AS k FROM t),
 h AS (SELECT p_partkey, p_brand, p, max(least(1.0, (m - k + 1) * p)) OVER (PARTITION BY p_brand ORDER BY k) AS p_holm FROM r)
 SELECT p_partkey, p_brand, round(p, 6) AS p, round(p_holm, 6) AS p_holm FROM h
 UNION ALL SELECT p_partkey, p_brand, round({_P}, 6), NULL FROM part WHERE p_size <= 1"""
)
def holm_adjust(spark, sf_dir):
    tests = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", F.expr(_P).alias("p"))
    out = o.holm(tests, "p", ["p_partkey"], ["p_brand"], F.col("p_size") > 1)
    return rounded(out.select("p_partkey", "p_brand", "p", "p_holm"), "p", "p_holm")


@query(
    """SELECT p_partkey, round(CASE WHEN max(p_retailprice) OVER w > min(p_retailprice) OVER w
  THEN (p_retailprice - min(p_retailprice) OVER w) / (max(p_retailprice) OVER w - min(p_retailprice) OVER w) ELSE 0 END, 6) AS p_retailprice_scaled
 FROM part WINDOW w AS (PARTITION BY p_brand)"""
)
def minmax_scale(spark, sf_dir):
    out = o.minmax_scaled(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand"])
    return rounded(out.select("p_partkey", "p_retailprice_scaled"), "p_retailprice_scaled")


@query("SELECT p_partkey, CAST(ntile(3) OVER (PARTITION BY p_brand ORDER BY p_retailprice, md5(p_name), p_partkey) AS INTEGER) AS tertile FROM part")
def tertile_bucket(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("tie", F.md5("p_name"))
    return o.tertiles(rows, "p_retailprice", ["tie", "p_partkey"], ["p_brand"]).select("p_partkey", "tertile")


@query(
    """SELECT p_partkey, CAST(row_number() OVER w AS INTEGER) AS rank, round((row_number() OVER w - 1) / greatest(1, count(*) OVER (PARTITION BY p_brand) - 1), 6) AS percentile
 FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey)"""
)
def rank_percentile(spark, sf_dir):
    out = o.rank_percentile(table(spark, sf_dir, "part"), "p_retailprice", ["p_partkey"], ["p_brand"])
    return rounded(out.select("p_partkey", "rank", "percentile"), "percentile")


@query("SELECT o_orderkey, o_orderstatus, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS turn FROM orders")
def round_robin(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return o.round_robin(rows, "o_orderstatus", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_orderstatus", "turn")


@query(
    """WITH q AS (SELECT s_nationkey, s_suppkey, count(l_suppkey) AS quota FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL)
 SELECT s_nationkey, s_suppkey, quota, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY quota, md5(CAST(s_suppkey AS VARCHAR))) AS INTEGER) AS place FROM q
 QUALIFY place <= 2"""
)
def topk_quota(spark, sf_dir):
    loads = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("quota"))
    rows = table(spark, sf_dir, "supplier").join(loads, "s_suppkey", "left").select("s_nationkey", "s_suppkey", F.coalesce("quota", F.lit(0)).alias("quota"))
    rows = rows.withColumn("tie", F.md5(F.col("s_suppkey").cast("string")))
    return o.lowest_per_group(rows, "quota", ["tie"], ["s_nationkey"], 2).drop("tie")


@query(
    """WITH u AS (SELECT p_name, p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) = 1)
 SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS place FROM u QUALIFY place <= 5"""
)
def prune_overgenerated(spark, sf_dir):
    return o.pruned(table(spark, sf_dir, "part"), "p_name", "p_brand", "p_retailprice", ["p_partkey"], 5).select("p_partkey", "p_brand", "place")


@query(
    """SELECT event_type, CAST(least(floor(x * 20) + 1, 20) AS INTEGER) AS bin, count(*) AS n FROM
 (SELECT event_type, CAST(event_id % 1001 AS DOUBLE) / 1000 AS x FROM events) GROUP BY ALL"""
)
def histogram20(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", ((F.col("event_id") % 1001).cast("double") / 1000).alias("x"))
    return o.histogram(rows, "x", 20, 0.0, 1.0, ["event_type"])


_RESPONSES = """r AS (SELECT user_id, event_id % 60 AS item, event_type = 'error' AS bad, event_type = 'purchase' AS correct, CAST(extract(hour FROM ts) AS INTEGER) AS block,
  CAST(event_id % 5 AS INTEGER) AS module FROM events)"""


@query(
    f"""WITH {_RESPONSES}, b AS (SELECT user_id, sum(x) AS bad_total, max(x) AS bad_in_block FROM (SELECT user_id, block, count(*) FILTER (bad) AS x FROM r GROUP BY ALL) GROUP BY ALL),
 c AS (SELECT user_id, count(DISTINCT item) AS done, count(*) FILTER (correct) AS n_correct, least({", ".join(f"count(*) FILTER (correct AND module = {k})" for k in range(5))}) AS few FROM r GROUP BY ALL),
 p AS (SELECT user_id, user_id % 2 = 0 AS main, user_id % 50 = 7 AS tester, 25 AS assigned, bad_total, bad_in_block, done, n_correct, few FROM b JOIN c USING (user_id)),
 q AS (SELECT *, array_to_string(list_filter([CASE WHEN tester THEN 'tester' END, CASE WHEN done < assigned THEN 'not_finished' END,
   CASE WHEN main AND bad_total > 5 THEN 'bad_records_total' END, CASE WHEN main AND bad_in_block > 1 THEN 'bad_records_block' END,
   CASE WHEN NOT main AND done >= assigned AND n_correct < 3 THEN 'too_few_correct' END, CASE WHEN NOT main AND done >= assigned AND few < 1 THEN 'too_few_in_module' END], lambda x: x IS NOT NULL), ',') AS reasons FROM p)
 SELECT user_id, CAST(bad_total AS BIGINT) AS bad_total, done, n_correct, reasons, reasons = '' AS retained FROM q"""
)
def retention(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select(
        "user_id",
        (F.col("event_id") % 60).alias("item"),
        st.bad_record(F.lit(None), F.col("event_type") == "error", F.lit(None)).alias("bad"),
        (F.col("event_type") == "purchase").alias("correct"),
        F.hour("ts").alias("block"),
        (F.col("event_id") % 5).cast("int").alias("module"),
    )
    people = events.select("user_id").distinct().withColumn("assigned", F.lit(25))
    out = st.retention(
        people, rows, "user_id", "item",
        main=F.col("user_id") % 2 == 0, tester=F.col("user_id") % 50 == 7, assigned="assigned", bad=F.col("bad"), block=F.col("block"), correct=F.col("correct"),
        module=F.col("module"), modules=(0, 1, 2, 3, 4), max_bad=5, max_bad_in_block=1, least_correct=3, least_in_module=1,
    )
    return out.select("user_id", "bad_total", "done", "n_correct", F.array_join("reasons", ",").alias("reasons"), "retained")


@query(
    """SELECT event_id % 60 AS item, count(*) AS raw, count(*) FILTER (value > 20) AS retained, count(*) FILTER (value > 20 AND event_type = 'purchase') AS correct,
 count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY ALL"""
)
def quota_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("item", F.col("event_id") % 60)
    return st.quotas(rows, "item", F.col("event_type") == "purchase", F.col("event_type") == "error", F.col("value") > 20)


@query("SELECT o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY ALL")
def finished_load_join(spark, sf_dir):
    people = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return st.finished_load(table(spark, sf_dir, "orders"), people, "o_custkey", "o_orderpriority", F.col("c_acctbal") > 0)


@query("SELECT c_nationkey, count(*) AS n FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') r ON c_custkey = o_custkey WHERE o_custkey IS NULL GROUP BY ALL")
def pending_anti_join(spark, sf_dir):
    answered = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return st.pending_load(table(spark, sf_dir, "customer"), answered, ["c_custkey"], "c_nationkey")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 50)")
def page_offset(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return st.page(rows, [F.desc("o_totalprice"), "o_orderkey"], 100, 50)


_PROMPTS = (("plain", "0"), ("hint", "0"), ("plain", "1"))


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 2).cast("string").alias("kind"))
    prompts = spark.createDataFrame(_PROMPTS, "prompt string, kind string")
    return st.request_queue(items, prompts, ["low", "high"], 3, ["kind"], ["s_suppkey", "prompt", "condition", "sample_index"])


_QUEUE_SQL = """q AS (SELECT s_suppkey, CAST(s_suppkey % 2 AS VARCHAR) AS kind, prompt, condition, CAST(sample_index AS INTEGER) AS sample_index,
 substr(sha256(concat_ws('|', CAST(s_suppkey AS VARCHAR), prompt, condition, CAST(sample_index AS VARCHAR))), 1, 20) AS request_id
 FROM supplier JOIN (VALUES ('plain', 0), ('hint', 0), ('plain', 1)) p(prompt, k) ON s_suppkey % 2 = k, (VALUES ('low'), ('high')) c(condition), range(3) g(sample_index))"""


@query(f"WITH {_QUEUE_SQL} SELECT s_suppkey, prompt, condition, sample_index, request_id FROM q")
def request_queue(spark, sf_dir):
    return _queue(spark, sf_dir).select("s_suppkey", "prompt", "condition", "sample_index", "request_id")


@query(f"WITH {_QUEUE_SQL} SELECT s_suppkey, prompt, condition, sample_index, request_id FROM q WHERE NOT (sample_index = 0 AND condition = 'low')")
def resume_anti_join(spark, sf_dir):
    queue = _queue(spark, sf_dir)
    done = queue.filter("sample_index = 0 and condition = 'low'")
    return st.remaining(queue, done, "request_id").select("s_suppkey", "prompt", "condition", "sample_index", "request_id")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_by_key(spark, sf_dir):
    return st.latest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    """SELECT o_custkey, count(*) AS attempts, arg_min(o_orderstatus, o_orderkey) AS first_status, arg_max(o_orderstatus, o_orderkey) AS last_status
 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY ALL"""
)
def orphan_repair(spark, sf_dir):
    summaries = table(spark, sf_dir, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return st.orphan_summaries(table(spark, sf_dir, "orders"), summaries, "o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n_correct, CAST(2.5 + 0.25 * count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS amount FROM events GROUP BY ALL")
def payment_ledger(spark, sf_dir):
    return st.ledger(table(spark, sf_dir, "events"), "user_id", F.col("event_type") == "purchase", 2.5, 0.25)


@query(
    """SELECT user_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us FROM events GROUP BY ALL"""
)
def activity_duration(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").alias("start"), F.col("ts").alias("end"))
    return st.activity_span([events.filter("event_type = 'error'"), events.filter("event_type != 'error'")], "user_id", "start", "end")


@query(
    """SELECT p_brand, p_type, count(*) AS n, min(p_size) AS low, max(p_size) AS high, round(avg(p_size), 6) AS mean FROM part GROUP BY GROUPING SETS ((p_brand, p_type), (p_brand), ())"""
)
def dataset_profile(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupingSets([["p_brand", "p_type"], ["p_brand"], []], "p_brand", "p_type")
    return rounded(rows.agg(F.count("*").alias("n"), F.min("p_size").alias("low"), F.max("p_size").alias("high"), F.avg("p_size").alias("mean")), "mean")


@query("SELECT user_id, count(*) AS steps, CAST(sum(CASE WHEN b <> event_type THEN 1 ELSE 0 END) AS BIGINT) AS changes FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) GROUP BY ALL")
def consecutive_changes(spark, sf_dir):
    return o.changes(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query(
    """SELECT a.l_orderkey, CAST(sum(CASE WHEN a.l_linenumber < b.l_linenumber AND a.l_extendedprice > b.l_extendedprice THEN 1 ELSE 0 END) AS BIGINT) AS inversions
 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey GROUP BY ALL"""
)
def inversions(spark, sf_dir):
    return i.inversions(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_extendedprice")


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) - 1 AS others FROM lineitem")
def loo_shared_count(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return o.shared_with_others(rows, ["l_suppkey"], "l_returnflag").select("l_orderkey", "l_linenumber", "others")


@query("SELECT user_id, event_id, event_type FROM events WHERE event_type IN ('click', 'purchase') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, event_id DESC) = 1")
def union_override(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    last = [st.latest(rows.filter(F.col("event_type") == kind), ["user_id"], ["event_id"]) for kind in ("click", "purchase")]
    return st.last_of_union(last, ["user_id"])


@query("SELECT c_nationkey, 'left' AS side FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9500 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT s_nationkey, 'right' FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 5000 EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9500)")
def set_difference(spark, sf_dir):
    a = table(spark, sf_dir, "customer").filter("c_acctbal > 9500").select("c_nationkey").distinct()
    return st.set_difference(a, table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey")).distinct())


@query("SELECT l_orderkey, min(l_returnflag) AS l_returnflag, min(l_returnflag) <> max(l_returnflag) AS conflict FROM lineitem GROUP BY ALL")
def consistent_dedup(spark, sf_dir):
    return st.consistent(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_returnflag")


@query(
    """SELECT n_nationkey, p AS o_orderpriority FROM nation, (SELECT DISTINCT o_orderpriority AS p FROM orders)
 EXCEPT SELECT c_nationkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 490000"""
)
def missing_crossing(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_totalprice > 490000").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).select(F.col("c_nationkey").alias("n_nationkey"), "o_orderpriority")
    return i.missing_crossing(rows, table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "orders").select("o_orderpriority"))


@query("SELECT count(DISTINCT a.o_custkey) AS n FROM orders a JOIN orders b USING (o_custkey) WHERE a.o_orderstatus = 'P' AND b.o_orderstatus = 'F'")
def overlap_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return i.overlap(orders.filter("o_orderstatus = 'P'"), orders.filter("o_orderstatus = 'F'"), ["o_custkey"])


@query(
    """SELECT 'duplicate' AS problem, l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1
 UNION ALL SELECT 'unknown', l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')"""
)
def catalog_consistency(spark, sf_dir):
    known = table(spark, sf_dir, "orders").filter("o_orderstatus != 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return i.catalog_problems(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], known, ["l_orderkey"])


@query(
    """WITH s AS (SELECT o_orderkey, o_custkey, list_sort(list(DISTINCT l_suppkey)) AS xs FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
 p AS (SELECT a.o_custkey, 1 - len(list_intersect(a.xs, b.xs)) / len(list_distinct(list_concat(a.xs, b.xs))) AS d FROM s a JOIN s b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey)
 SELECT o_custkey, count(*) AS pairs, round(avg(d), 6) AS mean_distance, round(max(d), 6) AS max_distance FROM p GROUP BY ALL"""
)
def pairwise_jaccard(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.expr("l_orderkey = o_orderkey"))
    return rounded(i.pairwise_jaccard(rows, "o_custkey", "o_orderkey", "l_suppkey"), "mean_distance", "max_distance")


@query(
    """SELECT a.n_regionkey, round(max(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))), 6) AS contrast FROM
 (SELECT n_regionkey, s_suppkey, s_acctbal / 10000 AS x, (s_suppkey % 7) / 7 AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey) a JOIN
 (SELECT n_regionkey, s_suppkey, s_acctbal / 10000 AS x, (s_suppkey % 7) / 7 AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey) b
 ON a.n_regionkey = b.n_regionkey AND a.s_suppkey < b.s_suppkey GROUP BY ALL"""
)
def spatial_contrast(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.expr("s_nationkey = n_nationkey"))
    vectors = rows.select("n_regionkey", "s_suppkey", F.array(F.col("s_acctbal") / 10000, (F.col("s_suppkey") % 7) / 7).alias("v"))
    return rounded(i.max_contrast(vectors, "n_regionkey", "s_suppkey", "v"), "contrast")


@query(
    """WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY ALL),
 d AS (SELECT a.label AS "left", b.label AS "right", sum((a.x - b.x) * (a.x - b.x)) AS d2 FROM c a JOIN c b ON a.i = b.i GROUP BY ALL)
 SELECT "left", "right", round(-0.5 * (d2 - avg(d2) OVER (PARTITION BY "left") - avg(d2) OVER (PARTITION BY "right") + avg(d2) OVER ()), 6) + 0.0 AS kernel FROM d"""
)
def kernel_double_center(spark, sf_dir):
    centroids = i.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return rounded(i.double_centred(i.squared_distances(centroids, "label")), "kernel")


@query(
    """SELECT o_clerk AS lane, o_orderkey, batch FROM (SELECT o_orderpriority AS o_clerk, o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) / 7) AS BIGINT) AS batch FROM orders)"""
)
def capped_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("lane"), "o_orderkey", F.lit(1).alias("size"))
    return o.batches(rows, ["lane"], ["o_orderkey"], "size", 7, 10**9).drop("size")


@query(
    """SELECT c.c_custkey, count(*) AS rivals FROM customer c JOIN customer d ON c.c_nationkey = d.c_nationkey AND c.c_custkey <> d.c_custkey
 AND (c.c_mktsegment = d.c_mktsegment OR floor(c.c_acctbal / 100) = floor(d.c_acctbal / 100)) GROUP BY ALL"""
)
def duplicate_identity(spark, sf_dir):
    # A disjunction can't be an equi-join, so each arm is one and the union is made distinct.
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 100).alias("cell"))
    return i.same_in_any(rows, "c_custkey", [["c_nationkey", "c_mktsegment"], ["c_nationkey", "cell"]], "rivals")
