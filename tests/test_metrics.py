"""Distribution metrics and their aggregation, against the identities they must meet."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallygrid.functions import metrics as m
from tallygrid.operators import distributions as d


def bound(spark, cells, schema="source string, item string, klass string, stratum string"):
    return spark.createDataFrame([row[:4] for row in cells for _ in range(row[4])], schema)


def pairs_of(spark, cells):
    return {(r.left, r.right, r.item): r for r in d.pairwise(d.distributions(d.class_counts(bound(spark, cells)))).collect()}


def test_half_overlap(spark):
    found = pairs_of(spark, [("a", "i", "x", "s", 5), ("a", "i", "y", "s", 5), ("b", "i", "y", "s", 5), ("b", "i", "z", "s", 5)])["a", "b", "i"]
    assert (found.tv, found.js) == (pytest.approx(0.5), pytest.approx(0.5))
    assert found.js_distance == pytest.approx(math.sqrt(0.5))
    assert found.hellinger == pytest.approx(math.sqrt(0.5))
    assert found.modal_agreement is True  # y is a mode of both, if not the only one


def test_disjoint_and_equal(spark):
    found = pairs_of(spark, [("a", "i", "x", "s", 3), ("b", "i", "y", "s", 7), ("a", "j", "x", "s", 2), ("b", "j", "x", "s", 9)])
    assert [found["a", "b", "i"][k] for k in ("tv", "js", "hellinger", "modal_agreement")] == [1.0, 1.0, 1.0, False]
    assert [found["a", "b", "j"][k] for k in ("tv", "js", "hellinger", "modal_agreement")] == [0.0, 0.0, 0.0, True]
    assert found["a", "b", "j"].log_density_correlation is None  # constant


def test_unobserved_classes_count(spark):
    """The catalog's classes that one source never gave are part of its log densities."""
    cells = [("a", "i", "x", "s", 8), ("a", "i", "y", "s", 1), ("b", "i", "x", "s", 6), ("b", "i", "z", "s", 2), ("c", "i", "w", "s", 1)]
    got = pairs_of(spark, cells)["a", "b", "i"].log_density_correlation
    x, y = [math.log(n + 0.5) for n in (8, 1, 0, 0)], [math.log(n + 0.5) for n in (6, 0, 2, 0)]
    mx, my = sum(x) / 4, sum(y) / 4
    r = sum((p - mx) * (q - my) for p, q in zip(x, y)) / math.sqrt(sum((p - mx) ** 2 for p in x) * sum((q - my) ** 2 for q in y))
    assert got == pytest.approx(r)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=2, max_size=5).filter(lambda c: sum(a for a, _ in c) and sum(b for _, b in c)))
def test_metrics_equal_the_dense_formulas(spark, counts):
    cells = [(s, "i", str(k), "s", n) for k, c in enumerate(counts) for s, n in zip("ab", c) if n]
    got = pairs_of(spark, cells)["a", "b", "i"]
    na, nb = (sum(c[k] for c in counts) for k in (0, 1))
    p, q = [a / na for a, _ in counts], [b / nb for _, b in counts]
    kl = lambda x, y: sum(a * math.log2(2 * a / (a + b)) for a, b in zip(x, y) if a)
    assert got.tv == pytest.approx(sum(abs(a - b) for a, b in zip(p, q)) / 2, abs=1e-12)
    assert got.js == pytest.approx((kl(p, q) + kl(q, p)) / 2, abs=1e-12)
    assert got.hellinger == pytest.approx(math.sqrt(sum((math.sqrt(a) - math.sqrt(b)) ** 2 for a, b in zip(p, q)) / 2), abs=1e-7)


def test_entropy_uses_the_catalog(spark):
    dist = d.distributions(d.class_counts(bound(spark, [("a", "i", "x", "s", 5), ("a", "i", "y", "s", 5), ("b", "i", "z", "s", 1), ("b", "i", "w", "s", 1)])))
    own = d.profiles(dist).join(d.catalog_sizes(dist), "item").withColumn("h", m.normalized_entropy(F.col("entropy"), F.col("classes")))
    assert {r.source: (r.entropy, r.h) for r in own.collect()} == {"a": (1.0, 0.5), "b": (1.0, 0.5)}


def test_equal_stratum_mean(spark):
    rows = spark.createDataFrame([("k", "s", 0.0), ("k", "s", 0.0), ("k", "s", 0.0), ("k", "t", 1.0)], "key string, stratum string, v double")
    assert {r.stratum: r.v for r in d.stratum_means(rows, ["key"], ["v"]).collect()} == {"s": 0.0, "t": 1.0, None: 0.5}


def test_attraction(spark):
    rows = spark.createDataFrame([(0.5, 0.25), (-1.0, 0.5), (0.0, 1.0), (None, 0.5)], "gain double, before double")
    assert [r[0] for r in rows.select(m.normalized_attraction(F.col("gain"), F.col("before"))).collect()] == [pytest.approx(2 / 3), -2.0, None, None]


def test_information(spark):
    dependent = [("u", a, a) for a in "xy" for _ in range(4)]
    independent = [("v", a, b) for a in "xy" for b in "xy" for _ in range(2)]
    joint = d.joint_distribution(spark.createDataFrame(dependent + independent, "k string, a string, b string"), ["k"])
    got = {r.k: r for r in d.dependence(joint, ["k"]).collect()}
    assert (got["u"].mutual_information, got["u"].independence_tv) == (1.0, 0.5)
    assert (got["v"].mutual_information, got["v"].independence_tv) == (0.0, 0.0)


def test_last_first_answer_wins(spark):
    first = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "x")], "k int, o int, klass string")
    second = spark.createDataFrame([(1, "b")], "k int, klass string")
    assert [tuple(r) for r in d.paired_answers(first, second, ["k"], "o").collect()] == [(1, "new", "b")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "source string, item string, klass string, stratum string")
    dist = d.distributions(d.class_counts(none))
    assert d.pairwise(dist).count() == d.profiles(dist).count() == d.uniform_baseline(dist).count() == 0
