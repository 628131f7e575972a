"""Draws, intervals, permutation tests, step-down adjustment, geometry and regressions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallygrid.functions import solvers
from tallygrid.operators import geometry, inference, logit, ordering


def test_golden_draws(spark):
    expected = [[1, 1, 2, 3, 4], [1, 1, 3, 3, 3], [0, 0, 3, 2, 2], [1, 0, 3, 2, 4]]
    assert [x.tolist() for x in inference.indices((2, 3), 4, 0)] == expected
    rows = inference.draws(spark, (2, 3), 4, 0).collect()
    for rep, own in enumerate(expected):
        assert sorted((r["index"], r.times) for r in rows if r.rep == rep) == [(k, own.count(k)) for k in sorted(set(own))]


def test_bootstrap_equals_numpy(spark):
    values = [("a", f"c{k}", float(k)) for k in range(4)] + [("b", f"d{k}", 10.0 * k) for k in range(3)]
    rows = spark.createDataFrame([("k", *v) for v in values], "key string, stratum string, cluster string, value double")
    drawn = np.stack(list(inference.indices((4, 3), 200, 5)))
    x = np.array([v[2] for v in values])
    for equal in (True, False):
        means = (x[drawn[:, :4]].mean(1) + x[drawn[:, 4:]].mean(1)) / 2 if equal else x[drawn].mean(1)
        got = inference.bootstrap(rows, 200, 5, ["key"], equal_strata=equal).first()
        assert [got.low, got.high] == pytest.approx(np.quantile(means, (0.025, 0.975)).tolist())


def test_random_tables_keep_their_margins():
    rows, columns = np.array([7, 0, 12, 3]), np.array([10, 1, 0, 11])
    tables = inference.margin_tables(rows, columns, 500, np.random.default_rng(0))
    assert (tables >= 0).all() and (tables.sum(2) == rows).all() and (tables.sum(1) == columns).all()
    assert inference.margin_tables(np.array([4]), np.array([1, 3]), 2, np.random.default_rng(0)).tolist() == [[[1, 3]]] * 2
    # Cells have the mean and the variance of the hypergeometric distribution.
    tables = inference.margin_tables(np.array([30, 20]), np.array([25, 15, 10]), 40_000, np.random.default_rng(1))
    p = np.array([25, 15, 10]) / 50
    assert tables[:, 0].mean(0) == pytest.approx(30 * p, abs=0.05)
    assert tables[:, 0].var(0) == pytest.approx(30 * p * (1 - p) * 20 / 49, rel=0.05)


def permuted_ps(table, repeats, rng):
    """Both p-values by permuting the second answers one by one."""
    first, second = (np.repeat(np.arange(table.shape[k]), table.sum(1 - k)) for k in (0, 1))
    null = np.zeros((repeats, *table.shape), int)
    for k in range(repeats):
        np.add.at(null[k], (first, rng.permutation(second)), 1)
    ps = []
    for f, slack in ((inference.information, 1e-15), (inference.independence_distance, 1e-12)):
        ps.append((1 + (f(null) >= f(table[None])[0] - slack).sum()) / (1 + repeats))
    return ps


def test_permutation_p_values(spark):
    """The p-values of random tables are those of permutations, within what chance allows at 10,000 draws."""
    rng = np.random.default_rng(81)
    tables = {k: rng.multinomial(60, np.ones(9) / 9).reshape(3, 3) for k in range(4)} | {9: np.array([[8, 2], [3, 7]])}
    rows = [(k, f"a{i}", f"b{j}", int(n)) for k, t in tables.items() for (i, j), n in np.ndenumerate(t)]
    got = {r.key: r for r in inference.joint_tests(spark.createDataFrame(rows, "key int, a string, b string, n long"), ["key"], 10_000).collect()}
    for k, t in tables.items():
        for p, q in zip((got[k].p_information, got[k].p_tv), permuted_ps(t, 10_000, rng), strict=True):
            assert abs(p - q) < 5 * np.sqrt(2 * q * (1 - q) / 10_000) + 1e-4
        x = t[t.sum(1) > 0] / t.sum()
        product = np.outer(x.sum(1), x.sum(0))
        assert got[k].information == pytest.approx((x[x > 0] * np.log2(x[x > 0] / product[x > 0])).sum())
    strong = inference.joint_tests(spark.createDataFrame([("k", "a", "x", 20), ("k", "b", "y", 20)], "key string, a string, b string, n long"), ["key"], 300).first()
    assert strong.information == 1 and strong.p_information == strong.p_tv == 1 / 301
    arms = [("k", "x", 50, 5), ("k", "y", 5, 50), ("e", "x", 0, 3), ("same", "x", 50, 50), ("same", "y", 50, 50)]
    rows = spark.createDataFrame(arms, "key string, klass string, before long, after long")
    assert {r.key: r.p for r in inference.tv_tests(rows, ["key"], 100).collect()} == {"k": 1 / 101, "e": None, "same": 1.0}


def test_holm_leaves_controls_alone(spark):
    rows = spark.createDataFrame([("cue", 0.01), ("related", 0.04), ("control", 0.0001)], "row string, p double")
    got = {r.row: r.p_holm for r in ordering.holm(rows, "p", ["row"], None, F.col("row") != "control").collect()}
    assert got == {"cue": 0.02, "related": 0.04, "control": None}


def test_response_bootstrap(spark):
    schema = "source string, person string, item string, klass string, n int"
    rows = [("h", "p", "i", "a", 2), ("h", "p", "i", None, 2), ("m", None, "i", "a", 50), ("m", None, "i", None, 50), ("m", None, "j", None, 50)]
    assert all(v == 0 for v in inference.response_bootstrap(spark.createDataFrame(rows, schema), 8, 0).first()[2:])
    # People answer alike on all items, so what a replicate draws of them is the same on each: many items say no more than one.
    people = [("h", f"p{k}", f"i{j}", "a" if k < 6 else "b", 1) for k in range(20) for j in range(5)]
    fixed = [("m", None, f"i{j}", "a", 9) for j in range(5)]
    df = spark.createDataFrame(people + fixed, schema)
    many, one = (inference.response_bootstrap(x, 300, 0, crossed="h").first() for x in (df, df.filter("item = 'i0'")))
    assert [many.tv_low, many.tv_high] == pytest.approx([one.tv_low, one.tv_high])
    assert 0.4 < many.tv_low < 0.6 < 0.75 < many.tv_high < 0.95
    alone = inference.response_bootstrap(df, 300, 0).first()
    assert alone.tv_high - alone.tv_low < 0.7 * (many.tv_high - many.tv_low)
    # Items that are never drawn don't count.
    other = df.unionAll(spark.createDataFrame([("h", "p0", "k", "b", 1), ("m", None, "k", "a", 1)], schema))
    draws = df.sparkSession.range(300).selectExpr("cast(id as int) rep", "'i0' item", "2L times")
    joint = inference.response_bootstrap(other.filter("item in ('i0', 'k')"), 300, 0, crossed="h", item_draws=draws).first()
    assert joint.left == "h" and joint.right == "m" and 0.4 < joint.tv_low < 0.6


def test_people_are_a_multinomial(spark):
    """Each replicate draws as many people as there are; a person's times have the multinomial's mean, variance and correlation; blocks don't matter to that."""
    n, reps = 150, list(range(3, 1203))
    rows = [(f"p{k}" if k else None, f"i{k % 3}", f"p{k}", 1) for k in range(n)]
    df = spark.createDataFrame(rows, "person string, item string, klass string, n long")
    for block in (1024, 8):
        drawn = inference.drawn_people(df, reps, 5, 0, block).toPandas()
        assert set(drawn.groupby("rep")["w"].sum()) == {n} and sorted(set(drawn["rep"])) == reps
        times = drawn.pivot_table(index="rep", columns="klass", values="w", fill_value=0, aggfunc="sum").to_numpy()
        assert times.shape == (len(reps), n)
        assert times.mean(0) == pytest.approx(np.ones(n), abs=0.16)
        assert times.var(0).mean() == pytest.approx(1 - 1 / n, rel=0.03)
        c = np.cov(times.T)
        assert c[~np.eye(n, dtype=bool)].mean() == pytest.approx(-1 / n, rel=0.05)
    again = inference.drawn_people(df.repartition(3), reps, 5, 0, 8).toPandas()
    order = ["rep", "item", "klass", "w"]
    assert drawn[order].sort_values(order).values.tolist() == again[order].sort_values(order).values.tolist()
    whole = [(None, "i", None, 2), ("a", "i", None, 3), ("a", "j", "x", 4)]
    got = inference.drawn_people(spark.createDataFrame(whole, "person string, item string, klass string, n long"), [0, 1, 2, 3], 1, 0).toPandas()
    for _, own in got.groupby("rep"):
        w = {(r.item, r.klass): r.w for r in own.itertuples()}
        assert w.get(("j", "x"), 0) % 4 == 0 and w.get(("i", None), 0) == 2 * (2 - w.get(("j", "x"), 0) // 4) + 3 * (w.get(("j", "x"), 0) // 4)


def test_null_strata_are_drawn(spark):
    rows = spark.createDataFrame([("k", None, "a", 1.0), ("k", None, "b", 3.0), ("k", "s", "c", 5.0)], "key string, stratum string, cluster string, value double")
    got = inference.bootstrap(rows, 200, 0, ["key"], equal_strata=True).first()
    assert got["mean"] == 3.5 and got.low == 3.0 and got.high == 4.0


def test_embedding_recovers_points(spark):
    points = np.array([[0.0, 0.0], [0.3, 0.0], [0.0, 0.4], [0.2, 0.2]])
    rows = [(a, b, float(np.linalg.norm(points[a] - points[b]))) for a in range(4) for b in range(a + 1, 4)]
    labels, m = geometry.matrix(spark.createDataFrame(rows, "left int, right int, value double"))
    x, values, shares = geometry.embedding(geometry.kernel(m))
    assert np.linalg.norm(x[0] - x[1]) == pytest.approx(0.3)
    assert geometry.stress(m, x) == pytest.approx(0, abs=1e-9)
    assert shares.sum() == pytest.approx(1)
    new = np.linalg.norm(points - np.array([0.1, 0.1]), axis=1)[None]
    at = geometry.projected(m, x, values, new)
    assert np.linalg.norm(at[0] - x[0]) == pytest.approx(np.hypot(0.1, 0.1))
    assert np.diag(geometry.alignment([geometry.kernel(m)] * 2)) == pytest.approx([1, 1])
    with pytest.raises(geometry.NotAMatrix):
        geometry.checked(m + 2, "distance")


def test_newton_matches_differences():
    rng = np.random.default_rng(0)
    x, q = [rng.normal(size=(3, 2)) for _ in range(4)], [rng.dirichlet(np.ones(3)) for _ in range(4)]
    model = logit.Choice(x, q)
    beta, gradient, _ = model.fit()
    assert gradient <= 1e-8
    loss = lambda b: model.losses(b).mean() + model.penalty / 2 * b @ b
    for k in range(2):
        step = np.eye(2)[k] * 1e-5
        assert (loss(beta + step) - loss(beta - step)) / 2e-5 == pytest.approx(0, abs=1e-6)
    y = rng.integers(0, 2, 40).astype(float)
    z = rng.normal(size=(40, 2)) + y[:, None]
    source = logit.Source(z, y, np.ones(40))
    b, gradient, _ = source.fit()
    assert gradient <= 1e-8 and (source.probability(b) > 0.5).mean() > 0


def test_separated_sources_stay_finite():
    x = np.array([[0.0], [1.0]])
    beta, gradient, _ = logit.Source(x, np.array([0.0, 1.0]), np.ones(2)).fit()
    assert gradient <= 1e-8 and np.isfinite(beta).all()


def test_choice_fits_find_the_signal(spark):
    rng = np.random.default_rng(1)
    rows = []
    for item in range(12):
        f = rng.normal(size=3)
        p = np.exp(2 * f) / np.exp(2 * f).sum()
        rows += [("t", item, k, float(p[k]), float(f[k]), float(item)) for k in range(3)]
    out = logit.choice_fits(spark.createDataFrame(rows, "task string, item int, k int, share double, f double, flat double"), "task", "item", "k", "share", ["f", "flat"], repeats=20)
    got = {r.feature: r for r in out.collect()}
    assert got["f"].coefficient == pytest.approx(2, abs=0.05) and got["f"].low <= got["f"].coefficient <= got["f"].high
    assert got["flat"].coefficient == pytest.approx(0, abs=1e-6)
    assert got["f"].held_out_loss < got["f"].chance_loss


def test_robust_errors_and_resume(spark):
    rng = np.random.default_rng(3)
    x = [rng.normal(size=(3, 1)) for _ in range(400)]
    q = [np.eye(3)[rng.choice(3, p=np.exp(m[:, 0]) / np.exp(m[:, 0]).sum())] for m in x]
    model = logit.Choice(x, q, penalty=0.0)
    beta, _, _ = model.fit()
    information = sum((m.T * p) @ m - np.outer(m.T @ p, m.T @ p) for m, p in zip(x, model.shares(beta)))
    assert model.robust_errors(beta)[0] == pytest.approx(1 / np.sqrt(information[0, 0]), rel=0.2)
    assert logit.normal_p(1.959964) == pytest.approx(0.05, abs=1e-6)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "task string, v int")
    done = spark.createDataFrame([("a", "f1"), ("b", "f0")], "task string, fingerprint string")
    assert [r.task for r in logit.unfinished(rows, done, "task", "f1").collect()] == ["b"]


def test_queries_cover_their_tables(spark, tmp_path):
    """Solvers and fits take all rows, not the first ids."""
    from tallygrid.plans.inference_queries import QUERIES

    parts = [(k, k % 50 + 1) for k in (1, 59, 60, 199, 200, 1999)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    rng = np.random.default_rng(3)
    flags = lambda: "ANR"[rng.integers(3)]
    lines = [(s, int(n), flags(), float(rng.integers(1, 50)), float(rng.random() / 10)) for s in (1, 40, 41, 90) for n in rng.integers(1, 8, 120)]
    lines = [(k, *x) for k, x in enumerate(lines)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_quantity double, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(k, k % 3) for k in (1, 40, 41, 90)], "s_suppkey long, s_nationkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(k, 0) for k in range(3)], "n_nationkey long, n_regionkey long").write.parquet(str(tmp_path / "nation.parquet"))
    assert {r.puzzle_id for r in QUERIES["solver_maze"](spark, str(tmp_path)).collect()} >= {199, 1999}
    found = {}
    for r in QUERIES["solver_arithmetic"](spark, str(tmp_path)).collect():
        found.setdefault(r.p_partkey, []).append(r.expression)
    solved = {k: solvers.arithmetic(tuple((k * (j + 3) + size * j) % 9 + 1 for j in range(4)), 24) for k, size in parts}
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in solved.items() if v}
    assert max(found) >= 60
    for name in ("choice_logit", "source_logit"):
        assert {r["items"] for r in QUERIES[name](spark, str(tmp_path)).collect()} == {4}


def test_svd_from_inner_products(spark):
    """The projection from inner products is that of the whole table."""
    table = np.random.default_rng(4).normal(size=(4, 30))
    rows = spark.createDataFrame([(f"s{k}", j, float(table[k, j])) for k in range(4) for j in range(30)], "source string, item int, value double")
    labels, gram = geometry.matrix(geometry.gram_rows(rows), diagonal=None)
    x, shares = geometry.svd_projection(gram)
    u, s, _ = np.linalg.svd(table - table.mean(0), full_matrices=False)
    assert labels == ["s0", "s1", "s2", "s3"] and shares == pytest.approx(s[:2] ** 2 / (s**2).sum())
    assert np.abs(x) == pytest.approx(np.abs(u[:, :2] * s[:2]))
