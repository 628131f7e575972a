"""Generated pools and modules, resumed fits, and sinks that SQL can't see into."""

import gzip
import json
import os
import stat

import pytest
from pyspark.sql import functions as F

from tallygrid.functions import solvers
from tallygrid.operators import generation, logit, ordering, puzzles, study
from tallygrid.sources import records


def test_boards_depend_on_the_seed_alone(spark):
    one, again, other = (generation.boards(spark, 50, 4, 0.3, s) for s in (1, 1, 2))
    rows = {r.puzzle_id: r.board for r in one.collect()}
    assert rows == {r.puzzle_id: r.board for r in again.repartition(7).collect()} and len(rows) == 50
    assert {tuple(b) for b in rows.values()} != {tuple(r.board) for r in other.collect()}
    share = sum(x == "X" for b in rows.values() for row in b for x in row) / (50 * 16)
    assert 0.2 < share < 0.4


def test_rook_pool(spark):
    pool = generation.rook_pool(generation.boards(spark, 300, 3, 0.4, 3), 3, 2, per_bucket=4).collect()
    assert pool and max(sum(r.difficulty == d for r in pool) for d in (1, 2, 3)) <= 4
    for r in pool:
        assert r.n_solutions == len(list(solvers.rooks(list(r.board), 2))) and 3 <= r.n_solutions <= 8
        assert r.blocked == sum(row.count("X") for row in r.board)
    assert len({solvers.canonical_grid(list(r.board)) for r in pool}) == len(pool)


def test_modules_are_complete(spark):
    pool = generation.rook_pool(generation.boards(spark, 300, 3, 0.4, 3), 3, 2, per_bucket=4)
    trials = generation.spatial_module(pool).unionAll(generation.transfer_module(pool, "difficulty", ["puzzle_id"]))
    arms = {"spatial": ["original", "mirror_h", "mirror_v", "mirror_hv"], "transfer": ["prime", "target"]}
    assert study.design_problems(trials, arms).count() == 0
    broken = study.design_problems(trials.filter("condition != 'mirror_v'"), arms)
    assert {(r.module, r.problem) for r in broken.collect()} == {("spatial", "missing_arm")}
    assert {len(r.trial_ids) for r in generation.module_blocks(trials).collect()} == {2, 4}


def test_symmetries_are_eight():
    assert len({tuple(x) for x in puzzles.symmetries(3)}) == 8


def test_rebalanced(spark):
    rows = spark.createDataFrame([("a", 10, 4), ("b", 5, 20), ("c", 5, 6)], "bucket string, target long, available long")
    got = {r.bucket: r.chosen for r in ordering.rebalanced(rows, "bucket", "target", "available", 20).collect()}
    assert got == {"a": 4, "b": 11, "c": 5}


def test_fits_are_taken_up(spark, tmp_path):
    rows = spark.createDataFrame([(t, i, k, float((i + k) % 3 + 1), float(k), float(i * k % 5)) for t in ("x", "y") for i in range(6) for k in range(3)], "task string, item int, klass int, share double, f double, g double")
    calls = []

    def fit(r):
        calls.append(sorted(x.task for x in r.select("task").distinct().collect()))
        return logit.choice_fits(r, "task", "item", "klass", "share", ["f", "g"], repeats=5)

    path = str(tmp_path / "fits")
    logit.resumed_fits(rows.filter("task = 'x'"), "task", "p", path, fit)
    out = logit.resumed_fits(rows, "task", "p", path, fit)
    assert calls == [["x"], ["y"]] and out.count() == 4
    changed = rows.withColumn("f", F.when((F.col("task") == "x") & (F.col("item") == 0), 9.0).otherwise(F.col("f")))
    assert logit.resumed_fits(changed, "task", "p", path, fit).count() == 4 and calls[-1] == ["x"]


def test_validation_in_each_draw(spark):
    rows = spark.createDataFrame([("x", i, k, float((i + k) % 3 + 1), float(k)) for i in range(6) for k in range(3)], "task string, item int, klass int, share double, f double")
    one = logit.choice_fits(rows, "task", "item", "klass", "share", ["f"], repeats=100, validate=True).first()
    assert one.low <= one.coefficient <= one.high and one.held_out_low <= one.held_out_loss <= one.held_out_high


def test_diagnostics_name_the_item(spark):
    rows = [("x", i, k, float(k), float(k * k + i)) for i in range(4) for k in range(3)] + [("y", i, k, float(k), 2.0 * k) for i in range(4) for k in range(3)]
    got = {r.task: r for r in logit.design_diagnostics(spark.createDataFrame(rows, "task string, item int, klass int, f double, g double"), "task", ["f", "g"]).collect()}
    assert got["x"].deficient is None and got["x"]["rank"] == 2 and got["y"].deficient == "pooled"


def test_unknown_classes_are_errors(spark):
    answers = spark.createDataFrame([("s", "i", "a", 1), ("s", "i", "z", 1)], "source string, item string, klass string, k int")
    catalog = spark.createDataFrame([("i", "a")], "item string, klass string")
    with pytest.raises(logit.UnknownClass):
        logit.observations(answers, answers.select("k").distinct(), catalog, ["k"])


def test_sorted_gzip_has_fixed_bytes(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(100)], "k long, s string")
    texts = []
    for name in ("a", "b"):
        records.write_sorted(rows.repartition(5 if name == "a" else 2), str(tmp_path / name), ["k"], files=2, compressed=True)
        texts.append([p.read_bytes() for p in sorted((tmp_path / name).glob("*.json.gz"))])
    assert texts[0] == texts[1] and gzip.decompress(texts[0][0]).startswith(b'{"k":0,"s":"t0"}\n')


def test_sorted_files_hold_fixed_ranges(spark, tmp_path):
    rows = spark.createDataFrame([(k // 3, f"t{k * 7 % 101}") for k in range(101)] + [(None, "x"), (None, "x")], "k long, s string")
    for name in ("a", "b"):
        records.write_sorted(rows.repartition(7 if name == "a" else 3), str(tmp_path / name), ["k"], file_rows=20)
    one, two = ([p.read_bytes() for p in sorted((tmp_path / n).glob("*.json"))] for n in ("a", "b"))
    assert one == two and [t.count(b"\n") for t in one] == [20, 20, 20, 20, 20, 3]
    lines = b"".join(one).decode().splitlines()
    assert lines == sorted(lines, key=lambda t: (json.loads(t)["k"] is not None, json.loads(t)["k"] or 0, t))
    records.write_sorted(rows.limit(0), str(tmp_path / "none"), ["k"])
    assert spark.read.text(str(tmp_path / "none")).count() == 0


def test_private_sink_is_exclusive(spark, tmp_path):
    path = str(tmp_path / "p")
    records.write_private(spark.range(3), path)
    assert stat.S_IMODE(os.stat(path).st_mode) == 0o700
    assert all(stat.S_IMODE(f.stat().st_mode) == 0o600 for f in (tmp_path / "p").glob("part-*"))
    with pytest.raises(FileExistsError):
        records.write_private(spark.range(3), path)


def test_identity_cover(spark):
    people = spark.createDataFrame([("a",), ("b",)], "name string")
    known = records.pseudonyms(people, "name", None)
    assert records.covered(people, known, "name").count() == 2
    for wrong in (known.filter("name = 'a'"), known.unionAll(known.limit(1)), known.unionAll(spark.createDataFrame([("z", "P9")], "name string, alias string"))):
        with pytest.raises(records.IdentityMismatch):
            records.covered(people, wrong, "name")


def test_manifest_has_hashes(spark, tmp_path):
    import hashlib
    import json

    (tmp_path / "in.jsonl").write_text('{"a": 1}\n')
    records.write_manifest(spark, str(tmp_path / "m.json"), {"x": 1}, {"in": str(tmp_path / "in.jsonl")}, "done", 0.0)
    got = json.loads((tmp_path / "m.json").read_text())
    assert got["inputs"]["in"]["in.jsonl"] == hashlib.sha256(b'{"a": 1}\n').hexdigest() and got["status"] == "done"


def test_command_line_regress_and_tables(spark, tmp_path):
    from tallygrid.__main__ import main

    rows = spark.createDataFrame([(t, i, k, float((i + k) % 3 + 1), float(k * i % 4)) for t in ("x", "y") for i in range(5) for k in range(3)], "source string, item int, klass int, share double, f double")
    rows.write.parquet(str(tmp_path / "design"))
    for _ in range(2):
        main(["regress", "--design", str(tmp_path / "design"), "--features", "f", "--draws", "4", "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out/fits")).count() == 2
    spark.createDataFrame([("a", "g", 0.01), ("b", "g", 0.04)], "test string, family string, p double").write.parquet(str(tmp_path / "tests"))
    main(["tables", "--tests", str(tmp_path / "tests"), "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out/significance")).first().n_holm == 2


def brute_arithmetic(numbers, target):
    """All trees over all orders of the numbers' places, one by one."""
    from fractions import Fraction
    from itertools import permutations

    from tallygrid.functions.expressions import read

    def trees(places):
        if len(places) == 1:
            yield Fraction(numbers[places[0]]), str(numbers[places[0]]), 0, 0
            return
        for k in range(1, len(places)):
            for a, s, d1, w1 in trees(places[:k]):
                for b, t, d2, w2 in trees(places[k:]):
                    for mark, v in (("+", a + b), ("-", a - b), ("*", a * b), ("/", a / b if b else None)):
                        if v is not None:
                            yield v, f"({s}{mark}{t})", d1 + d2 + (mark == "/"), w1 + w2 + (v < 0 or v.denominator != 1)

    out = {}
    for order in permutations(range(len(numbers))):
        crossed = sum(order[i] > order[j] for i in range(len(order)) for j in range(i + 1, len(order)))
        for v, text, d, w in trees(order):
            if v == target:
                depth, cut = 0, 0
                for k, c in enumerate(text[1:-1]):
                    depth += (c == "(") - (c == ")")
                    if depth == 0 and c in "+-*/" and k:
                        cut = k
                left = sum(c.isdigit() for c in text[1:-1][:cut])
                form = read(text)[2]
                old = out.get(form, (99, 99, False, 99))
                out[form] = min(old[0], d), min(old[1], w), old[2] or 2 * left == len(numbers), min(old[3], crossed)
    return out


@pytest.mark.parametrize("numbers", [(3, 3, 8, 8), (1, 2, 3, 4), (6, 1, 4, 1)])
def test_arithmetic_features(numbers):
    assert solvers.arithmetic_features(numbers) == brute_arithmetic(numbers, 24)
    assert sorted(solvers.arithmetic_features(numbers)) == solvers.arithmetic(numbers)
