"""Retention boundaries, store operators, records, the command line, and the streaming variants against their batch forms."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tallygrid.__main__ import main
from tallygrid.functions import solvers, usage
from tallygrid.operators import ordering, puzzles, store, study
from tallygrid.sources import records
from tallygrid.streaming import resume


def retained(spark, rows, people, **limits):
    df = spark.createDataFrame(rows, "user string, item string, block string, bad boolean, correct boolean, module string")
    who = spark.createDataFrame(people, "user string, main boolean, tester boolean, assigned int")
    out = store.retention(
        who, df, "user", "item", main=F.col("main"), tester=F.col("tester"), assigned="assigned", bad=F.col("bad"), block=F.col("block"), correct=F.col("correct"),
        module=F.col("module"), modules=("a", "b"), **limits,
    )
    return {r.user: (r.retained, list(r.reasons)) for r in out.collect()}


def test_retention_boundaries(spark):
    rows = []
    for user, bad in (("thirty", 30), ("thirtyone", 31)):
        rows += [(user, f"p{k}", f"t{k % 5}", k < bad, False, None) for k in range(40)]
    rows += [("block", f"p{k}", "t0" if k < 15 else "t1", k < 15, False, None) for k in range(40)]
    rows += [("short", f"p{max(1, k)}", "t", False, False, None) for k in range(40)]
    rows += [("tester", f"p{k}", "t", False, False, None) for k in range(40)]
    rows += [("module", f"p{k}", "t", False, True, "ab"[k % 2]) for k in range(40)]
    rows += [("few", f"p{k}", "t", False, k > 0, "ab"[k % 2]) for k in range(40)]
    rows += [("one", f"p{k}", "t", False, True, "a" if k else "b") for k in range(40)]
    people = [(u, True, u == "tester", 40) for u in ("thirty", "thirtyone", "block", "short", "tester")] + [(u, False, False, 40) for u in ("module", "few", "one", "absent")]
    got = retained(spark, rows, people)
    assert got["thirty"] == (True, [])
    assert got["thirtyone"] == (False, ["bad_records_total"])
    assert got["block"] == (False, ["bad_records_block"])
    assert got["short"] == (False, ["not_finished"])
    assert got["tester"] == (False, ["tester"])
    assert got["module"] == (True, [])
    assert got["few"] == (False, ["too_few_correct"])
    assert got["one"] == (False, ["too_few_in_module"])
    assert got["absent"] == (False, ["not_finished"])


def test_batches_keep_both_caps(spark):
    rows = spark.createDataFrame([("l", k, s) for k, s in enumerate([5, 5, 1, 9, 20, 1, 1, 1, 1])], "lane string, k int, size int")
    got = [r.batch for r in ordering.batches(rows, ["lane"], ["k"], "size", 3, 11).orderBy("k").collect()]
    assert got == [0, 0, 0, 1, 2, 3, 3, 3, 4]


def test_request_queue_is_complete_and_unique(spark):
    items, prompts = spark.createDataFrame([("a", "x"), ("b", "y")], "item string, kind string"), spark.createDataFrame([("p", "x"), ("q", "x")], "prompt string, kind string")
    queue = store.request_queue(items, prompts, ["low", "high"], 3, ["kind"], ["item", "prompt", "condition", "sample_index"])
    assert queue.count() == 12 and store.colliding(queue).count() == 0
    assert store.remaining(queue, queue.filter("sample_index = 0"), "request_id").count() == 8


def test_records(spark, tmp_path):
    plain, packed = tmp_path / "a.jsonl", tmp_path / "b.jsonl.gz"
    text = '{"k": 1, "s": "x"}\n\n{"k": 2, "s": null}\n'
    plain.write_text(text)
    packed.write_bytes(gzip.compress(text.encode()))
    rows = [sorted(map(tuple, records.read_jsonl(spark, str(p), "k long, s string").collect())) for p in (plain, packed)]
    assert rows[0] == rows[1] == [(1, "x"), (2, None)]
    plain.write_text("[1]\nnot json\n")
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(plain), "k long").collect()
    assert records.one_input(spark, str(tmp_path), "b").endswith(".gz")
    (tmp_path / "b.jsonl").write_text("")
    with pytest.raises(FileNotFoundError, match="ambiguous"):
        records.one_input(spark, str(tmp_path), "b")
    df = spark.createDataFrame([("0123456789abcdef0123", 1, "z")], "request_id string, v int, secret string")
    with pytest.raises(records.NotAllowed):
        records.exported(df, ["request_id", "v"])
    assert records.exported(df, ["request_id", "v"], dropped=["secret"]).columns == ["request_id", "v"]
    with pytest.raises(records.NotAllowed):
        records.exported(df.withColumn("request_id", F.lit("short")), ["request_id", "v"], dropped=["secret"])


def test_pseudonyms_are_stable(spark):
    first = records.pseudonyms(spark.createDataFrame([("b",), ("a",)], "name string"), "name", None)
    assert {r.name: r.alias for r in first.collect()} == {"a": "P0001", "b": "P0002"}
    more = records.pseudonyms(spark.createDataFrame([("aa",), ("b",), ("a",)], "name string"), "name", first)
    assert {r.name: r.alias for r in more.collect()} == {"a": "P0001", "b": "P0002", "aa": "P0003"}


def test_solvers():
    assert "(8/(3-(8/3)))" in solvers.arithmetic((3, 3, 8, 8)) and solvers.arithmetic((1, 1, 1, 1)) == []
    assert solvers.shortest_paths(["S.", ".G"]) == ["DR", "RD"] and solvers.shortest_paths(["S#", "#G"]) == []
    assert list(solvers.rooks(["..", "X."], 2)) == [[[1, 1], [2, 2]]]
    assert solvers.forced_cells(["?0"], "safe") == [[1, 1]] and solvers.forced_cells(["?1"], "mine") == [[1, 1]] and solvers.forced_cells(["?1?"], "mine") == []
    assert solvers.sudoku_cells(["1...", "....", "....", "...."], 1, 2, 2) == [[2, 3], [2, 4], [3, 2], [3, 3], [3, 4], [4, 2], [4, 3], [4, 4]]
    assert solvers.canonical_grid(["ab", "cd"]) == solvers.canonical_grid(["db", "ca"]) and solvers.least_hamming(["ab", "cd"], ["ba", "dc"]) == 0
    assert solvers.clue_certificates(["?0", "1."], (1, 1), "safe") == (1, 1)


def test_puzzle_features(spark):
    rows = spark.createDataFrame([("z", "RRDD", 0, 0, 2, 2), ("z", "RDRD", 0, 0, 2, 2)], "puzzle_id string, moves string, start_r int, start_c int, goal_r int, goal_c int")
    got = {r.moves: r for r in puzzles.maze_features(rows).collect()}
    assert (got["RRDD"].turns, got["RDRD"].turns) == (1, 3) and got["RRDD"].shared == got["RDRD"].shared == 0.5
    placed = spark.createDataFrame([("p", "a", [[1, 1], [2, 2], [3, 3]]), ("p", "b", [[1, 1], [2, 3], [3, 2]])], "puzzle_id string, placement_id string, cells array<array<int>>")
    got = {r.placement_id: r for r in puzzles.rook_features(placed).collect()}
    assert (got["a"].disorder, got["b"].disorder, got["a"].changes, got["b"].changes) == (0, pytest.approx(1 / 3), 0, 1)
    assert got["a"].rarity == pytest.approx(2 / 3 * 0.6931471805599453)
    far = puzzles.diverse(spark.createDataFrame([("g", k, [float(x)]) for k, x in enumerate([0, 1, 9, 10])], "g string, k int, v array<double>"), "g", "k", "v", 3)
    assert [r.k for r in far.orderBy("place").collect()][:2] == [0, 3]


def test_usage_and_study(spark):
    rows = spark.createDataFrame([("gemini", '{"promptTokenCount": 5, "thoughtsTokenCount": 7}', 3.0), ("other", "{}", None)], "p string, j string, v double")
    got = rows.select(usage.usage(F.col("p"), F.col("j")).alias("u"), usage.bucket(F.col("v"), [1, 3], ["low", "mid", "high"]).alias("b"), usage.retry_delay(F.lit(5)).alias("d")).collect()
    assert (got[0].u.input_tokens, got[0].u.reasoning_tokens, got[0].b, got[0].d) == (5, 7, "mid", 2.0) and got[1].u is None and got[1].b is None
    trials = spark.createDataFrame([("t0", "cue", "b", "baseline", None), ("t1", "cue", "b", "hint", None), ("t2", "cue", "b", "anti", None)], "trial string, module string, block string, condition string, role string")
    assert {(r.reference, r.perturbed, r.arm) for r in study.comparisons(trials).collect()} == {("t0", "t1", "hint"), ("t0", "t2", "anti")}
    items = spark.createDataFrame([("m_1", None, "s"), ("f9_REL", "pair", "s"), ("f9_CTRL", "pair", "s")], "item string, module string, stratum string")
    assert {r["item"]: r.cluster for r in study.clusters(items, "item", "module", "stratum").collect()} == {"m_1": "m_1", "f9_REL": "f9", "f9_CTRL": "f9"}
    values = spark.createDataFrame([("k", "f", "b", 0.0), ("k", "f", "b", 1.0), ("k", "f", "c", 1.0), ("k", "g", "d", 0.0)], "key string, family string, block string, v double")
    assert study.nested_means(values, ["key"], ["family", "block"], "v").first().v == pytest.approx(0.375)


def test_streams_agree_with_batches(spark, tmp_path):
    folder, stored = tmp_path / "log", tmp_path / "stored"
    folder.mkdir()
    schema = "request_id string, item string, at timestamp, v int"
    first = [("r1", "a", "2024-01-01T00:00:00", 1), ("r2", "a", "2024-01-01T00:01:00", 2), ("r1", "a", "2024-01-01T00:02:00", 3)]
    write = lambda name, rows: (folder / name).write_text("".join(json.dumps(dict(zip(("request_id", "item", "at", "v"), r))) + "\n" for r in rows))
    write("1.json", first)
    upsert = lambda: resume.upserted(spark.readStream.schema(schema).json(str(folder)), str(stored), ["request_id"], ["at"], str(tmp_path / "c1")).awaitTermination()
    upsert()
    write("2.json", [("r2", "a", "2024-01-01T00:03:00", 9)])
    upsert()
    kept = resume.stored(spark, str(stored), spark.read.schema(schema).json(str(folder)).schema)
    latest = {r.request_id: r.v for r in kept.collect()}
    assert latest == {"r1": 3, "r2": 9} == {r.request_id: r.v for r in store.latest(spark.read.schema(schema).json(str(folder)), ["request_id"], ["at"]).collect()}
    seen = []
    resume.drained(resume.completed_once(spark, str(folder), schema, "request_id", "at", "1 hour"), lambda df, n: seen.extend(r.request_id for r in df.collect()), str(tmp_path / "c2"))
    assert sorted(seen) == ["r1", "r2"]


def test_command_line(spark, tmp_path):
    puzzle = {"puzzle_id": "m", "puzzle_type": "minesweeper_lite", "board": ["?0?"], "legal": [[1, 1], [1, 3]], "stratum": "mines", "solutions": [{"solution_id": f"s{c}", "abstract_solution_id": f"S{c}", "answer": f"[1,{c}]"} for c in (1, 3)]}
    (tmp_path / "puzzles.jsonl").write_text(json.dumps(puzzle) + "\n")
    rows = [{"request_id": f"{k:020x}", "input_kind": "single", "puzzle_id": "m", "raw_answer": f"(1,{c})", "raw_response": f"(1,{c})", "source": s} for k, (s, c) in enumerate([("h", 1), ("h", 3), ("m", 1), ("m", 1), ("m", 9)])]
    (tmp_path / "responses.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    out = tmp_path / "out"
    main(["process", "--responses", str(tmp_path / "responses.jsonl"), "--puzzles", str(tmp_path / "puzzles.jsonl"), "--out", str(out)])
    main(["analyze", "--scored", str(out / "scored"), "--out", str(out)])
    assert spark.read.parquet(str(out / "pairs")).first().tv == pytest.approx(0.5)
    assert json.loads((out / "process.json").read_text())["status"] == "done"
    with pytest.raises(Exception):
        main(["analyze", "--scored", str(out / "scored"), "--out", str(out)])


def test_upserts_touch_their_buckets_alone(spark, tmp_path):
    folder, target, schema = tmp_path / "log", str(tmp_path / "kept"), "k int, at int, v string"
    shape = spark.createDataFrame([], schema).schema
    stream = lambda: resume.upserted(spark.readStream.schema(schema).json(str(folder)), target, ["k"], ["at"], str(tmp_path / "c"), 8).awaitTermination()
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))
    folder.mkdir()
    assert resume.stored(spark, target, shape).count() == 0
    put([(k, 1, f"a{k}") for k in range(40)] + [(None, 1, "x"), (3, 1, "a2")])
    stream()
    put([(3, 2, "b"), (4, 0, "late"), (None, 2, None)])
    stream()
    got = {r.k: r.v for r in resume.stored(spark, target, shape).collect()}
    assert got == {**{k: f"a{k}" for k in range(40)}, 3: "b", None: None}
    written = {int(p.name.split("=")[1]) for p in (tmp_path / "kept" / "rows" / "version=1").glob("bucket=*")}
    assert 1 <= len(written) <= 3
    assert resume.vacuumed(spark, target) == len(written) and resume.vacuumed(spark, target) == 0
    assert {r.k: r.v for r in resume.stored(spark, target, shape).collect()} == got
