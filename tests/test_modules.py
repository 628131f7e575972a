"""Pools by floods and peers against plain searches, and the cue, pair and formulation modules on small pools with odd rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from tallygrid.functions import solvers
from tallygrid.operators import modules, ordering, pools, study
from tallygrid.sources import records

MAZES = [
    ["S..", ".#.", "..G"],
    ["S..", "...", "..G"],
    ["S#.", "#..", "..G"],
    ["S.#", "..#", "#.G"],
    ["#.G", "#..", "#S."],
    ["...", ".#.", "..G"],
    ["###", "###", "###"],
]


def test_floods_are_shortest_ways(spark):
    rows = spark.createDataFrame(list(enumerate(MAZES)), "puzzle_id int, board array<string>").withColumn("x", pools.characters("board"))
    for r in rows.select("board", pools.floods("x", 3).alias("f")).collect():
        flat = "".join(r.board)
        ways = solvers.shortest_paths(list(r.board)) if "S" in flat and "G" in flat else []
        goal = r.f[flat.index("G")] if "G" in flat else None
        assert (goal.w if goal else 0) == len(ways)
        if ways:
            assert goal.d == len(ways[0])


def test_maze_pool(spark):
    rows = spark.createDataFrame([(k, b) for k, b in enumerate(MAZES)] + [(9, MAZES[0]), (10, None)], "puzzle_id int, board array<string>")
    got = {r.puzzle_id: r for r in pools.maze_pool(rows, 3, (2, 8), (1, 8), 0.1).collect()}
    assert set(got) == {0, 3, 4}
    assert (got[0].shortest, got[0].n_solutions, got[0].detour, got[0].dead_ends, got[0].branches) == (4, 2, 0, 0, 0)
    # A bend of five cells with a dead end on either side.
    assert (got[3].shortest, got[3].n_solutions, got[3].dead_ends, got[3].branches) == (4, 2, 0, 1)
    assert pools.maze_pool(rows.limit(0), 3, (2, 8)).count() == 0


def brute_cells(board, digit, box):
    n = box[0] * box[1]
    out = {}
    for r, c in itertools.product(range(n), repeat=2):
        if board[r][c] == ".":
            seen = [board[x][y] for x, y in itertools.product(range(n), repeat=2) if x == r or y == c or (x // box[0] == r // box[0] and y // box[1] == c // box[1])]
            out[(r + 1, c + 1)] = (digit in seen, sum(s != "." for s in seen))
    return out


def test_square_pool(spark):
    boards = [(1, ["1...", "....", "..2.", "...3"]), (2, ["1...", "....", "..2.", "...3"]), (3, ["1234", "3412", "2143", "4321"]), (4, ["....", "..1.", "4...", ".2.."]), (5, None)]
    got = {r.puzzle_id: r for r in pools.square_pool(spark.createDataFrame(boards, "puzzle_id int, board array<string>"), "1", (2, 2), (1, 16)).collect()}
    assert set(got) == {1, 4}
    for k, board in boards[:1] + boards[3:4]:
        own = brute_cells(board, "1", (2, 2))
        assert {tuple(x) for x in got[k].cells} == {x for x, (taken, _) in own.items() if not taken}
        assert {tuple(x) for x in got[k].decoys} == {x for x, (taken, _) in own.items() if taken}
        visible = [v for taken, v in own.values() if not taken]
        assert (got[k].least_visible, got[k].most_visible, got[k].n_empty) == (min(visible), max(visible), len(own))
    wide = [(1, ["1.....", "......", "......", "..2...", "......", ".....3"])]
    own = brute_cells(wide[0][1], "1", (2, 3))
    found = pools.square_pool(spark.createDataFrame(wide, "puzzle_id int, board array<string>"), "1", (2, 3), (1, 36)).first()
    assert {tuple(x) for x in found.cells} == {x for x, (taken, _) in own.items() if not taken}


def test_mine_pool(spark):
    boards = [["?0?", "???"], ["?1?", "1??"], ["2??", "???"], ["???", "???"], ["000", "000"], ["?9?", "???"], ["?2?", "?3?"], ["??1", "1?1"]]
    rows = [(k, b, kind) for k, b in enumerate(boards) for kind in ("safe", "mine")] + [(20, boards[0], "safe"), (21, None, "safe"), (22, boards[0], None)]
    got = {(r.puzzle_id, r.kind): r for r in pools.mine_pool(spark.createDataFrame(rows, "puzzle_id int, board array<string>, kind string"), (2, 3), (0, 6)).collect()}
    consistent = {}
    for k, b in enumerate(boards):
        flat = "".join(b)
        unknown = [i for i, x in enumerate(flat) if x == "?"]
        near = lambda i: [j for j in range(6) if j != i and abs(j // 3 - i // 3) <= 1 and abs(j % 3 - i % 3) <= 1]
        ways = (set(m) for n in range(len(unknown) + 1) for m in itertools.combinations(unknown, n))
        consistent[k] = [m for m in ways if all(sum(j in m for j in near(i)) == int(x) for i, x in enumerate(flat) if x != "?")] if unknown else []
    assert {k for k, _ in got} == {k for k, ways in consistent.items() if ways} and (5, "safe") not in got
    for (k, kind), r in got.items():
        assert r.n_assignments == len(consistent[k])
        forced = [i for i, x in enumerate("".join(boards[k])) if x == "?" and all((i in m) == (kind == "mine") for m in consistent[k])]
        assert r.cells == [[i // 3 + 1, i % 3 + 1] for i in forced] == solvers.forced_cells(boards[k], kind)
    crowded = spark.createDataFrame([(1, ["????"] * 5, "safe")], "puzzle_id int, board array<string>, kind string")
    assert pools.mine_pool(crowded, (5, 4), (0, 20)).count() == 0


def cells(n, row):
    return [[row, c + 1] for c in range(n)]


def test_cue_module(spark):
    rows = [(1, "a", cells(5, 1), cells(6, 2), 2), (2, "a", cells(4, 1), cells(3, 2), 9), (3, "a", cells(4, 1), cells(4, 2), 1), (4, "b", None, None, 1), (5, "b", cells(3, 1), cells(9, 2), 1), (6, None, cells(4, 1), cells(4, 2), 1)]
    pool = spark.createDataFrame(rows, "puzzle_id int, family string, cells array<array<int>>, decoys array<array<int>>, score int")
    trials = modules.cue_module(pool, [F.desc("score")], 1, 3)
    got = {r.trial: r for r in trials.collect()}
    assert {r.block for r in got.values()} == {"cue_1", "cue_6"} and len(got) == 6
    assert {tuple(r) for r in trials.repartition(5).collect() for r in [map(str, r)]} == {tuple(map(str, r)) for r in got.values()}
    a, b = got["cue_1/half_a"], got["cue_1/half_b"]
    assert (len(a.valid), len(a.invalid), len(b.valid), len(b.invalid)) == (3, 3, 2, 2)
    assert sorted(a.valid + b.valid) == cells(5, 1) and not [x for x in a.invalid if x in b.invalid]
    assert got["cue_1/baseline"].valid == [] and a.valid == sorted(a.valid)
    assert study.design_problems(trials, {"cue": ["baseline", "half_a", "half_b"]}).count() == 0
    assert {(r.arm, r.block) for r in study.comparisons(trials).collect()} == set(itertools.product(["half_a", "half_b"], ["cue_1", "cue_6"]))


def test_pair_module(spark):
    board = lambda k: [f"{k}12", "345", "678"]
    rows = [(k, "a", board(k)) for k in range(5)] + [(7, "b", board(7)), (8, "c", board(8)), (9, "c", board(9))]
    pool = spark.createDataFrame(rows, "puzzle_id int, family string, board array<string>")
    trials = modules.pair_module(pool, ["puzzle_id"], 3, 1)
    got = {(r.block, r.condition, r.role): r for r in trials.collect()}
    # Family b has nothing to set beside its only board; c's second board is chosen too, as three are.
    assert {r.family for r in got.values()} == {"a"} and len(got) == 15
    controls = [r.shown for (_, condition, role), r in got.items() if (condition, role) == ("unrelated", "first")]
    assert set(controls) == {3, 4} and max(map(controls.count, controls)) == 2
    assert [got[(f"pair_{k}", "alone", "second")].board for k in range(3)] == [["210", "543", "876"], ["678", "345", "112"], ["876", "543", "212"]]
    assert len({tuple(got[("pair_1", c, "second")].board) for c in ("alone", "related", "unrelated")}) == 1
    named = trials.withColumn("condition", F.concat_ws("/", "condition", "role"))
    assert study.design_problems(named, {"pair": ["alone/second", "related/first", "related/second", "unrelated/first", "unrelated/second"]}).count() == 0
    assert {r.arm for r in study.comparisons(trials).collect()} == {"related", "unrelated"} and study.comparisons(trials).count() == 6
    cell = F.array(F.lit(1), F.lit(3))
    places = spark.range(1).select(*[modules.reflected_cell(cell, F.lit(how), 3).alias(how) for how in ("mirror_h", "mirror_v", "mirror_hv")]).first()
    assert (places.mirror_h, places.mirror_v, places.mirror_hv) == ([1, 1], [3, 3], [3, 1])


def test_formulation_module(spark):
    rows = [(k, "a", [6, 1, k % 3 + 1, 4], 5) for k in range(30)] + [(40, "b", [2, 2, 2, 2], 5), (41, "b", None, 5), (42, "b", [1, 2, 3, 4], 9), (43, "b", [2, 2, 2, 1], 3)]
    pool = spark.createDataFrame(rows, "puzzle_id int, family string, numbers array<int>, n_solutions int")
    trials = modules.formulation_module(pool, ["n_solutions"], 20, 2)
    blocks = {}
    for r in trials.collect():
        blocks.setdefault(r.block, {})[r.condition] = r.numbers
    assert len(blocks) == 21 and "formulation_43" in blocks
    for b in blocks.values():
        assert b["ascending"] == sorted(b["shuffled"]) != b["shuffled"]
    assert study.design_problems(trials, {"formulation": ["ascending", "shuffled"]}).count() == 0


def test_fresh_sources(spark):
    pool = spark.createDataFrame([(1, ["ab"]), (2, ["cd"]), (3, None)], "puzzle_id int, board array<string>")
    used = spark.createDataFrame([(9, ["ab"]), (10, None)], "puzzle_id int, board array<string>")
    assert {r.puzzle_id for r in modules.fresh(pool, used, "board").collect()} == {2, 3}


@pytest.mark.parametrize("n, names", [(1, ["simplest"]), (3, ["simplest", "simple", "complex"]), (7, ["simplest", "simple", "simple", "middle", "middle", "complex", "complex"])])
def test_ranked_simplicity(spark, n, names):
    rows = spark.createDataFrame([("p", k, 0.5) for k in range(n)], "puzzle_id string, k int, score double")
    got = pools.ranked_simplicity(rows, "score", ["k"]).orderBy("k").collect()
    assert [r.bucket for r in got] == names and got[0].percentile == 0 and (n == 1 or got[-1].percentile == 1)


def test_places_over_all_rows(spark):
    values = [((k * 7919) % 101, k) for k in range(300)]
    rows = spark.createDataFrame(values, "v int, k int").repartition(7)
    got = {r.k: r.place for r in ordering.numbered(rows, [F.desc("v"), F.col("k")]).collect()}
    assert got == {k: i + 1 for i, (_, k) in enumerate(sorted(values, key=lambda x: (-x[0], x[1])))}
    assert ordering.numbered(rows.limit(0), ["v", "k"]).count() == 0
    for n in range(1, 9):
        at = spark.range(1, n + 1).select("id", ordering.thirds(F.col("id"), n).alias("t"), F.ntile(3).over(ordering.Window.orderBy("id")).alias("u")).collect()
        assert [r.t for r in at] == [r.u for r in at]


def test_holm_over_ranges_is_holm(spark):
    rows = spark.createDataFrame([(k, ((k * 37) % 50 + 1) / 20000, 0) for k in range(120)], "k int, p double, g int")
    one = {r.k: r.p_holm for r in ordering.holm(rows, "p", ["k"]).collect()}
    assert one == pytest.approx({r.k: r.p_holm for r in ordering.holm(rows, "p", ["k"], ["g"]).collect()})


def test_long_pseudonyms_are_whole(spark):
    known = spark.createDataFrame([("a", "P9998")], "name string, alias string")
    got = records.pseudonyms(spark.createDataFrame([(x,) for x in "abcd"], "name string"), "name", known).collect()
    assert {r.name: r.alias for r in got} == {"a": "P9998", "b": "P9999", "c": "P10000", "d": "P10001"}
