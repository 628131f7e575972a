"""Answer texts: the fixed cases of format 5, and whole verdicts."""

import pytest
from pyspark.sql import functions as F

from tallygrid.functions import answers as a
from tallygrid.functions.expressions import canonical
from tallygrid.operators import scoring


def values(spark, texts, column):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_sequence_parts(spark):
    """Made from the rules: every order of labels, spelling of a label and missing part."""
    left, right = "URDD", "3*8"
    labels = {"plain": "{k}: ", "dash": "{k} - ", "puzzle": "Puzzle {k}: ", "problem": "problem {k} :"}
    cases = []
    for form in labels.values():
        one, other = form.format(k="A") + left, form.format(k="B") + right
        cases += [(f"{one}\n{other}", [left, right], "high"), (f"{other} ; {one}", [left, right], "high"), (one.lower().replace(left.lower(), left), [left, ""], "low"), (other, ["", right], "low")]
    # Without labels the first lines count, and a word that ends in a label's letter is none.
    cases += [(f"\n {left} \n\n{right}\nmore", [left, right], "medium"), (f"DATA: {left}", ["", ""], "low"), (left, ["", ""], "low"), (" \n ", ["", ""], "low"), (None, ["", ""], "low")]
    # The last of a label's parts counts, and labels beyond the number of puzzles are none.
    cases += [(f"A: x\nA: {left}\nB: {right}", [left, right], "high"), (f"C: {left}", ["", ""], "low")]
    got = values(spark, [c[0] for c in cases], lambda t: a.sequence_parts(t, F.lit(2)))
    assert [(g.answers, g.confidence) for g in got] == [c[1:] for c in cases]


def test_final_line_and_period(spark):
    assert values(spark, ["work\nANSWER: one\nanswer : two. \n", "none", "  Answer: x"], a.final_line) == ["two.", "none", "x"]
    assert values(spark, ["a.", "a..", ".", "a. ", "a ."], a.without_period) == ["a", "a..", ".", "a", "a"]


def test_moves_coordinates_expressions(spark):
    moves = values(spark, ["path: U, d L", "`udl` RR", "go UU then DDD", "12 34", "U D; L"], a.moves)
    assert [(m.value, m.confidence) for m in moves] == [("UDL", "high"), ("UDL", "high"), ("DDD", "medium"), (None, "low"), ("UDL", "high")]
    pairs = values(spark, ["(1,2), ( 3 , 4 )", "1 2 3 4", "1 2 3", "none"], a.coordinates)
    assert [(p.value, p.confidence) for p in pairs] == [([[1, 2], [3, 4]], "high"), ([[1, 2], [3, 4]], "medium"), ([], "low"), ([], "low")]
    sums = values(spark, ["expression=8*3+4-4", "8*3 = 24", "`(1+2)*8`", "a 1+1 b 22+2", "no"], a.expression)
    assert [(s.value, s.confidence) for s in sums] == [("8*3+4-4", "high"), ("8*3", "high"), ("(1+2)*8", "medium"), ("22+2", "medium"), (None, "low")]


@pytest.mark.parametrize(
    ("text", "numbers", "form"),
    [
        ("8*3+4-4", [3, 4, 4, 8], "((3*8)+4-4)"),
        ("4-4+3*8", [3, 4, 4, 8], "((3*8)+4-4)"),
        ("(1+3)*(2+4)", [1, 2, 3, 4], "((1+3)*(2+4))"),
        ("8/(3-8/3)", [3, 3, 8, 8], "(8/(3-(8/3)))"),
        ("24/(1*1)/1", [1, 1, 1, 24], "(24/(1*1*1))"),
        ("8*3", [3, 4, 4, 8], None),
        ("8*3+4-3", [3, 3, 4, 8], None),
        ("8/0", [0, 8], None),
        ("8**3", [3, 8], None),
        ("8 3", [3, 8], None),
        ("(24", [24], None),
        ("", [], None),
        (None, None, None),
    ],
)
def test_canonical(text, numbers, form):
    assert canonical(text, numbers) == form


def test_scoring(spark):
    puzzles = spark.createDataFrame(
        [
            ("mine", "minesweeper_lite", None, None, None, None, ["?0"], None, [[1, 1]], [("m1", "M", "[1,1]")]),
            ("rooks", "grid_placement", None, None, None, None, ["..", ".."], 2, None, [("r1", "R", "[[1,1],[2,2]]")]),
            ("maze", "maze", None, None, ["S.", "#G"], 2, None, None, None, [("z1", "Z", "RD")]),
            ("sum", "arithmetic24", [3, 4, 4, 8], 24, None, None, None, None, None, [("s1", "S", "((3*8)+4-4)")]),
        ],
        ", ".join(f"{k} {v}" for k, v in scoring.PUZZLE.items()),
    )
    cases = [
        ("mine", "(1,1)", True, None),
        ("mine", "(1,1), (2,2)", False, "wrong_number_of_tokens"),
        ("mine", "(9,9)", False, "invalid_coordinate"),
        ("mine", "", False, "empty"),
        ("rooks", "(2,2), (1,1)", True, None),
        ("rooks", "(1,1), (1,2)", False, "row_conflict"),
        ("rooks", "(1,1), (1,1)", False, "duplicate_coordinate"),
        ("rooks", "(1,2), (2,2)", False, "column_conflict"),
        ("rooks", "(1,1), (3,3)", False, "coordinate_out_of_bounds"),
        ("rooks", "(1,2), (2,1)", False, "valid_but_unmatched_solution"),
        ("maze", "MOVES: R D", True, None),
        ("maze", "D", False, "path_hits_wall"),
        ("maze", "L", False, "path_out_of_bounds"),
        ("maze", "R", False, "does_not_reach_goal"),
        ("maze", "RLRD", False, "not_shortest"),
        ("sum", "ANSWER: expression=8*3+4-4.", True, None),
        ("sum", "ANSWER: 8*3+4-4..", False, "wrong_arithmetic"),
        ("sum", "words", False, "format_error"),
        ("other", "x", False, "unknown_puzzle_id"),
    ]
    rows = spark.createDataFrame([(str(i), "single", c[0], None, c[1], c[1]) for i, c in enumerate(cases)], "request_id string, input_kind string, puzzle_id string, trial_ids string, raw_answer string, raw_response string")
    got = {int(r.request_id): (r.is_valid, r.invalid_reason) for r in scoring.scored(scoring.expanded(rows), puzzles).collect()}
    assert {i: got[i] for i in got} == {i: c[2:] for i, c in enumerate(cases)}


def test_missing_part_keeps_its_slot(spark):
    puzzles = spark.createDataFrame([("mine", "minesweeper_lite", ["?0"], [[1, 1]], [("m1", "M", "[1,1]")])], "puzzle_id string, puzzle_type string, board array<string>, legal array<array<bigint>>, solutions array<struct<solution_id:string,abstract_solution_id:string,answer:string>>")
    rows = spark.createDataFrame([("q", "sequence", "both", "mine;mine", "B: (1,1)", "B: (1,1)")], "request_id string, input_kind string, puzzle_id string, trial_ids string, raw_answer string, raw_response string")
    out = scoring.scored(scoring.expanded(rows), puzzles).orderBy("sequence_position").collect()
    assert [(r.sequence_label, r.is_valid, r.invalid_reason) for r in out] == [("A", False, "empty"), ("B", True, None)]
    ended = scoring.ended_without_answer(spark.createDataFrame([(True, None, "s", "S", "x", "y", "v", "high", True, False)], "is_valid boolean, invalid_reason string, solution_id string, abstract_solution_id string, parsed_answer string, canonical_answer string, parser_version string, parse_confidence string, timeout boolean, gave_up boolean")).first()
    assert (ended.is_valid, ended.invalid_reason, ended.solution_id) == (False, "timeout", None)
