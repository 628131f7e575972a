"""Raw answers to verdicts: sequence rows become trial rows, trials meet their puzzle, and each is scored."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallygrid.functions import answers as a
from tallygrid.functions.expressions import canonical

#: Columns of puzzles that scoring reads; a missing one counts as null.
PUZZLE = {
    "puzzle_id": "string", "puzzle_type": "string", "numbers": "array<int>", "target": "int", "grid": "array<string>", "shortest": "int", "board": "array<string>", "m": "int",
    "legal": "array<array<bigint>>", "solutions": "array<struct<solution_id:string,abstract_solution_id:string,answer:string>>",
}


@F.pandas_udf(StringType())
def canonical_expression(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, numbers, target in parts:
        yield pd.Series([canonical(t, None if n is None else list(n), 24 if pd.isna(g) else int(g)) for t, n, g in zip(text, numbers, target, strict=True)], dtype=object)


def expanded(responses: DataFrame) -> DataFrame:
    """One row for each trial of a response; ``trial_ids`` are joined by semicolons, their labels are A to D."""
    ids = F.filter(F.transform(F.split(F.coalesce(F.nullif("trial_ids", F.lit("")), "puzzle_id", F.lit("")), ";"), a.stripped), lambda x: x != "")
    many = (F.col("input_kind") == "sequence") & (F.size(ids) > 1)
    rows = responses.withColumn("_ids", F.when(many, ids).otherwise(F.array("puzzle_id")))
    parts = a.sequence_parts(F.coalesce("raw_response", "raw_answer"), F.size("_ids"))
    rows = rows.withColumn("_parts", F.when(many, parts)).select("*", F.posexplode("_ids").alias("_k", "_id"))
    joint = F.col("_parts").isNotNull()
    return rows.withColumns(
        {
            "sequence_parent_puzzle_id": F.when(joint, F.col("puzzle_id")),
            "puzzle_id": F.col("_id"),
            "raw_answer": F.when(joint, F.try_element_at(F.col("_parts")["answers"], F.col("_k") + 1)).otherwise(F.col("raw_answer")),
            "sequence_position": F.when(joint, F.col("_k") + 1),
            "sequence_label": F.when(joint, F.substring(F.lit("ABCD"), F.col("_k") + 1, F.lit(1))),
            "sequence_parse_confidence": F.col("_parts")["confidence"],
            "sequence_parse_notes": F.col("_parts")["notes"],
        }
    ).drop("_ids", "_parts", "_k", "_id")


def _verdict(reason: Column, answer: Column, found: Column) -> Column:
    return F.struct(reason.alias("reason"), answer.alias("answer"), found["confidence"].alias("confidence"), found["manual"].alias("manual"), found["notes"].alias("notes"))


def scored(trials: DataFrame, puzzles: DataFrame) -> DataFrame:
    """Adds is_valid, invalid_reason, solution_id, abstract_solution_id, parsed_answer and the parse fields.

    Unknown puzzles stay, as invalid rows.  The puzzle dimension is joined once;
    its solutions are an array, matched in the row.
    """
    for name, kind in PUZZLE.items():
        if name not in puzzles.columns:
            puzzles = puzzles.withColumn(name, F.lit(None).cast(kind))
    dimension = puzzles.select("puzzle_id", F.struct(*[c for c in PUZZLE if c != "puzzle_id"]).alias("_z"))
    rows = trials.join(dimension, "puzzle_id", "left")
    z = F.col("_z")
    # An absent part of a sequence must not take the other part's text.
    whole = F.when((F.col("input_kind") == "sequence") & (F.coalesce("raw_answer", F.lit("")) == ""), F.lit("")).otherwise(F.coalesce("raw_response", "raw_answer", F.lit("")))
    text = a.stripped(F.coalesce(F.nullif("raw_answer", F.lit("")), F.nullif(a.stripped(whole), F.lit("")), F.lit("")))
    rows = rows.withColumn("_text", text)
    line = a.final_line(F.col("_text"))
    rows = rows.withColumns({"_period": a.has_period(line), "_line": a.without_period(line)})
    line, none = F.col("_line"), F.lit(None).cast("string")

    pairs, walk, sum_ = a.coordinates(line), a.moves(line), a.expression(line)
    as_text = lambda ps: F.to_json(ps)
    cells = pairs["value"]
    rooks = F.when(F.size(cells) == 0, F.lit("format_error")).otherwise(a.rooks_reason(z["board"], z["m"], cells))
    one = F.when(F.size(cells) == 0, F.lit("format_error")).when(F.size(cells) != 1, F.lit("wrong_number_of_tokens")).when(~F.coalesce(F.array_contains(z["legal"], F.try_element_at(cells, F.lit(1))), F.lit(False)), F.lit("invalid_coordinate"))
    path = F.when(walk["value"].isNull(), F.lit("format_error")).otherwise(a.maze_reason(z["grid"], walk["value"], z["shortest"]))
    kind = z["puzzle_type"]
    verdict = (
        F.when(kind == "maze", _verdict(path, walk["value"], walk))
        .when(kind == "grid_placement", _verdict(rooks, F.when(F.size(cells) > 0, as_text(F.when(rooks.isNull(), F.array_sort(cells)).otherwise(cells))), pairs))
        .when(kind.isin("minesweeper_lite", "mini_sudoku"), _verdict(one, F.when(F.size(cells) > 0, F.when(F.size(cells) == 1, as_text(F.try_element_at(cells, F.lit(1)))).otherwise(as_text(cells))), pairs))
        .when(kind == "arithmetic24", _verdict(F.when(sum_["value"].isNull(), F.lit("format_error")), sum_["value"], sum_))
    )
    rows = rows.withColumn("_v", verdict)
    # Only arithmetic rows cross to Python.
    wanted = F.when(kind == "arithmetic24", F.col("_v")["answer"])
    rows = rows.withColumn("_canonical", canonical_expression(wanted, z["numbers"], z["target"]))
    v = F.col("_v")
    reason = F.when(F.col("_z").isNull(), F.lit("unknown_puzzle_id")).when(F.col("_text") == "", F.lit("empty")).when(v.isNull(), F.lit("unknown_puzzle_type"))
    reason = reason.otherwise(F.coalesce(v["reason"], F.when((kind == "arithmetic24") & F.col("_canonical").isNull(), F.lit("wrong_arithmetic"))))
    answer = F.when(kind == "arithmetic24", F.col("_canonical")).otherwise(v["answer"])
    rows = rows.withColumns({"_reason": reason, "_answer": answer})
    match = F.try_element_at(F.filter(z["solutions"], lambda s: s["answer"] == F.col("_answer")), F.lit(1))
    rows = rows.withColumn("_s", F.when(F.col("_reason").isNull(), match))
    valid = F.col("_s").isNotNull()
    unmatched = F.col("_reason").isNull() & ~valid
    notes = F.concat_ws(" ", F.when(F.col("_period") & F.col("_z").isNotNull() & (F.col("_text") != ""), a.PERIOD), F.nullif(v["notes"], F.lit("")))
    return rows.withColumns(
        {
            "is_valid": valid,
            "invalid_reason": F.when(unmatched, F.lit("valid_but_unmatched_solution")).otherwise(F.col("_reason")),
            "solution_id": F.when(valid, F.col("_s")["solution_id"]),
            "abstract_solution_id": F.when(valid, F.col("_s")["abstract_solution_id"]),
            "parsed_answer": F.coalesce(v["answer"], none),
            "canonical_answer": F.when(valid, F.col("_answer")),
            "parser_version": F.when(F.col("_z").isNotNull(), F.lit(a.VERSION)),
            "parse_confidence": F.coalesce(v["confidence"], F.lit("low")),
            "requires_manual_review": F.coalesce(v["manual"], F.lit(False)) | unmatched | F.col("_z").isNull(),
            "parse_notes": F.when(F.col("_z").isNull(), "Puzzle ID was not found in the dataset.").when(F.col("_text") == "", "No answer text found.").otherwise(notes),
        }
    ).drop("_z", "_text", "_period", "_line", "_v", "_canonical", "_reason", "_answer", "_s")


def ended_without_answer(rows: DataFrame) -> DataFrame:
    """Time-outs and giving up override a score; their columns may be missing."""
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in rows.columns else F.lit(False)
    late, gave_up = flag("timeout"), flag("gave_up") | flag("skipped")
    reason = F.when(late & gave_up, "timeout_or_give_up").when(late, "timeout").when(gave_up, "give_up")
    ended = late | gave_up
    blank = F.lit(None).cast("string")
    return rows.withColumns(
        {
            "is_valid": F.when(ended, F.lit(False)).otherwise(F.col("is_valid")),
            "invalid_reason": F.when(ended, reason).otherwise(F.col("invalid_reason")),
            "parser_version": F.when(ended, "human_outcome_v1").otherwise(F.col("parser_version")),
            "parse_confidence": F.when(ended, "high").otherwise(F.col("parse_confidence")),
            **{c: F.when(ended, blank).otherwise(F.col(c)) for c in ("solution_id", "abstract_solution_id", "parsed_answer", "canonical_answer")},
        }
    )
