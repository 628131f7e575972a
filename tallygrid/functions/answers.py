"""Free-text answers as columns: the final line, moves, coordinates, expressions, labelled parts, and verdicts.

Everything but arithmetic runs inside the JVM.  Patterns use Unicode classes
and take only ``\\n`` for a line's end.  Fixed values: the patterns, reasons and
notes are those of answer format 5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = "response_parser_v5"
_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

NO_MOVES = "No U/D/L/R move string found."
MANY_MOVES = "Multiple move-like spans found; selected the longest."
NO_PAIRS = "No coordinate pairs found."
FLAT_PAIRS = "Coordinates inferred from a flat number list."
NO_EXPRESSION = "No arithmetic-looking expression found."
MANY_EXPRESSIONS = "Multiple expression-like spans found; selected the longest."
PERIOD = "Ignored one sentence-terminal period."
PART_MISSING = "A labeled sequence answer is missing; left the missing slot empty."
BY_LINES = "Sequence answer inferred from line order."
TOO_FEW = "Too few sequence answers; left unanswered slots empty."


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE, "")


def final_line(text: Column) -> Column:
    """What follows the last ``ANSWER:``; the whole text where there is none."""
    found = F.regexp_extract_all(text, F.lit(r"(?imdU)^\s*ANSWER\s*:\s*(.+?)\s*$"), F.lit(1))
    return F.when(F.size(found) > 0, stripped(F.element_at(found, -1))).otherwise(text)


def has_period(text: Column) -> Column:
    """One final period, not an ellipsis, after something."""
    end = F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+$", "")
    return (F.length(end) > 1) & end.endswith(".") & ~end.endswith("..")


def without_period(text: Column) -> Column:
    end = F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+$", "")
    return F.when(has_period(text), F.regexp_replace(end, r"(?U)[\s\x1c-\x1f]*\.$", "")).otherwise(end)


def _first_longest(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))


def _quoted(text: Column) -> Column:
    """The first span in back quotes, or the text."""
    found = F.regexp_extract_all(text, F.lit("`([^`]+)`"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, 1)).otherwise(text)


def _found(value: Column, confidence: Column, manual: Column, notes: Column) -> Column:
    return F.struct(value.alias("value"), confidence.alias("confidence"), manual.alias("manual"), notes.alias("notes"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def moves(text: Column) -> Column:
    """struct(value, confidence, manual, notes): a string of U, D, L, R, null if there is none."""
    letters = lambda x: F.array_join(F.regexp_extract_all(x, F.lit("[UDLR]"), F.lit(0)), "")
    high = lambda x: _found(x, F.lit("high"), F.lit(False), F.lit(""))
    none = _found(F.lit(None).cast("string"), F.lit("low"), F.lit(False), F.lit(NO_MOVES))

    def by_runs(runs: Column) -> Column:
        several = F.size(runs) > 1
        longest = _found(_first_longest(runs), F.when(several, "medium").otherwise("high"), several, F.when(several, MANY_MOVES).otherwise(""))
        return F.when(F.size(runs) > 0, longest).otherwise(none)

    def read(t: Column) -> Column:
        named = F.regexp_extract(t, r"(?U)\b(?:PATH|MOVES?)\s*[:=]\s*([UDLR][UDLR\s,;:.-]*)", 1)
        plain = t.rlike(r"(?U)^[UDLR\s,;:.-]+\z") & t.rlike("[UDLR]")
        runs = _once(F.regexp_extract_all(t, F.lit("[UDLR]+"), F.lit(0)), by_runs)
        return _once(named, lambda x: F.when(x != "", high(letters(x))).when(plain, high(letters(t))).otherwise(runs))

    return _once(_quoted(F.upper(stripped(text))), read)


def coordinates(text: Column) -> Column:
    """struct(value, confidence, manual, notes): pairs of numbers, or an even list of two or more numbers taken in pairs."""
    pattern = F.lit(r"(?U)\(?\s*(\d+)\s*,\s*(\d+)\s*\)?")
    whole = lambda xs: F.transform(xs, lambda x: x.cast("long"))
    rows, columns = (whole(F.regexp_extract_all(text, pattern, F.lit(k))) for k in (1, 2))
    pairs = F.zip_with(rows, columns, lambda r, c: F.array(r, c))
    flat = whole(F.regexp_extract_all(text, F.lit(r"(?U)\d+"), F.lit(0)))
    n = F.size(flat)
    even = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (n / 2).cast("int"))), lambda k: F.slice(flat, 2 * k - 1, 2))
    none = F.array().cast("array<array<bigint>>")
    return (
        F.when(F.size(pairs) > 0, _found(pairs, F.lit("high"), F.lit(False), F.lit("")))
        .when((n >= 2) & (n % 2 == 0), _found(even, F.lit("medium"), F.lit(False), F.lit(FLAT_PAIRS)))
        .otherwise(_found(none, F.lit("low"), F.lit(False), F.lit(NO_PAIRS)))
    )


def expression(text: Column) -> Column:
    """struct(value, confidence, manual, notes): the longest arithmetic span, without a right-hand side that has 24."""
    t = stripped(text)
    quoted = t.contains("`") & t.rlike("`[^`]+`")
    t = _quoted(t)
    left = F.substring_index(t, "=", 1)
    right = F.when(t.contains("="), F.substring(t, F.length(left) + 2, F.length(t))).otherwise("")
    t = F.when(right.contains("24"), left).otherwise(t)
    spans = F.regexp_extract_all(t, F.lit(r"(?U)[-+*/().\d\s]+"), F.lit(0))
    spans = F.filter(F.transform(spans, stripped), lambda x: x.rlike(r"(?U)\d"))
    several = F.size(spans) > 1
    found = _found(_first_longest(spans), F.when(several | quoted, "medium").otherwise("high"), several, F.when(several, MANY_EXPRESSIONS).otherwise(""))
    none = _found(F.lit(None).cast("string"), F.lit("low"), F.lit(False), F.lit(NO_EXPRESSION))
    return F.when(F.size(spans) > 0, found).otherwise(none)


def sequence_parts(text: Column, n: Column) -> Column:
    """struct(answers, confidence, notes): the parts of a joint answer to n (up to 4) puzzles, by label or else by line."""
    label = r"(?iU)(?<![A-Za-z0-9])(?:Puzzle|Problem)?\s*([A-D])\s*[:\-]\s*"
    t = stripped(F.coalesce(text, F.lit("")))
    names = F.transform(F.regexp_extract_all(t, F.lit(label), F.lit(1)), F.upper)
    pieces = F.split(t, label, -1)
    place = F.transform(names, lambda x: F.ascii(x) - 64)
    known = F.exists(place, lambda k: k <= n)
    parts = F.zip_with(place, F.transform(F.slice(pieces, 2, F.greatest(F.size(names), F.lit(1))), lambda x: F.regexp_replace(stripped(x), r"(?U)^[;\s]+|[;\s]+$", "")), lambda k, x: F.struct(k.alias("k"), x.alias("x")))
    slots = F.sequence(F.lit(1), n)
    labelled = F.transform(slots, lambda k: F.coalesce(F.try_element_at(F.transform(F.filter(parts, lambda p: (p["k"] == k) & (p["x"] != "")), lambda p: p["x"]), F.lit(-1)), F.lit("")))
    lines = F.filter(F.transform(F.split(t, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"), stripped), lambda x: x != "")
    out = lambda xs, confidence, notes: F.struct(xs.alias("answers"), F.lit(confidence).alias("confidence"), F.lit(notes).alias("notes"))
    return (
        F.when(known & ~F.exists(labelled, lambda x: x == ""), out(labelled, "high", ""))
        .when(known, out(labelled, "low", PART_MISSING))
        .when(F.size(lines) >= n, out(F.slice(lines, F.lit(1), n), "medium", BY_LINES))
        .otherwise(out(F.transform(slots, lambda k: F.lit("")), "low", TOO_FEW))
    )


def rooks_reason(board: Column, m: Column, pairs: Column) -> Column:
    """Why a placement is wrong, by the first rule it breaks; null if it breaks none."""
    n = F.size(board)
    rows, columns = F.transform(pairs, lambda p: p[0]), F.transform(pairs, lambda p: p[1])
    outside = lambda p: (p[0] < 1) | (p[0] > n) | (p[1] < 1) | (p[1] > n)
    cell = lambda p: F.substring(F.element_at(board, p[0].cast("int")), p[1].cast("int"), F.lit(1))
    # Cells are judged in their order, so the first bad one names the reason.
    first = F.try_element_at(F.filter(F.transform(pairs, lambda p: F.when(outside(p), "coordinate_out_of_bounds").when(cell(p) == "X", "forbidden_cell")), lambda x: x.isNotNull()), F.lit(1))
    return (
        F.when(F.size(pairs) != m, "wrong_number_of_tokens")
        .when(F.size(F.array_distinct(pairs)) < F.size(pairs), "duplicate_coordinate")
        .when(F.size(F.array_distinct(rows)) < F.size(rows), "row_conflict")
        .when(F.size(F.array_distinct(columns)) < F.size(columns), "column_conflict")
        .otherwise(first)
    )


def maze_reason(grid: Column, path: Column, shortest: Column) -> Column:
    """Why a walk from S is wrong, by the first rule it breaks: bounds, wall, goal, length; null if it breaks none."""
    at = lambda mark: F.struct(
        (F.array_position(F.transform(grid, lambda row: row.contains(mark)), True) - 1).alias("r"),
        (F.instr(F.element_at(F.filter(grid, lambda row: row.contains(mark)), 1), mark) - 1).cast("long").alias("c"),
    )
    start, goal = at("S"), at("G")
    zero = F.struct(start["r"].alias("r"), start["c"].alias("c"), F.lit(None).cast("string").alias("why"))

    def step(s: Column, move: Column) -> Column:
        r = s["r"] + F.when(move == "U", -1).when(move == "D", 1).otherwise(0)
        c = s["c"] + F.when(move == "L", -1).when(move == "R", 1).otherwise(0)
        inside = (r >= 0) & (r < F.size(grid)) & (c >= 0) & (c < F.length(F.element_at(grid, 1)))
        cell = F.when(inside, F.substring(F.element_at(grid, (r + 1).cast("int")), (c + 1).cast("int"), F.lit(1)))
        why = F.when(s["why"].isNotNull(), s["why"]).when(~inside, "path_out_of_bounds").when(cell == "#", "path_hits_wall")
        return F.struct(r.cast("long").alias("r"), c.cast("long").alias("c"), why.alias("why"))

    end = F.aggregate(F.regexp_extract_all(path, F.lit("."), F.lit(0)), zero, step)
    away = (end["r"] != goal["r"]) | (end["c"] != goal["c"])
    return F.when(end["why"].isNotNull(), end["why"]).when(away, "does_not_reach_goal").when(F.length(path) != shortest, "not_shortest")


def reflected(row: Column, column: Column, height: Column, width: Column, how: str) -> tuple[Column, Column]:
    """A 1-based cell under mirror_h, mirror_v or mirror_hv."""
    across = width + 1 - column if how in ("mirror_h", "mirror_hv") else column
    down = height + 1 - row if how in ("mirror_v", "mirror_hv") else row
    return down, across


def first_number(*columns: Column) -> Column:
    """The first that is neither null nor an empty string, as a number."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns]).cast("double")


def resolved_class(valid: Column, abstract: Column, concrete: Column) -> Column:
    """The abstract class of a valid answer, or else its own; null for an invalid one."""
    return F.when(F.coalesce(valid, F.lit(False)), F.coalesce(F.nullif(abstract, F.lit("")), F.nullif(concrete, F.lit(""))))


def preferred(*columns: Column) -> Column:
    """The first that is neither null nor an empty string."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])
