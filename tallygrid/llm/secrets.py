"""Secrets in texts: three fixed patterns, and a battery of randomness tests with false-discovery control.

Only SQL functions are used: a pattern's matches come from ``regexp_extract_all``,
their places from the lengths of the pieces that ``split`` leaves between them.

**Battery.**  Candidates are runs of 20 or more characters of the base-64
alphabets.  For each an encoding is inferred (hex, base 32, base 64), and three
tests ask whether it could be uniform over that alphabet: chi-squared on the
counts of the alphabet's characters, the runs test on changes of class (capital,
small, digit, sign) given the class counts, and the lag-1 serial correlation of
alphabet positions.  A candidate that one of them rejects at 0.001 gets the
p-value 1.

**False discoveries.**  The null hypothesis of a discovery is a token of prose
or code.  Two statistics of the battery speak against it: fewer equal pairs of
characters (which is chi-squared) than text has, by the exact mean and
variance of their number (p at most exp(-z^2/2)/2), and more changes of class
than text has, a capital before a small letter not counted
(p by the Chernoff bound).  Fisher's rule joins the two.  Benjamini-Hochberg
with weights in proportion to the length is run over all candidates of all
documents, the rejected ones included, and what it discovers is what is
reported.  It needs only how many p-values lie below each of ``N_BINS`` bounds:
a table of fixed size, taken to the driver.

Defined results: null and empty texts have no spans; a null ``doc_id`` and
repeated rows are kept as rows; with no candidates nothing is added; spans that
overlap a base one are not added, and spans that start together are ordered by
kind; texts of any length are read whole; an empty table gives no rows; other
columns are ignored by :func:`find` and kept, whatever their names, by
:func:`redact`.  Places count code points, the end excluded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, checkpointed, table

# Fixed values of the query's contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
FDR = 0.01
N_BINS = 400
BIN = 0.05
LENGTH = 32  # weights are 1 at this length before they are scaled to a mean of 1

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encoding: pattern, alphabet, and for a token of prose, code or numbers the chance that two (three) of its characters are equal and that a place changes class.
ENCODINGS = {
    "hex": (r"^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.12, 0.016, 0.15),
    "base32": (r"^[A-Z2-7]+=*$", _UPPER + "234567", 0.065, 0.0053, 0.1),
    "base64": (r"^", _UPPER + _LOWER + _DIGITS + "+/", 0.065, 0.0053, 0.2),
}
#: Upper 0.001 point of the normal, and of its absolute value.
UPPER_CRITICAL, Z_CRITICAL = 3.09, 3.29

_SPAN = "array<struct<start:int,end:int>>"


def _places(text: Column, pattern: str) -> Column:
    """Start and end of each match."""
    matched = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(matched, F.length).alias("size"))
    steps = F.filter(steps, lambda s: s["size"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(acc: Column, s: Column) -> Column:
        start, end = acc["at"] + s["gap"], acc["at"] + s["gap"] + s["size"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    found = F.aggregate(steps, zero, add, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _assign(text: Column) -> Column:
    """Places of the assignments whose value is long enough."""
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_LEAST)
    pairs = F.arrays_zip(_places(text, ASSIGN).alias("place"), long_enough.alias("ok"))
    kept = F.transform(F.filter(pairs, lambda p: p["ok"]), lambda p: p["place"])
    return F.when(text.rlike(ASSIGN), kept).otherwise(F.array().cast(_SPAN))


def _count(token: Column, characters: str) -> Column:
    return (F.length(token) - F.length(F.translate(token, characters, ""))).cast("double")


def _battery(token: Column) -> Column:
    """-log10 of the weighted p-value under prose, or of 1 where a test rejects uniformity."""
    body = F.regexp_replace(token, "=+$", "")
    body = F.translate(F.when(token.rlike(ENCODINGS["hex"][0]), F.lower(body)).otherwise(body), "-_", "+/")
    n = F.length(body).cast("double")

    def by_encoding(of) -> Column:
        return F.when(token.rlike(ENCODINGS["hex"][0]), of(*ENCODINGS["hex"][1:])).when(token.rlike(ENCODINGS["base32"][0]), of(*ENCODINGS["base32"][1:])).otherwise(of(*ENCODINGS["base64"][1:]))

    add = lambda acc, x: acc + x
    characters = F.regexp_extract_all(body, F.lit("."), F.lit(0))
    squares = F.aggregate(F.transform(F.array_distinct(characters), lambda c: F.pow(n - F.length(F.replace(body, c, F.lit(""))), F.lit(2.0))), F.lit(0.0), add)

    # Uniform over the alphabet: chi-squared (its upper point by the cube-root rule), runs of classes, serial correlation.
    size = by_encoding(lambda a, *_: F.lit(float(len(a))))
    point = by_encoding(lambda a, *_: F.lit((len(a) - 1) * (1 - 2 / (9 * (len(a) - 1)) + UPPER_CRITICAL * math.sqrt(2 / (9 * (len(a) - 1)))) ** 3))
    uneven = squares * size / n - n > point

    classes = [_count(body, x) for x in (_UPPER, _LOWER, _DIGITS)]
    classes.append(n - classes[0] - classes[1] - classes[2])
    second, third = (sum((c**k for c in classes[1:]), classes[0] ** k) for k in (2, 3))
    runs = F.size(F.regexp_extract_all(body, F.lit("[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0)))
    spread = (second * (second + n * (n + 1)) - 2 * n * third - n**3) / (n * n * (n - 1))
    z_runs = F.when(spread > 1e-9, F.abs(runs - (n + 1 - second / n)) / F.sqrt(spread)).otherwise(0.0)

    places = F.transform(characters, lambda c: by_encoding(lambda a, *_: F.instr(F.lit(a), c)).cast("double"))
    average = F.aggregate(places, F.lit(0.0), add) / n
    deviations = F.transform(places, lambda x: x - average)
    products = F.zip_with(F.slice(deviations, 1, F.size(deviations) - 1), F.slice(deviations, 2, F.size(deviations) - 1), lambda x, y: x * y)
    power = F.aggregate(F.transform(deviations, lambda x: x * x), F.lit(0.0), add)
    z_serial = F.when(power > 1e-9, F.abs(F.aggregate(products, F.lit(0.0), add) / power + 1 / n) * F.sqrt(n)).otherwise(99.0)

    # Prose: equal pairs of characters, and changes of class.
    two, three = by_encoding(lambda a, two, *_: F.lit(two)), by_encoding(lambda a, two, three, _: F.lit(three))
    usual = by_encoding(lambda a, two, three, changes: F.lit(changes))
    pairs, all_pairs = (squares - n) / 2, n * (n - 1) / 2
    z = F.least(F.lit(0.0), (pairs - all_pairs * two) / F.sqrt(all_pairs * (two + 2 * (n - 2) * three - (2 * n - 3) * two * two)))
    starts = F.size(F.regexp_extract_all(body, F.lit("[A-Z][a-z]"), F.lit(0)))
    share = F.least(F.lit(0.999), (runs - 1 - starts) / (n - 1))
    chernoff = F.when(share > usual, (n - 1) * (share * F.log(share / usual) + (1 - share) * F.log((1 - share) / (1 - usual)))).otherwise(0.0)
    both = z * z / 2 + math.log(2) + chernoff  # -ln of the product
    fisher = F.greatest(F.lit(0.0), (both - F.log(1 + both)) / math.log(10))
    return F.when(uneven | (z_runs > Z_CRITICAL) | (z_serial > Z_CRITICAL), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), fisher + F.log10(n / LENGTH)))


def _scanned(rows: DataFrame, text: Column) -> DataFrame:
    """Adds assign, access, hex (places) and candidates (place, score)."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    tested = F.transform(_places(text, CANDIDATE), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.substring(text, p["start"] + 1, p["end"] - p["start"]).alias("token")))
    tested = F.filter(tested, lambda c: F.length(F.regexp_replace(c["token"], "=+$", "")) >= 16)
    tested = F.transform(tested, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), _battery(c["token"]).alias("score")))
    none = F.array().cast("array<struct<start:int,end:int,score:double>>")
    return rows.select("*", _assign(text).alias("assign"), _places(text, ACCESS).alias("access"), _places(text, HEX).alias("hex"), F.when(text.rlike(CANDIDATE), tested).otherwise(none).alias("candidates"))


def discovery_bound(scanned: DataFrame, fdr: float = FDR) -> float:
    """The least score of a discovery: weighted Benjamini-Hochberg on binned scores (each taken at its bin's lower end)."""
    candidates = scanned.select(F.explode("candidates").alias("c"))
    size = F.col("c.end") - F.col("c.start")
    cell = F.greatest(F.lit(0), F.least(F.lit(N_BINS - 1), F.floor(F.col("c.score") / BIN))).cast("int")
    rows = candidates.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum(size).alias("length")).collect()  # N_BINS at most
    total = sum(r["n"] for r in rows)
    if not total:
        return math.inf
    shift = math.log10(sum(r["length"] for r in rows) / total / LENGTH)
    count, bound = {r["cell"]: r["n"] for r in rows}, math.inf
    above = 0
    for cell in range(N_BINS - 1, -1, -1):
        above += count.get(cell, 0)
        if above and 10 ** -(cell * BIN - shift) <= fdr * above / total:
            bound = cell * BIN
    return bound


def _all_spans(bound: float) -> tuple[Column, Column]:
    """(base, all) spans as arrays of (start, rank, end), in order."""
    kind = lambda name, rank: F.transform(name, lambda p: F.struct(p["start"].alias("start"), F.lit(rank).alias("rank"), p["end"].alias("end")))
    base = F.array_sort(F.concat(kind("assign", 0), kind("access", 1), kind("hex", 2)))
    found = F.filter("candidates", lambda c: c["score"] >= F.lit(bound))
    found = F.filter(found, lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return base, F.array_sort(F.concat(base, kind(found, 3)))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = checkpointed(_scanned(narrow, F.col("text")).drop("text"))
    base, spans = _all_spans(discovery_bound(scanned, fdr))
    rows = scanned.withColumn("base", base).withColumn("spans", spans)
    size = lambda name: F.size(name).cast("long")
    return rows.select(
        "doc_id",
        size("assign").alias("n_assign"),
        size("access").alias("n_access"),
        size("hex").alias("n_hex"),
        F.sha2(F.encode(_written(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
        (size("spans") - size("base")).alias("n_random"),
    )


def redact(docs: DataFrame, fdr: float = FDR, mark: str = "[SECRET]") -> DataFrame:
    """The documents with each span replaced by ``mark``; ``n_chars``, if there, follows the text."""
    scanned = _scanned(boxed(docs), F.col("row.text"))
    _, spans = _all_spans(discovery_bound(scanned.select("candidates"), fdr))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("row.text").cast("string")

    def add(acc: Column, s: Column) -> Column:
        before = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], before).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("spans", start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    rows = scanned.select("row", spans.alias("spans"))
    rows = rows.select("row", (F.size("spans") > 0).alias("changed"), F.when(F.size("spans") > 0, clean).otherwise(text).alias("text"))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("changed"), F.length("text")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    return rows.select(*[(new[f.name].cast(f.dataType) if f.name in new else F.col(f"row.`{f.name}`")).alias(f.name) for f in docs.schema])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
