"""Quality rules with cross-document line frequency.

Lines are normalised (A-Z in lower case, digits as 0, words joined by single
spaces) and hashed.  For each host the number of distinct documents with a
line is counted; a line above ``max(MIN_DOCUMENTS, SHARE of the host's
documents)`` is boilerplate of that host and removed.  A document is rejected
if it fails the base rules, or if it is depleted: boilerplate was removed and
fewer than ``LEAST_WORDS`` words or less than ``LEAST_LEFT`` of them remain.

Copies of one document are not boilerplate, so they count once: a document
counts for a line by a 64-bit fingerprint of its whole normalised text (all its
lines in order), which copies share and other documents do not.

The text is read once; what goes on is a row of numbers a document and a hash
for each distinct line.  The count is aggregated before and after the shuffle;
the join of lines with the boilerplate is on (host, line), which adaptive
execution splits where a line is hot, or broadcasts where the boilerplate's
measured size allows.

Defined results: null and empty texts have no words, so fail the base rules; a
null source is a host of its own; repeated rows get a row each and count once;
a null ``doc_id`` is carried; a line in exactly the limit's number of documents
stays; a very long text is measured whole; an empty table gives no rows; other
columns are ignored by :func:`judge` and kept, whatever their names, by
:func:`apply`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _STEP, checkpointed, flat, fresh, lowered, mixed, slices, table, window_hashes, word_hashes, words

MIN_DOCUMENTS = 20
SHARE = 0.002
LEAST_WORDS = 10
LEAST_LEFT = 0.2
WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#*$%&|<>"]] = True
_DIGITS = np.arange(256, dtype=np.uint8)
_DIGITS[48:58] = 48

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id {}, host string, " + ", ".join(f"{c} long" for c in COUNTS) + ", print long, lines array<struct<line: long, words: int>>"


def _per_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(mask)))[at])


def lines_of(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each line with a word: text, hash as it stands, hash when normalised, number of words, start, end."""
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    cuts = np.union1d(np.flatnonzero(data == 10) + 1, offsets)
    cell = np.searchsorted(cuts, starts, "right")
    head = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    n_words = np.diff(np.append(head, len(cell)))
    begin, end = cuts[cell[head] - 1], cuts[cell[head]]
    end = end - (data[end - 1] == 10)
    place = np.arange(len(cell)) - np.repeat(head, n_words)
    h = word_hashes(_DIGITS[lowered(data)], starts, lengths)
    normal = mixed(np.add.reduceat(mixed(h + place.astype(np.uint64) * _STEP), head))
    return np.searchsorted(first, head, "right") - 1, word_hashes(data, begin, end - begin), normal, n_words, begin, end


def _measure(part: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = flat(part.column("text"))
    n = len(offsets) - 1
    starts, lengths, first = words(data, offsets)
    n_words = np.diff(first)
    solid = np.zeros(len(data) + 1, np.int64)
    np.add.at(solid, starts, 1)
    np.add.at(solid, starts + lengths, -1)
    in_word = np.cumsum(solid[:-1]) > 0
    word_chars = _per_text(in_word & ((data & 0xC0) != 0x80), offsets)
    symbols = _per_text(_SYMBOL[data], offsets)

    w, at = window_hashes(word_hashes(data, starts, lengths), first, WINDOW)
    owner = np.searchsorted(first, at, "right") - 1
    order = np.lexsort((w, owner))
    same = (w[order][1:] == w[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    repeated = _per_text(np.cumsum(cover[:-1]) > 0, first)

    text, raw, normal, line_words, _, _ = lines_of(data, offsets, starts, lengths, first)
    order = np.lexsort((raw, text))
    again = (raw[order][1:] == raw[order][:-1]) & (text[order][1:] == text[order][:-1])
    dup_lines = np.bincount(text[order][1:][again], minlength=n) if len(text) else np.zeros(n, np.int64)

    order = np.lexsort((normal, text))
    a, b = normal[order], text[order]
    head = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
    hashes, owner = a[head].view(np.int64), b[head]
    total = np.add.reduceat(line_words[order], head) if len(head) else np.zeros(0, np.int64)
    counts = np.bincount(owner, minlength=n)
    begin = np.cumsum(counts) - counts
    # The fingerprint: the text's normalised lines, each mixed with its place, added up.
    per_text = np.bincount(text, minlength=n)
    place = np.arange(len(normal)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    whole = np.zeros(n, np.uint64)
    np.add.at(whole, text, mixed(normal + (place.astype(np.uint64) + np.uint64(1)) * _STEP))
    whole = mixed(whole)

    items = pa.StructArray.from_arrays([pa.array(hashes), pa.array(total.astype(np.int32))], ["line", "words"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), items)
    numbers = [pa.array(np.asarray(c, np.int64)) for c in (n_words, word_chars, symbols, dup_lines, repeated)]
    return pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), *numbers, pa.array(whole.view(np.int64)), lists], ["doc_id", "host", *COUNTS, "print", "lines"])


def measured(docs: DataFrame, host: str = "source", id_type: str = "long") -> DataFrame:
    """doc_id, host, COUNTS, the fingerprint and the distinct normalised lines of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield _measure(part)

    narrow = docs.select(F.col("doc_id").cast(id_type).alias("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, SCHEMA.format(id_type))


def boilerplate(rows: DataFrame, min_documents: int = MIN_DOCUMENTS, share: float = SHARE) -> DataFrame:
    """host, line, n_docs of the lines above the host's limit."""
    # One row a distinct text, so its distinct lines count by rows, which are added up before the shuffle.
    texts = rows.groupBy("host", "print").agg(F.first("lines").alias("lines"))
    lines = texts.select("host", F.explode("lines.line").alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > min_documents)
    hosts = rows.groupBy("host").agg(F.count("*").alias("host_docs"))
    return counts.join(hosts, "host").filter(F.col("n_docs") > share * F.col("host_docs")).select("host", "line", "n_docs")


def judge(docs: DataFrame, host: str = "source", min_documents: int = MIN_DOCUMENTS, share: float = SHARE, id_type: str = "long") -> DataFrame:
    """One row a document: COUNTS, base_failed, removed_words, removed_lines (hashes) and kept."""
    rows = checkpointed(measured(docs, host, id_type)).withColumn("_row", F.monotonically_increasing_id())  # stable on checkpointed rows
    bad = boilerplate(rows, min_documents, share)
    lines = rows.select("_row", "host", F.explode("lines").alias("l")).select("_row", "host", "l.line", "l.words")
    removed = lines.join(bad, ["host", "line"]).groupBy("_row").agg(F.sum("words").cast("long").alias("removed_words"), F.collect_list("line").alias("removed_lines"))
    out = rows.drop("lines", "print").join(removed, "_row", "left")
    gone = F.coalesce("removed_words", F.lit(0).cast("long"))
    left = F.col("n_words") - gone
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (gone > 0) & ((left < LEAST_WORDS) | (left < LEAST_LEFT * F.col("n_words")))
    return out.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), gone.alias("removed_words"), "removed_lines")


def apply(docs: DataFrame, host: str = "source", min_documents: int = MIN_DOCUMENTS, share: float = SHARE) -> DataFrame:
    """The documents that are kept, without their boilerplate lines; ``n_chars``, if there, follows the text."""
    text, name = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col(f"`{host}`").cast("string"), F.lit(""))
    own, kept, gone = fresh(docs, "own", "kept", "gone")
    # The verdict depends on text and host alone, so it is joined by a 128-bit digest of both; only documents that change or go have a row.
    digest = F.coalesce(F.md5(F.encode(F.concat(name, F.lit("\0"), text), "UTF-8")), F.lit(""))  # never null, so that both branches read it alike
    verdicts = judge(docs.select(digest.alias("doc_id"), text.alias("text"), name.alias("host")), "host", min_documents, share, "string").filter("not kept or removed_words > 0")
    verdicts = verdicts.groupBy(F.col("doc_id").alias(own)).agg(F.min("kept").alias(kept), F.min("removed_lines").alias(gone))
    # Both branches below take the same columns, so that they share one exchange.
    columns = [f"`{c}`" for c in docs.columns]
    joined = docs.withColumn(own, digest).join(verdicts, own, "left").filter(F.coalesce(kept, F.lit(True))).select(*columns, gone)
    same = joined.filter(F.col(gone).isNull()).select(*columns)
    at = docs.columns.index("text")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without_lines(t, set(g)) for t, g in zip(batch.column(at).to_pylist(), batch.column(gone).to_pylist(), strict=True)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type)).select(docs_columns)

    docs_columns = docs.columns
    changed = joined.filter(F.col(gone).isNotNull()).mapInArrow(strip, docs.schema)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return same.unionByName(changed)


def without_lines(text: str, gone: set[int]) -> str:
    """The text without the lines whose normalised hash is in ``gone``."""
    data, offsets = flat(pa.array([text], pa.string()))
    *_, normal, _, begin, end = lines_of(data, offsets, *words(data, offsets))
    raw, out, at = data.tobytes(), [], 0
    for h, b, e in zip(normal.view(np.int64).tolist(), begin.tolist(), end.tolist(), strict=True):
        if h in gone:
            out.append(raw[at:b])
            at = e + 1  # with the line's end
    out.append(raw[at:])
    return b"".join(out).decode()


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept", "removed_words")
