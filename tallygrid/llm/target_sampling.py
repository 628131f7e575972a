"""Importance resampling of documents towards a target distribution, scored without exploding.

A document is an array of hash buckets: its words, and runs of up to ``n`` of
them, through CRC-32.  Higher-order functions make that array and sum a literal
array of gains over it, so a document is scored where it is read; what the
corpus counts in each bucket is all that is shuffled for the scores, a row for
each bucket and task at most.  A bucket's gain is the floored log ratio of its
smoothed shares in the target and in the corpus, in thousandths.  A Gumbel
variate made of the ``doc_id`` is added, so the highest scores are a draw
without replacement with chances in proportion to the likelihood ratio.

The draw is a rank in one order of the whole corpus: narrow rows are dealt into
range partitions, whose few totals are summed up, as in the byte shards.

Defined results: null and empty texts have no features and weight 0; a null
``doc_id`` is hashed as an empty string and comes after all others of its
score; rows with one ``doc_id`` are separate documents, and equal rows take
neighbouring ranks in either order; ties of score go to the smaller
``doc_id``; very long texts are scored whole, in one array; an empty corpus
gives no rows, an empty target gains by smoothing alone; other columns are
ignored by :func:`scored` and kept, whatever their names, by :func:`resample`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import boxed, checkpointed, table

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LAST = (1 << 63) - 1


def words(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, A-Z in lower case; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _UPPER.lower()), F.lit(_WORD), F.lit(0))


def buckets(words: Column, n: int = 1, size: int = BUCKETS) -> Column:
    """The bucket of each run of 1 to n words, repeats included."""
    runs = words
    if n > 1:
        run = lambda k: F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
        runs = F.flatten(F.array(words, *[F.when(F.size(words) >= k, run(F.lit(k))).otherwise(F.array().cast("array<string>")) for k in range(2, n + 1)]))
    return F.transform(runs, lambda w: (F.crc32(F.encode(w, "UTF-8")) % size).cast("int"))


def counted(texts: DataFrame, n: int, size: int) -> DataFrame:
    """(bucket, count) over all texts; tasks add up before anything is sent.

    An inner explode would be given a filter on the array's size, which makes the words anew for each run.
    """
    found = texts.select(words(F.col("text")).alias("words")).select(F.explode_outer(buckets(F.col("words"), n, size)).alias("bucket"))
    return found.filter("bucket is not null").groupBy("bucket").count()


def gains(docs: DataFrame, target: DataFrame, n: int = 1, size: int = BUCKETS) -> list[int]:
    """A bucket's gain in thousandths, for each of the ``size`` buckets; all that the driver ever gets."""
    s, t = counted(docs, n, size).withColumnRenamed("count", "s"), counted(target, n, size).withColumnRenamed("count", "t")
    both = docs.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    rows = both.collect()
    s_all, t_all = (float(sum(r[c] for r in rows) + size) for c in ("s", "t"))
    log = F.log((F.col("t") + 1).cast("double") * s_all / ((F.col("s") + 1).cast("double") * t_all))
    counts = docs.sparkSession.createDataFrame(rows, "bucket int, s long, t long")
    return [r.gain for r in counts.select("bucket", F.floor(1000 * log).alias("gain")).orderBy("bucket").collect()]


def _scored(rows: DataFrame, gain: list[int], n: int, seed: int, min_words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds id, n_features, weight, score, eligible and key (the order after score and id) to a table of documents.

    Words and buckets are columns of their own, so that they are made once and not anew for each use.
    """
    own, array = F.col("id"), F.lit(np.array(gain, np.int64))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(own.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = rows.withColumns({"id": F.col(doc_id).cast("long"), "key": F.xxhash64(F.col(text).cast("string")), "words": words(F.col(text))})
    rows = rows.withColumns({"runs": buckets(F.col("words"), n, len(gain)), "eligible": F.size("words") >= min_words}).drop("words")
    rows = rows.withColumns({"n_features": F.size("runs").cast("long"), "weight": F.aggregate("runs", F.lit(0).cast("long"), lambda total, b: total + F.element_at(array, b + 1))})
    return rows.withColumn("score", F.col("weight") + gumbel).drop("runs")


def _narrow(docs: DataFrame, gain: list[int], n: int, seed: int, min_words: int) -> DataFrame:
    return _scored(docs.select("doc_id", "text"), gain, n, seed, min_words).drop("doc_id", "text")


def _ranked(rows: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """Narrow scored rows with their rank in the order of the draw, and how many are drawn."""
    order = [F.col("eligible").desc(), F.col("score").desc(), F.coalesce("id", F.lit(_LAST)), F.col("key"), F.col("row")]
    # Range bounds come from a sample, so what is dealt is fixed before it is counted and numbered.
    fixed = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    drawn = fixed.filter("eligible").count() * percent // 100
    dealt = checkpointed(fixed.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    ranked = dealt.join(totals, "part").withColumn("place", place)
    return ranked.withColumn("rank", F.when(F.col("eligible") & (F.col("place") <= drawn), F.col("place"))), drawn


def scored(docs: DataFrame, target: DataFrame, n: int = 1, size: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document.

    ``percent`` of the documents with ``min_words`` words are drawn and ranked from 1; the others' rank is null.
    """
    ranked, _ = _ranked(_narrow(docs, gains(docs, target, n, size), n, seed, min_words), percent)
    return ranked.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, size: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """The drawn documents with all their columns.

    The last drawn row's score, id and digest are a threshold, so no text is shuffled; rows that repeat that last row as it is stay with it.
    """
    gain = gains(docs, target, n, size)
    ranked, drawn = _ranked(_narrow(docs, gain, n, seed, min_words), percent)
    last = ranked.filter(F.col("rank") == drawn).select("score", F.coalesce("id", F.lit(_LAST)).alias("id"), "key").first()
    if last is None:
        return docs.limit(0)
    # A filter isn't pushed below a partition's number, and so doesn't make the words anew for each run.
    own = _scored(boxed(docs), gain, n, seed, min_words, "row.doc_id", "row.text").withColumn("part", F.spark_partition_id())
    score, after, key = F.col("score") - last.score, F.coalesce("id", F.lit(_LAST)), F.col("key")
    reached = (score > 0) | (score == 0) & ((after < last.id) | (after == last.id) & (key <= last.key))
    return own.filter(F.col("eligible") & reached).select("row.*")


def op11_target_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
