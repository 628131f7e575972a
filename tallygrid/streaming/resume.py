"""Incremental variants: resume, latest answers, and live loads, on file streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def completed_once(spark: SparkSession, path: str, schema: str, key: str, time: str, delay: str) -> DataFrame:
    """A log folder as a stream with each key once; state older than the delay is dropped."""
    return spark.readStream.schema(schema).json(path).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def live_load(events: DataFrame, item: str, time: str, delay: str, window: str) -> DataFrame:
    """Counts by item and time window of a stream, closed once the watermark has passed."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window), item).agg(F.count("*").alias("n"))


def upserted(stream: DataFrame, target: str, key: list[str], order: list[str], checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keyed overwrite: a batch's rows join what is stored, the last of each key stays; :func:`stored` reads it.

    Keys are dealt into ``buckets`` by hash, and a batch reads and rewrites only those that its rows fall into: they go to
    ``rows/version=N/bucket=B``, then a line for each says so in ``manifest/version=N``.  What a batch writes is named by its
    number and replaces what an interrupted run of it left, so a repeated batch has the same outcome.  Rows older than what is
    stored change nothing, ties in ``order`` go by the other columns, a null key is a key, an empty batch writes nothing.  The driver
    sees bucket numbers alone.  Old versions stay for readers until :func:`vacuumed`.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        dealt = _last(batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")), key, order).persist()
        try:
            touched = [r.bucket for r in dealt.select("bucket").distinct().collect()]
            if not touched:
                return
            before = {b: v for b, v in _versions(spark, target, number).items() if b in set(touched)}
            rows = dealt
            if before:
                rows = rows.unionByName(_read(spark, target, before, batch.schema))
            _last(rows, key, order).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/rows/version={number}")
            spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").json(f"{target}/manifest/version={number}")
        finally:
            dealt.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """What :func:`upserted` has stored: of each bucket its last version; no rows where nothing is stored yet."""
    versions = _versions(spark, target)
    return _read(spark, target, versions, schema).drop("bucket") if versions else spark.createDataFrame([], schema)


def vacuumed(spark: SparkSession, target: str) -> int:
    """Deletes the bucket folders that a later version has replaced, and says how many; for times without readers."""
    versions = _versions(spark, target)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/rows/version=*/bucket=*")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for status in fs.globStatus(path) or []:
        folder = status.getPath()
        bucket, version = (int(p.getName().split("=")[1]) for p in (folder, folder.getParent()))
        if versions.get(bucket, version) > version:
            gone += fs.delete(folder, True)
    return gone


def _last(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key and bucket, folded before it is shuffled, so that a hot key is one row of each task."""
    rest = [c for c in rows.columns if c not in order]
    last = F.max(F.struct(*order, *rest)).alias("_row")
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    return rows.groupBy(F.col("bucket").alias("_b"), *keys).agg(last).select(*[F.col("_row")[c].alias(c) for c in rows.columns])


def _versions(spark: SparkSession, target: str, below: int | None = None) -> dict[int, int]:
    """The last version of each bucket, before a batch if one is named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return {}
    lines = spark.read.schema("bucket int, version long").json(f"{target}/manifest")
    lines = lines.filter(F.col("version") < below) if below is not None else lines
    return {r.bucket: r.version for r in lines.groupBy("bucket").agg(F.max("version").alias("version")).collect()}


def _read(spark: SparkSession, target: str, versions: dict[int, int], schema: T.StructType) -> DataFrame:
    """The named versions of buckets, by their folders alone."""
    paths = [f"{target}/rows/version={v}/bucket={b}" for b, v in sorted(versions.items())]
    full = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(full).option("basePath", f"{target}/rows").parquet(*paths).select(*full.names)


def drained(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that is there now, batch by batch, then stop."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
