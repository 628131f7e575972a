"""Cutting the lineage of a table that several passes read, and spreading few rows with much work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fixed(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the folder of ``spark.checkpoint.dir``, or in one of the warehouse where none is set."""
    context, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return df.checkpoint()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by the keys into as many tasks as a shuffle has: adaptive execution would merge rows that are few, however long each takes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
