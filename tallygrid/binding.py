"""Which columns of a table play the parts of a distribution study."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Binding:
    """Column names (or SQL expressions) of source, item and class, and of the item's stratum and cluster."""

    source: str
    item: str
    klass: str
    stratum: str | None = None
    cluster: str | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        """Only the bound columns, by part; the scan reads nothing else."""
        parts: list[Column] = []
        for name in ("source", "item", "klass", "stratum", "cluster"):
            if (expression := getattr(self, name)) is not None:
                parts.append(F.expr(expression).alias(name))
        return df.select(*parts)
