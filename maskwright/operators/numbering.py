"""Consecutive numbers in a global order without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def numbered(df: DataFrame, *order: Column | str, column: str = "n") -> DataFrame:
    """``df`` with 1, 2, 3 ... in ``column``.

    Rows are dealt out by ranges of the order and staged with their partition; a partition's number
    starts after the rows of those before it. The driver sees one count for each partition.
    """
    held = staged(df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "numbered")
    counts = sorted((r["__p"], r["count"]) for r in held.groupBy("__p").count().collect())
    first, rows = 0, []
    for p, n in counts:
        rows.append((p, first))
        first += n
    starts = df.sparkSession.createDataFrame(rows, "__p int, __first long")
    within = Window.partitionBy("__p").orderBy(*order)
    out = held.join(F.broadcast(starts), "__p")  # a row for each partition
    return out.withColumn(column, F.col("__first") + F.row_number().over(within)).drop("__p", "__first")
