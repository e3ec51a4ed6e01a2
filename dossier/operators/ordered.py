"""Ranks and running sums over a whole table in an order, without bringing it into one task.

Rows are dealt by ranges of the order and sorted there; what the ranges before a row hold is added from one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.operators.lineage import written


def running(df: DataFrame, order: list[Column], value: Column | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with ``_rank`` (from 1) and ``_total`` (sum of ``value`` up to the row, itself included) in ``order``.

    The dealt rows are written, since ranges are drawn from a sample and must not be drawn anew.
    """
    value = F.lit(0) if value is None else value
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.withColumn("_value", value).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("_value").alias("_s"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    inner = Window.partitionBy("_part").orderBy(*order)
    own = dealt.join(F.broadcast(sums), "_part").withColumns({"_rank": F.col("_n0") + F.row_number().over(inner), "_total": F.col("_s0") + F.sum("_value").over(inner.rowsBetween(Window.unboundedPreceding, 0))})
    return own.drop("_part", "_n0", "_s0", "_value")
