"""Control-number series: order, gaps, runs, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gaps(stamps: DataFrame) -> DataFrame:
    """(series, lo, hi, n): ranges of missing values between consecutive values of ``stamps(series, value)``."""
    order = Window.partitionBy("series").orderBy("value")
    after = stamps.select("series", "value").distinct().withColumn("next", F.lead("value").over(order))
    return after.where("next > value + 1").select("series", (F.col("value") + 1).alias("lo"), (F.col("next") - 1).alias("hi"), (F.col("next") - F.col("value") - 1).alias("n"))


def coverage(stamps: DataFrame) -> DataFrame:
    """(series, first, last, n_values, n_missing, coverage)."""
    out = stamps.groupBy("series").agg(F.min("value").alias("first"), F.max("value").alias("last"), F.count_distinct("value").alias("n_values"))
    span = F.col("last") - F.col("first") + 1
    return out.withColumn("n_missing", span - F.col("n_values")).withColumn("coverage", F.col("n_values") / span)


def monotone_runs(stamps: DataFrame) -> DataFrame:
    """(series, run, first_page, n_pages, lo, hi) of ``stamps(series, page, value)``: a new run at every backward step."""
    order = Window.partitionBy("series").orderBy("page")
    back = (F.col("value") < F.lag("value").over(order)).cast("int")
    runs = stamps.withColumn("back", F.coalesce(back, F.lit(0))).withColumn("run", F.sum("back").over(order))
    return runs.groupBy("series", "run").agg(F.min("page").alias("first_page"), F.count("*").alias("n_pages"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def parsed(stamps: DataFrame, column: str = "stamp") -> DataFrame:
    """prefix, digits and value of stamps such as ABC-000123, with digits that recognition read as letters mended."""
    tail = F.translate(F.regexp_extract(column, r"([0-9OoIlSB]{4,10})$", 1), "OoIlSB", "001158")
    return stamps.withColumns({"prefix": F.regexp_extract(column, r"^(.*?)[-_ ]?[0-9OoIlSB]{4,10}$", 1), "digits": tail, "value": F.nullif(tail, F.lit("")).cast("bigint")})
