"""Failure rates by type, and the capped lists that a stability report shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def type_stats(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """AG01, AG02: counts by type; rows without a type don't count; unlisted results stay in the total."""
    r = F.upper(F.trim(F.col("result")))
    out = df.where(F.col("type").isNotNull()).groupBy("type").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(r == "PASS").alias("passed"),
        F.count_if(r == "FAIL").alias("failed"),
        F.count_if(r == "PARENT_FAIL").alias("parent_failed"),
        F.count_if(r == "NOT_RUN").alias("not_run"),
    )
    effective = F.col("total") - F.col("parent_failed") - F.col("not_run")
    out = out.withColumn("effective", effective).withColumn("rate", F.when(F.col("effective") > 0, F.col("failed") / F.col("effective")).otherwise(0.0))
    return out.withColumn("flagged", F.col("rate") >= threshold)


def run_stats(stats: DataFrame) -> DataFrame:
    """AG05: totals over types, the overall rate, and which types are flagged."""
    out = stats.agg(F.sum("total").alias("total"), F.sum("failed").alias("failed"), F.sum("effective").alias("effective"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("flagged"), F.col("type")))), ",").alias("flagged_types"))
    return out.withColumn("rate", F.when(F.col("effective") > 0, F.col("failed") / F.col("effective")).otherwise(0.0))


def by_device(df: DataFrame) -> DataFrame:
    """AG04: failures and passes by SoC and host, where there is either."""
    return df.groupBy("soc", "host").agg(F.count_if(F.col("result") == "FAIL").alias("failed"), F.count_if(F.col("result") == "PASS").alias("passed")).where("failed > 0 or passed > 0")


def first_rows(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group in a total order. Rank filters of this form are applied before the
    shuffle too (a top-k per task), so a hot group doesn't travel whole."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
