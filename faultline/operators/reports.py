"""Marts of the clustered failures: counts by dimension, matrices with totals, severities, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What a matrix shows, the bands of a heat map, the severities of a model.
RUNTIMES = ("cpu", "gpu", "gpu_fp16", "dsp", "dsp_fp16", "npu", "npu_x86", "hta")
BANDS = (0.10, 0.25, 0.50, 0.75)
CRITICAL, HIGH = 200, 50


def by_dimension(df: DataFrame, column: str) -> DataFrame:
    """AG09."""
    return df.where(F.col(column).isNotNull()).groupBy(F.lower(column).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def overview(df: DataFrame) -> DataFrame:
    """AG10: totals of a consolidated report; a model counts once for each run."""
    return df.agg(F.count(F.lit(1)).alias("failures"), F.count_distinct("run_id", "model").alias("models"), F.count_distinct("run_id").alias("runs"), F.count_distinct("bu").alias("bus"), F.count_distinct("cluster_name").alias("clusters"))


def matrix(df: DataFrame) -> DataFrame:
    """AG11: segment by runtime."""
    return df.groupBy("bu").agg(*[F.count_if(F.col("runtime") == r).alias(r) for r in RUNTIMES])


def matrix_totals(df: DataFrame) -> DataFrame:
    """AG12: with row, column and grand totals, in one aggregation."""
    return df.where(F.col("runtime").isin(*RUNTIMES)).cube("bu", "runtime").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("bu", F.lit("ALL")).alias("bu"), F.coalesce("runtime", F.lit("ALL")).alias("runtime"), "n")


def metric_set(df: DataFrame) -> DataFrame:
    """AG13: counts by each of eight dimensions, by grouping sets over one scan."""
    dims = ("soc", "runtime", "type", "cluster_class", "cluster_name", "model", "bu", "host")
    exploded = df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key")) for d in dims])).alias("x")).select("x.*")
    return exploded.where("key is not null").groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("n"))


def shares(counts: DataFrame, column: str = "n") -> DataFrame:
    """AG29: percent of the total, which is one row and broadcast."""
    total = counts.agg(F.sum(column).alias("_total"))
    return counts.join(F.broadcast(total)).withColumn("percent", F.when(F.col("_total") > 0, F.round(100.0 * F.col(column) / F.col("_total"), 6)).otherwise(0.0)).drop("_total")


def heat(counts: DataFrame, column: str = "n") -> DataFrame:
    """The ratio to the largest, in six bands; the largest is one row and broadcast."""
    top = counts.agg(F.max(column).alias("_top"))
    ratio = F.col(column) / F.col("_top")
    band = F.when(F.col(column) == 0, 0)
    for k, edge in enumerate(BANDS, 1):
        band = band.when(ratio < edge, k)
    return counts.join(F.broadcast(top)).withColumn("band", band.otherwise(len(BANDS) + 1)).drop("_top")


def severity(n: Column) -> Column:
    """W17."""
    return F.when(n > CRITICAL, "Critical").when(n > HIGH, "High").otherwise("Medium")


def stops(counts: DataFrame, column: str, *order) -> DataFrame:
    """Cumulative percents of a short list (a donut's slices: one row per category)."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return counts.withColumn("stop", F.round(100.0 * F.sum(column).over(w) / F.sum(column).over(total), 6))


def unique_changes(changes: DataFrame, url: str, *order: str) -> DataFrame:
    """AG19: the first change of each lower-cased address."""
    w = Window.partitionBy(F.lower(F.col(url))).orderBy(*order)
    return changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def chunks(df: DataFrame, keys: list[str], order: list, size: int, overlap: int = 0) -> DataFrame:
    """Rows of each group in chunks of `size`, each starting `size - overlap` rows after the one before. A row
    goes to every chunk that holds it; the last chunk of a group may be short."""
    step = size - overlap
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.col("_n")
    last = F.floor((n - 1) / step)
    first = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)))
    return df.withColumn("_n", F.row_number().over(w)).withColumn("chunk", F.explode(F.sequence(first.cast("int"), last.cast("int")))).drop("_n")


def minmax(df: DataFrame, key: str, value: str, flat: float) -> DataFrame:
    """Values scaled to 0..1 in their group; `flat` where the group's range is none."""
    w = Window.partitionBy(key)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumns({"_lo": lo, "_hi": hi}).withColumn("score", F.when(F.col("_hi") - F.col("_lo") < 1e-9, flat).otherwise((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")
