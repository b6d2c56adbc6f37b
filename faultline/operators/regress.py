"""Filters and joins on test results: regressions between runs, previous runs, and the sets around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import runs as R

# Fixed values.
NOT_FAILED = ("PASS", "NOT_RUN", "PARENT_NOT_RUN", "PARENT_FAIL")
EXCLUDED_TYPES = ("bm_regression", "bm_verifier")


def failures(df: DataFrame) -> DataFrame:
    """rows that count as failed; an unknown result does."""
    return df.where(~F.col("result").isin(*NOT_FAILED) | F.col("result").isNull())


def split_by(df: DataFrame, column: str, phrase: str) -> tuple[DataFrame, DataFrame]:
    """rows whose text has the phrase, and the others (NULL among them)."""
    has = F.coalesce(F.lower(F.col(column)).contains(phrase), F.lit(False))
    return df.where(has), df.where(~has)


def without_types(df: DataFrame, types: tuple[str, ...] = EXCLUDED_TYPES) -> DataFrame:
    """F08."""
    return df.where(~F.lower(F.col("type")).isin(*types))


def report_rows(df: DataFrame) -> DataFrame:
    """rows that reports count."""
    return without_types(df).where((F.col("cluster_name") != "") & (F.col("reason") != "") & (F.col("cluster_class") == "sdk_issue"))


def not_containing(df: DataFrame, column: str, phrase: str) -> DataFrame:
    """case-insensitive; NULL stays."""
    return df.where(~F.coalesce(F.lower(F.col(column)).contains(phrase.lower()), F.lit(False)))


def regressions(new: DataFrame, old: DataFrame, key: str = "tc_uuid") -> DataFrame:
    """Failed in the new run, passed in the old one. Both filters reach the scans; duplicates multiply."""
    before = old.where(F.col("result") == "PASS").select(key, F.col("row_id").alias("old_row_id"), F.col("run_id").alias("old_run_id"))
    return new.where(F.col("result") == "FAIL").join(before, key)


def with_previous_failure(new: DataFrame, old: DataFrame, key: str = "tc_uuid") -> DataFrame:
    """Marks rows whose test was not PASS in the previous run."""
    marks = failures(old).select(key).distinct().withColumn("_mark", F.lit(True))
    return new.join(marks, key, "left").withColumn("failed_before", F.col("_mark").isNotNull()).drop("_mark")


def pending(jobs: DataFrame, ledger: DataFrame, key: str = "run_id") -> DataFrame:
    """Rows that the ledger doesn't have."""
    return jobs.join(ledger.select(key).distinct(), key, "left_anti")


def requeue(ledger: DataFrame, failed: DataFrame, key: str, order: str, most: int = 500, trim: int = 100) -> DataFrame:
    """The ledger without failed runs, and without its first `trim` entries once it has more than `most`. The
    place in order needs no global sort: it is the count of earlier ones, taken by ranges."""
    left = ledger.join(failed.select(key).distinct(), key, "left_anti")
    if left.count() <= most:
        return left
    first = left.orderBy(order, key).limit(trim).select(key)
    return left.join(F.broadcast(first), key, "left_anti")


def completion(df: DataFrame, *keys: str) -> DataFrame:
    """AG03: whole percent of completed rows."""
    done = F.count_if(F.col("exec_status") == "COMPLETED")
    return df.groupBy(*keys).agg(F.when(F.count(F.lit(1)) > 0, F.floor(100 * done / F.count(F.lit(1)))).otherwise(0).cast("int").alias("completion"))


def run_table(df: DataFrame) -> DataFrame:
    """Distinct runs with their parsed parts and embedded time."""
    runs = df.select("run_id").distinct()
    return runs.withColumn("p", R.parse(F.col("run_id"))).select("run_id", "p.*", R.embedded_time(F.col("run_id")).alias("run_ts"))


def previous_runs(runs: DataFrame) -> DataFrame:
    """For each run the greatest smaller id with the same prefix and suffix: of the same version, else of any.

    Per (prefix, suffix) and version the previous id is a window's lag; no pair of runs is formed.
    """
    same = Window.partitionBy("prefix", "suffix_base", "version").orderBy("run_id")
    other = Window.partitionBy("prefix", "suffix_base").orderBy("run_id")
    return runs.select("run_id", F.coalesce(F.lag("run_id").over(same), F.lag("run_id").over(other)).alias("previous_run_id"))


def valid_previous_runs(runs: DataFrame, percents: DataFrame, least: int = 90) -> DataFrame:
    """The latest earlier run of the prefix and suffix whose completion is at least `least` percent."""
    w = Window.partitionBy("prefix", "suffix_base").orderBy("run_id").rowsBetween(Window.unboundedPreceding, -1)
    good = F.when(F.col("completion") >= least, F.col("run_id"))
    return runs.join(percents, "run_id", "left").select("run_id", F.last(good, ignorenulls=True).over(w).alias("previous_run_id"))


def previous_releases(runs: DataFrame) -> DataFrame:
    """The run of the highest lower (major, minor) with the same prefix; of these the highest RC, then id."""
    best = runs.groupBy("prefix", "major", "minor").agg(F.max(F.struct("rc", "run_id")).alias("b"))
    ordered = Window.partitionBy("prefix").orderBy("major", "minor")
    releases = best.select("prefix", "major", "minor", F.lag("b.run_id").over(ordered).alias("previous_release"))
    return runs.join(releases, ["prefix", "major", "minor"], "left").select("run_id", "previous_release")


def valid_previous_releases(runs: DataFrame, percents: DataFrame, least: int = 90) -> DataFrame:
    """As previous_releases(), of runs whose completion is at least `least` percent only."""
    good = runs.join(percents, "run_id").where(F.col("completion") >= least)
    best = good.groupBy("prefix", "major", "minor").agg(F.max(F.struct("rc", "run_id")).alias("b"))
    releases = runs.select("prefix", "major", "minor").distinct().join(best, ["prefix", "major", "minor"], "left")
    w = Window.partitionBy("prefix").orderBy("major", "minor").rowsBetween(Window.unboundedPreceding, -1)
    before = releases.select("prefix", "major", "minor", F.last("b.run_id", ignorenulls=True).over(w).alias("previous_release"))
    return runs.join(before, ["prefix", "major", "minor"], "left").select("run_id", "previous_release")


def highest_rc(runs: DataFrame) -> DataFrame:
    """W12."""
    return runs.groupBy("prefix", "version").agg(F.max_by("run_id", F.struct("rc", "run_id")).alias("run_id"))


def changes_between(changes: DataFrame, lo: Column, hi: Column, stamp: str) -> DataFrame:
    """Changes in (lo, hi], whichever end is named first."""
    return changes.where((F.col(stamp) > F.least(lo, hi)) & (F.col(stamp) <= F.greatest(lo, hi)))


def type_changes(df: DataFrame, changes: DataFrame) -> DataFrame:
    """The changes of each type's backends: those of its runtimes, or of itself for the tools; a backend without a
    change stays, with none."""
    low = F.lower("type")
    backends = df.select(low.alias("type"), F.when(low.isin("converter", "quantizer"), low).otherwise(F.col("runtime")).alias("backend")).distinct()
    return backends.join(changes, "backend", "left")


def first_seen(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
