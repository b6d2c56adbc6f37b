"""Report marts: small tables out of the flat fact of clustered failures, which pages and cards then show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators import reports as P
from faultline.operators import stability as S

# Rows of the consolidated report, and how many entries its lists show.
TOOLS, GRAPH_TYPES, CPU_TYPES, LEFT_OUT = ("converter", "quantizer"), ("savecontext", "graph_prepare"), ("inference", "verifier"), "benchmark"
SHOWN, HOSTS = 10, 5


def report_row(kind: Column, runtime: Column) -> Column:
    """RP03: the row of the consolidated report that a failure belongs to; NULL for what it leaves out."""
    kind, runtime = F.lower(kind), F.lower(runtime)
    cpu = runtime == "cpu"
    return (
        F.when(kind.isin(*TOOLS), "Tools")
        .when(cpu & kind.isin(*GRAPH_TYPES), "Graph Prepare")
        .when(cpu & kind.isin(*CPU_TYPES), "cpu")
        .when(kind == LEFT_OUT, None)
        .when(cpu, "Core")
        .otherwise(runtime)
    )


def consolidated(df: DataFrame) -> DataFrame:
    """RP03: (report_row, label, failures, clusters, first_reason) of the rows a report counts. The label is the runtime
    under Tools, else the type."""
    rows = df.withColumn("report_row", report_row(F.col("type"), F.col("runtime"))).where("report_row is not null")
    rows = rows.withColumn("label", F.when(F.col("report_row") == "Tools", F.col("runtime")).otherwise(F.lower("type")))
    return rows.groupBy("report_row", "label").agg(F.count(F.lit(1)).alias("failures"), F.count_distinct("cluster_name").alias("clusters"), F.min_by("reason", "row_id").alias("first_reason"))


def type_matrix(df: DataFrame) -> DataFrame:
    """RP01: failures and clusters by type and runtime, with the most frequent cluster."""
    counts = df.groupBy("type", "runtime", "cluster_name").agg(F.count(F.lit(1)).alias("n"))
    top = F.min_by("cluster_name", F.struct((-F.col("n")).alias("n"), "cluster_name"))
    return counts.groupBy("type", "runtime").agg(F.sum("n").alias("failures"), F.count("cluster_name").alias("clusters"), top.alias("top_cluster"))


def detail(df: DataFrame, by: str) -> DataFrame:
    """RP02: a page's rows: each failure under its key (a type, SoC, runtime or model), numbered by cluster and row."""
    w = Window.partitionBy(by).orderBy("cluster_name", "row_id")
    return df.where(F.col(by).isNotNull()).select(F.col(by).alias("key"), F.row_number().over(w).alias("line"), "row_id", "tc_uuid", "cluster_name", "reason")


def segment_report(df: DataFrame) -> DataFrame:
    """RP04, AG23, AG27: each run under its segment, with failures, models, SoCs and runtimes."""
    return df.groupBy("bu", "run_id").agg(F.count(F.lit(1)).alias("failures"), F.count_distinct("model").alias("models"), F.count_distinct("soc").alias("socs"), F.count_distinct("runtime").alias("runtimes"))


def changes_page(changes: DataFrame) -> DataFrame:
    """RP04, AG19: changes (repository, url, message, pos) once by lower-cased address, first kept, under their
    repository."""
    first = P.unique_changes(changes, "url", "pos", "url")
    w = Window.partitionBy("repository").orderBy("pos", "url")
    return first.withColumn("line", F.row_number().over(w)).select("repository", "line", "url", "message")


def change_cell(changes: DataFrame, runtime: str) -> DataFrame:
    """RP08: the changes of a report row's cell: those of the runtime (of both tools for Tools), by repository, once by
    lower-cased message; changes without a message are left out."""
    own = changes.where(F.col("backend").isin("quantizer", "converter") if runtime.lower() == "tools" else F.col("backend") == runtime)
    named = own.withColumns({"repository": F.trim(F.coalesce("repository", F.lit(""))), "message": F.trim(F.coalesce("message", F.lit("")))}).where("message <> ''")
    w = Window.partitionBy(F.lower("repository"), F.lower("message")).orderBy("pos", "url")
    once = named.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return once.select("repository", "pos", "url", "message")


def top_lists(df: DataFrame, most: int = SHOWN) -> DataFrame:
    """The longest lists of a dashboard: the most frequent values of SoC (but the host), cluster and model, and
    all runtimes, types and classes: (dimension, key, n, rank)."""
    counts = P.metric_set(df).where(F.col("dimension").isin("soc", "cluster_name", "model", "runtime", "type", "cluster_class"))
    ranked = counts.where(~((F.col("dimension") == "soc") & (F.col("key") == "host"))).withColumn("rank", F.row_number().over(Window.partitionBy("dimension").orderBy(F.col("n").desc(), "key")))
    return ranked.where(~F.col("dimension").isin("soc", "cluster_name", "model") | (F.col("rank") <= most))


def dashboard(df: DataFrame) -> DataFrame:
    """RP05, RP06: the lists with shares of their dimension, heat bands and, for models, severities."""
    lists = top_lists(df)
    totals = P.metric_set(df).groupBy("dimension").agg(F.sum("n").alias("_all"), F.max("n").alias("_top"))
    ratio, band = F.col("n") / F.col("_top"), F.when(F.col("n") == 0, 0)
    for k, edge in enumerate(P.BANDS, 1):
        band = band.when(ratio < edge, k)
    out = lists.join(totals, "dimension").withColumns({"percent": F.round(100.0 * F.col("n") / F.col("_all"), 6), "band": band.otherwise(len(P.BANDS) + 1)})
    return out.withColumn("severity", F.when(F.col("dimension") == "model", P.severity(F.col("n")))).drop("_all", "_top")


def flagged_first(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """T05, RP07: rates by type with their place: flagged types first, then by rate, then by name."""
    stats = S.type_stats(df, threshold)
    return stats.withColumn("place", F.row_number().over(Window.orderBy(F.col("flagged").desc(), F.col("rate").desc(), "type")))


def host_cards(df: DataFrame, threshold: float = 0.5, most: int = HOSTS) -> DataFrame:
    """RP07, W09: under each flagged type and SoC the hosts with most failures: (type, soc, host, failed, passed, rank)."""
    flagged = S.type_stats(df, threshold).where("flagged").select("type")
    counts = df.join(flagged, "type", "left_semi").groupBy("type", "soc", "host").agg(F.count_if(F.col("result") == "FAIL").alias("failed"), F.count_if(F.col("result") == "PASS").alias("passed"))
    return S.first_rows(counts.where("failed > 0 or passed > 0"), ["type", "soc"], [F.col("failed").desc(), "host"], most)


def job_status(df: DataFrame | None) -> str:
    """whether a job's frame can be analysed: no_data, missing_columns or ok."""
    if df is None or df.isEmpty():
        return "no_data"
    return "ok" if {"type", "result"} <= set(df.columns) else "missing_columns"
