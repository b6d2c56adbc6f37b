"""Registered queries over the synthetic tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import runs as R
from faultline.functions import text as T
from faultline.functions import vectors as V
from faultline.operators import cluster as C
from faultline.operators import models as M
from faultline.operators import regress as G
from faultline.operators import reports as P
from faultline.operators import stability as S
from faultline.operators import state as U
from faultline.plans import cascade as A
from faultline.sources.shared import cut
from faultline.sources.views import RESULTS_SQL, results, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
WITH = f"WITH {RESULTS_SQL}"


def register(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def on_results(name: str, sql: str | None = None):
    """A query over the results view; its SQL follows the view's definition."""

    def put(f: Callable[[DataFrame], DataFrame]):
        register(name, f"{WITH} {sql}" if sql else None)(lambda spark, sf: f(results(spark, sf)))
        return f

    return put


def _run(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("run_no") == n)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- scans -------------------------------------------------------------------------------------------------------

on_results("src02_run_ids", "SELECT DISTINCT run_id FROM results WHERE run_id NOT LIKE '%win%'")(lambda d: d.where(~F.col("run_id").contains("win")).select("run_id").distinct())
on_results("src03_run_rows", "SELECT row_id, tc_uuid, result FROM results WHERE run_no = 5")(lambda d: _run(d, 5).select("row_id", "tc_uuid", "result"))
on_results("src07_load_failures", "SELECT row_id, result FROM results WHERE result NOT IN ('PASS','NOT_RUN','PARENT_NOT_RUN','PARENT_FAIL') OR result IS NULL")(lambda d: G.failures(d).select("row_id", "result"))
on_results("src09_all_runs", "SELECT DISTINCT run_id FROM results")(lambda d: d.select("run_id").distinct())


@register("src04_month_shards",
    "SELECT strftime(ts, '%Y_%m') AS shard, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-20' "
    "GROUP BY 1"
)
def _(spark, sf):
    return table(spark, sf, "events").where("ts >= TIMESTAMP_NTZ '2024-01-01' AND ts < TIMESTAMP_NTZ '2024-01-20'").groupBy(F.date_format("ts", "yyyy_MM").alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@register("src12_change_map",
    "SELECT event_id, key, cast(json_extract_string(props, '$.' || key) AS bigint) AS value FROM (SELECT event_id, props, "
    "unnest(json_keys(props)) AS key FROM events)"
)
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "value"))


@register("src15_log_tail",
    "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), greatest(len(string_split(text, chr(10))) - 2, 1), "
    "len(string_split(text, chr(10)))), chr(10)) AS tail FROM documents WHERE text IS NOT NULL"
)
def _(spark, sf):
    lines = F.split("text", "\n")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.array_join(F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), F.lit(3)), "\n").alias("tail"))


on_results("src19_types", "SELECT DISTINCT type FROM results")(lambda d: d.select("type").distinct())

# --- filters -----------------------------------------------------------------------------------------------------

on_results("f01_failures",
    "SELECT type, count(*) AS n FROM results WHERE result NOT IN ('PASS','NOT_RUN','PARENT_NOT_RUN','PARENT_FAIL') OR result IS NULL "
    "GROUP BY type"
)(lambda d: G.failures(d).groupBy("type").agg(F.count(F.lit(1)).alias("n")))
on_results("f02_limiting_split", "SELECT contains(lower(coalesce(reason, '')), 'limiting reason') AS limited, count(*) AS n FROM results GROUP BY 1")(lambda d: G.split_by(d, "reason", "limiting reason")[0].select(F.lit(True).alias("limited")).unionAll(G.split_by(d, "reason", "limiting reason")[1].select(F.lit(False).alias("limited"))).groupBy("limited").agg(F.count(F.lit(1)).alias("n")))
on_results("f03_empty_log",
    "SELECT row_id, CASE WHEN lower(trim(coalesce(reason, 'nan'))) IN ('nan','none','null','') THEN 'NoErrorLog' "
    "WHEN NOT regexp_matches(reason, '[a-zA-Z]') THEN 'EmptyErrorLog' END AS seed FROM results"
)(lambda d: d.select("row_id", T.emptiness(F.col("reason")).alias("seed")))
on_results("f04_garbage", "SELECT row_id, type = 'inference' AND contains(lower(coalesce(reason, '')), 'segmentation fault') AS garbage FROM results")(lambda d: d.select("row_id", T.garbage_rule(F.when(F.col("type") == "inference", "transformer_run").otherwise("other"), F.lower("reason")).alias("garbage")))
on_results("f05_named_rules",
    "SELECT row_id, CASE WHEN regexp_matches(reason, '(?i)device creation failure') THEN 'Device creation Failure' "
    "WHEN regexp_matches(reason, '(?i)scheduledonsameworker') THEN 'Scheduled on Same worker' "
    "WHEN regexp_matches(reason, '(?i)batchtimerexpired') THEN 'Batch Timer Expired' "
    "WHEN regexp_matches(reason, '(?i)wait timeout') THEN 'Wait timeout' "
    "WHEN regexp_matches(reason, '(?i)failed to create dlc handle with code') THEN 'DLC Handle' "
    "WHEN regexp_matches(reason, '(?i)verifier failed') THEN 'Verifier Failed' END AS rule FROM results"
)(lambda d: d.select("row_id", T.named_rule(F.col("reason")).alias("rule")))
on_results("f07_report_rows",
    "SELECT row_id FROM results WHERE lower(type) NOT IN ('bm_regression','bm_verifier') AND cluster_name <> '' AND reason <> '' "
    "AND cluster_class = 'sdk_issue'"
)(lambda d: G.report_rows(d).select("row_id"))
on_results("f08_excluded_types", "SELECT type, count(*) AS n FROM results WHERE lower(type) NOT IN ('bm_regression','bm_verifier') GROUP BY type")(lambda d: G.without_types(d).groupBy("type").agg(F.count(F.lit(1)).alias("n")))
on_results("f11_recent_runs",
    "SELECT DISTINCT run_id FROM results WHERE strptime('20' || regexp_extract(run_id, '\\.(\\d{12})_', "
    "1), '%Y%m%d%H%M%S') >= TIMESTAMP '2025-01-08 00:00:00'"
)(lambda d: d.select("run_id").distinct().where(R.embedded_time(F.col("run_id")).cast("timestamp_ntz") >= F.lit("2025-01-08 00:00:00").cast("timestamp_ntz")))
on_results("f13_job_filter", "SELECT DISTINCT run_id FROM results WHERE starts_with(run_id, 'ALFA') AND contains(run_id, 'auto')")(lambda d: d.where(F.col("run_id").startswith("ALFA") & F.col("run_id").contains("auto")).select("run_id").distinct())
on_results("f14_not_containing", "SELECT row_id FROM results WHERE NOT coalesce(contains(lower(reason), 'timeout'), false)")(lambda d: G.not_containing(d, "reason", "TIMEOUT").select("row_id"))
on_results("f17_required", "SELECT row_id FROM results WHERE reason IS NOT NULL AND result IS NOT NULL AND cluster_name IS NOT NULL")(lambda d: d.dropna(subset=["reason", "result", "cluster_name"]).select("row_id"))


@register("f12_release_window", "SELECT o_orderkey FROM orders WHERE cast(o_orderdate AS date) BETWEEN DATE '1998-03-30' AND DATE '1998-09-30'")
def _(spark, sf):
    ref = F.to_date(F.lit("1998-09-30"))
    return table(spark, sf, "orders").where(F.to_date("o_orderdate").between(F.add_months(ref, -6), ref)).select("o_orderkey")


# --- joins -------------------------------------------------------------------------------------------------------

on_results("j01_regressions",
    "SELECT n.type, n.runtime, count(*) AS n FROM results n JOIN results o USING (tc_uuid) WHERE n.run_no = 7 AND o.run_no = 3 "
    "AND n.result = 'FAIL' AND o.result = 'PASS' GROUP BY ALL"
)(lambda d: G.regressions(_run(d, 7), _run(d, 3)).groupBy("type", "runtime").agg(F.count(F.lit(1)).alias("n")))
on_results("j02_failed_before",
    "SELECT n.row_id, EXISTS (SELECT 1 FROM results o WHERE o.run_no = 3 AND o.tc_uuid = n.tc_uuid "
    "AND (o.result NOT IN ('PASS','NOT_RUN','PARENT_NOT_RUN','PARENT_FAIL') OR o.result IS NULL)) AS failed_before FROM results n "
    "WHERE n.run_no = 7"
)(lambda d: G.with_previous_failure(_run(d, 7), _run(d, 3)).select("row_id", "failed_before"))
on_results("j03_not_assigned", "SELECT row_id FROM results WHERE row_id NOT IN (SELECT row_id FROM results WHERE cluster_name IS NOT NULL)")(lambda d: G.pending(d, d.where("cluster_name is not null"), "row_id").select("row_id"))
on_results("j04_pending_runs", "SELECT DISTINCT run_id FROM results WHERE run_no >= 4")(lambda d: G.pending(d.select("run_id").distinct(), d.where("run_no < 4")))
_PARTS = (
    "p AS (SELECT DISTINCT run_id, split_part(run_id, '-v', 1) AS prefix, regexp_extract(run_id, '-v(\\d+\\.\\d+\\.\\d+)', 1) AS version, "
    "cast(regexp_extract(run_id, '-v(\\d+)\\.', 1) AS int) AS major, cast(regexp_extract(run_id, '-v\\d+\\.(\\d+)\\.', 1) AS int) AS minor, "
    "regexp_replace(regexp_extract(run_id, '_\\d+-(.+)$', 1), '_RC.*', '') AS suffix_base, "
    "coalesce(try_cast(nullif(regexp_extract(run_id, '_RC(\\d+)', 1), '') AS int), 0) AS rc FROM results)"
)
_WITH_PARTS = f"{WITH}, {_PARTS}"
register("j10_previous_run",
    f"{_WITH_PARTS} SELECT a.run_id, coalesce((SELECT max(b.run_id) FROM p b WHERE b.prefix = a.prefix AND b.suffix_base = a.suffix_base "
    f"AND b.version = a.version AND b.run_id < a.run_id), (SELECT max(b.run_id) FROM p b WHERE b.prefix = a.prefix "
    f"AND b.suffix_base = a.suffix_base AND b.run_id < a.run_id)) AS previous_run_id FROM p a"
)(lambda s, f: G.previous_runs(G.run_table(results(s, f))))
register("j11_valid_previous",
    f"{_WITH_PARTS}, c AS (SELECT run_id, floor(100 * count(*) FILTER (exec_status = 'COMPLETED') / count(*)) AS done FROM results "
    f"GROUP BY run_id) SELECT a.run_id, (SELECT max(b.run_id) FROM p b JOIN c USING (run_id) WHERE b.prefix = a.prefix "
    f"AND b.suffix_base = a.suffix_base AND b.run_id < a.run_id AND done >= 90) AS previous_run_id FROM p a"
)(lambda s, f: G.valid_previous_runs(G.run_table(results(s, f)), G.completion(results(s, f), "run_id")))
register("j12_previous_release",
    f"{_WITH_PARTS} SELECT a.run_id, (SELECT b.run_id FROM p b WHERE b.prefix = a.prefix AND (b.major, b.minor) < (a.major, a.minor) "
    f"ORDER BY b.major DESC, b.minor DESC, b.rc DESC, b.run_id DESC LIMIT 1) AS previous_release FROM p a"
)(lambda s, f: G.previous_releases(G.run_table(results(s, f))))


@register("j07_changes_between", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-06-30'")
def _(spark, sf):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return G.changes_between(table(spark, sf, "orders"), at("1997-06-30"), at("1997-01-01"), "o_orderdate").select("o_orderkey")


@register("j08_change_backends",
    "SELECT p_partkey, coalesce(b.backend, 'common') AS backend FROM part LEFT "
    "JOIN (VALUES ('widget','gpu'),('widget','dsp'),('ring','cpu')) b(word, backend) ON split_part(p_name, ' ', 2) = b.word"
)
def _(spark, sf):
    config = spark.createDataFrame([("widget", "gpu"), ("widget", "dsp"), ("ring", "cpu")], "word string, backend string")
    parts = table(spark, sf, "part").withColumn("word", F.split_part("p_name", F.lit(" "), F.lit(2)))
    return parts.join(F.broadcast(config), "word", "left").select("p_partkey", F.coalesce("backend", F.lit("common")).alias("backend"))




@register("j06_upsert",
    "WITH d AS (SELECT n_name AS name, r_name AS kind FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 18), "
    "i AS (SELECT DISTINCT n_name || '  ' AS name, lower(r_name) AS kind FROM nation JOIN region ON n_regionkey = r_regionkey "
    "WHERE n_nationkey >= 12) SELECT coalesce(d.name, i.name) AS name, coalesce(d.kind, i.kind) AS kind, CASE "
    "WHEN d.name IS NULL THEN DATE '2025-02-02' ELSE DATE '2025-01-01' END AS created_at, CASE WHEN i.name IS NULL THEN DATE '2025-01-01' "
    "ELSE DATE '2025-02-02' END AS updated_at FROM d FULL JOIN i ON lower(trim(d.name)) = lower(trim(i.name)) "
    "AND lower(trim(d.kind)) = lower(trim(i.kind))"
)
def _(spark, sf):
    both = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    day = F.to_date(F.lit("2025-01-01"))
    dim = both.where("n_nationkey < 18").select(F.col("n_name").alias("name"), F.col("r_name").alias("kind"), day.alias("created_at"), day.alias("updated_at"))
    new = both.where("n_nationkey >= 12").select(F.concat("n_name", F.lit("  ")).alias("name"), F.lower("r_name").alias("kind"))
    return U.upserted(dim, new, ["name", "kind"], F.to_date(F.lit("2025-02-02")))


# --- aggregates --------------------------------------------------------------------------------------------------

_STATS = (
    "s AS (SELECT type, count(*) AS total, count(*) FILTER (upper(trim(result)) = 'PASS') AS passed, "
    "count(*) FILTER (upper(trim(result)) = 'FAIL') AS failed, count(*) FILTER (upper(trim(result)) = 'PARENT_FAIL') AS parent_failed, "
    "count(*) FILTER (upper(trim(result)) = 'NOT_RUN') AS not_run FROM results WHERE type IS NOT NULL GROUP BY type), t AS (SELECT *, "
    "total - parent_failed - not_run AS effective FROM s)"
)
register("ag01_type_stats",
    f"{WITH}, {_STATS} SELECT *, round(CASE WHEN effective > 0 THEN failed / effective ELSE 0 END, 6) AS rate, coalesce(CASE "
    f"WHEN effective > 0 THEN failed / effective ELSE 0 END >= 0.35, false) AS flagged FROM t"
)(lambda s, f: _rounded(S.type_stats(results(s, f), 0.35), "rate"))
register("ag05_run_totals",
    f"{WITH}, {_STATS} SELECT cast(sum(total) AS bigint) AS total, cast(sum(failed) AS bigint) AS failed, "
    f"cast(sum(effective) AS bigint) AS effective, string_agg(type, ',' ORDER BY type) FILTER (failed / effective >= 0.3) AS flagged_types, "
    f"round(sum(failed) / sum(effective), 6) AS rate FROM t"
)(lambda s, f: _rounded(S.run_stats(S.type_stats(results(s, f), 0.3)), "rate"))
on_results("ag03_completion",
    "SELECT run_id, type, cast(floor(100 * count(*) FILTER (exec_status = 'COMPLETED') / count(*)) AS int) AS completion FROM results "
    "GROUP BY ALL"
)(lambda d: G.completion(d, "run_id", "type"))
on_results("ag04_by_device",
    "SELECT soc, host, count(*) FILTER (result = 'FAIL') AS failed, count(*) FILTER (result = 'PASS') AS passed FROM results GROUP BY ALL "
    "HAVING failed > 0 OR passed > 0"
)(S.by_device)
on_results("ag06_nested_counts", "SELECT type, runtime, cluster_name, count(*) AS n FROM results GROUP BY ROLLUP (type, runtime, cluster_name)")(lambda d: d.rollup("type", "runtime", "cluster_name").agg(F.count(F.lit(1)).alias("n")))
on_results("ag07_by_model", "SELECT model, count(*) AS n, min(row_id) AS first_row FROM results WHERE result = 'FAIL' GROUP BY model")(lambda d: d.where("result = 'FAIL'").groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row")))
on_results("ag08_runtimes", "SELECT type, string_agg(DISTINCT runtime, ',' ORDER BY runtime) AS runtimes FROM results GROUP BY type")(lambda d: d.groupBy("type").agg(F.array_join(F.array_sort(F.collect_set("runtime")), ",").alias("runtimes")))
on_results("ag09_by_soc", "SELECT lower(soc) AS key, count(*) AS n FROM results WHERE result = 'FAIL' AND soc IS NOT NULL GROUP BY 1")(lambda d: P.by_dimension(d.where("result = 'FAIL'"), "soc"))
on_results("ag10_overview",
    "SELECT count(*) AS failures, count(DISTINCT (run_id, model)) AS models, count(DISTINCT run_id) AS runs, count(DISTINCT bu) AS bus, "
    "count(DISTINCT cluster_name) AS clusters FROM results WHERE result = 'FAIL'"
)(lambda d: P.overview(d.where("result = 'FAIL'")))
on_results("ag11_matrix",
    "SELECT bu, count(*) FILTER (runtime = 'cpu') AS cpu, count(*) FILTER (runtime = 'gpu') AS gpu, count(*) FILTER (runtime = 'dsp') AS dsp, "
    "count(*) FILTER (runtime = 'hta') AS hta, count(*) FILTER (runtime = 'gpu_fp16') AS gpu_fp16, "
    "count(*) FILTER (runtime = 'dsp_fp16') AS dsp_fp16, count(*) FILTER (runtime = 'npu') AS npu, "
    "count(*) FILTER (runtime = 'npu_x86') AS npu_x86 FROM results WHERE result = 'FAIL' GROUP BY bu"
)(lambda d: P.matrix(d.where("result = 'FAIL'")))
on_results("ag12_matrix_totals",
    "SELECT coalesce(bu, 'ALL') AS bu, coalesce(runtime, 'ALL') AS runtime, count(*) AS n FROM results WHERE result = 'FAIL' "
    "GROUP BY CUBE (bu, runtime)"
)(lambda d: P.matrix_totals(d.where("result = 'FAIL'")))
on_results("ag13_metric_set",
    "SELECT dimension, key, count(*) AS n "
    "FROM (SELECT unnest(['soc','runtime','type','cluster_class','cluster_name','model','bu','host']) AS dimension, unnest([soc, runtime, "
    "type, cluster_class, cluster_name, model, bu, host]) AS key FROM results) WHERE key IS NOT NULL GROUP BY ALL"
)(P.metric_set)
on_results("ag14_exact_groups",
    "SELECT CASE WHEN length(reason) <= 50 THEN '(0,50]' ELSE '(50,110]' END AS bin, min(row_id) AS first_row, count(*) AS n FROM results "
    "WHERE length(reason) BETWEEN 1 AND 110 GROUP BY 1, reason HAVING count(*) >= 2"
)(lambda d: C.exact_groups(d, "row_id", "reason"))
on_results("ag21_duplicate_names", "SELECT cluster_name, count(DISTINCT type) AS types FROM results WHERE cluster_name IS NOT NULL GROUP BY 1 HAVING types > 1")(lambda d: d.where("cluster_name is not null").groupBy("cluster_name").agg(F.count_distinct("type").alias("types")).where("types > 1"))
on_results("ag22_distinct_clusters", "SELECT DISTINCT type, cluster_name FROM results")(lambda d: d.select("type", "cluster_name").distinct())
on_results("ag25_first_reason",
    "SELECT type, runtime, cluster_name, reason FROM (SELECT *, row_number() OVER (PARTITION BY type, runtime, cluster_name "
    "ORDER BY row_id) AS rn FROM results) WHERE rn = 1 AND cluster_class = 'sdk_issue'"
)(lambda d: S.first_rows(d, ["type", "runtime", "cluster_name"], ["row_id"], 1).where("cluster_class = 'sdk_issue'").select("type", "runtime", "cluster_name", "reason"))
on_results("ag26_cluster_counts", "SELECT cluster_name, count(*) AS n FROM results GROUP BY 1")(lambda d: d.groupBy("cluster_name").agg(F.count(F.lit(1)).alias("n")))
on_results("ag27_run_details",
    "SELECT run_id, count(*) AS failures, count(DISTINCT model) AS models, count(DISTINCT soc) AS socs, count(DISTINCT runtime) AS runtimes "
    "FROM results WHERE result = 'FAIL' GROUP BY 1"
)(lambda d: d.where("result = 'FAIL'").groupBy("run_id").agg(F.count(F.lit(1)).alias("failures"), F.count_distinct("model").alias("models"), F.count_distinct("soc").alias("socs"), F.count_distinct("runtime").alias("runtimes")))
on_results("ag29_shares", "SELECT key, n, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM (SELECT lower(soc) AS key, count(*) AS n FROM results GROUP BY 1)")(lambda d: P.shares(P.by_dimension(d, "soc")))


# --- windows, top-k, sets ------------------------------------------------------------------------------------------

on_results("w07_first_logs",
    "SELECT cluster_name, row_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_name ORDER BY row_id) AS rank FROM results "
    "WHERE cluster_name IS NOT NULL) WHERE rank <= 5"
)(lambda d: S.first_rows(d.where("cluster_name is not null"), ["cluster_name"], ["row_id"], 5).select("cluster_name", "row_id", "rank"))
on_results("w08_capped_failures",
    "SELECT type, row_id FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY row_id) AS rn FROM results WHERE result = 'FAIL') "
    "WHERE rn <= 100"
)(lambda d: S.first_rows(d.where("result = 'FAIL'"), ["type"], ["row_id"], 100).select("type", "row_id"))
on_results("w09_top_hosts",
    "SELECT soc, host, failed, rank FROM (SELECT *, row_number() OVER (PARTITION BY soc ORDER BY failed DESC, host) AS rank FROM (SELECT soc, "
    "host, count(*) FILTER (result = 'FAIL') AS failed FROM results GROUP BY ALL)) WHERE rank <= 5"
)(lambda d: S.first_rows(d.groupBy("soc", "host").agg(F.count_if(F.col("result") == "FAIL").alias("failed")), ["soc"], [F.col("failed").desc(), "host"], 5))
on_results("w10_top_clusters",
    "SELECT bu, cluster_name, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY bu ORDER BY n DESC, cluster_name) AS rank "
    "FROM (SELECT bu, cluster_name, count(*) AS n FROM results WHERE cluster_name IS NOT NULL GROUP BY ALL)) WHERE rank <= 3"
)(lambda d: S.first_rows(d.where("cluster_name is not null").groupBy("bu", "cluster_name").agg(F.count(F.lit(1)).alias("n")), ["bu"], [F.col("n").desc(), "cluster_name"], 3))
on_results("w11_first_seen", "SELECT tc_uuid, row_id FROM (SELECT *, row_number() OVER (PARTITION BY tc_uuid ORDER BY run_id, row_id) AS rn FROM results) WHERE rn = 1")(lambda d: G.first_seen(d, "tc_uuid", "run_id", "row_id").select("tc_uuid", "row_id"))
register("w12_highest_rc", f"{_WITH_PARTS} SELECT prefix, version, arg_max(run_id, (rc, run_id)) AS run_id FROM p GROUP BY ALL")(lambda s, f: G.highest_rc(G.run_table(results(s, f))))
on_results("w15_heat",
    "SELECT key, n, CASE WHEN n = 0 THEN 0 WHEN n / max(n) OVER () < 0.1 THEN 1 WHEN n / max(n) OVER () < 0.25 THEN 2 "
    "WHEN n / max(n) OVER () < 0.5 THEN 3 WHEN n / max(n) OVER () < 0.75 THEN 4 ELSE 5 END AS band FROM (SELECT lower(model) AS key, "
    "count(*) AS n FROM results GROUP BY 1)"
)(lambda d: P.heat(P.by_dimension(d, "model")))
on_results("w16_chunks",
    "SELECT cluster_name, chunk, count(*) AS n, min(row_id) AS first_row FROM (SELECT cluster_name, row_id, unnest(range(cast(greatest(0, "
    "ceil((rn - 50) / 47.0)) AS int), cast(floor((rn - 1) / 47.0) AS int) + 1)) AS chunk FROM (SELECT cluster_name, row_id, "
    "row_number() OVER (PARTITION BY cluster_name ORDER BY row_id) AS rn FROM results)) GROUP BY ALL"
)(lambda d: P.chunks(d, ["cluster_name"], ["row_id"], 50, 3).groupBy("cluster_name", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row")))
on_results("w17_severity",
    "SELECT model, CASE WHEN count(*) > 200 THEN 'Critical' WHEN count(*) > 50 THEN 'High' ELSE 'Medium' END AS severity FROM results "
    "WHERE result = 'FAIL' GROUP BY model"
)(lambda d: d.where("result = 'FAIL'").groupBy("model").agg(P.severity(F.count(F.lit(1))).alias("severity")))
on_results("w18_stops",
    "SELECT key, n, round(100.0 * sum(n) OVER (ORDER BY n DESC, key ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS stop "
    "FROM (SELECT lower(runtime) AS key, count(*) AS n FROM results GROUP BY 1)"
)(lambda d: P.stops(P.by_dimension(d, "runtime"), "n", F.col("n").desc(), "key"))
on_results("t03_top_models", "SELECT key, n FROM (SELECT lower(model) AS key, count(*) AS n FROM results WHERE result = 'FAIL' GROUP BY 1) ORDER BY n DESC, key LIMIT 10")(lambda d: P.by_dimension(d.where("result = 'FAIL'"), "model").orderBy(F.col("n").desc(), "key").limit(10))
on_results("t02_runs_after_first", "SELECT DISTINCT run_id FROM results WHERE run_no NOT IN (0, 1)")(lambda d: S.first_rows(d.select("run_id").distinct().withColumn("all", F.lit(1)).withColumn("t", R.embedded_time(F.col("run_id"))), ["all"], ["t", "run_id"], 1 << 30).where("rank > 2").select("run_id"))
on_results("t07_latest_match", "SELECT max(run_id) AS run_id FROM results WHERE run_id LIKE 'BETA%auto%'")(lambda d: d.where(F.col("run_id").like("BETA%auto%")).agg(F.max("run_id").alias("run_id")))
on_results("u01_union", "SELECT row_id, run_no FROM results WHERE run_no IN (1, 2)")(lambda d: _run(d, 1).select("row_id", "run_no").unionByName(_run(d, 2).select("row_id", "run_no", "type"), allowMissingColumns=True).drop("type"))
on_results("u03_shard_union", "SELECT DISTINCT run_id FROM results WHERE run_no < 6")(lambda d: d.where("run_no < 4").select("run_id").union(d.where("run_no between 2 and 5").select("run_id")).distinct())
on_results("u04_difference",
    "SELECT DISTINCT tc_uuid FROM results WHERE run_no = 1 AND result = 'FAIL' EXCEPT SELECT tc_uuid FROM results WHERE run_no = 2 "
    "AND result = 'FAIL'"
)(lambda d: _run(d, 1).where("result = 'FAIL'").select("tc_uuid").distinct().join(_run(d, 2).where("result = 'FAIL'").select("tc_uuid"), "tc_uuid", "left_anti"))
on_results("u08_pivot_nesting", "SELECT runtime, type, count(DISTINCT model) AS models FROM results GROUP BY ALL")(lambda d: d.groupBy("runtime", "type").agg(F.count_distinct("model").alias("models")))
on_results("u09_branches", "SELECT lower(type) IN ('converter','quantizer') AS tools, count(*) AS n FROM results GROUP BY 1")(lambda d: d.groupBy(F.lower("type").isin("converter", "quantizer").alias("tools")).agg(F.count(F.lit(1)).alias("n")))

# --- scalars -----------------------------------------------------------------------------------------------------

on_results("sc02_sparse_text",
    "SELECT row_id, "
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(coalesce(reason, ''), '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' '), '(?i)Limiting Reason To \\d+ chars\\|', '', 'g'), '^\\d+:\\s+', ''), '(?i)pid:\\s*\\d+', '', 'g'), '\\b\\d{6,}\\b', '<NUM>', 'g'), '\\s+', ' ', 'g')) AS text "
    "FROM (SELECT row_id, regexp_replace(reason, '\\b0x[0-9a-fA-F]{4,}\\b', '<ADDR>', 'g') AS reason FROM results)"
)(lambda d: d.select("row_id", T.for_sparse(F.col("reason")).alias("text")))
register("sc05_trimmed", "SELECT doc_id, CASE WHEN length(text) > 5000 THEN substr(text, 1, 1500) || ' ... ' || right(text, 3500) ELSE text END AS text FROM documents")(lambda s, f: table(s, f, "documents").select("doc_id", T.trimmed(F.col("text")).alias("text")))
register("sc06_controls", "SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0B-\\x0C\\x0E-\\x1F\\x7F]', '', 'g') AS text FROM documents")(lambda s, f: table(s, f, "documents").select("doc_id", T.without_controls(F.col("text")).alias("text")))
register("sc11_parse_run", f"{_WITH_PARTS} SELECT run_id, prefix, version, major, minor, suffix_base, rc, rc > 0 AS is_rc FROM p")(lambda s, f: G.run_table(results(s, f)).select("run_id", "prefix", "version", "major", "minor", "suffix_base", "rc", "is_rc"))
on_results("sc12_embedded_time", "SELECT DISTINCT run_id, strptime('20' || regexp_extract(run_id, '\\.(\\d{12})_', 1), '%Y%m%d%H%M%S') AS run_ts FROM results")(lambda d: d.select("run_id").distinct().select("run_id", R.embedded_time(F.col("run_id")).cast("timestamp_ntz").alias("run_ts")))
on_results("sc13_embedded_date", "SELECT DISTINCT run_id, cast(strptime('20' || regexp_extract(run_id, '\\.(\\d{12})_', 1), '%Y%m%d%H%M%S') AS date) AS run_date FROM results")(lambda d: d.select("run_id").distinct().select("run_id", R.embedded_date(F.col("run_id")).alias("run_date")))
on_results("sc15_segment",
    "SELECT DISTINCT run_id, CASE WHEN run_id LIKE '%-win%' THEN 'Compute' WHEN run_id LIKE '%-auto%' "
    "AND NOT run_id LIKE '%auto_R%' THEN 'Auto' WHEN run_id LIKE '%-auto_R%' THEN 'Auto' WHEN run_id LIKE '%-pt_%' THEN 'Mobile/IOT/XR' "
    "ELSE 'Unknown' END AS segment FROM results"
)(lambda d: d.select("run_id").distinct().select("run_id", R.segment(F.col("run_id")).alias("segment")))
on_results("sc16_segment_substring",
    "SELECT DISTINCT run_id, CASE WHEN contains(lower(run_id), 'win') THEN 'win' WHEN contains(lower(run_id), 'auto') THEN 'auto' "
    "WHEN contains(lower(run_id), 'llm') THEN 'llm' WHEN contains(lower(run_id), 'pt') THEN 'pt' ELSE 'Unknown' END AS segment FROM results"
)(lambda d: d.select("run_id").distinct().select("run_id", R.segment_by_substring(F.col("run_id")).alias("segment")))
register("sc17_dimension_lookup", "SELECT c_custkey, coalesce(n_name, 'Unknown') AS bu FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")(lambda s, f: table(s, f, "customer").join(F.broadcast(table(s, f, "nation").where("n_nationkey < 20")), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("Unknown")).alias("bu")))
on_results("sc18_cluster_key",
    "SELECT DISTINCT cluster_name, type, runtime, substr(md5(cluster_name || '_' || type || '_' || runtime), 1, 10) AS key FROM results "
    "WHERE cluster_name IS NOT NULL"
)(lambda d: d.where("cluster_name is not null").select("cluster_name", "type", "runtime").distinct().withColumn("key", T.cluster_key(F.col("cluster_name"), F.col("type"), F.col("runtime"))))
on_results("sc19_release_rewrite",
    "SELECT DISTINCT run_id, regexp_replace(regexp_replace(run_id, '_RC\\d+$', ''), '-v\\d+\\.\\d+\\.\\d+', '-v9.9.9') || '_RC2' AS other "
    "FROM results"
)(lambda d: d.select("run_id").distinct().select("run_id", R.release_rewrite(F.col("run_id"), "9.9.9", 2).alias("other")))
on_results("sc21_elapsed",
    "SELECT row_id, CASE WHEN m >= 1440 THEN (m // 1440)::bigint || 'd ' || (m // 60 - 24 * (m // 1440))::bigint || 'h' "
    "ELSE (m // 60)::bigint || 'h ' || (m % 60)::bigint || 'm' END AS label FROM (SELECT row_id, (row_id * 97) // 60 AS m FROM results)"
)(lambda d: d.select("row_id", R.elapsed_label(F.col("row_id") * 97).alias("label")))
on_results("sc22_backoff", "SELECT row_id, cast(least(30, 5 * power(2, row_id % 6)) AS int) AS seconds FROM results")(lambda d: d.select("row_id", R.backoff_seconds(F.col("row_id") % 6 + 1).alias("seconds")))
on_results("sc29_class",
    "SELECT row_id, CASE WHEN cluster_class = 'env_issue' THEN 'env_issue' WHEN cluster_class = 'setup_issue' THEN 'setup_issue' "
    "ELSE 'sdk_issue' END AS class FROM results"
)(lambda d: d.select("row_id", F.when(F.col("cluster_class") == "env_issue", "env_issue").when(F.col("cluster_class") == "setup_issue", "setup_issue").otherwise("sdk_issue").alias("class")))
on_results("sc37_month_name", "SELECT row_id, 'result_' || strftime(ts, '%Y_%m') AS name FROM results")(lambda d: d.select("row_id", F.concat(F.lit("result_"), F.date_format("ts", "yyyy_MM")).alias("name")))

# --- vectors and clusters -------------------------------------------------------------------------------------------

_MEANS = (
    "m AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS pos "
    "FROM embeddings) GROUP BY ALL), c AS (SELECT label, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS x FROM m)"
)
_UNITS = (
    "e AS (SELECT vec_id, label, pos, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM (SELECT vec_id, label, "
    "unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings))"
)
register("ag15_centroids", f"WITH {_MEANS} SELECT label, cast(pos - 1 AS int) AS pos, round(x, 6) + 0.0 AS x FROM c")(lambda s, f: C.centroids(table(s, f, "embeddings")).select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", (F.round("x", 6) + 0.0).alias("x")))
register("ag17_cohesion",
    f"WITH {_UNITS}, p AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, sum(a.x * b.x) AS s FROM e a JOIN e b ON a.label = b.label "
    f"AND a.pos = b.pos AND a.vec_id < b.vec_id GROUP BY ALL), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, n, "
    f"round(greatest(0, least(1, avg(s))), 6) AS cohesion, greatest(0, least(1, avg(s))) < 0.35 AND n > 5 AS is_loose FROM p "
    f"JOIN n USING (label) GROUP BY label, n"
)(lambda s, f: _rounded(C.cohesion(table(s, f, "embeddings")), "cohesion"))
register("j18_centroid_pairs",
    f"WITH {_MEANS} SELECT a.label AS a, b.label AS b, round(sum(a.x * b.x), 6) AS similarity FROM c a JOIN c b ON a.pos = b.pos "
    f"AND a.label < b.label GROUP BY ALL HAVING sum(a.x * b.x) >= 0.05"
)(lambda s, f: _rounded(C.centroid_pairs(C.centroids(table(s, f, "embeddings")), 0.05), "similarity"))
register("j19_nearest_centroid",
    f"WITH {_MEANS}, {_UNITS}, s AS (SELECT e.vec_id, c.label, sum(e.x * c.x) AS s FROM e JOIN c USING (pos) GROUP BY ALL) SELECT vec_id, "
    f"label, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS rn FROM s) WHERE rn = 1"
)(lambda s, f: _rounded(C.nearest_centroid(table(s, f, "embeddings"), C.centroids(table(s, f, "embeddings"))), "similarity"))
register("w01_ranked",
    f"WITH {_MEANS}, {_UNITS}, s AS (SELECT e.vec_id, e.label, sum(e.x * c.x) AS s FROM e JOIN c ON e.label = c.label AND e.pos = c.pos "
    f"GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, "
    f"vec_id) AS rank, (s - min(s) OVER (PARTITION BY label)) / (max(s) OVER (PARTITION BY label) - min(s) OVER (PARTITION BY label)) AS score "
    f"FROM s) SELECT vec_id, label, round(s, 6) AS similarity, rank, round(score, 6) AS score FROM t"
)(lambda s, f: _rounded(C.ranked(table(s, f, "embeddings"), C.centroids(table(s, f, "embeddings"))).drop("is_core"), "similarity", "score"))
register("w03_core_counts",
    f"WITH {_MEANS}, {_UNITS}, s AS (SELECT e.vec_id, e.label, sum(e.x * c.x) AS s FROM e JOIN c ON e.label = c.label AND e.pos = c.pos "
    f"GROUP BY ALL) SELECT label, count(*) FILTER (s >= med) AS core FROM (SELECT *, median(s) OVER (PARTITION BY label) AS med FROM s) "
    f"GROUP BY label"
)(lambda s, f: C.ranked(table(s, f, "embeddings"), C.centroids(table(s, f, "embeddings"))).groupBy("label").agg(F.count_if("is_core").alias("core")))
register("sc24_unit", f"WITH {_UNITS} SELECT vec_id, cast(pos - 1 AS int) AS pos, round(x, 6) + 0.0 AS x FROM e WHERE vec_id % 10 < 10")(lambda s, f: table(s, f, "embeddings").select("vec_id", F.posexplode(V.unit(F.col("embedding"))).alias("pos", "x")).select("vec_id", "pos", (F.round("x", 6) + 0.0).alias("x")))
register("cl10_hdbscan")(lambda s, f: C.density_clusters(table(s, f, "embeddings"), "label", epsilon=0.12))


@register("cl22_ema_update",
    f"WITH o AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS pos "
    f"FROM embeddings WHERE vec_id % 2 = 0 AND label < 8) GROUP BY ALL), n AS (SELECT label, pos, avg(x) AS m FROM (SELECT label, "
    f"unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE vec_id % 2 = 1 AND label > 1) "
    f"GROUP BY ALL), ou AS (SELECT label, pos, m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS x FROM o), nu AS (SELECT label, pos, "
    f"m / sqrt(sum(m * m) OVER (PARTITION BY label)) AS x FROM n), j AS (SELECT coalesce(ou.label, nu.label) AS label, coalesce(ou.pos, "
    f"nu.pos) AS pos, CASE WHEN ou.x IS NULL THEN nu.x WHEN nu.x IS NULL THEN ou.x ELSE 0.9 * ou.x + 0.1 * nu.x END AS x FROM ou FULL "
    f"JOIN nu ON ou.label = nu.label AND ou.pos = nu.pos) SELECT label, cast(pos - 1 AS int) AS pos, "
    f"round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) + 0.0 AS x FROM j"
)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    out = U.updated_centroids(C.centroids(e.where("vec_id % 2 = 0 and label < 8")), C.centroids(e.where("vec_id % 2 = 1 and label > 1")), ["label"])
    return out.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", (F.round("x", 6) + 0.0).alias("x"))


# --- cascade, models, stream -----------------------------------------------------------------------------------------


def _masked(d: DataFrame) -> DataFrame:
    return d.where("result = 'FAIL'").select("row_id", "run_id", "type", "reason")


@on_results("cl08_sparse_groups")
def _(d):
    rows = cut(A.seeded(_masked(d)))
    return A.sparse(rows).groupBy("type", "cluster_name", "assigned_by").agg(F.count(F.lit(1)).alias("n"))


@register("cl12_merged_clusters")
def _(spark, sf):
    cents = C.centroids(table(spark, sf, "embeddings")).select((F.col("label") % 2).cast("string").alias("type"), F.col("label").cast("string").alias("cluster_name"), "centroid")
    return A.merged(cents, 0.05)


@register("cl13_relabel", "SELECT label, count(*) AS n FROM (SELECT CASE WHEN label IN (3, 5) THEN 1 ELSE label END AS label FROM embeddings) GROUP BY label")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.lit("t").alias("type"), F.col("label").cast("string").alias("cluster_name"))
    names = spark.createDataFrame([("t", "3", "1"), ("t", "5", "1")], "type string, cluster_name string, into string")
    return A.relabelled(rows, F.broadcast(names)).groupBy(F.col("cluster_name").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))




@on_results("cl23_cascade")
def _(d):
    return A.analyze(_masked(d)).select("row_id", "type", "cluster_name", "assigned_by", "cluster_class")


@on_results("x08_classes",
    "SELECT row_id, CASE "
    "WHEN regexp_matches(reason, '(?i)device (not found|unavailable)|no space left|timer expired|same worker|connection') THEN 'env_issue' "
    "WHEN regexp_matches(reason, '(?i)missing|not found|no such file|permission denied|not installed') THEN 'setup_issue' "
    "ELSE 'sdk_issue' END AS class FROM results"
)
def _(d):
    return d.select("row_id", M.rule_class(F.col("reason")).alias("class"))


# --- the rest of the filters, joins, sets and scalars ------------------------------------------------------------------

on_results("f09_projection", "SELECT row_id, type AS test_type FROM results")(lambda d: d.drop(*[c for c in ("embedding", "bins") if c in d.columns]).select([c for c in ("row_id", "type", "absent") if c in d.columns]).withColumnRenamed("type", "test_type"))
on_results("f15_suppressed", "SELECT row_id FROM results WHERE NOT contains(coalesce(reason, ''), 'Segmentation') AND NOT contains(coalesce(reason, ''), 'device')")(lambda d: d.where(~F.coalesce(F.col("reason").rlike("Segmentation|device"), F.lit(False))).select("row_id"))
on_results("f16_persisted", "SELECT row_id FROM results WHERE cluster_name NOT IN ('Cluster1', 'Cluster2') AND value IS NOT NULL")(lambda d: d.where(~F.col("cluster_name").isin("Cluster1", "Cluster2") & F.col("value").isNotNull()).select("row_id"))
on_results("f18_valid_sheets", "SELECT DISTINCT cluster_name FROM results WHERE trim(cluster_name) <> ''")(lambda d: d.where(F.trim("cluster_name") != "").select("cluster_name").distinct())
on_results("j05_requeue", "SELECT run_no FROM (SELECT DISTINCT run_no FROM results) WHERE run_no NOT IN (2, 3) ORDER BY run_no OFFSET 4")(lambda d: G.requeue(d.select("run_no").distinct(), d.where("run_no in (2, 3)").select("run_no").distinct(), "run_no", "run_no", most=5, trim=4))
register("j13_valid_previous_release",
    f"{_WITH_PARTS}, c AS (SELECT run_id, floor(100 * count(*) FILTER (exec_status = 'COMPLETED') / count(*)) AS done FROM results "
    f"GROUP BY run_id) SELECT a.run_id, (SELECT b.run_id FROM p b JOIN c USING (run_id) WHERE done >= 90 AND b.prefix = a.prefix AND (b.major, "
    f"b.minor) < (a.major, a.minor) ORDER BY b.major DESC, b.minor DESC, b.rc DESC, b.run_id DESC LIMIT 1) AS previous_release FROM p a"
)(lambda s, f: G.valid_previous_releases(G.run_table(results(s, f)), G.completion(results(s, f), "run_id")))
on_results("ag16_sparse_centroids",
    "SELECT type, token, round(sum(w) / any_value(m), 6) AS weight FROM (SELECT type, runtime AS token, value AS w, "
    "count(*) OVER (PARTITION BY type) AS m FROM results) GROUP BY type, token"
)(lambda d: _rounded(C.sparse_centroids(d.select("row_id", "type", F.col("runtime").alias("token"), F.col("value").alias("weight")), "row_id", "type"), "weight"))
on_results("ag20_distinct_changes", "SELECT DISTINCT run_id || '/' || type AS url FROM results")(lambda d: d.select(F.concat_ws("/", "run_id", "type").alias("url")).dropDuplicates(["url"]))
on_results("ag24_keyed_counts", "SELECT soc, runtime, count(*) AS n, min(row_id) AS first_row FROM results WHERE result = 'FAIL' GROUP BY ALL")(lambda d: d.where("result = 'FAIL'").groupBy("soc", "runtime").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_row")))
register("ag28_batch_totals",
    f"{WITH}, {_STATS} SELECT cast(sum(total) AS bigint) AS tests, cast(sum(failed) AS bigint) AS failures, "
    f"count(*) FILTER (failed / effective >= 0.3) AS flagged FROM t"
)(lambda s, f: S.type_stats(results(s, f), 0.3).agg(F.sum("total").alias("tests"), F.sum("failed").alias("failures"), F.count_if("flagged").alias("flagged")))
on_results("w04_row_minmax",
    "SELECT row_id, round(CASE WHEN max(value) OVER w - min(value) OVER w < 1e-9 THEN 0 "
    "ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 6) AS score FROM results "
    "WINDOW w AS (PARTITION BY tc_uuid)"
)(lambda d: _rounded(P.minmax(d, "tc_uuid", "value", 0.0).select("row_id", "score"), "score"))
on_results("w13_first_of_duplicates", "SELECT tc_uuid, run_no, min(row_id) AS row_id FROM results GROUP BY ALL")(lambda d: S.first_rows(d, ["tc_uuid", "run_no"], ["row_id"], 1).select("tc_uuid", "run_no", "row_id"))
on_results("t01_latest_runs", "SELECT DISTINCT run_id FROM results ORDER BY run_id DESC LIMIT 4")(lambda d: d.select("run_id").distinct().orderBy(F.col("run_id").desc()).limit(4))
on_results("t08_samples",
    "SELECT cluster_class, row_id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_class ORDER BY row_id) AS rn FROM results) "
    "WHERE rn <= 80"
)(lambda d: S.first_rows(d, ["cluster_class"], ["row_id"], 80).select("cluster_class", "row_id"))
on_results("u02_tagged_union", "SELECT row_id, lower(type) AS cluster_type FROM results WHERE lower(type) IN ('inference', 'verifier')")(lambda d: d.where("type = 'inference'").select("row_id", F.lit("inference").alias("cluster_type")).unionByName(d.where("type = 'verifier'").select("row_id", F.lit("verifier").alias("cluster_type"))))
on_results("u06_ordered_distinct", "SELECT row_id, array_to_string(CASE WHEN soc = host THEN [soc] ELSE [soc, host] END, ',') AS names FROM results")(lambda d: d.select("row_id", F.array_join(F.array_distinct(F.array("soc", "host", "soc")), ",").alias("names")))
register("sc14_months_back", "SELECT o_orderkey, cast(o_orderdate - INTERVAL 3 MONTH AS date) AS back FROM orders")(lambda s, f: table(s, f, "orders").select("o_orderkey", F.add_months(F.to_date("o_orderdate"), -3).alias("back")))
on_results("sc20_primary_type", "SELECT DISTINCT type, replace(lower(type), '_', '') IN ('inference', 'verifier', 'unittesthost') AS is_primary FROM results")(lambda d: d.select("type").distinct().withColumn("is_primary", F.replace(F.lower("type"), F.lit("_"), F.lit("")).isin("inference", "verifier", "unittesthost")))
register("sc25_cosine",
    f"WITH {_UNITS} SELECT a.vec_id AS a, b.vec_id AS b, round(sum(a.x * b.x), 6) + 0.0 AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 "
    f"AND a.pos = b.pos GROUP BY ALL"
)(lambda s, f: table(s, f, "embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")).join(table(s, f, "embeddings").select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y")), "a").select("a", "b", (F.round(V.cosine(F.col("x"), F.col("y")), 6) + 0.0).alias("cosine")))
register("sc33_length", "SELECT doc_id, length(text) AS n FROM documents")(lambda s, f: table(s, f, "documents").select("doc_id", F.length("text").cast("long").alias("n")))
register("snk03_filled_class",
    "WITH d AS (SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'old' END AS c FROM nation) SELECT name, "
    "coalesce(c, 'new') AS cluster_class FROM d"
)(lambda s, f: U.filled_class(table(s, f, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "old").alias("cluster_class")), table(s, f, "nation").select(F.col("n_name").alias("name"), F.lit("new").alias("cluster_class")), "name"))
