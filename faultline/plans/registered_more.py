"""Further registered queries: text and vector operators on whole inputs, repairs, report marts, change records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import changes as H
from faultline.functions import runs as R
from faultline.functions import scores as O
from faultline.functions import text as T
from faultline.functions import vectors as V
from faultline.operators import cluster as C
from faultline.operators import dedupe as D
from faultline.operators import models as M
from faultline.operators import regress as G
from faultline.operators import reports as P
from faultline.operators import similar as N
from faultline.operators import stability as S
from faultline.operators import state as U
from faultline.plans import cascade as A
from faultline.plans import marts as K
from faultline.plans import sqltext as Q
from faultline.plans.registered import _MEANS, _UNITS, WITH, _rounded, on_results, register
from faultline.sources import cache
from faultline.sources import connectors as X
from faultline.sources.shared import cut
from faultline.sources.views import results, table

FAILED = "(result NOT IN ('PASS','NOT_RUN','PARENT_NOT_RUN','PARENT_FAIL') OR result IS NULL)"


def _reasons(d: DataFrame) -> DataFrame:
    """Distinct reasons, each with its least row."""
    return d.where("reason is not null").groupBy("reason").agg(F.min("row_id").alias("row_id"))


_REASONS = "r AS (SELECT min(row_id) AS row_id, reason FROM results WHERE reason IS NOT NULL GROUP BY reason)"
_MASKED = f"m AS (SELECT min(row_id) AS row_id, {Q.masked('reason')} AS text FROM results WHERE reason IS NOT NULL GROUP BY 2)"


def _masked_texts(d: DataFrame) -> DataFrame:
    """Distinct masked reasons, each with its least row. Only distinct reasons are masked."""
    return _reasons(d).groupBy(T.mask_numbers(F.col("reason")).alias("text")).agg(F.min("row_id").alias("row_id"))


# --- scans and sinks -----------------------------------------------------------------------------------------------

_SCORES = """s AS (SELECT row_id, run_id, exec_status, CASE WHEN json_valid(j) THEN json_extract(j, '$.Execution_Data.' || json_keys(json_extract(j, '$.Execution_Data'))[1]) END AS rt, run_id LIKE 'BETA%' AS second
    FROM (SELECT *, replace(replace(score, chr(39), '"'), 'None', '"None"') AS j FROM results)),
    p AS (SELECT row_id, run_id, exec_status,
        coalesce(try_cast(json_extract_string(rt, '$."Total Inference Time 75P".Avg_Time') AS double), try_cast(CASE WHEN second THEN json_extract_string(rt, '$."Total Inference Time [NetRun]".Avg_Time') ELSE json_extract_string(rt, '$."Total Inference Time".Avg_Time') END AS double)) AS inference,
        try_cast(CASE WHEN second THEN json_extract_string(rt, '$."Init Stats [NetRun]".Min_Time') ELSE json_extract_string(rt, '$.Init.Min_Time') END AS double) AS init,
        try_cast(CASE WHEN second THEN json_extract_string(rt, '$."De-Init Stats [NetRun]".Min_Time') ELSE json_extract_string(rt, '$."De-Init".Min_Time') END AS double) AS deinit
    FROM s)"""


def _scored(d: DataFrame) -> DataFrame:
    return d.withColumn("p", O.parse(F.col("score"), F.col("run_id").startswith("BETA"))).select("row_id", "run_id", "exec_status", "p.*")


@register("sc30_scores", f"{WITH}, {_SCORES} SELECT row_id, inference, init, deinit FROM p")
def _(spark, sf):
    return _scored(results(spark, sf)).select("row_id", "inference", "init", "deinit")


@register("src08_execution_status",
    f"{WITH}, {_SCORES} SELECT run_id, cast(floor(100 * count(*) FILTER (exec_status = 'COMPLETED') / count(*)) AS int) AS completion, "
    f"count(inference) AS timed, round(sum(inference), 6) AS inference, sum(init) AS init, sum(deinit) AS deinit FROM p GROUP BY run_id"
)
def _(spark, sf):
    rows = _scored(results(spark, sf))
    sums = rows.groupBy("run_id").agg(F.count("inference").alias("timed"), F.round(F.sum("inference"), 6).alias("inference"), F.sum("init").alias("init"), F.sum("deinit").alias("deinit"))
    return G.completion(rows, "run_id").join(sums, "run_id")


@on_results("src01_scan", "SELECT type, runtime, count(*) AS n FROM results WHERE exec_status = 'COMPLETED' GROUP BY ALL")
def _(d):
    d.createOrReplaceTempView("faultline_results")
    return d.sparkSession.sql("SELECT type, runtime, count(*) AS n FROM faultline_results WHERE exec_status = 'COMPLETED' GROUP BY ALL")


@on_results("src05_first_shard", "SELECT row_id FROM results WHERE run_no = (SELECT min(run_no) FROM results WHERE run_no >= 3)")
def _(d):
    return X.first_shard(d.where("run_no >= 3"), F.col("run_no")).select("row_id")


@on_results("src10_cached_runs", "SELECT DISTINCT run_id FROM results WHERE trim(run_id) <> ''")
def _(d):
    store = cache.MartCache(d.sparkSession, f"{_folder(d)}/marts")
    runs = cache.unique_runs(d)
    name = f"runs-{cache.input_key(runs, 'run_id')}"
    store.get(name, lambda: runs)
    return store.get(name, lambda: runs.limit(0))


def _folder(d: DataFrame) -> str:
    from faultline.sources.shared import folder

    return folder(d.sparkSession)


@on_results("src11_report_runs", "SELECT DISTINCT run_id FROM results WHERE type = 'verifier'")
def _(d):
    return cache.unique_runs(d.where("type = 'verifier'"))


@on_results("src18_group_id", "SELECT row_id, coalesce(substr(md5(cluster_name || '_' || type || '_' || runtime), 1, 10), '') AS group_id FROM results")
def _(d):
    keyed = F.when(F.col("cluster_name").isNotNull(), T.cluster_key(F.col("cluster_name"), F.col("type"), F.col("runtime")))
    return d.select("row_id", F.coalesce(keyed, F.lit("")).alias("group_id"))


@on_results("snk05_membership", "SELECT run_id, cluster_name FROM results WHERE cluster_name IS NOT NULL GROUP BY ALL")
def _(d):
    pairs = d.where("cluster_name is not null").select("run_id", "cluster_name")
    return U.added_members(pairs.where("run_no < 7").distinct(), pairs.where("run_no >= 5"), ["run_id", "cluster_name"])


# --- filters -------------------------------------------------------------------------------------------------------

on_results("f06_noise", f"SELECT row_id FROM results WHERE NOT {Q.noise('reason', T.NOISE)}")(lambda d: d.where(~T.is_noise(F.col("reason"))).select("row_id"))
on_results("f10_prefix", "SELECT run_id, count(*) AS n FROM results WHERE starts_with(run_id, 'ALFA') OR starts_with(run_id, 'BETA') GROUP BY run_id")(lambda d: d.where(F.col("run_id").startswith("ALFA") | F.col("run_id").startswith("BETA")).groupBy("run_id").agg(F.count(F.lit(1)).alias("n")))


@on_results("f19_job_status", "SELECT * FROM (VALUES ('whole', 'ok'), ('untyped', 'missing_columns'), ('none', 'no_data')) v(job, status)")
def _(d):
    jobs = {"whole": d, "untyped": d.drop("type"), "none": d.limit(0)}
    return d.sparkSession.createDataFrame([(k, K.job_status(v)) for k, v in jobs.items()], "job string, status string")


# --- texts ---------------------------------------------------------------------------------------------------------

on_results("sc01_preprocess", f"SELECT row_id, {Q.preprocess('reason')} AS text FROM results")(lambda d: d.select("row_id", T.preprocess(F.col("reason")).alias("text")))
register("sc01_documents", f"SELECT doc_id, {Q.preprocess('text')} AS text FROM documents")(lambda s, f: table(s, f, "documents").select("doc_id", T.preprocess(F.col("text")).alias("text")))
on_results("sc03_tokens", f"SELECT row_id, array_to_string({Q.tokens('reason')}, ' ') AS tokens FROM results")(lambda d: d.select("row_id", F.array_join(T.sparse_tokens(F.col("reason")), " ").alias("tokens")))
on_results("sc04_masked", f"SELECT row_id, {Q.masked('reason')} AS text FROM results")(lambda d: d.select("row_id", T.mask_numbers(F.col("reason")).alias("text")))

_LOG = (
    "concat('2024-01-15T13:45:22.123 [error] ', reason, chr(10), 'ready', chr(10), '2024-01-15 13:45:23 [Error] ', reason, "
    "chr(10), '2024-02-01 00:00:00 <E> code ', cast(row_id as string))"
)


@on_results("sc07_error_lines", f"SELECT row_id, {Q.error_lines('line')} AS text FROM (SELECT row_id, {_LOG} AS line FROM results WHERE reason IS NOT NULL)")
def _(d):
    return d.where("reason is not null").select("row_id", T.error_lines(F.expr(_LOG)).alias("text"))


@register("sc08_error_segments",
    f"SELECT doc_id, array_to_string({Q.ordered_distinct('found')}, ' ') AS text FROM (SELECT doc_id, flatten(list_transform(range(0, "
    f"len(text), 200), "
    f"lambda i: {' || '.join(f'''regexp_extract_all(substr(text, i + 1, 250), '(?i){p}')''' for p in T.ERROR_PATTERNS)})) AS found "
    f"FROM (SELECT doc_id, replace(text, '\\n', chr(10)) AS text FROM documents))"
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.error_segments(F.col("text")).alias("text"))


@on_results("sc10_timestamps",
    "SELECT row_id, CASE WHEN row_id % 2 = 0 THEN reason ELSE 'at ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || reason END AS text "
    "FROM results"
)
def _(d):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    line = F.when(F.col("row_id") % 2 == 0, F.concat(stamp, F.lit(",250 "), "reason")).otherwise(F.concat(F.lit("at "), stamp, F.lit(" "), "reason"))
    return d.select("row_id", T.without_timestamp(line).alias("text"))


@on_results("sc11_forms", r"""SELECT form, run_id, prefix, version, timestamp, build_number, suffix FROM (
    SELECT DISTINCT 0 AS form, run_id, split_part(run_id, '-v', 1) AS prefix, regexp_extract(run_id, '-v(\d+\.\d+\.\d+)', 1) AS version, regexp_extract(run_id, '\.(\d{12})_', 1) AS timestamp, regexp_extract(run_id, '_(\d+)-', 1) AS build_number, regexp_extract(run_id, '_\d+-(.+)$', 1) AS suffix FROM results
    UNION ALL SELECT DISTINCT 1, regexp_replace(run_id, '_(\d+)-', '_\1_win-'), split_part(run_id, '-v', 1), regexp_extract(run_id, '-v(\d+\.\d+\.\d+)', 1), regexp_extract(run_id, '\.(\d{12})_', 1), regexp_extract(run_id, '_(\d+)-', 1) || '_win', regexp_extract(run_id, '_\d+-(.+)$', 1) FROM results
    UNION ALL SELECT DISTINCT 2, regexp_replace(run_id, '_\d+-', '-'), split_part(run_id, '-v', 1), regexp_extract(run_id, '-v(\d+\.\d+\.\d+)', 1), regexp_extract(run_id, '\.(\d{12})_', 1), '', regexp_extract(run_id, '_\d+-(.+)$', 1) FROM results
    UNION ALL SELECT DISTINCT 3, replace(regexp_replace(run_id, '_(\d+)-', '_\1_'), 'A-v', 'A 2-v'), replace(split_part(run_id, '-v', 1), 'A', 'A 2'), regexp_extract(run_id, '-v(\d+\.\d+\.\d+)', 1), regexp_extract(run_id, '\.(\d{12})_', 1), regexp_extract(run_id, '_(\d+)-', 1), regexp_extract(run_id, '_\d+-(.+)$', 1) FROM results WHERE run_id LIKE 'BETA%'
    UNION ALL SELECT DISTINCT 4, 'run ' || type, NULL, NULL, NULL, NULL, NULL FROM results)""".replace("'A-v', 'A 2-v'", "'BETA-v', 'BETA 2-v'").replace("'A', 'A 2'", "'BETA', 'BETA 2'"))
def _(d):
    runs = d.select("run_id").distinct()
    forms = [
        runs,
        runs.select(F.regexp_replace("run_id", r"_(\d+)-", "_$1_win-").alias("run_id")),
        runs.select(F.regexp_replace("run_id", r"_\d+-", "-").alias("run_id")),
        runs.where("run_id like 'BETA%'").select(F.replace(F.regexp_replace("run_id", r"_(\d+)-", "_$1_"), F.lit("BETA-v"), F.lit("BETA 2-v")).alias("run_id")),
        d.select(F.concat(F.lit("run "), "type").alias("run_id")).distinct(),
    ]
    whole = None
    for k, form in enumerate(forms):
        part = form.withColumn("form", F.lit(k))
        whole = part if whole is None else whole.unionByName(part)
    return whole.withColumn("p", R.parse(F.col("run_id"))).select("form", "run_id", "p.prefix", "p.version", "p.timestamp", "p.build_number", "p.suffix")


@on_results("sc38_failed_runs", "SELECT DISTINCT type, run_id FROM results")
def _(d):
    pairs = d.select("type", "run_id").distinct()
    log = pairs.groupBy("type").agg(F.array_join(F.collect_list(F.concat(F.lit("\nRun ID: "), "run_id", F.lit(" \n\nFailed with error: Run ID unknown\n----\n"))), "\n").alias("log"))
    return log.select("type", F.explode(R.failed_runs(F.col("log"))).alias("run_id"))


@register("sc31_json_prefix", "SELECT p_partkey, p_name AS message, p_brand AS repository FROM part")
def _(spark, sf):
    body = F.concat(F.lit(")]}'\n"), F.to_json(F.struct(F.col("p_name").alias("subject"), F.col("p_brand").alias("project"), F.lit(1).alias("_number"))))
    return table(spark, sf, "part").select("p_partkey", body.alias("body")).select("p_partkey", H.decoded(F.col("body")).alias("c")).select("p_partkey", F.col("c.subject").alias("message"), F.col("c.project").alias("repository"))


# --- code changes --------------------------------------------------------------------------------------------------


def _changes(spark, sf) -> DataFrame:
    """Change responses of a review service, one of each order: its customer is the owner, its lines are votes."""
    lines = table(spark, sf, "lineitem")
    person = F.struct(F.concat(F.lit("cust"), F.col("l_suppkey") % 50).alias("username"), F.concat(F.lit("Name "), F.col("l_suppkey")).alias("name"), (F.col("l_linenumber") % 4 - 1).cast("int").alias("value"))
    votes = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(person)).alias("all"))
    labels = F.struct(F.struct(F.filter("all", lambda v: v["value"] != 1).alias("all")).alias("Code-Review"), F.struct(F.filter("all", lambda v: v["value"] == 1).alias("all")).alias("Developer-Verified"))
    owner = F.struct(F.concat(F.lit("cust"), F.col("o_custkey") % 50).alias("username"))
    orders = table(spark, sf, "orders").join(votes, "o_orderkey", "left")
    body = F.to_json(F.struct(F.concat(F.lit("Fix "), F.col("o_custkey") % 97).alias("subject"), F.concat(F.lit("group/repo"), F.col("o_custkey") % 7).alias("project"), owner.alias("owner"), labels.alias("labels")))
    return orders.select("o_orderkey", F.concat(F.lit(")]}'\n"), body).alias("body"))


_VOTES = (
    "v AS (SELECT o_orderkey, 'cust' || (o_custkey % 50) AS owner, 'cust' || (l_suppkey % 50) AS who, l_linenumber % 4 - 1 AS vote FROM orders "
    "LEFT JOIN lineitem ON l_orderkey = o_orderkey)"
)


@register("sc32_approvals",
    f"WITH {_VOTES} SELECT o_orderkey, coalesce(string_agg(who, ',' ORDER BY who) FILTER (vote = 2), '') AS approvers, "
    f"coalesce(string_agg(who, ',' ORDER BY who) FILTER (vote = 1 AND who <> owner), '') AS reviewers FROM v GROUP BY o_orderkey"
)
def _(spark, sf):
    records = _changes(spark, sf).select("o_orderkey", H.record(F.col("body"), F.col("o_orderkey"), "http://c").alias("c"))
    names = lambda side: F.array_join(F.array_sort(F.transform(F.col(f"c.{side}"), lambda p: p["username"])), ",").alias(side)
    return records.select("o_orderkey", names("approvers"), names("reviewers"))


@register("sc39_change_records",
    "SELECT o_orderkey, 'http://c/' || o_orderkey AS url, 'Fix ' || (o_custkey % 97) AS message, 'group/repo' || (o_custkey % 7) AS repository, 'cust' || (o_custkey % 50) AS owner, '' AS email "
    "FROM orders"
)
def _(spark, sf):
    records = _changes(spark, sf).select("o_orderkey", H.record(F.col("body"), F.col("o_orderkey"), "http://c").alias("c"))
    return records.select("o_orderkey", "c.url", "c.message", "c.repository", F.col("c.owner.username").alias("owner"), F.col("c.owner.email").alias("email"))


def _change_table(spark, sf) -> DataFrame:
    backend = F.element_at(F.array(F.lit("quantizer"), F.lit("cpu"), F.lit("converter"), F.lit("gpu")), (F.col("o_custkey") % 4 + 1).cast("int"))
    return table(spark, sf, "orders").select(
        F.concat(F.lit("repo"), F.col("o_custkey") % 7).alias("repository"), backend.alias("backend"), F.concat(F.lit("http://C/"), F.col("o_custkey") % 211).alias("url"), F.when(F.col("o_custkey") % 5 > 0, F.concat(F.lit(" Fix "), F.col("o_custkey") % 97)).alias("message"), F.col("o_orderkey").alias("pos")
    )


_CHANGES = (
    "c AS (SELECT 'repo' || (o_custkey % 7) AS repository, ['quantizer', 'cpu', 'converter', 'gpu'][o_custkey % 4 + 1] AS backend, 'http://C/' || (o_custkey % 211) AS url, "
    "CASE WHEN o_custkey % 5 > 0 THEN ' Fix ' || (o_custkey % 97) END AS message, o_orderkey AS pos FROM orders)"
)

register("ag19_unique_changes",
    f"WITH {_CHANGES}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(url) ORDER BY pos, url) AS n FROM c) WHERE n = 1) "
    f"SELECT repository, row_number() OVER (PARTITION BY repository ORDER BY pos, url) AS line, url, message FROM f"
)(lambda s, f: K.changes_page(_change_table(s, f)))


@register("rp08_change_cell",
    f"WITH {_CHANGES}, o AS (SELECT repository, pos, url, trim(message) AS message FROM c WHERE backend IN ('quantizer', 'converter') "
    f"AND message IS NOT NULL) SELECT repository, pos, url, message FROM (SELECT *, row_number() OVER (PARTITION BY lower(repository), "
    f"lower(message) ORDER BY pos, url) AS n FROM o) WHERE n = 1"
)
def _(spark, sf):
    return K.change_cell(_change_table(spark, sf), "Tools")


@register("j09_type_changes", f"""{WITH}, m AS (SELECT DISTINCT lower(type) AS type, CASE WHEN lower(type) IN ('converter', 'quantizer') THEN lower(type) ELSE runtime END AS backend FROM results), {_CHANGES}
    SELECT m.type, m.backend, count(c.pos) AS changes FROM m LEFT JOIN c USING (backend) GROUP BY ALL""")
def _(spark, sf):
    return G.type_changes(results(spark, sf), _change_table(spark, sf)).groupBy("type", "backend").agg(F.count("pos").alias("changes"))


# --- clusters and similarity -----------------------------------------------------------------------------------------


@on_results("x02_sparse_weights", f"SELECT row_id, token, round(weight, 6) AS weight FROM (WITH {_REASONS}, {Q.weights('r', 'row_id', 'reason')} SELECT * FROM u)")
def _(d):
    return _rounded(C.token_weights(_reasons(d), "row_id", T.sparse_tokens(F.col("reason"))), "weight")


_ALL_REASONS = "r AS (SELECT min(row_id) AS row_id, reason FROM results GROUP BY reason)"


@on_results("j17_sparse_pairs",
    f"SELECT * FROM (WITH {_ALL_REASONS}, {Q.weights('r', 'row_id', 'reason')} SELECT a.row_id AS a, b.row_id AS b, "
    f"round(sum(a.weight * b.weight), 6) AS dot FROM u a JOIN u b USING (token) WHERE a.row_id < b.row_id GROUP BY ALL "
    f"HAVING sum(a.weight * b.weight) >= 0.2)"
)
def _(d):
    reasons = d.groupBy("reason").agg(F.min("row_id").alias("row_id"))
    return _rounded(C.sparse_pairs(C.token_weights(reasons, "row_id", T.sparse_tokens(F.col("reason"))), "row_id", 0.2), "dot")


@on_results("w05_anchor_minmax", f"""SELECT * FROM (WITH {_MASKED}, {Q.weights('m', 'row_id', 'text')},
    d AS (SELECT a.row_id AS a, b.row_id AS b, sum(a.weight * b.weight) AS dot FROM u a JOIN u b USING (token) GROUP BY ALL)
    SELECT a, b, round(CASE WHEN max(dot) OVER w - min(dot) OVER w < 1e-9 THEN 0 ELSE (dot - min(dot) OVER w) / (max(dot) OVER w - min(dot) OVER w) END, 6) AS score FROM d WINDOW w AS (PARTITION BY a))""")
def _(d):
    weights = C.token_weights(cut(_masked_texts(d)), "row_id", T.sparse_tokens(F.col("text")))
    # A row's least and greatest are those of its class, so classes are scaled, and rounded before they are spelt out.
    dots, members = C.sparse_classes(weights, "row_id")
    return C.spelt_out(_rounded(P.minmax(dots, "ca", "dot", 0.0).select("ca", "cb", "score"), "score"), members, "score")


_HYBRID = f"""{_MEANS}, {_UNITS}, q AS (SELECT vec_id, {'reason'} FROM embeddings JOIN results ON row_id = vec_id WHERE reason IS NOT NULL), {Q.weights('q', 'vec_id', 'reason')},
    z AS (SELECT label, count(*) AS m FROM embeddings JOIN q USING (vec_id) GROUP BY label),
    cw AS (SELECT label, token, sum(weight) / any_value(m) AS weight FROM u JOIN embeddings USING (vec_id) JOIN z USING (label) GROUP BY label, token),
    dn AS (SELECT e.vec_id, c.label AS k, sum(e.x * c.x) AS cosine FROM e JOIN c ON e.pos = c.pos AND e.label % 2 = c.label % 2 WHERE e.vec_id IN (SELECT vec_id FROM q) GROUP BY ALL),
    sp AS (SELECT u.vec_id, cw.label AS k, sum(u.weight * cw.weight) AS s FROM u JOIN cw USING (token) GROUP BY ALL),
    b AS (SELECT dn.vec_id, dn.k, cosine, coalesce(s, 0) AS sparse FROM dn LEFT JOIN sp USING (vec_id, k)),
    h AS (SELECT vec_id, k, 0.55 * cosine + 0.45 * CASE WHEN max(sparse) OVER w - min(sparse) OVER w < 1e-9 THEN 0 ELSE (sparse - min(sparse) OVER w) / (max(sparse) OVER w - min(sparse) OVER w) END AS score FROM b WINDOW w AS (PARTITION BY vec_id))"""


def _hybrid(spark, sf) -> DataFrame:
    """Scores of vectors, with the reasons of the rows of their numbers, against the clusters of their half."""
    rows = table(spark, sf, "embeddings").join(results(spark, sf).select(F.col("row_id").alias("vec_id"), "reason"), "vec_id").where("reason is not null")
    weights = cut(C.token_weights(rows.select("vec_id", "reason"), "vec_id", T.sparse_tokens(F.col("reason"))))
    members = rows.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    means = weights.join(rows.select("vec_id", "label"), "vec_id").groupBy("label", "token").agg(F.sum("weight").alias("s")).join(members, "label").select("label", "token", (F.col("s") / F.col("m")).alias("weight"))
    half = (F.col("label") % 2).cast("string").alias("type")
    cents = C.centroids(table(spark, sf, "embeddings")).join(C.weight_maps(means, "label"), "label").select(half, F.col("label").alias("cluster_name"), "centroid", "weights")
    queries = rows.join(C.weight_maps(weights, "vec_id"), "vec_id", "left").select(F.col("vec_id").alias("row_id"), half, "embedding", "weights")
    return C.hybrid_scores(queries, cents)


@register("cl04_hybrid_search",
    f"{WITH}, {_HYBRID} SELECT vec_id AS row_id, k AS cluster_name, round(score, 6) AS score FROM (SELECT *, "
    f"row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, k) AS n FROM h) WHERE n = 1"
)
def _(spark, sf):
    best = _hybrid(spark, sf).groupBy("row_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "cluster_name")).alias("b"))
    return best.select("row_id", "b.cluster_name", F.round(-F.col("b.s"), 6).alias("score"))


register("sc27_hybrid", f"{WITH}, {_HYBRID} SELECT vec_id AS row_id, k AS cluster_name, round(score, 6) AS score FROM h")(lambda s, f: _hybrid(s, f).select("row_id", "cluster_name", F.round("score", 6).alias("score")))
register("t06_candidate_pairs", f"WITH {_MEANS}, p AS (SELECT a.label AS a, b.label AS b, sum(a.x * b.x) AS s FROM c a JOIN c b ON a.pos = b.pos AND a.label < b.label GROUP BY ALL) SELECT a, b, round(s, 6) AS similarity, row_number() OVER (ORDER BY s DESC, a, b) AS rank FROM p WHERE s >= 0.0")(
    lambda s, f: _rounded(D.candidate_pairs(_clusters(s, f), 0.0), "similarity").select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), "similarity", "rank")
)


def _clusters(spark, sf) -> DataFrame:
    """Centroids by label, of one type, named so that the names' order is that of the labels."""
    return C.centroids(table(spark, sf, "embeddings")).select(F.lit("t").alias("type"), F.format_string("%02d", F.col("label")).alias("cluster_name"), "centroid")


@register("x07_confirmed",
    f"WITH {_MEANS}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), p AS (SELECT a.label AS a, b.label AS b, "
    f"sum(a.x * b.x) AS s FROM c a JOIN c b ON a.pos = b.pos AND a.label < b.label GROUP BY ALL) SELECT a, b, s >= 0.05 AS is_duplicate, CASE "
    f"WHEN x.n >= y.n THEN a ELSE b END AS keep, cast(floor((row_number() OVER (ORDER BY s DESC, a, b) - 1) / 5) AS int) AS batch FROM p "
    f"JOIN n x ON x.label = a JOIN n y ON y.label = b WHERE s >= 0.0"
)
def _(spark, sf):
    sizes = table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit("t").alias("type"), F.format_string("%02d", F.col("label")).alias("cluster_name"), "n")
    found = D.confirmed(D.candidate_pairs(_clusters(spark, sf), 0.0), sizes, 0.05)
    return found.select(*[F.col(c).cast("int").alias(c) for c in ("a", "b")], "is_duplicate", F.col("keep").cast("int").alias("keep"), "batch")


@register("cl18_near_duplicates")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.lit("t").alias("type"), F.format_string("%02d", F.col("label")).alias("cluster_name"), F.col("vec_id").alias("row_id"))
    return D.deduplicated(rows, _clusters(spark, sf), 0.0, 0.05).groupBy("type", "cluster_name").agg(F.count(F.lit(1)).alias("n"))


@register("cl19_pair_outliers",
    f"WITH {_UNITS}, p AS (SELECT * FROM e WHERE label IN (1, 2)), r AS (SELECT vec_id, unnest(embedding)::double AS x, "
    f"generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE label IN (1, 2)), m AS (SELECT pos, avg(x) AS m FROM r GROUP BY pos), "
    f"u AS (SELECT pos, m / sqrt(sum(m * m) OVER ()) AS x FROM m) SELECT (SELECT CASE "
    f"WHEN count(*) FILTER (label = 1) >= count(*) FILTER (label = 2) THEN '01' ELSE '02' END FROM embeddings) AS merged_name, "
    f"vec_id AS row_id, sum(p.x * u.x) < 0.5 AS is_outlier FROM p JOIN u USING (pos) GROUP BY vec_id"
)
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.lit("t").alias("type"), F.format_string("%02d", F.col("label")).alias("cluster_name"), F.col("vec_id").alias("row_id"), "embedding")
    return D.pair_outliers(rows, "t", "01", "02", 0.5)


_LOF = f"""{_UNITS}, {_MEANS.replace('m AS', 'mm AS', 1).replace('FROM m)', 'FROM mm)')},
    d AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, greatest(0, 1 - sum(a.x * b.x)) AS d FROM e a JOIN e b ON a.label = b.label AND a.pos = b.pos AND a.vec_id <> b.vec_id GROUP BY ALL),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS n FROM d) WHERE n <= 15),
    kd AS (SELECT a AS b, max(d) AS kd FROM k GROUP BY a),
    lr AS (SELECT a, 1 / (avg(greatest(kd, d)) + 1e-10) AS lrd FROM k JOIN kd USING (b) GROUP BY a),
    lo AS (SELECT k.a, avg(o.lrd) / any_value(m.lrd) AS lof FROM k JOIN lr o ON o.a = k.b JOIN lr m ON m.a = k.a GROUP BY k.a),
    cs AS (SELECT e.vec_id, e.label, sum(e.x * c.x) AS s FROM e JOIN c ON e.label = c.label AND e.pos = c.pos GROUP BY ALL)"""
register("cl15_outliers", f"WITH {_LOF} SELECT label, vec_id, round(lof, 6) AS lof FROM cs JOIN lo ON a = vec_id WHERE lof > 1.005 AND s < 0.7")(lambda s, f: _rounded(A.outliers(table(s, f, "embeddings"), cut=1.005), "lof"))
register("cl11_euclidean")(lambda s, f: C.density_clusters(table(s, f, "embeddings"), "label", min_size=5, epsilon=0.0, samples=5, metric="euclidean"))


@on_results("j16_similar_texts")
def _(d):
    return N.similar_pairs(_rounded(N.similar_lists(d.where("result = 'FAIL'"), "type", "row_id", "reason", 85.0), "ratio"), "type")


@on_results("cl07_similar_groups")
def _(d):
    return N.similar_groups(d.where("result = 'FAIL'"), "type", "row_id", "reason", 85.0)


_LINES = f"SELECT row_id, type, {Q.error_lines('reason')} AS raw, reason FROM results WHERE result = 'FAIL'"
_SEEDED = (
    f"SELECT row_id, {Q.masked('clean')} AS text, coalesce({Q.emptiness('reason')}, CASE "
    f"WHEN type = 'transformer_run' THEN 'GarbageOutput' END, replace({Q.named_rule('clean')}, ' ', '')) AS cluster_name FROM (SELECT row_id, "
    f"type, reason, {Q.preprocess('raw')} AS clean FROM ({_LINES}))"
)


@on_results("cl01_seeded", f"SELECT *, CASE WHEN cluster_name IS NOT NULL THEN 'rule' END AS assigned_by FROM ({_SEEDED})")
def _(d):
    return A.seeded(_failed(d)).select("row_id", "text", "cluster_name", "assigned_by")


def _failed(d: DataFrame) -> DataFrame:
    return d.where("result = 'FAIL'").select("row_id", "run_id", "type", "reason")


def _unlabelled(d: DataFrame, *more: str) -> DataFrame:
    nothing = F.lit(None).cast("string")
    return _failed(d).select("row_id", "type", F.col("reason").alias("text"), nothing.alias("cluster_name"), nothing.alias("assigned_by"))


@on_results("cl06_exact_groups",
    "SELECT type, n FROM (SELECT type, reason, count(*) AS n FROM results WHERE result = 'FAIL' AND length(reason) BETWEEN 1 AND 110 "
    "GROUP BY ALL) WHERE n >= 2"
)
def _(d):
    return A.exact(_unlabelled(d)).where("cluster_name is not null").groupBy("type", "cluster_name").agg(F.count(F.lit(1)).alias("n")).select("type", "n")


@on_results("cl20_same_names",
    "SELECT type, CASE WHEN cluster_name IN ('Cluster1', 'Cluster2', 'Cluster3') THEN 'Low' ELSE cluster_name END AS cluster_name, "
    "count(*) AS n FROM results WHERE cluster_name IS NOT NULL AND NOT coalesce(contains(reason, 'device'), false) GROUP BY ALL"
)
def _(d):
    rows = d.where("cluster_name is not null").select("row_id", "type", "cluster_name", F.col("reason").alias("text"))
    wrong = D.analysed(rows, lambda t: t.contains("device"))
    names = wrong.withColumn("name", F.when(F.col("cluster_name").isin("Cluster1", "Cluster2", "Cluster3"), "Low").otherwise(F.col("cluster_name")))
    return D.merged_same_names(rows, names).where("cluster_name is not null").groupBy("type", "cluster_name").agg(F.count(F.lit(1)).alias("n"))


@on_results("cl21_subclusters", f"""SELECT row_id, CASE WHEN n >= 2 THEN 'Cluster1_' || first ELSE 'Cluster1' END AS cluster_name, cast(floor((dense_rank() OVER (PARTITION BY type ORDER BY first) - 1) / 30) AS int) AS batch
    FROM (SELECT row_id, type, count(*) OVER (PARTITION BY type, m) AS n, min(row_id) OVER (PARTITION BY type, m) AS first FROM (SELECT row_id, type, {Q.masked('reason')} AS m FROM results WHERE cluster_name = 'Cluster1' AND reason IS NOT NULL))""")
def _(d):
    return D.subclustered(d.where("reason is not null").select("row_id", "type", "cluster_name", F.col("reason").alias("text")), "Cluster1")


@on_results("x04_analysis",
    "SELECT type, cluster_name, count(*) FILTER (contains(reason, 'device')) AS misclassified FROM results WHERE cluster_name IS NOT NULL "
    "GROUP BY ALL"
)
def _(d):
    rows = d.where("cluster_name is not null").select("row_id", "type", "cluster_name", F.col("reason").alias("text"))
    return D.analysed(rows, lambda t: t.contains("device")).select("type", "cluster_name", F.size("misclassified").cast("long").alias("misclassified"))


@on_results("x06_masked_groups",
    f"SELECT row_id, min(row_id) OVER (PARTITION BY m) AS \"group\" FROM (SELECT row_id, {Q.masked('reason')} AS m FROM results "
    f"WHERE reason IS NOT NULL)"
)
def _(d):
    return M.masked_groups(d.where("reason is not null"), "row_id", "reason")


@on_results("x09_summary",
    f"SELECT cluster_name, pattern, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster_name ORDER BY n DESC, pattern) AS rank "
    f"FROM (SELECT cluster_name, {Q.masked('reason')} AS pattern, count(*) AS n FROM results WHERE reason IS NOT NULL GROUP BY ALL)) "
    f"WHERE rank <= 5"
)
def _(d):
    return M.summary(d.where("reason is not null").select("cluster_name", "reason"), "cluster_name", "reason")


@on_results("x01_hashed_embedding")
def _(d):
    return M.hashed_embedding(_reasons(d), "reason").select("row_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@on_results("x03_names")
def _(d):
    return M.token_namer(d.where("cluster_name is not null and reason is not null"), "cluster_name", "reason")


@on_results("j22_cluster_class",
    "SELECT r.row_id, c.cls FROM results r LEFT JOIN (SELECT cluster_name, min(cluster_class) AS cls FROM results "
    "WHERE cluster_name IS NOT NULL GROUP BY 1) c USING (cluster_name)"
)
def _(d):
    classes = d.where("cluster_name is not null").groupBy("cluster_name").agg(F.min("cluster_class").alias("cls"))
    return d.join(classes, "cluster_name", "left").select("row_id", "cls")


@register("cl22_sparse_update", """WITH w AS (SELECT n_regionkey AS type, n_name AS token, n_nationkey / 10.0 AS weight FROM nation),
    o AS (SELECT type, token, weight FROM w WHERE type < 4), n AS (SELECT type, token, weight + 1 AS weight FROM w WHERE type > 0 AND token > 'E')
    SELECT coalesce(o.type, n.type) AS type, coalesce(o.token, n.token) AS token, round(CASE WHEN coalesce(o.type, n.type) NOT IN (SELECT type FROM o) THEN n.weight WHEN coalesce(o.type, n.type) NOT IN (SELECT type FROM n) THEN o.weight ELSE 0.9 * coalesce(o.weight, 0) + 0.1 * coalesce(n.weight, 0) END, 6) AS weight FROM o FULL JOIN n ON o.type = n.type AND o.token = n.token""")
def _(spark, sf):
    w = table(spark, sf, "nation").select(F.col("n_regionkey").alias("type"), F.col("n_name").alias("token"), (F.col("n_nationkey") / 10.0).alias("weight"))
    old, new = w.where("type < 4"), w.where("type > 0 and token > 'E'").withColumn("weight", F.col("weight") + 1)
    moved = U.updated_weights(C.weight_maps(old, "type"), C.weight_maps(new, "type"), ["type"])
    return moved.select("type", F.explode("weights").alias("token", "weight")).withColumn("weight", F.round("weight", 6))


# --- report marts ----------------------------------------------------------------------------------------------------

_COUNTED = (
    "f AS (SELECT * FROM results WHERE lower(type) NOT IN ('bm_regression','bm_verifier') AND cluster_name <> '' AND reason <> '' "
    "AND cluster_class = 'sdk_issue')"
)

register("rp01_type_matrix",
    f"{WITH}, {_COUNTED}, c AS (SELECT type, runtime, cluster_name, count(*) AS n FROM f GROUP BY ALL) SELECT type, runtime, "
    f"cast(sum(n) AS bigint) AS failures, count(*) AS clusters, arg_min(cluster_name, (-n, cluster_name)) AS top_cluster FROM c GROUP BY ALL"
)(lambda s, f: K.type_matrix(G.report_rows(results(s, f))))
register("rp02_model_detail",
    f"{WITH}, {_COUNTED} SELECT model AS key, row_number() OVER (PARTITION BY model ORDER BY cluster_name, row_id) AS line, row_id, tc_uuid, "
    f"cluster_name, reason FROM f"
)(lambda s, f: K.detail(G.report_rows(results(s, f)), "model"))
register("rp02_soc_detail",
    f"{WITH}, {_COUNTED} SELECT soc AS key, row_number() OVER (PARTITION BY soc ORDER BY cluster_name, row_id) AS line, row_id, tc_uuid, "
    f"cluster_name, reason FROM f"
)(lambda s, f: K.detail(G.report_rows(results(s, f)), "soc"))
register("rp03_consolidated",
    f"{WITH}, {_COUNTED}, r AS (SELECT *, CASE WHEN lower(type) IN ('converter','quantizer') THEN 'Tools' WHEN runtime = 'cpu' "
    f"AND lower(type) IN ('savecontext','graph_prepare') THEN 'Graph Prepare' WHEN runtime = 'cpu' "
    f"AND lower(type) IN ('inference','verifier') THEN 'cpu' WHEN lower(type) = 'benchmark' THEN NULL WHEN runtime = 'cpu' THEN 'Core' "
    f"ELSE runtime END AS report_row FROM f) SELECT report_row, CASE WHEN report_row = 'Tools' THEN runtime ELSE lower(type) END AS label, "
    f"count(*) AS failures, count(DISTINCT cluster_name) AS clusters, arg_min(reason, row_id) AS first_reason FROM r "
    f"WHERE report_row IS NOT NULL GROUP BY ALL"
)(lambda s, f: K.consolidated(G.report_rows(results(s, f))))
on_results("rp04_segment_report",
    "SELECT bu, run_id, count(*) AS failures, count(DISTINCT model) AS models, count(DISTINCT soc) AS socs, "
    "count(DISTINCT runtime) AS runtimes FROM results WHERE result = 'FAIL' GROUP BY ALL"
)(lambda d: K.segment_report(d.where("result = 'FAIL'")))
_LISTS = (
    "x AS (SELECT dimension, key, count(*) AS n "
    "FROM (SELECT unnest(['soc','runtime','type','cluster_class','cluster_name','model']) AS dimension, unnest([soc, runtime, type, "
    "cluster_class, cluster_name, model]) AS key FROM results WHERE result = 'FAIL') WHERE key IS NOT NULL GROUP BY ALL), k AS (SELECT *, "
    "row_number() OVER (PARTITION BY dimension ORDER BY n DESC, key) AS rank, round(100.0 * n / sum(n) OVER (PARTITION BY dimension), "
    "6) AS percent, n / max(n) OVER (PARTITION BY dimension) AS ratio FROM x)"
)
register("t04_dashboard_lists", f"{WITH}, {_LISTS} SELECT dimension, key, n, rank FROM k WHERE dimension NOT IN ('soc', 'cluster_name', 'model') OR rank <= 10")(lambda s, f: K.top_lists(results(s, f).where("result = 'FAIL'")))
register("rp05_dashboard",
    f"{WITH}, {_LISTS} SELECT dimension, key, n, rank, percent, CASE WHEN ratio < 0.1 THEN 1 WHEN ratio < 0.25 THEN 2 WHEN ratio < 0.5 THEN 3 "
    f"WHEN ratio < 0.75 THEN 4 ELSE 5 END AS band, CASE WHEN dimension <> 'model' THEN NULL WHEN n > 200 THEN 'Critical' "
    f"WHEN n > 50 THEN 'High' ELSE 'Medium' END AS severity FROM k WHERE dimension NOT IN ('soc', 'cluster_name', 'model') OR rank <= 10"
)(lambda s, f: K.dashboard(results(s, f).where("result = 'FAIL'")))
_RATES = (
    "s AS (SELECT type, count(*) FILTER (upper(trim(result)) = 'FAIL') AS failed, "
    "count(*) - count(*) FILTER (upper(trim(result)) = 'PARENT_FAIL') - count(*) FILTER (upper(trim(result)) = 'NOT_RUN') AS effective "
    "FROM results WHERE type IS NOT NULL GROUP BY type), t AS (SELECT *, coalesce(CASE WHEN effective > 0 THEN failed / effective END, "
    "0) AS rate FROM s)"
)
register("t05_flagged_first",
    f"{WITH}, {_RATES} SELECT type, rate >= 0.35 AS flagged, round(rate, 6) AS rate, row_number() OVER (ORDER BY rate >= 0.35 DESC, rate DESC, "
    f"type) AS place FROM t"
)(lambda s, f: _rounded(K.flagged_first(results(s, f), 0.35), "rate").select("type", "flagged", "rate", "place"))
register("rp07_host_cards",
    f"{WITH}, {_RATES}, c AS (SELECT type, soc, host, count(*) FILTER (result = 'FAIL') AS failed, count(*) FILTER (result = 'PASS') AS passed "
    f"FROM results JOIN (SELECT type FROM t WHERE rate >= 0.3) USING (type) GROUP BY ALL) SELECT type, soc, host, failed, passed, rank "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY type, soc ORDER BY failed DESC, host) AS rank FROM c WHERE failed > 0 OR passed > 0) "
    f"WHERE rank <= 5"
)(lambda s, f: K.host_cards(results(s, f), 0.3))


@on_results("ag06_rows",
    "SELECT type, runtime, cluster_name, row_id, count(*) OVER (PARTITION BY type, runtime, cluster_name) AS n FROM results "
    "WHERE cluster_name IS NOT NULL"
)
def _(d):
    rows = d.where("cluster_name is not null").select("type", "runtime", "cluster_name", "row_id")
    return rows.join(rows.groupBy("type", "runtime", "cluster_name").agg(F.count(F.lit(1)).alias("n")), ["type", "runtime", "cluster_name"])


@on_results("ag07_model_rows", "SELECT model, row_id, type, count(*) OVER (PARTITION BY model) AS n FROM results WHERE result = 'FAIL'")
def _(d):
    rows = d.where("result = 'FAIL'").select("model", "row_id", "type")
    return rows.join(rows.groupBy("model").agg(F.count(F.lit(1)).alias("n")), "model")


@on_results("ag24_soc_rows",
    "SELECT soc, runtime, row_id, count(*) OVER (PARTITION BY soc) AS of_soc, count(*) OVER (PARTITION BY runtime) AS of_runtime FROM results "
    "WHERE result = 'FAIL'"
)
def _(d):
    rows = d.where("result = 'FAIL'").select("soc", "runtime", "row_id")
    return rows.join(rows.groupBy("soc").agg(F.count(F.lit(1)).alias("of_soc")), "soc").join(rows.groupBy("runtime").agg(F.count(F.lit(1)).alias("of_runtime")), "runtime")


on_results("ag23_runs_per_bu", "SELECT bu, string_agg(DISTINCT run_id, ',' ORDER BY run_id) AS runs FROM results GROUP BY bu")(lambda d: d.select("bu", "run_id").distinct().groupBy("bu").agg(F.array_join(F.array_sort(F.collect_list("run_id")), ",").alias("runs")))


@register("ag27_run_changes", f"""{WITH}, r AS (SELECT run_id, strptime('20' || regexp_extract(run_id, '\\.(\\d{{12}})_', 1), '%Y%m%d%H%M%S') AS run_at, count(*) FILTER (result = 'FAIL') AS failures FROM results GROUP BY run_id),
    w AS (SELECT *, lag(run_at) OVER (PARTITION BY split_part(run_id, '-v', 1) ORDER BY run_at, run_id) AS before FROM r)
    SELECT run_id, failures, (SELECT count(*) FROM orders WHERE o_orderdate + INTERVAL 9620 DAY > before AND o_orderdate + INTERVAL 9620 DAY <= run_at) AS changes FROM w""")
def _(spark, sf):
    d = results(spark, sf)
    runs = d.groupBy("run_id").agg(F.count_if(F.col("result") == "FAIL").alias("failures")).withColumn("at", R.embedded_time(F.col("run_id")).cast("timestamp_ntz"))
    w = Window.partitionBy(F.split("run_id", "-v")[0]).orderBy("at", "run_id")
    spans = runs.withColumn("before", F.lag("at").over(w))
    merged = table(spark, sf, "orders").select((F.col("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL '9620' DAY")).alias("merged_at"))
    # Runs are few: their spans travel to the changes, which are counted where they are.
    counts = merged.join(F.broadcast(spans), (F.col("merged_at") > F.col("before")) & (F.col("merged_at") <= F.col("at"))).groupBy("run_id").agg(F.count(F.lit(1)).alias("changes"))
    return runs.join(counts, "run_id", "left").select("run_id", "failures", F.coalesce("changes", F.lit(0)).alias("changes"))


on_results("w14_first_reason", "SELECT cluster_name, arg_min(reason, row_id) AS reason FROM results WHERE cluster_name IS NOT NULL AND reason IS NOT NULL GROUP BY 1")(lambda d: d.where("cluster_name is not null and reason is not null").groupBy("cluster_name").agg(F.min_by("reason", "row_id").alias("reason")))
on_results("t08_preview", "SELECT row_id, run_id, type, result FROM results ORDER BY row_id LIMIT 5")(lambda d: d.select("row_id", "run_id", "type", "result").orderBy("row_id").limit(5))
on_results("t09_releases",
    "SELECT version, row_number() OVER (ORDER BY version DESC) AS place FROM (SELECT DISTINCT regexp_extract(run_id, '-v(\\d+\\.\\d+\\.\\d+)', "
    "1) AS version FROM results)"
)(lambda d: d.select("run_id").distinct().select(R.parse(F.col("run_id"))["version"].alias("version")).distinct().withColumn("place", F.row_number().over(Window.orderBy(F.col("version").desc()))))


def _nested(rows: DataFrame) -> DataFrame:
    """{type: {runtime: [SoCs]}} of each segment."""
    inner = rows.select("bu", "type", "runtime", "soc").distinct().groupBy("bu", "type", "runtime").agg(F.array_sort(F.collect_list("soc")).alias("socs"))
    middle = inner.groupBy("bu", "type").agg(F.map_from_entries(F.collect_list(F.struct("runtime", "socs"))).alias("m"))
    return middle.groupBy("bu").agg(F.map_from_entries(F.collect_list(F.struct("type", "m"))).alias("nested"))


@on_results("u07_merged_maps", "SELECT bu, type, runtime, string_agg(DISTINCT soc, ',' ORDER BY soc) AS socs FROM results WHERE run_no < 7 OR run_no > 8 GROUP BY ALL")
def _(d):
    a, b = _nested(d.where("run_no < 7")).withColumnRenamed("nested", "a"), _nested(d.where("run_no > 8")).withColumnRenamed("nested", "b")
    both = a.join(b, "bu", "full_outer").select("bu", F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(H.merged_maps(F.col("a"), F.col("b"))).alias("m"))
    return both.select("bu", F.explode("m").alias("type", "of")).select("bu", "type", F.explode("of").alias("runtime", "l")).select("bu", "type", "runtime", F.array_join(F.array_sort(F.array_distinct("l")), ",").alias("socs"))


@on_results("u08_regrouped", "SELECT runtime, type, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM results GROUP BY ALL")
def _(d):
    by_type = d.select("type", "runtime", "model").distinct().groupBy("type", "runtime").agg(F.array_sort(F.collect_list("model")).alias("l")).groupBy("type").agg(F.map_from_entries(F.collect_list(F.struct("runtime", "l"))).alias("m"))
    return by_type.select("type", F.explode("m").alias("runtime", "l")).select("runtime", "type", F.array_join("l", ",").alias("models"))
