"""Views that give the synthetic tables the shapes the operators work on, for Spark and (as SQL) for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_RUN = "cast(event_id % 12 as int)"
_RUNTIME = "case cast(user_id % 8 as int) when 0 then 'cpu' when 1 then 'gpu' when 2 then 'dsp' when 3 then 'hta' when 4 then 'gpu_fp16' when 5 then 'dsp_fp16' when 6 then 'npu' else 'npu_x86' end"
#: Times of a test as text, with single quotes; none, of no runtime, or broken in some rows.
_SCORE = f"""case when event_id % 19 = 0 then null when event_id % 17 = 0 then 'no json' when event_id % 13 = 0 then '{{}}' else replace(concat('{{"Execution_Data": {{"', {_RUNTIME}, '": {{', case when event_id % 3 = 0 then concat('"Total Inference Time 75P": {{"Avg_Time": ', cast(event_id % 101 as string), '.5}}, ') when event_id % 3 = 1 then '"Total Inference Time 75P": {{"Avg_Time": None}}, ' else '' end, '"Total Inference Time": {{"Avg_Time": ', cast(event_id % 53 as string), '}}, "Total Inference Time [NetRun]": {{"Avg_Time": ', cast(event_id % 59 as string), '}}, "Init": {{"Min_Time": ', cast(event_id % 7 as string), '}}, "De-Init Stats [NetRun]": {{"Min_Time": ', cast(event_id % 5 as string), '}}}}}}}}'), '"', chr(39)) end"""
#: Test results out of the events; each expression means the same in Spark SQL and DuckDB.
RESULT_COLUMNS = {
    "row_id": "event_id",
    "run_id": f"concat(case when {_RUN} % 2 = 0 then 'ALFA' else 'BETA' end, '-v2.', cast(30 + cast(floor({_RUN} / 4) as int) as string), '.0.2501', lpad(cast({_RUN} + 1 as string), 2, '0'), '103000_', cast(1000 + {_RUN} as string), '-', case when {_RUN} % 3 = 0 then 'auto' when {_RUN} % 3 = 1 then 'pt_nightly' else 'win' end, case when {_RUN} >= 8 then concat('_RC', cast({_RUN} - 7 as string)) else '' end)",
    "run_no": _RUN,
    "tc_uuid": "concat('tc', cast(cast(floor(event_id / 12) as bigint) % 400 as string))",
    "type": "case event_type when 'error' then 'Converter' when 'click' then 'quantizer' when 'view' then 'inference' when 'purchase' then 'verifier' else 'bm_regression' end",
    "runtime": _RUNTIME,
    "soc": "concat('soc', cast(user_id % 7 as string))",
    "host": "concat('host', cast(user_id % 11 as string))",
    "model": "concat('model', cast(user_id % 23 as string))",
    "bu": "case cast(user_id % 5 as int) when 0 then 'Compute' when 1 then 'Auto' when 2 then 'GenAI' when 3 then 'Mobile' else 'Unknown' end",
    "result": "case when event_id % 97 = 0 then null when cast(floor(value) as bigint) % 10 < 5 then 'PASS' when cast(floor(value) as bigint) % 10 < 8 then 'FAIL' when cast(floor(value) as bigint) % 10 = 8 then 'NOT_RUN' else 'PARENT_FAIL' end",
    "exec_status": "case when event_id % 13 = 0 then 'PENDING' else 'COMPLETED' end",
    "cluster_name": "case when user_id % 9 = 0 then null else concat('Cluster', cast(user_id % 9 as string)) end",
    "cluster_class": "case cast(user_id % 3 as int) when 0 then 'sdk_issue' when 1 then 'env_issue' else 'setup_issue' end",
    "reason": "case when event_id % 31 = 0 then null when event_id % 29 = 0 then '' when event_id % 5 = 0 then concat('9: [ERROR] Verifier Failed at step ', cast(user_id % 6 as string), ' after ', cast(cast(floor(value) as bigint) as string), 'ms') when event_id % 5 = 1 then concat('Limiting Reason To 3000 chars|device not found on ', event_type) when event_id % 5 = 2 then concat('Wait timeout: code 0x', cast(100000 + user_id as string), ' pid: ', cast(user_id as string)) when event_id % 5 = 3 then concat('Segmentation fault in node_', cast(user_id % 8 as string), ' (core 12.5 s)') else '4242 1717' end",
    "score": _SCORE,
    "ts": "ts",
    "value": "value",
}


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[f"{e} AS {c}" for c, e in RESULT_COLUMNS.items()])


RESULTS_SQL = "results AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in RESULT_COLUMNS.items()) + " FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
