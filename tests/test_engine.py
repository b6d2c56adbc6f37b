import datetime

import pytest
from pyspark.sql import functions as F

from faultline.operators import models as M
from faultline.plans import cascade as A
from faultline.plans import render
from faultline.plans.engine import Engine
from faultline.sources import connectors as S
from faultline.streaming import centroids as ST

OLD, NEW = "ALFA-v2.30.0.250101103000_1-auto", "ALFA-v2.30.0.250102103000_2-auto"
RESULTS = "row_id long, run_id string, tc_uuid string, type string, runtime string, soc string, host string, model string, bu string, result string, exec_status string, reason string, cluster_name string, cluster_class string"


def results(spark):
    rows = []
    for k in range(40):
        reason = ["Verifier failed at 12 ms", "crash in node alpha beta", None, "crash in node alpha gamma", "!!!"][k % 5]
        for n, run in enumerate((OLD, NEW)):
            rows.append((2 * k + n, run, f"t{k}", ["inference", "quantizer"][k % 2], "cpu", "s", "h", "m", "b", "PASS" if n == 0 else "FAIL", "COMPLETED", reason, None, None))
    return spark.createDataFrame(rows, RESULTS)


def test_cascade_keeps_every_row_once(spark):
    df = results(spark).where(F.col("result") == "FAIL")
    out = A.analyze(df.select("row_id", "type", "reason")).collect()
    assert sorted(r.row_id for r in out) == sorted(r.row_id for r in df.collect())
    by_row = {r.row_id: r for r in out}
    assert by_row[1].cluster_name.startswith("VerifierFailed") and by_row[5].cluster_name == "NoErrorLog" and by_row[9].cluster_name == "EmptyErrorLog"
    assert all(r.cluster_name for r in out if r.row_id // 2 % 5 in (1, 3))
    assert A.analyze(df.select("row_id", "type", "reason").limit(0)).count() == 0


def test_engine_end_to_end(spark, tmp_path):
    changes = spark.createDataFrame([("c1", datetime.datetime(2025, 1, 2)), ("c2", datetime.datetime(2025, 1, 3))], "change_id string, merged_at timestamp")
    engine = Engine(spark, results(spark), f"file://{tmp_path}/state", changes)
    assert engine.newer_first(OLD, NEW) == (NEW, OLD)
    assert engine.regressions(OLD, NEW).count() == 40
    assert [r.change_id for r in engine.changes_between(NEW, OLD).collect()] == ["c1"]
    assert engine.previous_runs(NEW).first()["previous_run_id"] == OLD
    first = engine.process_run(NEW).count()
    stored = sorted(map(str, engine.store.centroids().collect()))
    assert first == 40 and stored
    assert engine.process_run(NEW).count() == first and sorted(map(str, engine.store.centroids().collect())) == stored
    assert [r.run_id for r in engine.queue(spark.createDataFrame([(OLD,), (NEW,)], "run_id string")).collect()] == [OLD]
    assert engine.lookup("inference", "crash in node alpha beta").first()["assigned_by"] == "known"
    assert "&lt;b&gt;" in engine.report("<b>", engine.run_clusters(NEW, OLD))


def test_stream_applies_each_run_once(spark, tmp_path):
    folder, source = f"file://{tmp_path}/s", f"{tmp_path}/in"
    rows = [(OLD, "t", "a", [1.0, 0.0]), (NEW, "t", "a", [0.0, 1.0]), (NEW, "t", "b", [0.6, 0.8])]
    spark.createDataFrame(rows, ST.INPUT).coalesce(1).write.mode("append").parquet(source)
    ST.start(spark, source, folder).awaitTermination()
    spark.createDataFrame(rows[:1], ST.INPUT).coalesce(1).write.mode("append").parquet(source)
    ST.start(spark, source, folder).awaitTermination()
    got = {r.cluster_name: [round(x, 6) for x in r.centroid] for r in ST.CentroidStore(spark, folder).centroids().collect()}
    assert got == {"a": [0.993884, 0.110432], "b": [0.6, 0.8]}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "r.csv").write_text("row_id,result,type\n1,FAIL,x\n2,PASS,\n")
    df = S.read_results(spark, f"{tmp_path}/r.csv", "csv")
    assert df.count() == 2 and df.where("reason is null").count() == 2
    with pytest.raises(ValueError):
        (tmp_path / "b.csv").write_text("a\n1\n")
        S.read_results(spark, f"{tmp_path}/b.csv", "csv")
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.txt").write_text('{"error_msg": "from json"}')
    (tmp_path / "log/b.txt").write_text("l1\nl2")
    logs = S.read_logs(spark, f"{tmp_path}/log")
    path = next(r.path for r in logs.collect() if r.path.endswith("a.txt"))
    cut = spark.createDataFrame([(1, path, "Limiting Reason To 3000 chars|x"), (2, "none", "full")], "row_id int, log_path string, reason string")
    assert {r.row_id: r.reason for r in S.with_full_reasons(cut, logs).collect()} == {1: "from json", 2: "full"}
    (tmp_path / "map.json").write_text('{"r1": ["a", "b"], "r2": []}')
    assert sorted(map(tuple, S.change_map(spark, f"{tmp_path}/map.json").collect())) == [("r1", 0, "a"), ("r1", 1, "b")]
    S.publish(spark, "v1", f"file://{tmp_path}/current")
    S.publish(spark, "v2", f"file://{tmp_path}/current")
    assert S.published(spark, f"file://{tmp_path}/current") == "v2"
    S.write_by_cluster(spark.createDataFrame([(1, "A"), (2, " ")], "x int, cluster_name string"), f"file://{tmp_path}/out")
    assert [p.name for p in (tmp_path / "out").iterdir() if p.is_dir()] == ["cluster=A"]


def test_render_and_models():
    assert render.cell(["<i>", 1234]) == "<ul><li>&lt;i&gt;</li><li>1,234</li></ul>" and render.bars([]) == ""
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert M.retried(flaky, sleep=lambda s: None) == "ok"
    assert M.halved(lambda x: x if len(x) < 3 else 1 / 0, list(range(8))) == list(range(8))


def test_queue_works_in_order_and_goes_on_after_failures(spark, tmp_path):
    import time

    from faultline.streaming.queue import JobQueue

    queue, seen = JobQueue(spark, f"file://{tmp_path}/q"), []

    def work(run):
        seen.append(run)
        if run == "bad":
            raise ValueError("no data")
        if run == "slow":
            time.sleep(3)

    queue.add(["a", "bad", "a", "other"])
    queue.add(["a", "slow"])
    out = queue.drain(work, lambda r: r != "other", limit=1.0)
    assert out == [("a", "done"), ("bad", "failed"), ("other", "skipped"), ("slow", "late")]
    assert seen == ["a", "bad", "slow"] and queue.pending().count() == 0
    assert queue.requeue() == ["bad", "slow"]
    assert sorted(r.run_id for r in queue.pending().collect()) == ["bad", "slow"] and queue.failures().count() == 0


def test_marts_are_kept_by_name(spark, tmp_path):
    from faultline.sources import cache

    store, built = cache.MartCache(spark, f"file://{tmp_path}/m"), []

    def build(n):
        built.append(n)
        return spark.range(n)

    assert store.get("x", lambda: build(3)).count() == 3 and store.get("x", lambda: build(4)).count() == 3
    assert store.get("x", lambda: build(5), refresh=True).count() == 5 and built == [3, 5]
    a, b = spark.range(4), spark.range(4).orderBy(F.col("id").desc())
    assert cache.input_key(a, "id") == cache.input_key(b, "id") != cache.input_key(spark.range(5), "id")
    (tmp_path / "c.yaml").write_text("a: 1\nb: [x]\n")
    assert cache.read_config(str(tmp_path / "c.yaml")) == {"a": 1, "b": ["x"]}


def test_client_answers_nested_or_nothing(spark, tmp_path):
    import asyncio

    from faultline.plans.client import RegressionClient, TooManyRows, nested

    engine = Engine(spark, results(spark), f"file://{tmp_path}/state")
    client = RegressionClient(engine)
    answer = asyncio.run(client.cluster_info_async(OLD, NEW))
    assert answer["status"] == 200 and sum(len(c) for t in answer["type"].values() for r in t.values() for c in r.values()) == 40
    assert client.cluster_info(NEW, OLD) is answer and len(answer["model"]["m"]) == 40
    engine.results = None
    assert client.cluster_info(NEW, OLD) is answer and client.cluster_info(NEW, OLD, force=True) == {}
    with pytest.raises(TooManyRows):
        nested(results(spark), most=3)


def test_repairs_chain_names_and_lose_no_row(spark):
    from faultline.operators import dedupe as D

    assert D.rename_chain([("a", "b", "a"), ("b", "c", "c"), ("c", "a", "a"), ("d", "e", "e")]) == {"b": "c", "a": "c", "d": "e"}
    rows = spark.createDataFrame([(k, "t", f"n{k % 4}", [1.0, 0.02 * (k % 4)]) for k in range(12)] + [(99, "u", "z", [1.0, 0.0])], "row_id long, type string, cluster_name string, embedding array<double>")
    out = D.deduplicated(rows, A.centroids(rows))
    assert out.count() == 13 and {(r.type, r.cluster_name) for r in out.collect()} == {("t", "n0"), ("u", "z")}


def test_reports_and_jobs(spark, tmp_path):
    jobs = spark.createDataFrame([(NEW, "RUNNING"), ("ALFA-v2.30.0.250103103000_3-auto", "RUNNING"), ("BETA-x", "RUNNING")], "run_id string, state string")

    class Jobs:
        def jobs(self):
            return jobs

    engine = Engine(spark, results(spark), f"file://{tmp_path}/state")
    got = {r.run_id: (r.status, r.failed) for r in engine.running_jobs(Jobs(), "ALFA", "auto").collect()}
    assert got == {NEW: ("ok", 40), "ALFA-v2.30.0.250103103000_3-auto": ("no_data", None)}
    rows = engine.run_clusters(NEW).cache()
    names = engine.write_reports(f"file://{tmp_path}/r", "<t>", rows)
    assert names == ["index", "model", "runtime", "soc", "stability", "type"]
    assert "&lt;t&gt;" in "".join(r.value for r in spark.read.text(f"file://{tmp_path}/r/index").collect())
    assert engine.health()["status"] == "ok"
    assert engine.sparse_encode(spark.createDataFrame([(1, "Crash in node")], "row_id long, text string")).count() == 3
    changes = spark.createDataFrame([("r", "http://A", "m<", 1), ("r", "http://a", "n", 2), (None, None, "o", 3)], "repository string, url string, message string, pos long")
    assert "m&lt;" in engine.changes_page(changes) and ">n<" not in engine.changes_page(changes)


def test_service_answers_requests(spark, tmp_path):
    import io
    import json

    from faultline.service import Service
    from faultline.streaming.queue import JobQueue

    engine = Engine(spark, results(spark), f"file://{tmp_path}/state")
    service = Service(engine, JobQueue(spark, f"file://{tmp_path}/q"))

    def ask(method, path, body=None, query=""):
        raw, seen = json.dumps(body or {}).encode(), []
        out = service({"REQUEST_METHOD": method, "PATH_INFO": path, "QUERY_STRING": query, "CONTENT_LENGTH": str(len(raw)), "CONTENT_TYPE": "application/json", "wsgi.input": io.BytesIO(raw)}, lambda s, h: seen.append((s, dict(h)["Content-Type"])))
        text = b"".join(out).decode()
        return seen[0][0][:3], json.loads(text) if "json" in seen[0][1] else text

    assert ask("GET", "/api/health")[1]["data"]["status"] == "ok"
    assert ask("GET", "/regression")[1].count("<input") == 2 and ask("GET", "/nowhere")[0] == "404"
    assert ask("POST", "/api/get_previous_run_ids/", {})[0] == "400"
    assert ask("POST", "/api/get_previous_run_ids/", {"run_id": NEW})[1]["data"]["previous_run_id"] == OLD
    status, answer = ask("GET", "/api/get_error_cluster_name/", query="_type=inference&runtime=cpu&error=Verifier+failed+at+12+ms")
    assert status == "200" and answer["data"]["cluster_name"] == "VerifierFailed" and len(answer["data"]["error_group_id"]) == 10
    assert ask("POST", "/api/consolidated_report_regression_analysis/", {"run_ids": ["r2", "r1", "r2"]})[1]["data"]["waiting"] == ["r2", "r1"]
    assert ask("POST", "/api/sparse/encode/", {"texts": ["crash here", "!"]})[1]["data"][1] == {}
    assert ask("POST", "/api/initiate_issue_grouping/", {"run_id": "none"})[1]["data"]["status"] == 404


def test_report_command_writes_pages(spark, tmp_path):
    from faultline import report

    results(spark).withColumn("cluster_class", F.lit("sdk_issue")).write.parquet(f"{tmp_path}/results")
    arguments = ["--results", f"{tmp_path}/results", "--release", "2.30.0", "--output", f"file://{tmp_path}/out", "--keep-summaries"]
    assert report.main(arguments) == ["index", "model", "runtime", "soc", "stability", "type", "summaries"]
    assert spark.read.json(f"file://{tmp_path}/out/summaries").where("rank = 1").count() > 0
