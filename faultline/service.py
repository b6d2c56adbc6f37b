"""The engine as a web service: JSON answers and three plain pages, on the standard library's WSGI."""

from __future__ import annotations

import datetime
import decimal
import html
import json
import time
from collections.abc import Callable, Iterable
from urllib.parse import parse_qs

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.plans.client import RegressionClient, nested
from faultline.plans.engine import Engine
from faultline.sources.connectors import JobService
from faultline.streaming.queue import JobQueue

#: Rows that one answer carries at most; tables read the frames themselves.
MOST = 10_000
PAGES = {"grouping": ("/api/initiate_issue_grouping/", ("run_id",)), "regression": ("/api/get_two_run_ids_cluster_info/", ("run_id_a", "run_id_b")), "classification": ("/api/get_error_cluster_name/", ("_type", "runtime", "error"))}


def _plain(value: object) -> object:
    if isinstance(value, datetime.date | datetime.datetime):
        return value.isoformat()
    return float(value) if isinstance(value, decimal.Decimal) else str(value)


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(MOST).collect()]


class Service:
    """API01 to API10. Each request is answered by the engine's method of that entry; what a request lacks is a 400, what
    goes wrong a 500 with the error's text."""

    def __init__(self, engine: Engine, queue: JobQueue, jobs: JobService | None = None, prefix: str = "", mark: str = "") -> None:
        self.engine, self.queue, self.jobs, self.prefix, self.mark = engine, queue, jobs, prefix, mark
        self.client = RegressionClient(engine)
        self.routes: dict[tuple[str, str], Callable[[dict], object]] = {
            ("GET", "/api/get_error_cluster_name/"): self.cluster_name,
            ("POST", "/api/initiate_issue_grouping/"): self.start_grouping,
            ("POST", "/api/get_two_run_ids_cluster_info/"): lambda a: self.client.cluster_info(a["run_id_a"], a["run_id_b"], bool(a.get("force", False))),
            ("POST", "/api/get_one_run_id_cluster_info/"): self.one_run,
            ("POST", "/api/get_changes_merged_between_two_run_ids/"): lambda a: rows(self.engine.changes_between(a["run_id_a"], a["run_id_b"])),
            ("POST", "/api/consolidated_report_regression_analysis/"): self.queue_reports,
            ("POST", "/api/get_previous_run_ids/"): lambda a: (rows(self.engine.previous_runs(a["run_id"])) or [{}])[0],
            ("GET", "/api/get_running_jobs/"): lambda a: rows(self.engine.running_jobs(self.jobs, self.prefix, self.mark)) if self.jobs else [],
            ("GET", "/api/stability/"): lambda a: rows(self.engine.stability()),
            ("POST", "/api/sparse/encode/"): self.encode,
            ("GET", "/api/health/"): lambda a: self.engine.health(),
        }

    def cluster_name(self, asked: dict) -> dict:
        """API01, SRC18: the cluster of one error, and the id of its group."""
        found = self.engine.lookup(asked["_type"], asked["error"])
        key = T.cluster_key(F.col("cluster_name"), F.col("type"), F.lit(asked["runtime"]))
        return (rows(found.withColumn("error_group_id", F.coalesce(key, F.lit("")))) or [{}])[0]

    def start_grouping(self, asked: dict) -> dict:
        """API02: the run's failures are grouped and stored; a run without rows is told apart."""
        if self.engine.run(asked["run_id"]).isEmpty():
            return {"status": 404, "run_id": asked["run_id"], "rows": 0}
        return {"status": 200, "run_id": asked["run_id"], "rows": self.engine.process_run(asked["run_id"]).count()}

    def one_run(self, asked: dict) -> dict:
        """API06: a run's clusters; with the run before, whether its tests failed there, too."""
        before = (rows(self.engine.previous_runs(asked["run_id"])) or [{}])[0].get("previous_run_id")
        return {"status": 200, "previous_run_id": before, **nested(self.engine.run_clusters(asked["run_id"], before))}

    def queue_reports(self, asked: dict) -> dict:
        """API05."""
        self.queue.add([str(r) for r in asked["run_ids"]])
        return {"status": 202, "waiting": [r["run_id"] for r in self.queue.pending().orderBy("place").collect()]}

    def encode(self, asked: dict) -> list[dict]:
        """API09: token weights of each text."""
        texts = self.engine.spark.createDataFrame([(k, str(t)) for k, t in enumerate(asked["texts"])], "row_id long, text string")
        out: list[dict] = [{} for _ in asked["texts"]]
        for r in self.engine.sparse_encode(texts).collect():  # of one request's texts
            out[r["row_id"]][r["token"]] = r["weight"]
        return out

    def page(self, name: str) -> str:
        """API10: a form for one of the entries."""
        path, fields = PAGES[name]
        inputs = "".join(f"<label>{html.escape(f)} <input name='{html.escape(f)}'></label> " for f in fields)
        links = " ".join(f"<a href='/{n}'>{n}</a>" for n in PAGES)
        method = "get" if ("GET", path) in self.routes else "post"
        return f"<!doctype html><title>{name}</title><p>{links}</p><h1>{name}</h1><form action='{path}' method='{method}'>{inputs}<button>Go</button></form>"

    def __call__(self, environ: dict, start: Callable) -> Iterable[bytes]:
        began, method, path = time.perf_counter(), environ["REQUEST_METHOD"], environ.get("PATH_INFO", "/")
        name = path.strip("/") or "grouping"
        if method == "GET" and name in PAGES:
            start("200 OK", [("Content-Type", "text/html; charset=utf-8")])
            return [self.page(name).encode()]
        entry = self.routes.get((method, path if path.endswith("/") else f"{path}/"))
        if entry is None:
            status, body = "404 Not Found", {"error_message": "no such entry"}
        else:
            try:
                status, body = "200 OK", {"data": entry(self._asked(environ))}
            except KeyError as error:
                status, body = "400 Bad Request", {"error_message": f"{error.args[0]} is missing"}
            except Exception as error:
                status, body = "500 Internal Server Error", {"error_message": str(error)}
        body["time_taken"] = round(time.perf_counter() - began, 3)
        start(status, [("Content-Type", "application/json")])
        return [json.dumps(body, default=_plain).encode()]

    @staticmethod
    def _asked(environ: dict) -> dict:
        if environ["REQUEST_METHOD"] == "GET":
            return {k: v[0] for k, v in parse_qs(environ.get("QUERY_STRING", ""), keep_blank_values=True).items()}
        raw = environ["wsgi.input"].read(int(environ.get("CONTENT_LENGTH") or 0)).decode()
        if "form" in environ.get("CONTENT_TYPE", ""):
            return {k: v[0] for k, v in parse_qs(raw, keep_blank_values=True).items()}
        return json.loads(raw or "{}")
