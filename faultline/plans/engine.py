"""The engine's entry points: what a service would expose, as methods that return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import runs as R
from faultline.functions import text as T
from faultline.operators import cluster as C
from faultline.operators import models as M
from faultline.operators import regress as G
from faultline.operators import reports as P
from faultline.plans import cascade, marts, render
from faultline.sources.cache import MartCache
from faultline.sources.connectors import JobService
from faultline.streaming.centroids import CentroidStore


class Engine:
    """Over one table of results, a centroid store, and tables of changes."""

    def __init__(self, spark: SparkSession, results: DataFrame, folder: str, changes: DataFrame | None = None) -> None:
        self.spark, self.results, self.changes = spark, results, changes
        self.store = CentroidStore(spark, folder)

    def run(self, run_id: str) -> DataFrame:
        return self.results.where(F.col("run_id") == run_id)

    def lookup(self, kind: str, text: str) -> DataFrame:
        """API01: the cluster of one text, from the store, else from its own rules."""
        row = self.spark.createDataFrame([(0, kind, text)], "row_id long, type string, reason string")
        return cascade.analyze(row, self.store.centroids()).select("type", "cluster_name", "assigned_by", "cluster_class")

    def process_run(self, run_id: str) -> DataFrame:
        """API02: clusters a run's failures and adds them to the store, once."""
        rows = self.run_clusters(run_id)
        done = self.store.ledger().where(F.col("run_id") == run_id).limit(1).count()
        if not done:
            self.store.apply(rows.select("run_id", "type", "cluster_name", "embedding", "text"), 0)
        return rows

    def run_clusters(self, run_id: str, previous: str | None = None) -> DataFrame:
        """API06: a run's failures with clusters, and whether their tests failed in the run before."""
        failed = G.failures(self.run(run_id)).drop("cluster_name", "cluster_class")
        rows = cascade.analyze(failed, self.store.centroids())
        return G.with_previous_failure(rows, self.run(previous)) if previous else rows

    def regressions(self, new: str, old: str) -> DataFrame:
        """API03: clustered regressions between two runs; the newer id, by embedded time, is the new one."""
        new, old = self.newer_first(new, old)
        found = G.regressions(self.run(new), self.run(old)).dropDuplicates(["row_id"]).drop("cluster_name", "cluster_class")
        return cascade.analyze(found, self.store.centroids())

    def newer_first(self, a: str, b: str) -> tuple[str, str]:
        """Ties keep the given order."""
        row = self.spark.createDataFrame([(a, b)], "a string, b string").select(R.embedded_time(F.col("a")).alias("x"), R.embedded_time(F.col("b")).alias("y")).first()
        return (b, a) if row["x"] is not None and row["y"] is not None and row["y"] > row["x"] else (a, b)

    def changes_between(self, a: str, b: str, stamp: str = "merged_at") -> DataFrame:
        """API04: changes in (older, newer] by the runs' embedded times."""
        ends = self.spark.createDataFrame([(a, b)], "_a string, _b string").select(R.embedded_time(F.col("_a")).alias("_lo"), R.embedded_time(F.col("_b")).alias("_hi"))
        return G.changes_between(self.changes.join(F.broadcast(ends)), F.col("_lo"), F.col("_hi"), stamp).drop("_lo", "_hi")

    def queue(self, ids: DataFrame) -> DataFrame:
        """API05: ids that aren't processed yet."""
        return G.pending(ids.select("run_id").distinct(), self.store.ledger(), "run_id")

    def previous_runs(self, run_id: str) -> DataFrame:
        """API07, J14: the previous run, the previous valid one and the previous release."""
        runs, percents = G.run_table(self.results), G.completion(self.results, "run_id")
        out = G.previous_runs(runs).join(G.valid_previous_runs(runs, percents).withColumnRenamed("previous_run_id", "previous_valid"), "run_id").join(G.previous_releases(runs), "run_id")
        return out.where(F.col("run_id") == run_id)

    def search(self, queries: DataFrame, least: float = cascade.KNOWN) -> DataFrame:
        """CL04, CL05: the best stored cluster of each query (row_id, type, text, and embedding if it has one): cluster_name
        is NULL where none is similar enough."""
        rows = queries if "embedding" in queries.columns else M.hashed_embedding(queries, "text")
        blank = F.lit(None).cast("string")
        open_rows = rows.select("row_id", "type", "text", "embedding", blank.alias("cluster_name"), blank.alias("assigned_by"))
        return cascade.known(open_rows, self.store.centroids(), least).select("row_id", "type", "cluster_name", "already_seen")

    def all_clusters(self, kind: str | None = None) -> DataFrame:
        """CL05: the names of the stored clusters."""
        names = self.store.centroids().select("type", "cluster_name")
        return names if kind is None else names.where(F.col("type") == kind)

    def sparse_encode(self, texts: DataFrame) -> DataFrame:
        """API09, X02: (row_id, token, weight) of texts (row_id, text)."""
        return C.token_weights(texts, "row_id", T.sparse_tokens(F.col("text")))

    def health(self) -> dict:
        """API09: whether the session answers, and how much is stored."""
        return {"status": "ok" if self.spark.range(1).count() == 1 else "down", "clusters": self.store.centroids().count()}

    def stability(self, threshold: float = 0.5) -> DataFrame:
        """API08: rates by type, flagged ones first."""
        return marts.flagged_first(self.results, threshold).orderBy("place")

    def running_jobs(self, jobs: JobService, prefix: str, mark: str, threshold: float = 0.5) -> DataFrame:
        """API08, F13, F19: each running job of a prefix and mark, with its status, tests, failures and flagged types.
        All jobs are looked up in one pass over the results."""
        wanted = jobs.jobs().where(F.col("run_id").startswith(prefix) & F.col("run_id").contains(mark)).select("run_id", "state").distinct()
        if marts.job_status(self.results) != "ok":
            return wanted.select("run_id", "state", F.lit(marts.job_status(self.results)).alias("status"), *[F.lit(None).cast("long").alias(c) for c in ("total", "failed", "flagged")])
        own = self.results.join(wanted, "run_id", "left_semi")
        by_type = own.groupBy("run_id", "type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("result") == "FAIL").alias("failed"), F.count_if(F.col("result").isin("PARENT_FAIL", "NOT_RUN")).alias("out"))
        rate = F.when(F.col("total") > F.col("out"), F.col("failed") / (F.col("total") - F.col("out"))).otherwise(0.0)
        totals = by_type.groupBy("run_id").agg(F.sum("total").alias("total"), F.sum("failed").alias("failed"), F.count_if((rate >= threshold) & F.col("type").isNotNull()).alias("flagged"))
        return wanted.join(totals, "run_id", "left").select("run_id", "state", F.when(F.col("total").isNull(), "no_data").otherwise("ok").alias("status"), "total", "failed", "flagged")

    def report(self, title: str, rows: DataFrame) -> str:
        """RP01, RP03, RP05, RP06: the main page over clustered rows."""
        counted = G.report_rows(rows).persist()
        try:
            sections = [render.table(P.overview(counted), "Overview"), render.table(P.matrix(counted), "Segments by runtime"), render.table(marts.type_matrix(counted).orderBy("type", "runtime"), "Types by runtime"), render.table(marts.consolidated(counted).orderBy("report_row", "label"), "Release")]
            lists = marts.dashboard(counted)
            for d in ("type", "runtime", "soc", "model", "cluster_name"):
                of = lists.where(F.col("dimension") == d).orderBy("rank").drop("dimension")
                sections += [render.table(of, d), render.bars((r["key"], r["n"]) for r in of.limit(marts.SHOWN).collect())]
            return render.page(title, sections)
        finally:
            counted.unpersist()

    def detail_pages(self, rows: DataFrame, most: int = render.SHOWN) -> dict[str, str]:
        """RP02: a page for types, SoCs, runtimes and models, each with its failures; `most` lines a page."""
        counted = G.report_rows(rows)
        return {d: render.page(f"Failures by {d}", [render.table(marts.detail(counted, d).orderBy("key", "line").limit(most), d)]) for d in ("type", "soc", "runtime", "model")}

    def stability_page(self, threshold: float = 0.5) -> str:
        """RP07: the page of failure rates, and the hosts of what is flagged."""
        return render.page("Stability", [render.table(self.stability(threshold), "Types"), render.table(marts.host_cards(self.results, threshold).orderBy("type", "soc", "rank"), "Hosts")])

    def changes_page(self, changes: DataFrame) -> str:
        """RP04, RP08: changes under their repositories, linked."""
        return render.page("Changes", [render.change_list(marts.changes_page(changes).orderBy("repository", "line"))])

    def write_reports(self, folder: str, title: str, rows: DataFrame) -> list[str]:
        """SNK07: the main page and the detail pages as files, written by Spark where `folder` is."""
        pages = {"index": self.report(title, rows), **self.detail_pages(rows), "stability": self.stability_page()}
        for name, page in pages.items():
            self.spark.createDataFrame([(page,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/{name}", lineSep="\n")
        return sorted(pages)

    def release_reports(self, cache: MartCache, releases: dict[str, list[str]]) -> dict[str, DataFrame]:
        """RP04, SRC20, SNK10: the consolidated mart of each release's runs; one that is kept already isn't computed
        again."""
        return {name: cache.get(f"release-{name}", lambda ids=ids: marts.consolidated(G.report_rows(self.results.where(F.col("run_id").isin(ids))))) for name, ids in releases.items()}
