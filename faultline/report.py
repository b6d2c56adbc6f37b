"""python -m faultline.report: a release's pages out of a table of results (RP05's command line)."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import models as M
from faultline.plans import cascade
from faultline.plans.engine import Engine
from faultline.sources.cache import MartCache, input_key
from faultline.sources.connectors import read_results


def summaries(rows: DataFrame, cache: MartCache | None) -> DataFrame:
    """SNK09, X09: a summary of each cluster; kept under a name that changes with the rows."""

    def build() -> DataFrame:
        return M.summary(rows.where("cluster_name is not null and reason is not null"), "cluster_name", "reason")

    return build() if cache is None else cache.get(f"summaries-{input_key(rows, 'cluster_name', 'reason')}", build)


def main(arguments: list[str] | None = None) -> list[str]:
    parser = argparse.ArgumentParser(description="Writes the pages of a release's regressions.")
    parser.add_argument("--results", required=True, help="table of results")
    parser.add_argument("--release", required=True, help="what run ids of the release contain")
    parser.add_argument("--output", required=True, help="folder of the pages")
    parser.add_argument("--format", default="parquet", help="of the table")
    parser.add_argument("--no-summaries", action="store_true")
    parser.add_argument("--keep-summaries", action="store_true", help="reuse those of the same rows, beside the pages")
    asked = parser.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    results = read_results(spark, asked.results, asked.format)
    if "bu" not in results.columns:
        from faultline.functions.runs import segment

        results = results.withColumn("bu", segment(F.col("run_id")))
    engine = Engine(spark, results, f"{asked.output}/state")
    own = results.where(F.col("run_id").contains(asked.release))
    from faultline.operators.regress import failures

    rows = cascade.analyze(failures(own).drop("cluster_name", "cluster_class"))
    written = engine.write_reports(asked.output, asked.release, rows)
    if not asked.no_summaries:
        kept = MartCache(spark, f"{asked.output}/marts") if asked.keep_summaries else None
        summaries(rows, kept).write.mode("overwrite").json(f"{asked.output}/summaries")
        written.append("summaries")
    return written


if __name__ == "__main__":
    main()
