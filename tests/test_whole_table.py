"""Queries that must use every event, not those of one run, on small tables against brute force."""

import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from faultline import catalog
from faultline.functions import text as T
from faultline.sources.views import RESULTS_SQL

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """The first 240 events: 20 of each of the twelve runs."""
    folder = str(tmp_path_factory.mktemp("small"))
    db = duckdb.connect()
    db.sql(f"COPY (SELECT * FROM '{EVENTS}' ORDER BY event_id LIMIT 240) TO '{folder}/events.parquet'")
    rows = db.sql(f"WITH events AS (SELECT * FROM '{folder}/events.parquet'), {RESULTS_SQL} SELECT row_id, run_no, result, reason, cluster_name FROM results").fetchall()
    return folder, rows


def test_cascade_and_sparse_groups_hold_every_failure(spark, small):
    folder, rows = small
    failed = {r[0]: r[1] for r in rows if r[2] == "FAIL"}
    assert len(set(failed.values())) > 4
    assert sorted(r.row_id for r in catalog.queries()["cl23_cascade"](spark, folder).collect()) == sorted(failed)
    assert sum(r.n for r in catalog.queries()["cl08_sparse_groups"](spark, folder).collect()) == len(failed)


def sparse_weights(texts):
    """Unit-length TF-IDF weights of each text that has tokens."""
    counts = {k: Counter(w.lower() for w in re.findall("[a-zA-Z][a-zA-Z0-9]+", t)) for k, t in texts.items()}
    counts = {k: c for k, c in counts.items() if c}
    df = Counter(w for c in counts.values() for w in c)
    out = {}
    for k, c in counts.items():
        raw = {w: n * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out[k] = {w: x / norm for w, x in raw.items()}
    return out


def test_sparse_pairs_of_all_runs(spark, small):
    folder, rows = small
    firsts = {}
    for row, _, _, reason, _ in rows:
        firsts[reason] = min(row, firsts.get(reason, row))
    cleaned = spark.createDataFrame([(row, reason) for reason, row in firsts.items()], "row int, reason string").select("row", T.for_sparse(F.col("reason")).alias("text"))
    weights = sparse_weights({r.row: r.text for r in cleaned.collect()})
    want = {}
    for a in weights:
        for b in weights:
            dot = sum(x * weights[b].get(w, 0) for w, x in weights[a].items())
            if a < b and dot >= 0.2:
                want[a, b] = dot
    got = {(r.a, r.b): r.dot for r in catalog.queries()["j17_sparse_pairs"](spark, folder).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_sparse_pairs_of_classes_are_those_of_rows(spark, monkeypatch):
    from faultline.operators import cluster as C

    monkeypatch.setattr(C, "CHUNK", 2)
    monkeypatch.setattr(C, "PORTIONS", 2)
    weights = {k: {"a": 1.0} if k % 3 == 0 else {"a": 0.6, "b": 0.8} if k % 3 == 1 else {f"c{k}": 1.0} for k in range(30)}
    df = spark.createDataFrame([(k, t, w) for k, own in weights.items() for t, w in own.items()], "row_id long, token string, weight double")
    dots = {(a, b): sum(x * weights[b].get(t, 0.0) for t, x in weights[a].items()) for a in weights for b in weights if weights[a].keys() & weights[b].keys()}
    got = [(r.a, r.b, round(r.dot, 9)) for r in C.sparse_pairs(df, "row_id", 0.5).collect()]
    assert sorted(got) == sorted((a, b, round(d, 9)) for (a, b), d in dots.items() if a < b and d >= 0.5)
    products, members = C.sparse_classes(df, "row_id")
    assert products.count() == 4 + 10 and products.where("ca = 0").count() == 2  # not 20 * 20 + 10 pairs of rows
    assert C.spelt_out(products, members, "dot").count() == len(dots)


def test_minmax_pairs_are_rounded_and_streamed_before_they_are_spelt_out(spark, small):
    folder, _ = small
    got = catalog.queries()["w05_anchor_minmax"](spark, folder)
    n = len({r.a for r in got.collect()})
    assert n and got.count() > n
    plan = got._jdf.queryExecution().executedPlan().toString().split("\n")
    plan = plan[: next((k for k, line in enumerate(plan) if "Initial Plan" in line), len(plan))]
    explodes = [k for k, line in enumerate(plan) if "Generate explode(" in line][:2]
    assert not any("round(" in line for line in plan[: explodes[1]])  # once for a pair of classes, not for each pair of rows
    assert ["*(" in plan[k] for k in explodes] == [True, False]  # compiled together they hold all pairs of two portions
