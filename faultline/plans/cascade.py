"""The clustering cascade over test types: rules, known clusters, exact and sparse groups, density clusters, repair.

Rows are told apart by row_id throughout, no stage drops a row, and a row keeps the first stage's cluster
(assigned_by names the stage). All types run in one job; a stage that needs pairs of rows works per type on what the
stages before left over.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.functions import vectors as V
from faultline.operators import cluster as C
from faultline.operators import dedupe as D
from faultline.operators import models as M
from faultline.sources.shared import cut
from faultline.sources.shared import cut as cut_off  # where `cut` is a threshold

# Thresholds of the stages.
KNOWN, MERGE, REASSIGN, SPARSE, NEAR, OUTLIER, LOF = 0.82, 0.87, 0.88, 0.80, 0.85, 0.7, 1.5


def seeded(df: DataFrame) -> DataFrame:
    """CL01: texts cleaned and masked; rows without a log, with garbage output or under a named rule have a cluster."""
    clean = df.withColumn("_raw", T.preprocess(T.error_lines(F.col("reason"))))
    name = F.coalesce(T.emptiness(F.col("reason")), F.when(T.garbage_rule(F.col("type"), F.col("_raw")), "GarbageOutput"), F.regexp_replace(T.named_rule(F.col("_raw")), " ", ""))
    return clean.withColumns({"text": T.mask_numbers(F.col("_raw")), "cluster_name": name, "assigned_by": F.when(name.isNotNull(), "rule")}).drop("_raw")


def known(df: DataFrame, cents: DataFrame, least: float = KNOWN, stage: str = "known") -> DataFrame:
    """CL03, CL04: the best stored cluster of a row's type, if similar enough; ties to the least name. Where the store
    has token weights, the score is the hybrid of cosine and scaled sparse product, else the cosine. The state is one
    row per cluster; it is joined by type, and broadcast only where Spark finds it small.

    Rows that a store's clusters took are marked `already_seen`.
    """
    rows = df.where("cluster_name is null and embedding is not null")
    if "weights" in cents.columns:
        texts = rows.groupBy("type", "text").agg(F.min("row_id").alias("row_id"), F.first("embedding").alias("embedding"))
        weights = C.weight_maps(C.token_weights(texts, "row_id", T.sparse_tokens(F.col("text"))), "row_id")
        scored = C.hybrid_scores(texts.join(weights, "row_id", "left"), cents).select("row_id", F.col("cluster_name").alias("k"), F.col("score").alias("s"))
        best = scored.where(F.col("s") >= least).groupBy("row_id").agg(F.min(F.struct((-F.col("s")).alias("s"), "k")).alias("b"))
        named = best.join(texts, "row_id").select("type", "text", F.col("b.k").alias("_k"))
        found = rows.select("row_id", "type", "text").join(named, ["type", "text"]).select("row_id", "_k")
    else:
        u = rows.select("row_id", "type", V.unit(F.col("embedding")).alias("u"))
        scored = u.join(cents.select("type", F.col("cluster_name").alias("k"), "centroid"), "type").select("row_id", "k", V.dot(F.col("u"), F.col("centroid")).alias("s"))
        best = scored.where(F.col("s") >= least).groupBy("row_id").agg(F.min(F.struct((-F.col("s")).alias("s"), "k")).alias("b"))
        found = best.select("row_id", F.col("b.k").alias("_k"))
    return _assigned(df, found, stage).withColumn("already_seen", F.coalesce(F.col("assigned_by") == "known", F.lit(False)))


def _assigned(df: DataFrame, found: DataFrame, stage: str) -> DataFrame:
    """df with the clusters (row_id, _k) that a stage has found for rows without one."""
    out = df.join(found, "row_id", "left")
    fresh = F.col("cluster_name").isNull() & F.col("_k").isNotNull()
    return out.withColumns({"assigned_by": F.when(fresh, F.lit(stage)).otherwise(F.col("assigned_by")), "cluster_name": F.coalesce("cluster_name", "_k")}).drop("_k")


def exact(df: DataFrame) -> DataFrame:
    """CL06 at its default of 100: equal masked texts of a length bin and type, two or more, named by their tokens."""
    rows = df.where("cluster_name is null").select("row_id", "type", "text", T.length_bin(F.col("text")).alias("bin")).where("bin is not null")
    groups = rows.groupBy("type", "text").agg(F.min("row_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    named = M.token_namer(groups, "first", "text")
    found = rows.join(groups.join(named, "first", "left"), ["type", "text"]).select("row_id", F.concat(F.coalesce("name", F.lit("Group")), F.lit("_"), F.col("first").cast("string")).alias("_k"))
    return _assigned(df, found, "exact")


def sparse_groups(pairs: DataFrame, members: DataFrame, least: float = SPARSE) -> DataFrame:
    """CL08: greedy groups of rows by min-max scaled sparse similarity, in row order, two or more. Which rows an
    anchor takes depends on all anchors before, so a type's leftovers (distinct texts only) meet in one task."""
    both = pairs.select("type", "a", "b", "dot").union(pairs.select("type", F.col("b").alias("a"), F.col("a").alias("b"), "dot"))
    w = Window.partitionBy("type", "a")
    scaled = both.withColumns({"lo": F.least(F.lit(0.0), F.min("dot").over(w)), "hi": F.greatest(F.lit(1.0), F.max("dot").over(w))})
    near = scaled.where((F.col("dot") - F.col("lo")) / (F.col("hi") - F.col("lo")) >= least).select(F.col("type").alias("kind"), "a", "b")

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        groups = C.greedy_groups(list(zip(right["a"], right["b"], strict=True)), left["row_id"].tolist())
        sizes = pd.Series(list(groups.values())).value_counts()
        rows = [(r, a) for r, a in groups.items() if sizes[a] >= 2]
        return pd.DataFrame(rows, columns=["row_id", "anchor"]).astype("int64")

    return members.groupBy("type").cogroup(near.groupBy("kind")).applyInPandas(run, "row_id long, anchor long")


def sparse(df: DataFrame) -> DataFrame:
    """CL08, CL09's second step, on one row for each distinct text."""
    left = df.where("cluster_name is null")
    firsts = cut(left.groupBy("type", "text").agg(F.min("row_id").alias("row_id")))
    weights = C.token_weights(firsts, "row_id", T.sparse_tokens(F.col("text"))).join(firsts.select("row_id", "type"), "row_id")
    # Pairs stay inside a type: the token carries it.
    typed = cut(weights).withColumn("token", F.concat("type", F.lit("\x01"), "token"))
    pairs = C.sparse_pairs(typed, "row_id", 0.0).join(firsts.select(F.col("row_id").alias("a"), "type"), "a")
    groups = cut(sparse_groups(pairs, firsts.select("type", "row_id")))
    named = M.token_namer(groups.join(firsts, "row_id"), "anchor", "text")
    of = groups.join(named, "anchor").select("row_id", F.concat("name", F.lit("_"), F.col("anchor").cast("string")).alias("_k"))
    texts = firsts.join(of, "row_id").select("type", "text", "_k")
    return _assigned(df, left.select("row_id", "type", "text").join(texts, ["type", "text"]).select("row_id", "_k"), "sparse")


def dense(df: DataFrame) -> DataFrame:
    """CL10 on the distinct texts that are left, per type."""
    left = df.where("cluster_name is null and embedding is not null")
    firsts = left.groupBy("type", "text").agg(F.min_by("embedding", "row_id").alias("embedding"), F.min("row_id").alias("row_id"))
    labels = C.density_clusters(firsts, "type", "row_id").where("int_cluster >= 0")
    keyed = firsts.join(labels.select("row_id", "int_cluster"), "row_id").withColumn("_key", F.concat("type", F.lit("/"), F.col("int_cluster").cast("string")))
    named = M.token_namer(keyed, "_key", "text")
    of = keyed.join(named, "_key", "left").select("type", "text", F.concat(F.coalesce("name", F.lit("Group")), F.lit("_d"), F.col("int_cluster").cast("string")).alias("_k"))
    return _assigned(df, left.select("row_id", "type", "text").join(of, ["type", "text"]).select("row_id", "_k"), "density")


def centroids(df: DataFrame) -> DataFrame:
    """(type, cluster_name, centroid) of all clustered rows with an embedding."""
    rows = df.where("cluster_name is not null and embedding is not null").withColumn("_key", F.struct("type", "cluster_name"))
    return C.centroids(rows, "_key", "embedding").select("_key.type", "_key.cluster_name", "centroid")


def merged(cents: DataFrame, least: float = MERGE) -> DataFrame:
    """CL12: (type, cluster_name, into) for clusters that greedily join an earlier one of their type. Clusters
    of one type, hundreds at most, meet in one task; rows don't."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("cluster_name").reset_index(drop=True)
        x = np.array([np.asarray(c, float) for c in pdf["centroid"]])
        near = np.argwhere(np.triu(x @ x.T >= least, 1))
        into = C.greedy_groups([tuple(p) for p in near.tolist()], list(range(len(pdf))))
        return pd.DataFrame({"type": pdf["type"], "cluster_name": pdf["cluster_name"], "into": [pdf["cluster_name"][into[k]] for k in range(len(pdf))]})

    return cents.groupBy("type").applyInPandas(run, "type string, cluster_name string, into string")


def relabelled(df: DataFrame, names: DataFrame) -> DataFrame:
    """CL13."""
    return df.join(names, ["type", "cluster_name"], "left").withColumn("cluster_name", F.coalesce("into", "cluster_name")).drop("into")


def reassigned(df: DataFrame, least: float = REASSIGN) -> DataFrame:
    """CL14: rows without a cluster go to the best centroid of their type, if similar enough."""
    return known(df, centroids(df), least, "reassigned")


def outliers(df: DataFrame, key: str = "label", row: str = "vec_id", vector: str = "embedding", k: int = 15, cut: float = LOF, least: float = OUTLIER) -> DataFrame:
    """CL15: rows of a cluster whose local outlier factor is over `cut` and whose cosine to the mean is under
    `least`. Distances are those inside a cluster."""
    near = cut_off(C.neighbours(df, key, row, vector, k))
    reach_of = near.groupBy(F.col("a").alias("b")).agg(F.max("d").alias("kd"))
    density = near.join(reach_of, "b").groupBy("a").agg((1 / (F.avg(F.greatest("kd", "d")) + 1e-10)).alias("lrd"))
    factors = near.join(density.select(F.col("a").alias("b"), F.col("lrd").alias("lb")), "b").groupBy("a").agg(F.avg("lb").alias("lb")).join(density, "a").select(F.col("a").alias(row), (F.col("lb") / F.col("lrd")).alias("lof"))
    return df.join(factors, row).join(C.centroids(df, key, vector), key).where((F.col("lof") > cut) & (V.cosine(F.col(vector), F.col("centroid")) < least)).select(key, row, "lof")


def without_outliers(df: DataFrame) -> DataFrame:
    """CL20's outlier step: rows of density clusters whose text is an outlier of its cluster lose it. Distinct texts are
    compared, not rows."""
    rows = df.where("assigned_by = 'density' and embedding is not null")
    texts = rows.groupBy("type", "cluster_name", "text").agg(F.min("row_id").alias("row_id"), F.min_by("embedding", "row_id").alias("embedding"))
    keyed = cut(texts.withColumn("_key", F.concat_ws("\x01", "type", "cluster_name")))
    out = keyed.join(outliers(keyed, "_key", "row_id").select("row_id"), "row_id", "left_semi").select("type", "cluster_name", "text", F.lit(True).alias("_out"))
    marked = df.join(out, ["type", "cluster_name", "text"], "left")
    gone = F.coalesce("_out", F.lit(False)) & (F.col("assigned_by") == "density")
    return marked.withColumns({"cluster_name": F.when(~gone, F.col("cluster_name")), "assigned_by": F.when(~gone, F.col("assigned_by"))}).drop("_out")


def reclustered(df: DataFrame) -> DataFrame:
    """CL20's last step, X06, X03: rows still without a cluster are grouped by masked text, and named by its tokens."""
    left = df.where("cluster_name is null").select("row_id", "type", "text")
    firsts = cut(left.groupBy("type", "text").agg(F.min("row_id").alias("first")))
    named = M.token_namer(firsts, "first", "text")
    found = firsts.join(named, "first", "left").select("type", "text", F.concat(F.coalesce("name", F.lit("Group")), F.lit("_s"), F.col("first").cast("string")).alias("_k"))
    return _assigned(df, left.join(found, ["type", "text"]).select("row_id", "_k"), "single")


def split_verifier(df: DataFrame, name: str = "VerifierFailed") -> DataFrame:
    """CL21: rows under the rule of that name get sub-clusters."""
    sub = D.subclustered(df, name).select("row_id", F.col("cluster_name").alias("_sub"))
    return df.join(sub, "row_id", "left").withColumn("cluster_name", F.coalesce("_sub", "cluster_name")).drop("_sub")


def classified(df: DataFrame) -> DataFrame:
    """A class for rows that have none: that of the text of their cluster's first row. One aggregate by cluster,
    so a hot cluster is summed up before it moves."""
    first = df.groupBy("type", "cluster_name").agg(M.rule_class(F.min_by("text", "row_id")).alias("_class"))
    out = df.alias("d").join(first.alias("f"), F.col("d.type").eqNullSafe(F.col("f.type")) & F.col("d.cluster_name").eqNullSafe(F.col("f.cluster_name")), "left")
    return out.select("d.*", "f._class").withColumn("cluster_class", F.coalesce("cluster_class", "_class")).drop("_class")


def analyze(df: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """CL23, CL24: the whole cascade. df has row_id, type, reason and, optionally, embedding and cluster_class.

    Rules, stored clusters, exact, sparse and density groups; then repair: similar density clusters merge (CL12, CL13),
    noise goes to the best cluster (CL14), outliers leave theirs and are placed anew (CL15, CL20), what is left is
    grouped by masked text, verifier failures are split (CL21), and near-duplicate names become one (CL18).
    """
    rows = seeded(df.drop("cluster_name"))
    if "embedding" not in rows.columns:
        rows = M.hashed_embedding(rows, "text")
    if "cluster_class" not in rows.columns:
        rows = rows.withColumn("cluster_class", F.lit(None).cast("string"))
    rows = cut(rows.withColumn("already_seen", F.lit(False)))
    if stored is not None:
        rows = cut(known(rows, stored))
    for stage in (exact, sparse, dense):
        rows = cut(stage(rows))
    density = rows.where("assigned_by = 'density'")
    rows = cut(relabelled(rows, merged(centroids(density))))
    for stage in (_placed, without_outliers, _placed, reclustered, split_verifier):
        rows = cut(stage(rows))
    return classified(D.deduplicated(rows, centroids(rows.where("assigned_by <> 'rule'"))))


def _placed(df: DataFrame) -> DataFrame:
    seen = df.select("row_id", F.col("already_seen").alias("_seen"))
    return reassigned(df.drop("already_seen")).drop("already_seen").join(seen, "row_id").withColumnRenamed("_seen", "already_seen")
