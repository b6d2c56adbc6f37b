"""Repair of clusters after they are found: near-duplicate names, equal names, outliers, and what is left over.

A clustered table has row_id, type, text, cluster_name and embedding; clusters are few against rows, so pairs are of
clusters only and are blocked by type.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import vectors as V
from faultline.operators import models as M

# Candidates, their confirmation, the least number of clusters, batches.
CANDIDATE, CONFIRMED, LEAST_CLUSTERS, PAIRS_PER_CALL, LOGS_PER_BATCH, ROUNDS = 0.85, 0.92, 3, 5, 30, 5


def candidate_pairs(cents: DataFrame, least: float = CANDIDATE, least_clusters: int = LEAST_CLUSTERS) -> DataFrame:
    """Pairs of a type's clusters (type, a, b, similarity, rank), the most similar first; none for a type with
    fewer than `least_clusters`. Clusters meet by type, so no side is broadcast whatever the number of types."""
    many = cents.groupBy("type").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_clusters).select("type")
    of = cents.join(many, "type", "left_semi")
    a, b = of.select("type", F.col("cluster_name").alias("a"), F.col("centroid").alias("ca")), of.select("type", F.col("cluster_name").alias("b"), F.col("centroid").alias("cb"))
    pairs = a.join(b, "type").where("a < b").select("type", "a", "b", V.cosine(F.col("ca"), F.col("cb")).alias("similarity")).where(F.col("similarity") >= least)
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy(F.col("similarity").desc(), "a", "b")))


def confirmed(pairs: DataFrame, sizes: DataFrame, least: float = CONFIRMED) -> DataFrame:
    """X07's default: a pair is a duplicate if its similarity is at least `least`; the name of the larger is kept.
    A service would take pairs in batches of PAIRS_PER_CALL by rank; the batch number is returned for it."""
    size = lambda side: sizes.select("type", F.col("cluster_name").alias(side), F.col("n").alias(f"n{side}"))
    both = pairs.join(size("a"), ["type", "a"]).join(size("b"), ["type", "b"])
    keep = M.merge_name(F.col("a"), F.col("na"), F.col("b"), F.col("nb"))
    return both.select("type", "a", "b", "similarity", "rank", F.floor((F.col("rank") - 1) / PAIRS_PER_CALL).cast("int").alias("batch"), (F.col("similarity") >= least).alias("is_duplicate"), keep.alias("keep"))


def rename_chain(pairs: list[tuple[str, str, str]]) -> dict[str, str]:
    """CL18's fold over confirmed (a, b, keep) in order: names are first followed to what they have become, so chains
    end at one name and no name returns to itself."""
    into: dict[str, str] = {}

    def now(name: str) -> str:
        while name in into:
            name = into[name]
        return name

    for a, b, keep in pairs:
        a, b, keep = now(a), now(b), now(keep)
        keep = keep if keep in (a, b) else a
        drop = b if keep == a else a
        if drop != keep:
            into[drop] = keep
    return {name: now(name) for name in into}


def renames(found: DataFrame) -> DataFrame:
    """(type, cluster_name, into) of confirmed pairs; a type's pairs, which are of clusters, meet in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        chain = rename_chain(list(zip(pdf["a"], pdf["b"], pdf["keep"], strict=True)))
        return pd.DataFrame({"type": pdf["type"].iloc[0], "cluster_name": list(chain), "into": list(chain.values())})

    return found.where("is_duplicate").select("type", "rank", "a", "b", "keep").groupBy("type").applyInPandas(run, "type string, cluster_name string, into string")


def sizes_of(df: DataFrame) -> DataFrame:
    return df.where("cluster_name is not null").groupBy("type", "cluster_name").agg(F.count(F.lit(1)).alias("n"))


def deduplicated(df: DataFrame, cents: DataFrame, least: float = CANDIDATE, sure: float = CONFIRMED) -> DataFrame:
    """CL18: near-duplicate clusters of a type get one name."""
    names = renames(confirmed(candidate_pairs(cents, least), sizes_of(df), sure))
    return df.join(names, ["type", "cluster_name"], "left").withColumn("cluster_name", F.coalesce("into", "cluster_name")).drop("into")


def analysed(df: DataFrame, misclassified: Callable[[Column], Column] | None = None) -> DataFrame:
    """(type, cluster_name, name, misclassified row ids) of each cluster: a name from its tokens, and the rows that
    `misclassified`, a condition on the text, tells apart; by default none."""
    rows = df.where("cluster_name is not null").withColumn("_key", F.struct("type", "cluster_name"))
    wrong = F.lit(False) if misclassified is None else F.coalesce(misclassified(F.col("text")), F.lit(False))
    ids = rows.groupBy("_key").agg(F.array_sort(F.collect_list(F.when(wrong, F.col("row_id")))).alias("misclassified"))
    return ids.join(M.token_namer(rows, "_key", "text"), "_key", "left").select("_key.type", "_key.cluster_name", "name", "misclassified")


def merged_same_names(df: DataFrame, names: DataFrame) -> DataFrame:
    """AG21, CL19, CL20's second step: clusters of a type that were given one name become the first of them, by name,
    and carry that name; rows listed as misclassified lose their cluster."""
    kept = names.withColumn("final", F.coalesce(F.col("name"), F.col("cluster_name"))).select("type", "cluster_name", "final", "misclassified")
    out = df.join(kept, ["type", "cluster_name"], "left")
    loses = F.coalesce(F.array_contains("misclassified", F.col("row_id")), F.lit(False))
    return out.withColumn("cluster_name", F.when(~loses, F.coalesce("final", "cluster_name"))).drop("final", "misclassified")


def pair_outliers(df: DataFrame, kind: str, a: str, b: str, least: float = 0.7) -> DataFrame:
    """CL19: two clusters as one: (merged_name, row_id, is_outlier) of their rows; outliers are rows whose cosine to the
    mean of both is under `least`."""
    from faultline.operators.cluster import centroids

    rows = df.where((F.col("type") == kind) & F.col("cluster_name").isin(a, b) & F.col("embedding").isNotNull())
    mean = centroids(rows.withColumn("_one", F.lit(1)), "_one", "embedding").select("centroid")
    counts = rows.agg(F.count_if(F.col("cluster_name") == a).alias("na"), F.count_if(F.col("cluster_name") == b).alias("nb"))
    name = M.merge_name(F.lit(a), F.col("na"), F.lit(b), F.col("nb"))
    # Both are one row.
    return rows.join(F.broadcast(mean)).join(F.broadcast(counts)).select(name.alias("merged_name"), "row_id", (V.cosine(F.col("embedding"), F.col("centroid")) < least).alias("is_outlier"))


def subclustered(df: DataFrame, name: str, batch: int = LOGS_PER_BATCH) -> DataFrame:
    """CL21, X06: rows of the cluster `name` are split by their masked texts: (row_id, cluster_name, batch).

    A registry of sub-clusters is carried over all batches: a masked text has one name wherever its rows stand, which
    a table of distinct masked texts gives, with no fold over batches; the batch number is what a service would get.
    Rows whose masked text is theirs alone keep the name, so none is lost.
    """
    from faultline.functions.text import mask_numbers

    rows = df.where(F.col("cluster_name") == name).select("row_id", "type", mask_numbers(F.col("text")).alias("_m"))
    groups = rows.groupBy("type", "_m").agg(F.count(F.lit(1)).alias("_n"), F.min("row_id").alias("_first"))
    order = Window.partitionBy("type").orderBy("_first")
    # Distinct masked texts of one cluster, not rows, are numbered.
    numbered = groups.withColumns({"_k": F.row_number().over(order), "batch": F.floor((F.row_number().over(order) - 1) / batch).cast("int")})
    sub = F.when(F.col("_n") >= 2, F.concat(F.lit(f"{name}_"), F.col("_first").cast("string"))).otherwise(F.lit(name))
    return rows.join(numbered, ["type", "_m"]).select("row_id", sub.alias("cluster_name"), "batch")
