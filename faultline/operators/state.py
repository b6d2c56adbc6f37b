"""State that runs update: centroids by exponential average, the cluster dimension, the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import vectors as V

# Fixed value: the weight of the stored centroid.
KEEP = 0.9


def updated_centroids(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """CL22: known clusters move by an exponential average and are normalised again, new ones are added, others stay."""
    a = old.select(*keys, F.col("centroid").alias("_old"))
    b = new.select(*keys, F.col("centroid").alias("_new"))
    moved = V.unit(F.zip_with("_old", "_new", lambda x, y: KEEP * x + (1 - KEEP) * y))
    return a.join(b, keys, "full_outer").select(*keys, F.when(F.col("_old").isNull(), F.col("_new")).when(F.col("_new").isNull(), F.col("_old")).otherwise(moved).alias("centroid"))


def updated_weights(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """CL22's sparse half: token weights (maps) of known clusters move by the same average, a token that one side lacks
    counting as 0 there, and aren't normalised again; new clusters are added, others stay."""
    a, b = old.select(*keys, F.col("weights").alias("_old")), new.select(*keys, F.col("weights").alias("_new"))
    zero = F.lit(0.0)
    moved = F.map_zip_with("_old", "_new", lambda _, x, y: KEEP * F.coalesce(x, zero) + (1 - KEEP) * F.coalesce(y, zero))
    return a.join(b, keys, "full_outer").select(*keys, F.when(F.col("_old").isNull(), F.col("_new")).when(F.col("_new").isNull(), F.col("_old")).otherwise(moved).alias("weights"))


def added_members(members: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK05, CL22's membership: rows that aren't there yet are added."""
    return members.unionByName(new.select(members.columns).distinct().join(members, keys, "left_anti").select(members.columns))


def upserted(dimension: DataFrame, incoming: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Rows matched on trimmed, lower-cased keys get a new updated_at, others are added; incoming rows of one key count once."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.select("*", *[F.lower(F.trim(F.col(k))).alias(f"_{k}") for k in keys])

    marks = [f"_{k}" for k in keys]
    fresh = keyed(incoming).groupBy(*marks).agg(*[F.min(k).alias(f"n_{k}") for k in keys])
    joined = keyed(dimension).join(fresh, marks, "full_outer")
    return joined.select(*[F.coalesce(F.col(k), F.col(f"n_{k}")).alias(k) for k in keys], F.coalesce("created_at", now).alias("created_at"), F.when(F.col(f"n_{keys[0]}").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"))


def filled_class(dimension: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """SNK03: a class is filled in only where there was none."""
    return dimension.join(classes.select(key, F.col("cluster_class").alias("_c")), key, "left").withColumn("cluster_class", F.coalesce("cluster_class", "_c")).drop("_c")
