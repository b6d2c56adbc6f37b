"""External models as protocols, each with a deterministic default that needs no service."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol, TypeVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.functions import vectors as V

R = TypeVar("R")


class Embedder(Protocol):
    """Adds a unit-length `embedding` for a text column."""

    def __call__(self, df: DataFrame, text: str) -> DataFrame: ...


class Namer(Protocol):
    """(key, name) of each cluster."""

    def __call__(self, df: DataFrame, key: str, text: str) -> DataFrame: ...


class Classifier(Protocol):
    """The class of a text."""

    def __call__(self, text: Column) -> Column: ...


def hashed_embedding(df: DataFrame, text: str, dims: int = 64) -> DataFrame:
    """Default of X01: token counts by hash, unit length; texts without tokens have the zero vector."""
    tokens = T.sparse_tokens(F.col(text))
    places = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int"))
    held = df.withColumn("_places", places)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.size(F.filter("_places", lambda p: p == k)).cast("double"))
    return held.withColumn("_counts", counts).withColumn("embedding", V.unit(F.col("_counts"))).drop("_places", "_counts")


def token_namer(df: DataFrame, key: str, text: str, words: int = 5) -> DataFrame:
    """Default of X03 and X04: the cluster's most telling tokens, most frequent first, in Pascal case; ties by token."""
    flat = df.select(key, F.explode(F.array_distinct(T.sparse_tokens(F.col(text)))).alias("token"))
    counts = flat.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    spread = counts.groupBy("token").agg(F.count(F.lit(1)).alias("clusters"))
    scored = counts.join(spread, "token").withColumn("score", F.col("n") / F.col("clusters"))
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), "token")
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= words)
    return top.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.initcap("token").alias("t")))), lambda s: s["t"]), "").alias("name"))


# Ordered class rules.
CLASS_RULES = (("env_issue", r"device (not found|unavailable)|no space left|timer expired|same worker|connection"), ("setup_issue", r"missing|not found|no such file|permission denied|not installed"))


def rule_class(text: Column) -> Column:
    """Default of X08: the first rule that matches; else sdk_issue."""
    out = F.when(text.rlike(f"(?i){CLASS_RULES[0][1]}"), CLASS_RULES[0][0])
    for name, pattern in CLASS_RULES[1:]:
        out = out.when(text.rlike(f"(?i){pattern}"), name)
    return out.otherwise("sdk_issue")


def merge_name(a: Column, size_a: Column, b: Column, size_b: Column) -> Column:
    """Default of X05: the larger cluster's name; of equal ones the lexically smaller."""
    return F.when(size_a > size_b, a).when(size_b > size_a, b).otherwise(F.least(a, b))


def masked_groups(df: DataFrame, row: str, text: str) -> DataFrame:
    """Default of X06: rows with the same masked text are a group, named by its least row."""
    masked = df.select(row, T.mask_numbers(F.col(text)).alias("_m"))
    return masked.join(masked.groupBy("_m").agg(F.min(row).alias("group")), "_m").select(row, "group")


def summary(df: DataFrame, key: str, text: str, top: int = 5) -> DataFrame:
    """Default of X09: a cluster's most common masked texts with counts. One aggregation does what map and reduce
    over windows of logs would."""
    counts = df.groupBy(key, T.mask_numbers(F.col(text)).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), "pattern")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def retried(call: Callable[[], R], attempts: int = 4, final: tuple[type[BaseException], ...] = (), sleep: Callable[[float], None] = time.sleep) -> R:
    """Exponential waits of at most 30 s; errors in `final` aren't tried again."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except final:
            raise
        except Exception:
            if attempt == attempts:
                raise
            sleep(min(5 * 2 ** (attempt - 1), 30))
    raise AssertionError


def halved(call: Callable[[list], list], items: list, splits: int = 10) -> list:
    """X01's batch rule: a batch that a server refuses is sent as halves, at most `splits` times deep."""
    try:
        return call(items)
    except Exception:
        if splits == 0 or len(items) < 2:
            raise
        half = len(items) // 2
        return halved(call, items[:half], splits - 1) + halved(call, items[half:], splits - 1)
