"""The training corpus from raw documents, in five stages; each works on all that the one before kept.

Every stage takes (spark, docs, sf_dir), where docs has the columns of `documents`, and returns a DataFrame; run()
writes each result as Parquet in the shared folder and rereads it as the next stage's docs. All stages but the last
return the columns of `documents` (further ones too, if docs has them).

Nulls in any column, empty texts, repeated rows, ties and empty tables are defined per stage below; each operator's
docstring has the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import decontaminate, jaccard_join, packing, suffix_dedup, toxicity
from faultline.llm.common import discard, fresh, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.3, by a model of the `labels` that other folds' documents have.

    Null texts are scored as empty ones; repeated rows go or stay together; without labels of both kinds all rows get
    the share of toxic labels as their score, and without any label half, so all go: nothing is known to be clean.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity.probability(model, F.col("text")) < 0.3)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group connected by links (five-word shingles, Jaccard 0.8 or more).

    Repeated rows (same id and text) are one. Rows are told apart by id and text; one without an id is kept only where
    its group has none with an id, and of equal ids the text of the least hash is kept. Null and empty texts link with
    nothing and stay.
    """
    row, times = fresh(docs, "row"), fresh(docs, "times")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    groups = jaccard_join.components_of(keyed.select(row, "text"), id_column=row, words=5, percent=80)
    names = groups.groupBy(F.col("doc_id").alias("name"), "component_id").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", F.xxhash64("text").alias("hash"), F.col(row).alias("name"))
    places = keyed.select(F.col(row).alias("name"), place.alias("place")).distinct()
    first = names.join(places, "name").groupBy("component_id").agg(F.min(F.struct("place", "n")).alias("f"))
    chosen = keyed.join(first.select(F.col("f.place.name").alias(row), F.col("f.n").alias(times)), row)
    once = chosen.where(F.col(times) == 1).unionByName(chosen.where(F.col(times) > 1).dropDuplicates([row]))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what an earlier text has, too (100 bytes or more); characters that are cut go as a whole.
    Texts of which nothing is left, though they had something, are dropped; n_chars is the new length.

    Null and empty texts lose nothing and stay as they are; of repeated rows the first keeps its text.
    """
    cut = suffix_dedup.remove_repeats(docs, carry=docs.columns)
    kept = cut.where((F.col("n_removed") == 0) | (F.trim(F.col("kept_text")) != ""))
    new = {"text": F.when(F.col("n_removed") == 0, F.col("carried.text")).otherwise(F.col("kept_text"))}
    new["n_chars"] = F.when(F.col("n_removed") == 0, F.col("carried.n_chars")).otherwise(F.length("kept_text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*[new.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of a benchmark item occurs.

    Null and empty texts have no words and stay; repeated rows go or stay together; an empty benchmark drops nothing.
    """
    row = fresh(docs, "row")
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    found = decontaminate.decontaminate(keyed.select(row, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_column=row)
    bad = found.where("contaminated").select(F.col("doc_id").alias(row)).distinct()
    return keyed.join(bad, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens and their places in sequences; null and empty texts are the end id alone, and
    repeated rows are packed each time."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_near_copies),
    ("suffix_array_dedup", without_repeats),
    ("decontamination", decontaminated),
    ("best_fit_packing", packed),
]

#: SQL can express neither the trained model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
