"""Corpus preparation as five stages, each over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flightloom.llm.common import forget, scratch, stash, table
from flightloom.llm.decontamination import contamination
from flightloom.llm.near_dedup import near_classes
from flightloom.llm.packing import pack_along_curve
from flightloom.llm.pii import redacted, train_pii
from flightloom.llm.toxicity import toxicity_score, train_toxicity

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC; a null text has no feature and stays unless the bias alone says otherwise."""
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.withColumn("_score", toxicity_score(model)).where(F.col("_score") < TOXIC).drop("_score")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the smallest doc_id, once. Rows without doc_id have no class and stay."""
    classes = near_classes(docs)
    dropped = stash(classes.where("doc_id <> class_id").select("doc_id").distinct(), "dropped")
    again = stash(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id").join(dropped, "doc_id", "left_anti"), "again")
    single = docs.join(dropped.unionByName(again), "doc_id", "left_anti")
    order = Window.partitionBy("doc_id").orderBy(*(c for c in docs.columns if c != "doc_id"))
    first = docs.join(again, "doc_id", "left_semi").withColumn("_row", F.row_number().over(order)).where("_row = 1").drop("_row")
    return single.select(docs.columns).unionByName(first.select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word phrase of the benchmark. Rows without doc_id can't be named and stay."""
    found = contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated and doc_id is not null").select("doc_id").distinct()
    return docs.join(stash(found, "contaminated"), "doc_id", "left_anti").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind; n_chars follows the text."""
    changed = docs.withColumn("text", redacted(train_pii(docs)))
    return changed.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids with their ids, documents in the order of the curve."""
    return pack_along_curve(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: SQL expresses neither the models nor the signatures; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage wrote for itself is deleted when its result is written, the result when the next one is."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs = stash(stage(spark, docs, sf_dir), name)
            result = made.pop()
        forget(spark, before)
        before = [result]
    return docs
