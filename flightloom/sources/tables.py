"""Readers and writers of profiles, labelled features, corpus files, records and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightloom import schemas as S
from flightloom.operators.corpus import normalize_source_id

PROFILE_SCHEMA = T.StructType(
    [T.StructField(x, T.StringType()) for x in S.PROFILE_IDENTITY]
    + [T.StructField(x, T.StringType() if x in S.CATEGORIES else T.DoubleType()) for x in S.PROFILE_RAW]
    + [T.StructField("max_payload_kg", T.DoubleType()), T.StructField("max_takeoff_mass_kg", T.DoubleType()), T.StructField("runway_capable", T.BooleanType()), T.StructField("swarm_capable", T.BooleanType()), T.StructField("max_swarm_size", T.IntegerType())]
)
LABELLED_SCHEMA = T.StructType([T.StructField(x, T.StringType() if x in S.CATEGORIES or isinstance(S.DROPPED_DEFAULTS.get(x), str) else T.DoubleType()) for x in S.RAW_FEATURES] + [T.StructField("label_risk_category", T.StringType())])


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a file under <path>/<user>/<profile>.json."""
    return spark.read.schema(PROFILE_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True).json(path)


def safe_id(name: str):
    held = F.col(name)
    return held.isNotNull() & ~held.isin("", ".", "..") & ~held.contains("/") & ~held.contains("\\")


def upsert_profiles(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """Profiles with all columns of ``existing`` after create, update and delete (``op``), the ``result`` of each, and whether it is ``stored`` then.

    create needs a new key whose ids can name a place, the others a known key; anything else is refused and alters
    nothing. An update replaces the whole profile. A deleted profile is shown as it was. ``changes`` has the same columns
    and at most one row a key; columns that it lacks are null. The rows that are stored are the new table.
    """
    key = ["user_id", "profile_id"]
    rest = [x for x in existing.columns if x not in key]
    old = existing.select(*key, F.struct(*rest).alias("old"), F.lit(True).alias("known"))
    kinds = {x: existing.schema[x].dataType for x in rest}
    given = F.struct(*(F.col(x).cast(kinds[x]).alias(x) if x in changes.columns else F.lit(None).cast(kinds[x]).alias(x) for x in rest))
    both = old.join(changes.select(*key, "op", given.alias("new"), F.lit(True).alias("asked")), key, "full")
    known, op = F.coalesce("known", F.lit(False)), F.coalesce("op", F.lit(""))
    fine = ((op == "create") & ~known & safe_id("user_id") & safe_id("profile_id")) | (op.isin("update", "delete") & known)
    now = F.when(fine & op.isin("create", "update"), F.col("new")).otherwise(F.col("old"))
    result = F.when(F.col("asked").isNull(), "kept").when(~fine, "refused").otherwise(op)
    stored = F.when(fine, op != "delete").otherwise(known)
    shown = both.select(*key, now.alias("now"), result.alias("result"), stored.alias("stored"))
    return shown.select(*(x if x in key else F.col("now")[x].alias(x) for x in existing.columns), "result", "stored")


def write_assessments(records: DataFrame, path: str, batch: int | None = None) -> None:
    """Store records in parts by user and batch; rows whose ids can't name a place are refused.

    Without ``batch`` they are appended. With one, the batch's parts are replaced: a batch of a stream that is written
    again leaves each record once.
    """
    fit = records.where(safe_id("user_id") & safe_id("assessment_id")).withColumn("batch", F.lit(-1 if batch is None else batch).cast("long"))
    to = fit.hint("rebalance", "user_id").write.partitionBy("user_id", "batch")
    (to.mode("append") if batch is None else to.mode("overwrite").option("partitionOverwriteMode", "dynamic")).parquet(path)


def read_assessments(spark: SparkSession, path: str) -> DataFrame:
    """All stored records; ids stay text whatever they look like."""
    return parts_as_text(spark, path, "user_id").drop("batch")


def parts_as_text(spark: SparkSession, path: str, part: str) -> DataFrame:
    """A partitioned table whose part isn't taken for a number."""
    kinds = [T.StructField(f.name, T.StringType() if f.name == part else f.dataType) for f in spark.read.parquet(path).schema]
    return spark.read.schema(T.StructType(kinds)).parquet(path)


def read_labelled_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELLED_SCHEMA).parquet(path)


def catalog_sources(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """source_id, filename, sha256, size and mtime of each file."""
    held = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return held.select(normalize_source_id(name).alias("source_id"), name.alias("filename"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def append_evidence_log(entries: DataFrame, path: str, rows: int = 5000) -> None:
    entries.write.mode("append").option("maxRecordsPerFile", rows).json(path)
