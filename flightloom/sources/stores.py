"""Stores of profiles and index tables: what a writer changes becomes visible as a whole or not at all.

Profiles lie in parts by user, of which a change rewrites those of the users it names. An index lies in versions, each
written completely before one small file, the manifest, is put in the place of the last; readers follow the manifest.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.sources.tables import parts_as_text, upsert_profiles

PART = "user_id"
MANIFEST = "manifest.json"


def at(spark: SparkSession, path: str):
    """A path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = at(spark, path)
    return files.exists(place)


def read_profile_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored profiles."""
    return parts_as_text(spark, path, PART).where("stored").drop("stored")


def store_profiles(profiles: DataFrame, path: str) -> None:
    """A new store of whole profiles, in parts by user; refuses where there is one."""
    profiles.withColumn("stored", F.lit(True)).hint("rebalance", PART).write.partitionBy(PART).mode("errorifexists").parquet(path)


def change_profiles(spark: SparkSession, path: str, changes: DataFrame) -> DataFrame:
    """Create, update and delete profiles of a store (see upsert_profiles), and give (user_id, profile_id, result) of each change.

    Only the parts of users that ``changes`` names with a change that is made are read in full and written again; all
    other files stay. A deleted profile stays as a row that isn't stored, since a part without any row wouldn't be
    replaced. The new rows are worked out and put into the checkpoint folder before the first part is replaced.
    """
    held = parts_as_text(spark, path, PART)
    touched = changes.where(F.col(PART).isNotNull()).select(PART).distinct()
    old = held.join(touched, PART, "left_semi")
    live, gone = old.where("stored").drop("stored"), old.where("NOT stored")
    made = upsert_profiles(live, changes)
    result = made.where("result <> 'kept'").select(PART, "profile_id", "result")
    named = made.withColumn("in_store", (F.col("result") != "refused") | F.col("stored"))
    rewritten = named.where(F.col("result").isin("create", "update", "delete")).select(PART).distinct()
    now = named.where("in_store").drop("in_store", "result")
    back = now.select(PART, "profile_id")  # a key that was deleted and is here again
    both = now.select(held.columns).unionByName(gone.join(back, [PART, "profile_id"], "left_anti").select(held.columns))
    whole = both.join(rewritten, PART, "left_semi").checkpoint()
    told = result.checkpoint()
    whole.hint("rebalance", PART).write.partitionBy(PART).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return told


def publish_index(tables: dict[str, DataFrame], path: str, force: bool = False) -> str:
    """Write all tables of an index as one new version and make it the one that is read; gives the version's name.

    Everything that can be refused is, before the first write: no table, a name that isn't a plain one, a stream, and
    an index that is there already unless ``force``. All tables are written to a folder of their own; then the manifest
    is replaced in one step. A failure before that leaves what was published as it was. The version before the new one
    is kept for those who still read it, older ones are deleted.
    """
    if not tables:
        raise ValueError("an index needs a table")
    if wrong := [x for x in tables if not x.isidentifier()]:
        raise ValueError(f"not names of tables: {wrong}")
    if moving := [x for x, df in tables.items() if df.isStreaming]:
        raise ValueError(f"streams can't be published: {moving}")
    spark = next(iter(tables.values())).sparkSession
    before = read_manifest(spark, path)
    if before and not force:
        raise FileExistsError(f"{path} holds an index; force replaces it")
    version = f"{datetime.now(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:12]}"
    counts = {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/versions/{version}/{name}")
        counts[name] = spark.read.parquet(f"{path}/versions/{version}/{name}").count()
    switch_manifest(spark, path, {"version": version, "before": before.get("version"), "tables": counts})
    keep = {version, before.get("version")}
    place, files = at(spark, f"{path}/versions")
    for x in files.listStatus(place):
        if x.getPath().getName() not in keep:
            files.delete(x.getPath(), True)
    return version


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The published version, the one before it, and the tables with their numbers of rows; empty where nothing is published."""
    if not exists(spark, f"{path}/{MANIFEST}"):
        return {}
    return json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0])


def switch_manifest(spark: SparkSession, path: str, manifest: dict) -> None:
    """Put a manifest in the place of the last by one rename."""
    fresh, files = at(spark, f"{path}/{MANIFEST}.{uuid.uuid4().hex}")
    out = files.create(fresh, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    options = spark._sc._gateway.new_array(jvm.Options.Rename, 1)
    options[0] = jvm.Options.Rename.OVERWRITE
    jvm.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(fresh), files.makeQualified(jvm.Path(f"{path}/{MANIFEST}")), options)


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of the published version by name; they belong together whatever is published meanwhile."""
    manifest = read_manifest(spark, path)
    if not manifest:
        raise FileNotFoundError(f"no index is published at {path}")
    return {name: spark.read.parquet(f"{path}/versions/{manifest['version']}/{name}") for name in manifest["tables"]}
