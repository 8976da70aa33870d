"""The state of a published index: its manifest, and one reconciliation of manifest, chunks, postings and vectors by their keys.

A table that isn't there is a state, not an error. Tables are compared chunk by chunk and source by source, in one grouping
each, and only counts and codes are left over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Codes of what is amiss, states, and the fields that a manifest has.
MISSING = {"vectors": "missing_dense_index", "chunks": "missing_dense_mapping", "docs": "missing_sparse_index", "manifest": "missing_metadata"}
CURRENT, FAILED, NO_INDEX = "current", "integrity_failed", "missing_index"
FIELDS = ["schema_version", "build_tool", "build_timestamp", "source_count", "chunk_count", "vector_count", "indexed_count", "dimension", "chunk_size", "chunk_overlap"]
SCHEMA_VERSION = "3.0"


def blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""


def index_manifest(chunks: DataFrame, docs: DataFrame, vectors: DataFrame, sources: DataFrame, built_at: str, tool: str = "flightloom", chunk_size: int = 800, chunk_overlap: int = 150) -> tuple[DataFrame, DataFrame]:
    """The manifest of an index as one row of FIELDS, and its sources as rows (source_id, filename, sha256, chunk_count).

    ``sources`` is the catalog of the corpus (source_id, filename, sha256); a source without chunks has 0.
    """
    many = chunks.groupBy("source_id").agg(F.count("*").alias("chunk_count"))
    listed = sources.select("source_id", "filename", "sha256").join(many, "source_id", "left").select("source_id", "filename", "sha256", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    of_vectors = vectors.agg(F.count("*").alias("vector_count"), F.max(F.size("embedding")).alias("dimension"))
    row = n(listed, "source_count").crossJoin(n(chunks, "chunk_count")).crossJoin(of_vectors).crossJoin(n(docs, "indexed_count"))  # rows of one
    fixed = {"schema_version": SCHEMA_VERSION, "build_tool": tool, "build_timestamp": built_at, "chunk_size": chunk_size, "chunk_overlap": chunk_overlap}
    return row.withColumns({k: F.lit(v) for k, v in fixed.items()}).select(FIELDS), listed


def chunk_codes(chunks: DataFrame) -> DataFrame:
    """One row: codes of what is amiss within the chunk table, and whether the ids of its vectors go from 0 on without gap."""
    page, end = F.col("page_start"), F.col("page_end")
    rules = {
        "dense_mapping_chunk_missing_chunk_id": blank("chunk_id"),
        "dense_mapping_chunk_missing_source_id": blank("source_id"),
        "dense_mapping_chunk_missing_source_filename": blank("source_filename"),
        "dense_mapping_chunk_missing_source_title": blank("source_title"),
        "dense_mapping_chunk_empty_text": blank("text"),
        "dense_mapping_chunk_missing_text_sha256": blank("text_sha256"),
        "dense_mapping_chunk_invalid_vector_id": F.col("vector_id").isNull(),
        "dense_mapping_chunk_invalid_page_start": page < 1,
        "dense_mapping_chunk_invalid_page_end": end < 1,
        "dense_mapping_chunk_invalid_page_range": end < page,
    }
    found = chunks.agg(*(F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False)).alias(k) for k, c in rules.items()), F.count("*").alias("n"), F.countDistinct("vector_id").alias("ids"), F.min("vector_id").alias("low"), F.max("vector_id").alias("high"))
    gap = (F.col("n") > 0) & ((F.col("ids") != F.col("n")) | (F.col("low") != 0) | (F.col("high") != F.col("n") - 1))
    codes = [F.when(F.col(k), k) for k in rules] + [F.when(F.coalesce(gap, F.lit(True)) & (F.col("n") > 0), "dense_mapping_vector_id_sequence_invalid"), F.when(F.col("n") == 0, "dense_mapping_no_sources")]
    return found.select(F.array_compact(F.array(*codes)).alias("codes"))


def index_status(
    spark: SparkSession,
    manifest: DataFrame | None = None,
    sources: DataFrame | None = None,
    chunks: DataFrame | None = None,
    docs: DataFrame | None = None,
    vectors: DataFrame | None = None,
) -> DataFrame:
    """One row: status, errors (codes in order of name), the tables' numbers of rows, chunk_provenance_complete and all_sources_have_chunks.

    ``manifest`` and ``sources`` are as index_manifest makes them (``sources`` belongs to the manifest), ``chunks`` has
    vector_id, chunk_id, source_id, source_filename, source_title, page_start, page_end, text and text_sha256, ``docs``
    (the sparse side) and ``vectors`` chunk_id. A table that is None is
    missing, one without rows is there. Without vectors the status is missing_index; with any other error integrity_failed; else current.
    """
    given = {"vectors": vectors, "chunks": chunks, "docs": docs, "manifest": manifest}
    row = spark.range(1).select(F.array(*(F.lit(code) for k, code in MISSING.items() if given[k] is None)).cast("array<string>").alias("errors"))
    counted = {"chunks": chunks, "docs": docs, "vectors": vectors}
    sides = [df.select(F.col("chunk_id").cast("string").alias("chunk_id"), *(F.lit(int(k == name)).alias(k) for k in counted)) for name, df in counted.items() if df is not None]
    keyed = spark.createDataFrame([], "chunk_id string, chunks int, docs int, vectors int")
    for side in sides:
        keyed = keyed.unionByName(side)
    per_chunk = keyed.groupBy("chunk_id").agg(*(F.sum(k).alias(k) for k in counted))
    lacks = lambda a, b: F.coalesce(F.bool_or((F.col(a) > 0) & (F.col(b) == 0)), F.lit(False))
    total = per_chunk.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(f"{k}_n") for k in counted), lacks("chunks", "vectors").alias("no_vector"), lacks("vectors", "chunks").alias("no_chunk"), lacks("chunks", "docs").alias("no_postings"), F.coalesce(F.bool_or(F.col("chunks") > 1), F.lit(False)).alias("twice"))
    row = row.crossJoin(total)  # rows of one from here on
    has = lambda *names: F.lit(all(given[k] is not None for k in names))
    codes = [
        F.when(has("vectors", "chunks") & (F.col("chunks_n") != F.col("vectors_n")), "dense_mapping_count_mismatch"),
        F.when(has("docs", "chunks") & (F.col("chunks_n") != F.col("docs_n")), "sparse_dense_count_mismatch"),
        F.when(has("vectors", "chunks") & F.col("no_vector"), "chunk_without_vector"),
        F.when(has("vectors", "chunks") & F.col("no_chunk"), "vector_without_chunk"),
        F.when(has("docs", "chunks") & F.col("no_postings"), "chunk_without_postings"),
        F.when(F.col("twice"), "chunk_id_repeated"),
    ]
    if chunks is not None:
        row = row.crossJoin(chunk_codes(chunks))
    else:
        row = row.withColumn("codes", F.array().cast("array<string>"))
    if manifest is not None:
        fields = [F.first(F.col(x) if x in manifest.columns else F.lit(None), True).cast("string").alias(f"m_{x}") for x in FIELDS]
        row = row.crossJoin(manifest.agg(*fields))
        codes += [F.when(F.col(f"m_{x}").isNull(), f"metadata_missing_{x}") for x in FIELDS]
        differs = lambda name, n: F.coalesce(F.col(f"m_{name}").try_cast("long") != F.col(n), F.lit(False))
        codes += [F.when(has("chunks") & differs("chunk_count", "chunks_n"), "dense_mapping_count_field_mismatch"), F.when(has("vectors") & differs("vector_count", "vectors_n"), "metadata_vector_count_mismatch")]
        listed = sources if sources is not None else spark.createDataFrame([], "source_id string, chunk_count long")
        declared = listed.select(F.trim("source_id").alias("source_id"), F.lit(1).alias("listed"), F.coalesce("chunk_count", F.lit(0)).cast("long").alias("declared"), F.lit(0).cast("long").alias("held"))
        if chunks is not None:
            held = chunks.groupBy(F.trim("source_id").alias("source_id")).agg(F.count("*").alias("held"))
            declared = declared.unionByName(held.select("source_id", F.lit(0).alias("listed"), F.lit(0).cast("long").alias("declared"), "held"))
        each = declared.groupBy("source_id").agg(F.sum("listed").alias("listed"), F.sum("declared").alias("declared"), F.sum("held").alias("held"))
        any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
        l, d, h = F.col("listed"), F.col("declared"), F.col("held")
        row = row.crossJoin(each.agg(F.coalesce(F.sum("listed"), F.lit(0)).alias("sources_n"), any_of((l > 0) & (d <= 0)).alias("zero"), any_of((l == 0) & (h > 0)).alias("unlisted"), any_of((l > 0) & (h != d)).alias("miscounted")))
        codes += [
            F.when(F.col("zero"), "metadata_source_zero_chunks"),
            F.when(F.col("unlisted"), "chunk_source_missing_in_metadata"),
            F.when(has("chunks") & F.col("miscounted"), "metadata_source_chunk_count_mismatch"),
            F.when(differs("source_count", "sources_n"), "source_count_mismatch"),
            F.when(F.col("sources_n") == 0, "metadata_invalid_source_documents"),
        ]
        linked, full = ~F.col("unlisted"), (F.col("sources_n") > 0) & ~F.col("zero")
    else:
        row = row.withColumn("sources_n", F.lit(0).cast("long"))
        linked, full = F.lit(False), F.lit(False)
    whole = ~F.arrays_overlap("codes", F.array(*(F.lit(f"dense_mapping_chunk_{x}") for x in ("missing_source_id", "missing_source_filename", "empty_text", "missing_text_sha256"))))
    errors = F.array_sort(F.array_distinct(F.concat("errors", "codes", F.array_compact(F.array(*codes)))))
    status = F.when(F.array_contains("found", MISSING["vectors"]), NO_INDEX).when(F.size("found") > 0, FAILED).otherwise(CURRENT)
    return row.withColumn("found", errors).select(
        status.alias("status"), F.col("found").alias("errors"), F.col("sources_n").alias("source_count"), F.col("chunks_n").alias("chunk_count"), F.col("docs_n").alias("sparse_count"), F.col("vectors_n").alias("vector_count"),
        (has("chunks", "manifest") & whole & linked).alias("chunk_provenance_complete"), full.alias("all_sources_have_chunks"),
    )
