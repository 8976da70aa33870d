"""Corpus preparation and the sparse index: keys, tokens, postings, statistics, dense ids, unit vectors, manifest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: BM25 parameters.
K1, B = 1.5, 0.75


def normalize_source_id(filename: Column) -> Column:
    """Lower-case stem, runs of other characters as one underscore, and 8 hex digits of the name's sha256."""
    stem = F.lower(F.regexp_replace(filename, r"\.[^.]*$", ""))
    plain = F.regexp_replace(F.regexp_replace(stem, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.when(plain == "", "source").otherwise(plain), F.lit("_"), F.substring(F.sha2(filename, 256), 1, 8))


def normalize_text(text: Column) -> Column:
    """White space cut from both ends and from the end of each line; all line ends become line feeds."""
    lines = F.regexp_replace(text, "\r\n|\r", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"[ \t]+(?=\n|$)", ""), r"^\s+|\s+$", "")


def chunk_keys(chunks: DataFrame) -> DataFrame:
    """Adds text_sha256, chunk_id, char_count, token_count and source_title to (source_id, source_filename, page, at_place, text)."""
    sha = F.sha2("text", 256)
    own = F.substring(F.sha2(F.concat_ws("|", "source_id", F.col("page").cast("string"), F.col("page").cast("string"), F.col("at_place").cast("string"), sha), 256), 1, 24)
    words = F.size(F.filter(F.split("text", r"\s+"), lambda t: t != ""))
    return chunks.select("*", sha.alias("text_sha256"), own.alias("chunk_id"), F.length("text").alias("char_count"), words.alias("token_count"), F.regexp_replace("source_filename", r"\.[^.]*$", "").alias("source_title"))


def assign_vector_ids(chunks: DataFrame, source: str = "source_filename", page: str = "page", *rest: str, pages: int = 1024) -> DataFrame:
    """Dense ids from 0 in the order of source, page and the rest.

    A bucket is ``pages`` pages of a source, so a source of any size is many buckets. Buckets are counted and each one's
    first id is the sum of those before it; within a bucket rows are numbered in order. All keys are values of the rows,
    so ids don't depend on how the rows are dealt.
    """
    held = chunks.withColumn("_bucket", F.floor(F.col(page) / pages))
    key = [source, "_bucket"]
    sizes = held.groupBy(*key).agg(F.count("*").alias("_n"))
    by_source = sizes.groupBy(source).agg(F.sum("_n").alias("_n"))  # one row a source
    first = by_source.select(source, (F.sum("_n").over(Window.orderBy(source)) - F.col("_n")).alias("_first"))
    within = sizes.select(*key, (F.sum("_n").over(Window.partitionBy(source).orderBy("_bucket")) - F.col("_n")).alias("_before"))  # one row a bucket
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(page, *rest))
    return held.withColumn("_at", nth).join(within, key).join(first, source).withColumn("vector_id", F.col("_first") + F.col("_before") + F.col("_at") - 1).select(*chunks.columns, "vector_id")


def source_chunk_counts(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks of each source; sources without any have 0."""
    held = chunks.groupBy("source_id").agg(F.count("*").alias("n"))
    return sources.select("source_id").distinct().join(held, "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("chunk_count"))


def index_tokens(text: Column) -> Column:
    """Tokens of the index: ASCII letters and digits in lower case, longer than two."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0))


def tokenize(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", index_tokens(F.col("text")).alias("tokens"))


def build_postings(tokens: DataFrame, terms: DataFrame | None = None, lengths: bool = False) -> DataFrame:
    """(term, chunk_id, tf); only of ``terms`` (term), if given, which are then looked up before anything is shuffled. With ``lengths`` also dl, the tokens of the chunk, so that a search doesn't read the texts again for it."""
    each = tokens.select("chunk_id", *([F.size("tokens").alias("dl")] if lengths else []), F.explode_outer("tokens").alias("term")).where("term is not null")  # for explode Spark would cut each text once more, to filter
    each = each if terms is None else each.join(terms.select("term").distinct(), "term", "left_semi")
    return each.groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), *([F.max("dl").alias("dl")] if lengths else []))


def term_stats(postings: DataFrame, n_chunks: int) -> DataFrame:
    """(term, df, idf). All columns of the postings are read, so that a plan that needs both shuffles them once."""
    whole = F.col("tf") > 0
    whole = whole & (F.col("dl") > 0) if "dl" in postings.columns else whole
    df = postings.groupBy("term").agg(F.count(F.when(whole, 1)).alias("df"))
    return df.select("term", "df", F.ln((F.lit(n_chunks) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf"))


def doc_stats(tokens: DataFrame) -> DataFrame:
    """(chunk_id, dl), the tokens of each chunk."""
    return tokens.select("chunk_id", F.size("tokens").alias("dl"))


def token_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ASCII letters and digits in lower-case texts, whose other characters have no such byte in UTF-8: each one's text and length, and the bytes of all."""
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    held = texts.cast(pa.large_binary())
    ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset :][: len(held) + 1]
    whole, ends = np.frombuffer(held.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]
    w = (whole - np.uint8(97) < 26) | (whole - np.uint8(48) < 10)  # unsigned: a to z, 0 to 9
    cut = np.zeros(len(w) + 1, bool)
    cut[ends] = True  # a run ends with its text
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1] | cut[1:-1]
    last[:-1] &= ~w[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    of = np.repeat(np.arange(len(held)), np.diff(np.searchsorted(starts, ends)))
    return of, np.flatnonzero(last) + 1 - starts, whole[w]


def count_tokens(texts: pa.Array) -> pa.Array:
    """Tokens of each lower-case text: runs of three or more."""
    of, size, _ = token_runs(texts)
    return pa.array(np.bincount(of[size >= 3], minlength=len(texts)).astype(np.int32), mask=np.asarray(texts.is_null()))


def terms_in(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each lower-case text, none in a null; and of the terms (large_binary) that are tokens of them, in order of text and term, the text's place, the term's place and how often."""
    of, size, data = token_runs(texts)
    runs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)]), pa.py_buffer(data)])
    at, whole, n = pc.fill_null(pc.index_in(runs, terms), -1).to_numpy(), size >= 3, max(1, len(terms))
    held = whole & (at >= 0)
    pairs, times = np.unique(of[held] * n + at[held], return_counts=True)
    return np.bincount(of[whole], minlength=len(texts)), pairs // n, pairs % n, times


def doc_lengths(chunks: DataFrame) -> DataFrame:
    """The same (chunk_id, dl) from texts, without making their tokens."""
    return chunks.select("chunk_id", F.arrow_udf(count_tokens, "int")(F.lower("text")).alias("dl"))


def normalize_vectors(vectors: DataFrame, column: str = "embedding", size: int | None = None) -> DataFrame:
    """Vectors of length 1, other columns as they are; a zero vector stays, and one of another size is left out."""
    held = vectors if size is None else vectors.where(F.size(column) == size)
    norm = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    both = F.array(F.struct(F.col(column).alias("v"), norm.alias("norm")))  # the norm as an element: a column of its own is worked out again for each x where Spark filters by the result
    unit = F.transform(both, lambda r: F.when(r["norm"] > 0, F.transform(r["v"], lambda x: x / r["norm"])).otherwise(r["v"].cast("array<double>")))
    return held.withColumn(column, F.get(unit, F.lit(0)))


def index_manifest(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: chunks, sources, characters, dimension."""
    sizes = chunks.agg(F.count("*").alias("total_chunks"), F.countDistinct("source_id").alias("total_sources"), F.sum("char_count").alias("total_chars"))
    return sizes.crossJoin(vectors.agg(F.max(F.size("embedding")).alias("dimension")))  # one row by one row


def chunk_integrity(chunks: DataFrame, declared: int) -> DataFrame:
    """Distinct error codes of a chunk table."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    codes = F.array_compact(F.array(F.when(blank("source_id"), F.lit("blank_source")), F.when(blank("text"), F.lit("blank_text")), F.when(blank("text_sha256"), F.lit("blank_sha")), F.when(F.col("page_start") < 1, F.lit("bad_page")), F.when(F.col("page_end") < F.col("page_start"), F.lit("bad_page_range"))))
    rows = chunks.select(F.explode(codes).alias("code"))
    whole = chunks.agg(F.count("*").alias("n"), F.countDistinct("vector_id").alias("d"), F.min("vector_id").alias("lo"), F.max("vector_id").alias("hi"))
    table = whole.select(F.explode(F.array_compact(F.array(F.when(F.col("n") != declared, F.lit("count_mismatch")), F.when((F.col("d") != F.col("n")) | (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1), F.lit("vector_ids_not_sequential"))))).alias("code"))
    return rows.unionByName(table).distinct()


def corpus_coverage(expected: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: expected and indexed sources, those missing, and complete, partial or unknown."""
    held = expected.select("source_id").distinct().join(indexed.select("source_id", F.lit(1).alias("has")).distinct(), "source_id", "left")
    out = held.agg(F.count("*").alias("expected"), F.count("has").alias("indexed"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("has").isNull(), F.col("source_id")))), ",").alias("missing"))
    return out.withColumn("status", F.when(F.col("expected") == 0, "unknown").when(F.col("expected") == F.col("indexed"), "complete").otherwise("partial"))
