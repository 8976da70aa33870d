"""Shared helpers: the shared scratch folder, tables cut from lineage, and vectorised text scanning.

Text is scanned as UTF-8 bytes in numpy. A record batch is processed in slices of about ``SLICE`` bytes, so that
memory stays bounded by the slice (or by one very long text), not by the partition.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE = 1 << 19
#: Odd multiplier of the polynomial word hash, and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset: a folder of our own in local mode, an error on a cluster, whose machines share no local folder."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        held = tempfile.mkdtemp(prefix="flightloom-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Within, Arrow batches hold 2000 rows of text unless the session has a number of its own: Spark's default of 10000 long texts weighs on small executors."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, "2000" if held == "10000" else held)
    try:
        yield
    finally:
        spark.conf.set(name, held)


_made: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Lists the tables that are stashed within. On leaving, those still listed are deleted: take off what is read later."""
    held: list[str] = []
    _made.append(held)
    try:
        yield held
    finally:
        _made.remove(held)
        forget(spark, held)


def forget(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables. What the driver holds of the jobs that made them, and their shuffle files, go when it collects its garbage, which it is asked to do: its memory would grow to its limit first."""
    for x in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(x)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if paths:
        spark._jvm.System.gc()


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage ends there and lost executors cost little."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for held in _made:
        held.append(path)
    with bounded_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system, so that a worker that waits for its next task holds little more than its libraries."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of each slice has about ``budget`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + budget, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def lengths(column: pa.Array) -> np.ndarray:
    return np.diff(offsets(column)) if len(column) else np.zeros(0, np.int64)


def offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, and where each begins (one entry more than texts). Null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    at = offsets(column)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, which: str) -> np.ndarray:
    """Powers of BASE or of its inverse; those of a slice are kept, those that one very long text needs are not."""
    have = _powers[which]
    if len(have) < n:
        step = np.full(max(n, SLICE + 1), BASE if which == "up" else BASE_INVERSE, np.uint64)
        step[0] = 1
        have = np.cumprod(step, dtype=np.uint64)
        if n <= 2 * SLICE:
            _powers[which] = have
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data.astype(np.uint64) * powers(len(data), "up"), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(len(data) + 1, "down")[starts] + (ends - starts).astype(np.uint64))


#: Lower-cases A-Z and nothing else; and the bytes of words: digits, letters and all of non-ASCII characters.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run ends where a text ends."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[at] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, word ends, word hashes, and the first word of each text (one entry more)."""
    data, at = text_bytes(column)
    low = LOWER[data]
    starts, ends = runs(WORD[low], at)
    hashes = span_hashes(low, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return low, starts, ends, hashes, np.searchsorted(starts, at)


def owners(first: np.ndarray) -> np.ndarray:
    """Row number of each item, from the first item of each row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated aranges: starts[i] .. starts[i] + counts[i] - 1."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
