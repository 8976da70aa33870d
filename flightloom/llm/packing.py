"""Packing along a space-filling curve.

A document's token counts, hashed into bins and weighted by their root, are projected to three dimensions by fixed
signs. Each dimension is brought to an even spread by the corpus's mean and deviation, and the three numbers give a
Hilbert key. Documents in the order of (key, tie) form one stream of ids that is cut every ``length`` ids: neighbours
on the curve share sequences, each id lies in one piece, and only the last sequence of all needs padding.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.llm.binary_output import END, squeeze, unsqueeze
from flightloom.llm.common import mix, slices, stash
from flightloom.llm.tokens import ENCODED, encoder

DIMENSIONS, BITS, BINS = 3, 16, 512
#: Ids that a task cuts into pieces, on average; there are as many tasks as that takes.
TASK_IDS = 8_000_000


def signs() -> np.ndarray:
    at = np.arange(BINS * DIMENSIONS, dtype=np.uint64)
    return ((mix(at) & np.uint64(1)).astype(np.float32) * 2 - 1).reshape(BINS, DIMENSIONS)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with whole coordinates below 2**bits, one row a point."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns from the coarsest cell down
        p = q - 1
        for i in range(n):
            turned = (x[i] & q) > 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(turned, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def vectors(vocabulary: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc, sign = encoder(vocabulary), signs()
    for batch in slices(batches, "text", ENCODED):
        ids, sizes = enc.encode(batch.column("text"))
        edges = np.concatenate([[0], np.cumsum(sizes)])
        bins = (mix(ids.astype(np.uint64)) % np.uint64(BINS)).astype(np.int64)
        counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * BINS + bins, minlength=len(sizes) * BINS).reshape(-1, BINS)
        v = np.sqrt(counts.astype(np.float32))
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        v = (v @ sign).astype(np.float64)
        own = [np.append(ids[a:b], END) for a, b in zip(edges[:-1], edges[1:])]
        crcs = [zlib.crc32(x.astype("<u4").tobytes()) for x in own]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v[:, i]) for i in range(DIMENSIONS)), pa.array(sizes + 1), pa.array(crcs, pa.int64()), pa.array(map(squeeze, own), pa.binary())], names=["doc_id", "v0", "v1", "v2", "n", "crc", "ids"])


def cut(length: int, starts: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of rows that come by bucket and in the order of the curve, each with its ids as little-endian u4."""
    bucket, at = -1, 0
    out: list[tuple] = []
    held = 0
    for batch in batches:
        for doc_id, b, squeezed in zip(batch.column("doc_id").to_pylist(), batch.column("bucket").to_pylist(), batch.column("ids")):
            if b != bucket:
                bucket, at = b, starts[b]
            raw = unsqueeze(squeezed.as_py()).tobytes()
            n, start = len(raw) // 4, 0
            while start < n:
                size = min(n - start, length - at % length)
                out.append((doc_id, start, size, n, at // length, at % length, raw[4 * start : 4 * (start + size)]))
                start += size
                at += size
                held += 4 * size
                if held >= OUT_BYTES:
                    yield pieces(out)
                    out, held = [], 0
    if out:
        yield pieces(out)


def pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), PIECES.types)], schema=PIECES)


#: Bytes of ids in a record batch of pieces, and a piece more at most.
OUT_BYTES = 1 << 22
PIECES = pa.schema([*((x, pa.int64()) for x in ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")), ("ids", pa.binary())])


def pack_along_curve(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", length: int = 2048) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and ids, packed as little-endian u4.

    The pieces of a sequence_id, their ids joined in the order of offset, are the sequence; ids_crc32 is taken from ids.
    A null or empty text is the end id alone. Equal texts lie side by side; among equal keys the order is by a hash of
    doc_id, then the ids' crc, so a key that holds a third of all rows is still dealt over many buckets. Repeated rows
    are packed as often as they occur, a null doc_id stays null, an empty table gives no piece. Only doc_id and text
    are read. The driver holds one boundary and one sum per bucket.
    """
    spark = docs.sparkSession
    encoded = stash(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(vectors, vocabulary), "doc_id long, v0 double, v1 double, v2 double, n long, crc long, ids binary"), "vectors")
    axes = [f"v{i}" for i in range(DIMENSIONS)]
    spread = encoded.agg(*(F.avg(x) for x in axes), *(F.stddev_pop(x) for x in axes), F.sum("n")).first()
    mean, deviation = np.array([x or 0.0 for x in spread[:DIMENSIONS]]), np.array([x or 1.0 for x in spread[DIMENSIONS : 2 * DIMENSIONS]])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(spread[-1] or 0) // TASK_IDS))

    @F.pandas_udf("long")
    def key(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        z = (np.stack([a, b, c], axis=1) - mean) / deviation
        even = 1 / (1 + np.exp(-1.702 * z))  # close to the normal distribution's
        return pd.Series(hilbert_key(np.clip(even * (1 << BITS), 0, (1 << BITS) - 1)))

    keyed = encoded.withColumn("key", key(*axes)).withColumn("tie", F.xxhash64("doc_id"))
    dealt = keyed.select("key", "tie", "n").repartitionByRange(4 * tasks, "key", "tie").withColumn("part", F.spark_partition_id())
    found = sorted((x.first.key, x.first.tie, x.n) for x in dealt.groupBy("part").agg(F.min(F.struct("key", "tie")).alias("first"), F.sum("n").alias("n")).collect())
    edges = [x[:2] for x in found[1:]]
    starts = np.concatenate([[0], np.cumsum([x[2] for x in found])]).astype(int).tolist()

    @F.pandas_udf("int")
    def bucket(k: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(edges, x) for x in zip(k.tolist(), t.tolist())], dtype="int32")

    placed = keyed.select("doc_id", "key", "tie", "crc", "ids", bucket("key", "tie").alias("bucket"))
    return placed.repartition(tasks, "bucket").sortWithinPartitions("bucket", "key", "tie", "crc").select("doc_id", "bucket", "ids").mapInArrow(partial(cut, length, starts), ", ".join(f"{x} {'binary' if x == 'ids' else 'long'}" for x in PIECES.names)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids"
    )
