"""Token files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Layout of a file image (one row of the written table, little-endian):
    magic ``FLV1`` | documents (u4) | ids (u4) | doc_id per document (i8) | ids per document (u4)
    | control bytes, two bits an id, four ids a byte, lowest bits first: bytes of the id less one
    | data bytes, lowest byte first.
An id is written as its rank by falling corpus frequency (ties to the smaller id), so the 256 commonest take one byte.
The ranking is written beside the images. A reader finds all lengths by table lookup of control bytes, all places by a
running sum, and all ids in one gather.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom.llm.common import shared_folder, slices, stash
from flightloom.llm.tokens import ENCODED, encoder

MAGIC = b"FLV1"
END = 1
#: Ids gathered before a file image is closed; a document is never cut.
IMAGE_IDS = 1 << 18
LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.int64)
KEEP = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def squeeze(ids: np.ndarray) -> bytes:
    """Ids for a scratch table: planes of low and high bytes, compressed."""
    return zstandard.compress(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unsqueeze(held: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(held), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype(np.int64) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.int64)
    padded[: len(ranks)] = size - 1
    return (padded.reshape(-1, 4) @ np.array([1, 4, 16, 64])).astype(np.uint8).tobytes(), data.tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    size = LENGTHS[control].ravel()[:n]
    start = np.cumsum(size) - size
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    return padded[start[:, None] + np.arange(4)].view("<u4").ravel() & KEEP[size]


def image(doc_ids: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    return MAGIC + struct.pack("<II", len(doc_ids), len(ranks)) + doc_ids.astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + control + data


def read_image(held: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, ids per document, ranks of all ids."""
    if held[:4] != MAGIC:
        raise ValueError("not a token file image")
    docs, n = struct.unpack_from("<II", held, 4)
    at = 12
    doc_ids = np.frombuffer(held, "<i8", docs, at)
    at += 8 * docs
    sizes = np.frombuffer(held, "<u4", docs, at)
    at += 4 * docs
    control = np.frombuffer(held, np.uint8, -(-n // 4), at)
    return doc_ids, sizes, decode_ranks(control, np.frombuffer(held, np.uint8, offset=at + len(control)), n)


def tokenise(vocabulary: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and at the end of the task one row that counts the ids it met."""
    enc = encoder(vocabulary)
    total = np.zeros(enc.tokenizer.get_vocab_size(), np.int64)
    for batch in slices(batches, "text", ENCODED):
        ids, sizes = enc.encode(batch.column("text"))
        total += np.bincount(ids, minlength=len(total))
        total[END] += len(sizes)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        own = [np.append(ids[a:b], END) for a, b in zip(edges[:-1], edges[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([crc(x) for x in own], pa.int64()), pa.array(map(squeeze, own), pa.binary()), pa.nulls(len(own), pa.binary())], names=["doc_id", "crc", "ids", "counts"])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([zlib.compress(total.tobytes(), 1)])], names=["doc_id", "crc", "ids", "counts"])


def unfold_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for held in batch.column("counts").to_pylist():
            n = np.frombuffer(zlib.decompress(held), np.int64)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["id", "n"])


def pack_images(ranked: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ranked: ids by rank. A task's rows come in the order of the files."""
    rank = np.zeros(int(ranked.max(initial=0)) + 1, np.uint32)
    rank[ranked] = np.arange(len(ranked))
    part, before = TaskContext.get().partitionId(), 0
    docs, known, parts, held = [], [], [], 0

    def close() -> pa.RecordBatch:
        # a null doc_id is kept beside the image, which has room for numbers only
        out = image(np.array([x or 0 for x in docs], np.int64), np.array([len(x) for x in parts]), rank[np.concatenate(parts)])
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([before]), pa.array([held]), pa.array([[i for i, x in enumerate(docs) if x is None]], pa.list_(pa.int32())), pa.array([out])], names=["part", "before", "n_ids", "no_id", "image"])

    for batch in batches:
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
            own = unsqueeze(ids.as_py())
            docs.append(doc_id)
            parts.append(own)
            held += len(own)
            if held >= IMAGE_IDS:
                yield close()
                before += held
                docs, parts, held = [], [], 0
    if docs:
        yield close()


def unpack_images(ranked: np.ndarray, starts: dict[int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, before, no_id, held in zip(batch.column("part").to_pylist(), batch.column("before").to_pylist(), batch.column("no_id").to_pylist(), batch.column("image")):
            doc_ids, sizes, ranks = read_image(held.as_py())
            ids = ranked[ranks]
            edges = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            nulls = np.zeros(len(doc_ids), bool)
            nulls[no_id] = True
            raw = memoryview(ids.astype("<u4").tobytes())
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=nulls), pa.array(starts[part] + before + edges[:-1]), pa.array(sizes.astype(np.int64)), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, vocabulary: str, path: str | None = None) -> str:
    """Encode whole texts, end each with id 1, and write file images in ascending doc_id order.

    Null texts are empty (the end id alone). Null doc_ids come first; repeated rows are kept, those of one doc_id in
    the order of their ids' crc. An empty table gives no image. Only doc_id and text are read, so further columns,
    whatever their names, play no part. What reaches the driver is the ranking (one entry per vocabulary id).
    """
    path = path or f"{shared_folder(docs.sparkSession).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    encoded = stash(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(partial(tokenise, vocabulary), "doc_id long, crc long, ids binary, counts binary"), "encoded")
    counted = encoded.where("counts is not null").select("counts").mapInArrow(unfold_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counted.coalesce(1).write.parquet(f"{path}/ranking")
    ranked = ranking(docs.sparkSession, path)
    (
        encoded.where("ids is not null").select("doc_id", "crc", "ids")
        .repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc")
        .mapInArrow(partial(pack_images, ranked), "part long, before long, n_ids long, no_id array<int>, image binary")
        .write.option("compression", "zstd").parquet(f"{path}/images")
    )
    return path


def ranking(spark: SparkSession, path: str) -> np.ndarray:
    """Ids by rank: at most one entry per vocabulary id."""
    held = spark.read.parquet(f"{path}/ranking").toPandas()
    return held.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""
    images = spark.read.schema("part long, before long, n_ids long, no_id array<int>, image binary").parquet(f"{path}/images")
    sums = sorted(images.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    starts = dict(zip([x.part for x in sums], np.concatenate([[0], np.cumsum([x.n for x in sums])]).tolist()))
    return images.select("part", "before", "no_id", "image").mapInArrow(partial(unpack_images, ranking(spark, path), starts), "doc_id long, start long, n_tokens long, ids_crc32 long")
