"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed character n-grams (3 to 6 code points, case folded) in a whole text. Counts of
documents with each feature, by label, give log-count ratios r; the features that tell the labels apart best are kept,
and a logistic regression is fitted on r-scaled presence. Its weights times r make one table of weights by hash, and a
text is scored by summing the weights of the distinct features it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom.llm.common import SLICE, bounded_batches, slices, text_bytes

ORDERS = (3, 4, 5, 6)
WIDTH = 20
FEATURES = 4000
#: Labelled training rows are sampled down to about this many.
TRAIN_ROWS = 20_000
#: Counts are summed in chunks of so many features, so that no row is large.
CHUNK = 1 << 14
#: Bytes of text whose n-grams are listed at a time.
LISTED = 1 << 18


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Case-folded code points (ASCII and Latin-1 capitals, white space as blanks) and where each text begins."""
    data, at = text_bytes(column)
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).copy()
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    capital = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
    points[capital] += 32
    points[(points >= 9) & (points <= 13)] = 32
    return points, lead[at]


def hashes(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order, the feature of the n-gram that begins at each code point."""
    step, h = np.uint32(0x01000193), points.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(points) < n:
            return
        h = h[:-1] * step + points[n - 1 :]
        if n in ORDERS:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield n, (x >> np.uint32(32 - WIDTH)).astype(np.int64)


def present(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs of a slice in order; only features marked in ``wanted``, if given."""
    points, at = code_points(column)
    found = []
    for n, x in hashes(points):
        where = np.arange(len(x)) if wanted is None else np.flatnonzero(wanted[x])
        row = np.searchsorted(at, where, side="right") - 1
        inside = where + n <= at[row + 1]
        found.append(row[inside] << WIDTH | x[where[inside]])
    pairs = np.concatenate(found) if found else np.zeros(0, np.int64)
    pairs.sort()
    pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
    return pairs >> WIDTH, pairs & ((1 << WIDTH) - 1)


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, how many documents of each label have each feature, by chunk; chunk -1 counts documents."""
    counts, docs = np.zeros((2, 1 << WIDTH), np.int64), np.zeros(2, np.int64)
    for batch in slices(batches, "text", LISTED):
        label = batch.column("label").to_numpy(zero_copy_only=False)
        row, feature = present(batch.column("text"))
        for k in (0, 1):
            counts[k] += np.bincount(feature[label[row] == k], minlength=1 << WIDTH)
            docs[k] += (label == k).sum()
    if docs.any():
        parts = [counts[:, i : i + CHUNK].tobytes() for i in range(0, 1 << WIDTH, CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(parts))], pa.int64()), pa.array([docs.tobytes(), *parts])], names=["chunk", "counts"])


def sum_counts(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"chunk": [key[0]], "counts": [np.sum([np.frombuffer(x, np.int64) for x in held["counts"]], axis=0).tobytes()]})


def list_features(wanted: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", LISTED):
        row, feature = present(batch.column("text"), wanted)
        edges = np.searchsorted(row, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(edges.astype(np.int32), feature.astype(np.int32))], names=["label", "features"])


def chi_square(with_1: np.ndarray, with_0: np.ndarray, n1: float, n0: float) -> np.ndarray:
    n, has = n1 + n0, with_1 + with_0
    bottom = np.maximum(n1 * n0 * has * (n - has), 1)
    return n * (with_1 * (n0 - with_0) - with_0 * (n1 - with_1)) ** 2 / bottom


def fit_linear(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, rounds: int = 200, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on presence times scale, by Adam over all rows; ``rows`` hold column numbers."""
    size = np.array([len(x) for x in rows])
    column = np.concatenate(rows) if size.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), size)
    value = scale[column]
    w, b = np.zeros(len(scale)), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, value * w[column], len(rows)) + b
        miss = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels
        g = np.append(np.bincount(column, value * miss[row], len(scale)) / len(rows) + decay * w, miss.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def sample_labels(labels: DataFrame, value: str, modulus: int, remainder: int, bound: int) -> DataFrame:
    """doc_id and label of about ``bound`` training rows at most, chosen by a hash of doc_id."""
    known = labels.where(F.col(value).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(value).cast("int").alias("label"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus != remainder if remainder is not None else F.lit(True))
    share = min(1.0, bound / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def train_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, bound: int = TRAIN_ROWS) -> ToxicityModel:
    """Fit on labelled rows whose crc32(doc_id) mod ``modulus`` isn't ``held_out``, sampled to about ``bound``.

    Only doc_id and text of ``docs`` and doc_id and toxic of ``labels`` are read. With no row of one label the model
    gives every text the score 0.
    """
    sample = sample_labels(labels, "toxic", modulus, held_out, bound)
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").select("text", "label")  # at most ``bound`` ids, 16 bytes each
    with bounded_batches(docs.sparkSession):
        held = rows.mapInArrow(count_features, "chunk long, counts binary").groupBy("chunk").applyInPandas(sum_counts, "chunk long, counts binary").toPandas()
    parts = {int(k): np.frombuffer(x, np.int64) for k, x in zip(held["chunk"], held["counts"])}
    if not parts or not (docs_by := parts.pop(-1)).all():
        return ToxicityModel(np.zeros(1 << WIDTH, np.float32), -40.0)
    with_0, with_1 = np.concatenate([parts[k].reshape(2, -1) for k in sorted(parts)], axis=1).astype(float)
    n0, n1 = docs_by.astype(float)
    ratio = np.log((with_1 + 1) / (with_1.sum() + len(with_1))) - np.log((with_0 + 1) / (with_0.sum() + len(with_0)))
    kept = np.sort(np.argsort(-chi_square(with_1, with_0, n1, n0), kind="stable")[:FEATURES])
    wanted = np.zeros(1 << WIDTH, bool)
    wanted[kept] = True
    with bounded_batches(docs.sparkSession):
        listed = rows.mapInArrow(partial(list_features, wanted), "label int, features array<int>").toPandas()
    w, bias = fit_linear([np.searchsorted(kept, x) for x in listed["features"]], listed["label"].to_numpy(float), ratio[kept])
    weights = np.zeros(1 << WIDTH, np.float32)
    weights[kept] = w * ratio[kept]
    return ToxicityModel(weights, bias)


def score_texts(model: ToxicityModel, column: pa.Array) -> np.ndarray:
    row, feature = present(column, model.weights != 0)
    z = np.bincount(row, model.weights[feature], len(column)) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def by_slices(score, column: pa.Array) -> pa.Array:
    """Apply a scorer of text columns to slices of bounded size."""
    column = column.fill_null("") if column.null_count else column
    batch = pa.RecordBatch.from_arrays([column], names=["text"])
    parts = [score(x.column("text")) for x in slices(iter([batch]), "text", SLICE)]
    return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())


def toxicity_score(model: ToxicityModel, text: str = "text") -> Column:
    """Score of a text column, from 0 to 1; null and empty texts get the score of no feature."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return by_slices(partial(score_texts, model), column)

    return score(F.col(text))


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; repeated rows are scored as often as they occur.

    A null doc_id belongs to no fold (held_out false) and is never trained on.
    """
    model = train_toxicity(docs, labels, modulus, held_out)
    return docs.select("doc_id", fold(modulus, held_out), toxicity_score(model).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fold(modulus: int, held_out: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == held_out, F.lit(False)).alias("held_out")
