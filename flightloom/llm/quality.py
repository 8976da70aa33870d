"""Quality by attention-based multiple-instance learning.

A text is a bag of passages (runs of 60 white-space words). Each passage has counted features: letter case, digits,
marks, word lengths, repetition within the passage and the text, and a hashed byte histogram. A layer encodes every
passage, a gated layer gives it an attention weight, and the weighted sum of the encoded passages is scored. All
layers are learned together from document labels, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom.llm.common import bounded_batches, mix, owners, runs, slices, span_hashes, text_bytes
from flightloom.llm.tokens import PLAIN_SPACE
from flightloom.llm.toxicity import by_slices, fold, sample_labels

PASSAGE = 60
COUNTED, BUCKETS = 20, 44
#: Labelled training rows are sampled down to about this many.
TRAIN_ROWS = 6_000
HIDDEN, GATE = 16, 8

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOP = np.isin(np.arange(256), [33, 44, 46, 58, 59, 63])
SYMBOL = ((np.arange(256) > 32) & (np.arange(256) < 127)) & ~UPPER & ~DIGIT & ~STOP & ~((np.arange(256) > 96) & (np.arange(256) < 123))
#: Bytes by kind; non-ASCII bytes are hashed.
BUCKET = np.where(np.arange(256) < 128, np.arange(256) % 32, 32 + np.arange(256) % 12)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def first_seen(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    out = np.ones(len(keys), bool)
    out[order[1:]] = ranked[1:] != ranked[:-1]
    return out


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the first passage of each text; a text without words has one empty passage."""
    data, at = text_bytes(column)
    starts, ends = runs(~PLAIN_SPACE[data], at) if len(data) else (np.zeros(0, np.int64),) * 2
    first = np.searchsorted(starts, at)
    n_words = np.diff(first)
    n_passages = np.maximum(1, -(-n_words // PASSAGE))
    base = np.concatenate([[0], np.cumsum(n_passages)])
    total = int(base[-1])
    x = np.zeros((total, COUNTED + BUCKETS), np.float32)
    text_of = owners(first)
    within = np.arange(len(starts)) - first[:-1][text_of]
    passage = base[:-1][text_of] + within // PASSAGE
    words = np.bincount(passage, minlength=total).astype(float)
    per_word = np.maximum(words, 1)
    size = (ends - starts).astype(float)
    chars = np.bincount(passage, size, total)
    per_char = np.maximum(chars, 1)
    mean = lambda v: np.bincount(passage, v, total) / per_word

    if len(starts):
        of_byte = np.repeat(passage, ends - starts)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        low = data[np.cumsum(inside[:-1]) > 0]
        histogram = np.bincount(of_byte * 256 + low, minlength=total * 256).reshape(total, 256)
        share = lambda kind: histogram[:, kind].sum(axis=1) / per_char
        x[:, 0], x[:, 1], x[:, 2], x[:, 3] = share(UPPER), share(DIGIT), share(STOP), share(SYMBOL)
        x[:, 4] = histogram[:, 128:].sum(axis=1) / per_char
        buckets = np.zeros((total, BUCKETS))
        for b in range(BUCKETS):
            buckets[:, b] = histogram[:, BUCKET == b].sum(axis=1)
        x[:, COUNTED:] = np.sqrt(buckets / per_char[:, None])
        h = span_hashes(data, starts, ends)
        own, whole = passage.astype(np.uint64) << np.uint64(20), text_of.astype(np.uint64) << np.uint64(20)
        x[:, 5] = mean(first_seen(mix(h ^ own)).astype(float))
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (text_of[1:] == text_of[:-1])
        x[:, 6] = mean(same)
        three = h.copy()
        three[:-2] += h[1:-1] * np.uint64(3) + h[2:] * np.uint64(7)
        x[:, 7] = mean(first_seen(mix(three ^ own)).astype(float))
        x[:, 8] = mean(repeated(mix(three ^ whole)).astype(float))
        x[:, 9] = mean(first_seen(mix(h ^ whole)).astype(float))
        x[:, 10] = mean(UPPER[data[starts]].astype(float))
        x[:, 11] = mean((STOP | SYMBOL)[data[ends - 1]].astype(float))
        x[:, 12] = mean(SYMBOL[data[ends - 1]].astype(float))
        x[:, 13] = mean((size == 1).astype(float))
        x[:, 14] = mean((size > 20).astype(float))
        deviation = np.sqrt(np.maximum(mean(size * size) - mean(size) ** 2, 0))
        x[:, 15] = deviation / 10
        gap = np.zeros(len(starts))
        gap[1:] = np.minimum(starts[1:] - ends[:-1], 4)
        x[:, 16] = mean(gap) / 4
    x[:, 17] = chars / per_word / 10
    x[:, 18] = words / PASSAGE
    x[:, 19] = np.repeat(np.log1p(n_words), n_passages) / 10
    return x, base


class QualityModel:
    """Layers: encoder (w, b), gated attention (v, u, a), scorer (c, d); features are brought to mean 0 and spread 1."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        normal = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
        self.layers = {"w": normal(len(mean), HIDDEN), "b": np.zeros(HIDDEN), "v": normal(HIDDEN, GATE), "u": normal(HIDDEN, GATE), "a": normal(GATE), "c": normal(HIDDEN), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, base: np.ndarray) -> dict[str, np.ndarray]:
        p = self.layers
        x = np.clip((x - self.mean) / self.spread, -6, 6)
        h = np.tanh(x @ p["w"] + p["b"])
        tanh, gate = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = (tanh * gate) @ p["a"]
        bag = owners(base)
        e = np.exp(e - np.maximum.reduceat(e, base[:-1])[bag])
        weight = e / np.add.reduceat(e, base[:-1])[bag]
        z = np.add.reduceat(weight[:, None] * h, base[:-1])
        return {"x": x, "h": h, "tanh": tanh, "gate": gate, "weight": weight, "z": z, "bag": bag, "out": z @ p["c"] + p["d"]}

    def gradients(self, x: np.ndarray, base: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.layers, self.forward(x, base)
        miss = (1 / (1 + np.exp(-f["out"])) - labels) / len(labels)
        dz = miss[:, None] * p["c"]
        share, bag = f["weight"], f["bag"]
        dweight = (dz[bag] * f["h"]).sum(axis=1)
        de = share * (dweight - np.add.reduceat(share * dweight, base[:-1])[bag])
        both = f["tanh"] * f["gate"]
        dt = de[:, None] * p["a"] * f["gate"] * (1 - f["tanh"] ** 2)
        ds = de[:, None] * p["a"] * f["tanh"] * f["gate"] * (1 - f["gate"])
        dh = share[:, None] * dz[bag] + dt @ p["v"].T + ds @ p["u"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"w": f["x"].T @ dx, "b": dx.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ ds, "a": both.T @ de, "c": f["z"].T @ miss, "d": np.array([miss.sum()])}

    def score(self, x: np.ndarray, base: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward(x, base)["out"], -40, 40)))


def fit_quality(x: np.ndarray, base: np.ndarray, labels: np.ndarray, steps: int = 2500, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> QualityModel:
    """Adam over batches of documents, in an order fixed by the seed."""
    model = QualityModel(x.mean(axis=0), x.std(axis=0) + 1e-3)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.layers.items()}
    s = {k: np.zeros_like(v) for k, v in model.layers.items()}
    order, at = rng.permutation(len(labels)), 0
    for t in range(1, steps + 1):
        if at + batch > len(order):
            order, at = rng.permutation(len(labels)), 0
        pick = order[at : at + batch]
        at += batch
        size = base[pick + 1] - base[pick]
        rows = np.repeat(base[pick] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pace = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for k, g in model.gradients(x[rows], np.concatenate([[0], np.cumsum(size)]), labels[pick]).items():
            g = g + decay * model.layers[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            model.layers[k] = model.layers[k] - pace * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    return model


def list_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        x, base = passages(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([x[a:b].astype("<f4").tobytes() for a, b in zip(base[:-1], base[1:])])], names=["doc_id", "label", "passages"])


def train_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, bound: int = TRAIN_ROWS) -> QualityModel | None:
    """Fit on labelled rows whose crc32(doc_id) mod ``modulus`` isn't ``held_out``, sampled to about ``bound``; None without both labels."""
    sample = sample_labels(labels, "quality", modulus, held_out, bound)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")  # at most ``bound`` ids, 16 bytes each
    with bounded_batches(docs.sparkSession):
        held = rows.mapInArrow(list_passages, "doc_id long, label int, passages binary").toPandas().sort_values(["doc_id", "label", "passages"])
    if held["label"].nunique() < 2:
        return None
    bags = [np.frombuffer(x, "<f4").reshape(-1, COUNTED + BUCKETS) for x in held["passages"]]
    return fit_quality(np.concatenate(bags), np.concatenate([[0], np.cumsum([len(x) for x in bags])]), held["label"].to_numpy(float))


def score_texts(model: QualityModel, column: pa.Array) -> np.ndarray:
    return model.score(*passages(column))


def quality_score(model: QualityModel | None, text: str = "text") -> Column:
    """Score of a text column; null and empty texts are one empty passage. 1 for every text where there is no model."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return by_slices(partial(score_texts, model), column)

    return F.lit(1.0) if model is None else score(F.col(text))


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; repeated rows are scored as often as they occur."""
    model = train_quality(docs, labels, modulus, held_out)
    return docs.select("doc_id", fold(modulus, held_out), quality_score(model).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
