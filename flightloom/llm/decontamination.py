"""Benchmark decontamination by a positional inverted index of the training documents.

Index: one row a block of documents (about ``BLOCK`` bytes of text), with the block's sorted terms (64-bit hashes of
words), how often each occurs, and its postings: places of the words in the block, ascending within a term, coded as
gaps. A search looks up which phrases have all their terms in a block, and for those intersects the posting lists,
each shifted by its term's place in the phrase, from the block's rarest term on. With slack, a term may stand up to so
many words from its place (proximity); without, the phrase is exact.

Phrases go to the blocks in batches of at most ``BATCH`` phrases, so what tasks are sent is bounded whatever the
benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.llm.binary_output import decode_ranks, encode_ranks
from flightloom.llm.common import give_back, slices, stash, words

BLOCK = 2 << 20
BATCH = 100_000
INDEX = "block long, doc_ids array<long>, first array<long>, terms binary, counts binary, control binary, gaps binary"


def build_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, k = TaskContext.get().partitionId(), 0
    for batch in slices(batches, "text", BLOCK):
        _, _, _, terms, first = words(batch.column("text"))
        order = np.argsort(terms, kind="stable")
        ranked = terms[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        gaps = order.copy()
        gaps[1:] -= order[:-1]
        gaps[at] = order[at]
        control, data = encode_ranks(gaps)
        counts = np.diff(np.append(at, len(ranked))).astype("<u4")
        one = lambda x, kind: pa.array([x], kind)
        yield pa.RecordBatch.from_arrays([one((part << 32) + k, pa.int64()), one(batch.column("doc_id").to_pylist(), pa.list_(pa.int64())), one(first, pa.list_(pa.int64())), one(ranked[at].astype("<u8").tobytes(), pa.binary()), one(counts.tobytes(), pa.binary()), one(control, pa.binary()), one(data, pa.binary())], names=["block", "doc_ids", "first", "terms", "counts", "control", "gaps"])
        k += 1


def build_index(docs: DataFrame) -> DataFrame:
    """Write the index of all documents into the shared folder. Null and empty texts are documents without words."""
    return stash(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build_blocks, INDEX), "postings")


def cut_phrases(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ``size`` words of each item; an item of fewer words, but not none, is one phrase."""
    for batch in slices(batches, "text"):
        _, _, _, terms, first = words(batch.column("text"))
        items, held = [], []
        for item, a, b in zip(batch.column("item_id").to_pylist(), first[:-1], first[1:]):
            for s in range(a, max(a + 1, b - size + 1)) if b > a else ():
                items.append(item)
                held.append(terms[s : min(b, s + size)].view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(held, pa.list_(pa.int64()))], names=["item_id", "terms"])


def find_phrases(phrases: list[np.ndarray], held: dict, slack: int = 0) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(phrase, where its words begin, where they end) of a block, by intersecting shifted posting lists from the rarest on.

    All words of a match lie in one document. With slack, a word may stand anywhere within so many words of its place,
    counted from the rarest word; of several the nearest counts, of two as near the first.
    """
    terms, counts = np.frombuffer(held["terms"], "<u8"), np.frombuffer(held["counts"], "<u4").astype(np.int64)
    if not len(terms) or not phrases:
        return []
    size = np.array([len(x) for x in phrases])
    flat = np.concatenate(phrases)
    spot = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
    edges = np.concatenate([[0], np.cumsum(size)])
    likely = np.flatnonzero(np.logical_and.reduceat(terms[spot] == flat, edges[:-1]))
    if not len(likely):
        return []
    ends = np.cumsum(counts)
    gaps = decode_ranks(np.frombuffer(held["control"], np.uint8), np.frombuffer(held["gaps"], np.uint8), int(ends[-1])).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(gaps)])
    first = np.asarray(held["first"])
    out = []
    for k in likely.tolist():
        own = spot[edges[k] : edges[k + 1]]
        order = np.argsort(counts[own], kind="stable").tolist()
        posted = lambda offset: sums[ends[own[offset]] - counts[own[offset]] + 1 : ends[own[offset]] + 1] - sums[ends[own[offset]] - counts[own[offset]]]
        rarest = posted(order[0])
        doc = np.searchsorted(first, rarest, side="right")
        begin, end = first[doc - 1], first[doc]  # of the rarest word's document
        start = rarest - order[0]
        low, high = rarest.copy(), rarest.copy()
        alive = np.ones(len(start), bool)
        for offset in order[1:]:
            near, fits = nearest(posted(offset), start + offset, np.maximum(start + offset - slack, begin), np.minimum(start + offset + slack + 1, end))
            alive &= fits
            if not alive.any():
                break
            low, high = np.where(fits, np.minimum(low, near), low), np.where(fits, np.maximum(high, near), high)
        if alive.any():
            out.append((k, low[alive], high[alive] + 1))
    return out


def nearest(places: np.ndarray, wanted: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each wanted place the nearest of the ascending ``places`` that lies in begin .. end - 1, the first of two as near; and whether there is one.

    Within the range, the nearest is the last place up to the wanted one or the first from it on, so both ends are held to the range.
    """
    low, high = np.searchsorted(places, begin), np.searchsorted(places, end)  # those of the range are low .. high - 1
    after = np.searchsorted(places, wanted)
    before = np.clip(after - 1, low, np.maximum(high - 1, low))
    after = np.clip(after, low, np.maximum(high - 1, low))
    top = len(places) - 1
    x, y = places[np.minimum(before, top)], places[np.minimum(after, top)]
    return np.where(np.abs(x - wanted) <= np.abs(y - wanted), x, y), high > low


def search_blocks(sent, slack: int, every: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: block, place in it, doc_id, n_words, covered words as starts and ends, items found. ``every``: also documents with none."""
    items, flat, size = sent.value
    edges = np.concatenate([[0], np.cumsum(size)])
    phrases = [flat[a:b] for a, b in zip(edges[:-1], edges[1:])]
    for batch in batches:
        for at in range(batch.num_rows):  # one block at a time
            (held,) = batch.slice(at, 1).to_pylist()
            first, n = np.asarray(held["first"]), len(held["doc_ids"])
            covers: dict[int, list[tuple[int, int]]] = {}
            found: dict[int, set[str]] = {}
            for k, starts, ends in find_phrases(phrases, held, slack):
                for doc, a, b in zip((np.searchsorted(first, starts, side="right") - 1).tolist(), starts.tolist(), ends.tolist()):
                    covers.setdefault(doc, []).append((a - int(first[doc]), b - int(first[doc])))
                    found.setdefault(doc, set()).add(str(items[k]))
            docs = range(n) if every else sorted(covers)
            merged = [merge(covers.get(d, [])) for d in docs]
            yield pa.RecordBatch.from_arrays([pa.array([held["block"]] * len(merged), pa.int64()), pa.array(list(docs), pa.int64()), pa.array([held["doc_ids"][d] for d in docs], pa.int64()), pa.array([int(first[d + 1] - first[d]) for d in docs], pa.int64()), pa.array([[x for x, _ in m] for m in merged], pa.list_(pa.int64())), pa.array([[x for _, x in m] for m in merged], pa.list_(pa.int64())), pa.array([sorted(found.get(d, ())) for d in docs], pa.list_(pa.string()))], names=["block", "place", "doc_id", "n_words", "starts", "ends", "items"])
    give_back()


MATCHES = "block long, place long, doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>"


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def merge_batches(held: pd.DataFrame) -> pd.DataFrame:
    spans = merge([s for a, b in zip(held["starts"], held["ends"]) for s in zip(a.tolist(), b.tolist())])
    return held.head(1).assign(starts=[[a for a, _ in spans]], ends=[[b for _, b in spans]], items=[sorted({y for x in held["items"] for y in x})])


def phrase_matches(docs: DataFrame, benchmark: DataFrame, size: int = 10, slack: int = 0) -> DataFrame:
    """Every document with the words that phrases of the benchmark cover and the items they come from.

    Items without an id play no part; items that share one count as one. Tables may be empty; only doc_id and text,
    item_id and text are read.
    """
    spark = docs.sparkSession
    index = build_index(docs)
    known = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null")
    phrases = stash(known.mapInArrow(partial(cut_phrases, size), "item_id long, terms array<long>").distinct(), "phrases")
    batches = max(1, -(-phrases.count() // BATCH))
    dealt = phrases.withColumn("batch", F.pmod(F.xxhash64("item_id", "terms"), F.lit(batches)))
    parts = []
    for k in range(batches):
        held = dealt.where(F.col("batch") == k).select("item_id", "terms").toPandas()
        flat = np.concatenate([np.zeros(0, np.int64), *held["terms"]]).astype(np.int64).view(np.uint64)
        sent = spark.sparkContext.broadcast((held["item_id"].to_numpy(), flat, np.array([len(x) for x in held["terms"]], np.int64)))  # about BATCH phrases of ``size`` words
        parts.append(index.mapInArrow(partial(search_blocks, sent, slack, k == 0), MATCHES))
    if batches == 1:
        return parts[0]
    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    return both.groupBy("block", "place").applyInPandas(merge_batches, MATCHES)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row."""
    found = phrase_matches(docs, benchmark, size)
    covered = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)
