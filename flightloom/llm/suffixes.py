"""Passages that repeat across documents, by a sparse suffix array.

Suffixes are kept at content-selected places only: each window of LEAST words has one, the least hash of KEY words in it,
the first of equals. Equal windows have equal places, so two documents that share a window share the place's KEY words,
and hold equal words to the left and to the right of it. The windows of one place form a run, and a suffix is kept
with the run's words: those before the place, at most WINDOW - 1, and those from it on, at most LEAST.

Suffixes whose KEY words begin in no other document are dropped at once, and equal ones, left words included, are one
entry. The entries are range-sorted by the words from the place on; neighbours are compared, and their match is extended
to the right and to the left. They are sorted once more by the words before the place, read backwards. An entry's
neighbours in both orders bound what any other can share with it, and mostly show all of that. Where they don't (the
longest match to the right is one document's, that to the left another's), the windows in doubt, and no others, are
completed by hashes. That is exact but for collisions of 64-bit hashes, and makes a bounded number of pairs an entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightloom.llm.common import BASE, BASE_INVERSE, mix, owners, ranges, slices, stash, words

LEAST, KEY = 50, 26
WINDOW = LEAST - KEY + 1


class Runs:
    """Of the words of a slice: places in order with the hash of the KEY words there, and each one's run, the windows ``start`` .. ``start + count - 1``."""

    def __init__(self, terms: np.ndarray, first: np.ndarray):
        n = len(terms)
        self.at = self.start = self.count = np.zeros(0, np.int64)
        self.sums, self.down = np.zeros(1, np.uint64), np.ones(1, np.uint64)
        if n < LEAST:
            return
        up = np.full(n + 1, BASE, np.uint64)
        down = np.full(n + 1, BASE_INVERSE, np.uint64)
        up[0] = down[0] = 1
        up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms * up[:n], dtype=np.uint64)])
        grams = self.hashes(np.arange(n - KEY + 1), KEY)
        best = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).argmin(axis=1) + np.arange(n - LEAST + 1)
        room = np.repeat(first[1:], np.diff(first))[: n - LEAST + 1]
        valid = np.flatnonzero(np.arange(n - LEAST + 1) + LEAST <= room)
        # places don't go back as windows go on, and no window crosses an end of a text
        self.at, begin, self.count = np.unique(best[valid], return_index=True, return_counts=True)
        self.start = valid[begin]

    def hashes(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start] + np.asarray(length).astype(np.uint64))

    def keys(self) -> np.ndarray:
        return self.hashes(self.at, KEY).view(np.int64)

    def blocks(self) -> np.ndarray:
        """Hashes of all words of each run."""
        return self.hashes(self.start, self.count + LEAST - 1).view(np.int64)


def list_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        _, _, _, terms, first = words(batch.column("text"))
        runs = Runs(terms, first)
        row = np.searchsorted(first, runs.at, side="right") - 1
        numbers = [pa.array((x - y).astype(np.int32)) for x, y in ((runs.at, first[row]), (runs.start, first[row]), (runs.count, 0))]
        yield pa.RecordBatch.from_arrays([pa.array(runs.keys()), pa.array(runs.blocks()), batch.column("uid").take(pa.array(row)), batch.column("doc_id").take(pa.array(row)), *numbers], names=PLACE_NAMES)


PLACES = "key long, block long, uid long, doc_id long, place int, start int, count int"
PLACE_NAMES = [x.split()[0] for x in PLACES.split(", ")]


ENTRIES = "key long, block long, low long, high long, left array<long>, right array<long>"


def list_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the listed places: the words from a place to its run's end, and those before it, nearest first."""
    for batch in slices(batches, "text"):
        _, _, _, terms, first = words(batch.column("text"))
        runs = Runs(terms, first)
        listed = batch.column("places")
        many, flat = listed.value_lengths().to_numpy(zero_copy_only=False), listed.flatten()
        at = first[owners(np.concatenate([[0], np.cumsum(many)]))] + flat.field("place").to_numpy(zero_copy_only=False)
        run = np.searchsorted(runs.at, at)
        start, end = runs.start[run], runs.start[run] + runs.count[run] + LEAST - 1
        signed = terms.view(np.int64)
        lists = []
        for lead, count, step in ((at - 1, at - start, -1), (at, end - at, 1)):
            own = ranges(np.zeros(len(at), np.int64), count)
            edges = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(signed[np.repeat(lead, count) + step * own])))
        yield pa.RecordBatch.from_arrays([pa.array(runs.keys()[run]), pa.array(runs.blocks()[run]), flat.field("low"), flat.field("high"), *lists], names=["key", "block", "low", "high", "left", "right"])


def common(a: Column, b: Column) -> Column:
    """How many elements two arrays share from the start on."""
    n = F.least(F.size(a), F.size(b))
    differ = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), F.lit(False))
    return F.when(differ > 0, differ.cast("int") - 1).otherwise(n)


def neighbours(entries: DataFrame, order: list[str], label: str) -> DataFrame:
    """Entries next to each other in an order that tells all apart, of one key: (key, block, other, to_right, to_left, apart), a row for each of the two.

    Entries are range-sorted and each is joined to the one before it by number; the last of a task and the first of the next
    are neighbours too (a table of a row a task tells which). No key has to fit a task.
    """
    ranged = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = stash(ranged.withColumn("row", F.monotonically_increasing_id()), label)
    ends = ranked.groupBy(F.shiftright("row", 33).alias("task")).agg(F.min("row").alias("row"), F.max("row").alias("last"))
    seams = ends.select("row", F.lag("last").over(Window.orderBy("task")).alias("seam"))  # a row a task
    after = ranked.join(F.broadcast(seams), "row", "left").withColumn("row", F.coalesce("seam", F.col("row") - 1)).drop("seam")
    x, y = ranked.alias("x"), after.alias("y")
    both = x.join(y, F.col("x.row") == F.col("y.row")).where("x.key = y.key")
    apart = ~((F.col("x.low") == F.col("x.high")) & (F.col("y.low") == F.col("y.high")) & (F.col("x.low") == F.col("y.low")))
    held = both.select(F.col("x.key").alias("key"), F.array("x.block", "y.block").alias("blocks"), common(F.col("x.right"), F.col("y.right")).alias("to_right"), common(F.col("x.left"), F.col("y.left")).alias("to_left"), apart.alias("apart"))
    return held.select("key", F.explode("blocks").alias("block"), "to_right", "to_left", "apart")


def shared_windows(entries: DataFrame) -> DataFrame:
    """key, block and ``shared`` of entries: ranges (least, most) of the numbers of words before the place with which a window lies in two documents.

    A window of ``l`` words before the place has LEAST - l from it on. What two neighbours of different documents share
    is shared. An entry that several documents hold shares all of its own windows. By its nearest neighbours in the one
    order no entry agrees with it in more than ``most`` words before the place, by those in the other in more than LEAST -
    ``least`` from it on; of the windows between these bounds, those that no neighbour showed are looked up by their hash.
    """
    right = neighbours(entries, ["key", "right", "block"], "by-right").withColumn("by_right", F.lit(True))
    left = neighbours(entries, ["key", "left", "block"], "by-left").withColumn("by_right", F.lit(False))
    window = F.struct((LEAST - F.col("to_right")).alias("least"), F.col("to_left").alias("most"))
    seen = right.unionByName(left).groupBy("key", "block").agg(
        F.max(F.when(F.col("by_right"), F.col("to_right"))).alias("to_right"),
        F.max(F.when(~F.col("by_right"), F.col("to_left"))).alias("to_left"),
        F.collect_set(F.when(F.col("apart") & (LEAST - F.col("to_right") <= F.col("to_left")), window)).alias("shared"),
    )
    several = F.col("low") < F.col("high")
    whole = F.struct((LEAST - F.size("right")).alias("least"), F.size("left").alias("most"))
    held = entries.join(seen, ["key", "block"], "left")
    held = held.withColumn("shared", F.when(several, F.array(whole)).otherwise(F.coalesce("shared", F.array().cast("array<struct<least:int,most:int>>"))))
    least, most = LEAST - F.coalesce("to_right", F.lit(0)), F.coalesce("to_left", F.lit(0))
    possible = F.when(least <= most, F.sequence(least, most)).otherwise(F.array().cast("array<int>"))
    doubt = F.filter("possible", lambda w: ~F.exists("shared", lambda x: (x["least"] <= w) & (w <= x["most"])))
    held = stash(held.withColumn("possible", possible).withColumn("doubt", doubt), "compared")
    open_keys = held.where("size(doubt) > 0").select("key").distinct()
    asked = held.join(open_keys, "key").select("key", "block", "low", "high", "left", "right", "doubt", F.explode("possible").alias("l"))
    hashed = F.xxhash64(F.concat(F.reverse(F.slice("left", F.lit(1), F.col("l"))), F.slice("right", F.lit(1), LEAST - F.col("l"))))
    asked = stash(asked.select("key", "block", "low", "high", "l", hashed.alias("hash"), F.array_contains("doubt", F.col("l")).alias("doubt")), "windows")
    twice = asked.groupBy("key", "hash").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("key", "hash")
    found = asked.where("doubt").join(twice, ["key", "hash"]).groupBy("key", "block").agg(F.collect_list(F.struct(F.col("l").alias("least"), F.col("l").alias("most"))).alias("looked_up"))
    both = held.select("key", "block", "shared").join(found, ["key", "block"], "left")
    return both.select("key", "block", F.concat("shared", F.coalesce("looked_up", F.array().cast("array<struct<least:int,most:int>>"))).alias("shared")).where("size(shared) > 0")


def join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out_s, out_e = [], []
        for spans in batch.column("spans"):
            a, b = (spans.values.field(x).to_numpy(zero_copy_only=False) for x in "ab")
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.flatnonzero(a[1:] > b[:-1]) + 1
            out_s.append(a[np.concatenate([[0], new])])
            out_e.append(b[np.concatenate([new - 1, [-1]])])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out_s, pa.list_(pa.int32())), pa.array(out_e, pa.list_(pa.int32()))], names=["doc_id", "starts", "ends"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, starts and ends (words, end exclusive) of each document that holds a passage of LEAST words or more which another document holds too.

    Documents are told apart by (doc_id, text), so a repeated row isn't another document, and rows of one doc_id with
    several texts each give their row. Words are as in common.words. Null, empty and shorter texts hold no passage.
    Only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").withColumn("uid", F.xxhash64("doc_id", "text"))
    places = stash(rows.mapInArrow(list_places, PLACES), "places")
    # stashed, so that the joins' sides are plain scans and Spark can split a hot key
    keys = stash(places.groupBy("key").agg(F.min("uid").alias("low"), F.max("uid").alias("high"), (F.min("block") == F.max("block")).alias("same")).where("low < high").select("key", "same"), "shared-keys")
    known = stash(places.join(keys, "key").select("key", "block", "uid", "doc_id", "place", "start", "count", "same"), "shared-places")
    span = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")).alias("span")
    alike = known.where("same").select("uid", "doc_id", span(F.col("start"), F.col("start") + F.col("count") + (LEAST - 1)))  # one entry, held by several
    once = known.where("not same").groupBy("key", "block").agg(F.min(F.struct("uid", "place")).alias("first"), F.min("uid").alias("low"), F.max("uid").alias("high"))
    wanted = once.groupBy(F.col("first.uid").alias("uid")).agg(F.collect_list(F.struct(F.col("first.place").alias("place"), "low", "high")).alias("places"))
    listed = rows.join(wanted, "uid").select("text", "places").mapInArrow(list_suffixes, ENTRIES)
    entries = stash(listed.groupBy("key", "block").agg(*(F.first(c).alias(c) for c in ("low", "high", "left", "right"))), "entries")  # a repeated row lists its entries again
    shared = stash(shared_windows(entries), "shared-windows")
    found = known.where("not same").join(shared, ["key", "block"]).select("uid", "doc_id", "place", F.explode("shared").alias("x"))
    spans = alike.unionByName(found.select("uid", "doc_id", span(F.col("place") - F.col("x.most"), F.col("place") - F.col("x.least") + LEAST)))
    return spans.groupBy("uid", "doc_id").agg(F.collect_set("span").alias("spans")).select("doc_id", "spans").mapInArrow(join_spans, "doc_id long, starts array<int>, ends array<int>")


def passage_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_spans, n_repeated (words) and spans (``start:end``, comma-joined) of each document with repeated passages."""
    length = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0), lambda s, x: s + x)
    shown = F.array_join(F.zip_with("starts", "ends", lambda a, b: F.concat(a.cast("string"), F.lit(":"), b.cast("string"))), ",")
    return repeated_passages(docs).select("doc_id", F.size("starts").cast("long").alias("n_spans"), length.cast("long").alias("n_repeated"), shown.alias("spans"))
