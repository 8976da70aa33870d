"""Near-duplicate classes by ProbMinHash over weighted shingles, banding and verification.

A text is a bag of five-word shingles weighted by how often they occur. Each shingle's arrivals are a Poisson process
of its weight's rate, with times and registers drawn from its hash; a register keeps the shingle that arrives first,
and a text's processes end once no later arrival can change a register. Two texts' registers agree with the
probability Jaccard of their bags.

Equal texts are one node from the start. Bands of registers propose links; in each bucket every node is first linked
to the bucket's pivot (the member that shares most buckets), and links are verified on the exact bags. Only buckets
whose members are then still in several components are gone through pair by pair, in cells of bounded size: on registers
first, and where these look near on the exact bags. So a bucket of near copies costs a link or so a member, and no
pair is lost: every pair of a bucket is in one component, verified, or far apart by its registers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightloom.llm.common import give_back, mix, owners, slices, stash, words
from flightloom.llm.components import components, joined

SHINGLE, SIMILAR = 5, 0.8
ROWS, BANDS = 5, 25
REGISTERS = ROWS * BANDS
#: Pairs whose registers agree less than this aren't verified: 0.8 less five and a half deviations of 125 registers, so of
#: pairs at 0.8 one in ten million is passed over, far fewer than share no band.
LOOKS_NEAR = 0.6
#: Members of a bucket that one task compares with as many.
CELL = 512


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in order, their weights, and the first of each text. A text of fewer words, but not none, is one shingle."""
    _, _, _, h, first = words(column)
    n = np.diff(first)
    many = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    start = np.repeat(first[:-1] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    end = np.repeat(first[1:], many)
    key = np.zeros(len(start), np.uint64)
    for k in range(size):
        key = mix(key * np.uint64(31) + np.where(start + k < end, padded[start + k], np.uint64(0)))
    row = np.repeat(np.arange(len(n)), many)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(key)))
    return key[at], weight, np.searchsorted(row[at], np.arange(len(n) + 1))


def probability_signature(keys: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers (32-bit names of shingles) of each text, one row a text; of a text without shingles all zero."""
    n = len(first) - 1
    best = np.full(n * REGISTERS, np.inf)
    name = np.zeros(n * REGISTERS, np.uint32)
    row, rate = owners(first), weights.astype(float)
    state, time = keys.copy(), np.zeros(len(keys))
    alive = np.arange(len(keys))
    while len(alive):
        state[alive] = s = mix(state[alive])
        time[alive] += -np.log(((s >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / rate[alive]
        register = row[alive] * REGISTERS + (mix(s) % np.uint64(REGISTERS)).astype(np.int64)
        t = time[alive]
        hit = t < best[register]
        alive_hit, register, t = alive[hit], register[hit], t[hit]
        np.minimum.at(best, register, t)
        won = best[register] == t
        name[register[won]] = (keys[alive_hit[won]] >> np.uint64(32)).astype(np.uint32)
        last = best.reshape(n, REGISTERS).max(axis=1)
        alive = alive[time[alive] < last[row[alive]]]
    return name.reshape(n, REGISTERS)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact, of two bags given as sorted keys and weights: the sum over common keys i of 1 / sum_j max(a_j / a_i, b_j / b_i)."""
    (ka, wa), (kb, wb) = a, b
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    below, above = np.cumsum(x), y.sum() - np.cumsum(y)  # of a tie either side gives the same
    return float((1 / ((only_a + below) / x + (only_b + above) / y)).sum())


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, print of the text, two hashes of the words in order (null without words), registers and band keys."""
    for batch in slices(batches, "text"):
        column = batch.column("text")
        _, _, _, h, at = words(column)
        n = np.diff(at)
        place = (np.arange(len(h)) - np.repeat(at[:-1], n)).astype(np.uint64)
        sums = []
        for seed in (1, 2):
            parts = mix(h ^ mix(place + np.uint64(seed << 40)))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(parts, dtype=np.uint64)])
            sums.append(mix(total[at[1:]] - total[at[:-1]] + n.astype(np.uint64)).view(np.int64))
        registers = probability_signature(*shingles(column))
        key = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], len(n), axis=0)
        for k in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + registers.reshape(-1, BANDS, ROWS)[:, :, k])
        empty = n == 0
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("print"), *(pa.array(x, mask=empty) for x in sums), pa.array([x.tobytes() for x in registers.astype(np.uint8)], pa.binary()), pa.array([x.tobytes() for x in key.view(np.int64)], pa.binary())], names=["doc_id", "print", "h1", "h2", "registers", "bands"])


def spread_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column("node").to_numpy(zero_copy_only=False), BANDS))], names=["band", "node"])
    give_back()


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that are similar, of rows a, b, text_a, text_b; a text met again is not cut again."""
    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
        if text not in known:
            if len(known) > 64:
                known.clear()
            keys, weights, _ = shingles(pa.array([text]))
            known[text] = keys, weights
        return known[text]

    for batch in batches:
        near = [probability_jaccard(bag(x), bag(y)) >= SIMILAR for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))
    known.clear()
    give_back()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose texts are similar; ``texts`` has node and text. A node of many pairs is split by Spark's skew join."""
    first = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    full = first.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return stash(full.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long"), "similar")


def link_cell(held: pd.DataFrame) -> pd.DataFrame:
    """Links between a left and a right member of one cell that aren't in one component yet.

    A pair is looked at in the first bucket that it shares, and once. Each link found joins two components of the
    cell, so fewer links than members come out however many pairs are similar.
    """
    left, right = held[held["left"]], held[~held["left"]]
    registers = np.frombuffer(b"".join(right["registers"]), np.uint8).reshape(-1, REGISTERS)
    bands = np.frombuffer(b"".join(right["bands"]), np.int64).reshape(-1, BANDS)
    nodes, outside, root = right["node"].to_numpy(), right["outside"].to_numpy(), right["component"].to_numpy().copy()
    texts, bags, joined, found = right["text"].to_numpy(), {}, {}, []

    def bag(node: int, text: str) -> tuple[np.ndarray, np.ndarray]:
        if node not in bags:
            bags[node] = shingles(pa.array([text]))[:2]
        return bags[node]

    for node, component, own, own_bands, text in zip(left["node"].tolist(), left["component"].tolist(), left["registers"], left["bands"], left["text"]):
        while component in joined:
            component = joined[component]
        own_bands = np.frombuffer(own_bands, np.int64)
        before = int(np.flatnonzero(own_bands == held["band"].iloc[0])[0])
        at = np.flatnonzero((root != component) & (~outside | (nodes > node)))
        at = at[~(bands[at, :before] == own_bands[:before]).any(axis=1)]
        agree = (registers[at] == np.frombuffer(own, np.uint8)).mean(axis=1)
        for k in at[np.argsort(-agree, kind="stable")[: int((agree >= LOOKS_NEAR).sum())]].tolist():
            if root[k] != component and probability_jaccard(bag(node, text), bag(int(nodes[k]), texts[k])) >= SIMILAR:
                found.append((min(node, int(nodes[k])), max(node, int(nodes[k]))))
                joined[int(root[k])] = component
                root[root == root[k]] = component
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def further_links(members: DataFrame, found: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between members of one bucket in different components.

    Of a bucket, the members outside its largest component meet all members. Both are cut into parts of about CELL
    members, and a cell is one part of each, so no task holds a whole bucket.
    """
    placed = members.where("n > 2").join(found, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    sizes = placed.groupBy("band", "component").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("size", "component")).alias("core"), F.sum("size").alias("all")).where("core.size < all")
    mixed = mixed.select("band", F.col("core.component").alias("core"), F.ceil((F.col("all") - F.col("core.size")) / CELL).cast("int").alias("left_parts"), F.ceil(F.col("all") / CELL).cast("int").alias("right_parts"))
    held = placed.join(mixed, "band").join(nodes.select("node", "registers", "bands"), "node").join(texts, "node").withColumn("outside", F.col("component") != F.col("core"))
    part = lambda parts, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    rest = ("band", "node", "component", "registers", "bands", "text", "outside")
    right = held.select(*rest, F.lit(False).alias("left"), part("right_parts", 2).alias("j"), every("left_parts").alias("i"))
    left = held.where("outside").select(*rest, F.lit(True).alias("left"), every("right_parts").alias("j"), part("left_parts", 1).alias("i"))
    return right.unionByName(left).groupBy("band", "i", "j").applyInPandas(link_cell, "a long, b long").distinct()


def of_one_id(worded: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of a doc_id that has several; each to the first."""
    words = F.struct("h1", "h2")
    several = worded.groupBy("doc_id").agg(F.min(words).alias("low"), F.max(words).alias("high")).where("low <> high").select("doc_id", "low.h1", "low.h2")
    first = several.join(nodes.select("h1", "h2", F.col("node").alias("a")), ["h1", "h2"]).select("doc_id", "a")
    every = worded.select("doc_id", "h1", "h2").join(first, "doc_id").join(nodes.select("h1", "h2", F.col("node").alias("b")), ["h1", "h2"])
    return every.where("a <> b").select("a", "b").distinct()


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id and class_id of every row: class_id is the smallest doc_id that links of 0.8 or more lead to.

    A node is one sequence of words, whatever rows hold it. Texts without words (null, empty, marks alone) are linked
    to nothing, and rows without doc_id have no class. A doc_id that occurs with several texts ties their classes
    together; its rows without words keep to themselves. Only doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("print"))
    signed = stash(rows.mapInArrow(sign, "doc_id long, print long, h1 long, h2 long, registers binary, bands binary"), "signed")
    worded = signed.where("h1 is not null and doc_id is not null")
    own = worded.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "print")).alias("least"), F.first("registers").alias("registers"), F.first("bands").alias("bands"))
    nodes = stash(own.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", F.col("least.doc_id").alias("doc_id"), F.col("least.print").alias("print"), "registers", "bands"), "nodes")
    spread = nodes.select("bands", "node").mapInArrow(spread_bands, "band long, node long")
    shared = spread.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = stash(spread.join(shared, "band").select("band", "node", "n"), "members")
    degree = members.groupBy("node").agg(F.count("*").alias("degree"))
    pivots = members.join(degree, "node").groupBy("band").agg(F.min(F.struct(-F.col("degree"), F.col("node"))).alias("p")).select("band", F.col("p.node").alias("pivot"))
    star = members.join(pivots, "band").where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    star = stash(star, "star")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "print")
    texts = stash(rows.join(wanted, ["doc_id", "print"]).groupBy("node").agg(F.min("text").alias("text")), "texts")
    links = verified(star, texts)
    found = stash(components(links), "components")
    more = further_links(members, found, nodes, texts)
    final = stash(joined(found, more.unionByName(of_one_id(worded, nodes))), "components")
    classed = nodes.join(final, "node", "left").select("h1", "h2", "doc_id", F.coalesce("component", "node").alias("component"))
    least = classed.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    named = signed.select("doc_id", "h1", "h2").join(classed.join(least, "component").select("h1", "h2", "class_id"), ["h1", "h2"], "left")
    return named.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
