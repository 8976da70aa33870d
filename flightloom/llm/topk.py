"""Exact top-k by inner product without random access (NRA) over sorted lists.

Vectors come in blocks. For each dimension a block has a list sorted by value, which a query reads from the end that
helps it. All lists are read to one depth after another, and what is newly read is added to each vector's sum, so a
vector's score lies between a lower bound (the lists that it wasn't met in yet at their least values) and an upper one
(at their frontiers). A query stops reading once few vectors have an upper bound that reaches its k-th best lower bound
(of this block or of the scores already resolved); these vectors' scores are then resolved in full. The bounds of all
queries that still read are kept together, as matrices.

Scores are whole numbers: components are floor(256 x). Sums are exact in the float type that is used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightloom.llm.common import mix

BLOCK = 4096
#: Queries that a batch sends to all tasks.
BATCH = 2048
#: Parts of the lists that are read in turn, and vectors left for a query at which it stops reading.
DEPTHS, FEW = (0.06, 0.12, 0.2, 0.3, 0.45, 0.65, 1.0), 24


def whole_vectors(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, components) of the usable vectors, by length."""
    offsets = np.concatenate([[0], np.cumsum(vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    length = np.diff(offsets)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ok = (bad[offsets[1:]] == bad[offsets[:-1]]) & ids.is_valid().to_numpy(zero_copy_only=False) & vectors.is_valid().to_numpy(zero_copy_only=False) & (length > 0)
    own = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(length[ok]).tolist():
        at = np.flatnonzero(ok & (length == n))
        yield own[at], np.floor(256 * flat[offsets[at][:, None] + np.arange(n)])


def prints(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row, by which repeated rows are told from several vectors of one id."""
    place = np.arange(x.shape[1], dtype=np.uint64) << np.uint64(32)
    return mix(np.bitwise_xor.reduce(mix(x.astype(np.int64).view(np.uint64) ^ mix(place)), axis=1)).view(np.int64)


class Best:
    """The k best (score, id, print) of each query so far; a repeated row counts once."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.q, self.id, self.print, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.floor = np.full(queries, -np.inf)

    def add(self, q: np.ndarray, ids: np.ndarray, prints: np.ndarray, score: np.ndarray) -> None:
        held = [np.append(x, y) for x, y in ((self.q, q), (self.id, ids), (self.print, prints), (self.score, score))]
        order = np.lexsort((held[2], held[1], -held[3], held[0]))
        q, ids, prints, score = (x[order] for x in held)
        new = np.ones(len(q), bool)
        new[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]) | (prints[1:] != prints[:-1])
        q, ids, prints, score = q[new], ids[new], prints[new], score[new]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        kept = rank < self.k
        self.q, self.id, self.print, self.score = q[kept], ids[kept], prints[kept], score[kept]
        last = rank[kept] == self.k - 1
        self.floor[self.q[last]] = self.score[last]


def read_lists(x: np.ndarray, ids: list[np.ndarray], queries: np.ndarray, query_ids: np.ndarray, best: Best) -> None:
    """One block of distinct vectors: ids[i] are the (at most k + 1) smallest ids of x[i]."""
    n, k, own = len(x), best.k, prints(x)
    exact = np.float32 if 2 * x.shape[1] * max(1, np.abs(x).max(initial=0)) * max(1, np.abs(queries).max(initial=0)) < 1 << 24 else np.float64
    x = x.astype(exact)
    up, down = np.maximum(queries, 0).astype(exact).T, np.minimum(queries, 0).astype(exact).T
    ranked = np.sort(x, axis=0)
    least, most = ranked[0], ranked[-1]
    reading = np.arange(len(queries))
    lower = np.repeat((least @ up + most @ down)[None, :], n, axis=0)
    top, bottom = np.zeros(x.shape, bool), np.zeros(x.shape, bool)  # met in the list from its top, from its bottom
    for depth in DEPTHS:
        read = min(n, int(np.ceil(depth * n)))
        high, low = ranked[n - read], ranked[read - 1]  # frontiers
        now_top, now_bottom = x >= high, x <= low
        lower += np.where(now_top & ~top, x - least, 0) @ up + np.where(now_bottom & ~bottom, x - most, 0) @ down
        top, bottom = now_top, now_bottom
        floor = best.floor[reading]
        if n > k:  # one of the best may be the query's own row
            floor = np.maximum(floor, np.partition(lower, n - k - 1, axis=0)[n - k - 1])
        left = lower + np.where(top, 0, high - least) @ up + np.where(bottom, 0, low - most) @ down >= floor
        stop = left.sum(axis=0) <= FEW if read < n else np.ones(len(reading), bool)
        if stop.any():
            row, q = np.nonzero(left[:, stop])
            resolve(x, own, ids, row, reading[stop][q], queries, query_ids, best)
            reading, lower, up, down = reading[~stop], lower[:, ~stop], up[:, ~stop], down[:, ~stop]
        if not len(reading):
            return


def resolve(x: np.ndarray, own: np.ndarray, ids: list[np.ndarray], row: np.ndarray, q: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, best: Best) -> None:
    """Full scores of the vectors that are left, ``row`` for query ``q``; the query's own id is left out."""
    many = np.array([len(i) for i in ids])
    for a in range(0, len(row), 1 << 18):
        r, p = row[a : a + (1 << 18)], q[a : a + (1 << 18)]
        score = np.einsum("ij,ij->i", x[r].astype(np.float64), queries[p])
        named = np.concatenate([ids[i] for i in r])
        r, p, score = (np.repeat(y, many[r]) for y in (r, p, score))
        other = named != query_ids[p]
        best.add(p[other], named[other], own[r[other]], score[other])


def search(sent, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k best of a task's vectors for each query of the batch."""
    by_length: dict[int, tuple[np.ndarray, np.ndarray, Best]] = {n: (ids, q, Best(len(ids), k)) for n, (ids, q) in sent.value.items()}
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            for ids, x in whole_vectors(part.column("vec_id"), part.column("embedding")):
                if x.shape[1] not in by_length:
                    continue
                query_ids, queries, best = by_length[x.shape[1]]
                order = np.argsort(ids, kind="stable")
                distinct, inverse = np.unique(x[order], axis=0, return_inverse=True)
                inverse = inverse.ravel()
                by_vector = np.argsort(inverse, kind="stable")
                edges = np.searchsorted(inverse[by_vector], np.arange(len(distinct) + 1))
                own = ids[order][by_vector]
                # of equal vectors only the k + 1 smallest ids can be among the k best others
                read_lists(distinct, [np.unique(own[a:b])[: k + 1] for a, b in zip(edges[:-1], edges[1:])], queries, query_ids, best)
    for query_ids, _, best in by_length.values():
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[best.q]), pa.array(best.id), pa.array(best.print), pa.array(best.score.astype(np.int64))], names=["query_id", "vec_id", "print", "score"])


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among all other rows, ties to the smaller vec_id.

    Rows whose vec_id is null, or whose vector is null, empty or holds a null or non-finite component, take no part;
    a query meets vectors of its own length. A repeated row counts once; several vectors of one id are several rows,
    and of one query's several vectors the least asks. Only vec_id and embedding are read. Queries go to the tasks in
    batches of BATCH, so what is sent is bounded; each batch reads all vectors.
    """
    spark = vectors.sparkSession
    candidates = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(256 * x).cast("double")).alias("e")
    odd = F.exists(F.col("embedding").cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = queries.where("vec_id is not null and size(embedding) > 0").where(~odd).select(F.col("vec_id").cast("long"), whole).groupBy("vec_id").agg(F.min("e").alias("e"))
    batches = max(1, -(-own.count() // BATCH))
    parts = []
    for b in range(batches):
        held = own.where(F.pmod(F.xxhash64("vec_id"), F.lit(batches)) == b).toPandas()  # about BATCH vectors
        length = held["e"].map(len)
        usable = {int(n): (held["vec_id"][length == n].to_numpy(np.int64), np.stack(held["e"][length == n])) for n in sorted(set(length))}
        sent = spark.sparkContext.broadcast(usable)
        parts.append(candidates.mapInArrow(lambda x, sent=sent: search(sent, k, x), "query_id long, vec_id long, print long, score long"))
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    ordered = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
