"""Product codes of vectors: whole-number codebooks for equal parts of a vector, learned in rounds over all rows.

The nearest entry of a part is found through memoised grid cells. A part lies in a cell of a coarse grid; an entry that
another one beats all over the cell's box, by the least and greatest values of their distances there, can be nearest to
no part in it. What is left is kept for the cell, under the cell's hash, and a part is compared exactly with the entries of its cell
only. A cell is worked out when a task first meets it and serves all later parts; a hash that two cells share is told by
the cells' coordinates, and the part that doesn't own it is compared with all entries.

Components are floor(scale * x). All distances are sums of whole numbers, exact in the number type that is used.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom.llm.common import give_back, mix, stash

#: Side of a cell as a power of two, cells that a task keeps for a part position, and rows that are worked on at once.
SIDE_BITS, CELLS, ROWS = 9, 1 << 16, 4096
#: Whole components beyond this have no exact distances in 64 bits.
FAR = 1 << 24


class Cells:
    """The memo of one part position: cells by hash, with the entries that may be nearest in each as bits."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries, self.evaluated, self.hits = entries, 0, 0
        self.exact = np.float64 if np.abs(entries).max(initial=0) * entries.shape[1] < 1 << 19 else np.int64
        self.hash, self.at, self.near = np.zeros(0, np.uint64), np.zeros((0, entries.shape[1]), np.int64), np.zeros((0, len(entries)), bool)

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """Of each cell's box: which entries no other one beats everywhere in it.

        Entry f beats e where the greatest value that d(x, f) - d(x, e) takes in the box is below zero; squares of x cancel,
        so this is a linear function's maximum. It holds wherever e's least distance is above f's greatest.
        """
        middle = ((cells << SIDE_BITS) * 2 + (1 << SIDE_BITS) - 1).astype(self.exact)
        norm = (self.entries**2).sum(axis=1)
        out = np.ones((len(cells), len(self.entries)), bool)
        for f, entry in enumerate(self.entries):
            slope = 2 * (self.entries - entry)
            rest = 2 * (norm[f] - norm) + np.abs(slope).sum(axis=1) * ((1 << SIDE_BITS) - 1)
            out &= middle @ slope.T.astype(self.exact) + rest >= 0
        return out

    def look_up(self, cells: np.ndarray) -> np.ndarray:
        """The entries that may be nearest, for each row's cell."""
        hashes = np.full(len(cells), 7, np.uint64)
        for j in range(cells.shape[1]):
            hashes = mix(hashes ^ cells[:, j].astype(np.uint64))
        found = np.searchsorted(self.hash, hashes)
        held = np.zeros(len(cells), bool)
        inside = found < len(self.hash)
        held[inside] = self.hash[found[inside]] == hashes[inside]
        self.hits += int(held.sum())
        new, first = np.unique(hashes[~held], return_index=True)
        if len(new):
            if len(self.hash) + len(new) > CELLS:  # start anew: memory stays bounded
                self.hash, self.at, self.near = self.hash[:0], self.at[:0], self.near[:0]
                new, first = np.unique(hashes, return_index=True)
                where = cells[first]
            else:
                where = cells[~held][first]
            order = np.argsort(np.concatenate([self.hash, new]), kind="stable")
            self.hash = np.concatenate([self.hash, new])[order]
            self.at = np.concatenate([self.at, where])[order]
            self.near = np.concatenate([self.near, self.undominated(where)])[order]
            found = np.searchsorted(self.hash, hashes)
        own = (self.at[found] == cells).all(axis=1)
        return self.near[found] | ~own[:, None]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each part's nearest entry, the first of equals, and its squared distance."""
        near = self.look_up(parts >> SIDE_BITS)
        best, index = np.full(len(parts), np.iinfo(np.int64).max), np.zeros(len(parts), np.int64)
        for e, entry in enumerate(self.entries):
            rows = np.flatnonzero(near[:, e])
            self.evaluated += len(rows)
            distance = ((parts[rows] - entry) ** 2).sum(axis=1)
            closer = distance < best[rows]
            best[rows[closer]], index[rows[closer]] = distance[closer], e
        return index, best


def part_matrix(column: pa.Array, parts: int) -> np.ndarray:
    """(part position, row, component) of whole vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), parts, -1).transpose(1, 0, 2)


def blocks(batches: Iterator[pa.RecordBatch], cells: list[Cells]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            rows = batch.slice(a, ROWS)
            x = part_matrix(rows.column("whole"), len(cells))
            yield rows, x, [c.nearest(p) for c, p in zip(cells, x)]


def add_up(books: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's vectors: for each part position and entry, how many parts are nearest to it and their sums."""
    many, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
    for _, x, found in blocks(batches, [Cells(b) for b in books]):
        for p, (index, _) in enumerate(found):
            many[p] += np.bincount(index, minlength=books.shape[1])
            np.add.at(sums[p], index, x[p])
    part, entry = np.nonzero(many)
    yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "many": many[part, entry], "sums": pa.array(list(sums[part, entry]), pa.list_(pa.int64()))})
    give_back()


def encode(books: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, _, found in blocks(batches, [Cells(b) for b in books]):
        digits = np.array([f"{e:02x}" for e in range(books.shape[1])])
        code = np.array([""])
        for index, _ in found:
            code = np.char.add(code, digits[index])
        error = np.sum([d for _, d in found], axis=0)
        yield pa.RecordBatch.from_pydict({"vec_id": rows.column("vec_id"), "label": rows.column("label"), "code": pa.array(code.astype(object), pa.string()), "error": error})
    give_back()


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as a double; null where the vector is null or holds a null or non-finite component."""
    wide = vector.cast("array<double>")
    good = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    far = F.exists(wide, lambda x: F.abs(x) * scale > FAR)
    return F.when(good & far, F.raise_error("a component is too large for exact squared distances in 64 bits").cast("array<long>")).when(good, F.transform(wide, lambda x: F.floor(x * scale)))


class Codes:
    """Learned codebooks, (part position, entry, component), and the whole vectors that they were learned from."""

    def __init__(self, books: np.ndarray, rows: DataFrame, total: int) -> None:
        self.books, self.rows, self.total = books, rows, total

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def encoded(self) -> DataFrame:
        """vec_id, label, code (two hex digits a part), error (squared distances of all parts)."""
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.rows.schema if f.name in ("vec_id", "label"))
        return self.rows.mapInArrow(partial(encode, self.books), f"{kinds}, code string, error long")


def learn_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> Codes | None:
    """Codebooks of whole parts, over all usable rows in every round; None without any.

    Rows whose vector is null or holds a null or non-finite component take no part. The vector of the smallest vec_id
    (null last, equal ones by components) gives the length; rows of other lengths, and all rows if ``parts`` doesn't divide it,
    take no part either. Entries start as the parts of the ``entries`` first rows in that order (all, if fewer; repeated rows
    each are one), are replaced by their parts' floor(sum / count), and stay where no part is nearest; equal entries leave
    the part to the first. What comes to the driver are the sums of parts * entries entries. Components beyond 2**24 / scale are an error.
    """
    kept = vectors.select("vec_id", "label", whole(F.col("embedding"), scale).alias("whole")).where("whole is not null")
    rows = stash(kept, "whole-vectors")
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").select("whole").limit(1).collect()
    size = len(first[0]["whole"]) if first else 0
    if not first or size % parts:
        return None
    rows = rows.where(F.size("whole") == size)
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").select("whole").limit(entries).collect()
    books = np.array([x["whole"] for x in start], np.int64).reshape(len(start), parts, size // parts).transpose(1, 0, 2)
    total = 0
    for _ in range(rounds):
        sums = rows.mapInArrow(partial(add_up, books), "part int, entry int, many long, sums array<long>")
        every = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size // parts)]
        books, total = books.copy(), 0
        for x in sums.groupBy("part", "entry").agg(F.sum("many").alias("many"), *every).collect():
            books[x["part"], x["entry"]] = [x[f"s{i}"] // x["many"] for i in range(size // parts)]
            total += x["many"] if x["part"] == 0 else 0
    return Codes(books, rows, total)


def with_group_totals(rows: DataFrame, key: str, value: str, total: int, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over rows of equal ``key``, nulls together, on every row. ``rows`` is a written table of ``total`` rows.

    Keys of a thousandth of the rows or more are a thousand at most and are broadcast; the others are joined by key.
    """
    sums = stash(rows.groupBy(F.col(key).alias("_key")).agg(F.sum(value).alias(name), F.count("*").alias("_many")), "totals")
    large = F.col("_many") * 1000 >= total
    hot = sums.where(large).select("_key", name)
    rest = sums.where(~large).select("_key", name)
    same = F.col(key).eqNullSafe(F.col("_key"))
    return rows.join(F.broadcast(hot), same).drop("_key").unionByName(rows.join(F.broadcast(hot), same, "left_anti").join(rest, same).drop("_key"))


def vector_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (errors of equal labels, nulls together) and codebooks_sha256, a row for each row that takes part.

    See ``learn_codes`` for what takes part; a null vec_id is kept. Only vec_id, embedding and label are read. An empty table gives no row.
    """
    codes = learn_codes(vectors)
    if codes is None:
        return vectors.limit(0).selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    made = with_group_totals(stash(codes.encoded(), "codes"), "label", "error", codes.total, "label_error")
    return made.select("vec_id", "code", "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256"))
