"""Keyed state for streams whose rule depends on the order of rows (transformWithState, RocksDB).

A batch's rows of a key come in chunks and in no order. A chunk is sorted and, unless it is the only one, put into the
state store as a run of blocks; the runs are then merged, one block of each in memory, and taken out again. So a task
holds a chunk and a few blocks, never all rows that a batch has of one key.
"""

from __future__ import annotations

import heapq
import pickle
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Rows of a run that are read at once.
RUN_BLOCK = 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def needs_rocksdb(stream: DataFrame) -> DataFrame:
    """The stream; an error where the session keeps state in another store, which can't hold keyed lists and maps."""
    held = stream.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass")
    if not held.endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {ROCKSDB}")
    return stream


class Ordered(StatefulProcessor):
    """Rows of a key in the order of ``by``, whatever chunks they come in."""

    by: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", "run int, block int", "rows binary")

    def in_order(self, chunks: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """Plain tuples of each row; the columns are those of the chunks."""
        held, blocks = None, []
        for chunk in chunks:
            if held is not None:
                blocks.append(self.put_away(len(blocks), held))
            held = chunk
        if held is None or not len(held):
            return
        self.columns = list(held.columns)
        if not blocks:
            yield from held.sort_values(self.by, kind="stable").itertuples(index=False, name=None)
            return
        blocks.append(self.put_away(len(blocks), held))
        keys = [self.columns.index(c) for c in self.by]
        yield from heapq.merge(*(self.taken_out(run, many) for run, many in enumerate(blocks)), key=lambda x: [x[i] for i in keys])

    def put_away(self, run: int, chunk: pd.DataFrame) -> int:
        rows = list(chunk.sort_values(self.by, kind="stable").itertuples(index=False, name=None))
        starts = range(0, len(rows), RUN_BLOCK)
        for block, a in enumerate(starts):
            self.runs.updateValue((run, block), (pickle.dumps(rows[a : a + RUN_BLOCK]),))
        return len(starts)

    def taken_out(self, run: int, many: int) -> Iterator[tuple]:
        for block in range(many):
            rows = pickle.loads(bytes(self.runs.getValue((run, block))[0]))
            self.runs.removeKey((run, block))
            yield from rows

    def close(self) -> None:
        pass


class LearnedProfile(Ordered):
    """One state of learned settings a scenario type; the state after each batch is put out."""

    by = ["timestamp", "entry_id"]

    def __init__(self, learn, start: tuple) -> None:
        self.learn, self.start = learn, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("learned", "n long, mean double, share double, k int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, at = self.state.get() or self.start, None
        for x in self.in_order(rows):
            at = at or (self.columns.index("top_score"), self.columns.index("used_hyde"))
            now = self.learn(tuple(now), float(x[at[0]]), bool(x[at[1]]))
        self.state.update(tuple(now))
        yield pd.DataFrame([(key[0], *now)], columns=["scenario_type", "query_count", "avg_top_score", "hyde_success_rate", "optimal_k"])


class Thresholds(Ordered):
    """The last ``window`` scores of a key as a list, and the minimum so far as a value; a row is put out for each score."""

    by = ["timestamp", "entry_id"]

    def __init__(self, lowered, start: float, window: int) -> None:
        self.lowered, self.start, self.window = lowered, start, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ring = handle.getListState("ring", "score double")
        self.minimum = handle.getValueState("minimum", "minimum double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ring = deque((x[0] for x in self.ring.get()), maxlen=self.window)
        least, at, out = (self.minimum.get() or (self.start,))[0], None, []
        for x in self.in_order(rows):
            at = at or (self.columns.index("entry_id"), self.columns.index("top_score"))
            ring.append(float(x[at[1]]))
            least = self.lowered(ring, least)
            out.append((key[0], x[at[0]], least))
            if len(out) == 10 * RUN_BLOCK:
                yield pd.DataFrame(out, columns=["key", "entry_id", "minimum"])
                out = []
        self.ring.put([(x,) for x in ring])
        self.minimum.update((least,))
        yield pd.DataFrame(out, columns=["key", "entry_id", "minimum"])
