"""What past queries teach, as a batch fold and as a stream with keyed state; missions and logs as streams."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flightloom.operators import validate as V
from flightloom.operators.assessment import assess_missions
from flightloom.operators.ordering import place_in_group
from flightloom.operators.records import build_records
from flightloom.sources.tables import write_assessments
from flightloom.streaming.keyed import LearnedProfile, Thresholds, needs_rocksdb

LEARNED = "scenario_type string, query_count long, avg_top_score double, hyde_success_rate double, optimal_k int"
START = (0, 0.0, 0.0, 60)
#: Bounds of k, and the least minimum with its step below the mean.
LOW_K, HIGH_K = 20, 120
FLOOR, STEP = 0.25, 0.05
#: Rows whose windows of scores one task computes.
BLOCK = 10_000


def step_of(mean: float) -> int:
    """How k moves at a mean score; the mean is held to twelve places, so that sums in any order agree."""
    mean = round(mean, 12)
    return -5 if mean > 0.6 else 10 if mean < 0.3 else 0


def learn(state: tuple, top_score: float, used_hyde: bool) -> tuple:
    """State (count, mean score, share of successes by widened queries over all queries so far, k) after one more query."""
    n, mean, share, k = state
    n += 1
    mean = (mean * (n - 1) + top_score) / n
    if used_hyde:
        share = (share * (n - 1) + (1.0 if top_score > 0.5 else 0.0)) / n
    return n, mean, share, min(HIGH_K, max(LOW_K, k + step_of(mean)))


def fold(rows: pd.DataFrame, state: tuple = START) -> tuple:
    for score, hyde in zip(rows["top_score"], rows["used_hyde"]):
        state = learn(state, float(score), bool(hyde))
    return state


def usable(history: DataFrame) -> DataFrame:
    """Rows with a score; a null used_hyde is false."""
    held = history.where("top_score is not null and not isnan(top_score)")
    return held.select("scenario_type", F.col("top_score").cast("double").alias("top_score"), F.coalesce("used_hyde", F.lit(False)).alias("used_hyde"), "timestamp", "entry_id")


def part_effect(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """What the queries of one part do to any state before them: the share becomes by * share + plus, k becomes k + move held within low and high."""
    by, plus, move, low, high = 1.0, 0.0, 0, LOW_K, HIGH_K
    rows = rows.sort_values("place")
    for n, total, score, hyde in zip(rows["place"].tolist(), rows["total"].tolist(), rows["top_score"].tolist(), rows["used_hyde"].tolist()):
        if hyde:
            by, plus = by * (n - 1) / n, (plus * (n - 1) + (1.0 if score > 0.5 else 0.0)) / n
        step = step_of(total / n)
        move, low, high = move + step, min(HIGH_K, max(LOW_K, low + step)), min(HIGH_K, max(LOW_K, high + step))
    last = rows.iloc[-1]
    return pd.DataFrame([(key[0], int(last["place"]), last["total"] / last["place"], by, plus, move, low, high)], columns=EFFECT)


EFFECT = ["scenario_type", "n", "mean", "by", "plus", "move", "low", "high"]


def learn_scenario_profiles(history: DataFrame, part: str = "day") -> DataFrame:
    """Learned values of each scenario type, its queries in order of time and entry_id; rows without a score take no part.

    The rule depends on the order, but what a run of queries does to any state before it is five numbers. So a type is
    cut into parts by time (``part``, a unit of date_trunc: choose one whose rows of a type fit a task), each part is
    worked out by itself from the sums before it, and only one row a part is applied in order.
    """
    placed = place_in_group(usable(history), "scenario_type", F.date_trunc(part, "timestamp"), ["timestamp", "entry_id"], "top_score")
    held = placed.select("scenario_type", "part", "place", "total", "top_score", "used_hyde")
    effects = held.groupBy("scenario_type", "part").applyInPandas(part_effect, "scenario_type string, n long, mean double, by double, plus double, move int, low int, high int")
    each = effects.groupBy("scenario_type").agg(F.array_sort(F.collect_list(F.struct(*EFFECT[1:]))).alias("parts"))
    share = F.aggregate("parts", F.lit(START[2]), lambda x, e: x * e["by"] + e["plus"])
    k = F.aggregate("parts", F.lit(START[3]), lambda x, e: F.least(e["high"], F.greatest(e["low"], x + e["move"])))
    last = F.element_at("parts", -1)
    return each.select("scenario_type", last["n"].alias("query_count"), last["mean"].alias("avg_top_score"), share.alias("hyde_success_rate"), k.alias("optimal_k"))


def stream_scenario_profiles(stream: DataFrame) -> DataFrame:
    """The same as a stream: each batch's rows of a type, in order of time and entry_id, on from its state; emits the state after each batch. Needs the RocksDB state store."""
    rows = usable(needs_rocksdb(stream))
    return rows.groupBy("scenario_type").transformWithStateInPandas(LearnedProfile(learn, START), LEARNED, "Update", "None")


def starting_minimum(corpus_size: int) -> float:
    return min(0.55, 0.35 + 0.02 * corpus_size / 1000)


def lowered(scores: Sequence[float], minimum: float) -> float:
    """The minimum after one more score, of the last scores: from twenty on, a mean below it takes it to STEP under that mean, FLOOR at least."""
    mean = round(sum(scores) / len(scores), 12)
    return max(FLOOR, mean - STEP) if len(scores) >= 20 and mean < minimum else minimum


def stream_thresholds(stream: DataFrame, corpus_size: int, window: int = 100, key: str | None = None) -> DataFrame:
    """adaptive_thresholds as a stream: a row a score, from the state that the batches before left. Needs the RocksDB state store.

    A batch's rows of a key are taken in order of time and entry_id; a batch goes on where the one before ended, so the
    stream equals the batch where batches follow each other in time. Without ``key`` there is one history, and one task.
    """
    start, names = starting_minimum(corpus_size), [key] if key else []
    rows = needs_rocksdb(stream).where("top_score is not null and not isnan(top_score)")
    rows = rows.select("entry_id", "timestamp", F.col("top_score").cast("double").alias("top_score"), (F.col(key) if key else F.lit("all")).alias("key"))
    kinds = f"key {rows.schema['key'].dataType.simpleString()}, entry_id {rows.schema['entry_id'].dataType.simpleString()}, minimum double"
    out = rows.groupBy("key").transformWithStateInPandas(Thresholds(lowered, start, window), kinds, "Append", "None")
    return out.select(*(F.col("key").alias(n) for n in names), "entry_id", "minimum", F.lit(start + 0.10).alias("hyde_trigger"), F.lit(start + 0.15).alias("rerank_cutoff"))


def adaptive_thresholds(scores: DataFrame, corpus_size: int, window: int = 100, key: str | None = None, part: str = "hour") -> DataFrame:
    """entry_id, the minimum after each score in order, and the two cut-offs that the corpus alone sets; one history, or one for each ``key``.

    From twenty scores on, where the mean of the last ``window`` falls below the minimum, the minimum drops to just under
    that mean. Each drop is of more than STEP or ends at FLOOR, so there are a few at most, whatever the number of rows:
    each is the first mean below the one before, found by an aggregation over those means that are new lows of their block.
    """
    start = starting_minimum(corpus_size)
    names = [key] if key else []
    held = scores.where("top_score is not null and not isnan(top_score)").select("entry_id", "timestamp", "top_score", (F.col(key) if key else F.lit(0)).alias("_key"))
    placed = place_in_group(held, "_key", F.date_trunc(part, "timestamp"), ["timestamp", "entry_id"]).select("_key", "entry_id", "place", F.col("top_score").cast("double").alias("score"))
    size = max(BLOCK, window)
    block = F.floor((F.col("place") - 1) / size)
    seam = (F.col("place") - 1) % size >= size - window + 1  # the next block's windows begin in these rows
    blocks = F.when(seam, F.array(block, block + 1)).otherwise(F.array(block))
    dealt = placed.withColumn("block", F.explode(blocks)).withColumn("own", F.col("block") == block)
    order = Window.partitionBy("_key", "block").orderBy("place")
    frame = order.rowsBetween(-(window - 1), 0)
    means = dealt.withColumn("mean", F.when((F.count("*").over(frame) >= 20) & F.col("own"), F.round(F.avg("score").over(frame), 12)))
    lows = means.withColumn("low", F.min("mean").over(order.rowsBetween(Window.unboundedPreceding, -1))).where(F.col("mean") < F.least(F.lit(start), F.coalesce("low", F.lit(start))))
    lows = lows.select("_key", "place", "mean").repartition("_key", "place")
    last, drops = lows.groupBy("_key").agg(F.min(F.struct("place", "mean")).alias("m")), []
    for _ in range(math.ceil(round((start - FLOOR) / STEP, 9))):
        now = last.select(F.col("_key").alias("k"), F.col("m.place").alias("at"), F.greatest(F.lit(FLOOR), F.col("m.mean") - STEP).alias("least"))
        drops.append(now)
        last = lows.join(now, F.col("_key").eqNullSafe(F.col("k"))).where("place > at and mean < least").groupBy("_key").agg(F.min(F.struct("place", "mean")).alias("m"))
    every = drops[0]
    for now in drops[1:]:
        every = every.unionByName(now)
    every = every.groupBy("k").agg(F.collect_list(F.struct("at", "least")).alias("drops"))
    so_far = F.aggregate(F.coalesce("drops", F.array()), F.lit(start), lambda x, d: F.when(d["at"] <= F.col("place"), F.least(x, d["least"])).otherwise(x))
    out = placed.join(every, F.col("_key").eqNullSafe(F.col("k")), "left")
    return out.select(*(F.col("_key").alias(n) for n in names), "entry_id", so_far.alias("minimum"), F.lit(start + 0.10).alias("hyde_trigger"), F.lit(start + 0.15).alias("rerank_cutoff"))


def stream_assess(stream: DataFrame, profiles: DataFrame, bundles: DataFrame, attributions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Missions of a stream with their status, issue codes, recommendation and decision (see assess_missions), and their columns ``keep``; profiles, bundles and attributions are tables. Stateless."""
    return assess_missions(V.join_profiles(stream, profiles), bundles, attributions, keep=keep)


OF_RECORD = ("mission_user_id", "mission_profile_id", "created_at")


def stream_records(stream: DataFrame, profiles: DataFrame, bundles: DataFrame, attributions: DataFrame, path: str, checkpoint: str):
    """Assess the missions of a stream and store their records under ``path`` as write_assessments does; all that is there is done, then it stops.

    Each batch writes the parts that carry its number, so a batch that is run again after a failure replaces what it wrote.
    """
    decided = stream_assess(stream, profiles, bundles, attributions, OF_RECORD)

    def store(rows: DataFrame, batch: int) -> None:
        write_assessments(build_records(rows), path, batch)

    return decided.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_evidence_log(stream: DataFrame, path: str, checkpoint: str):
    """Append entries of a stream as JSON lines; all that is there is written, then it stops."""
    return stream.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
