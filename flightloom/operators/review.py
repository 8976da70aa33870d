"""Findings and actions from evidence and attributions, gap queries, normalised recommendations, and public records."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightloom.operators.retrieval import any_of

# Topics of a query's text, in order; severities of topics; topics of feature names, in order.
QUERY_TOPICS = [
    ("c2", ["command and control", "c2", "link reliability", "uplink", "downlink", "comms"]),
    ("weather", ["weather", "wind", "gust"]),
    ("airspace", ["airspace", "authorization", "restricted", "altitude", "agl"]),
    ("vlos", ["visual line of sight"]),
    ("ml_review", ["special condition"]),
    ("sora_volume", ["ground risk", "operational volume", "adjacent area", "containment"]),
]
INTENT_TOPICS = {"special_condition": "ml_review", "ac107": "airspace", "part107": "airspace", "sora": "sora_volume"}
# Of each topic the finding's text, the action's, and the severity of both.
TOPIC_TEXTS = {
    "weather": ("Weather and wind conditions require preflight assessment before mission launch.", "Review local weather, wind direction/speed, gusts, and define mission wind limits before flight.", "medium"),
    "airspace": ("Controlled/restricted airspace context requires authorization or operational review.", "Verify airspace class, authorization requirements, and no-fly/restriction proximity before launch.", "high"),
    "vlos": ("Visual line-of-sight operating requirements should be reviewed for this mission context.", "Confirm remote pilot/visual observer responsibilities and maintain VLOS constraints.", "medium"),
    "c2": ("Command-and-control link reliability is an operational concern for mission safety.", "Verify uplink/downlink reliability, contingency procedures, and lost-link behavior.", "high"),
    "ml_review": ("The ML risk signal warrants conservative operational review with evidence-backed mitigations.", "Review relevant operational limitations and mitigations before accepting mission risk.", "medium"),
    "sora_volume": ("Operational volume and ground-risk context should be evaluated using SORA-style risk controls.", "Review operational volume, adjacent area, containment, and mitigation assumptions.", "medium"),
    "general": ("Operational evidence indicates additional UAV mission review is warranted.", "Perform targeted operator review for this topic and confirm mission assumptions before launch.", "medium"),
}
GAP_REASON = "Evidence was insufficient for this query."
GAP_TEXT, GAP_ACTION = "Unresolved operational topic: ", "Treat this topic as unresolved and seek additional evidence/operator review."
NAME_TOPICS = {
    "weather": "weather wind gust turbulence thermal".split(),
    "airspace": "airspace no_fly nofly restricted geofence authorization".split(),
    "altitude": "altitude agl ceiling".split(),
    "c2": "comms uplink downlink c2 link telemetry lost_link".split(),
    "payload": "payload mass weight loading".split(),
    "swarm": "swarm multi_uas formation".split(),
    "ground_risk": "obstacle traffic landing landing_site population ground_risk adjacent_area operational_volume".split(),
    "faults": "fault failure degraded emergency".split(),
    "energy": "battery reserve endurance fuel energy".split(),
    "vlos": "vlos visual_line_of_sight line_of_sight los".split(),
}
# Topics of a signal's or planned query's words; the first that fits counts.
SIGNAL_TOPICS = {
    "weather": "weather wind gust turbulence thermal".split(),
    "airspace": "airspace no_fly restricted authorization altitude agl ceiling".split(),
    "c2": "comms uplink downlink c2 telemetry link".split(),
    "swarm": "swarm multi_uas formation".split(),
    "payload": "payload mass weight loading".split(),
    "energy": "battery reserve endurance energy flight_time".split(),
    "ground_risk": "obstacle traffic landing population ground_risk".split(),
    "vlos": "vlos visual line_of_sight los".split(),
}
# Words for recommendations (others are degraded), statuses, and keys that public records never hold, whole or in part.
RECOMMENDATIONS = {
    "go": "go", "approve": "go", "approved": "go",
    "caution": "caution", "conditional_go": "caution", "conditional": "caution",
    "no_go": "no_go", "reject": "no_go", "rejected": "no_go",
    "insufficient_evidence": "insufficient_evidence", "no_evidence": "insufficient_evidence",
}
STATUSES = ["skipped", "completed", "degraded", "failed"]
FORBIDDEN_KEYS = frozenset(
    """reasoning_steps chain_of_thought reasoning_chain thoughts thought raw_prompt prompt raw_completion completion raw_llm_response
    tool_history internal_memory scratchpad hidden api_key secret token authorization internal_reasoning private_reasoning""".split()
)
SECRET_PARTS = ["api_key", "apikey", "secret", "token", "authorization", "password", "bearer"]
TOO_DEEP = "[truncated-depth]"


def query_topic(query: Column, intent: Column) -> Column:
    """Topic of a query: its own words first, then its intent."""
    low, by_intent = F.lower(query), F.lit("general")
    for k, v in INTENT_TOPICS.items():
        by_intent = F.when(intent == k, v).otherwise(by_intent)
    out = None
    for topic, words in QUERY_TOPICS:
        hit = any_of(low, words) | ((intent == "special_condition") if topic == "ml_review" else F.lit(False))
        out = F.when(hit, topic) if out is None else out.when(hit, topic)
    return out.otherwise(by_intent)


def signal_topic(words: Column) -> Column:
    """The first of SIGNAL_TOPICS whose parts the words touch, inside words too; general where none does."""
    return topic_of_low(F.lower(words))


def topic_of_low(low: Column) -> Column:
    """signal_topic of words in lower case; inside a lambda, where nothing is shared, they are then lowered once."""
    out = F.lit("general")
    for name, parts in reversed(SIGNAL_TOPICS.items()):
        out = F.when(any_of(low, parts), name).otherwise(out)
    return out


def evidence_findings(bundles: DataFrame) -> DataFrame:
    """One row a bundle that says something: finding, its action and (of a gap) its limitation.

    (mission_id, query_id, topic, finding_type, severity, summary, action, limitation). A bundle that is at least
    partially supported and cites something is evidence-backed; an insufficient one is a high uncertainty, whose reason
    (no_evidence_reason, where the bundles have it) is told. Others say nothing.
    """
    topic = query_topic(F.col("query"), F.col("intent"))
    weak = F.col("support_status") == "insufficient_evidence"
    backed = F.col("support_status").isin("supported", "partially_supported") & (F.col("n_citations") > 0)
    said = F.col("no_evidence_reason") if "no_evidence_reason" in bundles.columns else F.lit(None).cast("string")
    reason = F.when(F.coalesce(said, F.lit("")) == "", GAP_REASON).otherwise(said)
    texts = F.create_map(*(F.lit(x) for k, v in TOPIC_TEXTS.items() for x in (k, " | ".join(v))))
    part = lambda i: F.split(F.element_at(texts, F.col("topic")), r" \| ")[i]
    held = bundles.where(weak | backed).select("mission_id", "query_id", topic.alias("topic"), weak.alias("weak"), "query", reason.alias("reason"))
    either = lambda gap, own, name: F.when(F.col("weak"), gap).otherwise(own).alias(name)
    return held.select(
        "mission_id", "query_id", "topic",
        either(F.lit("operational_uncertainty"), F.lit("evidence_backed"), "finding_type"), either(F.lit("high"), part(2), "severity"),
        either(F.concat(F.lit(GAP_TEXT), "reason"), part(0), "summary"), either(F.lit(GAP_ACTION), part(1), "action"),
        F.when(F.col("weak"), F.concat("query", F.lit(": "), "reason")).alias("limitation"),
    )


def name_topics(names: DataFrame, column: str = "feature") -> DataFrame:
    """(feature, topic, place) for each topic that a name's parts touch; names are few, missions many."""
    low = F.lower(column)
    each = F.array_compact(F.array(*(F.when(any_of(low, parts), F.struct(F.lit(t).alias("topic"), F.lit(i).alias("place"))) for i, (t, parts) in enumerate(NAME_TOPICS.items()))))
    return names.select(column, F.explode(each).alias("x")).select(column, "x.topic", "x.place")


def topic_findings(fields: DataFrame, attributions: DataFrame, backed: DataFrame, scenario_limit: int = 5, limit: int = 7) -> DataFrame:
    """(mission_id, topic, support_status): topics of scenario fields that evidence doesn't back yet, five at most, then those of attributions alone, seven in all.

    ``fields`` and ``attributions`` have (mission_id, feature), ``backed`` (mission_id, topic). Topics are found in each row
    and meet once, as the bits of three numbers a mission; no two tables of missions are joined.
    """
    low, names = F.lower("feature"), list(NAME_TOPICS)
    none = F.lit(0)
    touched = sum((F.when(any_of(low, parts), 1 << i).otherwise(0) for i, (_, parts) in enumerate(NAME_TOPICS.items())), none)
    known = sum((F.when(F.col("topic") == t, 1 << i).otherwise(0) for i, t in enumerate(names)), none)
    held = fields.select("mission_id", touched.alias("own"), none.alias("model"), none.alias("done"))
    held = held.unionByName(attributions.select("mission_id", none.alias("own"), touched.alias("model"), none.alias("done")))
    held = held.unionByName(backed.where("mission_id is not null").select("mission_id", none.alias("own"), none.alias("model"), known.alias("done")))
    bits = held.groupBy("mission_id").agg(*(F.coalesce(F.bit_or(c), none).alias(c) for c in ("own", "model", "done")))
    own = F.col("own").bitwiseAND(F.bitwise_not("done"))
    # A null mission_id is no key: nothing is left out for what another row of it says.
    said = F.col("done").bitwiseOR(F.when(F.col("mission_id").isNull(), 0).otherwise(F.col("own")))
    bits = bits.select("mission_id", own.alias("own"), F.col("model").bitwiseAND(F.bitwise_not(said)).alias("model"))
    listed = lambda c, status: F.array(*(F.when(F.col(c).bitwiseAND(1 << i) > 0, F.struct(F.lit(t).alias("topic"), F.lit(status).alias("support_status"))) for i, t in enumerate(names)))
    first = F.slice(F.array_compact(listed("own", "scenario_derived")), 1, scenario_limit)
    every = F.slice(F.concat(first, F.array_compact(listed("model", "model_explanation"))), 1, limit)
    return bits.where("own > 0 or model > 0").select("mission_id", F.explode(every).alias("x")).select("mission_id", "x.*")


def plan_gap_queries(plans: DataFrame, bundles: DataFrame, limit: int = 5) -> DataFrame:
    """(mission_id, query_id, topic, result): planned queries to run, or why one is skipped.

    ``plans`` has (mission_id, query_id, query, intent, place); ``bundles`` also support_status. The first planned
    query of a topic runs; ``over_limit`` marks those beyond ``limit``. A planned query's topic is the first whose
    parts its words touch (see SIGNAL_TOPICS), a bundle's is that of query_topic.
    """
    topic = query_topic(F.col("query"), F.col("intent"))
    done = bundles.select("mission_id", F.lower(F.trim("query")).alias("text"), F.lit(True).alias("done")).distinct()
    held = bundles.where(F.col("support_status").isin("supported", "partially_supported")).select("mission_id", topic.alias("topic"), F.lit(True).alias("held")).distinct()
    rows = plans.withColumn("topic", signal_topic(F.col("query"))).withColumn("text", F.lower(F.trim("query"))).join(done, ["mission_id", "text"], "left").join(held, ["mission_id", "topic"], "left")
    first = F.when(F.col("done"), "already_retrieved").when(F.col("held"), "topic_already_supported")
    nth = F.row_number().over(Window.partitionBy("mission_id", "topic", F.col("result").isNull()).orderBy("place"))
    chosen = rows.withColumn("result", first).withColumn("n", nth).withColumn("result", F.when(F.col("result").isNull() & (F.col("n") > 1), "duplicate_topic").otherwise(F.col("result")))
    place = F.row_number().over(Window.partitionBy("mission_id", F.col("result").isNull()).orderBy("place"))
    return chosen.withColumn("at", place).select("mission_id", "query_id", "topic", F.coalesce("result", F.when(F.col("at") <= limit, "run").otherwise("over_limit")).alias("result"))


def normalize_recommendations(rows: DataFrame, bundles: DataFrame) -> DataFrame:
    """mission_id, recommendation, status, confidence and auto_finding.

    ``rows`` has recommendation and confidence, and where they exist status, n_findings and structural (whether a
    finding is structural). Words become the known values, others degraded. A status that is none of STATUSES is
    completed, of degraded ones degraded. Confidence lies within [0, 1]; where there is none it is 0.5, of degraded and
    insufficient ones 0. A completed go, caution or no_go without findings gets one (auto_finding). Where any bundle is
    insufficient, all but a structural no_go become insufficient_evidence of 0.5 at most.
    """
    have = lambda c, else_: F.coalesce(F.col(c), F.lit(else_)) if c in rows.columns else F.lit(else_)
    word, out = F.regexp_replace(F.lower(F.trim("recommendation")), "-", "_"), F.lit("degraded")
    for k, v in RECOMMENDATIONS.items():
        out = F.when(word == k, v).otherwise(out)
    weak = bundles.where("support_status = 'insufficient_evidence'").select("mission_id", F.lit(True).alias("weak")).distinct()
    r, status = F.col("r"), F.lower(F.trim(have("status", "")))
    held = rows.select("mission_id", out.alias("r"), status.alias("s"), F.col("confidence"), have("n_findings", 0).alias("n"), have("structural", False).alias("structural"))
    held = held.withColumn("status", F.when(F.col("s").isin(STATUSES), F.col("s")).when(r == "degraded", "degraded").otherwise("completed"))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.when(r.isin("degraded", "insufficient_evidence"), 0.0).otherwise(0.5))))
    back = F.coalesce("weak", F.lit(False)) & ~((r == "no_go") & F.col("structural"))
    auto = r.isin("go", "caution", "no_go") & (F.col("status") == "completed") & (F.col("n") == 0)
    return held.join(weak, "mission_id", "left").select("mission_id", F.when(back, "insufficient_evidence").otherwise(r).alias("recommendation"), "status", F.when(back, F.least(sure, F.lit(0.5))).otherwise(sure).alias("confidence"), auto.alias("auto_finding"))


def manifest_integrity(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """(code, source_id): sources without chunks, chunks of unknown sources, and sources whose count differs from the manifest's."""
    held = chunks.groupBy("source_id").agg(F.count("*").alias("n"))
    both = manifest.select("source_id", F.col("chunk_count").alias("declared")).join(held, "source_id", "full")
    code = F.when(F.col("declared").isNull(), "unknown_source").when(F.col("n").isNull(), "zero_chunk_source").when(F.col("n") != F.col("declared"), "chunk_count_mismatch")
    return both.select(code.alias("code"), "source_id").where("code is not null")


def clean(value: object, depth: int = 0, allowed: frozenset[str] | None = None, text: int = 500, items: int = 64, levels: int = 8) -> object:
    """A JSON value without forbidden keys, and with long texts cut (three dots at the end), long lists cut, deep levels marked and numbers that aren't finite null. ``allowed``: keys of the top level that are kept."""
    if depth >= levels:
        return TOO_DEEP
    if isinstance(value, dict):
        kept = ((k, v) for k, v in value.items() if allowed is None or k in allowed)
        return {k: clean(v, depth + 1) for k, v in kept if (low := k.strip().lower()) not in FORBIDDEN_KEYS and not any(p in low for p in SECRET_PARTS)}
    if allowed is not None:
        return {}
    if isinstance(value, list):
        return [clean(v, depth + 1) for v in value[:items]]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value[: text - 3] + "..." if isinstance(value, str) and len(value) > text else value


def sanitize_public(column: str, allowed: list[str] | None = None) -> Column:
    """A JSON text column made fit for the public; null where it can't be read. ``allowed``: the only keys of the top level that stay; what is no object is then an empty one."""
    keys = None if allowed is None else frozenset(allowed)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(clean(json.loads(t), 0, keys), sort_keys=True, ensure_ascii=False)
            except (ValueError, RecursionError):
                return None

        return texts.map(one)

    return cleaned(F.col(column))
