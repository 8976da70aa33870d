"""Findings from a mission and its profile, stage contributions, the weighted decision and its confidence.

All tables are keyed by mission_id. A stage's contribution is one aggregation on that key, or a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightloom import schemas as S
from flightloom.operators.scoring import best_class

# Topics by parts of a name, parts of great concern, and scores of severities.
DECISION_TOPICS = {
    "weather": "weather wind gust turbulence thermal".split(),
    "airspace": "airspace no_fly restricted altitude agl ceiling".split(),
    "c2": "comms uplink downlink c2 link telemetry".split(),
    "payload": "payload mass weight loading".split(),
    "swarm": "swarm multi_uas formation".split(),
    "ground_risk": "ground_risk population adjacent_area operational_volume traffic obstacle landing".split(),
    "energy": "battery reserve endurance fuel energy".split(),
    "faults": "fault failure degraded emergency".split(),
    "vlos": "vlos visual_line_of_sight line_of_sight los".split(),
}
GREAT_CONCERN = "airspace no_fly restricted comms fault failure swarm".split()
SEVERITY = {"info": 0.05, "low": 0.15, "medium": 0.40, "high": 0.70, "critical": 0.95}


@dataclass(frozen=True)
class Policy:
    ml: float = 0.22
    shap: float = 0.10
    rag: float = 0.28
    agent: float = 0.25
    scenario_profile: float = 0.10
    llm: float = 0.05
    go: float = 0.35
    no_go: float = 0.70
    confidence_margin: float = 0.12


def severity_score(severity: Column) -> Column:
    out = F.lit(SEVERITY["info"])
    for k, v in SEVERITY.items():
        out = F.when(severity == k, v).otherwise(out)
    return out


def found(kind: str, finding_id: str, severity: Column | str, topic: str | None) -> Column:
    held = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(finding_id).alias("finding_id"), F.lit(kind).alias("finding_type"), held.alias("severity"), F.lit(topic).cast("string").alias("topic"))


def finding_rows(df: DataFrame, each: list[Column], key: str = "mission_id") -> DataFrame:
    return df.select(key, F.explode(F.array_compact(F.array(*each))).alias("x")).select(key, "x.*")


def class_severity(low: Column) -> Column:
    return F.when(low.contains("high"), "high").when(low.contains("medium"), "medium").otherwise("low")


def ml_signal_finding(missions: DataFrame, probabilities: str = "probabilities") -> DataFrame:
    """One finding a mission, its severity from the most likely class."""
    return finding_rows(missions, [found("ml_signal", "ml_signal_summary", class_severity(F.lower(best_class(F.col(probabilities)))), None)])


def uncertainty_findings(missions: DataFrame, probabilities: str = "probabilities", margin: float = 0.15) -> DataFrame:
    """Missions whose two most likely classes lie closer than the margin."""
    ordered = F.sort_array(F.map_values(probabilities), asc=False)
    close = (F.size(ordered) >= 2) & (F.get(ordered, 0) - F.get(ordered, 1) < margin - 1e-9)
    return finding_rows(missions, [F.when(close, found("operational_uncertainty", "ml_probability_uncertainty", "medium", None))])


def capability_margin_findings(joined: DataFrame) -> DataFrame:
    """Margins between a mission and its profile: payload, swarm, sensors, energy, altitude. A null limit gives no finding."""
    return finding_rows(joined, margin_findings())


def margin_findings() -> list[Column]:
    c = F.col
    wants_swarm = (c("swarm_enabled") == 1) | (c("swarm_size") > 1)
    not_capable = wants_swarm & ~c("swarm_capable")
    too_many = (c("max_swarm_size") > 0) & (c("swarm_size") > c("max_swarm_size"))
    blind = F.greatest(*(F.when(c(x) == 0, 1).otherwise(0) for x in S.SENSORS)) == 1
    share = lambda used, limit: (c(limit) > 0) & (c(used) >= c(limit) * 0.85)
    check = lambda name, severity, topic: found("tool_check", name, severity, topic)
    return [
        F.when(share("uav_payload_mass_kg", "max_payload_kg"), check("profile_payload_margin", "medium", "payload")),
        F.when(F.coalesce(not_capable, F.lit(False)), check("profile_swarm_capability", "high", "swarm")).when(too_many, check("profile_swarm_size_margin", "high", "swarm")),
        F.when(((c("moving_obstacles_count") > 0) | (c("traffic_count") > 0)) & blind, check("profile_sensor_daa_margin", "high", "ground_risk")),
        F.when(c("uav_reserve_fraction").isNotNull(), check("profile_energy_margin", "medium", "energy")),
        F.when(share("airspace_altitude_agl_max_m", "uav_rotorcraft_hover_ceiling_m"), check("profile_altitude_margin", "medium", "altitude")),
    ]


def ml_contribution(missions: DataFrame, probabilities: str = "probabilities") -> DataFrame:
    """Concern from the predicted class and how likely it is; a close second adds to it."""
    held = missions.select("mission_id", best_class(F.col(probabilities)).alias("label"), F.sort_array(F.map_values(probabilities), asc=False).alias("p"))
    close = (F.size("p") > 1) & (F.get("p", F.lit(0)) - F.get("p", F.lit(1)) < 0.15 - 1e-9)
    return held.select("mission_id", "label", ml_score(F.lower("label"), F.col("p"), close).alias("contribution"), (F.size("p") <= 0).cast("int").alias("no_probabilities"), close.cast("int").alias("close"))


def ml_score(low: Column, p: Column, close: Column) -> Column:
    base = F.when(low.contains("high"), 0.85).when(low.contains("medium"), 0.55).when(low.contains("low"), 0.20).otherwise(0.45)
    score = 0.7 * base + 0.3 * F.get(p, F.lit(0))
    return F.when(F.size(p) > 0, F.when(close, F.least(F.lit(1.0), score + 0.08)).otherwise(score)).otherwise(base)


def any_part(low: Column, parts: list[str]) -> Column:
    hit = F.lit(False)
    for x in parts:
        hit = hit | low.contains(x)
    return hit


def topics_of(name: Column, topics: dict[str, list[str]]) -> Column:
    """Topics whose parts a name contains; parts may match inside other words."""
    low, each = F.lower(name), []
    for topic, parts in topics.items():
        hit = F.lit(False)
        for p in parts:
            hit = hit | low.contains(p)
        each.append(F.when(hit, F.lit(topic)))
    return F.array_compact(F.array(*each))


def attribution_contribution(attributions: DataFrame, missions: DataFrame) -> DataFrame:
    """Concern from the topics that attributions touch; topics are found once for each distinct name."""
    names = attributions.select("feature").distinct()
    great = F.lit(False)
    for p in GREAT_CONCERN:
        great = great | F.lower("feature").contains(p)
    known = names.select("feature", topics_of(F.col("feature"), DECISION_TOPICS).alias("topics"), great.alias("great"))
    held = attributions.join(known, "feature").groupBy("mission_id").agg(F.size(F.array_distinct(F.flatten(F.collect_set("topics")))).alias("topics"), F.bool_or("great").alias("great"))
    return missions.select("mission_id").join(held, "mission_id", "left").select("mission_id", F.coalesce("topics", F.lit(0)).alias("topics"), attribution_score(F.col("topics"), F.col("great")).alias("contribution"))


def attribution_score(topics: Column, great: Column) -> Column:
    score = F.least(F.lit(0.45), 0.10 + 0.05 * topics)
    return F.when(topics.isNull(), 0.05).when(great, F.least(F.lit(0.65), score + 0.10)).otherwise(score)


def evidence_contribution(bundles: DataFrame, missions: DataFrame) -> DataFrame:
    """Concern from evidence: none, insufficient, uncited, all supported, or mixed."""
    count = lambda status: F.count(F.when(F.col("support_status") == status, 1))
    held = bundles.groupBy("mission_id").agg(F.count("*").alias("n"), count("insufficient_evidence").alias("insufficient"), count("supported").alias("supported"), F.sum("n_citations").alias("citations"))
    score = evidence_score(F.col("n"), F.col("insufficient"), F.col("citations"), F.col("supported"))
    return missions.select("mission_id").join(held, "mission_id", "left").select("mission_id", score.alias("contribution"), F.coalesce("insufficient", F.lit(0)).alias("insufficient"), (F.col("n").isNull() | ((F.col("citations") == 0) & (F.col("insufficient") == 0))).cast("int").alias("no_evidence"))


def evidence_score(n: Column, insufficient: Column, citations: Column, supported: Column) -> Column:
    return F.when(n.isNull(), 0.70).when(insufficient > 0, 0.65).when(citations == 0, 0.70).when(supported == n, 0.20).otherwise(0.45)


def limitation_findings(bundles: DataFrame) -> DataFrame:
    """A high limitation of each mission with an insufficient bundle."""
    weak = bundles.where("support_status = 'insufficient_evidence'").select("mission_id").distinct()
    return weak.selectExpr("mission_id", "'evidence_limitation' AS finding_id", "'limitation' AS finding_type", "'high' AS severity", "CAST(NULL AS STRING) AS topic")


def recommend(missions: DataFrame, findings: DataFrame, bundles: DataFrame, probabilities: str = "probabilities") -> DataFrame:
    """Provisional recommendation of each mission and its confidence. Only cited bundles that are at least partially supported count, and missions with an uncertainty or a limitation never go."""
    counts = F.col("support_status").isin("supported", "partially_supported") & (F.col("n_citations") > 0)
    supported = bundles.groupBy("mission_id").agg(F.bool_or(counts).alias("supported"))
    doubt = findings.unionByName(limitation_findings(bundles)).groupBy("mission_id").agg(F.bool_or(F.col("finding_type").isin("operational_uncertainty", "limitation")).alias("doubt"))
    held = missions.select("mission_id", F.lower(best_class(F.col(probabilities))).alias("top")).join(supported, "mission_id", "left").join(doubt, "mission_id", "left")
    sure = advice(F.col("top"), F.coalesce("supported", F.lit(False)), F.coalesce("doubt", F.lit(False)))
    return held.select("mission_id", sure.alias("x")).select("mission_id", "x.recommendation", "x.confidence")


def advice(top: Column, supported: Column, doubt: Column) -> Column:
    """Recommendation and confidence from the lower-case name of the most likely class."""
    one = lambda r, c: F.struct(F.lit(r).alias("recommendation"), F.lit(c).alias("confidence"))
    held = F.when(~supported, one("insufficient_evidence", 0.2)).when(top.contains("high") | top.contains("medium"), one("caution", 0.55))
    return held.when(top.contains("low") & ~doubt, one("go", 0.7)).otherwise(one("caution", 0.5))


def findings_contribution(missions: DataFrame, findings: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Concern from the gravest finding, doubt, and the recommendation; without a recommendation 0.70."""
    held = findings.groupBy("mission_id").agg(F.max(severity_score(F.col("severity"))).alias("worst"), F.bool_or(F.col("finding_type").isin("operational_uncertainty", "limitation")).alias("doubt"))
    both = missions.select("mission_id").join(held, "mission_id", "left").join(recommendations.select("mission_id", "recommendation"), "mission_id", "left")
    return both.select("mission_id", findings_score(F.col("worst"), F.col("doubt"), F.col("recommendation")).alias("contribution"))


def findings_score(worst: Column, doubt: Column, recommendation: Column) -> Column:
    score = F.coalesce(worst, F.lit(0.20))
    score = F.when(doubt, F.least(F.lit(1.0), score + 0.08)).otherwise(score)
    score = F.when(recommendation == "no_go", F.greatest(score, F.lit(0.80))).when(recommendation == "caution", F.greatest(score, F.lit(0.45))).otherwise(score)
    return F.when(recommendation.isNull(), 0.70).otherwise(score)


def profile_contribution(missions: DataFrame, findings: DataFrame) -> DataFrame:
    """Concern from findings that name a topic of the scenario or profile, else 0.10."""
    held = findings.where(F.trim(F.coalesce("topic", F.lit(""))) != "").groupBy("mission_id").agg(F.max(severity_score(F.col("severity"))).alias("worst"))
    return missions.select("mission_id").join(held, "mission_id", "left").select("mission_id", F.coalesce("worst", F.lit(0.10)).alias("contribution"))


def decide(missions: DataFrame, ml: DataFrame, shap: DataFrame, rag: DataFrame, agent: DataFrame, profile: DataFrame, findings: DataFrame, blocked: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row a mission: score, decision, confidence and the stages' contributions. A blocked mission is no_go at 1.0."""
    part = lambda df, name, *more: df.select("mission_id", F.col("contribution").alias(name), *more)
    critical = findings.groupBy("mission_id").agg(F.bool_or(F.col("severity") == "critical").alias("critical"))
    held = (
        missions.select("mission_id")
        .join(part(ml, "ml", "label", "no_probabilities", "close"), "mission_id", "left")
        .join(part(shap, "shap", F.col("topics")), "mission_id", "left")
        .join(part(rag, "rag", "insufficient", "no_evidence"), "mission_id", "left")
        .join(part(agent, "agent"), "mission_id", "left")
        .join(part(profile, "scenario_profile"), "mission_id", "left")
        .join(critical, "mission_id", "left")
        .join(blocked.select("mission_id", F.lit(True).alias("blocked")).distinct(), "mission_id", "left")
    )
    c, zero = F.col, F.lit(0)
    limits = F.coalesce("no_probabilities", zero) + F.coalesce("close", zero) + F.when(c("topics") == 0, 1).otherwise(0) + F.coalesce("insufficient", zero) + F.coalesce("no_evidence", zero)
    return decision_columns(held.withColumn("limits", limits), policy).select("mission_id", "final_decision", "decision_score", "confidence_level", "ml", "shap", "rag", "agent", "scenario_profile")


def decision_columns(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Adds final_decision, decision_score and confidence_level to rows with the stages' contributions, label, insufficient, limits, critical and blocked."""
    c, none = F.col, F.lit(0.0)
    total = sum((F.coalesce(c(k), none) * w for k, w in (("ml", policy.ml), ("shap", policy.shap), ("rag", policy.rag), ("agent", policy.agent), ("scenario_profile", policy.scenario_profile))), none)
    stop, weak = F.coalesce("blocked", F.lit(False)), F.coalesce("insufficient", F.lit(0)) > 0
    scored = rows.withColumn("_score", F.when(stop, 1.0).otherwise(F.greatest(none, F.least(F.lit(1.0), total))))
    score, elevated = c("_score"), F.coalesce(F.lower("label").rlike("medium|high"), F.lit(False))
    decision = F.when(stop | (score >= policy.no_go), "no_go").when((score >= policy.go) | weak | F.coalesce("critical", F.lit(False)) | elevated, "caution").otherwise("go")
    near = F.least(F.abs(score - policy.go), F.abs(score - policy.no_go))
    confidence = F.when(stop | weak | (c("limits") >= 3), "low").when((near >= policy.confidence_margin) & (c("limits") == 0), "high").otherwise("medium")
    return scored.select("*", decision.alias("final_decision"), F.round(score + 1e-9, 4).alias("decision_score"), confidence.alias("confidence_level"))


def decision_reasons(decided: DataFrame, reasons: DataFrame, bundles: DataFrame, limit: int = 8) -> DataFrame:
    """mission_id, reasons: the score line, a line on evidence where any bundle is insufficient, then the first reasons in order (at_place), without repeats."""
    listed = reasons.groupBy("mission_id").agg(F.array_sort(F.collect_list(F.struct("at_place", "reason"))).alias("r"))
    line = F.concat(F.lit("Weighted decision score is "), F.format_string("%.3f", F.col("decision_score") + 1e-9), F.lit("; final decision is "), F.col("final_decision"), F.lit("."))
    rest = F.slice(F.transform(F.coalesce("r", F.array().cast("array<struct<at_place:int,reason:string>>")), lambda x: x["reason"]), 1, limit)
    weak = bundles.where("support_status = 'insufficient_evidence'").select("mission_id", F.lit(True).alias("weak")).distinct()
    lines = F.when(F.col("weak"), F.array(line, F.lit("Insufficient evidence prevents overconfident GO."))).otherwise(F.array(line))
    return decided.join(listed, "mission_id", "left").join(weak, "mission_id", "left").select("mission_id", F.array_distinct(F.concat(lines, rest)).alias("reasons"))


def decision_refs(refs: DataFrame) -> DataFrame:
    """Evidence references, one of each (claim, citation list) of a mission, the first by place."""
    order = F.row_number().over(Window.partitionBy("mission_id", "claim_id", "citations").orderBy("at_place"))
    return refs.withColumn("n", order).where("n = 1").select("mission_id", "claim_id", "citations", "at_place")


def pipeline_status(decided: DataFrame, evidence: DataFrame, agent_status: DataFrame) -> DataFrame:
    """completed, or degraded where the agent didn't complete or evidence is insufficient."""
    weak = evidence.groupBy("mission_id").agg(F.bool_or(F.col("support_status") == "insufficient_evidence").alias("weak"))
    held = decided.select("mission_id").join(weak, "mission_id", "left").join(agent_status, "mission_id", "left")
    bad = F.coalesce("weak", F.lit(False)) | (F.coalesce("agent_status", F.lit("missing")) != "completed")
    return held.select("mission_id", F.when(bad, "degraded").otherwise("completed").alias("status"))
