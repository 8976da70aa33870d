"""Queries of findings and the decision, and the assessment of all missions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom import bindings as B
from flightloom import schemas as S
from flightloom.operators import assessment as W
from flightloom.operators import decision as J
from flightloom.plans.feature_queries import SCORED_SQL
from flightloom.plans.registry import query
from flightloom.plans.validation_queries import ISSUES_SQL, joined

STATUS = "CASE (mission_id + k) % 3 WHEN 0 THEN 'supported' WHEN 1 THEN 'partially_supported' ELSE 'insufficient_evidence' END"
CITED = "CASE WHEN (mission_id + k) % 3 = 2 THEN 0 ELSE (mission_id + k) % 4 END"
BUNDLES_SQL = f"bundles AS (SELECT mission_id, k, {STATUS} AS support_status, CAST({CITED} AS BIGINT) AS n_citations FROM (SELECT o_orderkey AS mission_id, unnest(range(1, o_orderkey % 4 + 1)) AS k FROM orders))"


def bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence bundles of missions: up to three each, test use only."""
    held = B.read(spark, sf_dir, "orders").where("o_orderkey % 4 > 0").selectExpr("o_orderkey AS mission_id", "explode(sequence(1, o_orderkey % 4)) AS k")
    return held.selectExpr("mission_id", "k", f"{STATUS} AS support_status", f"CAST({CITED} AS BIGINT) AS n_citations")


#: The bundles of a mission, in its row.
BUNDLE_ARRAY = f"CASE WHEN mission_id % 4 > 0 THEN transform(sequence(1L, mission_id % 4), k -> struct(k AS place, {STATUS} AS support_status, CAST({CITED} AS BIGINT) AS n_citations)) END"


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joined(spark, sf_dir)
    return J.ml_signal_finding(rows).unionByName(J.uncertainty_findings(rows)).unionByName(J.capability_margin_findings(rows)).unionByName(J.limitation_findings(bundles(spark, sf_dir)))


BASE = f"{SCORED_SQL}, joined AS (SELECT * FROM missions LEFT JOIN profiles ON mission_user_id = user_id AND mission_profile_id = profile_id), {BUNDLES_SQL}"
TOP_TWO = "(confidence - (p_high + p_medium + p_low - confidence - least(p_high, p_medium, p_low)))"
ML_FINDING = "SELECT mission_id, 'ml_signal_summary' AS finding_id, 'ml_signal' AS finding_type, CASE predicted_class WHEN 'High Risk' THEN 'high' WHEN 'Medium Risk' THEN 'medium' ELSE 'low' END AS severity, CAST(NULL AS VARCHAR) AS topic FROM scored"
UNSURE = f"SELECT mission_id, 'ml_probability_uncertainty' AS finding_id, 'operational_uncertainty' AS finding_type, 'medium' AS severity, CAST(NULL AS VARCHAR) AS topic FROM scored WHERE {TOP_TWO} < 0.15 - 1e-9"
ONE = lambda name, severity, topic, condition: f"SELECT mission_id, '{name}' AS finding_id, 'tool_check' AS finding_type, '{severity}' AS severity, '{topic}' AS topic FROM joined WHERE {condition}"
NO_SWARM = "(swarm_enabled = 1 OR swarm_size > 1) AND NOT swarm_capable"
MARGINS = " UNION ALL ".join(
    [
        ONE("profile_payload_margin", "medium", "payload", "max_payload_kg > 0 AND uav_payload_mass_kg >= max_payload_kg * 0.85"),
        ONE("profile_swarm_capability", "high", "swarm", NO_SWARM),
        ONE("profile_swarm_size_margin", "high", "swarm", f"NOT coalesce({NO_SWARM}, false) AND max_swarm_size > 0 AND swarm_size > max_swarm_size"),
        ONE("profile_sensor_daa_margin", "high", "ground_risk", f"(moving_obstacles_count > 0 OR traffic_count > 0) AND ({' OR '.join(f'{x} = 0' for x in S.SENSORS)})"),
        ONE("profile_energy_margin", "medium", "energy", "uav_reserve_fraction IS NOT NULL"),
        ONE("profile_altitude_margin", "medium", "altitude", "uav_rotorcraft_hover_ceiling_m > 0 AND airspace_altitude_agl_max_m >= uav_rotorcraft_hover_ceiling_m * 0.85"),
    ]
)
LIMITED = "SELECT DISTINCT mission_id, 'evidence_limitation' AS finding_id, 'limitation' AS finding_type, 'high' AS severity, CAST(NULL AS VARCHAR) AS topic FROM bundles WHERE support_status = 'insufficient_evidence'"
WITH_FINDINGS = f"{BASE}, findings AS ({ML_FINDING} UNION ALL {UNSURE} UNION ALL {MARGINS} UNION ALL {LIMITED})"


@query(f"{BASE} {ML_FINDING}")
def ml_signal_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.ml_signal_finding(B.missions(spark, sf_dir))


@query(f"{BASE} {UNSURE}")
def uncertainty_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.uncertainty_findings(B.missions(spark, sf_dir))


@query(f"{BASE} {MARGINS}")
def capability_margin_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.capability_margin_findings(joined(spark, sf_dir))


ML_SQL = f"ml AS (SELECT mission_id, predicted_class AS label, CASE WHEN {TOP_TWO} < 0.15 - 1e-9 THEN least(1.0, s + 0.08) ELSE s END AS contribution, 0 AS no_probabilities, CASE WHEN {TOP_TWO} < 0.15 - 1e-9 THEN 1 ELSE 0 END AS close FROM (SELECT *, 0.7 * CASE predicted_class WHEN 'High Risk' THEN 0.85 WHEN 'Medium Risk' THEN 0.55 ELSE 0.20 END + 0.3 * confidence AS s FROM scored))"


@query(f"{BASE}, {ML_SQL} SELECT * FROM ml")
def ml_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.ml_contribution(B.missions(spark, sf_dir))


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions of missions by orders' residues, test use only: mission m has the names i of the scenario with (m + 7 i) mod 16 = 0; m mod 25 = 0 none."""
    return named_by(B.read(spark, sf_dir, "orders").where("o_orderkey % 25 > 0").select(F.col("o_orderkey").alias("mission_id")), 9 * F.col("mission_id"), 16)


def named_by(missions: DataFrame, first: Column, every: int) -> DataFrame:
    """(mission_id, feature): of the scenario's names the ``first`` (modulo ``every``) and each ``every``-th after it; no others are made up."""
    names, i = F.array(*map(F.lit, S.SCENARIO_RAW)), F.sequence(F.pmod(first, F.lit(every)).cast("int"), F.lit(len(S.SCENARIO_RAW) - 1), F.lit(every))
    return missions.select("mission_id", F.explode(i).alias("i")).select("mission_id", F.get(names, F.col("i")).alias("feature"))


def attributed(mission: Column) -> Column:
    """The names that ``attributions`` gives a mission, in order, in its row; null where there are none."""
    names, i = F.array(*map(F.lit, S.SCENARIO_RAW)), F.sequence(F.pmod(9 * mission, F.lit(16)).cast("int"), F.lit(len(S.SCENARIO_RAW) - 1), F.lit(16))
    return F.when(mission % 25 > 0, F.sort_array(F.transform(i, lambda x: F.get(names, x))))


TOPIC_CASES = " + ".join(f"max(CASE WHEN {' OR '.join(f'contains(feature, {chr(39)}{p}{chr(39)})' for p in parts)} THEN 1 ELSE 0 END)" for parts in J.DECISION_TOPICS.values())
GREAT_SQL = " OR ".join(f"contains(feature, '{p}')" for p in J.GREAT_CONCERN)
SHAP_SQL = f"""named AS (SELECT o_orderkey AS mission_id, feature FROM orders, (SELECT unnest({S.SCENARIO_RAW}) AS feature, unnest(range({len(S.SCENARIO_RAW)})) AS i) WHERE o_orderkey % 25 > 0 AND (o_orderkey + 7 * i) % 16 = 0),
touched AS (SELECT mission_id, {TOPIC_CASES} AS topics, bool_or({GREAT_SQL}) AS great FROM named GROUP BY 1),
shap AS (SELECT m.mission_id, CAST(coalesce(t.topics, 0) AS INT) AS topics, CASE WHEN t.topics IS NULL THEN 0.05 WHEN t.great THEN least(0.65, least(0.45, 0.10 + 0.05 * t.topics) + 0.10) ELSE least(0.45, 0.10 + 0.05 * t.topics) END AS contribution FROM missions m LEFT JOIN touched t USING (mission_id))"""


@query(f"{BASE}, {SHAP_SQL} SELECT mission_id, topics, CAST(contribution AS DOUBLE) AS contribution FROM shap")
def attribution_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.attribution_contribution(attributions(spark, sf_dir), B.missions(spark, sf_dir))


RAG_SQL = """backed AS (SELECT mission_id, count(*) AS n, sum(CASE WHEN support_status = 'insufficient_evidence' THEN 1 ELSE 0 END) AS weak, sum(CASE WHEN support_status = 'supported' THEN 1 ELSE 0 END) AS good, sum(n_citations) AS cites FROM bundles GROUP BY 1),
rag AS (SELECT m.mission_id, CASE WHEN n IS NULL THEN 0.70 WHEN weak > 0 THEN 0.65 WHEN cites = 0 THEN 0.70 WHEN good = n THEN 0.20 ELSE 0.45 END AS contribution, CAST(coalesce(weak, 0) AS BIGINT) AS insufficient, CASE WHEN n IS NULL OR (cites = 0 AND weak = 0) THEN 1 ELSE 0 END AS no_evidence FROM missions m LEFT JOIN backed USING (mission_id))"""


@query(f"{BASE}, {RAG_SQL} SELECT mission_id, CAST(contribution AS DOUBLE) AS contribution, insufficient, no_evidence FROM rag")
def evidence_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.evidence_contribution(bundles(spark, sf_dir), B.missions(spark, sf_dir))


RECOMMEND_SQL = """doubtful AS (SELECT DISTINCT mission_id FROM findings WHERE finding_type IN ('operational_uncertainty', 'limitation')),
advised AS (SELECT s.mission_id, CASE WHEN NOT coalesce(b.ok, false) THEN 'insufficient_evidence' WHEN predicted_class <> 'Low Risk' THEN 'caution' WHEN d.mission_id IS NULL THEN 'go' ELSE 'caution' END AS recommendation,
 CASE WHEN NOT coalesce(b.ok, false) THEN 0.2 WHEN predicted_class <> 'Low Risk' THEN 0.55 WHEN d.mission_id IS NULL THEN 0.7 ELSE 0.5 END AS confidence
 FROM scored s LEFT JOIN (SELECT mission_id, bool_or(support_status IN ('supported', 'partially_supported') AND n_citations > 0) AS ok FROM bundles GROUP BY 1) b USING (mission_id) LEFT JOIN doubtful d ON d.mission_id = s.mission_id)"""


@query(f"{WITH_FINDINGS}, {RECOMMEND_SQL} SELECT mission_id, recommendation, CAST(confidence AS DOUBLE) AS confidence FROM advised")
def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.recommend(B.missions(spark, sf_dir), all_findings(spark, sf_dir), bundles(spark, sf_dir))


SEVERITY_SQL = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in J.SEVERITY.items()) + " END"
AGENT_SQL = f"""worst AS (SELECT mission_id, max({SEVERITY_SQL}) AS w, max(CASE WHEN topic IS NOT NULL THEN {SEVERITY_SQL} END) AS named, bool_or(finding_type IN ('operational_uncertainty', 'limitation')) AS doubt FROM findings GROUP BY 1),
agent AS (SELECT a.mission_id, CASE recommendation WHEN 'caution' THEN greatest(x, 0.45) ELSE x END AS contribution FROM (SELECT advised.mission_id, recommendation, CASE WHEN doubt THEN least(1.0, coalesce(w, 0.2) + 0.08) ELSE coalesce(w, 0.2) END AS x FROM advised LEFT JOIN worst USING (mission_id)) a),
profiled AS (SELECT m.mission_id, coalesce(named, 0.10) AS contribution FROM missions m LEFT JOIN worst USING (mission_id))"""


@query(f"{WITH_FINDINGS}, {RECOMMEND_SQL}, {AGENT_SQL} SELECT mission_id, CAST(contribution AS DOUBLE) AS contribution FROM agent")
def findings_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, findings = B.missions(spark, sf_dir), all_findings(spark, sf_dir)
    return J.findings_contribution(rows, findings, J.recommend(rows, findings, bundles(spark, sf_dir)))


@query(f"{WITH_FINDINGS}, {RECOMMEND_SQL}, {AGENT_SQL} SELECT mission_id, CAST(contribution AS DOUBLE) AS contribution FROM profiled")
def profile_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.profile_contribution(B.missions(spark, sf_dir), all_findings(spark, sf_dir))


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.assess_missions(joined(spark, sf_dir), bundles(spark, sf_dir), attributions(spark, sf_dir))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).select("mission_id", "final_decision", "decision_score", "confidence_level", "ml", "shap", "rag", "agent", "scenario_profile")


DECIDE_SQL = f"""{WITH_FINDINGS}, {ISSUES_SQL}, {ML_SQL}, {SHAP_SQL}, {RAG_SQL}, {RECOMMEND_SQL}, {AGENT_SQL},
stopped AS (SELECT DISTINCT mission_id FROM issues),
summed AS (SELECT m.mission_id, CAST(ml.contribution AS DOUBLE) AS ml, CAST(shap.contribution AS DOUBLE) AS shap, CAST(rag.contribution AS DOUBLE) AS rag, CAST(agent.contribution AS DOUBLE) AS agent, CAST(profiled.contribution AS DOUBLE) AS scenario_profile, label, insufficient, close + (CASE WHEN topics = 0 THEN 1 ELSE 0 END) + insufficient + no_evidence AS limits, stopped.mission_id IS NOT NULL AS stop
 FROM missions m JOIN ml USING (mission_id) JOIN shap USING (mission_id) JOIN rag USING (mission_id) JOIN agent USING (mission_id) JOIN profiled USING (mission_id) LEFT JOIN stopped ON stopped.mission_id = m.mission_id),
final AS (SELECT *, CASE WHEN stop THEN 1.0 ELSE 0.22 * ml + 0.10 * shap + 0.28 * rag + 0.25 * agent + 0.10 * scenario_profile END AS score FROM summed),
decided AS (SELECT mission_id, CASE WHEN stop OR score >= 0.70 THEN 'no_go' WHEN score >= 0.35 OR insufficient > 0 OR label <> 'Low Risk' THEN 'caution' ELSE 'go' END AS final_decision, round(score + 1e-9, 4) AS decision_score,
 CASE WHEN stop OR insufficient > 0 OR limits >= 3 THEN 'low' WHEN least(abs(score - 0.35), abs(score - 0.70)) >= 0.12 AND limits = 0 THEN 'high' ELSE 'medium' END AS confidence_level, ml, shap, rag, agent, scenario_profile FROM final)"""


@query(f"{DECIDE_SQL} SELECT * FROM decided")
def decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir)


@query(f"{DECIDE_SQL} SELECT d.mission_id, CASE WHEN s.mission_id IS NULL THEN 'open' ELSE 'blocked' END AS status, recommendation, CAST(a.confidence AS DOUBLE) AS confidence, final_decision, decision_score, confidence_level FROM decided d JOIN advised a USING (mission_id) LEFT JOIN stopped s ON s.mission_id = d.mission_id")
def assess_missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assessed(spark, sf_dir).select("mission_id", "status", "recommendation", "confidence", "final_decision", "decision_score", "confidence_level")


@query(f"{DECIDE_SQL} SELECT mission_id, confidence_level FROM decided")
def decision_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("mission_id", "confidence_level")


REASON = "'Bundle status ' || support_status || '.'"


@query(f"{DECIDE_SQL} SELECT mission_id, 'Weighted decision score is ' || printf('%.3f', decision_score + 1e-9) || '; final decision is ' || final_decision || '.' || CASE WHEN coalesce(weak, false) THEN '|Insufficient evidence prevents overconfident GO.' ELSE '' END || coalesce('|' || r, '') AS reasons FROM decided LEFT JOIN (SELECT mission_id, bool_or(support_status = 'insufficient_evidence') AS weak FROM bundles GROUP BY 1) USING (mission_id) LEFT JOIN (SELECT mission_id, string_agg(reason, '|' ORDER BY k) AS r FROM (SELECT mission_id, {REASON} AS reason, min(k) AS k FROM bundles GROUP BY 1, 2) GROUP BY 1) USING (mission_id)")
def decision_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = bundles(spark, sf_dir).select("mission_id", F.col("k").cast("int").alias("at_place"), F.expr(REASON).alias("reason"))
    return J.decision_reasons(decided(spark, sf_dir), reasons, bundles(spark, sf_dir)).select("mission_id", F.array_join("reasons", "|").alias("reasons"))


@query(f"{BASE} SELECT mission_id, support_status AS claim_id, n_citations AS citations, min(k) AS at_place FROM bundles GROUP BY 1, 2, 3")
def decision_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = bundles(spark, sf_dir).select("mission_id", F.col("support_status").alias("claim_id"), F.col("n_citations").alias("citations"), F.col("k").alias("at_place"))
    return J.decision_refs(refs)


@query(f"{BASE} SELECT m.mission_id, CASE WHEN coalesce(weak, false) OR m.mission_id % 10 = 3 THEN 'degraded' ELSE 'completed' END AS status FROM missions m LEFT JOIN (SELECT mission_id, bool_or(support_status = 'insufficient_evidence') AS weak FROM bundles GROUP BY 1) USING (mission_id)")
def pipeline_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.missions(spark, sf_dir)
    agents = rows.select("mission_id", F.when(F.col("mission_id") % 10 == 3, "failed").otherwise("completed").alias("agent_status"))
    return J.pipeline_status(rows, bundles(spark, sf_dir), agents)
