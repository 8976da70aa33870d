"""Queries of feature assembly and scoring."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom import bindings as B
from flightloom import schemas as S
from flightloom.operators import features as C
from flightloom.operators import graph_features as P
from flightloom.operators import scoring as D
from flightloom.operators import validate as V
from flightloom.plans.registry import query
from flightloom.plans.validation_queries import ISSUES_SQL, WITH, joined


def staged_sql(source: str, stages: list[C.Stage], name: str = "made") -> str:
    """The stages as nested selects."""
    inner = source
    for stage in stages:
        inner = f"(SELECT *, {', '.join(f'{v} AS {k}' for k, v in stage.items())} FROM {inner})"
    return f"{name} AS (SELECT * FROM {inner})"


def derived_sql(stages: list[C.Stage], keep: list[str] | None = None) -> str:
    columns = keep or [k for s in stages for k in s]
    return f"{WITH}, {staged_sql('joined', stages)} SELECT mission_id, {', '.join(columns)} FROM made"


@query(derived_sql([C.PHYSICS]))
def physics_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.physics_features(joined(spark, sf_dir))


@query(derived_sql([C.SITE_MOMENTS, C.SITE_BOUNDS, C.SITE_RANGES]))
def site_bounds_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.site_bounds_features(joined(spark, sf_dir))


@query(derived_sql([C.COMMS_WINDOWS]))
def comms_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.comms_window_features(joined(spark, sf_dir))


@query(derived_sql([C.ENVIRONMENT]))
def environment_runway_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.environment_runway_features(joined(spark, sf_dir))


@query(derived_sql([C.PHYSICS, C.COMPOSITES], list(C.COMPOSITES)))
def composite_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.composite_features(joined(spark, sf_dir))


def cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined missions without any issue."""
    return joined(spark, sf_dir).where(~V.any_issue())


FLAG_SQL = {"uav_aero_wing_area_m2_was_missing": "CASE WHEN override_wing IS NULL THEN 1.0 ELSE 0.0 END"}


def raw_sql(name: str) -> str:
    """A raw column of the assembled row, in the bindings' terms."""
    if name == "uav_aero_wing_area_m2":
        return "coalesce(TRY_CAST(override_wing AS DOUBLE), uav_aero_wing_area_m2) AS uav_aero_wing_area_m2"
    if name.endswith(S.MISSING):
        base = name.removesuffix(S.MISSING)
        value = FLAG_SQL.get(name, "1.0" if base in S.MISSING_UNLESS_SET or base == "autofix_uav_physics_first" else "0.0")
        return f"CAST({value} AS DOUBLE) AS {name}"
    if name == "controls_actions_first":
        return "'fwd' AS controls_actions_first"
    if name in S.DROPPED_DEFAULTS:
        held = S.DROPPED_DEFAULTS[name]
        return f"'{held}' AS {name}" if isinstance(held, str) else f"CAST({held} AS DOUBLE) AS {name}"
    return name


CLEARED_SQL = f"{WITH}, {ISSUES_SQL}, cleared AS (SELECT * FROM joined WHERE mission_id NOT IN (SELECT mission_id FROM issues)), {staged_sql('cleared', C.STAGES)}"
RAW_SQL = f"{CLEARED_SQL}, raw AS (SELECT mission_id, {', '.join(map(raw_sql, S.RAW_FEATURES))} FROM made)"


@query(f"{RAW_SQL} SELECT * FROM raw")
def assemble_raw_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.assemble_raw_features(cleared(spark, sf_dir))


@query(f"{RAW_SQL} SELECT mission_id, uav_aero_wing_area_m2, feat_disk_loading, {', '.join(x for x in S.RAW_FEATURES if x.endswith(S.MISSING))} FROM raw")
def apply_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.derive(cleared(spark, sf_dir), *C.STAGES)
    return C.apply_overrides(made).select("mission_id", "uav_aero_wing_area_m2", "feat_disk_loading", *(x for x in S.RAW_FEATURES if x.endswith(S.MISSING)))


HOT_SQL = ", ".join(f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END AS {c}_{v}" for c, values in S.CATEGORIES.items() for v in values[1:])


@query(f"{RAW_SQL} SELECT mission_id, {HOT_SQL}, {', '.join(C.PROCESSED[13:])} FROM raw")
def encode_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.encode_processed(C.assemble_raw_features(cleared(spark, sf_dir)))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, sum(l_quantity) AS uav_mass, sum(l_tax) AS uav_tax, sum(l_discount) AS env_wind FROM lineitem GROUP BY 1, 2")
def flatten_nested_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = B.read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"), F.sum("l_tax").alias("t"), F.sum("l_discount").alias("d"))
    nested = lines.select("l_orderkey", "l_linenumber", "n", F.struct(F.col("q").alias("mass"), F.col("t").alias("uav_tax")).alias("uav"), F.struct(F.col("d").alias("wind")).alias("env"))
    keyed = nested.withColumn("key", F.struct("l_orderkey", "l_linenumber", "n"))
    return C.flatten_nested_payload(keyed, {"uav": "uav_", "env": "env_"}, "key").select("key.*", "uav_mass", "uav_tax", "env_wind")


@query("SELECT o_orderkey AS mission_id, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS DOUBLE) * 22.2 / 1000 ELSE CAST(o_orderkey % 3 AS DOUBLE) END AS battery_wh, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey % 120 AS DOUBLE) ELSE CAST(o_orderkey % 4 AS DOUBLE) END AS altitude_m, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderkey % 5 AS DOUBLE) ELSE CAST(o_custkey % 2 AS DOUBLE) END AS restricted_zones FROM orders")
def tier0_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = B.read(spark, sf_dir, "orders").select(o.alias("mission_id"), *(x.cast("double").alias(n) for n, x in {"battery_wh": o % 3, "battery_mah": c, "battery_v": F.lit(22.2), "altitude_m": o % 4, "max_altitude_m": c % 120, "restricted_zones": c % 2, "no_fly_zones": o % 5}.items()))
    return C.tier0_projection(rows)


@query("SELECT o_orderkey AS mission_id, 'uav_mass_kg' AS primary_names, 'feat_fault_risk' AS override_names, o_orderstatus AS extra_names FROM orders")
def route_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mission_id"), F.create_map(F.lit("uav_mass_kg"), F.lit("1"), F.lit("feat_fault_risk"), F.lit("2"), F.col("o_orderstatus"), F.lit("3")).alias("inputs"))
    parts = C.route_inputs(rows, S.PROFILE_RAW + S.SCENARIO_RAW, S.RAW_FEATURES)
    return parts.select("mission_id", *(F.array_join(F.array_sort(F.map_keys(x)), ",").alias(f"{x}_names") for x in ("primary", "override", "extra")))


PARTS_SQL = lambda name, parts: " OR ".join(f"contains({name}, '{p}')" for p in parts)
UNIT_SQL = (
    "CASE " + " ".join(f"WHEN name = '{k}' THEN '{v}'" for k, v in C.UNIT_BY_NAME.items()) + " " + " ".join(f"WHEN ends_with(name, '{k}') THEN '{v}'" for k, v in C.UNIT_BY_SUFFIX.items())
    + " " + " ".join(f"WHEN {PARTS_SQL('name', p)} THEN '{k}'" for k, p in C.UNIT_BY_PART.items()) + " ELSE 'dimensionless' END"
)
FUEL = "'fuel'"
KIND_SQL = ", ".join(f"CASE WHEN ({PARTS_SQL('name', p)}){f' AND NOT contains(name, {FUEL})' if c == 'battery' else ''} THEN '{c}' END" for c, p in C.CATEGORY_PARTS.items())


@query(f"SELECT name, {UNIT_SQL} AS unit, concat_ws(',', {KIND_SQL}, CASE WHEN contains(name, 'feat_') OR contains(name, '_was_missing') THEN 'derived' END) AS categories FROM (SELECT unnest({C.PROCESSED}) AS name)")
def feature_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.feature_dictionary(spark.createDataFrame([(x,) for x in C.PROCESSED], "name string"))


CHANCES = {"High Risk": "p_high", "Low Risk": "p_low", "Medium Risk": "p_medium"}
SCORED_SQL = f"""WITH {B.PROFILES_SQL}, {B.MISSIONS_SQL}, scored AS (SELECT mission_id, p_high, p_medium, p_low, round(p_high + 0.5 * p_medium + 1e-9, 4) AS risk_score, greatest(p_high, p_medium, p_low) AS confidence,
 CASE WHEN p_high >= p_low AND p_high >= p_medium THEN 'High Risk' WHEN p_low >= p_medium THEN 'Low Risk' ELSE 'Medium Risk' END AS predicted_class FROM missions)"""


@query(f"{SCORED_SQL} SELECT mission_id, risk_score, confidence, predicted_class, CASE predicted_class WHEN 'High Risk' THEN 'NO-GO' WHEN 'Low Risk' THEN 'GO' ELSE 'CONDITIONAL-GO' END AS advice FROM scored")
def risk_from_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.risk_from_probabilities(B.missions(spark, sf_dir))


@query(f"{SCORED_SQL} SELECT mission_id, risk_score, confidence, round(p_high + p_low + (p_medium * 1.01) + 1e-9, 6) AS total FROM scored WHERE abs(p_high + p_low + (p_medium * 1.01) - 1) > 0.0001")
def check_probability_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.missions(spark, sf_dir)
    shifted = rows.select("mission_id", F.transform_values("probabilities", lambda k, v: F.when(k == "Medium Risk", v * 1.01).otherwise(v)).alias("probabilities"))
    return D.check_probability_bounds(D.risk_from_probabilities(rows).join(shifted, "mission_id")).withColumn("total", F.round(F.col("total") + 1e-9, 6))


@query(f"{SCORED_SQL} SELECT mission_id, 'Low Risk' AS predicted_class, CASE predicted_class WHEN 'High Risk' THEN round(p_low + 0.5 * p_medium + 1e-9, 4) WHEN 'Medium Risk' THEN round(p_high + 0.5 * p_low + 1e-9, 4) ELSE risk_score END AS risk_score, confidence FROM scored")
def recalibrate_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.recalibrate_class(B.missions(spark, sf_dir), "Low Risk")


@query(f"WITH {B.PROFILES_SQL} SELECT profile_id, substr(sha256(concat_ws('|', CAST(CAST(uav_max_speed_mps AS INT) AS VARCHAR), coalesce(uav_energy_source, 'null'), CAST(CAST(uav_max_tilt_deg AS INT) AS VARCHAR))), 1, 12) AS vector_hash FROM profiles")
def hash_feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = B.profiles(spark, sf_dir).select("profile_id", F.col("uav_max_speed_mps").cast("int").alias("speed"), "uav_energy_source", F.col("uav_max_tilt_deg").cast("int").alias("tilt"))
    return D.hash_feature_vector(held, ["speed", "uav_energy_source", "tilt"], "profile_id")


#: A linear model's (coefficient, mean) by feature.
LINEAR = {x: (((7 * i + 3) % 13 - 6) / 10, float(i)) for i, x in enumerate(C.COMPOSITES)}
CONTRIBUTIONS_SQL = f"{CLEARED_SQL}, long AS ({' UNION ALL '.join(f'SELECT mission_id, {chr(39)}{k}{chr(39)} AS feature, {k} AS value, ({k} - {m}) * {c} AS contribution FROM made' for k, (c, m) in LINEAR.items())})"


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.linear_contributions(C.derive(cleared(spark, sf_dir), *C.STAGES), LINEAR)


@query(f"{CONTRIBUTIONS_SQL} SELECT * FROM long")
def linear_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contributions(spark, sf_dir)


@query(f"{CONTRIBUTIONS_SQL}, scored AS (SELECT mission_id, CASE WHEN p_high >= p_low AND p_high >= p_medium THEN 1 WHEN p_low >= p_medium THEN -1 ELSE 0 END AS side FROM missions) SELECT mission_id, rank, feature, value, contribution, CASE side WHEN 0 THEN CASE WHEN contribution > 0 THEN 'stabilizes_medium_risk' ELSE 'shifts_away_from_medium' END ELSE CASE WHEN (contribution > 0) = (side = 1) THEN 'increases_risk' ELSE 'decreases_risk' END END AS direction FROM (SELECT *, CAST(row_number() OVER (PARTITION BY mission_id ORDER BY abs(contribution) DESC, feature) AS INT) AS rank FROM long JOIN scored USING (mission_id)) WHERE rank <= 4")
def top_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.top_contributions(C.derive(cleared(spark, sf_dir), *C.STAGES), LINEAR, D.best_class(F.col("probabilities")), 4)


NUMERIC = [x for x in S.RAW_FEATURES if x not in S.CATEGORIES and x not in S.DROPPED_DEFAULTS and not x.endswith(S.MISSING)]


@query(
    f"{RAW_SQL}, row0 AS (SELECT min(mission_id) AS m FROM raw) SELECT feature, value, 1.0 AS reference, abs(value - 1) / spread AS deviation FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, max(CASE WHEN mission_id = (SELECT m FROM row0) THEN {c} END) AS value, stddev_pop({c}) AS spread FROM raw" for c in C.COMPOSITES)
    + ") WHERE spread > 0 ORDER BY deviation DESC, feature LIMIT 12"
)
def deviation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = C.assemble_raw_features(cleared(spark, sf_dir))
    row = raw.agg(F.min("mission_id")).first()[0]
    return D.deviation_report(raw, list(C.COMPOSITES), dict.fromkeys(C.COMPOSITES, 1.0), row)


@query(f"{SCORED_SQL} SELECT mission_id, 'High Risk' AS expected, predicted_class, confidence, predicted_class = 'High Risk' AND confidence >= 0.8 AS passed  FROM scored")
def golden_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = B.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mission_id"), F.lit("High Risk").alias("expected"), F.lit(0.8).alias("least_confidence"))
    return D.golden_check(D.risk_from_probabilities(B.missions(spark, sf_dir)), golden)


def linear_model(x: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a fitted model: three scores of fault risk and weather, normalised."""
    high, low = 1 + x["feat_fault_risk"], 1 + x["feat_weather_severity"] / 10
    total = high + low + 1
    return pd.DataFrame({"High Risk": high / total, "Medium Risk": 1 / total, "Low Risk": low / total})


@query(f"{CLEARED_SQL} SELECT mission_id, (1 + feat_fault_risk) / t AS \"High Risk\", 1 / t AS \"Medium Risk\", (1 + feat_weather_severity / 10) / t AS \"Low Risk\" FROM (SELECT *, (1 + feat_fault_risk) + (1 + feat_weather_severity / 10) + 1 AS t FROM made)")
def score_missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = C.derive(cleared(spark, sf_dir), *C.STAGES).select("mission_id", "feat_fault_risk", "feat_weather_severity")
    return D.score_missions(made, linear_model, ["High Risk", "Medium Risk", "Low Risk"])


#: The overrides of the query, by name: where an order has one, and what it says.
GRAPH_OVERRIDES = {
    "uav_rotorcraft_disk_area_m2": ("o_orderkey % 4 = 0", "2.5"),
    "uav_aero_cl_max": ("o_orderkey % 6 = 0", " 0 "),
    "landing_preferred_sites_x_std": ("o_orderkey % 5 = 0", "1e1"),
    "landing_preferred_sites_z_mean": ("o_orderkey % 8 = 0", "7"),
    "environment_thermal_plumes_count": ("o_orderkey % 9 = 0", "Yes"),
    "feat_fault_risk": ("o_orderkey % 61 = 0", "n/a"),
    "uav_mass_kg": ("o_orderkey % 3 = 0", "99"),
}


def spread_sql(p: str, mean: tuple[str, ...], std: tuple[str, ...]) -> str:
    """Moments, bounds and ranges of a place by hand, from what its means and deviations are."""
    out = []
    for a, m, s in zip("xyz", mean, std):
        out.append(f"{m} AS {p}_{a}_mean, {s} AS {p}_{a}_std, {m} - 2 * ({s}) AS {p}_{a}_min, {m} + 2 * ({s}) AS {p}_{a}_max, ({m} + 2 * ({s})) - ({m} - 2 * ({s})) AS {p}_{a}_range")
    return ", ".join(out)


ABOVE = lambda n, least, v: f"CASE WHEN {n} >= {least} THEN {v} ELSE 0 END"
GRAPH_SQL = f"""{WITH}, j AS (SELECT *, mission_id AS k, uav_energy_source IN ('fuel', 'hybrid') AS winged, CASE WHEN uav_energy_source IN ('fuel', 'hybrid') THEN uav_mass_kg / 35 ELSE 0 END AS wing,
 CASE WHEN mission_id % 6 = 0 THEN 0 WHEN uav_energy_source IN ('fuel', 'hybrid') AND uav_mass_kg <> 0 THEN 1.4 ELSE 0 END AS cl, CASE WHEN uav_mass_kg > 0 THEN uav_mass_kg / (40 / sqrt(greatest(uav_rotorcraft_rotor_count, 1))) ELSE 0 END AS disk,
 CASE WHEN mission_id % 8 = 0 THEN 7 ELSE landing_preferred_sites_z_mean END AS pz, airspace_altitude_agl_min_m + 5 AS low, greatest(least(airspace_altitude_agl_max_m - 10, uav_rotorcraft_hover_ceiling_m - 20), airspace_altitude_agl_min_m + 5) AS high,
 list_sort(list_filter([CASE WHEN uav_battery_wh IS NULL THEN 'uav_battery_wh' END, CASE WHEN mission_id % 61 = 0 THEN 'feat_fault_risk' END], lambda x: x IS NOT NULL)) AS refused FROM joined),
made AS (SELECT mission_id, refused, CASE WHEN uav_energy_source = 'fuel' THEN 1 ELSE 0 END AS uav_energy_source_fuel, CASE WHEN uav_energy_source = 'hybrid' THEN 1 ELSE 0 END AS uav_energy_source_hybrid,
 {', '.join(f"CASE WHEN mission_pattern = '{v}' THEN 1 ELSE 0 END AS mission_pattern_{v}" for v in ('custom', 'grid', 'orbit', 'spiral'))}, {', '.join(f"CASE WHEN swarm_roles_first = '{v}' THEN 1 ELSE 0 END AS swarm_roles_first_{v}" for v in ('relay', 'scout', 'single', 'solo'))},
 CASE WHEN controls_mode = 'discrete' THEN 1 ELSE 0 END AS controls_mode_discrete, CASE WHEN controls_mode = 'discrete' THEN 1 ELSE 0 END AS controls_actions_first_hold, CASE WHEN controls_mode = 'discrete' THEN 0 ELSE 1 END AS controls_actions_first_throttle,
 {', '.join(x for x in S.PROFILE_NUMERIC + S.SCENARIO_NUMERIC if not x.endswith('_sites_z_mean'))},
 10 AS sim_policy_frequency, mission_time_budget_s * 10 AS sim_duration_steps, 0 AS autofix_uav_physics_count, mission_waypoints_count + 1 AS controls_actions_count,
 CASE WHEN swarm_enabled = 0 OR swarm_size = 1 THEN 1 WHEN swarm_size = 2 THEN 2 ELSE 3 END AS swarm_roles_count, mission_runway_required AS airspace_runway_threshold_count,
 CASE WHEN mission_runway_required = 1 THEN spawn_yaw_deg ELSE 0 END AS airspace_runway_heading_deg, CASE WHEN mission_runway_required = 1 THEN spawn_xyz_first ELSE 0 END AS airspace_runway_threshold_first,
 airspace_no_fly_zones_count * 4 AS airspace__geofence__sample__points_count, airspace_no_fly_zones_sample_radius_m AS airspace_no_fly_zones_dynamic_sample_radius_m, airspace_altitude_agl_min_m AS airspace_no_fly_zones_dynamic_sample_floor_m, airspace_altitude_agl_max_m AS airspace_no_fly_zones_dynamic_sample_ceiling_m,
 CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END AS environment_thermal_plumes_count, CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END AS environment__thermal__plumes__sample__ce_count, 0 AS environment_thermal_plumes_sample_radius_m, 0 AS environment_thermal_plumes_sample_w_up_mps,
 1 AS environment_wind_profile_count, (airspace_altitude_agl_min_m + airspace_altitude_agl_max_m) / 2 AS environment_wind_profile_sample_alt_m, environment_weather_wind_mps AS environment_wind_profile_sample_wind_mps, environment_weather_wind_dir_deg AS environment_wind_profile_sample_dir_deg,
 CASE WHEN faults_count = 0 THEN 0 ELSE mission_time_budget_s / 2 END AS faults_sample_t_s, 0 AS traffic_sample_heading_deg,
 airspace_no_fly_zones_count AS airspace__no__fly__zones__sample__center_count, airspace_no_fly_zones_dynamic_count AS airspace__no__fly__zones__dynamic__sampl_count, landing_preferred_sites_count AS landing__preferred__sites__sample_count, landing_emergency_sites_count AS landing__emergency__sites__sample_count,
 mission_waypoints_count AS mission__waypoints__sample_count, traffic_count AS traffic__sample__spawn_count, moving_obstacles_count AS moving__obstacles__sample__center_count, moving_obstacles_count AS moving__obstacles__sample__vel_count, comms_loss_windows_count AS comms__loss__windows__sample_count,
 wing AS uav_aero_wing_area_m2, CASE WHEN wing = 0 THEN 0 ELSE 10.2 END AS uav_aero_aspect_ratio, cl AS uav_aero_cl_max, CASE WHEN wing = 0 THEN 0 ELSE 0.025 END AS uav_aero_cd0, CASE WHEN wing = 0 OR cl <= 0 THEN 0 ELSE sqrt(19.62 * uav_mass_kg / (1.225 * wing * cl)) END AS uav_aero_stall_speed_mps,
 CASE WHEN k % 4 = 0 THEN 2.5 ELSE disk END AS uav_rotorcraft_disk_area_m2, CASE WHEN disk <= 0 THEN 0 ELSE power(uav_mass_kg * 9.81, 1.5) / sqrt(1.8375 * disk) END AS uav_battery_model_hover_power_w,
 CASE WHEN uav_payload_mass_kg = 0 THEN 0.08 ELSE least(0.5, greatest(0.05, 0.12 + 0.15 * uav_payload_mass_kg / greatest(uav_mass_kg, 1e-6))) END AS uav_battery_model_k_drag, 1 + uav_max_tilt_deg / 150 AS uav_battery_model_k_manoeuvre,
 CASE WHEN uav_payload_mass_kg = 0 THEN 0 WHEN uav_payload_mass_kg > 0.5 THEN 0.25 ELSE 0.15 END AS uav_payload_drag_coeff, CASE WHEN wing = 0 THEN 0 ELSE 10 END AS mission_transition_profile_vtol_to_ff_t_s, CASE WHEN wing = 0 THEN 0 ELSE 10 END AS mission_transition_profile_ff_to_vtol_t_s,
 airspace_altitude_agl_max_m - airspace_altitude_agl_min_m AS feat_altitude_range, CASE WHEN environment_weather_wind_mps = 0 THEN 1 ELSE environment_weather_gust_mps / environment_weather_wind_mps END AS feat_wind_gust_ratio, environment_weather_wind_mps / greatest(uav_max_speed_mps, 1e-6) AS feat_wind_speed_ratio,
 (uav_sensors_gnss + uav_sensors_lidar + uav_sensors_radar + uav_sensors_camera_rgb + uav_sensors_camera_thermal) / 5 AS feat_sensor_redundancy, uav_reserve_fraction * 100 AS feat_reserve_utilization, traffic_count / greatest(mission_time_budget_s, 1e-6) AS feat_traffic_density,
 faults_count * faults_sample_severity * faults_sample_duration_s / greatest(mission_time_budget_s, 1e-6) AS feat_fault_risk, CASE WHEN k % 4 = 0 THEN uav_mass_kg / 2.5 WHEN disk > 0 THEN uav_mass_kg / disk ELSE 0 END AS feat_disk_loading,
 least(1, greatest(0, (comms_uplink_ok + comms_downlink_ok) / 2 * (2 + comms_rssi_dbm_min / 100))) AS feat_comms_health, (environment_weather_wind_mps / 10 + environment_weather_gust_mps / 15 + environment_weather_phenomena_count) / 3 AS feat_weather_severity,
 {spread_sql('landing_preferred_sites', (ABOVE('landing_preferred_sites_count', 1, 'spawn_xyz_first'),) * 2 + ('pz',), ('CASE WHEN k % 5 = 0 THEN 10 WHEN landing_preferred_sites_count >= 2 THEN 57.74 ELSE 0 END', ABOVE('landing_preferred_sites_count', 2, '57.74'), ABOVE('landing_preferred_sites_count', 2, '2.89')))},
 {spread_sql('landing_emergency_sites', (ABOVE('landing_emergency_sites_count', 1, 'spawn_xyz_first'),) * 2 + (ABOVE('landing_emergency_sites_count', 1, 'pz'),), (ABOVE('landing_emergency_sites_count', 2, '115.47'),) * 2 + (ABOVE('landing_emergency_sites_count', 2, '5.77'),))},
 {spread_sql('mission_waypoints', (ABOVE('mission_waypoints_count', 1, 'spawn_xyz_first'),) * 2, (ABOVE('mission_waypoints_count', 3, 'mission_loiter_radius_m / 1.414'),) * 2)},
 low AS mission_waypoints_z_min, high AS mission_waypoints_z_max, high - low AS mission_waypoints_z_range, CASE WHEN mission_waypoints_count >= 1 THEN (high - low) / 4 ELSE 0 END AS mission_waypoints_z_std,
 {', '.join(f"CASE WHEN comms_loss_windows_count >= 1 THEN spawn_xyz_first {s} ELSE 0 END AS comms_loss_windows_{a}_{end}" for a in 'xy' for end, s in (('mean', ''), ('min', '- 300'), ('max', '+ 300')))},
 {', '.join(f"CASE WHEN comms_loss_windows_count >= 1 THEN 150 ELSE 0 END AS comms_loss_windows_{a}_std, 0 AS comms_loss_windows_{a}_range" for a in 'xy')},
 {', '.join(f'0 AS {x}' for x in S.RAW_FEATURES if x.endswith(S.MISSING))} FROM j)
SELECT mission_id, array_to_string(refused, ',') AS refused, {', '.join(f'CASE WHEN len(refused) = 0 THEN CAST({x} AS DOUBLE) END AS {x}' for x in C.PROCESSED)} FROM made"""


@query(GRAPH_SQL)
def legacy_processed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.array_compact(F.array(*(F.when(F.expr(c.replace("o_orderkey", "mission_id")), F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))) for k, (c, v) in GRAPH_OVERRIDES.items())))
    rows = P.flagged(joined(spark, sf_dir)).withColumn("overrides", F.map_from_entries(entries))
    return P.legacy_processed_features(rows).withColumn("refused", F.array_join("refused", ","))
