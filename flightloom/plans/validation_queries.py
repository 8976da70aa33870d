"""Queries of the validation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom import bindings as B
from flightloom.operators import assessment as W
from flightloom.operators import validate as V
from flightloom.plans.registry import query

WITH = f"WITH {B.PROFILES_SQL}, {B.MISSIONS_SQL}, {B.JOINED_SQL}"


Check = tuple[str, str, str, str]  # code, field, message, SQL of what is wrong

# The checks once more, written for DuckDB apart from the operators' rules, so that a wrong name, bound or order shows.
PROFILE_NUMBERS = "uav_mass_kg uav_battery_wh uav_fuel_l uav_max_speed_mps uav_max_tilt_deg uav_reserve_fraction uav_rotorcraft_rotor_count uav_sensors_gnss uav_sensors_lidar uav_sensors_radar uav_sensors_camera_rgb uav_sensors_camera_thermal uav_aero_prop_efficiency uav_rotorcraft_max_climb_mps uav_rotorcraft_hover_ceiling_m".split()
SCENARIO_NAMES = """uav_payload_mass_kg environment_weather_wind_mps environment_weather_wind_dir_deg environment_weather_gust_mps environment_weather_phenomena_count environment_gnss_multipath environment_gnss_jam_dbm
environment_em_interference airspace_altitude_agl_min_m airspace_altitude_agl_max_m airspace_no_fly_zones_count airspace_no_fly_zones_sample_radius_m airspace_no_fly_zones_sample_floor_m airspace_no_fly_zones_sample_ceiling_m
airspace_no_fly_zones_dynamic_count airspace_runway_length_m spawn_xyz_first spawn_yaw_deg landing_preferred_sites_count landing_preferred_sites_z_mean landing_emergency_sites_count mission_waypoints_count mission_waypoints_z_mean
mission_pattern mission_time_budget_s mission_runway_required mission_loiter_radius_m traffic_count traffic_sample_speed_mps moving_obstacles_count moving_obstacles_sample_radius_m swarm_enabled swarm_size swarm_roles_first
swarm_inter_uav_sep_min_m controls_mode daa_sep_threshold_m daa_ttc_threshold_s faults_count faults_sample_duration_s faults_sample_severity comms_uplink_ok comms_downlink_ok comms_loss_windows_count comms_rssi_dbm_min""".split()
SCENARIO_NUMBERS = [x for x in SCENARIO_NAMES if x not in ("mission_pattern", "controls_mode", "swarm_roles_first")]
ABSENT = lambda code, names, what: [(code, x, f"Missing required {what}: {x}", f"{x} IS NULL") for x in names]
ENDLESS = lambda names: [("INVALID_NUMERIC", x, f"Field {x} must be a finite numeric scalar.", f"NOT isfinite({x})") for x in names]
BELOW = lambda names: [("INVALID_NUMERIC", x, f"Field {x} must be non-negative.", f"isfinite({x}) AND {x} < 0") for x in names]
NO_FLAG = lambda names, what: [("INVALID_BOOLEAN", x, f"{what} {x} must be boolean-like 0/1 or bool.", f"{x} <> 0 AND {x} <> 1") for x in names]
PROFILE_CHECKS: list[Check] = [
    *ABSENT("MISSING_PROFILE_FIELD", ("user_id", "profile_id", "profile_name"), "profile identity field"),
    *ABSENT("MISSING_PROFILE_FIELD", [*PROFILE_NUMBERS[:3], "uav_energy_source", *PROFILE_NUMBERS[3:]], "raw field"),
    ("INVALID_CATEGORY", "uav_energy_source", "Invalid category for uav_energy_source", "uav_energy_source NOT IN ('battery', 'fuel', 'hybrid')"),
    *ENDLESS(PROFILE_NUMBERS),
    *BELOW(PROFILE_NUMBERS),
    *NO_FLAG([f"uav_sensors_{x}" for x in ("gnss", "lidar", "radar", "camera_rgb", "camera_thermal")], "Sensor flag"),
    *(("INVALID_NUMERIC", x, f"Capability field {x} must be a non-negative finite number.", f"NOT isfinite({x}) OR {x} < 0") for x in ("max_payload_kg", "max_takeoff_mass_kg")),
    ("INVALID_NUMERIC", "max_swarm_size", "max_swarm_size must be an integer >= 1.", "max_swarm_size <= 0"),
]
SCENARIO_CHECKS: list[Check] = [
    *ABSENT("MISSING_SCENARIO_FIELD", SCENARIO_NAMES, "raw field"),
    ("INVALID_CATEGORY", "mission_pattern", "Invalid category for mission_pattern", "mission_pattern NOT IN ('corridor', 'custom', 'grid', 'orbit', 'spiral')"),
    ("INVALID_CATEGORY", "controls_mode", "Invalid category for controls_mode", "controls_mode NOT IN ('continuous', 'discrete')"),
    ("INVALID_CATEGORY", "swarm_roles_first", "Invalid category for swarm_roles_first", "swarm_roles_first NOT IN ('leader', 'relay', 'scout', 'single', 'solo')"),
    *ENDLESS(SCENARIO_NUMBERS),
    *BELOW([x for x in SCENARIO_NUMBERS if x not in ("environment_gnss_jam_dbm", "comms_rssi_dbm_min")]),
    *NO_FLAG(("mission_runway_required", "swarm_enabled", "comms_uplink_ok", "comms_downlink_ok", "environment_gnss_multipath", "environment_em_interference"), "Field"),
    ("ALTITUDE_RANGE_INVALID", "airspace_altitude_agl_max_m", "Maximum AGL altitude must be greater than minimum AGL altitude.", "isfinite(airspace_altitude_agl_max_m) AND isfinite(airspace_altitude_agl_min_m) AND NOT airspace_altitude_agl_max_m > airspace_altitude_agl_min_m"),
]
VETO_CHECKS: list[Check] = [
    ("PAYLOAD_EXCEEDS_PROFILE_LIMIT", "uav_payload_mass_kg", "Payload mass exceeds profile max_payload_kg.", "max_payload_kg < uav_payload_mass_kg"),
    ("MASS_EXCEEDS_PROFILE_LIMIT", "uav_mass_kg", "UAV mass exceeds profile max_takeoff_mass_kg.", "max_takeoff_mass_kg < uav_mass_kg"),
    ("ALTITUDE_EXCEEDS_HOVER_CEILING", "airspace_altitude_agl_max_m", "Mission altitude exceeds profile hover ceiling.", "uav_rotorcraft_hover_ceiling_m < airspace_altitude_agl_max_m"),
    ("SWARM_NOT_CAPABLE", "swarm_enabled", "Swarm requested but profile is not swarm capable.", "swarm_enabled = 1 AND swarm_capable = false"),
    ("SWARM_SIZE_EXCEEDS_PROFILE_LIMIT", "swarm_size", "Scenario swarm_size exceeds profile max_swarm_size.", "max_swarm_size < swarm_size"),
    ("RUNWAY_NOT_CAPABLE", "mission_runway_required", "Runway mission requested but profile is not runway capable.", "mission_runway_required = 1 AND runway_capable = false"),
]


def issues_sql(source: str, key: str, checks: list[Check]) -> str:
    """One SELECT a check, numbered by key."""
    parts = " UNION ALL ".join(f"SELECT {key}, {i} AS k, '{code}' AS code, '{field}' AS field, '{message}' AS message FROM {source} WHERE {wrong}" for i, (code, field, message, wrong) in enumerate(checks))
    return f"SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY k) AS INT) AS seq, code, field, message FROM ({parts})"


def listed(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.join_profiles(B.missions(spark, sf_dir), B.profiles(spark, sf_dir))


NUMBER_TEXT = "CASE event_id % 5 WHEN 0 THEN '  N/A ' WHEN 1 THEN CAST(value AS VARCHAR(40)) WHEN 2 THEN 'unknown' WHEN 3 THEN concat(' ', CAST(event_id AS VARCHAR(40)), ' ') ELSE event_type END"
FLAG_TEXT = "CASE event_id % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN 'OFF' WHEN 2 THEN '1' WHEN 3 THEN 'n' WHEN 4 THEN 'maybe' END"


@query(f"SELECT event_id, CASE WHEN lower(trim(t)) NOT IN {listed(V.NO_NUMBER)} THEN TRY_CAST(trim(t) AS DOUBLE) END AS number FROM (SELECT event_id, {NUMBER_TEXT} AS t FROM events)")
def parse_flexible_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = B.read(spark, sf_dir, "events").selectExpr("event_id", NUMBER_TEXT.replace("VARCHAR(40)", "STRING") + " AS t")
    return held.select("event_id", V.parse_flexible_float(F.col("t")).alias("number"))


@query(f"SELECT event_id, CASE WHEN lower(trim(t)) IN {listed(V.TRUE_WORDS)} THEN true WHEN lower(trim(t)) IN {listed(V.FALSE_WORDS)} THEN false END AS flag FROM (SELECT event_id, {FLAG_TEXT} AS t FROM events)")
def parse_flexible_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = B.read(spark, sf_dir, "events").selectExpr("event_id", f"{FLAG_TEXT} AS t")
    return held.select("event_id", V.parse_flexible_bool(F.col("t")).alias("flag"))


@query(f"WITH {B.PROFILES_SQL} " + issues_sql("profiles", "profile_id", PROFILE_CHECKS))
def validate_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validate_profiles(B.profiles(spark, sf_dir))


@query(f"WITH {B.MISSIONS_SQL} " + issues_sql("missions", "mission_id", SCENARIO_CHECKS))
def validate_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validate_scenarios(B.missions(spark, sf_dir))


@query("""SELECT mission_id, CAST(row_number() OVER (PARTITION BY mission_id ORDER BY k) AS INT) AS seq, code, field, message FROM (
SELECT o_orderkey AS mission_id, 1 AS k, 'MISSING_ASSESSMENT_FIELD' AS code, 'user_id' AS field, 'Missing assessment field: user_id' AS message FROM orders WHERE o_orderkey % 37 = 0
UNION ALL SELECT o_orderkey, 2, 'MISSING_ASSESSMENT_FIELD', 'profile_id', 'Missing assessment field: profile_id' FROM orders WHERE o_orderkey % 41 = 0
UNION ALL SELECT o_orderkey, 3, 'USER_ID_MISMATCH', 'user_id', 'Assessment user_id must match drone_profile.user_id.' FROM orders WHERE o_orderkey % 37 <> 0 AND o_orderkey % 43 = 0
UNION ALL SELECT o_orderkey, 4, 'PROFILE_ID_MISMATCH', 'profile_id', 'Assessment profile_id must match drone_profile.profile_id.' FROM orders WHERE o_orderkey % 41 <> 0 AND o_orderkey % 29 = 0)""")
def validate_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some missions' ids taken away or changed after the join, so that each rule is broken."""
    told = {"mission_user_id": "CASE WHEN mission_id % 37 = 0 THEN NULL WHEN mission_id % 43 = 0 THEN 'someone' ELSE user_id END", "mission_profile_id": "CASE WHEN mission_id % 41 = 0 THEN NULL WHEN mission_id % 29 = 0 THEN 'another' ELSE profile_id END"}
    return V.validate_identity(joined(spark, sf_dir).withColumns({k: F.expr(v) for k, v in told.items()}))


@query(f"WITH {B.MISSIONS_SQL} SELECT mission_id, 1 AS seq, 'INVALID_OVERRIDE_KEY' AS code, 'feat_fake' AS field, 'Unknown or non-overridable raw feature: feat_fake' AS message FROM missions WHERE override_fake IS NOT NULL")
def validate_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validate_overrides(B.missions(spark, sf_dir))


@query(f"{WITH} " + issues_sql("joined", "mission_id", VETO_CHECKS))
def structural_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.structural_veto(B.missions(spark, sf_dir), B.profiles(spark, sf_dir))


ALL_CHECKS: list[Check] = [
    *(("MISSING_ASSESSMENT_FIELD", x, f"Missing assessment field: {x}", f"mission_{x} IS NULL") for x in ("user_id", "profile_id")),
    *PROFILE_CHECKS,
    *SCENARIO_CHECKS,
    ("INVALID_OVERRIDE_KEY", "feat_fake", "Unknown or non-overridable raw feature: feat_fake", "override_fake = '1'"),
    ("USER_ID_MISMATCH", "user_id", "Assessment user_id must match drone_profile.user_id.", "user_id <> mission_user_id"),
    ("PROFILE_ID_MISMATCH", "profile_id", "Assessment profile_id must match drone_profile.profile_id.", "profile_id <> mission_profile_id"),
    *VETO_CHECKS,
]
ISSUES_SQL = f"issues AS ({issues_sql('joined', 'mission_id', ALL_CHECKS)})"


@query(f"{WITH}, {ISSUES_SQL} SELECT mission_id, 'blocked' AS status, 'no_go' AS final_decision, CAST(count(*) AS INT) AS n_issues, string_agg(code, ',' ORDER BY seq) AS codes FROM issues GROUP BY 1")
def split_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.split_by_issues(joined(spark, sf_dir))[0]


@query("SELECT event_id, j.k AS field FROM events, LATERAL (SELECT unnest(json_keys(props)) AS k) j WHERE j.k NOT IN ('path', 'n')")
def reject_extra_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.reject_extra_fields(B.read(spark, sf_dir, "events"), ["path", "n"], "event_id", "props")


@query(f"WITH {B.MISSIONS_SQL} SELECT mission_id, concat('mission_pattern_', mission_pattern) AS field FROM missions WHERE mission_pattern IN ('custom', 'grid', 'orbit', 'spiral')")
def reject_processed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.missions(spark, sf_dir).withColumn("supplied", F.create_map(F.concat(F.lit("mission_pattern_"), "mission_pattern"), F.lit("1")))
    return V.reject_processed_inputs(rows, "supplied")


@query(f"{WITH} SELECT mission_id, v IS NULL AS passed, v AS violated FROM (SELECT mission_id, CASE WHEN uav_mass_kg >= 25 THEN 'uav_mass_kg' WHEN environment_weather_wind_mps >= 15 THEN 'environment_weather_wind_mps' WHEN airspace_altitude_agl_max_m >= 122 THEN 'airspace_altitude_agl_max_m' END AS v FROM joined)")
def core_range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.core_range_check(joined(spark, sf_dir))
