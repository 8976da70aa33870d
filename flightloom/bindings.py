"""The driver's tables as missions, profiles, corpus and logs (see FIXTURES.md). Test use: the library takes plain DataFrames.

Each expression is plain SQL that Spark and DuckDB both read, so a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(number: str, values: list) -> str:
    """CASE by number modulo the length of the list."""
    shown = [f"'{v}'" if isinstance(v, str) else str(v) for v in values]
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(shown[:-1]))
    return f"CASE {number} % {len(values)} {cases} ELSE {shown[-1]} END"


def double(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def flag(condition: str) -> str:
    return double(f"CASE WHEN {condition} THEN 1 ELSE 0 END")


K, O, C = "p_partkey", "o_orderkey", "o_custkey"
PROFILE = {
    "user_id": f"concat('user_', CAST({K} % 50 AS VARCHAR(20)))",
    "profile_id": f"concat('profile_', CAST({K} AS VARCHAR(20)))",
    "profile_name": "p_name",
    "uav_mass_kg": f"CASE WHEN {K} % 97 = 96 THEN CAST(-1 AS DOUBLE) ELSE {double('p_size')} * {double('0.6')} END",
    "uav_battery_wh": f"CASE WHEN {K} % 103 = 102 THEN NULL ELSE p_retailprice END",
    "uav_fuel_l": f"{double(f'{K} % 4')} * {double('0.5')}",
    "uav_energy_source": f"CASE WHEN {K} % 101 = 100 THEN 'solar' ELSE {pick(K, ['battery', 'fuel', 'hybrid'])} END",
    "uav_max_speed_mps": double(f"10 + {K} % 21"),
    "uav_max_tilt_deg": double(pick(K, [15, 30, 35, 45, 90])),
    "uav_reserve_fraction": f"{double(f'1 + {K} % 7')} / 10",
    "uav_rotorcraft_rotor_count": double(pick(K, [1, 2, 4, 6, 8])),
    "uav_sensors_gnss": double(f"{K} % 2"),
    "uav_sensors_lidar": double(f"floor({K} / 2) % 2"),
    "uav_sensors_radar": double(f"floor({K} / 4) % 2"),
    "uav_sensors_camera_rgb": double(f"floor({K} / 8) % 2"),
    "uav_sensors_camera_thermal": double(f"floor({K} / 16) % 2"),
    "uav_aero_prop_efficiency": double("0.7"),
    "uav_rotorcraft_max_climb_mps": double(f"3 + {K} % 5"),
    "uav_rotorcraft_hover_ceiling_m": double(f"60 + ({K} % 10) * 50"),
    "max_payload_kg": f"CASE WHEN {K} % 11 = 10 THEN NULL ELSE {double(f'1 + {K} % 6')} END",
    "max_takeoff_mass_kg": double("28"),
    "runway_capable": f"{K} % 3 = 0",
    "swarm_capable": f"{K} % 2 = 0",
    "max_swarm_size": f"CASE WHEN {K} % 2 = 0 THEN CAST(1 + {K} % 8 AS INT) ELSE NULL END",
}
#: n lines and q quantity of an order, parts the number of profiles.
SCENARIO = {
    "uav_payload_mass_kg": f"{double(f'{O} % 60')} / 10",
    "environment_weather_wind_mps": f"{double(f'{O} % 160')} / 10",
    "environment_weather_wind_dir_deg": double(f"{C} % 360"),
    "environment_weather_gust_mps": f"{double(f'{O} % 160')} / 10 + {C} % 6",
    "environment_weather_phenomena_count": double(f"{O} % 4"),
    "environment_gnss_multipath": double(f"{O} % 2"),
    "environment_gnss_jam_dbm": double("-125"),
    "environment_em_interference": double(f"{C} % 2"),
    "airspace_altitude_agl_min_m": double(f"{O} % 20"),
    "airspace_altitude_agl_max_m": double(f"{O} % 20 + ({C} % 300) - 5"),
    "airspace_no_fly_zones_count": double(f"{O} % 4"),
    "airspace_no_fly_zones_sample_radius_m": double("100"),
    "airspace_no_fly_zones_sample_floor_m": double("0"),
    "airspace_no_fly_zones_sample_ceiling_m": double("120"),
    "airspace_no_fly_zones_dynamic_count": double(f"{C} % 2"),
    "airspace_runway_length_m": double("500"),
    "spawn_xyz_first": double(f"{C} % 100"),
    "spawn_yaw_deg": double(f"{O} % 360"),
    "landing_preferred_sites_count": double(f"{O} % 3"),
    "landing_preferred_sites_z_mean": double("5"),
    "landing_emergency_sites_count": double(f"{C} % 3"),
    "mission_waypoints_count": double("n % 7"),
    "mission_waypoints_z_mean": double("30"),
    "mission_pattern": f"CASE WHEN {O} % 211 = 210 THEN 'zigzag' ELSE {pick(O, ['corridor', 'custom', 'grid', 'orbit', 'spiral'])} END",
    "mission_time_budget_s": double(f"300 + {O} % 900"),
    "mission_runway_required": flag(f"{O} % 7 = 0"),
    "mission_loiter_radius_m": double(f"10 + {O} % 40"),
    "traffic_count": double("n"),
    "traffic_sample_speed_mps": double("10"),
    "moving_obstacles_count": double(f"{O} % 4"),
    "moving_obstacles_sample_radius_m": double("5"),
    "swarm_enabled": flag(f"{C} % 5 = 0"),
    "swarm_size": double(f"1 + {O} % 5"),
    "swarm_roles_first": pick(C, ["leader", "relay", "scout", "single", "solo"]),
    "swarm_inter_uav_sep_min_m": double("10"),
    "controls_mode": pick(O, ["continuous", "discrete"]),
    "daa_sep_threshold_m": double("50"),
    "daa_ttc_threshold_s": double("20"),
    "faults_count": double(f"{O} % 3"),
    "faults_sample_duration_s": "q",
    "faults_sample_severity": f"{double(f'{C} % 11')} / 10",
    "comms_uplink_ok": flag(f"{O} % 9 > 0"),
    "comms_downlink_ok": flag(f"{C} % 9 > 0"),
    "comms_loss_windows_count": double(f"{C} % 2"),
    "comms_rssi_dbm_min": double(f"-40 - {O} % 80"),
}
NOTES = f"CASE {O} % 5 WHEN 0 THEN NULL WHEN 1 THEN 'strong wind expected' WHEN 2 THEN 'controlled airspace near airport' WHEN 3 THEN 'keep visual line of sight' ELSE 'multiple drone swarm' END"
WEIGHTS = {"High Risk": f"({O} % 97) + 1", "Medium Risk": f"({C} % 89) + 1", "Low Risk": f"(({O} + {C}) % 83) + 1"}
TOTAL = " + ".join(WEIGHTS.values())
MISSION = {
    "mission_id": O,
    "mission_user_id": f"concat('user_', CAST(({O} % parts) % 50 AS VARCHAR(20)))",
    "mission_profile_id": f"concat('profile_', CAST({O} % parts AS VARCHAR(20)))",
    "created_at": "o_orderdate",
    **SCENARIO,
    "operator_notes": NOTES,
    "override_wing": f"CASE WHEN {O} % 10 = 0 THEN CAST(1 + {O} % 3 AS VARCHAR(20)) END",
    "override_fake": f"CASE WHEN {O} % 307 = 306 THEN '1' END",
    **{f"p_{k.split()[0].lower()}": f"CAST({v} AS DOUBLE) / CAST({TOTAL} AS DOUBLE)" for k, v in WEIGHTS.items()},
}


def select(expressions: dict[str, str]) -> list[str]:
    return [f"{v} AS {k}" for k, v in expressions.items()]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").selectExpr(*(x.replace("VARCHAR(20)", "STRING") for x in select(PROFILE)))


def missions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order, with the scenario's columns, ``overrides`` and ``probabilities`` as maps."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    parts = read(spark, sf_dir, "part").count()
    held = orders.join(lines, "o_orderkey", "left").select("o_orderkey", "o_custkey", "o_orderdate", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("q", F.lit(0.0)).alias("q"), F.lit(parts).alias("parts"))
    flat = held.selectExpr(*(x.replace("VARCHAR(20)", "STRING") for x in select(MISSION)))
    overrides = F.map_filter(F.create_map(F.lit("uav_aero_wing_area_m2"), F.col("override_wing"), F.lit("feat_fake"), F.col("override_fake")), lambda k, v: v.isNotNull())
    chances = F.create_map(F.lit("High Risk"), F.col("p_high"), F.lit("Medium Risk"), F.col("p_medium"), F.lit("Low Risk"), F.col("p_low"))
    return flat.withColumn("overrides", overrides).withColumn("probabilities", chances).drop("override_wing", "override_fake", "p_high", "p_medium", "p_low")


#: The same tables for DuckDB, as common table expressions.
PROFILES_SQL = f"profiles AS (SELECT {', '.join(select(PROFILE))} FROM part)"
MISSIONS_SQL = f"""bound AS (SELECT o_orderkey, o_custkey, o_orderdate, coalesce(l.n, 0) AS n, coalesce(l.q, 0) AS q, (SELECT count(*) FROM part) AS parts
 FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey),
missions AS (SELECT {', '.join(select(MISSION))} FROM bound)"""
JOINED_SQL = "joined AS (SELECT * FROM missions LEFT JOIN profiles ON mission_user_id = user_id AND mission_profile_id = profile_id)"
