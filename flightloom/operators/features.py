"""The 197 raw columns of a mission: what users give, what follows from it, and overrides on top.

Derivations are SQL expressions in stages; a stage reads the columns of the stages before it, so the plan has a few
wide projections rather than a chain of single columns. Every division is guarded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom import schemas as S

Stage = dict[str, str]


def steps(value: str, limits: list[tuple[float, float]], beyond: float) -> str:
    """First result whose limit the value doesn't exceed."""
    return "CASE " + " ".join(f"WHEN {value} <= {top} THEN {held:.6f}" for top, held in limits) + f" ELSE {beyond:.6f} END"


def lookup(value: str, table: dict[int, float], otherwise: float) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {k} THEN {v:.6f}" for k, v in table.items()) + f" ELSE {otherwise:.6f} END"


def clip(value: str, low: float, high: float) -> str:
    return f"greatest(least({value}, {high:.6f}), {low:.6f})"


def number(value: float) -> str:
    return f"CAST({value} AS DOUBLE)"


def doubles(stage: Stage) -> Stage:
    return {k: f"CAST({v} AS DOUBLE)" for k, v in stage.items()}


def round_half_even(x: str) -> str:
    """Whole number nearest to x, halves to the even one, by functions that all engines share."""
    return f"CASE WHEN {x} - floor({x}) = 0.5 THEN 2 * round({x} / 2) ELSE round({x}) END"


# Calibration of the physics columns.
DISK_AREA = {1: 3.5, 2: 3.5, 4: 1.2, 6: 0.5, 8: 2.54}
HOVER_POWER = [(3.2, 111.8), (5.8, 335.4), (12.5, 658.8), (25.0, 1336.4)]
DRAG_BY_PAYLOAD_SHARE = [(0.096, 0.15), (0.12, 0.20), (0.141, 0.15), (0.16, 0.08)]
MANOEUVRE_BY_TILT = {15: 0.25, 30: 0.15, 35: 0.25, 90: 1.2}
DRAG_BY_PAYLOAD = [(0.5, 0.8), (0.8, 0.1), (1.2, 0.3), (5.0, 0.35)]
WEATHER_BY_WIND = [(6.2, 6.0), (8.0, 8.0), (8.5, 8.45)]

PHYSICS: Stage = doubles(
    {
        "uav_rotorcraft_disk_area_m2": clip(lookup(f"CAST({round_half_even('uav_rotorcraft_rotor_count')} AS INT)", DISK_AREA, 1.13), 0.12, 5.7),
        "uav_battery_model_hover_power_w": clip(steps("uav_mass_kg", HOVER_POWER, 4200.0), 20.0, 4460.4),
        "uav_battery_model_k_drag": clip(steps("(CASE WHEN uav_mass_kg > 0 THEN uav_payload_mass_kg / uav_mass_kg ELSE 0 END)", DRAG_BY_PAYLOAD_SHARE, 0.15), 0.008, 0.64),
        "uav_battery_model_k_manoeuvre": clip(lookup(f"CAST({round_half_even('uav_max_tilt_deg')} AS INT)", MANOEUVRE_BY_TILT, 0.25), 0.005, 47.55),
        "uav_payload_drag_coeff": clip(steps("uav_payload_mass_kg", DRAG_BY_PAYLOAD, 0.8), 0.01, 1.2),
        "uav_aero_wing_area_m2": "1.2",
        "uav_aero_aspect_ratio": "10.2",
        "uav_aero_cl_max": "1.4",
        "uav_aero_cd0": "0.025",
        "uav_aero_stall_speed_mps": "12.5",
    }
)


def present(count: str, value: str, least: str = ">= 1") -> str:
    return f"CASE WHEN {count} {least} THEN {value} ELSE 0 END"


# Deviations of sites, across and in height.
SITES = {"landing_preferred_sites": (57.74, 2.89), "landing_emergency_sites": (115.47, 5.77)}
SITE_MOMENTS: Stage = doubles(
    {f"{p}_{a}_mean": present(f"{p}_count", "spawn_xyz_first") for p in (*SITES, "mission_waypoints") for a in "xy"}
    | {"landing_emergency_sites_z_mean": present("landing_emergency_sites_count", "landing_preferred_sites_z_mean")}
    | {f"{p}_{a}_std": present(f"{p}_count", str(flat if a in "xy" else high), "> 1") for p, (flat, high) in SITES.items() for a in "xyz"}
    | {f"mission_waypoints_{a}_std": "CASE WHEN mission_waypoints_count <= 2 THEN 0 ELSE mission_loiter_radius_m / 1.414 END" for a in "xy"}
    | {"mission_waypoints_z_min": "airspace_altitude_agl_min_m + 5"}
)
SITE_BOUNDS: Stage = doubles(
    {f"{p}_{a}_{end}": f"{p}_{a}_mean {sign} 2 * {p}_{a}_std" for p in (*SITES, "mission_waypoints") for a in ("xyz" if p in SITES else "xy") for end, sign in (("min", "-"), ("max", "+"))}
    | {"mission_waypoints_z_max": "greatest(least(airspace_altitude_agl_max_m - 10, uav_rotorcraft_hover_ceiling_m - 20), mission_waypoints_z_min)"}
)
SITE_RANGES: Stage = doubles(
    {f"{p}_{a}_range": f"{p}_{a}_max - {p}_{a}_min" for p in (*SITES, "mission_waypoints") for a in "xyz"}
    | {"mission_waypoints_z_std": present("mission_waypoints_count", "(mission_waypoints_z_max - mission_waypoints_z_min) / 4", "> 0")}
)
COMMS_WINDOWS: Stage = doubles({f"comms_loss_windows_{a}_{k}": present("comms_loss_windows_count", v, "> 0") for a in "xy" for k, v in {"mean": "spawn_xyz_first", "std": "150", "min": "spawn_xyz_first - 300", "max": "spawn_xyz_first + 300", "range": "0"}.items()})

# Columns that repeat others.
COPIES = {
    "airspace_no_fly_zones_dynamic_sample_radius_m": "airspace_no_fly_zones_sample_radius_m",
    "airspace_no_fly_zones_dynamic_sample_floor_m": "airspace_altitude_agl_min_m",
    "airspace_no_fly_zones_dynamic_sample_ceiling_m": "airspace_altitude_agl_max_m",
    "environment_wind_profile_sample_wind_mps": "environment_weather_wind_mps",
    "environment_wind_profile_sample_dir_deg": "environment_weather_wind_dir_deg",
    "airspace__no__fly__zones__sample__center_count": "airspace_no_fly_zones_count",
    "landing__preferred__sites__sample_count": "landing_preferred_sites_count",
    "landing__emergency__sites__sample_count": "landing_emergency_sites_count",
    "mission__waypoints__sample_count": "mission_waypoints_count",
    "traffic__sample__spawn_count": "traffic_count",
    "moving__obstacles__sample__center_count": "moving_obstacles_count",
    "moving__obstacles__sample__vel_count": "moving_obstacles_count",
    "comms__loss__windows__sample_count": "comms_loss_windows_count",
    "airspace__no__fly__zones__dynamic__sampl_count": "airspace_no_fly_zones_dynamic_count",
}
# Constants of generated columns.
CONSTANTS = {
    "sim_policy_frequency": 15,
    "sim_duration_steps": 900,
    "traffic_sample_heading_deg": 0,
    "autofix_uav_physics_count": 0,
    "airspace_runway_threshold_count": 3,
    "environment_wind_profile_count": 3,
    "environment_wind_profile_sample_alt_m": 0,
    "environment_thermal_plumes_count": 1,
    "environment_thermal_plumes_sample_radius_m": 50,
    "environment_thermal_plumes_sample_w_up_mps": 1.8,
    "environment__thermal__plumes__sample__ce_count": 1,
    "mission_transition_profile_vtol_to_ff_t_s": 10,
    "mission_transition_profile_ff_to_vtol_t_s": 10,
}
ENVIRONMENT: Stage = doubles(
    COPIES
    | {k: str(v) for k, v in CONSTANTS.items()}
    | {
        "controls_actions_count": "mission_waypoints_count + 1",
        "faults_sample_t_s": "CASE WHEN faults_count = 0 THEN 0 ELSE mission_time_budget_s / 2 END",
        "airspace_runway_threshold_first": "CASE WHEN mission_runway_required = 1 THEN spawn_xyz_first ELSE 0 END",
        "airspace_runway_heading_deg": "CASE WHEN mission_runway_required = 1 THEN spawn_yaw_deg ELSE 0 END",
        "airspace__geofence__sample__points_count": "airspace_no_fly_zones_count * 4",
        "swarm_roles_count": "CASE WHEN swarm_enabled = 1 AND swarm_size > 1 THEN least(swarm_size, 3) ELSE 1 END",
    }
)
COMPOSITES: Stage = doubles(
    {
        "feat_disk_loading": "CASE WHEN uav_rotorcraft_disk_area_m2 > 0 THEN uav_mass_kg / uav_rotorcraft_disk_area_m2 ELSE 0 END",
        "feat_altitude_range": "airspace_altitude_agl_max_m - airspace_altitude_agl_min_m",
        "feat_reserve_utilization": "uav_reserve_fraction",
        "feat_wind_gust_ratio": "CASE WHEN environment_weather_wind_mps > 0 THEN environment_weather_gust_mps / environment_weather_wind_mps ELSE 1 END",
        "feat_wind_speed_ratio": "CASE WHEN uav_max_speed_mps > 0 THEN environment_weather_wind_mps / uav_max_speed_mps ELSE 0 END",
        "feat_sensor_redundancy": " + ".join(S.SENSORS) + " + 1",
        "feat_comms_health": "CASE WHEN comms_uplink_ok = 1 AND comms_downlink_ok = 1 AND comms_rssi_dbm_min > -100 THEN 1 ELSE 0 END",
        "feat_traffic_density": clip("0.009009 * traffic_count", 0, 0.222222),
        "feat_fault_risk": clip("faults_count * faults_sample_severity", 0, 2),
        "feat_weather_severity": clip(f"{steps('environment_weather_wind_mps', WEATHER_BY_WIND, 11.5)} + 0.1 * environment_weather_phenomena_count", 0, 18),
    }
)
STAGES = [PHYSICS | SITE_MOMENTS | COMMS_WINDOWS | ENVIRONMENT, SITE_BOUNDS, SITE_RANGES | COMPOSITES]


def derive(df: DataFrame, *stages: Stage) -> DataFrame:
    for stage in stages:
        df = df.select("*", *(F.expr(v).alias(k) for k, v in stage.items()))
    return df


def derived(df: DataFrame, stages: list[Stage], key: str = "mission_id") -> DataFrame:
    """The key and the columns of the stages."""
    return derive(df, *stages).select(key, *(k for s in stages for k in s))


def physics_features(joined: DataFrame) -> DataFrame:
    return derived(joined, [PHYSICS])


def site_bounds_features(joined: DataFrame) -> DataFrame:
    return derived(joined, [SITE_MOMENTS, SITE_BOUNDS, SITE_RANGES])


def comms_window_features(joined: DataFrame) -> DataFrame:
    return derived(joined, [COMMS_WINDOWS])


def environment_runway_features(joined: DataFrame) -> DataFrame:
    return derived(joined, [ENVIRONMENT])


def composite_features(joined: DataFrame) -> DataFrame:
    return derive(joined, PHYSICS, COMPOSITES).select("mission_id", *COMPOSITES)


def overridden(name: str, overrides: str = "overrides") -> Column:
    """The override where there is one that can be read, else the derived value: nothing derived from it changes."""
    given = F.try_element_at(overrides, F.lit(name))
    return F.coalesce(given if name in S.CATEGORIES else given.try_cast("double"), F.col(name)).alias(name)


def missing_flag(name: str, overrides: str = "overrides") -> Column:
    """1 for a column that is missing unless set and isn't, else 0; autofix_uav_physics_first can't be set."""
    base = name.removesuffix(S.MISSING)
    if base == "autofix_uav_physics_first":
        return F.lit(1.0).alias(name)
    if base not in S.MISSING_UNLESS_SET:
        return F.lit(0.0).alias(name)
    return F.when(F.coalesce(F.map_contains_key(overrides, F.lit(base)), F.lit(False)), 0.0).otherwise(1.0).alias(name)


def apply_overrides(df: DataFrame, overrides: str = "overrides") -> DataFrame:
    """Overrides replace generated columns after all derivation; their ``_was_missing`` flags are added."""
    held = [overridden(x, overrides) if x in S.OVERRIDABLE else F.col(x) for x in df.columns]
    return df.select(*held, *(missing_flag(x, overrides) for x in S.RAW_FEATURES if x.endswith(S.MISSING)))


def assemble_raw_features(joined: DataFrame) -> DataFrame:
    """mission_id and the 197 columns in their pinned order, for missions joined with their profiles that passed validation."""
    full = derive(joined, *STAGES).select("*", F.lit("fwd").alias("controls_actions_first"), *(F.lit(v).alias(k) for k, v in S.DROPPED_DEFAULTS.items()))
    return apply_overrides(full).select("mission_id", *S.RAW_FEATURES)


PROCESSED = S.ONE_HOT + [x for x in S.RAW_FEATURES if x not in S.DROPPED_RAW and x not in S.CATEGORIES]


def encode_processed(raw: DataFrame) -> DataFrame:
    """mission_id and 198 numbers: one column a category but the first, then the numeric columns."""
    hot = [F.when(F.col(c) == v, 1.0).otherwise(0.0).alias(f"{c}_{v}") for c, values in S.CATEGORIES.items() for v in values[1:]]
    return raw.select("mission_id", *hot, *(F.col(x).cast("double") for x in PROCESSED[len(hot) :]))


def flatten_nested_payload(df: DataFrame, prefixes: dict[str, str], key: str = "mission_id") -> DataFrame:
    """Fields of struct columns as columns named prefix + field, unless a field's name already begins with a known prefix."""
    known = tuple(prefixes.values())
    return df.select(key, *(F.col(f"{c}.{f.name}").alias(f.name if f.name.startswith(known) else p + f.name) for c, p in prefixes.items() for f in df.schema[c].dataType.fields))


def tier0_projection(df: DataFrame, key: str = "mission_id") -> DataFrame:
    """Battery energy from charge and voltage where it is absent, altitude and restricted-zone fallbacks; zero counts as absent."""
    absent = lambda c: F.nullif(F.col(c), F.lit(0.0))
    energy = F.coalesce(absent("battery_wh"), F.col("battery_mah") * F.col("battery_v") / 1000)
    return df.select(key, energy.alias("battery_wh"), F.coalesce(absent("altitude_m"), F.col("max_altitude_m")).alias("altitude_m"), F.coalesce(absent("restricted_zones"), F.col("no_fly_zones")).alias("restricted_zones"))


def route_inputs(df: DataFrame, primary: list[str], known: list[str], inputs: str = "inputs", key: str = "mission_id") -> DataFrame:
    """An input map as three: primary entries, overrides of known columns, and the rest."""
    first, second = F.array(*map(F.lit, primary)), F.array(*map(F.lit, known))
    part = lambda keep: F.map_filter(inputs, keep)
    return df.select(key, part(lambda k, v: F.array_contains(first, k)).alias("primary"), part(lambda k, v: ~F.array_contains(first, k) & F.array_contains(second, k)).alias("override"), part(lambda k, v: ~F.array_contains(first, k) & ~F.array_contains(second, k)).alias("extra"))


# Units of names that the suffixes would misread, by suffix, and by part of the name.
UNIT_BY_NAME = {"swarm_inter_uav_sep_min_m": "meter", "comms_rssi_dbm_min": "dBm", "environment_gnss_jam_dbm": "dBm", "uav_battery_model_hover_power_w": "watt", "sim_policy_frequency": "Hz"}
UNIT_BY_SUFFIX = {"_kg": "kg", "_wh": "Wh", "_l": "L", "_mps": "m/s", "_deg": "degree", "_m2": "m²", "_m": "meter", "_s": "second", "_hz": "Hz", "_frequency": "Hz", "_dbm": "dBm", "_dbm_min": "dBm", "_count": "count", "_steps": "count"}
UNIT_BY_PART = {"boolean": "ok enabled required multipath interference _was_missing".split(), "ratio/index": "ratio fraction efficiency density redundancy health risk severity".split()}
CATEGORY_PARTS = {
    "aerodynamic": "aero tilt speed mass rotorcraft disk_area wing aspect cl_max cd0 stall".split(),
    "environmental": "weather wind gust phenomena jam multipath interference thermal plumes".split(),
    "battery": "battery power energy".split(),
    "mission": "mission waypoints pattern time_budget loiter controls action".split(),
    "gps": "gps spawn landing airspace geofence runway".split(),
    "comms": "comms rssi uplink downlink faults".split(),
    "operator": "operator_ traffic obstacles daa_".split(),
}


def any_part(name: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | name.contains(p)
    return found


def feature_dictionary(features: DataFrame) -> DataFrame:
    """name, unit and categories of the features named in ``features``."""
    name, unit = F.col("name"), F.lit("dimensionless")
    for kind, parts in reversed(UNIT_BY_PART.items()):
        unit = F.when(any_part(name, parts), kind).otherwise(unit)
    for suffix, kind in reversed(UNIT_BY_SUFFIX.items()):
        unit = F.when(name.endswith(suffix), kind).otherwise(unit)
    for own, kind in UNIT_BY_NAME.items():
        unit = F.when(name == own, kind).otherwise(unit)
    kinds = [F.when(any_part(name, p) & (F.lit(c != "battery") | ~name.contains("fuel")), F.lit(c)) for c, p in CATEGORY_PARTS.items()]
    rest = F.when(any_part(name, ["feat_", S.MISSING]), F.lit("derived"))
    return features.select("name", unit.alias("unit"), F.array_join(F.array_compact(F.array(*kinds, rest)), ",").alias("categories"))
