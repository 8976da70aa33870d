"""The older map of 198 processed features, derived from 68 inputs as a graph.

A node is a column with the expression that derives it. An override replaces a node where it stands in the graph, so
whatever is derived from the node follows it (in the newer row, overrides replace columns after all derivation). Nodes
are put into layers by what they read, and a layer is one projection; names that begin with an underscore are steps
between nodes that no override reaches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightloom import schemas as S
from flightloom.operators.features import PROCESSED, SITES

#: Inputs: everything that a profile and a scenario give, categories as flags of all their values but the first.
FLAGGED = [x for x in S.ONE_HOT if not x.startswith("controls_actions_first")]
INPUTS = S.CORE_FEATURES
assert sorted(INPUTS) == sorted([*FLAGGED, *S.PROFILE_NUMERIC, *S.SCENARIO_NUMERIC]) and not set(INPUTS) - set(PROCESSED)
#: Nodes that take an input as it is, unless overridden.
GIVEN = "_given_"
REPLACEABLE_INPUTS = ["landing_preferred_sites_z_mean", "mission_waypoints_z_mean"]

# Words that stand for 1 and for 0 where a number is asked for; constants of the physics nodes.
TRUE_WORDS, FALSE_WORDS = ["true", "yes", "on"], ["false", "no", "off"]
GRAVITY, AIR, ROTOR_EFFICIENCY = 9.81, 1.225, 0.75

NO_WING = "_wing = 0"
PHYSICS = {
    "_wing": "CASE WHEN uav_energy_source_fuel = 0 AND uav_energy_source_hybrid = 0 THEN 0 ELSE uav_mass_kg / 35 END",
    "uav_aero_wing_area_m2": "_wing",
    "uav_aero_aspect_ratio": f"CASE WHEN {NO_WING} THEN 0 ELSE 10.2 END",
    "uav_aero_cl_max": f"CASE WHEN {NO_WING} THEN 0 ELSE 1.4 END",
    "uav_aero_cd0": f"CASE WHEN {NO_WING} THEN 0 ELSE 0.025 END",
    "uav_aero_stall_speed_mps": f"CASE WHEN {NO_WING} OR uav_aero_cl_max <= 0 THEN 0 ELSE sqrt((2 * uav_mass_kg * {GRAVITY}) / ({AIR} * _wing * uav_aero_cl_max)) END",
    "_disk": "CASE WHEN uav_mass_kg > 0 THEN uav_mass_kg / (40 / sqrt(greatest(uav_rotorcraft_rotor_count, 1))) ELSE 0 END",
    "uav_rotorcraft_disk_area_m2": "_disk",
    "uav_battery_model_hover_power_w": f"CASE WHEN _disk <= 0 THEN 0 ELSE power(uav_mass_kg * {GRAVITY}, 1.5) / sqrt(2 * {AIR} * _disk * {ROTOR_EFFICIENCY}) END",
    "uav_battery_model_k_drag": "greatest(least(CASE WHEN uav_payload_mass_kg = 0 THEN 0.08 ELSE 0.12 + (uav_payload_mass_kg / greatest(uav_mass_kg, 0.000001)) * 0.15 END, 0.5), 0.05)",
    "uav_battery_model_k_manoeuvre": "1 + (uav_max_tilt_deg / 45) * 0.3",
    "uav_payload_drag_coeff": "CASE WHEN uav_payload_mass_kg = 0 THEN 0 WHEN uav_payload_mass_kg <= 0.5 THEN 0.15 ELSE 0.25 END",
    "mission_transition_profile_vtol_to_ff_t_s": f"CASE WHEN {NO_WING} THEN 0 ELSE 10 END",
    "mission_transition_profile_ff_to_vtol_t_s": f"CASE WHEN {NO_WING} THEN 0 ELSE 10 END",
}
PLAN = {
    "sim_policy_frequency": "10",
    "sim_duration_steps": "mission_time_budget_s * 10",
    "autofix_uav_physics_count": "0",
    "controls_actions_first_hold": "CASE WHEN controls_mode_discrete = 1 THEN 1 ELSE 0 END",
    "controls_actions_first_throttle": "CASE WHEN controls_mode_discrete = 0 THEN 1 ELSE 0 END",
    "controls_actions_count": "mission_waypoints_count + 1",
    "swarm_roles_count": "CASE WHEN swarm_enabled = 0 OR swarm_size = 1 THEN 1 WHEN swarm_size = 2 THEN 2 ELSE 3 END",
    "airspace_runway_threshold_count": "mission_runway_required",
    "airspace_runway_heading_deg": "CASE WHEN _runway = 1 THEN spawn_yaw_deg ELSE 0 END",
    "airspace_runway_threshold_first": "CASE WHEN _runway = 1 THEN _spawn_x ELSE 0 END",
    "airspace__geofence__sample__points_count": "airspace_no_fly_zones_count * 4",
    "airspace_no_fly_zones_dynamic_sample_radius_m": "airspace_no_fly_zones_sample_radius_m",
    "airspace_no_fly_zones_dynamic_sample_floor_m": "airspace_altitude_agl_min_m",
    "airspace_no_fly_zones_dynamic_sample_ceiling_m": "airspace_altitude_agl_max_m",
    "environment_thermal_plumes_count": "0",
    "environment_thermal_plumes_sample_radius_m": "0",
    "environment_thermal_plumes_sample_w_up_mps": "0",
    "environment_wind_profile_count": "1",
    "environment_wind_profile_sample_alt_m": "(airspace_altitude_agl_min_m + airspace_altitude_agl_max_m) / 2",
    "environment_wind_profile_sample_wind_mps": "environment_weather_wind_mps",
    "environment_wind_profile_sample_dir_deg": "environment_weather_wind_dir_deg",
    "faults_sample_t_s": "CASE WHEN faults_count = 0 THEN 0 ELSE mission_time_budget_s / 2 END",
    "traffic_sample_heading_deg": "0",
}
SAMPLES = {
    "airspace__no__fly__zones__sample__center_count": "airspace_no_fly_zones_count",
    "airspace__no__fly__zones__dynamic__sampl_count": "airspace_no_fly_zones_dynamic_count",
    "landing__preferred__sites__sample_count": "landing_preferred_sites_count",
    "landing__emergency__sites__sample_count": "landing_emergency_sites_count",
    "mission__waypoints__sample_count": "mission_waypoints_count",
    "traffic__sample__spawn_count": "traffic_count",
    "moving__obstacles__sample__center_count": "moving_obstacles_count",
    "moving__obstacles__sample__vel_count": "moving_obstacles_count",
    "comms__loss__windows__sample_count": "comms_loss_windows_count",
    "environment__thermal__plumes__sample__ce_count": "environment_thermal_plumes_count",
}
COMPOSITES = {
    "feat_altitude_range": "airspace_altitude_agl_max_m - airspace_altitude_agl_min_m",
    "feat_wind_gust_ratio": "CASE WHEN environment_weather_wind_mps <> 0 THEN environment_weather_gust_mps / environment_weather_wind_mps ELSE 1 END",
    "feat_wind_speed_ratio": "environment_weather_wind_mps / greatest(uav_max_speed_mps, 0.000001)",
    "feat_sensor_redundancy": f"({' + '.join(S.SENSORS)}) / 5",
    "feat_reserve_utilization": "uav_reserve_fraction * 100",
    "feat_traffic_density": "traffic_count / greatest(mission_time_budget_s, 0.000001)",
    "feat_fault_risk": "faults_count * faults_sample_severity * (faults_sample_duration_s / greatest(mission_time_budget_s, 0.000001))",
    "feat_disk_loading": "CASE WHEN uav_rotorcraft_disk_area_m2 > 0 THEN uav_mass_kg / uav_rotorcraft_disk_area_m2 ELSE 0 END",
    "feat_comms_health": "greatest(least(((comms_uplink_ok + comms_downlink_ok) / 2) * (1 + (comms_rssi_dbm_min + 100) / 100), 1), 0)",
    "feat_weather_severity": "(environment_weather_wind_mps / 10 + environment_weather_gust_mps / 15 + environment_weather_phenomena_count) / 3",
}


def places() -> dict[str, str]:
    """Moments, bounds and ranges of sites, waypoints and windows."""
    out = {x: GIVEN + x for x in REPLACEABLE_INPUTS}
    spread = {p: (f"_n_{p}", flat, high) for p, (flat, high) in SITES.items()}
    out |= {"_n_landing_preferred_sites": "TRY_CAST(landing_preferred_sites_count AS BIGINT)", "_n_landing_emergency_sites": "TRY_CAST(landing_emergency_sites_count AS BIGINT)"}
    out |= {"_n_waypoints": "TRY_CAST(mission_waypoints_count AS BIGINT)", "_n_windows": "TRY_CAST(comms_loss_windows_count AS BIGINT)", "_runway": "TRY_CAST(mission_runway_required AS BIGINT)"}
    for p, (n, flat, high) in spread.items():
        for a in "xy":
            out[f"{p}_{a}_mean"] = f"CASE WHEN {n} > 0 THEN _spawn_{a} ELSE 0 END"
        for a, s in (("x", flat), ("y", flat), ("z", high)):
            out[f"{p}_{a}_std"] = f"CASE WHEN {n} > 1 THEN {s} ELSE 0 END"
    out["landing_emergency_sites_z_mean"] = "CASE WHEN _n_landing_emergency_sites > 0 THEN landing_preferred_sites_z_mean ELSE 0 END"
    for a in "xy":
        out[f"mission_waypoints_{a}_mean"] = f"CASE WHEN _n_waypoints > 0 THEN _spawn_{a} ELSE 0 END"
        out[f"mission_waypoints_{a}_std"] = "CASE WHEN _n_waypoints <= 2 THEN 0 ELSE mission_loiter_radius_m / 1.414 END"
        out[f"comms_loss_windows_{a}_mean"] = f"CASE WHEN _n_windows > 0 THEN _spawn_{a} ELSE 0 END"
        out[f"comms_loss_windows_{a}_std"] = "CASE WHEN _n_windows > 0 THEN 150 ELSE 0 END"
        out[f"comms_loss_windows_{a}_range"] = "0"
    out["_low"] = "airspace_altitude_agl_min_m + 5"
    out["_high"] = "greatest(least(airspace_altitude_agl_max_m - 10, uav_rotorcraft_hover_ceiling_m - 20), _low)"
    out |= {"mission_waypoints_z_min": "_low", "mission_waypoints_z_max": "_high", "mission_waypoints_z_std": "CASE WHEN _n_waypoints > 0 THEN (_high - _low) / 4 ELSE 0 END"}
    bounded = {**dict.fromkeys(spread, "xyz"), "mission_waypoints": "xy", "comms_loss_windows": "xy"}
    for p, axes in bounded.items():
        for a in axes:
            out |= {f"{p}_{a}_min": f"{p}_{a}_mean - 2 * {p}_{a}_std", f"{p}_{a}_max": f"{p}_{a}_mean + 2 * {p}_{a}_std"}
    for p in (*spread, "mission_waypoints"):
        out |= {f"{p}_{a}_range": f"{p}_{a}_max - {p}_{a}_min" for a in "xyz"}
    return out


def layers(nodes: dict[str, str]) -> list[dict[str, str]]:
    """Nodes by the longest way to them: each layer reads inputs and earlier layers only. A circle is an error."""
    reads = {k: set(re.findall(r"[A-Za-z_]\w*", v)) & nodes.keys() for k, v in nodes.items()}
    depth: dict[str, int] = {}
    while len(depth) < len(nodes):
        ready = [k for k in nodes if k not in depth and reads[k] <= depth.keys()]
        if not ready:
            raise ValueError(f"nodes that read each other: {sorted(nodes.keys() - depth.keys())}")
        depth |= {k: 1 + max((depth[x] for x in reads[k]), default=-1) for k in ready}
    return [{k: nodes[k] for k in nodes if depth[k] == d} for d in range(1 + max(depth.values()))]


NODES = PHYSICS | PLAN | SAMPLES | COMPOSITES | places() | {x: "0" for x in PROCESSED if x.endswith(S.MISSING)}
OPEN = [x for x in NODES if not x.startswith("_")]
assert sorted({*OPEN, *INPUTS}) == sorted(PROCESSED)
LAYERS = layers(NODES)


def as_number(value: Column) -> Column:
    """A number in text, or a word that stands for 1 or 0; null if it is neither."""
    text = F.lower(F.trim(value))
    number = F.when(text.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[-+]?[0-9]+)?$|^[-+]?(nan|inf|infinity)$"), text.try_cast("double"))
    return F.when(text.isin(TRUE_WORDS), 1.0).when(text.isin(FALSE_WORDS), 0.0).otherwise(number)


def inputs_of(df: DataFrame) -> list[Column]:
    """The inputs as numbers, and the spawn place's coordinates; spawn_xyz_first may be one number for all three or an array of three."""
    out = []
    for x in INPUTS:
        kind = df.schema[x].dataType
        held = F.col(x)
        if isinstance(kind, T.ArrayType):
            held = F.when((F.size(x) == 3) & F.forall(x, lambda v: v.isNotNull()), F.get(x, F.lit(0)))
        number = as_number(held) if isinstance(kind, T.StringType) else held.cast("double")
        out.append(F.when(F.abs(number) < float("inf"), number).alias(GIVEN + x if x in REPLACEABLE_INPUTS else x))
    triple = isinstance(df.schema["spawn_xyz_first"].dataType, T.ArrayType)
    axes = [F.get("spawn_xyz_first", F.lit(i)).cast("double") if triple else out[INPUTS.index("spawn_xyz_first")] for i in range(2)]
    return [*out, axes[0].alias("_spawn_x"), axes[1].alias("_spawn_y")]


def flagged(df: DataFrame) -> DataFrame:
    """Columns of categories as flags of their values but the first; a null category has null flags."""
    hot = [F.when(F.col(c).isNotNull(), (F.col(c) == v).cast("double")).alias(f"{c}_{v}") for c, values in S.CATEGORIES.items() for v in values[1:] if f"{c}_{v}" in FLAGGED]
    return df.select("*", *hot)


def legacy_processed_features(df: DataFrame, overrides: str = "overrides", key: str = "mission_id") -> DataFrame:
    """The key, 198 numbers in their pinned order, and ``refused``: the inputs that are missing, not finite or can't be read and the overrides of nodes that can't be, in order of name.

    ``df`` has the 68 INPUTS as numbers, flags or text, and a map of overrides as text (null: none). Overrides of other
    names, and of inputs but the two REPLACEABLE_INPUTS, change nothing. Where anything is refused the numbers are null.
    """
    given = F.coalesce(F.col(overrides), F.create_map().cast("map<string,string>"))
    rows = df.select(key, given.alias("_overrides"), *inputs_of(df))
    names = [GIVEN + x if x in REPLACEABLE_INPUTS else x for x in INPUTS]
    absent = F.array_compact(F.array(*(F.when(F.col(n).isNull(), x) for n, x in zip(names, INPUTS))))
    known = F.array(*map(F.lit, OPEN))
    unread = F.map_keys(F.map_filter("_overrides", lambda k, v: F.array_contains(known, k) & as_number(v).isNull()))
    read = F.transform_values(F.map_filter("_overrides", lambda k, v: F.array_contains(known, k)), lambda k, v: as_number(v))
    rows = rows.withColumns({"refused": F.array_sort(F.array_distinct(F.concat(absent, unread))), "_overrides": read})
    for layer in LAYERS:
        made = {k: F.expr(v if v.startswith("TRY_CAST(") else f"CAST({v} AS DOUBLE)") for k, v in layer.items()}
        rows = rows.select("*", *((F.coalesce(F.try_element_at("_overrides", F.lit(k)), v) if k in OPEN else v).alias(k) for k, v in made.items()))
    fine = F.size("refused") == 0
    return rows.select(key, *(F.when(fine, F.col(x)).alias(x) for x in PROCESSED), "refused")
