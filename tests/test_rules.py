"""Single rules on tiny tables."""

import pytest
from pyspark.sql import functions as F

from flightloom import schemas as S
from flightloom.operators import decision as J
from flightloom.operators import features as C
from flightloom.operators import retrieval as R
from flightloom.operators import validate as V

PROFILE = dict(
    user_id="user_1", profile_id="profile_1", profile_name="Raw Profile", uav_mass_kg=2.0, uav_battery_wh=1.0, uav_fuel_l=1.0, uav_energy_source="battery", uav_max_speed_mps=15.0, uav_max_tilt_deg=30.0,
    uav_reserve_fraction=0.7, uav_aero_prop_efficiency=1.0, uav_rotorcraft_max_climb_mps=1.0, uav_rotorcraft_hover_ceiling_m=1000.0, uav_rotorcraft_rotor_count=1.0,
    **{x: 1.0 for x in S.SENSORS}, max_payload_kg=5.0, max_takeoff_mass_kg=20.0, runway_capable=True, swarm_capable=True, max_swarm_size=5,
)


def scenario(**changes):
    held = {x: 1.0 for x in S.SCENARIO_RAW} | dict(
        mission_pattern="custom", controls_mode="discrete", swarm_roles_first="single", mission_time_budget_s=600.0, mission_loiter_radius_m=30.0, airspace_altitude_agl_min_m=10.0, airspace_altitude_agl_max_m=50.0, uav_payload_mass_kg=0.5,
        environment_weather_wind_mps=8.0, environment_weather_gust_mps=8.0, environment_weather_wind_dir_deg=240.0, comms_rssi_dbm_min=-50.0, environment_gnss_jam_dbm=-125.0, spawn_xyz_first=50.0,
        mission_runway_required=0.0, swarm_enabled=0.0, environment_gnss_multipath=0.0, environment_em_interference=0.0,
    )
    return held | changes


def mission(spark, profile=None, overrides=None, **changes):
    row = {"mission_id": 1, "mission_user_id": "user_1", "mission_profile_id": "profile_1", **scenario(**changes), **(PROFILE | (profile or {})), "overrides": overrides or {}}
    kinds = ["string" if k in S.CATEGORIES or k.endswith("_id") and k != "mission_id" or k == "profile_name" else "boolean" if k.endswith("_capable") else "int" if k == "max_swarm_size" else "long" if k == "mission_id" else "map<string,string>" if k == "overrides" else "double" for k in row]
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {t}" for k, t in zip(row, kinds)))


def codes(spark, **held):
    row = mission(spark, **held)
    found = [x["code"] for x in V.issue_rows(row, V.all_issues()).orderBy("seq").collect()]
    assert row.select(V.any_issue()).first()[0] == bool(found)
    return found


@pytest.mark.parametrize(
    "held, code",
    [
        ({}, []),
        ({"profile": {"uav_mass_kg": None}}, ["MISSING_PROFILE_FIELD"]),
        ({"profile": {"uav_energy_source": "solar"}}, ["INVALID_CATEGORY"]),
        ({"profile": {"uav_mass_kg": -1.0}}, ["INVALID_NUMERIC"]),
        ({"profile": {"uav_sensors_gnss": 0.5}}, ["INVALID_BOOLEAN"]),
        ({"profile": {"max_swarm_size": 0}}, ["INVALID_NUMERIC", "SWARM_SIZE_EXCEEDS_PROFILE_LIMIT"]),
        ({"traffic_count": float("nan")}, ["INVALID_NUMERIC"]),
        ({"traffic_count": float("inf")}, ["INVALID_NUMERIC"]),
        ({"airspace_altitude_agl_max_m": 10.0}, ["ALTITUDE_RANGE_INVALID"]),
        ({"overrides": {"uav_energy_source_fuel": "1"}}, ["FORBIDDEN_PROCESSED_FEATURE"]),
        ({"overrides": {"swarm_size_was_missing": "1"}}, ["INTERNAL_ONLY_OVERRIDE"]),
        ({"overrides": {"uav_type": "1"}}, ["DROPPED_METADATA_OVERRIDE"]),
        ({"overrides": {"feat_fake": "1"}}, ["INVALID_OVERRIDE_KEY"]),
        ({"overrides": {"uav_aero_cd0": "x"}}, ["INVALID_NUMERIC"]),
        ({"overrides": {"controls_actions_first": "jump"}}, ["INVALID_CATEGORY"]),
        ({"uav_payload_mass_kg": 6.0}, ["PAYLOAD_EXCEEDS_PROFILE_LIMIT"]),
        ({"uav_payload_mass_kg": 6.0, "profile": {"max_payload_kg": None}}, []),
        ({"profile": {"uav_mass_kg": 21.0}}, ["MASS_EXCEEDS_PROFILE_LIMIT"]),
        ({"airspace_altitude_agl_max_m": 1001.0}, ["ALTITUDE_EXCEEDS_HOVER_CEILING"]),
        ({"swarm_enabled": 1.0, "profile": {"swarm_capable": False}}, ["SWARM_NOT_CAPABLE"]),
        ({"mission_runway_required": 1.0, "profile": {"runway_capable": False}}, ["RUNWAY_NOT_CAPABLE"]),
        ({"environment_weather_wind_mps": 500.0}, []),
    ],
)
def test_issue_codes(spark, held, code):
    assert codes(spark, **held) == code


def test_calibration_and_overrides(spark):
    raw = C.assemble_raw_features(mission(spark, overrides={"uav_aero_wing_area_m2": "2"})).first()
    assert len(raw) == 198 and list(raw.asDict())[1:] == S.RAW_FEATURES
    assert raw["uav_rotorcraft_disk_area_m2"] == 3.5 and raw["uav_battery_model_hover_power_w"] == 111.8
    assert raw["uav_aero_wing_area_m2"] == 2 and raw["uav_aero_wing_area_m2_was_missing"] == 0 and raw["uav_aero_cd0_was_missing"] == 1
    assert raw["feat_wind_gust_ratio"] == 1 and raw["sim_duration_steps"] == 900


def test_zero_counts(spark):
    raw = C.assemble_raw_features(mission(spark, landing_preferred_sites_count=0.0, mission_waypoints_count=0.0, comms_loss_windows_count=0.0, environment_weather_wind_mps=0.0)).first()
    assert raw["landing_preferred_sites_x_mean"] == raw["mission_waypoints_x_std"] == raw["comms_loss_windows_x_min"] == 0
    assert raw["feat_wind_gust_ratio"] == 1


def test_source_cap(spark):
    rows = [(1, i, "s", "s.pdf", i, "x" * 50, True, explicit, 0.5, 1 - i / 10) for explicit in (False,) for i in range(5)]
    names = "query_id long, chunk_id long, source_id string, source_filename string, page long, text string, domain_match boolean, explicit boolean, source_match_score double, final_score double"
    held = spark.createDataFrame(rows, names)
    assert [x["chunk_id"] for x in R.diversify(held).orderBy("rank").collect()] == [0, 1]
    assert R.diversify(held.withColumn("explicit", F.lit(True))).count() == 3


def test_intents(spark):
    texts = ["vlos for small uas", "what is annex b", "bake a cake", "drone weight", "  "]
    got = {x["query_id"]: (x["intent"], x["confidence"]) for x in R.detect_intent(spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")).collect()}
    assert got == {0: ("part107", 0.9), 1: ("sora_annex_b", 0.9), 2: ("unsupported_domain", 0.1), 3: ("general_uav", 0.6), 4: ("unknown", 0.0)}


def test_veto_beats_weights(spark):
    one = mission(spark).select("*", F.create_map(F.lit("Low Risk"), F.lit(0.9), F.lit("High Risk"), F.lit(0.1)).alias("probabilities"))
    findings, bundles = J.ml_signal_finding(one), spark.createDataFrame([(1, "supported", 2)], "mission_id long, support_status string, n_citations long")
    parts = (J.ml_contribution(one), J.attribution_contribution(spark.createDataFrame([(1, "uav_mass_kg")], "mission_id long, feature string"), one), J.evidence_contribution(bundles, one), J.findings_contribution(one, findings, J.recommend(one, findings, bundles)), J.profile_contribution(one, findings), findings)
    free = J.decide(one, *parts, one.limit(0).select("mission_id")).first()
    stopped = J.decide(one, *parts, one.select("mission_id")).first()
    assert free["final_decision"] == "go" and stopped["final_decision"] == "no_go" and stopped["decision_score"] == 1.0
