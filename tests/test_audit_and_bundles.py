"""The older feature graph, the audit of inputs, and nested evidence bundles, by hand."""

import math

import pytest
from pyspark.sql import functions as F

from flightloom import schemas as S
from flightloom.operators import bundles as N
from flightloom.operators import graph_features as P
from flightloom.operators import quality_records as Q


def inputs(**changed):
    held = dict.fromkeys(S.CORE_FEATURES, 1.0) | {"uav_mass_kg": 4.0, "uav_energy_source_fuel": 1.0, "uav_energy_source_hybrid": 0.0, "uav_rotorcraft_rotor_count": 4.0, "uav_payload_mass_kg": 0.5, "mission_waypoints_count": 3.0, "landing_preferred_sites_count": 2.0, "spawn_xyz_first": 50.0, "airspace_altitude_agl_min_m": 10.0, "airspace_altitude_agl_max_m": 50.0, "uav_rotorcraft_hover_ceiling_m": 1000.0, "mission_time_budget_s": 600.0}
    return held | changed


def graph(spark, rows, overrides):
    df = spark.createDataFrame([(i, *(r[x] for x in S.CORE_FEATURES), o) for i, (r, o) in enumerate(zip(rows, overrides))], "mission_id long, " + ", ".join(f"{x} double" for x in S.CORE_FEATURES) + ", overrides map<string,string>")
    return {x.mission_id: x for x in P.legacy_processed_features(df).collect()}


def test_overrides_reach_what_is_derived_from_them(spark):
    plain, aero, sites, words, refused, absent, ignored = (
        None, {"uav_aero_cl_max": "2.8", "uav_rotorcraft_disk_area_m2": "8"}, {"landing_preferred_sites_x_std": "10", "landing_preferred_sites_z_mean": " 7 "},
        {"environment_thermal_plumes_count": "Yes", "feat_fault_risk": "off"}, {"feat_fault_risk": "unknown", "uav_aero_cl_max": "1d"}, None, {"uav_mass_kg": "99", "no_such_name": "x"},
    )
    rows = [inputs()] * 5 + [inputs(uav_mass_kg=None, spawn_yaw_deg=math.nan)] + [inputs()]
    got = graph(spark, rows, [plain, aero, sites, words, refused, absent, ignored])
    wing = 4 / 35
    assert len(got[0]) == 200 and got[0].refused == []
    assert got[0].uav_aero_wing_area_m2 == wing and got[0].uav_aero_cl_max == 1.4
    assert math.isclose(got[0].uav_aero_stall_speed_mps, math.sqrt(2 * 4 * 9.81 / (1.225 * wing * 1.4)))
    assert math.isclose(got[0].uav_rotorcraft_disk_area_m2, 0.2) and math.isclose(got[0].feat_disk_loading, 20)
    assert (got[0].landing_preferred_sites_x_min, got[0].landing_preferred_sites_x_max) == (50 - 2 * 57.74, 50 + 2 * 57.74)
    assert (got[0].mission_waypoints_z_min, got[0].mission_waypoints_z_max, got[0].mission_waypoints_z_std) == (15, 40, 6.25)
    assert math.isclose(got[1].uav_aero_stall_speed_mps, math.sqrt(2 * 4 * 9.81 / (1.225 * wing * 2.8))) and got[1].feat_disk_loading == 0.5
    assert got[1].uav_battery_model_hover_power_w == got[0].uav_battery_model_hover_power_w  # worked out from the area before it is replaced
    assert (got[2].landing_preferred_sites_x_min, got[2].landing_preferred_sites_x_range, got[2].landing_emergency_sites_z_mean) == (30, 40, 7)
    assert got[2].landing_preferred_sites_y_std == 57.74 and got[2].landing_preferred_sites_z_max == 7 + 2 * 2.89
    assert (got[3].environment__thermal__plumes__sample__ce_count, got[3].feat_fault_risk) == (1, 0)
    assert got[4].refused == ["feat_fault_risk", "uav_aero_cl_max"] and got[4].uav_mass_kg is None
    assert got[5].refused == ["spawn_yaw_deg", "uav_mass_kg"]
    assert got[6].uav_mass_kg == 4 and got[6].refused == []


def test_inputs_as_text_and_a_triplet(spark):
    kinds = {x: "string" if x == "swarm_enabled" else "array<double>" if x == "spawn_xyz_first" else "double" for x in S.CORE_FEATURES}
    held = [inputs(swarm_enabled="Yes", spawn_xyz_first=[1.0, 2.0, 3.0]), inputs(swarm_enabled="n/a", spawn_xyz_first=[1.0, 2.0])]
    df = spark.createDataFrame([(i, *(r[x] for x in S.CORE_FEATURES)) for i, r in enumerate(held)], "mission_id long, " + ", ".join(f"{k} {v}" for k, v in kinds.items())).withColumn("overrides", F.lit(None).cast("map<string,string>"))
    a, b = P.legacy_processed_features(df).orderBy("mission_id").collect()
    assert (a.swarm_enabled, a.spawn_xyz_first, a.landing_preferred_sites_x_mean, a.landing_preferred_sites_y_mean, a.refused) == (1, 1, 1, 2, [])
    assert b.refused == ["spawn_xyz_first", "swarm_enabled"]


def test_a_circle_of_nodes_is_an_error():
    assert P.layers({"a": "x + 1", "b": "a * 2", "c": "a + b"}) == [{"a": "x + 1"}, {"b": "a * 2"}, {"c": "a + b"}]
    with pytest.raises(ValueError, match="read each other"):
        P.layers({"a": "b", "b": "a"})


def test_audit_by_hand(spark):
    kinds = "mission_id long, uav_mass_kg double, environment_weather_wind_mps double, airspace_altitude_agl_max_m string, spawn_xyz_first array<string>, swarm_enabled boolean"
    df = spark.createDataFrame([(1, 25.0, 12.5, " 50 ", ["1", "2", "3"], True), (2, 24.6, math.inf, "None", ["1", "2"], False), (3, None, math.nan, "5O", ["x", "2", "3"], None), (4, 0.4, -1.0, "121.5", None, None)], kinds)
    records = Q.profile_data_quality(df, Q.feature_bounds(spark)).cache()
    assert records.count() == 4 * 176
    told = {(x.mission_id, x.feature_name): (x.status, x.was_missing, x.was_invalid_type, x.was_out_of_range, x.final_value) for x in records.where("correction_reason <> 'Missing feature telemetry field.'").collect()}
    good, bad = ("PROVIDED", False, False), ("IMPUTED", False, True)
    assert told == {
        (1, "uav_mass_kg"): (*good, True, 25.0), (1, "environment_weather_wind_mps"): (*good, True, 12.5), (1, "airspace_altitude_agl_max_m"): (*good, False, 50.0), (1, "spawn_xyz_first"): (*good, False, 1.0), (1, "swarm_enabled"): (*good, False, 1.0),
        (2, "uav_mass_kg"): (*good, True, 24.6), (2, "environment_weather_wind_mps"): (*bad, False, None), (2, "spawn_xyz_first"): (*bad, False, None), (2, "swarm_enabled"): (*good, False, 0.0),
        (3, "environment_weather_wind_mps"): (*bad, False, None), (3, "airspace_altitude_agl_max_m"): (*bad, False, None), (3, "spawn_xyz_first"): (*bad, False, None),
        (4, "uav_mass_kg"): (*good, True, 0.4), (4, "environment_weather_wind_mps"): (*good, True, -1.0), (4, "airspace_altitude_agl_max_m"): (*good, True, 121.5),
    }
    scores = {x.mission_id: x for x in Q.data_quality_score(records).collect()}
    assert math.isclose(scores[1].overall_data_quality_score, 0.7 * 5 / 68 + 0.3 * 5 / 198) and len(scores[1].missing_core) == 63 and scores[1].missing_core[0] == "uav_energy_source_fuel"
    assert not scores[1].is_usable and scores[1].errors[0].startswith("MISSING_CORE_FEATURES: uav_energy_source_fuel")
    whole = spark.createDataFrame([(i, *(inputs(uav_mass_kg=m)[x] for x in S.CORE_FEATURES)) for i, m in enumerate((4.0, 25.0))], "mission_id long, " + ", ".join(f"{x} double" for x in S.CORE_FEATURES))
    assert [(x.is_usable, x.errors) for x in Q.data_quality_score(Q.profile_data_quality(whole, Q.feature_bounds(spark)), True).orderBy("mission_id").collect()] == [(True, []), (False, [])]
    assert Q.data_quality_score(records.limit(0)).count() == 0


CANDS = "query_id long, chunk_id string, source_id string, source_filename string, page int, text string, origin string, final_score double, retrieval_score double, dense_score double, sparse_score double, source_match_score double, explicit boolean, section string, support_status string, synthetic boolean"


def test_bundles_there_and_back(spark):
    text = "a passage that is long enough to be quoted in full"
    values = lambda *a, **x: tuple(({"query_id": a[0], "chunk_id": a[1], "source_id": "s", "source_filename": "s.pdf", "page": 2, "text": f" {text} ", "origin": "local_document", "final_score": a[2], "retrieval_score": a[3], "dense_score": 0.3, "sparse_score": 0.2, "source_match_score": 0.5, "explicit": False, "section": None, "support_status": None, "synthetic": None} | x).values())
    rows = [
        values(1, "a", 0.5, 0.9), values(1, "b", 0.7, None, section="§ 2", support_status="own", synthetic=True), values(1, "c", 0.6, 2.0, page=None), values(1, "d", 0.4, 0.1), values(1, "g", 0.99, 0.9, origin="LLM_Synthesis"),
        values(2, "h", 0.9, 0.9, origin="hyde_generated"), values(3, "x", 0.9, 0.9, text="too short"), values(4, "y", None, 0.3), values(4, "y", None, 0.3), values(5, "z", 0.5, 0.5, page=0),
    ]
    queries = spark.createDataFrame([(i, f" query {i} ") for i in range(1, 7)], "query_id long, query string")
    made = N.evidence_bundles(spark.createDataFrame(rows, CANDS), queries).cache()
    got = {x.query_id: x for x in made.collect()}
    assert [(c.claim_id, c.claim, c.citations[0].citation_id, c.confidence) for c in got[1].claims] == [("claim_1", "Retrieved evidence is available for the query: query 1", "cit_b", 0.7), ("claim_2", "Retrieved evidence is available for the query: query 1", "cit_c", 1.0), ("claim_3", "Retrieved evidence is available for the query: query 1", "cit_a", 0.9)]
    assert (got[1].support_status, got[1].confidence, got[1].evidence_status, got[1].citation_count) == ("supported", 1.0, "grounded", 3)
    assert [(got[i].evidence_status, got[i].synthetic, got[i].support_status) for i in (2, 3, 5, 6)] == [("synthetic_only", True, "insufficient_evidence"), ("insufficient", False, "insufficient_evidence")] + [("insufficient", False, "insufficient_evidence")] * 2
    assert len(got[4].claims) == 2 and len(got[4].citations) == 1  # a repeated candidate is two claims and one citation
    flat = {(x.query_id, x.citation_id): x for x in N.bundle_citations(made).collect()}
    b, c = flat[1, "cit_b"], flat[1, "cit_c"]
    assert (b.page_start, b.section_title, b.rank, b.quote, b.support_status, b.synthetic, b.retrieval_origin, b.source_title) == (2, "§ 2", 1, text, "own", True, "scenario_driven", "s.pdf")
    assert (c.page_start, c.section_title, c.rank, c.support_status, c.synthetic, c.confidence_label) == (None, None, 2, "grounded", False, "MEDIUM")
    assert N.bundle_claims(made).count() == 5 and N.bundle_violations(made).count() == 0
    bare = made.where("query_id = 1").withColumn("citations", F.transform("citations", lambda x: x.withField("rank", F.lit(None).cast("int")).withField("support_status", F.lit(" ")).withField("synthetic", F.lit(None).cast("boolean")))).withColumn("synthetic", F.lit(True))
    assert [(x.rank, x.support_status, x.synthetic) for x in N.bundle_citations(bare).orderBy("rank").collect()] == [(i, "grounded", True) for i in (1, 2, 3)]
    broken = made.where("query_id = 1").withColumns({
        "claims": F.transform("claims", lambda x, i: x.withField("support_status", F.when(i == 0, "conflicting").when(i == 1, "insufficient_evidence").otherwise("partially_supported")).withField("conflicts", F.array(F.lit(" "))).withField("confidence", F.when(i == 0, 1.5).otherwise(0.5)).withField("citations", F.slice(x["citations"], 1, 0))),
        "citations": F.transform("citations", lambda x: x.withField("page", F.lit(0)).withField("quote", F.lit(" ")).withField("rerank_score", F.lit(-1.0)).withField("origin", F.lit("HyDE_generated"))),
        "support_status": F.lit("insufficient_evidence"), "no_evidence_reason": F.lit("  "), "bundle_id": F.lit(""), "confidence": F.lit(None).cast("double"),
    })
    found = sorted((x.place or "", x.code) for x in N.bundle_violations(broken).collect())
    of_citations = [(f"cit_{x}", code) for x in "abc" for code in ("citation_blank", "citation_generated", "citation_page", "citation_score")]
    assert found == sorted([("", "bundle_blank"), ("", "bundle_confidence"), ("", "insufficient_without_reason"), ("claim_1", "claim_confidence"), ("claim_1", "conflicting_without_conflict"), ("claim_2", "insufficient_without_limitation"), ("claim_3", "claim_without_citation"), *of_citations])
