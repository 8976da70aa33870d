"""Signals of missions some of whose inputs are null, and states of an index by hand."""

from flightloom.operators import index_status as X
from flightloom.operators import signals as G


def test_signals_of_null_inputs(spark):
    profile = "struct<max_payload_kg:double,max_altitude_m:double,hover_ceiling_m:double,reserve_fraction:double,swarm_capable:boolean,detect_and_avoid_available:boolean>"
    kinds = f"mission_id long, probabilities map<string,double>, attributions array<struct<feature:string,importance:double>>, scenario array<struct<name:string,value:string,off:boolean>>, profile {profile}, operator_notes string"
    chances, field, held, note = {"High Risk": 0.7, "Low Risk": 0.3}, [("swarm_enabled", "0.0", True)], (1.0, None, None, None, True, None), "strong wind"
    rows = [(1, chances, None, field, held, note), (2, chances, [("wind", 0.5)], None, held, None), (3, None, None, None, None, note), (4, None, None, None, None, None)]
    got = {}
    for x in G.input_signals(spark.createDataFrame(rows, kinds)).collect():
        got.setdefault(x.mission_id, set()).add(x.signal_id)
    of_profile = {"sig_profile_max_payload_kg", "sig_profile_swarm_capable"}
    assert got == {1: {"sig_ml_prediction", "sig_scenario_swarm_enabled", "sig_operator_notes", *of_profile}, 2: {"sig_ml_prediction", "sig_shap_1", *of_profile}, 3: {"sig_operator_notes"}}


def test_states_of_an_index(spark):
    chunks = spark.createDataFrame([(i, f"c{i}", f"s{i % 2}", f"s{i % 2}.pdf", "t", 1, None, "text", "sha") for i in range(4)], "vector_id long, chunk_id string, source_id string, source_filename string, source_title string, page_start int, page_end int, text string, text_sha256 string")
    docs, vectors = chunks.select("chunk_id"), chunks.selectExpr("chunk_id", "array(1.0D) AS embedding")
    sources = spark.createDataFrame([("s0", "s0.pdf", "x"), ("s1", "s1.pdf", "y")], "source_id string, filename string, sha256 string")
    manifest, listed = X.index_manifest(chunks, docs, vectors, sources, "now")
    state = lambda **t: tuple(X.index_status(spark, **t).first())
    whole = dict(manifest=manifest, sources=listed, chunks=chunks, docs=docs, vectors=vectors)
    assert state(**whole) == ("current", [], 2, 4, 4, 4, True, True)
    assert state(**{**whole, "docs": None}) == ("integrity_failed", ["missing_sparse_index"], 2, 4, 0, 4, True, True)
    assert state(**{**whole, "vectors": None})[:2] == ("missing_index", ["missing_dense_index"])
    assert state(**{**whole, "docs": docs.where("chunk_id <> 'c1'")})[:2] == ("integrity_failed", ["chunk_without_postings", "sparse_dense_count_mismatch"])
    swapped = vectors.where("chunk_id <> 'c3'").unionByName(spark.createDataFrame([("other", [1.0])], "chunk_id string, embedding array<double>"))
    assert state(**{**whole, "vectors": swapped})[1] == ["chunk_without_vector", "vector_without_chunk"]  # the counts agree, the keys don't
    assert state(**{**whole, "chunks": chunks.limit(0)})[1][:2] == ["dense_mapping_count_field_mismatch", "dense_mapping_count_mismatch"]
    empty = spark.createDataFrame([("s2", "s2.pdf", "z")], sources.schema)
    lacking = X.index_manifest(chunks, docs, vectors, sources.unionByName(empty), "now")
    assert state(**{**whole, "manifest": lacking[0], "sources": lacking[1]}) == ("integrity_failed", ["metadata_source_zero_chunks"], 3, 4, 4, 4, True, False)
