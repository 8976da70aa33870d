"""Queries of review: findings from evidence and names, gap queries, recommendations, integrity, data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom import bindings as B
from flightloom import schemas as S
from flightloom.operators import corpus as E
from flightloom.operators import graph_features as P
from flightloom.operators import index_status as X
from flightloom.operators import quality_records as Q
from flightloom.operators import review as I
from flightloom.plans.decision_queries import BUNDLES_SQL, attributions, bundles, named_by
from flightloom.plans.registry import query
from flightloom.plans.retrieval_queries import PAGES_SQL, pages
from flightloom.plans.validation_queries import WITH, joined

TEXTS = ["wind limits", "controlled airspace authorization", "c2 link reliability", "keep visual line of sight", "ground risk containment", "battery care"]
INTENTS = ["part107", "sora", "general_uav"]
ASKED = f"CASE (mission_id + k) % 6 {' '.join(f'WHEN {i} THEN {chr(39)}{t}{chr(39)}' for i, t in enumerate(TEXTS[:-1]))} ELSE '{TEXTS[-1]}' END"
MEANT = "CASE (mission_id + k) % 3 WHEN 0 THEN 'part107' WHEN 1 THEN 'sora' ELSE 'general_uav' END"
TOPIC = "CASE WHEN query = 'wind limits' THEN 'weather' WHEN query LIKE 'controlled%' THEN 'airspace' WHEN query LIKE 'c2%' THEN 'c2' WHEN query LIKE 'keep%' THEN 'vlos' WHEN query LIKE 'ground%' THEN 'sora_volume' WHEN intent = 'part107' THEN 'airspace' WHEN intent = 'sora' THEN 'sora_volume' ELSE 'general' END"
ASKED_SQL = f"{BUNDLES_SQL}, asked AS (SELECT *, k AS query_id, {ASKED} AS query, {MEANT} AS intent FROM bundles), topical AS (SELECT *, {TOPIC} AS topic FROM asked)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles(spark, sf_dir).selectExpr("*", "k AS query_id", f"{ASKED} AS query", f"{MEANT} AS intent")


FINDING_SQL = """SELECT mission_id, query_id, topic, 'operational_uncertainty' AS finding_type, 'high' AS severity, 'Unresolved operational topic: Evidence was insufficient for this query.' AS summary,
 'Treat this topic as unresolved and seek additional evidence/operator review.' AS action, query || ': Evidence was insufficient for this query.' AS limitation FROM topical WHERE support_status = 'insufficient_evidence'
UNION ALL SELECT mission_id, query_id, topic, 'evidence_backed', CASE WHEN topic IN ('airspace', 'c2') THEN 'high' ELSE 'medium' END,
 CASE topic WHEN 'weather' THEN 'Weather and wind conditions require preflight assessment before mission launch.' WHEN 'airspace' THEN 'Controlled/restricted airspace context requires authorization or operational review.'
  WHEN 'vlos' THEN 'Visual line-of-sight operating requirements should be reviewed for this mission context.' WHEN 'c2' THEN 'Command-and-control link reliability is an operational concern for mission safety.'
  WHEN 'sora_volume' THEN 'Operational volume and ground-risk context should be evaluated using SORA-style risk controls.' ELSE 'Operational evidence indicates additional UAV mission review is warranted.' END,
 CASE topic WHEN 'weather' THEN 'Review local weather, wind direction/speed, gusts, and define mission wind limits before flight.' WHEN 'airspace' THEN 'Verify airspace class, authorization requirements, and no-fly/restriction proximity before launch.'
  WHEN 'vlos' THEN 'Confirm remote pilot/visual observer responsibilities and maintain VLOS constraints.' WHEN 'c2' THEN 'Verify uplink/downlink reliability, contingency procedures, and lost-link behavior.'
  WHEN 'sora_volume' THEN 'Review operational volume, adjacent area, containment, and mitigation assumptions.' ELSE 'Perform targeted operator review for this topic and confirm mission assumptions before launch.' END, NULL
FROM topical WHERE support_status IN ('supported', 'partially_supported') AND n_citations > 0"""


@query(f"WITH {ASKED_SQL} {FINDING_SQL}")
def evidence_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.evidence_findings(asked(spark, sf_dir))


PLANNED = "CASE WHEN query = 'wind limits' THEN 'weather' WHEN query LIKE 'controlled%' THEN 'airspace' WHEN query LIKE 'c2%' THEN 'c2' WHEN query LIKE 'keep%' THEN 'vlos' WHEN query LIKE 'battery%' THEN 'energy' ELSE 'general' END"


@query(f"""WITH {ASKED_SQL}, plans AS (SELECT o_orderkey AS mission_id, k AS query_id, k AS place FROM orders, (SELECT unnest(range(10, 18)) AS k)),
planned AS (SELECT *, {ASKED.replace('k)', 'query_id)')} AS query, {MEANT.replace('k)', 'query_id)')} AS intent FROM plans), judged AS (SELECT p.*, {PLANNED} AS topic FROM planned p),
one AS (SELECT j.*, CASE WHEN EXISTS (SELECT 1 FROM asked a WHERE a.mission_id = j.mission_id AND a.query = j.query) THEN 'already_retrieved' WHEN EXISTS (SELECT 1 FROM topical t WHERE t.mission_id = j.mission_id AND t.topic = j.topic AND t.support_status <> 'insufficient_evidence') THEN 'topic_already_supported' END AS early FROM judged j),
two AS (SELECT *, CASE WHEN early IS NULL AND row_number() OVER (PARTITION BY mission_id, topic, early IS NULL ORDER BY place) > 1 THEN 'duplicate_topic' ELSE early END AS result FROM one)
SELECT mission_id, query_id, topic, coalesce(result, CASE WHEN row_number() OVER (PARTITION BY mission_id, result IS NULL ORDER BY place) <= 2 THEN 'run' ELSE 'over_limit' END) AS result FROM two""")
def plan_gap_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = B.read(spark, sf_dir, "orders").selectExpr("o_orderkey AS mission_id", "explode(sequence(10, 17)) AS k").selectExpr("mission_id", "k AS query_id", "k AS place", f"{ASKED} AS query", f"{MEANT} AS intent")
    return I.plan_gap_queries(plans, asked(spark, sf_dir), 2)


SAID = "CASE mission_id % 7 WHEN 0 THEN ' Approve' WHEN 1 THEN 'Conditional-Go' WHEN 2 THEN 'NO-GO' WHEN 3 THEN 'perhaps' WHEN 4 THEN 'rejected' WHEN 5 THEN 'no_evidence' END"
SURE = "CASE mission_id % 4 WHEN 1 THEN CAST(7 AS DOUBLE) WHEN 2 THEN CAST(-1 AS DOUBLE) WHEN 3 THEN CAST(0.75 AS DOUBLE) END"
STATE = "CASE mission_id % 3 WHEN 1 THEN 'Failed' WHEN 2 THEN 'done' END"


@query(f"""WITH {BUNDLES_SQL}, said AS (SELECT o_orderkey AS mission_id, o_orderkey % 7 AS s, o_orderkey % 4 AS c, o_orderkey % 3 AS t, o_orderkey % 2 = 0 AS structural, o_orderkey % 5 AS n FROM orders),
read AS (SELECT *, CASE s WHEN 0 THEN 'go' WHEN 1 THEN 'caution' WHEN 2 THEN 'no_go' WHEN 4 THEN 'no_go' WHEN 5 THEN 'insufficient_evidence' ELSE 'degraded' END AS r FROM said),
sure AS (SELECT *, CASE WHEN t = 1 THEN 'failed' WHEN r = 'degraded' THEN 'degraded' ELSE 'completed' END AS status, CASE c WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 WHEN 3 THEN 0.75 ELSE CASE WHEN r IN ('degraded', 'insufficient_evidence') THEN 0.0 ELSE 0.5 END END AS x FROM read),
held AS (SELECT sure.*, coalesce(weak, false) AND NOT (r = 'no_go' AND structural) AS back FROM sure LEFT JOIN (SELECT DISTINCT mission_id, true AS weak FROM bundles WHERE support_status = 'insufficient_evidence') USING (mission_id))
SELECT mission_id, CASE WHEN back THEN 'insufficient_evidence' ELSE r END AS recommendation, status, CAST(CASE WHEN back THEN least(x, 0.5) ELSE x END AS DOUBLE) AS confidence, r IN ('go', 'caution', 'no_go') AND status = 'completed' AND n = 0 AS auto_finding FROM held""")
def normalize_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.read(spark, sf_dir, "orders").selectExpr("o_orderkey AS mission_id")
    return I.normalize_recommendations(rows.selectExpr("mission_id", f"{SAID} AS recommendation", f"{SURE} AS confidence", f"{STATE} AS status", "CAST(mission_id % 5 AS INT) AS n_findings", "mission_id % 2 = 0 AS structural"), bundles(spark, sf_dir))


FIELD_ROWS = [(f, t, i) for f in S.SCENARIO_RAW for i, (t, parts) in enumerate(I.NAME_TOPICS.items()) if any(p in f for p in parts)]
NAMED_SQL = f"touching AS (SELECT * FROM (VALUES {', '.join(map(str, FIELD_ROWS))}) v(feature, topic, place)), named AS (SELECT o_orderkey AS mission_id, feature, i FROM orders, (SELECT unnest({S.SCENARIO_RAW}) AS feature, unnest(range({len(S.SCENARIO_RAW)})) AS i))"


@query(f"""WITH {ASKED_SQL}, {NAMED_SQL}, own0 AS (SELECT DISTINCT mission_id, topic, place FROM named JOIN touching USING (feature) WHERE (mission_id + i) % 9 = 0 AND NOT EXISTS (SELECT 1 FROM topical b WHERE b.mission_id = named.mission_id AND b.topic = touching.topic)),
model0 AS (SELECT DISTINCT mission_id, topic, place FROM named JOIN touching USING (feature) WHERE mission_id % 25 > 0 AND (mission_id + 7 * i) % 16 = 0 AND NOT EXISTS (SELECT 1 FROM topical b WHERE b.mission_id = named.mission_id AND b.topic = touching.topic)),
own AS (SELECT mission_id, topic, place, 'scenario_derived' AS support_status FROM (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY place) AS n FROM own0) WHERE n <= 5),
both_kinds AS (SELECT * FROM own UNION ALL SELECT mission_id, topic, place, 'model_explanation' FROM model0 m WHERE NOT EXISTS (SELECT 1 FROM own0 o WHERE o.mission_id = m.mission_id AND o.topic = m.topic))
SELECT mission_id, topic, support_status FROM (SELECT *, row_number() OVER (PARTITION BY mission_id ORDER BY support_status DESC, place) AS n FROM both_kinds) WHERE n <= 7""")
def topic_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = named_by(B.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mission_id")), -F.col("mission_id"), 9)
    backed = asked(spark, sf_dir).select("mission_id", I.query_topic(F.col("query"), F.col("intent")).alias("topic")).distinct()
    return I.topic_findings(fields, attributions(spark, sf_dir), backed)


@query(f"WITH {PAGES_SQL}, n AS (SELECT source_id, source_title, count(*) AS n FROM pages_of GROUP BY 1, 2) SELECT CASE source_title WHEN 'src1' THEN 'unknown_source' WHEN 'src2' THEN 'zero_chunk_source' ELSE 'chunk_count_mismatch' END AS code, source_id FROM n WHERE source_title IN ('src1', 'src2', 'src3')")
def manifest_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = pages(spark, sf_dir)
    manifest = held.groupBy("source_id", "source_title").agg(F.count("*").alias("chunk_count")).where("source_title <> 'src1'")
    manifest = manifest.withColumn("chunk_count", F.when(F.col("source_title") == "src3", F.col("chunk_count") + 1).otherwise(F.col("chunk_count")))
    return I.manifest_integrity(manifest, held.where("source_title <> 'src2'"))


def index_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Documents as chunks, with the tables of an index over them; every document has a place among the vectors."""
    held = pages(spark, sf_dir)
    chunks = E.assign_vector_ids(held, "source_filename", "page").withColumns({"text_sha256": F.sha2("text", 256), "page_start": F.col("page"), "page_end": F.col("page"), "text": F.concat("text", F.lit("."))})
    vectors = chunks.select("chunk_id", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    sources = held.select("source_id", F.col("source_filename").alias("filename"), F.sha2("source_filename", 256).alias("sha256")).distinct()
    docs = E.doc_stats(E.tokenize(held))
    manifest, listed = X.index_manifest(chunks, docs, vectors, sources, "2024-01-01T00:00:00")
    return {"manifest": manifest, "sources": listed, "chunks": chunks, "docs": docs, "vectors": vectors}


COUNTS_SQL = f"WITH {PAGES_SQL}, n AS (SELECT count(*) AS chunks, count(DISTINCT source_id) AS sources, count(*) FILTER (source_title <> 'src1') AS without, (SELECT count(*) FROM embeddings) AS vectors FROM pages_of)"
DAMAGED = "chunk_id_repeated,chunk_source_missing_in_metadata,chunk_without_postings,{LACKING}dense_mapping_chunk_empty_text,dense_mapping_chunk_invalid_page_range,dense_mapping_chunk_invalid_page_start,dense_mapping_count_field_mismatch,dense_mapping_count_mismatch,dense_mapping_vector_id_sequence_invalid,metadata_missing_chunk_overlap,metadata_source_chunk_count_mismatch,metadata_source_zero_chunks,metadata_vector_count_mismatch,source_count_mismatch,sparse_dense_count_mismatch"
DAMAGED_SQL = "'" + DAMAGED.format(LACKING="' || CASE WHEN EXISTS (SELECT 1 FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) THEN 'chunk_without_vector,' ELSE '' END || '") + "' || CASE WHEN EXISTS (SELECT 1 FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) THEN ',vector_without_chunk' ELSE '' END"


@query(f"""{COUNTS_SQL} SELECT 'whole' AS state_of, 'current' AS status, '' AS errors, sources AS source_count, chunks AS chunk_count, chunks AS sparse_count, chunks AS vector_count, true AS chunk_provenance_complete, true AS all_sources_have_chunks FROM n
UNION ALL SELECT 'damaged', 'integrity_failed', {DAMAGED_SQL}, sources, chunks + 1, without, vectors, false, false FROM n
UNION ALL SELECT 'without vectors', 'missing_index', 'missing_dense_index,missing_metadata', 0, chunks, chunks, 0, false, false FROM n
UNION ALL SELECT 'nothing', 'missing_index', 'missing_dense_index,missing_dense_mapping,missing_metadata,missing_sparse_index', 0, 0, 0, 0, false, false""")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index as it is, with much amiss, without vectors and manifest, and none at all."""
    t = index_tables(spark, sf_dir)
    first = t["chunks"].where("vector_id = 0")
    sources = t["sources"].withColumn("chunk_count", F.when(F.col("filename") == "src2.pdf", 0).otherwise(F.col("chunk_count"))).where("filename <> 'src3.pdf'").unionByName(spark.createDataFrame([("ghost", "g.pdf", "x", 1)], "source_id string, filename string, sha256 string, chunk_count long"))
    broken = {
        "manifest": t["manifest"].withColumn("source_count", F.col("source_count") + 1).withColumn("chunk_overlap", F.lit(None).cast("int")),
        "sources": sources,
        "chunks": t["chunks"].unionByName(first.withColumns({"text": F.lit(" "), "page_start": F.lit(0).cast("long"), "page_end": F.lit(-0).cast("long") + 1})).withColumn("page_end", F.when(F.col("vector_id") == 1, F.col("page_start") - 1).otherwise(F.col("page_end"))),
        "docs": t["docs"].join(pages(spark, sf_dir).where("source_title = 'src1'"), "chunk_id", "left_anti"),
        "vectors": B.read(spark, sf_dir, "embeddings").selectExpr("vec_id AS chunk_id"),
    }
    cases = {"whole": t, "damaged": broken, "without vectors": {k: t[k] for k in ("chunks", "docs")}, "nothing": {}}
    out = None
    for name, tables in cases.items():
        one = X.index_status(spark, **tables).select(F.lit(name).alias("state_of"), "*")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("errors", F.array_join("errors", ","))


#: Profiles as the audit sees them: known columns, an odd fuel text, a spawn place that is a triplet, a pair or missing.
FUEL = "CASE WHEN p_partkey % 7 = 0 THEN ' Unknown ' WHEN p_partkey % 7 = 1 THEN 'full' ELSE '1.5' END"
SPAWN = "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN {two} ELSE {three} END"
KNOWN = [x for x in S.PROFILE_NUMERIC if x != "uav_fuel_l"]
RECORDS_SQL = f"""WITH {B.PROFILES_SQL}, named AS (SELECT {B.PROFILE['profile_id']} AS profile_id, {FUEL} AS fuel, p_partkey % 5 AS spawn FROM part),
given AS (SELECT p.profile_id, x.name, x.v, CASE WHEN x.name = 'spawn_xyz_first' AND spawn > 0 THEN CASE WHEN spawn = 1 THEN 2 ELSE 3 END END AS size FROM profiles p JOIN named n USING (profile_id),
 LATERAL (SELECT unnest([{', '.join(f"struct_pack(name := '{c}', v := CAST({c} AS DOUBLE))" for c in KNOWN)}, struct_pack(name := 'uav_fuel_l', v := CASE WHEN fuel = '1.5' THEN 1.5 END), struct_pack(name := 'spawn_xyz_first', v := CASE WHEN spawn > 1 THEN 4.0 END)]) AS x)),
audited AS (SELECT profile_id, f.name, coalesce(f.name = 'uav_fuel_l' AND fuel = 'full', false) AS garbled, g.v, g.size FROM named CROSS JOIN (SELECT unnest({Q.AUDITED}) AS name) f LEFT JOIN given g USING (profile_id, name)),
records AS (SELECT profile_id, name AS feature_name, v AS final_value, CASE WHEN v IS NULL THEN 'IMPUTED' ELSE 'PROVIDED' END AS status, v IS NULL AND size IS NULL AND NOT garbled AS was_missing, v IS NULL AND (size IS NOT NULL OR garbled) AS was_invalid_type,
 name = 'uav_mass_kg' AND coalesce(v < 0.5 OR v > 24.5, false) AS was_out_of_range,
 CASE WHEN size = 3 THEN 'Accepted spatial triplet payload; canonical scalar anchor retained from first coordinate.' WHEN size = 2 THEN 'spawn_xyz_first must contain exactly 3 spatial values.' WHEN garbled THEN 'Invalid numeric format signals.' WHEN v IS NULL THEN 'Missing feature telemetry field.'
 WHEN name = 'uav_mass_kg' AND v >= 25 THEN 'CRITICAL OPERATIONAL BREACH DETECTED AND NATIVELY PRESERVED' WHEN name = 'uav_mass_kg' AND (v < 0.5 OR v > 24.5) THEN 'Value preserved outside safe envelope.' ELSE 'OK' END AS correction_reason,
 name IN {tuple(S.CORE_FEATURES)} AS is_core_feature FROM audited)"""


def profile_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {k: v.replace("VARCHAR(20)", "STRING") for k, v in B.PROFILE.items() if k == "profile_id" or k in KNOWN}
    odd = {"uav_fuel_l": FUEL, "spawn_xyz_first": SPAWN.format(two="array(4D, 5D)", three="array(4D, 5D, 6D)")}
    rows = B.read(spark, sf_dir, "part").selectExpr(*B.select(named | odd))
    return Q.profile_data_quality(rows, Q.feature_bounds(spark), "profile_id")


@query(f"{RECORDS_SQL} SELECT * FROM records")
def profile_data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_records(spark, sf_dir).drop("original_value", "is_critical", "place", "core_place")


#: Missions as the audit sees them: of the core features the battery's charge may be missing, and the loiter radius is text.
SCORES_SQL = f"""{WITH}, held AS (SELECT mission_id, uav_battery_wh IS NULL AS no_battery, mission_id % 6 = 0 AS no_radius, uav_mass_kg >= 25 OR environment_weather_wind_mps >= 15 OR airspace_altitude_agl_max_m >= 122 AS breach FROM joined),
lists AS (SELECT *, concat_ws(', ', CASE WHEN no_battery THEN 'uav_battery_wh' END, CASE WHEN no_radius THEN 'mission_loiter_radius_m' END) AS lacking, no_battery::INT + no_radius::INT AS n FROM held)
SELECT mission_id, round(0.7 * (68 - n) / 68 + 0.3 * (68 - n) / 198, 9) AS overall_data_quality_score, lacking AS missing_core, lacking AS imputed_core, n > 0 AS has_critical_missing, n = 0 AND NOT breach AS is_usable,
 CASE WHEN n > 0 THEN 'IMPUTED_CORE_POLICY: imputed cores present: ' || lacking || '|MISSING_CORE_FEATURES: ' || lacking ELSE '' END AS errors FROM lists"""


@query(SCORES_SQL)
def data_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.flagged(joined(spark, sf_dir)).select("mission_id", *S.CORE_FEATURES)
    rows = rows.withColumn("mission_loiter_radius_m", F.when(F.col("mission_id") % 6 == 0, "n/a").otherwise(F.col("mission_loiter_radius_m").cast("string")))
    out = Q.score_rows(rows, True)
    listed = [F.array_join(c, ", ").alias(c) for c in ("missing_core", "imputed_core")]
    return out.select("mission_id", F.round("overall_data_quality_score", 9).alias("overall_data_quality_score"), *listed, "has_critical_missing", "is_usable", F.array_join("errors", "|").alias("errors"))


@query()
def sanitize_public(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "events").select("event_id", I.sanitize_public("props").alias("public"))
