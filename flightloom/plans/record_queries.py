"""Queries of evidence, fingerprints, chunking, records, sources and learned settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom import bindings as B
from flightloom.functions import chunking, fingerprints
from flightloom.operators import bundles as N
from flightloom.operators import evidence as H
from flightloom.operators import records as K
from flightloom.plans.decision_queries import BUNDLES_SQL, DECIDE_SQL, bundles, decided
from flightloom.plans.registry import query
from flightloom.plans.retrieval_queries import FOUND_SQL, HISTORY_SQL, PAGES_SQL, PRINTS_SQL, SEARCH_SQL, found, fresh_candidates, history, pages, search_queries
from flightloom.sources import tables as A
from flightloom.streaming import learning as L

ORIGIN = "CASE chunk_id % 11 WHEN 3 THEN 'LLM_Synthesis' WHEN 4 THEN 'hyde_generated' WHEN 5 THEN NULL WHEN 6 THEN 'operator_input' ELSE 'local_document' END"
PAGE = "CASE WHEN chunk_id % 7 = 2 THEN NULL ELSE page END"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).withColumn("origin", F.expr(ORIGIN)).withColumn("page", F.expr(PAGE)).withColumn("retrieval_score", F.col("rrf_score") * 10)


CANDIDATES_SQL = SEARCH_SQL.replace("found AS (SELECT query_id, chunk_id, source_id, final_score,", "found AS (SELECT query_id, chunk_id, source_id, final_score, page, rrf_score, dense_score, sparse_score, explicit, source_match_score,") + f", cands AS (SELECT *, {ORIGIN} AS origin, rrf_score * 10 AS retrieval_score FROM found WHERE rank <= 10), fit AS (SELECT * FROM cands WHERE origin IS NULL OR origin NOT IN ('LLM_Synthesis', 'hyde_generated'))"


@query(f"{CANDIDATES_SQL} SELECT query_id, chunk_id FROM fit")
def sufficient_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.sufficient_candidates(candidates(spark, sf_dir)).select("query_id", "chunk_id")


CITED_SQL = f"""{CANDIDATES_SQL}, cited AS (SELECT query_id, 'cit_' || chunk_id AS citation_id, source_id, page, CASE WHEN origin = 'local_document' THEN origin ELSE 'retrieval_system' END AS origin,
 greatest(0.0, least(1.0, final_score)) AS final_score, greatest(0.0, least(1.0, dense_score)) AS dense_score, greatest(0.0, least(1.0, sparse_score)) AS sparse_score, greatest(0.0, least(1.0, source_match_score)) AS source_match_score FROM fit),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, citation_id) AS INT) AS rank, 0.6 * final_score + 0.2 * dense_score + 0.1 * sparse_score + 0.1 * source_match_score AS blend FROM cited),
bundled AS (SELECT q.item_id AS query_id, CASE WHEN count(r.rank) = 0 THEN 'insufficient_evidence' ELSE 'supported' END AS support_status, coalesce(string_agg(citation_id, ',' ORDER BY rank), '') AS citation_ids, round(coalesce(max(final_score), 0), 9) AS confidence, CASE WHEN count(r.rank) = 0 THEN 'No sufficient evidence was found.' END AS no_evidence_reason FROM benchmark q LEFT JOIN ranked r ON r.query_id = q.item_id AND r.rank <= 3 GROUP BY 1)"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.rank_citations(H.build_citations(H.sufficient_candidates(candidates(spark, sf_dir))))


@query(f"{CITED_SQL} SELECT query_id, citation_id, origin, round(final_score, 9) AS final_score FROM cited")
def build_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.build_citations(H.sufficient_candidates(candidates(spark, sf_dir))).select("query_id", "citation_id", "origin", F.round("final_score", 9).alias("final_score"))


@query(f"{CITED_SQL} SELECT query_id, rank, citation_id, CASE WHEN blend >= 0.65 THEN 'HIGH' WHEN blend >= 0.45 THEN 'MEDIUM' WHEN blend >= 0.25 THEN 'LOW' ELSE 'VERY LOW' END AS label FROM ranked")
def rank_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).select("query_id", "rank", "citation_id", "label")


def query_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.build_bundles(ranked(spark, sf_dir), search_queries(spark, sf_dir))


@query(f"{CITED_SQL} SELECT * FROM bundled")
def build_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_bundles(spark, sf_dir).withColumn("citation_ids", F.array_join("citation_ids", ",")).withColumn("confidence", F.round("confidence", 9))


@query(f"{CITED_SQL} SELECT query_id, CASE support_status WHEN 'supported' THEN 'insufficient_without_reason' ELSE 'supported_without_citation' END AS code FROM bundled")
def evidence_contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles with their statuses exchanged: each then breaks one rule."""
    held = query_bundles(spark, sf_dir)
    return H.evidence_contract_violations(held.withColumn("support_status", F.when(F.col("support_status") == "supported", "insufficient_evidence").otherwise("supported")))


@query(f"{CITED_SQL} SELECT query_id, rank - 1 AS at_place, citation_id, 'supported' AS support_status FROM ranked WHERE rank <= 3")
def flatten_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.flatten_citations(query_bundles(spark, sf_dir))


SURE = "greatest(0.0, least(1.0, c.retrieval_score))"
NESTED_SQL = f"""{CITED_SQL}, whole AS (SELECT r.query_id, r.rank, r.citation_id, CASE WHEN c.chunk_id % 7 = 2 THEN NULL ELSE r.page END AS page, r.origin, {SURE} AS retrieval_score, CASE WHEN r.blend >= 0.65 THEN 'HIGH' WHEN r.blend >= 0.45 THEN 'MEDIUM' WHEN r.blend >= 0.25 THEN 'LOW' ELSE 'VERY LOW' END AS confidence_label,
 'bundle_' || substr(sha256(trim(b.text)), 1, 16) AS bundle_id, 'Retrieved evidence is available for the query: ' || trim(b.text) AS claim, trim(d.text) AS quote, d.source || '.pdf' AS source_filename, d.source AS source_title
 FROM ranked r JOIN cands c ON c.query_id = r.query_id AND 'cit_' || c.chunk_id = r.citation_id JOIN benchmark b ON b.item_id = r.query_id JOIN documents d ON d.doc_id = c.chunk_id WHERE r.rank <= 3),
found_of AS (SELECT query_id, bool_or(coalesce(lower(origin) IN ('llm_synthesis', 'hyde_generated'), false)) AS generated FROM cands GROUP BY 1)"""


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.evidence_bundles(candidates(spark, sf_dir), search_queries(spark, sf_dir))


@query(f"""{NESTED_SQL} SELECT 'bundle_' || substr(sha256(trim(b.text)), 1, 16) AS bundle_id, b.item_id AS query_id, CASE WHEN count(w.rank) = 0 THEN 'insufficient_evidence' ELSE 'supported' END AS support_status, round(coalesce(max(retrieval_score), 0), 9) AS confidence,
 CASE WHEN count(w.rank) = 0 THEN 'No sufficient evidence candidates passed retrieval safety checks.' END AS no_evidence_reason, 'scenario_driven' AS retrieval_origin, CASE WHEN count(w.rank) > 0 THEN 'grounded' WHEN coalesce(bool_or(generated), false) THEN 'synthetic_only' ELSE 'insufficient' END AS evidence_status,
 count(w.rank) = 0 AND coalesce(bool_or(generated), false) AS synthetic, CAST(count(w.rank) AS INT) AS citation_count, CAST(count(w.rank) AS INT) AS n_claims FROM benchmark b LEFT JOIN whole w ON w.query_id = b.item_id LEFT JOIN found_of f ON f.query_id = b.item_id GROUP BY b.item_id, b.text""")
def evidence_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested(spark, sf_dir).withColumns({"n_claims": F.size("claims"), "confidence": F.round("confidence", 9)}).drop("claims", "citations", "query")


@query(f"{NESTED_SQL} SELECT query_id, bundle_id, rank - 1 AS at_place, 'claim_' || rank AS claim_id, claim, 'supported' AS support_status, 'retrieval_context' AS evidence_use, citation_id, round(retrieval_score, 9) AS confidence FROM whole")
def bundle_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = N.bundle_claims(nested(spark, sf_dir))
    return held.select("query_id", "bundle_id", "at_place", "claim_id", "claim", "support_status", "evidence_use", F.array_join(F.col("citations.citation_id"), ",").alias("citation_id"), F.round("confidence", 9).alias("confidence"))


@query(f"{NESTED_SQL} SELECT query_id, bundle_id, citation_id, source_filename, source_title, CAST(page AS INT) AS page_start, CAST(NULL AS INT) AS page_end, CAST(NULL AS VARCHAR) AS section_title, quote, round(retrieval_score, 9) AS retrieval_score, confidence_label, rank, 'scenario_driven' AS retrieval_origin, 'grounded' AS support_status, false AS synthetic FROM whole")
def bundle_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.bundle_citations(nested(spark, sf_dir)).withColumn("retrieval_score", F.round("retrieval_score", 9))


@query(f"""{NESTED_SQL}, numbers AS (SELECT item_id AS query_id, 'bundle_' || substr(sha256(trim(b.text)), 1, 16) AS bundle_id, count(rank) AS n FROM benchmark b LEFT JOIN whole w ON w.query_id = b.item_id GROUP BY b.item_id, b.text)
SELECT query_id, bundle_id, NULL AS place, 'insufficient_without_reason' AS code FROM numbers WHERE n > 0
UNION ALL SELECT query_id, bundle_id, claim_id, code FROM (SELECT query_id, bundle_id, 'claim_' || rank AS claim_id, CASE rank WHEN 1 THEN 'claim_without_citation' WHEN 2 THEN 'insufficient_without_limitation' ELSE 'conflicting_without_conflict' END AS code FROM whole)
UNION ALL SELECT query_id, bundle_id, citation_id, 'citation_page' FROM whole WHERE page - 2 < 1""")
def bundle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles made to contradict themselves: no reason for none, claims without what their state asks for, pages two lower."""
    states = F.array(*map(F.lit, (N.SUPPORTED, N.INSUFFICIENT, N.CONFLICTING)))
    broken = F.transform("claims", lambda x, i: x.withField("support_status", F.get(states, i)).withField("citations", F.slice(x["citations"], 1, 0)))
    held = nested(spark, sf_dir).where("support_status = 'supported'")
    held = held.withColumns({"claims": broken, "support_status": F.lit(N.INSUFFICIENT), "citations": F.transform("citations", lambda c: c.withField("page", c["page"] - 2))})
    return N.bundle_violations(held)


@query(f"""WITH {BUNDLES_SQL}, asked_for AS (SELECT *, (mission_id + k) % 7 = 0 AS synthetic FROM bundles WHERE (mission_id + 2 * k) % 5 <> 0),
counted AS (SELECT o_orderkey AS mission_id, count(k) AS n, count(CASE WHEN support_status = 'supported' THEN 1 END) AS good, count(CASE WHEN support_status = 'partially_supported' THEN 1 END) AS half, count(CASE WHEN support_status = 'insufficient_evidence' THEN 1 END) AS weak, coalesce(bool_or(synthetic), false) AS made FROM orders LEFT JOIN asked_for ON mission_id = o_orderkey GROUP BY 1),
named AS (SELECT mission_id, CASE WHEN n = 0 THEN 'unavailable' WHEN good = n THEN 'grounded' WHEN good + half = n THEN 'partial' WHEN weak = n AND made THEN 'synthetic_only' WHEN weak = n THEN 'insufficient' ELSE 'partial' END AS evidence_status FROM counted)
SELECT *, CASE evidence_status WHEN 'grounded' THEN true WHEN 'unavailable' THEN NULL ELSE false END AS grounded FROM named""")
def scenario_evidence_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = bundles(spark, sf_dir).withColumn("synthetic", F.expr("(mission_id + k) % 7 = 0")).withColumn("retrieval_origin", F.expr("CASE (mission_id + 2 * k) % 5 WHEN 0 THEN 'agent_requested' WHEN 1 THEN NULL ELSE 'scenario_driven' END"))
    return H.scenario_evidence_status(held, B.read(spark, sf_dir, "orders").selectExpr("o_orderkey AS mission_id"))


CASES_SQL = f"""{CITED_SQL}, cases AS (SELECT q.item_id AS query_id, q.item_id % 4 > 0 AS should_have, q.item_id % 3 = 1 AS critical, 2 AS minimum, count(r.rank) AS n,
 q.item_id % 11 = 0 OR coalesce(bool_or(contains(r.source_id, 'src' || CAST(q.item_id % 10 AS VARCHAR)) OR contains(r.source_id, 'src' || CAST(q.item_id % 7 AS VARCHAR))), false) AS matched,
 coalesce(bool_and(trim(r.source_id) <> '' AND coalesce(r.page, 1) >= 1) FILTER (WHERE r.rank IS NOT NULL), true) AS complete FROM benchmark q LEFT JOIN ranked r ON r.query_id = q.item_id GROUP BY 1),
judged AS (SELECT *, concat_ws(',', CASE WHEN should_have AND n = 0 THEN 'no_evidence' END, CASE WHEN should_have AND n < minimum THEN 'too_few' END, CASE WHEN should_have AND NOT matched THEN 'no_source' END, CASE WHEN should_have AND NOT complete THEN 'no_provenance' END, CASE WHEN NOT should_have AND n > 0 THEN 'not_refused' END) AS warnings FROM cases)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("query_id")
    keywords = F.when(q % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("src"), (q % 10).cast("string")), F.concat(F.lit("SRC"), (q % 7).cast("string"))))
    expected = search_queries(spark, sf_dir).select(q, keywords.alias("keywords"), F.lit(2).alias("minimum"), (q % 4 > 0).alias("should_have"), (q % 3 == 1).alias("critical"))
    return H.retrieval_quality_cases(expected, ranked(spark, sf_dir))


@query(f"{CASES_SQL} SELECT * FROM judged")
def retrieval_quality_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).withColumn("warnings", F.array_join("warnings", ","))


@query(f"""{CASES_SQL}, good AS (SELECT *, should_have AND n >= minimum AND n > 0 AS good, CASE WHEN warnings = '' THEN 0 ELSE length(warnings) - length(replace(warnings, ',', '')) + 1 END AS w FROM judged),
summed AS (SELECT count(*) AS cases, count(*) FILTER (should_have) AS expected, count(*) FILTER (good) AS supported, count(*) FILTER (good AND matched) AS matched, count(*) FILTER (good AND complete) AS complete, count(*) FILTER (NOT should_have AND n = 0) AS refused, CAST(sum(w) AS BIGINT) AS warnings,
 bool_and(NOT (should_have AND critical) OR (n > 0 AND matched AND complete)) AS kept FROM good)
SELECT * EXCLUDE (kept), supported > 0 AND kept AS usable, expected > 0 AND supported = expected AND matched = expected AND complete = expected AND refused = cases - expected AND warnings = 0 AS proven FROM summed""")
def retrieval_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.retrieval_quality_report(cases(spark, sf_dir))


@query(f"WITH {PAGES_SQL}, {PRINTS_SQL} SELECT doc_id, CAST(coalesce(fingerprint, 0)::HUGEINT - CASE WHEN fingerprint >= 9223372036854775808 THEN 18446744073709551616::HUGEINT ELSE 0 END AS BIGINT) AS fingerprint FROM documents LEFT JOIN prints ON chunk_id = doc_id")
def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_rows(B.read(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH {PAGES_SQL}, {PRINTS_SQL}, own AS (SELECT coalesce(fingerprint, 0) AS f, min(doc_id) AS id FROM documents LEFT JOIN prints ON chunk_id = doc_id GROUP BY 1)
SELECT x.id AS a, y.id AS b, CAST(bit_count(xor(x.f, y.f)) AS INT) AS distance FROM own x JOIN own y ON x.id < y.id AND bit_count(xor(x.f, y.f)) <= 3""")
def simhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.simhash_pairs(simhash(spark, sf_dir).withColumnRenamed("doc_id", "id"))


@query(f"{FOUND_SQL} SELECT query_id, chunk_id FROM walk WHERE fresh AND nth > 0")
def dedupe_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fresh_candidates(spark, sf_dir).select("query_id", "chunk_id")


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(pages(spark, sf_dir))


RECORDS_SQL = f"{DECIDE_SQL}, records AS (SELECT 'assessment_' || mission_id AS assessment_id, mission_user_id AS user_id, mission_profile_id AS profile_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, final_decision, decision_score, confidence_level FROM decided JOIN missions USING (mission_id))"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.build_records(decided(spark, sf_dir), B.missions(spark, sf_dir))


@query(f"{RECORDS_SQL} SELECT * FROM records")
def build_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir)


@query(f"{RECORDS_SQL} SELECT assessment_id, profile_id, created_at, final_decision || ' (' || printf('%.3f', decision_score + 1e-9) || ')' AS summary FROM records WHERE user_id = 'user_7'")
def list_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.list_assessments(records(spark, sf_dir), "user_7")


NOTE = "CASE event_id % 4 WHEN 0 THEN concat('My  Chain_of_Thought is ', props, ' and a THOUGHT x') WHEN 1 THEN concat(' plain ', props, '  ', props, '  ', props, '  ', props, '  ', props, '  ', props, '  ', props, '  ', props, '  ', props) WHEN 2 THEN '  ' END"
WORDS = "internal_reasoning|private_reasoning|chain_of_thought|reasoning_chain|scratchpad|thought"


@query(f"SELECT event_id, CASE WHEN h = '' THEN 'not_available' WHEN length(h) > 120 THEN rtrim(substr(h, 1, 117)) || '...' ELSE h END AS note FROM (SELECT event_id, CASE WHEN regexp_matches(lower(p), '{WORDS}') THEN regexp_replace(lower(p), '{WORDS}', '[redacted_forbidden_token]', 'g') ELSE p END AS h FROM (SELECT event_id, trim(regexp_replace(coalesce({NOTE}, 'not_available'), '\\s+', ' ', 'g')) AS p FROM events))")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "events").selectExpr("event_id", f"{NOTE} AS t").select("event_id", K.redact_text(F.col("t"), 120).alias("note"))


TOLD = "concat('A Decision Score of ', CAST((mission_id % 100) / 100.0 AS VARCHAR(9)), ' with confidence level: ', CASE mission_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'medium' WHEN 2 THEN 'High' ELSE 'unknown' END, '; FINAL decision ', CASE mission_id % 5 WHEN 0 THEN 'is go' WHEN 1 THEN '= Caution' WHEN 2 THEN 'is no_go' WHEN 3 THEN 'no go' ELSE 'stays open' END, '.')"


@query(f"""{DECIDE_SQL} SELECT mission_id, 'score_mismatch' AS code FROM decided WHERE abs((mission_id % 100) / 100.0 - decision_score) > 0.02
UNION ALL SELECT mission_id, 'confidence_mismatch' FROM decided WHERE mission_id % 4 < 3 AND confidence_level <> CASE mission_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END
UNION ALL SELECT mission_id, 'decision_mismatch' FROM decided WHERE mission_id % 5 < 4 AND final_decision <> CASE mission_id % 5 WHEN 0 THEN 'go' WHEN 1 THEN 'caution' ELSE 'no_go' END""")
def narrative_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = B.read(spark, sf_dir, "orders").selectExpr("o_orderkey AS mission_id").selectExpr("mission_id", TOLD.replace("VARCHAR(9)", "STRING").replace("/ 100.0", "/ 100") + " AS narrative")
    return K.narrative_conflicts(told, decided(spark, sf_dir))


@query(f"WITH {BUNDLES_SQL} SELECT mission_id, 'bundle_' || (k + 1) AS ref FROM bundles WHERE k = mission_id % 4")
def unknown_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = bundles(spark, sf_dir)
    known = held.select("mission_id", F.concat(F.lit("bundle_"), F.col("k").cast("string")).alias("ref"))
    return K.unknown_references(held.select("mission_id", F.concat(F.lit("bundle_"), (F.col("k") + 1).cast("string")).alias("ref")), known)


@query(f"WITH {B.PROFILES_SQL} SELECT profile_id, runway_capable, swarm_capable, concat_ws(',', CASE WHEN uav_sensors_camera_rgb = 1 THEN 'camera_rgb' END, CASE WHEN uav_sensors_camera_thermal = 1 THEN 'camera_thermal' END, CASE WHEN uav_sensors_gnss = 1 THEN 'gnss' END, CASE WHEN uav_sensors_lidar = 1 THEN 'lidar' END, CASE WHEN uav_sensors_radar = 1 THEN 'radar' END) AS sensors FROM profiles")
def profile_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.profile_context(B.profiles(spark, sf_dir))


@query(f"WITH {BUNDLES_SQL} SELECT mission_id, min(k) AS at_place FROM bundles GROUP BY mission_id, support_status")
def dedupe_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bundles(spark, sf_dir).select("mission_id", F.col("k").alias("at_place"), F.concat(F.lit(" Review  "), F.when(F.col("k") % 2 == 0, F.upper("support_status")).otherwise(F.col("support_status"))).alias("summary"))
    return K.dedupe_actions(rows).select("mission_id", "at_place")


UPSERT_SQL = f"""WITH {B.PROFILES_SQL}, k AS (SELECT *, CAST(substr(profile_id, 9) AS BIGINT) AS n FROM profiles), made AS (SELECT * FROM k WHERE n % 30 = 0)
SELECT * EXCLUDE (n) REPLACE (CASE WHEN n % 4 = 2 THEN 'renamed' ELSE profile_name END AS profile_name, CASE WHEN n % 4 = 2 THEN uav_mass_kg * 2 ELSE uav_mass_kg END AS uav_mass_kg),
CASE n % 4 WHEN 0 THEN 'kept' WHEN 1 THEN 'refused' WHEN 2 THEN 'update' ELSE 'delete' END AS result, n % 4 < 3 AS stored FROM k
UNION ALL BY NAME SELECT * EXCLUDE (n) REPLACE (profile_id || '_new' AS profile_id, 'renamed' AS profile_name, uav_mass_kg * 2 AS uav_mass_kg), 'create' AS result, true AS stored FROM made
UNION ALL BY NAME SELECT user_id, profile_id || '_new' AS profile_id, 'refused' AS result, false AS stored FROM k WHERE n % 10 = 0 AND n % 3 > 0"""


@query(UPSERT_SQL)
def upsert_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = B.profiles(spark, sf_dir)
    n = F.substring("profile_id", 9, 20).cast("long")
    asked = held.withColumns({"profile_name": F.lit("renamed"), "uav_mass_kg": F.col("uav_mass_kg") * 2})
    known = asked.where(n % 4 > 0).withColumn("op", F.when(n % 4 == 1, "create").when(n % 4 == 2, "update").otherwise("delete"))
    new = asked.where(n % 10 == 0).withColumns({"op": F.when(n % 3 == 0, "create").otherwise("update"), "profile_id": F.concat("profile_id", F.lit("_new"))})
    return A.upsert_profiles(held, known.unionByName(new))


MEAN_SQL = "(a.mean * a.n + x.mean) / (a.n + 1)"
LEARNED_SQL = f"""WITH {HISTORY_SQL}, runs AS (SELECT scenario_type, list({{'n': 0, 'mean': CAST(top_score AS DOUBLE), 'share': CASE WHEN used_hyde THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 'k': 0}} ORDER BY timestamp, entry_id) AS each FROM history WHERE top_score IS NOT NULL GROUP BY 1),
ends AS (SELECT scenario_type, list_reduce(each, lambda a, x: {{'n': a.n + 1, 'mean': {MEAN_SQL}, 'share': CASE WHEN x.share > 0 THEN (a.share * a.n + CASE WHEN x.mean > 0.5 THEN 1 ELSE 0 END) / (a.n + 1) ELSE a.share END,
'k': CASE WHEN round({MEAN_SQL}, 12) > 0.6 THEN greatest(20, a.k - 5) WHEN round({MEAN_SQL}, 12) < 0.3 THEN least(120, a.k + 10) ELSE a.k END}}, {{'n': 0, 'mean': 0.0::DOUBLE, 'share': 0.0::DOUBLE, 'k': 60}}) AS e FROM runs)
SELECT scenario_type, CAST(e.n AS BIGINT) AS query_count, round(e.mean + 1e-12, 6) AS avg_top_score, round(e.share + 1e-12, 6) AS hyde_success_rate, CAST(e.k AS INT) AS optimal_k FROM ends"""


@query(LEARNED_SQL)
def learn_scenario_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = L.learn_scenario_profiles(history(spark, sf_dir))
    return held.select("scenario_type", "query_count", *(F.round(F.col(c) + 1e-12, 6).alias(c) for c in ("avg_top_score", "hyde_success_rate")), "optimal_k")


START_SQL = "0.35 + 0.02 * 3598 / 1000"
THRESHOLDS_SQL = f"""WITH RECURSIVE {HISTORY_SQL}, placed AS (SELECT entry_id, row_number() OVER w AS place, count(*) OVER (w ROWS 99 PRECEDING) AS held, round(avg(CAST(top_score AS DOUBLE)) OVER (w ROWS 99 PRECEDING), 12) AS mean FROM history WHERE top_score IS NOT NULL WINDOW w AS (ORDER BY timestamp, entry_id)),
drops AS (SELECT 0::BIGINT AS place, CAST({START_SQL} AS DOUBLE) AS least UNION ALL
SELECT min(p.place), greatest(0.25, arg_min(p.mean, p.place) - 0.05) FROM drops d JOIN placed p ON p.place > d.place AND p.held >= 20 AND p.mean < d.least WHERE d.least > 0.25 HAVING count(*) > 0)
SELECT entry_id, round(min(least) + 1e-12, 6) AS minimum, round({START_SQL} + 0.10, 6) AS hyde_trigger, round({START_SQL} + 0.15, 6) AS rerank_cutoff FROM placed p JOIN drops d ON d.place <= p.place GROUP BY entry_id"""


@query(THRESHOLDS_SQL)
def adaptive_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = L.adaptive_thresholds(history(spark, sf_dir), 3598)
    return held.select("entry_id", F.round(F.col("minimum") + 1e-12, 6).alias("minimum"), *(F.round(c, 6).alias(c) for c in ("hyde_trigger", "rerank_cutoff")))
