"""Queries of corpus preparation, the sparse index, retrieval and planning. A document is one chunk here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightloom import bindings as B
from flightloom.operators import corpus as E
from flightloom.operators import planning as G
from flightloom.operators import retrieval as R
from flightloom.operators import search as W
from flightloom.operators.ordering import place_in_group
from flightloom.plans.registry import query


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.read(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "source", "text")
    held = place_in_group(rows, "source", F.floor(F.col("doc_id") / 65_536), ["doc_id"]).withColumnRenamed("place", "page")
    name = F.concat("source", F.lit(".pdf"))
    return held.select(F.col("doc_id").alias("chunk_id"), "page", name.alias("source_filename"), F.col("source").alias("source_title"), E.normalize_source_id(name).alias("source_id"), F.lit(0).alias("at_place"), F.coalesce("text", F.lit("")).alias("text"))


SOURCE_ID = "source || '_pdf_' || substr(sha256(source || '.pdf'), 1, 8)".replace("_pdf_", "_")
PAGES_SQL = f"pages_of AS (SELECT doc_id AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, source || '.pdf' AS source_filename, source AS source_title, {SOURCE_ID} AS source_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL)"
TOKENS_SQL = "tokens AS (SELECT doc_id AS chunk_id, t.term FROM documents, LATERAL (SELECT unnest(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+')) AS term) t WHERE length(t.term) > 2)"
POSTINGS_SQL = "postings AS (SELECT term, chunk_id, count(*) AS tf FROM tokens GROUP BY 1, 2), docs AS (SELECT d.doc_id AS chunk_id, count(t.term) AS dl FROM documents d LEFT JOIN tokens t ON t.chunk_id = d.doc_id GROUP BY 1), stats AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1.0) AS idf FROM postings GROUP BY 1)"
INDEX_SQL = f"{TOKENS_SQL}, {POSTINGS_SQL}"
QUERY_TEXT = "text"
BM25_SQL = f"""{INDEX_SQL}, terms AS (SELECT item_id AS query_id, t.term, count(*) AS times FROM benchmark, LATERAL (SELECT unnest(string_split_regex(lower({QUERY_TEXT}), '\\s+')) AS term) t WHERE t.term <> '' GROUP BY 1, 2),
scored AS (SELECT query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM docs)))) AS score FROM terms JOIN stats USING (term) JOIN postings USING (term) JOIN docs USING (chunk_id) GROUP BY 1, 2),
sparse AS (SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, score / max(score) OVER (PARTITION BY query_id) AS sparse_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored) WHERE rank <= 30)"""
UNIT_SQL = "vecs AS (SELECT vec_id AS chunk_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings)"
DENSE_SQL = f"{UNIT_SQL}, sims AS (SELECT q.item_id AS query_id, a.chunk_id, greatest(0, least(1, list_inner_product(a.v, b.v))) AS s FROM benchmark q JOIN vecs b ON b.chunk_id = q.item_id CROSS JOIN vecs a), dense AS (SELECT query_id, chunk_id, CAST(rank AS INT) AS rank, s AS dense_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS rank FROM sims) WHERE rank <= 30)"
FUSED_SQL = f"WITH {BM25_SQL}, {DENSE_SQL}, fused AS (SELECT query_id, chunk_id, sum(w) AS rrf_score, max(dense_score) AS dense_score, max(sparse_score) AS sparse_score FROM (SELECT query_id, chunk_id, 0.6 / (60 + rank) AS w, dense_score, 0.0 AS sparse_score FROM dense UNION ALL SELECT query_id, chunk_id, 0.4 / (60 + rank), 0.0, sparse_score FROM sparse) GROUP BY 1, 2)"


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))


def index(spark: SparkSession, sf_dir: str, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, their statistics and those of chunks; of the given terms only, where a search needs no others."""
    chunks = chunk_texts(spark, sf_dir)
    postings = E.build_postings(E.tokenize(chunks), terms, terms is not None)
    return postings, E.term_stats(postings, chunks.count()), E.doc_lengths(chunks)


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.normalize_vectors(B.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"))


@query(f"WITH {PAGES_SQL} SELECT DISTINCT source_filename, source_id FROM pages_of")
def normalize_source_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("source_filename", "source_id").distinct()


@query("SELECT doc_id, sha256(regexp_replace(regexp_replace(coalesce(text, ''), '[ \\t]+(\\n|$)', '\\1', 'g'), '^\\s+|\\s+$', '', 'g')) AS text_hash FROM documents")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "documents").select("doc_id", F.sha2(E.normalize_text(F.coalesce("text", F.lit(""))), 256).alias("text_hash"))


@query(f"WITH {PAGES_SQL}, keyed AS (SELECT *, sha256(text) AS text_sha256 FROM pages_of) SELECT chunk_id AS doc_id, text_sha256, substr(sha256(source_id || '|' || page || '|' || page || '|0|' || text_sha256), 1, 24) AS key, CAST(length(text) AS INT) AS char_count, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS INT) AS token_count FROM keyed")
def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = pages(spark, sf_dir).withColumnRenamed("chunk_id", "doc_id")
    return E.chunk_keys(held).select("doc_id", "text_sha256", F.col("chunk_id").alias("key"), "char_count", "token_count")


@query(f"WITH {PAGES_SQL} SELECT chunk_id, row_number() OVER (ORDER BY source_filename, page) - 1 AS vector_id FROM pages_of")
def assign_vector_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.assign_vector_ids(pages(spark, sf_dir).select("chunk_id", "source_filename", "page"), "source_filename", "page").select("chunk_id", F.col("vector_id").cast("long"))


@query(f"WITH {PAGES_SQL} SELECT source_id, sum(CASE WHEN length(text) > 400 AND source_title <> 'src3' THEN 1 ELSE 0 END)::BIGINT AS chunk_count FROM pages_of GROUP BY 1")
def source_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = pages(spark, sf_dir)
    return E.source_chunk_counts(held.where("length(text) > 400 and source_title <> 'src3'"), held)


@query(f"WITH {TOKENS_SQL} SELECT d.doc_id AS chunk_id, count(t.term) AS n_tokens, coalesce(sum(length(t.term)), 0)::BIGINT AS token_chars FROM documents d LEFT JOIN tokens t ON t.chunk_id = d.doc_id GROUP BY 1")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = E.tokenize(B.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text")))
    return held.select("chunk_id", F.size("tokens").cast("long").alias("n_tokens"), F.aggregate("tokens", F.lit(0).cast("long"), lambda s, t: s + F.length(t)).alias("token_chars"))


@query(f"WITH {INDEX_SQL} SELECT * FROM postings")
def build_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir)[0]


@query(f"WITH {INDEX_SQL} SELECT * FROM stats")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir)[1]


@query(f"WITH {INDEX_SQL} SELECT chunk_id, CAST(dl AS INT) AS dl FROM docs")
def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir)[2]


@query(f"WITH {UNIT_SQL} SELECT chunk_id, round(v[1], 9) AS first, round(list_sum(v), 9) AS total FROM vecs")
def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_vectors(spark, sf_dir).select("chunk_id", F.round(F.get("embedding", F.lit(0)), 9).alias("first"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 9).alias("total"))


@query(f"WITH {PAGES_SQL} SELECT count(*) AS total_chunks, count(DISTINCT source_id) AS total_sources, sum(length(text))::BIGINT AS total_chars, (SELECT CAST(max(len(embedding)) AS INT) FROM embeddings) AS dimension FROM pages_of")
def index_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.index_manifest(pages(spark, sf_dir).withColumn("char_count", F.length("text")), B.read(spark, sf_dir, "embeddings"))


@query(f"WITH {PAGES_SQL} SELECT DISTINCT code FROM (SELECT 'bad_page' AS code FROM pages_of WHERE page - 2 < 1 UNION ALL SELECT 'bad_page_range' FROM pages_of WHERE page - 1 < page - 2 UNION ALL SELECT 'count_mismatch' UNION ALL SELECT 'blank_text' FROM pages_of WHERE trim(text) = '')")
def chunk_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = pages(spark, sf_dir)
    rows = E.assign_vector_ids(held, "source_filename", "page").select("*", F.sha2("text", 256).alias("text_sha256"), (F.col("page") - 2).alias("page_start"), (F.col("page") - 1).alias("page_end"))
    return E.chunk_integrity(rows, -1)


@query(f"WITH {PAGES_SQL} SELECT count(DISTINCT source_id) AS expected, count(DISTINCT CASE WHEN source_title <> 'src3' THEN source_id END) AS indexed, min(CASE WHEN source_title = 'src3' THEN source_id END) AS missing, 'partial' AS status FROM pages_of")
def corpus_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = pages(spark, sf_dir)
    return E.corpus_coverage(held, held.where("source_title <> 'src3'"))


TEST_RULES = [("first", ["the"], ["src1", "src2"]), ("second", ["de "], ["src3"]), ("third", ["und"], ["src4", "src5", "src6"])]
INTENT_SQL = f"intents AS (SELECT item_id AS query_id, CASE WHEN contains(lower({QUERY_TEXT}), 'the') THEN 'first' WHEN contains(lower({QUERY_TEXT}), 'de ') THEN 'second' WHEN contains(lower({QUERY_TEXT}), 'und') THEN 'third' WHEN contains(lower({QUERY_TEXT}), 'que') THEN 'general_uav' ELSE 'unsupported_domain' END AS intent FROM benchmark)"


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.detect_intent(search_queries(spark, sf_dir), TEST_RULES, ["que"])


@query(f"WITH {INTENT_SQL} SELECT query_id, intent, CAST(CASE intent WHEN 'general_uav' THEN 0.6 WHEN 'unsupported_domain' THEN 0.1 ELSE 0.9 END AS DOUBLE) AS confidence FROM intents")
def detect_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intents(spark, sf_dir).select("query_id", "intent", "confidence")


@query(f"WITH {BM25_SQL} SELECT query_id, chunk_id, rank, round(sparse_score, 9) AS sparse_score FROM sparse")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bm25_topk(search_queries(spark, sf_dir), *index(spark, sf_dir, R.query_terms(search_queries(spark, sf_dir)))).withColumn("sparse_score", F.round("sparse_score", 9))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_vectors(spark, sf_dir).join(B.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id")), "chunk_id").withColumnRenamed("chunk_id", "query_id")


@query(f"WITH {DENSE_SQL} SELECT query_id, chunk_id, rank, round(dense_score, 9) AS dense_score FROM dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense_topk(query_vectors(spark, sf_dir), unit_vectors(spark, sf_dir)).withColumn("dense_score", F.round("dense_score", 9))


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rrf_fuse(R.dense_topk(query_vectors(spark, sf_dir), unit_vectors(spark, sf_dir)), R.bm25_texts(search_queries(spark, sf_dir), chunk_texts(spark, sf_dir)))


@query(f"{FUSED_SQL} SELECT query_id, chunk_id, round(rrf_score, 12) AS rrf_score, round(dense_score, 9) AS dense_score, round(sparse_score, 9) AS sparse_score FROM fused")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("query_id", "chunk_id", F.round("rrf_score", 12).alias("rrf_score"), F.round("dense_score", 9).alias("dense_score"), F.round("sparse_score", 9).alias("sparse_score"))


@query("SELECT event_id, CAST(greatest(20, least(120, CASE WHEN event_id % 3 = 0 THEN s ELSE floor(0.7 * s + 0.3 * (20 + event_id % 101) + 1e-9) END)) AS INT) AS rrf_k FROM (SELECT event_id, CASE WHEN user_id * 37 < 1000 THEN 40 WHEN user_id * 37 < 10000 THEN 60 WHEN user_id * 37 < 100000 THEN 80 ELSE 100 END AS s FROM events)")
def adaptive_rrf_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.read(spark, sf_dir, "events").select("event_id", (F.col("user_id") * 37).alias("corpus_size"), F.when(F.col("event_id") % 3 != 0, 20 + F.col("event_id") % 101).alias("optimal_k"))
    return R.adaptive_rrf_k(rows).select("event_id", "rrf_k")


MATCH_SQL = "CASE intent WHEN 'first' THEN (CASE WHEN contains(names, 'src1') THEN 1 ELSE 0 END + CASE WHEN contains(names, 'src2') THEN 1 ELSE 0 END) / 2.0 WHEN 'second' THEN CASE WHEN contains(names, 'src3') THEN 1.0 ELSE 0 END WHEN 'third' THEN (CASE WHEN contains(names, 'src4') THEN 1 ELSE 0 END + CASE WHEN contains(names, 'src5') THEN 1 ELSE 0 END + CASE WHEN contains(names, 'src6') THEN 1 ELSE 0 END) / 3.0 ELSE 0.0 END"
BLENDED_SQL = f"""{FUSED_SQL}, {PAGES_SQL}, {INTENT_SQL}, matched AS (SELECT *, CAST({MATCH_SQL} AS DOUBLE) AS source_match_score FROM (SELECT f.*, p.page, p.source_filename, p.source_id, p.text, lower(p.source_id || ' ' || p.source_filename || ' ' || p.source_title) AS names, i.intent, i.intent IN ('first', 'second', 'third') AS explicit, i.intent <> 'unsupported_domain' AS domain_match FROM fused f JOIN pages_of p USING (chunk_id) JOIN intents i USING (query_id))),
blended AS (SELECT *, 0.5 * rrf_score + 0.3 * dense_score + 0.2 * sparse_score + CASE WHEN explicit THEN 0.18 ELSE 0.05 END * source_match_score - CASE WHEN explicit AND source_match_score <= 0 THEN 0.08 ELSE 0 END AS final_score FROM matched),
gated AS (SELECT * FROM blended WHERE domain_match AND length(trim(text)) >= 40 AND final_score >= 0.08 AND (NOT explicit OR source_match_score > 0))"""


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.source_match(fused(spark, sf_dir).join(pages(spark, sf_dir).drop("text"), "chunk_id"), intents(spark, sf_dir))


def matched_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the candidates' texts; the fusion has at most 30 chunks a side and query."""
    texts = B.read(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("source_title"), F.coalesce("text", F.lit("")).alias("text"))
    held = R.with_texts(fused(spark, sf_dir), pages(spark, sf_dir).drop("text"), texts, 60 * search_queries(spark, sf_dir).count())
    return R.source_match(held, intents(spark, sf_dir))


@query(f"{BLENDED_SQL} SELECT query_id, chunk_id, source_match_score FROM matched")
def source_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched(spark, sf_dir).select("query_id", "chunk_id", "source_match_score")


@query(f"{BLENDED_SQL} SELECT query_id, chunk_id, round(final_score, 9) AS final_score FROM blended")
def blend_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.blend_scores(matched(spark, sf_dir)).select("query_id", "chunk_id", F.round("final_score", 9).alias("final_score"))


@query(f"{BLENDED_SQL} SELECT query_id, chunk_id, round(CASE WHEN chunk_id % 2 = 0 THEN 0.45 * final_score + 0.35 * (chunk_id % 10) / 10.0 + 0.2 * rrf_score ELSE final_score END, 9) AS final_score FROM blended")
def apply_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = R.blend_scores(matched(spark, sf_dir)).withColumn("rerank_score", F.when(F.col("chunk_id") % 2 == 0, (F.col("chunk_id") % 10) / 10))
    return R.apply_rerank(held).select("query_id", "chunk_id", F.round("final_score", 9).alias("final_score"))


@query(f"{BLENDED_SQL} SELECT query_id, chunk_id FROM gated")
def gate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.gate_candidates(R.blend_scores(matched_texts(spark, sf_dir))).select("query_id", "chunk_id")


SEARCH_SQL = f"{BLENDED_SQL}, one_page AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_filename, page ORDER BY round(final_score, 9) DESC, chunk_id) AS a FROM gated) WHERE a = 1), found AS (SELECT query_id, chunk_id, source_id, final_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, chunk_id) AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY round(final_score, 9) DESC, chunk_id) AS b FROM one_page) WHERE b <= CASE WHEN explicit THEN 3 ELSE 2 END)"


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.diversify(R.gate_candidates(R.blend_scores(matched_texts(spark, sf_dir))), 10)


PRINTS_SQL = """words_of AS (SELECT chunk_id, CAST('0x' || substr(md5(t.term), 1, 16) AS UBIGINT) AS h FROM pages_of, LATERAL (SELECT unnest(string_split_regex(lower(text), '\\s+')) AS term) t WHERE t.term <> ''),
prints AS (SELECT chunk_id, sum(CASE WHEN 2 * ones > n THEN CAST(1 AS UBIGINT) << b ELSE 0 END)::UBIGINT AS fingerprint FROM (SELECT chunk_id, b, sum((h >> b) & 1) AS ones, count(*) AS n FROM words_of, range(64) AS r(b) GROUP BY 1, 2) GROUP BY 1)"""
#: The reciprocal's k of each query: a step by the corpus' size, blended with a learned k that two of three queries have.
RRF_K_SQL = "ks AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN s ELSE greatest(20, least(120, floor(0.7 * s + 0.3 * (20 + item_id % 101) + 1e-9))) END AS rrf_k FROM benchmark, (SELECT CASE WHEN count(*) < 1000 THEN 40 WHEN count(*) < 10000 THEN 60 WHEN count(*) < 100000 THEN 80 ELSE 100 END AS s FROM documents))"
FOUND_SQL = f"""WITH RECURSIVE {BM25_SQL}, {DENSE_SQL}, {PAGES_SQL}, {INTENT_SQL}, {PRINTS_SQL}, {RRF_K_SQL},
both_sides AS (SELECT query_id, chunk_id, 0.6 / (rrf_k + rank) AS w, dense_score, CAST(0 AS DOUBLE) AS sparse_score FROM dense JOIN ks USING (query_id) UNION ALL SELECT query_id, chunk_id, 0.4 / (rrf_k + rank), CAST(0 AS DOUBLE), sparse_score FROM sparse JOIN ks USING (query_id)),
one_list AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, chunk_id) AS n FROM (SELECT query_id, chunk_id, sum(w) AS rrf_score, max(dense_score) AS dense_score, max(sparse_score) AS sparse_score FROM both_sides GROUP BY 1, 2)),
pool AS (SELECT l.*, fingerprint, intent, row_number() OVER (PARTITION BY l.query_id ORDER BY n) AS nth FROM one_list l JOIN prints USING (chunk_id) JOIN intents USING (query_id) WHERE n <= 60 AND intent <> 'unsupported_domain'),
walk AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS nth, CAST([] AS UBIGINT[]) AS kept, true AS fresh, CAST(NULL AS BIGINT) AS chunk_id FROM pool
 UNION ALL SELECT p.query_id, p.nth, CASE WHEN len(list_filter(kept, lambda f: bit_count(xor(f, p.fingerprint)) <= 3)) = 0 THEN list_append(kept, p.fingerprint) ELSE kept END, len(list_filter(kept, lambda f: bit_count(xor(f, p.fingerprint)) <= 3)) = 0, p.chunk_id FROM walk w JOIN pool p ON p.query_id = w.query_id AND p.nth = w.nth + 1),
named AS (SELECT p.*, g.page, g.source_filename, g.source_id, g.text, lower(g.source_id || ' ' || g.source_filename || ' ' || g.source_title) AS names, intent IN ('first', 'second', 'third') AS explicit FROM pool p JOIN walk w ON w.query_id = p.query_id AND w.nth = p.nth AND w.fresh JOIN pages_of g ON g.chunk_id = p.chunk_id),
judged AS (SELECT *, 0.5 * rrf_score + 0.3 * dense_score + 0.2 * sparse_score + CASE WHEN explicit THEN 0.18 ELSE 0.05 END * m - CASE WHEN explicit AND m <= 0 THEN 0.08 ELSE 0 END AS final_score FROM (SELECT *, CAST({MATCH_SQL} AS DOUBLE) AS m FROM named)),
fit AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_filename, page ORDER BY round(final_score, 9) DESC, chunk_id) AS of_page FROM judged WHERE length(trim(text)) >= 40 AND final_score >= 0.08 AND (NOT explicit OR m > 0)),
spread AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_id ORDER BY round(final_score, 9) DESC, chunk_id) AS of_source FROM fit WHERE of_page = 1),
chosen AS (SELECT query_id, chunk_id, final_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(final_score, 9) DESC, chunk_id) AS INT) AS rank FROM spread WHERE of_source <= CASE WHEN explicit THEN 3 ELSE 2 END)"""


def asked_and_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, W.SearchIndex]:
    """Benchmark texts, each with its vector and its own k of the fusion, and an index over the documents."""
    texts = search_queries(spark, sf_dir)
    rows = texts.join(query_vectors(spark, sf_dir), "query_id", "left").withColumn("corpus_size", F.lit(B.read(spark, sf_dir, "documents").count()))
    queries = R.adaptive_rrf_k(rows.withColumn("optimal_k", F.when(F.col("query_id") % 3 != 0, 20 + F.col("query_id") % 101)))
    rows = B.read(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("chunk_id"), F.coalesce("text", F.lit("")).alias("text"))
    return queries, W.build_index(pages(spark, sf_dir), B.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), R.query_terms(texts), rows)


def fresh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, tables = asked_and_index(spark, sf_dir)
    return W.candidate_pool(queries.join(intents(spark, sf_dir).where("domain_match").select("query_id"), "query_id"), tables)


@query(f"{FOUND_SQL} SELECT query_id, rank, chunk_id, round(final_score, 9) AS final_score FROM chosen WHERE rank <= 10")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, tables = asked_and_index(spark, sf_dir)
    return W.hybrid_search(queries, tables, 10, None, TEST_RULES, ["que"]).select("query_id", "rank", "chunk_id", F.round("final_score", 9).alias("final_score"))


@query(f"{SEARCH_SQL} SELECT query_id, source_id, count(*) AS n FROM found WHERE rank <= 10 GROUP BY 1, 2")
def diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).groupBy("query_id", "source_id").agg(F.count("*").alias("n"))


MERGED_SQL = f"{SEARCH_SQL}, best AS (SELECT query_id % 7 AS search_id, chunk_id, max(final_score) AS final_score, chunk_id % 50 AS fingerprint FROM found WHERE rank <= 10 GROUP BY 1, 2), merged AS (SELECT search_id, chunk_id, final_score, CAST(row_number() OVER (PARTITION BY search_id ORDER BY round(final_score, 9) DESC, chunk_id) AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY search_id, fingerprint ORDER BY round(final_score, 9) DESC, chunk_id) AS n FROM best) WHERE n = 1)"


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = found(spark, sf_dir).select((F.col("query_id") % 7).alias("search_id"), "chunk_id", "final_score", (F.col("chunk_id") % 50).alias("fingerprint"))
    return R.merge_query_results(rows)


@query(f"{MERGED_SQL} SELECT search_id, rank, chunk_id, round(final_score, 9) AS final_score FROM merged WHERE rank <= 20")
def merge_query_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).withColumn("final_score", F.round("final_score", 9))


@query(f"{MERGED_SQL} SELECT search_id, round(greatest(0, least(1, 0.6 * avg(CASE WHEN rank <= 5 THEN final_score END) + 0.3 * least(1.0, count(*) / 10.0) - 0.1 * search_id / 10)), 9) AS confidence, count(*) AS n, round(avg(final_score), 9) AS avg_score, round(max(final_score), 9) AS top_score FROM merged WHERE rank <= 20 GROUP BY search_id")
def retrieval_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merged(spark, sf_dir)
    out = R.retrieval_confidence(rows, rows.select("search_id").distinct().withColumn("complexity", F.col("search_id") / 10))
    return out.select("search_id", "n", *(F.round(c, 9).alias(c) for c in ("confidence", "avg_score", "top_score")))


# Planning: orders as scenarios of the planner's own vocabulary.
PLAN = {
    "wind_speed_kt": "CAST(o_orderkey % 45 AS DOUBLE)",
    "flight_altitude_m": "CAST(o_orderkey % 600 AS DOUBLE)",
    "temperature_c": "CAST(o_custkey % 90 - 30 AS DOUBLE)",
    "obstacle_proximity_m": "CAST(o_custkey % 60 AS DOUBLE)",
    "battery_capacity_mah": "CAST(o_orderkey % 100 AS DOUBLE)",
    "population_density": "CAST((o_custkey * 7) % 12000 AS DOUBLE)",
}
PLAN_SQL = f"plan AS (SELECT o_orderkey AS mission_id, {', '.join(f'{v} AS {k}' for k, v in PLAN.items())} FROM orders)"
LEVEL_SQL = lambda f: (lambda w, c, e, lw, lc: f"CASE WHEN {f} >= {e} THEN 'emergency' WHEN {f} >= {c} THEN 'critical' WHEN {f} >= {w} THEN 'warning'" + (f" WHEN {f} <= {lc} THEN 'critical' WHEN {f} <= {lw} THEN 'warning'" if lc is not None else "") + " ELSE 'low' END")(*G.THRESHOLDS[f])
LEVELS_SQL = f"{PLAN_SQL}, levels AS ({' UNION ALL '.join(f'SELECT mission_id, {chr(39)}{f}{chr(39)} AS feature, {f} AS value, {LEVEL_SQL(f)} AS risk_level FROM plan' for f in PLAN)})"


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "orders").selectExpr("o_orderkey AS mission_id", *(f"{v} AS {k}" for k, v in PLAN.items()))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = plan(spark, sf_dir).unpivot("mission_id", list(PLAN), "feature", "value")
    return G.feature_risk_levels(long, G.threshold_rows(spark))


@query(f"WITH {LEVELS_SQL} SELECT * FROM levels")
def feature_risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels(spark, sf_dir)


PHRASES = {"wind_speed_kt": "wind speed knots UAV drone operation limit gust tolerance", "flight_altitude_m": "altitude flight operation UAV drone maximum ceiling AGL MSL"}
ASKED_SQL = f"""{LEVELS_SQL}, asked AS (SELECT mission_id, feature, CASE feature {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in PHRASES.items())} ELSE replace(feature, '_', ' ') END || ' ' || CASE risk_level {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in G.SUFFIX.items())} END AS query_text,
 CAST(least(10, CASE risk_level {' '.join(f"WHEN '{k}' THEN {v}" for k, v in G.PRIORITY.items())} END + CASE WHEN feature IN ('flight_altitude_m', 'wind_speed_kt', 'obstacle_proximity_m', 'battery_capacity_mah') THEN 1 ELSE 0 END) AS INT) AS priority FROM levels),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY mission_id ORDER BY priority DESC, feature) AS INT) AS at_place FROM asked)"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.feature_queries(levels(spark, sf_dir), spark.createDataFrame(list(PHRASES.items()), "feature string, phrase string"))


@query(f"WITH {ASKED_SQL} SELECT * FROM placed")
def feature_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir)


@query(f"WITH {ASKED_SQL} SELECT mission_id, at_place, CAST(floor((at_place - 1) / 4) AS INT) AS batch FROM placed")
def query_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.query_batches(asked(spark, sf_dir), 4).select("mission_id", "at_place", "batch")


SCENE = {
    "emergency_procedure_available": "o_orderkey % 13 = 0",
    "flight_termination_system": "o_orderkey % 17 = 0",
    "e_stop_functional": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 19 = 0 END",
    "wind_speed_kt": "CAST(o_orderkey % 25 AS DOUBLE)",
    "precipitation_mm": "CAST(o_custkey % 7 AS DOUBLE)",
    "airspace_class": "CASE WHEN o_custkey % 6 = 0 THEN 'C' WHEN o_custkey % 6 = 1 THEN '' END",
    "operational_authorization": "CASE WHEN o_custkey % 11 = 0 THEN true WHEN o_custkey % 11 = 1 THEN false END",
    "geo_fence_status": "CASE WHEN o_custkey % 13 = 0 THEN 'active' END",
    "battery_capacity_mah": "CAST(o_orderkey % 100 AS DOUBLE)",
    "operation_type": "CASE o_orderkey % 4 WHEN 0 THEN 'Aerial Survey' WHEN 1 THEN 'delivery' WHEN 2 THEN 'Tower INSPECTION' END",
}
SCENE_SQL = f"scene AS (SELECT o_orderkey AS mission_id, {', '.join(f'{v} AS {k}' for k, v in SCENE.items())} FROM orders)"
KIND_SQL = f"{SCENE_SQL}, kinds AS (SELECT mission_id, CASE WHEN emergency_procedure_available OR flight_termination_system OR coalesce(e_stop_functional, false) THEN 'emergency_response' WHEN wind_speed_kt > 20 OR precipitation_mm > 5 THEN 'adverse_weather' WHEN airspace_class <> '' OR operational_authorization OR geo_fence_status <> '' THEN 'regulatory_compliance' WHEN battery_capacity_mah < 20 THEN 'technical_degradation' WHEN lower(operation_type) LIKE '%survey%' THEN 'survey_mission' WHEN lower(operation_type) LIKE '%delivery%' THEN 'delivery_mission' WHEN lower(operation_type) LIKE '%inspection%' THEN 'inspection_mission' ELSE 'general_operation' END AS scenario_type FROM scene)"


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.classify_scenarios(B.read(spark, sf_dir, "orders").selectExpr("o_orderkey AS mission_id", *(f"{v} AS {k}" for k, v in SCENE.items())))


@query(f"WITH {KIND_SQL} SELECT * FROM kinds")
def classify_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinds(spark, sf_dir)


COMPLEX_SQL = f"complexities AS (SELECT o_orderkey AS mission_id, least(1.0, least(0.3, (o_orderkey % 90) / 200.0) + 0.15 * (o_custkey % 4) + least(0.2, CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 5 ELSE 3 END / 100.0) + least(0.2, (o_orderkey % 10) / 40.0)) AS complexity, {B.NOTES} AS notes FROM orders)"


def complexities(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = B.read(spark, sf_dir, "orders").select(o.alias("mission_id"), (o % 90).alias("n_features"), (c % 4).alias("risk_flags"), F.expr(B.NOTES).alias("notes"), ((o % 10) / 40).alias("variance"))
    return G.scenario_complexity(rows).join(rows.select("mission_id", "notes"), "mission_id")


@query(f"WITH {COMPLEX_SQL} SELECT mission_id, round(CAST(complexity AS DOUBLE), 9) AS complexity FROM complexities")
def scenario_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexities(spark, sf_dir).select("mission_id", F.round("complexity", 9).alias("complexity"))


SWITCHES = {
    "communication_range_km": "CAST(mission_id % 4 AS DOUBLE)",
    "gps_quality": "CAST(mission_id % 11 AS DOUBLE)",
    "rc_link_quality": "CAST(mission_id % 101 AS DOUBLE)",
    "emergency_procedure_available": "mission_id % 3 = 0",
    "flight_termination_system": "CASE WHEN mission_id % 5 > 0 THEN mission_id % 2 = 0 END",
    "parachute_equipped": "true",
    "system_redundancy_level": "CAST(mission_id % 4 AS DOUBLE)",
}


@query(f"""WITH {PLAN_SQL}, switched AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in SWITCHES.items())} FROM plan)
SELECT mission_id, concat_ws(',', CASE WHEN wind_speed_kt <= 25 THEN 'wind_speed_kt' END, CASE WHEN flight_altitude_m <= 400 THEN 'flight_altitude_m' END, CASE WHEN obstacle_proximity_m <= 20 THEN 'obstacle_proximity_m' END, CASE WHEN battery_capacity_mah <= 10 THEN 'battery_capacity_mah' END,
 CASE WHEN communication_range_km <= 1 THEN 'communication_range_km' END, CASE WHEN gps_quality <= 5 THEN 'gps_quality' END, CASE WHEN rc_link_quality <= 50 THEN 'rc_link_quality' END, CASE WHEN NOT emergency_procedure_available THEN 'emergency_procedure_available' END,
 CASE WHEN NOT flight_termination_system THEN 'flight_termination_system' END, CASE WHEN NOT parachute_equipped THEN 'parachute_equipped' END, CASE WHEN system_redundancy_level = 0 THEN 'system_redundancy_level' END) AS priority_features FROM switched""")
def priority_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan(spark, sf_dir).selectExpr("*", *(f"{v} AS {k}" for k, v in SWITCHES.items()))
    return G.priority_features(rows).select("mission_id", F.array_join("priority_features", ",").alias("priority_features"))


@query(f"WITH {PLAN_SQL} SELECT mission_id, concat_ws('|', CASE WHEN wind_speed_kt > 20 THEN 'High wind: ' || CAST(wind_speed_kt AS VARCHAR) || ' kt' END, CASE WHEN flight_altitude_m > 400 THEN 'High altitude: ' || CAST(flight_altitude_m AS VARCHAR) || ' m' END, CASE WHEN obstacle_proximity_m < 30 THEN 'Close obstacle: ' || CAST(obstacle_proximity_m AS VARCHAR) || ' m' END, CASE WHEN battery_capacity_mah < 15 THEN 'Low battery: ' || CAST(battery_capacity_mah AS VARCHAR) || '%' END, CASE WHEN population_density > 1000 THEN 'Dense population: ' || CAST(population_density AS VARCHAR) || '/km²' END) AS indicators FROM plan")
def risk_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.risk_indicators(plan(spark, sf_dir)).select("mission_id", F.array_join("indicators", "|").alias("indicators"))


LEARNED = [("emergency_response", 9, 0.2), ("adverse_weather", 8, 0.7), ("survey_mission", 3, 0.9), ("general_operation", 20, 0.45)]


@query(f"WITH {KIND_SQL}, {COMPLEX_SQL}, learned AS (SELECT * FROM (VALUES {', '.join(map(str, LEARNED))}) t(scenario_type, query_count, rate)) SELECT mission_id, CASE WHEN query_count > 5 AND rate > 0.6 THEN true WHEN query_count > 5 AND rate < 0.3 THEN false ELSE (complexity > 0.5 AND notes IS NOT NULL) OR scenario_type = 'emergency_response' OR complexity > 0.4 + 1e-12 END AS use_hyde FROM kinds JOIN complexities USING (mission_id) LEFT JOIN learned USING (scenario_type)")
def hyde_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    learned = spark.createDataFrame(LEARNED, "scenario_type string, query_count int, hyde_success_rate double")
    held = kinds(spark, sf_dir).join(complexities(spark, sf_dir), "mission_id").withColumn("complexity", F.col("complexity") - 1e-12)
    return G.hyde_decision(held, learned)


HISTORY = {"entry_id": "event_id", "scenario_type": "event_type", "query": "props", "used_hyde": "event_id % 2 = 1", "top_score": "value / 500", "result_count": "event_id % 20", "timestamp": "ts"}
HISTORY_SQL = f"history AS (SELECT {', '.join(f'{v} AS {k}' for k, v in HISTORY.items())} FROM events)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "events").selectExpr(*(f"{v} AS {k}" for k, v in HISTORY.items()))


@query(f"WITH {HISTORY_SQL} SELECT scenario_type, count(*) AS query_count, round(avg(top_score) + 1e-12, 3) AS avg_top_score, round(avg(CASE WHEN used_hyde THEN 1.0 ELSE 0.0 END) + 1e-12, 3) AS hyde_success_rate FROM history GROUP BY 1")
def history_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.history_stats(history(spark, sf_dir))


@query(f"WITH {HISTORY_SQL} SELECT entry_id, scenario_type FROM history ORDER BY timestamp DESC, entry_id DESC LIMIT 1000")
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.recent_history(history(spark, sf_dir)).select("entry_id", "scenario_type")


@query(f"WITH {HISTORY_SQL} SELECT entry_id, scenario_type FROM history WHERE contains(lower(query), '7') AND scenario_type = (SELECT min(event_type) FROM events) ORDER BY timestamp DESC, entry_id DESC LIMIT 50")
def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = history(spark, sf_dir)
    return G.search_log(held, "7", held.agg(F.min("scenario_type")).first()[0]).select("entry_id", "scenario_type")
