"""Hybrid search as one call, from queries to ranked chunks, over an index that is built once.

Only what a step needs travels: rankings carry ids and scores, near duplicates are told by stored fingerprints, and texts
are joined to the candidates that are left. All that follows the fusion is keyed by query_id and bounded by its pool.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightloom.functions.fingerprints import dedupe_near_duplicates, fingerprint_rows
from flightloom.operators import corpus as E
from flightloom.operators import retrieval as R

#: Candidates that each side brings, and of the fused ones that are looked at, as multiples of k.
SIDE, POOL = 3, 6
CHUNK = ["chunk_id", "source_id", "source_filename", "source_title", "page", "text"]


class SearchIndex(NamedTuple):
    """chunks: CHUNK and fingerprint (null for a blank text; without that column, fingerprints are made of a search's candidates alone); postings, stats and docs as build_postings, term_stats and doc_stats make them; vectors: (chunk_id, embedding) of length 1, or None."""

    chunks: DataFrame
    postings: DataFrame
    stats: DataFrame
    docs: DataFrame
    vectors: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k, v in self._asdict().items() if v is not None}


def build_index(chunks: DataFrame, vectors: DataFrame | None = None, terms: DataFrame | None = None, texts: DataFrame | None = None) -> SearchIndex:
    """Tables of an index over chunks (CHUNK); publish_index stores them.

    With ``terms``, postings of these terms only and no fingerprints, for searches that ask for no others. ``texts`` are the
    chunks' chunk_id and text, read for tokens where making whole chunks takes more.
    """
    texts = chunks if texts is None else texts
    postings = E.build_postings(E.tokenize(texts), terms, terms is not None)
    marked = chunks.select(CHUNK)
    if terms is None:
        marked = marked.join(fingerprint_rows(chunks.where(F.trim("text") != ""), "chunk_id", "text"), "chunk_id", "left")
    return SearchIndex(marked, postings, E.term_stats(postings, texts.count()), E.doc_lengths(texts), None if vectors is None else E.normalize_vectors(vectors))


def candidate_pool(asked: DataFrame, index: SearchIndex, k: int = 10, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """query_id, chunk_id, fingerprint and the scores of both sides and of their fusion: 3k chunks a side, the first 6k of both, no blank text and no near duplicate of a better one."""
    sparse = R.bm25_topk(asked.select("query_id", "query"), index.postings, index.stats, index.docs, SIDE * k)
    has_vectors = index.vectors is not None and "embedding" in asked.columns
    dense = R.dense_topk(asked.select("query_id", "embedding"), index.vectors, SIDE * k) if has_vectors else sparse.limit(0).select("query_id", "chunk_id", "rank", F.lit(0.0).alias("dense_score"))
    ks = asked.select("query_id", F.coalesce("rrf_k", F.lit(60)).alias("rrf_k")) if "rrf_k" in asked.columns else None
    fused = R.rrf_fuse(dense, sparse, 60, weights, ks)
    order = Window.partitionBy("query_id").orderBy(F.round("rrf_score", 12).desc(), "chunk_id")
    pool = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= POOL * k)
    if "fingerprint" in index.chunks.columns:
        prints = index.chunks.select("chunk_id", "fingerprint")
    else:
        prints = fingerprint_rows(index.chunks.select("chunk_id", "text").join(pool.select("chunk_id").distinct(), "chunk_id", "left_semi").where(F.trim("text") != ""), "chunk_id", "text")
    marked = pool.join(prints, "chunk_id").where("fingerprint is not null")
    return dedupe_near_duplicates(marked).drop("rank")


def hybrid_search(
    queries: DataFrame,
    index: SearchIndex,
    k: int = 10,
    reranker: Callable[[str, str], Column] | None = None,
    rules: list[tuple[str, list[str], list[str]]] = R.INTENT_RULES,
    domain: list[str] = R.DOMAIN_WORDS,
    weights: tuple[float, float] = (0.6, 0.4),
) -> DataFrame:
    """query_id, rank, CHUNK, fingerprint and all scores of each query's k best chunks.

    ``queries`` has query_id and query; ``embedding`` (without it, or in an index without vectors, words alone decide),
    and ``rrf_k`` (60 where null or absent; see adaptive_rrf_k). A query outside of the domain isn't searched and has no
    row. Each side brings 3k chunks; of the fused ranking the first 6k are looked at, without blank texts and without those
    whose fingerprint is within three bits of a better one's. ``reranker``, a pandas UDF of two columns (query, text), then
    scores these candidates and no others; where it gives null the score stays. Gates and diversity choose k.
    """
    intents = R.detect_intent(queries, rules, domain)
    asked = queries.join(intents.where("domain_match").select("query_id"), "query_id")
    held = candidate_pool(asked, index, k, weights).join(index.chunks.drop("fingerprint"), "chunk_id")
    scored = R.blend_scores(R.source_match(held, intents))
    if reranker is not None:
        texts = asked.select("query_id", "query")
        scored = R.apply_rerank(scored.join(texts, "query_id").withColumn("rerank_score", reranker("query", "text")).drop("query"))
    return R.diversify(R.gate_candidates(scored), k)
