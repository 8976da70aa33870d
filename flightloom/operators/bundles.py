"""Evidence bundles with their claims and citations as arrays of structs, made in one grouping and taken apart again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flightloom.operators import evidence as H

# Texts of claims and refusals, the use of a claim, origins of retrieval and states of evidence.
CLAIM = "Retrieved evidence is available for the query: "
NO_EVIDENCE = "No sufficient evidence candidates passed retrieval safety checks."
USE = "retrieval_context"
ORIGINS = ["scenario_driven", "agent_requested", "fallback"]
SUPPORTED, PARTLY, INSUFFICIENT, CONFLICTING = "supported", "partially_supported", "insufficient_evidence", "conflicting"

#: A citation's fields, with what a candidate without such a column has.
CITATION = {
    "citation_id": "string", "source_id": "string", "source_title": "string", "source_filename": "string", "origin": "string", "section": "string", "section_title": "string", "page": "int", "page_end": "int", "chunk_id": "string",
    "quote": "string", "retrieval_score": "double", "rerank_score": "double", "final_score": "double", "confidence_label": "string", "rank": "int", "retrieval_origin": "string", "support_status": "string", "synthetic": "boolean",
}
TEXTS = "array<string>"
CITATION_TYPE = "struct<" + ",".join(f"{k}:{v}" for k, v in CITATION.items()) + ">"
CLAIM_TYPE = f"struct<claim_id:string,claim:string,support_status:string,evidence_use:string,citations:array<{CITATION_TYPE}>,confidence:double,limitations:{TEXTS},conflicts:{TEXTS}>"


def column(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def within(score: Column) -> Column:
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def evidence_bundles(cands: DataFrame, queries: DataFrame, claims: int = 3, retrieval_origin: str = "scenario_driven") -> DataFrame:
    """One bundle a query: bundle_id, query_id, query, claims, citations, support_status, confidence, no_evidence_reason, retrieval_origin, evidence_status, synthetic, citation_count.

    Of the candidates that may be cited (see sufficient_candidates) the ``claims`` best each become a claim that holds its
    citation; the bundle's citations are those, each once. Confidence is a citation's retrieval score (else its final,
    dense or sparse one), and a bundle's is its claims' greatest. A query without any is insufficient, with a reason, and
    synthetic where only generated text was found. ``cands`` has the columns of search results and may have those of a
    citation; ``queries`` has query_id and query. Ranking and grouping share one shuffle by query_id.
    """
    origin = retrieval_origin.strip().lower().replace("-", "_")
    origin = origin if origin in ORIGINS else ORIGINS[0]
    score = lambda name: within(column(cands, name, "double"))
    final, dense, sparse = score("final_score"), score("dense_score"), score("sparse_score")
    some = lambda c: F.nullif(c, F.lit(0.0))
    sure = F.coalesce(score("retrieval_score"), some(final), some(dense), some(sparse), F.lit(0.0))
    blend = sum((F.coalesce(score(c), F.lit(0.0)) * w for c, w in H.BLEND.items()), F.lit(0.0))
    label = F.lit("VERY LOW")
    for least, name in reversed(H.LABELS):
        label = F.when(blend >= least, name).otherwise(label)
    made = F.lower(F.trim("origin"))
    own = {
        "citation_id": F.coalesce(column(cands, "citation_id", "string"), F.concat(F.lit("cit_"), F.trim(F.col("chunk_id").cast("string")))),
        "source_title": F.coalesce(column(cands, "source_title", "string"), F.col("source_filename")),
        "origin": F.when(made.isin(H.KEPT_ORIGINS), made).otherwise("retrieval_system"),
        "quote": F.trim("text"),
        "retrieval_score": sure,
        "rerank_score": score("rerank_score"),
        "confidence_label": label,
        "support_status": F.coalesce(column(cands, "support_status", "string"), F.lit("grounded")),
        "synthetic": F.coalesce(column(cands, "synthetic", "boolean"), F.lit(False)),
    }
    fit = H.is_sufficient(cands)
    lead = F.round(F.coalesce(final, score("retrieval_score"), dense, sparse, F.lit(0.0)), 9)
    rows = cands.select("query_id", fit.alias("_fit"), made.isin(H.GENERATED).alias("_made"), lead.alias("_lead"), own["citation_id"].alias("_cited"), *((own[k] if k in own else column(cands, k, v)).cast(v).alias(k) for k, v in CITATION.items() if k != "rank"))
    order = Window.partitionBy("query_id").orderBy(F.col("_fit").desc(), F.col("_lead").desc(), "_cited")
    ranked = rows.withColumn("rank", F.row_number().over(order))
    citation = F.when(F.col("_fit") & (F.col("rank") <= claims), F.struct("rank", F.struct(*CITATION).cast(CITATION_TYPE).alias("c")))
    held = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(citation)).alias("best"), F.bool_or(F.coalesce("_made", F.lit(False))).alias("made"))
    both = queries.select("query_id", F.trim("query").alias("query")).join(held, "query_id", "left")
    best = F.transform(F.coalesce("best", F.array().cast(held.schema["best"].dataType)), lambda x: x["c"])
    none = F.array().cast(TEXTS)
    both = both.withColumn("best", best)
    claim = lambda c, i: F.struct(F.concat(F.lit("claim_"), (i + 1).cast("string")), F.concat(F.lit(CLAIM), F.col("query")), F.lit(SUPPORTED), F.lit(USE), F.array(c), c["retrieval_score"], none, none).cast(CLAIM_TYPE)
    once = F.filter("best", lambda c, i: ~F.exists(F.slice("best", F.lit(1), i), lambda x: x["citation_id"] == c["citation_id"]))
    empty, generated = F.size("best") == 0, F.coalesce("made", F.lit(False))
    return both.select(
        F.concat(F.lit("bundle_"), F.substring(F.sha2("query", 256), 1, 16)).alias("bundle_id"),
        "query_id",
        "query",
        F.transform("best", claim).alias("claims"),
        once.alias("citations"),
        F.when(empty, INSUFFICIENT).otherwise(SUPPORTED).alias("support_status"),
        F.coalesce(F.array_max(F.transform("best", lambda c: c["retrieval_score"])), F.lit(0.0)).alias("confidence"),
        F.when(empty, NO_EVIDENCE).alias("no_evidence_reason"),
        F.lit(origin).alias("retrieval_origin"),
        F.when(~empty, "grounded").when(generated, "synthetic_only").otherwise("insufficient").alias("evidence_status"),
        (empty & generated).alias("synthetic"),
        F.size(once).alias("citation_count"),
    )


def bundle_claims(bundles: DataFrame) -> DataFrame:
    """One row a claim of a bundle."""
    each = bundles.select("query_id", "bundle_id", F.posexplode("claims").alias("at_place", "x"))
    return each.select("query_id", "bundle_id", "at_place", "x.*")


def bundle_citations(bundles: DataFrame) -> DataFrame:
    """One row a citation of a bundle; what it doesn't say itself comes from its place and from the bundle."""
    each = bundles.select("query_id", "bundle_id", F.posexplode("citations").alias("at_place", "c"), F.col("retrieval_origin").alias("_origin"), F.col("evidence_status").alias("_status"), F.col("synthetic").alias("_synthetic"))
    some = lambda c: F.when(F.trim(c) != "", c)
    return each.select(
        "query_id", "bundle_id", "c.citation_id", "c.source_filename", "c.source_title", F.col("c.page").alias("page_start"), "c.page_end", F.coalesce("c.section_title", "c.section").alias("section_title"), "c.quote", "c.retrieval_score", "c.confidence_label",
        F.coalesce("c.rank", F.col("at_place") + 1).alias("rank"), F.coalesce(some(F.col("c.retrieval_origin")), F.col("_origin")).alias("retrieval_origin"), F.coalesce(some(F.col("c.support_status")), F.col("_status")).alias("support_status"), F.coalesce("c.synthetic", "_synthetic", F.lit(False)).alias("synthetic"),
    )


def bundle_violations(bundles: DataFrame) -> DataFrame:
    """(query_id, bundle_id, place, code) of what contradicts itself: ``place`` is a claim_id or citation_id, or null for the bundle.

    A claim that is supported, even partly, has a citation; an insufficient one a limitation and a conflicting one a conflict
    that says something. A bundle that is insufficient has a reason. Ids, texts and quotes aren't blank, scores and
    confidence lie within 0 and 1, pages begin at 1, and generated text isn't cited.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    mute = lambda c: ~F.exists(F.coalesce(c, F.array().cast(TEXTS)), lambda x: F.trim(x) != "")
    outside = lambda c: F.coalesce((c < 0) | (c > 1), F.lit(False))
    codes = lambda rules: F.array_compact(F.array(*(F.when(c, code) for code, c in rules.items())))

    def of_claim(x: Column) -> Column:
        s = x["support_status"]
        return codes({
            "claim_without_citation": s.isin(SUPPORTED, PARTLY) & (F.coalesce(F.size(x["citations"]), F.lit(0)) <= 0),
            "insufficient_without_limitation": (s == INSUFFICIENT) & mute(x["limitations"]),
            "conflicting_without_conflict": (s == CONFLICTING) & mute(x["conflicts"]),
            "claim_blank": blank(x["claim_id"]) | blank(x["claim"]),
            "claim_confidence": outside(x["confidence"]) | x["confidence"].isNull(),
        })

    def of_citation(c: Column) -> Column:
        return codes({
            "citation_blank": blank(c["citation_id"]) | blank(c["source_id"]) | blank(c["source_title"]) | blank(c["quote"]),
            "citation_page": F.coalesce(c["page"] < 1, F.lit(False)),
            "citation_score": outside(c["retrieval_score"]) | outside(c["rerank_score"]),
            "citation_generated": F.lower(F.trim(F.coalesce(c["origin"], F.lit("")))).isin(H.GENERATED),
        })

    whole = codes({
        "insufficient_without_reason": (F.col("support_status") == INSUFFICIENT) & blank(F.col("no_evidence_reason")),
        "bundle_blank": blank(F.col("bundle_id")) | blank(F.col("query")),
        "bundle_confidence": outside(F.col("confidence")) | F.col("confidence").isNull(),
    })
    placed = lambda name, x, found: F.transform(found, lambda code: F.struct(x.alias("place"), code.alias("code")))
    each = F.concat(
        F.transform(whole, lambda code: F.struct(F.lit(None).cast("string").alias("place"), code.alias("code"))),
        F.flatten(F.transform("claims", lambda x: placed("claim", x["claim_id"], of_claim(x)))),
        F.flatten(F.transform("citations", lambda c: placed("citation", c["citation_id"], of_citation(c)))),
    )
    return bundles.select("query_id", "bundle_id", F.explode(each).alias("x")).select("query_id", "bundle_id", "x.place", "x.code")
