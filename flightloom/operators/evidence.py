"""From candidates to citations, bundles and their checks. Tables are long; bundles hold arrays only in the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Origins that are generated text, those a citation keeps, weights of the confidence blend, its labels.
GENERATED = ["llm_synthesis", "hyde_generated"]
KEPT_ORIGINS = ["local_document", "retrieval_system"]
BLEND = {"final_score": 0.6, "dense_score": 0.2, "sparse_score": 0.1, "source_match_score": 0.1}
LABELS = [(0.65, "HIGH"), (0.45, "MEDIUM"), (0.25, "LOW")]
#: Scores by which a candidate is judged and by which citations are ordered: the first that isn't null.
SCORES = ["final_score", "score", "retrieval_score"]
LEAD = ["final_score", "retrieval_score", "dense_score", "sparse_score"]


def blank(name: str):
    return F.trim(F.coalesce(F.col(name), F.lit(""))) == ""


def is_sufficient(cands: DataFrame) -> Column:
    """Whether a candidate may be cited: not generated, long enough, with its source and score, of the asked source, and on a page from 1 on if it names one. The score is the final one, else score, else retrieval_score."""
    real = ~F.lower(F.trim(F.coalesce("origin", F.lit("")))).isin(GENERATED)
    whole = ~blank("source_id") & ~blank("source_filename") & ~(F.trim(F.coalesce(F.col("chunk_id").cast("string"), F.lit(""))) == "") & (F.col("page").isNull() | (F.col("page") >= 1))
    score = F.coalesce(*(F.col(c) for c in SCORES if c in cands.columns))
    good = score.isNotNull() & (score >= 0.08) & (F.length(F.trim(F.coalesce("text", F.lit("")))) >= 40)
    return real & whole & good & ~(F.coalesce("explicit", F.lit(False)) & (F.coalesce("source_match_score", F.lit(0.0)) <= 0))


def sufficient_candidates(cands: DataFrame) -> DataFrame:
    """Candidates fit to be cited (see is_sufficient)."""
    return cands.where(is_sufficient(cands))


def build_citations(cands: DataFrame) -> DataFrame:
    """Citation ids, scores within [0, 1] (null where there is none), and one of two origins: what names neither comes from the retrieval system."""
    within = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))).alias(c)
    own = F.lower(F.trim("origin"))
    origin = F.when(own.isin(KEPT_ORIGINS), own).otherwise("retrieval_system").alias("origin")
    return cands.select("query_id", "chunk_id", F.concat(F.lit("cit_"), F.col("chunk_id").cast("string")).alias("citation_id"), "source_id", "page", *(within(c) for c in dict.fromkeys([*LEAD, *BLEND])), origin)


def rank_citations(cits: DataFrame) -> DataFrame:
    """Rank within a query by the first score that isn't null, and a label of the blended score."""
    lead = F.coalesce(*LEAD, F.lit(0.0))
    blend = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in BLEND.items()), F.lit(0.0))
    label = F.lit("VERY LOW")
    for least, name in reversed(LABELS):
        label = F.when(blend >= least, name).otherwise(label)
    return cits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(lead, 9).desc(), "citation_id"))).withColumn("label", label)


def build_bundles(ranked: DataFrame, queries: DataFrame, claims: int = 3) -> DataFrame:
    """One bundle a query: its first citations as claims, the best score as confidence; a query without any is insufficient, with a reason."""
    held = ranked.where(F.col("rank") <= claims).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "citation_id"))).alias("c"), F.max("final_score").alias("confidence"))
    out = queries.select("query_id").join(held, "query_id", "left")
    none = F.col("c").isNull()
    ids = F.coalesce(F.transform("c", lambda x: x["citation_id"]), F.array().cast("array<string>"))
    return out.select("query_id", F.when(none, "insufficient_evidence").otherwise("supported").alias("support_status"), ids.alias("citation_ids"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.when(none, "No sufficient evidence was found.").alias("no_evidence_reason"))


def evidence_contract_violations(bundles: DataFrame) -> DataFrame:
    """(query_id, code) of bundles that contradict themselves."""
    n = F.size("citation_ids")
    codes = F.array_compact(F.array(F.when((F.col("support_status") == "supported") & (n == 0), F.lit("supported_without_citation")), F.when((F.col("support_status") == "insufficient_evidence") & blank("no_evidence_reason"), F.lit("insufficient_without_reason"))))
    return bundles.select("query_id", F.explode(codes).alias("code"))


def flatten_citations(bundles: DataFrame) -> DataFrame:
    """One row a citation of a bundle, with the bundle's status."""
    return bundles.select("query_id", F.posexplode("citation_ids").alias("at_place", "citation_id"), "support_status")


def scenario_evidence_status(bundles: DataFrame, missions: DataFrame | None = None) -> DataFrame:
    """mission_id, evidence_status and grounded over the bundles that the scenario asked for.

    grounded: all supported. partial: all at least partially supported, or some insufficient beside others.
    insufficient: all insufficient; synthetic_only where any of them is synthetic. unknown: anything else. Missions (if
    given) without such a bundle are unavailable. ``retrieval_origin`` (scenario_driven where null) and ``synthetic``
    are read where the bundles have them.
    """
    held = bundles.where(F.coalesce("retrieval_origin", F.lit("scenario_driven")) == "scenario_driven") if "retrieval_origin" in bundles.columns else bundles
    made = F.col("synthetic") if "synthetic" in bundles.columns else F.lit(False)
    of = held.groupBy("mission_id").agg(F.collect_set("support_status").alias("s"), F.bool_or(F.coalesce(made, F.lit(False))).alias("made"))
    if missions is not None:
        of = missions.select("mission_id").join(of, "mission_id", "left")
    s, only = F.col("s"), lambda *names: F.size(F.array_except("s", F.array(*map(F.lit, names)))) == 0
    status = F.when(s.isNull() | (F.size(s) == 0), "unavailable").when(only("supported"), "grounded").when(only("supported", "partially_supported"), "partial")
    status = status.when(only("insufficient_evidence"), F.when(F.col("made"), "synthetic_only").otherwise("insufficient")).when(F.array_contains(s, "insufficient_evidence"), "partial").otherwise("unknown")
    grounded = F.when(F.col("evidence_status") == "grounded", True).when(F.col("evidence_status").isin("partial", "insufficient", "synthetic_only"), False)
    return of.select("mission_id", status.alias("evidence_status")).withColumn("grounded", grounded)


def retrieval_quality_cases(expected: DataFrame, cited: DataFrame) -> DataFrame:
    """Each labelled query (query_id, keywords, minimum, should_have, critical) with what was found for it in ``cited``.

    n: citations. matched: a keyword, in any case, is in a source's id or title, or none is asked for. complete: no
    citation lacks an id, title, quote, chunk or file name (those of the columns that ``cited`` has) and no page is below
    1; true without citations. warnings: codes of what is amiss.
    """
    named = [F.col(c) for c in ("source_id", "source_title", "quote", "chunk_id", "source_filename") if c in cited.columns]
    whole = F.lit(True)
    for c in named:
        whole = whole & (F.trim(F.coalesce(c.cast("string"), F.lit(""))) != "")
    if "page" in cited.columns:
        whole = whole & (F.coalesce("page", F.lit(1)) >= 1)
    places = F.lower(F.concat_ws(" ", *(c for c in ("source_id", "source_title") if c in cited.columns)))
    held = cited.select("query_id", whole.alias("whole"), places.alias("places")).join(expected.select("query_id", "keywords"), "query_id")
    held = held.groupBy("query_id").agg(F.count("*").alias("n"), F.bool_and("whole").alias("complete"), F.bool_or(F.exists("keywords", lambda k: F.col("places").contains(F.lower(k)))).alias("matched"))
    asked = F.size(F.coalesce("keywords", F.array().cast("array<string>"))) > 0
    both = expected.join(held, "query_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "matched": ~asked | F.coalesce("matched", F.lit(False)), "complete": F.coalesce("complete", F.lit(True))})
    n, due = F.col("n"), F.col("should_have")
    amiss = [(due & (n == 0), "no_evidence"), (due & (n < F.col("minimum")), "too_few"), (due & asked & ~F.col("matched"), "no_source"), (due & ~F.col("complete"), "no_provenance"), (~due & (n > 0), "not_refused")]
    return both.select("query_id", "should_have", "critical", "minimum", "n", "matched", "complete", F.array_compact(F.array(*(F.when(c, code) for c, code in amiss))).alias("warnings"))


def retrieval_quality_report(cases: DataFrame) -> DataFrame:
    """One row of counts over the cases, of those that ask for evidence: supported, and of these matched and complete; of the others: refused.

    usable: some case is supported and every critical one has a known source and its provenance. proven: every case is as expected, without a warning.
    """
    due, found = F.col("should_have"), F.col("n") > 0
    good = due & found & (F.col("n") >= F.col("minimum"))
    many = lambda c: F.count(F.when(c, 1))
    lost = many(due & F.col("critical") & ~(found & F.col("matched") & F.col("complete")))
    out = cases.agg(F.count("*").alias("cases"), many(due).alias("expected"), many(good).alias("supported"), many(good & F.col("matched")).alias("matched"), many(good & F.col("complete")).alias("complete"), many(~due & ~found).alias("refused"), F.coalesce(F.sum(F.size("warnings")), F.lit(0)).alias("warnings"), lost.alias("lost"))
    usable = (F.col("supported") > 0) & (F.col("lost") == 0)
    all_due = (F.col("expected") > 0) & (F.least("supported", "matched", "complete") == F.col("expected"))
    return out.withColumns({"usable": usable, "proven": all_due & (F.col("refused") == F.col("cases") - F.col("expected")) & (F.col("warnings") == 0)}).drop("lost")
