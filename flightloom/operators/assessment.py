"""The assessment of missions in one pass: issues, findings, recommendation and decision as columns of a mission's row.

What one mission and its profile say is a projection. Only evidence bundles and attributions are grouped, each once, and
joined on mission_id; so a mission table of any size is shuffled at most for these two joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom.operators import decision as J
from flightloom.operators import validate as V
from flightloom.operators.scoring import best_class

UNSURE = ("operational_uncertainty", "limitation")


def evidence_of(bundles: DataFrame) -> DataFrame:
    """Per mission of its bundles: how many, how many insufficient and supported, citations, and whether any cited one is at least partially supported."""
    count = lambda s: F.count(F.when(F.col("support_status") == s, 1))
    counts = F.col("support_status").isin("supported", "partially_supported") & (F.col("n_citations") > 0)
    return bundles.groupBy("mission_id").agg(F.count("*").alias("n_bundles"), count("insufficient_evidence").alias("insufficient"), count("supported").alias("n_supported"), F.sum("n_citations").alias("citations"), F.bool_or(counts).alias("backed"))


def topics_by_mission(attributions: DataFrame) -> DataFrame:
    """Per mission: how many topics its attributions touch, and whether any is of great concern."""
    touch = lambda parts: J.any_part(F.lower("feature"), parts)
    held = attributions.groupBy("mission_id").agg(*(F.bool_or(touch(v)).alias(f"topic_{k}") for k, v in J.DECISION_TOPICS.items()), F.bool_or(touch(J.GREAT_CONCERN)).alias("great"))
    return held.select("mission_id", sum((F.col(f"topic_{k}").cast("int") for k in J.DECISION_TOPICS), F.lit(0)).alias("topics"), "great")


def assess_missions(joined: DataFrame, bundles: DataFrame, attributions: DataFrame, policy: J.Policy = J.Policy(), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a mission of ``joined`` (missions with their profiles and class probabilities).

    mission_id, status (blocked or open), codes of issues, recommendation and its confidence, final_decision,
    decision_score, confidence_level, the stages' contributions, and the mission's columns ``keep``; of what is made here, ``label`` (the most
    likely class) and ``findings`` can be kept too. ``joined`` may be a stream where the others are tables.
    """
    p = F.sort_array(F.map_values("probabilities"), asc=False)
    rows = joined.select("mission_id", *(x for x in keep if x not in ("label", "findings")), best_class(F.col("probabilities")).alias("label"), p.alias("p"), V.all_issues().alias("issues"), F.array_compact(F.array(*J.margin_findings())).alias("margins"))
    rows = rows.join(evidence_of(bundles), "mission_id", "left").join(topics_by_mission(attributions), "mission_id", "left")
    c, zero = F.col, F.lit(0)
    low, weak, blocked = F.lower("label"), F.coalesce("insufficient", zero) > 0, F.size("issues") > 0
    close = (F.size("p") > 1) & (F.get("p", zero) - F.get("p", F.lit(1)) < 0.15 - 1e-9)
    own = [J.found("ml_signal", "ml_signal_summary", J.class_severity(low), None), F.when(close, J.found("operational_uncertainty", "ml_probability_uncertainty", "medium", None)), F.when(weak, J.found("limitation", "evidence_limitation", "high", None))]
    rows = rows.select("*", close.alias("close"), weak.alias("weak"), blocked.alias("blocked"), F.concat(F.array_compact(F.array(*own)), "margins").alias("findings"))
    worst = F.array_max(F.transform("findings", lambda x: J.severity_score(x["severity"])))
    named = F.array_max(F.transform(F.filter("findings", lambda x: F.trim(F.coalesce(x["topic"], F.lit(""))) != ""), lambda x: J.severity_score(x["severity"])))
    doubt = F.exists("findings", lambda x: x["finding_type"].isin(*UNSURE))
    advice = J.advice(low, F.coalesce("backed", F.lit(False)), c("doubt"))
    rows = rows.select("*", worst.alias("worst"), named.alias("named"), doubt.alias("doubt"), F.exists("findings", lambda x: x["severity"] == "critical").alias("critical")).withColumn("advice", advice)
    no_evidence = c("n_bundles").isNull() | ((c("citations") == 0) & ~c("weak"))
    scored = rows.select(
        "*",
        J.ml_score(low, c("p"), c("close")).alias("ml"),
        J.attribution_score(c("topics"), c("great")).alias("shap"),
        J.evidence_score(c("n_bundles"), c("insufficient"), c("citations"), c("n_supported")).alias("rag"),
        J.findings_score(c("worst"), c("doubt"), c("advice.recommendation")).alias("agent"),
        F.coalesce("named", F.lit(0.10)).alias("scenario_profile"),
        ((F.size("p") <= 0).cast("int") + c("close").cast("int") + (F.coalesce("topics", zero) == 0).cast("int") + F.coalesce("insufficient", zero) + no_evidence.cast("int")).alias("limits"),
    )
    decided = J.decision_columns(scored, policy)
    codes = F.concat_ws(",", F.transform("issues", lambda x: x["code"]))
    return decided.select("mission_id", F.when(c("blocked"), "blocked").otherwise("open").alias("status"), codes.alias("codes"), "advice.recommendation", c("advice.confidence").alias("confidence"), "final_decision", "decision_score", "confidence_level", "ml", "shap", "rag", "agent", "scenario_profile", *keep)


def split_by_issues(joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Missions with an issue, as blocked rows with decision no_go, and the missions that go on. A predicate parts them, and issues are made up for blocked rows only."""
    issues = joined.where(V.any_issue()).select("mission_id", F.transform(V.all_issues(), lambda x: x["code"]).alias("codes"))
    blocked = issues.select("mission_id", F.lit("blocked").alias("status"), F.lit("no_go").alias("final_decision"), F.size("codes").alias("n_issues"), F.concat_ws(",", "codes").alias("codes"))
    return blocked, joined.where(~V.any_issue())
