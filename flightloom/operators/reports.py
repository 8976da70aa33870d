"""Operational reports: eleven sections of lines a mission, from the tables of its assessment.

The tables meet once, by mission, before any line is made: a mission's report is made in its row, as an array of lines a section,
so no line is shuffled or sorted. Arrays of lines are made in the order of the report. Lists are cut to their own bounds, with a
line that says how many more there are where the format has one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom.operators.records import is_clean, once, redact_text

# Titles in order, sentences of the format, keys of metadata that a section shows, and bounds of lists.
TITLES = [
    "Executive Summary", "Input Summary", "ML Assessment", "SHAP Risk Drivers", "RAG Evidence", "Agent Operational Analysis", "DecisionEngine Final Decision", "LLM Synthesis", "Required Actions", "System Work Trace", "Diagnostics",
]
ML_BOUNDARY = "interpretation_boundary: ML is a learned risk signal, not legal authority and not the final operational decision."
SHAP_BOUNDARY = "interpretation_boundary: SHAP explains model behavior and risk drivers; it is not causal proof or legal evidence."
NO_SHAP = "No SHAP features were provided."
RAG_BOUNDARY = "evidence_boundary: RAG citations are evidence references; LLM synthesis may explain them but cannot invent or replace them."
NO_DECISION = "Decision engine output is not available."
AUTHORITY = "decision_authority: DecisionEngine owns final GO/CAUTION/NO-GO scoring."
NO_AGENT, NO_ACTIONS, NO_TRACE = "Agent result is not available.", "No operator action items were provided.", "No agent tool trace was provided."
SYNTHESIS = [
    "LLM-assisted synthesis based only on deterministic pipeline outputs.",
    "role: required_post_decision_operational_report_synthesis",
    "scope: structured UAV operational report narrative from ML, SHAP, RAG, Agent, and DecisionEngine outputs only.",
    "authority: does_not_override_decision_engine_or_rag_evidence",
]
SYNTHESIS_FIELDS = "executive_summary operational_interpretation decision_explanation mitigation_narrative".split()
EVIDENCE_KEYS = """
retrieval_usable rag_quality_is_proven quality_is_proven scenario_evidence_complete scenario_evidence_status
index_provenance_status provenance_status path_resolution_status corpus_coverage_status expected_source_count
indexed_source_count missing_sources_count source_count chunk_count faiss_ntotal
""".split()
RAG_KEYS = [*EVIDENCE_KEYS, "synthetic_bundle_count", "agent_requested_query_count"]
DIAGNOSTIC_KEYS = [*EVIDENCE_KEYS, *"dense_mapping_count reranker_configured reranker_available reranker_used reranker_reason synthetic_bundle_count agent_requested_query_count retrieval_origins".split()]
SUMMARY_REASONS = SUMMARY_ACTIONS = 6
SCENARIO_ITEMS = PROFILE_ITEMS = 20
METADATA_ITEMS, CLAIM_ITEMS, CITATION_ITEMS, MEMORY_ITEMS = 14, 5, 5, 10

TEXTS = "array<string>"
#: Tables with rows of a mission's own, by the name of their array in its row.
MANY = "bundles findings actions steps".split()


class Row:
    """A table's columns, or a struct's fields, by name; one that isn't there is null of the asked type."""

    def __init__(self, names: list[str], of: Column | None = None) -> None:
        self.names, self.of = set(names), of

    def __call__(self, name: str, kind: str = "string") -> Column:
        if name not in self.names:
            return F.lit(None).cast(kind)
        return F.col(name) if self.of is None else self.of[name]


def decimals(x: Column, places: int) -> Column:
    """A number with so many places; 1e-9 is added first, so that engines agree on halves. A decimal prints the same as format_string in a third of the time, where it is neither negative nor large."""
    y = x + 1e-9
    return F.when((x >= 0) & (x < 1e11), y.cast(f"decimal({12 + places},{places})").cast("string")).otherwise(F.format_string(f"%.{places}f", y))


def number(x: Column) -> Column:
    """A number with up to six places, at least one: 0.5, 1.0, 0.123457."""
    held = F.rtrim(decimals(x.cast("double"), 6), F.lit("0"))
    return F.when(x.isNotNull(), once(held, lambda t: F.when(t.endswith("."), F.concat(t, F.lit("0"))).otherwise(t)))


def text(x: Column, otherwise: str = "None") -> Column:
    return F.coalesce(x.cast("string"), F.lit(otherwise))


def yes(x: Column) -> Column:
    return F.when(x, "True").otherwise("False")


def line(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def fixed(lines: list[Column | str]) -> Column:
    """Lines one after another, none of them null."""
    return F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines))


def some(lines: list[Column | str]) -> Column:
    """Lines one after another; null ones are left out."""
    return F.array_compact(fixed(lines))


def none() -> Column:
    return F.array().cast(TEXTS)


def each(items: Column, said: Callable[[Column, Column], Column], most: int | None = None) -> Column:
    """A line an item, of the first ``most``; null ones are left out."""
    held = items if most is None else F.slice(items, 1, most)
    return F.coalesce(F.array_compact(F.transform(held, said)), none())


def of_each(items: Column, said: Callable[[Column, Column], Column]) -> Column:
    """The lines of each item's array, one array after another."""
    return F.coalesce(F.flatten(F.transform(items, said)), none())


def mapped(prefix: str, held: Column, keys: Column, most: int) -> Column:
    """A map's entries in the order of ``keys``, and how many are left out. Values are looked at together first: where none needs cleaning, which is the rule, they are shown as they are."""
    joined = F.concat(F.lit("|"), F.array_join(F.map_values(held), "|", ""), F.lit("|"))
    shown = lambda f: each(keys, lambda k, i: line(f"{prefix}[", k, "]: ", f(F.try_element_at(held, k))), most)
    more = F.when(F.size(held) > most, F.array(line(f"{prefix}_truncated_count: ", (F.size(held) - most).cast("string"))))
    return F.concat(F.when(~joined.contains("||") & is_clean(joined), shown(lambda x: x)).otherwise(shown(redact_text)), F.coalesce(more, none()))


def keyed(prefix: str, held: Column, keys: list[str]) -> Column:
    """Of a map the entries of given keys, where they are."""
    there = F.filter(F.array(*map(F.lit, keys)), lambda k: F.map_contains_key(held, k))
    return each(there, lambda k, i: line(f"{prefix}[", k, "]: ", redact_text(F.try_element_at(held, k))))


def joined_ids(x: Column) -> Column:
    return F.array_join(F.coalesce(x, none()), ",")


def mission_keys(r: Row) -> dict[str, Column]:
    """The keys of a mission's maps in order, which its lines name more than once."""
    return {f"{x}_keys": F.sort_array(F.map_keys(r(x, "map<string,string>"))) for x in ("scenario", "profile", "input_metadata")}


def mission_sections(r: Row) -> dict[int, Column]:
    """Sections 2 to 4."""
    words = "map<string,string>"
    names = lambda x: F.coalesce(F.nullif(F.array_join(f"{x}_keys", ", "), F.lit("")), F.lit("none"))
    entries = lambda x, most: mapped(x, r(x, words), F.col(f"{x}_keys"), most)
    noted = F.trim(F.coalesce(r("operator_notes"), F.lit(""))) != ""
    two = F.concat(fixed([line("scenario_keys: ", names("scenario")), line("profile_context_keys: ", names("profile")), line("operator_notes_present: ", yes(noted))]), entries("scenario", SCENARIO_ITEMS), entries("profile", PROFILE_ITEMS), entries("input_metadata", METADATA_ITEMS))
    chances, features = r("probabilities", "map<string,double>"), r("attributions", "array<struct<feature:string,importance:double,direction:string,value:string>>")
    labels = F.sort_array(F.map_keys(chances))
    listed = each(labels, lambda k, i: line("probability[", k, "]: ", decimals(F.try_element_at(chances, k), 4)))
    as_json = line("{", F.array_join(F.transform(labels, lambda k: line('"', k, '": ', text(number(F.try_element_at(chances, k)), "null"))), ", "), "}")
    three = F.concat(fixed([line("predicted_class: ", text(r("predicted_class"))), line("probabilities: ", redact_text(as_json, 700))]), listed, fixed([line("raw_feature_count: ", text(r("raw_feature_count", "int"))), line("processed_feature_count: ", text(r("processed_feature_count", "int"))), line("model_metadata: ", redact_text(r("model_metadata"), 700)), ML_BOUNDARY]))
    idle = F.coalesce(F.size(features), F.lit(0)) <= 0
    driver = lambda x, i: line("shap_driver[", (i + 1).cast("string"), "]: feature=", text(x["feature"]), ", importance=", text(number(x["importance"])), ", direction=", text(x["direction"]), ", value=", redact_text(x["value"]))
    four = F.concat(some([SHAP_BOUNDARY, F.when(idle, NO_SHAP)]), each(features, driver))
    return {2: two, 3: three, 4: four}


def bundle_lines(r: Row) -> Column:
    """Of section 5 what a bundle says; ``place`` numbers a mission's bundles from 1."""
    n, claims, citations = r("place").cast("string"), r("claims"), r("citations")
    head = line(
        "bundle[", n, ":", text(r("bundle_id")), "]: query='", redact_text(r("query"), 240), "' status=", text(r("support_status")), " confidence=", text(number(r("confidence", "double"))), " claims=", F.size(claims).cast("string"),
        " citations=", F.size(citations).cast("string"), " origin=", text(r("retrieval_origin")), " evidence_status=", text(r("evidence_status")), " source_intent=", text(r("source_intent")), " synthetic=", F.coalesce(yes(r("synthetic", "boolean")), F.lit("None")),
    )
    reason = F.when(F.coalesce(r("no_evidence_reason"), F.lit("")) != "", line("insufficient_evidence_reason: ", r("no_evidence_reason")))

    def claim(x: Column, i: Column) -> Column:
        name = x["claim_id"]
        own = line("claim[", name, "]: status=", text(x["support_status"]), " evidence_use=", text(x["evidence_use"]), " confidence=", text(number(x["confidence"])), " citations=", F.size(x["citations"]).cast("string"), " claim=", redact_text(x["claim"], 320))
        said = lambda what, c: each(c, lambda t, j: line(f"claim_{what}[", name, "]: ", redact_text(t, 260)))
        return F.concat(some([own]), said("limitation", x["limitations"]), said("conflict", x["conflicts"]))

    def citation(c: Column, i: Column) -> Column:
        return line(
            "citation[", n, ".", (i + 1).cast("string"), ":", c["citation_id"], "]: source_id=", text(c["source_id"]), ", source_filename=", text(F.coalesce(F.nullif(c["source_filename"], F.lit("")), c["source_title"])), ", page_start=", text(c["page"]),
            ", page_end=", text(c["page_end"]), ", section_title=", text(F.coalesce(c["section_title"], c["section"])), ", rank=", text(c["rank"]), ", final_score=", text(number(c["final_score"])), ", rerank_score=", text(number(c["rerank_score"])),
        )

    return F.concat(some([head, reason]), of_each(F.slice(claims, 1, CLAIM_ITEMS), claim), each(citations, citation, CITATION_ITEMS))


def counts_of_bundles(bundles: Column) -> dict[str, Column]:
    """Of a mission's array of bundles: their number, distinct citations, grounded and insufficient ones."""
    cited = F.flatten(F.transform(F.filter(bundles, lambda b: b["citations"].isNotNull()), lambda b: F.transform(b["citations"], lambda c: c["citation_id"])))
    status = lambda *s: F.size(F.filter(bundles, lambda b: b["support_status"].isin(*s)))
    return {"n_bundles": F.size(bundles), "n_citations": F.size(F.array_distinct(cited)), "n_grounded": status("supported", "partially_supported"), "n_insufficient": status("insufficient_evidence")}


def decision_sections(r: Row) -> dict[int, Column]:
    """Sections 1 and 5 to 11, of a mission's decision, the counts of its arrays and what these say (``*_lines``)."""
    texts, meta = TEXTS, r("metadata", "map<string,string>")
    at = lambda k: F.coalesce(F.try_element_at(meta, F.lit(k)), F.lit("None"))
    count = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)).cast("string")
    known = r("final_decision").isNotNull()
    agent = r("agent_status").isNotNull()
    reasons, actions = r("decision_reasons", texts), r("required_actions", texts)
    numbers = [line("evidence_bundle_count: ", count("n_bundles")), line("citation_count: ", count("n_citations"))]
    one = F.concat(
        fixed([
            line("assessment_id: ", text(r("assessment_id"))), line("user_id: ", text(r("user_id"))), line("profile_id: ", text(r("profile_id"))), line("stage2_status: ", text(r("status"))), line("mission_posture: ", text(r("final_decision"), "decision_unavailable")),
            line("decision_score: ", text(number(r("decision_score", "double")), "not_available")), line("decision_confidence_level: ", text(r("confidence_level"), "not_available")), line("agent_recommendation: ", text(r("recommendation"), "not_available")), *numbers,
            line("rag_quality_is_proven: ", at("rag_quality_is_proven")), line("scenario_evidence_complete: ", at("scenario_evidence_complete")), line("reranker_used: ", at("reranker_used")), line("llm_synthesis_status: ", text(r("synthesis_status"), "not_generated")), line("llm_provider: ", text(r("synthesis_provider"), "not_configured")),
        ]),
        each(reasons, lambda x, i: line("executive_decision_reason: ", x), SUMMARY_REASONS), each(actions, lambda x, i: line("executive_required_action: ", x), SUMMARY_ACTIONS),
    )
    reranker = F.when(F.map_contains_key(meta, F.lit("reranker_configured")), line("reranker_status: configured=", at("reranker_configured"), " available=", at("reranker_available"), " used=", at("reranker_used"), " reason=", at("reranker_reason")))
    five = F.concat(fixed([*numbers, line("grounded_evidence_count: ", count("n_grounded")), line("insufficient_evidence_count: ", count("n_insufficient")), RAG_BOUNDARY]), keyed("rag", meta, RAG_KEYS), some([reranker]), F.col("bundles_lines"))
    weights = r("stage_weights", "map<string,double>")
    stages = r("contributions", "array<struct<stage:string,weight:double,contribution:double,signal:string,summary:string,reasons:array<string>,limitations:array<string>>>")

    def stage(x: Column, i: Column) -> Column:
        own = line("stage[", x["stage"], "] weight=", text(number(x["weight"])), " contribution=", text(number(x["contribution"])), " signal=", text(x["signal"]), ": ", text(x["summary"], ""))
        said = lambda what, c: each(c, lambda t, j: line(f"stage_{what}[", x["stage"], "]: ", t))
        return F.concat(some([own]), said("reason", x["reasons"]), said("limitation", x["limitations"]))

    weighed = F.array_join(F.transform(F.sort_array(F.map_keys(weights)), lambda k: line(k, "=", text(number(F.try_element_at(weights, k))))), ", ")
    named = lambda what: lambda x, i: line(f"{what}: ", x)
    refs = r("evidence_refs", "array<struct<claim_id:string,citation_ids:array<string>>>")
    listed = [("decision_reason", reasons), ("blocking_reason", r("blocking_reasons", texts)), ("required_action", actions), ("limitation", r("limitations", texts))]
    head = [F.when(~known, NO_DECISION), *(F.when(known, F.lit(x) if isinstance(x, str) else x) for x in (line("final_decision: ", r("final_decision")), line("decision_score: ", text(number(r("decision_score", "double")))), line("confidence_level: ", text(r("confidence_level"))), AUTHORITY, line("stage_weights: ", F.coalesce(weighed, F.lit("")))))]
    seven = F.concat(some(head), of_each(stages, stage), *(each(items, named(what)) for what, items in listed), each(refs, lambda x, i: line("decision_evidence_ref claim_id=", text(x["claim_id"]), " citation_ids=", joined_ids(x["citation_ids"]))))
    errors = r("errors", "array<struct<code:string,message:string>>")
    synthesis = r("synthesis_status").isNotNull()
    end = [line("assessment_id: ", text(r("assessment_id"))), line("status: ", text(r("status"))), line("error_count: ", F.greatest(F.coalesce(F.size(errors), F.lit(0)), F.lit(0)).cast("string")), *numbers, line("agent_available: ", yes(agent)), line("decision_available: ", yes(known)), line("llm_synthesis_available: ", yes(synthesis))]
    more = [F.when(synthesis, x) for x in (line("llm_status: ", r("synthesis_status")), line("llm_provider: ", text(r("synthesis_provider"), "not_configured")), line("llm_model_name: ", text(r("synthesis_model"), "not_configured")), F.lit("llm_authority_boundary: post_decision_report_synthesis_only"))]
    eleven = F.concat(fixed(end), some(more), keyed("diagnostic", meta, DIAGNOSTIC_KEYS), each(errors, lambda x, i: line("error[", text(x["code"]), "]: ", text(x["message"], ""))))
    drivers, warnings = r("key_risk_drivers", texts), r("consistency_warnings", "array<struct<warning_type:string,message:string>>")
    told = [line("status: ", text(r("synthesis_status"), "not_generated")), line("provider: ", text(r("synthesis_provider"), "not_configured")), line("model_name: ", text(r("synthesis_model"), "not_configured")), *(line(f"{x}: ", F.coalesce(r(x), F.lit(""))) for x in SYNTHESIS_FIELDS)]
    ids = [F.when(F.size(r(x, texts)) > 0, line(f"{x}: ", joined_ids(r(x, texts)))) for x in ("evidence_reference_ids", "finding_ids", "action_item_ids", "limitation_ids")]
    eight = F.concat(fixed([*SYNTHESIS, *told]), each(drivers, lambda x, i: line("key_risk_driver: ", x)), each(warnings, lambda x, i: line("consistency_warning[", text(x["warning_type"]), "]: ", text(x["message"], ""))), some(ids))
    own = each(actions, lambda x, i: line("decision_required_action[", (i + 1).cast("string"), "]: ", x))
    idle = (F.coalesce(F.size(actions), F.lit(0)) <= 0) & (F.coalesce(F.col("n_actions"), F.lit(0)) <= 0)
    nine = F.concat(own, F.col("actions_lines"), some([F.when(idle, NO_ACTIONS)]))
    memory = "array<struct<signal_id:string,source:string,topic:string,priority:double,risk_relevance:string,value_summary:string>>"
    judged = "array<struct<assessment_id:string,feature_name:string,topic:string,priority:double,evidence_status:string,conclusion:string>>"
    coverage = r("coverage_summary", "map<string,string>")
    signal = lambda x, i: line("signal[", x["signal_id"], "] source=", text(x["source"]), " topic=", text(x["topic"]), " priority=", decimals(x["priority"], 2), " risk_relevance=", text(x["risk_relevance"]), ": ", redact_text(x["value_summary"], 260))
    assessed = lambda x, i: line("feature_assessment[", x["assessment_id"], "] feature=", text(x["feature_name"]), " topic=", text(x["topic"]), " priority=", decimals(x["priority"], 2), " evidence_status=", text(x["evidence_status"]), ": ", redact_text(x["conclusion"], 260))
    asked = [F.when(F.size(r(x, texts)) > 0, line(f"{x}: ", F.array_join(F.slice(r(x, texts), 1, MEMORY_ITEMS), " | "))) for x in ("selected_rag_queries", "skipped_rag_queries")]
    covered = line("working_memory_coverage: ", F.array_join(F.transform(F.sort_array(F.map_keys(coverage)), lambda k: line(k, "=", text(F.try_element_at(coverage, k)))), ", "))
    remembers = r("reasoning_summary").isNotNull() | coverage.isNotNull()
    head = [F.when(~agent, NO_AGENT), *(F.when(agent, x) for x in (line("status: ", r("agent_status")), line("recommendation: ", text(r("recommendation"))), line("confidence: ", text(number(r("agent_confidence", "double")))), line("findings_count: ", count("n_findings")), line("action_item_count: ", count("n_actions")), line("tool_trace_count: ", count("n_steps"))))]
    remembered = [F.when(agent & remembers, line("working_memory_summary: ", text(r("reasoning_summary"), "not available"))), F.when(agent & remembers, F.coalesce(covered, F.lit("working_memory_coverage: ")))]
    six = F.concat(some(head), F.col("findings_lines"), some(remembered), each(r("input_signals", memory), signal, MEMORY_ITEMS), each(r("feature_assessments", judged), assessed, MEMORY_ITEMS), some(asked))
    ten = F.concat(fixed([F.when(agent, line("agent_tool_trace_count: ", count("n_steps"))).otherwise(NO_TRACE)]), F.col("steps_lines"))
    return {1: one, 5: five, 6: six, 7: seven, 8: eight, 9: nine, 10: ten, 11: eleven}


def finding_lines(r: Row) -> Column:
    """Of section 6 what a finding says."""
    name = r("finding_id")
    head = line("finding[", name, "] severity=", text(r("severity")), " type=", text(r("finding_type")), " support_status=", text(r("support_status")), " topic=", text(r("topic")), ": ", redact_text(r("summary"), 340))
    related = [F.when(F.size(r(x, TEXTS)) > 0, line("finding[", name, f"] {x}=", redact_text(F.array_join(r(x, TEXTS), ", ")))) for x in ("related_feature_names", "related_scenario_fields", "related_profile_fields")]
    refs = r("refs", "array<struct<claim_id:string,citation_ids:array<string>>>")
    return F.concat(some([head, *related]), each(refs, lambda x, i: line("evidence_ref claim_id=", text(x["claim_id"]), " citation_ids=", joined_ids(x["citation_ids"]), " finding_id=", name)))


def action_lines(r: Row) -> Column:
    """Of section 9 what an action of the agent says."""
    refs = r("refs", "array<struct<claim_id:string,citation_ids:array<string>>>")
    cited = F.when(F.size(refs) > 0, line(" [evidence_refs=", F.array_join(F.transform(refs, lambda x: joined_ids(x["citation_ids"])), ";"), "]")).otherwise("")
    return some([line("agent_action[", r("action_id"), "]: ", text(r("summary"), ""), " (priority=", text(r("priority")), ")", cited)])


def step_lines(r: Row) -> Column:
    """Of section 10 what a step says; ``place`` numbers a mission's steps from 1."""
    n = r("place").cast("string")
    said = [line("tool_step[", n, "] tool=", text(r("tool")), " status=", text(r("status")), ": ", text(r("purpose"), "")), *(line("tool_step[", n, f"].{x}: ", text(r(x), "")) for x in ("input_summary", "output_summary"))]
    said += [F.when(F.size(r(x, TEXTS)) > 0, line("tool_step[", n, f"].{x}: ", joined_ids(r(x, TEXTS)))) for x in ("related_query_ids", "related_evidence_ids", "related_finding_ids")]
    return some(said)


LINES_OF = {"bundles": bundle_lines, "findings": finding_lines, "actions": action_lines, "steps": step_lines}


def gathered(missions: DataFrame, decided: DataFrame | None, many: dict[str, DataFrame]) -> DataFrame:
    """One row a mission of any table: the structs ``mission`` and ``decision`` (null where there is none) and the arrays of ``many``, ordered by place. Rows meet in one shuffle, none is joined."""
    parts = {"mission": missions, "decision": decided, **many}
    every = None
    for name, df in parts.items():
        if df is not None:
            part = df.select("mission_id", F.struct(*(c for c in df.columns if c != "mission_id")).alias(name))
            every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    by_place = lambda x: F.array_sort(x, lambda a, b: F.coalesce((a["place"] - b["place"]).cast("int"), F.lit(0)))
    one = [F.first(x, ignorenulls=True).alias(x) for x in ("mission", "decision") if parts[x] is not None]
    return every.groupBy("mission_id").agg(*one, *(by_place(F.collect_list(x)).alias(x) for x in many))


def report_sections(missions: DataFrame, decided: DataFrame | None, many: dict[str, DataFrame | None]) -> DataFrame:
    """(mission_id, s1 ... s11): the lines of each section of a mission's report as an array."""
    given = {k: df for k, df in many.items() if df is not None}
    if decided is None and not given:
        rows, own, end, there = missions, Row(missions.columns), Row(missions.columns), {}
    else:
        rows = gathered(missions, decided, given)
        of_decision = "mission" if decided is None else "decision"
        own, end = Row(missions.columns, F.col("mission")), Row((missions if decided is None else decided).columns, F.col(of_decision))
        there = {**dict.fromkeys((2, 3, 4), "mission"), **dict.fromkeys((1, 5, 6, 7, 8, 9, 10, 11), of_decision)}
    said, counts = {}, {}
    said_by = lambda of, names: lambda x, i: of(Row(names, x))
    for name, of in LINES_OF.items():
        held = F.col(name) if name in rows.columns else None
        names = rows.schema[name].dataType.elementType.names if held is not None else []
        said[f"{name}_lines"] = none() if held is None else of_each(held, said_by(of, names))
        counts[f"n_{name}"] = F.lit(0) if held is None else F.size(held)
    counts |= counts_of_bundles(F.col("bundles")) if "bundles" in rows.columns else dict.fromkeys(("n_citations", "n_grounded", "n_insufficient"), F.lit(0))
    rows = rows.withColumns(said | counts | mission_keys(own))
    sections = mission_sections(own) | decision_sections(end)
    lost = {5: "bundles_lines", 6: "findings_lines", 9: "actions_lines", 10: "steps_lines"}
    for no, name in there.items():
        sections[no] = F.when(F.col(name).isNotNull(), sections[no]).otherwise(F.col(lost[no]) if no in lost else none())
    return rows.select("mission_id", *(sections[no].alias(f"s{no}") for no in sorted(sections)))


def report_lines(missions: DataFrame, decided: DataFrame | None = None, bundles: DataFrame | None = None, findings: DataFrame | None = None, actions: DataFrame | None = None, steps: DataFrame | None = None) -> DataFrame:
    """(mission_id, section_no, line_no, line): all sections of each mission's report, numbered from 1.

    ``missions`` and ``decided`` have a row a mission, the others one a bundle, finding, action or step with its ``place``
    from 1. Alone, ``missions`` has the decision's columns and the others as arrays of structs in order of place. The functions
    of the sections name the columns that they read; those that a table lacks count as null. The numbers of bundles,
    citations, findings, actions and steps are counted here.
    """
    held = report_sections(missions, decided, dict(zip(MANY, (bundles, findings, actions, steps))))
    parts = held.select("mission_id", F.posexplode(F.array(*(f"s{i}" for i in range(1, len(TITLES) + 1)))).alias("no", "lines"))
    return parts.select("mission_id", (F.col("no") + 1).alias("section_no"), F.posexplode("lines").alias("at", "line")).select("mission_id", "section_no", (F.col("at") + 1).alias("line_no"), "line")


def render_reports(missions: DataFrame, decided: DataFrame | None = None, bundles: DataFrame | None = None, findings: DataFrame | None = None, actions: DataFrame | None = None, steps: DataFrame | None = None) -> DataFrame:
    """render_markdown of report_lines of the same tables, without a row a line."""
    held = report_sections(missions, decided, dict(zip(MANY, (bundles, findings, actions, steps))))
    shown = [F.when(F.size(f"s{i}") > 0, line(f"## {title}\n- ", F.array_join(f"s{i}", "\n- "))) for i, title in enumerate(TITLES, 1)]
    return held.select("mission_id", F.concat(F.concat_ws("\n\n", *shown), F.lit("\n")).alias("document"))


def render_markdown(lines: DataFrame) -> DataFrame:
    """One document a mission: each section under its title."""
    held = lines.groupBy("mission_id", "section_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    title = F.get(F.array(*map(F.lit, TITLES)), F.col("section_no") - 1)
    shown = F.concat(F.lit("## "), title, F.lit("\n"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x["line"])), "\n"))
    whole = held.select("mission_id", F.struct("section_no", shown.alias("shown")).alias("s")).groupBy("mission_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return whole.select("mission_id", F.concat(F.array_join(F.transform("s", lambda x: x["shown"]), "\n\n"), F.lit("\n")).alias("document"))
