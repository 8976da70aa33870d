"""Rules held against cases worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from flightloom.functions.chunking import split_text
from flightloom.operators import decision as J
from flightloom.operators import evidence as H
from flightloom.operators import records as K
from flightloom.operators import review as I


def rows(df, *names):
    return sorted((tuple(x[n] for n in names) for x in df.collect()), key=str)


def test_texts_are_cut_at_the_first_separator_that_occurs():
    text = "Head of it.\nArticle 1 one one one\nArticle 2 two. two two\nmore"
    assert split_text(text, 30, 5) == ["Head of it.", "Article 1 one one one", "Article 2 two. two two\nmore"]
    assert split_text("a b c d e f g h", 5, 2) == ["a b c", "c d", "d e", "e f", "f g", "g h"]  # a blank belongs to the piece after it
    assert split_text("x" * 900) == ["x" * 900] and split_text("") == [] == split_text(" \n ")
    long = "\n\n".join(f"Paragraph {i} " + "word " * 60 for i in range(9))
    assert all(len(c) <= 800 for c in split_text(long)) and all(f"Paragraph {i} " in "".join(split_text(long)) for i in range(9))


def test_public_records():
    value = {"a": {"Prompt": 1, "my_token_count": 2, "kept": "x" * 600}, "chain_of_thought": "no", "list": list(range(80)), "nan": float("nan")}
    deep = 1
    for _ in range(10):
        deep = {"d": deep}
    got = I.clean(value | {"deep": deep})
    assert set(got) == {"a", "list", "nan", "deep"} and list(got["a"]) == ["kept"] and len(got["a"]["kept"]) == 500 and got["a"]["kept"].endswith("x...")
    assert len(got["list"]) == 64 and got["nan"] is None and "[truncated-depth]" in json.dumps(got["deep"])
    assert I.clean(value, allowed=frozenset(["list"])) == {"list": list(range(64))} and I.clean([1], allowed=frozenset("a")) == {}


@pytest.mark.parametrize(
    "held, want",
    [
        (["supported"], "grounded"), (["partially_supported"], "partial"), (["supported", "partially_supported"], "partial"), (["insufficient_evidence"], "insufficient"),
        (["supported", "insufficient_evidence"], "partial"), (["supported", "conflicting"], "unknown"), ([], "unavailable"),
    ],
)
def test_evidence_status(spark, held, want):
    bundles = spark.createDataFrame([(1, s, "scenario_driven", False) for s in held] + [(1, "conflicting", "agent_requested", True)], "mission_id long, support_status string, retrieval_origin string, synthetic boolean")
    assert H.scenario_evidence_status(bundles, spark.createDataFrame([(1,)], "mission_id long")).first()["evidence_status"] == want


def test_candidates_citations_and_labels(spark):
    text = "x" * 40
    table = [
        (1, "c1", "s", "f.pdf", 1, text, "local_document", 0.9, 0.5, 0.5, 0.5, 1.0, True), (1, "c2", "s", "f.pdf", None, text, "operator_input", 0.5, 0.5, 0.5, 0.5, 1.0, True),
        (1, "c3", "s", "f.pdf", 0, text, None, 0.9, 0.5, 0.5, 0.5, 1.0, True), (1, "c4", "s", "f.pdf", 1, text, "HYDE_generated", 0.9, 0.5, 0.5, 0.5, 1.0, False),
        (1, "c5", "s", "f.pdf", 1, text[1:], None, 0.9, 0.5, 0.5, 0.5, 1.0, False), (1, "c6", "s", "f.pdf", 1, text, None, 0.07, 0.5, 0.5, 0.5, 1.0, False),
        (1, "c7", "s", "f.pdf", 1, text, None, 0.9, 0.5, 0.5, 0.5, 0.0, True), (1, "c8", " ", "f.pdf", 1, text, None, 0.9, 0.5, 0.5, 0.5, 1.0, False), (1, "c9", "s", "f.pdf", 2, text, None, 0.1, 0.0, 0.0, 0.0, None, False),
    ]
    cands = spark.createDataFrame(table, "query_id long, chunk_id string, source_id string, source_filename string, page int, text string, origin string, final_score double, retrieval_score double, dense_score double, sparse_score double, source_match_score double, explicit boolean")
    ranked = H.rank_citations(H.build_citations(H.sufficient_candidates(cands)))
    assert rows(ranked, "rank", "citation_id", "label", "origin") == [(1, "cit_c1", "HIGH", "local_document"), (2, "cit_c2", "MEDIUM", "retrieval_system"), (3, "cit_c9", "VERY LOW", "retrieval_system")]


def test_recommendations(spark):
    bundles = spark.createDataFrame([(1, "supported", 0), (2, "partially_supported", 1), (3, "supported", 1), (3, "insufficient_evidence", 0), (4, "supported", 2)], "mission_id long, support_status string, n_citations long")
    missions = spark.createDataFrame([(i, {"Low Risk": 0.9, "High Risk": 0.1}) for i in (1, 2, 3)] + [(4, {"Low Risk": 0.1, "Medium Risk": 0.9})], "mission_id long, probabilities map<string,double>")
    got = J.recommend(missions, J.ml_signal_finding(missions), bundles)
    assert rows(got, "mission_id", "recommendation", "confidence") == [(1, "insufficient_evidence", 0.2), (2, "go", 0.7), (3, "caution", 0.5), (4, "caution", 0.55)]
    said = spark.createDataFrame([(2, "Approved", None, False), (3, "no-go", 0.9, True), (4, "whatever", None, False), (5, "rejected", 3.0, False)], "mission_id long, recommendation string, confidence double, structural boolean")
    weak = spark.createDataFrame([(2, "insufficient_evidence"), (3, "insufficient_evidence")], "mission_id long, support_status string")
    got = I.normalize_recommendations(said, weak)
    assert rows(got, "mission_id", "recommendation", "status", "confidence", "auto_finding") == [(2, "insufficient_evidence", "completed", 0.5, True), (3, "no_go", "completed", 0.9, True), (4, "degraded", "degraded", 0.0, False), (5, "no_go", "completed", 1.0, True)]


def test_public_texts(spark):
    texts = ["  a \n b ", "My Scratchpad and Internal_Reasoning", None, "", "y" * 400]
    got = [x[0] for x in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(K.redact_text(F.col("t"))).collect()]
    assert got == ["a b", "my [redacted_forbidden_token] and [redacted_forbidden_token]", "not_available", "not_available", "y" * 357 + "..."]


def test_narratives(spark):
    told = spark.createDataFrame([(1, "The decision score is 0.51, confidence level: Low, final decision is NO GO"), (2, "Decision Score 0.40. Confidence high. Final decision caution"), (3, "nothing said")], "mission_id long, narrative string")
    held = spark.createDataFrame([(1, 0.5, "low", "no_go"), (2, 0.5, "low", "go"), (3, 0.5, "low", "go")], "mission_id long, decision_score double, confidence_level string, final_decision string")
    assert rows(K.narrative_conflicts(told, held), "mission_id", "code") == [(2, "confidence_mismatch"), (2, "decision_mismatch"), (2, "score_mismatch")]
