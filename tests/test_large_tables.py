"""Steps that must stay bounded where tables of missions or documents are large: plans without copies for every task, and the same results as by other ways."""

import re
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from flightloom.operators import corpus as E
from flightloom.operators import quality_records as Q
from flightloom.operators import records as K
from flightloom.operators import retrieval as R
from flightloom.operators import review as I
from flightloom.operators import search as W
from flightloom.plans import all_queries
from flightloom.plans.retrieval_queries import BM25_SQL

QUERIES = all_queries()[0]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_topics_of_missions_meet_without_joins(spark, sf_dir):
    plan = plan_of(QUERIES["topic_findings"](spark, sf_dir))
    assert "Broadcast" not in plan and "Join" not in plan
    table = lambda rows, names: spark.createDataFrame(rows, names)
    kinds = "mission_id long, feature string"
    fields = table([(1, "wind"), (1, "link_wind"), (2, "fuel"), (None, "wind"), (3, "mass"), (3, None), (4, "wind"), (4, "airspace"), (4, "agl"), (4, "uplink"), (4, "mass"), (4, "swarm")], kinds)
    model = table([(1, "wind"), (1, "vlos"), (2, "fuel"), (None, "wind"), (4, "swarm"), (4, "fuel"), (4, "traffic"), (4, "fault")], kinds)
    backed = table([(2, "energy"), (None, "weather"), (1, "c2"), (3, "general")], "mission_id long, topic string")
    own, more = "scenario_derived", "model_explanation"
    want = [(1, "weather", own), (1, "vlos", more), (3, "payload", own), (None, "weather", own), (None, "weather", more)]
    want += [(4, t, own) for t in ("weather", "airspace", "altitude", "c2", "payload")] + [(4, "ground_risk", more), (4, "faults", more)]
    assert rows_of(I.topic_findings(fields, model, backed)) == sorted(want, key=str)


def test_scores_from_rows_equal_those_from_records(spark):
    kinds = "mission_id long, uav_mass_kg double, environment_weather_wind_mps float, airspace_altitude_agl_max_m string, spawn_xyz_first array<string>, swarm_enabled boolean, mission_loiter_radius_m int, uav_fuel_l array<double>"
    rows = [(1, 25.0, 12.5, " 50 ", ["1", "2", "3"], True, 3, None), (2, 24.6, float("inf"), "None", ["1", "2"], False, None, [1.0]), (3, None, float("nan"), "5O", ["x", "2", "3"], None, 0, None), (4, 0.4, 0.1, "130", None, None, 1, [1.0, 2.0, 3.0]), (5, float("nan"), 15.0, "n/a", ["1e999", "2", "3"], None, None, None)]
    df = spark.createDataFrame(rows, kinds)
    for strict in (False, True):
        want = Q.data_quality_score(Q.profile_data_quality(df, Q.feature_bounds(spark)), strict)
        assert rows_of(Q.score_rows(df, strict)) == rows_of(want)


def test_scores_of_missions_write_no_records(spark, sf_dir):
    plan = plan_of(QUERIES["data_quality_score"](spark, sf_dir))
    assert "Generate" not in plan and "ObjectHashAggregate" not in plan


def test_records_are_dealt_out_before_they_unfold(spark, sf_dir):
    plan = plan_of(QUERIES["profile_data_quality"](spark, sf_dir))
    assert "Exchange hashpartitioning(profile_id" in plan[plan.index("Generate") :]


def test_sums_of_chunks_across_batches(monkeypatch):
    """Runs of chunks that end inside a batch, against plain sums."""
    monkeypatch.setattr(R, "SIDE", 3)
    rows = pd.DataFrame([(c, t, (c * 7 + i) % 5 + 1.0) for c in range(11) for i, t in enumerate("abcd") if (c + i) % 3], columns=["chunk_id", "term", "weight"])
    sent = SimpleNamespace(value=(np.array([5, 9]), ["a", "c"], np.array([[2.0, 0.0], [1.0, 1.0]])))
    found = pd.concat(R.best_sums(sent, 2, (rows.iloc[i : i + 4] for i in range(0, len(rows), 4))))
    want = {(q, c): sum(w * x for t, x in zip(rows.term[rows.chunk_id == c], rows.weight[rows.chunk_id == c]) for w in [times.get(t, 0)]) for q, times in ((5, {"a": 2}), (9, {"a": 1, "c": 1})) for c in range(11)}
    got = {(x.query_id, x.chunk_id): x.score for x in found.itertuples()}
    assert len(got) == len(found) and all(want[k] == v for k, v in got.items())
    for q in (5, 9):
        best = sorted(((-v, c) for (p, c), v in want.items() if p == q and v), key=lambda x: x)[:2]
        assert {c for _, c in best} <= {c for p, c in got if p == q}
    assert list(R.best_sums(sent, 2, iter([]))) == []


def test_sparse_search_makes_no_row_a_query_and_chunk(spark, sf_dir):
    plan = plan_of(QUERIES["bm25_topk"](spark, sf_dir))
    assert not re.search(r"Aggregate\(keys=\[query_id#\d+L?, chunk_id#", plan) and "MapInPandas" in plan


def test_sparse_search_reads_texts_once_for_postings(spark, sf_dir):
    df = QUERIES["bm25_topk"](spark, sf_dir)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2  # of postings and, by a shuffle that both share, of their statistics
    rows = df.collect()
    assert rows and "ReusedExchange" in plan_of(df)


def test_postings_with_lengths_find_the_same(spark):
    chunks = spark.createDataFrame([(1, "one two two three"), (2, "two four"), (3, ""), (None, "two five"), (5, "six seven eight nine two")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "two three"), (2, "nine two"), (3, "none")], "query_id long, query string")
    tokens = E.tokenize(chunks)
    found = []
    for lengths in (False, True):
        postings = E.build_postings(tokens, R.query_terms(asked), lengths)
        found.append(rows_of(R.bm25_topk(asked, postings, E.term_stats(postings, 5), E.doc_stats(tokens), 2)))
    assert found[0] == found[1] and len(found[0]) == 4


def test_fingerprints_of_candidates_alone(spark):
    rows = [(i, "s", "s.pdf", "s", i, t) for i, t in enumerate(["wind speed limit of the drone", "wind speed limit of the drone", "  ", "ground risk of the drone", "nothing of it"], 1)]
    chunks = spark.createDataFrame(rows, "chunk_id long, source_id string, source_filename string, source_title string, page int, text string")
    asked = spark.createDataFrame([(1, "drone wind"), (2, "ground risk")], "query_id long, query string")
    own = W.build_index(chunks, terms=R.query_terms(asked), texts=chunks.select("chunk_id", "text"))
    found = rows_of(W.candidate_pool(asked, own))
    assert "fingerprint" not in own.chunks.columns and len(found) == 3
    assert found == rows_of(W.candidate_pool(asked, W.build_index(chunks)).select(W.candidate_pool(asked, own).columns))


def test_tokens_are_runs_of_three_or_more(spark):
    df = spark.createDataFrame([("Ab abc, x-ray_2000\t\u00c4bcd \u212aelvin the  end",), ("",), (None,)], "t string")
    plain = F.filter(F.split(F.regexp_replace(F.lower("t"), r"[^a-z0-9\s]", " "), r"\s+"), lambda t: F.length(t) > 2)
    got = df.select(E.index_tokens(F.col("t")).alias("x"), plain.alias("y")).collect()
    assert [x.x for x in got] == [x.y for x in got] and {"abc", "ray", "2000", "bcd", "the", "end"} <= set(got[0].x)


def test_a_text_is_cleaned_once_however_often_it_is_looked_at(spark):
    df = spark.createDataFrame([("a  b" * 30,), ("My Thought  here",), ("",), (None,), ("  ",)], "t string")
    shown = df.select(K.redact_text(F.col("t"), 20).alias("x"))
    assert shown._jdf.queryExecution().analyzed().toString().count("\\s+") == 1
    assert [x.x for x in shown.collect()] == ["a ba ba ba ba ba...", "my [redacted_forb...", "not_available", "not_available", "not_available"]


def test_topics_of_signals_are_looked_up_once(spark, sf_dir):
    plan = QUERIES["input_signals"](spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert plan.count("turbulence") < 10  # the words of a topic, in a plan that holds them for each use


def test_a_norm_is_worked_out_once_a_vector(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [])]
    made = E.normalize_vectors(spark.createDataFrame(rows, "chunk_id long, embedding array<float>")).where("embedding is not null")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"lambda x_\d+#\d+ as double\) / SQRT\(", plan)
    assert rows_of(made) == [(1, [0.6, 0.8]), (2, [0.0, 0.0]), (4, [1.0, None]), (5, [])]


def test_lengths_of_chunks_need_no_tokens(spark, sf_dir):
    texts = ["Ab abc, x-ray_2000\t\u00c4bcd \u212aelvin the  end", "", None, "ab", "abc", "\u0130ab \u0130abc\u0130", "one1 t\u00e9st\U0001f600abc", "no", "  abc\nabc-ab-abcd", "ABC" * 5000]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(3)
    made = E.doc_lengths(chunks)
    assert "regexp" not in made._jdf.queryExecution().optimizedPlan().toString()
    plain = {i: None if t is None else len(re.findall("[a-z0-9]{3,}", t.lower())) for i, t in enumerate(texts)}
    assert {x.chunk_id: x.dl for x in made.collect()} == plain
    held = E.tokenize(chunks.where("text is not null"))
    assert rows_of(made.where("dl is not null")) == rows_of(E.doc_stats(held))
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS chunk_id", "coalesce(text, '') AS text")
    assert rows_of(E.doc_lengths(whole)) == rows_of(E.doc_stats(E.tokenize(whole)))
    assert "regexp" not in QUERIES["doc_stats"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_only_texts_of_candidates_are_shuffled(spark, sf_dir):
    plan = plan_of(QUERIES["sufficient_candidates"](spark, sf_dir))
    assert not re.search(r"Project \[[^\n]*text#\d+[^\n]* AS part#", plan)  # what the numbering of pages shuffles


def test_candidates_meet_the_texts_of_their_rows(spark, monkeypatch):
    rows = [(1, "a", 1, "x"), (2, "a", 2, "y"), (2, "a", 3, "z"), (2, "b", 1, "u"), (3, None, 1, "v"), (3, "", 1, "w"), (4, "b", 2, "t")]
    chunks = spark.createDataFrame(rows, "chunk_id long, source_title string, page long, text string")
    cands = spark.createDataFrame([(7, 1, 0.1), (7, 2, 0.2), (8, 2, 0.3), (8, 3, 0.4), (9, 5, 0.5)], "query_id long, chunk_id long, score double")
    names = ["query_id", "chunk_id", "score", "source_title", "page", "text"]
    want = rows_of(cands.join(chunks, "chunk_id").select(names))
    places, texts = chunks.drop("text"), chunks.drop("page")
    assert rows_of(R.with_texts(cands, places, texts, 5).select(names)) == want and len(want) == 9
    monkeypatch.setattr(R, "SENT", 4)
    assert rows_of(R.with_texts(cands, places, texts, 5).select(names)) == want


def test_search_of_texts_equals_that_of_postings(spark, monkeypatch):
    """Null texts, ties, words that are no tokens; in one batch of queries and in many, with few words and with more than are sent."""
    texts = [(i, None if i % 13 == 0 else " ".join(f"w{(i * j) % 9}x" for j in range(i % 7)) + (" \u212aelvin ab-abc" if i % 5 == 0 else "")) for i in range(300)]
    texts += [(1000 + i, "w3x w4x same") for i in range(40)] + [(i, "big " * 3000) for i in range(2000, 2003)]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string").repartition(5)
    asked = spark.createDataFrame([(1, "w1x w2x w2x"), (2, "kelvin, kelvin ab"), (3, "same"), (4, "none at all"), (5, ""), (6, "big w3x")], "query_id long, query string")
    shown = lambda df: rows_of(df.selectExpr("query_id", "chunk_id", "rank", "round(sparse_score, 9)"))
    plain = chunks.fillna("", ["text"])
    postings = E.build_postings(E.tokenize(plain), R.query_terms(asked), True)
    found = {}
    for k in (3, 30):
        want = shown(R.bm25_topk(asked, postings, E.term_stats(postings, chunks.count()), E.doc_lengths(plain), k))
        assert len(want) > 3 * k and shown(R.bm25_texts(asked, chunks, k)) == want
        found[k] = want
    assert shown(R.bm25_texts(asked.where("query_id > 9"), chunks)) == []
    assert shown(R.bm25_texts(asked.unionByName(asked.selectExpr("cast(null as long) AS query_id", "query")), chunks, 3)) == found[3]
    monkeypatch.setattr(R, "TERMS", 2)
    assert shown(R.bm25_texts(asked, chunks, 3)) == found[3]
    monkeypatch.setattr(R, "WORDS", 2)
    assert shown(R.bm25_texts(asked, chunks, 3)) == found[3]


def test_search_of_repeated_and_null_chunks_against_sql(spark):
    rows = [(i % 23 if i % 9 else None, " ".join(f"w{(i * j) % 9}x" for j in range(i % 8))) for i in range(120)] + [(50, None), (51, "w1x w5x")]
    asked = [(1, "w1x w2x w2x"), (2, "w3x other"), (3, "w5x w7x w8x")]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.register("benchmark", pd.DataFrame(asked, columns=["item_id", "text"]))
    want = con.sql(f"WITH {BM25_SQL} SELECT query_id, chunk_id, rank, round(sparse_score, 9) FROM sparse").fetchall()
    found = R.bm25_texts(spark.createDataFrame(asked, "query_id long, query string"), spark.createDataFrame(rows, "chunk_id long, text string").repartition(3))
    assert len(want) > 30 and rows_of(found.selectExpr("query_id", "chunk_id", "rank", "round(sparse_score, 9)")) == sorted(want, key=str)


def test_runs_of_chunks_hold_whole_chunks(monkeypatch):
    """Chunks that go on over batches, in runs that end inside a batch, against plain sums."""
    monkeypatch.setattr(R, "SIDE", 3)
    rows = [(None, 1, 2, [0], [1]), (None, 1, 4, [0, 2], [1, 1])] + [(c, 1, c + i, [c % 3, 3], [i + 1, 2]) for c in range(10) for i in range(c % 4)]
    kinds = pa.schema([("chunk_id", pa.int64()), ("n", pa.int64()), ("dl", pa.int64()), ("at", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])
    want = {}
    for c, n, dl, at, tf in rows:
        was = want.get(c, (0, 0, {}))
        want[c] = (was[0] + n, was[1] + dl, was[2] | {a: was[2].get(a, 0) + x for a, x in zip(at, tf)})
    for size in (1, 2, 5, 100):
        got = {}
        for ids, n, dl, of, at, tf in R.whole_chunks(pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in rows[i : i + size]], kinds) for i in range(0, len(rows), size)):
            assert len(ids) <= 3
            got |= {c: (n[i], dl[i], dict(zip(at[of == i], tf[of == i]))) for i, c in enumerate(ids.to_pylist())}
        assert got == want


def test_blended_search_makes_no_row_for_a_posting(spark, sf_dir):
    for name in ("sufficient_candidates", "merge_query_results", "build_citations", "bundle_citations", "evidence_bundles", "evidence_contract_violations"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan and "MapInArrow" in plan
