"""Streams give what the batch jobs give; sources round trip."""

import json

import pandas as pd
from pyspark.sql import functions as F

from flightloom import bindings as B
from flightloom.functions.chunking import split_text
from flightloom.functions.fingerprints import fingerprint_rows, simhash_pairs
from flightloom.operators import evidence as H
from flightloom.operators import validate as V
from flightloom.operators.assessment import assess_missions
from flightloom.plans.decision_queries import attributions, bundles
from flightloom.plans.retrieval_queries import history
from flightloom.sources import tables as A
from flightloom.streaming import learning as L


def test_learned_stream_is_the_batch(spark, sf_dir, tmp_path):
    rows = history(spark, sf_dir).select("scenario_type", "top_score", "used_hyde", "timestamp", "entry_id")
    ordered = rows.toPandas().sort_values(["timestamp", "entry_id"])
    for i, part in enumerate((ordered[:300], ordered[300:])):
        spark.createDataFrame(part, rows.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = L.stream_scenario_profiles(stream).writeStream.format("memory").queryName("learned").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.table("learned").groupBy("scenario_type").agg(F.max_by("avg_top_score", "query_count").alias("m"), F.max_by("optimal_k", "query_count").alias("k"), F.max("query_count").alias("n"))
    want = {x.scenario_type: (round(x.avg_top_score, 9), x.optimal_k, x.query_count) for x in L.learn_scenario_profiles(rows).collect()}
    assert {x.scenario_type: (round(x.m, 9), x.k, x.n) for x in last.collect()} == want


def in_parts(spark, rows, cuts, path):
    """The rows in order of time as files, one a batch, each dealt backwards."""
    ordered = sorted(rows.collect(), key=lambda x: (x.timestamp, x.entry_id))
    for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ordered)])):
        spark.createDataFrame(ordered[a:b][::-1], rows.schema).coalesce(1).write.parquet(f"{path}/p{i:02}")
        yield i


def test_states_of_streams_are_those_of_batches(spark, tmp_path):
    """Thresholds and learned profiles over several batches and a restart, with batches of many chunks that come in no order."""
    rows = learned_rows(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out, learned = {}, {}

        def keep(batch, _):
            for x in batch.collect():
                assert x.entry_id not in out
                out[x.entry_id] = x.minimum

        def remember(batch, _):
            learned.update({x.scenario_type: (x.query_count, x.avg_top_score, x.hyde_success_rate, x.optimal_k) for x in batch.collect()})

        for _ in in_parts(spark, rows, [0, 400, 420, 1000], tmp_path / "in"):
            stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
            L.stream_thresholds(stream, 9000, 30, "scenario_type").writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
            L.stream_scenario_profiles(stream).writeStream.foreachBatch(remember).outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {x.entry_id: x.minimum for x in L.adaptive_thresholds(rows, 9000, 30, "scenario_type").collect()}
    assert set(out) == set(want) and all(abs(out[i] - v) < 1e-9 for i, v in want.items()) and len(set(want.values())) > 2
    for x in L.learn_scenario_profiles(rows).collect():
        n, mean, share, k = learned[x.scenario_type]
        assert (n, k) == (x.query_count, x.optimal_k) and abs(mean - x.avg_top_score) < 1e-9 and abs(share - x.hyde_success_rate) < 1e-9


def learned_rows(spark):
    """Hot type, null type, scores that drift down and up, ties of time, rows without a score."""
    import math
    from datetime import datetime, timedelta

    rows = []
    for i in range(1200):
        kind = None if i % 17 == 0 else "hot" if i % 3 else "cold"
        score = None if i % 101 == 0 else round(0.45 + 0.3 * math.cos(i / 190), 3) if i % 2 else 0.2
        rows.append((kind, score, [True, False, None][i % 3], datetime(2024, 1, 1) + timedelta(minutes=7 * (i // 4)), i))
    return spark.createDataFrame(rows, "scenario_type string, top_score double, used_hyde boolean, timestamp timestamp, entry_id long")


def test_learned_parts_are_the_fold(spark):
    rows = learned_rows(spark)
    kept = [x for x in sorted(rows.collect(), key=lambda x: (x.timestamp, x.entry_id)) if x.top_score is not None]
    for part in ("hour", "day", "month"):
        got = {x.scenario_type: x for x in L.learn_scenario_profiles(rows, part).collect()}
        assert set(got) == {None, "hot", "cold"}
        for kind, x in got.items():
            n, mean, share, k = L.fold(pd.DataFrame([y.asDict() for y in kept if y.scenario_type == kind]))
            assert (x.query_count, x.optimal_k) == (n, k) and abs(x.avg_top_score - mean) < 1e-9 and abs(x.hyde_success_rate - share) < 1e-9
    assert L.learn_scenario_profiles(rows.limit(0)).count() == 0


def test_thresholds_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 64)
    rows = learned_rows(spark)
    kept = [x for x in sorted(rows.collect(), key=lambda x: (x.timestamp, x.entry_id)) if x.top_score is not None]
    for key, size, window in ((None, 3598, 100), ("scenario_type", 9000, 30)):
        got = {x.entry_id: x.minimum for x in L.adaptive_thresholds(rows, size, window, key).collect()}
        assert len(got) == len(kept)
        states, want = {}, {}
        for x in kept:
            held, least = states.get(key and x.scenario_type, ([], min(0.55, 0.35 + 0.02 * size / 1000)))
            held = [*held, x.top_score][-window:]
            mean = round(sum(held) / len(held), 12)
            least = max(0.25, mean - 0.05) if len(held) >= 20 and mean < least else least
            states[key and x.scenario_type] = held, least
            want[x.entry_id] = least
        assert len(set(want.values())) > 2
        assert all(abs(got[i] - v) < 1e-9 for i, v in want.items())
    assert L.adaptive_thresholds(rows.limit(0), 3598).count() == 0


def test_assessed_stream_is_the_batch(spark, sf_dir, tmp_path):
    missions, profiles = B.missions(spark, sf_dir).limit(200), B.profiles(spark, sf_dir)
    missions.write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema(missions.schema).parquet(str(tmp_path / "m"))
    evidence, named = bundles(spark, sf_dir), attributions(spark, sf_dir)
    q = L.stream_assess(stream, profiles, evidence, named).writeStream.format("memory").queryName("assessed").start()
    q.processAllAvailable()
    q.stop()
    rows = V.join_profiles(spark.read.parquet(str(tmp_path / "m")), profiles)
    blocked = {x.mission_id for x in V.issue_rows(rows, V.all_issues()).collect()}
    got = spark.table("assessed")
    assert {x.mission_id for x in got.where("status = 'blocked'").collect()} == blocked
    want = {x.mission_id: tuple(x) for x in assess_missions(rows, evidence, named).collect()}
    assert {x.mission_id: tuple(x) for x in got.collect()} == want and len({x[6] for x in want.values()}) > 1


def test_log_stream(spark, sf_dir, tmp_path):
    history(spark, sf_dir).limit(50).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "log")).schema).parquet(str(tmp_path / "log"))
    L.stream_evidence_log(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 50


def test_sources(spark, tmp_path):
    (tmp_path / "p" / "user_1").mkdir(parents=True)
    (tmp_path / "p" / "user_1" / "a.json").write_text(json.dumps({"user_id": "user_1", "profile_id": "a", "uav_mass_kg": 2, "swarm_capable": True}, indent=1))
    assert A.read_profiles(spark, str(tmp_path / "p")).select("profile_id", "uav_mass_kg", "swarm_capable").first() == ("a", 2.0, True)
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "My File.pdf").write_bytes(b"x")
    held = A.catalog_sources(spark, str(tmp_path / "f")).first()
    assert held["source_id"].startswith("my_file_") and held["size"] == 1
    rows = spark.createDataFrame([("u", "1"), ("u", ".."), ("", "2"), ("a/b", "3"), ("v", "4")], "user_id string, assessment_id string")
    A.write_assessments(rows, str(tmp_path / "r"))
    assert sorted(str(x.assessment_id) for x in spark.read.parquet(str(tmp_path / "r")).collect()) == ["1", "4"]


def test_changed_profiles(spark):
    held = spark.createDataFrame([("u", "a", 1.0, "x"), ("u", "b", 2.0, "y"), ("u", "c", 3.0, None)], "user_id string, profile_id string, mass double, name string")
    asked = [("u", "a", "n", 9.0, "update"), ("u", "b", "n", 9.0, "delete"), ("u", "c", "n", 9.0, "create"), ("u", "d", None, 4.0, "create"), ("u", "e", "n", 9.0, "update"), ("..", "f", "n", 9.0, "create"), (None, "g", "n", 9.0, "create"), ("u", "h", "n", 9.0, None)]
    changes = spark.createDataFrame(asked, "user_id string, profile_id string, name string, mass double, op string")
    got = A.upsert_profiles(held, changes)
    assert got.columns == ["user_id", "profile_id", "mass", "name", "result", "stored"]
    assert {x.profile_id: tuple(x)[2:] for x in got.collect()} == {
        "a": (9.0, "n", "update", True),
        "b": (2.0, "y", "delete", False),
        "c": (3.0, None, "refused", True),
        "d": (4.0, None, "create", True),
        "e": (None, None, "refused", False),
        "f": (None, None, "refused", False),
        "g": (None, None, "refused", False),
        "h": (None, None, "refused", False),
    }
    assert A.upsert_profiles(held.limit(0), changes.limit(0)).count() == 0


def test_retrieval_quality(spark):
    expected = spark.createDataFrame([(1, ["EASA"], 1, True, True), (2, [], 2, True, False), (3, ["faa"], 1, True, False), (4, [], 0, False, False), (5, [], 0, False, False), (6, ["x"], 1, True, False)], "query_id long, keywords array<string>, minimum int, should_have boolean, critical boolean")
    cited = spark.createDataFrame([(1, "easa_1", "q", 3), (1, "other", "q", None), (2, "s", "q", 1), (3, "easa_2", " ", 1), (5, "s", "q", 1)], "query_id long, source_id string, quote string, page int")
    cases = H.retrieval_quality_cases(expected, cited)
    assert {x.query_id: (x.n, x.matched, x.complete, x.warnings) for x in cases.collect()} == {
        1: (2, True, True, []),
        2: (1, True, True, ["too_few"]),
        3: (1, False, False, ["no_source", "no_provenance"]),
        4: (0, True, True, []),
        5: (1, True, True, ["not_refused"]),
        6: (0, False, True, ["no_evidence", "too_few", "no_source"]),
    }
    assert tuple(H.retrieval_quality_report(cases).first()) == (6, 4, 2, 1, 1, 1, 7, True, False)
    assert tuple(H.retrieval_quality_report(cases.where("query_id in (1, 4)")).first()) == (2, 1, 1, 1, 1, 1, 0, True, True)
    assert tuple(H.retrieval_quality_report(cases.limit(0)).first()) == (0,) * 7 + (False, False)


def test_chunks():
    text = "\n\n".join("word " * n for n in (10, 300, 5, 90))
    parts = split_text(text, 200, 40)
    assert all(0 < len(p) <= 200 for p in parts) and set(text.split()) == {w for p in parts for w in p.split()}
    assert split_text("x" * 900) == ["x" * 900] and split_text("  ") == []


def test_fingerprints(spark):
    texts = ["the quick brown fox jumps over the lazy dog " * 3, "the quick brown fox jumps over the lazy dog " * 3 + "!", "something else"]
    prints = fingerprint_rows(spark.createDataFrame(pd.DataFrame({"id": [1, 2, 3], "text": texts})), "id", "text").cache()
    bits = [x.fingerprint & (2**64 - 1) for x in prints.orderBy("id").collect()]
    want = {(i + 1, j + 1) for i in range(3) for j in range(i + 1, 3) if 0 < (bits[i] ^ bits[j]).bit_count() <= 3}
    assert {(x.a, x.b) for x in simhash_pairs(prints).collect()} == want
