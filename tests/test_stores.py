"""Stores change as a whole: profiles by user, index versions, records of a stream."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from flightloom import bindings as B
from flightloom.operators import corpus as E
from flightloom.operators import records as K
from flightloom.operators import retrieval as R
from flightloom.operators import search as W
from flightloom.plans.decision_queries import attributions, bundles
from flightloom.sources import stores as D
from flightloom.sources import tables as A
from flightloom.streaming import learning as L

PROFILE = "user_id string, profile_id string, mass double, name string"


def files(path):
    return {os.path.relpath(os.path.join(d, x), path): os.stat(os.path.join(d, x)).st_mtime_ns for d, _, names in os.walk(path) for x in names if x.endswith(".parquet")}


def test_profile_store(spark, tmp_path):
    path = str(tmp_path / "store")
    D.store_profiles(spark.createDataFrame([("7", "a", 1.0, "x"), ("7", "b", 2.0, None), ("007", "a", 3.0, "z"), ("v", "only", 4.0, "w")], PROFILE), path)
    before = files(path)
    asked = [("7", "a", 9.0, "n", "update"), ("7", "b", None, None, "delete"), ("7", "c", 5.0, "c", "create"), ("v", "only", None, None, "delete"), ("new", "p", 6.0, "p", "create"), ("007", "a", 0.0, "n", "create"), (None, "q", 1.0, "n", "create"), ("..", "q", 1.0, "n", "create")]
    told = D.change_profiles(spark, path, spark.createDataFrame(asked, PROFILE + ", op string"))
    assert {(x.user_id, x.profile_id): x.result for x in told.collect()} == {("7", "a"): "update", ("7", "b"): "delete", ("7", "c"): "create", ("v", "only"): "delete", ("new", "p"): "create", ("007", "a"): "refused", (None, "q"): "refused", ("..", "q"): "refused"}
    now = {(x.user_id, x.profile_id): (x.mass, x.name) for x in D.read_profile_store(spark, path).collect()}
    assert now == {("7", "a"): (9.0, "n"), ("7", "c"): (5.0, "c"), ("007", "a"): (3.0, "z"), ("new", "p"): (6.0, "p")}
    after = files(path)
    same = {x for x in before if after.get(x) == before[x]}
    assert same == {x for x in before if x.startswith("user_id=007/")}  # the user whose only change was refused keeps the files
    again = spark.createDataFrame([("7", "b", 8.0, "back", "create"), ("v", "only", 1.0, "n", "update")], PROFILE + ", op string")
    assert {x.profile_id: x.result for x in D.change_profiles(spark, path, again).collect()} == {"b": "create", "only": "refused"}
    assert {x.profile_id for x in D.read_profile_store(spark, path).where("user_id = '7'").collect()} == {"a", "b", "c"}
    held = spark.read.parquet(path)
    assert held.groupBy("user_id", "profile_id").count().where("count > 1").count() == 0
    with pytest.raises(Exception, match="exist"):
        D.store_profiles(spark.createDataFrame([("7", "a", 1.0, "x")], PROFILE), path)


def small_index(spark, texts):
    chunks = spark.createDataFrame([(i, f"s{i % 2}", f"s{i % 2}.pdf", f"s{i % 2}", i + 1, t) for i, t in enumerate(texts)], "chunk_id long, source_id string, source_filename string, source_title string, page int, text string")
    return W.build_index(chunks)


def test_index_versions(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        D.read_index(spark, path)
    first = small_index(spark, ["wind limits of small aircraft in the open", "airspace"])
    version = D.publish_index(first.tables(), path)
    held = W.SearchIndex(**D.read_index(spark, path))
    assert held.vectors is None and held.chunks.count() == 2 and {x.term for x in held.stats.collect()} >= {"wind", "airspace"}
    assert D.read_manifest(spark, path)["tables"]["chunks"] == 2
    for tables, kind in (({}, ValueError), ({"../x": first.docs}, ValueError), (first.tables(), FileExistsError)):
        with pytest.raises(kind):
            D.publish_index(tables, path)
    with pytest.raises(ValueError, match="streams"):
        D.publish_index({"docs": spark.readStream.format("rate").load()}, path, force=True)
    assert os.listdir(tmp_path / "index" / "versions") == [version]
    broken = first.docs.withColumn("dl", F.raise_error("the last table fails").cast("int"))
    second = small_index(spark, ["other text"])
    with pytest.raises(Exception, match="the last table fails"):
        D.publish_index({"chunks": second.chunks, "docs": broken}, path, force=True)
    assert D.read_manifest(spark, path)["version"] == version and D.read_index(spark, path)["chunks"].count() == 2
    new = D.publish_index(second.tables(), path, force=True)
    assert held.chunks.count() == 2  # the version before stays for its readers
    assert D.read_index(spark, path)["chunks"].first()["text"] == "other text"
    newest = D.publish_index(second.tables(), path, force=True)
    assert sorted(os.listdir(tmp_path / "index" / "versions")) == sorted([new, newest])


def test_batches_are_stored_once(spark, tmp_path):
    path = str(tmp_path / "records")
    rows = spark.createDataFrame([("1", "a1", 0.5), ("1", "a2", 0.6), ("01", "a3", 0.7), ("..", "a4", 0.1)], "user_id string, assessment_id string, decision_score double")
    A.write_assessments(rows, path, 3)
    A.write_assessments(rows, path, 3)
    assert A.read_assessments(spark, path).count() == 3
    A.write_assessments(rows.where("user_id = '1'").withColumn("assessment_id", F.concat("assessment_id", F.lit("b"))), path, 4)
    A.write_assessments(rows.where("user_id = '01'"), path)
    A.write_assessments(rows, path, 3)
    assert sorted((x.user_id, x.assessment_id) for x in A.read_assessments(spark, path).collect()) == [("01", "a3"), ("01", "a3"), ("1", "a1"), ("1", "a1b"), ("1", "a2"), ("1", "a2b")]


def test_record_stream_replays_a_batch(spark, sf_dir, tmp_path):
    missions, profiles = B.missions(spark, sf_dir).limit(60), B.profiles(spark, sf_dir)
    parts = [str(tmp_path / "in" / x) for x in "ab"]
    missions.where("mission_id % 2 = 0").coalesce(1).write.parquet(parts[0])
    stream = spark.readStream.schema(missions.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    run = lambda: L.stream_records(stream, profiles, bundles(spark, sf_dir), attributions(spark, sf_dir), out, checkpoint).awaitTermination()
    run()
    missions.where("mission_id % 2 = 1").coalesce(1).write.parquet(parts[1])
    run()
    stored = A.read_assessments(spark, out)
    assert stored.count() == 60 and stored.select("assessment_id").distinct().count() == 60
    last = max(int(x) for x in os.listdir(tmp_path / "c" / "commits") if x.isdigit())
    os.remove(tmp_path / "c" / "commits" / str(last))
    shutil.rmtree(tmp_path / "c" / "commits", ignore_errors=True) if last == 0 else None
    if os.path.exists(tmp_path / "c" / "commits" / f".{last}.crc"):
        os.remove(tmp_path / "c" / "commits" / f".{last}.crc")
    run()  # the last batch runs again
    again = A.read_assessments(spark, out)
    assert again.count() == 60 and again.select("assessment_id").distinct().count() == 60
    want = {x.mission_id for x in missions.select("mission_id").collect()}
    assert {int(x.assessment_id.removeprefix("assessment_")) for x in again.collect()} == want
    listed = K.list_assessments(again, again.first()["user_id"])
    assert listed.count() > 0


def test_search_with_a_reranker(spark):
    texts = ["small aircraft wind limits and gusts in the open field today"] * 2 + [f"small aircraft wind limits number {i} of many different words {'x' * i} here" for i in range(6)] + ["  ", "nothing to see here at all, other words only, long enough"]
    index = small_index(spark, texts)
    queries = spark.createDataFrame([(1, "uav wind limits"), (2, "poem about cats"), (3, "")], "query_id long, query string")
    plain = W.hybrid_search(queries, index, 4)
    rows = plain.orderBy("rank").collect()
    assert {x.query_id for x in rows} == {1} and len(rows) == 4
    assert {x.source_id for x in rows} == {"s0", "s1"} and not {0, 1} <= {x.chunk_id for x in rows}

    @F.pandas_udf("double")
    def longest(query, text):
        assert set(query) == {"uav wind limits"}
        return (text.str.len() / 100).where(text.str.contains("number"))

    ranked = W.hybrid_search(queries, index, 4, longest).collect()
    assert {x.chunk_id for x in ranked} <= set(range(8)) and len(ranked) == 4
    by_rank = sorted(ranked, key=lambda x: x["rank"])
    assert [round(x.final_score, 9) for x in by_rank] == sorted((round(x.final_score, 9) for x in ranked), reverse=True)
    numbered = [x for x in ranked if x.rerank_score is not None]
    assert numbered and all(abs(x.rerank_score - len(texts[x.chunk_id]) / 100) < 1e-9 for x in numbered)
    assert W.hybrid_search(queries.limit(0), index, 4).count() == 0
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(8)], "chunk_id long, embedding array<double>")
    both = W.build_index(index.chunks.drop("fingerprint"), vectors)
    asked = queries.withColumn("embedding", F.expr("array(0.0D, 1.0D)")).withColumn("rrf_k", F.expr("IF(query_id = 1, 20, NULL)"))
    found = W.hybrid_search(asked, both, 4)
    assert found.where("dense_score > 0").count() > 0
    ranks = R.dense_topk(asked.where("query_id = 1").select("query_id", "embedding"), E.normalize_vectors(vectors), 12)
    top = {x.chunk_id: x["rank"] for x in ranks.collect()}
    sparse = {x.chunk_id: x["rank"] for x in R.bm25_topk(asked.where("query_id = 1").select("query_id", "query"), both.postings, both.stats, both.docs, 12).collect()}
    for x in found.collect():
        want = (0.6 / (20 + top[x.chunk_id]) if x.chunk_id in top else 0) + (0.4 / (20 + sparse[x.chunk_id]) if x.chunk_id in sparse else 0)
        assert abs(x.rrf_score - want) < 1e-9
