import re

import corpus_pipeline as C
from flightloom.llm import near_dedup as N
from flightloom.llm.pii import base_spans

from .test_search import classes_by_brute_force, cut


def test_stages_one_by_one(spark, sf_dir, documents):
    docs = documents.select("doc_id", "text", "lang", "source", "n_chars")
    names = docs.columns
    clean = C.drop_toxic(spark, docs, sf_dir).cache()
    assert clean.columns == names and 0 < clean.count() <= docs.count()

    single = C.keep_one_of_each(spark, clean, sf_dir).cache()
    rows = [(x.doc_id, x.text) for x in clean.select("doc_id", "text").collect()]
    classes = classes_by_brute_force(rows)
    assert single.columns == names
    assert sorted((x.doc_id for x in single.collect()), key=str) == sorted([*{c for c in classes.values()}, *(d for d, _ in rows if d is None)], key=str)

    bench = [cut(x.text) for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    phrases = {tuple(w[i : i + 10]) for w in bench for i in range(max(1, len(w) - 9)) if w}
    uncontaminated = C.drop_contaminated(spark, single, sf_dir).cache()
    hit = lambda t: any(tuple(cut(t)[i : i + 10]) in phrases for i in range(len(cut(t))))
    assert uncontaminated.columns == names
    assert {x.doc_id for x in uncontaminated.collect()} == {x.doc_id for x in single.collect() if x.doc_id is None or not hit(x.text)}

    redacted = C.redact_personal_data(spark, uncontaminated, sf_dir)
    assert redacted.columns == names and redacted.count() == uncontaminated.count()
    before = {x.doc_id: x.text for x in uncontaminated.collect()}
    for x in redacted.collect():
        if x.text is None:
            assert before[x.doc_id] is None
            continue
        assert x.n_chars == len(x.text) and not base_spans(x.text)
        if not re.search("[0-9@]", before[x.doc_id]):
            assert x.text == before[x.doc_id]


def test_the_last_stage_keeps_ids(spark):
    docs = spark.createDataFrame([(1, "some words", "en", "s", 10), (2, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert all(len(x.ids) == 4 * x.length > 0 for x in C.pack(spark, docs, "").collect())


def test_run(spark, sf_dir):
    got = C.run(spark, sf_dir).toPandas()
    assert len(got) and set(got.columns) >= {"doc_id", "sequence_id", "offset", "length"}
    assert len(C.STAGES) == 5 and N.SIMILAR == 0.8
