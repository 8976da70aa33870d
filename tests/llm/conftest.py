import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, key string, uid long"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """The small table, and rows that are null, empty, long, repeated, and wordless; with columns whose names operators use themselves."""
    extra = [
        (90001, None), (90002, ""), (90003, " \n\t "), (90004, "!!! ... ???"), (90005, "two words"), (90006, "two words"),
        (90007, "lang wort " * 20_000), (90008, "x" * 150_000), (90009, "naïve café 日本語   z y"), (None, "a row without an id of its own"),
        (90010, "said twice in full"), (90010, "said twice in full"), (90011, "@@@ 1.2.3 +1 9999 a@b 300.1.1.1"), (90012, "mail x@y.org now"),
    ]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(a, b, "en", "odd", 0) for a, b in extra], rows.schema)
    return rows.unionByName(odd).selectExpr("*", "0.5D AS score", "1 AS label", "'k' AS key", "7L AS uid").cache()


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)


@pytest.fixture(scope="session")
def rows(documents):
    """The documents in plain Python, in no order."""
    return [(x.doc_id, x.text) for x in documents.select("doc_id", "text").collect()]
