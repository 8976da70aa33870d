"""Reports: lines are made in a mission's row, so none is shuffled; tables and rows give the same; numbers and cleaned texts against plain Python."""

import re

from pyspark.sql import functions as F

from flightloom.operators import records as K
from flightloom.operators import reports as R
from flightloom.plans import all_queries
from flightloom.plans.report_queries import report_rows

QUERIES = all_queries()[0]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_no_line_is_shuffled_or_sorted(spark, sf_dir):
    for name in ("report_lines", "render_markdown"):
        plan = plan_of(QUERIES[name](spark, sf_dir))
        assert "Window" not in plan and "Union" not in plan and "Aggregate" not in plan[: plan.index("Exchange")]


def test_reports_of_tables_equal_those_of_rows(spark, sf_dir):
    rows = report_rows(spark, sf_dir).where("mission_id % 30 < 3 AND mission_id < 400").cache()
    tables = {x: rows.select("mission_id", F.explode(x).alias("x")).select("mission_id", "x.*").repartition(3) for x in R.MANY}
    own = ["mission_id", "scenario", "profile", "operator_notes", "predicted_class", "probabilities", "raw_feature_count", "attributions"]
    decided = rows.drop(*own[1:], *R.MANY)
    found = {x[:3]: x[3] for x in rows_of(R.report_lines(rows))}
    assert len(found) > 3000 and found == {x[:3]: x[3] for x in rows_of(R.report_lines(rows.select(own), decided, **tables))}
    documents = rows_of(R.render_reports(rows))
    assert documents == rows_of(R.render_markdown(spark.createDataFrame([(*k, v) for k, v in found.items()], "mission_id long, section_no int, line_no int, line string")))


def test_lines_of_tables_that_lack_a_mission(spark):
    missions = spark.createDataFrame([(1, "note"), (None, None)], "mission_id long, operator_notes string")
    decided = spark.createDataFrame([(1, "go", ["a", None, "b"]), (2, None, None)], "mission_id long, final_decision string, decision_reasons array<string>")
    steps = spark.createDataFrame([(3, 2, "late"), (3, 1, "early"), (None, 1, "x"), (1, 1, None)], "mission_id long, place int, tool string")
    found = {x[:3]: x[3] for x in rows_of(R.report_lines(missions, decided, steps=steps))}
    assert {x[:2] for x in found} == {(1, i) for i in range(1, 12)} | {(2, i) for i in (1, 5, 6, 7, 8, 9, 10, 11)} | {(3, 10), (None, 2), (None, 3), (None, 4), (None, 10)}
    assert [found[3, 10, i] for i in (1, 4)] == ["tool_step[1] tool=early status=None: ", "tool_step[2] tool=late status=None: "]
    assert [x for (m, no, _), x in sorted(found.items(), key=str) if (m, no) == (1, 1) and "reason" in x] == ["executive_decision_reason: a", "executive_decision_reason: b"]


def test_numbers_print_as_by_format_string(spark):
    held = [0.0, -0.0, 0.5, 1.0, 0.1234565, 0.123456499, 1e-7, 4.9e-7, -1e-7, -2.5, 99999999999.25, 1e11, 1e15, 1e300, 0.1 + 0.2, 2 / 3, 100.0, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(x,) for x in held], "x double")
    long = F.regexp_replace(F.format_string("%.6f", F.col("x") + 1e-9), "0+$", "")
    want = F.when(F.col("x").isNotNull(), F.when(long.endswith("."), F.concat(long, F.lit("0"))).otherwise(long))
    for got, six, two, plain in df.select(R.number(F.col("x")), want, R.decimals(F.col("x"), 2), F.format_string("%.2f", F.col("x") + 1e-9)).collect():
        assert got == six and two == plain


def test_clean_texts_stay_as_they_are(spark):
    texts = ["a b", " a", "a ", "a  b", "a\tb", "a\n", "é", "K", "", None, "a|b", "THOUGHT", "my thoughts here", "Scratchpad", "reason", "x" * 20, "x" * 21, "private_Reasoning", "tho ught", "~", "\x7f", "\x00"]
    words = "|".join(sorted(K.REDACTED, key=len, reverse=True))

    def cleaned(t):
        t = re.sub(r"[ \t\n\x0b\f\r]+", " ", K.NO_TEXT if t is None else t).strip(" ")
        t = re.sub(words, K.REDACTED_MARK, t.lower()) if re.search(words, t.lower()) else t
        return K.NO_TEXT if t == "" else t[:17].rstrip(" ") + "..." if len(t) > 20 else t

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", K.redact_text(F.col("t"), 20), K.is_clean(F.col("t"), 20)).collect()
    assert [x[1] for x in rows] == [cleaned(t) for t in texts]
    assert all(x[1] == x[0] for x in rows if x[2]) and sum(bool(x[2]) for x in rows) == 6


def test_a_map_with_one_odd_value_is_cleaned(spark):
    rows = [(1, {"a": "x", "b": "1.5"}), (2, {"a": "x  y", "b": None}), (3, {"a": "", "b": "a thought"}), (4, {"a": "p||q"}), (5, None)]
    lines = R.report_lines(spark.createDataFrame(rows, "mission_id long, scenario map<string,string>")).where("section_no = 2 AND line LIKE 'scenario[%'").orderBy("mission_id", "line_no")
    assert [x.line for x in lines.collect()] == ["scenario[a]: x", "scenario[b]: 1.5", "scenario[a]: x y", "scenario[b]: not_available", "scenario[a]: not_available", f"scenario[b]: a {K.REDACTED_MARK}", "scenario[a]: p||q"]
