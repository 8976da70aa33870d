"""What a mission asks of the corpus: risk levels, query texts, scenario classes, complexity; and what past queries teach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds (warning, critical, emergency; low_warning, low_critical) and query parts by level.
THRESHOLDS = {
    "wind_speed_kt": (15, 25, 35, None, None),
    "flight_altitude_m": (120, 400, 500, None, None),
    "temperature_c": (40, 50, 60, -10, -20),
    "visibility_km": (3, 1, 0.5, None, None),
    "precipitation_mm": (1, 5, 10, None, None),
    "obstacle_proximity_m": (50, 20, 10, None, None),
    "battery_capacity_mah": (20, 10, 5, None, None),
    "communication_range_km": (2, 1, 0.5, None, None),
    "population_density": (100, 1000, 10000, None, None),
    "gps_quality": (8, 5, 3, None, None),
    "rc_link_quality": (70, 50, 30, None, None),
    "humidity_percent": (80, 90, 95, None, None),
}
SUFFIX = {
    "emergency": "emergency critical severe danger immediate action required",
    "critical": "critical high risk danger safety limit exceeded",
    "warning": "warning caution elevated risk approaching limit",
    "low": "normal operation standard procedure",
}
PRIORITY = {"low": 3, "warning": 6, "critical": 9, "emergency": 10}
CRITICAL_PARAMETERS = "flight_altitude_m wind_speed_kt obstacle_proximity_m battery_capacity_mah communication_range_km".split()
PRIORITY_LIMITS = {"wind_speed_kt": 25, "flight_altitude_m": 400, "obstacle_proximity_m": 20, "battery_capacity_mah": 10, "communication_range_km": 1, "gps_quality": 5, "rc_link_quality": 50}

PRIORITY_FLAGS = ["emergency_procedure_available", "flight_termination_system", "parachute_equipped", "system_redundancy_level"]


def threshold_rows(spark) -> DataFrame:
    return spark.createDataFrame([(k, *(None if x is None else float(x) for x in v)) for k, v in THRESHOLDS.items()], "feature string, warning double, critical double, emergency double, low_warning double, low_critical double")


def feature_risk_levels(features: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds risk_level to (mission_id, feature, value): the high bounds from the gravest down, then the low ones."""
    v = F.col("value")
    level = F.when(v >= F.col("emergency"), "emergency").when(v >= F.col("critical"), "critical").when(v >= F.col("warning"), "warning").when(v <= F.col("low_critical"), "critical").when(v <= F.col("low_warning"), "warning").otherwise("low")
    return features.join(thresholds, "feature", "left").select("mission_id", "feature", "value", level.alias("risk_level"))


def chosen(value: Column, table: dict[str, object]) -> Column:
    out = F.lit(None)
    for k, held in table.items():
        out = F.when(value == k, held).otherwise(out)
    return out


def feature_queries(levels: DataFrame, phrases: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """mission_id, at_place, feature, query_text, priority: the gravest first, ties by feature name.

    ``phrases`` has (feature, phrase); a feature without one is asked for by its name. ``weights`` has attributions
    (mission_id, feature, weight), which raise the priority.
    """
    held = levels.join(phrases, "feature", "left")
    text = F.concat_ws(" ", F.coalesce("phrase", F.regexp_replace("feature", "_", " ")), chosen(F.col("risk_level"), SUFFIX))
    priority = F.least(F.lit(10), chosen(F.col("risk_level"), PRIORITY) + F.when(F.col("feature").isin(CRITICAL_PARAMETERS), 1).otherwise(0))
    if weights is not None:
        held = held.join(weights, ["mission_id", "feature"], "left")
        priority = F.least(F.lit(10), priority + F.floor(F.least(F.lit(2.0), F.abs(F.coalesce("weight", F.lit(0.0))) * 10) + 1e-9))
    made = held.select("mission_id", "feature", text.alias("query_text"), priority.cast("int").alias("priority"))
    return made.withColumn("at_place", F.row_number().over(Window.partitionBy("mission_id").orderBy(F.desc("priority"), "feature")))


def query_batches(queries: DataFrame, size: int = 10) -> DataFrame:
    return queries.withColumn("batch", F.floor((F.col("at_place") - 1) / size).cast("int"))


def classify_scenarios(df: DataFrame, key: str = "mission_id") -> DataFrame:
    """First rule that fits: emergency flags, weather, regulation, battery, kind of operation."""
    c, kind = F.col, F.lower(F.coalesce("operation_type", F.lit("")))
    flags = F.coalesce(c("emergency_procedure_available"), F.lit(False)) | F.coalesce(c("flight_termination_system"), F.lit(False)) | F.coalesce(c("e_stop_functional"), F.lit(False))
    rules = F.when(flags, "emergency_response").when((F.coalesce(c("wind_speed_kt"), F.lit(0.0)) > 20) | (F.coalesce(c("precipitation_mm"), F.lit(0.0)) > 5), "adverse_weather")
    given = lambda x: F.coalesce(~c(x).cast("string").isin("", "false", "0", "0.0"), F.lit(False))
    rules = rules.when(given("airspace_class") | given("operational_authorization") | given("geo_fence_status"), "regulatory_compliance").when(F.coalesce(c("battery_capacity_mah"), F.lit(100.0)) < 20, "technical_degradation")
    for word in ("survey", "delivery", "inspection"):
        rules = rules.when(kind.contains(word), f"{word}_mission")
    return df.select(key, rules.otherwise("general_operation").alias("scenario_type"))


def scenario_complexity(df: DataFrame, key: str = "mission_id") -> DataFrame:
    """From (n_features, risk_flags, notes, variance), at most 1."""
    words = F.size(F.filter(F.split(F.coalesce("notes", F.lit("")), r"\s+"), lambda t: t != ""))
    score = F.least(F.lit(0.3), F.col("n_features") / 200) + 0.15 * F.col("risk_flags") + F.least(F.lit(0.2), words / 100) + F.least(F.lit(0.2), F.coalesce("variance", F.lit(0.0)))
    return df.select(key, F.least(F.lit(1.0), score).alias("complexity"))


def priority_features(df: DataFrame, key: str = "mission_id") -> DataFrame:
    """Names, in order, whose value doesn't exceed its limit, then flags that are false (a number of 0 is)."""
    low = [F.when(F.col(k) <= v, F.lit(k)) for k, v in PRIORITY_LIMITS.items()]
    off = [F.when(F.col(k).cast("double") == 0, F.lit(k)) for k in PRIORITY_FLAGS]
    return df.select(key, F.array_compact(F.array(*low, *off)).alias("priority_features"))


def risk_indicators(df: DataFrame, key: str = "mission_id") -> DataFrame:
    """Readable texts of five exceedances, in order."""
    show = lambda c: F.col(c).cast("string")
    each = [
        F.when(F.col("wind_speed_kt") > 20, F.concat(F.lit("High wind: "), show("wind_speed_kt"), F.lit(" kt"))),
        F.when(F.col("flight_altitude_m") > 400, F.concat(F.lit("High altitude: "), show("flight_altitude_m"), F.lit(" m"))),
        F.when(F.col("obstacle_proximity_m") < 30, F.concat(F.lit("Close obstacle: "), show("obstacle_proximity_m"), F.lit(" m"))),
        F.when(F.col("battery_capacity_mah") < 15, F.concat(F.lit("Low battery: "), show("battery_capacity_mah"), F.lit("%"))),
        F.when(F.col("population_density") > 1000, F.concat(F.lit("Dense population: "), show("population_density"), F.lit("/km²"))),
    ]
    return df.select(key, F.array_compact(F.array(*each)).alias("indicators"))


def hyde_decision(df: DataFrame, learned: DataFrame, key: str = "mission_id") -> DataFrame:
    """Whether to widen a query: what was learned of its scenario type if enough, else by complexity and type."""
    c = F.col
    held = df.join(learned, "scenario_type", "left")
    sure = F.when((c("query_count") > 5) & (c("hyde_success_rate") > 0.6), True).when((c("query_count") > 5) & (c("hyde_success_rate") < 0.3), False)
    rest = ((c("complexity") > 0.5) & (F.length(F.coalesce("notes", F.lit(""))) > 0)) | (c("scenario_type") == "emergency_response") | (c("complexity") > 0.4)
    return held.select(key, F.coalesce(sure, rest).alias("use_hyde"))


def history_stats(history: DataFrame) -> DataFrame:
    """Per scenario type: queries, mean top score and share of widened queries, to three places."""
    return history.groupBy("scenario_type").agg(F.count("*").alias("query_count"), F.round(F.avg("top_score") + 1e-12, 3).alias("avg_top_score"), F.round(F.avg(F.col("used_hyde").cast("double")) + 1e-12, 3).alias("hyde_success_rate"))


def recent_history(log: DataFrame, n: int = 1000) -> DataFrame:
    """The last n entries."""
    return log.orderBy(F.desc("timestamp"), F.desc("entry_id")).limit(n)


def search_log(log: DataFrame, pattern: str, scenario_type: str | None = None, limit: int = 50) -> DataFrame:
    """Entries whose query holds the pattern in any case, newest first."""
    held = log.where(F.lower("query").contains(pattern.lower()))
    held = held if scenario_type is None else held.where(F.col("scenario_type") == scenario_type)
    return held.orderBy(F.desc("timestamp"), F.desc("entry_id")).limit(limit)
