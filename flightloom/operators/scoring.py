"""Risk scoring: pluggable models, risk from class probabilities, attributions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of each class in the risk score, and the advice that goes with it.
CLASS_WEIGHT, OTHER_WEIGHT = {"High Risk": 1.0, "Medium Risk": 0.5, "Low Risk": 0.0}, 0.5
ADVICE = {"High Risk": "NO-GO", "Medium Risk": "CONDITIONAL-GO", "Low Risk": "GO"}


def score_missions(features: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], classes: list[str], key: str = "mission_id") -> DataFrame:
    """key and one probability a class by a fitted model that maps a batch of feature rows to a batch of probabilities, in Arrow batches."""

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            out = model(x.drop(columns=[key]))[classes]
            out.insert(0, key, x[key].to_numpy())
            yield out

    return features.mapInPandas(score, f"{key} long, " + ", ".join(f"`{c}` double" for c in classes))


def class_weight(name: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for k, v in CLASS_WEIGHT.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def best_class(probabilities: Column) -> Column:
    """Most likely class; ties go to the name that comes first."""
    entries = F.array_sort(F.map_entries(probabilities))
    return F.aggregate(entries, F.struct(F.lit(None).cast("string").alias("key"), F.lit(-1.0).alias("value")), lambda a, e: F.when(e["value"] > a["value"], F.struct(e["key"].alias("key"), e["value"].alias("value"))).otherwise(a))["key"]


def weighted_risk(probabilities: Column) -> Column:
    """Sum of probability times class weight, to four places; what lies within 1e-9 of a half goes up, so that the order of sums plays no part."""
    return F.round(F.lit(1e-9) + F.aggregate(F.map_entries(probabilities), F.lit(0.0), lambda s, e: s + e["value"] * class_weight(e["key"])), 4)


def risk_from_probabilities(df: DataFrame, probabilities: str = "probabilities", key: str = "mission_id") -> DataFrame:
    """Risk score, confidence, class and advice; a class without advice counts as Medium."""
    held = df.select(key, weighted_risk(F.col(probabilities)).alias("risk_score"), F.array_max(F.map_values(probabilities)).alias("confidence"), best_class(F.col(probabilities)).alias("predicted_class"))
    advice = F.lit(ADVICE["Medium Risk"])
    for k, v in ADVICE.items():
        advice = F.when(F.col("predicted_class") == k, v).otherwise(advice)
    return held.withColumn("advice", advice)


def check_probability_bounds(scored: DataFrame, probabilities: str = "probabilities", key: str = "mission_id", tolerance: float = 1e-4) -> DataFrame:
    """Rows whose score or confidence leaves [0, 1], or whose probabilities don't sum to 1."""
    total = F.aggregate(F.map_values(probabilities), F.lit(0.0), lambda s, x: s + x)
    return scored.withColumn("total", total).where(~F.col("risk_score").between(0, 1) | ~F.col("confidence").between(0, 1) | (F.abs(F.col("total") - 1) > tolerance)).select(key, "risk_score", "confidence", "total")


def recalibrate_class(df: DataFrame, target: str, probabilities: str = "probabilities", key: str = "mission_id") -> DataFrame:
    """Move rows to the target class: if the class of a row is more likely, the two probabilities change places; the row is scored anew."""
    own = F.coalesce(F.try_element_at("p", F.lit(target)), F.lit(0.0))
    held = df.select(key, F.col(probabilities).alias("p")).select(key, "p", best_class(F.col("p")).alias("old"), F.array_max(F.map_values("p")).alias("top"), own.alias("own"))
    moved = held.select(key, F.transform_values("p", lambda k, v: F.when(k == target, F.col("top")).when(k == F.col("old"), F.col("own")).otherwise(v)).alias("p"))
    return moved.select(key, F.lit(target).alias("predicted_class"), weighted_risk(F.col("p")).alias("risk_score"), F.element_at("p", F.lit(target)).alias("confidence"))


def hash_feature_vector(features: DataFrame, columns: list[str], key: str = "mission_id") -> DataFrame:
    """First 12 hex digits of the sha256 of the columns' texts, for lineage."""
    return features.select(key, F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns)), 256), 1, 12).alias("vector_hash"))


def linear_contributions(features: DataFrame, weights: dict[str, tuple[float, float]], key: str = "mission_id") -> DataFrame:
    """key, feature, value, contribution = coefficient * (value - mean); ``weights`` has (coefficient, mean) by feature."""
    long = features.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), ((F.col(f) - m) * c).alias("contribution")) for f, (c, m) in weights.items()))).alias("x"))
    return long.select(key, "x.feature", "x.value", "x.contribution")


def direction(value: Column, predicted: Column) -> Column:
    """What a contribution does to the risk, given the class that it speaks for."""
    up = value > 0
    return (
        F.when(predicted == "Low Risk", F.when(up, "decreases_risk").otherwise("increases_risk"))
        .when(predicted == "High Risk", F.when(up, "increases_risk").otherwise("decreases_risk"))
        .otherwise(F.when(up, "stabilizes_medium_risk").otherwise("shifts_away_from_medium"))
    )


def top_attributions(contributions: DataFrame, n: int = 10, key: str = "mission_id") -> DataFrame:
    """The n contributions of a mission that weigh most, ranked, ties by feature name. Rows carry predicted_class."""
    ranked = F.row_number().over(Window.partitionBy(key).orderBy(F.abs("contribution").desc(), "feature"))
    return contributions.withColumn("rank", ranked).where(F.col("rank") <= n).select(key, "rank", "feature", "value", "contribution", direction(F.col("contribution"), F.col("predicted_class")).alias("direction"))


def top_contributions(features: DataFrame, weights: dict[str, tuple[float, float]], predicted: Column, n: int = 10, key: str = "mission_id") -> DataFrame:
    """top_attributions(linear_contributions(...)) in one pass: a row's contributions are sorted and cut as an array, so nothing is shuffled."""
    each = F.array(*(F.struct((-F.abs((F.col(f) - m) * c)).alias("order"), F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"), ((F.col(f) - m) * c).alias("contribution")) for f, (c, m) in weights.items()))
    rows = features.select(key, predicted.alias("_predicted"), F.posexplode(F.slice(F.array_sort(each), 1, n)).alias("_at", "x"))
    return rows.select(key, (F.col("_at") + 1).alias("rank"), "x.feature", "x.value", "x.contribution", direction(F.col("x.contribution"), F.col("_predicted")).alias("direction"))


def deviation_report(features: DataFrame, columns: list[str], reference: dict[str, float], row: int, n: int = 12, key: str = "mission_id") -> DataFrame:
    """The n columns in which one row lies farthest from a reference row, in population deviations of the column; columns without spread are left out."""
    spread = features.agg(*(F.stddev_pop(c).alias(c) for c in columns), *(F.max(F.when(F.col(key) == row, F.col(c))).alias(f"own_{c}") for c in columns))
    long = spread.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"own_{c}").cast("double").alias("value"), F.lit(float(reference[c])).alias("reference"), F.col(c).alias("spread")) for c in columns))).alias("x")).select("x.*")
    return long.where("spread > 0").select("feature", "value", "reference", (F.abs(F.col("value") - F.col("reference")) / F.col("spread")).alias("deviation")).orderBy(F.desc("deviation"), "feature").limit(n)


def golden_check(scored: DataFrame, golden: DataFrame, key: str = "mission_id") -> DataFrame:
    """key, expected, predicted_class, confidence and passed: the label is right and confidence reaches the golden row's least."""
    return scored.join(golden, key).select(key, "expected", "predicted_class", "confidence", ((F.col("expected") == F.col("predicted_class")) & (F.col("confidence") >= F.col("least_confidence"))).alias("passed"))
