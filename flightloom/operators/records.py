"""Assessment records and texts about them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that are removed from public texts, and what stands for them and for no text.
REDACTED = ["reasoning_chain", "chain_of_thought", "thought", "scratchpad", "internal_reasoning", "private_reasoning"]
REDACTED_MARK, NO_TEXT = "[redacted_forbidden_token]", "not_available"


def build_records(decided: DataFrame, missions: DataFrame | None = None) -> DataFrame:
    """One record a mission: ids, time of creation as ISO text, and the decision's fields. Without ``missions``, ``decided`` has the ids and the time itself."""
    held = decided if missions is None else decided.join(missions.select("mission_id", "mission_user_id", "mission_profile_id", "created_at"), "mission_id")
    return held.select(F.concat(F.lit("assessment_"), F.col("mission_id").cast("string")).alias("assessment_id"), F.col("mission_user_id").alias("user_id"), F.col("mission_profile_id").alias("profile_id"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "final_decision", "decision_score", "confidence_level")


def list_assessments(records: DataFrame, user: str, profile: str | None = None) -> DataFrame:
    """A user's records, newest first, with a summary ``decision (score)``; only the user's part of a partitioned table is read."""
    held = records.where(F.col("user_id") == user)
    held = held if profile is None else held.where(F.col("profile_id") == profile)
    summary = F.concat("final_decision", F.lit(" ("), F.format_string("%.3f", F.col("decision_score") + 1e-9), F.lit(")"))
    return held.select("assessment_id", "profile_id", "created_at", summary.alias("summary")).orderBy(F.desc("created_at"), "assessment_id")


def redact_text(text: Column, limit: int = 360) -> Column:
    """White space collapsed, words of REDACTED replaced (the text is then lower case), cut to ``limit`` characters with dots; a null or empty text is NO_TEXT.

    All words are replaced, longer ones first, so none is left where several occur.
    """
    words = "|".join(sorted(REDACTED, key=len, reverse=True))
    def cleaned(t: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.coalesce(t, F.lit(NO_TEXT)), r"\s+", " "))
        held = once(plain, lambda x: F.when(F.lower(x).rlike(words), F.regexp_replace(F.lower(x), words, REDACTED_MARK)).otherwise(x))
        return once(held, lambda x: F.when(x == "", NO_TEXT).when(F.length(x) > limit, F.concat(F.rtrim(F.substring(x, 1, limit - 3)), F.lit("..."))).otherwise(x))

    return once(text, lambda t: F.when(is_clean(t, limit), t).otherwise(cleaned(t)))


def is_clean(text: Column, limit: int = 360) -> Column:
    """Whether redact_text surely leaves a text as it is: printable ASCII without a space to drop or a word of REDACTED, which one search finds out; null of null."""
    words = f"(?i:(?=[{''.join(sorted({x[0] for x in REDACTED}))}])(?:{'|'.join(REDACTED)}))"
    return (text != "") & (F.length(text) <= limit) & ~text.rlike(f"^ | $|  |[^ -~]|{words}")


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, also inside a lambda, where repeated expressions are evaluated each time."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def narrative_conflicts(narratives: DataFrame, decided: DataFrame) -> DataFrame:
    """(mission_id, code) where the score, confidence or decision that a narrative names first differs from the stored one; a score within 0.02 agrees."""
    held = narratives.join(decided.select("mission_id", "decision_score", "confidence_level", "final_decision"), "mission_id")
    text = F.col("narrative")
    # The three patterns of what a narrative names.
    score = F.regexp_extract(text, r"(?i)decision\s*score[^0-9]*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    level = F.lower(F.regexp_extract(text, r"(?i)confidence(?:\s*level)?[^a-z]*(low|medium|high)", 1))
    word = F.regexp_replace(F.lower(F.regexp_extract(text, r"(?i)final\s+decision\s+(?:is|=)?\s*(go|caution|no[_\s-]?go)", 1)), r"[_\s]", "-")
    said = lambda x, want: (x != "") & (x != want)
    codes = F.array_compact(
        F.array(
            F.when(F.abs(score - F.col("decision_score")) > 0.02, F.lit("score_mismatch")),
            F.when(said(level, F.lower("confidence_level")), F.lit("confidence_mismatch")),
            F.when(said(word, F.regexp_replace(F.lower("final_decision"), "_", "-")), F.lit("decision_mismatch")),
        )
    )
    return held.select("mission_id", F.explode(codes).alias("code"))


def unknown_references(refs: DataFrame, known: DataFrame) -> DataFrame:
    """(mission_id, ref) of references that no known id answers."""
    return refs.join(known, ["mission_id", "ref"], "left_anti").select("mission_id", "ref").distinct()


def profile_context(profiles: DataFrame) -> DataFrame:
    """Capability flags of a profile, and its sensors in order of name."""
    sensors = F.array_sort(F.array_compact(F.array(*(F.when(F.col(f"uav_sensors_{x}") == 1, F.lit(x)) for x in ("gnss", "lidar", "radar", "camera_rgb", "camera_thermal")))))
    return profiles.select("profile_id", "runway_capable", "swarm_capable", F.array_join(sensors, ",").alias("sensors"))


def dedupe_actions(actions: DataFrame) -> DataFrame:
    """Actions of a mission, the first (at_place) of each summary, white space and case aside."""
    plain = F.lower(F.trim(F.regexp_replace("summary", r"\s+", " ")))
    order = F.row_number().over(Window.partitionBy("mission_id", "plain").orderBy("at_place"))
    return actions.withColumn("plain", plain).withColumn("n", order).where("n = 1").select("mission_id", "at_place", "summary")
