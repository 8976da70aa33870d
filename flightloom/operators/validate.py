"""Validation: issue rows from rules over one joined row, hard vetoes, blocked missions, data-quality records.

Rules are plain SQL conditions; a row's issues are one array column, built in one pass without a shuffle, and only
rows with issues are exploded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightloom import schemas as S

#: Texts that stand for a missing number, and for true and false.
NO_NUMBER = ["", "n/a", "unknown", "null", "none"]
TRUE_WORDS, FALSE_WORDS = ["true", "1", "yes", "y", "on"], ["false", "0", "no", "n", "off"]


@dataclass(frozen=True)
class Rule:
    code: str
    field: str
    message: str
    broken: str  # condition, in SQL


def parse_flexible_float(text: Column) -> Column:
    """Number of a text; null where it is blank, a word for missing or no number."""
    held = F.lower(F.trim(text))
    return F.when(~held.isin(NO_NUMBER), held.try_cast("double"))


def parse_flexible_bool(text: Column) -> Column:
    held = F.lower(F.trim(text))
    return F.when(held.isin(TRUE_WORDS), F.lit(True)).when(held.isin(FALSE_WORDS), F.lit(False))


def not_finite(name: str) -> str:
    """True for NaN, which orders above all numbers, and the infinities."""
    return f"NOT ({name} BETWEEN -1.7976931348623157E308 AND 1.7976931348623157E308)"


def missing(names: list[str], code: str) -> list[Rule]:
    return [Rule(code, x, f"Missing required raw field: {x}", f"{x} IS NULL") for x in names]


def category(name: str) -> Rule:
    allowed = ", ".join(f"'{v}'" for v in S.CATEGORIES[name])
    return Rule("INVALID_CATEGORY", name, f"Invalid category for {name}", f"{name} NOT IN ({allowed})")


def numeric(names: list[str], negative: list[str] = ()) -> list[Rule]:
    finite = [Rule("INVALID_NUMERIC", x, f"Field {x} must be a finite numeric scalar.", not_finite(x)) for x in names]
    return finite + [Rule("INVALID_NUMERIC", x, f"Field {x} must be non-negative.", f"{x} < 0 AND NOT ({not_finite(x)})") for x in names if x not in negative]


def boolean(names: list[str], what: str) -> list[Rule]:
    return [Rule("INVALID_BOOLEAN", x, f"{what} {x} must be boolean-like 0/1 or bool.", f"{x} NOT IN (0, 1)") for x in names]


# Codes, fields and messages of the rules, in order.
PROFILE_RULES = [
    *(Rule("MISSING_PROFILE_FIELD", x, f"Missing required profile identity field: {x}", f"{x} IS NULL") for x in S.PROFILE_IDENTITY),
    *missing(S.PROFILE_RAW, "MISSING_PROFILE_FIELD"),
    category("uav_energy_source"),
    *numeric(S.PROFILE_NUMERIC),
    *boolean(S.SENSORS, "Sensor flag"),
    *(Rule("INVALID_NUMERIC", x, f"Capability field {x} must be a non-negative finite number.", f"{not_finite(x)} OR {x} < 0") for x in ("max_payload_kg", "max_takeoff_mass_kg")),
    Rule("INVALID_NUMERIC", "max_swarm_size", "max_swarm_size must be an integer >= 1.", "max_swarm_size < 1"),
]
SCENARIO_RULES = [
    *missing(S.SCENARIO_RAW, "MISSING_SCENARIO_FIELD"),
    *map(category, ("mission_pattern", "controls_mode", "swarm_roles_first")),
    *numeric(S.SCENARIO_NUMERIC, S.MAY_BE_NEGATIVE),
    *boolean(S.FLAGS, "Field"),
    Rule("ALTITUDE_RANGE_INVALID", "airspace_altitude_agl_max_m", "Maximum AGL altitude must be greater than minimum AGL altitude.", f"airspace_altitude_agl_max_m <= airspace_altitude_agl_min_m AND NOT ({not_finite('airspace_altitude_agl_max_m')}) AND NOT ({not_finite('airspace_altitude_agl_min_m')})"),
]
IDENTITY_RULES = [
    Rule("MISSING_ASSESSMENT_FIELD", "user_id", "Missing assessment field: user_id", "mission_user_id IS NULL"),
    Rule("MISSING_ASSESSMENT_FIELD", "profile_id", "Missing assessment field: profile_id", "mission_profile_id IS NULL"),
    Rule("USER_ID_MISMATCH", "user_id", "Assessment user_id must match drone_profile.user_id.", "mission_user_id <> user_id"),
    Rule("PROFILE_ID_MISMATCH", "profile_id", "Assessment profile_id must match drone_profile.profile_id.", "mission_profile_id <> profile_id"),
]
VETO_RULES = [
    Rule("PAYLOAD_EXCEEDS_PROFILE_LIMIT", "uav_payload_mass_kg", "Payload mass exceeds profile max_payload_kg.", "uav_payload_mass_kg > max_payload_kg"),
    Rule("MASS_EXCEEDS_PROFILE_LIMIT", "uav_mass_kg", "UAV mass exceeds profile max_takeoff_mass_kg.", "uav_mass_kg > max_takeoff_mass_kg"),
    Rule("ALTITUDE_EXCEEDS_HOVER_CEILING", "airspace_altitude_agl_max_m", "Mission altitude exceeds profile hover ceiling.", "airspace_altitude_agl_max_m > uav_rotorcraft_hover_ceiling_m"),
    Rule("SWARM_NOT_CAPABLE", "swarm_enabled", "Swarm requested but profile is not swarm capable.", "swarm_enabled = 1 AND NOT swarm_capable"),
    Rule("SWARM_SIZE_EXCEEDS_PROFILE_LIMIT", "swarm_size", "Scenario swarm_size exceeds profile max_swarm_size.", "swarm_size > max_swarm_size"),
    Rule("RUNWAY_NOT_CAPABLE", "mission_runway_required", "Runway mission requested but profile is not runway capable.", "mission_runway_required = 1 AND NOT runway_capable"),
]


def issue_array(rules: list[Rule]) -> Column:
    """Issues of a row, in the order of the rules: only the broken rules' numbers are made up per row."""
    broken = F.array_compact(F.array(*(F.when(F.expr(r.broken), F.lit(i)) for i, r in enumerate(rules))))
    listed = F.array(*(F.struct(F.lit(r.code).alias("code"), F.lit(r.field).alias("field"), F.lit(r.message).alias("message")) for r in rules))
    return F.transform(broken, lambda i: F.get(listed, i))


def issue_rows(df: DataFrame, issues: Column, key: str = "mission_id") -> DataFrame:
    """(key, seq, code, field, message), seq from 1."""
    held = df.select(key, F.posexplode(issues).alias("at", "issue"))
    return held.select(key, (F.col("at") + 1).alias("seq"), "issue.code", "issue.field", "issue.message")


def validate_profiles(profiles: DataFrame, key: str = "profile_id") -> DataFrame:
    return issue_rows(profiles, issue_array(PROFILE_RULES), key)


def validate_scenarios(missions: DataFrame) -> DataFrame:
    return issue_rows(missions, issue_array(SCENARIO_RULES))


def validate_identity(joined: DataFrame) -> DataFrame:
    return issue_rows(joined, issue_array(IDENTITY_RULES))


def override_issue(key: Column, value: Column) -> Column:
    """The first broken rule of one override, or null."""
    made = lambda code, text: F.struct(F.lit(code).alias("code"), key.alias("field"), F.concat(F.lit(text), key).alias("message"))
    number = value.try_cast("double")
    finite = number.isNotNull() & number.between(-1.7976931348623157e308, 1.7976931348623157e308)
    return (
        F.when(key.isin(S.ONE_HOT), made("FORBIDDEN_PROCESSED_FEATURE", "Processed feature cannot be overridden: "))
        .when(key.isin(S.INTERNAL_ONLY), made("INTERNAL_ONLY_OVERRIDE", "Internal-only raw feature cannot be overridden: "))
        .when(key.isin(S.DROPPED_RAW), made("DROPPED_METADATA_OVERRIDE", "Dropped raw metadata cannot be overridden: "))
        .when(~key.isin(S.OVERRIDABLE), made("INVALID_OVERRIDE_KEY", "Unknown or non-overridable raw feature: "))
        .when((key == "controls_actions_first") & ~value.isin(S.CATEGORIES["controls_actions_first"]), made("INVALID_CATEGORY", "Invalid override of "))
        .when((key != "controls_actions_first") & ~finite, made("INVALID_NUMERIC", "Override must be a finite number: "))
    )


def override_issues(overrides: str = "overrides") -> Column:
    entries = F.array_sort(F.coalesce(F.map_entries(overrides), F.array().cast("array<struct<key:string,value:string>>")))
    return F.filter(F.transform(entries, lambda e: override_issue(e["key"], e["value"])), lambda x: x.isNotNull())


def validate_overrides(missions: DataFrame) -> DataFrame:
    """First broken rule of each override, keys in order."""
    return issue_rows(missions, override_issues())


def join_profiles(missions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Missions with their profile's columns. Spark broadcasts the profiles where they are small, else splits popular profiles at run time."""
    return missions.join(profiles, (missions["mission_user_id"] == profiles["user_id"]) & (missions["mission_profile_id"] == profiles["profile_id"]), "left")


def all_issues() -> Column:
    return F.concat(issue_array(IDENTITY_RULES[:2] + PROFILE_RULES), issue_array(SCENARIO_RULES), override_issues(), issue_array(IDENTITY_RULES[2:]), issue_array(VETO_RULES))


def any_issue(overrides: str = "overrides") -> Column:
    """Whether a row breaks any rule: the predicates alone, no issue is made up. One greatest() of them, which the optimiser neither turns into hundreds of conjuncts nor evaluates twice."""
    rules = IDENTITY_RULES + PROFILE_RULES + SCENARIO_RULES + VETO_RULES
    entries = F.coalesce(F.map_entries(overrides), F.array().cast("array<struct<key:string,value:string>>"))
    overridden = F.exists(entries, lambda e: override_issue(e["key"], e["value"]).isNotNull())
    return F.greatest(overridden, *(F.expr(f"coalesce({r.broken}, false)") for r in rules))


def structural_veto(missions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Issue rows of the veto rules that compare a mission with its profile; a null limit breaks no rule."""
    return issue_rows(join_profiles(missions, profiles), issue_array(VETO_RULES))


def split_blocked(missions: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Missions with an issue, as blocked rows with decision no_go, and the missions that go on."""
    held = issues.groupBy("mission_id").agg(F.sort_array(F.collect_list(F.struct("seq", "code"))).alias("listed"))
    blocked = missions.select("mission_id").join(held, "mission_id").select("mission_id", F.lit("blocked").alias("status"), F.lit("no_go").alias("final_decision"), F.size("listed").alias("n_issues"), F.concat_ws(",", F.transform("listed", lambda x: x["code"])).alias("codes"))
    return blocked, missions.join(issues.select("mission_id"), "mission_id", "left_anti")


def reject_extra_fields(rows: DataFrame, fields: list[str], key: str = "mission_id", payload: str = "payload") -> DataFrame:
    """(key, field) of the payload's keys that the closed contract doesn't know; payload is a JSON object."""
    parsed = rows.select(key, F.explode(F.map_keys(F.from_json(payload, "map<string,string>"))).alias("field"))
    known = rows.sparkSession.createDataFrame([(x,) for x in fields], "field string")
    return parsed.join(known, "field", "left_anti").select(key, "field")


def reject_processed_inputs(missions: DataFrame, overrides: str = "overrides") -> DataFrame:
    """(mission_id, field) of one-hot names that a user supplied."""
    return missions.select("mission_id", F.explode(F.filter(F.map_keys(overrides), lambda k: k.isin(S.ONE_HOT))).alias("field"))


#: Hard bounds of the older path, in order.
HARD_BOUNDS = {"uav_mass_kg": 25.0, "environment_weather_wind_mps": 15.0, "airspace_altitude_agl_max_m": 122.0}


def core_range_check(joined: DataFrame) -> DataFrame:
    """mission_id, passed and the first of the hard bounds that is reached."""
    broken = F.coalesce(*(F.when(F.col(x) >= top, F.lit(x)) for x, top in HARD_BOUNDS.items()))
    return joined.select("mission_id", broken.isNull().alias("passed"), broken.alias("violated"))
