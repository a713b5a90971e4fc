"""Drug and lab safety alerts: rule table first, built-in fallback second."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxweave.functions.payloads import render_alert
from rxweave.functions.text import strip
from rxweave.refdata import safety_rules as S
from rxweave.refdata import tables

ALERT_COLUMNS = ["drug_name", "analyte_name", "severity", "description", "val_detected", "ref_range", "management"]


def active_rules(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("is_enabled") & ~F.col("is_deleted"))


def rule_predicate(value: Column, flag: Column) -> Column:
    """Does a value (or its flag) fulfil the rule columns beside it?"""
    op, low, high = F.trim("operator"), F.col("threshold_value"), F.col("threshold_value_max")
    by_value = (
        F.when(op == ">", value > low).when(op == "<", value < low)
        .when(op == ">=", value >= low).when(op == "<=", value <= low)
        .when(op == "=", value == low).when(op == "between", (value >= low) & (value <= high))
        .otherwise(False)
    )
    by_flag = F.lower(flag) == F.lower("flag_match")
    has_operator = F.coalesce(F.col("operator"), F.lit("")) != ""
    return F.coalesce(F.when(has_operator, by_value).otherwise(by_flag), F.lit(False))


def gender_band(band: Column, ref_range: Column) -> Column:
    """Rules for women fit ranges with the female mark, rules for men the
    others (and unknown ranges), rules for both fit all."""
    female = F.coalesce(ref_range, F.lit("")).contains(S.FEMALE_RANGE_MARK)
    wanted = F.coalesce(band, F.lit(S.DEFAULT_GENDER))
    return F.when(wanted == "female", female).when(wanted == "male", ~female).otherwise(True)


def dynamic_alerts(drugs: DataFrame, latest: DataFrame, rules: DataFrame, keys: tuple = ("patient_id",)) -> DataFrame:
    """Alerts of the rule table. ``drugs`` holds distinct (keys, INN); the keys
    include the patient."""
    active = active_rules(rules).withColumn("inn", F.lower("drug_inn")).withColumn("analyte_name", F.upper("analyte_name"))
    labs = latest.select("patient_id", "analyte_name", "value", "unit", "lab_range", "lab_flag")
    hits = (
        drugs.join(active.withColumnRenamed("severity", "rule_severity"), "inn")
        .join(labs, ["patient_id", "analyte_name"])
        .where(gender_band(F.col("gender_specific"), F.col("lab_range")) & rule_predicate(F.col("value"), F.col("lab_flag")))
    )
    unit = F.coalesce("unit", F.lit(""))
    return hits.select(
        *keys, F.initcap("drug_inn").alias("drug_name"), "analyte_name",
        F.coalesce("rule_severity", F.lit(S.DEFAULT_SEVERITY)).alias("severity"),
        render_alert(F.col("description_template"), F.col("value"), unit, F.col("threshold_value")).alias("description"),
        strip(F.concat(F.format_string("%.2f", "value"), F.lit(" "), unit)).alias("val_detected"),
        F.coalesce("lab_range", F.lit("")).alias("ref_range"), F.col("management_plan").alias("management"), "rule_name")


def handled_pairs(rules: DataFrame) -> DataFrame:
    """(drug, analyte) pairs that an active rule covers, whether it fires or not."""
    return active_rules(rules).select(F.lower("drug_inn").alias("inn"), F.upper("analyte_name").alias("analyte_name")).distinct()


def rule_inns(rules: DataFrame) -> DataFrame:
    """Drugs that any active or fallback rule names."""
    return handled_pairs(rules).select("inn").unionByName(tables.fallback_drugs(rules.sparkSession).select("inn")).distinct()


def fallback_drug_hits(drugs: DataFrame, keys: tuple = ("patient_id",)) -> DataFrame:
    """Per patient and fallback rule: the first drug of the rule's set."""
    sets = F.broadcast(tables.fallback_drugs(drugs.sparkSession))
    return drugs.join(sets, "inn").groupBy(*keys, "rule_id").agg(F.min("inn").alias("inn"))


def fallback_alerts(drugs: DataFrame, latest: DataFrame, rules: DataFrame, keys: tuple = ("patient_id",)) -> DataFrame:
    """At most one alert per patient and fallback rule, left out when its drug
    and analyte are handled by the rule table."""
    spark = drugs.sparkSession
    value = F.col("value")
    bound = lambda column, test: F.col(column).isNull() | test
    holds = (
        bound("gt", value > F.col("gt")) & bound("ge", value >= F.col("ge"))
        & bound("lt", value < F.col("lt")) & bound("le", value <= F.col("le"))
        & gender_band(F.col("band"), F.col("lab_range"))
    )
    labs = latest.select("patient_id", "analyte_name", "value", "unit", "lab_range")
    # rules × their outcomes is a join on rule_id with a code-defined table
    hits = (
        fallback_drug_hits(drugs, keys)
        .join(F.broadcast(tables.fallback_rules(spark)), "rule_id")
        .join(labs, ["patient_id", "analyte_name"]).where(holds)
    )
    chosen = hits.groupBy(*keys, "rule_id").agg(F.min_by(F.struct(
        "inn", "analyte_name", "severity", "value", "unit", "lab_range", "decimals", "default_unit",
        "default_range", "description_template", "value_template", "management"), "branch").alias("h"))
    allowed = chosen.select(*keys, "rule_id", "h.*").join(handled_pairs(rules), ["inn", "analyte_name"], "left_anti")
    unit = F.coalesce(F.nullif(F.col("unit"), F.lit("")), F.col("default_unit"))
    shown = F.when(F.col("decimals") == 1, F.format_string("%.1f", value)).otherwise(F.format_string("%.2f", value))
    drug = F.initcap("inn")

    def fill(template: str) -> Column:
        text = F.replace(F.col(template), F.lit("{value}"), shown)
        return F.replace(F.replace(text, F.lit("{unit}"), unit), F.lit("{drug}"), drug)

    return allowed.select(
        *keys, drug.alias("drug_name"), "analyte_name", "severity", fill("description_template").alias("description"),
        fill("value_template").alias("val_detected"),
        F.coalesce(F.nullif(F.col("lab_range"), F.lit("")), F.col("default_range")).alias("ref_range"),
        "management", "rule_id")


def for_alerts(latest: DataFrame) -> DataFrame:
    """Latest labs with the column names the alert joins use."""
    return latest.withColumnRenamed("ref_range", "lab_range").withColumnRenamed("flag", "lab_flag")


def safety_alerts(drugs: DataFrame, latest_labs: DataFrame, rules: DataFrame, keys: tuple = ("patient_id",)) -> DataFrame:
    latest = for_alerts(latest_labs)
    return dynamic_alerts(drugs, latest, rules, keys).select(*keys, *ALERT_COLUMNS).unionByName(
        fallback_alerts(drugs, latest, rules, keys).select(*keys, *ALERT_COLUMNS))
