"""Change feeds and constraint checks over the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxweave.operators.events import emit
from rxweave.operators.interactions import document_interactions
from rxweave.operators.medications import distinct_inns
from rxweave.operators.safety import rule_inns, safety_alerts
from rxweave.refdata import events as E



def apply_resolutions(feed: DataFrame, lines: DataFrame, queue: DataFrame, active: DataFrame, labs: DataFrame, rules: DataFrame) -> DataFrame:
    """Outcome of each reviewed prescription.

    ``feed``: item_id, patient_id, override_reason; ``lines``: item_id, inn;
    ``active``: the patients' current distinct drugs. Interactions are checked
    over new and current drugs, lab alerts over the new ones. A major
    interaction or critical alert without an override reason is rejected.
    """
    todo = feed.join(queue.where(~F.col("resolved") & (F.col("item_type") == "prescription")).select("item_id", "facility_id"), "item_id")
    new = distinct_inns(lines.join(todo.select("item_id"), "item_id", "left_semi"), "item_id")
    owners = todo.select("item_id", "patient_id").where(F.col("patient_id").isNotNull())
    found = document_interactions(todo.select("item_id", "patient_id").join(new, "item_id"), active, "item_id")
    major = found.groupBy("item_id").agg(F.bool_or(F.col("severity") == "major").alias("has_major"), F.count("*").alias("n_interactions"))
    alerts = safety_alerts(new.join(owners, "item_id"), labs, rules, ("item_id", "patient_id"))
    critical = alerts.groupBy("item_id").agg(F.bool_or(F.col("severity") == "critical").alias("has_critical"), F.count("*").alias("n_alerts"))
    joined = todo.join(major, "item_id", "left").join(critical, "item_id", "left").fillna(
        {"has_major": False, "has_critical": False, "n_interactions": 0, "n_alerts": 0})
    needs = F.col("has_major") | F.col("has_critical")
    blank = F.trim(F.coalesce("override_reason", F.lit(""))) == ""
    outcome = F.when(needs & blank, "rejected").otherwise("resolved")
    action = F.when(outcome == "rejected", F.lit(None)).when(needs, "override_safety").otherwise("resolve_rx")
    return joined.select(
        "item_id", "patient_id", "facility_id", "has_major", "has_critical", "n_interactions", "n_alerts", outcome.alias("outcome"),
        action.alias("audit_action"), (needs & ~blank).alias("needs_admin_oversight"), F.when(outcome == "resolved", F.lit(1.0)).alias("confidence"))


def apply_lab_resolutions(feed: DataFrame, queue: DataFrame, results: DataFrame, active: DataFrame, latest: DataFrame, rules: DataFrame) -> DataFrame:
    """Outcome of each reviewed lab report.

    ``results``: corrected rows item_id, analyte_name, value, unit, ref_range,
    flag. They become the newest value of their analyte, over the patients'
    current drugs.
    """
    todo = feed.join(queue.where(~F.col("resolved") & (F.col("item_type") == "lab")).select("item_id", "facility_id"), "item_id")
    owners = todo.select("item_id", "patient_id").where(F.col("patient_id").isNotNull())
    fresh = results.join(owners, "item_id").select("item_id", F.upper("analyte_name").alias("analyte_name"), "value", "unit", "ref_range", "flag")
    stored = latest.join(owners, "patient_id").select("item_id", "analyte_name", "value", "unit", "ref_range", "flag")
    kept = stored.join(fresh.select("item_id", "analyte_name"), ["item_id", "analyte_name"], "left_anti")
    labs = fresh.unionByName(kept).withColumnRenamed("item_id", "patient_id")
    # only drugs of some rule matter, which bounds the rows per item
    named = active.join(rule_inns(rules), "inn", "left_semi")
    drugs = owners.join(named, "patient_id").select(F.col("item_id").alias("patient_id"), "inn")
    alerts = safety_alerts(drugs, labs, rules)
    critical = alerts.groupBy(F.col("patient_id").alias("item_id")).agg(F.bool_or(F.col("severity") == "critical").alias("has_critical"))
    joined = todo.join(critical, "item_id", "left").fillna({"has_critical": False})
    blank = F.trim(F.coalesce("override_reason", F.lit(""))) == ""
    outcome = F.when(F.col("has_critical") & blank, "rejected").otherwise("resolved")
    action = F.when(outcome == "rejected", F.lit(None)).when(F.col("has_critical"), "override_safety").otherwise("resolve_lab")
    return joined.select("item_id", "patient_id", "has_critical", outcome.alias("outcome"), action.alias("audit_action"))


NEW_STATUS = {"confirm": "confirmed", "reject": "rejected", "resolve": "resolved"}
REVIEW_EVENT = {"confirm": "CONDITION_CONFIRMED", "reject": "CONDITION_REJECTED", "resolve": "CONDITION_RESOLVED"}


def _choose(column: str, table: dict) -> Column:
    return reduce(lambda c, kv: c.when(F.col(column) == kv[0], kv[1]), list(table.items())[1:], F.when(F.col(column) == next(iter(table)), next(iter(table.values()))))


def apply_condition_reviews(conditions: DataFrame, reviews: DataFrame) -> DataFrame:
    """New status and event of every reviewed open condition; a review that
    cannot be applied gives its reason."""
    keys = ["patient_id", "condition_code"]
    is_open = conditions.where(F.col("status").isin("probable", "confirmed"))
    joined = reviews.join(is_open, keys, "left")
    problem = (
        F.when(F.col("status").isNull(), "not_found")
        .when((F.col("action") == "reject") & (F.coalesce("rejection_reason", F.lit("")) == ""), "reason_required")
        .when(~F.col("action").isin(E.ALLOWED["review_action"]), "unknown_action"))
    ok = problem.isNull()
    return joined.select(
        *keys, "action", F.col("status").alias("old_status"), F.when(ok, _choose("action", NEW_STATUS)).alias("new_status"),
        F.when(ok, _choose("action", REVIEW_EVENT)).alias("event_type"), problem.alias("problem"))


def record_reactions(entries: DataFrame) -> DataFrame:
    """Reaction rows with tidy drug names, active, entered by a clinician."""
    tidy = lambda c: F.trim(F.lower(c))
    return entries.select(
        "patient_id", "reaction_type", tidy(F.col("inn")).alias("inn"), F.transform("cross_reactive_inns", tidy).alias("cross_reactive_inns"),
        "severity", F.lit("clinician_entered").alias("source"), F.lit(True).alias("is_active"))


def reaction_events(reactions: DataFrame) -> DataFrame:
    """One event per recorded reaction."""
    return emit(reactions, F.lit("ALLERGY_RECORDED"), ["inn", "reaction_type", "severity"])


def rule_snapshot(verb: str, version: Column) -> Column:
    """Audit text of a rule change."""
    test = F.when(F.coalesce("operator", F.lit("")) != "", F.concat(F.lit(" Op: "), F.col("operator"), F.lit(" Val: "), F.coalesce(F.col("threshold_value").cast("string"), F.lit("None")))).otherwise(
        F.concat(F.lit(" Flag: "), F.coalesce("flag_match", F.lit("None"))))
    shown = F.when(F.col("is_enabled"), "True").otherwise("False")
    return F.concat(
        F.lit(f"{verb} clinical safety rule v"), version.cast("string"), F.lit(": "), F.col("rule_name"), F.lit(" (Drug: "), F.col("drug_inn"),
        F.lit(", Analyte: "), F.col("analyte_name"), F.lit(","), test, F.lit(", Severity: "), F.col("severity"), F.lit(", Enabled: "), shown, F.lit(")"))


def apply_rule_changes(rules: DataFrame, changes: DataFrame) -> DataFrame:
    """Outcome of a feed of rule changes, at most one per rule.

    ``changes``: change (create / update / delete), rule_name (the target),
    new_name and new_threshold. Names are unique over all rules, deleted ones
    included; creating under a known name, renaming to one, or touching a
    missing or deleted rule is rejected.
    """
    names = rules.select(F.col("rule_name").alias("new_name"), F.lit(True).alias("_taken"))
    joined = changes.join(rules, "rule_name", "left").join(names, "new_name", "left")
    missing = F.col("version").isNull() | F.col("is_deleted")
    problem = (
        F.when((F.col("change") == "create") & F.col("version").isNotNull(), "name_exists")
        .when((F.col("change") != "create") & missing, "not_found")
        .when((F.col("change") == "update") & (F.col("new_name") != F.col("rule_name")) & F.col("_taken").isNotNull(), "name_exists"))
    ok = problem.isNull()
    updated, deleted = F.col("change") == "update", F.col("change") == "delete"
    version = F.when(F.col("change") == "create", 1).when(updated, F.col("version") + 1).otherwise(F.col("version"))
    return joined.select(
        "change", "rule_name", F.when(ok & updated, F.coalesce("new_name", "rule_name")).otherwise(F.col("rule_name")).alias("name"),
        F.when(ok & ~deleted, F.col("new_threshold")).otherwise(F.col("threshold_value")).alias("threshold_value"),
        F.when(ok, version).otherwise(F.col("version")).alias("version"),
        (ok & deleted).alias("is_deleted"), F.when(ok, F.concat(F.col("change"), F.lit("_rule"))).alias("audit_action"), problem.alias("problem"))


def approve_overrides(logs: DataFrame, approved: DataFrame) -> DataFrame:
    hit = logs.join(approved.select("log_id", F.lit(True).alias("_ok")).distinct(), "log_id", "left")
    return hit.withColumn("needs_admin_oversight", F.col("needs_admin_oversight") & F.col("_ok").isNull()).drop("_ok")


def duplicate_keys(df: DataFrame, constraint: str, keys: list[str], condition: Column | None = None) -> DataFrame:
    """Keys that occur more than once."""
    rows = df if condition is None else df.where(condition)
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    repeated = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return repeated.select(F.lit(constraint).alias("constraint"), text.alias("key"), "n")


def outside_values(df: DataFrame, constraint: str, key: str, column: str, allowed: list[str]) -> DataFrame:
    bad = df.where(F.col(column).isNotNull() & ~F.col(column).isin(allowed))
    return bad.select(F.lit(constraint).alias("constraint"), F.col(key).cast("string").alias("key"), F.lit(1).cast("bigint").alias("n"))


def outside_range(df: DataFrame, constraint: str, key: str, column: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    bad = df.where((F.col(column) < low) | (F.col(column) > high))
    return bad.select(F.lit(constraint).alias("constraint"), F.col(key).cast("string").alias("key"), F.lit(1).cast("bigint").alias("n"))


def constraint_audit(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
