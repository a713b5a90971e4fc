"""An ordered feed of rule changes, folded into a versioned rule table with audit rows.

Whether a change is valid depends on the valid changes before it: a rule must
exist and not be deleted, and a name must not belong to another rule at that
moment. So changes depend on each other through rules and names only. Groups of
changes that share neither with others (``linked``) are sorted once by group and
folded change by change, many groups in a task. What belongs to no bounded group
is judged all at once, against the changes judged valid so far,
and judged again until no verdict differs. A verdict depends on earlier changes
only, so the first wrong one is put right in every round, and what stays is what
a change-by-change loop gives. Usually that takes a few rounds; a round is two
running aggregates, over the rule and over the name, of rows without payload.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxweave.operators.linked import GROUP_ROWS, ROUNDS, linked_groups
from rxweave.operators.maintenance import rule_snapshot
from rxweave.operators.running import ANY, BLOCK, LAST, SUM, running
from rxweave.session import cut_lineage

FIELDS = ["drug_inn", "analyte_name", "operator", "threshold_value", "threshold_value_max", "flag_match", "gender_specific", "severity",
          "description_template", "management_plan", "is_enabled"]


def _judged(ops: DataFrame, block: int) -> DataFrame:
    """The ops with the verdict that follows from the present ones: ``next``."""
    ok, change, name = F.col("problem").isNull(), F.col("change"), F.col("rule_name")
    named = ok & change.isin("base", "create", "update")
    seen = running(ops, ["rule_id"], "seq", {
        "exists": (ANY, ok & change.isin("base", "create")), "deleted": (ANY, ok & ((change == "delete") | ((change == "base") & F.col("base_deleted")))),
        "held": (LAST, F.when(named, name))}, block)
    # a valid change of name takes the new name and frees the one held before
    moves = named & ~F.col("held").eqNullSafe(name)
    taken = seen.select(F.col("rule_name").alias("name"), "seq", F.lit(True).alias("asks"), F.when(moves, 1).otherwise(0).alias("delta"))
    freed = seen.where(moves & F.col("held").isNotNull()).select(F.col("held").alias("name"), "seq", F.lit(False).alias("asks"), F.lit(-1).alias("delta"))
    owned = running(taken.unionByName(freed), ["name"], "seq", {"owners": (SUM, F.col("delta"))}, block).where("asks").select("name", "seq", "owners")
    owned_by_other = F.col("owners") > 0
    gone = ~F.col("exists") | F.col("deleted")
    problem = (
        F.when(change == "base", F.lit(None).cast("string"))
        .when(change == "create", F.when(F.col("exists"), "id_exists").when(owned_by_other, "name_exists"))
        .when(change == "update", F.when(gone, "not_found").when(~F.col("held").eqNullSafe(name) & owned_by_other, "name_exists"))
        .when(change == "delete", F.when(gone, "not_found"))
        .otherwise("unknown_change"))
    # base rules share their number, and each has a name of its own
    return seen.join(owned.withColumnRenamed("name", "rule_name"), ["rule_name", "seq"]).withColumn("next", problem)


#: Columns of a change that verdicts depend on.
SLIM = ["seq", "change", "rule_id", "rule_name", "base_deleted", "base_version"]


def judge_changes(rules: DataFrame, changes: DataFrame, block: int = BLOCK, rounds: int = ROUNDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Every change with ``problem`` (null if it is valid), ``held`` (the rule's name before it) and ``version`` (after it)."""
    spark = rules.sparkSession
    # a feed without names would fall out of the join over names: a missing one counts as blank
    base = rules.select(
        F.lit(-1).cast("long").alias("seq"), F.lit("base").alias("change"), "rule_id", "rule_name",
        F.col("is_deleted").alias("base_deleted"), F.col("version").cast("int").alias("base_version"))
    fed = changes.select(F.col("seq").cast("long").alias("seq"), "change", "rule_id", F.coalesce("rule_name", F.lit("")).alias("rule_name"), F.lit(False).alias("base_deleted"), F.lit(None).cast("int").alias("base_version"))
    ops = cut_lineage(spark, base.unionByName(fed), "changes")
    near, far = linked_groups(ops, "rule_id", "rule_name", F.col("change").isin("base", "create", "update"), rounds, group_rows)
    kind = {f.name: f.dataType.simpleString() for f in ops.schema}
    schema = ", ".join(f"{c} {kind[c]}" for c in SLIM) + ", problem string, held string, version long"
    folded = near.repartition("group").sortWithinPartitions("group", "seq").mapInArrow(_fold_groups, schema)
    return folded if far is None else folded.unionByName(_judge_rounds(far.select(*SLIM), block))


def _fold_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts change by change; rows come in order of their group, then of ``seq``."""
    current, held, gone, versions, owners = None, {}, set(), {}, {}

    def verdict(change, rule, name) -> str | None:
        if change == "base":
            return None
        if change == "create":
            return "id_exists" if rule in held else "name_exists" if owners.get(name, 0) > 0 else None
        if change not in ("update", "delete"):
            return "unknown_change"
        if rule not in held or rule in gone:
            return "not_found"
        return "name_exists" if change == "update" and held[rule] != name and owners.get(name, 0) > 0 else None

    for batch in batches:
        problems, names, after = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("group", "change", "rule_id", "rule_name", "base_deleted", "base_version")]
        for group, change, rule, name, base_deleted, base_version in zip(*columns):
            if group != current:
                current, held, gone, versions, owners = group, {}, set(), {}, {}
            problem = verdict(change, rule, name)
            problems.append(problem)
            before = held.get(rule)
            names.append(before)
            if problem is None:
                if change == "delete":
                    gone.add(rule)
                else:
                    if before != name:
                        owners[name] = owners.get(name, 0) + 1
                        if before is not None:
                            owners[before] -= 1
                    held[rule] = name
                    if change == "update":
                        versions[rule] = versions[rule] + 1 if versions[rule] is not None else None
                    else:
                        versions[rule] = base_version if change == "base" else 1
                        if change == "base" and base_deleted:
                            gone.add(rule)
            after.append(versions.get(rule))
        arrays = [batch.column(c) for c in SLIM] + [pa.array(problems, pa.string()), pa.array(names, pa.string()), pa.array(after, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, [*SLIM, "problem", "held", "version"])


def _judge_rounds(ops: DataFrame, block: int) -> DataFrame:
    """The same for changes in groups of any size."""
    spark = ops.sparkSession
    ops = ops.withColumn("problem", F.lit(None).cast("string"))
    while True:
        judged = cut_lineage(spark, _judged(ops, block), "judged")
        if judged.where(~F.col("problem").eqNullSafe(F.col("next"))).isEmpty():
            break
        ops = judged.select(*SLIM, F.col("next").alias("problem"))
    ok = F.col("problem").isNull()
    first = F.when(F.col("change") == "base", F.col("base_version")).when(ok & (F.col("change") == "create"), 1)
    step = F.when(ok & (F.col("change") == "update"), 1).otherwise(0)
    counted = running(judged, ["rule_id"], "seq", {"first": (LAST, first), "steps": (SUM, step)}, block)
    return counted.withColumn("version", F.coalesce(first, F.col("first") + F.col("steps") + step)).select(*SLIM, "problem", "held", "version")


def fold_changes(rules: DataFrame, changes: DataFrame, block: int = BLOCK) -> dict[str, DataFrame]:
    """The rule table and audit rows that a feed of changes leaves.

    ``rules``: rule_id, rule_name, the fields, is_deleted, version; ids and names
    are unique, deleted rules keep theirs. ``changes``: seq (a distinct whole
    number from 0, the order), at, clinician_id, change (create, update, delete),
    rule_id, rule_name and the fields.

    ``changes``: each change with its problem, if any: id_exists, name_exists,
    not_found, unknown_change. ``history``: one row per version with ``valid_from`` and
    ``valid_to`` (null: current, or from the start). ``current``: the newest
    version of each rule, deleted ones marked. ``audit``: one row per valid
    change, with a text of what it set.
    """
    spark = rules.sparkSession
    judged = cut_lineage(spark, judge_changes(rules, changes, block), "judged")
    verdicts = judged.where("change <> 'base'").select("seq", "problem", "held", "version")
    told = changes.join(verdicts, "seq")
    tidy = {"drug_inn": F.lower("drug_inn"), "analyte_name": F.upper("analyte_name")}
    ok = told.where("problem IS NULL")
    columns = ["rule_id", "rule_name", *FIELDS, "version"]
    none = F.lit(None)
    versions = rules.select(*columns, none.cast(changes.schema["at"].dataType).alias("valid_from"), F.lit(-1).cast("long").alias("seq")).unionByName(
        ok.where("change <> 'delete'").withColumns(tidy).select(*columns, F.col("at").alias("valid_from"), F.col("seq").cast("long").alias("seq")))
    # the change that ends a version is the next valid one of its rule
    steps = ok.select("rule_id", F.col("version").alias("after"), "change", "at")
    removal = F.col("change") == "delete"
    ends = steps.where(F.col("change").isin("update", "delete")).select(
        "rule_id", F.when(removal, F.col("after")).otherwise(F.col("after") - 1).alias("version"), F.col("at").alias("valid_to"), removal.alias("removed"))
    was_deleted = rules.select("rule_id", "version", F.col("is_deleted").alias("_was"))
    history = (
        versions.drop("seq").join(ends, ["rule_id", "version"], "left").join(was_deleted, ["rule_id", "version"], "left")
        .withColumn("is_deleted", F.coalesce("removed", "_was", F.lit(False))).drop("removed", "_was"))
    newest = judged.where("problem IS NULL").groupBy("rule_id").agg(F.max("version").alias("version"))
    return {"changes": told, "history": history, "current": history.join(newest, ["rule_id", "version"], "left_semi"), "audit": audit_rows(ok)}


def audit_rows(ok: DataFrame) -> DataFrame:
    """One audit row per valid change."""
    def text(verb: str) -> Column:
        return rule_snapshot(verb, F.col("version"))

    removed = F.concat(F.lit("Soft-deleted clinical safety rule v"), F.col("version").cast("string"), F.lit(": "), F.col("held"))
    told = F.when(F.col("change") == "create", text("Created")).when(F.col("change") == "update", text("Updated")).otherwise(removed)
    return ok.select(F.col("seq").alias("change_id"), F.col("at").alias("created_at"), "clinician_id", F.col("rule_id").alias("item_id"),
                     F.concat(F.col("change"), F.lit("_rule")).alias("action"), told.alias("override_reason"), F.lit(False).alias("needs_admin_oversight"))
