"""The typed history event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxweave.refdata import events as E
from rxweave.refdata import tables


def emit(rows: DataFrame, event_type: Column, payload: list[str], keys: list[str] = ("patient_id",)) -> DataFrame:
    """Event rows with a JSON payload of the given columns."""
    return rows.select(
        event_type.alias("event_type"), F.lit(E.SCHEMA_VERSION).alias("payload_schema_version"), *keys,
        F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}).alias("payload"))


def conformance(log: DataFrame) -> DataFrame:
    """Required payload keys that an event lacks."""
    required = F.broadcast(tables.required_keys(log.sparkSession))
    joined = log.join(required, ["event_type", "payload_schema_version"])
    missing = F.array_except("required", F.coalesce(F.json_object_keys("payload"), F.array().cast("array<string>")))
    return joined.select("event_id", "event_type", F.size(missing).alias("n_missing"), F.array_join(missing, ",").alias("missing"))


def confidence_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Old and new confidence of every condition that an inference updated."""
    keys = ["patient_id", "condition_code"]
    old = before.select(*keys, F.col("confidence").alias("old_confidence"))
    new = after.select(*keys, F.col("confidence").alias("new_confidence"))
    return old.join(new, keys).where(~F.col("old_confidence").eqNullSafe(F.col("new_confidence")))


def window_counts(log: DataFrame, width: str = "1 day") -> DataFrame:
    """Events per type and time window; works on batches and streams."""
    return log.groupBy(F.window("created_at", width), "event_type").agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("window_start"), "event_type", "n")
