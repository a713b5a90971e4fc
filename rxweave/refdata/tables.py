"""Reference data as DataFrames.

Everything here is written in code, so its size is fixed whatever the data
volume; that is the bound that makes the broadcast hints below safe.
"""

from __future__ import annotations

from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxweave.refdata import analytes, events, interactions, safety_rules, signals

_ARROW = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}


def local_table(spark: SparkSession, rows: list[tuple], columns: dict[str, str]) -> DataFrame:
    """Rows held in code as a local relation with known size."""
    values = list(zip(*rows)) if rows else [[] for _ in columns]
    arrays = [pa.array(list(v), type=_ARROW[t]) for v, t in zip(values, columns.values())]
    return spark.createDataFrame(pa.table(dict(zip(columns, arrays))))


RULE_SCHEMA = {"drug_1": "string", "drug_2": "string", "severity": "string", "description": "string", "management": "string", "source": "string"}


def pair_rows() -> list[tuple]:
    """Exact pairs with the drugs in alphabetical order."""
    return [(*sorted((a, b)), sev, text, plan, interactions.PAIR_SOURCE) for a, b, sev, text, plan in interactions.PAIRS]


def class_pair_rows() -> list[tuple]:
    """Class rules written out per pair of member drugs, exact pairs left out."""
    exact = {row[:2] for row in pair_rows()}
    found = {}
    for left, right, sev, text, plan in interactions.CLASS_RULES:
        members = product(interactions.CLASS_MEMBERS.get(left, []), interactions.CLASS_MEMBERS.get(right, []))
        for a, b in members:
            key = tuple(sorted((a, b)))
            if a != b and key not in exact:
                found[key] = (*key, sev, text, plan, interactions.CLASS_SOURCE)
    return sorted(found.values())


def pair_rules(spark: SparkSession) -> DataFrame:
    return local_table(spark, pair_rows(), RULE_SCHEMA)


def class_pair_rules(spark: SparkSession) -> DataFrame:
    return local_table(spark, class_pair_rows(), RULE_SCHEMA)


def interaction_rules(spark: SparkSession) -> DataFrame:
    return local_table(spark, pair_rows() + class_pair_rows(), RULE_SCHEMA)


def drug_classes(spark: SparkSession) -> DataFrame:
    rows = [(d, c) for c, drugs in interactions.CLASS_MEMBERS.items() for d in drugs]
    return local_table(spark, rows, {"inn": "string", "drug_class": "string"})


SIGNAL_SCHEMA = dict(zip(signals.SIGNAL_COLUMNS, [
    "string", "string", "string", "string", "double", "double", "double", "double", "string", "int", "boolean", "int", "string"]))


def condition_signals(spark: SparkSession) -> DataFrame:
    return local_table(spark, signals.SIGNALS, SIGNAL_SCHEMA)


BASELINE_SCHEMA = dict(zip(safety_rules.RULE_COLUMNS, [
    "string", "string", "string", "string", "double", "double", "string", "string", "string", "string", "string", "boolean", "boolean", "int"]))


def baseline_rules(spark: SparkSession) -> DataFrame:
    return local_table(spark, safety_rules.BASELINE_RULES, BASELINE_SCHEMA)


FALLBACK_SCHEMA = dict(zip(safety_rules.FALLBACK_COLUMNS, [
    "int", "int", "string", "string", "double", "double", "double", "double", "string", "int", "string", "string", "string", "string", "string"]))


def fallback_rules(spark: SparkSession) -> DataFrame:
    return local_table(spark, safety_rules.FALLBACK_RULES, FALLBACK_SCHEMA)


def fallback_drug_rows() -> list[tuple]:
    return [(rule, drug) for rule, drugs in safety_rules.FALLBACK_DRUGS.items() for drug in drugs]


def fallback_drugs(spark: SparkSession) -> DataFrame:
    return local_table(spark, fallback_drug_rows(), {"rule_id": "int", "inn": "string"})


ANALYTE_SCHEMA = dict(zip(analytes.ANALYTE_COLUMNS, ["int", "string", "string", "string", "string", "double", "double", "double"]))


def analyte_rules(spark: SparkSession) -> DataFrame:
    return local_table(spark, analytes.ANALYTES, ANALYTE_SCHEMA)


def speciality_ratios(spark: SparkSession) -> DataFrame:
    return local_table(spark, signals.SPECIALITY_RATIOS, {"speciality_group": "string", "condition_group": "string", "ratio": "double"})


def required_key_rows() -> list[tuple]:
    return [(t, events.SCHEMA_VERSION, k) for t, keys in events.REQUIRED_KEYS.items() for k in keys]


def required_keys(spark: SparkSession) -> DataFrame:
    rows = [(t, events.SCHEMA_VERSION, ",".join(keys)) for t, keys in events.REQUIRED_KEYS.items()]
    table = local_table(spark, rows, {"event_type": "string", "payload_schema_version": "int", "keys": "string"})
    return table.select("event_type", "payload_schema_version", F.split("keys", ",").alias("required"))


ALL_TABLES = {
    "interaction_pairs": pair_rules,
    "class_pairs": class_pair_rules,
    "drug_classes": drug_classes,
    "condition_signals": condition_signals,
    "baseline_rules": baseline_rules,
    "fallback_rules": fallback_rules,
    "fallback_drugs": fallback_drugs,
    "analytes": analyte_rules,
    "speciality_ratios": speciality_ratios,
    "event_keys": required_keys,
}
