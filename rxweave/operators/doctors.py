"""Doctor identities from noisy mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxweave.functions.names import normalize_registration, speciality_group


def identified_mentions(mentions: DataFrame) -> DataFrame:
    """Mentions with a number or a name, with the normalized number."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return mentions.where(~(blank("reg_number") & blank("name"))).select(
        "*", normalize_registration(F.col("reg_number")).alias("reg_norm"), speciality_group(F.col("speciality")).alias("speciality_group"))


def resolve_doctors(mentions: DataFrame) -> DataFrame:
    """One row per registration number; mentions without one stay separate.

    Names are first grouped per number, so a number with very many mentions is
    combined before the shuffle and its name variants are counted, not
    collected (``name_variants`` lists them).
    """
    known = identified_mentions(mentions)
    order = F.struct("seen_order", "seen_line", "name", "speciality")
    per_name = known.where(F.col("reg_norm").isNotNull()).groupBy("reg_norm", "name").agg(
        F.min(F.struct(*[order[c].alias(c) for c in ("seen_order", "seen_line", "name", "speciality")], "reg_number")).alias("first"),
        F.min(F.when(F.col("speciality_group").isNotNull(), F.struct("seen_order", "seen_line", "speciality_group"))).alias("group"),
        F.count("*").alias("n"))
    merged = per_name.groupBy("reg_norm").agg(
        F.min("first").alias("first"), F.min("group").alias("group"), F.sum("n").alias("n_mentions"), F.count("name").alias("n_name_variants"))
    columns = ["reg_norm", "registration_number", "name", "speciality", "speciality_group", "n_mentions", "n_name_variants"]
    resolved = merged.select(
        "reg_norm", F.col("first.reg_number").alias("registration_number"), F.col("first.name").alias("name"),
        F.col("first.speciality").alias("speciality"), F.col("group.speciality_group").alias("speciality_group"), "n_mentions", "n_name_variants")
    one = F.lit(1).cast("bigint")
    single = known.where(F.col("reg_norm").isNull()).select(
        "reg_norm", F.col("reg_number").alias("registration_number"), "name", "speciality", "speciality_group",
        one.alias("n_mentions"), F.when(F.col("name").isNotNull(), one).otherwise(0).alias("n_name_variants"))
    return resolved.select(columns).unionByName(single.select(columns))


def name_variants(mentions: DataFrame) -> DataFrame:
    return identified_mentions(mentions).where(F.col("reg_norm").isNotNull() & F.col("name").isNotNull()).select("reg_norm", "name").distinct()


def with_doctor_ids(rows: DataFrame, doctors: DataFrame, reg: str = "doctor_reg") -> DataFrame:
    """Rows with ``doctor_id``: that of the known doctor with the same normalized number (the least, if several have it),
    as a string; of an unknown number, the number itself behind ``reg:``; null without a number."""
    known = doctors.groupBy(normalize_registration(F.col("registration_number")).alias("_reg")).agg(F.min("doctor_id").cast("string").alias("_id"))
    joined = rows.withColumn("_reg", normalize_registration(F.col(reg))).join(known.where("_reg IS NOT NULL"), "_reg", "left")
    return joined.withColumn("doctor_id", F.coalesce("_id", F.concat(F.lit("reg:"), "_reg"))).drop("_id", "_reg")


def registered_doctors(rows: DataFrame, doctors: DataFrame) -> DataFrame:
    """Known doctors and one row per doctor that ``with_doctor_ids`` made of a number; ids are strings."""
    known = doctors.select(F.col("doctor_id").cast("string").alias("doctor_id"), "name", "registration_number", "speciality")
    made = rows.where(F.col("doctor_id").startswith("reg:")).groupBy("doctor_id").agg(F.min("doctor_reg").alias("registration_number"))
    return known.unionByName(made.select("doctor_id", F.lit(None).cast("string").alias("name"), "registration_number", F.lit(None).cast("string").alias("speciality")))
