"""Training corpus: parse, validate, pair and write annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxweave.functions import annotations as A
from rxweave.functions.text import bind
from rxweave.refdata import corpus as C


def parse_annotations(rows: DataFrame) -> DataFrame:
    """Add the structured record of each annotation text."""
    return rows.withColumn("record", A.annotation_record(F.col("ground_truth")))


def rejection(file_name: Column, ground_truth: Column) -> Column:
    """Why a training row is rejected, NULL when it is valid."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    is_object = lambda m: F.startswith(F.ltrim(m), F.lit("{"))
    named = lambda m: ~blank(F.try_element_at(F.from_json(m, "map<string,string>"), F.lit("drug_name")))

    def of_medications(meds: Column, has_field: Column) -> Column:
        return bind(F.from_json(meds, "array<string>"), lambda items: (
            F.when(~F.startswith(F.ltrim(meds), F.lit("[")), "medications is not a list")
            .when(~has_field & (F.size(items) == 0), "no clinical field and no medication")
            .when(F.exists(items, lambda m: ~is_object(m)), "medication is not an object")
            .when(F.exists(items, lambda m: ~named(m)), "medication without drug_name")))

    def of_fields(fields: Column) -> Column:
        get = lambda key: F.try_element_at(fields, F.lit(key))
        has_field = F.exists(F.array(*[~blank(get(k)) for k in C.CLINICAL_FIELDS]), lambda b: b)
        meds = F.when(F.map_contains_key(fields, "medications"), F.coalesce(get("medications"), F.lit("null"))).otherwise(F.lit("[]"))
        return bind(meds, lambda m: of_medications(m, has_field))

    return (
        F.when(blank(file_name), "missing file_name")
        .when(blank(ground_truth), "missing ground_truth")
        .when(F.try_parse_json(ground_truth).isNull(), "invalid JSON")
        .otherwise(bind(F.from_json(ground_truth, "map<string,string>"), of_fields))
    )


def validate_training_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reason", rejection(F.col("file_name"), F.col("ground_truth")))


def pair_files(stems: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotation stems with their image (png before jpg before jpeg), and the
    stems without one. ``files``: file_name."""
    name, suffix = F.regexp_extract("file_name", r"^(.*)\.([^.]+)$", 1), F.regexp_extract("file_name", r"^(.*)\.([^.]+)$", 2)
    rank = F.array_position(F.array(*[F.lit(s) for s in C.IMAGE_SUFFIXES]), suffix)
    images = files.select(name.alias("stem"), rank.alias("rank"), "file_name").where(F.col("rank") > 0)
    best = images.groupBy("stem").agg(F.min_by("file_name", "rank").alias("file_name"))
    return stems.join(best, "stem"), stems.join(best, "stem", "left_anti")


def build_training_corpus(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Lines ``file_name, ground_truth`` of all valid, paired annotations.

    ``rows``: stem, ground_truth (annotation text).
    """
    parsed = parse_annotations(rows)
    json = parsed.withColumn("target", A.compact_json(A.sorted_record(F.col("record"))))
    paired, _ = pair_files(json, files)
    lines = paired.select("stem", F.concat(F.lit("images/"), F.col("file_name")).alias("file_name"), F.col("target").alias("ground_truth"))
    return validate_training_rows(lines).where(F.col("reason").isNull()).drop("reason")


def unlabeled(files: DataFrame, *splits: DataFrame) -> DataFrame:
    """Files that no split holds yet."""
    result = files
    for split in splits:
        result = result.join(split.select("file_name"), "file_name", "left_anti")
    return result
