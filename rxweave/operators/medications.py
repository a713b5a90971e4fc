"""Filters and sets over prescriptions and medication lines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxweave.refdata import prescribing as P


def active_medications(med: DataFrame, rx: DataFrame, as_of: dt.date) -> DataFrame:
    """Active lines that are chronic (no duration) or prescribed recently."""
    recent = F.col("created_at") >= F.date_sub(F.lit(as_of), P.ACTIVE_WINDOW_DAYS)
    joined = med.where("is_active").join(rx.select("rx_id", "patient_id", "created_at"), "rx_id")
    return joined.where(F.col("duration_days").isNull() | recent)


def distinct_inns(lines: DataFrame, key: str = "patient_id") -> DataFrame:
    """Distinct (key, INN) rows in lower case, blanks left out."""
    inn = F.lower(F.col("inn"))
    return lines.where(F.coalesce(inn, F.lit("")) != "").select(key, inn.alias("inn")).distinct()


def union_inns(history: DataFrame, new: DataFrame, key: str = "patient_id") -> DataFrame:
    return distinct_inns(history.select(key, "inn").unionByName(new.select(key, "inn")), key)


def named_medications(lines: DataFrame, *names: str) -> DataFrame:
    """Lines with a non-blank name in any of the given columns."""
    name = F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names])
    return lines.where(name.isNotNull())


def recent_prescriptions(rx: DataFrame, limit: int) -> DataFrame:
    """Newest prescriptions per patient.

    The rank filter lets Spark keep only ``limit`` rows per patient and input
    partition before the shuffle, so a patient with very many prescriptions
    does not send them all to one task.
    """
    order = Window.partitionBy("patient_id").orderBy(F.col("created_at").desc(), F.col("rx_id").desc())
    return rx.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit)


def route_by_confidence(docs: DataFrame, extractor: str = "tesseract_ner_fallback") -> DataFrame:
    """Flag low-confidence documents and give the reason."""
    low = F.col("confidence") < P.REVIEW_THRESHOLD
    reason = F.concat(
        F.lit("Confidence "), F.format_string("%.4f", "confidence"),
        F.lit(f" < threshold {P.REVIEW_THRESHOLD} (extractor={extractor})"))
    return docs.withColumn("needs_review", low).withColumn("reason", F.when(low, reason))


def upsert_patients(known: DataFrame, phones: DataFrame) -> DataFrame:
    """Phones seen for the first time."""
    return phones.select("phone").where(F.col("phone").isNotNull()).distinct().join(known.select("phone"), "phone", "left_anti")


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows plus the incoming rows whose key is new."""
    fresh = incoming.dropDuplicates(keys).join(existing.select(keys), keys, "left_anti")
    return existing.unionByName(fresh)
