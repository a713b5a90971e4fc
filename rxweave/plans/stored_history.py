"""Medication history in stored tables, brought up to date by each batch of accepted prescriptions.

Five tables lie in hash buckets of the patient: ``drugs`` (one row per
prescription and drug, from which all else follows), ``episodes``,
``dosage_history``, ``events`` and ``conditions``. A batch reads and writes the
buckets of its own patients only, and folds only those patients again, whatever
the order in which prescriptions arrive; conditions are merged with the stored
ones. All results are written to the shared folder before the first bucket is
replaced, ``drugs`` first. A prescription and drug that are there already are
left as they are, so a batch that broke off or comes twice gives the same tables.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxweave.operators import episodes as E
from rxweave.operators.inference import infer_conditions, merge_conditions
from rxweave.plans.processing import accepted_lines, folded_history
from rxweave.plans.resolution import bucket_of
from rxweave.session import cut_lineage
from rxweave.streaming.files import exists

BUCKETS = 256
KEYS = ["patient_id", "inn", "rx_id"]
CONDITION_FIELDS = ["patient_id", "condition_code", "condition_name", "condition_group", "status", "confidence"]


def write_buckets(rows: DataFrame, path: str, buckets: int) -> None:
    """Replace the buckets that the rows fall into; the others stay. A new table gets a file without rows, for its columns."""
    if not exists(rows.sparkSession, path):
        rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/bucket=-1")
    placed = rows.withColumn("bucket", bucket_of("patient_id", buckets))
    placed.repartition("bucket", "patient_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame | None:
    """The rows of a stored table, of the given buckets only; none if there is no such table yet."""
    if not exists(spark, path):
        return None
    rows = spark.read.parquet(path)
    return (rows if wanted is None else rows.where(F.col("bucket").isin(wanted))).drop("bucket")


def store_conditions(conditions: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Start a history with conditions known from elsewhere."""
    write_buckets(conditions.select(CONDITION_FIELDS), f"{path}/conditions", buckets)


def _or_none(stored: DataFrame | None, like: DataFrame) -> DataFrame:
    return like.limit(0) if stored is None else stored


def update_stored_history(medications: DataFrame, doctors: DataFrame, as_of: dt.date, path: str, buckets: int = BUCKETS) -> list[int]:
    """Fold a batch of ``process_prescriptions`` medication rows, with their doctor_id, into the history below ``path``.

    ``doctors``: doctor_id (of the same type) and speciality. Rows under review,
    without a patient, without a prescription id or without a drug name take no
    part; an empty batch changes nothing. Returns the buckets that were replaced.
    """
    spark = medications.sparkSession
    rows = E.prescription_drugs(accepted_lines(medications, as_of).where("rx_id IS NOT NULL"))
    arrived = cut_lineage(spark, rows, "arrived")
    touched = sorted(r[0] for r in arrived.select(bucket_of("patient_id", buckets).alias("b")).distinct().collect())  # at most as many as there are buckets
    if not touched:
        return []
    before = {t: read_buckets(spark, f"{path}/{t}", touched) for t in ("drugs", "episodes", "dosage_history", "events", "conditions")}
    patients = arrived.select("patient_id").distinct()
    held = _or_none(before["drugs"], arrived)
    added = arrived.join(held.select(KEYS), KEYS, "left_anti")
    mine = cut_lineage(spark, held.join(patients, "patient_id", "left_semi").unionByName(added), "touched")
    folded = folded_history(mine)
    folded["episodes"] = cut_lineage(spark, folded["episodes"], "episodes")
    none = spark.createDataFrame([], f"patient_id {mine.schema['patient_id'].dataType.simpleString()}, condition_code string, condition_name string, "
                                     "condition_group string, status string, confidence double")
    known = _or_none(before["conditions"], none)
    inferred = infer_conditions(folded["episodes"], doctors, as_of)
    conditions = merge_conditions(inferred, known.join(patients, "patient_id", "left_semi")).select(CONDITION_FIELDS)
    ready = {}
    for name, fresh in {"drugs": mine, **folded, "conditions": conditions}.items():
        others = before[name]
        both = fresh if others is None else fresh.unionByName(others.join(patients, "patient_id", "left_anti"))
        ready[name] = cut_lineage(spark, both, name)
    for name, table in ready.items():
        write_buckets(table, f"{path}/{name}", buckets)
    return touched
