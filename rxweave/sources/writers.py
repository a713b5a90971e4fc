"""Table and file sinks.

Each batch goes to its own ``batch_id`` partition in overwrite mode, so a
repeated batch replaces its own rows and never adds them twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxweave.functions.names import parse_date


def _write(df: DataFrame, folder: str, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{table}/batch_id={batch_id}")


def sink_prescriptions(folder: str, batch_id: int, documents: DataFrame, medications: DataFrame, interactions: DataFrame) -> None:
    """Accepted documents with their medications and interactions."""
    accepted = documents.where(~F.col("needs_review"))
    keys = accepted.select("doc_id")
    header = accepted.select(
        "doc_id", "patient_id", "text", "confidence", "doctor_reg", "patient_age", "diagnosis",
        parse_date(F.col("prescription_date")).alias("prescription_date"))
    _write(header, folder, "prescriptions", batch_id)
    _write(medications.join(keys, "doc_id", "left_semi").withColumn("is_active", F.lit(True)), folder, "medications", batch_id)
    _write(interactions.join(keys, "doc_id", "left_semi"), folder, "drug_interactions", batch_id)


def sink_review_queue(folder: str, batch_id: int, documents: DataFrame, item_type: str = "prescription") -> None:
    """Documents below the confidence threshold, with the reason."""
    rows = documents.where("needs_review").select(
        F.col("doc_id").alias("item_id"), "patient_id", F.col("text").alias("raw_ocr_text"), "confidence", "reason",
        F.lit(item_type).alias("item_type"), F.lit(False).alias("resolved"))
    _write(rows, folder, "review_queue", batch_id)


def sink_lab_reports(folder: str, batch_id: int, reports: DataFrame) -> None:
    """Accepted lab reports and their result rows."""
    accepted = reports.where(~F.col("needs_review"))
    header = accepted.select(F.col("doc_id").alias("report_id"), "patient_id", "lab_name", parse_date(F.col("report_date")).alias("report_date"))
    rows = accepted.select(F.col("doc_id").alias("report_id"), F.explode("results").alias("r")).select("report_id", "r.*")
    _write(header, folder, "lab_reports", batch_id)
    _write(rows.withColumn("analyte_name", F.upper("analyte_name")), folder, "lab_results", batch_id)


def sink_events(folder: str, batch_id: int, events: DataFrame) -> None:
    _write(events, folder, "history_events", batch_id)


def sink_training_jsonl(path: str, lines: DataFrame) -> None:
    """JSON lines ``file_name, ground_truth`` (the latter as JSON text)."""
    lines.select("file_name", "ground_truth").write.mode("overwrite").json(path)


def sink_metrics(path: str, metrics: DataFrame) -> None:
    metrics.write.mode("overwrite").json(path)


