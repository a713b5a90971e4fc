"""The whole job for new prescriptions, and the history update after it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxweave.functions.names import parse_date
from rxweave.operators import episodes as E
from rxweave.operators.brands import normalize_drugs
from rxweave.operators.inference import infer_conditions
from rxweave.operators.interactions import document_interactions
from rxweave.operators.medications import active_medications, distinct_inns, route_by_confidence
from rxweave.operators.safety import safety_alerts
from rxweave.plans.extraction import extract_prescriptions, medication_rows
from rxweave.session import cut_lineage


def normalized_medications(docs: DataFrame, brands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routed documents and their medication rows with generic names.

    The parsed documents are written once: several results are built on them,
    and reading them again is far cheaper than parsing the texts again.
    """
    routed = cut_lineage(docs.sparkSession, route_by_confidence(extract_prescriptions(docs)), "routed")
    rows = medication_rows(routed, "doc_id", "patient_id", "prescription_date", "needs_review")
    return routed, normalize_drugs(rows, brands)


def process_prescriptions(docs: DataFrame, brands: DataFrame, rx: DataFrame, med: DataFrame, labs: DataFrame,
                          rules: DataFrame, as_of: dt.date) -> dict[str, DataFrame]:
    """Extract, normalize, check and route a batch of documents, over a history of prescriptions and lines."""
    return process_documents(docs, brands, distinct_inns(active_medications(med, rx, as_of)), labs, rules)


def process_documents(docs: DataFrame, brands: DataFrame, active: DataFrame, labs: DataFrame, rules: DataFrame) -> dict[str, DataFrame]:
    """The same over the patients' distinct current drugs (patient_id, inn)."""
    routed, normalized = normalized_medications(docs, brands)
    normalized = cut_lineage(docs.sparkSession, normalized, "normalized")
    new = normalized.where(F.coalesce("inn", F.lit("")) != "").select("doc_id", "patient_id", F.lower("inn").alias("inn")).distinct()
    found = document_interactions(routed.select("doc_id", "patient_id").join(new.select("doc_id", "inn"), "doc_id"), active)
    alerts = safety_alerts(new.where(F.col("patient_id").isNotNull()), labs, rules, ("doc_id", "patient_id"))
    per_doc = routed.select("doc_id", "patient_id", F.size("medications").alias("n_meds"), "confidence", "needs_review", "reason")
    n_found = found.groupBy("doc_id").agg(F.count("*").alias("n_interactions"), F.bool_or(F.col("severity") == "major").alias("has_major"))
    n_alerts = alerts.groupBy("doc_id").agg(F.count("*").alias("n_alerts"), F.bool_or(F.col("severity") == "critical").alias("has_critical"))
    summary = per_doc.join(n_found, "doc_id", "left").join(n_alerts, "doc_id", "left").fillna(
        {"n_interactions": 0, "has_major": False, "n_alerts": 0, "has_critical": False})
    return {"documents": routed, "medications": normalized, "interactions": found, "alerts": alerts, "summary": summary}


def accepted_lines(medications: DataFrame, as_of: dt.date) -> DataFrame:
    """The lines of accepted documents of known patients. A document whose date does not parse counts from ``as_of``."""
    when = F.coalesce(parse_date(F.col("prescription_date")), F.lit(as_of))
    return medications.where(~F.col("needs_review") & F.col("patient_id").isNotNull()).select(
        "patient_id", F.col("doc_id").alias("rx_id"), when.alias("rx_date"), "line_no", "inn", "raw_drug_name",
        "dosage_value", "dosage_unit", "frequency", "duration_days", "doctor_id")


def folded_history(drugs: DataFrame) -> dict[str, DataFrame]:
    """Episodes, dose history and events of ``prescription_drugs`` that are stored; their days and numbered lines are written once."""
    days = cut_lineage(drugs.sparkSession, E.episode_days(drugs), "episode_days")
    history = cut_lineage(drugs.sparkSession, E.episode_lines(drugs, days), "episode_lines")
    return {
        "episodes": E.scheduled_episodes(days).unionByName(E.prn_episodes(drugs)),
        "dosage_history": E.dosage_history(history),
        "events": E.episode_events(history, E.scheduled_episodes(days), E.prn_snapshots(drugs)),
    }


def update_history(medications: DataFrame, doctors: DataFrame, as_of: dt.date) -> dict[str, DataFrame]:
    """Episodes, dose history, events and conditions of accepted documents.

    ``medications``: rows of ``process_prescriptions`` with a doctor_id.
    """
    drugs = cut_lineage(medications.sparkSession, E.prescription_drugs(accepted_lines(medications, as_of)), "drugs")
    folded = folded_history(drugs)
    return {**folded, "conditions": infer_conditions(folded["episodes"], doctors, as_of)}
