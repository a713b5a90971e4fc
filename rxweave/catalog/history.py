"""Queries over the stored medication history that batches of prescription texts are folded into."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxweave import bindings as B
from rxweave.catalog.base import query
from rxweave.catalog.longitudinal import day
from rxweave.catalog.sqlbind import AS_OF, CTES, at, sql
from rxweave.catalog.texts import DOC_DRUG_COLUMNS, DOCS, brand_table
from rxweave.operators import doctors as D
from rxweave.plans import processing as PR
from rxweave.plans import stored_history as SH
from rxweave.session import cut_lineage, dealt, shared_folder

BATCHES = 3
QUERY_BUCKETS = 8

# The accepted lines of the documents as rows, and what follows from them, in order.
_CHAIN = ["rx_drugs", "defaults", "scheduled", "folded", "lines", "sched_episodes", "episodes", "recent", "parts", "evidence", "rolled",
          "seen_doctors", "primary_group", "gated", "ratios", "decayed", "shifted", "scored", "inferred"]


def document_history(body: str, *names: str) -> str:
    """Check SQL over the rows of ``_CHAIN``, derived from the documents, up to the last of ``names``."""
    medications = f"""SELECT x.doc_id AS rx_id, x.patient_id, coalesce(CASE WHEN x.prescription_date IS NOT NULL THEN x.written END, {AS_OF}) AS rx_date, line_no, inn, raw_drug_name,
        dose AS dosage_value, 'mg' AS dosage_unit, frequency, duration_days, coalesce(CAST(s_suppkey AS VARCHAR), 'reg:' || doctor_reg) AS doctor_id
        FROM ({DOC_DRUG_COLUMNS}) x LEFT JOIN supplier ON doctor_reg = 'MH' || (10000 + s_suppkey) WHERE x.confidence >= 0.5"""
    doctors = f"SELECT CAST(s_suppkey AS VARCHAR) AS doctor_id, {at(B.SPECIALITIES, 's_suppkey')} AS speciality FROM supplier"
    last = max(_CHAIN.index(n) for n in names)
    # a newest line without a doctor leaves the episode without one, so null values count here
    chain = {n: CTES[n].replace("arg_max(", "arg_max_null(") for n in _CHAIN[:last + 1]}
    return sql(body, **DOCS, medications=medications, doctors=doctors, **chain)


def known_doctors(spark, sf):
    """Doctors whose numbers some of the bound texts carry."""
    return B.doctors(spark, sf).withColumn("registration_number", F.concat(F.lit("MH - "), 10000 + F.col("doctor_id")))


def folded(spark, sf, batches: int = BATCHES, conditions=None) -> str:
    """The folder of a history that the documents were folded into, batch by batch, out of the order of their days."""
    routed, rows = PR.normalized_medications(dealt(B.rx_documents(spark, sf)), brand_table(spark))
    doctors = known_doctors(spark, sf)
    rows = cut_lineage(spark, D.with_doctor_ids(rows.join(routed.select("doc_id", "doctor_reg"), "doc_id"), doctors), "medications")
    registered = D.registered_doctors(rows, doctors)
    out = shared_folder(spark, "history")
    if conditions is not None:
        SH.store_conditions(conditions, out, QUERY_BUCKETS)
    for n in range(batches):
        SH.update_stored_history(rows.where(F.col("doc_id") % batches == n), registered, B.AS_OF_RX, out, QUERY_BUCKETS)
    return out


@query("update_history", document_history("""SELECT patient_id, inn, episode_no, rx_id, doctor_id, raw_drug_name, dosage_value, dosage_unit, frequency, duration_days,
    row_number() OVER (PARTITION BY patient_id, inn, episode_no ORDER BY seq) AS refill_number, sha256(rx_id || '::' || inn) AS idempotency_key, CAST(rx_date AS VARCHAR) AS recorded_date FROM lines""", "lines"))
def update_history(spark, sf):
    return SH.read_buckets(spark, f"{folded(spark, sf)}/dosage_history").withColumn("recorded_date", F.col("recorded_date").cast("string"))


_EPISODE = ["patient_id", "inn", "episode_no", "dispensing_type", "status", "start_date", "estimated_end_date", "actual_end_date", "prescription_count", "version",
            "latest_dosage_value", "latest_frequency", "doctor_id"]
_DATES = {"start_date", "estimated_end_date", "actual_end_date"}


@query("update_history_episodes", document_history(f"SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' if c in _DATES else c for c in _EPISODE)} FROM episodes", "episodes"))
def update_history_episodes(spark, sf):
    return SH.read_buckets(spark, f"{folded(spark, sf)}/episodes").select(*[day(c) if c in _DATES else F.col(c) for c in _EPISODE])


@query("update_history_events", document_history("""SELECT patient_id, inn, episode_no, rx_id, CAST(rx_date AS VARCHAR) AS event_date,
      CASE WHEN n = 1 THEN 'MEDICATION_STARTED' WHEN dosage_value IS NOT DISTINCT FROM before_value THEN 'MEDICATION_CONTINUED' ELSE 'MEDICATION_DOSE_CHANGED' END AS event_type
    FROM (SELECT *, row_number() OVER w AS n, lag(dosage_value) OVER w AS before_value FROM lines WINDOW w AS (PARTITION BY patient_id, inn, episode_no ORDER BY seq))
    UNION ALL SELECT patient_id, inn, episode_no, NULL, CAST(actual_end_date AS VARCHAR), 'MEDICATION_COMPLETED' FROM episodes WHERE status = 'completed'
    UNION ALL SELECT d.patient_id, d.inn, NULL, d.rx_id, CAST(rx_date AS VARCHAR), 'MEDICATION_STARTED' FROM rx_drugs d JOIN defaults s ON s.inn = d.inn WHERE s.is_prn""", "episodes"))
def update_history_events(spark, sf):
    return SH.read_buckets(spark, f"{folded(spark, sf)}/events").withColumn("event_date", F.col("event_date").cast("string"))


# One batch over known conditions. Those of patients whom the batch does not touch stay as they are, and so do those not inferred.
@query("update_history_conditions", document_history("""SELECT coalesce(s.patient_id, i.patient_id) AS patient_id, coalesce(s.condition_code, i.condition_code) AS condition_code,
    CASE WHEN i.patient_id IS NOT NULL AND (s.status IS NULL OR s.status = 'resolved') THEN 'probable' ELSE s.status END AS status,
    CASE WHEN i.patient_id IS NOT NULL AND (s.status IS NULL OR s.status IN ('probable', 'resolved')) THEN i.confidence ELSE s.confidence END AS confidence
    FROM stored_conditions s FULL OUTER JOIN inferred i ON i.patient_id = s.patient_id AND i.condition_code = s.condition_code""", "inferred"))
def update_history_conditions(spark, sf):
    out = folded(spark, sf, 1, B.stored_conditions(spark, sf))
    return SH.read_buckets(spark, f"{out}/conditions").select("patient_id", "condition_code", "status", "confidence")
