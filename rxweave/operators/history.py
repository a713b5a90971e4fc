"""Patient history: prescriptions, timelines and the patient graph.

Every result is flat (one row per prescription, episode or dose), because a
list per patient would gather an unbounded number of rows in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxweave.functions.names import dosage_text
from rxweave.operators.medications import recent_prescriptions
from rxweave.refdata import prescribing as P


def history_medications(recent: DataFrame, med: DataFrame) -> DataFrame:
    """Lines of the listed prescriptions with defaults filled in."""
    name = F.col("raw_drug_name")
    return med.join(recent.select("rx_id", "patient_id"), "rx_id").select(
        "patient_id", "rx_id", name.alias("raw_drug_name"), F.coalesce("inn", name).alias("inn"),
        F.coalesce("inn", name).alias("standard_name"), F.coalesce("route", F.lit(P.DEFAULT_ROUTE)).alias("route"),
        "dosage_value", "dosage_unit", "frequency", "freq_per_day", "duration_days", "is_active")


def patient_history(patients: DataFrame, rx: DataFrame, med: DataFrame, found: DataFrame, limit: int | None = None) -> DataFrame:
    """The prescriptions of each patient, or the newest ``limit``, with their counts. Medication
    lines and interactions are counted per prescription before they meet it."""
    recent = rx if limit is None else recent_prescriptions(rx, limit)
    n_med = history_medications(recent, med).groupBy("rx_id").agg(
        F.count("*").alias("n_meds"), F.count_if(F.col("route") == P.DEFAULT_ROUTE).alias("n_oral"))
    n_int = found.groupBy("rx_id").agg(F.count("*").alias("n_interactions"), F.bool_or(F.col("severity") == "major").alias("major"))
    totals = rx.groupBy("patient_id").agg(F.count("*").alias("total_all"))
    zero = F.lit(0).cast("bigint")
    return (
        recent.join(n_med, "rx_id", "left").join(n_int, "rx_id", "left")
        .join(totals, "patient_id").join(patients.select("patient_id", "phone"), "patient_id")
        .select(
            "patient_id", "phone", "rx_id", "created_at", F.coalesce("n_meds", zero).alias("n_meds"), F.coalesce("n_oral", zero).alias("n_oral"),
            F.coalesce("n_interactions", zero).alias("n_interactions"), F.coalesce("major", F.lit(False)).alias("has_major"),
            (F.col("confidence") < P.REVIEW_THRESHOLD).alias("needs_review"),
            (F.col("total_all") if limit is None else F.least("total_all", F.lit(limit))).alias("total"), "total_all"))


def episode_view(episodes: DataFrame) -> DataFrame:
    return episodes.withColumn("latest_dosage", dosage_text(F.col("latest_dosage_value"), F.col("latest_dosage_unit")))


def patient_timeline(episodes: DataFrame, history: DataFrame, doctors: DataFrame) -> DataFrame:
    """Scheduled episodes with their dose rows and latest doctor."""
    doses = history.select("patient_id", "inn", "episode_no", "rx_id", "recorded_date", "refill_number", F.col("dosage_value").alias("dose"))
    doctor = doctors.select("doctor_id", F.col("name").alias("doctor_name"), "speciality")
    return (
        episode_view(episodes).join(doses, ["patient_id", "inn", "episode_no"], "left").join(doctor, "doctor_id", "left")
        .select("patient_id", "inn", "episode_no", "status", "start_date", "estimated_end_date", "prescription_count", "latest_dosage",
                "rx_id", "recorded_date", "refill_number", "dose", "doctor_id", "doctor_name", "speciality"))


def drug_timeline(episodes: DataFrame) -> DataFrame:
    """Per patient and drug: number of episodes and of dose rows, of which a
    scheduled episode has one per prescription and an as-needed one none."""
    doses = F.when(F.col("dispensing_type") == "scheduled", F.col("prescription_count")).otherwise(0)
    return episodes.groupBy("patient_id", "inn").agg(
        F.count("*").alias("episode_count"), F.min("start_date").alias("first_start"), F.max("start_date").alias("last_start"), F.sum(doses).alias("dose_rows"))


def timeline_sorted(episodes: DataFrame) -> DataFrame:
    """Episodes, newest first within a patient; a range sort that can split
    one patient over several tasks."""
    return episodes.orderBy("patient_id", F.col("start_date").desc(), "inn", "episode_no")


def episode_doctors(episodes: DataFrame, doctors: DataFrame) -> DataFrame:
    """Distinct doctors of each patient's active episodes."""
    seen = episodes.where((F.col("status") == "active") & F.col("doctor_id").isNotNull()).select("patient_id", "doctor_id").distinct()
    return seen.join(doctors, "doctor_id")


def ranked_conditions(conditions: DataFrame) -> DataFrame:
    """Conditions per patient, most certain first. A patient has at most one
    open row per condition code, so the window stays small."""
    order = Window.partitionBy("patient_id").orderBy(F.col("confidence").desc(), "condition_code")
    return conditions.withColumn("rank", F.row_number().over(order))


def patient_graph(patients: DataFrame, episodes: DataFrame, conditions: DataFrame, reactions: DataFrame, doctors: DataFrame) -> DataFrame:
    """Summary counts of every patient's history. Each part is counted per
    patient on its own, so the joins never multiply rows."""
    parts = [
        episodes.where(F.col("status") == "active").groupBy("patient_id").agg(F.count("*").alias("active_medication_count")),
        conditions.groupBy("patient_id").agg(
            F.count_if(F.col("status") == "probable").alias("probable_conditions"),
            F.count_if(F.col("status") == "confirmed").alias("confirmed_conditions"), F.max("confidence").alias("top_confidence")),
        reactions.where("is_active").groupBy("patient_id").agg(F.count("*").alias("active_reactions")),
        episode_doctors(episodes, doctors).groupBy("patient_id").agg(F.count("*").alias("prescribing_doctors")),
    ]
    result = patients.select("patient_id", "phone")
    for part in parts:
        result = result.join(part, "patient_id", "left")
    counts = ["active_medication_count", "probable_conditions", "confirmed_conditions", "active_reactions", "prescribing_doctors"]
    return result.fillna(0, subset=counts)


def patient_graph_entities(episodes: DataFrame, conditions: DataFrame, reactions: DataFrame, doctors: DataFrame) -> DataFrame:
    """The members of every patient's graph, one row each: active episodes,
    conditions, active reactions and doctors."""
    text = lambda c: F.col(c).cast("string")
    row = lambda df, section, key, value: df.select("patient_id", F.lit(section).alias("section"), key.alias("entity"), value.alias("detail"))
    active = episode_view(episodes.where(F.col("status") == "active"))
    return (
        row(active, "medication", F.col("inn"), text("latest_dosage"))
        .unionByName(row(conditions, "condition", F.col("condition_code"), F.col("status")))
        .unionByName(row(reactions.where("is_active"), "reaction", F.col("inn"), F.col("severity")))
        .unionByName(row(episode_doctors(episodes, doctors), "doctor", text("doctor_id"), F.col("speciality"))))
