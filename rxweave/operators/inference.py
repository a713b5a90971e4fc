"""Conditions inferred from medication episodes (noisy-OR evidence)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxweave.functions.names import speciality_group
from rxweave.refdata import signals as S
from rxweave.refdata import tables

REQUIRED_WORDS = sorted({row[-1] for row in S.SIGNALS if row[-1]})


def recent_episodes(episodes: DataFrame, as_of: dt.date) -> DataFrame:
    return episodes.where(
        F.col("status").isin("active", "completed", "prn_snapshot") & (F.col("start_date") >= F.add_months(F.lit(as_of), -12)))


def evidence(recent: DataFrame) -> DataFrame:
    """Episode × signal rows; a combination drug counts through each part.

    ``counts`` tells whether the episode has enough prescriptions for the signal.
    """
    signals = F.broadcast(tables.condition_signals(recent.sparkSession).withColumnRenamed("inn", "signal_inn"))
    parts = F.array_union(F.array("inn"), F.coalesce("fdc_components", F.array().cast("array<string>")))
    rows = recent.withColumn("signal_inn", F.explode(parts)).join(signals, "signal_inn")
    weight = F.when(F.col("status") == "active", F.lit(1.0)).otherwise(F.lit(S.INACTIVE_WEIGHT))
    last = F.coalesce("estimated_end_date", "actual_end_date", "start_date")
    return rows.select(
        "patient_id", "condition_code", "condition_name", "condition_group", "signal_inn", "signal_strength", "specificity",
        "condition_prevalence", "requires_speciality", "prescription_count", last.alias("last_date"),
        (F.col("signal_strength") * F.col("specificity") * weight).alias("factor"),
        (F.col("prescription_count") >= F.col("min_prescriptions")).alias("counts"))


def rollup(rows: DataFrame) -> DataFrame:
    """Evidence per patient and condition. Name, group, prevalence and the
    required speciality come from the alphabetically first drug present."""
    counts = F.col("counts")
    first = F.min_by(F.struct("condition_name", "condition_group", "condition_prevalence", "requires_speciality"), "signal_inn")
    return (
        rows.groupBy("patient_id", "condition_code")
        .agg(
            first.alias("meta"),
            (1 - F.product(F.when(counts, 1 - F.col("factor")).otherwise(F.lit(1.0)))).alias("noisy_or"),
            F.max(F.when(counts, F.col("prescription_count"))).alias("max_rx"),
            F.max(F.when(counts, F.col("last_date"))).alias("last_date"),
            F.count_if(counts).alias("n_factors"),
            # bounded by the number of signal drugs of the condition
            F.array_sort(F.collect_set(F.struct("signal_inn", "signal_strength", "specificity"))).alias("supporting"),
        )
        .where(F.col("n_factors") > 0).select("*", "meta.*").drop("meta")
    )


def patient_doctors(recent: DataFrame, doctors: DataFrame) -> DataFrame:
    """Per patient: primary speciality group of the prescribing doctors and the
    required specialities they cover."""
    spec = F.lower("speciality")
    seen = recent.select("patient_id", "doctor_id").where(F.col("doctor_id").isNotNull()).distinct()
    known = doctors.select("doctor_id", "speciality", speciality_group(F.col("speciality")).alias("speciality_group"))
    joined = seen.join(known, "doctor_id")
    general = F.col("speciality_group").isNull() | (F.col("speciality_group") == "general")
    covers = [F.coalesce(F.bool_or(spec.contains(w)), F.lit(False)).alias(w) for w in REQUIRED_WORDS]
    grouped = joined.groupBy("patient_id").agg(
        F.min_by(F.struct("speciality_group"), F.struct(general, F.col("doctor_id"))).alias("primary"), *covers)
    words = F.array_compact(F.array(*[F.when(F.col(w), F.lit(w)) for w in REQUIRED_WORDS]))
    return grouped.select("patient_id", F.col("primary.speciality_group").alias("speciality_group"), words.alias("covered"))


def speciality_gate(rows: DataFrame, by_patient: DataFrame) -> DataFrame:
    """Drop conditions whose required speciality no doctor of the patient has."""
    joined = rows.join(by_patient, "patient_id", "left")
    covered = F.array_contains("covered", F.lower("requires_speciality"))
    return joined.where(F.col("requires_speciality").isNull() | F.coalesce(covered, F.lit(False)))


def likelihood_ratio(group: Column, condition_group: Column) -> Column:
    """Ratio for (group, condition), else for (group, group), else 1."""
    table = {(g, c): r for g, c, r in S.SPECIALITY_RATIOS}
    own, any_ = None, None
    for (g, c), r in table.items():
        test, value = (group == g) & (condition_group == c), F.lit(r)
        own = F.when(test, value) if own is None else own.when(test, value)
        if g == c:
            any_ = F.when(group == g, value) if any_ is None else any_.when(group == g, value)
    return F.coalesce(own, any_, F.lit(1.0))


def _clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def confidence(noisy_or: Column, days_since: Column, group: Column, condition_group: Column, max_rx: Column, prior: Column) -> Column:
    """Noisy-OR, decayed to the prior, shifted by the speciality, weighted by
    the number of prescriptions."""
    combined = _clamp(noisy_or)
    decay = F.exp(F.lit(-S.DECAY_RATE) * (days_since - S.DECAY_START_DAYS))
    combined = F.when(days_since > S.DECAY_START_DAYS, _clamp(prior + (combined - prior) * decay)).otherwise(combined)
    ratio = likelihood_ratio(group, condition_group)
    inside = _clamp(combined, S.LOG_ODDS_EPS, 1 - S.LOG_ODDS_EPS)
    shifted = 1 / (1 + F.exp(-(F.ln(inside / (1 - inside)) + F.ln(ratio))))
    combined = F.when(ratio == 1.0, combined).otherwise(_clamp(shifted))
    credibility = F.least(F.lit(1.0), F.log1p(max_rx) / F.log1p(F.lit(S.FULL_CREDIBILITY_RX)))
    return F.round(_clamp(credibility * combined + (1 - credibility) * prior), 4)


def infer_conditions(episodes: DataFrame, doctors: DataFrame, as_of: dt.date) -> DataFrame:
    recent = recent_episodes(episodes, as_of)
    gated = speciality_gate(rollup(evidence(recent)), patient_doctors(recent, doctors))
    prior = F.coalesce(F.nullif(F.col("condition_prevalence"), F.lit(0.0)), F.lit(S.DEFAULT_PREVALENCE))
    since = F.date_diff(F.lit(as_of), F.col("last_date"))
    scored = gated.withColumn("days_since_last_rx", since).withColumn(
        "confidence", confidence(F.col("noisy_or"), since, F.col("speciality_group"), F.col("condition_group"), F.col("max_rx"), prior))
    return scored.where(F.col("confidence") >= S.MIN_CONFIDENCE)


def merge_conditions(inferred: DataFrame, stored: DataFrame, suppress_rejected: bool = True) -> DataFrame:
    """Stored conditions after an inference run, with the action per row.

    Confirmed rows stay, probable rows take the new confidence, new conditions
    are inserted as probable. A rejected condition stays rejected unless
    ``suppress_rejected`` is off.
    """
    keys = ["patient_id", "condition_code"]
    new = inferred.select(*keys, F.col("condition_name").alias("new_name"), F.col("condition_group").alias("new_group"), F.col("confidence").alias("new_confidence"))
    both = stored.join(new, keys, "full_outer")
    held = F.col("status").isin(["confirmed", "rejected"] if suppress_rejected else ["confirmed"])
    found = F.col("new_confidence").isNotNull()
    action = (
        F.when(~found, "unchanged").when(F.col("status").isNull(), "inserted").when(held, "kept")
        .when(F.col("status") == "probable", "updated").otherwise("reopened"))
    merged = both.withColumn("action", action)
    takes = F.col("action").isin("inserted", "updated", "reopened")
    return merged.select(
        *keys, F.coalesce("condition_name", "new_name").alias("condition_name"),
        F.coalesce("condition_group", "new_group").alias("condition_group"),
        F.when(F.col("action").isin("inserted", "reopened"), "probable").otherwise(F.col("status")).alias("status"),
        F.col("confidence").alias("old_confidence"),
        F.when(takes, F.col("new_confidence")).otherwise(F.col("confidence")).alias("confidence"), "action")
