"""Medication episodes per patient and drug.

A prescription continues the open episode when the episode has no known end or
the prescription falls within the gap tolerance after it; otherwise the episode
is closed and a new one starts. The end is the latest known end so far.

All prescriptions of one patient, drug and day share an episode, so the
boundaries are found on one row per day: lines are first aggregated to days
(combined before the shuffle) and the windows then run over at most one row per
calendar day, however many lines a single patient or drug has.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxweave.functions.names import fdc_components
from rxweave.operators.events import emit
from rxweave.refdata import signals as S
from rxweave.refdata import tables
from rxweave.session import cut_lineage

LINE_FIELDS = ["dosage_value", "dosage_unit", "frequency", "duration_days", "doctor_id", "raw_drug_name"]
DAY_KEYS = ["patient_id", "inn", "rx_date"]
DOSE_FIELDS = ["dosage_value", "dosage_unit"]
#: A day with more prescriptions of one patient and drug is numbered in several pieces.
LARGE_DAY = 10_000


def signal_defaults(spark) -> DataFrame:
    """Gap tolerance, class and as-needed flag of each drug with a signal."""
    pick = F.min_by(F.struct("episode_gap_tolerance", "medication_class", "is_prn"), "condition_code")
    return tables.condition_signals(spark).groupBy("inn").agg(pick.alias("s")).select("inn", "s.*")


def with_defaults(lines: DataFrame) -> DataFrame:
    known = F.broadcast(signal_defaults(lines.sparkSession))
    return lines.join(known, "inn", "left").fillna({
        "episode_gap_tolerance": S.DEFAULT_GAP_DAYS, "medication_class": S.DEFAULT_MEDICATION_CLASS, "is_prn": S.DEFAULT_IS_PRN})


def named_lines(lines: DataFrame) -> DataFrame:
    """Lines with a drug, their fields in ``l``."""
    inn = F.lower(F.trim("inn"))
    return lines.where(F.coalesce(inn, F.lit("")) != "").select("patient_id", inn.alias("inn"), "rx_id", "rx_date", F.struct("line_no", *LINE_FIELDS).alias("l"))


def least_lines(named: DataFrame) -> DataFrame:
    """The first of ``named_lines`` of each prescription and drug."""
    return named.groupBy("patient_id", "inn", "rx_id", "rx_date").agg(F.min("l").alias("l"))


def first_lines(lines: DataFrame) -> DataFrame:
    """The first line ``l`` of each prescription and drug."""
    return least_lines(named_lines(lines))


def line_columns(first: DataFrame) -> DataFrame:
    """``first_lines`` with the fields of the line as columns."""
    return first.select("patient_id", "inn", "rx_id", "rx_date", *[F.col(f"l.{f}").alias(f) for f in LINE_FIELDS])


def prescription_drugs(lines: DataFrame) -> DataFrame:
    """One row per prescription and drug: the first line of the pair counts,
    so a repeated upload or line never counts twice."""
    return line_columns(first_lines(lines))


def _end(rx_date: Column, days: Column) -> Column:
    return F.when(days > 0, F.date_add(rx_date, days))


def prescription_days(drugs: DataFrame) -> DataFrame:
    """One row per patient, scheduled drug and day."""
    latest = F.max_by(F.struct(*LINE_FIELDS), "rx_id")
    return (
        with_defaults(drugs).where(~F.col("is_prn"))
        .groupBy("patient_id", "inn", "rx_date")
        .agg(
            F.count("*").alias("n_rx"), F.max(_end(F.col("rx_date"), F.col("duration_days"))).alias("day_end"),
            latest.alias("day_latest"), F.first("episode_gap_tolerance").alias("gap_days"))
    )


def number_days(days: DataFrame) -> DataFrame:
    """``prescription_days`` with their episode numbers."""
    order = Window.partitionBy("patient_id", "inn").orderBy("rx_date")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # A day past the tolerance splits only once per known end: without a newer
    # end the episode it started is open-ended and takes the following days.
    marked = days.withColumn("_end", F.max("day_end").over(before)).withColumn(
        "_late", F.coalesce(F.col("rx_date") > F.date_add("_end", F.col("gap_days")), F.lit(False)))
    repeat = F.coalesce(F.lag("_late").over(order) & F.lag("_end").over(order).eqNullSafe(F.col("_end")), F.lit(False))
    split = marked.withColumn("_split", (F.col("_late") & ~repeat).cast("int"))
    numbered = split.withColumn("episode_no", F.sum("_split").over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1)
    within = Window.partitionBy("patient_id", "inn", "episode_no").orderBy("rx_date")
    return numbered.select(
        "patient_id", "inn", "rx_date", "n_rx", "day_end", "day_latest", "gap_days", "episode_no",
        F.coalesce(F.sum("n_rx").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rx_before"),
        F.lag("day_latest").over(within).alias("previous_latest"))


def episode_days(drugs: DataFrame) -> DataFrame:
    """One row per patient, drug and day with its episode number."""
    return number_days(prescription_days(drugs))


def _shape(df: DataFrame) -> DataFrame:
    return df.select(
        "patient_id", "inn", "episode_no", F.col("inn").contains("+").alias("is_fdc"),
        fdc_components(F.col("inn")).alias("fdc_components"), "dispensing_type", "status",
        "start_date", "estimated_end_date", "actual_end_date", "gap_days", "prescription_count", "version",
        F.col("latest.dosage_value").alias("latest_dosage_value"), F.col("latest.dosage_unit").alias("latest_dosage_unit"),
        F.col("latest.frequency").alias("latest_frequency"), F.col("latest.doctor_id").alias("doctor_id"))


def grouped_days(days: DataFrame) -> DataFrame:
    """One row per episode of ``number_days``, and whether another one follows it."""
    grouped = days.groupBy("patient_id", "inn", "episode_no").agg(
        F.min("rx_date").alias("start_date"), F.max("day_end").alias("estimated_end_date"),
        F.sum("n_rx").alias("prescription_count"), F.first("gap_days").alias("gap_days"),
        F.max_by("day_latest", "rx_date").alias("latest"), F.max("rx_date").alias("last_date"))
    last = F.max("episode_no").over(Window.partitionBy("patient_id", "inn"))
    return grouped.withColumn("closed", F.col("episode_no") < last)


def shaped_episodes(grouped: DataFrame) -> DataFrame:
    """Episodes of drugs taken on a schedule, from ``grouped_days``."""
    return _shape(grouped.select(
        "*", F.lit("scheduled").alias("dispensing_type"), F.when(F.col("closed"), "completed").otherwise("active").alias("status"),
        F.when(F.col("closed"), F.col("estimated_end_date")).alias("actual_end_date"),
        (F.col("prescription_count") + F.col("closed").cast("int")).alias("version")))


def scheduled_episodes(days: DataFrame) -> DataFrame:
    """Episodes of drugs taken on a schedule, from ``episode_days``."""
    return shaped_episodes(grouped_days(days))


def prn_snapshots(drugs: DataFrame) -> DataFrame:
    """As-needed drugs: every prescription is a snapshot of its own."""
    prn = with_defaults(drugs).where("is_prn")
    return prn.select(
        "patient_id", "inn", "rx_id", F.col("rx_date").alias("start_date"), _end(F.col("rx_date"), F.col("duration_days")).alias("estimated_end_date"),
        F.col("episode_gap_tolerance").alias("gap_days"), "dosage_value", "dosage_unit", "frequency", "doctor_id")


def prn_episodes(drugs: DataFrame) -> DataFrame:
    """As-needed snapshots in the form of episodes."""
    return _shape(prn_snapshots(drugs).select(
        "*", F.lit(None).cast("bigint").alias("episode_no"), F.lit("prn").alias("dispensing_type"), F.lit("prn_snapshot").alias("status"),
        F.lit(None).cast("date").alias("actual_end_date"), F.lit(1).cast("bigint").alias("prescription_count"),
        F.lit(1).cast("bigint").alias("version"), F.struct("dosage_value", "dosage_unit", "frequency", "doctor_id").alias("latest")))


def medication_episodes(drugs: DataFrame) -> DataFrame:
    """Scheduled episodes and as-needed snapshots of ``prescription_drugs``."""
    return scheduled_episodes(episode_days(drugs)).unionByName(prn_episodes(drugs))


def stored_days(drugs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``drugs`` and their ``episode_days``, each written once for results that use them several times."""
    spark = drugs.sparkSession
    drugs = cut_lineage(spark, drugs, "drugs")
    return drugs, cut_lineage(spark, episode_days(drugs), "episode_days")


def episode_lines(drugs: DataFrame, days: DataFrame, large_day: int = LARGE_DAY) -> DataFrame:
    """Prescriptions with their episode, refill number and previous dose.

    Lines of a day are ordered by prescription id. A day of at most
    ``large_day`` lines is ordered in one piece; larger ones, of which there
    are few, go by ``large_day_starts``. Hand in ``days`` that are stored: they
    are looked through for large days.
    """
    carried = F.struct(*[F.col(f"previous_latest.{f}").alias(f) for f in DOSE_FIELDS])
    starts = days.select(*DAY_KEYS, "n_rx", "episode_no", F.col("rx_before").alias("_before"), carried.alias("_carried"))
    small = starts.where(F.col("n_rx") <= large_day).drop("n_rx")
    large = starts.where(F.col("n_rx") > large_day).drop("n_rx")
    numbered = _numbered(drugs.join(small, DAY_KEYS), DAY_KEYS, drugs.columns)
    if large.isEmpty():
        return numbered
    placed = large_day_starts(drugs.join(large.select(*DAY_KEYS), DAY_KEYS, "left_semi"), large)
    return numbered.unionByName(_numbered(placed, [*DAY_KEYS, "_bucket"], drugs.columns))


def _numbered(lines: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Lines numbered by prescription id within ``keys``, after the ``_before`` lines and the dose ``_carried`` that precede them."""
    order = Window.partitionBy(*keys).orderBy("rx_id")
    position = F.row_number().over(order)
    return lines.select(
        *columns, "episode_no", (F.col("_before") + position).alias("refill_number"),
        F.when(position > 1, F.lag(F.struct(*DOSE_FIELDS)).over(order)).otherwise(F.col("_carried")).alias("previous_dose"))


def large_day_starts(drugs: DataFrame, starts: DataFrame) -> DataFrame:
    """Lines of very large days in id buckets: each bucket knows how many lines
    and which dose came before it, and only rows within a bucket are ordered.

    A bucket is what a range partitioning by day and id puts into one
    partition; it takes its bounds from the data, for ids of any type. It is
    written once, so that all uses of a bucket agree.
    """
    lines = cut_lineage(drugs.sparkSession, drugs.repartitionByRange(*DAY_KEYS, "rx_id").withColumn("_bucket", F.spark_partition_id()), "days")
    over_day = Window.partitionBy(*DAY_KEYS).orderBy("_bucket")
    buckets = lines.groupBy(*DAY_KEYS, "_bucket").agg(F.count("*").alias("_n"), F.max_by(F.struct(*DOSE_FIELDS), "rx_id").alias("_last")).select(
        *DAY_KEYS, "_bucket",
        F.coalesce(F.sum("_n").over(over_day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_in_day"),
        F.lag("_last").over(over_day).alias("_bucket_before"))
    placed = buckets.join(starts, DAY_KEYS).select(
        *DAY_KEYS, "_bucket", "episode_no", (F.col("_before") + F.col("_in_day")).alias("_before"),
        F.coalesce("_bucket_before", "_carried").alias("_carried"))
    return lines.join(placed, [*DAY_KEYS, "_bucket"])


def dosage_history(lines: DataFrame) -> DataFrame:
    """One row per prescription and drug with its idempotency key."""
    key = F.sha2(F.concat(F.col("rx_id").cast("string"), F.lit("::"), F.col("inn")), 256)
    return lines.select(
        "patient_id", "inn", "episode_no", "rx_id", "doctor_id", "raw_drug_name", "dosage_value", "dosage_unit", "frequency",
        "duration_days", "refill_number", key.alias("idempotency_key"), F.col("rx_date").alias("recorded_date"))


def episode_events(lines: DataFrame, episodes: DataFrame, prn: DataFrame) -> DataFrame:
    """Started, continued, dose-changed and completed events."""
    same = (
        F.col("dosage_value").eqNullSafe(F.col("previous_dose.dosage_value"))
        & F.col("dosage_unit").eqNullSafe(F.col("previous_dose.dosage_unit")))
    kind = F.when(F.col("refill_number") == 1, "MEDICATION_STARTED").when(same, "MEDICATION_CONTINUED").otherwise("MEDICATION_DOSE_CHANGED")
    per_line = lines.select("patient_id", "inn", "episode_no", "rx_id", F.col("rx_date").alias("event_date"), kind.alias("event_type"))
    none = F.lit(None).cast("bigint")
    closed = episodes.where(F.col("status") == "completed").select(
        "patient_id", "inn", "episode_no", none.alias("rx_id"), F.col("actual_end_date").alias("event_date"), F.lit("MEDICATION_COMPLETED").alias("event_type"))
    snapshots = prn.select(
        "patient_id", "inn", none.alias("episode_no"), "rx_id", F.col("start_date").alias("event_date"), F.lit("MEDICATION_STARTED").alias("event_type"))
    return per_line.unionByName(closed).unionByName(snapshots)


def discontinued_events(episodes: DataFrame, feed: DataFrame) -> DataFrame:
    """One event per episode that the feed closes."""
    keys = ["patient_id", "inn", "episode_no"]
    closed = feed.join(episodes.select(*keys), keys, "left_semi").withColumn("episode_id", F.col("episode_no"))
    return emit(closed, F.lit("MEDICATION_DISCONTINUED"), ["inn", "episode_id", "stop_reason", "switched_to_inn"])


def discontinue(episodes: DataFrame, feed: DataFrame, as_of: dt.date) -> DataFrame:
    """Close the episodes named in a feed of (patient, inn, episode_no)."""
    keys = ["patient_id", "inn", "episode_no"]
    stop = feed.select(*keys, "stop_reason", "switched_to_inn", F.lit(True).alias("_stop"))
    hit = F.coalesce("_stop", F.lit(False))
    return (
        episodes.join(stop, keys, "left")
        .withColumn("status", F.when(hit, "discontinued").otherwise(F.col("status")))
        .withColumn("actual_end_date", F.when(hit, F.lit(as_of)).otherwise(F.col("actual_end_date")))
        .withColumn("version", F.col("version") + hit.cast("int"))
        .drop("_stop")
    )
