"""Reviewers' corrections of queued prescriptions, from a feed of attempts to all stored tables.

An attempt is refused if its item or clinician is unknown, or lies outside the
clinician's facilities or scope, and rejected if a major interaction or a
critical alert lacks an override reason. The first attempt of an item that passes
resolves it: a prescription with confidence 1, its medication lines and
interactions, and an audit row are stored, and the queue row is closed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxweave.functions.names import parse_date
from rxweave.operators.brands import normalize_drugs
from rxweave.operators.interactions import document_interactions
from rxweave.operators.medications import distinct_inns
from rxweave.operators.safety import safety_alerts
from rxweave.session import cut_lineage
from rxweave.streaming.files import put

HEADER = ["doctor_reg", "patient_age", "diagnosis", "prescription_date"]
QUEUE_BUCKETS = 256


def access(feed: DataFrame, queue: DataFrame, clinicians: DataFrame, bridge: DataFrame) -> DataFrame:
    """The feed with its items' type, facility and state, and ``problem``: why an attempt may not be made, null if it may."""
    items = queue.select("item_id", "item_type", F.col("facility_id").alias("item_facility"), "resolved", F.col("patient_id").alias("item_patient"))
    known = feed.join(items, "item_id", "left").join(clinicians.select("clinician_id", "scopes"), "clinician_id", "left")
    member = bridge.select("clinician_id", F.col("facility_id").alias("item_facility"), F.lit(True).alias("member")).distinct()
    home = bridge.groupBy("clinician_id").agg(F.min("facility_id").alias("home_facility"))
    joined = known.join(member, ["clinician_id", "item_facility"], "left").join(home, "clinician_id", "left")
    problem = (
        F.when(F.col("item_type").isNull(), "item_not_found").when(F.col("scopes").isNull(), "clinician_not_found")
        .when(F.col("item_facility").isNotNull() & F.col("member").isNull(), "facility").when(F.col("scopes") == "lab", "scope")
        .when(F.col("item_type") != "prescription", "wrong_type").when(F.col("resolved"), "closed"))
    return joined.withColumn("problem", problem).drop("member")


def resolve_prescriptions(feed: DataFrame, lines: DataFrame, queue: DataFrame, clinicians: DataFrame, bridge: DataFrame, brands: DataFrame,
                          active: DataFrame, labs: DataFrame, rules: DataFrame) -> dict[str, DataFrame]:
    """Judge all attempts of a feed and derive the rows to store.

    ``feed``: seq (distinct, the order), item_id, clinician_id, patient_id (null:
    none given), override_reason and the header fields. ``lines``: seq, line_no,
    raw_drug_name and the dose fields of each attempt. ``active``: the patients'
    current distinct drugs; attempts of one feed don't see each other's.

    ``outcomes``: one row per attempt with ``outcome`` (resolved, rejected or
    refused) and ``problem``; ``prescriptions``, ``medications``, ``interactions``
    and ``audit``: rows to add; ``queue``: closed rows in place of open ones.
    """
    spark = feed.sparkSession
    attempts = cut_lineage(spark, access(feed, queue, clinicians, bridge), "attempts")
    allowed = attempts.where("problem IS NULL").select("seq", "patient_id")
    named = cut_lineage(spark, normalize_drugs(lines.join(allowed.select("seq"), "seq", "left_semi"), brands), "corrected")
    drugs = distinct_inns(named, "seq")
    found = cut_lineage(spark, document_interactions(allowed.join(drugs, "seq"), active, "seq"), "interactions")
    alerts = safety_alerts(drugs.join(allowed.where("patient_id IS NOT NULL"), "seq"), labs, rules, ("seq", "patient_id"))
    per = found.groupBy("seq").agg(F.bool_or(F.col("severity") == "major").alias("has_major"), F.count("*").alias("n_interactions"))
    critical = alerts.groupBy("seq").agg(F.bool_or(F.col("severity") == "critical").alias("has_critical"), F.count("*").alias("n_alerts"))
    judged = attempts.join(per, "seq", "left").join(critical, "seq", "left").fillna({"has_major": False, "has_critical": False, "n_interactions": 0, "n_alerts": 0})
    needs = F.col("has_major") | F.col("has_critical")
    reason = F.nullif(F.trim("override_reason"), F.lit(""))
    judged = judged.withColumn("needs_override", needs).withColumn("passes", F.col("problem").isNull() & (~needs | reason.isNotNull()))
    judged = cut_lineage(spark, judged, "attempts_judged")
    first = judged.where("passes").groupBy("item_id").agg(F.min("seq").alias("_first"))
    told = judged.join(first, "item_id", "left")
    resolved = F.col("passes") & (F.col("seq") == F.col("_first"))
    # an attempt that comes after the one that resolved its item finds it closed
    late = F.col("problem").isNull() & (F.col("seq") > F.col("_first"))
    outcome = F.when(resolved, "resolved").when(F.col("problem").isNotNull() | F.coalesce(late, F.lit(False)), "refused").otherwise("rejected")
    problem = F.coalesce("problem", F.when(late, "closed"), F.when(~F.col("passes"), "override_required"))
    told = told.select("*", outcome.alias("outcome"), problem.alias("why"))
    outcomes = told.select("seq", "item_id", "clinician_id", "patient_id", "has_major", "has_critical", "n_interactions", "n_alerts", "outcome", F.col("why").alias("problem"))

    done = cut_lineage(spark, told.where("outcome = 'resolved'"), "resolved")
    rx_id = F.concat(F.lit("resolution-"), F.col("seq").cast("string")).alias("rx_id")
    own = done.select("seq")
    audit = done.select(
        "clinician_id", F.coalesce("item_facility", "home_facility").alias("facility_id"), "item_id",
        F.when(F.col("needs_override"), "override_safety").otherwise("resolve_rx").alias("action"),
        F.when(F.col("needs_override"), F.col("override_reason")).alias("override_reason"), F.col("needs_override").alias("needs_admin_oversight"))
    header = [parse_date(F.col(c)).alias(c) if c == "prescription_date" else F.col(c) for c in HEADER]
    closed = done.select("item_id", F.coalesce("patient_id", "item_patient").alias("patient_id"), F.lit(True).alias("resolved"))
    return {
        "outcomes": outcomes,
        "prescriptions": done.select(rx_id, "item_id", "patient_id", F.col("item_facility").alias("facility_id"), *header, F.lit(1.0).alias("confidence")),
        "medications": named.join(own, "seq", "left_semi").select(rx_id, *[c for c in named.columns if c != "seq"], F.lit(True).alias("is_active")),
        "interactions": found.join(own, "seq", "left_semi").select(rx_id, *[c for c in found.columns if c != "seq"]),
        "audit": audit,
        "queue": closed}


def bucket_of(key: str, n: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")


def store_queue(queue: DataFrame, path: str, buckets: int = QUEUE_BUCKETS) -> None:
    """Write a queue table in hash buckets of its items."""
    queue.withColumn("bucket", bucket_of("item_id", buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def close_items(spark: SparkSession, path: str, closed: DataFrame, buckets: int = QUEUE_BUCKETS) -> list[int]:
    """Merge closed rows into a stored queue; returns the buckets that were read and written, which are those of the closed items only.

    Spark replaces the files of a bucket when all its rows are written, so a
    repeated merge gives the same table.
    """
    touched = sorted(r[0] for r in closed.select(bucket_of("item_id", buckets).alias("b")).distinct().collect())  # at most as many as there are buckets
    if not touched:
        return []
    stored = spark.read.parquet(path).where(F.col("bucket").isin(touched))
    new = closed.select("item_id", F.col("patient_id").alias("_patient"), F.col("resolved").alias("_resolved"))
    merged = stored.join(new, "item_id", "left").select(
        *[F.coalesce(F.col(n), F.col(c)).alias(c) if n else F.col(c) for c in stored.columns for n in [{"patient_id": "_patient", "resolved": "_resolved"}.get(c)]])
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def store_resolutions(spark: SparkSession, out: str, run: int, tables: dict[str, DataFrame], queue_path: str, buckets: int = QUEUE_BUCKETS) -> list[int]:
    """Store what a feed resolved, under the run's number; a repeated run replaces its own rows. The queue is closed last."""
    for name in ("prescriptions", "medications", "interactions", "audit", "outcomes"):
        put(tables[name], f"{out}/{name}", run)
    return close_items(spark, queue_path, tables["queue"], buckets)
