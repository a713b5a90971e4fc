"""Review queue, access and audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxweave.functions.labs import route_reason
from rxweave.refdata import prescribing as P


def open_items(queue: DataFrame) -> DataFrame:
    return queue.where(~F.col("resolved"))


def newest_first(queue: DataFrame) -> DataFrame:
    return open_items(queue).orderBy(F.col("created_at").desc(), "item_id")


def _in_scope():
    return (
        F.when(F.col("scopes") == "rx", F.col("item_type") == "prescription")
        .when(F.col("scopes") == "lab", F.col("item_type") == "lab").otherwise(True))


def scoped_queue(queue: DataFrame, clinicians: DataFrame) -> DataFrame:
    """Open items per facility and document scope that some clinician works in.

    A clinician's queue is the part with the own facility and scope; an item
    appears at most once per scope, however many clinicians share it.
    """
    views = clinicians.select("scopes", F.col("active_facility_id").alias("facility_id")).distinct()
    return open_items(queue).join(views, "facility_id").where(_in_scope()).select("facility_id", "scopes", "item_id", "item_type")


def facility_access(queue: DataFrame, clinicians: DataFrame, bridge: DataFrame) -> DataFrame:
    """How many items each clinician may open: those of own facilities, plus
    the items without a facility, which everyone may open.

    Items are counted per facility and type first; the answer for a single
    item is ``may_open``.
    """
    counts = queue.groupBy("facility_id", "item_type").agg(F.count("*").alias("n"))
    scoped = clinicians.select("clinician_id", "scopes")
    own = counts.where(F.col("facility_id").isNotNull()).join(bridge, "facility_id").join(scoped, "clinician_id").where(_in_scope())
    shared = counts.where(F.col("facility_id").isNull()).groupBy("item_type").agg(F.sum("n").alias("n"))
    by_scope = {s: F.sum(F.when(F.col("item_type") == t, F.col("n"))) for s, t in [("rx", "prescription"), ("lab", "lab")]}
    open_to_all = shared.agg(by_scope["rx"].alias("rx"), by_scope["lab"].alias("lab"), F.sum("n").alias("both"))
    per_scope = open_to_all.unpivot([], ["rx", "lab", "both"], "scopes", "n_shared")
    own_n = own.groupBy("clinician_id").agg(F.sum("n").alias("n_own"))
    zero = F.lit(0).cast("bigint")
    return (
        scoped.join(own_n, "clinician_id", "left").join(F.broadcast(per_scope), "scopes", "left")
        .select("clinician_id", F.coalesce("n_own", zero).alias("n_own"), F.coalesce("n_shared", zero).alias("n_shared")))


def may_open(requests: DataFrame, queue: DataFrame, clinicians: DataFrame, bridge: DataFrame) -> DataFrame:
    """Answer per requested (clinician, item): allowed or not."""
    item = queue.select("item_id", "item_type", "facility_id")
    member = bridge.select("clinician_id", "facility_id", F.lit(True).alias("_member"))
    joined = requests.join(item, "item_id").join(clinicians.select("clinician_id", "scopes"), "clinician_id").join(member, ["clinician_id", "facility_id"], "left")
    return joined.select("clinician_id", "item_id", ((F.col("facility_id").isNull() | F.col("_member").isNotNull()) & _in_scope()).alias("allowed"))


def queue_with_phone(queue: DataFrame, patients: DataFrame) -> DataFrame:
    return open_items(queue).join(patients.select("patient_id", "phone"), "patient_id", "left")


def cap_audit_confidence(docs: DataFrame) -> DataFrame:
    return docs.withColumn("confidence", F.least(F.lit(P.AUDIT_CONFIDENCE_CAP), F.col("confidence"))).withColumn(
        "reason", F.lit("Direct upload for clinical audit."))


def route_lab(reports: DataFrame) -> DataFrame:
    """Flag low-confidence lab reports and give the reason."""
    low = F.col("confidence") < P.REVIEW_THRESHOLD
    return reports.withColumn("needs_review", low).withColumn("reason", F.when(low, route_reason(F.col("report_date"), F.col("n_results"))))


def audit_oversight(logs: DataFrame, clinicians: DataFrame, facilities: DataFrame) -> DataFrame:
    """Audit rows that wait for oversight, with names or "Unknown"."""
    who = clinicians.select("clinician_id", F.col("name").alias("clinician_name"), F.col("email").alias("clinician_email"))
    where = facilities.select("facility_id", F.col("name").alias("facility_name"))
    unknown = lambda c: F.coalesce(F.col(c), F.lit("Unknown")).alias(c)
    return (
        logs.where("needs_admin_oversight").join(who, "clinician_id", "left").join(where, "facility_id", "left")
        .select("log_id", unknown("clinician_name"), unknown("clinician_email"), unknown("facility_name"), "action", "created_at"))
