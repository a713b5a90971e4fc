"""Queries over episodes, doctors, conditions and the patient graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxweave import bindings as B
from rxweave.catalog.base import query
from rxweave.catalog.core import active_drugs, day, keyed_alerts, latest, rule_table
from rxweave.catalog.sqlbind import AS_OF, at, group_case, sql
from rxweave.functions import names as N
from rxweave.operators import doctors as D
from rxweave.operators import episodes as E
from rxweave.operators import events as EV
from rxweave.operators import history as H
from rxweave.operators import inference as INF
from rxweave.operators import maintenance as M
from rxweave.refdata import tables
from rxweave.session import cut_lineage


def drugs_of(spark, sf):
    return E.prescription_drugs(B.dated_medications(spark, sf))


def episodes_of(spark, sf):
    return E.medication_episodes(drugs_of(spark, sf))


def history_of(spark, sf):
    return E.dosage_history(E.episode_lines(*E.stored_days(drugs_of(spark, sf))))


def doctors_of(spark, sf):
    return B.doctors(spark, sf)


def inferred_of(spark, sf):
    return INF.infer_conditions(episodes_of(spark, sf), doctors_of(spark, sf), B.AS_OF_RX)


# --- signals ------------------------------------------------------------------

@query("signals_by_group", sql("SELECT s.condition_group, count(DISTINCT s.inn || s.condition_code) AS n_signals, count(m.rx_id) AS n_lines FROM signals s LEFT JOIN medications m ON m.inn = s.inn GROUP BY 1"))
def signals_by_group(spark, sf):
    uses = B.medication_lines(spark, sf).groupBy("inn").agg(F.count("*").alias("n"))
    grouped = tables.condition_signals(spark).join(uses, "inn", "left").groupBy("condition_group").agg(
        F.count("*").alias("n_signals"), F.sum(F.coalesce("n", F.lit(0))).alias("n_lines"))
    return grouped.orderBy(F.col("n_signals").desc(), "condition_group")


@query("seed_delta", sql("SELECT count(*) AS rows_before, count(*) + (SELECT count(*) FROM (SELECT inn FROM signals EXCEPT SELECT inn FROM used)) AS rows_after FROM used", used="SELECT DISTINCT inn FROM medications"))
def seed_delta(spark, sf):
    """Drugs on file before and after adding those of the signal table."""
    used = B.medication_lines(spark, sf).select("inn").distinct()
    fresh = tables.condition_signals(spark).select("inn").distinct().join(used, "inn", "left_anti")
    both = used.select(F.lit(1).alias("old")).unionByName(fresh.select(F.lit(0).alias("old")))
    return both.agg(F.count_if(F.col("old") == 1).alias("rows_before"), F.count("*").alias("rows_after"))


@query("signal_defaults", sql("SELECT m.inn, coalesce(d.gap_days, 45) AS gap_days, coalesce(d.medication_class, 'chronic_oral') AS medication_class, coalesce(d.is_prn, FALSE) AS is_prn FROM (SELECT DISTINCT inn FROM medications) m LEFT JOIN defaults d ON d.inn = m.inn"))
def signal_defaults(spark, sf):
    drugs = B.medication_lines(spark, sf).select("inn").distinct()
    return E.with_defaults(drugs).select("inn", F.col("episode_gap_tolerance").alias("gap_days"), "medication_class", "is_prn")


@query("condition_metadata", sql("SELECT patient_id, condition_code, condition_name, condition_group, prior, required FROM rolled"))
def condition_metadata(spark, sf):
    rolled = INF.rollup(INF.evidence(INF.recent_episodes(episodes_of(spark, sf), B.AS_OF_RX)))
    return rolled.select("patient_id", "condition_code", "condition_name", "condition_group", F.col("condition_prevalence").alias("prior"), F.coalesce("requires_speciality", F.lit("")).alias("required"))


# --- episodes -------------------------------------------------------------------

@query("split_fdc", sql("SELECT rx_id, line_no, inn, contains(inn, '+') AS is_fdc, CASE WHEN contains(inn, '+') THEN array_to_string(list_transform(string_split(inn, '+'), lambda x: trim(x)), '|') ELSE '' END AS parts FROM medications"))
def split_fdc(spark, sf):
    parts = F.concat_ws("|", N.fdc_components(F.col("inn")))
    return B.medication_lines(spark, sf).select("rx_id", "line_no", "inn", F.col("inn").contains("+").alias("is_fdc"), parts.alias("parts"))


_EP = ["patient_id", "inn", "episode_no", "dispensing_type", "status", "start_date", "estimated_end_date", "actual_end_date", "prescription_count", "version", "latest_dosage_value", "latest_frequency", "doctor_id"]
_DATES = {"start_date", "estimated_end_date", "actual_end_date"}


def shown(columns):
    return [day(c) if c in _DATES else F.col(c) for c in columns]


def shown_sql(columns):
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}" if c in _DATES else c for c in columns)


@query("medication_episodes", sql(f"SELECT {shown_sql(_EP)} FROM episodes"))
def medication_episodes(spark, sf):
    return episodes_of(spark, sf).select(*shown(_EP))


@query("prn_snapshots", sql("SELECT d.patient_id, d.inn, d.rx_id, CAST(rx_date AS VARCHAR) AS start_date, CAST(rx_date + CAST(duration_days AS INTEGER) AS VARCHAR) AS estimated_end_date, dosage_value FROM rx_drugs d JOIN defaults s ON s.inn = d.inn WHERE s.is_prn"))
def prn_snapshots(spark, sf):
    return E.prn_snapshots(drugs_of(spark, sf)).select("patient_id", "inn", "rx_id", day("start_date"), day("estimated_end_date"), "dosage_value")


@query("episode_events", sql("""SELECT patient_id, inn, episode_no, rx_id, CAST(rx_date AS VARCHAR) AS event_date,
      CASE WHEN n = 1 THEN 'MEDICATION_STARTED' WHEN dosage_value IS NOT DISTINCT FROM before_value AND dosage_unit IS NOT DISTINCT FROM before_unit THEN 'MEDICATION_CONTINUED' ELSE 'MEDICATION_DOSE_CHANGED' END AS event_type
    FROM (SELECT *, row_number() OVER w AS n, lag(dosage_value) OVER w AS before_value, lag(dosage_unit) OVER w AS before_unit FROM lines WINDOW w AS (PARTITION BY patient_id, inn, episode_no ORDER BY seq))
    UNION ALL SELECT patient_id, inn, episode_no, NULL, CAST(actual_end_date AS VARCHAR), 'MEDICATION_COMPLETED' FROM episodes WHERE status = 'completed'
    UNION ALL SELECT d.patient_id, d.inn, NULL, d.rx_id, CAST(rx_date AS VARCHAR), 'MEDICATION_STARTED' FROM rx_drugs d JOIN defaults s ON s.inn = d.inn WHERE s.is_prn"""))
def episode_events(spark, sf):
    drugs, days = E.stored_days(drugs_of(spark, sf))
    found = E.episode_events(E.episode_lines(drugs, days), E.scheduled_episodes(days), E.prn_snapshots(drugs))
    return found.select("patient_id", "inn", "episode_no", "rx_id", day("event_date"), "event_type")


@query("dosage_history", sql("SELECT patient_id, inn, episode_no, rx_id, dosage_value, row_number() OVER (PARTITION BY patient_id, inn, episode_no ORDER BY seq) AS refill_number, sha256(rx_id || '::' || inn) AS idempotency_key, CAST(rx_date AS VARCHAR) AS recorded_date FROM lines"))
def dosage_history(spark, sf):
    return history_of(spark, sf).select("patient_id", "inn", "episode_no", "rx_id", "dosage_value", "refill_number", "idempotency_key", day("recorded_date"))


def discontinuation_feed(episodes):
    return episodes.where((F.col("status") == "active") & (F.col("patient_id") % 5 == 0)).select(
        "patient_id", "inn", "episode_no", F.lit("side effects").alias("stop_reason"), F.lit(None).cast("string").alias("switched_to_inn"))


@query("discontinue_episodes", sql(f"""SELECT patient_id, inn, episode_no, CASE WHEN stop THEN 'discontinued' ELSE status END AS status, CAST(CASE WHEN stop THEN {AS_OF} ELSE actual_end_date END AS VARCHAR) AS actual_end_date,
    CASE WHEN stop THEN version + 1 ELSE version END AS version, CASE WHEN stop THEN 'side effects' END AS stop_reason
    FROM (SELECT *, status = 'active' AND patient_id % 5 = 0 AS stop FROM episodes WHERE dispensing_type = 'scheduled')"""))
def discontinue_episodes(spark, sf):
    episodes = E.scheduled_episodes(E.episode_days(drugs_of(spark, sf)))
    return E.discontinue(episodes, discontinuation_feed(episodes), B.AS_OF_RX).select("patient_id", "inn", "episode_no", "status", day("actual_end_date"), "version", "stop_reason")


@query("discontinued_events", sql("""SELECT patient_id, 'MEDICATION_DISCONTINUED' AS event_type, 1 AS payload_schema_version,
    '{"inn":"' || inn || '","episode_id":' || episode_no || ',"stop_reason":"side effects","switched_to_inn":null}' AS payload FROM episodes WHERE dispensing_type = 'scheduled' AND status = 'active' AND patient_id % 5 = 0"""))
def discontinued_events(spark, sf):
    episodes = E.scheduled_episodes(E.episode_days(drugs_of(spark, sf)))
    return E.discontinued_events(episodes, discontinuation_feed(episodes))


@query("latest_dosage_text", sql("SELECT patient_id, inn, episode_no, CASE WHEN latest_dosage_value <> 0 THEN printf('%.1f', latest_dosage_value) || ' mg' END AS latest_dosage FROM sched_episodes"))
def latest_dosage_text(spark, sf):
    episodes = E.scheduled_episodes(E.episode_days(drugs_of(spark, sf)))
    return H.episode_view(episodes).select("patient_id", "inn", "episode_no", "latest_dosage")


# --- timelines and graph -----------------------------------------------------------

@query("patient_timeline", sql("""SELECT e.patient_id, e.inn, e.episode_no, e.status, CAST(e.start_date AS VARCHAR) AS start_date, e.prescription_count, printf('%.1f', e.latest_dosage_value) || ' mg' AS latest_dosage,
    l.rx_id, CAST(l.rx_date AS VARCHAR) AS recorded_date, l.dosage_value AS dose, d.name AS doctor_name FROM episodes e
    LEFT JOIN lines l ON l.patient_id = e.patient_id AND l.inn = e.inn AND l.episode_no = e.episode_no LEFT JOIN doctors d ON d.doctor_id = e.doctor_id"""))
def patient_timeline(spark, sf):
    drugs, days = E.stored_days(drugs_of(spark, sf))
    episodes = E.scheduled_episodes(days).unionByName(E.prn_episodes(drugs))
    rows = H.patient_timeline(episodes, E.dosage_history(E.episode_lines(drugs, days)), doctors_of(spark, sf))
    return rows.select("patient_id", "inn", "episode_no", "status", day("start_date"), "prescription_count", "latest_dosage", "rx_id", day("recorded_date"), "dose", "doctor_name")


@query("drug_timeline", sql("""SELECT e.patient_id, e.inn, count(*) AS episode_count, CAST(min(start_date) AS VARCHAR) AS first_start, CAST(max(start_date) AS VARCHAR) AS last_start,
    (SELECT count(*) FROM lines l WHERE l.patient_id = e.patient_id AND l.inn = e.inn) AS dose_rows FROM episodes e GROUP BY 1, 2"""))
def drug_timeline(spark, sf):
    drugs = cut_lineage(spark, drugs_of(spark, sf), "drugs")
    return H.drug_timeline(E.medication_episodes(drugs)).select("patient_id", "inn", "episode_count", day("first_start"), day("last_start"), "dose_rows")


@query("timeline_sort", sql("SELECT patient_id, inn, episode_no, CAST(start_date AS VARCHAR) AS start_date, status FROM episodes"))
def timeline_sort(spark, sf):
    return H.timeline_sorted(episodes_of(spark, sf)).select("patient_id", "inn", "episode_no", day("start_date"), "status")


@query("episode_doctors", sql("SELECT DISTINCT e.patient_id, e.doctor_id, d.name, d.speciality FROM episodes e JOIN doctors d ON d.doctor_id = e.doctor_id WHERE e.status = 'active'"))
def episode_doctors(spark, sf):
    return H.episode_doctors(episodes_of(spark, sf), doctors_of(spark, sf)).select("patient_id", "doctor_id", "name", "speciality")


@query("conditions_ranked", sql("SELECT patient_id, condition_code, confidence, row_number() OVER (PARTITION BY patient_id ORDER BY confidence DESC, condition_code) AS rank FROM inferred"))
def conditions_ranked(spark, sf):
    return H.ranked_conditions(inferred_of(spark, sf)).select("patient_id", "condition_code", "confidence", "rank")


@query("patient_graph", sql("""SELECT p.patient_id, p.phone, (SELECT count(*) FROM episodes e WHERE e.patient_id = p.patient_id AND status = 'active') AS active_medication_count,
    (SELECT count(*) FROM stored_conditions c WHERE c.patient_id = p.patient_id AND status = 'probable') AS probable_conditions,
    (SELECT count(*) FROM stored_conditions c WHERE c.patient_id = p.patient_id AND status = 'confirmed') AS confirmed_conditions,
    (SELECT max(confidence) FROM stored_conditions c WHERE c.patient_id = p.patient_id) AS top_confidence,
    (SELECT count(*) FROM reactions r WHERE r.patient_id = p.patient_id AND is_active) AS active_reactions,
    (SELECT count(DISTINCT e.doctor_id) FROM episodes e JOIN doctors d ON d.doctor_id = e.doctor_id WHERE e.patient_id = p.patient_id AND status = 'active') AS prescribing_doctors FROM patients p"""))
def patient_graph(spark, sf):
    return H.patient_graph(B.patients(spark, sf), episodes_of(spark, sf), B.stored_conditions(spark, sf), B.reactions(spark, sf), doctors_of(spark, sf))


@query("patient_graph_entities", sql("""SELECT patient_id, 'medication' AS section, inn AS entity, printf('%.1f', latest_dosage_value) || ' mg' AS detail FROM episodes WHERE status = 'active'
    UNION ALL SELECT patient_id, 'condition', condition_code, status FROM stored_conditions
    UNION ALL SELECT patient_id, 'reaction', inn, severity FROM reactions WHERE is_active
    UNION ALL SELECT DISTINCT e.patient_id, 'doctor', CAST(e.doctor_id AS VARCHAR), d.speciality FROM episodes e JOIN doctors d ON d.doctor_id = e.doctor_id WHERE e.status = 'active'"""))
def patient_graph_entities(spark, sf):
    return H.patient_graph_entities(episodes_of(spark, sf), B.stored_conditions(spark, sf), B.reactions(spark, sf), doctors_of(spark, sf))


# --- inference -------------------------------------------------------------------------

@query("recent_episodes", sql("SELECT patient_id, inn, episode_no, status, CAST(start_date AS VARCHAR) AS start_date FROM recent"))
def recent_episodes(spark, sf):
    return INF.recent_episodes(episodes_of(spark, sf), B.AS_OF_RX).select("patient_id", "inn", "episode_no", "status", day("start_date"))


def _evidence(spark, sf):
    return INF.evidence(INF.recent_episodes(episodes_of(spark, sf), B.AS_OF_RX))


@query("condition_evidence", sql("SELECT patient_id, condition_code, signal_inn, prescription_count, CAST(last_date AS VARCHAR) AS last_date, round(factor, 6) AS factor FROM evidence WHERE counts"))
def condition_evidence(spark, sf):
    rows = _evidence(spark, sf).where("counts")
    return rows.select("patient_id", "condition_code", "signal_inn", "prescription_count", day("last_date"), F.round("factor", 6).alias("factor"))


@query("noisy_or", sql("SELECT patient_id, condition_code, round(noisy_or, 6) AS noisy_or FROM rolled"))
def noisy_or(spark, sf):
    return INF.rollup(_evidence(spark, sf)).select("patient_id", "condition_code", F.round("noisy_or", 6).alias("noisy_or"))


@query("evidence_rollup", sql("SELECT patient_id, condition_code, max_rx, CAST(last_date AS VARCHAR) AS last_date, n_factors FROM rolled"))
def evidence_rollup(spark, sf):
    return INF.rollup(_evidence(spark, sf)).select("patient_id", "condition_code", "max_rx", day("last_date"), "n_factors")


@query("supporting_drugs", sql("SELECT patient_id, condition_code, supporting FROM rolled"))
def supporting_drugs(spark, sf):
    names = F.array_join(F.transform("supporting", lambda s: s["signal_inn"]), ",")
    return INF.rollup(_evidence(spark, sf)).select("patient_id", "condition_code", names.alias("supporting"))


@query("speciality_gate", sql("SELECT patient_id, condition_code, required, speciality_group FROM gated"))
def speciality_gate(spark, sf):
    recent = INF.recent_episodes(episodes_of(spark, sf), B.AS_OF_RX)
    gated = INF.speciality_gate(INF.rollup(INF.evidence(recent)), INF.patient_doctors(recent, doctors_of(spark, sf)))
    return gated.select("patient_id", "condition_code", F.coalesce("requires_speciality", F.lit("")).alias("required"), "speciality_group")


@query("primary_speciality", sql("SELECT patient_id, speciality_group FROM primary_group"))
def primary_speciality(spark, sf):
    recent = INF.recent_episodes(episodes_of(spark, sf), B.AS_OF_RX)
    return INF.patient_doctors(recent, doctors_of(spark, sf)).select("patient_id", "speciality_group")


@query("condition_confidence", sql("SELECT patient_id, condition_code, condition_name, confidence, since AS days_since_last_rx FROM inferred"))
def condition_confidence(spark, sf):
    return inferred_of(spark, sf).select("patient_id", "condition_code", "condition_name", "confidence", F.col("days_since_last_rx").cast("bigint").alias("days_since_last_rx"))


_MERGE = """SELECT coalesce(s.patient_id, i.patient_id) AS patient_id, coalesce(s.condition_code, i.condition_code) AS condition_code, s.confidence AS old_confidence,
    CASE WHEN i.patient_id IS NULL THEN 'unchanged' WHEN s.patient_id IS NULL THEN 'inserted' WHEN s.status IN ('confirmed', 'rejected') THEN 'kept' WHEN s.status = 'probable' THEN 'updated' ELSE 'reopened' END AS action,
    CASE WHEN i.patient_id IS NOT NULL AND (s.status IS NULL OR s.status = 'resolved') THEN 'probable' ELSE s.status END AS status,
    CASE WHEN i.patient_id IS NOT NULL AND (s.status IS NULL OR s.status IN ('probable', 'resolved')) THEN i.confidence ELSE s.confidence END AS confidence
    FROM stored_conditions s FULL OUTER JOIN inferred i ON i.patient_id = s.patient_id AND i.condition_code = s.condition_code"""


@query("merge_conditions", sql("SELECT * FROM merged", merged=_MERGE))
def merge_conditions(spark, sf):
    merged = INF.merge_conditions(inferred_of(spark, sf), B.stored_conditions(spark, sf))
    return merged.select("patient_id", "condition_code", "status", "old_confidence", "confidence", "action")


@query("confidence_change", sql("SELECT s.patient_id, s.condition_code, s.confidence AS old_confidence, i.confidence AS new_confidence FROM stored_conditions s JOIN inferred i ON i.patient_id = s.patient_id AND i.condition_code = s.condition_code WHERE s.status = 'probable' AND s.confidence <> i.confidence"))
def confidence_change(spark, sf):
    stored = B.stored_conditions(spark, sf).where(F.col("status") == "probable")
    return EV.confidence_changes(stored, inferred_of(spark, sf))


# --- doctors ---------------------------------------------------------------------------------

@query("speciality_group", sql(f"SELECT doctor_id, speciality, {group_case('speciality')} AS speciality_group FROM doctors"))
def speciality_group(spark, sf):
    return doctors_of(spark, sf).select("doctor_id", "speciality", N.speciality_group(F.col("speciality")).alias("speciality_group"))


@query("normalize_registration", sql("SELECT seen_order, seen_line, nullif(regexp_replace(upper(reg_number), '[^A-Z0-9]', '', 'g'), '') AS reg_norm FROM mentions"))
def normalize_registration(spark, sf):
    return B.doctor_mentions(spark, sf).select("seen_order", "seen_line", N.normalize_registration(F.col("reg_number")).alias("reg_norm"))


_KNOWN = f"""SELECT *, nullif(regexp_replace(upper(reg_number), '[^A-Z0-9]', '', 'g'), '') AS reg_norm, {group_case('speciality')} AS grp FROM mentions WHERE reg_number IS NOT NULL OR name IS NOT NULL"""


@query("resolve_doctors", sql("""SELECT reg_norm, first(reg_number ORDER BY seen_order, seen_line, name NULLS FIRST, speciality NULLS FIRST, reg_number) AS registration_number,
      first(name ORDER BY seen_order, seen_line, name NULLS FIRST, speciality NULLS FIRST) AS name, first(speciality ORDER BY seen_order, seen_line, name NULLS FIRST, speciality NULLS FIRST) AS speciality,
      first(grp ORDER BY seen_order, seen_line, grp) FILTER (grp IS NOT NULL) AS speciality_group, count(*) AS n_mentions, count(DISTINCT name) AS n_name_variants FROM known WHERE reg_norm IS NOT NULL GROUP BY reg_norm
    UNION ALL SELECT reg_norm, reg_number, name, speciality, grp, 1, CASE WHEN name IS NULL THEN 0 ELSE 1 END FROM known WHERE reg_norm IS NULL""", known=_KNOWN))
def resolve_doctors(spark, sf):
    return D.resolve_doctors(B.doctor_mentions(spark, sf))


@query("doctor_name_variants", sql("SELECT DISTINCT reg_norm, name FROM known WHERE reg_norm IS NOT NULL AND name IS NOT NULL", known=_KNOWN))
def doctor_name_variants(spark, sf):
    return D.name_variants(B.doctor_mentions(spark, sf))


# --- feeds --------------------------------------------------------------------------------------

_REVIEWS = """SELECT patient_id, condition_code, status, CASE patient_id % 4 WHEN 0 THEN 'confirm' WHEN 1 THEN 'reject' WHEN 2 THEN 'resolve' ELSE 'archive' END AS action,
    CASE WHEN patient_id % 8 = 1 THEN 'wrong patient' END AS rejection_reason FROM stored_conditions"""


@query("apply_condition_reviews", sql("""SELECT patient_id, condition_code, action, CASE WHEN is_open THEN status END AS old_status, problem,
    CASE WHEN problem IS NULL THEN CASE action WHEN 'confirm' THEN 'confirmed' WHEN 'reject' THEN 'rejected' ELSE 'resolved' END END AS new_status,
    CASE WHEN problem IS NULL THEN CASE action WHEN 'confirm' THEN 'CONDITION_CONFIRMED' WHEN 'reject' THEN 'CONDITION_REJECTED' ELSE 'CONDITION_RESOLVED' END END AS event_type
    FROM (SELECT *, status IN ('probable', 'confirmed') AS is_open, CASE WHEN status NOT IN ('probable', 'confirmed') THEN 'not_found' WHEN action = 'reject' AND rejection_reason IS NULL THEN 'reason_required' WHEN action = 'archive' THEN 'unknown_action' END AS problem FROM reviews)""", reviews=_REVIEWS))
def apply_condition_reviews(spark, sf):
    stored = B.stored_conditions(spark, sf)
    key = F.col("patient_id")
    reviews = stored.select("patient_id", "condition_code", B.pick(["confirm", "reject", "resolve", "archive"], key).alias("action"),
                            F.when(key % 8 == 1, "wrong patient").alias("rejection_reason"))
    return M.apply_condition_reviews(stored, reviews).select("patient_id", "condition_code", "action", "old_status", "new_status", "event_type", "problem")


@query("record_reactions", sql("SELECT patient_id, reaction_type, inn, array_to_string(cross_reactive_inns, '|') AS cross_reactive, severity, 'clinician_entered' AS source, TRUE AS is_active FROM reactions"))
def record_reactions(spark, sf):
    raw = B.reactions(spark, sf).withColumn("inn", F.concat(F.lit("  "), F.upper("inn"))).withColumn("cross_reactive_inns", F.transform("cross_reactive_inns", lambda c: F.concat(F.initcap(c), F.lit(" "))))
    return M.record_reactions(raw).select("patient_id", "reaction_type", "inn", F.array_join("cross_reactive_inns", "|").alias("cross_reactive"), "severity", "source", "is_active")


@query("reaction_events", sql("""SELECT patient_id, 'ALLERGY_RECORDED' AS event_type, 1 AS payload_schema_version,
    '{"inn":"' || inn || '","reaction_type":"' || reaction_type || '","severity":"' || severity || '"}' AS payload FROM reactions"""))
def reaction_events(spark, sf):
    return M.reaction_events(M.record_reactions(B.reactions(spark, sf))).select("patient_id", "event_type", "payload_schema_version", "payload")


def supplier_rules(spark, sf):
    """A rule table as large as the supplier table."""
    key = F.col("s_suppkey")
    return B.read(spark, sf, "supplier").select(
        F.col("s_name").alias("rule_name"), B.pick(B.CATALOG, key).alias("drug_inn"), F.lit("TSH").alias("analyte_name"),
        F.when(key % 4 != 0, ">").alias("operator"), (key % 10 + 0.5).cast("double").alias("threshold_value"), F.when(key % 4 == 0, "high").alias("flag_match"),
        F.lit("warning").alias("severity"), (key % 3 != 0).alias("is_enabled"), (key % 11 == 0).alias("is_deleted"), (key % 3 + 1).cast("int").alias("version"))


_SRULES = """SELECT s_suppkey AS k, s_name AS rule_name, s_suppkey % 10 + 0.5::DOUBLE AS threshold_value, s_suppkey % 11 = 0 AS is_deleted, s_suppkey % 3 + 1 AS version FROM supplier"""
_CHANGES = """SELECT c_custkey AS k, c_name AS n, CASE c_custkey % 3 WHEN 0 THEN 'create' WHEN 1 THEN 'update' ELSE 'delete' END AS change,
    CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'New rule ' || c_custkey ELSE 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS rule_name,
    CASE WHEN c_custkey % 5 = 0 THEN 'Supplier#000000002' WHEN c_custkey % 5 = 1 THEN 'Renamed ' || c_custkey END AS new_name, c_custkey % 7 + 0.25::DOUBLE AS new_threshold FROM customer"""


def rule_changes(spark, sf):
    key = F.col("c_custkey")
    return B.read(spark, sf, "customer").select(
        B.pick(["create", "update", "delete"], key).alias("change"),
        F.when((key % 3 == 0) & (key % 2 == 0), F.concat(F.lit("New rule "), key)).otherwise(F.concat(F.lit("Supplier#"), F.lpad(key.cast("string"), 9, "0"))).alias("rule_name"),
        F.when(key % 5 == 0, "Supplier#000000002").when(key % 5 == 1, F.concat(F.lit("Renamed "), key)).alias("new_name"), (key % 7 + 0.25).cast("double").alias("new_threshold"))


@query("apply_rule_changes", sql("""SELECT change, rule_name, CASE WHEN problem IS NULL AND change = 'update' THEN coalesce(new_name, rule_name) ELSE rule_name END AS name,
    CASE WHEN problem IS NULL AND change <> 'delete' THEN new_threshold ELSE threshold_value END AS threshold_value,
    CASE WHEN problem IS NULL THEN CASE change WHEN 'create' THEN 1 WHEN 'update' THEN version + 1 ELSE version END ELSE version END AS version,
    problem IS NULL AND change = 'delete' AS is_deleted, CASE WHEN problem IS NULL THEN change || '_rule' END AS audit_action, problem
    FROM (SELECT c.*, r.threshold_value, r.version, CASE WHEN change = 'create' AND r.k IS NOT NULL THEN 'name_exists' WHEN change <> 'create' AND (r.k IS NULL OR r.is_deleted) THEN 'not_found'
      WHEN change = 'update' AND new_name <> c.rule_name AND EXISTS (SELECT 1 FROM srules x WHERE x.rule_name = c.new_name) THEN 'name_exists' END AS problem
      FROM changes c LEFT JOIN srules r ON r.rule_name = c.rule_name)""", srules=_SRULES, changes=_CHANGES))
def apply_rule_changes(spark, sf):
    result = M.apply_rule_changes(supplier_rules(spark, sf), rule_changes(spark, sf))
    return result.withColumn("version", F.col("version").cast("bigint"))


@query("rule_snapshot_text", sql(f"""SELECT s_name AS rule_name, 'Updated clinical safety rule v' || (s_suppkey % 3 + 1) || ': ' || s_name || ' (Drug: ' || {at(B.CATALOG, 's_suppkey')} || ', Analyte: TSH,' ||
    CASE WHEN s_suppkey % 4 <> 0 THEN ' Op: > Val: ' || printf('%.1f', s_suppkey % 10 + 0.5) ELSE ' Flag: high' END || ', Severity: warning, Enabled: ' || CASE WHEN s_suppkey % 3 <> 0 THEN 'True' ELSE 'False' END || ')' AS snapshot FROM supplier"""))
def rule_snapshot_text(spark, sf):
    return supplier_rules(spark, sf).select("rule_name", M.rule_snapshot("Updated", F.col("version")).alias("snapshot"))


def resolution_feed(spark, sf):
    """Reviewed items: every queue item; every third one with a reason."""
    queue = B.review_queue(spark, sf)
    reason = F.when(F.col("item_id") % 3 == 0, "agreed with patient").when(F.col("item_id") % 3 == 1, "  ")
    return queue, queue.select("item_id", "patient_id", reason.alias("override_reason"))


_ITEM_DRUGS = """SELECT DISTINCT q.item_id, q.patient_id, m.inn FROM review_queue q JOIN medications m ON m.rx_id = q.item_id WHERE NOT q.resolved AND q.item_type = 'prescription'"""
_ITEM_ALL = "SELECT item_id, inn FROM item_drugs UNION SELECT i.item_id, a.inn FROM item_drugs i JOIN active_drugs a ON a.patient_id = i.patient_id"
_ITEM_PAIRS = "SELECT a.item_id, a.inn AS drug_1, b.inn AS drug_2 FROM item_all a JOIN item_all b ON a.item_id = b.item_id AND a.inn < b.inn"
_ITEM_FOUND = """SELECT p.item_id, r.severity FROM item_pairs p JOIN pair_rules r ON p.drug_1 = r.drug_1 AND p.drug_2 = r.drug_2
    UNION ALL SELECT p.item_id, r.severity FROM item_pairs p JOIN class_rules r ON p.drug_1 = r.drug_1 AND p.drug_2 = r.drug_2"""


_ITEM_STATE = """SELECT q.item_id, q.patient_id, q.facility_id, coalesce(f.major, FALSE) AS has_major, coalesce(a.critical, FALSE) AS has_critical, coalesce(f.n, 0) AS n_interactions, coalesce(a.n, 0) AS n_alerts,
    coalesce(f.major, FALSE) OR coalesce(a.critical, FALSE) AS needs, q.item_id % 3 <> 0 AS blank FROM review_queue q
    LEFT JOIN (SELECT item_id, bool_or(severity = 'major') AS major, count(*) AS n FROM item_found GROUP BY 1) f ON f.item_id = q.item_id
    LEFT JOIN alerts_of a ON a.item_id = q.item_id WHERE NOT q.resolved AND q.item_type = 'prescription'"""


_RESOLVED = sql("""SELECT item_id, patient_id, facility_id, has_major, has_critical, n_interactions, n_alerts, CASE WHEN needs AND blank THEN 'rejected' ELSE 'resolved' END AS outcome,
    CASE WHEN NOT needs THEN 'resolve_rx' WHEN NOT blank THEN 'override_safety' END AS audit_action, needs AND NOT blank AS needs_admin_oversight,
    CASE WHEN NOT (needs AND blank) THEN 1.0::DOUBLE END AS confidence FROM item_state""",
    item_drugs=_ITEM_DRUGS, drugs="SELECT * FROM item_drugs WHERE patient_id IS NOT NULL", **keyed_alerts("item_id"), item_all=_ITEM_ALL, item_pairs=_ITEM_PAIRS, item_found=_ITEM_FOUND, item_state=_ITEM_STATE)


@query("apply_resolutions", f"SELECT * EXCLUDE (facility_id, confidence) FROM ({_RESOLVED})")
def apply_resolutions(spark, sf):
    queue, feed = resolution_feed(spark, sf)
    lines = B.medication_lines(spark, sf).select(F.col("rx_id").alias("item_id"), "inn")
    out = M.apply_resolutions(feed, lines, queue, active_drugs(spark, sf), latest(spark, sf), rule_table(spark, sf))
    return out.select("item_id", "patient_id", "has_major", "has_critical", "n_interactions", "n_alerts", "outcome", "audit_action", "needs_admin_oversight")


@query("apply_resolutions_labs", _RESOLVED)
def apply_resolutions_labs(spark, sf):
    queue, feed = resolution_feed(spark, sf)
    lines = B.medication_lines(spark, sf).select(F.col("rx_id").alias("item_id"), "inn")
    return M.apply_resolutions(feed, lines, queue, active_drugs(spark, sf), latest(spark, sf), rule_table(spark, sf))


@query("apply_lab_resolutions")
def apply_lab_resolutions(spark, sf):
    queue, feed = resolution_feed(spark, sf)
    results = queue.select("item_id", F.lit("creatinine").alias("analyte_name"), (F.col("item_id") % 30 / 10.0).alias("value"), F.lit("mg/dL").alias("unit"), F.lit("0.6 - 1.2 mg/dL").alias("ref_range"), F.lit("normal").alias("flag"))
    return M.apply_lab_resolutions(feed, queue, results, active_drugs(spark, sf), latest(spark, sf), rule_table(spark, sf))
