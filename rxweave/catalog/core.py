"""Queries over scans, filters, joins on patients, review and interactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxweave import bindings as B
from rxweave.catalog.base import query
from rxweave.catalog.sqlbind import items, sql
from rxweave.operators import events as EV
from rxweave.operators import history as H
from rxweave.operators import interactions as I
from rxweave.operators import labs as L
from rxweave.operators import maintenance as M
from rxweave.operators import medications as MED
from rxweave.operators import review as R
from rxweave.operators import safety as S
from rxweave.refdata import prescribing as P
from rxweave.refdata import tables
from rxweave.sources import readers


def day(column: str):
    return F.col(column).cast("string").alias(column)


def active_drugs(spark, sf):
    return MED.distinct_inns(MED.active_medications(B.medication_lines(spark, sf), B.prescriptions(spark, sf), B.AS_OF_RX))


def latest(spark, sf):
    return L.latest_labs(B.lab_results(spark, sf))


# --- scans -------------------------------------------------------------

@query("scan_tables", sql("""SELECT 'patients' AS name, count(*) AS n, min(patient_id) AS low, max(patient_id) AS high FROM patients
    UNION ALL SELECT 'prescriptions', count(*), min(rx_id), max(rx_id) FROM prescriptions
    UNION ALL SELECT 'doctors', count(*), min(doctor_id), max(doctor_id) FROM doctors
    UNION ALL SELECT 'lab_results', count(*), min(result_id), max(result_id) FROM lab_results
    UNION ALL SELECT 'reactions', count(*), min(patient_id), max(patient_id) FROM reactions"""))
def scan_tables(spark, sf):
    parts = [("patients", B.patients, "patient_id"), ("prescriptions", B.prescriptions, "rx_id"), ("doctors", B.doctors, "doctor_id"),
             ("lab_results", B.lab_results, "result_id"), ("reactions", B.reactions, "patient_id")]
    rows = [fn(spark, sf).agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.min(k).alias("low"), F.max(k).alias("high")) for name, fn, k in parts]
    result = rows[0]
    for row in rows[1:]:
        result = result.unionByName(row)
    return result


@query("scan_reference", sql("""SELECT m.inn, count(*) AS n_lines, max(s.condition_code) AS condition_code, max(d.drug_class) AS drug_class
    FROM medications m LEFT JOIN signals s ON s.inn = m.inn LEFT JOIN drug_classes d ON d.inn = m.inn GROUP BY m.inn"""))
def scan_reference(spark, sf):
    counts = B.medication_lines(spark, sf).groupBy("inn").agg(F.count("*").alias("n_lines"))
    codes = tables.condition_signals(spark).select("inn", "condition_code")
    return counts.join(F.broadcast(codes), "inn", "left").join(F.broadcast(tables.drug_classes(spark)), "inn", "left")


@query("scan_documents_hash", "SELECT doc_id, sha256(text) AS upload_hash, length(text) AS n FROM documents")
def scan_documents_hash(spark, sf):
    docs = readers.fingerprint(B.read(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "upload_hash", F.length("text").alias("n"))


@query("sink_events", sql("SELECT event_type, 1 AS payload_schema_version, patient_id, '{\"inn\":\"' || inn || '\",\"rx_id\":' || rx_id || '}' AS payload FROM (SELECT 'MEDICATION_STARTED' AS event_type, patient_id, inn, rx_id FROM medications WHERE line_no = 1)"))
def sink_events(spark, sf):
    rows = B.dated_medications(spark, sf).where("line_no = 1")
    return EV.emit(rows, F.lit("MEDICATION_STARTED"), ["inn", "rx_id"])


@query("insert_if_absent", """SELECT c_custkey AS patient_id, c_name AS phone, 'old' AS origin FROM customer WHERE c_nationkey < 12
    UNION ALL SELECT c_custkey, c_name, 'new' FROM customer WHERE c_nationkey >= 12""")
def insert_if_absent(spark, sf):
    people = B.patients(spark, sf)
    old = people.where("facility_id < 12").select("patient_id", "phone", F.lit("old").alias("origin"))
    new = people.select("patient_id", "phone", F.lit("new").alias("origin"))
    return MED.insert_if_absent(old, new, ["phone"])


# --- projections and filters -------------------------------------------

@query("active_medications", sql("SELECT rx_id, patient_id, line_no, inn, dosage_value, CAST(created_at AS VARCHAR) AS created_at, duration_days FROM active"))
def active_medications(spark, sf):
    active = MED.active_medications(B.medication_lines(spark, sf), B.prescriptions(spark, sf), B.AS_OF_RX)
    return active.select("rx_id", "patient_id", "line_no", "inn", "dosage_value", day("created_at"), "duration_days")


def rule_table(spark, sf):
    """The rule table with a usage count per rule; some rules are off or deleted."""
    n = F.length("rule_name")
    return tables.baseline_rules(spark).withColumn("is_enabled", n % 5 != 0).withColumn("is_deleted", n % 7 == 0)


RULE_TABLE = "SELECT * EXCLUDE (is_enabled, is_deleted), length(rule_name) % 5 <> 0 AS is_enabled, length(rule_name) % 7 = 0 AS is_deleted FROM rules"


@query("active_rules", sql("SELECT r.rule_name, r.drug_inn, count(m.rx_id) AS n_lines FROM rule_table r LEFT JOIN medications m ON m.inn = r.drug_inn WHERE r.is_enabled AND NOT r.is_deleted GROUP BY 1, 2", rule_table=RULE_TABLE))
def active_rules(spark, sf):
    uses = B.medication_lines(spark, sf).groupBy(F.col("inn").alias("drug_inn")).agg(F.count("*").alias("n_lines"))
    return S.active_rules(rule_table(spark, sf)).join(uses, "drug_inn", "left").select("rule_name", "drug_inn", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query("review_queue_open", sql("SELECT item_id, patient_id, item_type, confidence, CAST(created_at AS VARCHAR) AS created_at FROM review_queue WHERE NOT resolved"))
def review_queue_open(spark, sf):
    return R.newest_first(B.review_queue(spark, sf)).select("item_id", "patient_id", "item_type", "confidence", day("created_at"))


@query("review_queue_scoped", sql("""SELECT DISTINCT q.facility_id, c.scopes, q.item_id, q.item_type FROM review_queue q JOIN clinicians c ON q.facility_id = c.active_facility_id
    WHERE NOT q.resolved AND (c.scopes = 'both' OR (c.scopes = 'rx' AND item_type = 'prescription') OR (c.scopes = 'lab' AND item_type = 'lab'))"""))
def review_queue_scoped(spark, sf):
    return R.scoped_queue(B.review_queue(spark, sf), B.clinicians(spark, sf))


_SCOPE = "(c.scopes = 'both' OR (c.scopes = 'rx' AND q.item_type = 'prescription') OR (c.scopes = 'lab' AND q.item_type = 'lab'))"


@query("facility_access", sql(f"""SELECT c.clinician_id, count(*) FILTER (q.facility_id IS NOT NULL AND {_SCOPE} AND q.facility_id IN (SELECT facility_id FROM clinician_facilities b WHERE b.clinician_id = c.clinician_id)) AS n_own,
    count(*) FILTER (q.facility_id IS NULL AND {_SCOPE}) AS n_shared FROM clinicians c CROSS JOIN review_queue q GROUP BY c.clinician_id"""))
def facility_access(spark, sf):
    return R.facility_access(B.review_queue(spark, sf), B.clinicians(spark, sf), B.clinician_facilities(spark, sf))


@query("facility_access_check", sql(f"""SELECT r.clinician_id, r.item_id, (q.facility_id IS NULL OR EXISTS (SELECT 1 FROM clinician_facilities b WHERE b.clinician_id = c.clinician_id AND b.facility_id = q.facility_id)) AND {_SCOPE} AS allowed
    FROM requests r JOIN review_queue q ON q.item_id = r.item_id JOIN clinicians c ON c.clinician_id = r.clinician_id""",
    requests="SELECT DISTINCT l_orderkey AS item_id, l_suppkey AS clinician_id FROM lineitem"))
def facility_access_check(spark, sf):
    requests = B.medication_lines(spark, sf).select(F.col("rx_id").alias("item_id"), F.col("doctor_id").alias("clinician_id")).distinct()
    return R.may_open(requests, B.review_queue(spark, sf), B.clinicians(spark, sf), B.clinician_facilities(spark, sf))


@query("route_by_confidence", sql("""SELECT rx_id, confidence, confidence < 0.5 AS needs_review,
    CASE WHEN confidence < 0.5 THEN 'Confidence ' || printf('%.4f', confidence) || ' < threshold 0.5 (extractor=tesseract_ner_fallback)' END AS reason FROM prescriptions"""))
def route_by_confidence(spark, sf):
    return MED.route_by_confidence(B.prescriptions(spark, sf)).select("rx_id", "confidence", "needs_review", "reason")


@query("cap_audit_confidence", sql("SELECT rx_id, least(0.45::DOUBLE, confidence) AS confidence FROM prescriptions"))
def cap_audit_confidence(spark, sf):
    return R.cap_audit_confidence(B.prescriptions(spark, sf)).select("rx_id", "confidence")


@query("named_medications", sql("SELECT rx_id, line_no, raw_drug_name FROM (SELECT *, CASE line_no % 3 WHEN 0 THEN '  ' WHEN 1 THEN raw_drug_name END shown FROM medications) WHERE trim(coalesce(shown, '')) <> ''"))
def named_medications(spark, sf):
    shown = F.when(F.col("line_no") % 3 == 0, "  ").when(F.col("line_no") % 3 == 1, F.col("raw_drug_name"))
    return MED.named_medications(B.medication_lines(spark, sf).withColumn("shown", shown), "shown").select("rx_id", "line_no", "raw_drug_name")


@query("open_condition_by_code", sql("SELECT patient_id, condition_code, status, confidence FROM stored_conditions WHERE status IN ('probable', 'confirmed')"))
def open_condition_by_code(spark, sf):
    return B.stored_conditions(spark, sf).where(F.col("status").isin("probable", "confirmed")).select("patient_id", "condition_code", "status", "confidence")


_TESTS = [(">", 1.4, None, None), ("<", 70.0, None, None), (">=", 10.0, None, None), ("<=", 4.0, None, None), ("=", 5.0, None, None), ("between", 10.0, 100.0, None), (None, None, None, "HIGH"), ("", None, None, "low")]
_TEST_COLUMNS = ["operator", "threshold_value", "threshold_value_max", "flag_match"]


@query("rule_predicate", sql("""SELECT l.result_id, t.operator, CASE WHEN t.operator IS NULL OR t.operator = '' THEN lower(l.flag) = lower(t.flag_match) ELSE CASE t.operator
    WHEN '>' THEN value > threshold_value WHEN '<' THEN value < threshold_value WHEN '>=' THEN value >= threshold_value WHEN '<=' THEN value <= threshold_value
    WHEN '=' THEN value = threshold_value WHEN 'between' THEN value BETWEEN threshold_value AND threshold_value_max END END AS matched
    FROM lab_results l JOIN tests t ON t.k = l.result_id % 8""",
    tests="SELECT * FROM (VALUES " + ", ".join(f"({i}, {', '.join('NULL' if v is None else repr(v) for v in row)})" for i, row in enumerate(_TESTS)) + ") t(k, operator, threshold_value, threshold_value_max, flag_match)"))
def rule_predicate(spark, sf):
    tests = tables.local_table(spark, [(i, *row) for i, row in enumerate(_TESTS)], {
        "k": "bigint", "operator": "string", "threshold_value": "double", "threshold_value_max": "double", "flag_match": "string"})
    rows = B.lab_results(spark, sf).withColumn("k", F.col("result_id") % 8).join(F.broadcast(tests), "k")
    return rows.select("result_id", "operator", S.rule_predicate(F.col("value"), F.col("flag")).alias("matched"))


@query("gender_band", sql("""SELECT result_id, CASE result_id % 3 WHEN 0 THEN contains(ref_range, '0.5') WHEN 1 THEN NOT contains(ref_range, '0.5') ELSE TRUE END AS applies FROM lab_results"""))
def gender_band(spark, sf):
    return B.lab_results(spark, sf).select("result_id", S.gender_band(B.pick(["female", "male", "both"], F.col("result_id")), F.col("ref_range")).alias("applies"))


# --- joins --------------------------------------------------------------

@query("meds_with_rx", sql("SELECT rx_id, patient_id, line_no, inn, CAST(rx_date AS VARCHAR) AS rx_date, dosage_value FROM medications"))
def meds_with_rx(spark, sf):
    return B.dated_medications(spark, sf).select("rx_id", "patient_id", "line_no", "inn", day("rx_date"), "dosage_value")


@query("labs_with_reports", sql("SELECT result_id, patient_id, analyte_name, value, unit, flag, CAST(report_date AS VARCHAR) AS report_date FROM lab_results"))
def labs_with_reports(spark, sf):
    rows = B.lab_results(spark, sf)
    results = rows.select("result_id", "report_id", "analyte_name", "value", "unit", "flag")
    reports = rows.select("report_id", "patient_id", "report_date")
    return results.join(reports, "report_id").select("result_id", "patient_id", "analyte_name", "value", "unit", "flag", day("report_date"))


@query("audit_oversight", sql("""SELECT log_id, coalesce(c.name, 'Unknown') AS clinician_name, coalesce(c.email, 'Unknown') AS clinician_email, coalesce(f.name, 'Unknown') AS facility_name, action
    FROM audit_logs l LEFT JOIN clinicians c ON c.clinician_id = l.clinician_id LEFT JOIN facilities f ON f.facility_id = l.facility_id WHERE needs_admin_oversight"""))
def audit_oversight(spark, sf):
    rows = R.audit_oversight(B.audit_logs(spark, sf), B.clinicians(spark, sf), B.facilities(spark, sf))
    return rows.orderBy(F.col("created_at").desc(), "log_id").drop("created_at")


@query("queue_with_phone", sql("SELECT q.item_id, q.patient_id, p.phone, q.item_type FROM review_queue q LEFT JOIN patients p ON p.patient_id = q.patient_id WHERE NOT resolved"))
def queue_with_phone(spark, sf):
    return R.queue_with_phone(B.review_queue(spark, sf), B.patients(spark, sf)).select("item_id", "patient_id", "phone", "item_type")


@query("upsert_patients", sql("SELECT DISTINCT c_name AS phone FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey >= 12"))
def upsert_patients(spark, sf):
    people = B.patients(spark, sf)
    seen = B.prescriptions(spark, sf).join(people, "patient_id").select("phone")
    return MED.upsert_patients(people.where("facility_id < 12"), seen)


@query("contraindications", sql("""SELECT DISTINCT m.patient_id, m.inn, r.inn AS reaction_inn, r.reaction_type, r.severity FROM medications m JOIN reactions r ON r.patient_id = m.patient_id
    WHERE r.is_active AND (m.inn = r.inn OR list_contains(r.cross_reactive_inns, m.inn))"""))
def contraindications(spark, sf):
    return I.contraindications(B.dated_medications(spark, sf), B.reactions(spark, sf)).select("patient_id", "inn", "reaction_inn", "reaction_type", "severity")


# --- interactions ---------------------------------------------------------

@query("drug_pairs", sql("SELECT d.patient_id, count(*) AS n_drugs, (SELECT count(*) FROM active_pairs p WHERE p.patient_id = d.patient_id) AS n_pairs FROM active_drugs d GROUP BY d.patient_id"))
def drug_pairs(spark, sf):
    return I.drug_pair_counts(active_drugs(spark, sf))


_FOUND = ["patient_id", "drug_1", "drug_2", "severity", "description", "source"]


@query("ddi_exact", sql(f"SELECT {', '.join(_FOUND)} FROM found_exact"))
def ddi_exact(spark, sf):
    return I.exact_interactions(active_drugs(spark, sf)).select(_FOUND)


@query("ddi_class", sql(f"SELECT {', '.join(_FOUND)} FROM found_class"))
def ddi_class(spark, sf):
    return I.class_interactions(active_drugs(spark, sf)).select(_FOUND)


def product_labels(spark, sf):
    """Label text per product name; it names the next product."""
    part = B.read(spark, sf, "part")
    names = part.groupBy(F.lower("p_name").alias("inn")).agg(F.min("p_partkey").alias("k"))
    following = part.select((F.col("p_partkey") - 1).alias("k"), F.lower("p_name").alias("other"))
    text = F.concat(F.lit("Effects may grow when used with "), F.col("other"), F.lit(". Ask before use."))
    return names.join(following, "k").select("inn", text.alias("label_text"))


@query("ddi_label_mention", sql("""SELECT DISTINCT u.patient_id, l.inn AS drug_1, l.other AS drug_2, 'unknown' AS severity, 'Effects may grow when used with ' || l.other || '. Ask before use.' AS description, 'OPENFDA' AS source
    FROM labels_of l JOIN used u ON u.inn = l.inn JOIN used v ON v.patient_id = u.patient_id AND v.inn = l.other WHERE l.inn < l.other""",
    used="SELECT DISTINCT o_custkey AS patient_id, lower(p_name) AS inn FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey",
    labels_of="SELECT n.inn, lower(p.p_name) AS other FROM (SELECT lower(p_name) AS inn, min(p_partkey) AS k FROM part GROUP BY 1) n JOIN part p ON p.p_partkey = n.k + 1"))
def ddi_label_mention(spark, sf):
    lines = B.read(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(B.read(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_name").alias("inn")), "l_partkey")
    rx = B.prescriptions(spark, sf).select(F.col("rx_id").alias("l_orderkey"), "patient_id")
    used = lines.join(rx, "l_orderkey").select("patient_id", "inn").distinct()
    return I.label_interactions(used, product_labels(spark, sf)).select(_FOUND)


@query("severity_sort", sql("SELECT patient_id, drug_1, drug_2, severity, CASE severity WHEN 'major' THEN 0 WHEN 'moderate' THEN 1 WHEN 'minor' THEN 2 WHEN 'unknown' THEN 3 ELSE 99 END AS severity_rank FROM found"))
def severity_sort(spark, sf):
    found = I.interactions(active_drugs(spark, sf))
    return found.orderBy("severity_rank", "drug_1", "drug_2", "patient_id").select("patient_id", "drug_1", "drug_2", "severity", "severity_rank")


@query("has_major", sql("SELECT d.patient_id, coalesce((SELECT bool_or(severity = 'major') FROM found f WHERE f.patient_id = d.patient_id), FALSE) AS has_major_interaction FROM (SELECT DISTINCT patient_id FROM active_drugs) d"))
def has_major(spark, sf):
    drugs = active_drugs(spark, sf)
    return I.summary(drugs, I.interactions(drugs)).select("patient_id", "has_major_interaction")


@query("distinct_inns", sql("SELECT patient_id, inn FROM active_drugs"))
def distinct_inns(spark, sf):
    return active_drugs(spark, sf)


@query("patient_interactions", sql("""SELECT f.patient_id, f.drug_1, f.drug_2, f.severity, f.source, (SELECT count(*) FROM active_drugs d WHERE d.patient_id = f.patient_id) AS n_active_drugs,
    count(*) OVER (PARTITION BY f.patient_id) AS n_interactions, bool_or(f.severity = 'major') OVER (PARTITION BY f.patient_id) AS has_major_interaction FROM found f"""))
def patient_interactions(spark, sf):
    columns = ["patient_id", "drug_1", "drug_2", "severity", "source", "n_active_drugs", "n_interactions", "has_major_interaction"]
    found = I.patient_interactions(active_drugs(spark, sf))
    return found.sortWithinPartitions("patient_id", "severity_rank", "drug_1", "drug_2").select(columns)


@query("union_inns", sql("SELECT DISTINCT patient_id, inn FROM medications WHERE is_active"))
def union_inns(spark, sf):
    lines = B.dated_medications(spark, sf).where("is_active")
    return MED.union_inns(lines.where("line_no <= 4"), lines.where("line_no > 3"))


# --- labs and safety ---------------------------------------------------------

@query("latest_labs", sql("SELECT patient_id, analyte_name, result_id, value, unit, ref_range, flag FROM latest_labs"))
def latest_labs(spark, sf):
    return latest(spark, sf).drop("result_at")


def _all_drugs(spark, sf):
    return MED.distinct_inns(B.dated_medications(spark, sf))


_DRUGS = "SELECT DISTINCT patient_id, inn FROM medications"
_TITLE = "array_to_string(list_transform(string_split({0}, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ')"
_BAND = "({0} = 'both' OR ({0} = 'female') = contains(l.ref_range, '0.5'))"
_OP = """CASE r.operator WHEN '>' THEN l.value > r.threshold_value WHEN '<' THEN l.value < r.threshold_value WHEN 'between' THEN l.value BETWEEN r.threshold_value AND r.threshold_value_max END"""
_DYNAMIC = f"""SELECT d.patient_id, {_TITLE.format('r.drug_inn')} AS drug_name, r.analyte_name, r.severity,
    replace(replace(replace(r.description_template, '{{value}}', printf('%.2f', l.value)), '{{unit}}', l.unit), '{{threshold}}', printf('%.2f', r.threshold_value)) AS description,
    printf('%.2f', l.value) || ' ' || l.unit AS val_detected, l.ref_range, r.management_plan AS management
    FROM drugs d JOIN rule_table r ON r.drug_inn = d.inn JOIN latest_labs l ON l.patient_id = d.patient_id AND l.analyte_name = r.analyte_name
    WHERE r.is_enabled AND NOT r.is_deleted AND {_BAND.format('r.gender_specific')} AND {_OP}"""
_FIRST_DRUG = "SELECT d.patient_id, f.rule_id, min(d.inn) AS inn FROM drugs d JOIN fallback_drugs f ON f.inn = d.inn GROUP BY 1, 2"
_FALLBACK = f"""SELECT patient_id, {_TITLE.format('inn')} AS drug_name, analyte_name, severity,
    replace(replace(replace(description_template, '{{value}}', shown), '{{unit}}', unit), '{{drug}}', {_TITLE.format('inn')}) AS description,
    replace(replace(value_template, '{{value}}', shown), '{{unit}}', unit) AS val_detected, ref_range, management FROM (
      SELECT h.patient_id, h.inn, r.*, l.unit, l.ref_range, printf('%.' || r.decimals || 'f', l.value) AS shown, row_number() OVER (PARTITION BY h.patient_id, r.rule_id ORDER BY r.branch) AS pick
      FROM first_drug h JOIN fallback_rules r ON r.rule_id = h.rule_id JOIN latest_labs l ON l.patient_id = h.patient_id AND l.analyte_name = r.analyte_name
      WHERE (gt IS NULL OR l.value > gt) AND (ge IS NULL OR l.value >= ge) AND (lt IS NULL OR l.value < lt) AND (le IS NULL OR l.value <= le) AND {_BAND.format('r.band')}) x
    WHERE pick = 1 AND NOT EXISTS (SELECT 1 FROM rule_table t WHERE t.is_enabled AND NOT t.is_deleted AND t.drug_inn = x.inn AND t.analyte_name = x.analyte_name)"""


def keyed_alerts(key: str) -> dict:
    """Alert queries per key and patient, over ``drugs`` with that key."""
    first = f"SELECT d.{key}, d.patient_id, f.rule_id, min(d.inn) AS inn FROM drugs d JOIN fallback_drugs f ON f.inn = d.inn GROUP BY 1, 2, 3"
    fallback = _FALLBACK.replace("SELECT patient_id,", f"SELECT {key},").replace("SELECT h.patient_id,", f"SELECT h.{key},").replace("PARTITION BY h.patient_id,", f"PARTITION BY h.{key},")
    return dict(rule_table=RULE_TABLE, first_drug=first, dynamic_hits=_DYNAMIC.replace("SELECT d.patient_id,", f"SELECT d.{key},"), fallback_hits=fallback,
                alerts_of=f"SELECT {key}, count(*) AS n, bool_or(severity = 'critical') AS critical FROM (SELECT * FROM dynamic_hits UNION ALL SELECT * FROM fallback_hits) GROUP BY 1")


_SAFETY = dict(drugs=_DRUGS, rule_table=RULE_TABLE, first_drug=_FIRST_DRUG)
_ALERT = ["patient_id", "drug_name", "analyte_name", "severity", "description", "val_detected", "ref_range", "management"]


@query("safety_rules_join", sql("SELECT * FROM dynamic_hits", **_SAFETY, dynamic_hits=_DYNAMIC))
def safety_rules_join(spark, sf):
    return S.dynamic_alerts(_all_drugs(spark, sf), S.for_alerts(latest(spark, sf)), rule_table(spark, sf)).select(_ALERT)


@query("safety_fallback", sql("SELECT * FROM fallback_hits", **_SAFETY, fallback_hits=_FALLBACK))
def safety_fallback(spark, sf):
    return S.fallback_alerts(_all_drugs(spark, sf), S.for_alerts(latest(spark, sf)), rule_table(spark, sf)).select(_ALERT)


@query("alerts_union", sql("SELECT * FROM dynamic_hits UNION ALL SELECT * FROM fallback_hits", **_SAFETY, dynamic_hits=_DYNAMIC, fallback_hits=_FALLBACK))
def alerts_union(spark, sf):
    return S.safety_alerts(_all_drugs(spark, sf), latest(spark, sf), rule_table(spark, sf))


@query("render_alert", sql("""SELECT result_id, 'Value ' || printf('%.2f', value) || ' ' || unit || ' over ' || printf('%.2f', high_above) AS alert FROM lab_results WHERE value > high_above"""))
def render_alert(spark, sf):
    from rxweave.functions.payloads import render_alert as render
    limits = F.broadcast(tables.analyte_rules(spark).select("analyte_name", "high_above"))
    rows = B.lab_results(spark, sf).join(limits, "analyte_name").where(F.col("value") > F.col("high_above"))
    return rows.select("result_id", render(F.lit("Value {value} {unit} over {threshold}"), F.col("value"), F.col("unit"), F.col("high_above")).alias("alert"))


@query("class_intersection", sql("SELECT d.patient_id, f.rule_id, count(*) AS n_drugs, min(d.inn) AS inn FROM drugs d JOIN fallback_drugs f ON f.inn = d.inn GROUP BY 1, 2", drugs=_DRUGS))
def class_intersection(spark, sf):
    sets = F.broadcast(tables.fallback_drugs(spark))
    return _all_drugs(spark, sf).join(sets, "inn").groupBy("patient_id", "rule_id").agg(F.count("*").alias("n_drugs"), F.min("inn").alias("inn"))


@query("uncovered_pairs", sql("""SELECT DISTINCT d.patient_id, d.inn, l.analyte_name FROM drugs d JOIN latest_labs l ON l.patient_id = d.patient_id
    WHERE NOT EXISTS (SELECT 1 FROM rule_table t WHERE t.is_enabled AND NOT t.is_deleted AND t.drug_inn = d.inn AND t.analyte_name = l.analyte_name)
    AND EXISTS (SELECT 1 FROM fallback_drugs f JOIN fallback_rules r ON r.rule_id = f.rule_id WHERE f.inn = d.inn AND r.analyte_name = l.analyte_name)""", drugs=_DRUGS, rule_table=RULE_TABLE))
def uncovered_pairs(spark, sf):
    """Drug and analyte pairs of a patient that only a fallback rule looks at."""
    pairs = tables.fallback_drugs(spark).join(tables.fallback_rules(spark).select("rule_id", "analyte_name"), "rule_id").select("inn", "analyte_name").distinct()
    open_pairs = pairs.join(S.handled_pairs(rule_table(spark, sf)), ["inn", "analyte_name"], "left_anti")
    hits = _all_drugs(spark, sf).join(F.broadcast(open_pairs), "inn")
    return hits.join(latest(spark, sf).select("patient_id", "analyte_name"), ["patient_id", "analyte_name"]).select("patient_id", "inn", "analyte_name")


# --- history of prescriptions ------------------------------------------------

@query("recent_rx_50", sql("SELECT * FROM (SELECT patient_id, rx_id, CAST(created_at AS VARCHAR) AS created_at, row_number() OVER (PARTITION BY patient_id ORDER BY p.created_at DESC, rx_id DESC) AS rn FROM prescriptions p) WHERE rn <= 50"))
def recent_rx_50(spark, sf):
    return MED.recent_prescriptions(B.prescriptions(spark, sf), P.HISTORY_LIMIT).select("patient_id", "rx_id", day("created_at"), "rn")


_RX_FOUND = """SELECT p.rx_id, r.severity FROM rx_pairs p JOIN pair_rules r ON p.drug_1 = r.drug_1 AND p.drug_2 = r.drug_2
    UNION ALL SELECT p.rx_id, c.severity FROM rx_pairs p JOIN drug_classes x ON x.inn = p.drug_1 JOIN drug_classes y ON y.inn = p.drug_2
    JOIN class_pairs c ON (c.class_a = x.drug_class AND c.class_b = y.drug_class) OR (c.class_a = y.drug_class AND c.class_b = x.drug_class)
    WHERE NOT EXISTS (SELECT 1 FROM pair_rules r WHERE r.drug_1 = p.drug_1 AND r.drug_2 = p.drug_2)"""
_RX_PAIRS = "SELECT DISTINCT a.rx_id, a.inn AS drug_1, b.inn AS drug_2 FROM medications a JOIN medications b ON a.rx_id = b.rx_id AND a.inn < b.inn"


@query("patient_history", sql("""SELECT t.patient_id, p.phone, t.rx_id, CAST(t.created_at AS VARCHAR) AS created_at, coalesce(m.n_meds, 0) AS n_meds, coalesce(m.n_oral, 0) AS n_oral, coalesce(i.n, 0) AS n_interactions, coalesce(i.major, FALSE) AS has_major,
    t.confidence < 0.5 AS needs_review, t.total_all AS total, t.total_all
    FROM (SELECT *, count(*) OVER (PARTITION BY patient_id) AS total_all FROM prescriptions) t
    JOIN patients p ON p.patient_id = t.patient_id
    LEFT JOIN (SELECT rx_id, count(*) AS n_meds, count(*) FILTER (coalesce(route, 'oral') = 'oral') AS n_oral FROM medications GROUP BY 1) m ON m.rx_id = t.rx_id
    LEFT JOIN (SELECT rx_id, count(*) AS n, bool_or(severity = 'major') AS major FROM rx_found GROUP BY 1) i ON i.rx_id = t.rx_id""", rx_pairs=_RX_PAIRS, rx_found=_RX_FOUND))
def patient_history(spark, sf):
    med = B.medication_lines(spark, sf)
    found = I.interactions(MED.distinct_inns(med, "rx_id"), "rx_id")
    out = H.patient_history(B.patients(spark, sf), B.prescriptions(spark, sf), med, found)
    return out.withColumn("created_at", day("created_at"))


@query("history_medications", sql("""SELECT m.patient_id, m.rx_id, m.inn, coalesce(m.route, 'oral') AS route, m.dosage_value FROM medications m JOIN prescriptions t ON t.rx_id = m.rx_id"""))
def history_medications(spark, sf):
    return H.history_medications(B.prescriptions(spark, sf), B.medication_lines(spark, sf)).select("patient_id", "rx_id", "inn", "route", "dosage_value")


# --- events, audit, constraints -----------------------------------------------

_REQ = "SELECT * FROM (VALUES " + ", ".join(f"('{t}', {items(k)})" for t, k in sorted(B.E.REQUIRED_KEYS.items())) + ") t(event_type, keys)"


@query("event_conformance", sql("""SELECT event_id, e.event_type, len(missing) AS n_missing, array_to_string(missing, ',') AS missing FROM (SELECT e.*, list_filter(r.keys, lambda x: NOT list_contains(
    list_concat(['inn', 'episode_id'], CASE WHEN event_id % 3 = 0 THEN ['dosage'] ELSE [] END, CASE WHEN event_id % 4 = 0 THEN ['condition_code'] ELSE [] END, CASE WHEN event_id % 2 = 0 THEN ['severity'] ELSE [] END), x)) AS missing
    FROM history_events e JOIN required r ON r.event_type = e.event_type) e""", required=_REQ))
def event_conformance(spark, sf):
    return EV.conformance(B.history_events(spark, sf))


@query("constraint_audit", sql("""SELECT 'one confidence in range' AS "constraint", CAST(rx_id AS VARCHAR) AS key, 1 AS n FROM (SELECT rx_id, confidence * 1.2 AS confidence FROM prescriptions) WHERE confidence < 0 OR confidence > 1
    UNION ALL SELECT 'unique line', l_orderkey || '|' || l_linenumber, count(*) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    UNION ALL SELECT 'reaction type', CAST(patient_id AS VARCHAR), 1 FROM reactions WHERE reaction_type = 'unknown'
    UNION ALL SELECT 'unique phone', c_name, count(*) FROM customer GROUP BY c_name HAVING count(*) > 1
    UNION ALL SELECT 'reaction severity', CAST(patient_id AS VARCHAR), 1 FROM reactions WHERE severity NOT IN ('mild', 'moderate', 'severe', 'life_threatening')
    UNION ALL SELECT 'unique doctor', speciality, count(*) FROM doctors GROUP BY speciality HAVING count(*) > 1
    UNION ALL SELECT 'unique signal', inn || '|' || condition_code, count(*) FROM signals GROUP BY inn, condition_code HAVING count(*) > 1
    UNION ALL SELECT 'unique rule name', drug_inn, count(*) FROM rules GROUP BY drug_inn HAVING count(*) > 1
    UNION ALL SELECT 'review action', CAST(patient_id AS VARCHAR), 1 FROM stored_conditions WHERE status NOT IN ('confirm', 'reject', 'resolve')
    UNION ALL SELECT 'interaction severity', drug_1 || '|' || drug_2, 1 FROM pair_rules WHERE severity NOT IN ('major', 'moderate', 'minor', 'unknown')
    UNION ALL SELECT 'alert severity', rule_name, 1 FROM rules WHERE severity NOT IN ('critical', 'warning', 'info')
    UNION ALL SELECT 'one open condition', patient_id || '|' || condition_code, count(*) FROM stored_conditions WHERE status IN ('probable', 'confirmed') GROUP BY patient_id, condition_code HAVING count(*) > 1"""))
def constraint_audit(spark, sf):
    raised = B.prescriptions(spark, sf).withColumn("confidence", F.col("confidence") * 1.2)
    is_open = F.col("status").isin("probable", "confirmed")
    return M.constraint_audit(
        M.outside_range(raised, "one confidence in range", "rx_id", "confidence"),
        M.duplicate_keys(B.medication_lines(spark, sf), "unique line", ["rx_id", "line_no"]),
        M.outside_values(B.reactions(spark, sf), "reaction type", "patient_id", "reaction_type", B.E.ALLOWED["reaction_type"]),
        M.duplicate_keys(B.patients(spark, sf), "unique phone", ["phone"]),
        M.outside_values(B.reactions(spark, sf), "reaction severity", "patient_id", "severity", B.E.ALLOWED["reaction_severity"]),
        # bound columns that break the rule, so that the check has violations to find
        M.duplicate_keys(B.doctors(spark, sf), "unique doctor", ["speciality"]),
        M.duplicate_keys(tables.condition_signals(spark), "unique signal", ["inn", "condition_code"]),
        M.duplicate_keys(tables.baseline_rules(spark), "unique rule name", ["drug_inn"]),
        M.outside_values(B.stored_conditions(spark, sf), "review action", "patient_id", "status", B.E.ALLOWED["review_action"]),
        M.outside_values(tables.pair_rules(spark).withColumn("key", F.concat_ws("|", "drug_1", "drug_2")), "interaction severity", "key", "severity", B.E.ALLOWED["severity"]),
        M.outside_values(tables.baseline_rules(spark), "alert severity", "rule_name", "severity", B.E.ALLOWED["alert_severity"]),
        M.duplicate_keys(B.stored_conditions(spark, sf), "one open condition", ["patient_id", "condition_code"], is_open))


@query("approve_overrides", sql("SELECT log_id, needs_admin_oversight AND log_id % 4 <> 0 AS needs_admin_oversight FROM audit_logs"))
def approve_overrides(spark, sf):
    logs = B.audit_logs(spark, sf)
    return M.approve_overrides(logs, logs.where("log_id % 4 = 0").select("log_id")).select("log_id", "needs_admin_oversight")


@query("event_counts", sql("SELECT CAST(CAST(date_trunc('day', created_at) AS DATE) AS VARCHAR) AS window_start, event_type, count(*) AS n FROM history_events GROUP BY 1, 2"))
def event_counts(spark, sf):
    return EV.window_counts(B.history_events(spark, sf)).select(F.to_date("window_start").cast("string").alias("window_start"), "event_type", "n")


