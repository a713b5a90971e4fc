"""The domain bindings and reference tables as SQL, for the check queries.

Written independently of the DataFrame code: the check SQL must not share the
logic it checks.
"""

from __future__ import annotations

import re

from rxweave import bindings as B
from rxweave.refdata import analytes, interactions, signals, tables
from rxweave.refdata import safety_rules as S


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def at(values, index: str) -> str:
    """Element of a list at an index modulo its length."""
    return f"({items(values)})[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


def table(rows, columns) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) t({', '.join(columns)})"


def isin(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


AS_OF = f"DATE '{B.AS_OF_RX}'"
GROUP_CASE = "CASE " + " ".join(f"WHEN contains(lower({{c}}), {lit(w)}) THEN {lit(g)}" for w, g in signals.SPECIALITY_GROUPS) + " ELSE 'general' END"


def group_case(column: str) -> str:
    return f"CASE WHEN {column} IS NULL OR {column} = '' THEN NULL ELSE {GROUP_CASE.format(c=column)} END"


_RULES = tables.RULE_SCHEMA
CTES = {
    "patients": "SELECT c_custkey patient_id, c_name phone, c_nationkey facility_id FROM customer",
    "facilities": "SELECT n_nationkey facility_id, n_name name FROM nation",
    "prescriptions": "SELECT o_orderkey rx_id, o_custkey patient_id, CAST(o_orderdate AS DATE) created_at, (o_orderkey % 100) / 100.0::DOUBLE confidence FROM orders",
    "medications": f"""SELECT l_orderkey rx_id, o_custkey patient_id, CAST(o_orderdate AS DATE) rx_date, CAST(o_orderdate AS DATE) created_at,
        l_linenumber line_no, {at(B.CATALOG, 'l_partkey')} inn, {at(B.BRANDS, 'l_partkey')} raw_drug_name, l_quantity dosage_value, 'mg' dosage_unit,
        {at([f for f, _ in B.FREQUENCIES], 'l_linenumber')} frequency, CASE l_returnflag WHEN 'A' THEN 7 WHEN 'R' THEN 30 END duration_days,
        CASE WHEN l_linenumber % 5 <> 0 THEN 'oral' END route, l_suppkey doctor_id, l_linenumber % 7 <> 0 is_active
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "active": f"SELECT * FROM medications WHERE is_active AND (duration_days IS NULL OR created_at >= {AS_OF} - INTERVAL 90 DAY)",
    "active_drugs": "SELECT DISTINCT patient_id, inn FROM active",
    "doctors": f"SELECT s_suppkey doctor_id, s_name AS name, 'MH - ' || s_suppkey registration_number, {at(B.SPECIALITIES, 's_suppkey')} speciality FROM supplier",
    "mentions": f"""SELECT CASE l_linenumber % 4 WHEN 0 THEN 'mh-' || l_suppkey WHEN 1 THEN 'MH - ' || l_suppkey WHEN 2 THEN 'M.H. ' || l_suppkey END reg_number,
        CASE WHEN l_linenumber % 7 < 3 THEN 'Dr S' || l_suppkey WHEN l_linenumber % 7 < 5 THEN 'DR. S' || l_suppkey END AS name,
        CASE WHEN l_linenumber % 3 = 0 THEN {at(B.SPECIALITIES, 'l_suppkey')} END speciality, l_orderkey seen_order, l_linenumber seen_line FROM lineitem""",
    "analytes": table(analytes.ANALYTES, analytes.ANALYTE_COLUMNS),
    "lab_binding": table(B.LAB_BINDING, ["event_type", "parity", "analyte_name", "base", "step", "steps"]),
    "lab_values": """SELECT event_id result_id, user_id patient_id, b.analyte_name, (base + step * (CAST(round(value * 100) AS BIGINT) % steps)) / 100.0::DOUBLE AS value,
        a.unit, CASE WHEN b.analyte_name = 'CREATININE' AND user_id % 2 = 0 THEN '0.5 - 1.1 mg/dL' ELSE a.ref_range END ref_range, a.low_below, a.high_above, a.high_from,
        CASE WHEN event_id % 9 <> 0 THEN CAST(ts AS DATE) END report_date, ts created_at
        FROM events e JOIN lab_binding b ON e.event_type = b.event_type AND e.event_id % 2 = b.parity JOIN analytes a ON a.analyte_name = b.analyte_name""",
    "lab_results": """SELECT *, CASE WHEN value > high_above OR value >= high_from THEN 'high' WHEN value < low_below THEN 'low' ELSE 'normal' END flag FROM lab_values""",
    "latest_labs": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, analyte_name ORDER BY coalesce(CAST(report_date AS TIMESTAMP), created_at) DESC, result_id) rn FROM lab_results) WHERE rn = 1""",
    "review_queue": """SELECT o_orderkey item_id, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END patient_id, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey % 25 END facility_id,
        CASE WHEN o_orderkey % 3 = 0 THEN 'lab' ELSE 'prescription' END item_type, (o_orderkey % 100) / 100.0::DOUBLE confidence, o_orderstatus = 'F' resolved, CAST(o_orderdate AS DATE) created_at
        FROM orders WHERE o_orderkey % 100 < 50""",
    "clinicians": f"SELECT s_suppkey clinician_id, s_name AS name, lower(s_name) || '@example.org' email, {at(B.SCOPES, 's_suppkey')} scopes, s_nationkey active_facility_id FROM supplier",
    "clinician_facilities": "SELECT DISTINCT s_suppkey clinician_id, unnest([s_nationkey, (s_nationkey + 7) % 25]) facility_id FROM supplier",
    "audit_logs": f"SELECT event_id log_id, user_id clinician_id, event_id % 30 facility_id, event_type AS action, event_type IN {isin(B.OVERSIGHT_TYPES)} needs_admin_oversight, ts created_at FROM events",
    "history_events": f"SELECT event_id, {at(B.EVENT_TYPES, 'event_id')} event_type, user_id patient_id, ts created_at, value, event_id k FROM events",
    "reactions": f"""SELECT c_custkey patient_id, {at(B.CATALOG, 'c_custkey')} inn, [{at(B.CATALOG, 'c_custkey + 1')}, {at(B.CATALOG, 'c_custkey + 2')}] cross_reactive_inns,
        {at(B.REACTION_TYPES, 'c_custkey')} reaction_type, {at(B.REACTION_SEVERITIES, 'c_custkey')} severity, c_acctbal > 0 is_active FROM customer""",
    "stored_conditions": f"""SELECT c_custkey patient_id, {at([c for c, _, _ in B.STORED_CODES], 'c_custkey')} condition_code,
        {at(B.STORED_STATUS, 'c_custkey // 4')} status, (c_custkey % 50 + 50) / 100.0::DOUBLE confidence FROM customer""",
    "brands": f"SELECT lower(p_name) brand_name, {at(B.CATALOG, 'min(p_partkey)')} inn FROM part GROUP BY lower(p_name)",
    "pair_rules": table(tables.pair_rows(), _RULES),
    "class_rules": table([(*r[:2], *r[2:5], interactions.CLASS_SOURCE) for r in tables.class_pair_rows()], _RULES),
    "drug_classes": table([(d, c) for c, ds in interactions.CLASS_MEMBERS.items() for d in ds], ["inn", "drug_class"]),
    "class_pairs": table([r[:5] for r in interactions.CLASS_RULES], ["class_a", "class_b", "severity", "description", "management"]),
    "signals": table(signals.SIGNALS, signals.SIGNAL_COLUMNS),
    "rules": table(S.BASELINE_RULES, S.RULE_COLUMNS),
    "fallback_rules": table(S.FALLBACK_RULES, S.FALLBACK_COLUMNS),
    "fallback_drugs": table(tables.fallback_drug_rows(), ["rule_id", "inn"]),
    # every unordered pair of a patient's active drugs, looked up one by one
    "active_pairs": "SELECT a.patient_id, a.inn drug_1, b.inn drug_2 FROM active_drugs a JOIN active_drugs b ON a.patient_id = b.patient_id AND a.inn < b.inn",
    "found_exact": "SELECT p.patient_id, p.drug_1, p.drug_2, r.severity, r.source, r.description FROM active_pairs p JOIN pair_rules r ON p.drug_1 = r.drug_1 AND p.drug_2 = r.drug_2",
    "found_class": """SELECT p.patient_id, p.drug_1, p.drug_2, c.severity, 'DRUG_CLASS' source, c.description FROM active_pairs p
        JOIN drug_classes x ON x.inn = p.drug_1 JOIN drug_classes y ON y.inn = p.drug_2
        JOIN class_pairs c ON (c.class_a = x.drug_class AND c.class_b = y.drug_class) OR (c.class_a = y.drug_class AND c.class_b = x.drug_class)
        WHERE NOT EXISTS (SELECT 1 FROM pair_rules r WHERE r.drug_1 = p.drug_1 AND r.drug_2 = p.drug_2)""",
    "found": "SELECT * FROM found_exact UNION ALL SELECT * FROM found_class",
    # prescription × drug, first line wins
    "rx_drugs": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, inn, rx_id ORDER BY line_no, dosage_value, dosage_unit, frequency, duration_days NULLS FIRST, doctor_id) rn FROM medications) WHERE rn = 1""",
    "defaults": "SELECT * FROM (SELECT inn, episode_gap_tolerance gap_days, medication_class, is_prn, row_number() OVER (PARTITION BY inn ORDER BY condition_code) rn FROM signals) WHERE rn = 1",
    "scheduled": """SELECT d.* EXCLUDE (rn), coalesce(s.gap_days, 45) gap_days, d.rx_date + CAST(d.duration_days AS INTEGER) end_date,
        row_number() OVER (PARTITION BY patient_id, d.inn ORDER BY rx_date, rx_id) seq
        FROM rx_drugs d LEFT JOIN defaults s ON s.inn = d.inn WHERE NOT coalesce(s.is_prn, FALSE)""",
    # the gap rule applied line by line, in order
    "folded": """SELECT patient_id, inn, seq, 1 episode_no, end_date est_end FROM scheduled WHERE seq = 1
        UNION ALL SELECT s.patient_id, s.inn, s.seq,
          f.episode_no + CASE WHEN f.est_end IS NOT NULL AND s.rx_date > f.est_end + s.gap_days THEN 1 ELSE 0 END,
          CASE WHEN f.est_end IS NOT NULL AND s.rx_date > f.est_end + s.gap_days THEN s.end_date ELSE greatest(f.est_end, s.end_date) END
        FROM folded f JOIN scheduled s ON s.patient_id = f.patient_id AND s.inn = f.inn AND s.seq = f.seq + 1""",
    "lines": """SELECT s.*, f.episode_no, f.est_end FROM scheduled s JOIN folded f ON s.patient_id = f.patient_id AND s.inn = f.inn AND s.seq = f.seq""",
    "sched_episodes": """SELECT patient_id, inn, episode_no, min(rx_date) start_date, max(end_date) estimated_end_date, count(*) prescription_count, max(gap_days) gap_days,
        arg_max(dosage_value, seq) latest_dosage_value, arg_max(frequency, seq) latest_frequency, arg_max(doctor_id, seq) doctor_id,
        episode_no < max(episode_no) OVER (PARTITION BY patient_id, inn) closed FROM lines GROUP BY patient_id, inn, episode_no""",
    "episodes": """SELECT patient_id, inn, episode_no, 'scheduled' dispensing_type, CASE WHEN closed THEN 'completed' ELSE 'active' END status, start_date, estimated_end_date,
        CASE WHEN closed THEN estimated_end_date END actual_end_date, prescription_count, prescription_count + CAST(closed AS INTEGER) AS version, latest_dosage_value, latest_frequency, doctor_id FROM sched_episodes
        UNION ALL SELECT d.patient_id, d.inn, NULL, 'prn', 'prn_snapshot', rx_date, rx_date + CAST(duration_days AS INTEGER), NULL, 1, 1, dosage_value, frequency, doctor_id
        FROM rx_drugs d JOIN defaults s ON s.inn = d.inn WHERE s.is_prn""",
    "recent": f"SELECT *, row_number() OVER () eid FROM episodes WHERE start_date >= {AS_OF} - INTERVAL 12 MONTH",
    "parts": "SELECT eid, unnest(list_distinct(list_concat([inn], list_transform(string_split(inn, '+'), lambda x: trim(x))))) part FROM recent",
    "evidence": """SELECT r.patient_id, s.condition_code, s.condition_name, s.condition_group, s.inn signal_inn, s.signal_strength, s.specificity, s.condition_prevalence, s.requires_speciality,
        r.prescription_count, coalesce(r.estimated_end_date, r.actual_end_date, r.start_date) last_date, s.signal_strength * s.specificity * CASE WHEN r.status = 'active' THEN 1.0::DOUBLE ELSE 0.4::DOUBLE END factor,
        r.prescription_count >= s.min_prescriptions counts FROM recent r JOIN parts p ON p.eid = r.eid JOIN signals s ON s.inn = p.part""",
    "rolled": """SELECT patient_id, condition_code, arg_min(condition_name, signal_inn) condition_name, arg_min(condition_group, signal_inn) condition_group, arg_min(condition_prevalence, signal_inn) prior,
        arg_min(coalesce(requires_speciality, ''), signal_inn) required, 1 - product(CASE WHEN counts THEN 1 - factor ELSE 1 END) noisy_or,
        max(prescription_count) FILTER (counts) max_rx, max(last_date) FILTER (counts) last_date, count(*) FILTER (counts) n_factors,
        string_agg(DISTINCT signal_inn, ',' ORDER BY signal_inn) supporting FROM evidence GROUP BY patient_id, condition_code HAVING count(*) FILTER (counts) > 0""",
    "seen_doctors": f"SELECT DISTINCT r.patient_id, r.doctor_id, d.speciality, {group_case('d.speciality')} speciality_group FROM recent r JOIN doctors d ON d.doctor_id = r.doctor_id",
    "primary_group": "SELECT patient_id, speciality_group FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY coalesce(speciality_group, 'general') = 'general', doctor_id) rn FROM seen_doctors) WHERE rn = 1",
    "gated": """SELECT r.*, g.speciality_group FROM rolled r LEFT JOIN primary_group g ON g.patient_id = r.patient_id WHERE r.required = '' OR EXISTS (
        SELECT 1 FROM seen_doctors d WHERE d.patient_id = r.patient_id AND contains(lower(d.speciality), lower(r.required)))""",
    "ratios": table(signals.SPECIALITY_RATIOS, ["speciality_group", "condition_group", "ratio"]),
    "decayed": f"""SELECT g.*, date_diff('day', last_date, {AS_OF}) AS since, coalesce((SELECT ratio FROM ratios x WHERE x.speciality_group = g.speciality_group AND x.condition_group = g.condition_group),
        (SELECT ratio FROM ratios x WHERE x.speciality_group = g.speciality_group AND x.condition_group = g.speciality_group), 1.0) ratio,
        CASE WHEN date_diff('day', last_date, {AS_OF}) > 180 THEN prior + (noisy_or - prior) * exp(-0.005 * (date_diff('day', last_date, {AS_OF}) - 180)) ELSE noisy_or END p FROM gated g""",
    "shifted": "SELECT *, CASE WHEN ratio = 1 THEN p ELSE 1 / (1 + exp(-(ln(least(greatest(p, 1e-9), 1 - 1e-9) / (1 - least(greatest(p, 1e-9), 1 - 1e-9))) + ln(ratio)))) END q, least(1.0, ln(1 + max_rx) / ln(11)) cred FROM decayed",
    "scored": "SELECT *, round(cred * q + (1 - cred) * prior, 4) confidence FROM shifted",
    "inferred": "SELECT * FROM scored WHERE confidence >= 0.30",
}
_NAME = re.compile(r"[a-z_]+")
_TEXT = re.compile(r"'(?:[^']|'')*'")


def _needs(text: str) -> list[str]:
    words = set(_NAME.findall(_TEXT.sub("", text)))
    return [n for n in CTES if n in words]


def sql(body: str, **extra: str) -> str:
    """A check query with the CTEs it mentions in front, in order."""
    chosen: list[str] = []

    def visit(name: str) -> None:
        for other in _needs(extra.get(name) or CTES[name]):
            if other != name and other not in chosen:
                visit(other)
        if name not in chosen:
            chosen.append(name)

    own = list(extra)
    for name in _needs(body + " " + " ".join(extra.values())):
        visit(name)
    parts = [f"{n} AS ({CTES[n]})" for n in chosen if n not in extra] + [f"{n} AS ({extra[n]})" for n in own]
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + body
