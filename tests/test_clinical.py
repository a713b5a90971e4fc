"""Interactions, safety rules, episodes, inference, doctors and feeds."""

import datetime as dt
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rxweave.operators import doctors as D
from rxweave.operators import episodes as E
from rxweave.operators import events as EV
from rxweave.operators import inference as INF
from rxweave.operators import interactions as I
from rxweave.operators import labs as L
from rxweave.operators import maintenance as M
from rxweave.operators import medications as MED
from rxweave.operators import safety as S
from rxweave.refdata import tables
from rxweave.sources import readers

DAY = dt.date(2024, 1, 1)


def drugs(spark, *sets):
    rows = [(i, d) for i, s in enumerate(sets) for d in s]
    return spark.createDataFrame(rows, "patient_id long, inn string")


def test_interactions(spark):
    sets = [["warfarin", "ibuprofen"], ["sertraline", "naproxen"], ["azithromycin", "levofloxacin"], ["escitalopram", "ibuprofen"], ["warfarin"], ["aspirin", "metformin"],
            ["sildenafil", "isosorbide dinitrate"], ["sertraline", "fluoxetine"], ["warfarin", "ibuprofen", "clopidogrel", "omeprazole"]]
    got = {(r.patient_id, r.drug_1, r.drug_2): (r.severity, r.source) for r in I.interactions(drugs(spark, *sets)).collect()}
    assert got == {
        (0, "ibuprofen", "warfarin"): ("major", "CRITICAL_DDI_DB"), (1, "naproxen", "sertraline"): ("moderate", "DRUG_CLASS"),
        (2, "azithromycin", "levofloxacin"): ("major", "DRUG_CLASS"), (8, "ibuprofen", "warfarin"): ("major", "CRITICAL_DDI_DB"),
        (8, "clopidogrel", "omeprazole"): ("moderate", "CRITICAL_DDI_DB")}


def test_label_mentions(spark):
    labels = spark.createDataFrame([("alpha", "Avoid Beta  acid, and gamma."), ("warfarin", "not with aspirin"), ("beta acid", "alpha")], "inn string, label_text string")
    got = I.label_interactions(drugs(spark, ["alpha", "beta acid", "gam", "warfarin"], ["alpha", "gamma"]), labels).collect()
    assert {(r.patient_id, r.drug_1, r.drug_2, r.severity) for r in got} == {(0, "alpha", "beta acid", "unknown"), (1, "alpha", "gamma", "unknown")}


ALERTS = [
    ("metformin", "CREATININE", 1.6, None, "critical"), ("metformin", "CREATININE", 1.45, None, "warning"), ("metformin", "CREATININE", 1.4, None, None),
    ("metformin", "CREATININE", 1.45, "0.5 - 1.1", "warning"), ("levothyroxine", "TSH", 5.0, None, "warning"), ("levothyroxine", "TSH", 0.1, None, "warning"),
    ("levothyroxine", "TSH", 2.0, None, None), ("aspirin", "HEMOGLOBIN", 9.0, None, "warning"), ("aspirin", "HEMOGLOBIN", 10.0, None, "info"), ("aspirin", "HEMOGLOBIN", 11.5, None, None),
    ("rosuvastatin", "LDL", 130.0, None, "info"), ("glimepiride", "FASTING_BLOOD_SUGAR", 60.0, None, "critical"), ("sitagliptin", "HBA1C", 9.0, None, "warning"),
    ("clopidogrel", "PLATELET_COUNT", 90.0, None, "critical"), ("clopidogrel", "PLATELET_COUNT", 90000.0, None, "critical"), ("clopidogrel", "PLATELET_COUNT", 150.0, None, None),
    ("losartan", "CREATININE", 1.5, None, "warning"), ("lovastatin", "TRIGLYCERIDES", 210.0, None, "info"), ("azathioprine", "TLC", 3.0, None, "critical"),
    ("azathioprine", "NEUTROPHILS", 30.0, None, "warning"), ("metformin + glipizide", "CREATININE", 3.0, None, None), ("insulin glargine", "FASTING_BLOOD_SUGAR", 50.0, None, None)]


def labs_of(spark, rows):
    return spark.createDataFrame(rows, "patient_id long, analyte_name string, value double, unit string, ref_range string, flag string")


def test_fallback_rules(spark):
    d = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ALERTS)], "patient_id long, inn string")
    labs = labs_of(spark, [(i, a[1], a[2], None, a[3], None) for i, a in enumerate(ALERTS)])
    none = tables.baseline_rules(spark).where("false")
    got = {r.patient_id: r for r in S.safety_alerts(d, labs, none).collect()}
    assert {i: got[i].severity for i in got} == {i: a[4] for i, a in enumerate(ALERTS) if a[4]}
    assert "(1.45 mg/dL > 1.4 mg/dL limit)" in got[3].description and "(1.45 mg/dL > 1.5 mg/dL limit)" in got[1].description
    assert got[0].val_detected == "1.60 mg/dL" and got[12].val_detected == "9.0%" and got[13].drug_name == "Clopidogrel"


def test_rule_table_replaces_fallback(spark):
    d = drugs(spark, ["metformin"], ["metformin"], ["methotrexate"])
    labs = labs_of(spark, [(0, "CREATININE", 1.6, "mg/dL", None, "HIGH"), (1, "CREATININE", 1.6, "mg/dL", None, "normal"), (2, "TLC", 3.0, None, None, None), (2, "NEUTROPHILS", 30.0, None, None, None)])
    schema = tables.baseline_rules(spark).schema
    row = lambda name, inn, analyte, enabled: (name, inn, analyte, None, None, None, "high", None, None, "{value} {unit} {threshold}", "plan", enabled, False, 1)
    on = spark.createDataFrame([row("a", "metformin", "creatinine", True), row("b", "methotrexate", "TLC", True)], schema)
    got = [(r.patient_id, r.severity, r.description) for r in S.safety_alerts(d, labs, on).collect()]
    # patient 1: the flag does not match, yet the pair is handled; patient 2: the
    # suppressed leucocyte alert still blocks the neutrophil one
    assert got == [(0, "warning", "1.60 mg/dL ")]
    off = spark.createDataFrame([row("a", "metformin", "creatinine", False)], schema)
    assert {(r.patient_id, r.severity) for r in S.safety_alerts(d, labs, off).collect()} == {(0, "critical"), (1, "critical"), (2, "critical")}


def test_latest_labs(spark):
    ts = lambda d: dt.datetime(2024, 1, d)
    rows = [(1, 7, "tsh", 1.0, "u", "r", "f", dt.date(2024, 1, 5), ts(1)), (2, 7, "TSH", 2.0, "u", "r", "f", None, ts(6)), (3, 7, "TSH", 3.0, "u", "r", "f", dt.date(2024, 1, 6), ts(1)), (4, 8, "LDL", 4.0, "u", "r", "f", None, ts(1))]
    df = spark.createDataFrame(rows, "result_id long, patient_id long, analyte_name string, value double, unit string, ref_range string, flag string, report_date date, created_at timestamp")
    assert {(r.patient_id, r.analyte_name, r.value) for r in L.latest_labs(df).collect()} == {(7, "TSH", 2.0), (8, "LDL", 4.0)}


def fold(lines, gap):
    """Episodes of one drug, line by line: [start, end, count]."""
    out = []
    for day, days in sorted(lines, key=lambda line: line[0]):
        end = day + dt.timedelta(days) if days else None
        if out and (out[-1][1] is None or day <= out[-1][1] + dt.timedelta(gap)):
            cur = out[-1]
            cur[2] += 1
            if end and (cur[1] is None or end > cur[1]):
                cur[1] = end
        else:
            out.append([day, end, 1])
    return out


def lines_frame(spark, rows):
    return spark.createDataFrame(
        [(p, inn, i, day, 1, float(i % 3), "mg", "od", days, 5, inn) for i, (p, inn, day, days) in enumerate(rows)],
        "patient_id long, inn string, rx_id long, rx_date date, line_no int, dosage_value double, dosage_unit string, frequency string, duration_days int, doctor_id long, raw_drug_name string")


LINE = st.tuples(st.sampled_from([0, 1]), st.sampled_from(["metformin", "tramadol", "unlisted"]), st.integers(0, 500).map(lambda d: DAY + dt.timedelta(d)), st.sampled_from([None, 0, 5, 30, 90]))
GAPS = {"metformin": 60, "tramadol": 7, "unlisted": 45}


@settings(max_examples=6, deadline=None)
@given(st.lists(LINE, min_size=1, max_size=60))
def test_episodes_equal_the_fold(spark, rows):
    got = {}
    for r in E.medication_episodes(E.prescription_drugs(lines_frame(spark, rows))).collect():
        got.setdefault((r.patient_id, r.inn), []).append([r.start_date, r.estimated_end_date, r.prescription_count])
    want = {}
    for p, inn, day, days in rows:
        want.setdefault((p, inn), []).append((day, days))
    assert {k: sorted(v, key=lambda e: e[0]) for k, v in got.items()} == {k: fold(v, GAPS[k[1]]) for k, v in want.items()}


def test_open_end_and_gap(spark):
    rows = [(1, "metformin", dt.date(2024, 1, 1), 30), (1, "metformin", dt.date(2024, 2, 10), 30), (1, "metformin", dt.date(2024, 9, 1), None), (1, "metformin", dt.date(2025, 9, 1), 30),
            (1, "salbutamol", dt.date(2024, 1, 1), 5), (1, "salbutamol", dt.date(2024, 1, 1), 5), (2, "metformin + glipizide", dt.date(2024, 1, 1), 30)]
    d = E.prescription_drugs(lines_frame(spark, rows))
    eps = E.medication_episodes(d).collect()
    main = sorted((e for e in eps if e.inn == "metformin"), key=lambda e: e.start_date)
    assert [(e.status, e.prescription_count, e.actual_end_date, e.version) for e in main] == [("completed", 2, dt.date(2024, 3, 11), 3), ("active", 2, None, 2)]
    assert [e.status for e in eps if e.inn == "salbutamol"] == ["prn_snapshot"] * 2
    assert [list(e.fdc_components) for e in eps if e.is_fdc] == [["metformin", "glipizide"]]
    days = E.episode_days(d)
    found = E.episode_events(E.episode_lines(d, days), E.scheduled_episodes(days), E.prn_snapshots(d))
    kinds = [r.event_type for r in found.where("patient_id = 1 and inn = 'metformin'").orderBy("event_date", "rx_id").collect()]
    assert sorted(kinds) == ["MEDICATION_COMPLETED", "MEDICATION_DOSE_CHANGED", "MEDICATION_DOSE_CHANGED", "MEDICATION_STARTED", "MEDICATION_STARTED"]


def py_confidence(noisy, days, group, cond, rx, prior):
    ratios = {(g, c): r for g, c, r in INF.S.SPECIALITY_RATIOS}
    p = noisy if days <= 180 else prior + (noisy - prior) * math.exp(-0.005 * (days - 180))
    lr = ratios.get((group, cond), ratios.get((group, group), 1.0))
    if lr != 1.0:
        q = min(max(p, 1e-9), 1 - 1e-9)
        p = 1 / (1 + math.exp(-(math.log(q / (1 - q)) + math.log(lr))))
    c = min(1.0, math.log1p(rx) / math.log1p(10))
    return min(max(c * p + (1 - c) * prior, 0), 1)


def test_confidence_formula(spark):
    rng = random.Random(3)
    groups = ["metabolic", "endocrinolog", "cardiovascular", "general", None]
    rows = [(rng.random(), rng.randint(-20, 900), rng.choice(groups), rng.choice(["metabolic", "renal"]), rng.randint(1, 15), rng.random() / 4) for _ in range(300)]
    df = spark.createDataFrame(rows, "n double, d int, g string, c string, rx int, p double")
    got = df.select(INF.confidence(*[F.col(x) for x in ("n", "d", "g", "c", "rx", "p")]).alias("v"), "*").collect()
    assert all(abs(r.v - py_confidence(r.n, r.d, r.g, r.c, r.rx, r.p)) < 6e-5 for r in got)


def test_speciality_gate_and_merge(spark):
    rows = [(1, "carbamazepine", DAY, 30), (2, "carbamazepine", DAY, 30), (3, "levothyroxine", DAY, 30)]
    eps = E.medication_episodes(E.prescription_drugs(lines_frame(spark, rows))).withColumn("doctor_id", F.col("patient_id"))
    doctors = spark.createDataFrame([(1, "Consultant in Neurology"), (2, "General")], "doctor_id long, speciality string")
    inferred = INF.infer_conditions(eps, doctors, dt.date(2024, 2, 1))
    assert {(r.patient_id, r.condition_code) for r in inferred.collect()} <= {(1, "G40"), (3, "E03")}
    stored = spark.createDataFrame([(9, "E11", "n", "g", "confirmed", 0.9), (3, "E03", "n", "g", "rejected", 0.4)], "patient_id long, condition_code string, condition_name string, condition_group string, status string, confidence double")
    new = spark.createDataFrame([(3, "E03", "x", "y", 0.8), (4, "I10", "x", "y", 0.5)], "patient_id long, condition_code string, condition_name string, condition_group string, confidence double")
    got = {r.patient_id: (r.action, r.status, r.confidence) for r in INF.merge_conditions(new, stored).collect()}
    assert got == {9: ("unchanged", "confirmed", 0.9), 3: ("kept", "rejected", 0.4), 4: ("inserted", "probable", 0.5)}
    legacy = {r.patient_id: r.action for r in INF.merge_conditions(new, stored, suppress_rejected=False).collect()}
    assert legacy[3] == "reopened"


def test_resolve_doctors(spark):
    rows = [("MH - 1", "A", None, 1), ("mh1", "B", "Cardiology", 2), ("MH-1", "A", "Neurology", 3), (None, "A", None, 4), ("", None, None, 5), ("--", None, "ENT", 6)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "reg_number string, name string, speciality string, seen_order int, seen_line int")
    got = sorted((r.reg_norm or "", r.name or "", r.speciality_group or "", r.n_mentions, r.n_name_variants) for r in D.resolve_doctors(df).collect())
    assert got == [("", "", "general", 1, 0), ("", "A", "", 1, 1), ("MH1", "A", "cardiovascular", 3, 2)]


def test_resolutions(spark):
    queue = spark.createDataFrame([(i, 5, False, "lab" if i > 5 else "prescription") for i in (1, 2, 3, 6, 7)] + [(4, 5, True, "prescription")], "item_id long, facility_id int, resolved boolean, item_type string")
    feed = spark.createDataFrame([(1, 1, None), (2, 1, " agreed "), (3, None, None), (4, 1, None), (6, 2, ""), (7, 2, "ok")], "item_id long, patient_id long, override_reason string")
    lines = spark.createDataFrame([(1, "Ibuprofen"), (2, "ibuprofen"), (3, "ibuprofen"), (4, "ibuprofen")], "item_id long, inn string")
    active = spark.createDataFrame([(1, "warfarin"), (2, "metformin")], "patient_id long, inn string")
    none = tables.baseline_rules(spark).where("false")
    labs = labs_of(spark, [(2, "CREATININE", 0.9, "mg/dL", None, "normal")])
    got = {r.item_id: (r.has_major, r.outcome, r.audit_action) for r in M.apply_resolutions(feed, lines, queue, active, labs, none).where("item_id < 6").collect()}
    assert got == {1: (True, "rejected", None), 2: (True, "resolved", "override_safety"), 3: (False, "resolved", "resolve_rx")}
    results = spark.createDataFrame([(6, "creatinine", 2.0, "mg/dL", None, "high"), (7, "creatinine", 1.0, "mg/dL", None, "high")], "item_id long, analyte_name string, value double, unit string, ref_range string, flag string")
    lab = {r.item_id: (r.has_critical, r.outcome, r.audit_action) for r in M.apply_lab_resolutions(feed, queue, results, active, labs, none).collect()}
    assert lab == {6: (True, "rejected", None), 7: (False, "resolved", "resolve_lab")}


def test_active_and_upserts(spark):
    rx = spark.createDataFrame([(1, 1, dt.date(2024, 1, 1)), (2, 1, dt.date(2024, 3, 31)), (3, 1, dt.date(2023, 12, 31))], "rx_id long, patient_id long, created_at date")
    med = spark.createDataFrame([(1, "a", 5, True), (2, "b", 5, True), (3, "c", 5, True), (3, "d", None, True), (2, "e", None, False)], "rx_id long, inn string, duration_days int, is_active boolean")
    got = {r.inn for r in MED.active_medications(med, rx, dt.date(2024, 3, 31)).collect()}
    assert got == {"a", "b", "d"}
    events = spark.createDataFrame([(1, "ALLERGY_RECORDED", 1, '{"inn": null, "severity": 1}'), (2, "ALLERGY_RECORDED", 1, "oops"), (3, "OTHER", 1, "{}")], "event_id int, event_type string, payload_schema_version int, payload string")
    assert {(r.event_id, r.n_missing) for r in EV.conformance(events).collect()} == {(1, 1), (2, 3)}


def test_scan_files(spark, tmp_path):
    for n in (2, 1):
        (tmp_path / f"rx_{n}.json").write_text('{\n "ground_truth": "doctor_name: A"\n}')
    rows = readers.scan_annotations(spark, str(tmp_path), limit=1).collect()
    assert [(r.stem, r.ground_truth) for r in rows] == [("rx_1", "doctor_name: A")]
    files = readers.scan_document_files(spark, str(tmp_path)).select("upload_hash").distinct().count()
    assert files == 1


@pytest.mark.parametrize("column", ["severity", "reaction_type"])
def test_audit_values(spark, column):
    df = spark.createDataFrame([(1, "allergy", "mild"), (2, "bad", "bad")], "id int, reaction_type string, severity string")
    allowed = M.E.ALLOWED["reaction_severity" if column == "severity" else "reaction_type"]
    assert [r.key for r in M.outside_values(df, "c", "id", column, allowed).collect()] == ["2"]
