"""Prescription, lab and annotation texts line by line."""

import pytest
from pyspark.sql import functions as F

from rxweave.functions import annotations as A
from rxweave.functions import names as N
from rxweave.functions import payloads as J
from rxweave.functions import prescription as P
from rxweave.plans import extraction as X


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *[c(F.col("t")).alias(str(k)) for k, c in enumerate(columns)]).orderBy("i").collect()]


FREQUENCIES = [
    ("BD", 2), ("BID", 2), ("1-0-1", 2), ("twice daily", 2), ("morning and night", 2), ("OD", 1), ("QD", 1), ("once a day", 1),
    ("TDS", 3), ("TID", 3), ("1-1-1", 3), ("three times daily", 3), ("morning afternoon night", 3), ("QDS", 4), ("QID", 4), ("1-1-1-1", 4),
    ("HS", 1), ("0-0-1", 1), ("1–0–0", 1), ("at bedtime", 1), ("SOS", 0), ("PRN", 0), ("STAT", 0), ("as needed", 0), ("AC", 3), ("PC", 3),
    ("before meals", 3), ("every night", 1), ("OM", 1), ("nothing here", None), ("é on", 1), ("éon", None)]


def test_frequencies(spark):
    got = values(spark, [t for t, _ in FREQUENCIES], P.frequency_rate)
    assert [g[0] for g in got] == [n for _, n in FREQUENCIES]


LINES = [
    ("Tab. Metformin 500mg BD", True), ("1. Ibuprofen 400mg TDS", True), ("Syp. Amoxicillin 250ml BD", True), ("Glycomet 500 BD", True),
    ("Prednisone", True), ("Diagnosis: Fever", False), ("Tel: 98765", False), ("Age: 45 yrs", False), ("2 Tast conducted", False), ("ab 5", False), ("", False), ("Dr. Sharma", False)]


def test_medication_lines(spark):
    got = values(spark, [t for t, _ in LINES], P.is_medication_line)
    assert [g[0] for g in got] == [n for _, n in LINES]


@pytest.mark.parametrize("line,name,dose,unit,days,route", [
    ("Glycomet 500 BD", "Glycomet", 500.0, "mg", None, "oral"),
    ("Tab. Dolo Z00 my BD x 5 days", "Dolo", 200.0, "mg", 5, "oral"),
    ("Inj. Lantus l0 units SC HS for 2 weeks", "Lantus", 10.0, "units", 14, "sc"),
    ("2) Ciplox 5O0mg BD 1 month", "Ciplox", 500.0, "mg", 30, "oral"),
    ("Moxi eye drops 3 drops TID", "Moxi", 3.0, "drops", None, "ophthalmic"),
    ("Augmentin/Clavam 625mg", "Augmentin", 625.0, "mg", None, "oral")])
def test_one_line(spark, line, name, dose, unit, days, route):
    (row,), = values(spark, [line], P.medication)
    assert (row["raw_drug_name"], row["dosage_value"], row["dosage_unit"], row["duration_days"], row["route"]) == (name, dose, unit, days, route)


def test_document(spark):
    text = "City\nReg. MH12345 Age: 99 yrs\nPatient 45 yrs\r\nDate: 01/02/2024\nDx: Fever\nTab. Metformin 500mg BD\nName: X 5mg\nGlycomet 500 BD"
    docs = spark.createDataFrame([(1, text), (2, "@@ ## 12\n,,"), (3, "Name: A\nAge: 30\nDate: 1/1/2020\nHospital")], "doc_id int, text string")
    rows = {r.doc_id: r for r in X.extract_prescriptions(docs).collect()}
    one = rows[1]
    assert (one.doctor_reg, one.patient_age, one.prescription_date, one.diagnosis) == ("MH12345", "45 yrs", "01/02/2024", "Fever")
    assert [m.raw_drug_name for m in one.medications] == ["Metformin", "Glycomet"] and one.confidence == 1.0
    assert rows[2].medications == [] and rows[2].confidence == 0.0
    assert rows[3].medications == [] and rows[3].confidence < 0.5


def test_lab_report(spark):
    text = "SRL Diagnostics\nDate of birth\nReport Date: 05-Jan-2024\nSerum Creatinine 1.8 mg/dL (0.6 - 1.2)\nGlycated Hemoglobin 7.2 % < 5.7\nHemoglobin 8.5\nTSH 0.15 0.4-4.5\nMCHC 33\nNeutrophils none"
    docs = spark.createDataFrame([(1, text), (2, "Sample 01/02/2024\nno values")], "doc_id int, text string")
    rows = {r.doc_id: r for r in X.extract_labs(docs).collect()}
    found = {x.analyte_name: (x.value, x.flag) for x in rows[1].results}
    # the glycated line also names hemoglobin and comes first
    assert found == {"HBA1C": (7.2, "high"), "CREATININE": (1.8, "high"), "HEMOGLOBIN": (7.2, "low"), "TSH": (0.15, "low"), "MCHC": (33.0, "normal")}
    assert (rows[1].lab_name, rows[1].report_date, rows[1].confidence) == ("Srl Diagnostics", "05-Jan-2024", 1.0)
    assert (rows[2].report_date, rows[2].confidence) == ("01/02/2024", 0.5)


def test_dates(spark):
    cases = {"1/5/2025": "2025-05-01", "01-02-2024": "2024-02-01", "2024-03-04": "2024-03-04", "1/5/25": "2025-05-01", "March 18, 2014": "2014-03-18",
             "18 march 2014": "2014-03-18", "05-jan-2024": "2024-01-05", "31/31/2020": None, "soon": None}
    got = values(spark, list(cases), lambda c: N.parse_date(c).cast("string"))
    assert [g[0] for g in got] == list(cases.values())


def test_names(spark):
    assert values(spark, ["Tab. Glycomet SR 500mg daily", " CROCIN ", "Inj Lantus"], N.clean_name) == [("glycomet sr",), ("crocin",), ("lantus",)]
    assert values(spark, ["MH - 12345", "Reg. No. 12", " - ", "mh12345"], N.normalize_registration) == [("MH12345",), ("REGNO12",), (None,), ("MH12345",)]
    assert values(spark, ["Consultant Cardiologist", "Neuro", "Dentist", "", "Internal Medicine"], N.speciality_group) == [
        ("cardiovascular",), ("neurological",), ("general",), (None,), ("general",)]


def test_annotation(spark):
    text = ("<s_ocr> doctor_name: Dr. B (MCI: AB-12) clinic_name: Care patient_name: - Eve patient_age: 40 date: 2024-01-02 "
            "medications: - with food - Atenolol 25 mg - As needed - After meals - Aspirin 50 mg twice daily - Vitamin signature: X </s>")
    (r,), = values(spark, [text], A.annotation_record)
    assert (r.doctor_reg, r.patient_name, r.clinic_name, r.diagnosis) == ("AB-12", "Eve", "Care", None)
    meds = [(m.drug_name, m.dosage_value, m.frequency, m.freq_per_day) for m in r.medications]
    assert meds == [("with food", None, None, None), ("Atenolol", 25.0, "After meals", None), ("Aspirin", 50.0, "twice daily", 2), ("Vitamin", None, None, None)]


def test_payloads(spark):
    raw = ['```JSON\n{"medications": [{"el": {"drug_name": "A", "dosage_value": "5"}}, 7]}\n```', "[1", '{"medications": null}', '{"diagnosis": "x"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "doc_id int, raw string")
    kept = {r.doc_id: r.record for r in X.model_records(df).collect()}
    assert sorted(kept) == [0, 3]
    assert kept[0].medications[0].raw_drug_name == "A" and kept[0].medications[0].dosage_value == 5.0 and kept[0].confidence == 0.75
    (lab,), = values(spark, ['{"results": [{"value": "1.5", "flag": "LOW"}, {"value": null}, {"value": "n/a"}, {"test_name": "z"}]}'], J.normalize_lab_json)
    assert [(x.value, x.flag, x.analyte_name) for x in lab.results] == [(1.5, "low", "OTHER"), (0.0, "normal", "OTHER")]


def test_whole_text_is_read(spark):
    """A medication after very many lines is found."""
    text = "\n".join(["some words here"] * 20000 + ["Tab. Metformin 500mg BD"])
    rows = X.extract_prescriptions(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    assert [m.raw_drug_name for m in rows[0].medications] == ["Metformin"]
