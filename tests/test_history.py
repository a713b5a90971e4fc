"""The stored medication history against one fold of everything, and label mentions against a plain search."""

import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from rxweave.operators import doctors as D
from rxweave.operators import interactions as I
from rxweave.operators.inference import infer_conditions, merge_conditions
from rxweave.plans import processing as PR
from rxweave.plans import stored_history as SH
from tests.test_clinical import DAY

AS_OF = DAY + dt.timedelta(400)
MEDS = ("doc_id long, patient_id long, prescription_date string, needs_review boolean, line_no int, inn string, raw_drug_name string, dosage_value double, dosage_unit string, "
        "frequency string, duration_days int, doctor_id string, patient_note string, bucket int")
DERIVED = ["episodes", "dosage_history", "events"]


def meds(r, n, patients=12):
    """Lines of prescriptions in no order of days, some repeated, under review, without patient, id, date or drug."""
    out = []
    for i in range(n):
        day = (DAY + dt.timedelta(i * 7919 % 400)).strftime("%d/%m/%Y")
        row = (i, r.choice([1, 1, 1, *range(patients)]), r.choice([day] * 9 + [None]), r.random() < 0.1, 0, r.choice(["metformin", "Tramadol ", "unlisted", "salbutamol", ""]),
               "m", r.choice([1.0, 2.0, None]), "mg", "od", r.choice([None, 0, 5, 30, 90]), r.choice(["1", "2", None]), "x", 7)
        out += [row] * r.choice([1, 1, 1, 2])
    out += [(None, 1, None, False, 0, "metformin", "m", 1.0, "mg", "od", 5, "1", "x", 7), (n + 1, None, None, False, 0, "metformin", "m", 1.0, "mg", "od", 5, "1", "x", 7)]
    return out


def doctors(spark):
    return spark.createDataFrame([("1", "Endocrinologist"), ("2", "Physician")], "doctor_id string, speciality string")


def shown(df):
    return sorted(str(sorted(x.asDict(True).items())) for x in df.collect())


def files(path, table):
    return {b: sorted(os.listdir(f"{path}/{table}/{b}")) for b in os.listdir(f"{path}/{table}") if b.startswith("bucket=")}


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_in_any_order_give_one_fold(spark, tmp_path, seed):
    r, out = random.Random(seed), str(tmp_path)
    rows = meds(r, 120)
    r.shuffle(rows)
    parts = [spark.createDataFrame(rows[i:i + 50], MEDS) for i in range(0, len(rows), 50)]
    for part in parts:
        SH.update_stored_history(part, doctors(spark), AS_OF, out, 4)
    whole = spark.createDataFrame([x for x in rows if x[0] is not None], MEDS)
    want = PR.update_history(whole, doctors(spark), AS_OF)
    before = {}
    for t in DERIVED:
        got = SH.read_buckets(spark, f"{out}/{t}")
        before[t] = shown(got)
        assert before[t] == shown(want[t].select(got.columns)), t
    conditions = shown(SH.read_buckets(spark, f"{out}/conditions"))
    SH.update_stored_history(parts[0], doctors(spark), AS_OF, out, 4)  # the same batch again
    assert all(shown(SH.read_buckets(spark, f"{out}/{t}")) == before[t] for t in DERIVED)
    assert shown(SH.read_buckets(spark, f"{out}/conditions")) == conditions


def test_conditions_are_merged_batch_by_batch(spark, tmp_path):
    r, out = random.Random(5), str(tmp_path)
    rows = [x for x in meds(r, 90) if x[0] is not None]
    stored = spark.createDataFrame([(p, "E11", "Diabetes", "endocrine", s, 0.5) for p, s in enumerate(["confirmed", "rejected", "probable", "resolved"] * 4)],
                                   "patient_id long, condition_code string, condition_name string, condition_group string, status string, confidence double")
    SH.store_conditions(stored, out, 4)
    want = {(x.patient_id, x.condition_code): (x.status, x.confidence) for x in stored.collect()}
    for a in range(0, len(rows), 40):
        part, seen = rows[a:a + 40], spark.createDataFrame(rows[:a + 40], MEDS)
        SH.update_stored_history(spark.createDataFrame(part, MEDS), doctors(spark), AS_OF, out, 4)
        touched = {x[1] for x in part if not x[3] and x[1] is not None and x[5].strip()}
        for c in infer_conditions(PR.update_history(seen, doctors(spark), AS_OF)["episodes"], doctors(spark), AS_OF).collect():
            status = want.get((c.patient_id, c.condition_code), (None, None))[0]
            if c.patient_id in touched and status not in ("confirmed", "rejected"):
                want[c.patient_id, c.condition_code] = ("probable", c.confidence)
    assert {(x.patient_id, x.condition_code): (x.status, x.confidence) for x in SH.read_buckets(spark, f"{out}/conditions").collect()} == want


def test_only_touched_buckets_are_written(spark, tmp_path):
    out = str(tmp_path)
    row = lambda doc, patient: (doc, patient, "01/02/2024", False, 0, "metformin", "m", 1.0, "mg", "od", 30, "1", "x", 7)
    SH.update_stored_history(spark.createDataFrame([row(p, p) for p in range(60)], MEDS), doctors(spark), AS_OF, out, 16)
    before = {t: files(out, t) for t in ("drugs", *DERIVED)}
    touched = SH.update_stored_history(spark.createDataFrame([row(100, 3)], MEDS), doctors(spark), AS_OF, out, 16)
    assert len(touched) == 1
    for t, was in before.items():
        now = files(out, t)
        assert {b for b in now if now[b] != was.get(b)} == {f"bucket={touched[0]}"}
    assert SH.update_stored_history(spark.createDataFrame([], MEDS), doctors(spark), AS_OF, out, 16) == []
    assert SH.read_buckets(spark, f"{out}/drugs").count() == 61


def test_doctors_by_number(spark):
    known = spark.createDataFrame([(1, "A", "MH - 10", "General"), (2, "B", None, "General"), (3, "C", "mh10", "General")], "doctor_id long, name string, registration_number string, speciality string")
    rows = spark.createDataFrame([(1, "MH10"), (2, "mh/10"), (3, "MH 11"), (4, "mh11"), (5, ""), (6, None)], "doc_id long, doctor_reg string")
    found = D.with_doctor_ids(rows, known)
    assert {x.doc_id: x.doctor_id for x in found.collect()} == {1: "1", 2: "1", 3: "reg:MH11", 4: "reg:MH11", 5: None, 6: None}
    assert sorted(x.doctor_id for x in D.registered_doctors(found, known).collect()) == ["1", "2", "3", "reg:MH11"]


def test_label_mentions_equal_a_plain_search(spark):
    r = random.Random(3)
    words = ["acid", "beta", "gamma", "iron+zinc", "of", "x"]
    names = sorted({" ".join(r.choices(words, k=r.choice([1, 1, 2, 3]))) for _ in range(40)})
    labels = [(r.choice(names), "".join(r.choice(words).upper() + r.choice([" ", ", ", "-", " (", "acid "]) for _ in range(r.choice([0, 5, 30])))) for _ in range(60)] + [("acid", None), (None, "beta"), ("acid", "")]
    plain = {(a, b) for a, t in labels if a and t for b in names if a < b and f" {b} " in " " + " ".join(re.split("[^a-z0-9+]+", t.lower())) + " "}
    inns = spark.createDataFrame([(n,) for n in [*names, None, " "]], "inn string")
    got = I.label_rules(spark.createDataFrame(labels, "inn string, label_text string"), inns).collect()
    assert {(x.drug_1, x.drug_2) for x in got} == plain and len(got) == len(plain)


def test_a_word_in_every_label_makes_no_pairs(spark):
    n = 300
    labels = spark.range(n).select(F.format_string("acid a%04d", "id").alias("inn"), F.format_string("An acid. See acid a%04d.", F.col("id") + 1).alias("label_text"))
    inns = labels.select("inn")
    rules = I.label_rules(labels, inns)
    assert rules.count() == n - 1
    plan = rules._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_snippet_starts_at_the_whole_name(spark):
    labels = spark.createDataFrame([("alpha", "preacid " + "w " * 400 + "Acid, strong here " + "z" * 600)], "inn string, label_text string")
    found = I.label_rules(labels, spark.createDataFrame([("alpha",), ("lye acid",), ("strong",)], "inn string")).collect()
    assert [x.drug_2 for x in found] == ["strong"] and "Acid, strong here" in found[0].description
