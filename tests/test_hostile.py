"""No text may end an extraction job."""

import random

from pyspark.sql import functions as F

from rxweave.functions import labs as L
from rxweave.functions import prescription as P
from rxweave.operators import episodes as E
from rxweave.operators import interactions as I
from rxweave.plans import extraction as X

PARTS = ["x 80000000 months", "99999999999999999999 days", "HbA1c १२ %", "HbA1c 12 %", "Tab Metformin ५०० mg", "1-0-1", "twice daily", "31/31/9999", "Creatinine", "٣٫٥", "TSH", "½", "²",
         "mg", "\x00", " ", "é", "😀", "(((", "[", "\\", "$1", "Date: 00/00/0000", "Reg No", "- - -", "for 2000000000 days", "Rx", "1.2.3.4", "9" * 400, "Hb 1e999"]


def lines(n):
    r = random.Random(11)
    return ["".join(r.choice(PARTS) + r.choice([" ", "\n", ""]) for _ in range(r.randint(1, 12))) for _ in range(n)]


def test_hostile_texts(spark):
    docs = spark.createDataFrame([(i, i % 9, t) for i, t in enumerate(lines(300))] + [(1000, None, None), (1001, 1, "")], "doc_id long, patient_id long, text string")
    assert X.extract_prescriptions(docs).count() == 302
    X.extract_prescriptions(docs).write.format("noop").mode("overwrite").save()
    X.extract_labs(docs).write.format("noop").mode("overwrite").save()


def test_digits_of_other_scripts_and_absurd_durations(spark):
    row = spark.range(1).select(
        L.lab_value(F.lit("HbA1c १२ %")).alias("lab"), P.dosage_value(F.lit("Tab Metformin ५०० mg")).alias("dose"), P.duration_days(F.lit("x 80000000 months")).alias("long"),
        P.duration_days(F.lit("for 3 weeks")).alias("weeks"), P.duration_days(F.lit("99999999999999999999 days")).alias("huge")).first()
    assert tuple(row) == (12.0, 500.0, None, 21, None)


def test_hot_day_with_one_id_prefix(spark):
    """All ids begin alike; the buckets take their bounds from the data."""
    day = spark.range(0, 40_000, 2).select(
        F.lit(1).cast("long").alias("patient_id"), F.lit("metformin").alias("inn"), F.format_string("RX-%09d", "id").alias("rx_id"), F.to_date(F.lit("2020-01-01")).alias("rx_date"), F.lit(1).alias("line_no"),
        F.lit(1.0).alias("dosage_value"), F.lit("mg").alias("dosage_unit"), F.lit("od").alias("frequency"), F.lit(30).alias("duration_days"), F.lit(1).cast("long").alias("doctor_id"), F.lit("m").alias("raw_drug_name"))
    drugs = E.prescription_drugs(day)
    rows = E.episode_lines(drugs, E.episode_days(drugs))
    found = rows.agg(F.count("*"), F.countDistinct("refill_number"), F.max("refill_number"), F.count_if(F.col("previous_dose.dosage_value").isNull())).first()
    assert tuple(found) == (20_000, 20_000, 20_000, 1)
    first = rows.orderBy("rx_id").limit(2).select("refill_number").collect()
    assert [r.refill_number for r in first] == [1, 2]


def test_long_labels(spark):
    text = " ".join(f"word{i}" for i in range(20_000)) + " Avoid with Zolpidem now " + "x" * 2_000
    labels = spark.createDataFrame([("abciximab", text)], "inn string, label_text string")
    inns = spark.createDataFrame([("abciximab",), ("zolpidem",), ("word7 plus",)], "inn string")
    rules = I.label_rules(labels, inns).collect()
    assert [(r.drug_1, r.drug_2) for r in rules] == [("abciximab", "zolpidem")]
    assert "Avoid with Zolpidem now" in rules[0].description and len(rules[0].description) == 500


def test_results_are_removed_at_the_end(spark, tmp_path, monkeypatch):
    from rxweave import session as S

    monkeypatch.setattr(S, "CHECKPOINT_CONF", "rxweave.test.folder")
    spark.conf.set(S.CHECKPOINT_CONF, str(tmp_path))
    assert S.cut_lineage(spark, spark.range(3), "x").count() == 3 and list(tmp_path.iterdir())
    S.remove_results(spark)
    assert not list(tmp_path.iterdir())
