"""Plans and results when one patient holds a third of all rows."""

import datetime as dt

from pyspark.sql import functions as F

from rxweave.catalog import QUERIES
from rxweave.operators import episodes as E
from rxweave.operators import medications as MED

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_rows_are_cut_before_the_shuffle(spark):
    plan = plan_of(QUERIES["recent_rx_50"](spark, SF))
    assert plan.count("WindowGroupLimit") == 2


def test_scans_read_only_what_they_need(spark):
    plan = plan_of(QUERIES["active_medications"](spark, SF))
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan


def hot_lines(spark, n):
    """Three patients; the first has a third of the rows, all of one drug."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 == 0, 0).otherwise(i % 1000 + 1).cast("long").alias("patient_id"), F.lit("metformin").alias("inn"), i.alias("rx_id"),
        F.date_add(F.lit(dt.date(2020, 1, 1)), (i % 1500).cast("int")).alias("rx_date"), F.lit(1).alias("line_no"), (i % 5).cast("double").alias("dosage_value"),
        F.lit("mg").alias("dosage_unit"), F.lit("od").alias("frequency"), F.when(i % 2 == 0, 30).alias("duration_days"), (i % 7).alias("doctor_id"), F.lit("m").alias("raw_drug_name"))


def test_episodes_of_a_hot_patient(spark):
    drugs = E.prescription_drugs(hot_lines(spark, 300_000))
    days = E.episode_days(drugs)
    assert days.groupBy("patient_id", "inn").count().agg(F.max("count")).first()[0] <= 1500
    assert E.scheduled_episodes(days).agg(F.sum("prescription_count")).first()[0] == 300_000
    last = E.episode_lines(drugs.where("patient_id = 0"), days.where("patient_id = 0")).agg(F.count("*"), F.max("refill_number")).first()
    assert tuple(last) == (100_000, 100_000)


def test_history_of_a_hot_patient(spark):
    rx = hot_lines(spark, 300_000).select("rx_id", "patient_id", F.col("rx_date").alias("created_at"))
    recent = MED.recent_prescriptions(rx, 50)
    assert recent.groupBy("patient_id").count().agg(F.max("count")).first()[0] == 50


def test_numbering_of_a_hot_day(spark):
    """One patient, drug and day with very many prescriptions: buckets of ids
    are numbered as one sequence, for numeric and for text ids."""
    i = F.col("id")
    for rx_id in (i * 1000, F.lpad(F.conv(i.cast("string"), 10, 16), 6, "0")):
        lines = hot_lines(spark, 30_000).withColumn("rx_id", F.lit(0)).select(
            F.lit(1).cast("long").alias("patient_id"), "inn", "rx_date", "line_no", "dosage_unit", "frequency", "duration_days", "doctor_id", "raw_drug_name").limit(1)
        day = spark.range(0, 60_000, 2).withColumn("rx_id", rx_id).crossJoin(lines).drop("id").withColumn("dosage_value", F.lit(1.0))
        drugs = E.prescription_drugs(day)
        rows = E.episode_lines(drugs, E.episode_days(drugs))
        found = rows.agg(F.count("*"), F.countDistinct("refill_number"), F.max("refill_number"), F.count_if(F.col("previous_dose.dosage_value").isNull())).first()
        assert tuple(found) == (30_000, 30_000, 30_000, 1)
        ordered = rows.orderBy("rx_id").limit(2).select("refill_number").collect()
        assert [r.refill_number for r in ordered] == [1, 2]
