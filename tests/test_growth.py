"""Work that may not grow faster than its input: what is shuffled, written and evaluated once, with the same results."""

import random
import re
from functools import reduce

from pyspark.sql import functions as F

from rxweave import bindings as B
from rxweave.catalog import QUERIES
from rxweave.functions import annotations as A
from rxweave.functions import prescription as P
from rxweave.functions.text import drop, has, regex, strip
from rxweave.operators import episodes as E
from rxweave.operators import evaluation as EV
from rxweave.operators import history as H
from rxweave.plans import extraction as X
from rxweave.refdata import prescribing as R
from tests.test_skew import SF, hot_lines, plan_of


def test_lines_are_dealt_by_range_for_large_days_only(spark):
    """Days up to the limit are ordered in one piece, larger ones in buckets, with the same numbers and doses."""
    lines = hot_lines(spark, 6_000).withColumn("rx_date", F.date_add("rx_date", -F.dayofmonth("rx_date")))
    drugs, days = E.stored_days(E.prescription_drugs(lines))
    assert days.agg(F.max("n_rx")).first()[0] > 20 and days.where("n_rx <= 20").count() > 0
    whole, mixed = E.episode_lines(drugs, days), E.episode_lines(drugs, days, large_day=20)
    assert "_bucket" not in plan_of(whole) and "_bucket" in plan_of(mixed)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(whole) == rows(mixed) and whole.count() == 6_000


def test_history_queries_build_drugs_and_days_once(spark):
    """The final plans read the stored drugs and days, never the lines of the tables again."""
    for name in ("episode_events", "dosage_history", "patient_timeline", "drug_timeline"):
        assert "lineitem" not in plan_of(QUERIES[name](spark, SF)), name


def test_drug_timeline_counts_doses_of_the_episodes(spark):
    drugs, days = E.stored_days(E.prescription_drugs(hot_lines(spark, 3_000)))
    numbered = E.episode_lines(drugs, days).groupBy("patient_id", "inn").agg(F.count("*").alias("dose_rows"))
    found = H.drug_timeline(E.medication_episodes(drugs)).select("patient_id", "inn", "dose_rows")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, numbered.collect()))


def test_documents_are_matched_once(spark):
    """Errors are counted in the pass that matches, and every ratio equals that of its own pair."""
    docs = QUERIES["error_categories"](spark, SF)
    assert plan_of(docs).count("ArrowEvalPython") == 1
    assert plan_of(QUERIES["evaluate_extraction"](spark, SF)).count("ArrowEvalPython") == 0
    rows = [(["a", "ab"], ["ab", "b", ""]), ([], ["x"]), (["x"], []), (["ab", "é"], ["é"]), ([], [])]
    pairs = spark.createDataFrame(rows, "g array<string>, p array<string>").coalesce(1)
    found = [r.t for r in pairs.select(EV.ratio_table("g", "p").alias("t")).collect()]
    assert found == [[[EV.ratio(a, b) for b in p] for a in g] for g, p in rows]


def test_answered_texts_are_not_parsed(spark):
    """The rules read what neither the service nor the model answered; queue items are read in one pass."""
    docs = spark.createDataFrame([(1, "Tab. Metformin 500mg BD"), (2, "Tab. Metformin 500mg BD"), (3, None)], "doc_id long, text string")
    fields = "doc_id long, medications_found int, confidence double, extractor_mode string"
    got = X.choose_extractor(docs, spark.createDataFrame([(1, 4, 0.9, "s")], fields), spark.createDataFrame([(1, 2, 0.7, "m")], fields))
    found = {r.doc_id: (r.medications_found, r.extractor_mode) for r in got.collect()}
    assert found[1] == (4, "s") and found[2] == (1, "tesseract_ner_fallback") and found[3][1] == "tesseract_ner_fallback"
    plan = plan_of(QUERIES["choose_extractor"](spark, SF))
    assert plan.count("Join") <= 2 and "Union" not in plan_of(QUERIES["queue_draft"](spark, SF))
    assert "Join" not in plan_of(QUERIES["queue_draft"](spark, SF))


def test_values_used_several_times_are_computed_once(spark):
    """One frequency text is cleaned once for all phrases, and a line after the first hit is not searched."""
    text = lambda c: c._jc.toString() if hasattr(c, "_jc") else str(c)
    assert text(A.frequency_per_day(F.col("t"))).count("regexp_replace") <= 2
    got = spark.createDataFrame([(["x", "Age: 40", "Age: 50"],), ([],), (None,)], "l array<string>").select(P.first_of(F.col("l"), P.age).alias("a"))
    assert [r.a for r in got.collect()] == ["40 yrs", None, None]


def name_in_turn(line):
    """The name with every pattern applied by itself, without tests of the next letter."""
    bare = lambda p: re.sub(r"\(\?=\[\S*?\]\)", "", p)
    name = F.when(has(line, R.NUMBERED_PATTERN), strip(drop(line, R.NUMBERED_PATTERN))).otherwise(line)
    patterns = [R.FORM_PATTERN, R.DOSAGE_PATTERN] + [p for p, *_ in R.FREQUENCIES + R.DURATIONS] + [R.ROUTE_PATTERN]
    name = strip(drop(strip(reduce(drop, map(bare, patterns), name)), r"\s+\d+(\.\d+)?\s*$"))
    name = drop(drop(name, "^" + P.EDGE_NOISE), P.EDGE_NOISE + "$")
    name = strip(F.element_at(F.split(name, regex(r"\s{2,}|/|\+")), 1))
    return P.bind(name, lambda n: F.when((F.length(n) >= 3) & ~has(n, r"(?i)^\d+(\.\d+)?\s*(mg|ml|mcg|g|iu)?$"), n))


def test_lines_are_read_in_one_pass(spark):
    """Ordinary lines take one pass for all frequencies and one for all durations, and every line gives the name it gives pattern by pattern."""
    line = F.col("line")
    fixed = B.medication_texts(spark, SF).select(P.fix_ocr_digits(line).alias("line"))
    assert fixed.where(~P._parts_apart(line)).count() == 0
    text = lambda c: c._jc.toString() if hasattr(c, "_jc") else str(c)
    assert text(P._name_at_once(line)).count("regexp_replace") <= 4
    hard = ["10-0-1-1-1", "01-0-1-0-1 xyz", "on5%ce daily", "iv5 days", "abc 5 bd days", "eye bd drops", "7 5 days weeks", "abc 5 weeks 5 days", " 500 ", "abc 5 iv days",
            "at qds bedtime", "four bd times daily", "once5mg daily", "Zinc \u017fos", "abc 5 mg\tod\t7", "1. tab ", "a morning and night bd", "abc bd\n", "ab /cd", ""]
    assert all(R.DURATION_WORDS[k] in p for k, (p, _) in enumerate(R.DURATIONS))
    words = [x for w, s, _, _ in R.FREQUENCY_WORDS for p in (w, s) if p for x in re.findall(r"[a-z]{2,}", p)] + list(R.UNITS) + list(R.ROUTES) + (
        "days day weeks month 5 2.5 500 1-0-1 0-0-1 1-1-1 - . , ( / + : Tab. 1. Sugarlow Metformin Insulbest \u00e9 \u00a0 x").split(" ")
    r = random.Random(3)
    drawn = ["".join(r.choice(words) + r.choice(["", " ", " ", " ", " ", "  ", "\t"]) for _ in range(r.randint(1, 8))) for _ in range(20_000)]
    rows = spark.createDataFrame([(t,) for t in hard + drawn + [None]], "line string").repartition(8)
    found = rows.select(line, P._parts_apart(line).alias("apart"), P.drug_name(line).alias("name"), name_in_turn(line).alias("plain"))
    assert found.where("NOT (name <=> plain)").collect() == []
    assert found.where("apart AND name IS NOT NULL").count() > 3_000 and found.where("NOT apart AND name IS NOT NULL").count() > 3_000
    misread = spark.createDataFrame([(t,) for t in ["Z00 l0 I5", "5O0", "aZ1 x", "zl1 1O1O1", "O5", "plain", None]], "line string")
    want = reduce(lambda c, fix: F.regexp_replace(c, *fix), R.DIGIT_FIXES, line)
    assert misread.where(~P.fix_ocr_digits(line).eqNullSafe(want)).collect() == []
