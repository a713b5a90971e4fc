"""Queries over prescription, lab and annotation texts, payloads and names.

The check SQL does not parse any text: the bound texts are composed from table
columns, so the expected values follow from those columns directly.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from rxweave import bindings as B
from rxweave.catalog.base import query
from rxweave.catalog.core import keyed_alerts, latest, rule_table
from rxweave.catalog.sqlbind import at, items, sql
from rxweave.functions import annotations as A
from rxweave.functions import labs as L
from rxweave.functions import names as N
from rxweave.functions import payloads as J
from rxweave.functions import prescription as P
from rxweave.functions.similarity import sequence_ratio
from rxweave.operators import brands as BR
from rxweave.operators import review as R
from rxweave.plans import extraction as X
from rxweave.plans import processing as PR
from rxweave.refdata import tables
from rxweave.session import dealt

# --- one line at a time ---------------------------------------------------------

_BRAND = at(B.BRANDS, "l_partkey")
_QTY = "CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)"
TEXTS = {
    "texts": f"""SELECT l_orderkey AS rx_id, l_linenumber AS line_no, {_BRAND} AS brand, l_quantity AS qty, {_QTY} AS q FROM lineitem""",
}


def by_line(*values) -> str:
    """CASE over the seven line styles."""
    return "CASE line_no " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values, 1) if v is not None) + " END"


def lines(spark, sf):
    return dealt(B.medication_texts(spark, sf).select("rx_id", "line_no", "line"))


def fixed(spark, sf):
    return lines(spark, sf).withColumn("line", P.fix_ocr_digits(F.col("line")))


@query("fix_ocr_digits", sql("SELECT rx_id, line_no, " + by_line(
    "'Tab. ' || brand || ' ' || q || 'mg BD x 5 days'", "brand || ' ' || q || ' TDS'", "'Syp. ' || brand || ' ' || q || ' ml HS for 2 weeks'", "'1. ' || brand || ' 500 mg OD'",
    "'Inj. ' || brand || ' ' || q || ' mcg IV stat'", "'Patient name: ' || brand", "brand || ' 200 my SOS x 1 month'") + " AS line FROM texts", **TEXTS))
def fix_ocr_digits(spark, sf):
    return fixed(spark, sf)


@query("is_medication_line", sql("SELECT rx_id, line_no, line_no <> 6 AS is_medication FROM texts", **TEXTS))
def is_medication_line(spark, sf):
    return lines(spark, sf).select("rx_id", "line_no", P.is_medication_line(F.col("line")).alias("is_medication"))


@query("extract_drug_name", sql("SELECT rx_id, line_no, CASE WHEN line_no = 6 THEN 'Patient name: ' || brand ELSE brand END AS drug_name FROM texts", **TEXTS))
def extract_drug_name(spark, sf):
    return fixed(spark, sf).select("rx_id", "line_no", P.drug_name(F.col("line")).alias("drug_name"))


_VALUE = by_line("qty", "qty", "qty", "500.0::DOUBLE", "qty", None, "200.0::DOUBLE")
_UNIT = by_line("'mg'", "'mg'", "'ml'", "'mg'", "'mcg'", None, "'mg'")
_FREQ = by_line("'twice daily'", "'three times daily'", "'at bedtime'", "'once daily'", "'immediately'", None, "'as needed'")
_RATE = by_line("2", "3", "1", "1", "0", None, "0")
_DAYS = by_line("5", None, "14", None, None, None, "30")
_ROUTE = "CASE WHEN line_no = 5 THEN 'iv' ELSE 'oral' END"


@query("extract_dosage", sql(f"SELECT rx_id, line_no, {_VALUE} AS dosage_value, {_UNIT} AS dosage_unit FROM texts", **TEXTS))
def extract_dosage(spark, sf):
    line = F.col("line")
    return fixed(spark, sf).select("rx_id", "line_no", P.dosage_value(line).alias("dosage_value"), P.dosage_unit(line).alias("dosage_unit"))


@query("extract_frequency", sql(f"SELECT rx_id, line_no, {_FREQ} AS frequency, {_RATE} AS freq_per_day FROM texts", **TEXTS))
def extract_frequency(spark, sf):
    line = F.col("line")
    return lines(spark, sf).select("rx_id", "line_no", P.frequency_text(line).alias("frequency"), P.frequency_rate(line).alias("freq_per_day"))


@query("extract_duration", sql(f"SELECT rx_id, line_no, {_DAYS} AS duration_days FROM texts", **TEXTS))
def extract_duration(spark, sf):
    return lines(spark, sf).select("rx_id", "line_no", P.duration_days(F.col("line")).alias("duration_days"))


@query("extract_route", sql(f"SELECT rx_id, line_no, {_ROUTE} AS route FROM texts", **TEXTS))
def extract_route(spark, sf):
    return lines(spark, sf).select("rx_id", "line_no", P.route(F.col("line")).alias("route"))


@query("parse_medication_line", sql(f"SELECT rx_id, line_no, brand AS raw_drug_name, {_VALUE} AS dosage_value, {_UNIT} AS dosage_unit, {_FREQ} AS frequency, {_RATE} AS freq_per_day, {_DAYS} AS duration_days, {_ROUTE} AS route FROM texts WHERE line_no <> 6", **TEXTS))
def parse_medication_line(spark, sf):
    return X.parse_lines(lines(spark, sf), "rx_id", "line_no")


@query("explode_lines", "SELECT doc_id, count(*) AS n_lines, CAST(sum(length(trim(line))) AS BIGINT) AS n_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY doc_id")
def explode_lines(spark, sf):
    """Non-blank lines of the raw documents."""
    rows = B.read(spark, sf, "documents").select("doc_id", F.explode(L.report_lines(F.col("text"))).alias("line"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


# --- prescription documents --------------------------------------------------------

_RX = f"""SELECT o_orderkey AS doc_id, o_custkey AS patient_id, o_orderkey AS k, CASE WHEN o_orderkey % 5 <> 0 THEN 'MH' || (10000 + o_custkey) END AS doctor_reg,
    CASE WHEN o_orderkey % 4 <> 0 THEN (20 + o_custkey % 60) || ' yrs' END AS patient_age, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS prescription_date,
    CASE WHEN o_orderstatus = 'F' THEN 'Fever' END AS diagnosis, CAST(o_orderkey % 3 <> 0 AS INTEGER) AS m1, CAST(o_orderkey % 6 < 2 AS INTEGER) AS m2,
    {at(B.BRANDS, 'o_orderkey')} AS brand1, {at(B.BRANDS, 'o_orderkey + 1')} AS brand2, CAST(o_orderkey % 40 + 10 AS DOUBLE) AS dose, CAST(o_orderdate AS DATE) AS written FROM orders"""
_RXC = """SELECT *, round(greatest(0, least(1, CASE WHEN m1 + m2 > 0 THEN 0.4 ELSE -0.3 END + CASE WHEN doctor_reg IS NULL THEN 0 ELSE 0.2 END + CASE WHEN diagnosis IS NULL THEN 0 ELSE 0.2 END
    + CASE WHEN prescription_date IS NULL THEN 0 ELSE 0.1 END + CASE WHEN patient_age IS NULL THEN 0 ELSE 0.1 END)), 4)::DOUBLE AS confidence FROM rx_texts"""
DOCS = dict(rx_texts=_RX, rx_scored=_RXC)

# the extracted lines with their documents' fields
DOC_DRUG_COLUMNS = f"""SELECT *, 0 AS line_no, {at(B.CATALOG, 'k')} AS inn, brand1 AS raw_drug_name, 'twice daily' AS frequency, 5 AS duration_days FROM rx_scored WHERE m1 = 1
    UNION ALL SELECT *, m1, {at(B.CATALOG, 'k + 1')}, brand2, 'three times daily', NULL FROM rx_scored WHERE m2 = 1"""


def extracted(spark, sf):
    return X.extract_prescriptions(dealt(B.rx_documents(spark, sf)))


@query("header_fields", sql("SELECT doc_id, doctor_reg, patient_age, prescription_date, diagnosis FROM rx_texts", **DOCS))
def header_fields(spark, sf):
    return extracted(spark, sf).select("doc_id", *X.HEADER)


@query("rx_confidence", sql("SELECT doc_id, m1 + m2 AS n_meds, confidence FROM rx_scored", **DOCS))
def rx_confidence(spark, sf):
    return extracted(spark, sf).select("doc_id", F.size("medications").alias("n_meds"), "confidence")


@query("extract_prescriptions", sql("""SELECT doc_id, 0 AS line_no, brand1 AS raw_drug_name, dose AS dosage_value, 'mg' AS dosage_unit, 'twice daily' AS frequency, 5 AS duration_days, confidence FROM rx_scored WHERE m1 = 1
    UNION ALL SELECT doc_id, m1, brand2, dose, 'mg', 'three times daily', NULL, confidence FROM rx_scored WHERE m2 = 1""", **DOCS))
def extract_prescriptions(spark, sf):
    rows = X.medication_rows(extracted(spark, sf), "doc_id", "confidence")
    return rows.select("doc_id", "line_no", "raw_drug_name", "dosage_value", "dosage_unit", "frequency", "duration_days", "confidence")


# --- lab documents ---------------------------------------------------------------------

_LAB = """SELECT event_id AS doc_id, user_id AS patient_id, CASE event_id % 3 WHEN 0 THEN 'Thyrocare' WHEN 1 THEN 'Srl Diagnostics' ELSE 'Unknown Diagnostics' END AS lab_name,
    CASE WHEN event_id % 4 <> 0 THEN strftime(ts, '%d/%m/%Y') END AS report_date, event_id % 3 <> 0 AS r1, event_id % 5 = 0 AS r2,
    CAST(((c % 20) || '.' || (c % 9 + 1)) AS DOUBLE) AS v FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events)"""
_LABC = "SELECT *, CAST(r1 AS INTEGER) + CAST(r2 AS INTEGER) AS n, round(1 - CASE WHEN report_date IS NULL THEN 0.15 ELSE 0 END - CASE WHEN r1 OR r2 THEN 0 ELSE 0.5 END, 4)::DOUBLE AS confidence FROM lab_texts"
LABS = dict(lab_texts=_LAB, lab_scored=_LABC)


def lab_extracted(spark, sf):
    return X.extract_labs(dealt(B.lab_documents(spark, sf)))


@query("lab_name", sql("SELECT doc_id, lab_name FROM lab_texts", **LABS))
def lab_name(spark, sf):
    return lab_extracted(spark, sf).select("doc_id", "lab_name")


@query("lab_date", sql("SELECT doc_id, report_date FROM lab_texts", **LABS))
def lab_date(spark, sf):
    return lab_extracted(spark, sf).select("doc_id", "report_date")


_LAB_ROWS = """SELECT doc_id, 'HBA1C' AS analyte_name, v AS value, CASE WHEN v >= 5.7 THEN 'high' ELSE 'normal' END AS flag FROM lab_texts WHERE r1
    UNION ALL SELECT doc_id, 'CREATININE', v, CASE WHEN v > 1.3 THEN 'high' WHEN v < 0.5 THEN 'low' ELSE 'normal' END FROM lab_texts WHERE r2"""


@query("lab_value", sql("SELECT doc_id, analyte_name, value FROM lab_found", **LABS, lab_found=_LAB_ROWS))
def lab_value(spark, sf):
    return X.lab_rows(lab_extracted(spark, sf), "doc_id").select("doc_id", "analyte_name", "value")


@query("lab_flag", sql("SELECT result_id, analyte_name, value, flag FROM lab_results"))
def lab_flag(spark, sf):
    return B.lab_results(spark, sf).select("result_id", "analyte_name", "value", "flag")


@query("lab_confidence", sql("SELECT doc_id, n AS n_results, confidence FROM lab_scored", **LABS))
def lab_confidence(spark, sf):
    return lab_extracted(spark, sf).select("doc_id", "n_results", "confidence")


@query("extract_labs", sql("SELECT f.doc_id, s.lab_name, s.report_date, f.analyte_name, f.value, f.flag, s.confidence FROM lab_found f JOIN lab_scored s ON s.doc_id = f.doc_id", **LABS, lab_found=_LAB_ROWS))
def extract_labs(spark, sf):
    rows = X.lab_rows(lab_extracted(spark, sf), "doc_id", "lab_name", "report_date", "confidence")
    return rows.select("doc_id", "lab_name", "report_date", "analyte_name", "value", "flag", "confidence")


@query("route_lab", sql("""SELECT doc_id, confidence < 0.5 AS needs_review, CASE WHEN confidence < 0.5 THEN CASE WHEN report_date IS NULL THEN 'Missing report date.' WHEN n = 0 THEN 'No analytes detected.' ELSE 'Lab report confidence below threshold.' END END AS reason FROM lab_scored""", **LABS))
def route_lab(spark, sf):
    return R.route_lab(lab_extracted(spark, sf)).select("doc_id", "needs_review", "reason")


# --- dates and names ---------------------------------------------------------------------

@query("parse_date_multi", "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 7 <> 6 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS parsed FROM orders")
def parse_date_multi(spark, sf):
    key, when = F.col("o_orderkey"), F.col("o_orderdate")
    formats = ["d/M/yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "MMMM d, yyyy", "d MMM yyyy", "dd-MMM-yyyy"]
    written = F.lit("soon")
    for i, f in enumerate(formats):
        written = F.when(key % 7 == i, F.date_format(when, f)).otherwise(written)
    return B.read(spark, sf, "orders").select(key.alias("doc_id"), N.parse_date(F.lower(written)).cast("string").alias("parsed"))


_NAMES = """SELECT p_partkey AS name_id, lower(p_name) AS brand, CASE p_partkey % 5 WHEN 0 THEN lower(p_name) WHEN 1 THEN lower(substr(p_name, 1, 3) || substr(p_name, 5)) WHEN 2 THEN lower(p_name)
    WHEN 3 THEN 'unlisted' || (p_partkey % 7) ELSE lower(p_name) || 'x' END AS name FROM part"""


@query("clean_name", sql("SELECT name_id, name FROM written", written=_NAMES))
def clean_name(spark, sf):
    return B.written_names(spark, sf).select("name_id", N.clean_name(F.col("raw_drug_name")).alias("name"))


def distinct_names(spark, sf):
    return B.written_names(spark, sf).select(N.clean_name(F.col("raw_drug_name")).alias("name")).distinct()


@query("brand_exact", sql("SELECT DISTINCT n.name, b.inn FROM written n JOIN brands b ON b.brand_name = n.name", written=_NAMES))
def brand_exact(spark, sf):
    return BR.exact_lookup(distinct_names(spark, sf), B.brand_dictionary(spark, sf))


# the best brand by edits alone; the bound misspellings are one edit away from
# their own brand, which is far above the ratio cut-off
_FUZZY = """SELECT name, brand_name, edits, inn FROM (SELECT DISTINCT n.name, b.brand_name, levenshtein(n.name, b.brand_name) AS edits, b.inn,
    row_number() OVER (PARTITION BY n.name ORDER BY levenshtein(n.name, b.brand_name)) AS rn FROM (SELECT DISTINCT name FROM written) n JOIN brands b ON levenshtein(n.name, b.brand_name) <= 2
    WHERE n.name NOT IN (SELECT brand_name FROM brands)) WHERE rn = 1"""


@query("brand_fuzzy", sql("SELECT name, brand_name, edits, inn FROM fuzzy", written=_NAMES, fuzzy=_FUZZY))
def brand_fuzzy(spark, sf):
    brands = B.brand_dictionary(spark, sf)
    rest = distinct_names(spark, sf).join(brands.select(F.col("brand_name").alias("name")), "name", "left_anti")
    return BR.fuzzy_lookup(rest, brands)


@query("fuzzy_top3")
def fuzzy_top3(spark, sf):
    return BR.fuzzy_top(distinct_names(spark, sf), B.brand_dictionary(spark, sf))


@query("normalize_drugs", sql("SELECT n.name_id, coalesce(b.inn, f.inn, n.name) AS inn FROM written n LEFT JOIN brands b ON b.brand_name = n.name LEFT JOIN fuzzy f ON f.name = n.name", written=_NAMES, fuzzy=_FUZZY))
def normalize_drugs(spark, sf):
    return BR.normalize_drugs(B.written_names(spark, sf), B.brand_dictionary(spark, sf)).select("name_id", "inn")


@query("concept_enrich", sql(f"SELECT rx_id, line_no, m.inn, CASE WHEN k % 3 <> 0 THEN CAST(1000 + k AS VARCHAR) END AS concept_id, CASE WHEN k % 3 <> 0 THEN upper(m.inn) ELSE m.inn END AS standard_name FROM medications m JOIN (SELECT unnest({items(B.CATALOG)}) AS inn, unnest(range({len(B.CATALOG)})) AS k) c ON c.inn = m.inn"))
def concept_enrich(spark, sf):
    """Concept snapshot for two thirds of the drugs that occur in the lines."""
    used = B.medication_lines(spark, sf).select("inn").distinct()
    number = F.array_position(F.array(*[F.lit(c) for c in B.CATALOG]), F.col("inn")) - 1
    concepts = used.withColumn("k", number).where("k % 3 <> 0").select("inn", (F.col("k") + 1000).cast("string").alias("concept_id"), F.upper("inn").alias("standard_name"))
    return BR.concept_enrich(B.medication_lines(spark, sf), concepts).select("rx_id", "line_no", "inn", "concept_id", "standard_name")


@query("edit_distance", "SELECT p_partkey, levenshtein(p_name, p_type || p_brand) AS edits FROM part")
def edit_distance(spark, sf):
    return B.read(spark, sf, "part").select("p_partkey", F.levenshtein("p_name", F.concat("p_type", "p_brand")).alias("edits"))


@query("sequence_ratio", "SELECT p_partkey, round(2.0 * (length(p_name) - 1) / (2 * length(p_name) - 1), 6)::DOUBLE AS ratio FROM part")
def ratio_of_names(spark, sf):
    name = F.col("p_name")
    shorter = F.expr("substring(p_name, 1, length(p_name) - 1)")
    distinct = B.read(spark, sf, "part").select("p_name").distinct().withColumn("ratio", F.round(sequence_ratio(name, shorter), 6))
    return B.read(spark, sf, "part").join(distinct, "p_name").select("p_partkey", "ratio")


# --- annotations ----------------------------------------------------------------------------

_ANN = f"""SELECT o_orderkey AS doc_id, o_orderkey AS k, 'Dr. A' || CASE WHEN o_orderkey % 3 = 0 THEN ' Reg: MH' || o_orderkey ELSE '' END AS doctor_name, CASE WHEN o_orderkey % 3 = 0 THEN 'MH' || o_orderkey END AS doctor_reg,
    'Patient ' || o_custkey AS patient_name, CAST(o_custkey % 60 + 20 AS VARCHAR) AS patient_age, strftime(o_orderdate, '%Y-%m-%d') AS prescription_date,
    {at(B.BRANDS, 'o_orderkey')} AS b1, {at(B.BRANDS, 'o_orderkey + 1')} AS b2, {at(B.BRANDS, 'o_orderkey + 2')} AS b3, {at(['mg', 'ml', 'mcg'], 'o_orderkey')} AS unit, CAST(o_orderkey % 50 + 1 AS DOUBLE) AS dose FROM orders"""


@query("annotation_fields", sql("SELECT doc_id, doctor_name, 'Care Clinic' AS clinic_name, patient_name, patient_age, prescription_date FROM ann", ann=_ANN))
def annotation_fields(spark, sf):
    text = F.col("ground_truth")
    field = lambda name, alias=None: A.annotation_field(text, name).alias(alias or name)
    return B.annotations(spark, sf).select("doc_id", field("doctor_name"), field("clinic_name"), field("patient_name"), field("patient_age"), field("date", "prescription_date"))


@query("annotation_reg", sql("SELECT doc_id, doctor_reg FROM ann", ann=_ANN))
def annotation_reg(spark, sf):
    name = A.annotation_field(F.col("ground_truth"), "doctor_name")
    return B.annotations(spark, sf).select("doc_id", A.annotation_registration(name).alias("doctor_reg"))


@query("annotation_meds", sql("""SELECT doc_id, 0 AS pos, b1 AS drug_name, dose AS dosage_value, unit AS dosage_unit, 'As needed' AS frequency, 0 AS freq_per_day FROM ann
    UNION ALL SELECT doc_id, 1, b2, dose, 'mg', 'twice daily', 2 FROM ann UNION ALL SELECT doc_id, 2, b3, NULL, NULL, 'Before meals', NULL FROM ann WHERE k % 2 = 0""", ann=_ANN))
def annotation_meds(spark, sf):
    meds = dealt(B.annotations(spark, sf)).select("doc_id", F.posexplode_outer(A.annotation_medications(F.col("ground_truth"))).alias("pos", "m"))
    return meds.where(F.col("pos").isNotNull()).select("doc_id", "pos", "m.drug_name", "m.dosage_value", "m.dosage_unit", "m.frequency", "m.freq_per_day")


_PHRASES = ["Once daily", "take od", "Every 12 hours", "BID after food", "now and then", "", "as needed"]


@query("frequency_per_day", f"SELECT l_orderkey AS rx_id, l_linenumber AS line_no, ([1, 1, 2, 1, NULL, NULL, 0])[l_linenumber] AS per_day FROM lineitem")
def frequency_per_day(spark, sf):
    phrase = B.pick(_PHRASES, F.col("line_no") - 1)
    return B.medication_lines(spark, sf).select("rx_id", "line_no", A.frequency_per_day(phrase).alias("per_day"))


@query("clean_whitespace", r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '</?s(?:_ocr)?>', ' ', 'g'), '[\s\x{0b}\x{85}\x{1c}-\x{1f}\p{Z}]+', ' ', 'g'), ' ' || chr(9) || chr(13) || chr(10) || ':-') AS cleaned FROM documents")
def clean_whitespace(spark, sf):
    return B.read(spark, sf, "documents").select("doc_id", A.clean_whitespace(F.col("text")).alias("cleaned"))


_MEDS_JSON = """'{"dosage_unit":"' || unit || '","dosage_value":' || printf('%.1f', dose) || ',"drug_name":"' || b1 || '","freq_per_day":0,"frequency":"As needed","route":"oral"},{"dosage_unit":"mg","dosage_value":' || printf('%.1f', dose) || ',"drug_name":"' || b2 || '","freq_per_day":2,"frequency":"twice daily","route":"oral"}'
    || CASE WHEN k % 2 = 0 THEN ',{"drug_name":"' || b3 || '","frequency":"Before meals","route":"oral"}' ELSE '' END"""
ANN_JSON = f"""SELECT *, '{{"clinic_name":"Care Clinic","doctor_name":"' || doctor_name || '"' || coalesce(',"doctor_reg":"' || doctor_reg || '"', '') || ',"medications":[' || {_MEDS_JSON} || '],"patient_age":"' || patient_age || '","patient_name":"' || patient_name || '","prescription_date":"' || prescription_date || '"}}' AS target FROM ann"""


@query("compact_struct", sql("SELECT doc_id, target FROM ann_json", ann=_ANN, ann_json=ANN_JSON))
def compact_struct(spark, sf):
    record = A.sorted_record(F.col("record"))
    rows = dealt(B.annotations(spark, sf)).select("doc_id", A.annotation_record(F.col("ground_truth")).alias("record"))
    return rows.select("doc_id", A.compact_json(record).alias("target"))


_EL = """'<s_el><s_dosage_unit>' || unit || '</s_dosage_unit><s_dosage_value>' || printf('%.1f', dose) || '</s_dosage_value><s_drug_name>' || b1 || '</s_drug_name><s_freq_per_day>0</s_freq_per_day><s_frequency>As needed</s_frequency><s_route>oral</s_route></s_el><s_el><s_dosage_unit>mg</s_dosage_unit><s_dosage_value>' || printf('%.1f', dose) || '</s_dosage_value><s_drug_name>' || b2 || '</s_drug_name><s_freq_per_day>2</s_freq_per_day><s_frequency>twice daily</s_frequency><s_route>oral</s_route></s_el>'
    || CASE WHEN k % 2 = 0 THEN '<s_el><s_drug_name>' || b3 || '</s_drug_name><s_frequency>Before meals</s_frequency><s_route>oral</s_route></s_el>' ELSE '' END"""


@query("target_sequence", sql(f"""SELECT doc_id, '<s_rx><s_clinic_name>Care Clinic</s_clinic_name><s_doctor_name>' || doctor_name || '</s_doctor_name>' || coalesce('<s_doctor_reg>' || doctor_reg || '</s_doctor_reg>', '') || '<s_medications>' || {_EL} || '</s_medications><s_patient_age>' || patient_age || '</s_patient_age><s_patient_name>' || patient_name || '</s_patient_name><s_prescription_date>' || prescription_date || '</s_prescription_date></s>' AS target FROM ann""", ann=_ANN))
def target_sequence(spark, sf):
    rows = dealt(B.annotations(spark, sf)).select("doc_id", A.annotation_record(F.col("ground_truth")).alias("record"))
    return rows.select("doc_id", A.target_sequence(F.col("record")).alias("target"))


# --- payloads -----------------------------------------------------------------------------------

_PAY = f"""SELECT o_orderkey AS doc_id, o_custkey AS patient_id, o_orderkey % 5 AS v, {at(B.BRANDS, 'o_orderkey')} AS brand, CAST(o_orderkey % 40 + 10 AS DOUBLE) AS dose FROM orders"""
_MED_JSON = """'{"drug_name": "' || brand || '", "dosage_value": ' || CAST(dose AS INTEGER) || ', "dosage_unit": "mg"}'"""


@query("strip_fences_parse_json", sql(f"""SELECT doc_id, CASE v WHEN 0 THEN '{{"doctor_name": "Dr A", "confidence": 0.9, "medications": [' || {_MED_JSON} || ']}}' WHEN 1 THEN '{{"medications": ' || {_MED_JSON} || '}}'
    WHEN 2 THEN '{{"medications": [{{"el": ' || {_MED_JSON} || '}}, {{"raw_drug_name": "Other", "route": "iv"}}]}}' WHEN 4 THEN '{{"medications": []}}' END AS payload FROM pay""", pay=_PAY))
def strip_fences_parse_json(spark, sf):
    return B.model_payloads(spark, sf).select("doc_id", J.strip_fences(F.col("raw")).alias("payload"))


def _payload_rows(spark, sf, build):
    clean = B.model_payloads(spark, sf).withColumn("payload", J.strip_fences(F.col("raw"))).where(F.col("payload").isNotNull())
    rows = clean.select("doc_id", build(F.col("payload")).alias("r"))
    return rows.select("doc_id", "r.doctor_name", "r.confidence", F.posexplode_outer("r.medications").alias("pos", "m")).select(
        "doc_id", "doctor_name", "confidence", "pos", "m.raw_drug_name", "m.dosage_value", "m.dosage_unit", "m.route")


def _payload_check(default: str, other: str) -> str:
    head = "doc_id, CASE WHEN v = 0 THEN 'Dr A' END AS doctor_name, CASE WHEN v = 0 THEN 0.9::DOUBLE ELSE {0}::DOUBLE END AS confidence".format(default)
    return sql(f"""SELECT {head}, 0 AS pos, brand AS raw_drug_name, dose AS dosage_value, 'mg' AS dosage_unit, 'oral' AS route FROM pay WHERE v IN (0, 1, 2)
        UNION ALL SELECT {head}, 1, '{other}', NULL, NULL, 'iv' FROM pay WHERE v = 2 UNION ALL SELECT {head}, NULL, NULL, NULL, NULL, NULL FROM pay WHERE v = 4""", pay=_PAY)


@query("normalize_rx_json", _payload_check("0.8", ""))
def normalize_rx_json(spark, sf):
    return _payload_rows(spark, sf, J.normalize_rx_json)


@query("normalize_model_json", _payload_check("0.75", "Other"))
def normalize_model_json(spark, sf):
    return _payload_rows(spark, sf, J.normalize_model_json)


@query("normalize_lab_json", """SELECT event_id AS doc_id, 'City Lab' AS lab_name, 0.8::DOUBLE AS confidence, 'A' AS raw_name, 'HBA1C' AS analyte_name, CAST(c % 100 AS DOUBLE) AS value, (['high', 'normal', 'low'])[event_id % 3 + 1] AS flag
    FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events) WHERE event_id % 4 < 2 UNION ALL SELECT event_id, 'City Lab', 0.8, 'B', 'OTHER', 0.0, 'normal' FROM events""")
def normalize_lab_json(spark, sf):
    rows = B.lab_payloads(spark, sf).select("doc_id", J.normalize_lab_json(F.col("raw")).alias("r"))
    return rows.select("doc_id", "r.lab_name", "r.confidence", F.explode("r.results").alias("x")).select(
        "doc_id", "lab_name", "confidence", "x.raw_name", "x.analyte_name", "x.value", "x.flag")


@query("empty_extraction_guard", sql("SELECT doc_id FROM pay WHERE v IN (0, 1, 2)", pay=_PAY))
def empty_extraction_guard(spark, sf):
    return X.model_records(B.model_payloads(spark, sf)).select("doc_id")


@query("choose_extractor", sql("""SELECT r.doc_id, CASE WHEN r.k % 10 = 0 THEN 1 WHEN p.v = 2 THEN 2 WHEN p.v < 2 THEN 1 ELSE m1 + m2 END AS medications_found,
    CASE WHEN r.k % 10 = 0 THEN 0.9::DOUBLE WHEN p.v = 0 THEN 0.9::DOUBLE WHEN p.v IN (1, 2) THEN 0.75::DOUBLE ELSE r.confidence END AS confidence,
    CASE WHEN r.k % 10 = 0 THEN 'gemini_hybrid_image_and_text' WHEN p.v < 3 THEN 'local_donut_ml' ELSE 'tesseract_ner_fallback' END AS extractor_mode FROM rx_scored r JOIN pay p ON p.doc_id = r.doc_id""", pay=_PAY, **DOCS))
def choose_extractor(spark, sf):
    """The service answered every tenth document, the model those it could read."""
    shape = lambda df: df.select("doc_id", F.size("record.medications").alias("medications_found"), "record.confidence", "record.extractor_mode")
    raw = B.model_payloads(spark, sf)
    service = raw.where("doc_id % 10 = 0").withColumn("record", J.normalize_rx_json(J.strip_fences(F.col("raw"))))
    return X.choose_extractor(B.rx_documents(spark, sf), shape(service), shape(X.model_records(raw)))


@query("queue_draft", sql("""SELECT r.doc_id AS item_id, CASE WHEN p.v IN (1, 2, 4) THEN 'json' ELSE 'rules' END AS origin, CASE p.v WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 0 ELSE m1 + m2 END AS n_meds,
    CASE WHEN p.v IN (1, 2, 4) THEN 0.8::DOUBLE ELSE r.confidence END AS confidence FROM rx_scored r JOIN pay p ON p.doc_id = r.doc_id""", pay=_PAY, **DOCS))
def queue_draft(spark, sf):
    """Queue texts: stored JSON for some items, recognised text for the rest."""
    return X.queue_drafts(dealt(B.queue_texts(spark, sf)))


# --- the whole job -----------------------------------------------------------------------------------

def brand_table(spark):
    """Brand names of the bound documents with their generic names."""
    rows = [(b.lower(), i) for b, i in zip(B.BRANDS, B.CATALOG)]
    return tables.local_table(spark, rows, {"brand_name": "string", "inn": "string"})


def processed(spark, sf):
    return PR.process_prescriptions(
        dealt(B.rx_documents(spark, sf)), brand_table(spark), B.prescriptions(spark, sf), B.medication_lines(spark, sf), latest(spark, sf), rule_table(spark, sf), B.AS_OF_RX)


_DOC_DRUGS = f"SELECT doc_id, patient_id, {at(B.CATALOG, 'k')} AS inn FROM rx_texts WHERE m1 = 1 UNION SELECT doc_id, patient_id, {at(B.CATALOG, 'k + 1')} FROM rx_texts WHERE m2 = 1"
_DOC_ALL = "SELECT doc_id, inn FROM doc_drugs UNION SELECT d.doc_id, a.inn FROM rx_texts d JOIN active_drugs a ON a.patient_id = d.patient_id WHERE d.m1 + d.m2 > 0"
_DOC_FOUND = """SELECT a.doc_id, r.severity FROM doc_all a JOIN doc_all b ON a.doc_id = b.doc_id AND a.inn < b.inn JOIN (SELECT * FROM pair_rules UNION ALL SELECT * FROM class_rules) r ON r.drug_1 = a.inn AND r.drug_2 = b.inn"""


_SUMMARY = sql("""SELECT s.doc_id, s.patient_id, m1 + m2 AS n_meds, confidence, confidence < 0.5 AS needs_review, coalesce(f.n, 0) AS n_interactions, coalesce(f.major, FALSE) AS has_major,
    coalesce(a.n, 0) AS n_alerts, coalesce(a.critical, FALSE) AS has_critical,
    CASE WHEN confidence < 0.5 THEN 'Confidence ' || printf('%.4f', confidence) || ' < threshold 0.5 (extractor=tesseract_ner_fallback)' END AS reason FROM rx_scored s LEFT JOIN alerts_of a ON a.doc_id = s.doc_id
    LEFT JOIN (SELECT doc_id, count(*) AS n, bool_or(severity = 'major') AS major FROM doc_found GROUP BY 1) f ON f.doc_id = s.doc_id""",
    **DOCS, doc_drugs=_DOC_DRUGS, drugs="SELECT * FROM doc_drugs WHERE patient_id IS NOT NULL", **keyed_alerts("doc_id"), doc_all=_DOC_ALL, doc_found=_DOC_FOUND)


@query("process_prescriptions", f"SELECT * EXCLUDE (reason) FROM ({_SUMMARY})")
def process_prescriptions(spark, sf):
    return processed(spark, sf)["summary"].select("doc_id", "patient_id", "n_meds", "confidence", "needs_review", "n_interactions", "has_major", "n_alerts", "has_critical")


@query("process_prescriptions_alerts", _SUMMARY)
def process_prescriptions_alerts(spark, sf):
    return processed(spark, sf)["summary"]
