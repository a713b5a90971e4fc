"""Queries over extraction quality, the training corpus, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxweave import bindings as B
from rxweave.catalog.base import query
from rxweave.catalog.sqlbind import at, sql
from rxweave.catalog.texts import _ANN, ANN_JSON, DOCS, LABS, extracted, lab_extracted
from rxweave.operators import evaluation as EV
from rxweave.operators import interactions as I
from rxweave.operators import medications as MED
from rxweave.operators import review as R
from rxweave.plans import corpus as C
from rxweave.plans import extraction as X
from rxweave.session import cut_lineage, shared_folder, dealt
from rxweave.sources import readers, writers

# --- matching: expected outcomes per kind of document ---------------------------

_DOCS = f"""SELECT o_orderkey AS doc_id, o_orderkey % 5 AS v, {at(B.BRANDS, 'o_orderkey')} AS a, {at(B.BRANDS, 'o_orderkey + 12')} AS b, (o_orderkey % 100) / 100.0::DOUBLE AS confidence,
    (o_orderkey % 10) / 10.0::DOUBLE AS latency_s, ([2, 1, 0, 1, 0])[o_orderkey % 5 + 1] AS strict_tp, ([2, 2, 1, 1, 0])[o_orderkey % 5 + 1] AS relaxed_tp, ([2, 2, 1, 2, 0])[o_orderkey % 5 + 1] AS n_pred FROM orders"""
EVAL = dict(docs=_DOCS)


def matched(spark, sf):
    return EV.match_documents(B.evaluation_documents(spark, sf))


def counts(spark, sf):
    return EV.document_counts(matched(spark, sf))


@query("match_strict", sql("SELECT doc_id, 2 AS n_gold, n_pred, strict_tp FROM docs", **EVAL))
def match_strict(spark, sf):
    return counts(spark, sf).select("doc_id", "n_gold", "n_pred", "strict_tp")


@query("match_relaxed", sql("SELECT doc_id, relaxed_tp FROM docs", **EVAL))
def match_relaxed(spark, sf):
    return counts(spark, sf).select("doc_id", "relaxed_tp")


@query("match_best_fuzzy", sql("""SELECT doc_id, 0 AS i, a AS gold, CASE WHEN v < 2 THEN a WHEN v = 2 THEN 'X' || substr(a, 2) END AS best FROM docs
    UNION ALL SELECT doc_id, 1, b, CASE WHEN v IN (0, 1, 3) THEN b END FROM docs""", **EVAL))
def match_best_fuzzy(spark, sf):
    rows = matched(spark, sf).select("doc_id", "pred", "best", F.posexplode("gold").alias("i", "g"))
    best = F.element_at("best", F.col("i") + 1)
    name = F.when(best["ratio"] >= 0.5, F.get(F.col("pred"), F.when(best["pos"] >= 0, best["pos"]))["raw_drug_name"])
    return rows.select("doc_id", "i", F.col("g.drug_name").alias("gold"), name.alias("best"))


def set_scores(spark, sf):
    return EV.set_scores(B.evaluation_documents(spark, sf).unionByName(B.model_documents(spark, sf)))


_SETS = """SELECT doc_id, 'ocr' AS extractor, latency_s, ([1, 1, 1, 0.5, 0])[v + 1]::DOUBLE AS p, ([1, 1, 0.5, 0.5, 0])[v + 1]::DOUBLE AS r FROM docs
    UNION ALL SELECT doc_id, 'model', latency_s + 1, CAST(doc_id % 2 = 0 AS INTEGER)::DOUBLE, CAST(doc_id % 2 = 0 AS INTEGER)::DOUBLE FROM docs"""
_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"
_MACRO = f"SELECT extractor, count(*) AS n_docs, avg(p) AS precision, avg(r) AS recall, avg({_F1}) AS f1, avg(latency_s) AS latency_s FROM sets GROUP BY extractor"
SETS = dict(docs=_DOCS, sets=_SETS, macro=_MACRO)


@query("match_set", sql(f"SELECT doc_id, extractor, p AS precision, r AS recall, round({_F1}, 6) AS f1 FROM sets", **SETS))
def match_set(spark, sf):
    return set_scores(spark, sf).select("doc_id", "extractor", "precision", "recall", F.round("f1", 6).alias("f1"))


_TOTALS = """SELECT 'strict' AS mode, count(*) AS n_docs, CAST(sum(strict_tp) AS BIGINT) AS tp, CAST(sum(n_pred) AS BIGINT) AS p, count(*) * 2 AS g FROM docs
    UNION ALL SELECT 'relaxed', count(*), CAST(sum(relaxed_tp) AS BIGINT), CAST(sum(n_pred) AS BIGINT), count(*) * 2 FROM docs"""
_MICRO = "SELECT mode, n_docs, tp, p - tp AS fp, g - tp AS fn, round(tp / p, 6) AS precision, round(tp / g, 6) AS recall, round(2 * (tp / p) * (tp / g) / (tp / p + tp / g), 6) AS f1, round(tp / g, 6) AS accuracy FROM totals"


def rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


@query("prf_micro", sql(_MICRO, docs=_DOCS, totals=_TOTALS))
def prf_micro(spark, sf):
    return rounded(EV.prf_micro(counts(spark, sf)), "precision", "recall", "f1", "accuracy")


@query("prf_macro", sql("SELECT extractor, n_docs, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM macro", **SETS))
def prf_macro(spark, sf):
    return rounded(EV.prf_macro(set_scores(spark, sf)), "precision", "recall", "f1").drop("latency_s")


@query("latency_mean", sql("SELECT extractor, round(latency_s, 6) AS latency_s FROM macro", **SETS))
def latency_mean(spark, sf):
    docs = B.evaluation_documents(spark, sf).unionByName(B.model_documents(spark, sf))
    return docs.groupBy("extractor").agg(F.round(F.avg("latency_s"), 6).alias("latency_s"))


@query("compare_extractors", sql("SELECT round(o.f1, 6) AS base_f1, round(m.f1, 6) AS challenger_f1, m.f1 > o.f1 + 0.2 AS prefer_challenger FROM macro o, macro m WHERE o.extractor = 'ocr' AND m.extractor = 'model'", **SETS))
def compare_extractors(spark, sf):
    return rounded(EV.compare_extractors(EV.prf_macro(set_scores(spark, sf)), "ocr", "model"), "base_f1", "challenger_f1")


_FIELDS = """SELECT e.extractor, f.field, (f.k + CASE WHEN e.extractor = 'model' THEN 1 ELSE 0 END) % 5 AS v FROM (
    SELECT o_orderkey AS k, 'doctor_name' AS field FROM orders UNION ALL SELECT o_orderkey, 'clinic_name' FROM orders UNION ALL SELECT o_orderkey, 'patient_age' FROM orders WHERE o_orderkey % 11 <> 0) f
    CROSS JOIN (VALUES ('ocr'), ('model')) e(extractor)"""


@query("field_accuracy", sql("""SELECT extractor, field, count(*) AS total, round(count(*) FILTER (v IN (0, 3)) / count(*), 6) AS strict,
    round(count(*) FILTER (v IN (0, 3) OR (v = 1 AND field <> 'patient_age')) / count(*), 6) AS fuzzy FROM fields GROUP BY 1, 2""", fields=_FIELDS))
def field_accuracy(spark, sf):
    return rounded(EV.field_accuracy(EV.with_ratio(B.field_values(spark, sf), "gold", "pred")), "strict", "fuzzy")


_ERRORS = """SELECT doc_id, 'character' AS category FROM docs WHERE v = 1 UNION ALL SELECT doc_id, 'synonym' FROM docs WHERE v = 2 UNION ALL SELECT doc_id, 'missing' FROM docs WHERE v IN (2, 3)
    UNION ALL SELECT doc_id, unnest(['missing', 'missing']) FROM docs WHERE v = 4 UNION ALL SELECT doc_id, 'hallucinated' FROM docs WHERE v = 3"""


@query("error_categories", sql("SELECT category, count(*) AS n FROM mistakes GROUP BY category", docs=_DOCS, mistakes=_ERRORS))
def error_categories(spark, sf):
    return EV.error_categories(matched(spark, sf))


@query("miss_audit", sql("""SELECT doc_id, a AS gold_name, CASE WHEN v = 2 THEN 'FUZZY_ONLY' ELSE 'TOTAL_MISS' END AS status FROM docs WHERE v IN (2, 3, 4)
    UNION ALL SELECT doc_id, b, 'TOTAL_MISS' FROM docs WHERE v IN (2, 4)""", **EVAL))
def miss_audit(spark, sf):
    return EV.miss_audit(matched(spark, sf)).select("doc_id", "gold_name", "status")


@query("inn_rate", sql("SELECT CAST(sum(([2, 2, 1, 1, 0])[v + 1]) AS BIGINT) AS matched, CAST(sum(([2, 1, 1, 1, 0])[v + 1]) AS BIGINT) AS correct, round(sum(([2, 1, 1, 1, 0])[v + 1]) / sum(([2, 2, 1, 1, 0])[v + 1]), 6) AS inn_rate FROM docs", **EVAL))
def inn_rate(spark, sf):
    return rounded(EV.inn_rate(matched(spark, sf)), "inn_rate")


@query("confidence_corr", sql("SELECT count(*) AS n, round(corr(confidence, ([2, 2, 1, 1, 0])[v + 1] / 2), 6) AS r FROM docs", **EVAL))
def confidence_corr(spark, sf):
    return rounded(EV.confidence_correlation(counts(spark, sf)), "r")


@query("word_accuracy", "SELECT count(*) AS n_words, count(*) FILTER (p_partkey % 4 < 2) / count(*) AS word_accuracy, count(*) FILTER (p_partkey % 3 = 0) / count(*) AS inn_accuracy FROM part")
def word_accuracy(spark, sf):
    return EV.word_accuracy(EV.with_ratio(B.labelled_words(spark, sf), "read", "word"))


@query("eval_limit", "SELECT image, word FROM (SELECT lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS image, p_name AS word FROM part) ORDER BY image LIMIT 30")
def eval_limit(spark, sf):
    return B.labelled_words(spark, sf).orderBy("image").limit(30).select("image", "word")


@query("evaluate_extraction", sql("""SELECT m.n_docs, m.tp AS strict_tp, m.fp AS strict_fp, m.fn AS strict_fn, m.f1 AS strict_f1, x.tp AS relaxed_tp, x.f1 AS relaxed_f1,
    (SELECT count(*) FROM mistakes WHERE category = 'missing') AS missing, (SELECT count(*) FROM mistakes WHERE category = 'hallucinated') AS hallucinated FROM micro m, micro x WHERE m.mode = 'strict' AND x.mode = 'relaxed'""",
    docs=_DOCS, totals=_TOTALS, micro=_MICRO, mistakes=_ERRORS))
def evaluate_extraction(spark, sf):
    """The metrics row of an evaluation run."""
    per_doc = cut_lineage(spark, counts(spark, sf).select("doc_id", "n_gold", "n_pred", "strict_tp", "relaxed_tp", "errors"), "counts")
    micro = rounded(EV.prf_micro(per_doc), "f1")
    value = lambda mode, c: F.when(F.col("mode") == mode, F.col(c))
    columns = {"n_docs": F.col("n_docs"), **{f"strict_{c}": value("strict", c) for c in ("tp", "fp", "fn", "f1")}, **{f"relaxed_{c}": value("relaxed", c) for c in ("tp", "f1")}}
    scores = micro.select(*[c.alias(n) for n, c in columns.items()])
    number = lambda c: F.coalesce(F.sum(F.size(F.filter("errors", lambda e: e == c))), F.lit(0))
    errors = per_doc.agg(*[number(c).alias(c) for c in ("missing", "hallucinated")])
    both = scores.unionByName(errors, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


# --- corpus --------------------------------------------------------------------------

def _training_rows(spark, sf):
    """Training rows with every kind of fault."""
    key = F.col("o_orderkey")
    good = F.concat(F.lit('{"doctor_name": "Dr '), key, F.lit('", "medications": [{"drug_name": "A"}]}'))
    truth = (
        F.when(key % 9 == 1, F.lit(None).cast("string")).when(key % 9 == 2, F.lit("{broken")).when(key % 9 == 3, F.lit('{"doctor_name": "A", "medications": {"drug_name": "B"}}'))
        .when(key % 9 == 4, F.lit('{"doctor_name": " ", "medications": []}')).when(key % 9 == 5, F.lit('{"medications": [{"drug_name": "A"}, {"dosage_value": 5}]}'))
        .when(key % 9 == 6, F.lit('{"medications": ["A"]}')).when(key % 9 == 7, F.lit('{"diagnosis": "Fever"}')).otherwise(good))
    return B.read(spark, sf, "orders").select(key.alias("doc_id"), F.when(key % 9 != 0, F.concat(F.lit("images/"), key, F.lit(".png"))).alias("file_name"), truth.alias("ground_truth"))


@query("validate_training_rows", """SELECT o_orderkey AS doc_id, CASE o_orderkey % 9 WHEN 0 THEN 'missing file_name' WHEN 1 THEN 'missing ground_truth' WHEN 2 THEN 'invalid JSON' WHEN 3 THEN 'medications is not a list'
    WHEN 4 THEN 'no clinical field and no medication' WHEN 5 THEN 'medication without drug_name' WHEN 6 THEN 'medication is not an object' END AS reason FROM orders""")
def validate_training_rows(spark, sf):
    return C.validate_training_rows(_training_rows(spark, sf)).select("doc_id", "reason")


def _stems(spark, sf):
    return B.annotations(spark, sf).select(F.concat(F.lit("rx"), F.col("doc_id")).alias("stem"), "ground_truth")


def _files(spark, sf):
    """Image files: png and jpg for some stems, one of them, or none."""
    key = F.col("o_orderkey")
    suffixes = F.when(key % 4 == 0, F.array(F.lit("jpg"), F.lit("png"))).when(key % 4 == 1, F.array(F.lit("jpeg"))).when(key % 4 == 2, F.array(F.lit("jpeg"), F.lit("jpg"), F.lit("txt"))).otherwise(F.array(F.lit("txt")))
    return B.read(spark, sf, "orders").select(F.explode(suffixes).alias("suffix"), key.alias("k")).select(F.concat(F.lit("rx"), F.col("k"), F.lit("."), F.col("suffix")).alias("file_name"))


_FILE = "'rx' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.png' WHEN 1 THEN '.jpeg' ELSE '.jpg' END"


@query("pair_files", f"SELECT 'rx' || o_orderkey AS stem, CASE WHEN o_orderkey % 4 < 3 THEN {_FILE} END AS file_name FROM orders")
def pair_files(spark, sf):
    found, missing = C.pair_files(_stems(spark, sf).select("stem"), _files(spark, sf))
    return found.unionByName(missing.select("stem", F.lit(None).cast("string").alias("file_name")))


@query("unlabeled_documents", "SELECT 'doc' || doc_id || '.png' AS file_name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabeled_documents(spark, sf):
    name = F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".png")).alias("file_name")
    labels = B.read(spark, sf, "labels")
    return C.unlabeled(B.read(spark, sf, "documents").select(name), labels.where("quality = 1").select(name), labels.where("quality = 0").select(name))


@query("build_training_corpus", sql(f"SELECT 'rx' || doc_id AS stem, 'images/' || {_FILE.replace('o_orderkey', 'doc_id')} AS file_name, target AS ground_truth FROM ann_json WHERE doc_id % 4 < 3", ann=_ANN, ann_json=ANN_JSON))
def build_training_corpus(spark, sf):
    return C.build_training_corpus(dealt(_stems(spark, sf)), _files(spark, sf))


# --- files: write what Spark derived from the tables, then scan it ------------------------

@query("scan_annotations", "SELECT 'doctor_name: Dr ' || n_name AS ground_truth FROM nation")
def scan_annotations(spark, sf):
    out = shared_folder(spark, "annotations")
    rows = B.facilities(spark, sf).select(F.concat(F.lit("doctor_name: Dr "), F.col("name")).alias("ground_truth"))
    rows.write.option("maxRecordsPerFile", 1).json(out)
    return readers.scan_annotations(spark, out).select("ground_truth")


@query("scan_metadata_jsonl", "SELECT CASE WHEN o_orderkey % 10 = 0 THEN '{\"file_name\": oops' || o_orderkey END AS bad_line, CASE WHEN o_orderkey % 10 <> 0 THEN 'f' || o_orderkey END AS file_name FROM orders")
def scan_metadata_jsonl(spark, sf):
    out, key = shared_folder(spark, "jsonl"), F.col("o_orderkey")
    good = F.to_json(F.struct(F.concat(F.lit("f"), key).alias("file_name"), F.lit("{}").alias("ground_truth")))
    line = F.when(key % 10 == 0, F.concat(F.lit('{"file_name": oops'), key)).otherwise(good)
    B.read(spark, sf, "orders").select(line.alias("value")).write.text(out)
    return readers.scan_metadata_jsonl(spark, out).select("bad_line", "file_name")


@query("scan_label_csv", sql(f"SELECT lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS image, p_name AS word, {at(B.CATALOG, 'p_partkey')} AS generic FROM part"))
def scan_label_csv(spark, sf):
    out = shared_folder(spark, "labels")
    words = B.labelled_words(spark, sf).select(F.col("image").alias("IMAGE"), F.col("word").alias("MEDICINE_NAME"), F.col("generic").alias("GENERIC_NAME"))
    words.write.option("header", True).csv(out)
    return readers.scan_label_csv(spark, out).toDF("image", "word", "generic")


@query("sink_prescriptions", sql("""SELECT 'prescriptions' AS sink, count(*) AS n FROM rx_scored WHERE confidence >= 0.5 UNION ALL SELECT 'medications', coalesce(CAST(sum(m1 + m2) AS BIGINT), 0) FROM rx_scored WHERE confidence >= 0.5""", **DOCS))
def sink_prescriptions(spark, sf):
    out = shared_folder(spark, "sink")
    docs = cut_lineage(spark, MED.route_by_confidence(extracted(spark, sf)), "routed")
    rows = X.medication_rows(docs, "doc_id").withColumn("inn", F.lower("raw_drug_name"))
    found = I.interactions(rows.select("doc_id", "inn").distinct(), "doc_id")
    writers.sink_prescriptions(out, 0, docs, rows, found)
    count = lambda t: spark.read.parquet(f"{out}/{t}").agg(F.lit(t).alias("sink"), F.count("*").alias("n"))
    return count("prescriptions").unionByName(count("medications"))


@query("sink_review_queue", sql("SELECT doc_id AS item_id, confidence, 'Confidence ' || printf('%.4f', confidence) || ' < threshold 0.5 (extractor=tesseract_ner_fallback)' AS reason FROM rx_scored WHERE confidence < 0.5", **DOCS))
def sink_review_queue(spark, sf):
    out = shared_folder(spark, "sink")
    writers.sink_review_queue(out, 0, cut_lineage(spark, MED.route_by_confidence(extracted(spark, sf)), "routed"))
    return spark.read.parquet(f"{out}/review_queue").select("item_id", "confidence", "reason")


@query("sink_lab_reports", sql("SELECT analyte_name, count(*) AS n FROM (SELECT unnest(list_concat(CASE WHEN r1 THEN ['HBA1C'] ELSE [] END, CASE WHEN r2 THEN ['CREATININE'] ELSE [] END)) AS analyte_name FROM lab_scored WHERE confidence >= 0.5) GROUP BY 1", **LABS))
def sink_lab_reports(spark, sf):
    out = shared_folder(spark, "sink")
    writers.sink_lab_reports(out, 0, cut_lineage(spark, R.route_lab(lab_extracted(spark, sf)), "routed"))
    return spark.read.parquet(f"{out}/lab_results").groupBy("analyte_name").agg(F.count("*").alias("n"))


@query("sink_training_jsonl", sql(f"SELECT 'images/' || {_FILE.replace('o_orderkey', 'doc_id')} AS file_name, target AS ground_truth FROM ann_json WHERE doc_id % 4 < 3", ann=_ANN, ann_json=ANN_JSON))
def sink_training_jsonl(spark, sf):
    out = shared_folder(spark, "corpus")
    writers.sink_training_jsonl(out, build_training_corpus(spark, sf))
    return readers.scan_metadata_jsonl(spark, out).select("file_name", "ground_truth")


@query("sink_metrics", sql(_MICRO, docs=_DOCS, totals=_TOTALS))
def sink_metrics(spark, sf):
    out = shared_folder(spark, "metrics")
    metrics = prf_micro(spark, sf)
    writers.sink_metrics(out, metrics)
    return spark.read.schema(metrics.schema).json(out)
