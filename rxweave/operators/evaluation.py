"""Extraction quality against gold annotations.

A document row carries its gold and predicted medications as two short arrays.
The similarity ratios of all pairs of a document are the one thing that needs
Python; tests and the greedy one-to-one assignment in list order are column
expressions over them, and all counts and rates after that plain aggregates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rxweave.functions.similarity import contains_either, ratio, tidy
from rxweave.functions.text import bind
from rxweave.refdata import corpus as C


@F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def ratio_table(gold: pa.Array, pred: pa.Array) -> pa.Array:
    """The ratio of every gold text (row) with every predicted one; equal pairs inside a batch are computed once."""
    size = lambda lists: lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    n_gold, n_pred = size(gold), size(pred)
    wanted, given = gold.flatten(), pred.flatten()
    words = pa.concat_arrays([wanted, given]).dictionary_encode()
    codes, names = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
    a, b = codes[:len(wanted)], codes[len(wanted):]
    width = np.repeat(n_pred, n_gold)  # of each gold text's row in its table
    ends = np.cumsum(width)
    start = np.repeat(np.cumsum(n_pred) - n_pred, n_gold)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - width), width)
    pairs, place = np.unique(np.repeat(a, width) * max(len(names), 1) + b[at], return_inverse=True)
    found = np.array([ratio(names[p // len(names)], names[p % len(names)]) for p in pairs.tolist()], dtype="float64")
    offsets = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    rows = pa.ListArray.from_arrays(offsets(width), pa.array(found[place]))
    return pa.ListArray.from_arrays(offsets(n_gold), rows)


def _texts(items: str, name: str) -> Column:
    return F.transform(items, lambda x: tidy(x[name]))


def _number(value: Column) -> Column:
    return F.nullif(value, F.lit(float("nan")))


def _alike(a: Column, b: Column, score: Column, threshold: float) -> Column:
    """Both non-empty, and contained in each other or similar enough."""
    return contains_either(a, b) | ((a != "") & (b != "") & (score >= threshold))


def _strict(g: Column, p: Column, name: Column, frequency: Column) -> Column:
    a, b, gold_route, pred_route = tidy(g["drug_name"]), tidy(p["raw_drug_name"]), tidy(g["route"]), tidy(p["route"])
    return (
        (a.contains(b) | b.contains(a))
        & _number(g["dosage_value"]).eqNullSafe(_number(p["dosage_value"]))
        & (tidy(g["dosage_unit"]) == tidy(p["dosage_unit"]))
        & _alike(tidy(g["frequency"]), tidy(p["frequency"]), frequency, C.STRICT_FREQUENCY_RATIO)
        & ((gold_route == pred_route) | ((gold_route == "") & (pred_route == "oral"))))


def _relaxed(g: Column, p: Column, name: Column, frequency: Column) -> Column:
    a, b, inn = tidy(g["clean_name"]), tidy(p["clean_name"]), tidy(p["inn"])
    x, y = _number(g["dosage_value"]), _number(p["dosage_value"])
    u, v, f, h = tidy(g["dosage_unit"]), tidy(p["dosage_unit"]), tidy(g["frequency"]), tidy(p["frequency"])
    named = ((inn != "") & (inn.contains(a) | a.contains(inn))) | _alike(a, b, name, C.RELAXED_RATIO)
    return (
        named
        & (x.isNull() | y.isNull() | F.coalesce(F.abs(x - y) < C.RELAXED_DOSE_GAP, F.lit(False)))
        & ((u == v) | (u == "") | (v == ""))
        & ((f == "") | (h == "") | _alike(f, h, frequency, C.RELAXED_RATIO)))


def _fits(test) -> Column:
    """For each gold item which predictions pass the test."""
    at = lambda table, i, j: F.col(table)[i][j]
    return F.transform("gold", lambda g, i: F.transform("pred", lambda p, j: test(g, p, at("_names", i, j), at("_frequencies", i, j))))


def greedy(fits: Column) -> Column:
    """For each gold item, in order, the position of the first free prediction that fits, or -1."""
    def step(taken: Column, row: Column) -> Column:
        free = F.filter(F.transform(row, lambda fit, j: F.when(fit & ~F.array_contains(taken, j), j)), lambda j: j.isNotNull())
        return F.array_append(taken, F.coalesce(F.try_element_at(free, F.lit(1)), F.lit(-1)))

    return F.aggregate(fits, F.array().cast("array<int>"), step)


def match_documents(docs: DataFrame) -> DataFrame:
    """Strict and relaxed assignment and the best fuzzy prediction (highest ratio, first wins) per item."""
    scored = docs.withColumn("_names", ratio_table(_texts("gold", "clean_name"), _texts("pred", "clean_name"))).withColumn(
        "_frequencies", ratio_table(_texts("gold", "frequency"), _texts("pred", "frequency")))
    best = F.transform("_names", lambda row: F.struct(
        (F.coalesce(F.array_position(row, F.array_max(row)).cast("int"), F.lit(0)) - 1).alias("pos"), F.coalesce(F.array_max(row), F.lit(0.0)).alias("ratio")))
    return scored.select(*docs.columns, greedy(_fits(_strict)).alias("strict"), greedy(_fits(_relaxed)).alias("relaxed"), best.alias("best"))


def _hits(assigned: Column) -> Column:
    return F.size(F.filter(assigned, lambda i: i >= 0))


def document_counts(matched: DataFrame) -> DataFrame:
    return matched.select(
        "doc_id", F.size("gold").alias("n_gold"), F.size("pred").alias("n_pred"),
        _hits(F.col("strict")).alias("strict_tp"), _hits(F.col("relaxed")).alias("relaxed_tp"),
        F.size(F.filter("best", lambda b: b["ratio"] >= C.BEST_RATIO)).alias("fuzzy_hits"), "confidence", errors().alias("errors"))


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return rate(2 * p * r, p + r)


def prf_micro(counts: DataFrame) -> DataFrame:
    """Totals and precision, recall, F1 and accuracy for both modes."""
    total = counts.agg(*[F.sum(c).alias(c) for c in ("n_gold", "n_pred", "strict_tp", "relaxed_tp")], F.count("*").alias("n_docs"))
    rows = total.unpivot(["n_docs", "n_gold", "n_pred"], ["strict_tp", "relaxed_tp"], "mode", "tp")
    p, r = rate(F.col("tp"), F.col("n_pred")), rate(F.col("tp"), F.col("n_gold"))
    return rows.select(
        F.regexp_replace("mode", "_tp", "").alias("mode"), "n_docs", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"),
        (F.col("n_gold") - F.col("tp")).alias("fn"), p.alias("precision"), r.alias("recall"), _f1(p, r).alias("f1"), r.alias("accuracy"))


def set_scores(docs: DataFrame) -> DataFrame:
    """Per document: precision, recall and F1 of the name sets."""
    named = lambda items, name: F.transform(F.filter(items, lambda x: F.coalesce(x[name], F.lit("")) != ""), lambda x: tidy(x[name]))
    sides = docs.select("doc_id", "extractor", "latency_s", named("gold", "drug_name").alias("_gold"), named("pred", "raw_drug_name").alias("_pred"))
    table = sides.withColumn("_ratios", ratio_table("_gold", "_pred"))
    like = F.transform("_gold", lambda x, i: F.transform("_pred", lambda y, j: _alike(x, y, F.col("_ratios")[i][j], C.SET_RATIO)))
    scored = table.withColumn("_like", like).select(
        "doc_id", "extractor", "latency_s", F.size(F.filter("_like", lambda row: F.exists(row, lambda hit: hit))).alias("gold_hits"),
        F.size(F.filter(F.transform("_pred", lambda y, j: F.exists("_like", lambda row: row[j])), lambda hit: hit)).alias("pred_hits"),
        F.size("_gold").alias("n_gold"), F.size("_pred").alias("n_pred"))
    empty = (F.col("n_gold") == 0) & (F.col("n_pred") == 0)
    p = F.when(empty, 1.0).otherwise(rate(F.col("pred_hits"), F.col("n_pred")))
    r = F.when(empty, 1.0).otherwise(rate(F.col("gold_hits"), F.col("n_gold")))
    return scored.select("*", p.alias("precision"), r.alias("recall")).withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def prf_macro(scores: DataFrame) -> DataFrame:
    """Mean scores and latency per extractor over documents with gold items."""
    has_gold = F.col("n_gold") > 0
    mean = lambda c: F.coalesce(F.avg(F.when(has_gold, F.col(c))), F.lit(0.0)).alias(c)
    return scores.groupBy("extractor").agg(F.count("*").alias("n_docs"), mean("precision"), mean("recall"), mean("f1"), F.avg("latency_s").alias("latency_s"))


def compare_extractors(macro: DataFrame, base: str, challenger: str) -> DataFrame:
    """One row: prefer the challenger only when it is clearly better."""
    f1 = lambda name: F.coalesce(F.max(F.when(F.col("extractor") == name, F.col("f1"))), F.lit(0.0))
    both = macro.agg(f1(base).alias("base_f1"), f1(challenger).alias("challenger_f1"))
    return both.withColumn("prefer_challenger", F.col("challenger_f1") > F.col("base_f1") + C.PREFER_MARGIN)


def field_accuracy(fields: DataFrame) -> DataFrame:
    """Strict and fuzzy accuracy per extractor and field over rows
    (extractor, field, gold, pred, ratio) with a gold value."""
    from rxweave.functions.similarity import fuzzy_match, tidy
    a, b = tidy(F.col("gold")), tidy(F.col("pred"))
    rows = fields.withColumn("a", a).withColumn("b", b).where(F.col("a") != "")
    return rows.groupBy("extractor", "field").agg(
        F.count("*").alias("total"),
        rate(F.count_if(F.col("a") == F.col("b")), F.count("*")).alias("strict"),
        rate(F.count_if(fuzzy_match(F.col("a"), F.col("b"), F.col("ratio"))), F.count("*")).alias("fuzzy"))


def with_ratio(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Add the similarity ratio; distinct value pairs are scored once."""
    from rxweave.functions.similarity import sequence_ratio, tidy
    keyed = pairs.withColumn("_a", tidy(F.col(a))).withColumn("_b", tidy(F.col(b)))
    scores = keyed.select("_a", "_b").where((F.col("_a") != "") & (F.col("_b") != "") & (F.col("_a") != F.col("_b"))).distinct().withColumn("ratio", sequence_ratio("_a", "_b"))
    joined = keyed.join(scores, ["_a", "_b"], "left")
    return joined.withColumn("ratio", F.coalesce("ratio", F.when((F.col("_a") == F.col("_b")) & (F.col("_a") != ""), 1.0).otherwise(0.0))).drop("_a", "_b")


def errors() -> Column:
    """The errors of a matched document: missing, synonym or character per missed gold item, hallucinated per prediction that fits none."""
    def missed(strict: Column, relaxed: Column) -> Column:
        def kind(g: Column, i: Column) -> Column:
            other = F.get(F.col("pred"), F.get(relaxed, i))["clean_name"]
            of = F.when(F.get(relaxed, i) < 0, "missing").when(other != g["clean_name"], "synonym").otherwise("character")
            return F.when(F.get(strict, i) < 0, of)

        return F.concat(F.transform("gold", kind), F.transform("pred", lambda _, j: F.when(~F.array_contains(relaxed, j), "hallucinated")))

    return bind(F.col("strict"), lambda s: bind(F.col("relaxed"), lambda r: F.filter(missed(s, r), lambda e: e.isNotNull())))


def error_rows(matched: DataFrame) -> DataFrame:
    """One row per error: missing, synonym, character or hallucinated."""
    return matched.select("doc_id", F.explode(errors()).alias("category"))


def error_categories(matched: DataFrame) -> DataFrame:
    return error_rows(matched).groupBy("category").agg(F.count("*").alias("n"))


def miss_audit(matched: DataFrame) -> DataFrame:
    """Gold names no prediction contains, with the closest prediction and
    whether it is at least similar."""
    rows = matched.select("doc_id", "pred", "best", F.posexplode("gold").alias("i", "g"))
    name = F.col("g.clean_name")
    contained = F.exists("pred", lambda p: p["clean_name"].contains(name) | name.contains(p["clean_name"]))
    best = F.element_at("best", F.col("i") + 1)
    closest = F.get(F.col("pred"), F.when(best["pos"] >= 0, best["pos"]))
    status = F.when(best["ratio"] >= C.RELAXED_RATIO, "FUZZY_ONLY").otherwise("TOTAL_MISS")
    return rows.where(~contained).select(
        "doc_id", F.col("g.drug_name").alias("gold_name"), F.coalesce(closest["raw_drug_name"], F.lit("[No Medications Extracted]")).alias("closest"),
        best["ratio"].alias("ratio"), status.alias("status"), (F.col("g.inn") == closest["inn"]).alias("same_inn"))


def inn_rate(matched: DataFrame) -> DataFrame:
    """Share of fuzzily matched drugs whose generic name is right."""
    rows = matched.select("pred", "best", F.posexplode("gold").alias("i", "g")).select(
        "g", F.element_at("best", F.col("i") + 1).alias("b"), "pred")
    found = F.col("b.ratio") >= C.BEST_RATIO
    given = F.get(F.col("pred"), F.when(F.col("b.pos") >= 0, F.col("b.pos")))["inn"]
    right = found & F.coalesce(F.lower(given) == F.lower(F.col("g.inn")), F.lit(False))
    return rows.agg(F.count_if(found).alias("matched"), F.count_if(right).alias("correct")).withColumn("inn_rate", rate(F.col("correct"), F.col("matched")))


def confidence_correlation(counts: DataFrame) -> DataFrame:
    """Pearson r of confidence and accuracy; 0 without any spread."""
    rows = counts.where(F.col("n_gold") > 0).select(F.col("confidence").alias("x"), rate(F.col("fuzzy_hits"), F.col("n_gold")).alias("y"))
    spread = F.stddev_pop("x") * F.stddev_pop("y")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.try_divide(F.covar_pop("x", "y"), spread), F.lit(0.0)).alias("r"))


def word_accuracy(words: DataFrame, limit: int | None = None) -> DataFrame:
    """Reading and INN accuracy over the labelled words, or over the first ``limit`` by image.

    Columns: image, word (gold brand), generic, read (text as read), inn, ratio.
    """
    from rxweave.functions.similarity import tidy
    rows = words if limit is None else words.orderBy("image").limit(limit)
    read, word, inn, generic = (tidy(F.col(c)) for c in ("read", "word", "inn", "generic"))
    hit = read.contains(word) | (F.col("ratio") >= C.SET_RATIO)
    same = inn.contains(generic) | generic.contains(inn)
    return rows.agg(F.count("*").alias("n_words"), rate(F.count_if(hit), F.count("*")).alias("word_accuracy"), rate(F.count_if(same), F.count("*")).alias("inn_accuracy"))
