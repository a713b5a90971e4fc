"""Drug interactions among the drugs of a patient (or of any other key).

Pairs are never enumerated per patient. The rule tables are written out per
drug pair; a patient's drugs that occur in any rule form a set no larger than
the rule vocabulary, and only rule partners are looked up in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxweave.functions.text import first_case
from rxweave.refdata import interactions as I
from rxweave.refdata import tables
from rxweave.session import cut_lineage


def severity_rank(severity: Column) -> Column:
    return first_case([(severity == s, n) for n, s in enumerate(I.SEVERITY_ORDER)], I.SEVERITY_LAST)


def drug_pair_counts(drugs: DataFrame, key: str = "patient_id") -> DataFrame:
    """Distinct drugs and the pairs to be checked, per key; pairs are counted,
    not listed, because only pairs with a rule can matter."""
    n = F.count("*")
    return drugs.groupBy(key).agg(n.alias("n_drugs"), F.expr("count(*) * (count(*) - 1) div 2").alias("n_pairs"))


def rule_drug_sets(drugs: DataFrame, rule_drugs: list[str], key: str = "patient_id") -> DataFrame:
    """Per key the set of its drugs that occur in any rule; never larger than
    the code-defined rule vocabulary."""
    return drugs.where(F.col("inn").isin(rule_drugs)).groupBy(key).agg(F.collect_set("inn").alias("_drugs"))


def pairs_in_sets(sets: DataFrame, rules: DataFrame, key: str = "patient_id") -> DataFrame:
    """Rule pairs whose two drugs are both in the set of a key."""
    return (
        sets.where(F.size("_drugs") > 1)
        .select(key, "_drugs", F.explode("_drugs").alias("drug_1"))
        .join(F.broadcast(rules), "drug_1")
        .where(F.array_contains("_drugs", F.col("drug_2")))
        .select(key, "drug_1", "drug_2", "severity", "description", "management", "source")
    )


def matched_pairs(drugs: DataFrame, rules: DataFrame, rule_drugs: list[str], key: str = "patient_id") -> DataFrame:
    return pairs_in_sets(rule_drug_sets(drugs, rule_drugs, key), rules, key)


def patient_interactions(drugs: DataFrame, key: str = "patient_id") -> DataFrame:
    """Interactions with the patient's number of drugs and interactions and
    the major flag, in one pass over the distinct drugs.

    The window runs over the pairs of one patient, never more than the rule
    table has, on rows that are already partitioned by patient.
    """
    rows = tables.pair_rows() + tables.class_pair_rows()
    words, rules = _vocabulary(rows), tables.interaction_rules(drugs.sparkSession)
    named = F.when(F.col("inn").isin(words), F.col("inn"))
    sets = drugs.groupBy(key).agg(F.count("*").alias("n_active_drugs"), F.collect_set(named).alias("_drugs"))
    pairs = (
        sets.where(F.size("_drugs") > 1)
        .select(key, "n_active_drugs", "_drugs", F.explode("_drugs").alias("drug_1"))
        .join(F.broadcast(rules), "drug_1").where(F.array_contains("_drugs", F.col("drug_2"))))
    own = Window.partitionBy(key)
    return pairs.select(
        key, "drug_1", "drug_2", "severity", "description", "management", "source", "n_active_drugs",
        severity_rank(F.col("severity")).alias("severity_rank"), F.count("*").over(own).alias("n_interactions"),
        F.bool_or(F.col("severity") == "major").over(own).alias("has_major_interaction"))


def _vocabulary(rows: list[tuple]) -> list[str]:
    return sorted({d for row in rows for d in row[:2]})


def exact_interactions(drugs: DataFrame, key: str = "patient_id") -> DataFrame:
    spark = drugs.sparkSession
    return matched_pairs(drugs, tables.pair_rules(spark), _vocabulary(tables.pair_rows()), key)


def class_interactions(drugs: DataFrame, key: str = "patient_id") -> DataFrame:
    """Pairs that only a class rule covers."""
    spark = drugs.sparkSession
    return matched_pairs(drugs, tables.class_pair_rules(spark), _vocabulary(tables.class_pair_rows()), key)


def interactions(drugs: DataFrame, key: str = "patient_id") -> DataFrame:
    """Exact pairs and, for pairs without one, class rules."""
    spark = drugs.sparkSession
    rows = tables.pair_rows() + tables.class_pair_rows()
    found = matched_pairs(drugs, tables.interaction_rules(spark), _vocabulary(rows), key)
    return found.withColumn("severity_rank", severity_rank(F.col("severity")))


def document_interactions(new: DataFrame, active: DataFrame, key: str = "doc_id") -> DataFrame:
    """Interactions of each document over its own drugs and the current drugs
    of its patient. ``new``: key, patient_id, inn; ``active``: patient_id, inn.

    A patient's current rule drugs are one bounded set, so a patient with very
    many documents joins a single row, not a row per drug.
    """
    spark = new.sparkSession
    rows = tables.pair_rows() + tables.class_pair_rows()
    words = _vocabulary(rows)
    held = rule_drug_sets(active, words, "patient_id").withColumnRenamed("_drugs", "_held")
    own = new.groupBy(key, "patient_id").agg(F.collect_set(F.when(F.col("inn").isin(words), F.col("inn"))).alias("_own"))
    none = F.array().cast("array<string>")
    sets = own.join(held, "patient_id", "left").select(key, F.array_union("_own", F.coalesce("_held", none)).alias("_drugs"))
    found = pairs_in_sets(sets, tables.interaction_rules(spark), key)
    return found.withColumn("severity_rank", severity_rank(F.col("severity")))


def label_rules(labels: DataFrame, inns: DataFrame, snippet: int = I.LABEL_SNIPPET_CHARS) -> DataFrame:
    """Pairs (a < b) where the label text of a names b.

    Label texts are cut into word sequences of as many words as names have, and
    those meet the names in an equi-join of whole names. So a word that begins
    many names or lies in every label makes no pairs, only mentions do.
    ``description`` is ``snippet`` characters of the label around the first
    mention. Null labels and names make no pairs.
    """
    spark = labels.sparkSession
    known = F.broadcast(tables.interaction_rules(spark).select("drug_1", "drug_2"))
    names = cut_lineage(spark, inns.select(F.col("inn").alias("drug_2")).where(F.trim("drug_2") != "").distinct(), "names")
    # distinct numbers of words: no more than the longest name has words
    sizes = sorted(r[0] for r in names.select(F.size(F.split("drug_2", " "))).distinct().collect())
    words = F.split(F.trim(F.regexp_replace(F.lower("label_text"), r"[^a-z0-9+]+", " ")), " ")
    found = labels.select(F.col("inn").alias("drug_1"), words.alias("_words")).where(F.col("_words").isNotNull())
    grams = F.array_union(F.array().cast("array<string>"), F.flatten(F.array(*[_sequences("_words", n) for n in sizes]).cast("array<array<string>>")))
    pairs = (
        found.select("drug_1", F.explode(grams).alias("drug_2")).where(F.col("drug_1") < F.col("drug_2"))
        .join(names, "drug_2").select("drug_1", "drug_2").distinct().join(known, ["drug_1", "drug_2"], "left_anti"))
    whole = F.concat(F.lit("(?<![a-z0-9+])"), F.replace(F.replace("drug_2", F.lit("+"), F.lit("[+]")), F.lit(" "), F.lit("[^a-z0-9+]+")), F.lit("(?![a-z0-9+])"))
    at = F.regexp_instr(F.lower("label_text"), whole)
    text = F.substr("label_text", F.greatest(F.lit(1), at - F.lit(snippet // 2)), F.lit(snippet))
    return (
        pairs.join(labels.select(F.col("inn").alias("drug_1"), "label_text"), "drug_1").where(at > 0)
        .groupBy("drug_1", "drug_2").agg(F.min(F.coalesce(F.nullif(text, F.lit("")), F.lit(I.LABEL_DEFAULT_TEXT))).alias("description"))
        .select("drug_1", "drug_2", F.lit("unknown").alias("severity"), "description",
                F.lit(None).cast("string").alias("management"), F.lit(I.LABEL_SOURCE).alias("source"))
    )


def _sequences(words: str, n: int) -> Column:
    """All sequences of n neighbouring words, joined by a blank."""
    if n == 1:
        return F.col(words)
    starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
    joined = F.transform(starts, lambda i: F.array_join(F.slice(F.col(words), i, n), " "))
    return F.when(F.size(words) >= n, joined).otherwise(F.array().cast("array<string>"))


def label_interactions(drugs: DataFrame, labels: DataFrame, key: str = "patient_id") -> DataFrame:
    """Label mentions among the drugs of a key. The label table is supplied by
    the user and may be large, so both joins are left to adaptive execution."""
    rules = label_rules(labels, drugs.select("inn").distinct())
    left = drugs.join(rules.select("drug_1", "drug_2"), drugs["inn"] == F.col("drug_1")).select(key, "drug_1", "drug_2")
    right = drugs.select(F.col(key), F.col("inn").alias("drug_2"))
    return left.join(right, [key, "drug_2"], "left_semi").join(rules, ["drug_1", "drug_2"]).select(key, *rules.columns)


def summary(drugs: DataFrame, found: DataFrame, key: str = "patient_id") -> DataFrame:
    """Per key: number of drugs, interactions, and whether one is major."""
    counts = drugs.groupBy(key).agg(F.count("*").alias("n_active_drugs"))
    hits = found.groupBy(key).agg(F.count("*").alias("n_interactions"), F.bool_or(F.col("severity") == "major").alias("_major"))
    return counts.join(hits, key, "left").select(
        key, "n_active_drugs", F.coalesce("n_interactions", F.lit(0).cast("bigint")).alias("n_interactions"),
        F.coalesce("_major", F.lit(False)).alias("has_major_interaction"))


def contraindications(lines: DataFrame, reactions: DataFrame) -> DataFrame:
    """Prescribed drugs that an active reaction of the patient rules out,
    directly or through a cross-reactive drug."""
    active = reactions.where("is_active")
    banned = active.select(
        "patient_id", F.col("inn").alias("reaction_inn"), "reaction_type", "severity",
        F.explode(F.array_union(F.array("inn"), F.coalesce("cross_reactive_inns", F.array().cast("array<string>")))).alias("inn"))
    return distinct_inns_of(lines).join(banned, ["patient_id", "inn"])


def distinct_inns_of(lines: DataFrame) -> DataFrame:
    return lines.select("patient_id", F.lower("inn").alias("inn")).distinct()
