"""Brand names to generic names: exact, then fuzzy.

The fuzzy step must find every brand whose similarity ratio reaches the
cut-off. A ratio r of a name of length n and a brand of length m leaves at most
b = (1 - r)(n + m) characters unmatched, and an even number of them if n + m is
even. With the brand cut into b + 1 pieces, there is a first piece i such that
just i unmatched characters lie before it and none inside it. So the piece
occurs unchanged in the name, moved by i - 2j if j of the i are the brand's;
how many are the brand's and the name's in all follows from n, m and b, and
bounds j. Names meet brands on (brand length, number of pieces, piece number,
piece text): an equi-join without loss, with some b * b / 4 + b + 1 rows per name and brand length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rxweave.functions.names import clean_name, first_word
from rxweave.functions.similarity import sequence_ratio
from rxweave.refdata import prescribing as P

_SLACK = 1 - P.FUZZY_RATIO


def _budget(n: Column, m: Column) -> Column:
    """Unmatched characters a pair of these lengths may have: as many as the cut-off leaves, odd or even as n + m is."""
    most = F.floor((n + m) * F.lit(_SLACK) + F.lit(1e-9)).cast("int")
    return most - (most + n + m) % 2


def _longest_partner(n: Column) -> Column:
    return F.floor(n * F.lit((1 + _SLACK) / (1 - _SLACK)) + F.lit(1e-9)).cast("int")


def _shortest_partner(n: Column) -> Column:
    return F.ceil(n * F.lit((1 - _SLACK) / (1 + _SLACK)) - F.lit(1e-9)).cast("int")


def _partners(n: Column) -> Column:
    """Lengths that can reach the cut-off with a name or brand of length n."""
    return F.sequence(_shortest_partner(n), _longest_partner(n))


def _start(m: Column, pieces: Column, i: Column) -> Column:
    return F.floor(i * m / pieces).cast("int")


def _numbers(k: Column) -> Column:
    return F.sequence(F.lit(0), k - 1)


def brand_pieces(brands: DataFrame) -> DataFrame:
    """The index: each brand cut into every number of pieces that some name length asks for. No shuffle."""
    m, k, i = F.col("m"), F.col("k"), F.col("i")
    base = brands.select("brand_name", F.length("brand_name").alias("m")).where(m > 0)
    cuts = base.select("*", F.explode(F.array_distinct(F.transform(_partners(m), lambda n: _budget(n, m) + 1))).alias("k")).where(k <= m)
    pieces = cuts.select("*", F.explode(_numbers(k)).alias("i"))
    start, end = _start(m, k, i), _start(m, k, i + 1)
    return pieces.select("brand_name", "m", "k", "i", F.substring("brand_name", start + 1, end - start).alias("piece"))


def name_pieces(names: DataFrame, brands: DataFrame) -> DataFrame:
    """Where in each name a piece of a brand can lie, for every brand length there is."""
    n, m, k, i, j, at = (F.col(c) for c in ("n", "m", "k", "i", "j", "at"))
    probes = names.select("name", F.length("name").alias("n")).where(n >= P.FUZZY_MIN_LENGTH)
    lengths = probes.select("*", F.explode(_partners(n)).alias("m")).join(brands.select(F.length("brand_name").alias("m")).distinct(), "m")
    cut = lengths.withColumn("k", _budget(n, m) + 1).select("*", F.explode(_numbers(k)).alias("i"))
    of_brand, of_name = ((k - 1 + m - n) / 2).cast("int"), ((k - 1 - m + n) / 2).cast("int")
    low, high = F.greatest(F.lit(0), i - of_name), F.least(i, of_brand)
    moved = cut.where(low <= high).select("*", F.explode(F.sequence(low, high)).alias("j")).withColumn("at", _start(m, k, i) + i - 2 * j)
    size = _start(m, k, i + 1) - _start(m, k, i)
    fits = (at >= 0) & (at + size <= n) & (F.abs(n - m - (i - 2 * j)) <= k - 1 - i)
    return moved.where(fits).select("name", "m", "k", "i", F.substring("name", at + 1, size).alias("piece"))


def candidate_pairs(names: DataFrame, brands: DataFrame) -> DataFrame:
    """Name and brand pairs that share a piece, and so may reach the cut-off."""
    return name_pieces(names, brands).join(brand_pieces(brands), ["m", "k", "i", "piece"]).select("name", "brand_name").distinct()


def fuzzy_candidates(names: DataFrame, brands: DataFrame) -> DataFrame:
    """Name and brand pairs whose ratio reaches the cut-off."""
    close = candidate_pairs(names, brands).where(F.levenshtein("name", "brand_name") <= _budget(F.length("name"), F.length("brand_name")))
    scored = close.withColumn("ratio", sequence_ratio(F.col("brand_name"), F.col("name")))
    return scored.where(F.col("ratio") >= P.FUZZY_RATIO)


def fuzzy_top(names: DataFrame, brands: DataFrame) -> DataFrame:
    """Up to three most similar brands per name, with their edit distance."""
    order = Window.partitionBy("name").orderBy(F.col("ratio").desc(), F.col("brand_name").desc())
    ranked = fuzzy_candidates(names, brands).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= P.FUZZY_CANDIDATES).withColumn("edits", F.levenshtein("name", "brand_name"))


def fuzzy_lookup(names: DataFrame, brands: DataFrame) -> DataFrame:
    """Best brand per name: of the top three, the one with fewest edits."""
    best = fuzzy_top(names, brands).where(F.col("edits") <= P.FUZZY_EDITS)
    chosen = best.groupBy("name").agg(F.min_by(F.struct("brand_name", "edits"), F.struct("edits", "rank")).alias("b"))
    return chosen.select("name", "b.*").join(brands, "brand_name").select("name", "brand_name", "edits", "inn")


def exact_lookup(names: DataFrame, brands: DataFrame) -> DataFrame:
    return names.join(brands.select(F.col("brand_name").alias("name"), "inn"), "name")


def lookup(names: DataFrame, brands: DataFrame) -> DataFrame:
    """Generic name for each distinct name: exact, else fuzzy; no row if none."""
    exact = exact_lookup(names, brands)
    rest = names.join(brands.select(F.col("brand_name").alias("name")), "name", "left_anti")
    return exact.unionByName(fuzzy_lookup(rest, brands).select("name", "inn"))


def normalize_drugs(lines: DataFrame, brands: DataFrame, name_column: str = "raw_drug_name") -> DataFrame:
    """Lines with their generic name.

    Whole names go first, then first words; what is still unknown keeps the
    cleaned name. Each distinct name is resolved once.
    """
    cleaned = lines.withColumn("_name", clean_name(F.col(name_column)))
    distinct = cleaned.select(F.col("_name").alias("name")).where(F.col("_name") != "").distinct()
    words = distinct.select("name", first_word(F.col("name")).alias("word"))
    # one lookup for whole names and first words together
    probes = distinct.unionByName(words.select(F.col("word").alias("name"))).distinct()
    known = lookup(probes, brands)
    resolved = (
        words.join(known.select("name", F.col("inn").alias("whole_inn")), "name", "left")
        .join(known.select(F.col("name").alias("word"), F.col("inn").alias("word_inn")), "word", "left")
        .select(F.col("name").alias("_name"), F.coalesce("whole_inn", "word_inn", "name").alias("inn")))
    base = cleaned.drop("inn") if "inn" in lines.columns else cleaned
    return base.join(resolved, "_name", "left").withColumn("inn", F.coalesce("inn", "_name")).drop("_name")


def concept_enrich(lines: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concept id and display name from a snapshot table; the INN otherwise."""
    return lines.join(concepts, "inn", "left").withColumn("standard_name", F.coalesce("standard_name", "inn"))
