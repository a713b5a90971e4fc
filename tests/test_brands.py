"""Fuzzy brand lookup against brute force."""

import difflib
import random

from rxweave.operators import brands as BR


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(name, brands):
    if len(name) < 3:
        return None
    best = None
    for candidate in difflib.get_close_matches(name, brands, n=3, cutoff=0.82):
        d = edits(name, candidate)
        if d <= 2 and (best is None or d < best[1]):
            best = (candidate, d)
    return best


def noisy(rng, word):
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(word) + 1)
        word = rng.choice([word[:at] + rng.choice("abcxyz ") + word[at:], word[:at] + word[at + 1:], word[:at] + rng.choice("abcxyz") + word[at + 1:]])
    return word


def test_fuzzy_equals_brute_force(spark):
    rng = random.Random(5)
    stems = ["gluco", "metfor", "ator", "rosu", "am", "cardi", "pan", "levo", "x", "ab"]
    brands = sorted({rng.choice(stems) + "".join(rng.choice("abelmnorstv") for _ in range(rng.randint(0, 14))) for _ in range(250)})
    names = sorted({noisy(rng, rng.choice(brands)) for _ in range(400)} - {""})
    table = spark.createDataFrame([(b, "inn of " + b) for b in brands], "brand_name string, inn string")
    rest = [n for n in names if n not in set(brands)]
    got = {r.name: (r.brand_name, r.edits) for r in BR.fuzzy_lookup(spark.createDataFrame([(n,) for n in rest], "name string"), table).collect()}
    want = {n: b for n in rest if (b := brute(n, brands))}
    assert len(want) > 100 and got == want


def test_candidates_are_complete(spark):
    """No pair at or above the cut-off is missed, however many edits it has."""
    rng = random.Random(9)
    brands = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 16))) for _ in range(150)})
    names = sorted({noisy(rng, rng.choice(brands)) for _ in range(150)} - {""})
    table = spark.createDataFrame([(b, "i") for b in brands], "brand_name string, inn string")
    got = {(r.name, r.brand_name) for r in BR.fuzzy_candidates(spark.createDataFrame([(n,) for n in names], "name string"), table).collect()}
    want = {(n, b) for n in names if len(n) >= 3 for b in brands if difflib.SequenceMatcher(None, b, n).ratio() >= 0.82}
    assert got == want


def words(rng, n, low, high):
    return sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high))) for _ in range(n)})


def test_pairs_are_few_before_the_ratio(spark):
    """3,000 names, half of them misspelt brands, against 2,000 brands: below 1 % of all pairs, and the best three are those of brute force."""
    rng = random.Random(21)
    brands = words(rng, 2000, 4, 16)
    names = sorted({*(noisy(rng, rng.choice(brands)) for _ in range(1600)), *words(rng, 1500, 4, 16)} - {""})[:3000]
    table = spark.createDataFrame([(b, "inn") for b in brands], "brand_name string, inn string").repartition(4).cache()
    written = spark.createDataFrame([(n,) for n in names], "name string").repartition(4).cache()
    assert BR.candidate_pairs(written, table).count() < 0.01 * len(names) * len(brands)
    got = {}
    for r in sorted(BR.fuzzy_top(written, table).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["name"], []).append(r["brand_name"])
    asked = names[::10]
    assert {n: got.get(n, []) for n in asked} == {n: difflib.get_close_matches(n, brands, n=3, cutoff=0.82) for n in asked}


def test_rows_of_a_name(spark):
    """Probes per name grow with its length, and stay few for names as long as brands are."""
    brands = spark.createDataFrame([("x" * m, "i") for m in range(1, 41)], "brand_name string, inn string")
    names = spark.createDataFrame([("y" * n,) for n in (2, 3, 10, 20, 30, 80)], "name string")
    rows = {len(r["name"]): r["count"] for r in BR.name_pieces(names, brands).groupBy("name").count().collect()}
    assert set(rows) == {3, 10, 20, 30} and rows[3] <= 4 and rows[10] <= 40 and rows[20] <= 200


def test_cascade(spark):
    table = spark.createDataFrame([("glycomet", "metformin"), ("glycomet gp", "metformin + glipizide"), ("crocin", "paracetamol")], "brand_name string, inn string")
    written = ["Tab. Glycomet SR 500mg", "GLYCOMET GP", "Crocim", "glycomett forte", "Unknownium", "Tab. "]
    lines = spark.createDataFrame([(i, w) for i, w in enumerate(written)], "i int, raw_drug_name string")
    got = [r.inn for r in BR.normalize_drugs(lines, table).orderBy("i").collect()]
    assert got[:5] == ["metformin", "metformin + glipizide", "paracetamol", "metformin", "unknownium"]
