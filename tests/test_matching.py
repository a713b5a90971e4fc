"""Assignment of predictions to gold items against a plain walk over both lists."""

import difflib
import random

from pyspark.sql import functions as F

from rxweave.operators import evaluation as EV

GOLD = "drug_name string, clean_name string, dosage_value double, dosage_unit string, frequency string, route string"
PRED = "raw_drug_name string, clean_name string, inn string, dosage_value double, dosage_unit string, frequency string, route string"


def tidy(x):
    return (x or "").strip().lower()


def alike(a, b, least):
    return bool(a and b) and (a in b or b in a or difflib.SequenceMatcher(None, a, b).ratio() >= least)


def strict(g, p):
    a, b, r, s = tidy(g[0]), tidy(p[0]), tidy(g[5]), tidy(p[6])
    return (a in b or b in a) and g[2] == p[3] and tidy(g[3]) == tidy(p[4]) and alike(tidy(g[4]), tidy(p[5]), 0.7) and (r == s or (not r and s == "oral"))


def relaxed(g, p):
    a, b, inn, u, v, f, h = tidy(g[1]), tidy(p[1]), tidy(p[2]), tidy(g[3]), tidy(p[4]), tidy(g[4]), tidy(p[5])
    named = (inn and (a in inn or inn in a)) or alike(a, b, 0.5)
    return bool(named) and (g[2] is None or p[3] is None or abs(g[2] - p[3]) < 0.1) and (u == v or not u or not v) and (not f or not h or alike(f, h, 0.5))


def walk(gold, pred, fits):
    taken, out = set(), []
    for g in gold:
        hit = next((i for i, p in enumerate(pred) if i not in taken and fits(g, p)), -1)
        taken.add(hit)
        out.append(hit)
    return out


def documents(n):
    r = random.Random(3)
    names, doses, units, often, routes = ["Metformin", "metformin sr", "Atorva", "", None, " Crocin "], [500.0, 500.05, 5.0, None], ["mg", "ml", "", None], ["twice daily", "twice a day", "od", "", None], ["oral", "", None, "iv"]
    pick = r.choice
    for i in range(n):
        gold = [(pick(names), pick(names), pick(doses), pick(units), pick(often), pick(routes)) for _ in range(r.randint(0, 4))]
        pred = [(pick(names), pick(names), pick(["metformin", "", None]), pick(doses), pick(units), pick(often), pick(routes)) for _ in range(r.randint(0, 4))]
        yield i, gold, pred


def test_assignments_and_sets(spark):
    rows = list(documents(400))
    docs = spark.createDataFrame(rows, f"doc_id int, gold array<struct<{GOLD.replace(' string', ':string').replace(' double', ':double')}>>, pred array<struct<{PRED.replace(' string', ':string').replace(' double', ':double')}>>")
    got = {r["doc_id"]: r for r in EV.match_documents(docs).collect()}
    sets = {r["doc_id"]: r for r in EV.set_scores(docs.withColumn("extractor", F.lit("x")).withColumn("latency_s", F.lit(1.0))).collect()}
    conflicts = 0
    for i, gold, pred in rows:
        assert got[i]["strict"] == walk(gold, pred, strict)
        assert got[i]["relaxed"] == walk(gold, pred, relaxed)
        conflicts += any(sum(relaxed(g, p) for g in gold) > 1 for p in pred)
        for g, best in zip(gold, got[i]["best"]):
            scores = [difflib.SequenceMatcher(None, tidy(g[1]), tidy(p[1])).ratio() for p in pred]
            assert (best["pos"], round(best["ratio"], 9)) == ((scores.index(max(scores)), round(max(scores), 9)) if scores else (-1, 0.0))
        a, b = [tidy(g[0]) for g in gold if g[0]], [tidy(p[0]) for p in pred if p[0]]
        hits = sum(any(alike(x, y, 0.8) for y in b) for x in a), sum(any(alike(x, y, 0.8) for x in a) for y in b), len(a), len(b)
        assert hits == tuple(sets[i][c] for c in ("gold_hits", "pred_hits", "n_gold", "n_pred"))
    assert conflicts > 30
