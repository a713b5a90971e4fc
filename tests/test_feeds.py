"""Change feeds against loops that take one change after the other."""

import random

import pytest
from pyspark.sql import functions as F

from rxweave.operators import rule_changes as RC
from rxweave.plans import resolution as RS
from rxweave.refdata import tables
from rxweave.operators.running import ANY, LAST, SUM, running

FIELD_TYPES = ("drug_inn string, analyte_name string, operator string, threshold_value double, threshold_value_max double, flag_match string, gender_specific string, severity string, "
               "description_template string, management_plan string, is_enabled boolean")


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_running_values(spark, block):
    r = random.Random(block)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), i, r.choice([None, 1, 2]), r.choice([None, "x", "y"]), r.random() < 0.05) for i in range(-1, 300)]
    df = spark.createDataFrame(rows, "k string, n long, v int, t string, b boolean")
    got = running(df, ["k"], "n", {"total": (SUM, F.col("v")), "seen": (ANY, F.col("b")), "last": (LAST, F.col("t"))}, block).collect()
    assert len(got) == len(rows)
    for x in got:
        before = [y for y in rows if y[0] == x.k and y[1] < x.n]
        last = [y[3] for y in before if y[3] is not None]
        assert (x.total, x.seen, x.last) == (sum(y[2] or 0 for y in before), any(y[4] for y in before), last[-1] if last else None)


def fields(threshold):
    return ("Metformin", "tsh", ">", threshold, None, None, "both", "warning", "d", "p", True)


def plain_fold(rules, changes):
    """One change after the other: verdicts, and the versions of each rule."""
    held = {r[0]: {"name": r[1], "version": r[-1], "deleted": r[-2], "versions": [(r[-1], r[1], r[5], None)], "ends": {}} for r in rules}
    out = []
    for seq, at, _, change, rule_id, name, *rest in changes:
        rule, name = held.get(rule_id), name
        taken = any(x["name"] == name for i, x in held.items() if i != rule_id)
        if change == "create":
            problem = "id_exists" if rule else "name_exists" if taken else None
        elif change in ("update", "delete"):
            problem = "not_found" if not rule or rule["deleted"] else "name_exists" if change == "update" and name != rule["name"] and taken else None
        else:
            problem = "unknown_change"
        version = rule["version"] if rule else None
        if problem is None:
            if change == "create":
                held[rule_id] = rule = {"name": name, "version": 1, "deleted": False, "versions": [(1, name, rest[3], at)], "ends": {}}
            elif change == "update":
                rule["ends"][rule["version"]] = at
                rule["version"] += 1
                rule["name"] = name
                rule["versions"].append((rule["version"], name, rest[3], at))
            else:
                rule["ends"][rule["version"]] = at
                rule["deleted"] = True
            version = rule["version"]
        out.append((seq, problem, version if problem is None else None))
    history = sorted((i, v, n, t, at, x["ends"].get(v), x["deleted"] and v == x["version"]) for i, x in held.items() for v, n, t, at in x["versions"])
    return out, history


CHANGES = f"seq long, at int, clinician_id long, change string, rule_id string, rule_name string, {FIELD_TYPES}"
RULES = f"rule_id string, rule_name string, {FIELD_TYPES}, is_deleted boolean, version int"


def folded(spark, rules, changes, block=1 << 16):
    return RC.fold_changes(spark.createDataFrame(rules, RULES), spark.createDataFrame(changes, CHANGES), block)


@pytest.mark.parametrize("seed", range(3))
def test_rule_changes_equal_the_loop(spark, seed):
    r = random.Random(seed)
    rules = [(f"r{i}", f"n{i}", *fields(1.0), i == 2, i + 1) for i in range(4)]
    ids, names = [f"r{i}" for i in range(7)], [f"n{i}" for i in range(7)]
    changes = [(i, 1000 + i, 5, r.choices(["create", "update", "delete", "merge"], (4, 8, 2, 0.3))[0], r.choice(ids), r.choice(names), *fields(float(i))) for i in range(70)]
    out = folded(spark, rules, changes, (5, 1 << 16, 20)[seed])
    verdicts, history = plain_fold(rules, changes)
    got = sorted((x.seq, x.problem, x.version if x.problem is None else None) for x in out["changes"].collect())
    assert got == verdicts and len({v[1] for v in verdicts}) > 3
    rows = sorted((x.rule_id, x.version, x.rule_name, x.threshold_value, x.valid_from, x.valid_to, x.is_deleted) for x in out["history"].collect())
    assert rows == history
    newest = {h[0]: h for h in history}
    assert sorted((x.rule_id, x.version, x.rule_name, x.is_deleted) for x in out["current"].collect()) == sorted((h[0], h[1], h[2], h[6]) for h in newest.values())
    assert out["audit"].count() == sum(v[1] is None for v in verdicts)


@pytest.mark.parametrize("rounds, group_rows", [(6, 1 << 16), (1, 1 << 16), (6, 12), (2, 8)])
def test_groups_of_rule_changes_equal_the_loop(spark, rounds, group_rows):
    """Many small groups, a long chain of names and a large group: folded by group, or judged in rounds."""
    r = random.Random(group_rows)
    rules = [(f"r{g}-{i}", f"n{g}-{i}", *fields(1.0), i == 1, g + 1) for g in range(8) for i in range(2)]
    keys = [(f"r{g}-{r.randrange(4)}", f"n{g}-{r.randrange(4)}") for g in range(8) for _ in range(9 if g else 30)] + [(f"c{i}", f"d{i + k}") for i in range(12) for k in (0, 1)]
    r.shuffle(keys)
    changes = [(i, i, 5, r.choices(["create", "update", "delete", "merge"], (4, 6, 2, 0.3))[0], *k, *fields(0.5)) for i, k in enumerate(keys)]
    judged = RC.judge_changes(spark.createDataFrame(rules, RULES), spark.createDataFrame(changes, CHANGES), 7, rounds, group_rows).where("change <> 'base'")
    got = sorted((x.seq, x.problem, x.version if x.problem is None else None) for x in judged.collect())
    assert got == plain_fold(rules, changes)[0]


def test_small_groups_are_not_judged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(RC, "_judged", lambda *a: pytest.fail("judged in rounds"))
    changes = [(i, i, 5, ("create", "update", "delete")[i // 20 % 3], f"r{i % 20}", f"n{i % 20}", *fields(0.5)) for i in range(120)]
    assert folded(spark, [], changes)["audit"].count() == 60


def test_one_name_through_a_feed(spark):
    """Create, rename, delete and re-create one name; two changes to one rule give two versions."""
    feed = [("create", "a", "N"), ("create", "b", "N"), ("update", "a", "M"), ("create", "b", "N"), ("update", "a", "N"), ("delete", "b", None), ("update", "a", "N"),
            ("create", "c", "N"), ("update", "a", "M"), ("update", "b", "K"), ("delete", "a", "x"), ("delete", "a", "x"), ("create", "d", "M")]
    changes = [(i, i, 1, c, rule, name, *fields(i + 0.5)) for i, (c, rule, name) in enumerate(feed)]
    out = folded(spark, [], changes)
    got = {x.seq: (x.problem, x.version) for x in out["changes"].collect()}
    assert [got[i][0] for i in range(13)] == [None, "name_exists", None, None, "name_exists", None, "name_exists", "name_exists", None, "not_found", None, "not_found", "name_exists"]
    assert got[2][1] == 2 and got[8][1] == 3 and got[10][1] == 3
    texts = {x.change_id: (x.action, x.override_reason) for x in out["audit"].collect()}
    assert texts[0] == ("create_rule", "Created clinical safety rule v1: N (Drug: Metformin, Analyte: tsh, Op: > Val: 0.5, Severity: warning, Enabled: True)")
    assert texts[8][1].startswith("Updated clinical safety rule v3: M (") and texts[10] == ("delete_rule", "Soft-deleted clinical safety rule v3: M")
    current = {x.rule_id: (x.rule_name, x.version, x.is_deleted, x.drug_inn, x.analyte_name, x.valid_to) for x in out["current"].collect()}
    assert current == {"a": ("M", 3, True, "metformin", "TSH", 10), "b": ("N", 1, True, "metformin", "TSH", 5)}
    empty = folded(spark, [], [])
    assert all(df.count() == 0 for df in empty.values())


# --- resolutions ------------------------------------------------------------------------

def resolution_inputs(spark):
    queue = spark.createDataFrame(
        [(1, 7, 5, "prescription", False, "x"), (2, 7, 5, "prescription", False, "y"), (3, 8, None, "prescription", False, "z"), (4, 8, 9, "prescription", False, None),
         (5, 8, 5, "lab", False, None), (6, 8, 5, "prescription", True, None), (7, None, 5, "prescription", False, None)],
        "item_id long, patient_id long, facility_id int, item_type string, resolved boolean, note string")
    clinicians = spark.createDataFrame([(10, "rx"), (11, "lab"), (12, "both"), (13, "both")], "clinician_id long, scopes string")
    bridge = spark.createDataFrame([(10, 5), (10, 6), (11, 5), (12, 5), (12, 5), (13, 2)], "clinician_id long, facility_id int")
    feed = spark.createDataFrame(
        [(1, 1, 10, 7, None), (2, 1, 10, 7, "  "), (3, 1, 12, 7, "agreed"), (4, 1, 10, 7, "again"), (5, 2, 11, 7, "r"), (6, 4, 10, 8, "r"), (7, 3, 13, 8, None), (8, 5, 12, 8, None), (9, 6, 10, 8, None),
         (10, 99, 10, 8, None), (11, 2, 77, 8, None), (12, 7, 10, None, None), (13, 2, 13, 7, None)],
        "seq long, item_id long, clinician_id long, patient_id long, override_reason string").withColumns(
        {"doctor_reg": F.lit("MH1"), "patient_age": F.lit("40"), "diagnosis": F.lit(None).cast("string"), "prescription_date": F.lit("03/02/2024")})
    lines = spark.createDataFrame([(s, n, name, 5.0) for s in range(1, 14) for n, name in enumerate(["Painawai", "Sugarlow"])], "seq long, line_no int, raw_drug_name string, dosage_value double")
    brands = spark.createDataFrame([("painaway", "ibuprofen"), ("sugarlow", "metformin")], "brand_name string, inn string")
    active = spark.createDataFrame([(7, "warfarin")], "patient_id long, inn string")
    labs = spark.createDataFrame([(9, "TSH", 1.0, "u", "r", "f")], "patient_id long, analyte_name string, value double, unit string, ref_range string, flag string")
    return feed, lines, queue, clinicians, bridge, brands, active, labs, tables.baseline_rules(spark).where("false")


def test_resolutions_as_tables(spark):
    out = RS.resolve_prescriptions(*resolution_inputs(spark))
    told = {x.seq: (x.outcome, x.problem) for x in out["outcomes"].collect()}
    assert told == {
        1: ("rejected", "override_required"), 2: ("rejected", "override_required"), 3: ("resolved", None), 4: ("refused", "closed"), 5: ("refused", "scope"), 6: ("refused", "facility"),
        7: ("resolved", None), 8: ("refused", "wrong_type"), 9: ("refused", "closed"), 10: ("refused", "item_not_found"), 11: ("refused", "clinician_not_found"), 12: ("resolved", None), 13: ("refused", "facility")}
    rx = {x.item_id: (x.rx_id, x.patient_id, x.facility_id, x.confidence, str(x.prescription_date)) for x in out["prescriptions"].collect()}
    assert rx == {1: ("resolution-3", 7, 5, 1.0, "2024-02-03"), 3: ("resolution-7", 8, None, 1.0, "2024-02-03"), 7: ("resolution-12", None, 5, 1.0, "2024-02-03")}
    assert {(x.rx_id, x.line_no, x.inn, x.is_active) for x in out["medications"].collect()} == {(f"resolution-{s}", n, inn, True) for s in (3, 7, 12) for n, inn in enumerate(["ibuprofen", "metformin"])}
    assert [(x.rx_id, x.drug_1, x.drug_2) for x in out["interactions"].collect()] == [("resolution-3", "ibuprofen", "warfarin")]
    audit = {x.item_id: (x.clinician_id, x.facility_id, x.action, x.override_reason, x.needs_admin_oversight) for x in out["audit"].collect()}
    assert audit == {1: (12, 5, "override_safety", "agreed", True), 3: (13, 2, "resolve_rx", None, False), 7: (10, 5, "resolve_rx", None, False)}


def test_only_touched_buckets_are_written(spark, tmp_path):
    inputs = resolution_inputs(spark)
    out, path = RS.resolve_prescriptions(*inputs), str(tmp_path / "queue")
    extra = spark.range(100, 400).selectExpr("id AS item_id", "1L AS patient_id", "5 AS facility_id", "'lab' AS item_type", "false AS resolved", "'n' AS note")
    RS.store_queue(inputs[2].unionByName(extra), path, 64)
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "queue").rglob("*.parquet")}
    before = files()
    touched = RS.store_resolutions(spark, str(tmp_path / "out"), 0, out, path, 64)
    after = files()
    rewritten = {f.parent.name for f in after if after[f] != before.get(f)}
    assert rewritten == {f"bucket={k}" for k in touched} and 0 < len(touched) <= 3 and len(before) > 30
    rows = {x.item_id: (x.resolved, x.patient_id, x.note) for x in spark.read.parquet(path).collect()}
    assert len(rows) == 307 and [i for i, r in rows.items() if r[0]] != [] and {i for i, r in rows.items() if r[0]} == {1, 3, 6, 7}
    assert rows[1] == (True, 7, "x") and rows[2] == (False, 7, "y") and rows[7] == (True, None, None)
    RS.store_resolutions(spark, str(tmp_path / "out"), 0, out, path, 64)  # repeated
    assert {x.item_id: (x.resolved, x.patient_id, x.note) for x in spark.read.parquet(path).collect()} == rows
    assert spark.read.parquet(str(tmp_path / "out" / "prescriptions")).count() == 3
    none = {k: v.where("false") for k, v in out.items()}
    assert RS.close_items(spark, path, none["queue"], 64) == []
