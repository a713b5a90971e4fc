"""Queries over change feeds: rule changes and resolutions, as the tables that they leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from rxweave import bindings as B
from rxweave.catalog.base import query
from rxweave.catalog.core import active_drugs, keyed_alerts, latest, rule_table
from rxweave.catalog.sqlbind import sql
from rxweave.catalog.texts import brand_table
from rxweave.operators import rule_changes as RC
from rxweave.plans import resolution as RS
from rxweave.session import shared_folder

# --- rule changes -----------------------------------------------------------------------

def _rest():
    """The fields that all rules share here."""
    fields = {"operator": F.lit(">"), "threshold_value_max": F.lit(None).cast("double"), "flag_match": F.lit(None).cast("string"), "gender_specific": F.lit("both"),
              "severity": F.lit("warning"), "description_template": F.lit("{value}"), "management_plan": F.lit("plan"), "is_enabled": F.lit(True)}
    return [c.alias(n) for n, c in fields.items()]


def folded_rules(spark, sf):
    """A rule per customer, and each order as a change to one of four rules and names of its customer."""
    key, owner = F.col("o_orderkey"), F.col("o_custkey")
    slot = lambda n: F.floor(key / n) % 4
    feed = B.read(spark, sf, "orders").select(
        key.alias("seq"), F.to_date("o_orderdate").alias("at"), (key % 10).alias("clinician_id"),
        F.when(key % 10 < 4, "create").when(key % 10 < 8, "update").otherwise("delete").alias("change"),
        F.concat(F.lit("c"), owner, F.lit("-"), slot(10)).alias("rule_id"), F.concat(F.lit("Rule "), owner, F.lit("-"), slot(7)).alias("rule_name"),
        F.lit("Metformin").alias("drug_inn"), F.lit("tsh").alias("analyte_name"), (key % 13 + 0.5).cast("double").alias("threshold_value"), *_rest())
    who = F.col("c_custkey")
    rules = B.read(spark, sf, "customer").select(
        F.concat(F.lit("c"), who, F.lit("-0")).alias("rule_id"), F.concat(F.lit("Rule "), who, F.lit("-0")).alias("rule_name"), F.lit("metformin").alias("drug_inn"),
        F.lit("TSH").alias("analyte_name"), F.lit(1.0).alias("threshold_value"), *_rest(), (who % 11 == 0).alias("is_deleted"), (who % 3 + 1).cast("int").alias("version"))
    return RC.fold_changes(rules, feed)


_RULES = dict(
    rfeed="""SELECT o_orderkey AS seq, o_custkey AS g, CASE WHEN o_orderkey % 10 < 4 THEN 'create' WHEN o_orderkey % 10 < 8 THEN 'update' ELSE 'delete' END AS change, CAST(o_orderdate AS DATE) AS happened,
        'c' || o_custkey || '-' || (o_orderkey // 10 % 4) AS rule_id, 'Rule ' || o_custkey || '-' || (o_orderkey // 7 % 4) AS rule_name, o_orderkey % 13 + 0.5::DOUBLE AS threshold_value,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders""",
    # every customer's rules as a list, one change after the other
    rfold="""SELECT c_custkey AS g, CAST(0 AS BIGINT) AS n, [{'id': 'c' || c_custkey || '-0', 'name': 'Rule ' || c_custkey || '-0', 'version': CAST(c_custkey % 3 + 1 AS INTEGER), 'deleted': c_custkey % 11 = 0}] AS held,
          CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS problem, CAST(NULL AS INTEGER) AS version, CAST(NULL AS VARCHAR) AS old_name FROM customer
        UNION ALL SELECT g, n, CASE WHEN problem IS NOT NULL THEN held WHEN change = 'create' THEN list_append(held, {'id': rule_id, 'name': rule_name, 'version': CAST(1 AS INTEGER), 'deleted': FALSE})
          ELSE list_transform(held, lambda x: CASE WHEN x.id <> rule_id THEN x WHEN change = 'update' THEN {'id': x.id, 'name': rule_name, 'version': CAST(x.version + 1 AS INTEGER), 'deleted': FALSE}
            ELSE {'id': x.id, 'name': x.name, 'version': x.version, 'deleted': TRUE} END) END,
          seq, problem, CASE WHEN problem IS NULL THEN CASE change WHEN 'create' THEN CAST(1 AS INTEGER) WHEN 'update' THEN CAST(me.version + 1 AS INTEGER) ELSE me.version END END, me.name
        FROM (SELECT *, CASE change WHEN 'create' THEN CASE WHEN me IS NOT NULL THEN 'id_exists' WHEN taken THEN 'name_exists' END
              WHEN 'update' THEN CASE WHEN me IS NULL OR me.deleted THEN 'not_found' WHEN me.name <> rule_name AND taken THEN 'name_exists' END
              ELSE CASE WHEN me IS NULL OR me.deleted THEN 'not_found' END END AS problem
          FROM (SELECT c.*, f.held, list_filter(f.held, lambda x: x.id = c.rule_id)[1] AS me, len(list_filter(f.held, lambda x: x.name = c.rule_name)) > 0 AS taken
                FROM rfold f JOIN rfeed c ON c.g = f.g AND c.n = f.n + 1))""",
    rdone="SELECT c.*, f.problem, f.version, f.old_name FROM rfold f JOIN rfeed c ON c.seq = f.seq",
    rsteps="""SELECT rule_id, seq, change, version, rule_name, threshold_value, happened FROM rdone WHERE problem IS NULL
        UNION ALL SELECT 'c' || c_custkey || '-0', -1, CASE WHEN c_custkey % 11 = 0 THEN 'gone' ELSE 'base' END, CAST(c_custkey % 3 + 1 AS INTEGER), 'Rule ' || c_custkey || '-0', 1.0, NULL FROM customer""")


@query("rule_change_audit", sql("""SELECT seq, rule_id, change, problem, version, CASE WHEN problem IS NOT NULL THEN NULL WHEN change = 'delete' THEN 'Soft-deleted clinical safety rule v' || version || ': ' || old_name
      ELSE CASE change WHEN 'create' THEN 'Created' ELSE 'Updated' END || ' clinical safety rule v' || version || ': ' || rule_name || ' (Drug: Metformin, Analyte: tsh, Op: > Val: ' || printf('%.1f', threshold_value) || ', Severity: warning, Enabled: True)' END AS override_reason
    FROM rdone""", **_RULES))
def rule_change_audit(spark, sf):
    """Every change of an ordered feed with its verdict, version and audit text."""
    out = folded_rules(spark, sf)
    audit = out["audit"].select(F.col("change_id").alias("seq"), "override_reason")
    told = out["changes"].select("seq", "rule_id", "change", "problem", F.when(F.col("problem").isNull(), F.col("version")).alias("version"))
    return told.join(audit, "seq", "left")


@query("rule_history", sql("""SELECT rule_id, version, rule_name, threshold_value, CAST(happened AS VARCHAR) AS valid_from, CAST(next_at AS VARCHAR) AS valid_to, change = 'gone' OR coalesce(next_change = 'delete', FALSE) AS is_deleted
    FROM (SELECT *, lead(happened) OVER w AS next_at, lead(change) OVER w AS next_change FROM rsteps WINDOW w AS (PARTITION BY rule_id ORDER BY seq)) WHERE change <> 'delete'""", **_RULES))
def rule_history(spark, sf):
    """All versions of all rules after the feed."""
    text = lambda c: F.col(c).cast("string").alias(c)
    return folded_rules(spark, sf)["history"].select("rule_id", "version", "rule_name", "threshold_value", text("valid_from"), text("valid_to"), "is_deleted")


# --- resolutions ------------------------------------------------------------------------

def resolution_attempts(spark, sf):
    """Each queue item once without a reason, and every second one again with one."""
    queue = B.review_queue(spark, sf)
    key = F.col("item_id")
    feed = queue.select(
        "item_id", "patient_id", (key % 10).alias("clinician_id"), F.explode(F.when(key % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"),
        F.lit("MH1").alias("doctor_reg"), F.lit("40").alias("patient_age"), F.lit("Fever").alias("diagnosis"), F.date_format("created_at", "dd/MM/yyyy").alias("prescription_date"))
    feed = feed.select("*", (key * 2 + F.col("again")).alias("seq"), F.when(F.col("again") == 1, "agreed with patient").when(key % 4 == 1, "  ").alias("override_reason")).drop("again")
    fields = ["line_no", "raw_drug_name", "dosage_value", "dosage_unit", "frequency", "freq_per_day", "duration_days", "route"]
    lines = B.medication_lines(spark, sf).select(F.col("rx_id").alias("item_id"), *fields).join(feed.select("item_id", "seq"), "item_id").drop("item_id")
    return queue, feed, lines


def resolved(spark, sf):
    queue, feed, lines = resolution_attempts(spark, sf)
    return queue, RS.resolve_prescriptions(feed, lines, queue, B.clinicians(spark, sf), B.clinician_facilities(spark, sf), brand_table(spark), active_drugs(spark, sf), latest(spark, sf), rule_table(spark, sf))


_RESOLVE = dict(
    item_drugs="SELECT DISTINCT q.item_id, q.patient_id, m.inn FROM review_queue q JOIN medications m ON m.rx_id = q.item_id", drugs="SELECT * FROM item_drugs WHERE patient_id IS NOT NULL", **keyed_alerts("item_id"),
    item_all="SELECT item_id, inn FROM item_drugs UNION SELECT i.item_id, a.inn FROM item_drugs i JOIN active_drugs a ON a.patient_id = i.patient_id",
    item_pairs="SELECT a.item_id, a.inn AS drug_1, b.inn AS drug_2 FROM item_all a JOIN item_all b ON a.item_id = b.item_id AND a.inn < b.inn",
    item_found="SELECT p.*, r.severity FROM item_pairs p JOIN (SELECT * FROM pair_rules UNION ALL SELECT * FROM class_rules) r ON r.drug_1 = p.drug_1 AND r.drug_2 = p.drug_2",
    item_state="""SELECT q.*, q.item_id % 10 AS clinician_id, coalesce(f.major, FALSE) AS has_major, coalesce(a.critical, FALSE) AS has_critical, coalesce(f.n, 0) AS n_interactions, coalesce(a.n, 0) AS n_alerts,
        h.home, CASE WHEN c.s_suppkey IS NULL THEN 'clinician_not_found' WHEN q.facility_id IS NOT NULL AND m.facility_id IS NULL THEN 'facility'
          WHEN c.s_suppkey % 3 = 1 THEN 'scope' WHEN q.item_type <> 'prescription' THEN 'wrong_type' WHEN q.resolved THEN 'closed' END AS barred
        FROM review_queue q LEFT JOIN supplier c ON c.s_suppkey = q.item_id % 10
        LEFT JOIN clinician_facilities m ON m.clinician_id = q.item_id % 10 AND m.facility_id = q.facility_id
        LEFT JOIN (SELECT clinician_id, min(facility_id) AS home FROM clinician_facilities GROUP BY 1) h ON h.clinician_id = q.item_id % 10
        LEFT JOIN (SELECT item_id, bool_or(severity = 'major') AS major, count(*) AS n FROM item_found GROUP BY 1) f ON f.item_id = q.item_id LEFT JOIN alerts_of a ON a.item_id = q.item_id""",
    firsts="SELECT *, item_id * 2 + again AS first_pass FROM (SELECT *, CASE WHEN barred IS NOT NULL THEN NULL WHEN NOT (has_major OR has_critical) THEN 0 WHEN item_id % 2 = 0 THEN 1 END AS again FROM item_state)",
    told="SELECT *, item_id * 2 AS seq FROM firsts UNION ALL SELECT *, item_id * 2 + 1 FROM firsts WHERE item_id % 2 = 0",
    done="SELECT *, first_pass AS seq, 'resolution-' || first_pass AS rx_id, has_major OR has_critical AS needs FROM firsts WHERE first_pass IS NOT NULL")


@query("resolution_outcomes", sql("""SELECT seq, item_id, clinician_id, patient_id, CASE WHEN barred IS NULL THEN has_major ELSE FALSE END AS has_major, CASE WHEN barred IS NULL THEN has_critical ELSE FALSE END AS has_critical,
      CASE WHEN barred IS NULL THEN n_interactions ELSE 0 END AS n_interactions, CASE WHEN barred IS NULL THEN n_alerts ELSE 0 END AS n_alerts,
      CASE WHEN seq = first_pass THEN 'resolved' WHEN barred IS NOT NULL OR seq > first_pass THEN 'refused' ELSE 'rejected' END AS outcome,
      CASE WHEN seq = first_pass THEN NULL WHEN barred IS NOT NULL THEN barred WHEN seq > first_pass THEN 'closed' ELSE 'override_required' END AS problem FROM told""", **_RESOLVE))
def resolution_outcomes(spark, sf):
    """What became of every attempt, refused ones included."""
    return resolved(spark, sf)[1]["outcomes"]


@query("resolved_prescriptions", sql("SELECT rx_id, item_id, patient_id, facility_id, CAST(created_at AS VARCHAR) AS prescription_date, 1.0::DOUBLE AS confidence FROM done", **_RESOLVE))
def resolved_prescriptions(spark, sf):
    rows = resolved(spark, sf)[1]["prescriptions"]
    return rows.select("rx_id", "item_id", "patient_id", "facility_id", F.col("prescription_date").cast("string").alias("prescription_date"), "confidence")


@query("resolved_lines", sql("""SELECT d.rx_id, m.line_no, m.inn, m.raw_drug_name, m.dosage_value, m.duration_days, m.route, CAST(NULL AS VARCHAR) AS severity FROM done d JOIN medications m ON m.rx_id = d.item_id
    UNION ALL SELECT d.rx_id, NULL, f.drug_1, f.drug_2, NULL, NULL, NULL, f.severity FROM done d JOIN item_found f ON f.item_id = d.item_id""", **_RESOLVE))
def resolved_lines(spark, sf):
    """Stored medication lines, and interactions in the form (rx_id, inn: one drug, raw_drug_name: the other, severity)."""
    out = resolved(spark, sf)[1]
    lines = out["medications"].select("rx_id", "line_no", "inn", "raw_drug_name", "dosage_value", "duration_days", "route", F.lit(None).cast("string").alias("severity"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    found = out["interactions"].select("rx_id", none("line_no", "int"), F.col("drug_1").alias("inn"), F.col("drug_2").alias("raw_drug_name"), none("dosage_value", "double"), none("duration_days", "int"), none("route", "string"), "severity")
    return lines.unionByName(found)


@query("resolution_audit", sql("""SELECT clinician_id, coalesce(facility_id, home) AS facility_id, item_id, CASE WHEN needs THEN 'override_safety' ELSE 'resolve_rx' END AS action,
    CASE WHEN needs THEN 'agreed with patient' END AS override_reason, needs AS needs_admin_oversight FROM done""", **_RESOLVE))
def resolution_audit(spark, sf):
    return resolved(spark, sf)[1]["audit"]


@query("queue_after_resolutions", sql("SELECT q.item_id, q.patient_id, q.facility_id, q.item_type, q.resolved OR d.item_id IS NOT NULL AS resolved FROM review_queue q LEFT JOIN done d ON d.item_id = q.item_id", **_RESOLVE))
def queue_after_resolutions(spark, sf):
    """The stored queue after the merge, of which only touched buckets were written."""
    path, out = shared_folder(spark, "queue"), shared_folder(spark, "resolutions")
    queue, tables = resolved(spark, sf)
    RS.store_queue(queue, path)
    RS.store_resolutions(spark, out, 0, tables, path)
    return spark.read.parquet(path).select("item_id", "patient_id", "facility_id", "item_type", "resolved")
