"""Register and record views over the TPC-H-like test tables.

The texts run in DuckDB as they stand and in Spark SQL with the type names
replaced, so both engines start from the same inputs; what is computed from them
is written twice, once as operators and once as SQL.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

AS_OF = "2001-08-02"

BASE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz,"
    " o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,"
    " l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,"
    " l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def pick(expr: str, values: list) -> str:
    """CASE over small integers."""
    lit = [f"'{v}'" if isinstance(v, str) else str(v) for v in values]
    return "CASE " + expr + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(lit[:-1])) + f" ELSE {lit[-1]} END"


LEVER_LIST = ["labour_hours", "purchasing", "portion", "comps", "menu_price", "mix_shift", "ticket_time"]
CODE_LIST = ["LAB", "PPV", "POR", "CMP", "PRC", "MIX", "TKT"]
FSTATE_LIST = ["awaiting_decision", "detected", "investigating", "data_insufficient", "qualified", "awaiting_decision",
               "accepted", "rejected", "superseded", "converted", "expired", "invalidated"]
OUTCOME_LIST = ["verified", "verified_limited", "directional", "inconclusive", "no_effect", "negative", "guardrail_failure",
                "data_failure", "attribution_conflict", "reversed", "pending", "verified"]

VIEWS: dict[str, str] = {
    "cust": "SELECT c_custkey, 'R' || CAST(n_regionkey AS VARCHAR) AS loc FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "supp": "SELECT s_suppkey, 'R' || CAST(n_regionkey AS VARCHAR) AS loc FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "reg_locations": "SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS loc, r_name AS name, r_name AS short FROM region",
    "reg_dayparts": "SELECT DISTINCT o_orderstatus AS daypart, CASE o_orderstatus WHEN 'F' THEN CAST(4 AS DOUBLE) WHEN 'O' THEN CAST(5 AS DOUBLE) ELSE CAST(6 AS DOUBLE) END AS hours FROM orders",
    "reg_skus": "SELECT DISTINCT 'S' || CAST(p_size % 12 AS VARCHAR) AS sku, 'V' || CAST((p_size % 12) % 4 AS VARCHAR) AS vendor, 'lb' AS unit FROM part",
    "reg_menu": """SELECT p_brand AS item, max(CAST(substr(p_brand, 7) AS INTEGER)) AS brand_no,
      max(CASE WHEN CAST(substr(p_brand, 7) AS INTEGER) % 3 = 0 THEN 'S' || CAST(CAST(substr(p_brand, 7) AS INTEGER) % 12 AS VARCHAR) END) AS uses_sku,
      CAST(0.5 AS DOUBLE) AS qty_per_unit, CAST(floor(avg(p_retailprice) * 40 + 0.5) AS BIGINT) AS cost_cents FROM part GROUP BY p_brand""",
    "reg_prices": """SELECT item, DATE '1995-06-01' AS effective_on, cost_cents * 2 AS cents FROM reg_menu
      UNION ALL SELECT item, DATE '1998-01-05' AS effective_on, cost_cents * 2 + 50 AS cents FROM reg_menu
      UNION ALL SELECT item, DATE '2000-06-05' AS effective_on, cost_cents * 2 + 125 AS cents FROM reg_menu WHERE brand_no % 2 = 0""",
    "reg_recipe_costs": """SELECT item, DATE '1995-01-01' AS effective_on, cost_cents, 'file' AS source FROM reg_menu
      UNION ALL SELECT item, DATE '1997-03-03' AS effective_on, cost_cents + 12 AS cost_cents, 'file' AS source FROM reg_menu
      UNION ALL SELECT item, DATE '2001-02-05' AS effective_on, cost_cents + 31 AS cost_cents, 'file' AS source FROM reg_menu WHERE brand_no % 5 <> 0""",
    "reg_order_items": """SELECT l_orderkey AS check_id, (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS id, loc,
      CAST(o_orderdate AS DATE) AS business_date, o_orderstatus AS daypart, p_brand AS menu_item_id, CAST(l_quantity AS BIGINT) AS qty,
      CAST(floor(l_extendedprice * 100 / l_quantity + 0.5) AS BIGINT) AS unit_price_cents,
      CAST(floor(p_retailprice * 40 + 0.5) AS BIGINT) AS unit_cost_cents,
      CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS gross_cents,
      CAST(floor(l_extendedprice * l_discount * 100 + 0.5) AS BIGINT) AS comp_cents,
      CASE WHEN p_size % 5 <> 0 THEN 10 + l_tax * 100 END AS ticket_min,
      p_type AS role, l_quantity / 4 AS scheduled_hours, floor(l_quantity * (1 + l_tax) + 0.5) / 4 AS clocked_hours,
      CAST(1500 + p_size * 10 AS BIGINT) AS wage_rate_cents
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cust ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey""",
    "reg_shifts": "SELECT id, loc, business_date, daypart, role, scheduled_hours, clocked_hours, wage_rate_cents FROM reg_order_items",
    "reg_check_lines": """SELECT l_orderkey AS check_id, sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS g,
      sum(CAST(floor(l_extendedprice * l_discount * 100 + 0.5) AS BIGINT)) AS c FROM lineitem GROUP BY l_orderkey""",
    "reg_checks": """SELECT o_orderkey AS id, loc, CAST(o_orderdate AS DATE) AS business_date, o_orderstatus AS daypart,
      1 + o_custkey % 4 AS guest_count, CAST(coalesce(g, 0) - coalesce(c, 0) AS BIGINT) AS subtotal_cents,
      CAST(coalesce(c, 0) AS BIGINT) AS comp_cents, o_orderkey % 50 = 0 AS voided
      FROM orders JOIN cust ON o_custkey = c_custkey LEFT JOIN reg_check_lines ON check_id = o_orderkey""",
    "reg_visits": """SELECT o_orderkey AS id, loc, CAST(o_orderdate AS DATE) AS business_date, o_orderstatus AS daypart,
      1 + o_custkey % 4 AS guest_count FROM orders JOIN cust ON o_custkey = c_custkey""",
    "reg_reviews": "SELECT id, loc, business_date, daypart, 3 + CAST(id % 21 AS DOUBLE) / 10 AS rating FROM reg_visits WHERE id % 3 = 0",
    "reg_reservations": """SELECT max(id) AS id, loc, business_date, daypart, count(*) AS booked, CAST(sum(guest_count % 2) AS BIGINT) AS walk_in,
      CAST(12 AS DOUBLE) AS quoted_wait_min, CAST(sum(id % 2) AS BIGINT) AS abandoned,
      CAST(sum(id % 3) AS BIGINT) AS turned_away, CAST(sum(id % 10) AS DOUBLE) / 10 / count(*) AS constrained_share, 40 AS capacity,
      extract(month FROM business_date) = 12 AND extract(day FROM business_date) = 25 AS holiday
      FROM reg_visits GROUP BY loc, business_date, daypart""",
    "reg_invoices": f"""SELECT loc, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, 'S' || CAST(p_size % 12 AS VARCHAR) AS sku,
      'V' || CAST((p_size % 12) % 4 AS VARCHAR) AS vendor,
      CAST(floor(l_extendedprice * 100 / l_quantity + 0.5) AS BIGINT) AS unit_price_cents, l_quantity AS qty,
      CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS extended_cents
      FROM lineitem JOIN supp ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_shipdate < TIMESTAMP '{AS_OF} 00:00:00'""",
    # findings as records: one per customer
    "rec_findings": f"""SELECT 'F-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id, c_custkey AS k,
      CASE WHEN c_custkey % 11 = 0 THEN 'group' ELSE 'R' || CAST(n_regionkey AS VARCHAR) END AS loc,
      CASE WHEN c_custkey % 11 = 0 THEN 'R0+R1+R2+R3+R4' WHEN c_custkey % 13 = 0
        THEN 'R' || CAST(n_regionkey AS VARCHAR) || '+R' || CAST((n_regionkey + 1) % 5 AS VARCHAR)
        ELSE 'R' || CAST(n_regionkey AS VARCHAR) END AS locs_key,
      {pick("c_custkey % 7", LEVER_LIST)} AS lever, {pick("c_custkey % 7", CODE_LIST)} AS detector,
      {pick("CAST(floor(c_custkey / 7) AS BIGINT) % 12", FSTATE_LIST)} AS state,
      CASE WHEN c_custkey % 7 IN (0, 3, 6) THEN {pick("c_custkey % 3", ["F", "O", "P"])} END AS daypart,
      CASE WHEN c_custkey % 7 = 0 THEN CAST(c_custkey % 5 AS INTEGER) END AS dow,
      CASE WHEN c_custkey % 7 IN (1, 2) THEN 'S' || CAST(c_custkey % 12 AS VARCHAR) END AS sku,
      CAST(floor(abs(c_acctbal) * 10 + 0.5) AS BIGINT) AS exposure_cents, CAST(c_custkey % 30 AS INTEGER) AS evidence_count,
      CAST(c_custkey % 16 AS DOUBLE) / 2 AS effort_hours, {pick("c_custkey % 9", ["blocked", "low", "medium", "low"])} AS risk,
      CAST(c_custkey % 15 AS INTEGER) AS latency_days, c_custkey % 17 = 0 AS historical,
      c_custkey % 7 = 6 AND c_custkey % 2 = 0 AS blocked,
      {pick("c_custkey % 10", ["reduced", "holds", "unresolved", "none"])} AS overlap_status,
      CASE WHEN c_custkey % 10 = 0 THEN CAST(c_custkey % 900 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS overlap_cents,
      CASE WHEN c_custkey % 10 = 0 THEN 'F-' || lpad(CAST(c_custkey + 1 - 2 * (CAST(floor(c_custkey / 10) AS BIGINT) % 2) AS VARCHAR), 9, '0') END AS overlap_with,
      CASE WHEN c_custkey % 7 IN (4, 5) THEN NULL ELSE DATE '2001-02-01' + CAST(c_custkey % 150 AS INTEGER) END AS onset_date,
      CASE WHEN c_custkey % 7 IN (4, 5) THEN NULL ELSE DATE '2001-02-01' + CAST(c_custkey % 150 + c_custkey % 40 AS INTEGER) END AS signal_date,
      CASE WHEN c_custkey % 7 IN (3, 6) THEN 1 ELSE 7 END AS cadence_days,
      DATE '2001-03-01' + CAST(c_custkey % 150 AS INTEGER) AS detected_on,
      DATE '2001-03-01' + CAST(c_custkey % 150 + c_custkey % 10 AS INTEGER) AS decision_opened_on,
      DATE '2001-03-01' + CAST(c_custkey % 150 + c_custkey % 10 + 45 AS INTEGER) AS expires_on,
      c_name AS title FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    # earlier snapshot of two thirds of the findings
    "rec_prior": f"""SELECT id, k, {pick("CAST(floor(k / 5) AS BIGINT) % 12", FSTATE_LIST)} AS state, 'kept' AS state_reason,
      CASE WHEN k % 4 <> 0 THEN DATE '2001-01-15' + CAST(k % 90 AS INTEGER) END AS detected_on,
      CASE WHEN k % 4 = 1 THEN DATE '2001-01-20' + CAST(k % 90 AS INTEGER) END AS decision_opened_on,
      CASE WHEN k % 4 = 2 THEN DATE '2001-05-01' + CAST(k % 90 AS INTEGER) END AS expires_on,
      CASE WHEN k % 12 = 9 THEN 'IV-' || CAST(k AS VARCHAR) END AS converted_to FROM rec_findings WHERE k % 3 <> 0""",
    "rec_decisions": f"""SELECT id AS finding_id, {pick("k % 3", ["accept", "reject", "investigate"])} AS decision,
      CASE WHEN k % 3 = 1 AND k % 4 <> 0 THEN 'service_risk' END AS code, CASE WHEN k % 5 <> 0 THEN 'seen on site' END AS reason,
      CASE WHEN k % 2 = 0 THEN 'owner' ELSE 'gm' END AS role, CASE WHEN k % 4 = 0 THEN 'lead ' || CAST(k % 20 AS VARCHAR) END AS owner,
      CASE WHEN k % 6 = 0 THEN DATE '2001-08-20' END AS due_on FROM rec_findings WHERE k % 2 = 0 OR k % 5 = 0""",
    # evaluated interventions as records: one per customer
    "rec_eval_base": f"""SELECT 'IV-' || lpad(CAST(k AS VARCHAR), 9, '0') AS id, k, id AS finding_id, title, lever, loc, locs_key,
      {pick("CAST(floor(k / 3) AS BIGINT) % 12", OUTCOME_LIST)} AS outcome, CAST(floor(exposure_cents * 0.6) AS BIGINT) AS projected_cents,
      CAST(exposure_cents AS DOUBLE) * 0.4 AS effect, DATE '2001-01-03' + CAST(k % 200 AS INTEGER) AS eligible_on,
      DATE '2001-01-03' + CAST(k % 200 - 35 AS INTEGER) AS exec_on, DATE '2001-01-03' + CAST(k % 200 - 35 - k % 20 AS INTEGER) AS decided_on
      FROM rec_findings""",
    "rec_evals": """SELECT b.*,
      CASE WHEN outcome IN ('verified', 'verified_limited') THEN CASE k % 3 WHEN 0 THEN 'persistent' WHEN 1 THEN 'decayed' ELSE 'persistence_monitoring' END
        WHEN outcome = 'pending' THEN CASE k % 4 WHEN 0 THEN 'measuring' WHEN 1 THEN 'approved' WHEN 2 THEN 'evidence_pending' ELSE 'in_progress' END
        WHEN outcome IN ('no_effect', 'negative', 'directional') THEN 'failed' WHEN outcome = 'guardrail_failure' THEN 'guardrail_failed'
        WHEN outcome = 'reversed' THEN 'reversed' ELSE 'inconclusive' END AS state,
      outcome <> 'pending' AS window_closed,
      CASE WHEN outcome IN ('verified', 'verified_limited') THEN CAST(floor(effect * 0.7) AS BIGINT) END AS bookable_cents,
      CASE WHEN outcome = 'reversed' THEN CAST(floor(effect * 0.7) AS BIGINT) END AS reversed_claim_cents,
      CASE WHEN outcome = 'reversed' THEN eligible_on + CAST(k % 60 AS INTEGER) END AS reversal_on,
      CASE WHEN outcome = 'pending' THEN NULL ELSE effect END AS point, effect / 2 + 100 AS mde, effect * 0.7 AS lower_bound,
      CASE WHEN outcome IN ('verified', 'verified_limited') THEN CASE k % 3 WHEN 0 THEN 'holding' WHEN 1 THEN 'decaying' ELSE 'not_assessed' END END AS persistence_status,
      CASE WHEN outcome IN ('verified', 'verified_limited') AND k % 3 <> 2 THEN CASE k % 5 WHEN 0 THEN 'structural' WHEN 1 THEN 'durable' WHEN 2 THEN 'durable' ELSE 'upkeep' END END AS persistence_class,
      CASE WHEN outcome IN ('verified', 'verified_limited') AND k % 3 <> 2 AND k % 5 <> 0 THEN CASE WHEN k % 5 < 3 THEN CAST(8 + k % 60 AS DOUBLE) ELSE CAST(2 + k % 6 AS DOUBLE) END END AS half_life_weeks,
      CASE WHEN k % 3 = 1 THEN CAST(20 + k % 40 AS DOUBLE) / 100 ELSE CAST(60 + k % 60 AS DOUBLE) / 100 END AS retention,
      CAST(k % 7 AS INTEGER) AS checks, CAST(k % 30 AS INTEGER) AS elapsed_weeks,
      CASE WHEN outcome = 'pending' AND k % 4 = 1 THEN 'not_started' WHEN k % 7 = 0 THEN 'partial' WHEN k % 5 = 0 THEN 'modified' ELSE 'complete' END AS fidelity,
      CAST(k % 3 AS INTEGER) AS evidence_total, CAST(CASE WHEN k % 9 = 0 THEN 0 ELSE k % 3 END AS INTEGER) AS evidence_resolved,
      3 AS guardrails_total, CASE WHEN outcome = 'guardrail_failure' OR k % 31 = 0 THEN 2 ELSE 3 END AS guardrails_passed,
      CASE WHEN k % 8 = 0 THEN 2 ELSE 3 END AS guardrails_observed, CAST(1 + k % 6 AS INTEGER) AS rung,
      CAST(k % 100 AS DOUBLE) / 100 AS pre_fit, k % 19 <> 0 AS data_pass, CAST(k % 9 AS INTEGER) AS observed, 4 AS observed_of
      FROM rec_eval_base b""",
    "rec_sides": """SELECT id AS intervention_id, CASE k % 4 WHEN 0 THEN 'partial' WHEN 1 THEN 'timing' ELSE 'reconciled' END AS status,
      CAST(floor(bookable_cents * 0.9) AS BIGINT) AS observed_cents, CASE WHEN k % 4 = 1 THEN CAST(floor(bookable_cents * 0.1) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS timing_cents,
      CAST(floor(bookable_cents * 0.04) AS BIGINT) AS unexplained_cents, bookable_cents AS claim_cents FROM rec_evals WHERE bookable_cents IS NOT NULL AND k % 2 = 0""",
    "rec_actions": """SELECT 'A-' || lpad(CAST(k AS VARCHAR), 9, '0') AS id, 'IV-' || lpad(CAST(k AS VARCHAR), 9, '0') AS intervention_id, k, loc, title,
      CASE k % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'not_executed' ELSE 'open' END AS state, 'lead ' || CAST(k % 20 AS VARCHAR) AS owner,
      DATE '2001-07-01' + CAST(k % 60 AS INTEGER) AS due_on, CAST(k % 3 AS INTEGER) AS evidence_items,
      DATE '2001-07-15' + CAST(k % 10 AS INTEGER) AS done_on FROM rec_findings WHERE k % 5 <> 1""",
    "rec_adjustments": """SELECT 'ADJ-' || lpad(CAST(k AS VARCHAR), 9, '0') AS id, k, CASE k % 3 WHEN 0 THEN 'Reversal' WHEN 1 THEN 'Decay' ELSE 'Dispute' END AS kind,
      id AS intervention_id, title, loc, locs_key, -CAST(floor(effect * 0.1) AS BIGINT) AS cents,
      CASE WHEN k % 3 = 2 THEN 'open' WHEN k % 3 = 0 THEN 'credited' ELSE 'accepted' END AS status,
      eligible_on + CAST(k % 30 AS INTEGER) AS on_date FROM rec_evals WHERE k % 4 = 0""",
}

# The feed catalogue joined with what the register delivered.
FEED_ROWS = [
    # code, tier, sla hours, completeness, rule, fixed date
    ("toast_orders", "Pilot", 36, 0.99, "pos", None),
    ("toast_labour", "Pilot", 36, 0.97, "yesterday", None),
    ("recipes", "Pilot", 168, 0.96, "fixed", "2001-07-20"),
    ("invoices", "Next", 336, 0.95, "two_days", None),
    ("auth", "Pilot", None, 1.0, "today", None),
    ("scheduling", "Next", 36, 0.98, "yesterday", None),
    ("kds", "Next", 48, 0.88, "pos", None),
    ("reservations", "Next", 24, 0.93, "fixed", "2001-07-25"),
    ("reviews", "Next", 72, 0.94, "fixed", "2001-08-20"),
    ("accounting", "Next", 48, 0.9, "none", None),
]
VIEWS["rec_feed_catalogue"] = " UNION ALL ".join(
    f"SELECT '{c}' AS code, '{t}' AS tier, CAST({'NULL' if s is None else s} AS INTEGER) AS sla_hours, CAST({p} AS DOUBLE) AS completeness,"
    f" '{r}' AS newest_rule, CAST({'NULL' if d is None else chr(39) + d + chr(39)} AS DATE) AS newest"
    for c, t, s, p, r, d in FEED_ROWS
)

METRICS_BY_MOD = ["labour_per_cover", "comps_per_cover", "cm_per_cover", "net_per_cover", "ticket_min",
                  "sku_unit_price", "sku_cost_per_plate", "item_cost_per_unit"]
# intervention declarations: one per supplier, one metric kind per residue of the key
VIEWS["rec_interventions"] = f"""SELECT 'IV-' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS intervention_id, s_suppkey AS k,
      {pick("s_suppkey % 8", METRICS_BY_MOD)} AS metric, {pick("s_suppkey % 8", ["cover", "cover", "cover", "service", "cover", "sku", "sku_unit", "unit"])} AS grain,
      {pick("s_suppkey % 8", ["labour_hours", "comps", "menu_price", "mix_shift", "ticket_time", "purchasing", "portion", "menu_price"])} AS lever,
      CASE WHEN s_suppkey % 8 IN (2, 3) THEN 'up_is_saving' ELSE 'down_is_saving' END AS direction,
      CASE WHEN s_suppkey % 8 IN (1, 5) THEN 'reconcile' ELSE 'did' END AS estimator,
      s_suppkey % 8 IN (1, 2) AS weekly, 'R' || CAST(n_regionkey AS VARCHAR) AS treat_loc,
      CASE WHEN s_suppkey % 8 IN (0, 4) THEN {pick("s_suppkey % 3", ["F", "O", "P"])} END AS daypart,
      CASE WHEN s_suppkey % 16 = 0 THEN CAST(s_suppkey % 5 AS INTEGER) END AS dow,
      CASE WHEN s_suppkey % 8 = 6 THEN 'S' || CAST((s_suppkey % 4) * 3 AS VARCHAR) WHEN s_suppkey % 8 = 5 THEN 'S' || CAST(s_suppkey % 12 AS VARCHAR) END AS treat_sku,
      CASE WHEN s_suppkey % 8 = 7 THEN 'Brand#' || CAST(1 + s_suppkey % 25 AS VARCHAR) END AS treat_item,
      s_suppkey % 24 = 3 AS no_control,
      DATE '2001-03-05' + CAST(s_suppkey % 64 AS INTEGER) AS exec_on, DATE '2001-02-20' + CAST(s_suppkey % 64 AS INTEGER) AS decided_on,
      CASE WHEN s_suppkey % 8 = 6 THEN 84 ELSE 56 END AS baseline_days, 28 AS window_days, CAST((s_suppkey % 2) * 7 AS INTEGER) AS latency_days,
      4 AS min_obs, 20 AS preferred_obs, CAST(2 + s_suppkey % 4 AS INTEGER) AS rung,
      {pick("s_suppkey % 11", ["not_started", "unknown", "partial", "modified", "complete"])} AS fidelity,
      CAST(floor(abs(s_acctbal)) AS BIGINT) AS incremental_cost_cents, CAST(s_suppkey % 50 AS BIGINT) AS recurring_cost_cents,
      CAST(floor(abs(s_acctbal) * 10) AS BIGINT) AS projected_cents, CAST(s_suppkey % 30 AS BIGINT) AS overlap_cents,
      {pick("s_suppkey % 12", ["reduced", "holds", "unresolved", "none"])} AS overlap_status
      FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def needed(text: str, catalogue: Mapping[str, str]) -> list[str]:
    """Names of the catalogue a text uses, dependencies first."""
    out: list[str] = []

    def visit(body: str) -> None:
        for word in dict.fromkeys(_WORD.findall(body)):
            if word in catalogue and word not in out:
                visit(catalogue[word])
                if word not in out:
                    out.append(word)

    visit(text)
    return out


def with_views(body: str, catalogue: Mapping[str, str]) -> str:
    names = needed(body, catalogue)
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({catalogue[n]})" for n in names)
    return f"WITH RECURSIVE {ctes}\n{body}" if "RECURSIVE" in body else f"WITH {ctes}\n{body}"


def to_spark(sql: str) -> str:
    return sql.replace("VARCHAR", "STRING").replace("TIMESTAMP '", "TIMESTAMP_NTZ '")


# In Spark the rooms meet the orders first, so lines are shuffled by order and part alone.
_BY_LINE = "JOIN orders ON l_orderkey = o_orderkey JOIN cust ON o_custkey = c_custkey"
JOINED = {"reg_order_items": VIEWS["reg_order_items"].replace(_BY_LINE, "JOIN (SELECT * FROM orders JOIN cust ON o_custkey = c_custkey) ON l_orderkey = o_orderkey")}


class Inputs:
    """The views of one test folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.base = {
            name: spark.read.schema(ddl).parquet(f"{sf_dir}/{name}.parquet")
            for name, ddl in BASE_SCHEMAS.items()
        }
        self.made: dict[str, DataFrame] = {}

    def view(self, name: str) -> DataFrame:
        if name in self.base:
            return self.base[name]
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, body: str) -> DataFrame:
        for name, df in {**self.base, **self.made}.items():
            df.createOrReplaceTempView(name)
        texts = {name: text for name, text in {**VIEWS, **JOINED}.items() if name not in self.made}
        return self.spark.sql(to_spark(with_views(body, texts)))

    def staged(self, name: str) -> DataFrame:
        """A view's rows, joined and written once for all that read them in this query."""
        if name not in self.made:
            self.made[name] = stored(self.view(name), name)
        return self.made[name]

    def records(self, name: str) -> DataFrame:
        """A record view with its delimited location list as an array."""
        return self.view(name).withColumn("locs", F.split("locs_key", r"\+"))

    def menu(self) -> DataFrame:
        prices = self.view("reg_prices").groupBy("item").agg(
            F.array_sort(F.collect_list(F.struct("effective_on", "cents"))).alias("price_history")
        )
        return self.view("reg_menu").join(prices, "item", "left")

VIEWS["rec_claims"] = """SELECT id, k, locs_key, 'account ' || CAST(k % 7 AS VARCHAR) AS account, 'W' || CAST(k % 2 AS VARCHAR) AS period,
      exposure_cents AS amount_cents, CASE WHEN k % 3 = 0 THEN 1 + k % 4 END AS item_count, CASE WHEN k % 4 <> 0 THEN CAST(1 + k % 3 AS INTEGER) END AS rung,
      CASE WHEN k % 6 IN (1, 2, 3) THEN DATE '2001-01-01' + CAST(k % 100 AS INTEGER) END AS verified_at, k % 29 = 0 AS human_allocation FROM rec_findings"""
VIEWS["rec_edges"] = """SELECT CASE WHEN a.k % 2 = 0 THEN a.id ELSE b.id END AS a_id, CASE WHEN a.k % 2 = 0 THEN b.id ELSE a.id END AS b_id,
      CAST(floor(a.exposure_cents * 0.3) AS BIGINT) AS cents FROM rec_findings a JOIN rec_findings b ON b.k = a.k + 14
      UNION ALL SELECT a.id AS a_id, b.id AS b_id, CAST(floor(b.exposure_cents * 0.2) AS BIGINT) AS cents FROM rec_findings a JOIN rec_findings b ON b.k = a.k + 28
      UNION ALL SELECT a.id AS a_id, b.id AS b_id, CAST(a.exposure_cents AS BIGINT) AS cents FROM rec_findings a JOIN rec_findings b ON b.k = a.k + 42"""
VIEWS["rec_moves"] = f"""SELECT id, {pick("k % 11", FSTATE_LIST[1:])} AS from_state, state AS to_state FROM rec_findings"""
VIEWS["rec_iv_moves"] = f"""SELECT id, {pick("k % 9", ["approved", "executed", "measuring", "verified", "draft", "persistent", "scheduled", "decayed", "closed"])} AS from_state,
      {pick("CAST(floor(k / 9) AS BIGINT) % 8", ["verified", "measuring", "measurement_pending", "reversed", "approved", "closed", "in_progress", "failed"])} AS to_state FROM rec_findings"""
