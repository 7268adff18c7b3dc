"""Queries over feeds, qualification, overlap, states, decisions, actions and proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import dates
from ..operators import costing, detectors, feeds, lifecycle, overlap
from ..operators.series import in_location_scope
from ..session import attach
from .detector_queries import POR_BODY, PPV_BODY, RELAXED
from .oracle_views import ORACLE_VIEWS
from .register_queries import item_days
from .registry import query, tidy, tidy_sql
from .series_queries import fixed_sql, usd_sql
from .views import AS_OF

DAY = f"DATE '{AS_OF}'"


def values_view(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else ("true" if v else "false") if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({names})"


ORACLE_VIEWS.update(
    {
        "o_feeds": f"""SELECT code, tier, sla_hours, completeness, newest, date_diff('day', newest, {DAY}) AS age_days,
            coalesce(date_diff('day', newest, {DAY}) * 24 > sla_hours, false) AS stale FROM (
          SELECT code, tier, sla_hours, completeness, CASE newest_rule WHEN 'pos' THEN (SELECT max(business_date) FROM reg_visits) WHEN 'today' THEN {DAY} WHEN 'yesterday' THEN {DAY} - 1
            WHEN 'two_days' THEN {DAY} - 2 WHEN 'none' THEN NULL ELSE CASE WHEN newest IS NOT NULL THEN least(newest, {DAY}) END END AS newest FROM rec_feed_catalogue)""",
        "o_levers": values_view([(k, v[0], v[1], v[2], v[3]) for k, v in dims.LEVERS.items()], "lever, family, domain, factor, p_verify"),
        "o_detector_feeds": values_view([(k, f) for k, v in dims.DETECTORS.items() for f in v[3]], "detector, code"),
        "o_qualified": """SELECT f.*, x.n_feeds, coalesce(x.completeness, 0) AS completeness, coalesce(x.stale_n, 0) AS stale_n, x.stale_names,
            evidence_count >= 6 AND coalesce(x.completeness, 0) >= 0.9 AND coalesce(x.stale_n, 0) = 0 AS t_data, effort_hours <= 6 AND risk <> 'blocked' AS t_feasible,
            exposure_cents >= 6000 AS t_worth, overlap_status <> 'unresolved' AS t_overlap,
            greatest(0, floor(exposure_cents * factor + 0.5) - overlap_cents) AS recoverable_cents,
            floor(greatest(0, floor(exposure_cents * factor + 0.5) - overlap_cents) * p_verify * 0.85 / greatest(effort_hours, 0.25) + 0.5) AS ev_per_hour
          FROM rec_findings f JOIN o_levers USING (lever) LEFT JOIN (
            SELECT detector, count(*) AS n_feeds, avg(completeness) AS completeness, count(*) FILTER (stale) AS stale_n, array_to_string(list(code) FILTER (stale), '+') AS stale_names
            FROM o_detector_feeds JOIN o_feeds USING (code) GROUP BY detector) x USING (detector)""",
    }
)


def feed_table(inp):
    through = inp.view("reg_visits").agg(F.max("business_date").alias("_through"))
    rows = attach(inp.view("rec_feed_catalogue"), through)
    rows = rows.withColumn("newest", feeds.feed_newest(dates.day(AS_OF), F.col("_through"))).drop("_through")
    return feeds.feed_health(rows, AS_OF)


def findings_with_feeds(inp):
    table = dims.detectors(inp.spark).select("detector", "feeds", "equations", "guardrails", "account")
    return inp.records("rec_findings").join(F.broadcast(table), "detector")


def qualified(inp):
    return lifecycle.qualify(findings_with_feeds(inp), feed_table(inp))


@query("feed_health", tidy_sql("SELECT * FROM o_feeds", keep="code tier stale", ints="age_days", doubles="completeness", dates="newest"))
def feed_health(inp):
    return tidy(feed_table(inp).select("code", "tier", "stale", "age_days", "completeness", "newest"))


@query(
    "feed_freshness",
    tidy_sql(
        """SELECT 'toast_orders' AS code, count(*) AS rows, max(business_date) AS newest FROM reg_order_items UNION ALL SELECT 'toast_labour', count(*), max(business_date) FROM reg_shifts
        UNION ALL SELECT 'kds', count(*), max(business_date) FROM reg_order_items WHERE ticket_min IS NOT NULL UNION ALL SELECT 'reservations', count(*), max(business_date) FROM reg_reservations
        UNION ALL SELECT 'reviews', count(*), max(business_date) FROM reg_reviews UNION ALL SELECT 'invoices', count(*), max(week) FROM reg_invoices
        UNION ALL SELECT 'recipes', count(*), NULL FROM reg_recipe_costs""",
        keep="code", ints="rows", dates="newest",
    ),
)
def feed_freshness(inp):
    items = inp.view("reg_order_items")
    out = feeds.feed_freshness(
        {
            "toast_orders": (items, "business_date"), "toast_labour": (inp.view("reg_shifts"), "business_date"),
            "kds": (items.filter(F.col("ticket_min").isNotNull()), "business_date"), "reservations": (inp.view("reg_reservations"), "business_date"),
            "reviews": (inp.view("reg_reviews"), "business_date"), "invoices": (inp.view("reg_invoices"), "week"), "recipes": (inp.view("reg_recipe_costs"), None),
        }
    )
    return tidy(out)


@query(
    "baseline_status",
    tidy_sql(
        f"SELECT org, greatest(0, date_diff('day', connected_on, {DAY})) AS delivered_days, 28 AS required_days, date_diff('day', connected_on, {DAY}) >= 28 AS ready FROM (SELECT 'C' || c_custkey AS org, {DAY} - CAST(c_custkey % 60 AS INTEGER) + 10 AS connected_on FROM customer)",
        keep="org ready", ints="delivered_days required_days",
    ),
)
def baseline_status(inp):
    orgs = inp.base["customer"].select(
        F.concat(F.lit("C"), F.col("c_custkey")).alias("org"), dates.day(AS_OF).alias("as_of"),
        F.date_add(dates.day(AS_OF), (10 - F.col("c_custkey") % 60).cast("int")).alias("connected_on"),
    )
    return tidy(feeds.baseline_status(orgs).select("org", "delivered_days", "required_days", "ready"))


@query(
    "reporting_periods",
    tidy_sql(
        """SELECT o_orderkey, date_trunc('month', d - 1)::DATE AS from_date, d - 1 AS to_date, strftime(d - 1, '%B %Y') || ', month to date' AS label,
        'FY' || year(d - 1) || ' P' || month(d - 1) AS fiscal, date_trunc('month', date_trunc('month', d) - INTERVAL 1 DAY)::DATE AS closed_from,
        (date_trunc('month', d) - INTERVAL 1 DAY)::DATE AS closed_to FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
        keep="label fiscal", ints="o_orderkey", dates="from_date to_date closed_from closed_to",
    ),
)
def reporting_periods(inp):
    d = F.col("o_orderdate").cast("date")
    rows = inp.base["orders"].select("o_orderkey", dates.reporting_period(d).alias("p"), dates.closed_period(d).alias("c"))
    return tidy(rows.select("o_orderkey", "p.*", F.col("c.from_date").alias("closed_from"), F.col("c.to_date").alias("closed_to")))


@query(
    "scoped_findings",
    tidy_sql("SELECT id, loc, locs_key, state FROM rec_findings WHERE loc = 'group' OR list_has_any(string_split(locs_key, '+'), ['R1', 'R3'])", keep="id loc locs_key state"),
)
def scoped_findings(inp):
    return inp.records("rec_findings").filter(in_location_scope(["R1", "R3"])).select("id", "loc", "locs_key", "state")


_DATA_TEXT = f"""CASE WHEN stale_n > 0 THEN 'stale' ELSE 'Points ' || evidence_count || '; feeds ' || n_feeds || '; complete ' || {fixed_sql('completeness * 100', 1)} || '%' END"""


@query(
    "qualified_findings",
    tidy_sql(
        f"""SELECT *, t_data AND t_feasible AND t_worth AND t_overlap AS qualified, {_DATA_TEXT} AS data_text,
        'Recoverable per week: ' || {usd_sql('recoverable_cents')} AS worth_text FROM o_qualified""",
        keep="id qualified t_data t_feasible t_worth t_overlap data_text worth_text", ints="recoverable_cents ev_per_hour", doubles="completeness",
    ),
)
def qualified_findings(inp):
    rows = lifecycle.size_findings(qualified(inp))
    passed = lambda i: F.col("tests")[i]["passed"]
    text = F.when(F.size("stale_feeds") > 0, "stale").otherwise(F.col("tests")[0]["detail"])
    return tidy(
        rows.select(
            "id", "qualified", passed(0).alias("t_data"), passed(1).alias("t_feasible"), passed(2).alias("t_worth"), passed(3).alias("t_overlap"),
            text.alias("data_text"), F.col("tests")[2]["detail"].alias("worth_text"), "recoverable_cents", "ev_per_hour", "completeness",
        )
    )


@query(
    "overlap_edges",
    tidy_sql(
        f"""SELECT least(ppv, por) AS a_id, greatest(ppv, por) AS b_id, cents FROM (
          SELECT 'F-PPV-' || p.sku AS ppv, 'F-POR-' || u.loc || '-' || u.sku AS por, greatest(0, floor(u.excess_qty * (p.p1 - p.p0) + 0.5)) AS cents
          FROM ({PPV_BODY}) p JOIN ({POR_BODY}) u ON p.sku = u.sku WHERE p.fired AND u.fired) WHERE cents > 0""",
        keep="a_id b_id", ints="cents",
    ),
)
def overlap_edges(inp):
    price = detectors.detect_price_variance(inp.view("reg_invoices"), AS_OF, RELAXED)
    usage = detectors.detect_usage_drift(inp.view("reg_invoices"), item_days(inp), inp.menu(), inp.view("reg_skus"), AS_OF, RELAXED)
    found = detectors.findings_of("PPV", price, AS_OF).unionByName(detectors.findings_of("POR", usage, AS_OF))
    return tidy(overlap.sku_intersections(found))


@query(
    "sku_intersections",
    tidy_sql(
        f"""SELECT least(ppv, por) AS a_id, greatest(ppv, por) AS b_id, cents FROM (
          SELECT 'P-' || p.sku AS ppv, 'U-' || u.loc || '-' || u.sku AS por, greatest(0, floor(x * (p1 - p0) + 0.5)) AS cents
          FROM (SELECT sku, avg(v) FILTER (date < {DAY} - 91) AS p0, avg(v) FILTER (date >= {DAY} - 91) AS p1 FROM o_price26 GROUP BY sku) p
          JOIN (SELECT loc, sku, avg(theoretical) FILTER (date >= {DAY} - 91) * (avg(v) FILTER (date >= {DAY} - 91) - avg(v) FILTER (date < {DAY} - 91)) AS x FROM o_usage26 GROUP BY ALL) u USING (sku)) WHERE cents > 0""",
        keep="a_id b_id", ints="cents",
    ),
)
def sku_intersections(inp):
    """Shared dollars of price and usage where both are taken half a window apart, signal or not."""
    recent = inp.view("reg_invoices").filter(F.col("week") >= F.lit(dates.weeks_back(AS_OF, 26)))
    late = F.col("date") >= F.lit(dates.weeks_back(AS_OF, 13))
    mean = lambda c, test: F.avg(F.when(test, F.col(c)))
    price = costing.weekly_unit_price(recent).groupBy("sku").agg(mean("v", ~late).alias("p0"), mean("v", late).alias("p1"))
    price = price.select(F.concat(F.lit("P-"), F.col("sku")).alias("id"), F.lit("PPV").alias("detector"), "sku", "p0", "p1", F.lit(None).cast("double").alias("excess_qty"))
    usage = costing.purchased_vs_theoretical(recent, item_days(inp), inp.menu()).groupBy("loc", "sku").agg(
        (mean("theoretical", late) * (mean("v", late) - mean("v", ~late))).alias("excess_qty")
    )
    none = F.lit(None).cast("double")
    usage = usage.select(F.concat(F.lit("U-"), F.col("loc"), F.lit("-"), F.col("sku")).alias("id"), F.lit("POR").alias("detector"), "sku", none.alias("p0"), none.alias("p1"), "excess_qty")
    return tidy(overlap.sku_intersections(price.unionByName(usage)))


ORACLE_VIEWS["o_pairs"] = """SELECT a_id, b_id, a.human_allocation AS ha, b.human_allocation AS hb, a.verified_at AS va, b.verified_at AS vb, a.amount_cents AS ma, b.amount_cents AS mb,
    coalesce(a.rung, 9) AS ra, coalesce(b.rung, 9) AS rb, len(string_split(a.locs_key, '+')) * coalesce(a.item_count, 8) AS wa, len(string_split(b.locs_key, '+')) * coalesce(b.item_count, 8) AS wb,
    least(e.cents, a.amount_cents, b.amount_cents) AS shared
  FROM (SELECT least(a_id, b_id) AS a_id, greatest(a_id, b_id) AS b_id, max(cents) AS cents FROM rec_edges GROUP BY ALL) e JOIN rec_claims a ON a.id = a_id JOIN rec_claims b ON b.id = b_id
  WHERE a.account = b.account AND a.period = b.period AND list_has_any(string_split(a.locs_key, '+'), string_split(b.locs_key, '+')) AND least(e.cents, a.amount_cents, b.amount_cents) <> 0"""
ORACLE_VIEWS["o_rules"] = """SELECT *, CASE WHEN ha OR hb THEN 1 WHEN va IS NOT NULL AND vb IS NOT NULL THEN 2 WHEN wa <> wb THEN 3 WHEN ra <> rb THEN 4 ELSE 5 END AS rule FROM o_pairs"""
ORACLE_VIEWS["o_events"] = """SELECT a_id, b_id, rule, a_id AS id, b_id AS other_id, CASE WHEN rule = 5 THEN da WHEN aw THEN 0 ELSE shared END AS deduction_cents, CASE WHEN rule = 5 OR NOT aw THEN 'reduced' ELSE 'holds' END AS status FROM o_won
  UNION ALL SELECT a_id, b_id, rule, b_id, a_id, CASE WHEN rule = 5 THEN shared - da WHEN aw THEN shared ELSE 0 END, CASE WHEN rule = 5 OR aw THEN 'reduced' ELSE 'holds' END FROM o_won"""
ORACLE_VIEWS["o_won"] = """SELECT *, CASE rule WHEN 1 THEN ha WHEN 2 THEN va <= vb WHEN 3 THEN wa < wb WHEN 4 THEN ra < rb END AS aw, floor(shared * (1 - ma / (ma + mb)) + 0.5) AS da FROM o_rules"""


def claims(inp):
    items = F.when(F.col("item_count").isNotNull(), F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("item_count")), lambda i: i.cast("string")))
    return inp.records("rec_claims").withColumn("items", items)


@query(
    "overlap_events",
    tidy_sql("SELECT a_id, b_id, CAST(rule AS VARCHAR) AS rule_no, id, other_id, deduction_cents, status FROM o_events", keep="a_id b_id rule_no id other_id status", ints="deduction_cents"),
)
def overlap_events(inp):
    out = overlap.overlap_events(claims(inp), inp.view("rec_edges"))
    return tidy(out.select("a_id", "b_id", F.substring("rule", 1, 1).alias("rule_no"), "id", "other_id", "deduction_cents", "status"))


@query(
    "resolved_overlaps",
    tidy_sql(
        """SELECT c.id, coalesce(d, 0) AS overlap_cents, coalesce(n, 0) AS overlap_pairs, CASE WHEN n IS NULL THEN 'none' ELSE coalesce(last, 'holds') END AS overlap_status FROM rec_claims c LEFT JOIN (
          SELECT id, sum(deduction_cents) AS d, count(*) AS n, arg_max(status, (a_id, b_id)) FILTER (status <> 'holds') AS last FROM o_events GROUP BY id) USING (id)""",
        keep="id overlap_status", ints="overlap_cents overlap_pairs",
    ),
)
def resolved_overlaps(inp):
    return tidy(overlap.resolve_overlaps(claims(inp), inp.view("rec_edges")).select("id", "overlap_cents", "overlap_pairs", "overlap_status"))


ORACLE_VIEWS["o_states"] = f"""SELECT q.id, q.k, coalesce(p.state, CASE WHEN q.blocked THEN 'data_insufficient' WHEN NOT (t_data AND t_feasible AND t_worth AND t_overlap) THEN CASE WHEN NOT t_data THEN 'data_insufficient' ELSE 'detected' END ELSE 'awaiting_decision' END) AS state,
    coalesce(p.detected_on, q.signal_date, {DAY} - 14) AS detected_on, p.decision_opened_on AS p_open, p.expires_on AS p_exp, p.converted_to, q.onset_date, q.cadence_days, q.recoverable_cents, p.id IS NOT NULL AS had_prior
  FROM o_qualified q LEFT JOIN rec_prior p USING (id)"""
ORACLE_VIEWS["o_windows"] = f"""SELECT *, coalesce(p_exp, opened + 45) AS expires_on FROM (
  SELECT *, coalesce(p_open, least(greatest(detected_on, coalesce(onset_date + CAST(6 * cadence_days AS INTEGER), detected_on)), {DAY})) AS opened FROM o_states)"""


def stateful(inp):
    return lifecycle.decision_window(lifecycle.assign_states(lifecycle.size_findings(qualified(inp)), inp.view("rec_prior")), AS_OF)


@query(
    "finding_states",
    tidy_sql("SELECT id, state, detected_on, opened AS decision_opened_on, expires_on, coalesce(converted_to, '') AS converted_to FROM o_windows", keep="id state converted_to", dates="detected_on decision_opened_on expires_on"),
)
def finding_states(inp):
    return tidy(stateful(inp).select("id", "state", "detected_on", "decision_opened_on", "expires_on", F.coalesce("converted_to", F.lit("")).alias("converted_to")))


@query(
    "expired_findings",
    f"SELECT id, CASE WHEN state = 'awaiting_decision' AND expires_on < {DAY} THEN 'expired' ELSE state END AS state, CASE WHEN state = 'awaiting_decision' AND expires_on < {DAY} THEN 'No decision inside the 45-day window.' ELSE '' END AS note FROM o_windows",
)
def expired_findings(inp):
    out = lifecycle.expire_stale(stateful(inp), AS_OF)
    return out.select("id", "state", F.when(F.col("state_reason").startswith("No decision"), F.col("state_reason")).otherwise(F.lit("")).alias("note"))


ORACLE_VIEWS["o_finding_edges"] = values_view([(a, b) for a, bs in dims.FINDING_EDGES.items() for b in bs], "from_state, to_state")
ORACLE_VIEWS["o_iv_edges"] = values_view([(a, b) for a, bs in dims.INTERVENTION_EDGES.items() for b in bs], "from_state, to_state")
ORACLE_VIEWS["o_paths"] = values_view([(a, b, "+".join(h)) for a, b, h in dims.finding_paths()], "from_state, to_state, hops")


@query(
    "transition_violations",
    """SELECT 'finding' AS kind, m.id, from_state, to_state FROM rec_moves m ANTI JOIN o_finding_edges USING (from_state, to_state)
    UNION ALL SELECT 'intervention', m.id, from_state, to_state FROM rec_iv_moves m ANTI JOIN o_iv_edges USING (from_state, to_state)""",
)
def transition_violations(inp):
    a = lifecycle.validate_transitions(inp.view("rec_moves"), "finding").withColumn("kind", F.lit("finding"))
    b = lifecycle.validate_transitions(inp.view("rec_iv_moves"), "intervention").withColumn("kind", F.lit("intervention"))
    return a.unionByName(b).select("kind", "id", "from_state", "to_state")


@query("transition_paths", "SELECT id, from_state, to_state, coalesce(hops, 'none') AS hops FROM rec_moves LEFT JOIN o_paths USING (from_state, to_state)")
def transition_paths(inp):
    return lifecycle.with_paths(inp.view("rec_moves")).select("id", "from_state", "to_state", F.coalesce(F.array_join("hops", "+"), F.lit("none")).alias("hops"))


ORACLE_VIEWS["o_judged"] = """SELECT d.finding_id, d.decision, f.state, CASE
    WHEN decision = 'reject' THEN CASE WHEN code IS NULL OR reason IS NULL THEN 'reason_required' WHEN f.state <> 'awaiting_decision' THEN 'illegal_transition' END
    WHEN decision = 'investigate' THEN CASE WHEN reason IS NULL THEN 'reason_required' WHEN f.state NOT IN ('detected', 'awaiting_decision') THEN 'illegal_transition' END
    ELSE CASE WHEN recoverable_cents >= 25000 AND role = 'gm' THEN 'approval_tier' WHEN f.state IN ('converted', 'data_insufficient', 'rejected', 'superseded', 'expired', 'invalidated') THEN 'illegal_transition'
      WHEN f.blocked THEN 'blocked' WHEN overlap_status = 'unresolved' THEN 'overlap_unresolved' END END AS refusal
  FROM rec_decisions d JOIN o_qualified f ON f.id = d.finding_id"""
ORACLE_VIEWS["o_opened"] = """SELECT finding_id, 'IV-' || CAST(row_number() OVER (ORDER BY finding_id) + (SELECT max(CAST(regexp_extract(intervention_id, '^IV-(\\d+)$', 1) AS BIGINT)) FROM rec_interventions) AS VARCHAR) AS intervention_id
  FROM o_judged WHERE decision = 'accept' AND refusal IS NULL"""


@query(
    "applied_decisions",
    """SELECT f.id, CASE WHEN j.finding_id IS NULL OR refusal IS NOT NULL THEN f.state WHEN decision = 'accept' THEN 'converted' WHEN decision = 'reject' THEN 'rejected' ELSE 'investigating' END AS state,
    coalesce(o.intervention_id, '') AS converted_to, coalesce(refusal, 'none') AS refusal FROM rec_findings f LEFT JOIN o_judged j ON j.finding_id = f.id LEFT JOIN o_opened o ON o.finding_id = f.id""",
)
def applied_decisions(inp):
    rows = lifecycle.size_findings(findings_with_feeds(inp))
    updated, refused, _ = lifecycle.apply_decisions(rows, inp.view("rec_decisions"), inp.view("rec_interventions"), AS_OF, "intervention_id")
    out = updated.select("id", "state", F.coalesce("converted_to", F.lit("")).alias("converted_to"))
    return out.join(refused.select(F.col("finding_id").alias("id"), "refusal"), "id", "left").withColumn("refusal", F.coalesce("refusal", F.lit("none")))


@query(
    "decision_audit",
    tidy_sql(
        """SELECT finding_id AS entity_id, step, hop AS event, coalesce(lag(hop) OVER (PARTITION BY finding_id ORDER BY step), state) AS from_state FROM (
          SELECT finding_id, state, unnest(list) AS hop, unnest(range(1, len(list) + 1)) AS step FROM (
            SELECT finding_id, j.state, string_split(coalesce(hops, goal), '+') AS list FROM (SELECT *, CASE decision WHEN 'accept' THEN 'converted' WHEN 'reject' THEN 'rejected' ELSE 'investigating' END AS goal FROM o_judged WHERE refusal IS NULL) j
              LEFT JOIN o_paths p ON p.from_state = j.state AND p.to_state = goal))""",
        keep="entity_id event from_state", ints="step",
    ),
)
def decision_audit(inp):
    judged = lifecycle.judge_decisions(lifecycle.size_findings(findings_with_feeds(inp)), inp.view("rec_decisions"), AS_OF)
    return tidy(lifecycle.decision_audit(judged, AS_OF).select("entity_id", "event", "from_state", "step"))


@query(
    "completed_actions",
    f"""SELECT a.id, CASE WHEN state = 'open' AND evidence_items > 0 AND k % 2 = 0 THEN 'done' ELSE state END AS state,
    CASE WHEN k % 2 = 0 AND state <> 'open' THEN 'illegal_transition' WHEN k % 2 = 0 AND evidence_items = 0 THEN 'evidence_required' ELSE 'none' END AS refusal FROM rec_actions a""",
)
def completed_actions(inp):
    actions = inp.view("rec_actions")
    given = actions.filter("k % 2 = 0").select("id", "done_on", "evidence_items")
    out = lifecycle.complete_actions(actions.drop("done_on"), given, inp.view("rec_interventions"), inp.view("rec_feed_catalogue"), AS_OF)
    return (
        out["actions"].select("id", "state").join(out["refused"], "id", "left").withColumn("refusal", F.coalesce("refusal", F.lit("none")))
    )


@query(
    "executed_declarations",
    tidy_sql(
        """SELECT i.intervention_id, CASE WHEN fidelity = 'not_started' AND d.intervention_id IS NOT NULL THEN 'complete' ELSE fidelity END AS fidelity,
        CASE WHEN fidelity = 'not_started' AND d.intervention_id IS NOT NULL THEN d.done_on ELSE exec_on END AS exec_on FROM rec_interventions i
        LEFT JOIN (SELECT intervention_id, done_on FROM rec_actions WHERE state = 'open' AND evidence_items > 0) d USING (intervention_id)""",
        keep="intervention_id fidelity", dates="exec_on",
    ),
)
def executed_declarations(inp):
    actions = inp.view("rec_actions")
    out = lifecycle.complete_actions(actions.drop("done_on"), actions.select("id", "done_on", "evidence_items"), inp.view("rec_interventions"), inp.view("rec_feed_catalogue"), AS_OF)
    return tidy(out["interventions"].select("intervention_id", "fidelity", "exec_on"))


@query(
    "proposed_plans",
    tidy_sql(
        """SELECT id AS finding_id, CASE lever WHEN 'comps' THEN 'comps_per_cover' WHEN 'labour_hours' THEN 'labour_per_cover' WHEN 'purchasing' THEN 'sku_unit_price' WHEN 'portion' THEN 'sku_cost_per_plate' ELSE 'cm_per_cover' END AS metric,
        CASE lever WHEN 'purchasing' THEN 'sku' WHEN 'portion' THEN 'sku_unit' ELSE 'cover' END AS grain, CASE WHEN lever IN ('menu_price', 'ticket_time', 'mix_shift') THEN 'up_is_saving' ELSE 'down_is_saving' END AS direction,
        lever IN ('comps', 'menu_price', 'ticket_time', 'mix_shift') AS weekly, CASE lever WHEN 'purchasing' THEN 'reconcile' ELSE 'did' END AS estimator, CASE lever WHEN 'portion' THEN 84 ELSE 56 END AS baseline_days,
        CASE WHEN lever IN ('menu_price', 'mix_shift') THEN 7 WHEN lever = 'ticket_time' THEN 3 WHEN latency_days > 7 THEN 7 ELSE 0 END AS latency_days,
        CASE WHEN lever IN ('comps', 'labour_hours', 'ticket_time') THEN daypart ELSE 'any' END AS dayparts, lever NOT IN ('purchasing', 'labour_hours') AS control_others,
        CASE WHEN lever = 'labour_hours' THEN array_to_string(list_filter([1, 2, 3, 4], lambda d: d <> dow), '+') ELSE 'any' END AS control_dows, CASE WHEN recoverable_cents >= 25000 THEN 'Owner' ELSE 'Operator' END AS approval_tier FROM o_qualified""",
        keep="finding_id metric grain direction weekly estimator dayparts control_others control_dows approval_tier", ints="baseline_days latency_days",
    ),
)
def proposed_plans(inp):
    out = lifecycle.propose_interventions(lifecycle.size_findings(findings_with_feeds(inp)), AS_OF)
    return tidy(
        out.select(
            "finding_id", "metric", "grain", "direction", "weekly", "estimator", "baseline_days", "latency_days",
            F.coalesce(F.array_join("treat_dayparts", "+"), F.lit("any")).alias("dayparts"), "control_others",
            F.coalesce(F.array_join(F.col("control_dows").cast("array<string>"), "+"), F.lit("any")).alias("control_dows"), "approval_tier",
        )
    )


@query(
    "control_skus",
    """SELECT t.sku AS treat_sku, array_to_string(list_sort(list_sort(list(s.sku))[1:4]), '+') AS control_skus FROM (SELECT DISTINCT sku FROM rec_findings WHERE sku IS NOT NULL) t
    JOIN reg_skus v ON v.sku = t.sku JOIN reg_skus s ON s.vendor = v.vendor AND s.sku <> t.sku GROUP BY t.sku""",
)
def control_skus(inp):
    out = lifecycle.propose_interventions(lifecycle.size_findings(findings_with_feeds(inp)), AS_OF)
    return lifecycle.control_skus(out, inp.view("reg_skus")).select("treat_sku", F.array_join("control_skus", "+").alias("control_skus"))


@query(
    "audit_diff",
    "SELECT n.id AS entity_id, CASE WHEN p.id IS NULL THEN 'detected' ELSE n.state END AS event, coalesce(p.state, 'none') AS from_state, n.state AS to_state FROM rec_findings n LEFT JOIN rec_prior p USING (id) WHERE p.id IS NULL OR p.state <> n.state",
)
def audit_diff(inp):
    after = inp.view("rec_findings").withColumn("state_reason", F.lit("re-run"))
    out = lifecycle.audit_diff(inp.view("rec_prior"), after, AS_OF)
    return out.select("entity_id", "event", F.coalesce("from_state", F.lit("none")).alias("from_state"), "to_state")


@query(
    "opening_audit",
    tidy_sql(
        """SELECT id AS entity_id, detected_on AS on_date, 'detected' AS event, CASE WHEN historical THEN 'awaiting_decision' ELSE 'detected' END AS to_state FROM rec_findings
        UNION ALL SELECT id, decision_opened_on, 'qualified', 'awaiting_decision' FROM rec_findings WHERE NOT historical AND state NOT IN ('detected', 'data_insufficient')
        UNION ALL SELECT id, detected_on, 'data_insufficient', 'data_insufficient' FROM rec_findings WHERE NOT historical AND state = 'data_insufficient'
        UNION ALL SELECT id, expires_on, 'expired', 'expired' FROM rec_findings WHERE NOT historical AND state = 'expired'""",
        keep="entity_id event to_state", dates="on_date",
    ),
)
def opening_audit(inp):
    rows = inp.view("rec_findings").withColumn("state_reason", F.lit("kept")).withColumn("converted_to", F.lit(None).cast("string"))
    return tidy(lifecycle.opening_audit(rows).select("entity_id", "event", "to_state", "on_date"))


@query(
    "next_ids",
    tidy_sql(
        "SELECT id, 'A-' || CAST(row_number() OVER (ORDER BY id) + (SELECT max(CAST(substr(id, 3) AS BIGINT)) FROM rec_actions) AS VARCHAR) AS new_id FROM rec_findings WHERE state = 'accepted'",
        keep="id new_id",
    ),
)
def next_ids(inp):
    fresh = inp.view("rec_findings").filter("state = 'accepted'").select("id")
    return lifecycle.next_ids(inp.view("rec_actions"), fresh, "A", "id").select("id", "new_id")
