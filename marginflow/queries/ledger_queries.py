"""Queries over the ledger, the queue, confidence, listings and sentences."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import dims
from ..operators import contract, ledger, persistence, report
from .lifecycle_queries import feed_table, lifecycle, qualified, values_view
from .measure_queries import KEY, records
from .oracle_views import ORACLE_VIEWS
from .registry import query, tidy, tidy_sql
from .series_queries import fixed_sql, usd_sql
from .views import AS_OF

DAY = f"DATE '{AS_OF}'"
SINCE, THROUGH, FEE = "2001-07-01", "2001-07-31", 490000


def findings(inp):
    return lifecycle.size_findings(qualified(inp))


def sides(inp):
    return inp.view("rec_sides")


def adjustments(inp):
    return inp.records("rec_adjustments")


def cents_in(cents: str, scope: str = "scope") -> str:
    """Cents of a claim inside a scope, by largest remainder over its rooms."""
    n = "len(string_split(locs_key, '+'))"
    at = f"(list_position(string_split(locs_key, '+'), {scope}) - 1)"
    part = f"abs({cents}) // {n} + CASE WHEN {at} < abs({cents}) % {n} THEN 1 ELSE 0 END"
    return f"CASE WHEN {scope} = 'all' THEN {cents} WHEN list_contains(string_split(locs_key, '+'), {scope}) THEN sign({cents}) * ({part}) ELSE 0 END"


IN_SCOPE = "(scope = 'all' OR loc = 'group' OR list_contains(string_split(locs_key, '+'), scope))"
HELD = "bookable_cents IS NOT NULL"
LASTING = "persistence_status IS NOT NULL AND persistence_status <> 'decaying'"

ORACLE_VIEWS.update(
    {
        "o_scopes": "SELECT 'all' AS scope UNION ALL SELECT loc FROM reg_locations",
        "o_period": f"SELECT id, CAST(floor(sum(y) + 0.5) AS BIGINT) AS period_cents FROM o_decay WHERE date BETWEEN DATE '{SINCE}' AND DATE '{THROUGH}' GROUP BY id",
        "o_evals": """SELECT e.*, r.realized_cents, CAST(r.annual_run_rate_cents AS BIGINT) AS annual_run_rate_cents, s.status AS side_status, s.observed_cents AS side_cents, coalesce(period_cents, 0) AS period_cents
          FROM rec_evals e JOIN (SELECT id, CAST(realized_cents AS BIGINT) AS realized_cents, annual_run_rate_cents FROM o_realized) r USING (id) LEFT JOIN rec_sides s ON s.intervention_id = e.id LEFT JOIN o_period USING (id)""",
        "o_ff": "SELECT f.*, s.scope FROM (SELECT *, CAST(recoverable_cents AS BIGINT) AS rec FROM o_qualified) f, o_scopes s WHERE " + IN_SCOPE,
        "o_ef": "SELECT e.*, s.scope, CAST(greatest(0, floor(coalesce(point, 0) + 0.5)) AS BIGINT) AS measured FROM o_evals e, o_scopes s WHERE " + IN_SCOPE,
        "o_af": "SELECT a.*, s.scope FROM rec_adjustments a, o_scopes s WHERE " + IN_SCOPE,
        "o_fee": f"SELECT scope, {FEE} * (CASE WHEN scope = 'all' THEN 1.0 ELSE 1.0 / (SELECT count(*) FROM reg_locations) END) * 31 / 31 AS fee FROM o_scopes",
    }
)


def evals(inp):
    return persistence.realize(records(inp), AS_OF)


OPEN = str(ledger.OPEN)
_KPI_F = f"""SELECT scope, sum(CASE WHEN state IN {OPEN} THEN {cents_in('exposure_cents')} ELSE 0 END) AS exposure, count(*) FILTER (state IN {OPEN}) AS openf,
  sum(CASE WHEN state IN ('awaiting_decision', 'accepted', 'converted') AND NOT historical THEN {cents_in('rec')} ELSE 0 END) AS recoverable FROM o_ff GROUP BY scope"""
_KPI_E = f"""SELECT scope, sum(CASE WHEN state IN ('approved', 'scheduled', 'in_progress', 'evidence_pending') THEN {cents_in('projected_cents')} ELSE 0 END) AS approved,
  sum(CASE WHEN state IN ('measuring', 'measurement_pending', 'executed') THEN {cents_in('projected_cents')} ELSE 0 END) AS active, sum(CASE WHEN window_closed AND point IS NOT NULL THEN {cents_in('measured')} ELSE 0 END) AS measured,
  sum(CASE WHEN {HELD} THEN {cents_in('bookable_cents')} ELSE 0 END) AS verified, sum(CASE WHEN {HELD} THEN {cents_in('realized_cents')} ELSE 0 END) AS realized,
  sum(CASE WHEN {HELD} AND {LASTING} THEN {cents_in('period_cents')} ELSE 0 END) AS persistent, sum(CASE WHEN {HELD} AND {LASTING} THEN {cents_in('annual_run_rate_cents')} ELSE 0 END) AS runrate,
  sum(CASE WHEN {HELD} AND side_status = 'reconciled' THEN {cents_in('side_cents')} ELSE 0 END) AS rc, count(*) FILTER ({HELD} AND side_status = 'reconciled') AS rn, count(*) FILTER ({HELD}) AS vn FROM o_ef GROUP BY scope"""


@query(
    "kpis_by_scope",
    tidy_sql(
        f"""SELECT scope, kpi, value FROM (SELECT scope, CAST(persistent AS DOUBLE) AS persistent, coalesce(persistent / nullif(floor(fee + 0.5), 0), 0) AS multiple, CAST(verified AS DOUBLE) AS verified, CAST(realized AS DOUBLE) AS realized, CAST(runrate AS DOUBLE) AS runrate,
          CAST(adj AS DOUBLE) AS adjustments, CAST(rc AS DOUBLE) AS "reconciledValue", coalesce(rn / nullif(vn, 0), 0) AS recon, CAST(measured AS DOUBLE) AS measured, CAST(active AS DOUBLE) AS active, CAST(approved AS DOUBLE) AS approved, CAST(recoverable AS DOUBLE) AS recoverable,
          CAST(exposure AS DOUBLE) AS exposure, CAST(openf AS DOUBLE) AS openf, CAST(overdue AS DOUBLE) AS overdue, (SELECT avg(completeness) FROM o_feeds WHERE tier = 'Pilot') AS dq
          FROM o_scopes JOIN ({_KPI_F}) USING (scope) JOIN ({_KPI_E}) USING (scope) JOIN (SELECT scope, sum(CASE WHEN status <> 'open' THEN {cents_in('cents')} ELSE 0 END) AS adj FROM o_af GROUP BY scope) USING (scope)
          JOIN (SELECT scope, count(*) AS overdue FROM rec_actions, o_scopes WHERE state = 'open' AND due_on < {DAY} AND (scope = 'all' OR loc = scope OR loc = 'group') GROUP BY scope) USING (scope) JOIN o_fee USING (scope))
        UNPIVOT (value FOR kpi IN (persistent, multiple, verified, realized, runrate, adjustments, "reconciledValue", recon, measured, active, approved, recoverable, exposure, openf, overdue, dq))""",
        keep="scope kpi", doubles="value",
    ),
)
def kpis_by_scope(inp):
    out = ledger.kpis(
        findings(inp), evals(inp), inp.view("rec_actions"), adjustments(inp), feed_table(inp), sides(inp), inp.view("reg_locations"), AS_OF, SINCE, THROUGH, FEE
    )
    return tidy(out.select("scope", "kpi", "value"))


_RAN = "fidelity IN ('complete', 'modified', 'partial') AND state NOT IN ('approved', 'scheduled')"
_VER = "(bookable_cents IS NOT NULL OR reversed_claim_cents IS NOT NULL)"


@query(
    "funnel",
    tidy_sql(
        f"""SELECT *, coalesce(lag(n) OVER (PARTITION BY scope ORDER BY pos) - n, 0) AS lost FROM (
          SELECT scope, 0 AS pos, 'Detected' AS stage, count(*) AS n, sum({cents_in('exposure_cents')}) AS cents FROM o_ff GROUP BY scope
          UNION ALL SELECT scope, 1, 'Qualified', count(*), sum({cents_in('rec')}) FROM o_ff WHERE t_data AND t_feasible AND t_worth AND t_overlap GROUP BY scope
          UNION ALL SELECT scope, 2, 'Accepted', count(*), sum({cents_in('rec')}) FROM o_ff WHERE state IN ('accepted', 'converted') OR id IN (SELECT finding_id FROM rec_evals WHERE k % 2 = 0) GROUP BY scope
          UNION ALL SELECT scope, 3, 'Executed', count(*), sum({cents_in('projected_cents')}) FROM o_ef WHERE {_RAN} GROUP BY scope
          UNION ALL SELECT scope, 4, 'Measured', count(*), sum({cents_in('measured')}) FROM o_ef WHERE window_closed AND point IS NOT NULL GROUP BY scope
          UNION ALL SELECT scope, 5, 'Verified', count(*), sum({cents_in('coalesce(bookable_cents, reversed_claim_cents)')}) FROM o_ef WHERE {_VER} GROUP BY scope
          UNION ALL SELECT scope, 6, 'Persistent', count(*), sum({cents_in('coalesce(bookable_cents, 0)')}) FROM o_ef WHERE {_VER} AND {LASTING} GROUP BY scope
          UNION ALL SELECT scope, 7, 'Reconciled', count(*), sum({cents_in('side_cents')}) FROM o_ef WHERE {_VER} AND side_status = 'reconciled' GROUP BY scope)""",
        keep="scope stage", ints="pos n cents lost",
    ),
)
def funnel(inp):
    # Every other evaluation names a finding that is not in the list, so some findings have none.
    linked = F.when(F.col("k") % 2 == 0, F.col("finding_id")).otherwise(F.lit("none"))
    out = ledger.funnel(findings(inp), evals(inp).withColumn("finding_id", linked), sides(inp), inp.view("reg_locations"))
    return tidy(out.select("scope", "stage", "pos", "n", "cents", F.coalesce("lost", F.lit(0)).alias("lost")))


ORACLE_VIEWS["o_targets"] = values_view([(k, *v) for k, v in dims.CONVERSIONS.items()], "metric, lo, hi, direction")


@query(
    "conversions",
    tidy_sql(
        f"""SELECT scope, metric, value, coalesce(CASE WHEN direction IN ('gte', 'gte_x') THEN value >= lo WHEN direction = 'band' THEN value >= lo AND value <= hi WHEN direction = 'lte_days' THEN value <= lo END, false) AS ok FROM (
          SELECT scope, CAST(q / f AS DOUBLE) AS qual, CAST(a / p AS DOUBLE) AS accept, CAST(least(1.0, x / a) AS DOUBLE) AS exec, ev / x AS evid, m / x AS meas, v / m AS ver, g / m AS guard, ps / v AS pers, t2a, t2v, CAST(pc / CASE WHEN scope = 'all' THEN 5 ELSE 1 END AS DOUBLE) AS vpl, CAST(pc / fee AS DOUBLE) AS mult FROM (
            SELECT scope, count(*) AS f, count(*) FILTER (t_data AND t_feasible AND t_worth AND t_overlap) AS q, count(*) FILTER (state IN ('awaiting_decision', 'accepted', 'rejected', 'converted')) AS p, count(*) FILTER (state IN ('accepted', 'converted')) AS a FROM o_ff GROUP BY scope)
          JOIN (SELECT scope, count(*) FILTER ({_RAN}) AS x, CAST(count(*) FILTER ({_RAN} AND evidence_resolved = evidence_total) AS DOUBLE) AS ev, CAST(count(*) FILTER (window_closed AND point IS NOT NULL) AS DOUBLE) AS m,
            CAST(count(*) FILTER ({_VER}) AS DOUBLE) AS v, CAST(count(*) FILTER (window_closed AND point IS NOT NULL AND guardrails_passed = guardrails_total) AS DOUBLE) AS g, CAST(count(*) FILTER ({_VER} AND {LASTING}) AS DOUBLE) AS ps,
            sum(CASE WHEN {_VER} AND {LASTING} THEN {cents_in('period_cents')} ELSE 0 END) AS pc,
            median(date_diff('day', detected_on, decided_on)) FILTER (detected_on <= decided_on) AS t2a, median(date_diff('day', decided_on, eligible_on)) FILTER ({_VER}) AS t2v
            FROM o_ef JOIN (SELECT id AS fid, detected_on FROM rec_findings) d ON d.fid = finding_id GROUP BY scope) USING (scope) JOIN o_fee USING (scope))
        UNPIVOT (value FOR metric IN (qual, accept, exec, evid, meas, ver, guard, pers, t2a, t2v, vpl, mult)) JOIN o_targets USING (metric)""",
        keep="scope metric ok", doubles="value",
    ),
)
def conversions(inp):
    out = ledger.conversions(findings(inp), evals(inp), inp.view("reg_locations"), AS_OF, SINCE, THROUGH, FEE)
    return tidy(out.filter(F.col("value").isNotNull()).select("scope", "metric", "value", F.coalesce("ok", F.lit(False)).alias("ok")))


@query(
    "apportion_claims",
    tidy_sql(
        """SELECT id, line, total, CASE WHEN w <= 0 THEN fl + CASE WHEN line = p0 THEN total - sum(fl) OVER (PARTITION BY id) ELSE 0 END
          ELSE fl + CASE WHEN row_number() OVER (PARTITION BY id ORDER BY frac DESC, line) <= total - sum(fl) OVER (PARTITION BY id) THEN 1 ELSE 0 END END AS part FROM (
          SELECT *, floor(raw) AS fl, raw - floor(raw) AS frac FROM (SELECT *, CASE WHEN w <= 0 THEN total / n ELSE total * weight / w END AS raw FROM (
            SELECT *, sum(weight) OVER (PARTITION BY id) AS w, count(*) OVER (PARTITION BY id) AS n, min(line) OVER (PARTITION BY id) AS p0 FROM (
              SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_shipdate) AS line, 10000 + l_orderkey % 997 AS total, CASE WHEN l_orderkey % 10 = 0 THEN 0 ELSE l_quantity END AS weight FROM lineitem))))""",
        ints="id line total part",
    ),
)
def apportion_claims(inp):
    order = W.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    rows = inp.base["lineitem"].select(
        F.col("l_orderkey").alias("id"), F.row_number().over(order).alias("line"), (F.lit(10000) + F.col("l_orderkey") % 997).alias("total"),
        F.when(F.col("l_orderkey") % 10 == 0, 0.0).otherwise(F.col("l_quantity")).alias("weight"),
    )
    return tidy(ledger.apportion(rows, ["id"], position="line").select("id", "line", "total", "part"))


@query(
    "claim_location_cents",
    tidy_sql(f"SELECT id, scope AS room, {cents_in('cents')} AS room_cents FROM rec_adjustments, o_scopes WHERE scope <> 'all' AND list_contains(string_split(locs_key, '+'), scope)", keep="id room", ints="room_cents"),
)
def claim_location_cents(inp):
    return tidy(ledger.claim_location_cents(adjustments(inp)).select("id", "room", "room_cents"))


@query(
    "resolved_rooms",
    "SELECT id, CASE WHEN k % 2 = 0 THEN locs_key WHEN loc = 'group' THEN 'R0+R1+R2+R3+R4' ELSE loc END AS rooms FROM rec_adjustments",
)
def resolved_rooms(inp):
    bare = adjustments(inp).withColumn("locs", F.when(F.col("k") % 2 == 0, F.col("locs")).otherwise(F.array().cast("array<string>")))
    return ledger.resolve_locs(bare, inp.view("reg_locations")).select("id", F.array_join("locs", "+").alias("rooms"))


@query("typed_sums", tidy_sql("SELECT status, 'adjustment' AS klass, sum(cents) AS cents FROM rec_adjustments GROUP BY ALL", keep="status klass", ints="cents"))
def typed_sums(inp):
    return tidy(ledger.typed_sum(adjustments(inp).withColumn("klass", F.lit("adjustment")), ["status"]))


_SHARE = "CASE WHEN scope = 'all' THEN 1.0 WHEN list_contains(string_split(locs_key, '+'), scope) THEN 1.0 / len(string_split(locs_key, '+')) ELSE 0 END"
ORACLE_VIEWS["o_acc"] = f"SELECT scope, date, sum(y * {_SHARE}) AS y FROM o_decay, o_scopes WHERE scope = 'all' OR list_contains(string_split(locs_key, '+'), scope) GROUP BY ALL"


@query(
    "scope_accrual",
    tidy_sql("SELECT scope, date, floor(y + 0.5) AS cents, floor(sum(y) OVER (PARTITION BY scope ORDER BY date ROWS UNBOUNDED PRECEDING) + 0.5) AS cumulative FROM o_acc", keep="scope", ints="cents cumulative", dates="date"),
)
def scope_accrual(inp):
    return tidy(ledger.cumulative_accrual(ledger.daily_accrual(evals(inp), inp.view("reg_locations"), AS_OF)))


@query(
    "weekly_accrual",
    tidy_sql("SELECT scope, date_trunc('week', date)::DATE AS week, floor(sum(y) + 0.5) AS cents FROM o_acc GROUP BY ALL", keep="scope", ints="cents", dates="week"),
)
def weekly_accrual(inp):
    return tidy(ledger.accrual_by_week(ledger.daily_accrual(evals(inp), inp.view("reg_locations"), AS_OF)))


@query(
    "monthly_accrual",
    tidy_sql(
        f"""SELECT m.scope, m.month, m.cents, coalesce(a.adj, 0) AS adjustments_cents, floor({FEE} * (CASE WHEN m.scope = 'all' THEN 1.0 ELSE 0.2 END) * (CASE WHEN m.month = '2001-08' THEN 2 / 31.0 ELSE 1.0 END) + 0.5) AS fee_cents FROM (
          SELECT scope, strftime(date, '%Y-%m') AS month, floor(sum(y) + 0.5) AS cents FROM o_acc GROUP BY ALL) m LEFT JOIN (
          SELECT scope, strftime(on_date, '%Y-%m') AS month, sum({cents_in('cents')}) AS adj FROM o_af WHERE status <> 'open' GROUP BY ALL) a USING (scope, month)""",
        keep="scope month", ints="cents adjustments_cents fee_cents",
    ),
)
def monthly_accrual(inp):
    return tidy(ledger.accrual_by_month(ledger.daily_accrual(evals(inp), inp.view("reg_locations"), AS_OF), adjustments(inp), inp.view("reg_locations"), AS_OF, FEE))


@query(
    "accrual_now",
    tidy_sql(
        f"""SELECT scope, floor(coalesce(sum(y) FILTER (date = {DAY}), 0) + 0.5) AS today_cents, floor(coalesce(sum(y) FILTER (date_trunc('week', date) = date_trunc('week', {DAY})), 0) + 0.5) AS week_cents,
        floor(coalesce(sum(y) FILTER (strftime(date, '%Y-%m') = '2001-08'), 0) + 0.5) AS month_cents FROM o_acc GROUP BY scope""",
        keep="scope", ints="today_cents week_cents month_cents",
    ),
)
def accrual_now(inp):
    return tidy(ledger.accrual_now(ledger.daily_accrual(evals(inp), inp.view("reg_locations"), AS_OF), AS_OF))


@query("period_accrual", tidy_sql("SELECT id AS intervention_id, period_cents FROM o_period", keep="intervention_id", ints="period_cents"))
def period_accrual(inp):
    return tidy(ledger.accrual_in_period(evals(inp), AS_OF, SINCE, THROUGH))


@query(
    "period_fees",
    tidy_sql("SELECT scope, floor(fee + 0.5) AS fee_cents FROM o_fee", keep="scope", ints="fee_cents"),
)
def period_fees(inp):
    rooms = inp.view("reg_locations")
    scopes = rooms.select(F.col("loc").alias("scope")).unionByName(inp.spark.range(1).select(F.lit("all").alias("scope")))
    fee = ledger.fee_for_period(FEE, F.col("scope"), F.col("rooms"), SINCE, THROUGH)
    return tidy(ledger.with_rooms(scopes, rooms).select("scope", F.floor(fee + 0.5).alias("fee_cents")))


ORACLE_VIEWS["o_used"] = """SELECT e.*, unnest(CASE WHEN lever IN ('menu_price', 'portion') THEN ['toast_orders', 'toast_labour', 'recipes'] WHEN lever = 'ticket_time' THEN ['toast_orders', 'toast_labour', 'kds'] ELSE ['toast_orders', 'toast_labour'] END) AS code,
  CASE WHEN lever IN ('menu_price', 'portion', 'ticket_time') THEN 3 ELSE 2 END AS n_used FROM o_evals e"""


_RISK = f"""SELECT f.code, s.scope, floor(coalesce(o, 0) + 0.5) AS open_exposure_cents, floor(coalesce(b, 0) + 0.5) AS blocked_cents, floor(coalesce(m, 0) + 0.5) AS monitoring_cents, floor(coalesce(v, 0) + 0.5) AS verified_at_risk_cents FROM o_feeds f CROSS JOIN o_scopes s
        LEFT JOIN (SELECT code, scope, sum(CASE WHEN state IN {OPEN} THEN recoverable_cents * {_SHARE} / n_feeds END) AS o, sum(CASE WHEN state = 'data_insufficient' THEN exposure_cents * {_SHARE} / n_feeds END) AS b
          FROM o_qualified JOIN o_detector_feeds USING (detector), o_scopes WHERE NOT historical GROUP BY ALL) USING (code, scope)
        LEFT JOIN (SELECT code, scope, sum(CASE WHEN state = 'measuring' THEN projected_cents * {_SHARE} / n_used END) AS m, sum(CASE WHEN {HELD} THEN bookable_cents * {_SHARE} / n_used END) AS v FROM o_used, o_scopes GROUP BY ALL) USING (code, scope)"""
ORACLE_VIEWS["o_risk"] = _RISK


@query(
    "feed_risk",
    tidy_sql(
        _RISK,
        keep="code scope", ints="open_exposure_cents blocked_cents monitoring_cents verified_at_risk_cents",
    ),
)
def feed_risk(inp):
    return tidy(ledger.feed_risk(findings(inp), evals(inp), feed_table(inp), inp.view("reg_locations")))


@query(
    "data_register",
    tidy_sql("SELECT * FROM o_feeds JOIN o_risk USING (code) WHERE scope = 'all'", keep="code tier stale", ints="open_exposure_cents blocked_cents verified_at_risk_cents"),
)
def data_register(inp):
    risk = ledger.feed_risk(findings(inp), evals(inp), feed_table(inp), inp.view("reg_locations"))
    return tidy(report.data_register(feed_table(inp), risk).select("code", "tier", "stale", "open_exposure_cents", "blocked_cents", "verified_at_risk_cents"))


ORACLE_VIEWS["o_recon"] = values_view([(k, v) for k, v in dims.RECON_LABELS.items()], "status, status_label")


def bridges(inp):
    accounts = F.create_map(*(F.lit(x) for k, v in dims.DETECTORS.items() for x in (v[0], v[1])))
    rows = records(inp).select(KEY, accounts[F.col("lever")].alias("account"), F.col("title").alias("change"))
    return ledger.bridge(rows, sides(inp))


ORACLE_VIEWS["o_accounts"] = values_view([(v[0], v[1]) for v in dims.DETECTORS.values()], "lever, account")


@query(
    "bridges",
    tidy_sql(
        "SELECT s.intervention_id, status, status_label, claim_cents, CASE WHEN status IN ('reconciled', 'timing') THEN observed_cents ELSE 0 END AS reconciled_cents FROM rec_sides s JOIN o_recon USING (status)",
        keep="intervention_id status status_label", ints="claim_cents reconciled_cents",
    ),
)
def bridge_totals(inp):
    return tidy(bridges(inp).select(KEY, "status", "status_label", "claim_cents", "reconciled_cents"))


@query(
    "bridge_lines",
    tidy_sql(
        f"""SELECT intervention_id, pos, v FROM (SELECT s.intervention_id, unnest([title, '', '', '', CASE WHEN timing_cents <> 0 THEN {usd_sql('timing_cents')} || ' belongs to the next period' ELSE 'No shift between periods' END,
          account, '', string_split(account, ' · ')[1] || ': ' || {usd_sql('s.observed_cents')},
          {usd_sql('unexplained_cents')} || ' open, ' || {fixed_sql('coalesce(unexplained_cents / nullif(claim_cents, 0), 0) * 100', 1)} || '%', '',
          CASE WHEN status IN ('partial', 'unexplained') THEN 'Under review: ' ELSE 'Signed off: ' END, status_label]) AS v, unnest(range(0, 12)) AS pos
          FROM rec_sides s JOIN o_recon USING (status) JOIN rec_evals e ON e.id = s.intervention_id JOIN o_accounts USING (lever))""",
        keep="intervention_id v", ints="pos",
    ),
)
def bridge_lines(inp):
    return tidy(ledger.bridge_lines(bridges(inp)).select(KEY, "pos", "v"))


@query(
    "largest_unexplained",
    tidy_sql("SELECT intervention_id, unexplained_cents, claim_cents FROM rec_sides WHERE unexplained_cents > 0 ORDER BY unexplained_cents DESC, intervention_id DESC LIMIT 1", keep="intervention_id", ints="unexplained_cents claim_cents"),
)
def largest_unexplained(inp):
    return tidy(ledger.largest_unexplained(sides(inp)))


ORACLE_VIEWS.update(
    {
        "o_figures": values_view([(f, e) for f, (_, uses) in dims.FIGURES.items() for e in uses], "figure, node"),
        "o_reads": values_view([(e, i) for e, inputs in dims.EQUATION_INPUTS.items() for i in inputs], "node, reads"),
        "o_delivers": values_view([(i, f) for i, feeds in dims.INPUT_FEEDS.items() for f in feeds], "node, code"),
    }
)
# The walk is spelled out in each query: a recursive part must stand in the query itself.
_WALK = "WITH RECURSIVE walk AS (SELECT figure, node FROM o_figures UNION SELECT w.figure, r.reads FROM walk w JOIN o_reads r ON r.node = w.node) SELECT DISTINCT figure, code FROM walk JOIN o_delivers USING (node)"
_SOURCES = f"""SELECT figure, string_agg(code, ' + ' ORDER BY code) AS feeds, coalesce(string_agg(code, ', ' ORDER BY code) FILTER (stale), '') AS late, count(*) FILTER (newest IS NULL) AS n_never, min(newest) AS oldest
  FROM ({_WALK}) LEFT JOIN o_feeds USING (code) GROUP BY figure"""


def _contracts(inp):
    out = ledger.kpis(
        findings(inp), evals(inp), inp.view("rec_actions"), adjustments(inp), feed_table(inp), sides(inp), inp.view("reg_locations"), AS_OF, SINCE, THROUGH, FEE
    )
    return contract.metric_contracts(out, feed_table(inp), SINCE, THROUGH)


@query("metric_lineage", tidy_sql(f"SELECT figure, feeds, late, CASE WHEN n_never = 0 THEN oldest END AS fresh_through FROM ({_SOURCES})", keep="figure feeds late", dates="fresh_through"))
def metric_lineage(inp):
    out = contract.figure_sources(feed_table(inp))
    return tidy(out.select("figure", F.array_join("feeds", " + ").alias("feeds"), F.array_join("stale_feeds", ", ").alias("late"), "fresh_through"))


@query(
    "metric_contracts",
    f"""SELECT scope, figure AS kpi, CASE WHEN n_never = 0 THEN strftime(oldest, '%Y-%m-%d') END AS freshness, CASE WHEN n_never = 0 THEN feeds END AS lineage,
      CASE WHEN n_never = 0 THEN CASE WHEN late = '' THEN 'up to date' ELSE 'waits for ' || late END END AS status, CASE WHEN scope = 'all' THEN 'every room' ELSE 'room ' || scope END AS location_scope
      FROM o_scopes, ({_SOURCES})""",
)
def metric_contracts(inp):
    return _contracts(inp).select("scope", "kpi", "freshness", "lineage", "status", "location_scope")


@query(
    "metric_contract_gaps",
    f"SELECT scope, figure AS kpi, unnest(['status', 'freshness', 'lineage']) AS attribute FROM o_scopes, ({_SOURCES}) WHERE n_never > 0",
)
def metric_contract_gaps(inp):
    return contract.contract_gaps(_contracts(inp))


# -- confidence, queue, listings --------------------------------------------

ORACLE_VIEWS["o_fconf"] = "SELECT id, least(1.0, evidence_count / 12 * 0.5 + completeness * 0.4 + CASE WHEN stale_n = 0 THEN 0.1 ELSE 0 END) AS data FROM o_qualified"
ORACLE_VIEWS["o_iconf"] = """SELECT *, CASE WHEN recon >= 0.9 THEN 'Reconciled' WHEN pers >= 0.5 THEN 'Persistent' WHEN exe > 0 AND meas >= 0.5 AND guard >= 1 THEN 'Verified' WHEN meas > 0 THEN 'Measured' WHEN attr > 0 THEN 'Directional' ELSE 'Estimated' END AS word FROM (
  SELECT id, CASE WHEN point IS NOT NULL THEN least(1.0, abs(point) / greatest(mde, 1) / 2) ELSE 0 END AS meas, CASE WHEN rung <= 3 THEN 0.9 ELSE 0.6 END AS attr,
    CASE fidelity WHEN 'complete' THEN 1 WHEN 'modified' THEN 0.7 WHEN 'partial' THEN 0.4 ELSE 0 END AS exe, CASE WHEN point IS NOT NULL THEN greatest(0, least(1.0, pre_fit + 0.2)) ELSE 0 END AS comp, guardrails_observed / guardrails_total AS guard,
    CASE WHEN persistence_status IS NULL THEN 0 WHEN persistence_status = 'decaying' THEN least(0.3, checks / 8) ELSE least(1.0, checks / 4) END AS pers,
    CASE WHEN side_status IS NULL THEN 0 WHEN side_status = 'reconciled' THEN 1 WHEN side_status IN ('partial', 'timing') THEN 0.6 ELSE 0.2 END AS recon FROM o_evals)"""


@query("finding_confidence", tidy_sql("SELECT * FROM o_fconf", keep="id", doubles="data"))
def finding_confidence(inp):
    return tidy(report.finding_confidence(findings_full(inp), feed_table(inp)).select("id", F.col("confidence.data").alias("data")))


def findings_full(inp):
    return findings(inp).drop("feed_map")


@query(
    "confidence_words",
    tidy_sql("SELECT id AS intervention_id, word, meas, guard, pers, recon, comp FROM o_iconf", keep="intervention_id word", doubles="meas guard pers recon comp"),
)
def confidence_words(inp):
    out = report.intervention_confidence(evals(inp), sides(inp)).withColumn("word", report.confidence_word())
    p = lambda d, n: F.col(f"confidence.{d}").alias(n)
    return tidy(out.select(KEY, "word", p("measurement", "meas"), p("guardrail", "guard"), p("persistence", "pers"), p("reconciliation", "recon"), p("comparability", "comp")))


@query(
    "finding_bases",
    f"""SELECT id, evidence_count || ' observations, ' || n_feeds || ' feeds, ' || {fixed_sql('completeness * 100', 1)} || '% complete' || CASE WHEN stale_n = 0 THEN '' ELSE ', one is late' END AS data, n_guards || ' limits named' AS guardrail, 'not begun' AS execution
      FROM o_qualified JOIN (SELECT lever, count(*) AS n_guards FROM o_lever_guards GROUP BY lever) USING (lever)""",
)
def finding_bases(inp):
    out = report.finding_confidence(findings_full(inp), feed_table(inp))
    return out.select("id", *(F.col(f"confidence_basis.{d}").alias(d) for d in ("data", "guardrail", "execution")))


@query(
    "intervention_bases",
    f"""SELECT id AS intervention_id, CASE WHEN data_pass THEN 'feeds complete' ELSE 'a feed is incomplete' END AS data, CASE WHEN point IS NULL THEN 'window open' ELSE {usd_sql('abs(point)')} || ' seen, ' || {usd_sql('mde')} || ' needed' END AS measurement,
      'rung ' || rung AS attribution, evidence_resolved || ' of ' || evidence_total || ' records found, ' || fidelity AS execution, CASE WHEN point IS NULL THEN 'no estimate' ELSE 'fit ' || {fixed_sql('pre_fit * 100', 0)} || '%' END AS comparability,
      guardrails_observed || ' of ' || guardrails_total || ' seen, ' || (guardrails_total - guardrails_passed) || ' broken' AS guardrail,
      CASE WHEN persistence_status IS NULL THEN 'no claim' ELSE checks || ' checks in ' || elapsed_weeks || ' weeks' || CASE WHEN persistence_status = 'decaying' THEN ', falling' ELSE '' END END AS persistence,
      coalesce(status_label, 'no bridge') AS reconciliation FROM o_evals LEFT JOIN o_recon ON status = side_status""",
)
def intervention_bases(inp):
    out = report.intervention_confidence(evals(inp), sides(inp))
    return out.select(KEY, *(F.col(f"confidence_basis.{d}").alias(d) for d in dims.CONFIDENCE_DIMENSIONS))


@query(
    "finding_summaries",
    tidy_sql("SELECT id, state, lever, loc, exposure_cents, recoverable_cents, ev_per_hour, 'Estimated' AS confidence_word, detected_on, expires_on FROM o_qualified", keep="id state lever loc confidence_word", ints="exposure_cents recoverable_cents ev_per_hour", dates="detected_on expires_on"),
)
def finding_summaries(inp):
    out = report.finding_summary(findings_full(inp), feed_table(inp))
    return tidy(out.select("id", "state", "lever", "loc", "confidence_word", "exposure_cents", "recoverable_cents", "ev_per_hour", "detected_on", "expires_on"))


ORACLE_VIEWS["o_outcomes"] = values_view([(k, v[0]) for k, v in dims.OUTCOMES.items()], "outcome, outcome_label")


@query(
    "intervention_summaries",
    tidy_sql(
        "SELECT e.id AS intervention_id, state, outcome, outcome_label, word AS confidence_word, coalesce(side_status, 'none') AS recon_status, outcome = 'reversed' AS reversed, projected_cents, floor(coalesce(point, 0) + 0.5) AS estimate_point_cents FROM o_evals e JOIN o_outcomes USING (outcome) JOIN o_iconf c ON c.id = e.id",
        keep="intervention_id state outcome outcome_label confidence_word recon_status reversed", ints="projected_cents estimate_point_cents",
    ),
)
def intervention_summaries(inp):
    out = report.intervention_summary(evals(inp), sides(inp))
    return tidy(
        out.select(
            KEY, "state", "outcome", "outcome_label", "confidence_word", F.coalesce("recon_status", F.lit("none")).alias("recon_status"), "reversed", "projected_cents",
            F.coalesce("estimate_point_cents", F.lit(0)).alias("estimate_point_cents"),
        )
    )


ORACLE_VIEWS["o_live"] = "SELECT *, CAST(recoverable_cents AS BIGINT) AS rec FROM o_qualified WHERE NOT historical"
ORACLE_VIEWS["o_ovl"] = """SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY CASE WHEN overlap_with IS NULL THEN id ELSE least(id, overlap_with) || '+' || greatest(id, overlap_with) END ORDER BY id) AS r
  FROM o_live WHERE overlap_status IN ('reduced', 'unresolved') AND state NOT IN ('converted', 'rejected', 'superseded')) WHERE r = 1"""
ORACLE_VIEWS["o_cards"] = f"""SELECT 'Q-' || id AS id, 'guardrail' AS type, CAST(NULL AS BIGINT) AS money FROM o_evals WHERE outcome = 'guardrail_failure'
  UNION ALL SELECT 'QR-' || id, 'reversal', NULL FROM o_evals WHERE outcome = 'guardrail_failure' AND state = 'guardrail_failed' UNION ALL SELECT 'QP-' || id, 'persistence', NULL FROM o_evals WHERE persistence_status = 'decaying'
  UNION ALL SELECT 'QW-' || id, 'window_eligible', projected_cents FROM o_evals WHERE state = 'measuring' UNION ALL SELECT 'QE-' || id, 'missing_evidence', NULL FROM o_evals WHERE state = 'evidence_pending' OR (state = 'in_progress' AND exec_on < {DAY})
  UNION ALL SELECT 'QV-' || id, 'verification_exception', NULL FROM o_evals WHERE outcome IN ('data_failure', 'attribution_conflict') UNION ALL SELECT 'QC-' || id, 'recon_question', NULL FROM rec_adjustments WHERE kind = 'Dispute' AND status = 'open'
  UNION ALL SELECT 'QF-' || id, 'high_value', rec FROM o_live WHERE state = 'awaiting_decision' UNION ALL SELECT 'QD-' || id, 'data_quality', NULL FROM o_live WHERE state = 'data_insufficient' AND blocked
  UNION ALL SELECT 'QO-' || id, 'overlap', NULL FROM o_ovl UNION ALL SELECT 'QS-' || code, 'data_quality', NULL FROM o_feeds WHERE stale UNION ALL SELECT 'QA-' || id, 'action_due', NULL FROM rec_actions WHERE state = 'open'"""
ORACLE_VIEWS["o_ranks"] = values_view(list(dims.CARD_RANKS.items()), "type, rank")
ORACLE_VIEWS["o_bands"] = """SELECT *, CASE WHEN rank <= 2 THEN 'blocking' WHEN type IN ('high_value', 'overlap', 'recon_question', 'window_eligible') THEN 'decide' WHEN type IN ('action_due', 'missing_evidence') THEN 'execute' ELSE 'watch' END AS band FROM o_cards JOIN o_ranks USING (type)"""


def cards(inp):
    refs = inp.view("rec_findings").filter("overlap_with IS NOT NULL").select("id", F.col("overlap_with").alias("other_id"))
    return report.queue(findings(inp), evals(inp), inp.view("rec_actions"), adjustments(inp), feed_table(inp), refs, AS_OF)


@query(
    "queue_cards",
    tidy_sql("SELECT id, type, rank, coalesce(money, -1) AS money_cents, band, row_number() OVER (ORDER BY rank, coalesce(money, 0) DESC, id) AS position FROM o_bands", keep="id type band", ints="rank money_cents position"),
)
def queue_cards(inp):
    out = report.placed(cards(inp).withColumn("band", report.card_band()), report.queue_order())
    return tidy(out.select("id", "type", "band", "rank", F.coalesce("money_cents", F.lit(-1)).alias("money_cents"), "position"))


@query("band_counts", tidy_sql("SELECT band, count(*) AS n FROM o_bands GROUP BY band", keep="band", ints="n"))
def band_counts(inp):
    return tidy(cards(inp).withColumn("band", report.card_band()).groupBy("band").agg(F.count(F.lit(1)).alias("n")))


@query(
    "view_counts",
    tidy_sql(
        """SELECT unnest(['awaiting_decision', 'investigating', 'data_insufficient', 'decided', 'all']) AS view, unnest([count(*) FILTER (NOT historical AND state = 'awaiting_decision'), count(*) FILTER (NOT historical AND state = 'investigating'),
        count(*) FILTER (NOT historical AND state = 'data_insufficient'), count(*) FILTER (state IN ('converted', 'rejected', 'expired', 'superseded')), count(*)]) AS n FROM rec_findings""",
        keep="view", ints="n",
    ),
)
def view_counts(inp):
    return tidy(report.view_counts(inp.view("rec_findings")))


@query("ordered_feeds", "SELECT code, tier, stale, row_number() OVER (ORDER BY stale DESC, CASE tier WHEN 'Pilot' THEN 0 WHEN 'Next' THEN 1 ELSE 2 END, code) AS position FROM o_feeds")
def ordered_feeds(inp):
    return report.placed(feed_table(inp), report.feed_order()).select("code", "tier", "stale", "position")


@query(
    "home_sections",
    f"""SELECT 'decisions_due' AS section, id AS ref_id FROM o_cards WHERE type IN ('guardrail', 'overlap', 'high_value', 'verification_exception', 'reversal', 'persistence', 'recon_question')
    UNION ALL SELECT 'executions_due', id FROM o_cards WHERE type IN ('action_due', 'missing_evidence')
    UNION ALL SELECT 'tests_running', id FROM o_evals WHERE state IN {dims.IN_FLIGHT_STATES} AND fidelity <> 'not_started' UNION ALL SELECT 'results_landed', id FROM o_evals WHERE window_closed AND eligible_on >= {DAY} - 42
    UNION ALL SELECT 'wins_decaying', id FROM o_evals WHERE persistence_status = 'decaying'""",
)
def home_sections(inp):
    return report.home_sections(evals(inp), cards(inp), AS_OF).select("section", "ref_id")


@query(
    "savings_ledger",
    tidy_sql("SELECT id AS intervention_id, coalesce(bookable_cents, 0) AS booked, row_number() OVER (ORDER BY coalesce(bookable_cents, 0) DESC, id) AS position FROM o_evals WHERE bookable_cents IS NOT NULL OR reversed_claim_cents IS NOT NULL OR outcome = 'reversed'", keep="intervention_id", ints="booked position"),
)
def savings_ledger(inp):
    out = report.placed(report.savings_ledger(evals(inp)), report.claim_order())
    return tidy(out.select(KEY, F.coalesce("bookable_cents", F.lit(0)).alias("booked"), "position"))


def _d(c: str) -> str:
    return f"day({c}) || ' ' || strftime({c}, '%b')"


_SENTENCE = f"""CASE WHEN outcome = 'pending' AND state = 'measuring' THEN 'Since ' || {_d('exec_on')} || ': ' || observed || '/' || observed_of || ' services; ' || CASE WHEN guardrails_passed < guardrails_total THEN 'a limit is broken' ELSE 'all limits hold' END || '; due ' || {_d('eligible_on')}
  WHEN outcome = 'pending' THEN 'Decided ' || {_d('decided_on')} || '; starts ' || {_d('exec_on')}
  WHEN outcome IN ('verified', 'verified_limited') THEN 'Effect ' || {usd_sql('abs(point)')} || ' per week; bookable ' || {usd_sql('bookable_cents')} || ' per week' || CASE WHEN persistence_status = 'holding' THEN '; still held' ELSE '' END
  WHEN outcome = 'inconclusive' THEN 'The figures leave it open; booked $0' WHEN outcome = 'no_effect' THEN 'Effect ' || {usd_sql('abs(point)')} || ' per week; detectable from ' || {usd_sql('mde')} || '; booked $0'
  WHEN outcome = 'negative' THEN 'Loss of ' || {usd_sql('abs(point)')} || ' per week; reversal advised' WHEN outcome = 'guardrail_failure' THEN 'A limit was broken; booked $0'
  WHEN outcome = 'directional' THEN 'Effect ' || {usd_sql('point')} || ' per week; lower bound ' || {usd_sql('lower_bound')} || '; booked $0' WHEN outcome = 'data_failure' THEN 'Data incomplete; claim on hold'
  WHEN outcome = 'attribution_conflict' THEN 'Cause disputed; claim on hold' ELSE 'Claim taken back' END"""


@query("outcome_sentences", f"SELECT id AS intervention_id, {_SENTENCE} AS sentence FROM o_evals")
def outcome_sentences(inp):
    return evals(inp).select(KEY, report.outcome_sentence().alias("sentence"))


ORACLE_VIEWS["o_detector_guards"] = values_view([(k, g, i) for k, v in dims.DETECTORS.items() for i, g in enumerate(v[7])], "detector, g, pos")


@query(
    "proposal_sentences",
    f"""SELECT id, title || '. Worth ' || {usd_sql('recoverable_cents')} || ' per week; limits for 4 weeks: ' || g AS sentence FROM o_qualified JOIN (
      SELECT detector, string_agg(replace(g, '_', ' '), ', ' ORDER BY pos) AS g FROM o_detector_guards GROUP BY detector) USING (detector)""",
)
def proposal_sentences(inp):
    out = report.proposal_sentence(F.concat(F.col("title"), F.lit(".")), F.col("recoverable_cents"), F.col("guardrails"), F.lit(28))
    return findings(inp).select("id", out.alias("sentence"))



@query(
    "proof_packets",
    tidy_sql(
        """SELECT e.id AS intervention_id, e.finding_id, coalesce(n, 0) AS adjustments, coalesce(a, 0) AS cents, coalesce(side_status, 'none') AS side_status FROM o_evals e LEFT JOIN (
        SELECT intervention_id, count(*) AS n, sum(cents) AS a FROM rec_adjustments GROUP BY ALL) x ON x.intervention_id = e.id""",
        keep="intervention_id finding_id side_status", ints="adjustments cents",
    ),
)
def proof_packets(inp):
    trail = records(inp).select(KEY, F.col("decided_on").alias("on_date"), "state")
    out = report.proof_packets(evals(inp), findings(inp), sides(inp), adjustments(inp), trail)
    size = F.when(F.col("adjustments").isNull(), 0).otherwise(F.size("adjustments"))
    total = F.coalesce(F.aggregate("adjustments", F.lit(0).cast("bigint"), lambda acc, x: acc + x["cents"]), F.lit(0))
    return tidy(out.select(KEY, "finding_id", F.coalesce("ledger_side.status", F.lit("none")).alias("side_status"), size.alias("adjustments"), total.alias("cents")))
