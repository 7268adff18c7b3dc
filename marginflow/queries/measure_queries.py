"""Queries over interventions: series, estimates, guardrails, verdicts, persistence and accrual."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import dims
from ..functions.numeric import normal_quantile_value
from ..operators import costing, guardrails, lifecycle, measure, persistence, series, verify
from ..plans import evaluate
from ..session import durable
from .lifecycle_queries import feed_table, values_view
from .oracle_views import ORACLE_VIEWS
from .register_queries import item_days, services
from .registry import query, tidy, tidy_sql
from .series_queries import tq_sql
from .views import AS_OF

KEY = measure.KEY
DAY = f"DATE '{AS_OF}'"
Z975, Z80, Z95 = (repr(normal_quantile_value(p)) for p in (0.975, 0.8, 0.95))


def plans(inp):
    """Declarations with their scopes as arrays."""
    rooms = F.array(*(F.lit(f"R{i}") for i in range(5)))
    guards = F.create_map(*(x for k, v in dims.LEVERS.items() for x in (F.lit(k), F.array(*(F.lit(g) for g in v[7])))))
    price, item = F.col("metric") == "sku_unit_price", F.col("metric") == "item_cost_per_unit"
    one_day = F.col("dow").isNotNull()
    sku_no = F.substring("treat_sku", 2, 2).try_cast("int")
    neighbour = F.array(F.concat(F.lit("R"), ((F.substring("treat_loc", 2, 1).cast("int") + 1) % 5).cast("string")))
    return inp.view("rec_interventions").select(
        "*",
        F.when(price, rooms).otherwise(F.array("treat_loc")).alias("treat_locs"),
        F.when(F.col("daypart").isNotNull(), F.array("daypart")).alias("treat_dayparts"),
        F.when(one_day, F.array("dow")).alias("treat_dows"),
        (~F.col("no_control") & ~price & ~item & ~one_day).alias("control_others"),
        F.when(one_day & ~F.col("no_control"), F.array("treat_loc")).when(item, neighbour).alias("control_locs"),
        F.when(F.col("daypart").isNotNull(), F.array("daypart")).alias("control_dayparts"),
        F.when(one_day, F.array_except(F.array(*(F.lit(d) for d in (1, 2, 3, 4))), F.array("dow"))).alias("control_dows"),
        F.when(price, F.array(*(F.concat(F.lit("S"), ((sku_no + d) % 12).cast("string")) for d in (4, 8)))).alias("control_skus"),
        F.when(item, F.array("treat_item")).alias("treat_items"),
        F.when(item, F.array("treat_item")).alias("control_items"),
        guards[F.col("lever")].alias("guardrails"),
    )


def register(inp):
    """The roll-up as the engine stores it, the sums of the invoices and the menu: made once, read by every series."""
    return evaluate.Register(durable(services(inp)), durable(item_days(inp)), durable(costing.weekly_invoices(inp.view("reg_invoices"))), durable(inp.menu()))


_METRIC_SQL = {
    "labour_per_cover": "labor_cents / greatest(covers, 1)", "comps_per_cover": "comps_cents / greatest(covers, 1)", "cm_per_cover": "(net_cents - cogs_cents) / greatest(covers, 1)",
    "cogs_per_cover": "cogs_cents / greatest(covers, 1)", "net_per_cover": "net_cents / greatest(covers, 1)", "ticket_min": "ticket_min",
}
_GUARD_SQL = {
    "net_sales": "net_cents", "covers": "covers", "ticket_time": "ticket_min", "rating": "rating", "overtime": "hours", "comps": "comps_cents / greatest(gross_cents, 1)",
    "check_average": "net_cents / greatest(covers, 1)",
}
_CASE = "CASE metric " + " ".join(f"WHEN '{m}' THEN {x}" for m, x in _METRIC_SQL.items()) + " END"

ORACLE_VIEWS.update(
    {
        "o_iv": "SELECT *, NOT no_control AND metric NOT IN ('sku_unit_price', 'item_cost_per_unit') AND dow IS NULL AS others, 'R' || ((CAST(substr(treat_loc, 2, 1) AS INTEGER) + 1) % 5) AS next_loc FROM rec_interventions",
        "o_arms": f"""SELECT i.*, s.* EXCLUDE (daypart, dow), 't' AS arm FROM o_iv i JOIN services s ON (s.loc = treat_loc OR metric = 'sku_unit_price') AND (i.daypart IS NULL OR s.daypart = i.daypart) AND (i.dow IS NULL OR s.dow = i.dow)
            WHERE s.date >= date_trunc('week', exec_on - baseline_days)::DATE AND s.date < {DAY} + 7
          UNION ALL SELECT i.*, s.* EXCLUDE (daypart, dow), 'c' AS arm FROM o_iv i JOIN services s ON (CASE WHEN others THEN s.loc <> treat_loc WHEN metric = 'item_cost_per_unit' THEN s.loc = next_loc WHEN i.dow IS NOT NULL AND NOT no_control THEN s.loc = treat_loc ELSE false END)
            AND (i.daypart IS NULL OR s.daypart = i.daypart) AND (i.dow IS NULL OR (s.dow IN (1, 2, 3, 4) AND s.dow <> i.dow))
            WHERE s.date >= date_trunc('week', exec_on - baseline_days)::DATE AND s.date < {DAY} + 7""",
        "o_price_arm": """SELECT intervention_id, exec_on, 't' AS arm, 0 AS pos, treat_sku AS sku FROM o_iv WHERE metric = 'sku_unit_price'
          UNION ALL SELECT intervention_id, exec_on, 'c', 0, 'S' || ((CAST(substr(treat_sku, 2) AS INTEGER) + 4) % 12) FROM o_iv WHERE metric = 'sku_unit_price'
          UNION ALL SELECT intervention_id, exec_on, 'c', 1, 'S' || ((CAST(substr(treat_sku, 2) AS INTEGER) + 8) % 12) FROM o_iv WHERE metric = 'sku_unit_price'""",
        "o_price_base": "SELECT a.*, (SELECT coalesce(avg(unit_price_cents), 1) FROM reg_invoices r WHERE r.sku = a.sku AND r.week < a.exec_on) AS base FROM o_price_arm a",
        "o_indexed": """SELECT b.intervention_id, b.arm, r.week AS date, avg(r.unit_price_cents / b.base) * max(f.base) AS y FROM o_price_base b JOIN reg_invoices r ON r.sku = b.sku
          JOIN o_price_base f ON f.intervention_id = b.intervention_id AND f.arm = b.arm AND f.pos = 0 GROUP BY ALL""",
        "o_frozen": """SELECT i.intervention_id, coalesce((SELECT sum(extended_cents) / sum(qty) FROM reg_invoices r WHERE r.sku = treat_sku AND week < exec_on AND week >= exec_on - 28),
          (SELECT avg(unit_price_cents) FROM reg_invoices r WHERE r.sku = treat_sku), 1) AS frozen FROM o_iv i WHERE metric = 'sku_cost_per_plate'""",
        "o_usage_arm": """SELECT intervention_id, treat_sku AS sku, 't' AS arm, loc FROM o_iv JOIN reg_locations ON loc = treat_loc WHERE metric = 'sku_cost_per_plate'
          UNION ALL SELECT intervention_id, treat_sku, 'c', loc FROM o_iv JOIN reg_locations ON loc <> treat_loc WHERE metric = 'sku_cost_per_plate' AND others""",
        "o_usage_y": """SELECT intervention_id, arm, date, q * frozen / p AS y FROM (
          SELECT a.intervention_id, a.arm, r.week AS date, sum(r.qty) AS q FROM o_usage_arm a JOIN reg_invoices r ON r.sku = a.sku AND r.loc = a.loc GROUP BY ALL)
          JOIN (SELECT a.intervention_id, a.arm, w.date, sum(w.plates) AS p FROM o_usage_arm a JOIN o_plates w ON w.sku = a.sku AND w.loc = a.loc GROUP BY ALL) USING (intervention_id, arm, date)
          JOIN o_frozen USING (intervention_id) WHERE p > 0""",
        "o_item_y": """SELECT intervention_id, arm, date, sum(units * cost_cents) / greatest(sum(units), 1) AS y FROM (
          SELECT i.intervention_id, 't' AS arm, d.* FROM o_iv i JOIN item_days d ON d.loc = treat_loc AND d.item = treat_item WHERE metric = 'item_cost_per_unit'
          UNION ALL SELECT i.intervention_id, 'c', d.* FROM o_iv i JOIN item_days d ON d.loc = next_loc AND d.item = treat_item WHERE metric = 'item_cost_per_unit') GROUP BY ALL""",
        "o_daily_y": f"""SELECT intervention_id, arm, date, avg({_CASE}) AS y FROM o_arms WHERE metric NOT LIKE 'sku%' AND metric <> 'item_cost_per_unit' GROUP BY ALL
          UNION ALL SELECT * FROM o_indexed UNION ALL SELECT * FROM o_usage_y UNION ALL SELECT * FROM o_item_y""",
        "o_series": """SELECT intervention_id, CASE WHEN weekly THEN date_trunc('week', date)::DATE ELSE date END AS date, avg(CASE WHEN arm = 't' THEN y END) AS t, avg(CASE WHEN arm = 'c' THEN y END) AS c
          FROM o_daily_y JOIN o_iv USING (intervention_id) GROUP BY ALL""",
    }
)


def moments_sql(pairs: str, keys: str) -> str:
    cells = {"pre": "date >= lo AND date < exec_on", "post": "date >= exec_on AND date < hi", "p1": "date >= lo AND date < mid", "p2": "date >= mid AND date < exec_on"}
    aggs = ", ".join(
        f"count({a}) FILTER ({test}) AS n_{a}_{c}, coalesce(avg({a}) FILTER ({test}), 0) AS m_{a}_{c}, coalesce(var_samp({a}) FILTER ({test}), 0) AS v_{a}_{c}"
        for c, test in cells.items() for a in ("t", "c")
    )
    pre = f"{cells['pre']} AND t IS NOT NULL AND c IS NOT NULL"
    return f"""(SELECT {keys}, estimator, {aggs}, CASE WHEN count(*) FILTER ({pre}) > 3 THEN coalesce(corr(t, c) FILTER ({pre}), 0) ELSE 0 END AS fit
      FROM (SELECT s.*, i.* EXCLUDE (intervention_id, weekly), exec_on - baseline_days AS lo, exec_on + window_days AS hi, exec_on - CAST(floor(baseline_days / 2) AS INTEGER) AS mid FROM {pairs} s JOIN o_iv i ON i.intervention_id = s.intervention_id) GROUP BY ALL)"""


def _sd(cells: list[str]) -> str:
    return "sqrt(" + " + ".join(f"v_{c} / nullif(n_{c}, 0)" for c in cells) + ")"


def _plan(*arms: str) -> str:
    return "sqrt(" + " + ".join(f"v_{a}_pre * (1 / greatest(n_{a}_post, 1) + 1 / greatest(n_{a}_pre, 1))" for a in arms) + ")"


_PSE = _sd(["t_p1", "t_p2", "c_p1", "c_p2"])
ORACLE_VIEWS["o_moments"] = f"SELECT * FROM {moments_sql('o_series', 'intervention_id')}"


def did_sql(src: str) -> str:
    return f"""(SELECT *, {tq_sql(Z95, 'df')} AS t_crit FROM (SELECT *, n_t_post >= 2 AND n_c_post >= 2 AND n_t_pre >= 4 AND n_c_pre >= 4 AS ok, m_t_post - m_t_pre - (m_c_post - m_c_pre) AS point, {_sd(['t_post', 't_pre', 'c_post', 'c_pre'])} AS se,
      CAST(greatest(n_t_post + n_t_pre + n_c_post + n_c_pre - 4, 4) AS DOUBLE) AS df, least(n_t_p1, n_t_p2, n_c_p1, n_c_p2) > 1 AS placebo_ok,
      m_t_p2 - m_t_p1 - (m_c_p2 - m_c_p1) AS pp, {_PSE} AS pse, {tq_sql(Z975, 'greatest(n_t_p1 + n_t_p2 + n_c_p1 + n_c_p2 - 4, 4)')} AS pcrit,
      fit AS pre_fit, ({Z975} + {Z80}) * {_plan('t', 'c')} AS mde, 0.0 AS index_share FROM {src}))"""


def rec_sql(src: str) -> str:
    a, b = "(v_t_pre / nullif(n_t_pre, 0))", "(v_t_post / nullif(n_t_post, 0))"
    den = f"({a} * {a} / greatest(n_t_pre - 1, 1) + {b} * {b} / greatest(n_t_post - 1, 1))"
    return f"""(SELECT *, {tq_sql(Z95, 'df')} AS t_crit FROM (SELECT *, n_t_pre >= 3 AND n_t_post >= 2 AS ok, m_t_pre - m_t_post AS point, sqrt({a} + {b}) AS se,
      greatest(CASE WHEN {den} > 0 THEN ({a} + {b}) ** 2 / {den} ELSE greatest(n_t_pre + n_t_post - 2, 1) END, 3) AS df, true AS placebo_ok, 0.0 AS pp, 1.0 AS pse, 1.0 AS pcrit,
      1.0 AS pre_fit, ({Z975} + {Z80}) * {_plan('t')} AS mde,
      CASE WHEN n_c_pre > 0 AND n_c_post > 0 AND m_t_pre <> m_t_post THEN (m_c_pre - m_c_post) / (m_t_pre - m_t_post) ELSE 0 END AS index_share FROM {src}))"""


_EST_COLS = "ok, point, se, df, t_crit, placebo_ok, placebo_ok AND pse > 0 AND abs(pp / nullif(pse, 0)) <= pcrit AS placebo_pass, pre_fit, mde, index_share, n_t_pre, n_t_post, n_c_pre, n_c_post"
_IF_OK = "ok, n_t_pre, n_t_post, n_c_pre, n_c_post, " + ", ".join(
    f"CASE WHEN ok THEN {e} END AS {n}"
    for n, e in [(c, c) for c in ("point", "se", "df", "t_crit", "placebo_ok", "pre_fit", "mde", "index_share")] + [("placebo_pass", "placebo_ok AND pse > 0 AND abs(pp / nullif(pse, 0)) <= pcrit")]
)
ORACLE_VIEWS["o_est"] = f"""SELECT intervention_id, {_EST_COLS}, estimator FROM {did_sql("(SELECT * FROM o_moments WHERE estimator = 'did')")}
  UNION ALL SELECT intervention_id, {_EST_COLS}, estimator FROM {rec_sql("(SELECT * FROM o_moments WHERE estimator = 'reconcile')")}"""
ORACLE_VIEWS["o_volume"] = """SELECT intervention_id, CASE WHEN grain = 'cover' THEN sum(covers) ELSE count(*) END AS volume FROM o_arms WHERE arm = 't' AND grain IN ('cover', 'service') AND date >= exec_on AND date < exec_on + window_days GROUP BY intervention_id, grain
  UNION ALL SELECT intervention_id, sum(units) FROM o_iv JOIN item_days d ON d.loc = treat_loc AND d.item = treat_item WHERE grain = 'unit' AND date >= exec_on AND date < exec_on + window_days GROUP BY ALL
  UNION ALL SELECT intervention_id, sum(units) FROM o_iv JOIN item_days d ON d.loc = treat_loc JOIN reg_menu m ON m.item = d.item AND m.uses_sku = treat_sku WHERE grain = 'sku_unit' AND date >= exec_on AND date < exec_on + window_days GROUP BY ALL
  UNION ALL SELECT intervention_id, sum(qty) FROM o_iv JOIN reg_invoices r ON r.sku = treat_sku WHERE grain = 'sku' AND week >= exec_on AND week < exec_on + window_days GROUP BY ALL"""
ORACLE_VIEWS["o_scale"] = f"""SELECT i.intervention_id, CASE WHEN i.estimator = 'reconcile' THEN 1 WHEN direction = 'down_is_saving' THEN -1 ELSE 1 END AS sign,
    CASE WHEN grain = 'sku' THEN coalesce(volume, 0) / greatest(1, floor(span / 7 + 0.5)) ELSE coalesce(volume, 0) / span * 7 END AS week_factor
  FROM (SELECT *, greatest(1, least(window_days, date_diff('day', exec_on, {DAY}))) AS span FROM o_iv) i LEFT JOIN o_volume USING (intervention_id)"""
ORACLE_VIEWS["o_scaled"] = """SELECT e.* REPLACE (e.point * sign * week_factor AS point, e.se * week_factor AS se, e.mde * week_factor AS mde), sign, week_factor, e.point AS raw_point
  FROM o_scale JOIN o_est e USING (intervention_id)"""
ORACLE_VIEWS["o_guard_rows"] = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT intervention_id, arm, date, weekly, lever, '{g}' AS guardrail, {x} AS v FROM o_arms" for g, x in _GUARD_SQL.items()
) + ") JOIN o_lever_guards USING (lever, guardrail)"
ORACLE_VIEWS["o_lever_guards"] = values_view([(k, g) for k, v in dims.LEVERS.items() for g in v[7]], "lever, guardrail")
ORACLE_VIEWS["o_guard_dim"] = values_view([(k, *v) for k, v in dims.GUARDRAILS.items()], "guardrail, label, worse, kind, tol")
ORACLE_VIEWS["o_guard_daily"] = "SELECT intervention_id, guardrail, weekly, date, avg(CASE WHEN arm = 't' THEN v END) AS t, avg(CASE WHEN arm = 'c' THEN v END) AS c FROM o_guard_rows GROUP BY ALL"
ORACLE_VIEWS["o_guard_series"] = "SELECT intervention_id, guardrail, CASE WHEN weekly THEN date_trunc('week', date)::DATE ELSE date END AS date, avg(t) AS t, avg(c) AS c FROM o_guard_daily GROUP BY ALL"
ORACLE_VIEWS["o_guard_moments"] = f"""SELECT m.*, i.others OR i.metric = 'item_cost_per_unit' OR (i.dow IS NOT NULL AND NOT i.no_control) AS controlled FROM {moments_sql('o_guard_series', 'intervention_id, guardrail')} m JOIN o_iv i USING (intervention_id)"""
ORACLE_VIEWS["o_guard_est"] = f"""SELECT intervention_id, guardrail, ok, point, se, t_crit, m_t_pre FROM {did_sql('(SELECT * FROM o_guard_moments WHERE controlled)')}
  UNION ALL SELECT intervention_id, guardrail, ok, -point, se, t_crit, m_t_pre FROM {rec_sql('(SELECT * FROM o_guard_moments WHERE NOT controlled)')}"""
ORACLE_VIEWS["o_guards"] = """SELECT *, coalesce(CASE WHEN worse = 'down' THEN optimistic >= tolerance ELSE optimistic <= tolerance END, false) AS passed FROM (
  SELECT i.intervention_id, g.guardrail, d.label, worse, CASE WHEN e.ok THEN point END AS observed, CASE WHEN e.ok THEN CASE WHEN worse = 'down' THEN point + t_crit * se ELSE point - t_crit * se END END AS optimistic,
    CASE WHEN e.ok THEN CASE WHEN kind = 'abs' THEN tol ELSE tol * m_t_pre END END AS tolerance FROM o_iv i JOIN o_lever_guards g USING (lever) JOIN o_guard_dim d USING (guardrail)
  LEFT JOIN o_guard_est e ON e.intervention_id = i.intervention_id AND e.guardrail = g.guardrail)"""
ORACLE_VIEWS["o_gates"] = """SELECT i.*, e.* EXCLUDE (intervention_id, estimator), gr.n_failed, dq.data_pass, point - t_crit * se AS lower,
    fidelity IN ('complete', 'modified') AS g_exec, n_t_post >= min_obs AS g_obs, abs(point) >= mde AS g_power, placebo_ok AND placebo_pass AS g_trend, point - t_crit * se > 0 AS g_sign, pre_fit >= 0.55 AS g_comp, overlap_status <> 'unresolved' AS g_ovl
  FROM o_iv i LEFT JOIN o_scaled e USING (intervention_id) JOIN (SELECT intervention_id, count(*) FILTER (NOT passed) AS n_failed FROM o_guards GROUP BY ALL) gr USING (intervention_id)
  JOIN (SELECT intervention_id, NOT (lever = 'ticket_time') AS data_pass FROM o_iv) dq USING (intervention_id)"""
ORACLE_VIEWS["o_verdict"] = """SELECT *, CASE WHEN outcome IN ('verified', 'verified_limited') THEN greatest(0, floor(lower - floor(incremental_cost_cents / 52 + 0.5) - recurring_cost_cents - overlap_cents + 0.5)) END AS bookable_cents FROM (
  SELECT *, CASE WHEN NOT coalesce(ok, false) THEN 'inconclusive' WHEN NOT data_pass THEN 'data_failure' WHEN fidelity IN ('not_started', 'unknown') THEN 'inconclusive' WHEN placebo_ok AND NOT placebo_pass THEN 'inconclusive'
    WHEN n_failed > 0 THEN 'guardrail_failure' WHEN abs(index_share) > 0.5 THEN 'attribution_conflict' WHEN pre_fit < 0.4 AND abs(point) < mde THEN 'inconclusive'
    WHEN abs(point) < mde THEN CASE WHEN point > 0 AND lower > 0 THEN 'directional' WHEN projected_cents > 0 AND mde > projected_cents THEN 'inconclusive' ELSE 'no_effect' END
    WHEN point < 0 THEN 'negative' WHEN lower <= 0 THEN 'directional' WHEN NOT (g_exec AND g_obs AND g_power AND g_trend AND g_sign AND g_ovl) THEN 'inconclusive'
    WHEN NOT g_comp OR rung >= 4 OR n_t_post < preferred_obs THEN 'verified_limited' ELSE 'verified' END AS outcome FROM o_gates)"""


def evaluated(inp):
    return evaluate.evaluate_interventions(plans(inp), register(inp), feed_table(inp), AS_OF)


def _scoped(inp):
    reg = register(inp)
    return measure.scope_days(plans(inp), reg.services, AS_OF), (reg.invoices, reg.item_days, reg.menu)


def _series(inp):
    scoped, bought = _scoped(inp)
    return measure.build_series(scoped, *bought, AS_OF)


def _spans(inp):
    return measure.series_spans(plans(inp), inp.view("reg_invoices"), item_days(inp), AS_OF, whole=True)


def _scaled(scoped, bought):
    """Scoped plans, the moments of their service series and their estimates by the week."""
    moments = durable(measure.service_moments(scoped))
    raw = measure.measure_interventions(scoped, *bought, AS_OF, moments)
    return scoped.plans, moments, measure.scale_to_week(raw, scoped.plans, measure.window_volume(scoped, *bought), AS_OF)


@query("indexed_price", tidy_sql("SELECT * FROM o_indexed", keep="intervention_id arm", doubles="y", dates="date"))
def indexed_price(inp):
    return tidy(costing.indexed_price_series(measure.sku_price_arms(plans(inp)), inp.view("reg_invoices"), _spans(inp)).drop("volume"))


@query("frozen_price_usage", tidy_sql("SELECT * FROM o_usage_y", keep="intervention_id arm", doubles="y", dates="date", digits=4))
def frozen_price_usage(inp):
    return tidy(costing.frozen_price_usage(measure.sku_usage_arms(plans(inp)), inp.view("reg_invoices"), item_days(inp), inp.menu(), _spans(inp)), 4)


@query("build_series", tidy_sql("SELECT * FROM o_series", keep="intervention_id", doubles="t c", dates="date", digits=4))
def build_series(inp):
    return tidy(_series(inp).pairs(), 4)


@query(
    "did_estimates",
    tidy_sql(
        f"SELECT intervention_id, {_IF_OK} FROM {did_sql('o_moments')}",
        keep="intervention_id ok placebo_ok placebo_pass", ints="n_t_pre n_t_post n_c_pre n_c_post", doubles="point se df t_crit pre_fit mde", digits=4,
    ),
)
def did_estimates(inp):
    cols = ["point", "se", "df", "t_crit", "pre_fit", "mde", "n_t_pre", "n_t_post", "n_c_pre", "n_c_post", "placebo_ok", "placebo_pass"]
    return tidy(measure.did(_series(inp), plans(inp)).select(KEY, "ok", *cols), 4)


@query(
    "reconcile_estimates",
    tidy_sql(
        f"SELECT intervention_id, {_IF_OK} FROM {rec_sql('o_moments')}",
        keep="intervention_id ok", ints="n_t_pre n_t_post", doubles="point se df t_crit mde index_share", digits=4,
    ),
)
def reconcile_estimates(inp):
    return tidy(measure.reconcile(_series(inp), plans(inp)).select(KEY, "ok", "point", "se", "df", "t_crit", "mde", "index_share", "n_t_pre", "n_t_post"), 4)


@query(
    "weekly_effects",
    tidy_sql("SELECT i.intervention_id, coalesce(ok, false) AS ok, s.sign, s.week_factor, CASE WHEN ok THEN point END AS point, CASE WHEN ok THEN se END AS se, CASE WHEN ok THEN mde END AS mde, CASE WHEN ok THEN raw_point END AS raw_point FROM o_iv i LEFT JOIN o_scale s USING (intervention_id) LEFT JOIN o_scaled USING (intervention_id)", keep="intervention_id ok", ints="sign", doubles="point se mde week_factor raw_point", digits=3),
)
def weekly_effects(inp):
    return tidy(_scaled(*_scoped(inp))[2].select(KEY, "ok", "sign", "point", "se", "mde", "week_factor", "raw_point"), 3)


@query(
    "guardrail_results",
    tidy_sql("SELECT * FROM o_guards", keep="intervention_id guardrail label passed", doubles="observed optimistic tolerance", digits=4),
)
def guardrail_results(inp):
    scoped = measure.scope_days(plans(inp), services(inp), AS_OF)
    out = guardrails.run_guardrails(scoped.plans, measure.service_moments(scoped))
    return tidy(out.select(KEY, "guardrail", "label", "passed", "observed", "optimistic", "tolerance"), 4)


@query(
    "gate_results",
    """SELECT intervention_id, array_to_string(list_filter([CASE WHEN NOT g_exec THEN 'EXEC' END, CASE WHEN NOT coalesce(ok AND g_obs, false) THEN 'OBS' END, CASE WHEN NOT coalesce(ok AND g_power, false) THEN 'POWER' END,
      CASE WHEN NOT coalesce(ok AND g_trend, false) THEN 'TREND' END, CASE WHEN NOT coalesce(ok AND g_sign, false) THEN 'SIGN' END, CASE WHEN NOT data_pass THEN 'DQ' END, CASE WHEN NOT g_ovl THEN 'OVL' END], lambda x: x IS NOT NULL), '+') AS failed,
      CASE WHEN coalesce(ok AND g_comp, false) THEN '' ELSE 'COMP' END AS soft FROM o_gates""",
)
def gate_results(inp):
    ev = _verdicts(inp)
    fixed = F.filter("gates_failed", lambda g: ~g.startswith("GR:"))
    return ev.select(KEY, F.array_join(fixed, "+").alias("failed"), F.array_join("gates_soft", "+").alias("soft"))


def _verdicts(inp):
    p, moments, scaled = _scaled(*_scoped(inp))
    return evaluate.judge(p, scaled, guardrails.run_guardrails(p, moments), verify.data_quality(p, feed_table(inp)))


@query("verdicts", tidy_sql("SELECT * FROM o_verdict", keep="intervention_id outcome", ints="bookable_cents"))
def verdicts(inp):
    return tidy(_verdicts(inp).select(KEY, "outcome", "bookable_cents"))


ORACLE_VIEWS["o_closed"] = f"""SELECT * EXCLUDE (sign, week_factor), exec_on + latency_days + window_days AS eligible_on, fidelity IN ('complete', 'modified', 'partial') AS executed,
  fidelity IN ('complete', 'modified', 'partial') AND exec_on + latency_days + window_days <= {DAY} AS window_closed FROM o_verdict"""


@query(
    "evaluated_interventions",
    tidy_sql(
        f"""SELECT intervention_id, eligible_on, executed, window_closed, lever, CASE WHEN NOT window_closed THEN 'pending' ELSE outcome END AS outcome,
        CASE WHEN NOT executed THEN 'approved' WHEN NOT window_closed THEN 'measuring' WHEN outcome IN ('verified', 'verified_limited') THEN 'verified' WHEN outcome IN ('no_effect', 'negative', 'directional') THEN 'failed'
          WHEN outcome = 'guardrail_failure' THEN 'guardrail_failed' ELSE 'inconclusive' END AS verdict_state, coalesce(ok, false) AS ok, data_pass, CASE WHEN window_closed THEN bookable_cents END AS bookable_cents,
        CASE WHEN ok THEN point END AS point, CASE WHEN ok THEN se END AS se, CASE WHEN ok THEN mde END AS mde, CASE WHEN ok THEN t_crit END AS t_crit, CASE WHEN ok THEN pre_fit END AS pre_fit, n_t_pre, n_t_post, n_c_pre, n_c_post, sign, week_factor,
        CASE WHEN executed AND NOT window_closed THEN coalesce(seen, 0) ELSE 0 END AS observed, guards AS guardrails_total, guards - n_failed AS guardrails_passed
        FROM o_closed LEFT JOIN (SELECT intervention_id, count(*) AS seen FROM o_arms WHERE arm = 't' AND date >= exec_on AND date < {DAY} GROUP BY ALL) USING (intervention_id)
        JOIN (SELECT intervention_id, count(*) AS guards FROM o_guards GROUP BY ALL) USING (intervention_id) LEFT JOIN (SELECT intervention_id, sign, week_factor FROM o_scale) USING (intervention_id)""",
        keep="intervention_id executed window_closed lever outcome verdict_state ok data_pass", dates="eligible_on", doubles="point se mde t_crit pre_fit week_factor",
        ints="bookable_cents n_t_pre n_t_post n_c_pre n_c_post sign observed guardrails_total guardrails_passed", digits=3,
    ),
)
def evaluated_interventions(inp):
    cols = ["executed", "window_closed", "lever", "outcome", "verdict_state", "data_pass", "eligible_on", "point", "se", "mde", "t_crit", "pre_fit", "week_factor", "bookable_cents"]
    counts = ["n_t_pre", "n_t_post", "n_c_pre", "n_c_post", "sign", "observed", "guardrails_total", "guardrails_passed"]
    return tidy(evaluated(inp).evals.select(KEY, F.coalesce("ok", F.lit(False)).alias("ok"), *cols, *counts), 3)


# Claims for the persistence queries: every closed window is taken as if it had booked its projected value.
# Each has its own estimate made; a refused one stays, and says so.
ORACLE_VIEWS["o_claims"] = f"""SELECT i.intervention_id, i.exec_on, i.baseline_days, i.exec_on + i.latency_days + i.window_days AS eligible_on, i.estimator, s.sign, s.week_factor, i.projected_cents AS bookable_cents, coalesce(e.ok, false) AS ok
  FROM o_iv i JOIN o_scale s USING (intervention_id) LEFT JOIN (SELECT intervention_id, bool_or(ok) AS ok FROM o_est GROUP BY intervention_id) e USING (intervention_id) WHERE i.exec_on + i.latency_days + i.window_days <= {DAY}"""
ORACLE_VIEWS["o_cuts"] = f"SELECT *, eligible_on + CAST(7 * j AS INTEGER) AS cut FROM (SELECT *, unnest(range(0, CAST(floor(date_diff('day', eligible_on, {DAY}) / 7) AS BIGINT) + 1)) AS j FROM o_claims)"
ORACLE_VIEWS["o_effects"] = """SELECT intervention_id, ok, cut AS date, CASE WHEN estimator = 'did' THEN CASE WHEN tn1 >= 2 AND cn1 >= 2 AND tn0 >= 4 AND cn0 >= 4 THEN greatest(0, (t1 - t0 - (c1 - c0)) * sign * week_factor) ELSE bookable_cents END
    ELSE CASE WHEN tn0 >= 3 AND tn1 >= 2 THEN greatest(0, (t0 - t1) * sign * week_factor) ELSE bookable_cents END END AS y FROM (
  SELECT k.intervention_id, k.ok, k.cut, k.estimator, k.sign, k.week_factor, k.bookable_cents, avg(t) FILTER (pre) AS t0, avg(t) FILTER (post) AS t1, avg(c) FILTER (pre) AS c0, avg(c) FILTER (post) AS c1,
    count(t) FILTER (pre) AS tn0, count(t) FILTER (post) AS tn1, count(c) FILTER (pre) AS cn0, count(c) FILTER (post) AS cn1 FROM (
    SELECT k.*, s.t, s.c, s.date >= k.exec_on - k.baseline_days AND s.date < k.exec_on AS pre, s.date >= k.exec_on AND s.date < k.cut AS post FROM o_cuts k LEFT JOIN o_series s USING (intervention_id)) k GROUP BY ALL)"""


def claims(inp):
    scoped, bought = _scoped(inp)
    p, _, scaled = _scaled(scoped, bought)
    made = F.coalesce(F.max("ok").over(W.partitionBy(KEY)), F.lit(False))
    scaled = scaled.select(KEY, "sign", "week_factor", made.alias("ok"))
    closed = evaluate.closed_windows(p, AS_OF).filter(F.col("eligible_on") <= F.lit(AS_OF).cast("date"))
    return measure.build_series(scoped, *bought, AS_OF), durable(closed.withColumn("bookable_cents", F.col("projected_cents")).join(scaled, KEY))


@query("effect_over_time", tidy_sql("SELECT * FROM o_effects", keep="intervention_id ok", doubles="y", dates="date", digits=2))
def effect_over_time(inp):
    pairs, held = claims(inp)
    return tidy(persistence.effect_over_time(pairs, held, AS_OF, also=["ok"]), 2)


ORACLE_VIEWS["o_fit"] = """SELECT *, sqrt(greatest(syy - 2 * b * sxy + b * b * sxx, 0) / (n - 1) / sxx) AS se, CASE WHEN b < 0 THEN ln(2.0) / -b ELSE 'infinity'::DOUBLE END AS hl FROM (
  SELECT intervention_id, ok, count(*) AS n, regr_slope(l, i) AS b, regr_sxx(l, i) AS sxx, regr_syy(l, i) AS syy, regr_sxy(l, i) AS sxy, arg_max(v, i) / arg_min(v, i) AS retention FROM (
    SELECT intervention_id, ok, ln(greatest(y, 1)) AS l, greatest(y, 1) AS v, row_number() OVER (PARTITION BY intervention_id ORDER BY date) - 1 AS i FROM o_effects) GROUP BY ALL)"""


@query(
    "persistence_fit",
    tidy_sql(
        """SELECT intervention_id, ok, CASE WHEN n < 3 THEN 'not_assessed' WHEN retention < 0.6 THEN 'decaying' ELSE 'holding' END AS persistence_status,
        CASE WHEN n < 3 THEN NULL WHEN b - 1.96 * se <= 0 AND b + 1.96 * se >= 0 THEN 'structural' WHEN hl < 8 THEN 'upkeep' ELSE 'durable' END AS persistence_class,
        CASE WHEN n >= 3 THEN b END AS slope, CASE WHEN n >= 3 THEN retention END AS retention, CASE WHEN n >= 3 THEN floor(n / 4) ELSE 0 END AS checks, CASE WHEN n >= 3 THEN n END AS elapsed_weeks FROM o_fit""",
        keep="intervention_id ok persistence_status persistence_class", ints="checks elapsed_weeks", doubles="slope retention",
    ),
)
def persistence_fit(inp):
    pairs, held = claims(inp)
    out = persistence.persistence(persistence.effect_over_time(pairs, held, AS_OF), plans(inp))
    out = out.join(held.select(KEY, "ok").distinct(), KEY)
    return tidy(out.select(KEY, "ok", "persistence_status", "persistence_class", "slope", "retention", "checks", "elapsed_weeks"))


def records(inp):
    """The evaluated-intervention records under the operators' column names."""
    return inp.records("rec_evals").withColumnRenamed("id", KEY)


ORACLE_VIEWS["o_decay"] = f"""SELECT *, bookable_cents / 7 * CASE WHEN persistence_class IS NULL OR persistence_class = 'structural' THEN 1 WHEN persistence_class = 'upkeep' THEN 0.5 ** (w / greatest(coalesce(half_life_weeks, 1), 1)) ELSE 0.5 ** (w / greatest(coalesce(half_life_weeks, 52), 52)) END AS y FROM (
  SELECT *, floor(d / 7) AS w, eligible_on + CAST(d AS INTEGER) AS date FROM (SELECT *, unnest(range(0, greatest(0, date_diff('day', eligible_on, least(coalesce(reversal_on, {DAY}), {DAY}))))) AS d FROM rec_evals WHERE bookable_cents IS NOT NULL))"""


@query("accrual_daily", tidy_sql("SELECT id AS intervention_id, date, y FROM o_decay", keep="intervention_id", doubles="y", dates="date", digits=4))
def accrual_daily(inp):
    return tidy(persistence.accrual_days(records(inp), AS_OF).select(KEY, "date", "y"), 4)


ORACLE_VIEWS["o_realized"] = f"""SELECT e.id, e.k, e.bookable_cents, e.eligible_on, e.persistence_status, e.elapsed_weeks, e.loc, floor(coalesce(r, 0) + 0.5) AS realized_cents, CASE WHEN bookable_cents IS NULL THEN 0 ELSE floor(greatest(0, date_diff('day', eligible_on, {DAY})) / 7) END AS weeks_held,
    CASE WHEN bookable_cents IS NULL THEN 0 WHEN persistence_class IS NULL OR persistence_class = 'structural' THEN bookable_cents * 52 ELSE floor(bookable_cents * least(52, coalesce(half_life_weeks, 52) * 1.4427) + 0.5) END AS annual_run_rate_cents
  FROM rec_evals e LEFT JOIN (SELECT id, sum(y) AS r FROM o_decay GROUP BY id) USING (id)"""


@query("realized_savings", tidy_sql("SELECT id AS intervention_id, realized_cents, weeks_held, annual_run_rate_cents FROM o_realized", keep="intervention_id", ints="realized_cents weeks_held annual_run_rate_cents"))
def realized_savings(inp):
    return tidy(persistence.realize(records(inp), AS_OF).select(KEY, "realized_cents", "weeks_held", "annual_run_rate_cents"))


def with_reversals(inp):
    """Standing claims, of which every fourth carries a reversal date."""
    on = F.when(F.col("k") % 4 == 0, F.date_add("eligible_on", (F.col("k") % 60).cast("int")))
    rows = persistence.realize(records(inp), AS_OF).withColumn("reversal_on", on)
    return persistence.apply_reversals(rows.drop("reversed_claim_cents"), AS_OF)


ORACLE_VIEWS["o_reversed"] = f"""SELECT *, CASE WHEN gone THEN greatest(0, floor(date_diff('day', eligible_on, rev) / 7)) ELSE 0 END AS weeks_booked FROM (
  SELECT *, bookable_cents IS NOT NULL AND rev IS NOT NULL AND rev <= {DAY} AS gone FROM (SELECT *, CASE WHEN k % 4 = 0 THEN eligible_on + CAST(k % 60 AS INTEGER) END AS rev FROM o_realized))"""


@query(
    "reversals",
    tidy_sql(
        "SELECT id AS intervention_id, CASE WHEN gone THEN bookable_cents END AS reversed_claim_cents, weeks_booked, CASE WHEN gone THEN -floor(bookable_cents * weeks_booked + 0.5) ELSE 0 END AS adjustment_cents, CASE WHEN gone THEN 0 ELSE realized_cents END AS realized_cents FROM o_reversed",
        keep="intervention_id", ints="reversed_claim_cents weeks_booked adjustment_cents realized_cents",
    ),
)
def reversals(inp):
    return tidy(with_reversals(inp).select(KEY, "reversed_claim_cents", "weeks_booked", "adjustment_cents", "realized_cents"))


ORACLE_VIEWS["o_adjust"] = f"""SELECT 'Reversal' AS kind, id AS intervention_id, -floor(bookable_cents * weeks_booked + 0.5) AS cents, rev AS on_date, bookable_cents AS original_cents FROM o_reversed WHERE gone
  UNION ALL SELECT 'Decay', id, realized_cents - rate, eligible_on + CAST(floor(date_diff('day', eligible_on, {DAY}) / 7) * 7 AS INTEGER), rate FROM (
    SELECT *, floor(bookable_cents / 7 * greatest(0, date_diff('day', eligible_on, {DAY})) + 0.5) AS rate FROM o_reversed WHERE NOT gone AND persistence_status = 'decaying' AND bookable_cents IS NOT NULL) WHERE realized_cents - rate < 0"""


@query(
    "adjustments",
    tidy_sql(
        """SELECT a.*, coalesce(x.id, 'ADJ-' || lpad(CAST(row_number() OVER (PARTITION BY x.id IS NULL ORDER BY on_date, intervention_id, kind) + (SELECT max(CAST(substr(id, 5) AS BIGINT)) FROM rec_adjustments) AS VARCHAR), 4, '0')) AS id
        FROM o_adjust a LEFT JOIN rec_adjustments x USING (kind, intervention_id)""".replace("x.on_date", "on_date").replace("FROM o_adjust a LEFT JOIN rec_adjustments x", "FROM o_adjust a LEFT JOIN (SELECT id, kind, intervention_id FROM rec_adjustments) x"),
        keep="kind intervention_id id", ints="cents original_cents", dates="on_date",
    ),
)
def adjustments(inp):
    fresh = persistence.derive_adjustments(with_reversals(inp), AS_OF)
    out = persistence.number_adjustments(inp.view("rec_adjustments"), fresh, width=4)
    return tidy(out.select("kind", KEY, "id", "cents", "original_cents", "on_date"))


@query(
    "intervention_history",
    tidy_sql(
        f"""SELECT id AS intervention_id, decided_on AS on_date, 'approved' AS state FROM rec_evals UNION ALL SELECT id, exec_on, 'executed' FROM rec_evals WHERE fidelity <> 'not_started'
        UNION ALL SELECT id, CASE WHEN window_closed THEN eligible_on ELSE exec_on END, CASE WHEN window_closed THEN 'measuring' ELSE 'measurement_pending' END FROM rec_evals WHERE fidelity <> 'not_started'
        UNION ALL SELECT id, eligible_on, state FROM rec_evals WHERE window_closed UNION ALL SELECT id, reversal_on, 'reversed' FROM rec_evals WHERE reversed_claim_cents IS NOT NULL
        UNION ALL SELECT id, eligible_on + CAST(7 * i AS INTEGER), CASE WHEN persistence_status = 'decaying' AND i = n - n % 4 THEN 'decayed' ELSE 'persistent' END FROM (
          SELECT id, eligible_on, persistence_status, n, unnest(range(4, n + 1, 4)) AS i FROM (SELECT *, CAST(floor(date_diff('day', eligible_on, {DAY}) / 7) AS BIGINT) AS n FROM rec_evals WHERE window_closed AND persistence_status IS NOT NULL))""",
        keep="intervention_id state", dates="on_date",
    ),
)
def intervention_history(inp):
    evals = records(inp).withColumn("verdict_state", F.col("state")).withColumn("why", F.lit(None).cast("string"))
    weeks = F.floor(F.datediff(F.lit(AS_OF).cast("date"), "eligible_on") / 7).cast("int")
    effects = evals.filter("persistence_status IS NOT NULL").select(KEY, F.explode(F.sequence(F.lit(0), weeks)).alias("j"), "eligible_on").select(KEY, F.date_add("eligible_on", F.col("j") * 7).alias("date"))
    return tidy(persistence.intervention_history(evals, effects, AS_OF).select(KEY, "state", "on_date"))


@query(
    "refreshed_projections",
    tidy_sql(
        """SELECT e.id AS intervention_id, coalesce(CASE WHEN q.historical THEN q.recoverable_cents END, CASE WHEN NOT q.historical AND q.k % 2 = 0 THEN q.recoverable_cents END, e.projected_cents) AS projected_cents FROM rec_evals e JOIN o_qualified q ON q.id = e.finding_id""",
        keep="intervention_id", ints="projected_cents",
    ),
)
def refreshed_projections(inp):
    sized = lifecycle.size_findings(inp.view("rec_findings")).withColumnRenamed("id", "finding_id")
    out = persistence.refresh_projected(records(inp), sized.filter("historical"), sized.filter("NOT historical AND k % 2 = 0"))
    return tidy(out.select(KEY, "projected_cents"))


@query(
    "counterfactual_series",
    tidy_sql(
        """SELECT intervention_id, date, t, c, c + coalesce(pt - pc, 0) AS counterfactual FROM (
          SELECT *, avg(CASE WHEN date < exec_on THEN t END) OVER w AS pt, avg(CASE WHEN date < exec_on THEN c END) OVER w AS pc, count(*) OVER w AS n FROM (
            SELECT s.*, exec_on, row_number() OVER (PARTITION BY intervention_id ORDER BY date DESC) AS r FROM o_series s JOIN o_iv USING (intervention_id) WHERE t IS NOT NULL) WHERE r <= 40
          WINDOW w AS (PARTITION BY intervention_id)) WHERE n >= 4""",
        keep="intervention_id", doubles="t c counterfactual", dates="date", digits=4,
    ),
)
def counterfactual_series(inp):
    pairs, members = _series(inp).by_date(plans(inp))
    drawn = series.counterfactual_series(pairs).withColumnRenamed(KEY, "series")
    return tidy(members.join(drawn, "series").select(KEY, "date", "t", "c", "counterfactual"), 4)
