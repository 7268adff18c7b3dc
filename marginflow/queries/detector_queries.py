"""Queries over costing, labour and the seven detectors.

The test tables hold no planted drift, so thresholds are relaxed parameters and
the measures of every examined unit are compared.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import costing, detectors, labour
from ..session import durable
from .oracle_views import ORACLE_VIEWS
from .register_queries import item_days, role_shifts, services
from .registry import query, tidy, tidy_sql
from .series_queries import onset_sql, tq_sql
from .views import AS_OF

ROLES = ("ECONOMY", "STANDARD", "SMALL")
RELAXED = detectors.Thresholds(
    hours_services=3, hours_peers=15, hours_side=1, hours_delta=0.1, hours_cents=1, rate_rel_se=5.0, price_rows=20, price_pre=1,
    price_post=1, price_cents=1, usage_rows=5, usage_pre=1, usage_post=1, usage_cents=1, comps_services=10, comps_signals=1,
    comps_cents=1, menu_rows=20, menu_prices=3, menu_weeks=10, menu_cents=1, mix_rows=20, mix_cents=1, ticket_services=10,
    ticket_pre=1, ticket_post=1, ticket_minutes=0.01,
)
DAY = f"DATE '{AS_OF}'"


def served(inp):
    """Services as the register stores them: rolled up once, read by every branch of a detector."""
    return durable(services(inp))


def sold(inp):
    return durable(item_days(inp))


def chart_sql(src: str, by: str, baseline: str) -> str:
    """CUSUM columns over a CTE with (by…, date, v)."""
    base = f"CASE WHEN i <= greatest(2, least({baseline}, n)) THEN v END"
    return f"""(SELECT *, CASE WHEN s_hi > 4 THEN 'high' WHEN s_lo > 4 THEN 'low' END AS signal FROM (
      SELECT *, up - least(0, min(up) OVER r) AS s_hi, down - least(0, min(down) OVER r) AS s_lo FROM (
        SELECT *, sum((v - mu) / sd - 0.5) OVER r AS up, sum(-(v - mu) / sd - 0.5) OVER r AS down FROM (
          SELECT * REPLACE (CASE WHEN coalesce(sd, 0) = 0 THEN 1e-9 ELSE sd END AS sd) FROM (
            SELECT *, avg({base}) OVER f AS mu, stddev_samp({base}) OVER f AS sd FROM (
              SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY date) AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {src})
            WINDOW f AS (PARTITION BY {by})))
        WINDOW r AS (PARTITION BY {by} ORDER BY date ROWS UNBOUNDED PRECEDING))
      WINDOW r AS (PARTITION BY {by} ORDER BY date ROWS UNBOUNDED PRECEDING)))"""


def ewma_sql(src: str, by: str) -> str:
    """EWMA of a CTE with (by…, date, v) through the full kernel."""
    base = "CASE WHEN i <= greatest(2, least(28, n)) THEN v END"
    keys = [k.strip() for k in by.split(",")]
    on = " AND ".join(f"a.{k} = x.{k}" for k in keys)
    a_keys = ", ".join(f"a.{k}" for k in keys)
    based = f"""(SELECT * REPLACE (CASE WHEN coalesce(sd, 0) = 0 THEN 1e-9 ELSE sd END AS sd) FROM (
      SELECT *, avg({base}) OVER f AS mu, stddev_samp({base}) OVER f AS sd FROM (
        SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY date) AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {src})
      WINDOW f AS (PARTITION BY {by})))"""
    return f"""(WITH eb AS {based}, ez AS (SELECT {a_keys}, a.i, max(a.mu) * 0.75 ** a.i + sum(0.25 * 0.75 ** (a.i - x.i) * x.v) AS z
        FROM eb a JOIN eb x ON {on} AND x.i <= a.i GROUP BY {a_keys}, a.i)
      SELECT *, CASE WHEN z > mu + w THEN 'high' WHEN z < mu - w THEN 'low' END AS signal FROM (
        SELECT eb.*, z, sd * 3 * sqrt(0.25 / 1.75 * (1 - 0.75 ** (2 * i))) AS w FROM eb JOIN ez USING ({by}, i)))"""


ORACLE_VIEWS.update(
    {
        "o_unit_price": "SELECT sku, week AS date, sum(extended_cents) / greatest(sum(qty), 1e-9) AS v, sum(qty) AS qty FROM reg_invoices GROUP BY ALL",
        "o_plates": """SELECT loc, uses_sku AS sku, date_trunc('week', date)::DATE AS date, sum(units) AS plates, sum(units * qty_per_unit) AS theoretical
          FROM item_days JOIN reg_menu USING (item) WHERE uses_sku IS NOT NULL GROUP BY ALL""",
        "o_usage": """SELECT b.*, coalesce(theoretical, 0) AS theoretical, CASE WHEN coalesce(theoretical, 0) > 0 THEN bought / theoretical ELSE 1 END AS v FROM (
          SELECT loc, sku, week AS date, sum(qty) AS bought, avg(unit_price_cents) AS price, count(*) AS lines FROM reg_invoices
          WHERE sku IN (SELECT uses_sku FROM reg_menu WHERE uses_sku IS NOT NULL) GROUP BY ALL) b LEFT JOIN o_plates USING (loc, sku, date)""",
        "o_upc": """SELECT w.*, units / greatest(coalesce(covers, 1), 1) AS per_cover FROM (
          SELECT loc, item, date_trunc('week', date)::DATE AS date, sum(units) AS units, avg(price_cents) AS price, avg(cost_cents) AS cost FROM item_days GROUP BY ALL) w
          LEFT JOIN (SELECT loc, date_trunc('week', date)::DATE AS date, sum(covers) AS covers FROM services GROUP BY ALL) USING (loc, date) WHERE units > 0""",
        "o_staffed": f"""SELECT s.loc, s.date, s.daypart, s.dow, s.covers, coalesce(sh, 0) AS sh, coalesce(th, 0) AS th, coalesce(cost, 0) AS cost FROM services s LEFT JOIN (
          SELECT loc, date, daypart, coalesce(sum(CASE WHEN role IN {ROLES} THEN clocked_hours END), 0) AS sh, sum(clocked_hours) AS th, sum(clocked_hours * rate_cents) AS cost
          FROM role_shifts GROUP BY ALL) USING (loc, date, daypart) WHERE s.date >= {DAY} - 182""",
        "o_peer_rows": "SELECT p.loc, p.daypart, d.dow, p.date, p.covers, p.sh, p.th FROM o_staffed p, (SELECT unnest(range(0, 7)) AS dow) d WHERE d.dow <> p.dow",
        "o_peer_fit": """SELECT *, CASE WHEN above < greatest(12, n_all * 0.35) THEN rk - 1 >= floor(n_all * 0.4) ELSE sh > fl * 1.12 END AS used FROM (
          SELECT *, sum(CASE WHEN sh > fl * 1.12 THEN 1 ELSE 0 END) OVER (PARTITION BY loc, daypart, dow) AS above FROM (
            SELECT *, count(*) OVER (PARTITION BY loc, daypart, dow) AS n_all, quantile_cont(sh, 0.1) OVER (PARTITION BY loc, daypart, dow) AS fl,
              row_number() OVER (PARTITION BY loc, daypart, dow ORDER BY covers, date) AS rk FROM o_peer_rows))""",
        "o_rate0": """SELECT loc, daypart, dow, max(n_all) AS n_all, count(*) FILTER (used) AS n, max(fl) AS floor_hours,
          coalesce(regr_sxy(sh, covers) FILTER (used) / CASE WHEN regr_sxx(sh, covers) FILTER (used) > 1e-9 THEN regr_sxx(sh, covers) FILTER (used) END, 0) AS slope,
          regr_sxx(sh, covers) FILTER (used) AS sxx, regr_syy(sh, covers) FILTER (used) AS syy, regr_sxy(sh, covers) FILTER (used) AS sxy,
          avg(covers) FILTER (used) AS mx, avg(sh) FILTER (used) AS my, sum(th) / greatest(0.25, sum(sh)) AS roster_ratio FROM o_peer_fit GROUP BY ALL""",
        "o_rate": """SELECT loc, daypart, dow, n_all, n, floor_hours, slope, se_slope, my - slope * mx AS intercept, roster_ratio,
            CASE WHEN slope > 1e-9 THEN se_slope / slope END AS rel_se, CASE WHEN slope > 1e-4 AND se_slope / slope <= 5.0 THEN 1 / slope END AS mu
          FROM (SELECT *, CASE WHEN sxx > 1e-9 THEN sqrt(greatest(syy - sxy * sxy / sxx, 0) / greatest(n - 2, 1) / sxx) END AS se_slope FROM o_rate0)""",
        "o_req": """SELECT loc, date, daypart, dow, covers, th, cost, n_all, mu, roster_ratio, rel_se, hours AS dp_hours,
          greatest(2, covers / hours / mu + 0.6 * sqrt(greatest(covers / hours / mu, 0.01))) * hours * roster_ratio AS required
          FROM o_staffed JOIN reg_dayparts USING (daypart) LEFT JOIN o_rate USING (loc, daypart, dow)""",
        "o_excess": "SELECT loc, daypart, dow, date, th - CASE WHEN mu IS NOT NULL THEN required END AS v, CASE WHEN mu IS NOT NULL THEN required END AS required, th, cost, n_all, mu, roster_ratio FROM o_req",
        "o_excess_known": "SELECT loc, daypart, dow, date, v FROM o_excess WHERE mu IS NOT NULL",
        "o_price26": f"SELECT sku, week AS date, sum(extended_cents) / greatest(sum(qty), 1e-9) AS v, sum(qty) AS qty FROM reg_invoices WHERE week >= {DAY} - 182 GROUP BY ALL",
        "o_usage26": f"SELECT * FROM o_usage WHERE date >= {DAY} - 182",
        "o_comps26": f"SELECT loc, daypart, date, comps_cents / greatest(gross_cents, 1) AS v, gross_cents FROM services WHERE date >= {DAY} - 182",
        "o_peer_comps": f"""SELECT u.loc, p.daypart, p.date, CASE WHEN sum(p.gross_cents) > 0 THEN sum(p.comps_cents) / sum(p.gross_cents) ELSE 0 END AS v
          FROM (SELECT DISTINCT loc, daypart FROM services WHERE date >= {DAY} - 182) u JOIN services p ON p.daypart = u.daypart AND p.loc <> u.loc
          WHERE p.date >= {DAY} - 182 GROUP BY u.loc, p.daypart, p.date""",
        "o_ticket26": f"SELECT loc, daypart, date, ticket_min AS v FROM services WHERE date >= {DAY} - 182",
        "o_upc52": f"""SELECT w.*, ln(units / greatest(coalesce(covers, 1), 1)) AS ln_u, ln(price) AS ln_p, row_number() OVER (PARTITION BY loc, item ORDER BY date DESC) AS r FROM (
          SELECT loc, item, date_trunc('week', date)::DATE AS date, sum(units) AS units, avg(price_cents) AS price, avg(cost_cents) AS cost FROM item_days
          WHERE date >= {DAY} - 364 GROUP BY ALL) w
          LEFT JOIN (SELECT loc, date_trunc('week', date)::DATE AS date, sum(covers) AS covers FROM services GROUP BY ALL) USING (loc, date)""",
    }
)


@query("weekly_unit_price", tidy_sql("SELECT * FROM o_unit_price", keep="sku", doubles="v qty", dates="date"))
def weekly_unit_price(inp):
    return tidy(costing.weekly_unit_price(inp.view("reg_invoices")))


@query("usage_ratio", tidy_sql("SELECT * FROM o_usage", keep="loc sku", ints="lines", doubles="bought price theoretical v", dates="date"))
def usage_ratio(inp):
    return tidy(costing.purchased_vs_theoretical(inp.view("reg_invoices"), item_days(inp), inp.menu()))


@query("units_per_cover", tidy_sql("SELECT * FROM o_upc", keep="loc item", ints="units", doubles="price cost per_cover", dates="date"))
def units_per_cover(inp):
    return tidy(costing.units_per_cover(item_days(inp), services(inp)).drop("covers"))


@query(
    "mix_shares",
    tidy_sql(
        """SELECT loc, item, units / sum(units) OVER (PARTITION BY loc) AS share, unit_margin, units FROM (
        SELECT loc, item, sum(units) AS units, avg(price_cents - cost_cents) AS unit_margin FROM item_days GROUP BY ALL)""",
        keep="loc item", ints="units", doubles="share unit_margin",
    ),
)
def mix_shares(inp):
    return tidy(costing.mix_shares(item_days(inp)))


@query(
    "cm_per_cover",
    tidy_sql(
        """SELECT loc, CASE WHEN covers > 0 THEN m / covers ELSE 0 END AS cm_per_cover FROM (SELECT loc, sum(covers) AS covers FROM services GROUP BY loc)
        LEFT JOIN (SELECT loc, sum(units * (price_cents - cost_cents)) AS m FROM item_days GROUP BY loc) USING (loc)""",
        keep="loc", doubles="cm_per_cover",
    ),
)
def cm_per_cover(inp):
    return tidy(costing.cm_per_cover(item_days(inp), services(inp)))


def _staffed(inp):
    recent = services(inp).filter(F.col("date") >= F.lit(dates.weeks_back(AS_OF, 26)))
    return labour.staffed_services(recent, role_shifts(inp), ROLES)


@query(
    "service_rate",
    tidy_sql(
        "SELECT *, coalesce(mu, -1) AS mu_ FROM o_rate",
        keep="loc daypart", ints="dow n_all n", doubles="floor_hours slope intercept roster_ratio mu_",
    ),
)
def service_rate(inp):
    out = labour.service_rate(labour.other_weekdays(_staffed(inp)), ["loc", "daypart", "dow"], 5.0)
    return tidy(
        out.select("loc", "daypart", "dow", "n_all", "n", "floor_hours", "slope", "intercept", "roster_ratio", F.coalesce("mu", F.lit(-1.0)).alias("mu_"))
    )


@query(
    "required_hours",
    tidy_sql(
        """SELECT loc, date, daypart, CASE WHEN mu IS NOT NULL THEN required END AS required, CASE WHEN mu IS NOT NULL THEN abs((l / mu + 0.3 / sqrt(greatest(l, 0.01)) * (l / mu)) * dp_hours * roster_ratio) * rel_se * mu END AS se FROM (
        SELECT *, covers / dp_hours / mu AS l FROM o_req)""",
        keep="loc daypart", doubles="required se", dates="date", digits=4,
    ),
)
def required_hours(inp):
    rows = detectors.excess_rows(services(inp), role_shifts(inp), inp.view("reg_dayparts"), AS_OF, ROLES, RELAXED)
    se = labour.required_hours_se(F.col("covers"), F.col("daypart_hours"), F.col("mu"), F.col("rel_se"), F.col("roster_ratio"))
    return tidy(rows.select("loc", "date", "daypart", "required", se.alias("se")), 4)


LAB_BODY = f"""SELECT *, coalesce(n_recent >= 1 AND n_prior >= 1 AND services >= 3 AND peers >= 15 AND mu IS NOT NULL AND delta_hours >= 0.1 AND signal_date IS NOT NULL AND exposure_cents >= 1, false) AS fired FROM (
          SELECT *, floor(delta_hours * blended_rate + 0.5) AS exposure_cents FROM (
            SELECT loc, daypart, dow, count(*) AS services, max(n_all) AS peers, max(mu) AS mu, count(*) FILTER (date >= {DAY} - 84) AS n_recent,
              count(*) FILTER (date < {DAY} - 84) AS n_prior, avg(v) FILTER (date >= {DAY} - 84) - avg(v) FILTER (date < {DAY} - 84) AS delta_hours,
              avg(cost / greatest(th, 1)) FILTER (date >= {DAY} - 84) AS blended_rate FROM o_excess GROUP BY loc, daypart, dow)
          LEFT JOIN {onset_sql(chart_sql('o_excess_known', 'loc, daypart, dow', 'least(14, n - 6)'), 'loc, daypart, dow')} USING (loc, daypart, dow))"""


@query(
    "detect_excess_hours",
    tidy_sql(
        LAB_BODY,
        keep="loc daypart fired", ints="dow services peers n_recent n_prior exposure_cents", doubles="mu delta_hours blended_rate", dates="onset_date signal_date",
    ),
)
def detect_excess_hours(inp):
    out = detectors.detect_excess_hours(served(inp), durable(role_shifts(inp)), inp.view("reg_dayparts"), AS_OF, ROLES, RELAXED)
    return tidy(
        out.select("loc", "daypart", "dow", "services", "peers", "mu", "n_recent", "n_prior", "delta_hours", "blended_rate", "exposure_cents", "onset_date", "signal_date", "fired")
    )


def _sides(src: str, by: str, onset: str, measures: dict[str, str]) -> str:
    cols = ", ".join(f"avg({c}) FILTER (date < onset_date) AS {m}0, avg({c}) FILTER (date >= signal_date) AS {m}1" for m, c in measures.items())
    return f"""(SELECT {by}, max(onset_date) AS onset_date, max(signal_date) AS signal_date, count(*) FILTER (date < onset_date) AS n_pre,
      count(*) FILTER (date >= signal_date) AS n_post, {cols} FROM {src} LEFT JOIN {onset} USING ({by}) GROUP BY {by})"""


PPV_BODY = f"""SELECT *, coalesce(lines >= 20 AND signal_date IS NOT NULL AND n_pre >= 1 AND n_post >= 1 AND price_leg >= 1, false) AS fired, floor(price_leg + 0.5) AS exposure_cents FROM (
          SELECT *, (p1 - p0) * q1 AS price_leg, (q1 - q0) * p0 AS quantity_leg FROM {_sides('o_price26', 'sku', onset_sql(chart_sql('o_price26', 'sku', '10'), 'sku'), {'p': 'v', 'q': 'qty'})}
          JOIN (SELECT sku, count(*) AS lines, array_to_string(list_sort(list(DISTINCT loc)), '+') AS locs FROM reg_invoices WHERE week >= {DAY} - 182 GROUP BY sku) USING (sku))"""


@query(
    "detect_price_variance",
    tidy_sql(
        PPV_BODY,
        keep="sku locs fired", ints="lines n_pre n_post exposure_cents", doubles="p0 p1 q0 q1 price_leg quantity_leg", dates="onset_date signal_date", digits=4,
    ),
)
def detect_price_variance(inp):
    return tidy(detectors.detect_price_variance(inp.view("reg_invoices"), AS_OF, RELAXED), 4)


POR_BODY = f"""SELECT *, coalesce(lines >= 5 AND signal_date IS NOT NULL AND n_pre >= 1 AND n_post >= 1 AND exposure_cents >= 1, false) AS fired FROM (
          SELECT *, floor(excess_qty * price1 + 0.5) AS exposure_cents FROM (SELECT *, theoretical1 * (r1 - r0) AS excess_qty FROM
          {_sides('o_usage26', 'loc, sku', onset_sql(chart_sql('o_usage26', 'loc, sku', '10'), 'loc, sku'), {'r': 'v', 'theoretical': 'theoretical', 'price': 'price'})}
          JOIN (SELECT loc, sku, sum(lines) AS lines FROM o_usage26 GROUP BY ALL) USING (loc, sku)))"""


@query(
    "detect_usage_drift",
    tidy_sql(
        POR_BODY,
        keep="loc sku fired", ints="lines n_pre n_post exposure_cents", doubles="r0 r1 theoretical1 price1 excess_qty", dates="onset_date signal_date", digits=4,
    ),
)
def detect_usage_drift(inp):
    return tidy(detectors.detect_usage_drift(inp.view("reg_invoices"), sold(inp), inp.menu(), inp.view("reg_skus"), AS_OF, RELAXED).drop("items"), 4)


def _last28(src: str) -> str:
    return f"""(SELECT loc, daypart, max(n) AS n, count(*) AS n_recent, count(*) FILTER (signal = 'high') AS signals, avg(z) AS z, avg(v) AS actual, max(mu) AS baseline
      FROM (SELECT *, row_number() OVER (PARTITION BY loc, daypart ORDER BY date DESC) AS r FROM {ewma_sql(src, 'loc, daypart')}) WHERE r <= 28 GROUP BY ALL)"""


CMP_BODY = f"""SELECT *, coalesce(services >= 10 AND signals >= 1 AND NOT peers_breach AND exposure_cents >= 1, false) AS fired FROM (
          SELECT loc, daypart, o.n AS services, o.signals, o.n_recent, o.actual, o.baseline, o.z - o.baseline AS excess_rate, week_gross, p.n AS peer_dates, p.signals AS peer_signals,
            floor((o.z - o.baseline) * week_gross + 0.5) AS exposure_cents, coalesce(p.n >= 10 AND p.signals >= 1, false) AS peers_breach, onset_date, signal_date
          FROM {_last28('o_comps26')} o JOIN (SELECT loc, daypart, coalesce(sum(gross_cents) FILTER (date >= {DAY} - 7), 0) AS week_gross FROM o_comps26 GROUP BY ALL) USING (loc, daypart)
          LEFT JOIN {_last28('o_peer_comps')} p USING (loc, daypart)
          LEFT JOIN {onset_sql(chart_sql('o_comps26', 'loc, daypart', '28'), 'loc, daypart')} USING (loc, daypart))"""


@query(
    "detect_comps_rate",
    tidy_sql(
        CMP_BODY,
        keep="loc daypart peers_breach fired", ints="services signals n_recent peer_dates peer_signals week_gross exposure_cents", doubles="actual baseline excess_rate", dates="onset_date signal_date",
    ),
)
def detect_comps_rate(inp):
    return tidy(detectors.detect_comps_rate(served(inp), AS_OF, RELAXED))


_GAIN = "floor((target - cost) * units_now * (target / price) ** ({e}) - (price - cost) * units_now + 0.5)"


PRC_BODY = f"""SELECT *, coalesce(p_star > max_price * 1.25, false) AS extrapolating, coalesce(rows >= 20 AND prices >= 3 AND weeks >= 10 AND se < abs(elasticity) / 2 AND elasticity < -1
            AND slope_of_margin > 0 AND target > price AND exposure_cents >= 1, false) AS fired FROM (
          SELECT *, {_GAIN.format(e='elasticity')} AS exposure_cents, {_GAIN.format(e='elasticity - t_crit * se')} AS low_cents, {_GAIN.format(e='elasticity + t_crit * se')} AS high_cents FROM (
            SELECT *, price * (1 + elasticity) - cost * elasticity AS slope_of_margin, CASE WHEN elasticity < -1 THEN floor(least(p_star, price * 1.08, max_price * 1.25) / 25 + 0.5) * 25 END AS target,
              {tq_sql('1.6448536269514729', 'weeks - 2')} AS t_crit FROM (
              SELECT *, CASE WHEN elasticity < -1 THEN cost * elasticity / (1 + elasticity) END AS p_star FROM (
                SELECT loc, item, rows, prices, max_price, weeks, price, cost, units_now, CASE WHEN sxx > 1e-9 THEN sxy / sxx ELSE 0 END AS elasticity,
                  CASE WHEN sxx > 1e-9 THEN sqrt(greatest(syy - sxy * sxy / sxx, 0) / (weeks - 2) / sxx) ELSE 99 END AS se FROM (
                  SELECT loc, item, count(*) AS weeks, regr_sxx(ln_u, ln_p) AS sxx, regr_syy(ln_u, ln_p) AS syy, regr_sxy(ln_u, ln_p) AS sxy,
                    max(CASE WHEN r = 1 THEN price END) AS price, max(CASE WHEN r = 1 THEN cost END) AS cost, avg(CASE WHEN r <= 8 THEN units END) AS units_now FROM o_upc52 GROUP BY ALL)
                JOIN (SELECT loc, item, count(*) AS rows, count(DISTINCT price_cents) AS prices, max(price_cents) AS max_price FROM item_days WHERE date >= {DAY} - 364 GROUP BY ALL) USING (loc, item)))))"""


@query(
    "detect_underpriced_item",
    tidy_sql(
        PRC_BODY,
        keep="loc item extrapolating fired", ints="rows prices max_price weeks exposure_cents", doubles="price cost units_now elasticity se p_star target slope_of_margin", digits=4,
    ),
)
def detect_underpriced_item(inp):
    out = detectors.detect_underpriced_item(sold(inp), served(inp), inp.menu(), AS_OF, RELAXED)
    return tidy(out.withColumn("target", F.col("target").cast("double")).drop("low_cents", "high_cents", "t_crit"), 4)


ORACLE_VIEWS["o_mix"] = f"""WITH a AS (SELECT loc, item, coalesce(sum(units) FILTER (NOT late), 0) AS u0, coalesce(sum(units) FILTER (late), 0) AS u1,
    coalesce(avg(price_cents - cost_cents) FILTER (NOT late), 0) AS m0, coalesce(avg(price_cents - cost_cents) FILTER (late), 0) AS m1,
    count(*) FILTER (NOT late) AS r0, count(*) FILTER (late) AS r1 FROM (SELECT *, date >= {DAY} - 56 AS late FROM item_days WHERE date >= {DAY} - 112) GROUP BY loc, item),
  b AS (SELECT a.*, sum(u0) OVER (PARTITION BY loc) AS ru0, sum(u1) OVER (PARTITION BY loc) AS ru1, sum(r0) OVER (PARTITION BY loc) AS rr0, sum(r1) OVER (PARTITION BY loc) AS rr1 FROM a),
  c AS (SELECT b.*, coalesce((SELECT sum(u1) FROM a x WHERE x.loc <> b.loc AND x.item = b.item), 0) / (SELECT sum(u1) FROM a x WHERE x.loc <> b.loc)
      - coalesce((SELECT sum(u0) FROM a x WHERE x.loc <> b.loc AND x.item = b.item), 0) / (SELECT sum(u0) FROM a x WHERE x.loc <> b.loc) AS shift FROM b),
  d AS (SELECT *, coalesce(u0 / nullif(ru0, 0), 0) AS share_pre, coalesce(u1 / nullif(ru1, 0), 0) AS share_now FROM c)
  SELECT loc, item, share_pre, share_now, share_now - share_pre - shift AS d_share, m1 - m0 AS d_margin, (share_now - share_pre - shift) * m0 AS mix_effect,
    share_now * (m1 - m0) AS cm_effect, (share_now - share_pre - shift) * (m1 - m0) AS cross_effect, ru1, rr0, rr1 FROM d"""


@query(
    "mix_drivers",
    tidy_sql(
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY loc ORDER BY mix_effect, item) AS rank FROM o_mix) WHERE rank <= 6",
        keep="loc item", ints="rank", doubles="share_pre share_now d_share d_margin mix_effect cm_effect cross_effect",
    ),
)
def mix_drivers(inp):
    return tidy(detectors.top_drivers(detectors.mix_effects(item_days(inp), AS_OF)).drop("room_u1", "room_r0", "room_r1"))


MIX_BODY = """SELECT *, abs(weekly_cents) AS exposure_cents, rows_pre >= 20 AND rows_post >= 20 AND weekly_cents <= -1 AS fired FROM (
          SELECT loc, sum(mix_effect) AS mix_effect, sum(cm_effect) AS cm_effect, sum(cross_effect) AS cross_effect, max(ru1) / 8 AS weekly_units, max(rr0) AS rows_pre, max(rr1) AS rows_post,
            floor(sum(mix_effect) * max(ru1) / 8 + 0.5) AS weekly_cents FROM o_mix GROUP BY loc)"""


@query(
    "detect_mix_shift",
    tidy_sql(
        MIX_BODY,
        keep="loc fired", ints="rows_pre rows_post weekly_cents exposure_cents", doubles="mix_effect cm_effect cross_effect weekly_units",
    ),
)
def detect_mix_shift(inp):
    return tidy(detectors.detect_mix_shift(sold(inp), AS_OF, RELAXED))


TKT_BODY = f"""SELECT *, coalesce(services >= 10 AND signal_date IS NOT NULL AND n_post >= 1 AND n_pre >= 1 AND delta_min >= 0.01, false) AS fired FROM (
          SELECT *, greatest(0, floor(delta_min / 60 * 0.8 * constrained_share * cm_per_cover * weekly_covers * 0.35 + 0.5)) AS exposure_cents FROM (
            SELECT *, t1 - t0 AS delta_min FROM {_sides('o_ticket26', 'loc, daypart', onset_sql(chart_sql('o_ticket26', 'loc, daypart', '28'), 'loc, daypart'), {'t': 'v'})}
            JOIN (SELECT loc, daypart, count(*) AS services, coalesce(avg(constrained_share) FILTER (date >= {DAY} - 56), 0) AS constrained_share,
              coalesce(sum(covers) FILTER (date >= {DAY} - 7), 0) AS weekly_covers FROM services WHERE date >= {DAY} - 182 GROUP BY ALL) USING (loc, daypart)
            JOIN (SELECT loc, m / c AS cm_per_cover FROM (SELECT loc, sum(covers) AS c FROM services WHERE date >= {DAY} - 56 GROUP BY loc)
              JOIN (SELECT loc, sum(units * (price_cents - cost_cents)) AS m FROM item_days WHERE date >= {DAY} - 56 GROUP BY loc) USING (loc)) USING (loc)))"""


@query(
    "detect_ticket_drift",
    tidy_sql(
        TKT_BODY,
        keep="loc daypart fired", ints="n_pre n_post services weekly_covers exposure_cents", doubles="t0 t1 constrained_share cm_per_cover delta_min", dates="onset_date signal_date",
    ),
)
def detect_ticket_drift(inp):
    return tidy(detectors.detect_ticket_drift(served(inp), sold(inp), AS_OF, th=RELAXED).drop("blocked"))


def _stricter(body: str, *swaps: tuple[str, str]) -> str:
    """A detector's SQL with the engine's own limits in place of the relaxed ones."""
    for old, new in swaps:
        assert old in body, old
        body = body.replace(old, new)
    return body


_SIDES_4_3 = ("n_pre >= 1 AND n_post >= 1", "n_pre >= 4 AND n_post >= 3")
DEFAULT_BODIES = {
    "PPV": ("sku", _stricter(PPV_BODY, _SIDES_4_3, ("price_leg >= 1,", "price_leg >= 8000,"))),
    "POR": ("loc || '/' || sku", _stricter(POR_BODY, ("lines >= 5 ", "lines >= 16 "), _SIDES_4_3, ("exposure_cents >= 1,", "exposure_cents >= 6000,"))),
    "CMP": ("loc || '/' || daypart", _stricter(CMP_BODY, ("services >= 10 AND signals >= 1 ", "services >= 40 AND signals >= 8 "), ("p.n >= 10 AND p.signals >= 1,", "p.n >= 40 AND p.signals >= 8,"), ("exposure_cents >= 1,", "exposure_cents >= 5000,"))),
    "PRC": ("loc || '/' || item", _stricter(PRC_BODY, ("rows >= 20 ", "rows >= 120 "), ("weeks >= 10 ", "weeks >= 24 "), ("exposure_cents >= 1,", "exposure_cents >= 5000,"))),
    "MIX": ("loc", _stricter(MIX_BODY, ("rows_pre >= 20 AND rows_post >= 20 AND weekly_cents <= -1 ", "rows_pre >= 200 AND rows_post >= 200 AND weekly_cents <= -9000 "))),
    "TKT": ("loc || '/' || daypart", _stricter(TKT_BODY, ("services >= 10 ", "services >= 40 "), ("n_post >= 1 AND n_pre >= 1 AND delta_min >= 0.01,", "n_post >= 8 AND n_pre >= 12 AND delta_min >= 1.5,"))),
}


@query(
    "default_detections",
    "\nUNION ALL ".join(f"SELECT '{code}' AS detector, {scope} AS scope, fired FROM ({body})" for code, (scope, body) in DEFAULT_BODIES.items()),
)
def default_detections(inp):
    """What the detectors judge at the engine's own limits, fired or not: one row per unit that each looked at."""
    items, services_, bought = sold(inp), served(inp), inp.view("reg_invoices")
    found = {
        "PPV": (("sku",), detectors.detect_price_variance(bought, AS_OF)),
        "POR": (("loc", "sku"), detectors.detect_usage_drift(bought, items, inp.menu(), inp.view("reg_skus"), AS_OF)),
        "CMP": (("loc", "daypart"), detectors.detect_comps_rate(services_, AS_OF)),
        "PRC": (("loc", "item"), detectors.detect_underpriced_item(items, services_, inp.menu(), AS_OF)),
        "MIX": (("loc",), detectors.detect_mix_shift(items, AS_OF)),
        "TKT": (("loc", "daypart"), detectors.detect_ticket_drift(services_, items, AS_OF)),
    }
    parts = [df.select(F.lit(code).alias("detector"), F.concat_ws("/", *unit).alias("scope"), "fired") for code, (unit, df) in found.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
