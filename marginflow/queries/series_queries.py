"""Queries over dated series: scopes, weeks, statistics, control charts, change points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numeric, text
from ..operators import series as S
from ..operators import spc
from .oracle_views import ORACLE_VIEWS
from .register_queries import item_days, services
from .registry import query, tidy, tidy_sql
from .views import AS_OF

BY = ["loc", "daypart"]

ORACLE_VIEWS.update(
    {
        "comps_series": "SELECT loc, daypart, date, comps_cents / greatest(gross_cents, 1) AS v FROM services",
        "weekly_comps": """SELECT loc, date_trunc('week', date)::DATE AS date, sum(comps_cents) / greatest(sum(gross_cents), 1) AS v
          FROM services GROUP BY ALL""",
        "o_based": """SELECT *, avg(CASE WHEN i <= greatest(2, least(28, n)) THEN v END) OVER w AS mu,
          CASE WHEN coalesce(stddev_samp(CASE WHEN i <= greatest(2, least(28, n)) THEN v END) OVER w, 0) = 0 THEN 1e-9
            ELSE stddev_samp(CASE WHEN i <= greatest(2, least(28, n)) THEN v END) OVER w END AS sd
          FROM (SELECT *, row_number() OVER (PARTITION BY loc, daypart ORDER BY date) AS i, count(*) OVER (PARTITION BY loc, daypart) AS n FROM comps_series)
          WINDOW w AS (PARTITION BY loc, daypart)""",
        "o_cusum": """SELECT *, up - least(0, min(up) OVER r) AS s_hi, down - least(0, min(down) OVER r) AS s_lo FROM (
            SELECT *, sum((v - mu) / sd - 0.5) OVER (PARTITION BY loc, daypart ORDER BY date ROWS UNBOUNDED PRECEDING) AS up,
              sum(-(v - mu) / sd - 0.5) OVER (PARTITION BY loc, daypart ORDER BY date ROWS UNBOUNDED PRECEDING) AS down FROM o_based)
          WINDOW r AS (PARTITION BY loc, daypart ORDER BY date ROWS UNBOUNDED PRECEDING)""",
        "o_cusum_sig": "SELECT *, CASE WHEN s_hi > 4 THEN 'high' WHEN s_lo > 4 THEN 'low' END AS signal FROM o_cusum",
    }
)


def onset_sql(cusum: str, by: str, direction: str | None = "high", lookback: int = 120) -> str:
    """Onset of every signalling series of a CTE with (by…, date, i, n, v, s_hi, s_lo, signal)."""
    hit = f"signal = '{direction}'" if direction else "signal IS NOT NULL"
    return f"""(WITH o_s AS (SELECT *, min(CASE WHEN {hit} THEN i END) OVER (PARTITION BY {by}) AS sig FROM {cusum}),
      o_d AS (SELECT *, max(CASE WHEN i = sig THEN signal END) OVER (PARTITION BY {by}) AS dir FROM o_s WHERE sig IS NOT NULL),
      o_w AS (SELECT *, coalesce(max(CASE WHEN i < sig AND (CASE WHEN dir = 'high' THEN s_hi ELSE s_lo END) = 0 THEN i END) OVER (PARTITION BY {by}), 0) + 1 AS walk,
          greatest(1, sig - {lookback}) AS lo, least(n, sig + 6) AS hi FROM o_d),
      o_seg AS (SELECT *, i - lo + 1 AS t, hi - lo + 1 AS m, sum(v) OVER (PARTITION BY {by} ORDER BY date ROWS UNBOUNDED PRECEDING) AS pre,
          sum(v) OVER (PARTITION BY {by}) AS tot FROM o_w WHERE i BETWEEN lo AND hi),
      o_sc AS (SELECT *, (tot - pre) / (m - t) - pre / t AS diff FROM o_seg WHERE m >= 6 AND t >= 3 AND t <= m - 3),
      o_best AS (SELECT {by}, arg_max(i + 1, (abs(diff) * sqrt(t * (m - t) / m), -t)) AS cp FROM o_sc
          WHERE (dir = 'high' AND diff > 0) OR (dir = 'low' AND diff < 0) GROUP BY {by}),
      o_pick AS (SELECT w.*, CASE WHEN cp >= walk AND cp <= sig THEN cp ELSE walk END AS onset FROM o_w w LEFT JOIN o_best USING ({by}))
      SELECT {by}, max(onset) AS onset_index, max(CASE WHEN i = onset THEN date END) AS onset_date, max(sig) AS signal_index,
        max(CASE WHEN i = sig THEN date END) AS signal_date, max(dir) AS direction FROM o_pick GROUP BY {by})"""


def comps_series(inp):
    return services(inp).select(*BY, "date", S.comps_rate().alias("v"))


@query(
    "scope_series",
    tidy_sql(
        f"""SELECT date, avg(net_cents / greatest(covers, 1)) AS y FROM services WHERE loc IN ('R0', 'R2') AND daypart IN ('F', 'O')
        AND dow IN (1, 2, 3, 4) AND date >= DATE '2000-08-02' AND date < DATE '{AS_OF}' GROUP BY date""",
        doubles="y", dates="date",
    ),
)
def scope_series(inp):
    scope = S.service_scope(["R0", "R2"], ["F", "O"], [1, 2, 3, 4]) & dates.between("date", dates.weeks_back("2001-08-01", 52), AS_OF)
    return tidy(S.service_series(services(inp), scope, S.service_metric("net_per_cover")))


@query(
    "item_series",
    tidy_sql(
        "SELECT loc, date, CAST(sum(units * cost_cents) AS DOUBLE) AS y FROM item_days WHERE item IN ('Brand#3', 'Brand#7', 'Brand#12') GROUP BY loc, date",
        keep="loc", doubles="y", dates="date",
    ),
)
def item_series(inp):
    return tidy(S.item_series(item_days(inp), None, ["Brand#3", "Brand#7", "Brand#12"], F.col("units") * F.col("cost_cents"), by=["loc"]))


@query(
    "weekly_series",
    tidy_sql(
        """SELECT loc, date_trunc('week', date)::DATE AS date, avg(y) AS mean_y, sum(y) AS sum_y FROM (
        SELECT loc, date, CAST(sum(net_cents) AS DOUBLE) AS y FROM services GROUP BY loc, date) GROUP BY ALL""",
        keep="loc", doubles="mean_y sum_y", dates="date",
    ),
)
def weekly_series(inp):
    daily = S.service_series(services(inp), F.lit(True), F.col("net_cents"), "sum", by=["loc"])
    mean = S.to_weekly(daily, "mean", ["loc"]).withColumnRenamed("y", "mean_y")
    total = S.to_weekly(daily, "sum", ["loc"]).withColumnRenamed("y", "sum_y")
    return tidy(mean.join(total, ["loc", "date"]))


@query(
    "service_metrics",
    tidy_sql(
        """SELECT loc, date, daypart, labor_cents / greatest(covers, 1) AS labour_per_cover, comps_cents / greatest(covers, 1) AS comps_per_cover,
        (net_cents - cogs_cents) / greatest(covers, 1) AS cm_per_cover, cogs_cents / greatest(covers, 1) AS cogs_per_cover,
        net_cents / greatest(covers, 1) AS net_per_cover, ticket_min FROM services""",
        keep="loc daypart", doubles="labour_per_cover comps_per_cover cm_per_cover cogs_per_cover net_per_cover ticket_min", dates="date",
    ),
)
def service_metrics(inp):
    return tidy(services(inp).select("loc", "date", "daypart", *(S.service_metric(m).alias(m) for m in S.SERVICE_METRICS)))


@query(
    "series_stats",
    tidy_sql(
        """SELECT loc, daypart, count(v) AS n, sum(v) AS total, avg(v) AS mean, coalesce(var_samp(v), 0) AS variance,
        coalesce(stddev_samp(v), 0) AS sd FROM comps_series GROUP BY ALL""",
        keep="loc daypart", ints="n", doubles="total mean variance sd",
    ),
)
def series_stats(inp):
    return tidy(S.describe(comps_series(inp), BY, "v"))


@query(
    "series_quantiles",
    tidy_sql(
        "SELECT loc, daypart, quantile_cont(v, 0.1) AS p10, median(v) AS p50, quantile_cont(v, 0.9) AS p90 FROM comps_series GROUP BY ALL",
        keep="loc daypart", doubles="p10 p50 p90",
    ),
)
def series_quantiles(inp):
    return tidy(S.quantiles(comps_series(inp), BY, {"p10": 0.1, "p50": 0.5, "p90": 0.9}, "v"))


@query(
    "series_ols",
    tidy_sql(
        """SELECT loc, daypart, count(*) AS n, regr_slope(hours, covers) AS slope, regr_intercept(hours, covers) AS intercept,
        sqrt(greatest(regr_syy(hours, covers) - regr_sxy(hours, covers) ** 2 / regr_sxx(hours, covers), 0) / greatest(count(*) - 2, 1) / regr_sxx(hours, covers)) AS se_slope
        FROM services GROUP BY ALL""",
        keep="loc daypart", ints="n", doubles="slope intercept se_slope",
    ),
)
def series_ols(inp):
    rows = services(inp).withColumn("covers", F.col("covers").cast("double"))
    return tidy(S.ols(rows, BY, "covers", "hours"))


@query(
    "series_index_slope",
    tidy_sql(
        """SELECT loc, daypart, regr_slope(v, i) AS slope FROM (SELECT *, row_number() OVER (PARTITION BY loc, daypart ORDER BY date) - 1 AS i FROM comps_series) GROUP BY ALL""",
        keep="loc daypart", doubles="slope", digits=10,
    ),
)
def series_index_slope(inp):
    return tidy(S.index_slope(comps_series(inp).withColumnRenamed("v", "y"), BY), 10)


@query(
    "price_cover_corr",
    tidy_sql(
        "SELECT loc, daypart, count(*) AS n, CASE WHEN count(*) > 1 THEN coalesce(corr(net_cents / greatest(covers, 1), covers), 0) ELSE 0 END AS r FROM services GROUP BY ALL",
        keep="loc daypart", ints="n", doubles="r",
    ),
)
def price_cover_corr(inp):
    rows = services(inp).withColumn("x", S.service_metric("net_per_cover")).withColumn("covers", F.col("covers").cast("double"))
    return tidy(S.correlation(rows, BY, "x", "covers"))


@query(
    "welch",
    tidy_sql(
        """SELECT loc, daypart, n_a, n_b, mean_a, mean_b, sqrt(a + b) AS se, (a + b) ** 2 / (a * a / greatest(n_a - 1, 1) + b * b / greatest(n_b - 1, 1)) AS df FROM (
          SELECT loc, daypart, count(x) AS n_a, count(y) AS n_b, avg(x) AS mean_a, avg(y) AS mean_b, var_samp(x) / count(x) AS a, var_samp(y) / count(y) AS b FROM (
            SELECT loc, daypart, CASE WHEN date < DATE '2000-01-01' THEN v END AS x, CASE WHEN date >= DATE '2000-01-01' THEN v END AS y FROM comps_series) GROUP BY ALL)""",
        keep="loc daypart", ints="n_a n_b", doubles="mean_a mean_b se df",
    ),
)
def welch(inp):
    return tidy(S.welch(comps_series(inp), BY, "v", F.col("date") < dates.day("2000-01-01")))


def _poly(coefs, x):
    out = str(coefs[0])
    for c in coefs[1:]:
        out = f"({out} * {x} + {c})"
    return out


def zq_sql(p: str) -> str:
    lo, hi = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))"
    mid, sq = f"(({p}) - 0.5)", f"(({p}) - 0.5) ** 2"
    tail = lambda q: f"{_poly(numeric._C, q)} / {_poly((*numeric._D, 1.0), q)}"
    return f"""CASE WHEN ({p}) < 0.02425 THEN {tail(lo)} WHEN ({p}) > 1 - 0.02425 THEN -({tail(hi)})
      ELSE {_poly(numeric._A, sq)} * {mid} / {_poly((*numeric._B, 1.0), sq)} END"""


def tq_sql(z: str, df: str) -> str:
    d = f"greatest(CAST({df} AS DOUBLE), 1)"
    return f"""({z} + ({z} ** 3 + {z}) / 4 / {d} + (5 * {z} ** 5 + 16 * {z} ** 3 + 3 * {z}) / 96 / ({d} ** 2)
      + (3 * {z} ** 7 + 19 * {z} ** 5 + 17 * {z} ** 3 - 15 * {z}) / 384 / ({d} ** 3))"""


@query(
    "quantile_functions",
    tidy_sql(
        f"""SELECT o_orderkey, z, {tq_sql('z', 'df')} AS t FROM (
          SELECT o_orderkey, df, {zq_sql('p')} AS z FROM (SELECT o_orderkey, (o_orderkey % 997 + 1) / 999.0::DOUBLE AS p, 1 + o_orderkey % 60 AS df FROM orders))""",
        ints="o_orderkey", doubles="z t",
    ),
)
def quantile_functions(inp):
    p = (F.col("o_orderkey") % 997 + 1) / F.lit(999.0)
    df = 1 + F.col("o_orderkey") % 60
    return tidy(inp.base["orders"].select("o_orderkey", numeric.normal_quantile(p).alias("z"), numeric.student_t_quantile(p, df).alias("t")))


@query(
    "ewma_chart",
    tidy_sql(
        """SELECT loc, daypart, date, i, z, mu + w AS ucl, mu - w AS lcl, CASE WHEN z > mu + w THEN 'high' WHEN z < mu - w THEN 'low' ELSE 'none' END AS signal FROM (
          SELECT b.*, sd * 3 * sqrt(0.25 / 1.75 * (1 - 0.75 ** (2 * i))) AS w, k.z FROM o_based b JOIN (
            SELECT a.loc, a.daypart, a.i, max(a.mu) * 0.75 ** a.i + sum(0.25 * 0.75 ** (a.i - x.i) * x.v) AS z
            FROM o_based a JOIN o_based x ON a.loc = x.loc AND a.daypart = x.daypart AND x.i <= a.i AND x.i > a.i - 180 GROUP BY a.loc, a.daypart, a.i) k USING (loc, daypart, i))""",
        keep="loc daypart signal", ints="i", doubles="z ucl lcl", dates="date",
    ),
)
def ewma_chart(inp):
    out = spc.ewma_chart(comps_series(inp), BY)
    return tidy(out.select(*BY, "date", "i", "z", "ucl", "lcl", F.coalesce("signal", F.lit("none")).alias("signal")))


@query(
    "cusum_chart",
    tidy_sql(
        "SELECT loc, daypart, date, i, mu, sd, s_hi, s_lo, coalesce(signal, 'none') AS signal FROM o_cusum_sig",
        keep="loc daypart signal", ints="i", doubles="mu sd s_hi s_lo", dates="date",
    ),
)
def cusum_chart(inp):
    out = spc.cusum_chart(comps_series(inp), BY)
    return tidy(out.select(*BY, "date", "i", "mu", "sd", "s_hi", "s_lo", F.coalesce("signal", F.lit("none")).alias("signal")))


@query(
    "change_points",
    tidy_sql(
        """SELECT loc, daypart, n, arg_max(t, (score, -t)) AS split, max(score) AS score FROM (
          SELECT loc, daypart, n, t, abs((tot - pre) / (n - t) - pre / t) * sqrt(t * (n - t) / n) AS score FROM (
            SELECT loc, daypart, row_number() OVER w AS t, sum(v) OVER w AS pre, count(*) OVER (PARTITION BY loc, daypart) AS n,
              sum(v) OVER (PARTITION BY loc, daypart) AS tot FROM comps_series WINDOW w AS (PARTITION BY loc, daypart ORDER BY date ROWS UNBOUNDED PRECEDING))
          WHERE t >= 3 AND t <= n - 3) GROUP BY ALL""",
        keep="loc daypart", ints="n split", doubles="score",
    ),
)
def change_points(inp):
    return tidy(spc.change_point(comps_series(inp), BY))


@query(
    "drift_onsets",
    tidy_sql(
        f"SELECT * FROM {onset_sql('o_cusum_sig', 'loc, daypart', None)}",
        keep="loc daypart direction", ints="onset_index signal_index", dates="onset_date signal_date",
    ),
)
def drift_onsets(inp):
    return tidy(spc.drift_onset(spc.cusum_chart(comps_series(inp), BY), BY))


ORACLE_VIEWS["o_wk_cusum"] = """SELECT *, CASE WHEN s_hi > 4 THEN 'high' WHEN s_lo > 4 THEN 'low' END AS signal FROM (
  SELECT *, up - least(0, min(up) OVER r) AS s_hi, down - least(0, min(down) OVER r) AS s_lo FROM (
    SELECT *, sum((v - mu) / sd - 0.5) OVER (PARTITION BY loc ORDER BY date ROWS UNBOUNDED PRECEDING) AS up,
      sum(-(v - mu) / sd - 0.5) OVER (PARTITION BY loc ORDER BY date ROWS UNBOUNDED PRECEDING) AS down FROM (
      SELECT *, avg(CASE WHEN i <= 28 THEN v END) OVER (PARTITION BY loc) AS mu, stddev_samp(CASE WHEN i <= 28 THEN v END) OVER (PARTITION BY loc) AS sd FROM (
        SELECT *, row_number() OVER (PARTITION BY loc ORDER BY date) AS i, count(*) OVER (PARTITION BY loc) AS n FROM weekly_comps)))
  WINDOW r AS (PARTITION BY loc ORDER BY date ROWS UNBOUNDED PRECEDING))"""


@query(
    "weekly_comps_drift",
    tidy_sql(f"SELECT * FROM {onset_sql('o_wk_cusum', 'loc', None)}", keep="loc direction", ints="onset_index signal_index", dates="onset_date signal_date"),
)
def weekly_comps_drift(inp):
    """Flagship: weekly comps rate per room, charted, with the day each drift began."""
    weekly = (
        services(inp).groupBy("loc", dates.week_of("date").alias("date"))
        .agg((F.sum("comps_cents") / F.greatest(F.sum("gross_cents"), F.lit(1))).alias("v"))
    )
    return tidy(spc.drift_onset(spc.cusum_chart(weekly, ["loc"]), ["loc"]))


@query(
    "last_services",
    tidy_sql(
        "SELECT loc, daypart, date, v FROM (SELECT *, row_number() OVER (PARTITION BY loc, daypart ORDER BY date DESC) AS r FROM comps_series) WHERE r <= 28",
        keep="loc daypart", doubles="v", dates="date",
    ),
)
def last_services(inp):
    return tidy(S.last_n(comps_series(inp), 28, BY))


@query(
    "control_chart_frame",
    tidy_sql(
        """SELECT loc, daypart, date, v, idx, mu, sd, mu + 3 * sd AS ucl, mu - 3 * sd AS lcl, v > mu + 3 * sd OR v < mu - 3 * sd AS outside FROM (
          SELECT *, avg(CASE WHEN idx <= 28 THEN v END) OVER (PARTITION BY loc, daypart) AS mu, stddev_samp(CASE WHEN idx <= 28 THEN v END) OVER (PARTITION BY loc, daypart) AS sd FROM (
            SELECT loc, daypart, date, v, row_number() OVER (PARTITION BY loc, daypart ORDER BY date) AS idx FROM (
              SELECT *, row_number() OVER (PARTITION BY loc, daypart ORDER BY date DESC) AS r FROM comps_series) WHERE r <= 160))""",
        keep="loc daypart outside", ints="idx", doubles="v mu sd ucl lcl", dates="date",
    ),
)
def control_chart_frame(inp):
    return tidy(S.control_chart_frame(comps_series(inp), BY))


@query(
    "date_functions",
    tidy_sql(
        """SELECT o_orderkey, d + 10 AS plus_ten, date_diff('day', DATE '1999-12-31', d) AS since, dayofweek(d) AS dow, date_trunc('week', d)::DATE AS week,
        strftime(d, '%Y-%m') AS month, dayofyear(d) AS doy, year(d) AS yr, (year(d) % 4 = 0 AND year(d) % 100 <> 0) OR year(d) % 400 = 0 AS leap,
        day(last_day(d)) AS month_days, least(d, DATE '1998-01-01') AS earlier, greatest(d, DATE '1998-01-01') AS later,
        day(d) || ' ' || strftime(d, '%b') AS short_text, day(d) || ' ' || strftime(d, '%b %Y') AS long_text, strftime(d, '%B %Y') AS month_text
        FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
        keep="month leap short_text long_text month_text", ints="o_orderkey since dow doy yr month_days", dates="plus_ten week earlier later",
    ),
)
def date_functions(inp):
    d = F.col("o_orderdate").cast("date")
    pivot = dates.day("1998-01-01")
    return tidy(
        inp.base["orders"].select(
            "o_orderkey", F.date_add(d, 10).alias("plus_ten"), F.datediff(d, dates.day("1999-12-31")).alias("since"),
            dates.day_of_week(d).alias("dow"), dates.week_of(d).alias("week"), dates.month_of(d).alias("month"), F.dayofyear(d).alias("doy"),
            F.year(d).alias("yr"), dates.is_leap_year(F.year(d)).alias("leap"), dates.days_in_month(d).alias("month_days"),
            F.least(d, pivot).alias("earlier"), F.greatest(d, pivot).alias("later"), dates.short_date(d).alias("short_text"),
            dates.long_date(d).alias("long_text"), dates.month_name(d).alias("month_text"),
        )
    )


def usd_sql(c: str, dp: int | None = None, sign: bool = False) -> str:
    """The dollar text of cents, as SQL."""
    x = f"CAST(coalesce({c}, 0) AS DOUBLE)"
    q2, q0 = f"CAST(floor(abs({x}) + 0.5) AS BIGINT)", f"CAST(floor(abs({x} / 100) + 0.5) AS BIGINT)"
    two = f"format('{{:,}}', {q2} // 100) || '.' || lpad(CAST({q2} % 100 AS VARCHAR), 2, '0')"
    zero = f"format('{{:,}}', {q0})"
    body = two if dp == 2 else zero if dp == 0 else f"CASE WHEN abs({x} / 100) >= 100 THEN {zero} ELSE {two} END"
    return f"(CASE WHEN {x} < 0 THEN '−' ELSE '{'+' if sign else ''}' END || '$' || ({body}))"


def fixed_sql(x: str, dp: int) -> str:
    q = f"CAST(floor(abs({x}) * {10**dp} + 0.5) AS BIGINT)"
    body = f"CAST({q} // {10**dp} AS VARCHAR) || '.' || lpad(CAST({q} % {10**dp} AS VARCHAR), {dp}, '0')" if dp else f"CAST({q} AS VARCHAR)"
    return f"(CASE WHEN ({x}) < 0 THEN '-' ELSE '' END || {body})"


@query(
    "money_text",
    tidy_sql(
        f"""SELECT c_custkey, {usd_sql('cents')} AS usd, {usd_sql('cents', 2)} AS usd2, {usd_sql('cents', None, True)} AS usd_signed,
        {fixed_sql('share * 100', 1)} || '%' AS pct, (CASE WHEN share >= 0 THEN '+' ELSE '−' END) || {fixed_sql('abs(share * 100)', 1)} || 'pp' AS pp,
        regexp_replace(regexp_replace(upper(label), '[^A-Z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS code FROM (
          SELECT c_custkey, CAST(floor(c_acctbal * 31) AS BIGINT) AS cents, c_acctbal / 13000 AS share, '(' || c_name || ' / ' || c_mktsegment || ')' AS label FROM customer)""",
        keep="usd usd2 usd_signed pct pp code", ints="c_custkey",
    ),
)
def money_text(inp):
    cents = F.floor(F.col("c_acctbal") * 31)
    share = F.col("c_acctbal") / 13000
    label = F.concat(F.lit("("), F.col("c_name"), F.lit(" / "), F.col("c_mktsegment"), F.lit(")"))
    return inp.base["customer"].select(
        "c_custkey", text.format_usd(cents).alias("usd"), text.format_usd(cents, 2).alias("usd2"), text.format_usd(cents, sign=True).alias("usd_signed"),
        text.format_pct(share).alias("pct"), text.format_pp(share).alias("pp"), text.slug(label).alias("code"),
    )


@query(
    "decay_weights",
    tidy_sql(
        """SELECT id, week, CASE WHEN persistence_class IS NULL OR persistence_class = 'structural' THEN 1
          WHEN persistence_class = 'upkeep' THEN 0.5 ** (week / greatest(coalesce(half_life_weeks, 1), 1)) ELSE 0.5 ** (week / greatest(coalesce(half_life_weeks, 52), 52)) END AS weight
        FROM rec_evals, (SELECT unnest(range(0, 12)) AS week) WHERE bookable_cents IS NOT NULL""",
        keep="id", ints="week", doubles="weight",
    ),
)
def decay_weights(inp):
    rows = inp.view("rec_evals").filter(F.col("bookable_cents").isNotNull()).withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(11))))
    return tidy(rows.select("id", "week", numeric.decay_at(F.col("persistence_class"), F.col("half_life_weeks"), F.col("week")).alias("weight")))
