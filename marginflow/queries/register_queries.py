"""Queries over the roll-up: services, item-days, shifts, prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollup
from .registry import query, tidy, tidy_sql
from .views import Inputs


def services(inp: Inputs):
    # Items and shifts are lines of the same orders, which others read as well.
    lines = inp.staged("reg_order_items")
    return rollup.rollup_services(
        inp.view("reg_checks"), lines, inp.view("reg_shifts"), inp.view("reg_reviews"), inp.view("reg_reservations")
    )


def item_days(inp: Inputs):
    return rollup.rollup_item_days(inp.view("reg_order_items"))


def role_shifts(inp: Inputs):
    return rollup.rollup_shifts(inp.view("reg_shifts"))


@query(
    "service_rollup",
    tidy_sql(
        "SELECT * FROM services",
        keep="loc daypart holiday",
        ints="dow covers turned_away gross_cents comps_cents net_cents cogs_cents labor_cents capacity",
        doubles="hours ticket_min rating constrained_share",
        dates="date",
    ),
)
def service_rollup(inp):
    return tidy(services(inp))


@query(
    "item_day_rollup",
    tidy_sql("SELECT * FROM item_days", keep="loc daypart item", ints="units price_cents cost_cents", dates="date"),
)
def item_day_rollup(inp):
    return tidy(item_days(inp))


@query(
    "shift_rollup",
    tidy_sql("SELECT * FROM role_shifts", keep="loc daypart role", ints="rate_cents", doubles="scheduled_hours clocked_hours", dates="date"),
)
def shift_rollup(inp):
    return tidy(role_shifts(inp))


@query(
    "reservation_rollup",
    tidy_sql(
        """SELECT loc, business_date AS date, daypart, arg_max(booked, id) AS booked, arg_max(walk_in, id) AS walk_in,
        arg_max(quoted_wait_min, id) AS quoted_wait_min, arg_max(abandoned, id) AS abandoned FROM reg_reservations GROUP BY ALL""",
        keep="loc daypart", ints="booked walk_in abandoned", doubles="quoted_wait_min", dates="date",
    ),
)
def reservation_rollup(inp):
    return tidy(rollup.rollup_reservations(inp.view("reg_reservations")))


@query(
    "price_as_of",
    tidy_sql(
        """SELECT d.loc, d.date, d.daypart, d.item, d.units,
        coalesce((SELECT arg_max(p.cents, p.effective_on) FROM reg_prices p WHERE p.item = d.item AND p.effective_on <= d.date),
                 (SELECT arg_min(p.cents, p.effective_on) FROM reg_prices p WHERE p.item = d.item), 0) AS list_price_cents FROM item_days d""",
        keep="loc daypart item", ints="units list_price_cents", dates="date",
    ),
)
def price_as_of(inp):
    out = rollup.price_as_of(item_days(inp), inp.menu())
    return tidy(out.select("loc", "date", "daypart", "item", "units", "list_price_cents"))


@query(
    "recipe_cost_as_of",
    tidy_sql(
        """SELECT d.loc, d.date, d.daypart, d.item, r.cost_cents AS recipe_cost_cents FROM item_days d
        ASOF LEFT JOIN reg_recipe_costs r ON r.item = d.item AND r.effective_on <= d.date""",
        keep="loc daypart item", ints="recipe_cost_cents", dates="date",
    ),
)
def recipe_cost_as_of(inp):
    out = rollup.recipe_cost_as_of(item_days(inp), inp.view("reg_recipe_costs"))
    return tidy(out.select("loc", "date", "daypart", "item", "recipe_cost_cents"))


_SERVICE_KINDS = dict(
    keep="loc daypart holiday", ints="dow covers turned_away gross_cents comps_cents net_cents cogs_cents labor_cents capacity",
    doubles="hours ticket_min rating constrained_share", dates="date",
)
_INVOICE_KINDS = dict(keep="loc sku vendor", ints="unit_price_cents extended_cents", doubles="qty", dates="week")


def _hash_sql(name: str, source: str, kinds: dict[str, str]) -> str:
    doubles = kinds["doubles"].split()
    text = lambda c: f"CAST(floor({c} * 1e6 + 0.5) AS BIGINT)" if c in doubles else c
    values = ", ".join(f"coalesce(CAST({text(c)} AS VARCHAR), 'null')" for c in sorted(" ".join(kinds.values()).split()))
    return f"""SELECT '{name}' AS "table", count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', {values})), 1, 12) AS BIGINT)) % {1 << 60} AS BIGINT) AS content_hash
      FROM ({tidy_sql(f"SELECT * FROM {source}", **kinds)})"""


@query("fingerprint", f"{_hash_sql('services', 'services', _SERVICE_KINDS)} UNION ALL {_hash_sql('invoices', 'reg_invoices', _INVOICE_KINDS)}")
def fingerprint(inp):
    return rollup.fingerprint(services=tidy(services(inp)), invoices=tidy(inp.view("reg_invoices"))).select("table", "rows", "content_hash")
