"""Column contracts of the register and of the record tables. Nothing is inferred."""

from __future__ import annotations



def columns(text: str) -> dict[str, str]:
    """Column names and types of a schema text, in order."""
    return dict(part.split(" ", 1) for part in text.split(", "))


def ddl(cols: dict[str, str]) -> str:
    """The schema text a reader takes."""
    return ", ".join(f"{name} {kind}" for name, kind in cols.items())


CHECKS = columns(
    "id bigint, loc string, business_date date, daypart string, guest_count bigint, subtotal_cents bigint, comp_cents bigint, "
    "void_cents bigint, discount_cents bigint, tax_cents bigint, tip_cents bigint, total_cents bigint, voided boolean, "
    "server_ref string, table_ref string, opened_at timestamp, closed_at timestamp"
)
ORDER_ITEMS = columns(
    "id bigint, check_id bigint, loc string, business_date date, daypart string, menu_item_id string, qty bigint, "
    "unit_price_cents bigint, unit_cost_cents bigint, ticket_min double"
)
SHIFTS = columns(
    "id bigint, loc string, business_date date, daypart string, role string, employee_ref string, scheduled_hours double, "
    "clocked_hours double, wage_rate_cents bigint"
)
REVIEWS = columns("id bigint, loc string, business_date date, daypart string, rating double, is_complaint boolean")
RESERVATIONS = columns(
    "id bigint, loc string, business_date date, daypart string, booked bigint, walk_in bigint, quoted_wait_min double, "
    "abandoned bigint, turned_away bigint, constrained_share double, capacity int, holiday boolean"
)
INVOICES = columns("loc string, week date, sku string, vendor string, unit_price_cents bigint, qty double, extended_cents bigint")
RECIPE_COSTS = columns("item string, effective_on date, cost_cents bigint, source string")
SERVICES = columns(
    "loc string, date date, dow int, daypart string, covers bigint, turned_away bigint, gross_cents bigint, comps_cents bigint, "
    "net_cents bigint, cogs_cents bigint, labor_cents bigint, hours double, ticket_min double, rating double, "
    "constrained_share double, holiday boolean, capacity int"
)
ITEM_DAYS = columns(
    "loc string, date date, daypart string, item string, units bigint, price_cents bigint, cost_cents bigint"
)
ROLE_SHIFTS = columns(
    "loc string, date date, daypart string, role string, scheduled_hours double, clocked_hours double, rate_cents bigint"
)
RESERVATION_DAYS = columns(
    "loc string, date date, daypart string, booked bigint, walk_in bigint, quoted_wait_min double, abandoned bigint"
)
MENU = columns(
    "item string, name string, category string, cost_cents bigint, price_history array<struct<effective_on:date,cents:bigint>>, "
    "uses_sku string, qty_per_unit double"
)
SKUS = columns("sku string, name string, vendor string, unit string")
LOCATIONS = columns("loc string, name string, short string, seats int, opened date")
DAYPARTS = columns("daypart string, label string, start_hour int, end_hour int, hours double")
ROLES = columns("role string, label string, foh boolean, loaded_rate_cents bigint")
FEEDS = columns(
    "code string, name string, tier string, cadence string, sla_hours int, completeness double, rows bigint, newest date, "
    "newest_rule string"
)

REGISTER_TABLES = {
    "services": SERVICES,
    "item_days": ITEM_DAYS,
    "shifts": ROLE_SHIFTS,
    "invoices": INVOICES,
    "reservation_days": RESERVATION_DAYS,
    "locations": LOCATIONS,
    "dayparts": DAYPARTS,
    "menu": MENU,
    "skus": SKUS,
    "roles": ROLES,
}
