"""SQL definitions the oracles share (DuckDB dialect)."""

from __future__ import annotations

from .views import AS_OF

ORACLE_VIEWS: dict[str, str] = {
    "o_keys": """SELECT loc, business_date, daypart FROM reg_checks WHERE NOT voided UNION SELECT loc, business_date, daypart FROM reg_shifts
      UNION SELECT loc, business_date, daypart FROM reg_reservations""",
    "o_chk": """SELECT loc, business_date, daypart, sum(guest_count) AS covers, sum(comp_cents) AS comps, sum(subtotal_cents) AS net
      FROM reg_checks WHERE NOT voided GROUP BY ALL""",
    "o_itm": "SELECT loc, business_date, daypart, sum(qty * unit_cost_cents) AS cogs, avg(ticket_min) AS tick FROM reg_order_items GROUP BY ALL",
    "o_shf": "SELECT loc, business_date, daypart, sum(clocked_hours * wage_rate_cents) AS wages, sum(clocked_hours) AS hrs FROM reg_shifts GROUP BY ALL",
    "o_rev": "SELECT loc, business_date, daypart, floor(avg(rating) * 100 + 0.5) / 100 AS rating FROM reg_reviews GROUP BY ALL",
    "o_svc0": """SELECT k.loc, k.business_date AS date, k.daypart, coalesce(covers, 0) AS covers, coalesce(turned_away, 0) AS turned_away,
      coalesce(net, 0) + coalesce(comps, 0) AS gross_cents, coalesce(comps, 0) AS comps_cents, coalesce(net, 0) AS net_cents,
      coalesce(cogs, 0) AS cogs_cents, floor(coalesce(wages, 0) + 0.5) AS labor_cents, floor(coalesce(hrs, 0) * 4 + 0.5) / 4 AS hours,
      coalesce(floor(tick * 10 + 0.5) / 10, 0) AS ticket_min, v.rating, coalesce(constrained_share, 0) AS constrained_share,
      coalesce(holiday, false) AS holiday, coalesce(capacity, 0) AS capacity
      FROM o_keys k LEFT JOIN o_chk c USING (loc, business_date, daypart) LEFT JOIN o_itm i USING (loc, business_date, daypart)
      LEFT JOIN o_shf s USING (loc, business_date, daypart) LEFT JOIN o_rev v USING (loc, business_date, daypart)
      LEFT JOIN reg_reservations b USING (loc, business_date, daypart)""",
    "services": """SELECT loc, date, dayofweek(date) AS dow, daypart, CAST(covers AS BIGINT) AS covers, CAST(turned_away AS BIGINT) AS turned_away,
      CAST(gross_cents AS BIGINT) AS gross_cents, CAST(comps_cents AS BIGINT) AS comps_cents, CAST(net_cents AS BIGINT) AS net_cents,
      CAST(cogs_cents AS BIGINT) AS cogs_cents, CAST(labor_cents AS BIGINT) AS labor_cents, hours, ticket_min,
      coalesce(last_value(rating IGNORE NULLS) OVER (PARTITION BY loc, daypart ORDER BY date ROWS UNBOUNDED PRECEDING), 4.4) AS rating,
      constrained_share, holiday, capacity FROM o_svc0""",
    "item_days": """SELECT loc, business_date AS date, daypart, menu_item_id AS item, CAST(sum(qty) AS BIGINT) AS units,
      CAST(floor(sum(qty * unit_price_cents) / sum(qty) + 0.5) AS BIGINT) AS price_cents,
      CAST(floor(sum(qty * unit_cost_cents) / sum(qty) + 0.5) AS BIGINT) AS cost_cents
      FROM reg_order_items GROUP BY ALL HAVING sum(qty) <> 0""",
    "role_shifts": """SELECT loc, business_date AS date, daypart, role, floor(sum(scheduled_hours) * 4 + 0.5) / 4 AS scheduled_hours,
      floor(sum(clocked_hours) * 4 + 0.5) / 4 AS clocked_hours, arg_min(wage_rate_cents, id) AS rate_cents FROM reg_shifts GROUP BY ALL""",
}
_ = AS_OF
