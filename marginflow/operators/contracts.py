"""Contracts of the tables: rules on rows, unique keys, references and agreements between tables.

A contract is data; it is compiled into one pass per table without a shuffle, which serves every rule on rows, one count per
key where it is unique, and one anti-join per reference. Keys become text only in rows that break a rule.
Each broken rule comes with the number of rows that break it and the least and greatest key among them.

A rule that is null for a row is broken. A null reference refers to nothing and is not broken; whether it may be null is a
rule on rows. Keys are shown as text, their parts joined by ``|``, a null part as ``null``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..session import attach


@dataclass(frozen=True)
class Reference:
    """``columns`` of a row must be found as ``their`` columns of a row of ``table``; with ``agree``, that row must agree in these columns."""

    name: str
    columns: tuple[str, ...]
    table: str
    their: tuple[str, ...]
    agree: tuple[str, ...] = ()


@dataclass(frozen=True)
class Contract:
    key: tuple[str, ...]
    rules: Mapping[str, str] = field(default_factory=dict)
    unique: bool = True
    references: tuple[Reference, ...] = ()


def one_of(column: str, values: Iterable) -> str:
    shown = ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)
    return f"{column} IN ({shown})"


def _served(*more: Reference) -> tuple[Reference, ...]:
    """What every dated row refers to."""
    return (Reference("room is known", ("loc",), "locations", ("loc",)), Reference("daypart is known", ("daypart",), "dayparts", ("daypart",)), *more)


_CHECK = Reference("belongs to a check of its room, day and daypart", ("check_id",), "checks", ("id",), ("loc", "business_date", "daypart"))
_ITEM = Reference("item is on the menu", ("menu_item_id",), "menu", ("item",))
_SERVICE = Reference("belongs to a service", ("loc", "date", "daypart"), "services", ("loc", "date", "daypart"))
_CHANGE = Reference("belongs to an intervention", ("intervention_id",), "evaluations", ("id",))

CONTRACTS: dict[str, Contract] = {
    "checks": Contract(("id",), {"guests are not negative": "guest_count >= 0", "comps are not negative": "comp_cents >= 0", "voided is known": "voided IS NOT NULL"}, references=_served()),
    "order_items": Contract(
        ("id",), {"quantity is positive": "qty > 0", "price is not negative": "unit_price_cents >= 0", "cost is not negative": "unit_cost_cents >= 0", "ticket is a time": "ticket_min IS NULL OR ticket_min >= 0"},
        references=_served(_CHECK, _ITEM),
    ),
    "shifts": Contract(("id",), {"hours are not negative": "clocked_hours >= 0 AND scheduled_hours >= 0", "hours fit a day": "clocked_hours <= 24", "wage is positive": "wage_rate_cents > 0"}, references=_served()),
    "reviews": Contract(("id",), {"rating is 0 to 5": "rating BETWEEN 0 AND 5"}, references=_served()),
    "reservations": Contract(
        ("id",), {"walk-ins are among the booked": "walk_in BETWEEN 0 AND booked", "constrained share is a share": "constrained_share IS NULL OR constrained_share BETWEEN 0 AND 1", "capacity is positive": "capacity > 0"},
        references=_served(),
    ),
    "invoices": Contract(
        ("loc", "week", "sku"), {"week is a Monday": "extract(DOW FROM week) = extract(DOW FROM DATE '2001-01-01')", "quantity is positive": "qty > 0", "price is not negative": "unit_price_cents >= 0"}, unique=False,
        references=(Reference("room is known", ("loc",), "locations", ("loc",)), Reference("SKU is known and from its vendor", ("sku",), "skus", ("sku",), ("vendor",))),
    ),
    "recipe_costs": Contract(("item", "effective_on"), {"cost is not negative": "cost_cents >= 0", "source is known": "source IS NOT NULL"}, references=(Reference("item is on the menu", ("item",), "menu", ("item",)),)),
    "menu": Contract(("item",), {"usage is positive where a SKU is used": "uses_sku IS NULL OR qty_per_unit > 0"}, references=(Reference("SKU is known", ("uses_sku",), "skus", ("sku",)),)),
    "skus": Contract(("sku",), {"vendor is known": "vendor IS NOT NULL"}),
    "locations": Contract(("loc",), {"name is known": "name IS NOT NULL"}),
    "dayparts": Contract(("daypart",), {"length is a part of a day": "hours > 0 AND hours <= 24"}),
    "services": Contract(
        ("loc", "date", "daypart"),
        {
            "covers are not negative": "covers >= 0", "gross is net plus comps": "gross_cents = net_cents + comps_cents", "weekday is 0 to 6": "dow BETWEEN 0 AND 6", "rating is 0 to 5": "rating BETWEEN 0 AND 5",
            "constrained share is a share": "constrained_share BETWEEN 0 AND 1", "hours are quarters": "hours * 4 = floor(hours * 4)",
        },
        references=_served(),
    ),
    "item_days": Contract(("loc", "date", "daypart", "item"), {"units are sold": "units <> 0", "price is not negative": "price_cents >= 0"}, references=(_SERVICE, Reference("item is on the menu", ("item",), "menu", ("item",)))),
    "role_shifts": Contract(("loc", "date", "daypart", "role"), {"hours are not negative": "clocked_hours >= 0 AND scheduled_hours >= 0", "rate is positive": "rate_cents > 0"}, references=(_SERVICE,)),
    "reservation_days": Contract(("loc", "date", "daypart"), {"walk-ins are among the booked": "walk_in BETWEEN 0 AND booked"}, references=(_SERVICE,)),
    "feeds": Contract(("code",), {"completeness is a share": "completeness BETWEEN 0 AND 1", "rule is positive": "sla_hours IS NULL OR sla_hours > 0"}),
    "findings": Contract(
        ("id",),
        {
            "state is known": one_of("state", dims.FINDING_STATES), "lever is known": one_of("lever", dims.LEVERS), "detector is known": one_of("detector", dims.DETECTORS), "exposure is not negative": "exposure_cents >= 0",
            "overlap status is known": one_of("overlap_status", dims.OVERLAP_STATES), "expiry is after opening": "expires_on > decision_opened_on", "onset is before its signal": "onset_date IS NULL OR onset_date <= signal_date",
        },
        references=(Reference("shares dollars with a finding", ("overlap_with",), "findings", ("id",)),),
    ),
    "decisions": Contract(("finding_id",), {"decision is known": one_of("decision", ("accept", "reject", "investigate")), "a rejection has a code": "decision <> 'reject' OR code IS NOT NULL"}, references=(Reference("is about a finding", ("finding_id",), "findings", ("id",)),)),
    "interventions": Contract(
        ("intervention_id",),
        {
            "metric is known": one_of("metric", dims.SERVICE_METRICS + dims.SCOPE_METRICS), "fidelity is known": one_of("fidelity", dims.FIDELITIES), "rung is 1 to 7": one_of("rung", dims.RUNGS),
            "decided before executed": "decided_on <= exec_on", "estimator is known": one_of("estimator", ("did", "reconcile")),
        },
    ),
    "evaluations": Contract(
        ("id",),
        {
            "outcome is known": one_of("outcome", (*dims.OUTCOMES, "pending")), "state is known": one_of("state", dims.INTERVENTION_STATES), "a pending one books nothing": "outcome <> 'pending' OR bookable_cents IS NULL",
            "what is booked is not negative": "bookable_cents IS NULL OR bookable_cents >= 0", "guardrails passed are among all": "guardrails_passed BETWEEN 0 AND guardrails_total",
        },
        references=(Reference("comes from a finding of its lever", ("finding_id",), "findings", ("id",), ("lever",)),),
    ),
    "actions": Contract(("id",), {"state is known": one_of("state", ("open", "done", "not_executed")), "a done one has a date": "state <> 'done' OR done_on IS NOT NULL"}, references=(_CHANGE,)),
    "adjustments": Contract(
        ("id",), {"kind is known": one_of("kind", ("Reversal", "Decay", "Dispute")), "cents are not positive": "cents <= 0", "status is known": one_of("status", ("open", "credited", "accepted"))}, references=(_CHANGE,),
    ),
    "ledger_sides": Contract(
        ("intervention_id",), {"status is known": one_of("status", dims.RECON_LABELS), "parts are within the claim": "abs(unexplained_cents) <= abs(claim_cents)"}, references=(_CHANGE,),
    ),
}


def _shown(columns: Iterable[str]) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns))


_RESULT = ["table", "rule", "rows", "violations", "first_key", "last_key"]


def _cells(wide: DataFrame, table: str, cells: list[tuple[str, str, str, str]]) -> DataFrame:
    parts = F.array(*(F.struct(F.lit(rule).alias("rule"), F.coalesce(n, F.lit(0)).cast("bigint").alias("violations"), F.col(lo).alias("first_key"), F.col(hi).alias("last_key")) for rule, n, lo, hi in cells))
    return wide.select(F.lit(table).alias("table"), F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), F.inline(parts)).select(_RESULT)


def check_rows(table: str, rows: DataFrame, contract: Contract) -> DataFrame:
    """Rules on rows, added up where the rows lie, and uniqueness of the key."""
    key, aggs = _shown(contract.key), [F.count(F.lit(1)).alias("rows")]
    for i, text in enumerate(contract.rules.values()):
        broken = ~F.coalesce(F.expr(text), F.lit(False))
        aggs += [F.count(F.when(broken, 1)).alias(f"v{i}"), F.min(F.when(broken, key)).alias(f"lo{i}"), F.max(F.when(broken, key)).alias(f"hi{i}")]
    parts = [_cells(rows.agg(*aggs), table, [(name, f"v{i}", f"lo{i}", f"hi{i}") for i, name in enumerate(contract.rules)])] if contract.rules else []
    if contract.unique:
        # Two whole numbers have one text just when they are equal, so they need none to be grouped.
        whole = len(contract.key) == 1 and dict(rows.dtypes)[contract.key[0]] in ("tinyint", "smallint", "int", "bigint")
        counted = rows.groupBy((F.col(contract.key[0]) if whole else key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
        shown = F.when(F.col("n") > 1, _shown(["_key"]))
        wide = counted.agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("v"), F.min(shown).alias("lo"), F.max(shown).alias("hi"))
        parts.append(_cells(wide, table, [("key is unique", "v", "lo", "hi")]))
    return reduce(DataFrame.unionByName, parts)


def check_reference(table: str, rows: DataFrame, contract: Contract, ref: Reference, parent: DataFrame) -> DataFrame:
    """Rows whose reference is not found, or whose row there does not agree.

    No texts are gathered per referenced value, as that would sort all rows. Small tables referred to are broadcast and hot
    values of large ones are split, as Catalyst and AQE see fit.
    """
    named = F.lit(True)
    for c in ref.columns:
        named = named & F.col(c).isNotNull()
    own = rows.filter(named).select(*(F.col(c).alias(f"_r{i}") for i, c in enumerate(ref.columns)), *(F.col(c).alias(f"_a{i}") for i, c in enumerate(ref.agree)), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(contract.key)))
    met = [f"_r{i}" for i in range(len(ref.columns))] + [f"_a{i}" for i in range(len(ref.agree))]
    theirs = parent.select(*(F.col(c).alias(f"_r{i}") for i, c in enumerate(ref.their)), *(F.col(c).alias(f"_a{i}") for i, c in enumerate(ref.agree)))
    same = F.lit(True)
    for c in met:
        same = same & (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) if c.startswith("_a") else F.col(f"a.{c}") == F.col(f"b.{c}"))
    lost = own.alias("a").join(theirs.alias("b"), same, "left_anti")
    key = _shown([f"_k{i}" for i in range(len(contract.key))])
    wide = attach(lost.agg(F.count(F.lit(1)).alias("v"), F.min(key).alias("lo"), F.max(key).alias("hi")), rows.agg(F.count(F.lit(1)).alias("rows")))
    return _cells(wide, table, [(ref.name, "v", "lo", "hi")])


def check_contracts(tables: Mapping[str, DataFrame], contracts: Mapping[str, Contract] = CONTRACTS) -> DataFrame:
    """(table, rule, rows, violations, first_key, last_key) of every rule of the tables given; references need both tables."""
    parts = []
    for name, rows in tables.items():
        parts.append(check_rows(name, rows, contracts[name]))
        parts += [check_reference(name, rows, contracts[name], r, tables[r.table]) for r in contracts[name].references if r.table in tables]
    return reduce(DataFrame.unionByName, parts)
