"""Figures by room and for the group: KPIs, funnel, conversions, accrual, feed risk, bridge.

Every figure of every scope comes from one star fact (``star``): claims are added
up per figure and set of rooms, and only sets are ever opened into rooms.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import dims
from ..functions.dates import day, days_in_month, month_of, to_date, week_of
from ..functions.numeric import round_cents
from ..functions.text import format_pct, format_usd
from ..session import attach, durable
from . import selection, star
from .persistence import accrual_days, period_cents

Day = str | dt.date
KEY = "intervention_id"
OPEN = tuple(s for s in dims.FINDING_STATES if s not in dims.TERMINAL_FINDING_STATES and s != "converted")
EXECUTED = ("complete", "modified", "partial")


# -- money ------------------------------------------------------------------


def typed_sum(amounts: DataFrame, by: list[str] | None = None, cents: str = "cents", klass: str = "klass") -> DataFrame:
    """Sum of integer cents of one claim class; adding two classes, or a part of a cent, fails the job."""
    one = F.countDistinct(klass)
    broken = F.raise_error(F.lit("fractional cents in a sum of integer cents")).cast("bigint")
    whole = F.when(F.col(cents) != F.floor(cents), broken).otherwise(F.col(cents).cast("bigint"))
    total = amounts.groupBy(*(by or [])).agg(F.sum(whole).alias("cents"), F.max(klass).alias("klass"), one.alias("_n"))
    refuse = F.raise_error(F.lit("claim-class violation: two classes in one sum")).cast("bigint")
    return total.withColumn("cents", F.when(F.col("_n") > 1, refuse).otherwise(F.col("cents"))).drop("_n")


def apportion(
    rows: DataFrame, claim: list[str], total: str = "total", weight: str = "weight", position: str = "pos", direct_rows: int = selection.DIRECT_ROWS
) -> DataFrame:
    """Largest-remainder parts of an integer total; parts of a claim sum exactly.

    Equal remainders go to the lower position first. With no positive weight every
    row takes the same floor and the first row the rest. Claims of up to ``direct_rows``
    parts are ranked in their task; of a larger one only the cut is looked for, the
    remainder down to which parts get a cent and the last position that does among
    equals, by selection from counts: its rows are neither sorted nor moved together.
    """
    sums = rows.groupBy(*claim).agg(F.sum(F.col(weight).cast("double")).alias("_w"), F.count(F.lit(1)).alias("_n"), F.min(position).alias("_p0"))
    met = lambda a, b: selection.same(a, b, claim)
    keep = lambda side, *more: [F.col(f"{side}.{c}").alias(c) for c in more]
    flat = F.col("_w") <= 0
    raw = F.when(flat, F.col(total) / F.col("_n")).otherwise(F.try_divide(F.col(total) * F.col(weight), F.col("_w")))
    sized = rows.alias("a").join(sums.alias("b"), met("a", "b")).select("a.*", "_w", "_n", "_p0")
    sized = sized.withColumn("_floor", F.floor(raw)).withColumn("_frac", F.when(flat, 0.0).otherwise(raw - F.floor(raw)))
    claims = durable(sized.groupBy(*claim).agg((F.max(total) - F.sum("_floor")).alias("_left"), F.max("_n").alias("_n"), F.max("_w").alias("_w")))
    sized = sized.alias("a").join(claims.select(*claim, "_left").alias("b"), met("a", "b")).select("a.*", "_left")
    # Only claims with weights have a cut to look for.
    large = claims.filter((F.col("_n") > direct_rows) & (F.col("_w") > 0) & (F.col("_left") > 0))
    small = sized.filter((F.col("_n") <= direct_rows) & ~flat).withColumn("_rank", F.row_number().over(W.partitionBy(*claim).orderBy(F.col("_frac").desc(), position)))
    small = small.withColumn("_extra", (F.col("_rank") <= F.col("_left")).cast("bigint")).drop("_rank")
    level = sized.filter(flat).withColumn("_extra", F.when(F.col(position) == F.col("_p0"), F.col("_left")).otherwise(0).cast("bigint"))
    out = small.unionByName(level)
    if claims.filter(F.col("_n") > direct_rows).limit(1).count():
        rest = sized.filter((F.col("_n") > direct_rows) & ~flat)
        asked = large.select(*claim, (F.col("_n") - F.col("_left")).alias("rank"))
        cut = selection.values_at(rest, claim, "_frac", asked).select(*claim, F.col("value").alias("_cut"))
        cutting = rest.alias("a").join(cut.alias("b"), met("a", "b"), "left").select("a.*", "_cut")
        # Of the parts at the cut itself, the lowest positions get what is left.
        above = cutting.groupBy(*claim).agg(F.count(F.when(F.col("_frac") > F.col("_cut"), 1)).alias("_above"), F.max("_left").alias("_left"), F.max("_cut").alias("_cut"))
        last = above.filter(F.col("_cut").isNotNull()).select(*claim, (F.col("_left") - F.col("_above") - 1).alias("rank"))
        ties = cutting.filter(F.col("_frac") == F.col("_cut"))
        until = selection.values_at(ties, claim, position, last).select(*claim, F.col("value").alias("_until"))
        placed = cutting.alias("a").join(until.alias("b"), met("a", "b"), "left").select("a.*", "_until")
        gets = (F.col("_frac") > F.col("_cut")) | ((F.col("_frac") == F.col("_cut")) & (F.col(position) <= F.col("_until")))
        out = out.unionByName(placed.withColumn("_extra", F.coalesce(gets.cast("bigint"), F.lit(0).cast("bigint"))).drop("_cut", "_until"))
    return out.withColumn("part", (F.col("_floor") + F.col("_extra")).cast("bigint")).drop("_w", "_n", "_p0", "_floor", "_frac", "_left", "_extra")


def equal_part(cents: Column, position: Column, parts: Column) -> Column:
    """The part at a 0-based position of an equal split; the sign is kept, the parts sum exactly."""
    size = F.abs(cents)
    share = F.floor(size / parts)
    return F.when(cents < 0, -1).otherwise(1) * (share + F.when(position < size - share * parts, 1).otherwise(0))


def resolve_locs(records: DataFrame, locations: DataFrame) -> DataFrame:
    """Gives records of the group that name no room the list of all rooms, for records that are handed out.

    Figures by room do not need it: they take such records as the set of all rooms.
    """
    named = F.when(F.size("locs") > 0, F.col("locs"))
    every = F.when(F.col("loc") == "group", F.col("_rooms"))
    rooms = locations.agg(F.array_sort(F.collect_set("loc")).alias("_rooms"))
    return attach(records, rooms).withColumn("locs", F.coalesce(named, every, F.array("loc"))).drop("_rooms")


def claim_location_cents(claims: DataFrame, cents: str = "cents") -> DataFrame:
    """Cents of each claim per room it covers, in equal largest-remainder shares."""
    parts = claims.select("*", F.posexplode("locs").alias("_pos", "room"))
    return parts.withColumn("room_cents", equal_part(F.col(cents), F.col("_pos"), F.size("locs"))).drop("_pos")


def _room_count(locations: DataFrame) -> DataFrame:
    return locations.agg(F.count(F.lit(1)).alias("rooms"))


def with_rooms(rows: DataFrame, locations: DataFrame) -> DataFrame:
    return attach(rows, _room_count(locations))


def fee_for_period(monthly_cents: int, scope: Column, rooms: Column, since: Day, through: Day) -> Column:
    """Unrounded recurring fee of a period, split evenly when the scope is one room."""
    lo, hi = to_date(since), to_date(through)
    share = F.when(scope == "all", F.lit(1.0)).otherwise(1 / F.greatest(rooms, F.lit(1)))
    return F.lit(monthly_cents) * share * ((hi - lo).days + 1) / days_in_month(day(lo))


# -- KPIs -------------------------------------------------------------------


def accrual_in_period(evals: DataFrame, as_of: Day, since: Day, through: Day) -> DataFrame:
    """Rounded accrual of each claim inside a closed period; claims without a day in it have no row."""
    return evals.withColumn("period_cents", period_cents(as_of, since, through)).filter(F.col("period_cents").isNotNull()).select(KEY, "period_cents")


def _sided(evals: DataFrame, sides: DataFrame) -> DataFrame:
    return evals.join(sides.select(KEY, F.col("status").alias("side_status"), F.col("observed_cents").alias("side_cents")), KEY, "left")


def kpis(
    findings: DataFrame, evals: DataFrame, actions: DataFrame, adjustments: DataFrame, feeds: DataFrame, sides: DataFrame, locations: DataFrame,
    as_of: Day, since: Day, through: Day, fee_monthly_cents: int,
) -> DataFrame:
    """The sixteen figures, for every room and for the group, with their class."""
    c = F.col
    zero = F.lit(0)
    finding_facts = star.claims(
        findings,
        {
            "exposure": (c("state").isin(list(OPEN)), c("exposure_cents")),
            "recoverable": (c("state").isin("awaiting_decision", "accepted", "converted") & ~c("historical"), c("recoverable_cents")),
        },
    )
    held = c("bookable_cents").isNotNull()
    lasting = held & c("persistence_status").isNotNull() & (c("persistence_status") != "decaying")
    rows = _sided(evals, sides).withColumn("period_cents", F.coalesce(period_cents(as_of, since, through), zero))
    eval_facts = star.claims(
        rows,
        {
            "approved": (c("state").isin("approved", "scheduled", "in_progress", "evidence_pending"), c("projected_cents")),
            "active": (c("state").isin("measuring", "measurement_pending", "executed"), c("projected_cents")),
            "measured": (c("window_closed") & c("point").isNotNull(), F.greatest(zero, round_cents(c("point")))),
            "verified": (held, c("bookable_cents")),
            "realized": (held, c("realized_cents")),
            "persistent": (lasting, c("period_cents")),
            "runrate": (lasting, c("annual_run_rate_cents")),
            "reconciled": (held & (c("side_status") == "reconciled"), c("side_cents")),
        },
    )
    other = star.claims(adjustments, {"adjustments": (c("status") != "open", c("cents"))}).unionByName(
        star.claims(actions.withColumn("locs", F.array("loc")), {"overdue": ((c("state") == "open") & (c("due_on") < day(to_date(as_of))), zero)})
    )
    names = ["exposure", "recoverable", "approved", "active", "measured", "verified", "realized", "persistent", "runrate", "reconciled", "adjustments", "overdue"]
    fact = star.added_up(finding_facts.unionByName(eval_facts).unionByName(other), locations)
    wide = with_rooms(star.by_scope(fact, locations, names), locations)
    pilot = feeds.filter(c("tier") == "Pilot").agg(F.coalesce(F.avg("completeness"), F.lit(0.0)).alias("dq"))
    wide = attach(wide, pilot)
    fee = round_cents(fee_for_period(fee_monthly_cents, c("scope"), c("rooms"), since, through))
    wide = wide.withColumn("fee", fee)
    money = lambda name, klass: (name, c(f"c_{name}").cast("double"), klass)
    figures = [
        money("persistent", "bookable"),
        ("multiple", F.coalesce(F.try_divide(c("c_persistent"), c("fee")), F.lit(0.0)), None),
        money("verified", "verified"), money("realized", "realized"), money("runrate", "bookable"), money("adjustments", "adjustment"),
        ("reconciledValue", c("c_reconciled").cast("double"), "bookable"),
        ("recon", F.coalesce(F.try_divide(c("n_reconciled"), c("n_verified")), F.lit(0.0)), None),
        money("measured", "measured"), money("active", "committed"), money("approved", "committed"), money("recoverable", "recoverable"),
        money("exposure", "profit_exposure"), ("openf", c("n_exposure").cast("double"), None), ("overdue", c("n_overdue").cast("double"), None), ("dq", c("dq"), None),
    ]
    cells = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(n).alias("kpi"), v.alias("value"), F.lit(k).cast("string").alias("klass")) for i, (n, v, k) in enumerate(figures)))
    return wide.select("scope", F.inline(cells))


def funnel(findings: DataFrame, evals: DataFrame, sides: DataFrame, locations: DataFrame) -> DataFrame:
    """Eight stages per scope: count, cents, class and the loss against the stage before."""
    c = F.col
    linked = evals.select(c("finding_id").alias("id")).distinct().withColumn("_linked", F.lit(True))
    rows = findings.join(linked, "id", "left")
    accepted = c("state").isin("accepted", "converted") | c("_linked").isNotNull()
    first = star.claims(
        rows,
        {"Detected": (F.lit(True), c("exposure_cents")), "Qualified": (c("qualified"), c("recoverable_cents")), "Accepted": (accepted, c("recoverable_cents"))},
    )
    ran = c("fidelity").isin(list(EXECUTED)) & ~c("state").isin("approved", "scheduled")
    held = c("bookable_cents").isNotNull() | c("reversed_claim_cents").isNotNull()
    lasting = held & c("persistence_status").isNotNull() & (c("persistence_status") != "decaying")
    second = star.claims(
        _sided(evals, sides),
        {
            "Executed": (ran, c("projected_cents")),
            "Measured": (c("window_closed") & c("point").isNotNull(), F.greatest(F.lit(0), round_cents(c("point")))),
            "Verified": (held, F.coalesce("bookable_cents", "reversed_claim_cents")),
            "Persistent": (lasting, F.coalesce("bookable_cents", F.lit(0))),
            "Reconciled": (held & (c("side_status") == "reconciled"), c("side_cents")),
        },
    )
    stages = ["Detected", "Qualified", "Accepted", "Executed", "Measured", "Verified", "Persistent", "Reconciled"]
    klass = ["profit_exposure", "recoverable", "recoverable", "committed", "measured", "verified", "bookable", "bookable"]
    wide = star.by_scope(star.added_up(first.unionByName(second), locations), locations, stages)
    cells = F.array(
        *(
            F.struct(
                F.lit(i).alias("pos"), F.lit(s).alias("stage"), c(f"n_{s}").alias("n"), c(f"c_{s}").alias("cents"), F.lit(klass[i]).alias("klass"),
                (c(f"n_{stages[i - 1]}") - c(f"n_{s}") if i else F.lit(None).cast("bigint")).alias("lost"),
            )
            for i, s in enumerate(stages)
        )
    )
    return wide.select("scope", F.inline(cells))


def _lag_medians(lags: DataFrame, locations: DataFrame, names: list[str]) -> DataFrame:
    """Exact medians per scope of lags in days: claims are counted per set of rooms and lag before any room is named.

    ``lags``: (rooms, of_group and the named columns). A claim of the group counts in every room; its histogram, as long
    as there are different lags, is the same for all of them.
    """
    cells = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("lag")) for n in names))
    long = lags.select("rooms", "of_group", F.inline(cells)).filter(F.col("lag").isNotNull())
    counts = durable(long.groupBy("rooms", "of_group", "name", "lag").agg(F.count(F.lit(1)).alias("n")))
    own = counts.filter(~F.col("of_group") & (F.col("rooms") != star.EVERY)).select(F.explode(F.array_distinct(star.named_rooms())).alias("scope"), "name", "lag", "n")
    whole = counts.select(F.lit("all").alias("scope"), "name", "lag", "n")
    shared = counts.filter("of_group").groupBy("name", "lag").agg(F.sum("n").alias("n")).agg(F.collect_list(F.struct("name", "lag", "n")).alias("_shared"))
    every = attach(locations.select(F.col("loc").alias("scope")), shared).select("scope", F.inline("_shared"))
    hist = own.unionByName(whole).unionByName(every).groupBy("scope", "name", "lag").agg(F.sum("n").alias("n"))
    # Days are small integers: a scope has as many rows as there are different lags.
    return hist.groupBy("scope").agg(*(F.percentile(F.when(F.col("name") == n, F.col("lag")), 0.5, F.col("n")).alias(n) for n in names))


def conversions(
    findings: DataFrame, evals: DataFrame, locations: DataFrame, as_of: Day, since: Day, through: Day, fee_monthly_cents: int
) -> DataFrame:
    """Twelve rates and medians per scope against their targets; null where nothing was counted."""
    c = F.col
    none = F.lit(0)
    ran = c("fidelity").isin(list(EXECUTED)) & ~c("state").isin("approved", "scheduled")
    closed = c("window_closed") & c("point").isNotNull()
    held = c("bookable_cents").isNotNull() | c("reversed_claim_cents").isNotNull()
    lasting = held & c("persistence_status").isNotNull() & (c("persistence_status") != "decaying")
    a = star.claims(
        findings,
        {
            "all_f": (F.lit(True), none), "qualified": (c("qualified"), none),
            "presented": (c("state").isin("awaiting_decision", "accepted", "rejected", "converted"), none), "accepted": (c("state").isin("accepted", "converted"), none),
        },
    )
    b = star.claims(
        evals.withColumn("period_cents", period_cents(as_of, since, through)),
        {
            "executed": (ran, none), "evidenced": (ran & (c("evidence_resolved") == c("evidence_total")), none), "measured": (closed, none), "verified": (held, none),
            "guarded": (closed & (c("guardrails_passed") == c("guardrails_total")), none), "persistent": (lasting, F.coalesce("period_cents", none)),
        },
    )
    names = ["all_f", "qualified", "presented", "accepted", "executed", "evidenced", "measured", "verified", "guarded", "persistent"]
    wide = with_rooms(star.by_scope(star.added_up(a.unionByName(b), locations), locations, names), locations)
    found = findings.select(c("id").alias("finding_id"), "detected_on")
    lags = evals.join(found, "finding_id", "left").select(
        star.room_set().alias("rooms"), (c("loc") == star.GROUP).alias("of_group"), F.when(c("detected_on") <= c("decided_on"), F.datediff("decided_on", "detected_on")).alias("t2a"),
        F.when(held, F.datediff("eligible_on", "decided_on")).alias("t2v"),
    )
    wide = wide.join(_lag_medians(lags, locations, ["t2a", "t2v"]), "scope", "left")
    rate = lambda x, y: F.try_divide(c(f"n_{x}"), c(f"n_{y}"))
    fee = fee_for_period(fee_monthly_cents, c("scope"), c("rooms"), since, through)
    in_scope = F.when(c("scope") == "all", c("rooms")).otherwise(1)
    values = {
        "qual": rate("qualified", "all_f"), "accept": rate("accepted", "presented"), "exec": F.when(c("n_accepted") > 0, F.least(F.lit(1.0), rate("executed", "accepted"))),
        "evid": rate("evidenced", "executed"), "meas": rate("measured", "executed"), "ver": rate("verified", "measured"), "guard": rate("guarded", "measured"),
        "pers": rate("persistent", "verified"), "t2a": c("t2a"), "t2v": c("t2v"), "vpl": F.when(c("n_persistent") > 0, F.try_divide(c("c_persistent"), in_scope)),
        "mult": F.try_divide(c("c_persistent"), fee),
    }
    cells = F.array(*(F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in values.items()))
    out = wide.select("scope", F.inline(cells)).join(F.broadcast(dims.conversion_targets(findings.sparkSession)), "metric")
    ok = (
        F.when(c("direction").isin("gte", "gte_x"), c("value") >= c("target_lo"))
        .when(c("direction") == "band", (c("value") >= c("target_lo")) & (c("value") <= c("target_hi")))
        .when(c("direction") == "lte_days", c("value") <= c("target_lo"))
    )
    return out.withColumn("ok", ok)


# -- accrual ----------------------------------------------------------------


def daily_accrual(evals: DataFrame, locations: DataFrame, as_of: Day) -> DataFrame:
    """Accrual per scope and day. Claims of one set of rooms are summed before they are split."""
    days = accrual_days(evals.withColumn("rooms", star.room_set()), as_of).select("rooms", "date", F.col("y").alias("amount"))
    return star.shares(days, locations, ["date"]).withColumnRenamed("amount", "y")


def cumulative_accrual(daily: DataFrame) -> DataFrame:
    """Running sum per scope; one row per day, so a scope is as long as the calendar."""
    so_far = W.partitionBy("scope").orderBy("date").rowsBetween(W.unboundedPreceding, W.currentRow)
    return daily.withColumn("cumulative", round_cents(F.sum("y").over(so_far))).withColumn("cents", round_cents(F.col("y"))).drop("y")


def accrual_by_week(daily: DataFrame) -> DataFrame:
    return daily.groupBy("scope", week_of("date").alias("week")).agg(round_cents(F.sum("y")).alias("cents"))


def accrual_by_month(daily: DataFrame, adjustments: DataFrame, locations: DataFrame, as_of: Day, fee_monthly_cents: int) -> DataFrame:
    """Months with accrual: cents, adjustments of the month and the fee, the running month in proportion."""
    months = daily.groupBy("scope", month_of("date").alias("month")).agg(round_cents(F.sum("y")).alias("cents"))
    settled = star.claims(adjustments.withColumn("month", month_of("on_date")), {"moved": (F.col("status") != "open", F.col("cents"))}, also=["month"])
    fact = star.added_up(settled, locations, by=["figure", "month"])
    whole = fact.groupBy("month").agg(F.sum("cents").alias("cents")).withColumn("scope", F.lit("all"))
    moved = star.by_room(fact, locations, by=["figure", "month"]).select("scope", "month", F.col("cents").alias("adjustments_cents"))
    moved = moved.unionByName(whole.select("scope", "month", F.col("cents").alias("adjustments_cents")))
    today = to_date(as_of)
    running = F.when(F.col("month") == today.strftime("%Y-%m"), F.lit(today.day) / days_in_month(day(today))).otherwise(F.lit(1.0))
    share = F.when(F.col("scope") == "all", F.lit(1.0)).otherwise(1 / F.greatest(F.col("rooms"), F.lit(1)))
    rows = with_rooms(months.join(moved, ["scope", "month"], "left"), locations)
    return rows.select(
        "scope", "month", "cents", F.coalesce("adjustments_cents", F.lit(0)).alias("adjustments_cents"), round_cents(F.lit(fee_monthly_cents) * share * running).alias("fee_cents"),
    )


def accrual_now(daily: DataFrame, as_of: Day) -> DataFrame:
    """Accrual of today, this week and this month per scope."""
    today = day(to_date(as_of))
    part = lambda test: round_cents(F.coalesce(F.sum(F.when(test, F.col("y"))), F.lit(0.0)))
    return daily.groupBy("scope").agg(
        part(F.col("date") == today).alias("today_cents"), part(week_of("date") == week_of(today)).alias("week_cents"),
        part(month_of("date") == month_of(today)).alias("month_cents"),
    )


# -- risk and bridge --------------------------------------------------------


def feed_risk(findings: DataFrame, evals: DataFrame, feeds: DataFrame, locations: DataFrame) -> DataFrame:
    """Dollars that rest on each feed, per scope; a claim is split over the feeds it cites."""
    c = F.col
    live = findings.filter(~c("historical"))
    n = F.greatest(F.size("feeds"), F.lit(1))
    blocked = c("state") == "data_insufficient"
    kind = F.when(blocked, "blocked").when(c("state").isin(list(OPEN)), "open")
    amount = F.when(blocked, c("exposure_cents")).otherwise(c("recoverable_cents")) / n
    a = live.withColumn("kind", kind).filter(c("kind").isNotNull())
    a = a.select(F.explode("feeds").alias("code"), "kind", star.room_set().alias("rooms"), amount.cast("double").alias("amount"))
    used = F.array(*(F.lit(f) for f in dims.BASE_FEEDS))
    for lever in dims.LEVER_FEEDS:
        used = F.when(c("lever") == lever, F.array(*(F.lit(f) for f in dims.feeds_used(lever)))).otherwise(used)
    rows = evals.withColumn("_used", used)
    kinds = F.array(
        F.struct(F.when(c("state") == "measuring", "monitoring").alias("kind"), (c("projected_cents") / F.size("_used")).cast("double").alias("amount")),
        F.struct(F.when(c("bookable_cents").isNotNull(), "verified").alias("kind"), (c("bookable_cents") / F.size("_used")).cast("double").alias("amount")),
    )
    b = rows.withColumn("code", F.explode("_used")).select(star.room_set().alias("rooms"), "code", F.inline(kinds)).filter(c("kind").isNotNull())
    part = lambda k: round_cents(F.coalesce(F.sum(F.when(c("kind") == k, c("amount"))), F.lit(0.0)))
    sums = star.shares(a.unionByName(b), locations, ["code", "kind"]).groupBy("code", "scope").agg(
        part("open").alias("open_exposure_cents"), part("monitoring").alias("monitoring_cents"), part("verified").alias("verified_at_risk_cents"), part("blocked").alias("blocked_cents"),
    )
    # The feed catalogue has a handful of codes; rooms stay rows.
    grid = attach(star.scopes(locations), feeds.agg(F.collect_set("code").alias("_codes"))).select(F.explode("_codes").alias("code"), "scope")
    return grid.join(sums, ["code", "scope"], "left").fillna(0)


# The labels of a bridge's lines, in order.
BRIDGE_LABELS = (
    "Operational driver changed", "Quantity effect", "Rate or price effect", "Mix effect", "Timing effect", "Expected P&L account",
    "Expected recognition period", "Observed ledger movement", "Reconciliation variance", "Explanation", "Accountant review", "Reconciliation status",
)


def bridge(claims: DataFrame, sides: DataFrame) -> DataFrame:
    """Claim against ledger per intervention, with the reconciled part.

    ``claims``: (intervention_id, account, change, …); ``sides``: (intervention_id, status,
    claim_cents, observed_cents, timing_cents, unexplained_cents and optional texts).
    """
    has = set(sides.columns)
    text = lambda c: (F.col(c) if c in has else F.lit(None).cast("string")).alias(c)
    cols = ["status", "claim_cents", "observed_cents", "timing_cents", "unexplained_cents"]
    texts = ("quantity_effect", "rate_effect", "mix_effect", "period_label", "explanation", "reviewer")
    rows = claims.join(sides.select(KEY, *cols, *(text(t) for t in texts)), KEY)
    done = F.col("status").isin("reconciled", "timing")
    labels = F.create_map(*(F.lit(x) for kv in dims.RECON_LABELS.items() for x in kv))
    return rows.withColumn("reconciled_cents", F.when(done, F.col("observed_cents")).otherwise(0)).withColumn("status_label", labels[F.col("status")])


def bridge_lines(bridges: DataFrame) -> DataFrame:
    """The twelve lines of a bridge, one row each, under their fixed labels."""
    c = F.col
    blank = lambda name: F.coalesce(c(name), F.lit(""))
    timing = F.when(
        c("timing_cents") != 0, F.concat(format_usd(c("timing_cents")), F.lit(" belongs to the next period"))
    ).otherwise(F.lit("No shift between periods"))
    moved = F.concat(F.split("account", " · ")[0], F.lit(": "), format_usd(c("observed_cents")))
    share = F.coalesce(F.try_divide(c("unexplained_cents"), c("claim_cents")), F.lit(0.0))
    variance = F.concat(format_usd(c("unexplained_cents")), F.lit(" open, "), format_pct(share, 1))
    review = F.when(c("status").isin("partial", "unexplained"), F.concat(F.lit("Under review: "), blank("reviewer"))).otherwise(
        F.concat(F.lit("Signed off: "), blank("reviewer"))
    )
    values = [
        blank("change"), blank("quantity_effect"), blank("rate_effect"), blank("mix_effect"), timing, blank("account"), blank("period_label"), moved, variance,
        blank("explanation"), review, c("status_label"),
    ]
    lines = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(k).alias("k"), v.alias("v")) for i, (k, v) in enumerate(zip(BRIDGE_LABELS, values))))
    return bridges.select(KEY, F.inline(lines))


def largest_unexplained(sides: DataFrame) -> DataFrame:
    """The bridge with the largest unexplained line, if any is above 0."""
    best = F.max(F.struct(F.col("unexplained_cents"), F.col(KEY), F.col("claim_cents")))
    return sides.filter(F.col("unexplained_cents") > 0).agg(best.alias("b")).filter(F.col("b").isNotNull()).select("b.*")
