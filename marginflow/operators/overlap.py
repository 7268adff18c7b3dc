"""Claims on the same dollars: intersections and their allocation.

Only pairs with a known intersection are ever formed; the edge table drives two
equi joins on the claim id, so no bucket of claims is paired with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_cents

RULES = {
    1: "1 · Explicit human resolution",
    2: "2 · Earliest verified claim",
    3: "3 · Narrowest scope",
    4: "4 · Strongest method",
    5: "5 · Proportional allocation",
    6: "— · Unresolved",
}


def sku_intersections(findings: DataFrame) -> DataFrame:
    """Weekly cents that a repriced and an over-used SKU share: the excess quantity at the price step.

    There is one price finding per SKU, so the join is one to many.
    """
    price = findings.filter(F.col("detector") == "PPV").select("sku", F.col("id").alias("ppv"), "p0", "p1")
    usage = findings.filter(F.col("detector") == "POR").select("sku", F.col("id").alias("por"), "excess_qty")
    cents = F.greatest(F.lit(0), round_cents(F.col("excess_qty") * (F.col("p1") - F.col("p0"))))
    pairs = price.join(usage, "sku").select("sku", "ppv", "por", cents.alias("cents")).filter(F.col("cents") > 0)
    return pairs.select(F.least("ppv", "por").alias("a_id"), F.greatest("ppv", "por").alias("b_id"), "cents")


def scope_width(locs: Column, items: Column) -> Column:
    return F.size(locs) * F.when(items.isNull(), F.lit(8)).otherwise(F.size(items))


def overlap_events(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Two rows per intersecting pair: what each side gives up, under which rule, in pair order (a_id, b_id)."""
    flipped = F.col("a_id") > F.col("b_id")
    edge = edges.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id"), "cents", flipped.alias("_flip"))
    edge = edge.groupBy("a_id", "b_id").agg(
        F.coalesce(F.max(F.when(~F.col("_flip"), F.col("cents"))), F.max("cents")).alias("cents")
    )
    has = set(claims.columns)
    opt = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind)
    facts = claims.select(
        "id", "locs", "account", "period", F.col("amount_cents").alias("amount"),
        scope_width(F.col("locs"), opt("items", "array<string>")).alias("width"),
        F.coalesce(opt("rung", "int"), F.lit(9)).alias("rung"), opt("verified_at", "date").alias("verified_at"),
        F.coalesce(opt("human_allocation", "boolean"), F.lit(False)).alias("human"),
    )
    side = lambda p: facts.select(*(F.col(c).alias(f"{p}_{c}") for c in facts.columns))
    pair = edge.join(side("a"), "a_id").join(side("b"), "b_id").filter(
        (F.col("a_account") == F.col("b_account")) & (F.col("a_period") == F.col("b_period")) & F.arrays_overlap("a_locs", "b_locs")
    )
    pair = pair.withColumn("shared", F.least("cents", "a_amount", "b_amount")).filter(F.col("shared") != 0)
    both_verified = F.col("a_verified_at").isNotNull() & F.col("b_verified_at").isNotNull()
    rule = (
        F.when(F.col("a_human") | F.col("b_human"), 1)
        .when(both_verified, 2)
        .when(F.col("a_width") != F.col("b_width"), 3)
        .when(F.col("a_rung") != F.col("b_rung"), 4)
        .when((F.col("a_amount") != 0) & (F.col("b_amount") != 0), 5)
        .otherwise(6)
    )
    a_wins = (
        F.when(F.col("rule") == 1, F.col("a_human"))
        .when(F.col("rule") == 2, F.col("a_verified_at") <= F.col("b_verified_at"))
        .when(F.col("rule") == 3, F.col("a_width") < F.col("b_width"))
        .when(F.col("rule") == 4, F.col("a_rung") < F.col("b_rung"))
    )
    pair = pair.withColumn("rule", rule).withColumn("a_wins", a_wins)
    a_share = round_cents(F.col("shared") * (1 - F.try_divide(F.col("a_amount"), F.col("a_amount") + F.col("b_amount"))))
    zero = F.lit(0).cast("bigint")

    def give(loses: Column, part: Column) -> Column:
        return F.when(F.col("rule") == 5, part).when(F.col("rule") == 6, zero).when(loses, F.col("shared")).otherwise(zero)

    def stand(loses: Column) -> Column:
        return F.when(F.col("rule") == 6, "unresolved").when((F.col("rule") == 5) | loses, "reduced").otherwise("holds")

    def role(loses: Column) -> Column:
        return F.when(F.col("rule") <= 4, F.when(loses, "reduced by").otherwise("holds against"))

    def ref(loses: Column, part: Column) -> Column:
        return F.when(F.col("rule") == 5, part).otherwise(F.col("shared"))

    lost_a, lost_b = ~F.col("a_wins"), F.col("a_wins")
    events = F.array(
        F.struct(
            F.col("a_id").alias("id"), F.col("b_id").alias("other_id"), give(lost_a, a_share).alias("deduction_cents"),
            ref(lost_a, a_share).alias("ref_cents"), stand(lost_a).alias("status"), role(lost_a).alias("role"),
        ),
        F.struct(
            F.col("b_id").alias("id"), F.col("a_id").alias("other_id"), give(lost_b, F.col("shared") - a_share).alias("deduction_cents"),
            ref(lost_b, F.col("shared") - a_share).alias("ref_cents"), stand(lost_b).alias("status"), role(lost_b).alias("role"),
        ),
    )
    names = F.create_map(*(F.lit(x) for kv in RULES.items() for x in kv))
    return pair.select("a_id", "b_id", names[F.col("rule")].alias("rule"), F.inline(events))


def resolve_overlaps(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Every claim with its status and deduction.

    Deductions add up; the last reduced or unresolved pair in pair order gives the
    status, else ``holds`` where the claim won any, else ``none``.
    """
    events = overlap_events(claims, edges)
    ruling = F.when(F.col("status") != "holds", F.struct("a_id", "b_id", "status"))
    total = events.groupBy("id").agg(
        F.sum("deduction_cents").alias("overlap_cents"), F.max(ruling)["status"].alias("_last"), F.count(F.lit(1)).alias("overlap_pairs")
    )
    return (
        claims.join(total, "id", "left")
        .withColumn(
            "overlap_status",
            F.when(F.col("overlap_pairs").isNull(), "none").otherwise(F.coalesce("_last", F.lit("holds"))),
        )
        .withColumn("overlap_cents", F.coalesce("overlap_cents", F.lit(0)))
        .withColumn("overlap_pairs", F.coalesce("overlap_pairs", F.lit(0)))
        .drop("_last")
    )
