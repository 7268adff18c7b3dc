"""Claims as one star fact: figure by set of rooms, whatever the number of claims or of rooms in a set.

A claim splits its cents equally over its rooms, the first ones taking the cent that is left over. So all claims of one
set of rooms give the room at position p the sum of their floors, plus one for every claim whose remainder is above p.
Claims are therefore added up per (figure, set, remainder) before any room is named; a set is opened once, and a running
sum over its positions takes out the remainders that have ended. A claim of the whole group that names no room is the
set ``*``: all rooms in order of their name.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import attach, durable, number_rows

#: Between the rooms of a set; room names hold no control characters.
BETWEEN = "\x1f"
EVERY = "*"
GROUP = "group"


def room_set() -> Column:
    """A record's rooms as one string: those it names, all for the group, else its own."""
    named = F.when(F.size("locs") > 0, F.array_join("locs", BETWEEN))
    return F.coalesce(named, F.when(F.col("loc") == GROUP, F.lit(EVERY)), F.col("loc"))


def named_rooms() -> Column:
    return F.split("rooms", BETWEEN)


def _entries(entries: Mapping[str, tuple[Column, Column]]) -> Column:
    cells = (F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(name).alias("figure"), amount.cast("bigint").alias("amount"))) for name, (test, amount) in entries.items())
    return F.inline(F.filter(F.array(*cells), lambda e: e.isNotNull()))


def claims(records: DataFrame, entries: Mapping[str, tuple[Column, Column]], also: Sequence[str] = ()) -> DataFrame:
    """One row per record and figure whose test it passes: figure, amount, its set of rooms and whether it is the group's."""
    rows = records.select(*also, room_set().alias("rooms"), (F.col("loc") == GROUP).alias("of_group"), _entries(entries))
    return rows.withColumn("amount", F.coalesce("amount", F.lit(0).cast("bigint"))).withColumn("of_group", F.coalesce("of_group", F.lit(False)))


def added_up(rows: DataFrame, locations: DataFrame, by: Sequence[str] = ("figure",)) -> DataFrame:
    """The star fact of ``claims``: per figure, set and remainder the cents, floors, cents left over, and counts."""
    sized = attach(rows, locations.agg(F.count(F.lit(1)).alias("_all")))
    parts = F.when(F.col("rooms") == EVERY, F.greatest(F.col("_all"), F.lit(1))).otherwise(F.size(named_rooms()))
    sized = sized.withColumn("_k", parts.cast("bigint")).withColumn("_size", F.abs("amount"))
    left = F.pmod(F.col("_size"), F.col("_k"))
    sign = F.when(F.col("amount") < 0, -1).otherwise(1).cast("bigint")
    floor = ((F.col("_size") - left) / F.col("_k")).cast("bigint")
    fact = sized.groupBy(*by, "rooms", left.alias("rem")).agg(
        F.sum("amount").alias("cents"), F.sum(sign * floor).alias("floors"), F.sum(F.when(left > 0, sign).otherwise(0)).alias("extra"),
        F.count(F.lit(1)).alias("n"), F.sum(F.col("of_group").cast("bigint")).alias("shared"),
    )
    # Small whatever the claims, and read by every figure: written once, so each pipeline of claims runs once.
    return durable(fact)


def by_room(fact: DataFrame, locations: DataFrame, by: Sequence[str] = ("figure",)) -> DataFrame:
    """(keys, scope, cents, n) of every room of every set; ``n`` leaves out the claims of the whole group."""
    sums = fact.groupBy(*by, "rooms").agg(*(F.sum(c).alias(c) for c in ("floors", "extra")), F.sum(F.col("n") - F.col("shared")).alias("n"))
    spread = sums.filter(F.col("rooms") != EVERY).select("*", F.posexplode(named_rooms()).alias("pos", "scope"))
    if fact.filter(F.col("rooms") == EVERY).limit(1).count():
        # One entry per figure and period, whatever the claims.
        whole = sums.filter(F.col("rooms") == EVERY).agg(F.collect_list(F.struct(*by, "rooms", "floors", "extra", "n")).alias("_sets"))
        places = number_rows(locations.select(F.col("loc").alias("scope")), [F.col("scope")], "_at").select("scope", (F.col("_at") - 1).cast("int").alias("pos"))
        spread = spread.unionByName(attach(places, whole).select("pos", "scope", F.inline("_sets")))
    ended = fact.filter(F.col("rem") > 0).groupBy(*by, "rooms", F.col("rem").cast("int").alias("pos")).agg(F.sum("extra").alias("_ended"))
    rows = spread.unionByName(ended, allowMissingColumns=True)
    # A set is as long as its rooms; a remainder ends before the room at its position.
    so_far = W.partitionBy(*by, "rooms").orderBy("pos", F.col("scope").isNotNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = rows.withColumn("_over", F.coalesce(F.sum("_ended").over(so_far), F.lit(0))).filter(F.col("scope").isNotNull())
    return placed.groupBy(*by, "scope").agg(F.sum(F.col("floors") + F.col("extra") - F.col("_over")).alias("cents"), F.sum("n").alias("n"))


def by_scope(fact: DataFrame, locations: DataFrame, figures: Sequence[str]) -> DataFrame:
    """One row per room and for the group (``all``) with ``c_<figure>`` cents and ``n_<figure>`` counts.

    A claim of the group counts in every room, and its cents only in the rooms it covers.
    """
    rooms = by_room(fact, locations)
    whole = fact.groupBy("figure").agg(F.sum("cents").alias("cents"), F.sum("n").alias("n")).withColumn("scope", F.lit("all"))
    cell = lambda f, c: F.sum(F.when(F.col("figure") == f, F.col(c)))
    sums = rooms.unionByName(whole).groupBy("scope").agg(*(cell(f, "cents").alias(f"c_{f}") for f in figures), *(cell(f, "n").alias(f"n_{f}") for f in figures))
    shared = fact.agg(*(F.coalesce(cell(f, "shared"), F.lit(0)).alias(f"s_{f}") for f in figures))
    out = attach(scopes(locations).join(sums, "scope", "left").fillna(0), shared)
    everywhere = F.col("scope") == "all"
    counts = {f"n_{f}": F.col(f"n_{f}") + F.when(everywhere, 0).otherwise(F.col(f"s_{f}")) for f in figures}
    return out.withColumns(counts).drop(*(f"s_{f}" for f in figures))


def scopes(locations: DataFrame) -> DataFrame:
    """Every room, and ``all``."""
    return locations.select(F.col("loc").alias("scope")).unionByName(locations.sparkSession.range(1).select(F.lit("all").alias("scope")))


def shares(amounts: DataFrame, locations: DataFrame, by: Sequence[str]) -> DataFrame:
    """(keys, scope, amount): unrounded equal shares of amounts that were summed per set of rooms, and ``all``."""
    summed = durable(amounts.groupBy(*by, "rooms").agg(F.sum("amount").alias("amount")))
    named = summed.filter(F.col("rooms") != EVERY).withColumn("_rooms", named_rooms())
    spread = named.select(*by, F.explode("_rooms").alias("scope"), (F.col("amount") / F.size("_rooms")).alias("amount"))
    whole = summed.groupBy(*by).agg(F.sum("amount").alias("amount")).withColumn("scope", F.lit("all"))
    out = spread.unionByName(whole.select(*by, "scope", "amount"))
    if summed.filter(F.col("rooms") == EVERY).limit(1).count():
        every = attach(summed.filter(F.col("rooms") == EVERY), locations.agg(F.count(F.lit(1)).alias("_all")))
        # As long as the keys are many (days or feeds), whatever the claims.
        rows = every.agg(F.collect_list(F.struct(*by, (F.col("amount") / F.col("_all")).alias("amount"))).alias("_rows"))
        out = out.unionByName(attach(locations.select(F.col("loc").alias("scope")), rows).select("scope", F.inline("_rows")).select(*by, "scope", "amount"))
    return out.groupBy(*by, "scope").agg(F.sum("amount").alias("amount"))
