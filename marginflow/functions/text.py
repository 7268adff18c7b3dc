"""Text forms of money, ratios and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUS = "−"


def fixed(x: Column, dp: int) -> Column:
    """A number with a fixed count of decimals, ties away from zero; ``-`` for negatives."""
    body = _unsigned(x, dp)
    return F.when(x < 0, F.concat(F.lit("-"), body)).otherwise(body)


def _unsigned(x: Column, dp: int, grouped: bool = False) -> Column:
    scale = 10**dp
    q = F.floor(F.abs(x) * scale + F.lit(0.5)).cast("long")
    whole = F.floor(q / scale).cast("long") if dp else q
    whole_text = F.format_number(whole, 0) if grouped else whole.cast("string")
    if not dp:
        return whole_text
    return F.concat(whole_text, F.lit("."), F.lpad((q % scale).cast("string"), dp, "0"))


def format_usd(cents: Column, dp: int | None = None, sign: bool = False) -> Column:
    """``$1,234`` from $100 up, ``$12.34`` below, unless the decimals are given."""
    value = F.coalesce(cents.cast("double"), F.lit(0.0))
    n = value / 100
    two = _unsigned_cents(value)
    zero = _unsigned(n, 0, grouped=True)
    if dp is None:
        body = F.when(F.abs(n) >= 100, zero).otherwise(two)
    else:
        body = two if dp == 2 else _unsigned(n, dp, grouped=True)
    lead = F.when(n < 0, F.lit(MINUS)).otherwise(F.lit("+" if sign else ""))
    return F.concat(lead, F.lit("$"), body)


def _unsigned_cents(value: Column) -> Column:
    q = F.floor(F.abs(value) + F.lit(0.5)).cast("long")
    return F.concat(F.format_number(F.floor(q / 100).cast("long"), 0), F.lit("."), F.lpad((q % 100).cast("string"), 2, "0"))


def format_pct(x: Column, dp: int = 1) -> Column:
    return F.concat(fixed(x * 100, dp), F.lit("%"))


def format_pp(x: Column, dp: int = 1) -> Column:
    return F.concat(F.when(x >= 0, F.lit("+")).otherwise(F.lit(MINUS)), _unsigned(x * 100, dp), F.lit("pp"))


def slug(x: Column) -> Column:
    """Upper case, runs of other characters to ``-``, no ``-`` at either end."""
    return F.regexp_replace(F.regexp_replace(F.upper(x), "[^A-Z0-9]+", "-"), "^-|-$", "")


def finding_id(code: str, *parts: Column) -> Column:
    return F.concat_ws("-", F.lit(f"F-{code}"), *parts)


def sentence_case(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))
