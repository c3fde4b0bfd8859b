"""Numbers: parsing, prices and reports' bars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sold_to_number(x) -> Column:
    """``1k+``, ``10k+``, ``500+``, ``1.2k``, ``2m``, ``1,234`` as numbers; ``<100`` and what is no number: 0."""
    t = F.lower(F.replace(F.trim(col(x).cast("string")), F.lit(","), F.lit("")))
    n = F.regexp_extract(t, r"([\d.]+)\s*([km]?)", 1).try_cast("double")
    unit = F.regexp_extract(t, r"([\d.]+)\s*([km]?)", 2)
    factor = F.when(unit == "k", 1e3).when(unit == "m", 1e6).otherwise(1.0)
    return F.when(t.startswith("<"), 0.0).otherwise(F.coalesce(F.round(n * factor), F.lit(0.0)))


def number_or_zero(x) -> Column:
    n = col(x).try_cast("double")
    return F.when(n.isNull() | F.isnan(n), 0.0).otherwise(n)


def first_real(*xs) -> Column:
    """The first that is not null, 0 or NaN; else 0."""
    return F.coalesce(*[F.when((n := col(x).try_cast("double")).isNotNull() & ~F.isnan(n) & (n != 0), n) for x in xs], F.lit(0.0))


def sell_price(cost) -> Column:
    """Half as much again or 25 more, whichever is more, up to the next 10."""
    c = col(cost).cast("double")
    return (F.ceil(F.greatest(c * 1.5, c + 25) / 10) * 10).cast("long")


def margin_floor(cost) -> Column:
    c = col(cost).cast("double")
    return (F.ceil(F.greatest(c * 1.5, c + 24) / 5) * 5).cast("long")


def markup(cost) -> Column:
    return sell_price(cost) / F.greatest(col(cost).cast("double"), F.lit(0.01))


def unscaled(x) -> Column:
    """Money that is stored times 100,000."""
    return col(x).cast("double") / 1e5


def half_up(x) -> Column:
    """Rounded to whole, halves up, also below zero."""
    return F.floor(col(x) + 0.5).cast("long")


def two_places(x) -> Column:
    return F.round(col(x).try_cast("double"), 2)


def text_bar(n, total, width: int) -> Column:
    """A bar of so many signs as the share of the total asks for; none below 0."""
    share = col(n) / F.greatest(col(total), F.lit(1)) * width
    return F.repeat(F.lit("#"), F.greatest(half_up(share), F.lit(0)).cast("int"))


def fixed(x, places: int) -> Column:
    """With so many decimals, halves away from 0; an exact decimal is rounded, not its binary form."""
    return F.round(col(x).cast("decimal(30, 10)"), places).cast(f"decimal(30, {places})").cast("string")


def padded(x, width: int, left: bool = False) -> Column:
    """Filled up with spaces at the end, or in front; what is longer stays whole."""
    t = col(x).cast("string")
    n = F.greatest(F.length(t), F.lit(width))
    return F.lpad(t, n, " ") if left else F.rpad(t, n, " ")


def clamp_batch(x, default: int = 20, most: int = 50) -> Column:
    n = col(x).try_cast("int")
    return F.least(F.greatest(F.coalesce(F.when(n != 0, n), F.lit(default)), F.lit(1)), F.lit(most))


def upper_median(x) -> Column:
    """The element at half the size of the ascending values; of an even number the larger middle one."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x} DESC)")
