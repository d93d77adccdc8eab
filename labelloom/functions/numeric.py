"""Numbers, dates and reproducible draws."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def revision_date(day: Column, month: Column, year: Column) -> Column:
    """Date from its three parts; null when they make no date."""
    return F.try_to_date(F.concat_ws("-", day, month, year), "d-M-yyyy")


def parse_revision_date(c: Column) -> Column:
    """``d-m-y`` text -> date; null when unreadable."""
    return F.try_to_date(c, "d-M-yyyy")


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def at_threshold(prob: Column, threshold: float) -> Column:
    """0/1 prediction; a probability equal to the threshold counts as positive."""
    return (prob >= F.lit(threshold)).cast("int")


def remap_unknown(target: Column) -> Column:
    """Unknown targets (-1) become class 2."""
    return F.when(target == -1, 2).otherwise(target)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, null when b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio_or_zero(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def draw_digits(*parts: Column) -> Column:
    """The bits of ``draw_bits`` as eight hexadecimal digits, which sort alike and are had for less."""
    return F.substring(F.md5(F.concat(*[p.cast("string") for p in parts])), 1, 8)


def digits_of(bits: Column) -> Column:
    """A number as ``draw_digits`` compare with it: one below or above all draws is below or above all digits."""
    inside = F.lpad(F.lower(F.hex(bits.cast("long"))), 8, "0")
    return F.when(bits < 0, "").when(bits >= F.lit(1 << 32), "g").otherwise(inside)


def draw_bits(*parts: Column) -> Column:
    """32 reproducible bits from the text of ``parts``; independent of row order and partitioning."""
    return F.conv(draw_digits(*parts), 16, 10).cast("long")


def draw(*parts: Column) -> Column:
    """Reproducible number in [0, 1)."""
    return draw_bits(*parts) / F.lit(4294967296.0)


def drawn_within(share: float, *parts: Column) -> Column:
    """Whether ``draw(*parts)`` is at most ``share``."""
    return draw_digits(*parts) <= digits_of(F.floor(F.lit(float(share)) * F.lit(4294967296.0)))


def made_once(c: Column) -> Column:
    """A costly value as an exploded one, so that filters on it do not make it again."""
    return F.explode(F.array(c))


def threshold_grid(thresholds: list[float] | None = None) -> list[float]:
    """The given thresholds, or 0.50..0.85 by 0.05 followed by 0.90..1.00 by 0.005."""
    if thresholds is not None:
        return sorted(thresholds)
    coarse = [round(0.5 + 0.05 * i, 3) for i in range(8)]
    fine = [round(0.9 + 0.005 * i, 3) for i in range(21)]
    return coarse + fine
