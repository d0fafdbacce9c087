"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp_round(raw: Column) -> Column:
    """``round(max(0, raw))`` with half-to-even rounding, as an int."""
    return F.bround(F.greatest(raw.cast("double"), F.lit(0.0)), 0).cast("int")


def deviation_pct(p: Column, v: Column) -> Column:
    """Percent deviation of prediction ``p`` from average ``v``.

    ``v <= 0`` (or NULL): +Infinity when p > 0, else 0.0.  Division is guarded,
    so ANSI mode never raises.
    """
    p = p.cast("double")
    v = v.cast("double")
    safe_v = F.when(v > 0, v)
    return F.when(
        v.isNull() | (v <= 0),
        F.when(p > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)),
    ).otherwise((p - v) / safe_v * F.lit(100.0))


def sign_class(d: Column) -> Column:
    """``positive`` / ``negative`` / ``neutral``."""
    return F.when(d > 0, F.lit("positive")).when(d < 0, F.lit("negative")).otherwise(F.lit("neutral"))


def _two_sum(a: Column, b: Column) -> tuple[Column, Column]:
    """``a + b`` as the nearest double and what it misses, both exact."""
    total = a + b
    part = total - a
    return total, (a - (total - part)) + (b - part)


def _nearest(d: Column, scale: int) -> Column:
    """``d * scale`` rounded to an integral double as its exact binary value says
    (ties to even), for a scale of 10 or 100.

    The product is a sum of powers of two times ``d``, so it is known exactly as
    a double and a rest; the rest decides where the double seems to lie halfway."""
    if scale == 10:
        total, rest = _two_sum(d * 8.0, d * 2.0)
    elif scale == 100:
        first, rest_1 = _two_sum(d * 64.0, d * 32.0)
        second, rest_2 = _two_sum(first, d * 4.0)
        total, rest = _two_sum(second, rest_1 + rest_2)
    else:
        raise ValueError("scale must be 10 or 100")
    below = F.floor(total).cast("double")
    over = total - below
    up = (over > 0.5) | ((over == 0.5) & ((rest > 0) | ((rest == 0) & (F.abs(below) % 2 == 1))))
    # From 2^52 on a double has no fraction.
    return F.when(F.abs(total) >= float(2**52), total).otherwise(below + F.when(up, 1.0).otherwise(0.0))


def round_decimal(d: Column, places: int) -> Column:
    """``round(d, places)`` for one or two places as Python does it: the exact
    binary value decides (2.675 is less than it looks and gives 2.67); -0.0 is
    0.0, and from 2^45 on ``d`` stays."""
    d = d.cast("double")
    scale = 10**places
    # + 0.0 folds -0.0 into 0.0.
    return F.when(F.abs(d) >= float(2**45), d).otherwise(_nearest(d, scale) / F.lit(float(scale))) + F.lit(0.0)


def signed_percent(d: Column) -> Column:
    """``+12.3%`` / ``-4.0%`` / ``0.0%``: one decimal of the exact binary value,
    ``+`` only when positive; infinite values and small negatives print as
    Python does (``inf``, ``-0.0``)."""
    d = d.cast("double")
    sign = F.when(d > 0, F.lit("+")).when(d < 0, F.lit("-")).otherwise(F.lit(""))
    tenths = F.abs(F.when(F.abs(d) < float(2**49), _nearest(d, 10)).otherwise(F.lit(0.0))).cast("long")
    whole = F.floor(tenths / F.lit(10)).cast("long")
    body = (
        F.when(d.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(d), F.lit("nan"))
        .when(F.abs(d) == F.lit(float("inf")), F.lit("inf"))
        .when(F.abs(d) >= float(2**49), F.format_string("%.1f", F.abs(d)))
        .otherwise(F.concat(whole.cast("string"), F.lit("."), (tenths - whole * 10).cast("string")))
    )
    return F.concat(sign, body, F.lit("%"))
