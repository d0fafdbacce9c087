"""Calendar and time helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish weekday names (Monday first) and month names.
WEEKDAYS_ES = ["Lunes", "Martes", "Miércoles", "Jueves", "Viernes", "Sábado", "Domingo"]
MONTHS_ES = [
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
]

_TWO_PI = 2.0 * math.pi


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cyclic_sin(value: Column, period: float) -> Column:
    """sin(2*pi*value/period)."""
    return F.sin(F.lit(_TWO_PI) * value.cast("double") / F.lit(float(period)))


def cyclic_cos(value: Column, period: float) -> Column:
    """cos(2*pi*value/period)."""
    return F.cos(F.lit(_TWO_PI) * value.cast("double") / F.lit(float(period)))


def is_payday(d: Column | str) -> Column:
    """1 when the day of month is 13..17 or >= 27, else 0."""
    day = F.dayofmonth(_c(d))
    return F.when(day.between(13, 17) | (day >= 27), F.lit(1)).otherwise(F.lit(0))


def iso_weekday(d: Column | str) -> Column:
    """ISO weekday 1..7 with Monday = 1 (Spark ``weekday`` is Monday = 0)."""
    return F.weekday(_c(d)) + F.lit(1)


def parse_date(text: Column | str, fmt: str = "dd-MM-yyyy") -> Column:
    """Parse text to a date; NULL (not an error) on malformed text."""
    return F.try_to_date(_c(text), fmt)


def date_label(d: Column | str, fmt: str = "dd/MM/yyyy") -> Column:
    return F.date_format(_c(d), fmt)


def period_label(start: Column | str, end: Column | str) -> Column:
    """``dd-MM-yyyy al dd-MM-yyyy``."""
    return F.concat(F.date_format(_c(start), "dd-MM-yyyy"), F.lit(" al "), F.date_format(_c(end), "dd-MM-yyyy"))


def long_date_es(d: Column | str) -> Column:
    """Spanish long date: ``<weekday>, <month> <day>, <year>``."""
    d = _c(d)
    weekday_name = F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS_ES]), F.weekday(d) + F.lit(1))
    month_name = F.element_at(F.array(*[F.lit(m) for m in MONTHS_ES]), F.month(d))
    return F.concat(weekday_name, F.lit(", "), month_name, F.lit(" "), F.dayofmonth(d).cast("string"), F.lit(", "), F.year(d).cast("string"))


def time_to_seconds(t: Column | str) -> Column:
    """Seconds since midnight of ``HH:mm:ss`` or ``yyyy-MM-dd HH:mm:ss`` text;
    NULL for anything else, so that one bad value costs its own row only."""
    t = F.trim(_c(t))
    pattern = r"^(?:\d{4}-\d{2}-\d{2} )?([01]\d|2[0-3]):([0-5]\d):([0-5]\d)$"
    part = lambda at: F.substring(t, at, 2).try_cast("int")
    return F.when(t.rlike(pattern), part(-8) * 3600 + part(-5) * 60 + part(-2))


def half_hour_floor(t: Column | str) -> Column:
    """Floor a time text to its half-hour block, returned as ``HH:mm:00``; NULL if malformed."""
    secs = time_to_seconds(t)
    block = F.floor(secs / F.lit(1800)).cast("int") * 1800
    return F.when(secs.isNotNull(), F.format_string("%02d:%02d:00", (block / 3600).cast("int"), ((block % 3600) / 60).cast("int")))
