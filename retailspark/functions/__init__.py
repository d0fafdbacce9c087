"""Column -> Column helpers.  Every helper is a composition of built-in
``pyspark.sql.functions`` so it stays inside whole-stage codegen."""

from retailspark.functions.calendar import (
    cyclic_cos,
    cyclic_sin,
    date_label,
    half_hour_floor,
    is_payday,
    iso_weekday,
    long_date_es,
    parse_date,
    period_label,
    time_to_seconds,
)
from retailspark.functions.weather import forecast_temperature, weather_code
from retailspark.functions.numbers import clamp_round, deviation_pct, signed_percent, sign_class
from retailspark.functions.text import alert_label, normalize_text, short_name

__all__ = [
    "alert_label",
    "clamp_round",
    "cyclic_cos",
    "cyclic_sin",
    "date_label",
    "deviation_pct",
    "forecast_temperature",
    "half_hour_floor",
    "is_payday",
    "iso_weekday",
    "long_date_es",
    "normalize_text",
    "parse_date",
    "period_label",
    "short_name",
    "sign_class",
    "signed_percent",
    "time_to_seconds",
    "weather_code",
]
