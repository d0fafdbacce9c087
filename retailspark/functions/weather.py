"""Weather helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from retailspark.config import DEFAULT_WEATHER_CODE


#: The internal codes are 0 .. ``N_CODES - 1``.
N_CODES = 6


def weather_code(wmo: Column | str) -> Column:
    """Map a WMO weather code to the internal 0..5 scale.

    Fixed mapping: 0 -> 0; 1, 2 -> 1; 3 -> 2; 51..67 -> 3; 80..82 -> 4;
    95..99 -> 5; every other code (45, 48, 71-77, 85, ...) and NULL -> 1.
    """
    c = F.col(wmo) if isinstance(wmo, str) else wmo
    return (
        F.when(c == 0, F.lit(0))
        .when(c.isin(1, 2), F.lit(1))
        .when(c == 3, F.lit(2))
        .when(c.between(51, 67), F.lit(3))
        .when(c.between(80, 82), F.lit(4))
        .when(c.between(95, 99), F.lit(5))
        .otherwise(F.lit(DEFAULT_WEATHER_CODE))
        .cast("int")
    )


def forecast_temperature(t_max: Column, t_min: Column) -> Column:
    """Daily forecast temperature = (max + min) / 2."""
    return (t_max.cast("double") + t_min.cast("double")) / F.lit(2.0)
