"""Deterministic demand factors and seasonal temperature.

Re-aimed from the reference's synthetic-data script as a scoring projection:
the random draws (noise, Poisson sampling, hashed product factor) are not
reproduced; the product factor is an input column (default 1.0).  The lookup
tables are the caller's; Spark broadcasts them if their size allows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Base daily units and temperature sensitivity per category.
BASE_SALES = {"Beverages": 15, "Snacks": 10, "Dairy": 8, "Cleaning": 4, "Chips": 7, "Sweets": 9, "Groceries": 6}
TEMP_SENSITIVITY = {"Beverages": 0.55, "Snacks": 0.10, "Dairy": -0.10, "Cleaning": 0.00, "Chips": 0.10, "Sweets": 0.00, "Groceries": 0.05}
DEFAULT_BASE = 5
# Demand factor per WMO code (others 1.0).
WMO_FACTOR = {95: 0.75, 63: 0.82, 51: 0.91}
WEEKEND_FACTOR = 1.30  # Saturday, Sunday
FRIDAY_FACTOR = 1.15
PAYDAY_FACTOR = 1.40
# Seasonal temperature profile per city (base, range in degrees).
CITY_PROFILES = {
    "Guadalajara": (22, 7),
    "Ciudad de México": (17, 5),
    "Monterrey": (25, 11),
    "Puebla": (16, 5),
    "Cancún": (28, 5),
}


def category_factors(spark: SparkSession) -> DataFrame:
    rows = [(c, float(BASE_SALES[c]), float(TEMP_SENSITIVITY.get(c, 0.0))) for c in BASE_SALES]
    return spark.createDataFrame(rows, "category string, base double, sens double")


def city_profiles(spark: SparkSession) -> DataFrame:
    rows = [(c, float(b), float(r)) for c, (b, r) in CITY_PROFILES.items()]
    return spark.createDataFrame(rows, "city string, t_base double, t_range double")


def seasonal_temperature(df: DataFrame, cities: DataFrame, *, city: str = "city", date_col: str = "sale_date") -> DataFrame:
    """``expected_temperature = base + range * sin((month - 3) * pi / 6)``
    for the row's city (NULL for cities without a profile)."""
    j = df.join(cities.withColumnRenamed("city", city), city, "left")
    angle = (F.month(F.col(date_col)) - F.lit(3)).cast("double") * F.lit(math.pi) / F.lit(6.0)
    return j.withColumn("expected_temperature", F.col("t_base") + F.sin(angle) * F.col("t_range")).drop("t_base", "t_range")


def expected_demand(df: DataFrame, factors: DataFrame, *, date_col: str = "sale_date", temperature: str = "temperature",
                    wmo: str = "weather_resume_wmo_code", product_factor: str | None = None) -> DataFrame:
    """base(category) x product factor x weekday factor x payday factor x
    (1 + sensitivity(category) * (t - 20) / 15) x weather factor(WMO)."""
    j = df.join(factors, "category", "left")
    d = F.col(date_col)
    wd = F.weekday(d)
    dow = F.when(wd >= 5, F.lit(WEEKEND_FACTOR)).when(wd == 4, F.lit(FRIDAY_FACTOR)).otherwise(F.lit(1.0))
    day = F.dayofmonth(d)
    pay = F.when(day.between(13, 17) | (day >= 27), F.lit(PAYDAY_FACTOR)).otherwise(F.lit(1.0))
    tf = F.lit(1.0) + F.coalesce(F.col("sens"), F.lit(0.0)) * ((F.col(temperature) - F.lit(20.0)) / F.lit(15.0))
    w = F.col(wmo)
    wf = F.when(w == 95, F.lit(WMO_FACTOR[95])).when(w == 63, F.lit(WMO_FACTOR[63])).when(w == 51, F.lit(WMO_FACTOR[51])).otherwise(F.lit(1.0))
    pf = F.coalesce(F.col(product_factor), F.lit(1.0)) if product_factor else F.lit(1.0)
    base = F.coalesce(F.col("base"), F.lit(float(DEFAULT_BASE)))
    expected = base * pf * dow * pay * tf * wf
    return j.withColumn("expected_demand", expected).drop("base", "sens")
