"""Feature construction (B2-B6): ten numeric columns in a fixed order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailspark.config import DEFAULT_WEATHER_CODE, TRAINING_ZERO_TEMPERATURE
from retailspark.functions.calendar import cyclic_cos, cyclic_sin, is_payday

# Fixed order of the model inputs; changing it invalidates every stored model.
FEATURE_NAMES = [
    "sin_weekday", "cos_weekday",
    "sin_day", "cos_day",
    "sin_month", "cos_month",
    "payday",
    "temperature",
    "weather_code",
    "store_f",
]
N_FEATURES = len(FEATURE_NAMES)


def feature_columns(date_col: str = "sale_date", temperature: str = "temperature", code: str = "weather_code", store: str = "store_id"):
    d = F.col(date_col)
    return [
        cyclic_sin(F.weekday(d), 7).alias("sin_weekday"),
        cyclic_cos(F.weekday(d), 7).alias("cos_weekday"),
        cyclic_sin(F.dayofmonth(d), 31).alias("sin_day"),
        cyclic_cos(F.dayofmonth(d), 31).alias("cos_day"),
        cyclic_sin(F.month(d), 12).alias("sin_month"),
        cyclic_cos(F.month(d), 12).alias("cos_month"),
        is_payday(d).cast("double").alias("payday"),
        F.col(temperature).cast("double").alias("temperature"),
        F.col(code).cast("double").alias("weather_code"),
        F.col(store).cast("double").alias("store_f"),
    ]


def feature_matrix(daily: DataFrame, *, training: bool, zero_as_missing: bool = True, date_col: str = "sale_date") -> DataFrame:
    """Keys + the ten features + target ``y`` (daily amount, training only).

    Training applies the reference's falsy defaults: temperature NULL or 0.0 ->
    20.0 and weather code NULL or 0 -> 1 (``zero_as_missing``).  Scoring does not.
    """
    df = daily
    if training:
        t, c = F.col("temperature"), F.col("weather_code")
        if zero_as_missing:
            t2 = F.when(t.isNull() | (t == 0), F.lit(TRAINING_ZERO_TEMPERATURE)).otherwise(t)
            c2 = F.when(c.isNull() | (c == 0), F.lit(DEFAULT_WEATHER_CODE)).otherwise(c)
        else:
            t2 = F.coalesce(t, F.lit(TRAINING_ZERO_TEMPERATURE))
            c2 = F.coalesce(c, F.lit(DEFAULT_WEATHER_CODE))
        df = df.withColumn("temperature", t2).withColumn("weather_code", c2)
    keys = [k for k in ("store_id", "barcode", date_col) if k in df.columns]
    extra = [F.col("amount").cast("double").alias("y")] if training else []
    return df.select(*keys, *feature_columns(date_col=date_col), *extra)
