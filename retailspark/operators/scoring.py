"""Forecast inputs, scoring grid and prediction write-back.

The grid is built with equi-joins only: each store's assortment (the products it
has sold) joined to that store's forecast days, then to products, fitted models
and V_p by key.  No cartesian product of all stores and all products is formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailspark.config import DEFAULT_TEMPERATURE, DEFAULT_WEATHER_CODE, Config, as_date
from retailspark.functions.numbers import clamp_round
from retailspark.functions.weather import forecast_temperature, weather_code
from retailspark.operators.alerts import classify
from retailspark.operators.features import feature_columns
from retailspark.operators.models import predict
from retailspark.sources.readers import cut_lineage

PREDICTION_COLUMNS = [
    "store_id", "barcode", "product_name", "category", "image_url", "objective_date", "prediction", "feature", "type",
    "percentage_average_deviation",
]


def forecast_days(payload: DataFrame, *, cfg: Config = Config()) -> DataFrame:
    """Daily forecast arrays -> ``store_id, objective_date, temperature,
    weather_code``: temperature = (max + min) / 2, code mapped to 0..5, day i =
    start_date + i, at most ``prediction_days`` days."""
    z = payload.select(
        "store_id", "start_date",
        F.posexplode(F.arrays_zip("temperature_2m_max", "temperature_2m_min", "weather_code")).alias("i", "d"),
    ).filter(F.col("i") < cfg.prediction_days)
    return z.select(
        "store_id",
        F.date_add(F.col("start_date"), F.col("i")).alias("objective_date"),
        forecast_temperature(F.col("d.temperature_2m_max"), F.col("d.temperature_2m_min")).alias("temperature"),
        weather_code(F.col("d.weather_code")).alias("weather_code"),
    )


def with_forecast_fallback(stores: DataFrame, forecast: DataFrame, *, as_of, cfg: Config = Config()) -> DataFrame:
    """Every store gets ``prediction_days`` days from ``as_of``; days the
    forecast lacks use the neutral 22.0 degrees and code 1."""
    a = as_date(as_of)
    days = stores.select(
        "store_id", F.explode(F.sequence(F.lit(0), F.lit(cfg.prediction_days - 1))).alias("i")
    ).select("store_id", F.date_add(F.lit(a), F.col("i")).alias("objective_date"))
    j = days.join(forecast, ["store_id", "objective_date"], "left")
    return j.select(
        "store_id", "objective_date",
        F.coalesce("temperature", F.lit(DEFAULT_TEMPERATURE)).alias("temperature"),
        F.coalesce("weather_code", F.lit(DEFAULT_WEATHER_CODE)).alias("weather_code"),
        F.col("temperature").isNull().alias("is_fallback"),
    )


def assortment(sales: DataFrame, *, as_of=None) -> DataFrame:
    """(store_id, barcode) pairs with at least one sale (up to ``as_of``)."""
    s = sales if as_of is None else sales.filter(F.col("sale_date") <= F.lit(as_date(as_of)))
    return s.select("store_id", "barcode").distinct()



def update_assortment(previous: DataFrame, sales: DataFrame, *, since, as_of) -> DataFrame:
    """The assortment maintained from run to run: the previous pairs plus pairs
    sold in ``since < sale_date <= as_of`` (a date-pruned read instead of a scan
    of the whole history)."""
    recent = sales.filter((F.col("sale_date") > F.lit(as_date(since))) & (F.col("sale_date") <= F.lit(as_date(as_of))))
    return previous.select("store_id", "barcode").unionByName(recent.select("store_id", "barcode")).distinct()


def extend_assortment(previous: DataFrame, arrived: DataFrame) -> DataFrame:
    """The previous pairs and those of rows that arrived since, late ones included."""
    return previous.select("store_id", "barcode").unionByName(arrived.select("store_id", "barcode")).distinct()


def scoring_grid(pairs: DataFrame, days: DataFrame, products: DataFrame) -> DataFrame:
    """Pairs x that store's forecast days (equi-join on store_id), with the
    product attributes (inner: unknown products are skipped).  These are written once,
    so that Spark broadcasts them if they are few."""
    p = cut_lineage(products.select("barcode", "product_name", "category", "image_url"))
    return pairs.join(days, "store_id").join(p, "barcode")


def score(grid: DataFrame, models: DataFrame, v_p: DataFrame, *, cfg: Config = Config()) -> DataFrame:
    """Join fitted models (only products with a coefficient vector and
    at least ``min_examples_cold_start`` examples are scored) and V_p (absent ->
    0.0), build inference features (no zero defaulting), predict, clamp and
    round half-even, classify, and return prediction rows."""
    m = models.filter(F.col("coef").isNotNull() & (F.col("total_examples") >= F.lit(cfg.min_examples_cold_start)))
    # The models are a row a product, written once and broadcast if they are few; last,
    # so that no coefficients are shuffled.
    m = cut_lineage(m.select("barcode", "coef"))
    g = grid.join(v_p.select("store_id", "barcode", "v_p"), ["store_id", "barcode"], "left").join(m, "barcode")
    f = g.select(
        "store_id", "barcode", "objective_date", "product_name", "category", "image_url", "coef",
        F.coalesce("v_p", F.lit(0.0)).alias("v_p"),
        *feature_columns(date_col="objective_date"),
    )
    scored = f.withColumn("raw", predict("coef")).withColumn("prediction", clamp_round(F.col("raw")))
    return classify(scored, cfg=cfg).select(*PREDICTION_COLUMNS)


def predictions_per_store(pred: DataFrame) -> DataFrame:
    """H6: rows written per store."""
    return pred.groupBy("store_id").agg(F.count(F.lit(1)).alias("n_predictions"))


def replace_keyed(old: DataFrame, new: DataFrame, keys: list[str] = ("store_id", "barcode")) -> DataFrame:
    """Every key present in ``new`` loses all of its old rows and gets
    the new ones; keys absent from ``new`` are untouched."""
    keys = list(keys)
    new_keys = new.select(*keys).distinct()
    return old.join(new_keys, keys, "left_anti").unionByName(new.select(*old.columns))
