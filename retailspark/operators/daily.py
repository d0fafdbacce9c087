"""Sales extraction and daily aggregation.

All operators work on every store x product at once; the reference issued one
query per product.  Grouping runs as partial + final hash aggregation, so a hot
product or store is combined map-side before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailspark.config import DEFAULT_TEMPERATURE, Config, as_date
from retailspark.functions.weather import N_CODES, weather_code
from retailspark.sources.readers import cut_lineage

SALES_COLUMNS = ["store_id", "barcode", "sale_date", "amount", "temperature", "weather_resume_wmo_code"]


def sales_scan(sales: DataFrame, *, as_of=None) -> DataFrame:
    """A1: the six training columns of the sales history (optionally up to ``as_of``)."""
    out = sales.select(*SALES_COLUMNS)
    if as_of is not None:
        out = out.filter(F.col("sale_date") <= F.lit(as_date(as_of)))
    return out


def list_stores(stores: DataFrame) -> DataFrame:
    """A3: the stores with their coordinates."""
    return stores.select("store_id", "latitude", "longitude")


def product_attributes(products: DataFrame, barcodes: DataFrame) -> DataFrame:
    """A4: name, category and image of the products in ``barcodes`` that exist."""
    wanted = barcodes.select("barcode")
    return products.select("barcode", "product_name", "category", "image_url").join(wanted, "barcode", "left_semi")


def recent_sales(sales: DataFrame, *, as_of, days: int | None = None, cfg: Config = Config()) -> DataFrame:
    """A2: rows with ``as_of - days <= sale_date <= as_of``.

    ``days`` of 0 or None falls back to the configured window, as in the reference.
    """
    d = days or cfg.training_window_days
    a = as_date(as_of)
    return sales.select(*SALES_COLUMNS).filter(
        (F.col("sale_date") >= F.date_sub(F.lit(a), d)) & (F.col("sale_date") <= F.lit(a))
    )



def daily_sales(sales: DataFrame) -> DataFrame:
    """Per (store_id, barcode, sale_date): amount sum, mean temperature over
    non-NULL readings, and the most frequent internal weather code (ties -> the
    lowest code; NULL WMO counts as code 1).  The few codes are counted one by one,
    which Spark does in a hash aggregate of fixed-size rows."""
    coded = sales.select(
        "store_id", "barcode", "sale_date", "amount", "temperature",
        weather_code(F.col("weather_resume_wmo_code")).alias("weather_code"),
    )
    counts = [F.count(F.when(F.col("weather_code") == k, 1)).alias(f"_n{k}") for k in range(N_CODES)]
    daily = coded.groupBy("store_id", "barcode", "sale_date").agg(
        F.sum("amount").alias("amount"), F.avg("temperature").alias("temperature"), *counts
    )
    most = F.greatest(*[F.col(f"_n{k}") for k in range(N_CODES)])
    lowest = F.coalesce(*[F.when(F.col(f"_n{k}") == most, F.lit(k)) for k in range(N_CODES)])
    return daily.select("store_id", "barcode", "sale_date", "amount", "temperature", lowest.alias("weather_code"))


def fill_temperature(daily: DataFrame) -> DataFrame:
    """A NULL daily temperature takes the unweighted mean of the product's
    daily means (all stores), else 22.0.

    Implemented as aggregate-then-join rather than a window partitioned by
    barcode, so a product holding a large share of the rows is reduced map-side
    instead of landing in one task.  The days are written once (they feed the means
    and the join), and so are the means: a row a product, which Spark broadcasts
    if they are few.
    """
    daily = cut_lineage(daily)
    means = cut_lineage(daily.groupBy("barcode").agg(F.avg("temperature").alias("_product_mean")))
    return (
        daily.join(means, "barcode", "left")
        .withColumn("temperature", F.coalesce("temperature", "_product_mean", F.lit(DEFAULT_TEMPERATURE)))
        .drop("_product_mean")
        .select(*daily.columns)
    )


def historical_average(sales: DataFrame, *, as_of, cfg: Config = Config()) -> DataFrame:
    """D3: V_p per (store_id, barcode): mean of the daily totals over the days
    *with sales* in ``as_of - history_days <= sale_date <= as_of`` (no zero fill).
    Pairs without rows are absent; consumers coalesce to 0.0."""
    a = as_date(as_of)
    window = sales.filter(
        (F.col("sale_date") >= F.date_sub(F.lit(a), cfg.history_days)) & (F.col("sale_date") <= F.lit(a))
    )
    per_day = window.groupBy("store_id", "barcode", "sale_date").agg(F.sum("amount").alias("daily_total"))
    return per_day.groupBy("store_id", "barcode").agg(
        F.avg(F.col("daily_total").cast("double")).alias("v_p"),
        F.count(F.lit(1)).alias("n_days"),
    )


def _signed_days(sales: DataFrame, sign) -> DataFrame:
    """Daily totals per pair, counted with ``sign`` of their date (1 or -1)."""
    per_day = sales.groupBy("store_id", "barcode", "sale_date").agg(F.sum("amount").alias("daily_total"))
    return per_day.select(
        "store_id", "barcode", (sign * F.coalesce("daily_total", F.lit(0))).cast("long").alias("units"),
        (sign * F.col("daily_total").isNotNull().cast("int")).cast("long").alias("n_valued"), sign.cast("long").alias("n_days"),
    )


def _window_totals(parts: DataFrame) -> DataFrame:
    sums = parts.groupBy("store_id", "barcode").agg(*[F.sum(c).alias(c) for c in ("units", "n_valued", "n_days")])
    return sums.where("n_days > 0")


def history_totals(sales: DataFrame, *, as_of, cfg: Config = Config()) -> DataFrame:
    """D3 as state: per (store_id, barcode) the ``units``, the days with a total
    (``n_valued``) and the days with sales (``n_days``) of the window up to ``as_of``."""
    a = F.lit(as_date(as_of))
    window = sales.filter((F.col("sale_date") >= F.date_sub(a, cfg.history_days)) & (F.col("sale_date") <= a))
    return _window_totals(_signed_days(window, F.lit(1)))


def advance_history(totals: DataFrame, sales: DataFrame, *, since, as_of, cfg: Config = Config()) -> DataFrame:
    """``history_totals`` of ``as_of`` from those of ``since``: the days that came are added
    and those that left the window are taken away, so a daily run reads two dates
    (partition filters), however long the window.  The table must have the days after
    ``since`` complete; rows that come later for a day that was added need a new
    ``history_totals``."""
    old, new = as_date(since), as_date(as_of)
    if new < old:
        raise ValueError("as_of must not lie before since")
    reach = dt.timedelta(days=cfg.history_days)
    day = dt.timedelta(days=1)
    came_from, left_to = max(old + day, new - reach), min(old, new - reach - day)
    d = F.col("sale_date")
    came, left = d.between(F.lit(came_from), F.lit(new)), d.between(F.lit(old - reach), F.lit(left_to))
    moved = sales.filter(came | left)
    sign = F.when(came, F.lit(1)).otherwise(F.lit(-1))
    return _window_totals(totals.select("store_id", "barcode", "units", "n_valued", "n_days").unionByName(_signed_days(moved, sign)))


def average_of(totals: DataFrame) -> DataFrame:
    """D3: ``historical_average`` from its state."""
    v_p = F.when(F.col("n_valued") > 0, F.col("units").cast("double") / F.col("n_valued"))
    return totals.select("store_id", "barcode", v_p.alias("v_p"), "n_days")


def examples_per_product(sales: DataFrame) -> DataFrame:
    """Raw sales rows per barcode."""
    return sales.groupBy("barcode").agg(F.count(F.lit(1)).alias("n_examples"))


def sold_products(sales: DataFrame) -> DataFrame:
    """Distinct barcodes with at least one sale."""
    return sales.select("barcode").filter(F.col("barcode").isNotNull()).distinct()


def sales_history(sales: DataFrame, *, store_id=None, barcode=None) -> DataFrame:
    """Daily units per (store, barcode, date) with the date as ``yyyy-MM-dd`` text.
    Optional ``store_id`` / ``barcode`` restrict to one series (pushed to the scan)."""
    s = sales
    if store_id is not None:
        s = s.filter(F.col("store_id") == F.lit(store_id))
    if barcode is not None:
        s = s.filter(F.col("barcode") == F.lit(barcode))
    g = s.groupBy("store_id", "barcode", "sale_date").agg(F.sum("amount").cast("long").alias("volume"))
    return g.select("store_id", "barcode", F.date_format("sale_date", "yyyy-MM-dd").alias("date"), "sale_date", "volume")
