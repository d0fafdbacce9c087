"""Point-of-sale ingest: scans, half-hour packages, gateway enrichment (A5-A7,
B10, B14, B23, B24, C1-C3, C8, D7-D9, D16, G2, G4)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailspark.config import RETENTION_DAYS, as_date
from retailspark.functions.calendar import half_hour_floor, iso_weekday, time_to_seconds
from retailspark.operators.ids import with_sequential_id

# Registration rules of the client form.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
NAME_MIN_LENGTH = 3
DIGIT_PATTERN = r"[\p{Nd}¹²³⁰⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉]"

# Product attributes when the catalogue lookup misses or lacks a field.
UNKNOWN_NAME = "Producto Desconocido"
UNKNOWN_CATEGORY = "Sin Categoría"
NO_IMAGE = "Sin Imagen"
NAME_UNAVAILABLE = "Nombre no disponible"

_STRIP = r"^\s+|\s+$"


def validate_registrations(requests: DataFrame) -> DataFrame:
    """``valid_name`` (stripped length >= 3 and no digit anywhere) and
    ``valid_email`` (stripped address matches local@domain.tld)."""
    name = F.coalesce(F.col("name"), F.lit(""))
    email = F.regexp_replace(F.coalesce(F.col("email"), F.lit("")), _STRIP, "")
    return requests.withColumn(
        "valid_name", (F.length(F.regexp_replace(name, _STRIP, "")) >= NAME_MIN_LENGTH) & ~name.rlike(DIGIT_PATTERN)
    ).withColumn("valid_email", email.rlike(EMAIL_PATTERN))


def clean_scans(raw: DataFrame) -> DataFrame:
    """Strip surrounding whitespace (spaces, tabs, newlines) from the
    scanned code, drop empty codes, one unit per scan."""
    return (
        raw.withColumn("barcode", F.regexp_replace(F.col("barcode"), _STRIP, ""))
        .filter(F.col("barcode").isNotNull() & (F.length("barcode") > 0))
        .withColumn("amount", F.lit(1))
    )


def scan_totals(scans: DataFrame, stores: DataFrame | None = None) -> DataFrame:
    """Units scanned per store; stores without scans report 0 when given."""
    t = scans.groupBy("store_id").agg(F.sum("amount").cast("long").alias("total_units"))
    if stores is None:
        return t
    return stores.select("store_id").join(t, "store_id", "left").select(
        "store_id", F.coalesce("total_units", F.lit(0).cast("long")).alias("total_units")
    )


def half_hour_sales(scans: DataFrame) -> DataFrame:
    """Units per (store, scan date, half-hour block, barcode).

    ``time`` is ``yyyy-MM-dd HH:mm:ss`` (or bare ``HH:mm:ss``, then the date is
    NULL); the block is the time floored to :00 or :30.  Scans with another time
    are left out; ``malformed_scans`` has them."""
    t = F.trim(F.col("time"))
    scans = scans.filter(time_to_seconds(t).isNotNull())
    d = F.when(F.length(t) > 8, F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
    s = scans.select("store_id", d.alias("sale_date"), half_hour_floor(t).alias("block"), "barcode", "amount")
    return s.groupBy("store_id", "sale_date", "block", "barcode").agg(F.sum("amount").cast("long").alias("amount"))


def malformed_scans(scans: DataFrame) -> DataFrame:
    """The scans whose ``time`` can't be read (NULL included)."""
    return scans.filter(time_to_seconds(F.col("time")).isNull())


def sales_packages(half_hours: DataFrame) -> DataFrame:
    """Nested package per (store, date): ``id_store, date (dd-MM-yyyy), day
    (ISO weekday), sales: [{time, products: [{barcode, amount}]}]`` sorted by
    time and barcode.  Arrays are bounded by 48 blocks x products per block."""
    blocks = half_hours.groupBy("store_id", "sale_date", "block").agg(
        F.array_sort(F.collect_list(F.struct(F.col("barcode"), F.col("amount").cast("int").alias("amount")))).alias("products")
    )
    pk = blocks.groupBy("store_id", "sale_date").agg(
        F.array_sort(F.collect_list(F.struct(F.col("block").alias("time"), F.col("products")))).alias("sales")
    )
    return pk.select(
        F.col("store_id").alias("id_store"),
        F.date_format("sale_date", "dd-MM-yyyy").alias("date"),
        iso_weekday(F.col("sale_date")).alias("day"),
        "sales",
        "sale_date",
    )


def package_lines(packages: DataFrame) -> DataFrame:
    """Flatten packages to sale lines ``store_id, sale_date, time, hour, barcode, amount``."""
    b = packages.select(
        F.col("id_store").alias("store_id"),
        F.try_to_date(F.col("date"), "dd-MM-yyyy").alias("sale_date"),
        F.explode("sales").alias("blk"),
    )
    p = b.select("store_id", "sale_date", F.col("blk.time").alias("time"), F.explode("blk.products").alias("p"))
    return p.select(
        "store_id", "sale_date", "time",
        F.try_element_at(F.split("time", ":"), F.lit(1)).try_cast("int").alias("hour"),
        F.col("p.barcode").alias("barcode"),
        F.col("p.amount").alias("amount"),
    )


BLOCK_TIME = r"^([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?$"


def package_problem() -> Column:
    """Why a package can't be stored, or NULL: ``bad_date`` (not dd-MM-yyyy),
    ``bad_time`` (a block without a time of day) or ``bad_product`` (a line
    without barcode or amount).  The whole package is refused; others go on."""
    date = F.try_to_date(F.col("date"), "dd-MM-yyyy").isNull() | ~F.col("date").rlike(r"^\d{2}-\d{2}-\d{4}$")
    blocks = F.coalesce(F.col("sales"), F.array())
    time = F.exists(blocks, lambda b: F.coalesce(~b["time"].rlike(BLOCK_TIME), F.lit(True)))
    lines = F.flatten(F.transform(blocks, lambda b: F.coalesce(b["products"], F.array())))
    product = F.exists(lines, lambda p: p["barcode"].isNull() | (F.trim(p["barcode"]) == "") | p["amount"].isNull())
    return F.when(F.coalesce(date, F.lit(True)), "bad_date").when(F.coalesce(time, F.lit(False)), "bad_time").when(F.coalesce(product, F.lit(False)), "bad_product")


def package_receipts(packages: DataFrame) -> DataFrame:
    """Number of time blocks received per package."""
    return packages.select("id_store", "date", F.size("sales").alias("blocks"))


def split_by_store(packages: DataFrame, stores: DataFrame, key: str = "id_store") -> tuple[DataFrame, DataFrame]:
    """Packages of known stores (semi join) and the rejects (anti join)."""
    s = stores.select(F.col("store_id").alias(key))
    return packages.join(s, key, "left_semi"), packages.join(s, key, "left_anti")


def explode_hourly(payload: DataFrame) -> DataFrame:
    """Hourly archive arrays -> one row per hour (array position = hour)."""
    z = payload.select("store_id", "date", F.posexplode(F.arrays_zip("temperature_2m", "weather_code")).alias("hour", "w"))
    return z.select(
        "store_id", "date", "hour",
        F.col("w.temperature_2m").alias("temperature"),
        F.col("w.weather_code").alias("weather_resume_wmo_code"),
    )


def attach_weather(lines: DataFrame, payload: DataFrame) -> DataFrame:
    """Sale lines + the weather of their store, date and hour, read from
    the hourly archive payload (``store_id, date, temperature_2m[24],
    weather_code[24]``, array position = hour).  The payload is joined on
    (store, date) and indexed by the line's hour, so the weather side is not
    exploded 24 times before the shuffle.  Missing payload or hour -> NULL (the
    reference failed the whole package instead)."""
    h = payload.select("store_id", F.col("date").alias("sale_date"), F.col("temperature_2m").alias("_t"), F.col("weather_code").alias("_w"))
    j = lines.join(h, ["store_id", "sale_date"], "left")
    ok = F.col("hour").between(0, 23)
    idx = F.col("hour") + F.lit(1)
    return j.withColumn("temperature", F.when(ok, F.try_element_at("_t", idx)).cast("double")).withColumn(
        "weather_resume_wmo_code", F.when(ok, F.try_element_at("_w", idx)).cast("int")
    ).drop("_t", "_w")


def complete_products(codes: DataFrame, products: DataFrame, catalog: DataFrame) -> DataFrame:
    """Barcodes seen in ``codes`` but missing from ``products`` get a row
    from the catalogue (per-field defaults) or the unknown-product row; existing
    products are untouched.  Returns only the new rows."""
    missing = codes.select("barcode").distinct().join(products.select("barcode"), "barcode", "left_anti")
    # A barcode that the catalogue has twice gives one product, its first row in order.
    first = F.min(F.struct("name", "category", "image_url")).alias("_c")
    c = catalog.groupBy("barcode").agg(first).select("barcode", "_c.name", "_c.category", "_c.image_url", F.lit(True).alias("_found"))
    j = missing.join(c, "barcode", "left")
    found = F.col("_found").isNotNull()
    return j.select(
        "barcode",
        F.when(found, F.coalesce("name", F.lit(NAME_UNAVAILABLE))).otherwise(F.lit(UNKNOWN_NAME)).alias("product_name"),
        F.when(found, F.coalesce("category", F.lit(UNKNOWN_CATEGORY))).otherwise(F.lit(UNKNOWN_CATEGORY)).alias("category"),
        F.when(found, F.coalesce("image_url", F.lit(NO_IMAGE))).otherwise(F.lit(NO_IMAGE)).alias("image_url"),
    )


REGISTRATION_FIELDS = ["name", "email", "city", "lat", "lng"]


def register_stores(requests: DataFrame, stores: DataFrame, *, order: str = "request_id", start: int | None = None) -> DataFrame:
    """Requests in ``order``.  A request missing a required field is
    ``invalid`` (the gateway rejects it before any lookup); an e-mail already
    registered (exact, case-sensitive) or used by an earlier valid request of
    the batch -> ``email_repeated``; otherwise ``exito`` with the next store id, or ids
    from ``start`` on (``sources.ledger`` reserves ranges for batches that run at once)."""
    valid = F.lit(True)
    for c in REGISTRATION_FIELDS:
        if c in requests.columns:
            valid = valid & F.col(c).isNotNull()
    known = stores.select("email").filter(F.col("email").isNotNull()).distinct()
    r = requests.withColumn("_valid", valid).join(known.withColumn("_known", F.lit(True)), "email", "left")
    first = r.filter(F.col("_valid")).groupBy("email").agg(F.min(order).alias("_first"))
    r = r.join(first, "email", "left")
    ok = F.col("_valid") & F.col("_known").isNull() & (F.col(order) == F.col("_first"))
    accepted = r.filter(ok)
    # Scalar subquery: evaluated once by Spark, no driver round trip, no join.
    start = stores.select(F.coalesce(F.max("store_id"), F.lit(0)) + F.lit(1)).scalar() if start is None else start
    numbered = with_sequential_id(accepted.select(order), [order], name="store_id", start=start)
    out = r.join(numbered, order, "left")
    status = F.when(~F.col("_valid"), F.lit("invalid")).when(ok, F.lit("exito")).otherwise(F.lit("email_repeated"))
    return out.select(order, "name", "email", status.alias("status"), F.col("store_id").cast("long").alias("store_id"))


def pending_packages(queue: DataFrame) -> DataFrame:
    """What stays in each client's queue after one send pass.

    ``queue``: ``client_id, seq, package_name, outcome`` where ``outcome`` is
    what sending that package returns: ``ok``, ``rejected`` (the server answered
    with an error) or ``network_error``.  Blank lines are dropped; a rejected
    package stays queued and the pass continues; at the first network error the
    pass stops, so that package and every later one stay queued."""
    q = queue.filter(F.length(F.trim(F.col("package_name"))) > 0)
    first_fail = q.filter(F.col("outcome") == "network_error").groupBy("client_id").agg(F.min("seq").alias("_fail"))
    j = q.join(first_fail, "client_id", "left")
    keep = (F.col("outcome") == "rejected") | (F.col("_fail").isNotNull() & (F.col("seq") >= F.col("_fail")))
    return j.filter(keep).select("client_id", "seq", F.trim("package_name").alias("package_name"))


def retain(df: DataFrame, *, as_of, date_col: str, days: int = RETENTION_DAYS) -> DataFrame:
    """Keep rows that are at most ``days`` old: by elapsed time (30 days and an
    hour are too old), or by whole days where both ``as_of`` and the column are dates."""
    timed = isinstance(as_of, dt.datetime) or (isinstance(as_of, str) and len(as_of) > 10)
    kind = df.schema[date_col].dataType
    if isinstance(kind, T.DateType) and not timed:
        return df.filter(F.datediff(F.lit(as_date(as_of)), F.col(date_col)) <= days)
    wall = "timestamp" if isinstance(kind, T.TimestampType) else "timestamp_ntz"
    now = F.lit(str(as_of)).cast(wall)
    return df.filter(F.timestamp_diff("MICROSECOND", F.col(date_col).cast(wall), now) <= days * 86_400_000_000)
