"""Stand-in inputs derived from the driver's test tables.

The reference reads its own operational tables (stores, products, sales,
predictions, scan buffer, ...).  The test bed only has TPC-H-like tables, so
these builders *re-shape* them into rows of the schemas our operators expect.
They do none of the operators' work: every query in ``__spark_entry__`` runs
the library operator on these rows.  The same derivations exist as DuckDB SQL
in ``sqlcheck/views.py`` so the oracle sees identical inputs.

Store keys come from ``supplier`` and sales lines from ``lineitem``, so the
number of stores, sales and prediction rows grows with the scale factor.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailspark.sources.readers import cut_lineage

# Fixed evaluation date used by every registered query (sales run 1995..2001).
AS_OF = _dt.date(2001, 7, 1)
# Gap that separates key-event sessions in the ``events`` stand-in.
EVENT_GAP_SECONDS = 3600
# Evaluation date for stand-ins built from ``events`` (January 2024).
EVENTS_AS_OF = _dt.date(2024, 2, 15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``store_id, barcode, sale_date, time, amount, temperature, weather_resume_wmo_code``."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    ok = F.col("l_orderkey")
    wmo = (
        F.when(ok % 12 == 0, 0).when(ok % 12 == 1, 1).when(ok % 12 == 2, 2).when(ok % 12 == 3, 3)
        .when(ok % 12 == 4, 45).when(ok % 12 == 5, 51).when(ok % 12 == 6, 63).when(ok % 12 == 7, 67)
        .when(ok % 12 == 8, 80).when(ok % 12 == 9, 95).when(ok % 12 == 10, 99)
    )
    return li.join(part, li.l_partkey == part.p_partkey).select(
        (F.col("l_suppkey") + 1).cast("int").alias("store_id"),
        F.col("p_brand").alias("barcode"),
        F.col("l_shipdate").cast("date").alias("sale_date"),
        F.format_string(
            "%02d:%02d:%02d",
            (F.lit(7) + ok % 15).cast("int"),
            ((F.col("l_linenumber") * 7) % 60).cast("int"),
            ((ok * 13) % 60).cast("int"),
        ).alias("time"),
        F.col("l_quantity").cast("int").alias("amount"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double"))
        .otherwise((F.col("l_partkey") % 60).cast("double") / F.lit(2.0))
        .alias("temperature"),
        wmo.cast("int").alias("weather_resume_wmo_code"),
    )


def _city(k: Column) -> Column:
    # The five cities that have a seasonal temperature profile.
    return (
        F.when(k % 5 == 0, F.lit("Guadalajara")).when(k % 5 == 1, F.lit("Ciudad de México")).when(k % 5 == 2, F.lit("Monterrey"))
        .when(k % 5 == 3, F.lit("Puebla")).otherwise(F.lit("Cancún"))
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One store per supplier; some blank, missing or malformed e-mails."""
    s = table(spark, sf_dir, "supplier")
    sid = (F.col("s_suppkey") + 1).cast("int")
    k = F.col("s_suppkey") % 10
    email = (
        F.when(k == 3, F.lit("   "))
        .when(k == 4, F.lit(None).cast("string"))
        .when(k == 7, F.concat(F.lit("store"), _s(sid), F.lit(".example.com")))
        .otherwise(F.concat(F.lit(" store"), _s(sid), F.lit("@example.com ")))
    )
    return s.select(
        sid.alias("store_id"),
        F.col("s_name").alias("owner_name"),
        email.alias("email"),
        _city(F.col("s_nationkey")).alias("city"),
        (F.lit(15.0) + F.col("s_nationkey").cast("double") / F.lit(2.0)).alias("latitude"),
        (F.lit(-105.0) + F.col("s_nationkey").cast("double") / F.lit(4.0)).alias("longitude"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product per part brand; accented names, some NULL names / categories."""
    b = table(spark, sf_dir, "part").select(F.col("p_brand").alias("barcode")).distinct()
    b = b.withColumn("brand_no", F.substring("barcode", 7, 10).cast("int"))
    n = F.col("brand_no")
    name = (
        F.when(n % 4 == 0, F.concat(F.lit("Café "), _s(n)))
        .when(n % 4 == 1, F.concat(F.lit("Jabón "), _s(n)))
        .when(n % 4 == 2, F.concat(F.lit("Ñandú "), _s(n)))
    )
    cat = (
        F.when(n % 6 == 0, F.lit("Beverages")).when(n % 6 == 1, F.lit("Snacks")).when(n % 6 == 2, F.lit("Dairy"))
        .when(n % 6 == 3, F.lit("Cleaning")).when(n % 6 == 4, F.lit("Sweets"))
    )
    return b.select(
        "barcode",
        name.alias("product_name"),
        cat.alias("category"),
        F.concat(F.lit("https://img.example.com/"), _s(n), F.lit(".jpg")).alias("image_url"),
        "brand_no",
    )


def forecast_payloads(spark: SparkSession, sf_dir: str, as_of: _dt.date = AS_OF, days: int = 7) -> DataFrame:
    """Daily forecast payloads (parallel arrays) per store; stores with id % 7 == 0 get none."""
    st = stores(spark, sf_dir).select("store_id").filter(F.col("store_id") % 7 != 0)
    idx = F.sequence(F.lit(0), F.lit(days - 1))
    sid = F.col("store_id")
    return st.select(
        "store_id",
        F.lit(as_of).alias("start_date"),
        F.transform(idx, lambda i: F.lit(24.0) + (sid % 5).cast("double") + i.cast("double") / F.lit(2.0)).alias("temperature_2m_max"),
        F.transform(idx, lambda i: F.lit(12.0) + (sid % 3).cast("double") + i.cast("double") / F.lit(4.0)).alias("temperature_2m_min"),
        F.transform(
            idx,
            lambda i: F.when((sid + i) % 4 == 0, 0).when((sid + i) % 4 == 1, 2).when((sid + i) % 4 == 2, 61).otherwise(95),
        ).alias("weather_code"),
    )


def predictions(spark: SparkSession, sf_dir: str, as_of: _dt.date = AS_OF) -> DataFrame:
    """Stored prediction rows as the forecasting job would leave them.

    One row per (store, barcode) pair with sales up to ``as_of`` and per day
    ``as_of-1 .. as_of+8``; the prediction is 0.60..1.39 x the pair's average
    daily total, compared with the pair's average over the last 365 days (0 when
    absent, which yields the +Infinity rule).  A few deviations are NULL.
    """
    s = sales(spark, sf_dir).filter(F.col("sale_date") <= F.lit(as_of))
    daily = s.groupBy("store_id", "barcode", "sale_date").agg(F.sum("amount").alias("daily_total"))
    all_avg = daily.groupBy("store_id", "barcode").agg(F.avg(F.col("daily_total").cast("double")).alias("v_all"))
    recent = (
        daily.filter(F.col("sale_date") > F.date_sub(F.lit(as_of), 365))
        .groupBy("store_id", "barcode")
        .agg(F.avg(F.col("daily_total").cast("double")).alias("v_p"))
    )
    prods = cut_lineage(products(spark, sf_dir))
    g = (
        all_avg.join(recent, ["store_id", "barcode"], "left")
        .join(prods, "barcode")
        .withColumn("day_no", F.explode(F.sequence(F.lit(-1), F.lit(8))))
        .withColumn("objective_date", F.date_add(F.lit(as_of), F.col("day_no")))
        .withColumn("v_p", F.coalesce("v_p", F.lit(0.0)))
    )
    ratio = (F.lit(60) + (F.col("store_id") * 7 + F.col("brand_no") * 3 + (F.col("day_no") + 1) * 5) % 80).cast("double") / F.lit(100.0)
    g = g.withColumn("prediction", F.floor(F.col("v_all") * ratio).cast("int"))
    p = F.col("prediction").cast("double")
    v = F.col("v_p")
    dev = F.when(v > 0, (p - v) / F.when(v > 0, v) * F.lit(100.0)).when(p > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))
    typ = F.when(dev <= -15.0, "deficit").when(dev >= 15.0, "superavit").otherwise("none")
    g = g.withColumn("dev", dev).withColumn("type", typ)
    return g.select(
        "store_id", "barcode", "product_name", "category", "image_url", "objective_date", "prediction",
        (F.col("type") != "none").alias("feature"),
        "type",
        F.when((F.col("store_id") + F.col("brand_no") + F.col("day_no")) % 29 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("dev")).alias("percentage_average_deviation"),
    )


def scans_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan buffer rows: ``id, store_id, barcode (untrimmed, some blank), time, amount``."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    code = F.concat(F.lit("Brand#"), _s(eid % 25 + 1))
    raw = F.when(eid % 10 == 0, F.lit("   ")).when(eid % 10 == 1, F.concat(F.lit("  "), code, F.lit(" "))).otherwise(code)
    return e.select(
        eid.alias("id"),
        (F.col("user_id") + 1).cast("int").alias("store_id"),
        raw.alias("barcode"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"),
        F.lit(1).alias("amount"),
    )


def key_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key presses per device: ``device, ts, key`` (one char, ``ENTER`` or NULL)."""
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    key = F.when(t == "signup", F.lit("ENTER")).when(t == "error", F.lit(None).cast("string")).otherwise(F.upper(F.substring(t, 1, 1)))
    return e.select(F.col("user_id").alias("device"), F.col("event_id").alias("seq"), "ts", key.alias("key"))


def stray_key_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key presses of devices whose clock jumps 75 years ahead and back, and which
    leave out some times: ``device, seq, ts, key, arrived``."""
    k = key_events(spark, sf_dir).filter(F.col("device") % 5 == 0)
    ahead = F.when(F.col("seq") % 5 == 0, F.col("ts") + F.expr("INTERVAL 75 YEARS")).otherwise(F.col("ts"))
    ts = F.when(F.col("seq") % 7 != 0, ahead)
    return k.select((-F.col("device") - 1).alias("device"), "seq", ts.alias("ts"), "key", F.col("ts").alias("arrived"))


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration requests: ``request_id, name, email, city, lat, lng``."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name"))
    name = F.when(k % 13 == 0, F.lit("Al")).otherwise(name)
    email = (
        F.when(k % 7 == 0, F.lit("a@b"))
        .when(k % 11 == 0, F.concat(F.lit(" store"), _s(k % 50 + 1), F.lit("@example.com ")))
        .otherwise(F.concat(F.lower(F.col("c_mktsegment")), F.lit("@example.com")))
    )
    return c.select(
        k.alias("request_id"),
        name.alias("name"),
        email.alias("email"),
        F.concat(F.lit("CITY_"), _s(F.col("c_nationkey"))).alias("city"),
        F.col("c_acctbal").alias("lat"),
        F.col("c_acctbal").alias("lng"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External product catalogue: the dropped products with an odd brand number."""
    p = products(spark, sf_dir).filter((F.col("brand_no") % 5 == 0) & (F.col("brand_no") % 2 == 1))
    return p.select("barcode", F.col("product_name").alias("name"), "category", "image_url")


def known_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product dimension with the brand_no % 5 == 0 rows missing (for C3)."""
    return products(spark, sf_dir).filter(F.col("brand_no") % 5 != 0).drop("brand_no")


def registry_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model registry before the run: total_examples = 3 x brand number (1..9 are cold)."""
    p = products(spark, sf_dir)
    return p.select("barcode", (F.col("brand_no") * 3).cast("long").alias("total_examples"))


def registry_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry that lacks the newest products and still has, for every third
    product, a predecessor that isn't sold any more."""
    p = products(spark, sf_dir)
    known = registry_state(spark, sf_dir).join(p.where("brand_no > 3").select("barcode"), "barcode", "left_semi")
    old = p.where("brand_no % 3 = 0").select(F.concat(F.col("barcode"), F.lit("-old")).alias("barcode"), F.col("brand_no").cast("long").alias("total_examples"))
    return known.unionByName(old)


def hourly_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly archive payloads per (store, date) that has sales; every 9th is missing."""
    keys = sales(spark, sf_dir).select("store_id", "sale_date").distinct()
    keys = keys.filter((F.col("store_id") + F.dayofmonth("sale_date")) % 9 != 0)
    hours = F.sequence(F.lit(0), F.lit(23))
    sid = F.col("store_id")
    return keys.select(
        "store_id",
        F.col("sale_date").alias("date"),
        F.transform(hours, lambda h: F.lit(10.0) + h.cast("double") / F.lit(2.0) + sid.cast("double")).alias("temperature_2m"),
        F.transform(
            hours,
            lambda h: F.when((sid + h) % 4 == 0, 0).when((sid + h) % 4 == 1, 2).when((sid + h) % 4 == 2, 61).otherwise(95),
        ).alias("weather_code"),
    )


def package_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending-queue lines per client ``client_id, seq, package_name`` (some blank)
    with the ``outcome`` a send attempt would have (ok / rejected / network_error)."""
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 17 == 0, F.lit("  ")).otherwise(
        F.concat(_s(F.col("user_id") + 1), F.lit("_"), F.date_format("ts", "dd-MM-yyyy_HH-mm-ss"), F.lit(".json"))
    )
    return e.select(
        (F.col("user_id") + 1).cast("int").alias("client_id"),
        F.col("event_id").alias("seq"),
        name.alias("package_name"),
        F.when(F.col("event_type") == "error", F.lit("network_error"))
        .when(F.col("value") >= F.lit(45.0), F.lit("rejected"))
        .otherwise(F.lit("ok")).alias("outcome"),
    )
