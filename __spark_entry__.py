"""

``entry(spark)`` runs the flagship query on sf0.001; ``queries()`` maps every
DataFrame``; ``oracle_sql()`` gives the DuckDB twin of each one that is
SQL-expressible.  Inputs are the stand-ins of ``retailspark.sources.fixtures``
(Spark) and ``sqlcheck.views`` (DuckDB), derived from the driver's tables.
Doubles are rounded to 6 places and +Infinity is reported as a flag on both
sides so that value hashes are engine-independent.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from retailspark.config import Config  # noqa: E402
from retailspark.functions import calendar as CAL  # noqa: E402
from retailspark.functions import numbers as NUM  # noqa: E402
from retailspark.functions import text as TXT  # noqa: E402
from retailspark.functions.weather import weather_code  # noqa: E402
from retailspark.operators import alerts as AL  # noqa: E402
from retailspark.operators import daily as D  # noqa: E402
from retailspark.operators import dashboard as DB  # noqa: E402
from retailspark.operators import demand as DM  # noqa: E402
from retailspark.operators import features as FE  # noqa: E402
from retailspark.operators import search as SX  # noqa: E402
from retailspark.operators import sessions as SS  # noqa: E402
from retailspark.operators import ingest as IN  # noqa: E402
from retailspark.operators import models as MD  # noqa: E402
from retailspark.operators import scoring as SC  # noqa: E402
from retailspark.operators import reports as RP  # noqa: E402
from retailspark.session import ensure_checkpoint_dir  # noqa: E402
from retailspark.sources import fixtures as FX  # noqa: E402
from retailspark.sources.ledger import register_batch  # noqa: E402
from retailspark.sources.readers import CORRUPT, cut_lineage, package_id, read_packages, write_packages  # noqa: E402
from retailspark.sources.snapshots import read_snapshot, replace_keyed_on_disk  # noqa: E402
from retailspark.streaming import ingest as SI  # noqa: E402
from retailspark.streaming import queue as QU  # noqa: E402
from retailspark.streaming import scans as SS2  # noqa: E402
from retailspark.streaming import sessions as SE  # noqa: E402

AS_OF = FX.AS_OF


def r6(c: F.Column) -> F.Column:
    """Round to 6 decimals with plain IEEE arithmetic, floor(x * 1e6 + 0.5) / 1e6,
    which DuckDB evaluates bit for bit the same way (library ``round`` functions
    break decimal ties differently)."""
    return F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def _r6(c: str) -> F.Column:
    return r6(F.col(c)).alias(c)


def _dev(c: str = "percentage_average_deviation") -> list[F.Column]:
    """Deviation as a finite rounded double (NULL when infinite) plus an ``is_atypical`` flag."""
    d = F.col(c)
    inf = F.abs(d) == F.lit(float("inf"))
    return [F.when(inf, F.lit(None).cast("double")).otherwise(r6(d)).alias(c), F.coalesce(inf, F.lit(False)).alias("is_atypical")]


def _upcoming(spark: SparkSession, sf: str) -> DataFrame:
    return RP.upcoming_predictions(FX.predictions(spark, sf), as_of=AS_OF)


ROWCOLS = ["store_id", "barcode", "product_name", "category", "objective_date", "prediction", "feature", "type"]


# --------------------------------------------------------------------------- daily family
def q_daily_sales(spark: SparkSession, sf: str) -> DataFrame:
    d = D.daily_sales(FX.sales(spark, sf))
    return d.select("store_id", "barcode", "sale_date", "amount", _r6("temperature"), "weather_code")


def q_historical_average(spark: SparkSession, sf: str) -> DataFrame:
    h = D.historical_average(FX.sales(spark, sf), as_of=AS_OF)
    return h.select("store_id", "barcode", _r6("v_p"), "n_days")


def q_rolling_average(spark: SparkSession, sf: str) -> DataFrame:
    """D3 as rolling state: the totals of nine days before ``as_of``, moved on three times."""
    import datetime as dt

    sales, days = FX.sales(spark, sf), [AS_OF - dt.timedelta(days=n) for n in (9, 5, 1, 0)]
    totals = D.history_totals(sales, as_of=days[0])
    for since, as_of in zip(days, days[1:]):
        totals = D.advance_history(totals, sales, since=since, as_of=as_of)
    return D.average_of(totals).select("store_id", "barcode", _r6("v_p"), "n_days")


# --------------------------------------------------------------------------- scalar functions
def q_weather_code(spark: SparkSession, sf: str) -> DataFrame:
    s = FX.sales(spark, sf)
    return s.groupBy(F.col("weather_resume_wmo_code").alias("wmo"), weather_code(F.col("weather_resume_wmo_code")).alias("weather_code")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def q_cyclic_features(spark: SparkSession, sf: str) -> DataFrame:
    d = FX.sales(spark, sf).select("sale_date").distinct()
    c = F.col("sale_date")
    return d.select(
        "sale_date",
        r6(CAL.cyclic_sin(F.weekday(c), 7)).alias("sin_weekday"),
        r6(CAL.cyclic_cos(F.weekday(c), 7)).alias("cos_weekday"),
        r6(CAL.cyclic_sin(F.dayofmonth(c), 31)).alias("sin_day"),
        r6(CAL.cyclic_cos(F.dayofmonth(c), 31)).alias("cos_day"),
        r6(CAL.cyclic_sin(F.month(c), 12)).alias("sin_month"),
        r6(CAL.cyclic_cos(F.month(c), 12)).alias("cos_month"),
        CAL.is_payday(c).alias("payday"),
        CAL.iso_weekday(c).alias("iso_weekday"),
    )


def q_clamp_round(spark: SparkSession, sf: str) -> DataFrame:
    li = FX.table(spark, sf, "lineitem")
    raw = F.col("l_quantity") / F.lit(2.0) - F.lit(5.0)
    return li.select("l_orderkey", "l_linenumber", raw.alias("raw"), NUM.clamp_round(raw).alias("prediction"))


def q_classify_alerts(spark: SparkSession, sf: str) -> DataFrame:
    p = FX.predictions(spark, sf).select("store_id", "barcode", "objective_date", "prediction")
    h = D.historical_average(FX.sales(spark, sf), as_of=AS_OF).select("store_id", "barcode", "v_p")
    c = AL.classify(p.join(h, ["store_id", "barcode"], "left"), cfg=Config())
    return c.select("store_id", "barcode", "objective_date", "prediction", "type", "feature", *_dev())


def q_alert_labels(spark: SparkSession, sf: str) -> DataFrame:
    p = RP.upcoming_predictions(FX.predictions(spark, sf), as_of=AS_OF)
    d = F.col("percentage_average_deviation")
    return p.select(
        "store_id", "barcode", "objective_date", "type",
        TXT.alert_label(F.col("type"), "report").alias("label_report"),
        TXT.alert_label(F.col("type"), "mail").alias("label_mail"),
        TXT.alert_label(F.col("type"), "ui").alias("label_ui"),
        NUM.sign_class(d).alias("sign_class"),
        F.when(F.abs(d) != F.lit(float("inf")), NUM.signed_percent(d)).alias("deviation_text"),
    )


def q_date_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = FX.sales(spark, sf).select("sale_date").distinct()
    c = F.col("sale_date")
    text_in = F.date_format(c, "dd-MM-yyyy")
    return d.select(
        "sale_date",
        CAL.parse_date(text_in, "dd-MM-yyyy").alias("parsed"),
        CAL.date_label(c, "dd/MM/yyyy").alias("label_slash"),
        CAL.date_label(c, "yyyy-MM-dd").alias("label_iso"),
        CAL.period_label(c, F.date_add(c, 7)).alias("period_label"),
        CAL.long_date_es(c).alias("long_date"),
    )


# --------------------------------------------------------------------------- features
def q_feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    daily = D.fill_temperature(D.daily_sales(FX.sales(spark, sf)))
    m = FE.feature_matrix(daily, training=True)
    return m.select("store_id", "barcode", "sale_date", *[_r6(c) for c in FE.FEATURE_NAMES], "y")


def q_daily_sales_filled(spark: SparkSession, sf: str) -> DataFrame:
    d = D.fill_temperature(D.daily_sales(FX.sales(spark, sf)))
    return d.select("store_id", "barcode", "sale_date", "amount", _r6("temperature"), "weather_code")


def q_sales_scan(spark: SparkSession, sf: str) -> DataFrame:
    return D.sales_scan(FX.sales(spark, sf))


def q_recent_sales(spark: SparkSession, sf: str) -> DataFrame:
    return D.recent_sales(FX.sales(spark, sf), as_of=AS_OF)


def q_examples_per_product(spark: SparkSession, sf: str) -> DataFrame:
    return D.examples_per_product(FX.sales(spark, sf))


def q_sold_products(spark: SparkSession, sf: str) -> DataFrame:
    return D.sold_products(FX.sales(spark, sf))


def q_sales_history(spark: SparkSession, sf: str) -> DataFrame:
    return D.sales_history(FX.sales(spark, sf)).drop("sale_date")


def q_store_list(spark: SparkSession, sf: str) -> DataFrame:
    return D.list_stores(FX.stores(spark, sf))


def q_product_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A4: attributes of the products that have sales (semi join)."""
    return D.product_attributes(FX.products(spark, sf), D.sold_products(FX.sales(spark, sf)))


# --------------------------------------------------------------------------- weekly report
def q_active_stores(spark: SparkSession, sf: str) -> DataFrame:
    return RP.active_stores(FX.stores(spark, sf))


def q_upcoming_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _upcoming(spark, sf).select(*ROWCOLS, *_dev())


def q_worst_case_rows(spark: SparkSession, sf: str) -> DataFrame:
    return RP.worst_case_rows(_upcoming(spark, sf)).select(*ROWCOLS, "summary_rank", *_dev())


def q_top_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return RP.top_alerts(_upcoming(spark, sf), k=10).select(*ROWCOLS, "alert_rank", *_dev())


def q_weekly_stats(spark: SparkSession, sf: str) -> DataFrame:
    return RP.weekly_stats(_upcoming(spark, sf))


def q_weekly_stats_all_stores(spark: SparkSession, sf: str) -> DataFrame:
    st = RP.weekly_stats(_upcoming(spark, sf))
    return RP.weekly_stats_all(FX.stores(spark, sf), st, as_of=AS_OF)


def q_category_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return RP.category_breakdown(RP.worst_cases(_upcoming(spark, sf)))


def q_category_proportions(spark: SparkSession, sf: str) -> DataFrame:
    return RP.category_proportions(RP.category_breakdown(RP.worst_cases(_upcoming(spark, sf))))


def _report_results(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in delivery results: stores with predictions were processed; the
    delivery succeeds when the address passes the registration e-mail pattern."""
    act = RP.active_stores(FX.stores(spark, sf))
    has = _upcoming(spark, sf).select("store_id").distinct()
    from retailspark.operators.ingest import EMAIL_PATTERN

    return act.join(has, "store_id", "left_semi").select("store_id", F.col("email").rlike(EMAIL_PATTERN).alias("ok"))


def q_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return RP.run_summary(RP.active_stores(FX.stores(spark, sf)), _report_results(spark, sf))


def _weekly(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    from retailspark.plans.weekly_report import weekly_report

    return weekly_report(stores=FX.stores(spark, sf), predictions=FX.predictions(spark, sf), as_of=AS_OF,
                         generated_at="01/07/2001 06:00")


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return _weekly(spark, sf)["documents"]


def q_report_document(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf)


def q_report_document_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A13 flattened: every entry of each document's summary and alert arrays
    with its array position (checks assembly and ordering)."""
    doc = _documents(spark, sf)
    s = doc.select("store_id", F.lit("summary").alias("section"), F.posexplode("summary_rows").alias("pos", "r"))
    a = doc.select("store_id", F.lit("alerts").alias("section"), F.posexplode("featured_list").alias("pos", "r"))
    return s.unionByName(a).select(
        "store_id", "section", "pos", F.col("r.rank").alias("rank"), F.col("r.barcode").alias("barcode"),
        F.col("r.date").alias("date"), F.col("r.label").alias("label"), F.col("r.deviation_text").alias("deviation_text"),
    )


def q_report_document_categories(spark: SparkSession, sf: str) -> DataFrame:
    """A13 flattened: every entry of each document's category array, at its place."""
    c = _documents(spark, sf).select("store_id", F.posexplode("categories").alias("pos", "c"))
    return c.select("store_id", "pos", "c.*")


def q_report_digest(spark: SparkSession, sf: str) -> DataFrame:
    return _weekly(spark, sf)["digests"]


# --------------------------------------------------------------------------- ingest
def q_validate_registrations(spark: SparkSession, sf: str) -> DataFrame:
    return IN.validate_registrations(FX.registrations(spark, sf))


def q_register_stores(spark: SparkSession, sf: str) -> DataFrame:
    return IN.register_stores(FX.registrations(spark, sf), FX.stores(spark, sf))


def q_register_batches(spark: SparkSession, sf: str) -> DataFrame:
    """C8 in two batches that see the same snapshot of stores; the first is replayed."""
    ledger = f"{ensure_checkpoint_dir(spark)}/ids-{uuid.uuid4().hex}"
    requests, stores = FX.registrations(spark, sf), FX.stores(spark, sf)
    even, odd = requests.where("request_id % 2 = 0"), requests.where("request_id % 2 = 1")
    register_batch(even, stores, ledger=ledger, batch="even")
    second = register_batch(odd, stores, ledger=ledger, batch="odd")
    return register_batch(even, stores, ledger=ledger, batch="even").unionByName(second)


def _scans(spark: SparkSession, sf: str) -> DataFrame:
    return IN.clean_scans(FX.scans_raw(spark, sf))


def q_clean_scans(spark: SparkSession, sf: str) -> DataFrame:
    return _scans(spark, sf)


def q_half_hour_sales(spark: SparkSession, sf: str) -> DataFrame:
    return IN.half_hour_sales(_scans(spark, sf))


def q_scan_totals(spark: SparkSession, sf: str) -> DataFrame:
    return IN.scan_totals(_scans(spark, sf), FX.stores(spark, sf))


def _packages(spark: SparkSession, sf: str) -> DataFrame:
    return IN.sales_packages(IN.half_hour_sales(_scans(spark, sf)))


def q_sales_packages(spark: SparkSession, sf: str) -> DataFrame:
    return _packages(spark, sf).drop("sale_date")


def q_package_lines(spark: SparkSession, sf: str) -> DataFrame:
    """D8 flattened: each product entry of each package with its block and
    product positions (checks nesting and the time / barcode ordering)."""
    p = _packages(spark, sf)
    b = p.select("id_store", "date", "day", F.posexplode("sales").alias("block_pos", "blk"))
    return b.select(
        "id_store", "date", "day", "block_pos", F.col("blk.time").alias("time"),
        F.posexplode("blk.products").alias("product_pos", "p"),
    ).select("id_store", "date", "day", "block_pos", "time", "product_pos", F.col("p.barcode").alias("barcode"), F.col("p.amount").alias("amount"))


def q_package_receipts(spark: SparkSession, sf: str) -> DataFrame:
    return IN.package_receipts(_packages(spark, sf))


def q_package_accept(spark: SparkSession, sf: str) -> DataFrame:
    ok, _ = IN.split_by_store(_packages(spark, sf), FX.stores(spark, sf))
    return ok.select("id_store", "date", "day", F.size("sales").alias("blocks"))


def q_package_reject(spark: SparkSession, sf: str) -> DataFrame:
    _, bad = IN.split_by_store(_packages(spark, sf), FX.stores(spark, sf))
    return bad.select("id_store", "date", "day", F.size("sales").alias("blocks"))


def q_retention_filter(spark: SparkSession, sf: str) -> DataFrame:
    return IN.retain(_packages(spark, sf), as_of=FX.EVENTS_AS_OF, date_col="sale_date").select("id_store", "date")


def q_retention_elapsed(spark: SparkSession, sf: str) -> DataFrame:
    """G4 by elapsed time: backups, written at the time of an event, that are at most 30 days old at noon."""
    import datetime as dt

    backups = FX.table(spark, sf, "events").select(F.col("event_id").alias("backup"), F.col("ts").alias("modified"))
    return IN.retain(backups, as_of=dt.datetime.combine(FX.EVENTS_AS_OF, dt.time(12)), date_col="modified")


def q_ingest_batch(spark: SparkSession, sf: str) -> DataFrame:
    """I1/I4 in batch: documents by outcome, and stored units, of a backfill in which
    every third store sends twice, every fifth store's packages were received before
    and some have an impossible date, time or line."""
    from retailspark.plans.ingest import ingest_packages

    p = _packages(spark, sf).drop("sale_date")
    k = F.col("id_store") + F.col("day")
    broken = p.withColumn("date", F.when(k % 11 == 0, "99-99-2024").otherwise(F.col("date")))
    bad_time = lambda b: F.struct(F.lit("xx:00").alias("time"), b["products"].alias("products"))
    broken = broken.withColumn("sales", F.when(k % 11 == 1, F.transform("sales", bad_time)).otherwise(F.col("sales")))
    out = ingest_packages(packages=broken.unionByName(broken.where("id_store % 3 = 0")), stores=FX.stores(spark, sf), products=FX.known_products(spark, sf),
                          catalog=FX.catalog(spark, sf), hourly_weather=FX.hourly_weather(spark, sf),
                          received=package_id(p).where("id_store % 5 = 0").select("package_id"))
    parts = [
        out["receipts"].groupBy(F.lit("received").alias("outcome")).agg(F.count(F.lit(1)).alias("n")),
        out["sales"].groupBy(F.lit("units").alias("outcome")).agg(F.sum("amount").alias("n")),
        out["duplicates"].groupBy(F.lit("duplicate").alias("outcome")).agg(F.sum("copies").alias("n")),
        out["rejected"].groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("n")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def q_sales_with_weather(spark: SparkSession, sf: str) -> DataFrame:
    s = FX.sales(spark, sf).withColumn("hour", F.substring("time", 1, 2).cast("int"))
    lines = s.select("store_id", "barcode", "sale_date", "time", "amount", "hour")
    j = IN.attach_weather(lines, FX.hourly_weather(spark, sf))
    return j.select("store_id", "barcode", "sale_date", "time", "amount", "temperature", "weather_resume_wmo_code")


def q_hourly_weather_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly archive payloads -> one row per (store, date, hour)."""
    return IN.explode_hourly(FX.hourly_weather(spark, sf))


def q_complete_products(spark: SparkSession, sf: str) -> DataFrame:
    return IN.complete_products(FX.sales(spark, sf), FX.known_products(spark, sf), FX.catalog(spark, sf))


def q_pending_packages(spark: SparkSession, sf: str) -> DataFrame:
    return IN.pending_packages(FX.package_queue(spark, sf))


# --------------------------------------------------------------------------- models and scoring
# Fixed coefficients used to check scoring independently of the fit:
# intercept 5.0; weights 0.1 .. 0.7 for the seven calendar features, then 0.08
# (temperature), 0.09 (weather code) and 0.01 (store id).
FIXED_COEF = [5.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.08, 0.09, 0.01]


def _training_rows(spark: SparkSession, sf: str) -> DataFrame:
    return MD.training_rows(FX.sales(spark, sf), FX.registry_state(spark, sf), as_of=AS_OF)


def q_training_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = _training_rows(spark, sf)
    return r.select("store_id", "barcode", "sale_date", *[_r6(c) for c in FE.FEATURE_NAMES], "y", "prev_examples", "is_cold")


def q_training_moments(spark: SparkSession, sf: str) -> DataFrame:
    m = MD.training_moments(_training_rows(spark, sf))
    e = m.select("barcode", "n", F.posexplode("moments").alias("k", "v"))
    mean = F.when((F.col("k") >= 1) & (F.col("k") <= MD.DIM), F.col("v")).otherwise(F.col("v") / F.col("n"))
    return e.select("barcode", "n", "k", r6(mean).alias("mean_value"))


def q_train_models(spark: SparkSession, sf: str) -> DataFrame:
    t = MD.train_models(FX.sales(spark, sf), FX.registry_state(spark, sf), as_of=AS_OF)
    return t.select("barcode", "mode", "n", "coef", "error", "mse", "last_date")


def q_model_optimality(spark: SparkSession, sf: str) -> DataFrame:
    """H2: whether each product's fitted model is the minimum of its objective: the
    gradient, recomputed from all raw training rows, vanishes."""
    rows = _training_rows(spark, sf)
    return _optimality(rows, MD.solve(MD.training_moments(rows)).select("barcode", "coef"))


def _optimality(rows: DataFrame, models: DataFrame) -> DataFrame:
    rest = F.col("y") - MD.predict("coef")
    sums = rows.join(cut_lineage(models), "barcode").groupBy("barcode", "coef").agg(
        F.count(F.lit(1)).alias("n"), F.avg(rest).alias("g0"), F.avg(F.abs("y")).alias("scale"),
        *[F.avg(rest * F.col(x)).alias(f"g{i + 1}") for i, x in enumerate(FE.FEATURE_NAMES)],
    )
    alpha = F.lit(Config().ridge_alpha)
    gradient = [F.abs(F.col("g0"))] + [F.abs(F.col(f"g{i + 1}") - alpha * F.get("coef", F.lit(i + 1))) for i in range(len(FE.FEATURE_NAMES))]
    return sums.select("barcode", "n", (F.greatest(*gradient) <= F.lit(1e-6) * (1 + F.col("scale"))).alias("is_optimal"))


def q_training_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Cold / incremental / skipped per sold product, with its row count."""
    sales = FX.sales(spark, sf)
    t = MD.train_models(sales, FX.registry_state(spark, sf), as_of=AS_OF)
    return MD.training_outcomes(D.sold_products(sales.filter(F.col("sale_date") <= F.lit(AS_OF))), t).drop("mse")


def _incremental(spark: SparkSession, sf: str) -> DataFrame:
    """State = a cold fit one week before ``as_of``; then the incremental step."""
    import datetime as dt

    sales = FX.sales(spark, sf)
    empty = spark.createDataFrame([], "barcode string, total_examples long")  # no models yet: every product cold
    week_before = AS_OF - dt.timedelta(days=7)
    first = MD.train_models(sales, empty, as_of=week_before)
    state = first.select("barcode", "n", "moments", "last_date", F.col("n").cast("long").alias("total_examples"))
    return MD.train_incremental(state, sales, as_of=AS_OF)


def q_train_incremental(spark: SparkSession, sf: str) -> DataFrame:
    return _incremental(spark, sf).select("barcode", "n", "new_examples", "total_examples", "last_date", "coef", "error", "mse")


def q_train_incremental_counts(spark: SparkSession, sf: str) -> DataFrame:
    """H3 bookkeeping: rows learned in total, added by this step, accumulated
    examples and the new high-water date."""
    return _incremental(spark, sf).select("barcode", "n", "new_examples", "total_examples", "last_date")


def q_train_incremental_optimality(spark: SparkSession, sf: str) -> DataFrame:
    """H3: whether the coefficients of the incremental step are the minimum over all the
    rows learned so far: those of the first fit and, of products that went on, the new days."""
    import datetime as dt

    sales, none = FX.sales(spark, sf), spark.createDataFrame([], "barcode string, total_examples long")
    week_before = F.lit(AS_OF - dt.timedelta(days=7))
    first = MD.training_rows(sales, none, as_of=AS_OF - dt.timedelta(days=7))
    warm = cut_lineage(first.groupBy("barcode").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= Config().min_examples_cold_start).select("barcode"))
    known = sales.where(F.col("sale_date") <= F.lit(AS_OF))
    read = known.where(F.col("sale_date") > week_before).join(warm, "barcode", "left_semi").unionByName(known.join(warm, "barcode", "left_anti"))
    rows = FE.feature_matrix(D.fill_temperature(D.daily_sales(read)), training=True)
    rows = first.join(warm, "barcode", "left_semi").select(*rows.columns).unionByName(rows)
    return _optimality(rows, _incremental(spark, sf).select("barcode", "coef"))


def _fixed_models(spark: SparkSession, sf: str) -> DataFrame:
    reg = FX.registry_state(spark, sf)
    return reg.select("barcode", "total_examples", F.array(*[F.lit(c) for c in FIXED_COEF]).alias("coef"))


def q_clipped_mse(spark: SparkSession, sf: str) -> DataFrame:
    rows = _training_rows(spark, sf)
    coef = F.array(*[F.lit(c) for c in FIXED_COEF])
    scored = rows.withColumn("coef", coef).withColumn("yhat", MD.predict("coef"))
    return MD.clipped_mse(scored).select("barcode", _r6("mse"), "n")


def q_model_registry_upsert(spark: SparkSession, sf: str) -> DataFrame:
    rows = _training_rows(spark, sf)
    coef = F.array(*[F.lit(c) for c in FIXED_COEF])
    scored = rows.withColumn("coef", coef).withColumn("yhat", MD.predict("coef"))
    trained = MD.clipped_mse(scored).select("barcode", "mse", F.col("n").alias("new_examples"), coef.alias("coef"))
    # Some trained products aren't registered yet, some registered ones weren't trained.
    up = MD.upsert_registry(FX.registry_before(spark, sf), trained, as_of=AS_OF)
    return up.select("barcode", r6(F.col("last_mse")).alias("last_mse"), "last_update", "total_examples", "type_model")


def _forecast(spark: SparkSession, sf: str) -> DataFrame:
    return SC.forecast_days(FX.forecast_payloads(spark, sf))


def q_forecast_days(spark: SparkSession, sf: str) -> DataFrame:
    return _forecast(spark, sf)


def _days(spark: SparkSession, sf: str) -> DataFrame:
    return SC.with_forecast_fallback(FX.stores(spark, sf), _forecast(spark, sf), as_of=AS_OF)


def q_forecast_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return _days(spark, sf)


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    sales = FX.sales(spark, sf)
    return SC.scoring_grid(SC.assortment(sales, as_of=AS_OF), _days(spark, sf), FX.products(spark, sf))


def q_scoring_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark, sf).select("store_id", "barcode", "objective_date", "temperature", "weather_code", "product_name", "category")


def _score_fixed(spark: SparkSession, sf: str) -> DataFrame:
    vp = D.historical_average(FX.sales(spark, sf), as_of=AS_OF)
    return SC.score(_grid(spark, sf), _fixed_models(spark, sf), vp)


def q_score_fixed(spark: SparkSession, sf: str) -> DataFrame:
    p = _score_fixed(spark, sf)
    return p.select(*ROWCOLS, *_dev())


def q_predictions_per_store(spark: SparkSession, sf: str) -> DataFrame:
    return SC.predictions_per_store(_score_fixed(spark, sf))


def q_prediction_replace(spark: SparkSession, sf: str) -> DataFrame:
    old = FX.predictions(spark, sf)
    out = SC.replace_keyed(old, cut_lineage(_score_fixed(spark, sf)))
    return out.select(*ROWCOLS, *_dev())


def q_prediction_replace_on_disk(spark: SparkSession, sf: str) -> DataFrame:
    """A11/G1 on disk: the stored predictions as one commit, the scored rows as the next."""
    path = f"{ensure_checkpoint_dir(spark)}/predictions-{uuid.uuid4().hex}"
    replace_keyed_on_disk(spark, path, FX.predictions(spark, sf))
    replace_keyed_on_disk(spark, path, _score_fixed(spark, sf))
    return read_snapshot(spark, path).select(*ROWCOLS, *_dev())


def _two_day_job(spark: SparkSession, sf: str) -> DataFrame:
    return q_score_predictions(spark, sf)


def q_score_predictions_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Which rows the two-day job leaves in the predictions table (keys and the
    denormalised product columns; the predicted values come from the solve)."""
    return _two_day_job(spark, sf).select("store_id", "barcode", "objective_date", "product_name", "category")


def q_score_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The daily job end to end, on two consecutive days: the first run
    (``as_of - 1``) rebuilds every product and stores its moments in the
    registry; the second (``as_of``) continues the warm products from those
    moments with the new day only, extends the assortment with the new day's
    pairs, updates the registry, scores each store's
    assortment x forecast days and writes back over the stored predictions."""
    import datetime as dt

    from retailspark.plans.forecast import daily_forecast

    common = dict(
        sales=FX.sales(spark, sf), stores=FX.stores(spark, sf), products=FX.products(spark, sf),
        forecast_payloads=FX.forecast_payloads(spark, sf),
    )
    day1 = daily_forecast(**common, registry=FX.registry_state(spark, sf), old_predictions=FX.predictions(spark, sf),
                          as_of=AS_OF - dt.timedelta(days=1))
    day2 = daily_forecast(**common, registry=day1["registry"], old_predictions=day1["predictions"], as_of=AS_OF,
                          assortment=day1["assortment"], assortment_as_of=AS_OF - dt.timedelta(days=1),
                          history=day1["history"], history_as_of=AS_OF - dt.timedelta(days=1))
    return day2["predictions"].select(*ROWCOLS, *_dev())


# --------------------------------------------------------------------------- dashboard, sessions, demand
def q_prediction_feed(spark: SparkSession, sf: str) -> DataFrame:
    f = DB.prediction_feed(FX.predictions(spark, sf), as_of=AS_OF)
    return f.select(*[c for c in f.columns if c != "percentage_average_deviation"], *_dev())


def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alert rows the client shows: feed rows (B9) of every store + avg_weekly_sales."""
    p = FX.predictions(spark, sf).filter(F.col("objective_date") > F.lit(AS_OF))
    vp = D.historical_average(FX.sales(spark, sf), as_of=AS_OF)
    return DB.alerts_with_weekly_average(p, vp)


def q_parse_alerts(spark: SparkSession, sf: str) -> DataFrame:
    a = _alerts(spark, sf)
    rec = F.struct(
        F.col("product_name").alias("name"),
        F.when(F.col("prediction") % 7 != 0, F.col("barcode")).alias("barcode"),
        "category", "image_url",
        F.when(F.col("prediction") % 10 == 0, F.lit("not-a-date"))
        .when(F.col("prediction") % 10 == 1, F.lit(None).cast("string"))
        .otherwise(F.date_format("objective_date", "yyyy-MM-dd")).alias("objective_date"),
        "prediction", "avg_weekly_sales", "type", "feature",
    )
    j = a.select("store_id", F.col("barcode").alias("src_barcode"), F.col("objective_date").alias("src_date"), F.to_json(rec).alias("json"))
    out = DB.parse_alerts(j, as_of=AS_OF)
    return out.select(*[c for c in out.columns if c != "avg_weekly_sales"], _r6("avg_weekly_sales"))


def q_parse_alerts_fields(spark: SparkSession, sf: str) -> DataFrame:
    """B13 field by field: records in which some fields have the wrong type and some
    aren't JSON at all."""
    a = _alerts(spark, sf).select("store_id", F.col("barcode").alias("src_barcode"), F.col("objective_date").alias("src_date"), "prediction", "feature", "type", F.coalesce("product_name", F.lit("-")).alias("n"))
    p = F.col("prediction")
    text = F.concat(
        F.lit('{"name": "'), F.col("n"), F.lit('", "prediction": '), F.when(p % 5 == 0, F.lit('"many"')).otherwise(p.cast("string")),
        F.lit(', "feature": '), F.when(p % 3 == 0, F.lit('{"is": true}')).otherwise(F.col("feature").cast("string")), F.lit(', "avg_weekly_sales": 2.5, "type": "'), F.col("type"), F.lit('"}'),
    )
    j = a.select("store_id", "src_barcode", "src_date", F.when(p % 11 == 0, F.lit("{not json")).otherwise(text).alias("json"))
    out = DB.parse_alerts_fields(j, as_of=AS_OF)
    return out.select("store_id", "src_barcode", "src_date", "product_name", "prediction", "feature", "type", "avg_weekly_sales", F.array_join("failed", ",").alias("failed"), "malformed")


def q_search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """B11/F3 by index: posting lists of three letters instead of a scan of names."""
    path = f"{ensure_checkpoint_dir(spark)}/name-index-{uuid.uuid4().hex}"
    alerts = _alerts(spark, sf)
    SX.write_index(alerts, path)
    r = DB.search_products(alerts, text="jabon", sort="az", index=SX.read_index(spark, path))
    return r.select("store_id", "barcode", "product_name", "objective_date", "type", "list_rank")


def q_search_products(spark: SparkSession, sf: str) -> DataFrame:
    r = DB.search_products(_alerts(spark, sf), text="jabon", sort="az")
    return r.select("store_id", "barcode", "product_name", "objective_date", "type", "list_rank")


def q_filter_alert_type(spark: SparkSession, sf: str) -> DataFrame:
    r = DB.search_products(_alerts(spark, sf), type="deficit", sort="za")
    return r.select("store_id", "barcode", "product_name", "objective_date", "type", "list_rank")


def q_top_deviations(spark: SparkSession, sf: str) -> DataFrame:
    return DB.top_deviations(_alerts(spark, sf))


def q_product_detail(spark: SparkSession, sf: str) -> DataFrame:
    d = DB.product_detail(FX.predictions(spark, sf), as_of=AS_OF)
    return d.select("store_id", "barcode", "product_name", "category", "image_url", "objective_date", "prediction", "feature", "type", *_dev())


def q_ordered_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return RP.ordered_alerts(_upcoming(spark, sf)).select(*ROWCOLS, "alert_position", *_dev())


def q_history_series(spark: SparkSession, sf: str) -> DataFrame:
    return DB.history_series(D.sales_history(FX.sales(spark, sf)))


def q_dashboard_stats(spark: SparkSession, sf: str) -> DataFrame:
    st = FX.stores(spark, sf)
    scans = IN.scan_totals(_scans(spark, sf))
    pend = IN.pending_packages(FX.package_queue(spark, sf))
    feed = DB.prediction_feed(FX.predictions(spark, sf), as_of=AS_OF)
    return DB.dashboard_stats(st, scans, pend, feed)


def q_weekly_series(spark: SparkSession, sf: str) -> DataFrame:
    return DB.weekly_series(FX.sales(spark, sf), FX.predictions(spark, sf), as_of=AS_OF)


def q_gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return SS.gap_sessions(FX.key_events(spark, sf), gap_seconds=FX.EVENT_GAP_SECONDS)


def q_expected_demand(spark: SparkSession, sf: str) -> DataFrame:
    s = FX.sales(spark, sf).join(FX.products(spark, sf).select("barcode", "category"), "barcode", "left")
    s = s.join(FX.stores(spark, sf).select("store_id", "city"), "store_id", "left")
    s = DM.seasonal_temperature(s, DM.city_profiles(spark))
    s = s.withColumn("temperature_used", F.coalesce("temperature", "expected_temperature"))
    d = DM.expected_demand(s, DM.category_factors(spark), temperature="temperature_used")
    return d.select("store_id", "barcode", "sale_date", "time", _r6("temperature_used"), _r6("expected_demand"))


def q_ingest_accounting(spark: SparkSession, sf: str) -> DataFrame:
    """Where each package of a batch ends, against receipts of earlier
    batches; every third store sends its packages twice, every fifth store's
    have been received before."""
    p = package_id(_packages(spark, sf)).withColumn(CORRUPT, F.lit(None).cast("string"))
    again = p.where("id_store % 3 = 0").withColumn("source", F.lit("b"))
    batch = p.withColumn("source", F.lit("a")).unionByName(again)
    found = SI.classify_packages(batch, FX.stores(spark, sf), p.where("id_store % 5 = 0").select("package_id"))
    return found.groupBy(F.coalesce("reason", F.lit("received")).alias("outcome")).agg(F.count(F.lit(1)).alias("documents"))


def q_package_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of all packages, written as JSON documents and read again."""
    path = f"{ensure_checkpoint_dir(spark)}/packages-{uuid.uuid4().hex}"
    write_packages(_packages(spark, sf), path, partitioned=False)
    return IN.package_lines(read_packages(spark, path)).select("store_id", "sale_date", "time", "hour", "barcode", "amount")


def q_half_hour_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming aggregation over the scan buffer read at once."""
    return SS2.half_hour_stream(FX.scans_raw(spark, sf))


def q_queue_passes(spark: SparkSession, sf: str) -> DataFrame:
    """G2/I3 as a stream: two passes over the clients' queues; what the first leaves is
    accepted by the second."""
    base = f"{ensure_checkpoint_dir(spark)}/queue-{uuid.uuid4().hex}"
    queue = FX.package_queue(spark, sf)
    outcome = queue.select("client_id", "seq", "outcome")

    def send(entries: DataFrame) -> DataFrame:
        judged = entries.join(outcome, ["client_id", "seq"])
        return judged.withColumn("outcome", F.when(F.col("tries") == 0, F.col("outcome")).otherwise(F.lit("ok")))

    QU.enqueue(queue, f"{base}/queue", "new")
    for _ in range(2):
        QU.queue_stream(spark, f"{base}/queue", send=send, out_dir=f"{base}/out", checkpoint=f"{base}/checkpoint").awaitTermination()
    return QU.sent_packages(spark, f"{base}/out").withColumn("package_name", F.trim("package_name"))


def q_retry_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected packages of stores that were unknown and of which every second has
    been registered since."""
    p = package_id(_packages(spark, sf)).withColumn(CORRUPT, F.lit(None).cast("string"))
    stores = FX.stores(spark, sf).select("store_id")
    rejects = SI.with_problem(p, stores).withColumnRenamed("_problem", "reason")
    added = rejects.where("id_store % 2 = 0").select(F.col("id_store").alias("store_id")).distinct()
    return SI.retry_rejected(rejects, stores.unionByName(added)).select("id_store", "date", "day", F.size("sales").alias("blocks"))


def q_half_hour_totals(spark: SparkSession, sf: str) -> DataFrame:
    """I2 as partial sums: the scans in six epochs, out of order, with snapshots after
    the second and the fourth, read as one snapshot and the epochs after it."""
    out = f"{ensure_checkpoint_dir(spark)}/half-hours-{uuid.uuid4().hex}"
    scans = FX.scans_raw(spark, sf)
    for epoch in range(6):
        if epoch and epoch % 2 == 0:
            SS2.compact_half_hours(spark, out, epoch)
        SS2.write_half_hours(scans.where(F.pmod(F.xxhash64("id"), F.lit(6)) == epoch), epoch, out)
    return SS2.read_half_hours(spark, out)


def q_scanner_codes(spark: SparkSession, sf: str) -> DataFrame:
    """The key events as a stream that is read to its end three times, from one
    checkpoint, as a third more has come each time, some hours out of order.  Devices whose clock jumps to 2099 and back and
    events without a time come among them."""
    base = f"{ensure_checkpoint_dir(spark)}/keys-{uuid.uuid4().hex}"
    keys = FX.key_events(spark, sf).withColumn("arrived", F.col("ts")).unionByName(FX.stray_key_events(spark, sf))
    at = F.unix_micros(F.col("arrived").cast("timestamp")) + F.pmod(F.xxhash64("seq"), F.lit(5)) * 3_600_000_000
    span = keys.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    third = F.lit(1) if span["a"] is None else F.least(F.floor((at - span["a"]) * 3 / (span["b"] - span["a"] + 1)), F.lit(2))
    for part in range(3):
        keys.where(third == part).drop("arrived").write.parquet(f"{base}/in/{part}")
        stream = spark.readStream.schema(keys.drop("arrived").schema).parquet(f"{base}/in/*")
        SE.scanner_sink(stream, out_dir=f"{base}/out", checkpoint=f"{base}/checkpoint", gap_seconds=FX.EVENT_GAP_SECONDS, delay_seconds=86_400.0, idle_seconds=86_400.0).awaitTermination()
    waiting = SE.waiting_codes(spark, f"{base}/checkpoint", gap_seconds=FX.EVENT_GAP_SECONDS)
    return SE.read_codes(spark, f"{base}/out").unionByName(waiting)


def q_forecast_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Maximum and minimum temperature of a forecast, position by position."""
    pairs = DB.zip_shortest(F.col("temperature_2m_max"), F.col("temperature_2m_min")).alias("z")
    each = FX.forecast_payloads(spark, sf).select("store_id", F.posexplode(pairs).alias("day_no", "z"))
    return each.select("store_id", "day_no", F.col("z").getField("0").alias("high"), F.col("z").getField("1").alias("low"))


def entry(spark: SparkSession) -> DataFrame:
    """Flagship on sf0.001: the daily forecasting job end to end (train every
    product from its moments, update the registry, score each store's
    assortment x forecast days, classify, write back over stored predictions)."""
    return q_score_predictions(spark, "/root/testdata/sf0.001")


def _corpus() -> tuple[dict, dict]:
    """Queries and oracle SQL of the training-data operators; empty when that
    subpackage (and the pipeline module that belongs to it) is not installed."""
    try:
        from retailspark.llm import queries as corpus
    except ModuleNotFoundError as e:
        if e.name not in ("retailspark.llm", "corpus_pipeline"):
            raise
        return {}, {}
    return corpus.queries(), corpus.oracle_sql()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k[2:]: v for k, v in globals().items() if k.startswith("q_") and callable(v)}
    return own | _corpus()[0]


def oracle_sql() -> dict[str, str]:
    from sqlcheck.queries import build

    return build() | _corpus()[1]
