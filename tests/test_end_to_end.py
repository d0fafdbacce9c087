"""Scans -> packages -> batch ingest -> sales on disk -> daily forecast ->
predictions on disk -> weekly report, all through the library."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from retailspark.config import Config
from retailspark.operators import ingest as IN
from retailspark.plans.forecast import daily_forecast
from retailspark.plans.ingest import ingest_packages
from retailspark.plans.weekly_report import weekly_report
from retailspark.sources import fixtures as FX
from retailspark.sources.readers import append_sales, read_sales
from retailspark.sources.snapshots import read_snapshot, replace_keyed_on_disk

SF = "/root/testdata/sf0.001"
AS_OF = dt.date(2024, 1, 31)
PRED_SCHEMA = ("store_id int, barcode string, product_name string, category string, image_url string, objective_date date, "
               "prediction int, feature boolean, type string, percentage_average_deviation double")


def test_scans_to_weekly_report(spark):
    d = tempfile.mkdtemp(prefix="rs-e2e-", dir="/tmp")
    stores, products = FX.stores(spark, SF), FX.products(spark, SF)
    packages = IN.sales_packages(IN.half_hour_sales(IN.clean_scans(FX.scans_raw(spark, SF))))
    weather = FX.hourly_weather(spark, SF)  # no weather for these dates: the left join keeps the lines
    res = ingest_packages(packages=packages, stores=stores, products=products.drop("brand_no"), catalog=FX.catalog(spark, SF),
                          hourly_weather=weather)
    sales_path = os.path.join(d, "sales")
    append_sales(res["sales"], sales_path, batch_id="2024-01")
    append_sales(res["sales"], sales_path, batch_id="2024-01")  # retried load: no duplicates
    sales = read_sales(spark, sales_path)
    assert sales.count() == res["sales"].count() > 0

    empty_registry = spark.createDataFrame([], "barcode string, total_examples long")
    empty_predictions = spark.createDataFrame([], PRED_SCHEMA)
    # one month of scans at the smallest scale: lower the cold-start minimum so products get scored
    cfg = Config(min_examples_cold_start=5)
    run = daily_forecast(sales=sales, stores=stores, products=products, registry=empty_registry, cfg=cfg,
                         forecast_payloads=FX.forecast_payloads(spark, SF, as_of=AS_OF), old_predictions=empty_predictions, as_of=AS_OF)
    pred_path = os.path.join(d, "predictions")
    replace_keyed_on_disk(spark, pred_path, run["new_predictions"])
    stored = read_snapshot(spark, pred_path)
    n_pairs = sales.select("store_id", "barcode").distinct().count()
    # scored pairs get 7 days each, never a negative prediction
    assert stored.count() % 7 == 0 and 0 < stored.count() <= 7 * n_pairs
    assert stored.filter(F.col("prediction") < 0).count() == 0

    report = weekly_report(stores=stores, predictions=stored, as_of=AS_OF, generated_at="31/01/2024 06:00")
    docs = report["documents"].collect()
    summary = report["summary"].first()
    assert len(docs) == summary.succeeded > 0
    assert all(doc.unique_products == len(doc.summary_rows) for doc in docs)
