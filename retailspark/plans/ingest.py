"""Batch package ingest (the twin of ``streaming.ingest``): every package ends in
``receipts``, ``rejected`` (with a reason) or ``duplicates``; the lines of those
received are enriched with weather; barcodes missing from the product table are
completed from the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailspark.operators.ingest import attach_weather, complete_products, package_lines
from retailspark.sources.readers import CORRUPT, package_id
from retailspark.streaming.ingest import with_problem


def ingest_packages(*, packages: DataFrame, stores: DataFrame, products: DataFrame, catalog: DataFrame,
                    hourly_weather: DataFrame, received: DataFrame | None = None) -> dict[str, DataFrame]:
    """``sales``, ``receipts``, ``rejected``, ``duplicates`` and ``new_products``.

    ``packages`` may have the text of malformed documents in ``_corrupt_record``
    (``readers.read_packages``); ``received`` (package_id) are packages stored before.
    Equal packages are one: they are aggregated, so one that was sent a million times
    fills no task.  ``duplicates`` has a row for each such content with the number of
    its surplus ``copies``."""
    if CORRUPT not in packages.columns:
        packages = packages.withColumn(CORRUPT, F.lit(None).cast("string"))
    judged = with_problem(package_id(packages), stores)
    body = [F.first(c).alias(c) for c in ("id_store", "date", "day", "sales")]
    valid = judged.where("_problem is null").groupBy("package_id").agg(*body, F.count(F.lit(1)).alias("n"))
    if received is not None:
        valid = valid.join(received.select("package_id").distinct().withColumn("_before", F.lit(True)), "package_id", "left")
    else:
        valid = valid.withColumn("_before", F.lit(None).cast("boolean"))
    ok = valid.where("_before is null")
    lines = package_lines(ok)
    sales = attach_weather(lines, hourly_weather).select(
        "store_id", "barcode", "sale_date", "time", "amount", "temperature", "weather_resume_wmo_code"
    )
    surplus = F.col("n") - F.when(F.col("_before").isNull(), 1).otherwise(0)
    return {
        "sales": sales,
        "rejected": judged.where("_problem is not null").select("package_id", "id_store", "date", CORRUPT, F.col("_problem").alias("reason")),
        "receipts": ok.select("package_id", "id_store", "date", F.size(F.coalesce("sales", F.array())).alias("blocks")),
        "duplicates": valid.select("package_id", "id_store", "date", surplus.alias("copies")).where("copies > 0"),
        "new_products": complete_products(lines, products, catalog),
    }
