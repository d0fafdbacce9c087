"""Weekly report job: every active store's statistics, worst-case rows, top
alerts, category breakdown, report document and mail digest in one job.

The upcoming rows (one horizon of predictions) feed four aggregations, so with
``materialize`` they are written once to the reliable checkpoint directory.
Stores without predictions get no document (they are counted as skipped by the
run summary), as in the reference job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailspark.config import Config
from retailspark.operators import reports as RP
from retailspark.sources.readers import cut_lineage


def weekly_report(*, stores: DataFrame, predictions: DataFrame, as_of, generated_at: str, cfg: Config = Config(),
                  materialize: bool = True, brand: str = RP.DEFAULT_BRAND) -> dict[str, DataFrame]:
    active = RP.active_stores(stores)
    upcoming = RP.upcoming_predictions(predictions.join(active.select("store_id"), "store_id", "left_semi"), as_of=as_of, cfg=cfg)
    if materialize:
        upcoming = cut_lineage(upcoming)
    stats = RP.weekly_stats(upcoming)
    worst = RP.worst_case_rows(upcoming)
    alerts = RP.top_alerts(upcoming, cfg=cfg)
    categories = RP.category_breakdown(worst)
    documents = RP.report_documents(active, stats, worst, alerts, categories)
    digests = RP.report_digest(documents, generated_at=generated_at, brand=brand)
    results = documents.select("store_id", F.lit(True).alias("ok"))
    return {
        "active": active, "upcoming": upcoming, "stats": stats, "worst": worst, "alerts": alerts,
        "categories": categories, "documents": documents, "digests": digests,
        "summary": RP.run_summary(active, results),
    }


def write_report_documents(documents: DataFrame, path: str) -> None:
    """One JSON document per store under ``store=<id>/``; re-running the job
    replaces only the stores it wrote (dynamic partition overwrite)."""
    (
        documents.withColumn("store", F.col("store_id"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("store").json(path)
    )
