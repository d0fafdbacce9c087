"""Weekly store report.

One job for all stores.  Per-(store, barcode) reductions use aggregate
functions (``max_by`` over a struct key), which combine map-side.  Ranks over a
store's rows use ``rank_within`` (range-partitioned ids, no per-store window);
top-k keeps a window because Spark plans a partial ``WindowGroupLimit`` before
the shuffle; category ranks run over at most a handful of rows per store.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailspark.config import Config, as_date
from retailspark.functions.calendar import date_label, period_label
from retailspark.functions.numbers import signed_percent
from retailspark.functions.text import alert_label
from retailspark.operators.ids import rank_within

# Report defaults for missing product attributes.
UNKNOWN_PRODUCT = "Producto Desconocido"
UNKNOWN_CATEGORY = "Sin categoría"

ROW_FIELDS = ["barcode", "product_name", "category", "objective_date", "prediction", "feature", "type", "percentage_average_deviation"]


def active_stores(stores: DataFrame) -> DataFrame:
    """Stores with an e-mail that is not NULL, not blank (SQL TRIM) and
    contains ``@``; the e-mail is returned stripped of surrounding whitespace."""
    e = F.col("email")
    return stores.filter(e.isNotNull() & (F.trim(e) != "") & e.contains("@")).select(
        "store_id", "owner_name", F.regexp_replace(e, r"^\s+|\s+$", "").alias("email"), "city"
    )


def upcoming_predictions(predictions: DataFrame, *, as_of, cfg: Config = Config(), days: int | None = None, store_id=None) -> DataFrame:
    """Rows with ``as_of <= objective_date <= as_of + days`` (both inclusive;
    8 dates for the default 7), product name / category defaults and NULL
    deviation -> 0.0.  Presentation order (F1) is ``alert_order``."""
    a = as_date(as_of)
    n = days if days is not None else cfg.report_days
    if not 1 <= n <= 31:
        raise ValueError(f"days must be within 1..31, got {n}")
    p = predictions.filter(F.col("objective_date").between(F.lit(a), F.date_add(F.lit(a), n)))
    if store_id is not None:
        p = p.filter(F.col("store_id") == F.lit(store_id))
    return p.select(
        "store_id",
        "barcode",
        F.coalesce("product_name", F.lit(UNKNOWN_PRODUCT)).alias("product_name"),
        F.coalesce("category", F.lit(UNKNOWN_CATEGORY)).alias("category"),
        "objective_date",
        "prediction",
        F.coalesce("feature", F.lit(False)).alias("feature"),
        "type",
        F.coalesce("percentage_average_deviation", F.lit(0.0)).alias("percentage_average_deviation"),
    )


def alert_order():
    """feature desc, |deviation| desc (+Infinity first), date asc, then store, barcode."""
    return [
        F.col("feature").desc(),
        F.abs("percentage_average_deviation").desc(),
        F.col("objective_date").asc(),
        F.col("store_id").asc(),
        F.col("barcode").asc(),
    ]


def ordered_alerts(upcoming: DataFrame) -> DataFrame:
    """F1 as data: ``alert_position`` numbers a store's upcoming rows in the
    report order (featured first, |deviation| desc, date, barcode).  Computed
    with ``rank_within`` so a very large store is spread over many tasks."""
    return rank_within(upcoming, ["store_id"], [*alert_order()[:3], F.col("barcode").asc()], name="alert_position")


def _worst_key():
    # Larger is worse: |dev| desc, then featured first, then the earlier date.
    return F.struct(
        F.abs(F.col("percentage_average_deviation")).alias("a"),
        F.col("feature").cast("int").alias("f"),
        (-F.datediff(F.col("objective_date"), F.lit(_dt.date(1970, 1, 1)))).alias("d"),
    )


def worst_cases(upcoming: DataFrame) -> DataFrame:
    """One row per (store, barcode) with the largest |deviation|; ties go
    to the featured row, then the earliest date.  One aggregate, no numbering."""
    row = F.struct(*[F.col(c) for c in ROW_FIELDS])
    w = upcoming.groupBy("store_id", "barcode").agg(F.max_by(row, _worst_key()).alias("r"))
    return w.select("store_id", *[F.col(f"r.{c}").alias(c) for c in ROW_FIELDS])


def worst_case_rows(upcoming: DataFrame) -> DataFrame:
    """``worst_cases`` with ``summary_rank``, which numbers the rows of a
    store by |deviation| desc (ties: featured, date, barcode)."""
    w = worst_cases(upcoming)
    order = [F.abs("percentage_average_deviation").desc(), F.col("feature").desc(), F.col("objective_date").asc(), F.col("barcode").asc()]
    return rank_within(w, ["store_id"], order, name="summary_rank")


def top_alerts(upcoming: DataFrame, *, k: int | None = None, cfg: Config = Config()) -> DataFrame:
    """Featured rows, one per barcode (its largest |deviation|, earliest date
    on ties), the first ``k`` per store by |deviation| desc (ties: date, barcode)."""
    k = k if k is not None else cfg.max_featured
    if not 1 <= k <= 50:
        raise ValueError(f"k must be within 1..50, got {k}")
    f = upcoming.filter(F.col("feature"))
    row = F.struct(*[F.col(c) for c in ROW_FIELDS])
    best = f.groupBy("store_id", "barcode").agg(F.max_by(row, _worst_key()).alias("r"))
    best = best.select("store_id", *[F.col(f"r.{c}").alias(c) for c in ROW_FIELDS])
    w = Window.partitionBy("store_id").orderBy(
        F.abs("percentage_average_deviation").desc(), F.col("objective_date").asc(), F.col("barcode").asc()
    )
    return best.withColumn("alert_rank", F.row_number().over(w)).filter(F.col("alert_rank") <= k)


def _per_product(upcoming: DataFrame) -> DataFrame:
    """One row per (store, barcode): row counts by type, any-featured flag, worst row's type."""
    t = F.col("type")
    return upcoming.groupBy("store_id", "barcode").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(t == "deficit").alias("n_deficit"),
        F.count_if(t == "superavit").alias("n_superavit"),
        F.count_if(t == "none").alias("n_none"),
        F.count_if(F.col("feature")).alias("n_featured"),
        F.max_by(F.col("type"), _worst_key()).alias("worst_type"),
        F.min("objective_date").alias("d_min"),
        F.max("objective_date").alias("d_max"),
    )


def weekly_stats(upcoming: DataFrame) -> DataFrame:
    """Per store: prediction rows by type, featured rows, distinct products,
    distinct featured products, products by the type of their worst-case row,
    and the objective-date range.  Two partial aggregations, no DISTINCT."""
    pp = _per_product(upcoming)
    wt = F.col("worst_type")
    return pp.groupBy("store_id").agg(
        F.sum("n_rows").alias("total_prediction_rows"),
        F.sum("n_deficit").alias("deficit_rows"),
        F.sum("n_superavit").alias("superavit_rows"),
        F.sum("n_none").alias("neutral_rows"),
        F.sum("n_featured").alias("featured_rows"),
        F.count(F.lit(1)).alias("unique_products"),
        F.count_if(F.col("n_featured") > 0).alias("unique_featured_products"),
        F.count_if(wt == "deficit").alias("deficit_products"),
        F.count_if(wt == "superavit").alias("superavit_products"),
        F.count_if(wt == "none").alias("neutral_products"),
        F.min("d_min").alias("date_range_start"),
        F.max("d_max").alias("date_range_end"),
    )


STAT_COUNTS = [
    "total_prediction_rows", "deficit_rows", "superavit_rows", "neutral_rows", "featured_rows", "unique_products",
    "unique_featured_products", "deficit_products", "superavit_products", "neutral_products",
]


def weekly_stats_all(stores: DataFrame, stats: DataFrame, *, as_of) -> DataFrame:
    """Every store; stores without predictions get zero counts and the range
    ``as_of .. as_of + 7``."""
    a = as_date(as_of)
    j = stores.select("store_id").join(stats, "store_id", "left")
    return j.select(
        "store_id",
        *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in STAT_COUNTS],
        F.coalesce("date_range_start", F.lit(a)).alias("date_range_start"),
        F.coalesce("date_range_end", F.date_add(F.lit(a), 7)).alias("date_range_end"),
        F.col("total_prediction_rows").isNull().alias("is_empty"),
    )


def category_breakdown(worst: DataFrame) -> DataFrame:
    """Per (store, category) over worst-case rows: total, deficit,
    superavit, neutral (= any other type), featured; ``category_rank`` orders a
    store's categories by total desc, then name."""
    t = F.col("type")
    b = worst.groupBy("store_id", "category").agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(t == "deficit").alias("deficit_count"),
        F.count_if(t == "superavit").alias("superavit_count"),
        F.count_if(~t.isin("deficit", "superavit") | t.isNull()).alias("neutral_count"),
        F.count_if(F.col("feature")).alias("featured_count"),
    )
    w = Window.partitionBy("store_id").orderBy(F.col("total_products").desc(), F.col("category").asc())
    return b.withColumn("category_rank", F.row_number().over(w))


def category_proportions(breakdown: DataFrame) -> DataFrame:
    """Percent of the category's products per type, rounded half-even to an
    int; counts shown as text with an em dash for zero."""
    out = breakdown
    for kind in ("deficit", "superavit", "neutral"):
        c = F.col(f"{kind}_count")
        out = out.withColumn(
            f"{kind}_pct",
            F.when(F.col("total_products") > 0, F.bround(F.lit(100.0) * c / F.col("total_products"), 0).cast("int")),
        ).withColumn(f"{kind}_text", F.when(c > 0, c.cast("string")).otherwise(F.lit("—")))
    return out.withColumn(
        "featured_text", F.when(F.col("featured_count") > 0, F.col("featured_count").cast("string")).otherwise(F.lit("—"))
    )


def run_summary(active: DataFrame, results: DataFrame) -> DataFrame:
    """Active stores, successes, failures, and skipped = active stores
    without a result.  ``results``: ``store_id, ok``."""
    j = active.select("store_id").join(results.select("store_id", "ok"), "store_id", "left")
    return j.agg(
        F.count(F.lit(1)).alias("active_stores"),
        F.count_if(F.col("ok") == F.lit(True)).alias("succeeded"),
        F.count_if(F.col("ok") == F.lit(False)).alias("failed"),
        F.count_if(F.col("ok").isNull()).alias("skipped"),
    )


def _row_struct(prefix_rank: str):
    return F.struct(
        F.col(prefix_rank).alias("rank"),
        "barcode", "product_name", "category",
        date_label(F.col("objective_date"), "dd/MM/yyyy").alias("date"),
        "prediction", "feature", "type",
        alert_label(F.col("type"), "report").alias("label"),
        signed_percent(F.col("percentage_average_deviation")).alias("deviation_text"),
        "percentage_average_deviation",
    )


def report_documents(active: DataFrame, stats: DataFrame, worst: DataFrame, alerts: DataFrame, breakdown: DataFrame) -> DataFrame:
    """One document per active store with predictions (stores without are
    skipped, as in the report job): stats, period label, summary rows (one per
    product), top alerts and category rows, each array sorted by its rank.
    Arrays hold at most one entry per product / category of the store."""
    summary = worst.groupBy("store_id").agg(
        F.array_sort(F.collect_list(_row_struct("summary_rank"))).alias("summary_rows")
    )
    top = alerts.groupBy("store_id").agg(F.array_sort(F.collect_list(_row_struct("alert_rank"))).alias("featured_list"))
    cats = category_proportions(breakdown).groupBy("store_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("category_rank").alias("rank"), "category", "total_products", "deficit_count", "superavit_count",
                    "neutral_count", "featured_count", "deficit_pct", "superavit_pct", "neutral_pct",
                )
            )
        ).alias("categories")
    )
    doc = (
        active.join(stats, "store_id")
        .join(summary, "store_id", "left")
        .join(top, "store_id", "left")
        .join(cats, "store_id", "left")
    )
    return doc.select(
        "store_id", "owner_name", "email", "city",
        *STAT_COUNTS,
        "date_range_start", "date_range_end",
        period_label(F.col("date_range_start"), F.col("date_range_end")).alias("period_label"),
        F.coalesce("summary_rows", F.array()).alias("summary_rows"),
        F.coalesce("featured_list", F.array()).alias("featured_list"),
        F.coalesce("categories", F.array()).alias("categories"),
    )


# The plain-text mail digest layout (Spanish).  The brand name
# and the footer are parameters; the defaults are neutral.
DEFAULT_BRAND = "Retail Analytics"
_DIGEST_HEAD = "Le enviamos su Reporte Semanal Predictivo de %s."
_DIGEST_SUMMARY = "── RESUMEN DE PREDICCIONES ──────────────────"
_DIGEST_ALERTS = "── TOP ALERTAS PRIORITARIAS ─────────────────"
DEFAULT_FOOTER = [
    "El reporte completo se encuentra adjunto en formato PDF.",
    "",
    "──────────────────────────────────────────────",
    "Este correo fue generado automáticamente. Por favor no responda.",
]


def report_digest(documents: DataFrame, *, generated_at: str, brand: str = DEFAULT_BRAND, footer: list[str] | None = None) -> DataFrame:
    """Mail subject and plain-text body per document; the alert block
    lists the first five featured rows and is absent when there are none."""
    item = lambda r: F.format_string(
        "  %d. %s [%s] Desv: %s — Pred: %d unid.", r["rank"], r["product_name"], F.upper(r["type"]), r["deviation_text"], r["prediction"]
    )
    top5 = F.slice(F.col("featured_list"), 1, 5)
    alert_block = F.when(
        F.size(top5) > 0,
        F.concat(F.lit(_DIGEST_ALERTS + "\n"), F.array_join(F.transform(top5, item), "\n"), F.lit("\n\n")),
    ).otherwise(F.lit(""))
    head = F.format_string(
        "Hola %s,\n\n" + (_DIGEST_HEAD % brand.replace("%", "%%")) + "\n\nPeríodo: %s al %s\nGenerado: %s\n\n" + _DIGEST_SUMMARY + "\n"
        "  Productos analizados  : %d\n  Alertas prioritarias  : %d\n  Productos en Déficit  : %d\n"
        "  Productos en Superávit: %d\n  Productos en Normal   : %d\n\n",
        F.col("owner_name"),
        date_label(F.col("date_range_start"), "dd/MM/yyyy"),
        date_label(F.col("date_range_end"), "dd/MM/yyyy"),
        F.lit(generated_at),
        F.col("unique_products"), F.col("unique_featured_products"), F.col("deficit_products"),
        F.col("superavit_products"), F.col("neutral_products"),
    )
    body = F.concat(head, alert_block, F.lit("\n".join(DEFAULT_FOOTER if footer is None else footer)))
    subject = F.concat(F.lit(f"📊 Reporte Semanal {brand} — "), F.col("owner_name"), F.lit(" ("), F.col("period_label"), F.lit(")"))
    return documents.select("store_id", "email", subject.alias("subject"), body.alias("body"))
