"""Store dashboard and prediction feed (A10, B9, B11-B13, B26, B27, C9, C10,
D17-D19, E5, E6).  Every operator works for all stores at once; per-store
windows only run over bounded sets (one row per product or per day)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailspark.config import as_date
from retailspark.functions.numbers import round_decimal
from retailspark.functions.text import fold_char, normalize_text, short_name
from retailspark.operators.ids import rank_within
from retailspark.operators.search import GRAM, matching_products

# Client-side defaults for absent alert fields.
ALERT_DEFAULTS = {
    "name": "Producto Desconocido",
    "barcode": "000000",
    "category": "General",
    "image_url": "https://via.placeholder.com/150",
    "objective_date": "2026-04-10",
    "prediction": 0,
    "avg_weekly_sales": 0.0,
    "type": "neutral",
    "feature": False,
}
ALERT_JSON_SCHEMA = (
    "name string, barcode string, category string, image_url string, objective_date string, "
    "prediction int, avg_weekly_sales double, type string, feature boolean"
)
TOP_DEVIATIONS = 25
NAME_CHARS = 10


def prediction_feed(predictions: DataFrame, *, as_of, store_id=None) -> DataFrame:
    """Predictions strictly after ``as_of`` in the gateway's field names
    (``Category``, ``objetive_date`` as ``yyyy-MM-dd`` text; no barcode)."""
    p = predictions.filter(F.col("objective_date") > F.lit(as_date(as_of)))
    if store_id is not None:
        p = p.filter(F.col("store_id") == F.lit(store_id))
    return p.select(
        "store_id",
        "product_name",
        F.col("category").alias("Category"),
        "image_url",
        F.date_format("objective_date", "yyyy-MM-dd").alias("objetive_date"),
        "prediction",
        "percentage_average_deviation",
        "feature",
        "type",
    )



def parse_alerts(df: DataFrame, json_col: str = "json", *, as_of) -> DataFrame:
    """Semi-structured alert records -> typed rows with the client's
    defaults for absent fields.  An absent date takes the fixed default date; a
    present but unparsable one takes ``as_of``."""
    j = F.from_json(F.col(json_col), ALERT_JSON_SCHEMA)
    d = ALERT_DEFAULTS
    raw_date = j["objective_date"]
    date = F.when(raw_date.isNull(), F.to_date(F.lit(d["objective_date"]))).otherwise(
        F.coalesce(F.try_to_date(raw_date, "yyyy-MM-dd"), F.lit(as_date(as_of)))
    )
    return df.select(
        *[c for c in df.columns if c != json_col],
        F.coalesce(j["name"], F.lit(d["name"])).alias("product_name"),
        F.coalesce(j["barcode"], F.lit(d["barcode"])).alias("barcode"),
        F.coalesce(j["category"], F.lit(d["category"])).alias("category"),
        F.coalesce(j["image_url"], F.lit(d["image_url"])).alias("image_url"),
        date.alias("objective_date"),
        F.coalesce(j["prediction"], F.lit(d["prediction"])).alias("prediction"),
        F.coalesce(j["avg_weekly_sales"], F.lit(d["avg_weekly_sales"])).alias("avg_weekly_sales"),
        F.coalesce(j["type"], F.lit(d["type"])).alias("type"),
        F.coalesce(j["feature"], F.lit(d["feature"])).alias("feature"),
    )


def parse_alerts_fields(df: DataFrame, json_col: str = "json", *, as_of) -> DataFrame:
    """B13 field by field: as ``parse_alerts``, with ``failed`` (the names of fields
    whose value isn't of their type, in the order of the schema) and ``malformed`` (the
    text is no JSON object).  A field of the wrong type costs that field only and takes
    its default, as an absent one does; numbers in text are read."""
    rows = df.withColumn("_v", F.try_parse_json(json_col))
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    got, failed = {}, []
    for name, kind in (field.split() for field in ALERT_JSON_SCHEMA.split(", ")):
        path = f"$.{name}"
        raw = F.try_variant_get("_v", path, "variant")
        # Text is only what was written as text.
        value = F.try_variant_get("_v", path, kind)
        if kind == "string":
            value = F.when(F.schema_of_variant(raw) == "STRING", value)
        got[name] = F.when(is_object, value)
        failed.append(F.when(is_object & raw.isNotNull() & ~F.is_variant_null(raw) & value.isNull(), F.lit(name)))
    d = ALERT_DEFAULTS
    date = F.when(got["objective_date"].isNull(), F.to_date(F.lit(d["objective_date"]))).otherwise(
        F.coalesce(F.try_to_date(got["objective_date"], "yyyy-MM-dd"), F.lit(as_date(as_of)))
    )
    named = {"name": "product_name"}
    columns = [date.alias(n) if n == "objective_date" else F.coalesce(c, F.lit(d[n])).alias(named.get(n, n)) for n, c in got.items()]
    return rows.select(*[c for c in df.columns if c != json_col], *columns, F.array_compact(F.array(*failed)).alias("failed"), (F.col(json_col).isNotNull() & ~is_object).alias("malformed"))


def alerts_with_weekly_average(feed_rows: DataFrame, v_p: DataFrame) -> DataFrame:
    """``avg_weekly_sales`` = 7 x V_p of the (store, barcode) (0.0 when absent)."""
    v = v_p.select("store_id", "barcode", (F.col("v_p") * F.lit(7.0)).alias("avg_weekly_sales"))
    return feed_rows.join(v, ["store_id", "barcode"], "left").withColumn(
        "avg_weekly_sales", F.coalesce("avg_weekly_sales", F.lit(0.0))
    )


def normalize_literal(text: str | None) -> str:
    """The search box text under the rule of ``normalize_text`` (None -> '')."""
    return "".join(fold_char(c) for c in text or "").lower()


def search_products(alerts: DataFrame, *, text: str | None = None, type: str | None = None, sort: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """Accent- and case-insensitive literal substring match on the
    product name or on the lower-cased barcode (empty text = no filter), an
    optional type filter, and ``sort`` in {None, 'az', 'za'} as a per-store
    ``list_rank`` on the normalised name (ties: barcode, date).  With ``index``
    (``search.read_index``) a text of three letters or more is looked up in posting
    lists, and the rows found by an equi-join."""
    out = alerts
    q = normalize_literal(text)
    if q and index is not None and len(q) >= GRAM:
        hits = matching_products(index, q).select(F.col("barcode").alias("_barcode"), F.col("product_name").alias("_name"))
        same = F.col("barcode").eqNullSafe(F.col("_barcode")) & F.col("product_name").eqNullSafe(F.col("_name"))
        out = out.join(hits, same, "left_semi")
    elif q:
        hit = F.locate(q, normalize_text(F.col("product_name"))) > 0
        hit = hit | (F.locate(q, F.lower(F.coalesce(F.col("barcode"), F.lit("")))) > 0)
        out = out.filter(hit)
    if type:
        out = out.filter(F.col("type") == F.lit(type))
    if sort in ("az", "za"):
        key = normalize_text(F.col("product_name"))
        key = key.asc() if sort == "az" else key.desc()
        out = rank_within(out, ["store_id"], [key, F.col("barcode").asc(), F.col("objective_date").asc()], name="list_rank")
    elif sort is not None:
        raise ValueError("sort must be None, 'az' or 'za'")
    return out


def top_deviations(alerts: DataFrame, *, n: int = TOP_DEVIATIONS) -> DataFrame:
    """Per store, alerts with ``avg_weekly_sales > 0``; deviation
    ``round((P - A) / A * 100, 2)``; the ``n`` largest |deviation| (ties: name with
    NULL last, barcode, date); short axis name; colour class; axis limit
    ``int(max|dev| * 1.2)``.  ``WindowGroupLimit`` keeps only n rows per store
    before the shuffle."""
    a = alerts.filter(F.col("avg_weekly_sales") > 0)
    dev = round_decimal((F.col("prediction").cast("double") - F.col("avg_weekly_sales")) / F.col("avg_weekly_sales") * F.lit(100.0), 2)
    a = a.withColumn("dev", dev).withColumn("abs_dev", F.abs("dev"))
    w = Window.partitionBy("store_id").orderBy(
        F.col("abs_dev").desc(), F.col("product_name").asc_nulls_last(), F.col("barcode").asc(), F.col("objective_date").asc()
    )
    # Filter on the rank itself so Spark plans a partial WindowGroupLimit.
    top = a.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    lim = Window.partitionBy("store_id")
    return top.select(
        "store_id", (F.col("_rn") - 1).alias("bar_index"), "barcode", "objective_date",
        short_name(F.col("product_name"), NAME_CHARS).alias("label"),
        "dev",
        F.when(F.col("dev") >= 0, F.lit("positive")).otherwise(F.lit("negative")).alias("color"),
        (F.max("abs_dev").over(lim) * F.lit(1.2)).cast("int").alias("y_limit"),
    )


def product_detail(predictions: DataFrame, *, as_of) -> DataFrame:
    """For every (store, barcode) the detail row the client opens: the
    nearest prediction strictly after ``as_of`` (an aggregate, not a window)."""
    p = predictions.filter(F.col("objective_date") > F.lit(as_date(as_of)))
    cols = [c for c in p.columns if c not in ("store_id", "barcode")]
    g = p.groupBy("store_id", "barcode").agg(F.min_by(F.struct(*cols), F.col("objective_date")).alias("r"))
    return g.select("store_id", "barcode", *[F.col(f"r.{c}").alias(c) for c in cols])


def history_series(history: DataFrame) -> DataFrame:
    """Per (store, barcode) daily series with a 0-based index in date order
    and the axis top ``max(10, int(max volume * 1.3))``."""
    k = ["store_id", "barcode"]
    w = Window.partitionBy(*k).orderBy("sale_date")
    return history.select(
        *k, "date", "volume",
        (F.row_number().over(w) - 1).alias("idx"),
        F.greatest(F.lit(10), (F.max("volume").over(Window.partitionBy(*k)) * F.lit(1.3)).cast("int")).alias("y_top"),
    )


def zip_shortest(a: Column, b: Column) -> Column:
    """Positional pairs of two arrays, truncated to the shorter one
    (``arrays_zip`` alone pads with NULL)."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, 1, n), F.slice(b, 1, n))


def dashboard_stats(stores: DataFrame, scan_totals: DataFrame, pending: DataFrame, feed: DataFrame) -> DataFrame:
    """Per store: scans, active predictions (feed rows), pending packages."""
    s = stores.select("store_id")
    act = feed.groupBy("store_id").agg(F.count(F.lit(1)).alias("active_predictions"))
    pend = pending.groupBy(F.col("client_id").alias("store_id")).agg(F.count(F.lit(1)).alias("pending_syncs"))
    j = s.join(scan_totals, "store_id", "left").join(act, "store_id", "left").join(pend, "store_id", "left")
    return j.select(
        "store_id",
        F.coalesce("total_units", F.lit(0).cast("long")).alias("total_scans"),
        F.coalesce("active_predictions", F.lit(0).cast("long")).alias("active_predictions"),
        F.coalesce("pending_syncs", F.lit(0).cast("long")).alias("pending_syncs"),
        F.lit(True).alias("is_online"),
    )


def weekly_series(sales: DataFrame, predictions: DataFrame, *, as_of, past_days: int = 7, future_days: int = 7, as_arrays: bool = False) -> DataFrame:
    """Per store and date in ``as_of - past_days + 1 .. as_of + future_days``:
    actual units sold and predicted units (full outer on date, 0 when absent).
    ``as_arrays`` folds each store into the three ordered arrays of the chart
    (at most past_days + future_days entries)."""
    a = as_date(as_of)
    lo, hi = F.date_sub(F.lit(a), past_days - 1), F.date_add(F.lit(a), future_days)
    act = sales.filter(F.col("sale_date").between(lo, hi)).groupBy("store_id", F.col("sale_date").alias("d")).agg(
        F.sum("amount").cast("long").alias("actual")
    )
    pr = predictions.filter(F.col("objective_date").between(lo, hi)).groupBy("store_id", F.col("objective_date").alias("d")).agg(
        F.sum("prediction").cast("long").alias("predicted")
    )
    j = act.join(pr, ["store_id", "d"], "full_outer").select(
        "store_id",
        F.col("d").alias("series_date"),
        F.date_format("d", "dd/MM").alias("label"),
        F.coalesce("actual", F.lit(0).cast("long")).alias("actual_sales"),
        F.coalesce("predicted", F.lit(0).cast("long")).alias("predicted_sales"),
    )
    if not as_arrays:
        return j
    g = j.groupBy("store_id").agg(F.array_sort(F.collect_list(F.struct("series_date", "label", "actual_sales", "predicted_sales"))).alias("s"))
    return g.select(
        "store_id",
        F.col("s.label").alias("labels"),
        F.col("s.actual_sales").alias("actual_sales"),
        F.col("s.predicted_sales").alias("predicted_sales"),
    )
