"""Daily forecasting job: train every product (incrementally from the stored
moments where the registry has them), update the registry, score the grid of
each store's assortment x forecast days, and replace the stored predictions of
the scored keys.

Reads in steady state: the days after the warm products' high-water date,
the 30-day V_p window and the days since the previous run (assortment update),
all date-pruned; only cold products (new, or below the example minimum) read
their whole history, through a semi join on their barcodes (cluster sales by
barcode so Parquet statistics prune that read).

Shuffle boundaries: (store, barcode, date) for the daily aggregate, barcode
for the moments, (store, barcode) for V_p and the write-back.  The models table
has one row of 11 doubles per product; Spark broadcasts it only when its
statistics put it under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailspark.config import Config, as_date
from retailspark.operators.daily import advance_history, average_of, history_totals
from retailspark.operators.models import arrivals, train_arrivals, train_incremental, upsert_registry
from retailspark.operators.scoring import assortment as assortment_of
from retailspark.operators.scoring import extend_assortment, forecast_days, replace_keyed, score, scoring_grid, update_assortment, with_forecast_fallback
from retailspark.sources.readers import cut_lineage


def daily_forecast(
    *, sales: DataFrame, stores: DataFrame, products: DataFrame, registry: DataFrame, forecast_payloads: DataFrame,
    old_predictions: DataFrame, as_of, cfg: Config = Config(), materialize: bool = True,
    assortment: DataFrame | None = None, assortment_as_of=None, since_epoch: int | None = None,
    history: DataFrame | None = None, history_as_of=None,
) -> dict[str, DataFrame]:
    """Run one day.  ``assortment`` / ``assortment_as_of``: the pairs returned by
    the previous run and its date; when given, the assortment and the product
    list are updated from the days since then instead of reading the whole
    sales history (the first run passes none).

    ``history`` / ``history_as_of``: the V_p totals returned by the previous run and
    its date; when given, only the days that came and that left the window are read.

    ``since_epoch`` (with a ``sales`` table that has ``epoch``, as the ingest stream
    writes it) is the last epoch the previous run has seen.  Training and
    assortment then follow what *arrived* since, whatever its date, so sales of a
    store that was offline are learned and scored.  Without it, days count and
    rows that come later than their day are not seen."""
    if assortment is None:
        pairs = assortment_of(sales, as_of=as_of)
    elif since_epoch is not None:
        pairs = extend_assortment(assortment, arrivals(sales, since_epoch=since_epoch, as_of=as_of))
    elif assortment_as_of is not None:
        pairs = update_assortment(assortment, sales, since=assortment_as_of, as_of=as_of)
    else:
        raise ValueError("a given assortment needs the date (assortment_as_of) or the epoch (since_epoch) it was made at")
    if materialize:
        pairs = cut_lineage(pairs)
    # Warm products add the days since their high-water date to their stored
    # moments; cold ones (or a registry without moments) are rebuilt.
    if since_epoch is not None:
        step = train_arrivals(registry, sales, since_epoch=since_epoch, as_of=as_of, cfg=cfg, materialize=materialize)
    else:
        step = train_incremental(registry, sales, as_of=as_of, cfg=cfg, materialize=materialize, known_barcodes=pairs)
    trained = step.filter(F.col("new_examples") > 0)
    if materialize:
        # One row per product: cut the lineage (scan, daily shuffle, solve) so
        # registry update and scoring reuse it and a lost executor re-reads it.
        trained = cut_lineage(trained)
    new_registry = upsert_registry(
        registry, trained.select("barcode", "coef", "mse", "new_examples", "moments", "n", "last_date"), as_of=as_of
    )
    # Every product that has moments is learned through ``as_of`` now, sold or not:
    # one that isn't sold any more doesn't hold the next read back.
    learned = F.col("moments").isNotNull() & (F.coalesce("last_date", F.lit(as_date(as_of))) <= F.lit(as_date(as_of)))
    new_registry = new_registry.withColumn("last_date", F.when(learned, F.lit(as_date(as_of))).otherwise(F.col("last_date")))
    days = with_forecast_fallback(stores, forecast_days(forecast_payloads, cfg=cfg), as_of=as_of, cfg=cfg)
    grid = scoring_grid(pairs, days, products)
    if history is None:
        totals = history_totals(sales, as_of=as_of, cfg=cfg)
    else:
        totals = advance_history(history, sales, since=history_as_of, as_of=as_of, cfg=cfg)
    if materialize:
        totals = cut_lineage(totals)
    fresh = score(grid, new_registry, average_of(totals), cfg=cfg)
    if materialize:
        # The write-back needs the rows and their keys: score once.
        fresh = cut_lineage(fresh)
    return {
        "trained": trained,
        "registry": new_registry,
        "new_predictions": fresh,
        "predictions": replace_keyed(old_predictions, fresh),
        "assortment": pairs,
        "history": totals,
    }
