"""Tumbling 30-minute aggregation of scans as a stream (I2); batch twin is
``operators.ingest.half_hour_sales``.

``half_hour_sink`` loses nothing: each micro-batch writes its partial sums, so a scan
counts however late it comes.  From time to time the sums so far become one snapshot,
and ``read_half_hours`` adds the newer epochs to the latest one: what it reads
doesn't grow with the number of epochs.
``half_hour_stream`` is for consumers that want closed windows at once and accept
a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailspark.operators.ingest import clean_scans, half_hour_sales, malformed_scans

SCAN_SCHEMA = "id long, store_id int, barcode string, time string, amount int"


def half_hour_stream(scans: DataFrame, *, watermark: str = "30 days") -> DataFrame:
    """Units per (store, 30-minute window, barcode); state is dropped once the
    watermark passes a window's end (late scans beyond it are not counted).

    Scan times are wall-clock text.  The event time is that wall time read as
    UTC (epoch micros), so windows fall on wall-clock half hours and the date
    and block are derived from the window start arithmetically, whatever the
    session time zone."""
    s = clean_scans(scans)
    # A time without a date, or none at all, has no window; such scans are in
    # ``malformed`` of ``half_hour_sink`` or, with a NULL date, in its sums.
    wall = F.try_to_timestamp(F.concat(F.trim(F.col("time")), F.lit("Z")), F.lit("yyyy-MM-dd HH:mm:ssX"))
    s = s.withColumn("ts", wall).filter(F.col("ts").isNotNull())
    g = s.withWatermark("ts", watermark).groupBy("store_id", F.window("ts", "30 minutes"), "barcode").agg(
        F.sum("amount").cast("long").alias("amount")
    )
    start_s = F.floor(F.unix_micros(F.col("window.start")) / F.lit(1_000_000))
    day = F.floor(start_s / F.lit(86400)).cast("int")
    sec = (start_s - day.cast("long") * 86400).cast("int")
    return g.select(
        "store_id",
        F.date_add(F.lit("1970-01-01").cast("date"), day).alias("sale_date"),
        F.format_string("%02d:%02d:00", (sec / 3600).cast("int"), ((sec % 3600) / 60).cast("int")).alias("block"),
        "barcode",
        "amount",
    )


def write_half_hours(batch: DataFrame, epoch_id: int, out_dir: str) -> None:
    """One micro-batch: partial sums into ``sums``, unreadable times into
    ``malformed``, both keyed by the epoch, which a replay overwrites."""
    scans = clean_scans(batch)
    half_hour_sales(scans).write.mode("overwrite").parquet(f"{out_dir}/sums/epoch={epoch_id}")
    malformed_scans(scans).write.mode("overwrite").parquet(f"{out_dir}/malformed/epoch={epoch_id}")


SUMS = "store_id int, sale_date date, block string, barcode string, amount long"
KEYS = ["store_id", "sale_date", "block", "barcode"]


def _numbers(spark: SparkSession, path: str, name: str) -> dict[int, str]:
    """The folders ``<name>=<n>`` of ``path`` whose write has ended, by number."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    done = [n for n in names if n.startswith(f"{name}=") and fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS"))]
    return {int(n.split("=")[1]): f"{path}/{n}" for n in done}


def _parts(spark: SparkSession, out_dir: str, before: int | None = None) -> list[str]:
    """The latest snapshot (with only epochs before ``before``) and the epochs after it."""
    allowed = lambda n: before is None or n < before
    snapshots = {n: p for n, p in _numbers(spark, f"{out_dir}/snapshots", "through").items() if allowed(n)}
    through = max(snapshots, default=-1)
    epochs = {n: p for n, p in _numbers(spark, f"{out_dir}/sums", "epoch").items() if allowed(n)}
    return [snapshots[n] for n in snapshots if n == through] + [p for n, p in sorted(epochs.items()) if n > through]


def compact_half_hours(spark: SparkSession, out_dir: str, before: int) -> None:
    """The sums of all epochs before ``before`` as one snapshot: the last one and the
    epochs after it, merged by key.  An epoch that may still be replayed must not lie
    before; written again, the snapshot is the same."""
    parts = _parts(spark, out_dir, before)
    if parts:
        sums = spark.read.schema(SUMS).parquet(*parts).groupBy(*KEYS).agg(F.sum("amount").alias("amount"))
        sums.write.mode("overwrite").parquet(f"{out_dir}/snapshots/through={before - 1}")


def half_hour_sink(scans: DataFrame, *, out_dir: str, checkpoint: str, available_now: bool = True, compact_every: int = 64):
    """Start the query that keeps ``write_half_hours`` going, with a snapshot every
    ``compact_every`` epochs; returns it."""

    def run(batch: DataFrame, epoch: int) -> None:
        # Epochs before this one are done; this one may come again.
        if epoch and epoch % compact_every == 0:
            compact_half_hours(batch.sparkSession, out_dir, epoch)
        write_half_hours(batch, epoch, out_dir)

    w = scans.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_half_hours(spark: SparkSession, out_dir: str) -> DataFrame:
    """Units per (store, date, half-hour block, barcode) over all epochs: what
    ``half_hour_sales`` gives over all scans at once.  Reads the latest snapshot and
    the epochs after it."""
    parts = _parts(spark, out_dir)
    if not parts:
        return spark.createDataFrame([], SUMS)
    return spark.read.schema(SUMS).parquet(*parts).groupBy(*KEYS).agg(F.sum("amount").alias("amount"))
