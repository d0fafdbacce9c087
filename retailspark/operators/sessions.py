"""Gap sessionisation of key events into scanned codes.

Rules (from the scanner listener): events are processed in time order per
device; a gap strictly larger than ``gap_seconds`` since the previous event
(of any kind) clears the buffer before the event is handled; a character is
appended; the terminator emits the buffer when it is non-empty and clears it;
other keys (NULL token) are ignored but still count for the gap.

Set-based form: an event opens a new island when it is the device's first, when
the gap rule fires, or when the previous event was the terminator.  An island
emits the concatenation of its characters when its last event is the
terminator.

Scale: a single device may hold a large share of all events, so no window is
partitioned by device alone.  Windows run per (device, hour); a small summary
(one row per device and hour with events) carries the previous slot's last event
and the island offset across slot boundaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENTER = "ENTER"


def gap_sessions(
    events: DataFrame,
    *,
    key: str = "device",
    ts: str = "ts",
    token: str = "key",
    order: str = "seq",
    gap_seconds: float = 0.3,
    terminator: str = ENTER,
) -> DataFrame:
    """Return ``key, island, code, started, ended`` per emitted code."""
    e = events.select(F.col(key).alias("_k"), F.col(ts).alias("_ts"), F.col(order).alias("_o"), F.col(token).alias("_tok"))
    # Fixed time slots: a unit of work is one device's hour, not its whole day.
    start = F.lit("1970-01-01 00:00:00").cast(events.schema[ts].dataType)
    e = e.withColumn("_slot", F.timestamp_diff("HOUR", start, F.col("_ts")))
    wl = Window.partitionBy("_k", "_slot").orderBy("_ts", "_o")
    e = (
        e.withColumn("_rn", F.row_number().over(wl))
        .withColumn("_pts", F.lag("_ts").over(wl))
        .withColumn("_ptok", F.lag("_tok").over(wl))
    )
    # Last event of each slot, and the previous slot's last event per device.
    slots = e.groupBy("_k", "_slot").agg(
        F.max_by(F.struct(F.col("_ts").alias("t"), F.col("_tok").alias("tok")), F.struct("_ts", "_o")).alias("_last")
    )
    wd = Window.partitionBy("_k").orderBy("_slot")
    slots = slots.select(
        "_k", "_slot",
        F.lag("_last.t").over(wd).alias("_dpts"),
        F.lag("_last.tok").over(wd).alias("_dptok"),
        F.lag(F.lit(True)).over(wd).alias("_dhas"),
    )
    e = e.join(slots, ["_k", "_slot"])
    first = F.col("_rn") == 1
    prev_ts = F.when(first, F.col("_dpts")).otherwise(F.col("_pts"))
    prev_tok = F.when(first, F.col("_dptok")).otherwise(F.col("_ptok"))
    has_prev = F.when(first, F.coalesce(F.col("_dhas"), F.lit(False))).otherwise(F.lit(True))
    gap_us = F.timestamp_diff("MICROSECOND", prev_ts, F.col("_ts"))
    boundary = (~has_prev) | (gap_us > F.lit(int(round(gap_seconds * 1_000_000)))) | F.coalesce(prev_tok == F.lit(terminator), F.lit(False))
    e = e.withColumn("_b", boundary.cast("long")).withColumn(
        "_lisl", F.sum("_b").over(wl.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    off = e.groupBy("_k", "_slot").agg(F.sum("_b").alias("_nb"))
    off = off.withColumn(
        "_off", F.coalesce(F.sum("_nb").over(wd.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    ).drop("_nb")
    e = e.join(off, ["_k", "_slot"]).withColumn("island", F.col("_off") + F.col("_lisl"))
    # Only islands closed by the terminator emit anything: find them with a
    # cheap aggregate first, so characters of never-closed islands (which the
    # listener discards) are not gathered at all.
    closed = e.filter(F.col("_tok") == F.lit(terminator)).select("_k", "island").distinct()
    e = e.join(closed, ["_k", "island"], "left_semi")
    # Partial text per (device, island, slot), then per island in slot order.
    is_char = F.col("_tok").isNotNull() & (F.col("_tok") != F.lit(terminator))
    part = e.groupBy("_k", "island", "_slot").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(is_char, F.struct("_ts", "_o", "_tok")))),
                lambda s: s["_tok"],
            ),
            "",
        ).alias("_txt"),
        F.max((F.col("_tok") == F.lit(terminator)).cast("int")).alias("_term"),
        F.min("_ts").alias("_start"),
        F.max("_ts").alias("_end"),
    )
    isl = part.groupBy("_k", "island").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_slot", "_txt"))), lambda s: s["_txt"]), "").alias("code"),
        F.max("_term").alias("_term"),
        F.min("_start").alias("started"),
        F.max("_end").alias("ended"),
    )
    return isl.filter((F.col("_term") == 1) & (F.length("code") > 0)).select(
        F.col("_k").alias(key), "island", "code", "started", "ended"
    )
