"""Contiguous ids and per-group ranks in a total order without a window that
holds a whole group (or the whole table) in one task.

``row_number()`` over an unpartitioned window moves every row into one task,
and over ``partitionBy(g)`` it moves a hot group into one task.  Instead:
range-partition by the full order (a hot group is split across partitions
because its rows have distinct sort keys) and sort within partitions; then
``monotonically_increasing_id()`` holds a row's partition and its place in it.
The id is that place plus the row count of all earlier partitions (one row per
partition, so tiny).  A rank within a group is then ``id - first id of the
group``.  Needs a unique total order for a deterministic result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailspark.sources.readers import cut_lineage

#: ``monotonically_increasing_id`` has the partition above this many bits.
PLACE_BITS = 33


def _cols(order) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def with_sequential_id(df: DataFrame, order, *, name: str = "seq_id", start: Column | int = 1, partitions: int | None = None) -> DataFrame:
    """``df`` with contiguous ids from ``start`` in ``order``: one range shuffle.

    Range bounds come from a sample, so two evaluations could put a row into
    different partitions; the rows are written once, with partition and place, into
    the reliable checkpoint directory, and counts and rows both read that copy."""
    order = _cols(order)
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    place = cut_lineage(ranged.sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", PLACE_BITS)
    counts = place.groupBy(part.alias("_pid")).agg((F.max(F.col("_mid").bitwiseAND((1 << PLACE_BITS) - 1)) + 1).alias("_n"))
    # One row per partition: a running sum over it is cheap.
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_pid", before.alias("_offset"))
    start_col = start if isinstance(start, Column) else F.lit(start)
    return (
        place.join(F.broadcast(offsets), part == F.col("_pid"))
        .withColumn(name, (start_col + F.col("_offset") + F.col("_mid").bitwiseAND((1 << PLACE_BITS) - 1)).cast("long"))
        .drop("_pid", "_mid", "_offset")
    )


def rank_within(df: DataFrame, by: list[str], order, *, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """``row_number() over (partition by <by> order by <order>)`` computed
    without gathering a group into one task."""
    ids = with_sequential_id(df, [F.col(c).asc() for c in by] + _cols(order), name="_gid", partitions=partitions)
    first = ids.groupBy(*by).agg(F.min("_gid").alias("_first"))
    return ids.join(first, by).withColumn(name, (F.col("_gid") - F.col("_first") + 1).cast("int")).drop("_gid", "_first")
