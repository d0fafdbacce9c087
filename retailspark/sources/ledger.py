"""Ranges of ids reserved by batch.

    <path>/commits/<n>    one reservation: batch, start, count

A reservation is the next commit of the ledger, named by a rename that only one
writer can win, and begins where the last one ends: batches that ran from one
snapshot of the table never share an id.  A batch that has one gets it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailspark.operators.ingest import register_stores
from retailspark.sources.readers import cut_lineage
from retailspark.sources.snapshots import Conflict, _names, commit

RESERVATION = "batch string, start long, count long"


def reservations(spark: SparkSession, path: str) -> DataFrame:
    """``batch, start, count`` of all reservations so far."""
    if not any(n.isdigit() for n in _names(spark, f"{path}/commits")):
        return spark.createDataFrame([], RESERVATION)
    return spark.read.schema(RESERVATION).json(f"{path}/commits/[0-9]*")


def reserve_ids(spark: SparkSession, path: str, batch: str, count: int, *, above: int = 0, tries: int = 20) -> int:
    """The first of ``count`` ids that belong to ``batch`` alone: after all that were
    reserved, and above ``above`` (the largest id that was given before there was a
    ledger).  A replay gets the same ids; one that wants another number is an error."""
    for _ in range(tries):
        versions = [int(n) for n in _names(spark, f"{path}/commits") if n.isdigit()]
        known = reservations(spark, path)
        mine = known.where(F.col("batch") == batch).first()
        if mine is not None:
            if mine["count"] != count:
                raise ValueError(f"batch {batch} has reserved {mine['count']} ids, not {count}")
            return mine["start"]
        start = max(above, known.agg(F.max(F.col("start") + F.col("count") - 1)).first()[0] or 0) + 1
        try:
            commit(spark, path, max(versions, default=0) + 1, {"batch": batch, "start": start, "count": count})
            return start
        except Conflict:  # another batch came first: after it, then
            continue
    raise Conflict(f"no reservation in {path} after {tries} tries")


def register_batch(requests: DataFrame, stores: DataFrame, *, ledger: str, batch: str, order: str = "request_id") -> DataFrame:
    """``register_stores`` with ids that no other batch has, whatever snapshot of
    ``stores`` it saw, and the same ids when the batch is replayed.  An e-mail that two
    batches bring at once is accepted by both: its owner is told apart by the id."""
    spark = requests.sparkSession
    judged = cut_lineage(register_stores(requests, stores, order=order, start=1))
    accepted = judged.where(F.col("store_id").isNotNull()).count()
    above = stores.agg(F.max("store_id")).first()[0] or 0
    if not accepted:
        return judged
    start = reserve_ids(spark, ledger, batch, accepted, above=above)
    return judged.withColumn("store_id", F.col("store_id") + F.lit(start - 1))
