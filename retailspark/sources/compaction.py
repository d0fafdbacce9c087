"""Compaction of the sales table that the ingest stream writes.

    <path>/epoch=<n>/sale_date=<d>/                       as the stream writes it: a file or more for each
    <path>_compacted/epochs=<a>-<b>/sale_date=<d>/        the epochs a..b together

Files of many epochs become few: rows are dealt by ranges of date and barcode, so a
small day shares its task with its neighbours and a large one is split, and files are
sorted by barcode, which lets row groups be skipped.  The epoch stays as a column, so
training by arrival goes on as before.  Only epochs that no batch holds yet are read and
written; a batch counts once its write has ended.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file, at most.
FILE_ROWS = 5_000_000


def _finished(spark: SparkSession, path: str) -> dict[str, str]:
    """The folders of ``path`` whose write has ended, by name."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    return {n: f"{path}/{n}" for n in names if fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS"))}


def _batches(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    found = [(re.fullmatch(r"epochs=(\d+)-(\d+)", n), p) for n, p in _finished(spark, f"{path}_compacted").items()]
    return sorted((int(m[1]), int(m[2]), p) for m, p in found if m)


def _loose(spark: SparkSession, path: str, batches: list[tuple[int, int, str]]) -> list[tuple[int, str]]:
    """The finished epochs that no batch holds."""
    epochs = sorted((int(n.split("=")[1]), p) for n, p in _finished(spark, path).items() if re.fullmatch(r"epoch=\d+", n))
    return [(n, p) for n, p in epochs if not any(a <= n <= b for a, b, _ in batches)]


def _epochs(spark: SparkSession, path: str, loose: list[tuple[int, str]], schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, epoch int").option("basePath", path).parquet(*[p for _, p in loose])


def compact_sales(spark: SparkSession, path: str, schema: str, *, before: int) -> tuple[int, int] | None:
    """Put the epochs before ``before`` that are still apart into one batch; the first
    and last of them, or None if there are fewer than two.  ``before`` must not lie after an
    epoch that may be written again."""
    batches = _batches(spark, path)
    loose = [(n, p) for n, p in _loose(spark, path, batches) if n < before and n > max((b for _, b, _ in batches), default=-1)]
    if len(loose) < 2:
        return None
    rows = _epochs(spark, path, loose, schema).repartitionByRange("sale_date", "barcode").sortWithinPartitions("sale_date", "barcode", "epoch")
    first, last = loose[0][0], loose[-1][0]
    rows.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("sale_date").parquet(f"{path}_compacted/epochs={first}-{last}")
    return first, last


def read_compacted(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """All rows with ``epoch``: the batches and the epochs after them; None if there is
    no batch.  Filters on ``sale_date`` prune folders in each."""
    batches = _batches(spark, path)
    if not batches:
        return None
    parts = [spark.read.schema(f"{schema}, epoch int").option("basePath", p).parquet(p) for _, _, p in batches]
    loose = _loose(spark, path, batches)
    if loose:
        parts.append(_epochs(spark, path, loose, schema))
    return reduce(DataFrame.unionByName, parts).withColumn("epoch", F.col("epoch").cast("int"))


def drop_compacted_epochs(spark: SparkSession, path: str) -> int:
    """Delete the epoch folders that a batch holds; how many.  Call it when no reader
    uses them any more."""
    hadoop, gone = spark._jvm.org.apache.hadoop.fs, 0
    for name, folder in _finished(spark, path).items():
        m = re.fullmatch(r"epoch=(\d+)", name)
        if m and any(a <= int(m[1]) <= b for a, b, _ in _batches(spark, path)):
            where = hadoop.Path(folder)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            gone += 1
    return gone
