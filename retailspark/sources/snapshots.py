"""Parquet tables that are replaced by commit (A11, G1 on disk).

    <path>/runs/<run>/<partition>=<value>/   data files; a run's folder is written once
    <path>/runs/<run>/_bucket_of_256=<n>/    the same for a table of many partition values
    <path>/commits/<version>                 which run each folder is read from

A writer puts its partitions into a fresh run folder and then names a new commit,
the last step, by a rename that fails if another writer has taken the version.
Readers follow the highest commit, so a run that dies on the way leaves the table as it
was, and a reader that has begun goes on with the files of its commit.  The file
system's rename must be atomic and refuse an existing name (HDFS does).

A folder a value is right for some thousand values at most: with more of them, a version
is as many small files.  Such a table has ``BUCKETS`` folders instead; the values that
share a hash share a folder, ordered by value, so that a filter skips most of a file.
A table that outgrows its folders is written whole into buckets, once.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailspark.operators.scoring import replace_keyed
from retailspark.sources.readers import cut_lineage

#: Partition values that get a folder each and that a filter names one by one.
MOST_PARTITIONS = 2_000
#: Folders of a table that goes over to buckets; one that has keeps its number.
BUCKETS = 256
_BUCKET = "_bucket_of_"


class Conflict(RuntimeError):
    """Another writer has committed since this one read the table."""


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return hadoop, where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    _, where, fs = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []


def current(spark: SparkSession, path: str) -> tuple[int, dict[str, str]]:
    """The latest version and its run for each folder; (0, {}) for no table."""
    versions = [int(n) for n in _names(spark, f"{path}/commits") if n.isdigit()]
    if not versions:
        return 0, {}
    return max(versions), _commit_of(spark, path, max(versions))


def _commit_of(spark: SparkSession, path: str, version: int) -> dict[str, str]:
    text = spark.read.text(f"{path}/commits/{version:012d}", wholetext=True).first()[0]
    return json.loads(text)


def commit(spark: SparkSession, path: str, version: int, runs: dict[str, str]) -> None:
    """Name ``runs`` as that version; ``Conflict`` if it exists."""
    hadoop, tmp, fs = _fs(spark, f"{path}/commits/.{uuid.uuid4().hex}")
    out = fs.create(tmp)
    out.write(bytearray(json.dumps(runs, sort_keys=True).encode()))
    out.close()
    target = hadoop.Path(f"{path}/commits/{version:012d}")
    try:
        options = spark._jvm.org.apache.hadoop.fs.Options.Rename
        none = spark._sc._gateway.new_array(options, 0)
        hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(tmp), fs.makeQualified(target), none)
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        fs.delete(tmp, False)
        raise Conflict(f"version {version} of {path} was committed by another writer") from e


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of ``version`` (default: the latest).  Partition filters prune folders,
    in a table of buckets row groups and pages."""
    runs = _commit_of(spark, path, version) if version is not None else current(spark, path)[1]
    if not runs:
        raise AnalysisException(f"PATH_NOT_FOUND: no committed table in {path}")
    return _read(spark, path, runs).drop(*filter(None, [_bucket_column(runs)]))


def _bucket_column(runs: dict[str, str]) -> str | None:
    return next((folder.partition("=")[0] for folder in runs if folder.startswith(_BUCKET)), None)


def _bucket(partition_col: str, bucket_column: str) -> Column:
    # Of the text, so that integers of any width agree.
    buckets = int(bucket_column.removeprefix(_BUCKET))
    return F.pmod(F.hash(F.col(partition_col).cast("string")), F.lit(buckets)).alias(bucket_column)


def _read(spark: SparkSession, path: str, runs: dict[str, str]) -> DataFrame:
    by_run = defaultdict(list)
    for partition, run in runs.items():
        by_run[run].append(partition)

    def part(run: str, partitions: list[str]) -> DataFrame:
        # Partition columns are found below a run's folder, which is read as one path if all of it is current.
        base = f"{path}/runs/{run}"
        whole = len(partitions) == sum("=" in n for n in _names(spark, base))
        return spark.read.option("basePath", base).parquet(*([base] if whole else sorted(f"{base}/{p}" for p in partitions)))

    return reduce(DataFrame.unionByName, [part(run, partitions) for run, partitions in sorted(by_run.items())])


def replace_keyed_on_disk(spark: SparkSession, path: str, new: DataFrame, *, keys=("store_id", "barcode"), partition_col: str = "store_id") -> int:
    """Every key in ``new`` loses all its stored rows and gets the new ones; other
    keys of the same partition and all other partitions are untouched.  Returns
    the version that it committed.

    Only the folders of the partitions present in ``new`` are read, merged and written,
    into a run of their own; of a table that goes over to buckets, all are.  ``new`` is
    computed once.  Two writers that start from one version: the second gets
    ``Conflict`` and may simply run again."""
    version, runs = current(spark, path)
    new = cut_lineage(new)
    stored = bucket = _bucket_column(runs)
    if not stored:
        names = [r[0] for r in new.select(partition_col).distinct().limit(MOST_PARTITIONS + 1).collect()]
        bucket = f"{_BUCKET}{BUCKETS}" if max(len(names), len(runs)) > MOST_PARTITIONS else None
    merged = new
    if runs:
        old = _read(spark, path, runs)
        if stored:
            touched = [r[0] for r in new.select(_bucket(partition_col, stored)).distinct().collect()]
            old = old.where(F.col(stored).isin(touched)).drop(stored)
        elif not bucket:
            named = F.col(partition_col).isin([n for n in names if n is not None])
            old = old.where(named | F.col(partition_col).isNull() if None in names else named)
        merged = replace_keyed(old, new.select(*old.columns), list(keys))
    # A folder's rows together, large ones in pieces: not a file of it from every task.
    if bucket:
        rows = merged.select("*", _bucket(partition_col, bucket)).hint("rebalance", bucket).sortWithinPartitions(bucket, partition_col)
    else:
        rows = merged.hint("rebalance", partition_col)
    run = uuid.uuid4().hex
    rows.write.partitionBy(bucket or partition_col).parquet(f"{path}/runs/{run}")
    written = {n: run for n in _names(spark, f"{path}/runs/{run}") if "=" in n}
    commit(spark, path, version + 1, runs | written if stored == bucket else written)
    return version + 1


def vacuum(spark: SparkSession, path: str, *, keep: int = 2) -> int:
    """Delete the commits before the last ``keep`` and the folders that only they, or
    runs that never committed, use; returns how many runs went.  Call it when no
    writer is at work and no reader uses an older version."""
    versions = sorted(int(n) for n in _names(spark, f"{path}/commits") if n.isdigit())
    needed = {r for v in versions[-keep:] for r in _commit_of(spark, path, v).values()}
    hadoop, _, fs = _fs(spark, path)
    gone = [r for r in _names(spark, f"{path}/runs") if r not in needed]
    for v in versions[:-keep]:
        fs.delete(hadoop.Path(f"{path}/commits/{v:012d}"), False)
    for r in gone:
        fs.delete(hadoop.Path(f"{path}/runs/{r}"), True)
    return len(gone)
