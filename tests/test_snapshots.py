import os
import tempfile

import pytest
from pyspark.sql import functions as F

from retailspark.sources import snapshots as S

SCHEMA = "store_id int, barcode string, v int"


def _table(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="rs-snap-", dir="/tmp"), "predictions")
    S.replace_keyed_on_disk(spark, path, spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 3), (2, "a", 4)], SCHEMA))
    return path


def _rows(df):
    return sorted(tuple(r) for r in df.select("store_id", "barcode", "v").collect())


def test_keys_are_replaced_and_other_partitions_stay(spark):
    path = _table(spark)
    assert S.replace_keyed_on_disk(spark, path, spark.createDataFrame([(1, "b", 9), (3, "c", 5)], SCHEMA)) == 2
    now = S.read_snapshot(spark, path)
    assert _rows(now) == [(1, "a", 1), (1, "b", 9), (2, "a", 4), (3, "c", 5)]
    assert _rows(S.read_snapshot(spark, path, 1)) == [(1, "a", 1), (1, "b", 2), (1, "b", 3), (2, "a", 4)]
    # Store 2 is still read from the first run.
    runs = S.current(spark, path)[1]
    assert runs["store_id=2"] != runs["store_id=1"] == runs["store_id=3"]
    assert "PartitionFilters: [isnotnull(store_id" in now.where("store_id = 2")._jdf.queryExecution().executedPlan().toString()


def test_a_run_that_dies_before_its_commit_changes_nothing(spark, monkeypatch):
    path = _table(spark)
    before = _rows(S.read_snapshot(spark, path))
    new = spark.createDataFrame([(1, "a", 7), (2, "z", 8)], SCHEMA)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(S, "commit", dies)
        with pytest.raises(KeyboardInterrupt):
            S.replace_keyed_on_disk(spark, path, new)
    assert len(os.listdir(os.path.join(path, "runs"))) == 2 and _rows(S.read_snapshot(spark, path)) == before
    # Dead in the middle of the write: files without a commit.
    new.write.partitionBy("store_id").parquet(f"{path}/runs/half")
    assert _rows(S.read_snapshot(spark, path)) == before
    S.replace_keyed_on_disk(spark, path, new)
    want = [(1, "a", 7), (1, "b", 2), (1, "b", 3), (2, "a", 4), (2, "z", 8)]
    assert _rows(S.read_snapshot(spark, path)) == want
    assert S.vacuum(spark, path, keep=1) == 3 and _rows(S.read_snapshot(spark, path)) == want


def test_the_second_of_two_writers_conflicts(spark):
    path = _table(spark)
    version, runs = S.current(spark, path)
    S.commit(spark, path, version + 1, runs)
    with pytest.raises(S.Conflict):
        S.commit(spark, path, version + 1, runs)
    assert S.current(spark, path)[0] == version + 1
    assert not [n for n in os.listdir(os.path.join(path, "commits")) if n.startswith(".") and not n.endswith(".crc")]


def test_many_partitions_are_joined_and_null_partitions_kept(spark, monkeypatch):
    path = _table(spark)
    monkeypatch.setattr(S, "MOST_PARTITIONS", 1)
    S.replace_keyed_on_disk(spark, path, spark.createDataFrame([(1, "b", 9), (2, "a", 6), (None, "n", 1)], SCHEMA))
    assert sorted(map(str, _rows(S.read_snapshot(spark, path).fillna(-1)))) == sorted(map(str, [(-1, "n", 1), (1, "a", 1), (1, "b", 9), (2, "a", 6)]))
    S.replace_keyed_on_disk(spark, path, spark.createDataFrame([(None, "m", 2)], SCHEMA))
    assert S.read_snapshot(spark, path).where(F.col("store_id").isNull()).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.read_snapshot(spark, path + "-none")


def test_a_partition_is_not_a_file_from_every_task(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="rs-snap-", dir="/tmp"), "predictions")
    rows = spark.range(400).selectExpr("cast(id % 5 as int) store_id", "cast(id as string) barcode", "cast(id as int) v").repartition(8, "barcode")
    for version in (1, 2):
        S.replace_keyed_on_disk(spark, path, rows)
        files = [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
        assert len(files) == 5 * version
    assert S.read_snapshot(spark, path).count() == 400


def _texts(df):
    return sorted(str(tuple(r)) for r in df.select("store_id", "barcode", "v").collect())


def test_many_partition_values_share_folders(spark, monkeypatch):
    monkeypatch.setattr(S, "MOST_PARTITIONS", 10)
    monkeypatch.setattr(S, "BUCKETS", 4, raising=False)
    path = os.path.join(tempfile.mkdtemp(prefix="rs-snap-", dir="/tmp"), "predictions")
    old = [(s, b, 10 * s) for s in range(40) for b in "ab"] + [(None, "n", 1)]
    S.replace_keyed_on_disk(spark, path, spark.createDataFrame(old, SCHEMA))
    first = S.current(spark, path)[1]
    files = [f for _, _, names in os.walk(path) for f in names if f.endswith(".parquet")]
    assert len(first) <= 4 and len(files) <= 4
    now = S.read_snapshot(spark, path)
    assert now.columns == ["store_id", "barcode", "v"] and _texts(now) == sorted(map(str, old))
    # Store 7, here as a bigint, is found; folders without it are left alone.
    S.replace_keyed_on_disk(spark, path, spark.createDataFrame([(7, "b", 1), (7, "b", 2), (7, "c", 3)], "store_id bigint, barcode string, v int"))
    want = [r for r in old if r[:2] != (7, "b")] + [(7, "b", 1), (7, "b", 2), (7, "c", 3)]
    assert _texts(S.read_snapshot(spark, path)) == sorted(map(str, want))
    second = S.current(spark, path)[1]
    assert first.keys() == second.keys() and sum(first[n] != second[n] for n in first) == 1
    # All values again, and none; a table keeps its number of buckets.
    monkeypatch.setattr(S, "BUCKETS", 3, raising=False)
    new = [(s, "a", s) for s in range(45)] + [(None, "n", 2)]
    S.replace_keyed_on_disk(spark, path, spark.createDataFrame(new, SCHEMA))
    want = [r for r in want if r[0] is None or r[1] != "a"] + new
    assert _texts(S.read_snapshot(spark, path)) == sorted(map(str, want))
    assert S.replace_keyed_on_disk(spark, path, spark.createDataFrame([], SCHEMA)) == 4
    assert _texts(S.read_snapshot(spark, path)) == sorted(map(str, want))
    assert S.vacuum(spark, path, keep=1) == 3 and S.read_snapshot(spark, path).count() == len(want)


def test_a_table_that_outgrows_its_folders_goes_over_to_buckets_whole(spark, monkeypatch):
    path = _table(spark)
    monkeypatch.setattr(S, "MOST_PARTITIONS", 3)
    monkeypatch.setattr(S, "BUCKETS", 2, raising=False)
    new = [(s, "z", s) for s in (1, 3, 4, 5, 6, None)]
    S.replace_keyed_on_disk(spark, path, spark.createDataFrame([*new, (1, "b", 9)], SCHEMA))
    want = [(1, "a", 1), (1, "b", 9), (2, "a", 4), *new]
    assert _texts(S.read_snapshot(spark, path)) == sorted(map(str, want))
    assert len(S.current(spark, path)[1]) <= 2
    assert _rows(S.read_snapshot(spark, path, 1)) == [(1, "a", 1), (1, "b", 2), (1, "b", 3), (2, "a", 4)]
