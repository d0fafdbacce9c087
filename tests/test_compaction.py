import datetime as dt
import os

import numpy as np
from pyspark.sql import functions as F

from retailspark.operators import models as MD
from retailspark.sources import compaction as C
from retailspark.sources.readers import SALES_SCHEMA, read_sales

COLUMNS = [c.split()[0] for c in SALES_SCHEMA.split(", ")]


def _write(spark, path, epochs=6):
    for e in range(epochs):
        rows = [(1 + i % 3, f"b{(i * 7 + e) % 5}", dt.date(2024, 1, 1) + dt.timedelta(days=(i + e) % 9), "10:00:00", 1 + i % 4, 20.0, 0) for i in range(40)]
        spark.createDataFrame(rows, SALES_SCHEMA).repartition(3).write.partitionBy("sale_date").parquet(f"{path}/epoch={e}")


def _rows(df):
    return sorted(map(tuple, df.select(*COLUMNS, "epoch").collect()))


def _files(root):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(root) for f in names)


def test_same_rows_in_fewer_files(spark, tmp_path):
    path = f"{tmp_path}/sales"
    _write(spark, path)
    want = _rows(read_sales(spark, path, with_epoch=True))
    assert C.compact_sales(spark, path, SALES_SCHEMA, before=4) == (0, 3)
    assert _rows(read_sales(spark, path, with_epoch=True)) == want
    assert _files(f"{path}_compacted") < _files(path) * 4 / 6 / 2
    # What is compacted already isn't read again; a batch that didn't finish doesn't count.
    assert C.compact_sales(spark, path, SALES_SCHEMA, before=5) is None
    os.makedirs(f"{path}_compacted/epochs=4-5/_temporary")
    assert _rows(read_sales(spark, path, with_epoch=True)) == want
    assert C.compact_sales(spark, path, SALES_SCHEMA, before=6) == (4, 5)
    assert C.drop_compacted_epochs(spark, path) == 6
    assert _rows(read_sales(spark, path, with_epoch=True)) == want
    jan = read_sales(spark, path).where(F.col("sale_date") <= F.lit(dt.date(2024, 1, 2)))
    assert "PartitionFilters: [isnotnull(sale_date" in jan._jdf.queryExecution().executedPlan().toString()
    one = spark.read.parquet(f"{path}_compacted/epochs=0-3").where("sale_date = '2024-01-03'")
    assert [r.barcode for r in one.collect()] == sorted(r.barcode for r in one.collect())


def test_training_by_arrival_goes_on(spark, tmp_path):
    path = f"{tmp_path}/sales"
    _write(spark, path)
    run = lambda: {r.barcode: r for r in MD.train_arrivals(spark.createDataFrame([], "barcode string, total_examples long"), read_sales(spark, path, with_epoch=True), since_epoch=2, as_of=dt.date(2024, 2, 1)).collect()}
    before = run()
    C.compact_sales(spark, path, SALES_SCHEMA, before=5)
    after = run()
    assert set(before) == set(after) and all(after[b].n == before[b].n and np.allclose(after[b].moments, before[b].moments, rtol=1e-9, atol=1e-9) for b in before)
