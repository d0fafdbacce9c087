"""Readers and sinks for tables and semi-structured payloads.

Tables are Parquet; the point-of-sale packages are JSON documents with a fixed
schema (no inference).  Sinks only append or overwrite whole partitions so that
a re-run of the same job produces the same files (idempotent on retry).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRODUCT_LINE = T.StructType([T.StructField("barcode", T.StringType()), T.StructField("amount", T.IntegerType())])
TIME_BLOCK = T.StructType([T.StructField("time", T.StringType()), T.StructField("products", T.ArrayType(PRODUCT_LINE))])
PACKAGE_SCHEMA = T.StructType(
    [
        T.StructField("id_store", T.IntegerType()),
        T.StructField("date", T.StringType()),
        T.StructField("day", T.IntegerType()),
        T.StructField("sales", T.ArrayType(TIME_BLOCK)),
    ]
)
CORRUPT = "_corrupt_record"
PACKAGE_SCHEMA_WITH_CORRUPT = T.StructType(PACKAGE_SCHEMA.fields + [T.StructField(CORRUPT, T.StringType())])

SALES_SCHEMA = (
    "store_id int, barcode string, sale_date date, time string, amount int, temperature double, weather_resume_wmo_code int"
)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """A5: package JSON files (one document per line or file) with the fixed schema;
    malformed documents keep their text in ``_corrupt_record``."""
    return (
        spark.read.schema(PACKAGE_SCHEMA_WITH_CORRUPT)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def append_sales(sales: DataFrame, path: str, *, batch_id: str) -> None:
    """Append a batch of sales lines under ``batch=<id>/sale_date=<d>/``.
    Re-running the same batch id overwrites exactly its own directory, so a
    retried load does not duplicate rows."""
    sales.write.mode("overwrite").partitionBy("sale_date").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def read_sales(spark: SparkSession, path: str, *, with_epoch: bool = False) -> DataFrame:
    """Sales table written by the ingest sink (``epoch=<id>/sale_date=<d>/``
    directories, and the batches that ``compaction`` made of them) or any Parquet
    table with the sales columns.  Partition
    discovery makes ``sale_date`` a partition column, so date filters prune
    directories instead of reading them.  ``with_epoch`` keeps the ingest mark,
    by which training and assortment follow arrivals."""
    from retailspark.sources.compaction import read_compacted

    df = read_compacted(spark, path, SALES_SCHEMA)
    if df is None:
        df = spark.read.option("basePath", path).parquet(path)
    cols = [c.strip().split(" ") for c in SALES_SCHEMA.split(",")]
    epoch = [F.col("epoch").cast("int").alias("epoch")] if with_epoch else []
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in cols], *epoch)


def package_id(df: DataFrame) -> DataFrame:
    """Content hash of a package (store, date, blocks): the key for idempotent
    sinks and duplicate suppression of retried sends."""
    body = F.to_json(F.struct(F.col("id_store"), F.col("date"), F.col("sales")))
    return df.withColumn("package_id", F.sha2(body, 256))


def write_packages(packages: DataFrame, path: str, *, partitioned: bool = True) -> None:
    """One JSON document per package, partitioned by store and date (the
    reference wrote ``{store}_{dd-MM-yyyy}_{HH-mm-ss}.json``).  Dynamic
    partition overwrite replaces only the partitions written.  Not
    ``partitioned``: one folder with several documents to a file, for bulk exchange."""
    documents = packages.select("id_store", "date", "day", "sales")
    if not partitioned:
        documents.write.mode("overwrite").json(path)
        return
    (
        documents
        .withColumn("store", F.col("id_store"))
        .withColumn("package_date", F.col("date"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("store", "package_date")
        .json(path)
    )


def write_table(df: DataFrame, path: str, *, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write a Parquet table; with ``partition_by`` only the written partitions
    are replaced (dynamic overwrite).  For a replacement that must survive a lost
    driver see ``snapshots``."""
    w = df.write.mode(mode).option("partitionOverwriteMode", "dynamic")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's reliable checkpoint directory
    (``spark.checkpoint.dir``) so that a lost executor re-reads it instead of
    recomputing a long lineage.  Never a local checkpoint.

    Parquet files rather than an RDD checkpoint: Spark knows their size, so a table
    with a row a product is broadcast if it is under
    ``spark.sql.autoBroadcastJoinThreshold``.  (Of a shuffled side that a few keys
    leave mostly empty, AQE makes no broadcast, and each key's rows meet in a task.)"""
    from retailspark.session import ensure_checkpoint_dir

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
