"""Continuous package ingestion.

``readStream`` of package JSON files -> content-hash id -> ``foreachBatch``.  Every
document that arrives ends in exactly one of three tables: ``receipts`` (its
lines are in ``sales``), ``rejects`` (with a reason) or ``duplicates`` (its
content was received before).  Duplicates are found against the stored ids, not by a
watermark: the package date is written by the client, whose clock may be wrong and
who may have been offline for months, so it bounds nothing.  Ids are kept by
prefix in runs that are merged ``FAN`` at a time, so a micro-batch reads the prefixes of
its own packages in a number of files that grows with the logarithm of the epochs.

Every sink write is keyed by the micro-batch id (``epoch=<id>`` directories
overwritten as a whole), and an epoch compares itself with earlier epochs only, so
a replay after a failure rewrites the same files: with the checkpointed source
offsets this gives exactly-once output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retailspark.operators.ingest import attach_weather, complete_products, package_lines, package_problem
from retailspark.sources.readers import CORRUPT, PACKAGE_SCHEMA_WITH_CORRUPT, package_id

#: A table, or a function that loads it: a loader is called in every micro-batch
#: and so sees rows that came since the stream started.
Table = DataFrame | Callable[[], DataFrame]

KEEP = ["package_id", "id_store", "date", "day", "sales", CORRUPT]


def load(table: Table) -> DataFrame:
    return table() if callable(table) else table


def package_stream(spark: SparkSession, path: str, *, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming packages with ``package_id`` (a digest of the content) and
    ``source`` (file).  All documents, duplicates and malformed ones included."""
    r = spark.readStream.schema(PACKAGE_SCHEMA_WITH_CORRUPT).option("columnNameOfCorruptRecord", CORRUPT)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return package_id(r.json(path).withColumn("source", F.col("_metadata.file_path")))


def with_problem(packages: DataFrame, stores: DataFrame) -> DataFrame:
    """``packages`` with ``_problem``: NULL for one that can be stored."""
    known = stores.select(F.col("store_id").alias("id_store"), F.lit(True).alias("_known")).distinct()
    found = packages.join(known, "id_store", "left")
    return found.withColumn(
        "_problem", F.when(F.col(CORRUPT).isNotNull(), "malformed").otherwise(F.coalesce(package_problem(), F.when(F.col("_known").isNull(), "unknown_store")))
    ).drop("_known")


def classify_packages(batch: DataFrame, stores: DataFrame, received: DataFrame | None) -> DataFrame:
    """``batch`` with ``reason``: NULL for a package to store, else ``malformed``,
    ``bad_date``, ``bad_time``, ``bad_product``, ``unknown_store`` or ``duplicate``.

    Of equal packages in the batch the first by file is stored.  A package that
    is rejected isn't received: offered again later (I3), it isn't a duplicate.
    The batch is bounded by the trigger, so its ids are broadcast to the stored
    ones, whatever their number."""
    found = with_problem(batch, stores)
    nth = F.row_number().over(Window.partitionBy("package_id", "_problem").orderBy("source"))
    found = found.withColumn("_repeat", F.col("_problem").isNull() & (nth > 1))
    if received is not None:
        before = received.select("package_id").join(F.broadcast(batch.select("package_id").distinct()), "package_id", "left_semi").distinct()
        found = found.join(before.withColumn("_before", F.lit(True)), "package_id", "left")
    else:
        found = found.withColumn("_before", F.lit(None).cast("boolean"))
    duplicate = F.col("_problem").isNull() & (F.col("_repeat") | F.coalesce("_before", F.lit(False)))
    return found.withColumn("reason", F.when(duplicate, "duplicate").otherwise(F.col("_problem"))).select(*KEEP, "source", "reason")


def _folders(spark: SparkSession, path: str) -> set[str]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {f.getPath().getName() for f in fs.listStatus(hadoop)} if fs.exists(hadoop) else set()


def _stored(spark: SparkSession, path: str, schema: str, epoch_id: int) -> DataFrame | None:
    """What earlier epochs wrote to ``path``; None before the first write.  The schema is
    declared: a first write that died left a folder without any file to infer it from."""
    if not any(n.startswith("epoch=") for n in _folders(spark, path)):
        return None
    return spark.read.schema(f"{schema}, epoch int").parquet(path).where(F.col("epoch") < epoch_id)


#: Runs of ids that are merged into one.
FAN = 64
#: Hex digits of an id by which its run is partitioned.
PREFIX = 2
_ID_SCHEMA = "package_id string, prefix string"


def _id_runs(epoch_id: int) -> list[tuple[int, int]]:
    """(level, run) of the runs that hold the ids of all epochs before ``epoch_id``: a
    run of level k covers ``FAN ** k`` epochs."""
    runs, level = [], 0
    while epoch_id:
        runs += [(level, r) for r in range(epoch_id // FAN * FAN, epoch_id)]
        epoch_id, level = epoch_id // FAN, level + 1
    return runs


def _run_path(out_dir: str, level: int, run: int) -> str:
    return f"{out_dir}/received/level={level}/run={run}"


def _prefixed(ids: DataFrame) -> DataFrame:
    # A letter before the digits: a folder's name must not read as a number.
    return ids.select("package_id", F.concat(F.lit("p"), F.substring("package_id", 1, PREFIX)).alias("prefix"))


def write_received(ids: DataFrame, epoch_id: int, out_dir: str) -> None:
    """The ids of an epoch's stored packages, and what this epoch completes: ``FAN``
    runs become one of the next level.  A replay writes the same runs."""
    spark = ids.sparkSession
    _prefixed(ids).repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(_run_path(out_dir, 0, epoch_id))
    level, done = 1, (epoch_id + 1) // FAN
    while done and (epoch_id + 1) % FAN**level == 0:
        parts = [_run_path(out_dir, level - 1, r) for r in range((done - 1) * FAN, done * FAN)]
        merged = spark.read.schema(_ID_SCHEMA).option("basePath", f"{out_dir}/received").parquet(*parts)
        merged.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(_run_path(out_dir, level, done - 1))
        level, done = level + 1, done // FAN


def received_before(batch: DataFrame, epoch_id: int, out_dir: str) -> DataFrame | None:
    """The stored ids that share a prefix with the batch's: at most 16 ** ``PREFIX`` prefixes,
    named in a partition filter."""
    spark = batch.sparkSession
    stored = {level: _folders(spark, f"{out_dir}/received/level={level}") for level in {k for k, _ in _id_runs(epoch_id)}}
    paths = [_run_path(out_dir, k, r) for k, r in _id_runs(epoch_id) if f"run={r}" in stored[k]]
    if not paths:
        return None
    prefixes = [r[0] for r in _prefixed(batch).select("prefix").distinct().collect()]
    ids = spark.read.schema(_ID_SCHEMA).option("basePath", f"{out_dir}/received").parquet(*paths)
    return ids.where(F.col("prefix").isin(prefixes)).select("package_id")


def process_batch(batch: DataFrame, epoch_id: int, *, stores: Table, products: Table, catalog: Table, hourly_weather: Table, out_dir: str) -> None:
    """One micro-batch: duplicates and rejects apart, A7/C1 enrichment, C3 product
    completion.

    The batch feeds several writes, so it is persisted for the duration of this
    call (bounded by the trigger size; lost blocks are recomputed from the
    source files) and released at the end."""
    received = received_before(batch, epoch_id, out_dir)
    sorted_out = classify_packages(batch, load(stores), received).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        _write_batch(sorted_out, epoch_id, products=load(products), catalog=load(catalog), hourly_weather=load(hourly_weather), out_dir=out_dir)
    finally:
        sorted_out.unpersist()


def _write_batch(batch: DataFrame, epoch_id: int, *, products: DataFrame, catalog: DataFrame, hourly_weather: DataFrame, out_dir: str) -> None:
    tag = f"epoch={epoch_id}"
    ok = batch.where("reason is null")
    batch.where("reason <> 'duplicate'").select(*KEEP, "reason").write.mode("overwrite").parquet(f"{out_dir}/rejects/{tag}")
    batch.where("reason = 'duplicate'").select("package_id", "id_store", "date", "source").write.mode("overwrite").parquet(f"{out_dir}/duplicates/{tag}")
    lines = package_lines(ok)
    enriched = attach_weather(lines, hourly_weather)
    # Partitioned by sale_date inside the epoch directory: V_p, training and
    # report filters on sale_date prune partitions when the table is read back.
    enriched.select(
        "store_id", "barcode", "sale_date", "time", "amount", "temperature", "weather_resume_wmo_code"
    ).write.mode("overwrite").partitionBy("sale_date").parquet(f"{out_dir}/sales/{tag}")
    # A product is new once: not in the table, not added by an earlier epoch.
    added = _stored(batch.sparkSession, f"{out_dir}/new_products", "barcode string", epoch_id)
    known = products.select("barcode") if added is None else products.select("barcode").union(added.select("barcode"))
    complete_products(lines, known, catalog).write.mode("overwrite").parquet(f"{out_dir}/new_products/{tag}")
    write_received(ok.select("package_id"), epoch_id, out_dir)
    # Last: what has a receipt is stored.
    ok.select("package_id", "id_store", "date", F.size(F.coalesce("sales", F.array())).alias("blocks")).write.mode("overwrite").parquet(
        f"{out_dir}/receipts/{tag}"
    )


def retry_rejected(rejects: DataFrame, stores: DataFrame) -> DataFrame:
    """Dead-letter packages whose store has been registered since; write
    them back into the input directory and the next trigger ingests them.
    Rejected packages have no receipt, so the re-offered copy is accepted once,
    however late; a second copy is then a duplicate."""
    unknown = rejects.filter(F.col("reason") == "unknown_store").select("id_store", "date", "day", "sales")
    return unknown.join(stores.select(F.col("store_id").alias("id_store")), "id_store", "left_semi")


def accounting(spark: SparkSession, out_dir: str) -> DataFrame:
    """(outcome, documents) over all epochs: ``received``, ``duplicate`` and a row
    for each reason of rejection; they add up to the documents that arrived."""
    read = lambda name, column: spark.read.schema(f"{column} string").parquet(f"{out_dir}/{name}")
    parts = [
        read("receipts", "package_id").select(F.lit("received").alias("outcome")),
        read("duplicates", "package_id").select(F.lit("duplicate").alias("outcome")),
        read("rejects", "reason").select(F.col("reason").alias("outcome")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("outcome").agg(F.count(F.lit(1)).alias("documents"))


def ingest_stream(spark: SparkSession, path: str, *, stores: Table, products: Table, catalog: Table, hourly_weather: Table,
                  out_dir: str, checkpoint: str, available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the ingestion query; returns the ``StreamingQuery``."""
    stream = package_stream(spark, path, max_files_per_trigger=max_files_per_trigger)

    def run(batch: DataFrame, epoch_id: int) -> None:
        process_batch(batch, epoch_id, stores=stores, products=products, catalog=catalog,
                      hourly_weather=hourly_weather, out_dir=out_dir)

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
