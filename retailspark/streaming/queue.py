"""The client queue of pending packages as a stream.

Queue files are read once each; a micro-batch is one send pass over what it holds.
What was accepted goes to ``sent``; what stays queued (rejected, or from the first
network error of its client on) is put back into the queue folder as a new file and
so comes again with the next pass, with one more in ``tries``.  Nothing waits in
memory: after a restart the source goes on where its checkpoint ends.

The outcomes of a pass are written before anything follows from them.  A pass that is
replayed with its outcomes on disk doesn't send again; one that died before may send a
package twice, which the receiver finds by its content (``streaming.ingest``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailspark.operators.ingest import pending_packages

ENTRY = "client_id int, seq long, package_name string, tries int"
#: Sends a pass: its entries with a column ``outcome`` (``ok``, ``rejected``, ``network_error``).
Send = Callable[[DataFrame], DataFrame]


def enqueue(entries: DataFrame, queue_dir: str, name: str) -> None:
    """Put ``client_id, seq, package_name`` into the queue as the file group ``name``."""
    tries = F.col("tries") if "tries" in entries.columns else F.lit(0)
    entries.select("client_id", "seq", "package_name", tries.cast("int").alias("tries")).write.mode("overwrite").json(f"{queue_dir}/{name}")


def send_pass(batch: DataFrame, epoch_id: int, *, send: Send, queue_dir: str, out_dir: str) -> None:
    """One micro-batch: ``attempts``, ``sent`` and what goes back into the queue, each
    under its epoch, which a replay overwrites."""
    spark, tag = batch.sparkSession, f"epoch={epoch_id}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{out_dir}/attempts/{tag}/_SUCCESS")
    schema = f"{ENTRY}, outcome string"
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        entries = batch.where(F.length(F.trim("package_name")) > 0)
        send(entries).select("client_id", "seq", "package_name", "tries", "outcome").write.mode("overwrite").parquet(f"{out_dir}/attempts/{tag}")
    attempts = spark.read.schema(schema).parquet(f"{out_dir}/attempts/{tag}")
    place = ["client_id", "seq"]
    waiting = pending_packages(attempts).select(*place)
    attempts.join(waiting, place, "left_anti").select("client_id", "seq", "package_name", "tries").write.mode("overwrite").parquet(f"{out_dir}/sent/{tag}")
    again = attempts.join(waiting, place, "left_semi").withColumn("tries", F.col("tries") + 1)
    if not again.isEmpty():
        enqueue(again, queue_dir, f"again-{epoch_id}")


def queue_stream(spark: SparkSession, queue_dir: str, *, send: Send, out_dir: str, checkpoint: str, available_now: bool = True):
    """Start the passes over the queue; returns the query.  ``available_now`` makes one
    pass over what is there; else a pass follows the other."""
    entries = spark.readStream.schema(ENTRY).json(f"{queue_dir}/*")
    w = entries.writeStream.foreachBatch(lambda batch, epoch: send_pass(batch, epoch, send=send, queue_dir=queue_dir, out_dir=out_dir)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def sent_packages(spark: SparkSession, out_dir: str) -> DataFrame:
    """All entries that were accepted, with the pass (``tries``) that did it."""
    return spark.read.schema(ENTRY).parquet(f"{out_dir}/sent").select("client_id", "seq", "package_name", "tries")
