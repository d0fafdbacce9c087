"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from retailspark.session import ensure_checkpoint_dir

# What runs in Python workers is pickled by value: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder that the cluster names in
    ``spark.checkpoint.dir`` and read it back: the lineage is cut, and a lost
    executor costs a re-read, not a recomputation.  The folder is the cluster's
    scratch space; ``drop_materialized`` removes what this session wrote."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(spark: SparkSession) -> None:
    """Delete this session's intermediate tables.  Call it once the results that
    were built from them have been written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/llm-{spark.sparkContext.applicationId}"


def whole(text: Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(text, F.lit(""))


def unit_hash(key: Column, seed: int) -> Column:
    """Uniform number in [0, 1) from the first 52 bits of md5(seed:key)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n (null key: as empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def bounded_batches(df: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """``df``, after telling the session to hand Python at most ``most_bytes`` at
    once: with the usual count of rows alone, a batch of long texts has no bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key, None)
    if now is None or int(str(now).rstrip("b")) > most_bytes:
        df.sparkSession.conf.set(key, str(most_bytes))
    return df


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(id, text, label) of at most ``rows`` labelled documents of each label, the
    first by hash of the id.  Labels other than 0 and 1 are left out.

    Ids are chosen on the table of labels; texts are only read for those.  An id
    with both labels counts for both, and one of its texts is taken."""
    known = labels.select(F.col(id_col).alias("_sample_id"), F.col(label_col).cast("int").alias("label")).where("_sample_id is not null and label in (0, 1)").distinct()
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("_sample_id"), "_sample_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = materialize(chosen, "labelled-ids")
    # At most 2 * rows ids: a bounded broadcast.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), F.col("id") == F.col("_sample_id")).select("id", "text", "label").dropDuplicates(["id"])


def with_scores(docs: DataFrame, text_col: str, judge: Callable[[list[str]], list[np.ndarray]], fields: list[StructField], also: Column | None = None) -> DataFrame:
    """All columns of ``docs``, untouched, and those that ``judge`` gives for a list
    of texts (null: empty; ``also``, if given, is a second list it gets).  A column
    that has the name of one of ``fields`` is replaced."""
    names = [f.name for f in fields]
    kept = [f for f in docs.schema.fields if f.name.lower() not in {n.lower() for n in names}]
    # By place, so that no name of a column matters.
    inner = [F.col(f"`{f.name}`").alias(f"_{i}") for i, f in enumerate(kept)]
    rows = bounded_batches(docs.select(*inner, whole(F.col(text_col)).alias("text"), (F.lit(None) if also is None else also).alias("also")))
    second = also is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").to_pylist()
            got = judge(texts, batch.column("also").to_pylist()) if second else judge(texts)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [pa.array(x) for x in got], names=[*(f.name for f in kept), *names])

    return rows.mapInArrow(run, StructType([*kept, *fields]))
