"""From raw documents to a training mixture.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns the documents that its stage keeps, with the columns of ``documents``
(the last adds ``mix_copy``).  ``run`` applies them in order; each result is
written as Parquet into the shared scratch folder and read again, so a lost
executor costs no more than its stage.

Rows may have nulls in any column, empty texts and repeated ids; an empty table
stays empty.  What each stage does with them is in its operator's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailspark.llm import decontaminate, mixing, neardup, secrets, toxicity
from retailspark.llm.common import crc_mod, materialize, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold.  Learned from the labels
    but for a fifth, on which the operator's accuracy is measured."""
    labels = read_table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model, out="_toxicity").where(F.col("_toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that with the smallest id."""
    return neardup.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark, parameters changed or not."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets masked and ``n_chars`` that of the masked text."""
    return secrets.redact(docs, length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each time that a document is taken, with ``mix_copy``."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]

#: Boosted trees and ProbMinHash can't be said in SQL; the tests check the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
