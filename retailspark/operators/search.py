"""Search index of product names (B11, F3): posting lists of three letters.

Each text (a normalised name, a lower-cased barcode) is listed under every three
letters in a row that it holds.  A search reads only the lists of its own letters,
keeps the texts that are in all of them, and verifies the substring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailspark.functions.text import normalize_text

GRAM = 3
#: Folders of the index; a list lies in one of them.
BUCKETS = 64
INDEX = "gram string, text string, barcode string, product_name string, bucket int"


def _bucket(gram):
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def posting_lists(products: DataFrame) -> DataFrame:
    """``gram, text, barcode, product_name``: a row for each product (a distinct
    pair of barcode and name), each of its texts and each gram of that.  Texts of
    fewer letters have no gram: no search of three letters can find them."""
    entries = products.select("barcode", "product_name").distinct()
    texts = F.array_distinct(F.array(normalize_text(F.col("product_name")), F.lower(F.coalesce("barcode", F.lit("")))))
    rows = entries.select("barcode", "product_name", F.explode(texts).alias("text")).where(F.length("text") >= GRAM)
    starts = F.sequence(F.lit(1), F.length("text") - (GRAM - 1))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substr("text", i, F.lit(GRAM))))
    return rows.select(F.explode(grams).alias("gram"), "text", "barcode", "product_name")


def write_index(products: DataFrame, path: str) -> None:
    """Posting lists in folders by hash of the gram, sorted by it within a file.  Names are
    few beside alerts; write it anew when products change."""
    lists = posting_lists(products).withColumn("bucket", _bucket("gram"))
    lists.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def matching_products(index: DataFrame, text: str) -> DataFrame:
    """The products (``barcode``, ``product_name``) one of whose texts holds ``text``, which
    is normalised and has at least three letters.  Folders and grams are filtered in
    the scan."""
    if len(text) < GRAM:
        raise ValueError(f"a search by index needs {GRAM} letters")
    grams = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
    spark = index.sparkSession
    buckets = sorted({r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket("gram")).collect()})
    lists = index.where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    # A text is in a list once for each product.
    in_all = lists.groupBy("text", "barcode", "product_name").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") == len(grams)) & (F.locate(text, F.col("text")) > 0))
    return in_all.select("barcode", "product_name").distinct()
