"""Alert classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailspark.config import Config
from retailspark.functions.numbers import deviation_pct


def classify(df: DataFrame, *, p: str = "prediction", v: str = "v_p", cfg: Config = Config()) -> DataFrame:
    """Add ``percentage_average_deviation``, ``type`` and ``feature``.

    Thresholds are inclusive and tested on the deviation of the (already rounded)
    prediction ``p`` against the historical average ``v`` (NULL -> 0.0):
    ``dev <= deficit_threshold`` -> deficit, ``dev >= superavit_threshold`` ->
    superavit, else none.  ``v <= 0`` gives +Infinity/superavit when p > 0.
    """
    dev = deviation_pct(F.col(p), F.coalesce(F.col(v).cast("double"), F.lit(0.0)))
    out = df.withColumn("percentage_average_deviation", dev)
    d = F.col("percentage_average_deviation")
    typ = (
        F.when(d <= F.lit(cfg.deficit_threshold), F.lit("deficit"))
        .when(d >= F.lit(cfg.superavit_threshold), F.lit("superavit"))
        .otherwise(F.lit("none"))
    )
    return out.withColumn("type", typ).withColumn("feature", F.col("type") != F.lit("none"))
