"""One regularised linear model per product.

The reference fits by stochastic gradient descent product by product.  Here the
fit is re-aimed to the same objective solved exactly and order-independently:

    minimise  mean(1/2 (y - b - w.x)^2) + alpha/2 |w|^2     (intercept unpenalised)

whose solution only needs the count, the means and the centred co-moments of [x, y]
per product.  Spark computes them for all products in two partial+final aggregations
(a hot product is combined map-side): means first, then sums around them, so no
large sums are subtracted, whatever the size of store ids or counts.  Two such
tables merge pairwise (H3: state + delta, or less what has expired), and the
only Python on executors is a 10x10 solve per product row.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailspark.config import Config, as_date
from retailspark.operators.daily import daily_sales, fill_temperature
from retailspark.operators.features import FEATURE_NAMES, N_FEATURES, feature_matrix
from retailspark.sources.readers import cut_lineage

VARIABLES = [*FEATURE_NAMES, "y"]
DIM = len(VARIABLES)
# Moment layout: the number of rows, the means of [x, y] (11), then the upper
# triangle (row-major, i <= j) of their centred co-moments (66) -> 78 numbers.
TRI = [(i, j) for i in range(DIM) for j in range(i, DIM)]
N_MOMENTS = 1 + DIM + len(TRI)
# Functions of this module run inside Python workers; pickle them by value so
# executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MODEL_TYPE = "ridge_centred"

MODEL_SCHEMA = (
    "barcode string, coef array<double>, n long, error string"
)


def cold_start_flags(products: DataFrame, registry: DataFrame, *, cfg: Config = Config()) -> DataFrame:
    """H1: ``is_cold`` when the product has no registry row, or fewer than
    ``min_examples_cold_start`` accumulated examples (NULL counts as 0)."""
    r = registry.select("barcode", F.col("total_examples").alias("_te"))
    j = products.select("barcode").join(r, "barcode", "left")
    return j.select(
        "barcode",
        F.coalesce(F.col("_te"), F.lit(0)).cast("long").alias("prev_examples"),
        (F.coalesce(F.col("_te"), F.lit(0)) < F.lit(cfg.min_examples_cold_start)).alias("is_cold"),
    )


def training_rows(sales: DataFrame, registry: DataFrame, *, as_of, cfg: Config = Config(), known_barcodes: DataFrame | None = None) -> DataFrame:
    """H1 + A1/A2 + D1/D2 + B4-B6: the (X, y) rows each product trains on.

    Cold products read their whole history up to ``as_of``; warm products only
    ``as_of - training_window_days .. as_of``.  Two scans instead of one
    filtered full scan: the warm branch carries a date predicate that reaches
    the Parquet scan (partition / row-group pruning), the cold branch is a semi
    join with the (small) set of cold barcodes, which AQE removes entirely when
    that set is empty.  The product list is ``known_barcodes`` (e.g. a maintained
    assortment), else the distinct barcodes sold (one column of the whole table).  The temperature fill uses the mean over each product's own
    extracted rows, as the reference does.
    """
    a = as_date(as_of)
    s = sales.filter(F.col("sale_date") <= F.lit(a))
    sold = s if known_barcodes is None else known_barcodes
    flags = cut_lineage(cold_start_flags(sold.select("barcode").distinct(), registry, cfg=cfg))
    warm = flags.filter(~F.col("is_cold")).select("barcode")
    cold = flags.filter(F.col("is_cold")).select("barcode")
    recent = s.filter(F.col("sale_date") >= F.date_sub(F.lit(a), cfg.training_window_days)).join(warm, "barcode", "left_semi")
    full = s.join(cold, "barcode", "left_semi")
    daily = fill_temperature(daily_sales(recent.unionByName(full)))
    m = feature_matrix(daily, training=True, zero_as_missing=cfg.zero_as_missing)
    return m.join(flags, "barcode")


def training_moments(matrix: DataFrame, by: str = "barcode", *also: Column) -> DataFrame:
    """H2: ``by, n, moments ARRAY<DOUBLE>[78]``, the last training date and the
    aggregates of ``also``.  The means are a row a product, written once, which Spark
    broadcasts if they are few."""
    means = cut_lineage(matrix.groupBy(F.col(by).alias("_by")).agg(F.array(*[F.avg(F.col(v).cast("double")) for v in VARIABLES]).alias("_mean")))
    # Distances come first, as columns: 66 sums of whole expressions leave no method that Java compiles.
    off = {f"_d{i}": F.col(v).cast("double") - F.get("_mean", F.lit(i)) for i, v in enumerate(VARIABLES)}
    rows = matrix.join(means, matrix[by].eqNullSafe(F.col("_by"))).withColumns(off)
    d = [F.col(c) for c in off]
    aggs = [F.count(F.lit(1)).alias("n"), F.first("_mean").alias("_mean"), F.array(*[F.sum(x) for x in d]).alias("_rest"), F.array(*[F.sum(d[i] * d[j]) for i, j in TRI]).alias("_sums"), *also]
    if "sale_date" in matrix.columns:
        aggs.append(F.max("sale_date").alias("last_date"))
    sums = rows.groupBy(by).agg(*aggs)
    # What rounding of the means has left.
    rest = lambda i: F.get("_rest", F.lit(i))
    exact = [F.get("_mean", F.lit(i)) + rest(i) / F.col("n") for i in range(DIM)]
    centred = [F.get("_sums", F.lit(k)) - rest(i) * rest(j) / F.col("n") for k, (i, j) in enumerate(TRI)]
    return sums.withColumn("moments", F.array(F.col("n").cast("double"), *exact, *centred)).drop("_mean", "_rest", "_sums")


def less(moments: DataFrame) -> DataFrame:
    """A moment table to take away: merged with one that has its rows, it leaves the others."""
    signed = F.transform("moments", lambda m, k: F.when((k >= 1) & (k <= DIM), m).otherwise(-m))
    return moments.withColumns({"n": -F.col("n"), "moments": signed})


def merge_moments(state: DataFrame, delta: DataFrame, by: str = "barcode") -> DataFrame:
    """H3: the moments of both tables' rows together (full outer on ``by``).  Co-moments
    are merged around the common mean; a ``delta`` of ``less`` takes rows away."""
    a = state.select(by, F.col("n").alias("n_a"), F.col("moments").alias("m_a"), F.col("last_date").alias("d_a"))
    b = delta.select(by, F.col("n").alias("n_b"), F.col("moments").alias("m_b"), F.col("last_date").alias("d_b"))
    j = a.join(b, by, "full_outer")
    zero = F.lit(0).cast("long")
    n_a, n_b = F.coalesce("n_a", zero), F.coalesce("n_b", zero)
    # Floating counts: their product leaves a long at some 10^9 rows.
    share_b = F.when(n_a + n_b != 0, n_b.cast("double") / (n_a + n_b)).otherwise(0.0)
    at = lambda m, k: F.get(m, F.lit(k))
    apart = [at("m_b", 1 + i) - at("m_a", 1 + i) for i in range(DIM)]
    means = [at("m_a", 1 + i) + F.col("_share") * apart[i] for i in range(DIM)]
    spread = F.col("_share") * n_a.cast("double")
    centred = [at("m_a", 1 + DIM + k) + at("m_b", 1 + DIM + k) + spread * apart[i] * apart[j] for k, (i, j) in enumerate(TRI)]
    both = F.array((n_a + n_b).cast("double"), *means, *centred)
    empty = F.array_repeat(F.lit(0.0), N_MOMENTS)
    one = F.coalesce("m_a", "m_b", empty)
    moments = F.when(F.col("m_a").isNull() | F.col("m_b").isNull(), one).when(n_a == 0, F.col("m_b")).when(n_b == 0, F.col("m_a")).when(n_a + n_b == 0, empty).otherwise(both)
    return j.withColumn("_share", share_b).select(by, (n_a + n_b).alias("n"), moments.alias("moments"), F.greatest("d_a", "d_b").alias("last_date"))


def _solve_rows(pdf: pd.DataFrame, alpha: float) -> pd.DataFrame:
    coefs, errors = [], []
    iu = np.triu_indices(DIM)
    for m, n in zip(pdf["moments"], pdf["n"]):
        try:
            if n is None or n <= 0 or m is None:
                raise ValueError("no training rows")
            m = np.asarray(m, dtype=np.float64)
            mu, ybar = m[1:DIM], m[DIM]
            g = np.zeros((DIM, DIM))
            g[iu] = m[1 + DIM :] / float(n)
            g = g + np.triu(g, 1).T
            cov, cxy = g[:-1, :-1], g[:-1, -1]
            w = np.linalg.solve(cov + alpha * np.eye(N_FEATURES), cxy)
            b = ybar - mu @ w
            if not np.all(np.isfinite(w)) or not np.isfinite(b):
                raise ValueError("non-finite solution")
            coefs.append([float(b)] + [float(v) for v in w])
            errors.append(None)
        except (ValueError, np.linalg.LinAlgError) as e:
            coefs.append(None)
            errors.append(str(e))
    return pd.DataFrame({"barcode": pdf["barcode"], "coef": coefs, "n": pdf["n"].astype("int64"), "error": errors})


def solve(moments: DataFrame, *, cfg: Config = Config()) -> DataFrame:
    """H2: per product ``coef = [intercept, w1..w10]``; NULL with ``error`` when
    there are no rows or the system is singular (one bad product never fails the
    job).  One row per product, so the Arrow batches stay small."""
    alpha = cfg.ridge_alpha

    def run(it):
        for pdf in it:
            yield _solve_rows(pdf, alpha)

    return moments.select("barcode", "moments", "n").mapInPandas(run, MODEL_SCHEMA)


def predict(coef: str = "coef") -> Column:
    """Raw linear prediction ``b + w.x`` from the ten feature columns, natively."""
    x = F.array(*[F.col(c).cast("double") for c in FEATURE_NAMES])
    w = F.slice(F.col(coef), 2, N_FEATURES)
    dot = F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return F.element_at(F.col(coef), 1) + dot


def clipped_mse(scored: DataFrame, *, by: str = "barcode", y: str = "y", yhat: str = "yhat") -> DataFrame:
    """``mean((y - max(yhat, 0))^2)`` per ``by``."""
    err = F.col(y) - F.greatest(F.col(yhat), F.lit(0.0))
    return scored.groupBy(by).agg(F.avg(err * err).alias("mse"), F.count(F.lit(1)).alias("n"))


def train_models(sales: DataFrame, registry: DataFrame, *, as_of, cfg: Config = Config(), materialize: bool = True, known_barcodes: DataFrame | None = None) -> DataFrame:
    """H1+H2+D13+D15 for every product at once.

    Returns ``barcode, mode (cold|incremental), n, coef, error, mse, moments,
    last_date``.  Warm products start from a fresh fit on their recent window
    when no stored moments exist (use ``train_incremental`` to carry state).

    The training rows feed three passes (means, moments, then the MSE of the solved
    model) over the days that ``fill_temperature`` has written once to the reliable
    checkpoint directory; with ``materialize`` the moments and the fitted models
    (one row per product) are written there too.
    """
    rows = training_rows(sales, registry, as_of=as_of, cfg=cfg, known_barcodes=known_barcodes)
    mom = training_moments(rows, "barcode", F.max(F.col("is_cold").cast("int")).alias("_cold")).withColumn("last_date", F.lit(as_date(as_of)))
    if materialize:
        mom = cut_lineage(mom)
    models = solve(mom, cfg=cfg)
    if materialize:
        models = cut_lineage(models)
    scored = rows.join(models.select("barcode", "coef"), "barcode").withColumn("yhat", predict("coef"))
    mse = clipped_mse(scored).select("barcode", "mse")
    return (
        mom.join(models.drop("n"), "barcode")
        .join(mse, "barcode", "left")
        .select(
            "barcode",
            F.when(F.col("_cold") == 1, F.lit("cold")).otherwise(F.lit("incremental")).alias("mode"),
            "n", "coef", "error", "mse", "moments", "last_date",
        )
    )


def training_outcomes(products: DataFrame, trained: DataFrame) -> DataFrame:
    """Per product of ``products`` (e.g. the sold barcodes) the outcome of
    a training run: ``cold`` / ``incremental`` with its row count and MSE, or
    ``skipped`` when the product had no training rows (the reference logs and
    skips it)."""
    t = trained.select("barcode", "mode", "n", "mse")
    j = products.select("barcode").distinct().join(t, "barcode", "left")
    return j.select(
        "barcode",
        F.coalesce(F.col("mode"), F.lit("skipped")).alias("outcome"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"),
        "mse",
    )


def registry_state(registry: DataFrame) -> DataFrame:
    """Registry rows as training state: ``barcode, n, moments, last_date,
    total_examples`` (state columns NULL when the registry has none, e.g. a
    registry that only counts examples, or has moments of another type)."""
    cols = {
        "n": "long", "moments": "array<double>", "last_date": "date",
    }
    r = registry
    for c, t in cols.items():
        if c not in r.columns:
            r = r.withColumn(c, F.lit(None).cast(t))
    if "type_model" in r.columns:
        r = r.withColumn("moments", F.when(F.col("type_model") == MODEL_TYPE, F.col("moments")))
    return r.select("barcode", "n", "moments", "last_date", F.col("total_examples").cast("long").alias("total_examples"))


def train_incremental(state: DataFrame, sales: DataFrame, *, as_of, cfg: Config = Config(), allow_overlap: bool = False,
                      materialize: bool = True, known_barcodes: DataFrame | None = None) -> DataFrame:
    """H3: add the rows after each product's high-water date to its stored
    moments and re-solve; rebuild the rest from their full history.

    ``state``: registry rows (``registry_state``).  A product is *warm* when it
    has stored moments, a high-water date and at least
    ``min_examples_cold_start`` examples; every other product that has sales
    is *cold* and is rebuilt from its whole history (its previous examples are
    still added to ``total_examples``, as the reference does).

    Reads: warm rows come from a branch bounded below by the oldest high-water
    date (a scalar subquery; on a table partitioned by ``sale_date`` it prunes
    partitions at run time) and are then cut per product; cold rows come from a
    semi join with the cold barcodes, which AQE drops when there are none.
    ``allow_overlap`` re-reads the reference's fixed recent window instead, so
    rows may be learned twice, as there.  ``known_barcodes`` (e.g. from a
    maintained assortment) replaces the distinct barcodes of the whole sales
    table as the product list.  ``last_date`` of the result is
    ``as_of``: the data is learned through that date.
    """
    a = as_date(as_of)
    st = registry_state(state).withColumnRenamed("total_examples", "prev_examples")
    if materialize:
        st = cut_lineage(st)
    warm = st.filter(
        (F.col("prev_examples") >= F.lit(cfg.min_examples_cold_start)) & F.col("moments").isNotNull() & F.col("last_date").isNotNull()
    )
    s = sales.filter(F.col("sale_date") <= F.lit(a))
    sold = known_barcodes.select("barcode").distinct() if known_barcodes is not None else s.select("barcode").distinct()
    cold = sold.join(warm.select("barcode"), "barcode", "left_anti")
    if materialize:
        cold = cut_lineage(cold)
    if allow_overlap:
        recent = s.filter(F.col("sale_date") >= F.date_sub(F.lit(a), cfg.training_window_days)).join(warm.select("barcode"), "barcode", "left_semi")
    else:
        lo = warm.select(F.min("last_date")).scalar()
        recent = (
            s.filter(F.col("sale_date") > lo)
            .join(warm.select("barcode", F.col("last_date").alias("_hw")), "barcode")
            .filter(F.col("sale_date") > F.col("_hw"))
            .drop("_hw")
        )
    full = s.join(cold, "barcode", "left_semi")
    daily = fill_temperature(daily_sales(recent.unionByName(full)))
    rows = feature_matrix(daily, training=True, zero_as_missing=cfg.zero_as_missing)
    delta = training_moments(rows)
    if materialize:
        delta = cut_lineage(delta)
    merged = merge_moments(warm.select("barcode", "n", "moments", "last_date"), delta)
    if materialize:
        merged = cut_lineage(merged)
    models = solve(merged, cfg=cfg)
    if materialize:
        models = cut_lineage(models)
    scored = rows.join(models.select("barcode", "coef"), "barcode").withColumn("yhat", predict("coef"))
    mse = clipped_mse(scored).select("barcode", "mse")
    new_n = delta.select("barcode", F.col("n").alias("new_examples"))
    return (
        merged.join(models.drop("n"), "barcode")
        .join(new_n, "barcode", "left")
        .join(mse, "barcode", "left")
        .join(st.select("barcode", "prev_examples"), "barcode", "left")
        .select(
            "barcode", "n", "moments", F.lit(a).alias("last_date"), "coef", "error", "mse",
            F.coalesce("new_examples", F.lit(0)).cast("long").alias("new_examples"),
            (F.coalesce("prev_examples", F.lit(0)) + F.coalesce("new_examples", F.lit(0))).cast("long").alias("total_examples"),
        )
    )


def arrivals(sales: DataFrame, *, since_epoch: int, as_of) -> DataFrame:
    """Sales rows of later epochs than ``since_epoch``, dated up to ``as_of``."""
    return sales.filter((F.col("epoch") > F.lit(since_epoch)) & (F.col("sale_date") <= F.lit(as_date(as_of))))


def train_arrivals(state: DataFrame, sales: DataFrame, *, since_epoch: int, as_of, cfg: Config = Config(), materialize: bool = True) -> DataFrame:
    """H3 by arrival: ``train_incremental`` for a sales table with ``epoch``.

    What arrived since the last run touches some (store, barcode, date) keys, new
    or old.  The days of just those keys are computed with and without the new
    rows, and the difference of their moments is added to the stored ones, so the
    result is that of a refit over everything received, whenever it came.  A
    product without stored moments has all its rows among the arrivals of its
    first run (``since_epoch`` before the first epoch), so no run re-reads history.

    Reads: the new epochs, and of older ones the dates that were touched (a join on
    the partition column).  A missing temperature is filled from the rows read, as
    in every incremental mode."""
    a = as_date(as_of)
    keys = ["store_id", "barcode", "sale_date"]
    st = registry_state(state).withColumnRenamed("total_examples", "prev_examples")
    touched = arrivals(sales, since_epoch=since_epoch, as_of=as_of).select(*keys).distinct()
    if materialize:
        touched = cut_lineage(touched)
    dates = touched.select("sale_date").distinct()
    around = sales.join(F.broadcast(dates), "sale_date").join(touched, keys, "left_semi")  # at most a row a day
    if materialize:
        around = cut_lineage(around)

    def rows_of(part: DataFrame) -> DataFrame:
        return feature_matrix(fill_temperature(daily_sales(part)), training=True, zero_as_missing=cfg.zero_as_missing)

    after = rows_of(around)
    plus = training_moments(after)
    minus = training_moments(rows_of(around.filter(F.col("epoch") <= F.lit(since_epoch))))
    if materialize:
        plus, minus = cut_lineage(plus), cut_lineage(minus)
    kept = st.filter(F.col("moments").isNotNull()).select("barcode", "n", "moments", "last_date")
    # First the rows that change are taken away, then they come as they are now.
    merged = merge_moments(merge_moments(kept, less(minus)), plus)
    delta = plus.select("barcode", "n").unionByName(less(minus).select("barcode", "n")).groupBy("barcode").agg(F.sum("n").alias("n"))
    if materialize:
        merged = cut_lineage(merged)
    models = solve(merged, cfg=cfg)
    if materialize:
        models = cut_lineage(models)
    scored = after.join(models.select("barcode", "coef"), "barcode").withColumn("yhat", predict("coef"))
    mse = clipped_mse(scored).select("barcode", "mse")
    return (
        merged.join(models.drop("n"), "barcode")
        .join(delta.select("barcode", F.col("n").alias("new_examples")), "barcode", "left")
        .join(mse, "barcode", "left")
        .join(st.select("barcode", "prev_examples"), "barcode", "left")
        .select(
            "barcode", "n", "moments", F.lit(a).alias("last_date"), "coef", "error", "mse",
            F.coalesce("new_examples", F.lit(0)).cast("long").alias("new_examples"),
            (F.coalesce("prev_examples", F.lit(0)) + F.coalesce("new_examples", F.lit(0))).cast("long").alias("total_examples"),
        )
    )


def upsert_registry(registry: DataFrame, trained: DataFrame, *, as_of) -> DataFrame:
    """Trained products replace coef / last_mse / last_update (and the
    training state ``moments, n, last_date`` when given) and add their new
    examples to ``total_examples``; untouched products keep their row; new
    products are inserted.  ``trained``: ``barcode, coef, mse, new_examples``
    [+ ``moments, n, last_date``]."""
    # date -> timestamp_ntz is independent of the session time zone
    ts = F.lit(as_date(as_of)).cast("timestamp_ntz")
    kept = [c for c in ("coef", "last_mse", "last_update", "moments", "n", "last_date") if c in registry.columns]
    r = registry.select("barcode", F.col("total_examples").alias("r_total"), *[F.col(c).alias(f"r_{c}") for c in kept])
    state_cols = [c for c in ("moments", "n", "last_date") if c in trained.columns]
    t = trained.select(
        "barcode", F.col("coef").alias("t_coef"), F.col("mse").alias("t_mse"), F.col("new_examples").alias("t_new"),
        *[F.col(c).alias(f"t_{c}") for c in state_cols],
    )
    j = r.join(t, "barcode", "full_outer")
    hit = F.col("t_new").isNotNull()
    old = lambda c, typ: F.col(f"r_{c}") if f"r_{c}" in r.columns else F.lit(None).cast(typ)
    state = []
    for c, typ in (("moments", "array<double>"), ("n", "long"), ("last_date", "date")):
        if c in state_cols or f"r_{c}" in r.columns:
            new = F.col(f"t_{c}") if c in state_cols else F.lit(None).cast(typ)
            state.append(F.when(hit, new).otherwise(old(c, typ)).alias(c))
    return j.select(
        "barcode",
        F.when(hit, F.col("t_coef")).otherwise(old("coef", "array<double>")).alias("coef"),
        F.when(hit, F.col("t_mse")).otherwise(old("last_mse", "double")).alias("last_mse"),
        F.when(hit, ts).otherwise(old("last_update", "timestamp_ntz")).alias("last_update"),
        (F.coalesce("r_total", F.lit(0)) + F.coalesce("t_new", F.lit(0))).cast("long").alias("total_examples"),
        F.lit(MODEL_TYPE).alias("type_model"),
        *state,
    )
