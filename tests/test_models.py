import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from retailspark.config import Config
from retailspark.operators import models as MD
from retailspark.operators.features import FEATURE_NAMES
from retailspark.operators.scoring import replace_keyed

AS_OF = dt.date(2001, 7, 1)


def _matrix(spark, n=200, seed=1, barcode="p1"):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 10))
    x[:, 9] = 3.0  # constant store id, as for single-store products
    w = np.arange(1, 11) / 10.0
    y = 4.0 + x @ w + rng.normal(scale=0.1, size=n)
    rows = [(barcode, *map(float, xi), float(yi)) for xi, yi in zip(x, y)]
    schema = "barcode string, " + ", ".join(f"{c} double" for c in FEATURE_NAMES) + ", y double"
    return spark.createDataFrame(rows, schema), x, y


def _ridge(x, y, alpha):
    mu, ybar = x.mean(0), y.mean()
    xc, yc = x - mu, y - ybar
    w = np.linalg.solve(xc.T @ xc / len(y) + alpha * np.eye(x.shape[1]), xc.T @ yc / len(y))
    return np.concatenate([[ybar - mu @ w], w])


def test_solve_matches_numpy_ridge(spark):
    df, x, y = _matrix(spark)
    coef = MD.solve(MD.training_moments(df), cfg=Config(ridge_alpha=1e-4)).first().coef
    np.testing.assert_allclose(coef, _ridge(x, y, 1e-4), rtol=1e-7, atol=1e-8)


def test_moments_are_additive(spark):
    df, _, _ = _matrix(spark, n=120)
    a = df.limit(50)
    b = df.subtract(a)
    with_date = lambda d: d.withColumn("sale_date", F.lit(AS_OF))
    merged = MD.merge_moments(MD.training_moments(with_date(a)), MD.training_moments(with_date(b))).first()
    whole = MD.training_moments(with_date(df)).first()
    assert merged.n == whole.n == 120
    np.testing.assert_allclose(merged.moments, whole.moments, rtol=1e-9, atol=1e-9)


def test_moments_of_large_ids_and_counts_stay_exact(spark):
    """Store ids near 10^6, merged until 10^9 rows: coefficients as numpy finds them on centred data."""
    rng = np.random.default_rng(7)
    n = 4000
    x = rng.normal(size=(n, 10))
    x[:, 9] = 1_000_000 + rng.integers(0, 50, n)
    y = 4.0 + x @ (np.arange(1, 11) / 10.0) + rng.normal(scale=0.1, size=n)
    schema = "barcode string, part int, sale_date date, " + ", ".join(f"{c} double" for c in FEATURE_NAMES) + ", y double"
    df = spark.createDataFrame([("p", i % 3, AS_OF, *map(float, x[i]), float(y[i])) for i in range(n)], schema).repartition(7)
    parts = [MD.training_moments(df.where(f"part = {k}")) for k in range(3)]
    want = _ridge(x, y, 1e-4)
    total = MD.merge_moments(MD.merge_moments(parts[0], parts[1]), parts[2])
    np.testing.assert_allclose(MD.solve(total).first().coef, want, rtol=1e-9)
    big = total
    for _ in range(18):  # the same rows again and again: 4000 * 2^18 rows
        big = spark.createDataFrame(MD.merge_moments(big, big).collect(), big.select("barcode", "n", "moments", "last_date").schema)
    row = big.first()
    assert row.n == n * 2**18 > 10**9 and row.moments[0] == row.n
    np.testing.assert_allclose(MD.solve(big).first().coef, want, rtol=1e-9)
    # Rows that expire leave the others; all of them leave nothing.
    left = MD.merge_moments(MD.merge_moments(total, MD.less(parts[1])), MD.less(parts[0]))
    keep = np.arange(n) % 3 == 2
    np.testing.assert_allclose(MD.solve(left).first().coef, _ridge(x[keep], y[keep], 1e-4), rtol=1e-8)
    assert MD.merge_moments(left, MD.less(parts[2])).first().moments == [0.0] * MD.N_MOMENTS


def test_moments_of_another_type_are_learned_anew(spark):
    reg = spark.createDataFrame([("a", 90, 5, [1.0] * 78, AS_OF, "ridge_moments"), ("b", 90, 5, [1.0] * 78, AS_OF, MD.MODEL_TYPE)],
                                "barcode string, total_examples long, n long, moments array<double>, last_date date, type_model string")
    assert {r.barcode: r.moments is None for r in MD.registry_state(reg).collect()} == {"a": True, "b": False}


def test_no_rows_gives_error_not_failure(spark):
    m = spark.createDataFrame([("p", 0, [0.0] * MD.N_MOMENTS)], "barcode string, n long, moments array<double>")
    r = MD.solve(m).first()
    assert r.coef is None and "no training rows" in r.error


def test_predict_and_clipped_mse(spark):
    df, _, _ = _matrix(spark, n=10)
    coef = [1.0] + [0.0] * 10
    s = df.withColumn("coef", F.array(*[F.lit(c) for c in coef])).withColumn("yhat", MD.predict("coef") - F.lit(2.0))
    r = MD.clipped_mse(s).first()
    ys = [row.y for row in df.collect()]
    assert abs(r.mse - np.mean([(y - 0.0) ** 2 for y in ys])) < 1e-9


def test_replace_keyed(spark):
    old = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 3)], "store_id int, barcode string, v int")
    new = spark.createDataFrame([(1, "b", 9)], "store_id int, barcode string, v int")
    assert sorted(tuple(r) for r in replace_keyed(old, new).collect()) == [(1, "a", 1), (1, "b", 9)]


def test_upsert_registry(spark):
    reg = spark.createDataFrame([("a", 10), ("b", 40)], "barcode string, total_examples long")
    tr = spark.createDataFrame([("a", [1.0], 2.0, 5), ("c", [2.0], 3.0, 7)], "barcode string, coef array<double>, mse double, new_examples long")
    out = {r.barcode: r for r in MD.upsert_registry(reg, tr, as_of=AS_OF).collect()}
    assert out["a"].total_examples == 15 and out["a"].last_mse == 2.0 and out["a"].last_update == dt.datetime(2001, 7, 1)
    assert out["b"].total_examples == 40 and out["b"].last_mse is None
    assert out["c"].total_examples == 7


def test_cold_start_flags(spark):
    prods = spark.createDataFrame([("a",), ("b",), ("c",)], "barcode string")
    reg = spark.createDataFrame([("a", 29), ("b", 30)], "barcode string, total_examples long")
    f = {r.barcode: r.is_cold for r in MD.cold_start_flags(prods, reg).collect()}
    assert f == {"a": True, "b": False, "c": True}


def test_daily_job_two_days_continues_warm_products(spark):
    from retailspark.plans.forecast import daily_forecast
    from retailspark.sources import fixtures as FX

    sf = "/root/testdata/sf0.001"
    common = dict(sales=FX.sales(spark, sf), stores=FX.stores(spark, sf), products=FX.products(spark, sf),
                  forecast_payloads=FX.forecast_payloads(spark, sf))
    d0 = AS_OF - dt.timedelta(days=30)
    day1 = daily_forecast(**common, registry=FX.registry_state(spark, sf), old_predictions=FX.predictions(spark, sf), as_of=d0)
    reg1 = {r.barcode: r for r in day1["registry"].collect()}
    assert all(r.last_date == d0 for r in reg1.values() if r.moments is not None)
    day2 = daily_forecast(**common, registry=day1["registry"], old_predictions=day1["predictions"], as_of=AS_OF)
    reg2 = {r.barcode: r for r in day2["registry"].collect()}
    new_rows = {r.barcode: r.n for r in MD.training_moments(
        MD.training_rows(FX.sales(spark, sf).filter(F.col("sale_date") > F.lit(d0)),
                         spark.createDataFrame([], "barcode string, total_examples long"), as_of=AS_OF)).collect()}
    for b, r in reg2.items():
        if reg1[b].moments is not None and reg1[b].total_examples >= 30:
            # warm: only the days after the high-water date were added
            assert r.n == reg1[b].n + new_rows.get(b, 0)
            assert r.total_examples == reg1[b].total_examples + new_rows.get(b, 0)
    assert day2["predictions"].count() > 0


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.integers(1, 3), st.sampled_from("abc"), st.integers(0, 9)), max_size=12),
    st.lists(st.tuples(st.integers(1, 3), st.sampled_from("abc"), st.integers(10, 19)), max_size=6),
)
def test_replace_keyed_matches_dict_update(spark, old_rows, new_rows):
    """A11 against a plain dict update keyed by (store, barcode)."""
    schema = "store_id int, barcode string, v int"
    got = sorted(tuple(r) for r in replace_keyed(spark.createDataFrame(old_rows, schema), spark.createDataFrame(new_rows, schema)).collect())
    by_key = {}
    for s, b, v in old_rows:
        by_key.setdefault((s, b), []).append(v)
    fresh = {}
    for s, b, v in new_rows:
        fresh.setdefault((s, b), []).append(v)
    by_key.update(fresh)
    want = sorted((s, b, v) for (s, b), vs in by_key.items() for v in vs)
    assert got == want


def test_assortment_update_equals_full(spark):
    from retailspark.operators.scoring import assortment, update_assortment
    from retailspark.sources import fixtures as FX

    sales = FX.sales(spark, "/root/testdata/sf0.001")
    d0 = AS_OF - dt.timedelta(days=90)
    upd = update_assortment(assortment(sales, as_of=d0), sales, since=d0, as_of=AS_OF)
    full = assortment(sales, as_of=AS_OF)
    assert sorted(tuple(r) for r in upd.collect()) == sorted(tuple(r) for r in full.collect())


def test_models_beat_the_mean_predictor(spark):
    """Sanity of the fitted models: on its training rows each product's clipped
    MSE is at most the variance of y (the MSE of predicting the mean)."""
    from retailspark.sources import fixtures as FX

    sf = "/root/testdata/sf0.01"
    sales = FX.sales(spark, sf)
    none = spark.createDataFrame([], "barcode string, total_examples long")
    fit = {r.barcode: r for r in MD.train_models(sales, none, as_of=AS_OF).collect()}
    rows = MD.training_rows(sales, none, as_of=AS_OF)
    var = {r.barcode: r.v for r in rows.groupBy("barcode").agg(F.var_pop("y").alias("v"), F.count("*").alias("n")).filter("n > 100").collect()}
    assert var
    for b, v in var.items():
        assert fit[b].coef is not None and fit[b].mse <= v * (1 + 1e-9), (b, fit[b].mse, v)


def _sales_rows(spark, rows):
    return spark.createDataFrame(rows, "epoch int, store_id int, barcode string, sale_date date, amount int, temperature double, weather_resume_wmo_code int")


def _some_sales():
    import datetime as dt
    import random

    rng, rows = random.Random(3), []
    for day in range(60):
        d = dt.date(2024, 1, 1) + dt.timedelta(days=day)
        for b in ("x", "y"):
            for s in (1, 2):
                late = s == 2 and 20 <= day < 40  # this store was offline; its rows come in epoch 2
                rows.append((2 if late else (0 if day < 30 else 1), s, b, d, rng.randint(1, 30), rng.uniform(5, 35), rng.choice([0, 61, 95])))
    rows.append((2, 1, "x", dt.date(2024, 1, 5), 7, 12.0, 0))  # one more line of a day already learned
    rows += [(2, 3, "z", dt.date(2024, 1, 1) + dt.timedelta(days=i), 5 + i % 7, 20.0 + i % 5, 0) for i in range(40)]  # a product all of whose rows are late
    return rows


def test_training_by_arrival_equals_a_full_refit(spark):
    import datetime as dt

    from retailspark.operators import models as MD

    as_of = dt.date(2024, 3, 1)
    sales = _sales_rows(spark, _some_sales())
    state = spark.createDataFrame([], "barcode string, total_examples long")
    for since in (-1, 0, 1):
        step = MD.train_arrivals(state, sales.where(f"epoch <= {since + 1}"), since_epoch=since, as_of=as_of)
        state = step.select("barcode", "n", "moments", "last_date", "total_examples")
    full = MD.train_arrivals(spark.createDataFrame([], "barcode string, total_examples long"), sales, since_epoch=-1, as_of=as_of)
    got, want = ({r.barcode: r for r in df.collect()} for df in (step, full))
    assert set(got) == set(want) == {"x", "y", "z"}
    for b in want:
        assert got[b].n == want[b].n == got[b].total_examples
        assert np.allclose(got[b].moments, want[b].moments, rtol=1e-9, atol=1e-8) and np.allclose(got[b].coef, want[b].coef, rtol=1e-6, atol=1e-8)


def test_daily_job_learns_and_scores_late_arrivals(spark):
    import datetime as dt

    from retailspark.plans.forecast import daily_forecast

    sales = _sales_rows(spark, _some_sales())
    stores = spark.createDataFrame([(1,), (2,), (3,)], "store_id int")
    products = spark.createDataFrame([(b, b, "c", "i") for b in "xyz"], "barcode string, product_name string, category string, image_url string")
    payloads = spark.createDataFrame([], "store_id int, start_date date, temperature_2m_max array<double>, temperature_2m_min array<double>, weather_code array<int>")
    old = spark.createDataFrame([], "store_id int, barcode string, objective_date date, product_name string, category string, image_url string, prediction int, feature boolean, type string, percentage_average_deviation double")
    common = dict(stores=stores, products=products, forecast_payloads=payloads, old_predictions=old)
    day1 = daily_forecast(**common, sales=sales.where("epoch <= 1"), registry=spark.createDataFrame([], "barcode string, total_examples long"), as_of=dt.date(2024, 3, 1))
    day2 = daily_forecast(**common, sales=sales, registry=day1["registry"], as_of=dt.date(2024, 3, 2), assortment=day1["assortment"], since_epoch=1)
    assert {(r.store_id, r.barcode) for r in day2["assortment"].collect()} == {(s, b) for s in (1, 2) for b in "xy"} | {(3, "z")}
    assert {r.barcode for r in day2["new_predictions"].collect()} == {"x", "y", "z"}
    assert {r.last_date for r in day2["registry"].collect()} == {dt.date(2024, 3, 2)}
    with pytest.raises(ValueError):
        daily_forecast(**common, sales=sales, registry=day1["registry"], as_of=dt.date(2024, 3, 2), assortment=day1["assortment"])


def test_unsold_product_does_not_hold_the_read_back(spark):
    import datetime as dt

    from retailspark.plans.forecast import daily_forecast

    rows = [r[1:] for r in _some_sales() if r[0] < 2]
    sales = spark.createDataFrame([r for r in rows if r[1] == "x" or r[2] < dt.date(2024, 2, 1)], "store_id int, barcode string, sale_date date, amount int, temperature double, weather_resume_wmo_code int")
    common = dict(
        sales=sales, stores=spark.createDataFrame([(1,), (2,)], "store_id int"),
        products=spark.createDataFrame([(b, b, "c", "i") for b in "xy"], "barcode string, product_name string, category string, image_url string"),
        forecast_payloads=spark.createDataFrame([], "store_id int, start_date date, temperature_2m_max array<double>, temperature_2m_min array<double>, weather_code array<int>"),
        old_predictions=spark.createDataFrame([], "store_id int, barcode string, objective_date date, product_name string, category string, image_url string, prediction int, feature boolean, type string, percentage_average_deviation double"),
    )
    day1 = daily_forecast(**common, registry=spark.createDataFrame([], "barcode string, total_examples long"), as_of=dt.date(2024, 2, 10))
    day2 = daily_forecast(**common, registry=day1["registry"], as_of=dt.date(2024, 2, 20), assortment=day1["assortment"], assortment_as_of=dt.date(2024, 2, 10))
    assert {r.barcode: r.last_date for r in day2["registry"].collect()} == {"x": dt.date(2024, 2, 20), "y": dt.date(2024, 2, 20)}


def test_rows_a_product_are_broadcast_not_sorted(spark):
    """Few products of many rows: no join sends a product's rows to one task."""
    from retailspark.operators.daily import daily_sales, fill_temperature
    from retailspark.operators.features import feature_matrix

    sales = spark.range(200_000).selectExpr(
        "cast(id % 50 as int) store_id", "concat('p', id % 3) barcode", "date_add(date'2001-01-01', cast(id % 97 as int)) sale_date",
        "cast(id % 9 as int) amount", "if(id % 7 = 0, null, cast(id % 30 as double)) temperature", "cast(id % 12 as int) weather_resume_wmo_code")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50KB")
    try:
        filled = fill_temperature(daily_sales(sales))
        moments = MD.training_moments(feature_matrix(filled, training=True))
        for df in (filled, moments):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert moments.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
