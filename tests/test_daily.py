import datetime as dt

from retailspark.config import Config
from retailspark.operators import daily as D

AS_OF = dt.date(2001, 7, 1)
SALES = "store_id int, barcode string, sale_date date, amount int, temperature double, weather_resume_wmo_code int"


def test_mode_lowest_code_wins_ties(spark):
    d = dt.date(2001, 1, 1)
    # internal codes 2,1,2,1,3  (WMO 3,1,3,2,51) -> tie between 1 and 2 -> 1
    rows = [(1, "a", d, 1, 10.0, 3), (1, "a", d, 2, None, 1), (1, "a", d, 3, 20.0, 3), (1, "a", d, 4, None, 2), (1, "a", d, 5, None, 51)]
    r = D.daily_sales(spark.createDataFrame(rows, SALES)).collect()
    assert len(r) == 1
    assert r[0].amount == 15 and r[0].temperature == 15.0 and r[0].weather_code == 1


def test_null_wmo_counts_as_one(spark):
    d = dt.date(2001, 1, 1)
    rows = [(1, "a", d, 1, None, None), (1, "a", d, 1, None, None), (1, "a", d, 1, None, 0)]
    assert D.daily_sales(spark.createDataFrame(rows, SALES)).first().weather_code == 1


def test_fill_temperature(spark):
    rows = [(1, "a", dt.date(2001, 1, 1), 1, 10.0, 1), (1, "a", dt.date(2001, 1, 2), 1, None, 1), (2, "a", dt.date(2001, 1, 3), 1, 20.0, 1),
            (1, "b", dt.date(2001, 1, 1), 1, None, 1)]
    out = {(r.store_id, r.barcode, r.sale_date.day): r.temperature for r in D.fill_temperature(D.daily_sales(spark.createDataFrame(rows, SALES))).collect()}
    assert out[(1, "a", 2)] == 15.0
    assert out[(1, "b", 1)] == 22.0


def test_historical_average_window(spark):
    rows = [
        (1, "a", AS_OF - dt.timedelta(days=30), 4, None, 1),
        (1, "a", AS_OF - dt.timedelta(days=10), 3, None, 1),
        (1, "a", AS_OF - dt.timedelta(days=10), 3, None, 1),
        (1, "a", AS_OF - dt.timedelta(days=31), 100, None, 1),
        (1, "a", AS_OF + dt.timedelta(days=1), 100, None, 1),
    ]
    r = D.historical_average(spark.createDataFrame(rows, SALES), as_of=AS_OF).collect()
    assert len(r) == 1 and r[0].v_p == 5.0 and r[0].n_days == 2


def test_recent_sales_zero_days_falls_back(spark):
    rows = [(1, "a", AS_OF - dt.timedelta(days=k), 1, None, 1) for k in range(0, 5)]
    df = spark.createDataFrame(rows, SALES)
    assert D.recent_sales(df, as_of=AS_OF, days=0).count() == 3
    assert D.recent_sales(df, as_of=AS_OF, days=None, cfg=Config(training_window_days=4)).count() == 5


def test_rolling_average_equals_the_window_of_each_day(spark):
    import datetime as dt
    import random

    from retailspark.config import Config

    rng, cfg, start = random.Random(5), Config(history_days=7), dt.date(2024, 1, 1)
    rows = [(s, b, start + dt.timedelta(days=d), rng.choice([None, 1, 2, 5])) for d in range(60) for s in (1, 2) for b in "xyz" if rng.random() < 0.5 for _ in range(rng.randint(1, 3))]
    sales = spark.createDataFrame(rows, "store_id int, barcode string, sale_date date, amount int")
    of = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    since = start + dt.timedelta(days=3)
    totals = D.history_totals(sales, as_of=since, cfg=cfg)
    for step in [1] * 8 + [3, 9, 20]:  # the last ones leave the whole window behind
        as_of = since + dt.timedelta(days=step)
        totals = D.advance_history(totals, sales, since=since, as_of=as_of, cfg=cfg)
        totals = spark.createDataFrame(totals.collect(), totals.schema)
        since = as_of
        assert of(D.average_of(totals)) == of(D.historical_average(sales, as_of=as_of, cfg=cfg))
    # Through forty successive days the state alone goes on.
    days = [start + dt.timedelta(days=n) for n in range(8, 48)]
    units = {}
    for s, b, d, n in rows:
        units[(s, b, d)] = units.get((s, b, d), 0) + (n or 0)
    state = {(r.store_id, r.barcode): (r.units, r.n_days) for r in D.history_totals(sales, as_of=days[0], cfg=cfg).collect()}
    for day in days[1:]:
        came, left = day, day - dt.timedelta(days=8)
        for (s, b, d), n in units.items():
            if d in (came, left):
                u, k = state.get((s, b), (0, 0))
                state[(s, b)] = (u + n, k + 1) if d == came else (u - n, k - 1)
    assert {k: v for k, v in state.items() if v[1]} == {(r.store_id, r.barcode): (r.units, r.n_days) for r in D.history_totals(sales, as_of=days[-1], cfg=cfg).collect()}


def test_a_day_of_rolling_average_reads_two_dates(spark, tmp_path):
    import datetime as dt

    start = dt.date(2024, 1, 1)
    rows = [(1, "x", start + dt.timedelta(days=d), d) for d in range(50)]
    spark.createDataFrame(rows, "store_id int, barcode string, sale_date date, amount int").write.partitionBy("sale_date").parquet(f"{tmp_path}/sales")
    sales = spark.read.parquet(f"{tmp_path}/sales")
    since = start + dt.timedelta(days=40)
    totals = D.history_totals(sales, as_of=since)
    state = spark.createDataFrame(totals.collect(), totals.schema)
    df = D.advance_history(state, sales, since=since, as_of=since + dt.timedelta(days=1))
    files = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in files and df.first().units == sum(range(11, 42))
    read = sales.where((sales.sale_date == since + dt.timedelta(days=1)) | (sales.sale_date == since - dt.timedelta(days=30)))
    assert read.count() == 2


def test_history_cannot_go_back(spark):
    import datetime as dt

    import pytest

    sales = spark.createDataFrame([], "store_id int, barcode string, sale_date date, amount int")
    with pytest.raises(ValueError):
        D.advance_history(D.history_totals(sales, as_of=dt.date(2024, 1, 2)), sales, since=dt.date(2024, 1, 2), as_of=dt.date(2024, 1, 1))


def test_days_are_aggregated_by_hash(spark):
    plan = D.daily_sales(spark.createDataFrame([], SALES))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
