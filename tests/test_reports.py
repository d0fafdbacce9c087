import datetime as dt

from retailspark.operators import reports as RP

AS_OF = dt.date(2001, 7, 1)
PRED = ("store_id int, barcode string, product_name string, category string, image_url string, objective_date date, "
        "prediction int, feature boolean, type string, percentage_average_deviation double")


def _p(store, bc, day, dev, feature=True, typ="deficit", cat="C", name="n"):
    return (store, bc, name, cat, None, AS_OF + dt.timedelta(days=day), 1, feature, typ, dev)


def test_upcoming_bounds_and_defaults(spark):
    rows = [_p(1, "a", -1, 1.0), _p(1, "a", 0, 1.0), _p(1, "a", 7, None, cat=None, name=None), _p(1, "a", 8, 1.0)]
    up = RP.upcoming_predictions(spark.createDataFrame(rows, PRED), as_of=AS_OF).collect()
    assert sorted(r.objective_date for r in up) == [AS_OF, AS_OF + dt.timedelta(days=7)]
    last = [r for r in up if r.objective_date != AS_OF][0]
    assert last.product_name == "Producto Desconocido" and last.category == "Sin categoría" and last.percentage_average_deviation == 0.0


def test_worst_case_tie_goes_to_earlier_date(spark):
    rows = [_p(1, "a", 2, -30.0), _p(1, "a", 1, 30.0), _p(1, "b", 1, None, feature=False, typ="none"), _p(1, "b", 2, -0.5, feature=False, typ="none")]
    up = RP.upcoming_predictions(spark.createDataFrame(rows, PRED), as_of=AS_OF)
    w = {r.barcode: r for r in RP.worst_case_rows(up).collect()}
    assert w["a"].objective_date == AS_OF + dt.timedelta(days=1)
    assert w["b"].percentage_average_deviation == -0.5
    assert w["a"].summary_rank == 1 and w["b"].summary_rank == 2


def test_worst_case_prefers_featured_on_equal_deviation(spark):
    rows = [_p(1, "a", 1, 20.0, feature=False, typ="none"), _p(1, "a", 2, -20.0, feature=True)]
    w = RP.worst_case_rows(RP.upcoming_predictions(spark.createDataFrame(rows, PRED), as_of=AS_OF)).first()
    assert w.feature and w.objective_date == AS_OF + dt.timedelta(days=2)


def test_top_alerts_k(spark):
    rows = [_p(1, f"b{i:02d}", d, float(i * 10 + d)) for i in range(12) for d in (0, 1)]
    rows += [_p(1, "zz", 0, 999.0, feature=False, typ="none")]
    top = RP.top_alerts(RP.upcoming_predictions(spark.createDataFrame(rows, PRED), as_of=AS_OF), k=10).collect()
    assert len(top) == 10 and len({r.barcode for r in top}) == 10
    best = sorted(top, key=lambda r: r.alert_rank)[0]
    assert best.barcode == "b11" and best.percentage_average_deviation == 111.0


def test_category_breakdown_unknown_type_is_neutral(spark):
    rows = [_p(1, "a", 0, -20.0), _p(1, "b", 0, 5.0, typ="weird", feature=False), _p(1, "c", 0, 30.0, typ="superavit"), _p(1, "d", 0, 1.0, cat="D", typ="none", feature=False)]
    up = RP.upcoming_predictions(spark.createDataFrame(rows, PRED), as_of=AS_OF)
    b = {r.category: r for r in RP.category_breakdown(RP.worst_case_rows(up)).collect()}
    c = b["C"]
    assert (c.total_products, c.deficit_count, c.superavit_count, c.neutral_count, c.featured_count) == (3, 1, 1, 1, 2)
    assert c.category_rank == 1 and b["D"].category_rank == 2


def test_weekly_stats_and_empty_store(spark):
    rows = [_p(1, "a", 0, -20.0), _p(1, "a", 1, 30.0, typ="superavit"), _p(1, "b", 2, 0.0, typ="none", feature=False)]
    up = RP.upcoming_predictions(spark.createDataFrame(rows, PRED), as_of=AS_OF)
    st = RP.weekly_stats(up).first()
    assert (st.total_prediction_rows, st.deficit_rows, st.superavit_rows, st.neutral_rows, st.featured_rows) == (3, 1, 1, 1, 2)
    assert (st.unique_products, st.unique_featured_products, st.deficit_products, st.superavit_products, st.neutral_products) == (2, 1, 0, 1, 1)
    stores = spark.createDataFrame([(1,), (2,)], "store_id int")
    allst = {r.store_id: r for r in RP.weekly_stats_all(stores, RP.weekly_stats(up), as_of=AS_OF).collect()}
    assert allst[2].total_prediction_rows == 0 and allst[2].date_range_end == AS_OF + dt.timedelta(days=7) and allst[2].is_empty


def test_active_stores(spark):
    rows = [(1, "o", " a@b.mx\t", "c"), (2, "o", "   ", "c"), (3, "o", None, "c"), (4, "o", "nope", "c")]
    r = RP.active_stores(spark.createDataFrame(rows, "store_id int, owner_name string, email string, city string")).collect()
    assert [(x.store_id, x.email) for x in r] == [(1, "a@b.mx")]


def test_digest_alert_block_absent_when_empty(spark):
    rows = [_p(1, "a", 0, 1.0, feature=False, typ="none")]
    up = RP.upcoming_predictions(spark.createDataFrame(rows, PRED), as_of=AS_OF)
    stores = spark.createDataFrame([(1, "Ana", "a@b.mx", "c")], "store_id int, owner_name string, email string, city string")
    worst = RP.worst_case_rows(up)
    doc = RP.report_documents(stores, RP.weekly_stats(up), worst, RP.top_alerts(up), RP.category_breakdown(worst))
    d = RP.report_digest(doc, generated_at="x").first()
    assert "TOP ALERTAS" not in d.body and d.body.startswith("Hola Ana,")
    assert d.subject.endswith("(01-07-2001 al 01-07-2001)")


def test_category_proportions_half_even_and_dash(spark):
    b = spark.createDataFrame([(1, "C", 8, 1, 3, 4, 0)],
                              "store_id int, category string, total_products long, deficit_count long, superavit_count long, neutral_count long, featured_count long")
    r = RP.category_proportions(b).first()
    assert (r.deficit_pct, r.superavit_pct, r.neutral_pct) == (12, 38, 50)  # 12.5 -> 12, 37.5 -> 38 (half to even)
    assert (r.deficit_text, r.featured_text) == ("1", "—")
