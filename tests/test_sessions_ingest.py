import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from retailspark.operators import ingest as IN
from retailspark.operators.dashboard import zip_shortest
from retailspark.operators.ids import with_sequential_id
from retailspark.operators.sessions import gap_sessions

T0 = dt.datetime(2024, 1, 1, 23, 59, 0)


def reference_machine(events, gap_s):
    """Literal state machine of the scanner listener (per device, in order)."""
    out = []
    by_dev = {}
    for dev, seq, ts, key in sorted(events, key=lambda e: (e[0], e[2], e[1])):
        buf, last = by_dev.get(dev, ([], None))
        if last is not None and (ts - last).total_seconds() > gap_s:
            buf = []
        last = ts
        if key == "ENTER":
            if buf:
                out.append((dev, "".join(buf), ts))
            buf = []
        elif key is not None:
            buf.append(key)
        by_dev[dev] = (buf, last)
    return sorted(out)


def _run(spark, events, gap_s):
    df = spark.createDataFrame(events, "device long, seq long, ts timestamp_ntz, key string")
    return sorted((r.device, r.code, r.ended) for r in gap_sessions(df, gap_seconds=gap_s).collect())


def test_gap_edges(spark):
    ms = lambda m: T0 + dt.timedelta(milliseconds=m)
    ev = [
        (1, 1, ms(0), "A"), (1, 2, ms(300), "B"), (1, 3, ms(600), "ENTER"),       # gap exactly 0.3 keeps -> AB
        (1, 4, ms(700), "C"), (1, 5, ms(1010), "D"), (1, 6, ms(1100), "ENTER"),   # 0.31 resets -> D
        (1, 7, ms(1200), "ENTER"),                                                # empty buffer -> nothing
        (1, 8, ms(1300), "E"), (1, 9, ms(1400), None), (1, 10, ms(1500), "F"),    # other key ignored
        (1, 11, ms(1600), "ENTER"),                                               # -> EF
        (1, 12, ms(1700), "G"),                                                   # never closed -> lost
    ]
    got = [(c) for _, c, _ in _run(spark, ev, 0.3)]
    assert sorted(got) == sorted(["AB", "D", "EF"])
    assert _run(spark, ev, 0.3) == reference_machine(ev, 0.3)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 5000), st.sampled_from(["A", "B", "C", "ENTER", None])), min_size=1, max_size=40))
def test_gap_sessions_equals_state_machine(spark, raw):
    # timestamps spread over ~3 days so sessions cross the per-day split
    events = [(d, i, T0 + dt.timedelta(seconds=t * 60), k) for i, (d, t, k) in enumerate(raw)]
    assert _run(spark, events, 1800.0) == reference_machine(events, 1800.0)


def test_half_hour_blocks_and_packages(spark):
    rows = [(1, 1, " x ", "2026-04-10 12:29:59", 1), (2, 1, "x", "2026-04-10 12:30:00", 1), (3, 1, "x", "2026-04-10 12:45:15", 1),
            (4, 1, " \t ", "2026-04-10 12:45:15", 1), (5, 1, "y\n", "2026-04-10 12:50:00", 1)]
    scans = IN.clean_scans(spark.createDataFrame(rows, "id long, store_id int, barcode string, time string, amount int"))
    hh = {(r.block, r.barcode): r.amount for r in IN.half_hour_sales(scans).collect()}
    assert hh == {("12:00:00", "x"): 1, ("12:30:00", "x"): 2, ("12:30:00", "y"): 1}
    pk = IN.sales_packages(IN.half_hour_sales(scans)).first()
    assert pk.id_store == 1 and pk.date == "10-04-2026" and pk.day == 5
    assert [b.time for b in pk.sales] == ["12:00:00", "12:30:00"]
    assert [(p.barcode, p.amount) for p in pk.sales[1].products] == [("x", 2), ("y", 1)]
    lines = IN.package_lines(IN.sales_packages(IN.half_hour_sales(scans))).collect()
    assert sorted((r.hour, r.barcode, r.amount) for r in lines) == [(12, "x", 1), (12, "x", 2), (12, "y", 1)]


def test_zip_shortest(spark):
    r = spark.createDataFrame([([1, 2, 3], ["a", "b"])], "a array<int>, b array<string>").select(zip_shortest(F.col("a"), F.col("b")).alias("z")).first()
    assert len(r.z) == 2


def test_sequential_ids_contiguous(spark):
    df = spark.range(0, 1000).withColumnRenamed("id", "k").repartition(7)
    out = with_sequential_id(df, ["k"], name="sid", start=101, partitions=5).collect()
    assert sorted((r.k, r.sid) for r in out) == [(k, 101 + k) for k in range(1000)]


def test_register_stores(spark):
    stores = spark.createDataFrame([(1, "a@x.com"), (5, "b@x.com")], "store_id int, email string")
    req = spark.createDataFrame([(1, "n", "a@x.com"), (2, None, "c@x.com"), (3, "n", "c@x.com"), (4, "n", "c@x.com"), (5, "n", "A@x.com")],
                                "request_id long, name string, email string")
    out = {r.request_id: (r.status, r.store_id) for r in IN.register_stores(req, stores).collect()}
    assert out == {1: ("email_repeated", None), 2: ("invalid", None), 3: ("exito", 6), 4: ("email_repeated", None), 5: ("exito", 7)}


def test_pending_queue(spark):
    rows = [(1, 1, "a.json", "ok"), (1, 2, "  ", "network_error"), (1, 3, "r.json", "rejected"), (1, 4, "b.json", "ok"),
            (1, 5, "c.json", "network_error"), (1, 6, "d.json", "ok"), (2, 1, "e.json", "rejected"), (3, 1, "f.json", "ok")]
    q = spark.createDataFrame(rows, "client_id int, seq long, package_name string, outcome string")
    got = sorted((r.client_id, r.package_name) for r in IN.pending_packages(q).collect())
    # blank ignored; rejected stays and the pass goes on; from the network error on, everything stays
    assert got == [(1, "c.json"), (1, "d.json"), (1, "r.json"), (2, "e.json")]


def test_complete_products(spark):
    codes = spark.createDataFrame([("a",), ("b",), ("c",)], "barcode string")
    prods = spark.createDataFrame([("a",)], "barcode string")
    cat = spark.createDataFrame([("b", None, "Cat", None)], "barcode string, name string, category string, image_url string")
    out = {r.barcode: (r.product_name, r.category, r.image_url) for r in IN.complete_products(codes, prods, cat).collect()}
    assert out == {"b": ("Nombre no disponible", "Cat", "Sin Imagen"), "c": ("Producto Desconocido", "Sin Categoría", "Sin Imagen")}


def test_retention_counts_elapsed_time(spark):
    rows = [(1, dt.datetime(2024, 1, 16, 12)), (2, dt.datetime(2024, 1, 16, 11, 59, 59)), (3, dt.datetime(2024, 1, 16, 7)), (4, dt.datetime(2024, 2, 15)), (5, None)]
    for kind in ("timestamp_ntz", "timestamp"):
        df = spark.createDataFrame(rows, f"id int, at {kind}")
        assert [r.id for r in IN.retain(df, as_of=dt.datetime(2024, 2, 15, 12), date_col="at").collect()] == [1, 4]
        assert [r.id for r in IN.retain(df, as_of="2024-02-15 12:00:00", date_col="at").collect()] == [1, 4]
        assert [r.id for r in IN.retain(df, as_of=dt.date(2024, 2, 15), date_col="at").collect()] == [1, 2, 3, 4]
    days = spark.createDataFrame([(1, dt.date(2024, 1, 16)), (2, dt.date(2024, 1, 15))], "id int, at date")
    assert [r.id for r in IN.retain(days, as_of=dt.date(2024, 2, 15), date_col="at").collect()] == [1]
    assert [r.id for r in IN.retain(days, as_of=dt.datetime(2024, 2, 15, 0, 0, 1), date_col="at").collect()] == []
