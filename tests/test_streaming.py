import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from retailspark.operators import ingest as IN
from retailspark.operators.sessions import gap_sessions
from retailspark.sources import fixtures as FX
from retailspark.sources.readers import package_id, read_packages, read_sales
from retailspark.streaming import ingest as SI
from retailspark.streaming.ingest import accounting, ingest_stream, process_batch, retry_rejected
from retailspark.streaming.scans import SCAN_SCHEMA, half_hour_sink, half_hour_stream, read_half_hours
from retailspark.streaming.sessions import read_codes, scanner_sessions, scanner_sink, waiting_codes

SF = "/root/testdata/sf0.001"


def _scratch():
    return tempfile.mkdtemp(prefix="rs-stream-", dir="/tmp")


def test_package_stream_ingest_and_dedup(spark):
    d = _scratch()
    src = os.path.join(d, "in")
    pk = IN.sales_packages(IN.half_hour_sales(IN.clean_scans(FX.scans_raw(spark, SF)))).drop("sale_date")
    pk.write.json(os.path.join(src, "a"))
    pk.limit(5).write.json(os.path.join(src, "b"))  # retried sends: same content again
    with open(os.path.join(src, "bad.json"), "w") as fh:
        fh.write("{not json\n")
    stores, prods = FX.stores(spark, SF), FX.known_products(spark, SF)
    q = ingest_stream(
        spark, os.path.join(src, "*"), stores=stores, products=prods, catalog=FX.catalog(spark, SF),
        hourly_weather=FX.hourly_weather(spark, SF), out_dir=os.path.join(d, "out"), checkpoint=os.path.join(d, "ckpt"),
    )
    q.awaitTermination(180)
    assert q.exception() is None
    out = os.path.join(d, "out")
    receipts = spark.read.parquet(os.path.join(out, "receipts"))
    ok, bad = IN.split_by_store(pk, stores)
    assert receipts.count() == ok.count()  # duplicates suppressed
    sales = read_sales(spark, os.path.join(out, "sales"))
    batch_units = IN.package_lines(ok).agg(F.sum("amount")).first()[0]
    assert sales.agg(F.sum("amount")).first()[0] == batch_units
    jan = sales.filter(F.col("sale_date") <= F.lit(dt.date(2024, 1, 10)))
    assert "PartitionFilters: [isnotnull(sale_date" in jan._jdf.queryExecution().executedPlan().toString()
    rejects = spark.read.parquet(os.path.join(out, "rejects"))
    assert rejects.filter(F.col("reason") == "unknown_store").count() == bad.count()
    assert rejects.filter(F.col("reason") == "malformed").count() == 1
    # batch reader sees the same documents
    assert read_packages(spark, os.path.join(src, "a")).count() == pk.count()
    # Register the unknown stores, re-offer the dead letters, ingest again
    new_stores = stores.unionByName(bad.select(F.col("id_store").alias("store_id")).distinct(), allowMissingColumns=True)
    retry = retry_rejected(spark.read.parquet(os.path.join(out, "rejects")), new_stores)
    assert retry.count() == bad.count()
    retry.write.json(os.path.join(src, "retry"))
    q2 = ingest_stream(
        spark, os.path.join(src, "*"), stores=new_stores, products=prods, catalog=FX.catalog(spark, SF),
        hourly_weather=FX.hourly_weather(spark, SF), out_dir=out, checkpoint=os.path.join(d, "ckpt"),
    )
    q2.awaitTermination(180)
    assert spark.read.parquet(os.path.join(out, "receipts")).count() == pk.count()


def test_half_hour_stream_matches_batch(spark):
    d = _scratch()
    raw = FX.scans_raw(spark, SF)
    raw.write.json(os.path.join(d, "scans"))
    stream = spark.readStream.schema(SCAN_SCHEMA).json(os.path.join(d, "scans"))
    got = {}

    def sink(batch, epoch):
        for r in batch.collect():
            got[(r.store_id, r.sale_date, r.block, r.barcode)] = r.amount

    q = (half_hour_stream(stream).writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(180)
    want = {(r.store_id, r.sale_date, r.block, r.barcode): r.amount for r in IN.half_hour_sales(IN.clean_scans(raw)).collect()}
    assert got == want


def test_scanner_sessions_stream_matches_batch(spark):
    d = _scratch()
    ev = FX.key_events(spark, SF)
    ev.write.parquet(os.path.join(d, "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(os.path.join(d, "ev"))
    q = (scanner_sessions(stream, gap_seconds=FX.EVENT_GAP_SECONDS).writeStream.outputMode("append").format("memory")
         .queryName("rs_sessions").option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(180)
    got = sorted((r.device, r.code, r.ended) for r in spark.sql("SELECT * FROM rs_sessions").collect())
    want = sorted((r.device, r.code, r.ended) for r in gap_sessions(ev, gap_seconds=FX.EVENT_GAP_SECONDS).collect())
    assert got == want and len(want) > 0


def test_half_hour_stream_append_respects_watermark(spark):
    """Append mode emits a 30-minute window once the watermark passes its end;
    scans older than the watermark are dropped (the late-data policy)."""
    d = _scratch()
    src = os.path.join(d, "scans")
    os.makedirs(src)
    schema = "id long, store_id int, barcode string, time string, amount int"

    def drop(name, rows):
        spark.createDataFrame(rows, schema).write.json(os.path.join(src, name))

    stream = spark.readStream.schema(SCAN_SCHEMA).option("maxFilesPerTrigger", 1).json(os.path.join(src, "*"))
    q = (half_hour_stream(stream, watermark="1 hour").writeStream.outputMode("append").format("memory")
         .queryName("rs_hh_append").option("checkpointLocation", os.path.join(d, "ck")).start())
    try:
        drop("b1", [(1, 1, "x", "2024-01-01 10:05:00", 1), (2, 1, "x", "2024-01-01 10:20:00", 1)])
        q.processAllAvailable()
        assert spark.sql("SELECT * FROM rs_hh_append").count() == 0  # window still open
        drop("b2", [(3, 1, "x", "2024-01-01 12:00:00", 1)])          # watermark -> 11:00
        q.processAllAvailable()
        drop("b3", [(4, 1, "x", "2024-01-01 10:10:00", 1)])          # late: older than the watermark
        q.processAllAvailable()
        drop("b4", [(5, 1, "x", "2024-01-01 14:00:00", 1)])          # watermark -> 13:00, emits 12:00
        q.processAllAvailable()
        got = sorted((r.block, r.amount) for r in spark.sql("SELECT * FROM rs_hh_append").collect())
        assert got == [("10:00:00", 2), ("12:00:00", 1)]
    finally:
        q.stop()


def test_duplicates_across_micro_batches(spark):
    """A retried send that arrives in a later micro-batch is dropped by the
    dedup state; a replay of the same epoch rewrites the same output."""
    d = _scratch()
    src = os.path.join(d, "in")
    pk = IN.sales_packages(IN.half_hour_sales(IN.clean_scans(FX.scans_raw(spark, SF)))).drop("sale_date")
    stores = FX.stores(spark, SF)
    ok, _ = IN.split_by_store(pk, stores)
    first = ok.orderBy("id_store", "date").limit(6)
    first.coalesce(1).write.json(os.path.join(src, "a"))
    first.limit(3).coalesce(1).write.json(os.path.join(src, "b"))   # duplicates of a, later file
    first.limit(2).coalesce(1).write.json(os.path.join(src, "c"))   # and again
    q = ingest_stream(
        spark, os.path.join(src, "*"), stores=stores, products=FX.known_products(spark, SF), catalog=FX.catalog(spark, SF),
        hourly_weather=FX.hourly_weather(spark, SF), out_dir=os.path.join(d, "out"), checkpoint=os.path.join(d, "ckpt"),
        max_files_per_trigger=1,
    )
    q.awaitTermination(180)
    assert q.exception() is None
    epochs = [p for p in os.listdir(os.path.join(d, "out", "receipts")) if p.startswith("epoch=")]
    assert len(epochs) == 3  # one file per trigger
    assert spark.read.parquet(os.path.join(d, "out", "receipts")).count() == 6


def test_scanner_state_expires_for_idle_devices(spark):
    d = _scratch()
    src = os.path.join(d, "ev")
    os.makedirs(src)
    schema = "device long, seq long, ts timestamp_ntz, key string"
    t0 = dt.datetime(2024, 1, 1, 10, 0, 0)

    def drop(name, rows):
        spark.createDataFrame(rows, schema).write.parquet(os.path.join(src, name))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(src, "*"))
    q = (scanner_sessions(stream, gap_seconds=1.0, watermark="1 minute").writeStream.outputMode("append").format("memory")
         .queryName("rs_scan_expiry").option("checkpointLocation", os.path.join(d, "ck")).start())
    try:
        drop("b1", [(1, 1, t0, "A"), (2, 2, t0, "B")])
        q.processAllAvailable()
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 2
        drop("b2", [(2, 3, t0 + dt.timedelta(hours=1), "C")])   # watermark passes device 1's gap
        q.processAllAvailable()
        drop("b3", [(2, 4, t0 + dt.timedelta(hours=1, seconds=0.5), "ENTER")])
        q.processAllAvailable()
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # only device 2 is kept
        got = sorted((r.device, r.code) for r in spark.sql("SELECT * FROM rs_scan_expiry").collect())
        assert got == [(2, "C")]
    finally:
        q.stop()


def test_half_hour_stream_independent_of_session_time_zone(spark):
    """Same blocks as the batch twin under a +05:45 session time zone."""
    d = _scratch()
    raw = FX.scans_raw(spark, SF)
    raw.write.json(os.path.join(d, "scans"))
    got = {}

    def sink(batch, epoch):
        for r in batch.collect():
            got[(r.store_id, r.sale_date, r.block, r.barcode)] = r.amount

    old_tz = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kathmandu")
    try:
        stream = spark.readStream.schema(SCAN_SCHEMA).json(os.path.join(d, "scans"))
        q = (half_hour_stream(stream).writeStream.outputMode("update").foreachBatch(sink)
             .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
        q.awaitTermination(180)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old_tz)
    want = {(r.store_id, r.sale_date, r.block, r.barcode): r.amount for r in IN.half_hour_sales(IN.clean_scans(raw)).collect()}
    assert got == want


PACKAGE = "id_store int, date string, day int, sales array<struct<time:string,products:array<struct<barcode:string,amount:int>>>>"


def _package(store, date, code="x", amount=1, time="10:00:00"):
    return (store, date, 1, [(time, [(code, amount)])])


def _offer(spark, src, name, rows):
    spark.createDataFrame(rows, PACKAGE).coalesce(1).write.json(os.path.join(src, name))


def _tables(spark):
    stores = spark.createDataFrame([(1,), (2,)], "store_id int")
    products = spark.createDataFrame([("x",)], "barcode string")
    catalog = spark.createDataFrame([("n", "New", "C", "i"), ("n", "Again", "C", "i")], "barcode string, name string, category string, image_url string")
    weather = spark.createDataFrame([], "store_id int, date date, temperature_2m array<double>, weather_code array<int>")
    return stores, products, catalog, weather


def _run(spark, src, out, ckpt, stores, products, catalog, weather):
    q = ingest_stream(spark, os.path.join(src, "*"), stores=stores, products=products, catalog=catalog, hourly_weather=weather, out_dir=out, checkpoint=ckpt, max_files_per_trigger=1)
    q.awaitTermination(300)
    assert q.exception() is None
    return {r.outcome: r.documents for r in accounting(spark, out).collect()}


def test_every_package_ends_somewhere(spark):
    """Clocks that are wrong, stores that were offline for long, retries and
    malformed values: nothing vanishes and nothing stops the stream."""
    d = _scratch()
    src, out, ckpt = (os.path.join(d, x) for x in ("in", "out", "ckpt"))
    stores, products, catalog, weather = _tables(spark)
    _offer(spark, src, "a", [_package(1, "01-01-2099"), _package(2, "05-03-2024")])
    _offer(spark, src, "b", [_package(2, "20-01-2024", "n"), _package(2, "05-03-2024")])  # 45 days late; a retry
    _offer(spark, src, "c", [_package(9, "02-01-2024", "n"), _package(1, "2024/01/05"), _package(1, "06-03-2024", time="xx:00"), _package(1, "07-03-2024", None), _package(1, "08-03-2024", "n")])
    with open(os.path.join(src, "bad.json"), "w") as fh:
        fh.write("{not json\n")
    got = _run(spark, src, out, ckpt, stores, products, catalog, weather)
    assert got == {"received": 4, "duplicate": 1, "unknown_store": 1, "bad_date": 1, "bad_time": 1, "bad_product": 1, "malformed": 1}
    # Registered much later, the dead letter is accepted once.
    more = stores.union(spark.createDataFrame([(9,)], "store_id int"))
    again = retry_rejected(spark.read.parquet(os.path.join(out, "rejects")), more)
    again.coalesce(1).write.json(os.path.join(src, "d"))
    again.coalesce(1).write.json(os.path.join(src, "e"))
    _offer(spark, src, "f", [_package(1, "09-05-2024", "n")])
    got = _run(spark, src, out, ckpt, lambda: more, products, catalog, weather)
    assert got["received"] == 6 and got["duplicate"] == 2 and sum(got.values()) == 13
    assert read_sales(spark, os.path.join(out, "sales")).count() == 6
    # The barcode came in four epochs and the catalogue has it twice: one product.
    assert spark.read.parquet(os.path.join(out, "new_products")).count() == 1


def test_replay_of_an_epoch_changes_nothing(spark):
    d = _scratch()
    src, out = os.path.join(d, "in"), os.path.join(d, "out")
    stores, products, catalog, weather = _tables(spark)
    _offer(spark, src, "a", [_package(1, "01-01-2024"), _package(1, "01-01-2024"), _package(2, "02-01-2024")])
    batch = package_id(read_packages(spark, os.path.join(src, "a")).withColumn("source", F.lit("f")))
    for _ in range(2):
        process_batch(batch, 0, stores=stores, products=products, catalog=catalog, hourly_weather=weather, out_dir=out)
        assert {r.outcome: r.documents for r in accounting(spark, out).collect()} == {"received": 2, "duplicate": 1}
    process_batch(batch, 1, stores=stores, products=products, catalog=catalog, hourly_weather=weather, out_dir=out)
    assert {r.outcome: r.documents for r in accounting(spark, out).collect()} == {"received": 2, "duplicate": 4}


def test_a_first_write_that_died_does_not_stop_the_replay(spark):
    """A crash in the middle of the first write leaves folders that hold only ``_temporary``."""
    d = _scratch()
    src, out = os.path.join(d, "in"), os.path.join(d, "out")
    for name in ("receipts", "new_products", "sales", "rejects", "duplicates"):
        os.makedirs(os.path.join(out, name, "_temporary", "0"))
    os.makedirs(os.path.join(out, "receipts", "epoch=0", "_temporary"))
    os.makedirs(os.path.join(out, "received", "level=0", "run=0", "_temporary"))
    stores, products, catalog, weather = _tables(spark)
    _offer(spark, src, "a", [_package(1, "01-01-2024", "n"), _package(2, "02-01-2024")])
    _offer(spark, src, "b", [_package(1, "01-01-2024", "n")])
    got = _run(spark, src, out, os.path.join(d, "ckpt"), stores, products, catalog, weather)
    assert got == {"received": 2, "duplicate": 1}
    assert spark.read.parquet(os.path.join(out, "new_products")).count() == 1


def test_ids_are_looked_up_by_prefix_in_few_files(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(SI, "FAN", 4)
    out = _scratch()
    ids = lambda *names: spark.createDataFrame([(hashlib.sha256(str(n).encode()).hexdigest(),) for n in names], "package_id string")
    batch = ids(3, 40, "new")
    seen = []
    for epoch in range(21):
        received = SI.received_before(batch, epoch, out)
        if received is not None:
            plan = received._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [isnotnull(prefix" in plan or "PartitionFilters: [prefix" in plan
            found = {r.package_id for r in received.join(batch, "package_id", "left_semi").collect()}
            assert found == {r.package_id for r in ids(*[n for n in (3, 40) if n < epoch * 3]).collect()}
            files = [r[0] for r in received.select(F.input_file_name()).distinct().collect()]
            seen.append(len(files))
            assert all(any(f"prefix=p{r.package_id[:2]}" in f for r in batch.collect()) for f in files)
        for _ in range(2):  # a replay writes the same
            SI.write_received(ids(*range(epoch * 3, epoch * 3 + 3)), epoch, out)
    assert SI._id_runs(21) == [(0, 20), (1, 4), (2, 0)] and SI._id_runs(4) == [(1, 0)] and SI._id_runs(0) == []
    assert 0 < max(seen) <= 3 * 3 * 3  # prefixes x runs of a level x levels


def test_batch_and_stream_agree(spark):
    from retailspark.plans.ingest import ingest_packages

    d = _scratch()
    src, out = os.path.join(d, "in"), os.path.join(d, "out")
    stores, products, catalog, weather = _tables(spark)
    _offer(spark, src, "a", [_package(1, "01-01-2024", "n"), _package(2, "99-99-2024"), _package(9, "02-01-2024"), _package(1, "01-01-2024", "n")])
    _offer(spark, src, "b", [_package(1, "01-01-2024", "n"), _package(2, "03-01-2024", time="25:00"), _package(2, "04-01-2024")])
    with open(os.path.join(src, "bad.json"), "w") as fh:
        fh.write("{not json\n")
    streamed = _run(spark, src, out, os.path.join(d, "ckpt"), stores, products, catalog, weather)
    tables = dict(stores=stores, products=products, catalog=catalog, hourly_weather=weather)
    batch = ingest_packages(packages=read_packages(spark, os.path.join(src, "*")), **tables)
    of = lambda df, *cols: sorted(tuple(r) for r in df.select(*cols).collect())
    counts = {"received": batch["receipts"].count(), "duplicate": sum(r.copies for r in batch["duplicates"].collect())} | {r.reason: r["count"] for r in batch["rejected"].groupBy("reason").count().collect()}
    assert counts == streamed == {"received": 2, "duplicate": 2, "bad_date": 1, "bad_time": 1, "unknown_store": 1, "malformed": 1}
    assert of(batch["receipts"], "package_id", "blocks") == of(spark.read.parquet(f"{out}/receipts"), "package_id", "blocks")
    lines = ["store_id", "barcode", "sale_date", "time", "amount"]
    assert of(batch["sales"], *lines) == of(read_sales(spark, f"{out}/sales"), *lines)
    assert of(batch["new_products"], "barcode") == of(spark.read.parquet(f"{out}/new_products"), "barcode")
    again = ingest_packages(packages=read_packages(spark, os.path.join(src, "*")), received=spark.read.parquet(f"{out}/receipts"), **tables)
    assert again["receipts"].count() == 0 and sum(r.copies for r in again["duplicates"].collect()) == 4


def test_half_hour_sink_counts_late_and_keeps_malformed_scans(spark):
    d = _scratch()
    src, out = os.path.join(d, "scans"), os.path.join(d, "out")
    rows = [(1, 1, "x", "2024-01-01 10:05:00", 1), (2, 1, "x", "2030-01-01 10:20:00", 1), (3, 1, " x ", "2024-01-01 10:10:00", 1), (4, 1, "x", "10:40:00", 1), (5, 1, "x", "aa:10:00", 1), (6, 1, "x", None, 1)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], SCAN_SCHEMA).coalesce(1).write.json(os.path.join(src, str(i)))
    stream = spark.readStream.schema(SCAN_SCHEMA).option("maxFilesPerTrigger", 1).json(os.path.join(src, "*"))
    half_hour_sink(stream, out_dir=out, checkpoint=os.path.join(d, "ck")).awaitTermination(300)
    got = sorted(map(tuple, read_half_hours(spark, out).collect()), key=str)
    want = sorted(map(tuple, IN.half_hour_sales(IN.clean_scans(spark.createDataFrame(rows, SCAN_SCHEMA))).collect()), key=str)
    assert got == want and sum(r[-1] for r in got) == 4
    assert sorted(r.id for r in spark.read.parquet(os.path.join(out, "malformed")).collect()) == [5, 6]


def test_half_hours_are_read_from_one_snapshot_and_newer_epochs(spark):
    from retailspark.streaming import scans as SC

    d = _scratch()
    src, out = os.path.join(d, "scans"), os.path.join(d, "out")
    day = lambda i: f"2024-01-{1 + i % 3:02d} 10:{i % 60:02d}:00"
    rows = [(i, i % 2, "x", day(i), 1) for i in range(11)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], SCAN_SCHEMA).coalesce(1).write.json(os.path.join(src, f"{i:02d}"))
    stream = spark.readStream.schema(SCAN_SCHEMA).option("maxFilesPerTrigger", 1).json(os.path.join(src, "*"))
    half_hour_sink(stream, out_dir=out, checkpoint=os.path.join(d, "ck"), compact_every=4).awaitTermination(300)
    of = lambda df: sorted(map(tuple, df.collect()))
    want = of(IN.half_hour_sales(IN.clean_scans(spark.createDataFrame(rows, SCAN_SCHEMA))))
    assert of(read_half_hours(spark, out)) == want
    parts = [p.rsplit("/", 1)[1] for p in SC._parts(spark, out)]
    assert parts == ["through=7", "epoch=8", "epoch=9", "epoch=10"]
    # A snapshot that was not finished is not read; written again, it is the same.
    os.makedirs(os.path.join(out, "snapshots", "through=9", "_temporary"))
    assert of(read_half_hours(spark, out)) == want
    for _ in range(2):
        SC.compact_half_hours(spark, out, 10)
        assert of(read_half_hours(spark, out)) == want and len(SC._parts(spark, out)) == 2
    # A scan that comes late still counts.
    SC.write_half_hours(spark.createDataFrame([(99, 0, "x", "2023-12-31 23:45:00", 1)], SCAN_SCHEMA), 11, out)
    assert sum(r[-1] for r in of(read_half_hours(spark, out))) == 12
    assert read_half_hours(spark, os.path.join(d, "none")).collect() == []


KEYS = "device long, seq long, ts timestamp_ntz, key string"


def _key_rows(devices=3, presses=40, seed=4):
    import random

    rng = random.Random(seed)
    rows, start = [], dt.datetime(2024, 1, 1, 9, 0, 0)
    for device in range(devices):
        at = start
        for _ in range(presses):
            at += dt.timedelta(milliseconds=rng.choice([50, 100, 200, 300, 400, 5000]))
            rows.append((device, len(rows), at, rng.choice(["a", "b", "7", None, "ENTER"])))
    return rows, rng


def _codes(df):
    return sorted((r.device, r.code, r.ended) for r in df.select("device", "code", "ended").collect())


def _scanner_run(spark, base, parts, **options):
    """The parts as micro-batches, one after the other; codes so far, all codes, and what went aside."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, KEYS).coalesce(1).write.parquet(f"{base}/in/{i}")
        stream = spark.readStream.schema(KEYS).option("maxFilesPerTrigger", 1).parquet(f"{base}/in/*")
        q = scanner_sink(stream, out_dir=f"{base}/out", checkpoint=f"{base}/ck", gap_seconds=0.3, **options)
        q.awaitTermination(120)
        assert q.exception() is None and not q.isActive
    codes = read_codes(spark, f"{base}/out")
    aside = sorted((r.kind, r.device, r.seq) for r in spark.read.parquet(f"{base}/out/aside").collect())
    return _codes(codes), _codes(codes.unionByName(waiting_codes(spark, f"{base}/ck", gap_seconds=0.3))), aside


def test_a_wrong_clock_delays_no_other_device(spark):
    rows, rng = _key_rows()
    want = _codes(gap_sessions(spark.createDataFrame(rows, KEYS), gap_seconds=0.3))
    n, day = len(rows), dt.timedelta(days=1)
    rng.shuffle(rows)
    ahead = [(7, n + i, dt.datetime(2099, 1, 1) + dt.timedelta(milliseconds=50 * i), k) for i, k in enumerate(["z", "q", "ENTER"])]
    now = [(7, n + 10 + i, dt.datetime(2024, 1, 1, 9, 0, i), k) for i, k in enumerate(["c", "ENTER", "d"])]
    untimed = [(0, n + 20, None, "x"), (8, n + 21, None, "ENTER")]
    moved = [(d, n + 30 + d, dt.datetime(2024, 1, 1, 9) + 2 * day, None) for d in range(3)]  # each device's own clock goes on
    late = [(0, n + 40, dt.datetime(2024, 1, 1, 9), "l")]
    done, all_codes, aside = _scanner_run(spark, _scratch(), [rows[:50] + ahead[:2], rows[50:] + untimed + now, moved + ahead[2:], late], delay_seconds=3600, idle_seconds=10**6)
    # The devices with a sound clock are through, though device 7 has been in 2099.
    assert done == want and want
    assert all_codes == sorted(want + [(7, "zq", ahead[2][2])])  # "c" waited for longer than the gap before its ENTER
    assert aside == [("late", 0, n + 40), ("untimed", 0, n + 20), ("untimed", 8, n + 21)]


def test_any_order_of_arrival_gives_the_batch_codes(spark):
    rows, rng = _key_rows(devices=5, presses=30, seed=9)
    want = _codes(gap_sessions(spark.createDataFrame(rows, KEYS), gap_seconds=0.3))
    rng.shuffle(rows)
    _, got, aside = _scanner_run(spark, _scratch(), [rows[:40], rows[40:90], rows[90:]], delay_seconds=86400)
    assert got == want and want and not aside


def test_idle_devices_are_finished_by_their_timer(spark):
    import time

    base = _scratch()
    at = dt.datetime(2024, 1, 1, 9)
    rows = [(1, 1, at, "a"), (1, 2, at + dt.timedelta(milliseconds=100), "b"), (1, 3, at + dt.timedelta(milliseconds=200), "ENTER")]
    spark.createDataFrame(rows, KEYS).coalesce(1).write.parquet(f"{base}/in")
    q = scanner_sink(spark.readStream.schema(KEYS).parquet(f"{base}/in"), out_dir=f"{base}/out", checkpoint=f"{base}/ck", available_now=False, delay_seconds=86400, idle_seconds=1)
    try:
        for _ in range(60):
            time.sleep(1)
            if os.path.isdir(f"{base}/out/codes") and any(p.startswith("epoch=") for p in os.listdir(f"{base}/out/codes")) and _codes(read_codes(spark, f"{base}/out")):
                break
        assert _codes(read_codes(spark, f"{base}/out")) == [(1, "ab", rows[-1][2])]
    finally:
        q.stop()


def test_sessions_state_orders_a_triggers_chunks(spark):
    key = [(1, i, dt.datetime(2024, 1, 1, 9, 0, 0, i * 100_000), k) for i, k in enumerate(["A", "B", "C", "D", "E", "F", "ENTER"])]
    d = _scratch()
    schema = "device long, seq long, ts timestamp_ntz, key string"
    spark.createDataFrame(list(reversed(key)), schema).coalesce(1).write.parquet(os.path.join(d, "ev"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        q = (scanner_sessions(spark.readStream.schema(schema).parquet(os.path.join(d, "ev"))).writeStream.outputMode("append").format("memory")
             .queryName("rs_chunks").option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
        q.awaitTermination(180)
        assert [r.code for r in spark.sql("SELECT * FROM rs_chunks").collect()] == ["ABCDEF"]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_device_is_handled_without_frames(monkeypatch):
    """A device costs a few list steps a trigger: only its rows come as a frame, and
    one is made only if something comes out."""
    import pandas as pd

    from retailspark.streaming.sessions import DeviceTime

    class Handle:
        value, timers, listed = None, [], 0

        def getValueState(self, *_):
            return self

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def listTimers(self):
            self.listed += 1
            return list(self.timers)

        def deleteTimer(self, t):
            self.timers.remove(t)

        def registerTimer(self, t):
            self.timers.append(t)

        def getCurrentProcessingTimeInMs(self):
            return 10**12

    handle, device = Handle(), DeviceTime(1000, "ENTER", 5000, 60_000)
    handle.timers = []
    device.init(handle)
    send = lambda rows: device.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["us", "seq", "key"])]), handle)
    made = []
    frame = pd.DataFrame
    rows = frame([(200, 2, "b"), (100, 1, "a"), (300, 3, "ENTER")], columns=["us", "seq", "key"])
    monkeypatch.setattr(pd, "DataFrame", lambda *a, **k: made.append(1) or frame(*a, **k))
    assert list(device.handleInputRows((1,), iter([rows]), handle)) == [] and not made and handle.listed == 0
    monkeypatch.undo()
    out = list(send([(9000, 4, "c"), (None, 5, "x")]))
    assert [tuple(r)[1:4] for r in out[0].itertuples(index=False)] == [("code", "ab", 300), ("untimed", None, None)]
    assert handle.value == ([9000], [4], ["c"], 4000) and len(handle.timers) == 1
    assert [r.kind for r in list(send([(4000, 6, "l")]))[0].itertuples()] == ["late"]
