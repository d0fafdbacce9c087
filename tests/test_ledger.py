import pytest

from retailspark.sources import ledger as L
from retailspark.sources import snapshots as S

REQUESTS = "request_id long, name string, email string, city string, lat double, lng double"


def _requests(spark, ids, prefix="a"):
    return spark.createDataFrame([(i, "Nom", f"{prefix}{i}@x.org", "c", 1.0, 2.0) for i in ids], REQUESTS)


def test_batches_from_one_snapshot_share_no_id_and_replays_agree(spark, tmp_path):
    stores = spark.createDataFrame([(3, "s@x.org"), (9, None)], "store_id int, email string")
    path = f"{tmp_path}/ids"
    run = lambda name, ids, prefix: {r.request_id: (r.status, r.store_id) for r in L.register_batch(_requests(spark, ids, prefix), stores, ledger=path, batch=name).collect()}
    first, second = run("one", range(5), "a"), run("two", range(10, 13), "b")
    assert [first[i][1] for i in range(5)] == [10, 11, 12, 13, 14] and [second[i][1] for i in range(10, 13)] == [15, 16, 17]
    assert run("one", range(5), "a") == first and run("two", range(10, 13), "b") == second
    assert sorted(tuple(r) for r in L.reservations(spark, path).collect()) == [("one", 10, 5), ("two", 15, 3)]
    with pytest.raises(ValueError):
        run("one", range(6), "a")
    none = L.register_batch(_requests(spark, []), stores, ledger=path, batch="empty")
    assert none.collect() == [] and L.reservations(spark, path).count() == 2
    # Stores that came by another way in the meantime lie below the next range.
    more = spark.createDataFrame([(40, None)], "store_id int, email string")
    assert [r.store_id for r in L.register_batch(_requests(spark, [1]), more, ledger=path, batch="three").collect()] == [41]


def test_a_lost_race_reserves_after_the_winner(spark, tmp_path, monkeypatch):
    path, real, raced = f"{tmp_path}/ids", S.commit, []

    def commit(spark_, path_, version, entry):
        if not raced:
            raced.append(version)
            real(spark_, path_, version, {"batch": "winner", "start": 1, "count": 7})
        real(spark_, path_, version, entry)

    monkeypatch.setattr(L, "commit", commit)
    assert L.reserve_ids(spark, path, "loser", 2) == 8
    assert sorted(tuple(r) for r in L.reservations(spark, path).collect()) == [("loser", 8, 2), ("winner", 1, 7)]
