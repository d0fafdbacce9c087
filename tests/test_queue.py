import os

import pytest
from pyspark.sql import functions as F

from retailspark.streaming import queue as Q


def _send(outcomes, log):
    """Outcomes by (client, seq) and try; ``ok`` where none is named."""

    def send(entries):
        rows = entries.collect()
        log.append(sorted((r.client_id, r.seq, r.tries) for r in rows))
        got = [(r.client_id, r.seq, r.package_name, r.tries, outcomes.get((r.client_id, r.seq, r.tries), "ok")) for r in rows]
        return entries.sparkSession.createDataFrame(got, f"{Q.ENTRY}, outcome string")

    return send


def test_rejected_come_again_and_nothing_is_lost_or_repeated(spark, tmp_path):
    base, log = str(tmp_path), []
    entries = spark.createDataFrame([(c, s, f"{c}_{s}.json") for c in (1, 2, 3) for s in range(5)] + [(3, 9, "  ")], "client_id int, seq long, package_name string")
    outcomes = {(1, 2, 0): "rejected", (1, 2, 1): "rejected", (2, 3, 0): "network_error", (3, 0, 0): "network_error", (3, 0, 1): "network_error"}
    Q.enqueue(entries, f"{base}/queue", "new")
    run = lambda: Q.queue_stream(spark, f"{base}/queue", send=_send(outcomes, log), out_dir=f"{base}/out", checkpoint=f"{base}/ck").awaitTermination(120)
    sent = lambda: sorted((r.client_id, r.seq, r.tries) for r in Q.sent_packages(spark, f"{base}/out").collect())
    run()
    assert sent() == [(1, 0, 0), (1, 1, 0), (1, 3, 0), (1, 4, 0), (2, 0, 0), (2, 1, 0), (2, 2, 0)]
    Q.enqueue(spark.createDataFrame([(4, 0, "4_0.json")], "client_id int, seq long, package_name string"), f"{base}/queue", "more")
    for _ in range(3):  # each run is a restart from the checkpoint
        run()
    got = sent()
    assert len(got) == 16 == len({g[:2] for g in got}) and (1, 2, 2) in got and (2, 3, 1) in got and (4, 0, 0) in got
    assert {g for g in got if g[0] == 3} == {(3, s, 2) for s in range(5)}
    assert len(log) == 3  # nothing was left for a fourth pass


def test_a_pass_that_died_after_its_outcomes_does_not_send_again(spark, tmp_path, monkeypatch):
    base, log = str(tmp_path), []
    entries = spark.createDataFrame([(1, 0, "a", 0), (1, 1, "b", 0)], Q.ENTRY)
    send = _send({(1, 1, 0): "rejected"}, log)
    real = Q.enqueue
    monkeypatch.setattr(Q, "enqueue", lambda *_: (_ for _ in ()).throw(RuntimeError("died")))
    with pytest.raises(RuntimeError):
        Q.send_pass(entries, 0, send=send, queue_dir=f"{base}/queue", out_dir=f"{base}/out")
    monkeypatch.setattr(Q, "enqueue", real)
    Q.send_pass(entries, 0, send=send, queue_dir=f"{base}/queue", out_dir=f"{base}/out")
    assert len(log) == 1 and os.listdir(f"{base}/queue") == ["again-0"]
    back = spark.read.schema(Q.ENTRY).json(f"{base}/queue/again-0")
    assert [(r.seq, r.tries) for r in back.collect()] == [(1, 1)] and Q.sent_packages(spark, f"{base}/out").where(F.col("seq") == 0).count() == 1
