import pytest
from pyspark.sql import functions as F

from eventledger.sources import tables
from eventledger.streaming import delivery


def test_breaker_opens_waits_and_closes(spark):
    got = [(r.pos, r.allowed, r.state) for r in delivery.breaker_trace(tables.literal(spark, "breaker_events")).orderBy("pos").collect()]
    states = [s for _, _, s in got]
    assert states[:7] == ["closed"] * 5 + ["open", "open"]  # the fifth failure in a row opens it, the next call is refused
    assert got[6][1] is False and got[7] == (7, False, "open")
    assert got[8] == (8, True, "half_open") and got[10] == (10, True, "closed")
    assert states[17] == "open" and got[18] == (18, True, "open")  # half open lets one through, its failure opens it again


def test_fsm_accepts_only_legal_orders(spark):
    got = {r.message: r for r in delivery.delivery_fsm(tables.literal(spark, "fsm_events")).collect()}
    done = got["success"]
    assert (done.state, done.acknowledged_frontier, done.checkpoint, done.source_visible, done.cleanup_allowed) == ("cleanup_eligible", 7, 7, False, True)
    assert (got["ambiguous"].state, got["ambiguous"].duplicate_possible, got["ambiguous"].source_visible) == ("sink_accepted", True, True)
    assert (got["retry"].state, got["retry"].failure_transient, got["dead"].failure_transient) == ("publish_failed", True, False)
    assert {m: r.refused for m, r in got.items() if r.refused} == {"too_early": "checkpoint_committed", "illegal": "checkpoint_committed", "other_frontier": "sink_acknowledged"}
    assert (got["other_frontier"].state, got["illegal"].state) == ("publish_started", "polled")
    assert tuple(got["next"])[1:8] == ("polled", 29, None, True, False, False, False)


def test_token_bucket_and_backoff():
    b = delivery.TokenBucket(10)
    assert b.take(20, 0) and not b.take(1, 0) and b.take(10, 1) and not b.take(11, 2)
    assert [delivery.backoff_s(i) for i in (0, 3, 9)] == [1, 8, 60]


def written(spark, path, parts):
    for rows in parts:
        frame = spark.createDataFrame([(i, o, p) for i, o, p in rows], "id long, outbox_name string, payload string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(path)


class Crash(Exception):
    pass


def test_no_loss_and_no_duplicates_after_a_crash(spark, tmp_path):
    source, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    written(spark, source, [[(1, "a", "x"), (2, "a", "bad"), (2, "a", "bad")], [(2, "a", "bad"), (3, "b", "y")], [(4, "b", "z")]])
    sink = delivery.FileSink(out, rejects=lambda d: F.col("payload") == "bad")
    seen = []

    def crash(batch_id):
        seen.append(batch_id)
        if seen == [0, 1]:
            raise Crash("between publishing and the ledger")

    with pytest.raises(Exception, match="between publishing"):
        delivery.deliver(spark, source, state, sink, "p", after_publish=crash)
    delivery.deliver(spark, source, state, sink, "p", after_publish=crash)
    assert seen == [0, 1, 1, 2]
    sent = [r.value for r in spark.read.text(out).collect()]
    keys = sorted(spark.read.json(spark.createDataFrame([(v,) for v in sent], "value string").rdd.map(lambda r: r.value)).toPandas()["dedup_key"])
    assert keys == ["outbox_a:1:0", "outbox_b:3:0", "outbox_b:4:0"]
    every = spark.read.parquet(source)
    frontier = lambda: {r.outbox_name: r.last_change_id for r in delivery.checkpoints(spark, state, every).collect()}
    assert frontier() == {"a": 2, "b": 4}
    assert [(r.dedup_key, r.error_code) for r in delivery.dead_letters(spark, state).collect()] == [("outbox_a:2:0", "protocol_rejection")]
    delivery.deliver(spark, source, state, sink, "p")
    assert len(spark.read.text(out).collect()) == 3


class Flaky:
    """Fails each message as often as its payload says, with the code that it names; keeps what it took."""

    def __init__(self):
        self.calls, self.taken = [], []

    def publish(self, batch, batch_id, attempt=1):
        rows = batch.collect()
        self.calls.append((batch_id, attempt, len(rows)))
        out = []
        for r in rows:
            code, times = r.payload.split("*")
            ok = attempt > int(times)
            self.taken += [r.dedup_key] * ok
            out.append((r.dedup_key, ok, None if ok else code))
        return batch.sparkSession.createDataFrame(out, "dedup_key string, ok boolean, error_code string")


def test_failures_are_tried_again_put_aside_or_stop(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    rows = [(10, "a", "x*0"), (11, "a", "timeout*2"), (12, "a", "throttled*9"), (13, "a", "authentication*1"), (14, "a", "skip*0"), (15, "a", "x" * 50 + "*0")]
    written(spark, source, [rows])
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    how = delivery.Delivery(keep=lambda d: ~F.col("payload").startswith("skip"), max_attempts=3, message_bytes=40, breaker=delivery.CircuitBreaker(failures=2), bucket=delivery.TokenBucket(2.0), clock=lambda: now[0], sleep=sleep)
    sink = Flaky()
    delivery.deliver(spark, source, state, sink, "p", how=how)
    assert sink.calls == [(0, 1, 4), (0, 2, 2), (0, 3, 2)] and sorted(sink.taken) == ["outbox_a:10:0", "outbox_a:11:0"]
    assert slept[:2] == [1.0, 1.0] or slept[0] == 1.0
    assert now[0] >= 31  # two failures in a row opened the breaker
    letters = {r.id: r.error_code for r in delivery.dead_letters(spark, state).collect()}
    assert letters == {12: "throttled", 13: "authentication", 15: "message_too_large"}
    messages = spark.read.parquet(source)
    assert {r.outbox_name: r.last_change_id for r in delivery.checkpoints(spark, state, messages).collect()} == {"a": 15}
    # Ids that come after greater ones hold the frontier until they are done.
    written(spark, source, [[(7, "a", "x*0")]])
    assert delivery.checkpoints(spark, state, spark.read.parquet(source)).collect() == []
    delivery.deliver(spark, source, state, sink, "p", how=how)
    assert [tuple(r) for r in delivery.checkpoints(spark, state, spark.read.parquet(source)).collect()] == [("a", 15)]


def test_dry_run_and_stop(spark, tmp_path):
    source, sink = str(tmp_path / "in"), Flaky()
    written(spark, source, [[(1, "a", "x*0"), (2, "a", "invalid_config*1")]])
    delivery.deliver(spark, source, str(tmp_path / "dry"), sink, "p", how=delivery.Delivery(dry_run=True))
    assert sink.calls == [] and delivery.ledger_of(spark, str(tmp_path / "dry")).where("outcome = 'dry_run'").count() == 2
    with pytest.raises(Exception, match="invalid_config of outbox_a:2:0"):
        delivery.deliver(spark, source, str(tmp_path / "stop"), sink, "p", how=delivery.Delivery(dlq=False))
    assert [tuple(r) for r in delivery.checkpoints(spark, str(tmp_path / "stop"), spark.read.parquet(source)).collect()] == [("a", 1)]


def test_versioned_table(spark, tmp_path):
    table = delivery.VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.read("a int").count() == 0
    table.replace(spark.createDataFrame([(1,)], "a int"))
    grown = table.read("a int").unionByName(spark.createDataFrame([(2,)], "a int"))
    assert table.replace(grown) == 2
    spark.createDataFrame([(9,)], "a int").write.parquet(f"{tmp_path}/t/v3")  # a crash before the pointer: not seen
    assert sorted(r.a for r in table.read("a int").collect()) == [1, 2]
    assert table.replace(table.read("a int").where("a = 2")) == 3
    assert [r.a for r in table.read("a int").collect()] == [2]
