"""Plans stay the ones that scale."""

import pytest
from pyspark.sql import functions as F

from eventledger.functions import secure
from eventledger.operators import catalog, lifecycle, metrics, poll, retention
from eventledger.sources import staging, tables


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_poll_reads_and_filters_at_the_scan(spark, sf):
    text = plan(poll.outbox_poll(tables.messages(spark, sf), "click", 40, 25).select("id", "payload"))
    assert "PushedFilters: [IsNotNull(event_type)" in text or "EqualTo(event_type,click)" in text
    assert "user_id" not in text.split("ReadSchema:")[1].split("\n")[0]
    assert "TakeOrdered" in text


def broadcasts(frame):
    """The parts of a plan that go to every task, as texts."""
    lines, out = plan(frame).split("\n"), []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            deep = len(line) - len(line.lstrip(" :+-*()0123456789"))
            part = []
            for below in lines[i + 1 :]:
                if len(below) - len(below.lstrip(" :+-*()0123456789")) <= deep:
                    break
                part.append(below)
            out.append("\n".join(part))
    return out


@pytest.fixture
def stored(spark, sf, tmp_path):
    """Offsets and leases as tables of their own, as they are outside tests, not derived from events."""

    def of(frame, name):
        frame.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    return of


def test_events_are_never_broadcast(spark, sf, stored):
    messages, pipelines = tables.messages(spark, sf), tables.pipelines(spark, sf)
    relay = stored(tables.relay_offsets(spark, sf), "relay")
    offsets, leases = stored(tables.offsets(spark, sf), "offsets"), stored(tables.leases(spark, sf), "leases")
    frames = [
        retention.exact_lag(messages, pipelines, relay), poll.pipeline_poll_batches(messages, pipelines, relay),
        poll.group_poll(messages, tables.groups(spark, sf), offsets, leases, tables.as_of(), 20), metrics.latency_percentiles(tables.events(spark, sf)),
    ]
    for frame in frames:
        assert "NestedLoop" not in plan(frame) and "Cartesian" not in plan(frame)
        assert not any("events.parquet" in part for part in broadcasts(frame))
    assert all("BroadcastHashJoin" in plan(f) for f in frames[:3])
    assert "WindowGroupLimit" in plan(poll.pipeline_poll_batches(messages, pipelines.where("name <> 'no-source'"), relay))


def test_many_offsets_are_joined_by_shuffle(spark, sf, monkeypatch):
    monkeypatch.setattr(poll, "FEW", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = retention.exact_lag(tables.messages(spark, sf), tables.pipelines(spark, sf), tables.relay_offsets(spark, sf))
        assert "BroadcastHashJoin" not in plan(frame) and frame.count() == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_paths_of_any_length(spark):
    """Cycles longer than any depth limit, chains, and loops at a node."""
    ring = [(f"r{i}", f"r{(i + 1) % 50}") for i in range(50)]
    chain = [(f"c{i}", f"c{i + 1}") for i in range(40)]
    edges = spark.createDataFrame([*ring, *chain, ("r3", "c0"), ("s", "s")], "upstream string, downstream string")
    assert {r.node for r in catalog.dag_cycle(edges).collect()} == {f"r{i}" for i in range(50)} | {"s"}
    asked = spark.createDataFrame([(1, "c40", "r7", "always"), (2, "c40", "c1", "always"), (3, "c1", "c39", "always"), (4, "c40", "new", "always")], "req long, upstream string, downstream string, policy string")
    assert {r.req: r.verdict for r in catalog.dag_edge_verdict(asked, edges).collect()} == {1: "cycle", 2: "cycle", 3: "ok", 4: "ok"}
    assert catalog.dag_cycle(edges.limit(0)).count() == 0


def test_percentiles_of_ties_and_one_value(spark):
    rows = spark.createDataFrame([(1, "a", 5.0)] * 99 + [(2, "a", 9.0), (3, "b", 1.0)], "event_id long, event_type string, value double")
    assert sorted(tuple(r) for r in metrics.latency_percentiles(rows).collect()) == [("a", 5.0, 5.0, 5.0), ("b", 1.0, 1.0, 1.0)]


def test_shared_folder_is_required_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    session = type("Session", (), {"sparkContext": Context(), "conf": {}})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(session)
    session.conf = {"spark.checkpoint.dir": "hdfs://x/y/"}
    assert staging.shared_dir(session) == "hdfs://x/y"


def test_envelopes_and_masks(spark):
    key, other = bytes(32), bytes([1]) * 32
    rows = spark.createDataFrame([(1, "é {}"), (2, ""), (3, None)], "id long, payload string")
    nonce = F.substring(F.unhex(F.sha2(F.col("id").cast("string"), 256)), 1, 12)
    sealed = rows.select("id", "payload", secure.encrypted(F.col("payload"), key, nonce).alias("sealed"))
    opened = {r.id: (r.back, r.other) for r in sealed.select("id", secure.decrypted(F.col("sealed"), [key]).alias("back"), secure.decrypted(F.col("sealed"), [other]).alias("other")).collect()}
    assert opened == {1: ("é {}", None), 2: ("", None), 3: (None, None)}
    changed = sealed.where("id = 1").select(F.regexp_replace("sealed", '"ct":"..', '"ct":"AA').alias("sealed"))
    assert changed.select(secure.decrypted(F.col("sealed"), [key]).alias("x")).first().x is None
    config = '{"${env:A}":"${env:B}", "c":["x", "${file:/d}"], "e" : "f"}'
    assert spark.createDataFrame([(config,)], "c string").select(secure.masked(F.col("c")).alias("m")).first().m == '{"${env:A}":"[REDACTED]", "c":["x", "[REDACTED]"], "e" : "f"}'
    with pytest.raises(ValueError, match="32 bytes"):
        secure.encrypted(F.col("payload"), b"short", nonce)


def test_sweep_loop_bounds_and_date_ranges(spark):
    rows = spark.createDataFrame([("a", i) for i in range(23)], "outbox_name string, id long")
    config = spark.createDataFrame([("a",), ("b",), ("c",)], "outbox_name string")
    blocked = spark.createDataFrame([("c",)], "outbox_name string")
    got = {r.outbox_name: tuple(r)[1:] for r in lifecycle.sweep_loop(rows, config, blocked, 5, 4).collect()}
    assert got == {"a": (False, 20, 4, True), "b": (False, 0, 1, False), "c": (True, 0, 0, False)}
    assert lifecycle.sweep_loop(rows, config, blocked, 12, 4).where("outbox_name = 'a'").first()[2:] == (23, 2, False)
    for batch, batches in ((0, 1), (10_001, 1), (5, 0)):
        with pytest.raises(ValueError):
            lifecycle.sweep_loop(rows, config, blocked, batch, batches)
    with pytest.raises(ValueError, match="id ranges"):
        lifecycle.date_range_conversion(rows)


def test_sweep_limits_each_outbox_before_the_shuffle(spark, sf):
    from eventledger.plans.queries import QUERIES

    assert "WindowGroupLimit" in plan(QUERIES["sweep_candidates"](spark, sf))


def test_bucket_filter_prunes_partitions(spark, tmp_path):
    spark.range(5000).selectExpr("id", "id div 1000 as id_bucket").write.partitionBy("id_bucket").parquet(f"{tmp_path}/m")
    rows = retention.prune_to_bucket(spark.read.parquet(f"{tmp_path}/m"), 3500, 1000)
    assert "PartitionFilters: [isnotnull(id_bucket" in plan(rows) and rows.count() == 1499


def test_replay_range_bounds(spark):
    rows = spark.createDataFrame([(1,), (5,), (None,)], "id long")
    assert poll.replay_range(rows, 1, 4).count() == 1
    assert poll.replay_range(rows, None, None).count() == 3
    assert poll.replay_range(rows, None, 0).count() == 1


@pytest.mark.parametrize("name", ["outbox_pending", "retention_status", "inbox_fleet_status", "dlq_stats"])
def test_empty_events(spark, sf, tmp_path, name):
    from eventledger.plans.queries import QUERIES

    spark.read.parquet(f"{sf}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() in (0, 5)
