"""Ledger tables derived from event Parquet files, and small literal catalog tables.

Every function takes (spark, dir) and returns a DataFrame. Ids are event ids plus one, since an offset of 0 means that
nothing was consumed. Times are taken at AS_OF, never from the clock. Literal tables are kept as rows so that the SQL
that checks the queries can hold the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
KINDS = ("click", "error", "purchase", "signup", "view")


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") + 1
    return events(spark, d).select(
        n.alias("id"),
        F.col("event_type").alias("outbox_name"),
        F.col("props").alias("payload"),
        F.when(n % 10 != 0, F.concat(F.lit('{"event_type":"'), "event_type", F.lit('.created"}'))).alias("headers"),
        F.col("ts").alias("created_at"),
        F.when(n % 3 == 0, F.col("ts") + F.expr("interval 1 hour")).alias("consumed_at"),
        F.lit("insert").alias("op"),
    )


def _tops(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy(F.col("event_type").alias("outbox_name")).agg((F.max("event_id") + 1).alias("mx"))


def outbox_config(spark: SparkSession, d: str) -> DataFrame:
    rows = ", ".join(f"('{t}', {24 * len(t)}, {'true' if t != 'error' else 'false'}, {len(t) if t != 'view' else 'null'})" for t in KINDS)
    return spark.sql(f"select * from values {rows} as t(outbox_name, retention_hours, enabled, resume_hours)")


def groups(spark: SparkSession, d: str) -> DataFrame:
    rows = ", ".join(f"('{t}-g{g}', '{t}', {g}, 'earliest')" for t in KINDS if t != "view" for g in (0, 1))
    return spark.sql(f"select * from values {rows} as t(group_name, outbox_name, g, auto_offset_reset)")


def offsets(spark: SparkSession, d: str) -> DataFrame:
    c = groups(spark, d).where("group_name <> 'signup-g1'").crossJoin(spark.range(2).withColumnRenamed("id", "c"))
    return c.join(_tops(spark, d), "outbox_name").select(
        "group_name",
        F.concat(F.lit("c"), "c").alias("consumer_name"),
        F.floor(F.col("mx") * (3 + F.col("g") + F.col("c")) / 10).alias("committed_offset"),
        (as_of() - F.expr("make_dt_interval(0, 0, cast(2 * g + c + 1 as int))")).alias("last_heartbeat"),
    )


def leases(spark: SparkSession, d: str) -> DataFrame:
    live = (F.col("group_name") == "click-g0") & (F.col("consumer_name") == "c0")
    dead = (F.col("group_name") == "error-g0") & (F.col("consumer_name") == "c1")
    off = F.col("committed_offset")
    until = F.when(live, as_of() + F.expr("interval 5 minutes")).otherwise(as_of() - F.expr("interval 5 minutes"))
    held = offsets(spark, d).where(live | dead).select("group_name", "consumer_name", (off + 1).alias("lease_start"), (off + 100).alias("lease_end"), until.alias("expires_at"))
    # Two consumers more that have live leases of the same group, apart and within reach of the next poll.
    others = held.where("consumer_name = 'c0'").select("group_name", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.lit(a).alias("a"), F.lit(b).alias("b")) for c, a, b in (("c8", 30, 60), ("c9", 75, 90))])).alias("o"), "lease_start", "expires_at")
    return held.unionByName(others.select("group_name", F.col("o.c").alias("consumer_name"), (F.col("lease_start") + F.col("o.a")).alias("lease_start"), (F.col("lease_start") + F.col("o.b")).alias("lease_end"), "expires_at"))


#: name, enabled, source_type, outbox, sink_type, tenant, owner, wire_format, batch_size
PIPELINES = [
    ("click-p", True, "outbox", "click", "nats", "t1", "ada", "native", 100),
    ("error-p", True, "outbox", "error", "kafka", "t1", "ben", "cloudevents", 200),
    ("purchase-p", True, "outbox", "purchase", "webhook", "t0", "ada", "native", 50),
    ("signup-p", False, "outbox", "signup", "inbox", "t0", "cai", "native", 10),
    ("legacy-redis", True, "outbox", "click", "redis", "default", "ada", "native", 100),
    ("no-source", True, None, "view", "nats", "default", "ben", "avro", 20000),
]


def pipelines(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(PIPELINES, "name string, enabled boolean, st string, ob string, sink string, tenant_name string, owner string, wire_format string, batch int")
    inner = F.struct(F.col("ob").alias("outbox"))
    config = F.to_json(F.struct(F.col("st").alias("source_type"), inner.alias("source"), F.col("sink").alias("sink_type"), F.col("batch").alias("batch_size")))
    return rows.select("name", "enabled", config.alias("config"), "tenant_name", "owner", "wire_format")


def relay_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = "('default', 'click', 6, 0), ('default', 'error', 5, 1), ('default', 'purchase', 9, 7), ('blue', 'click', 4, 90)"
    r = spark.sql(f"select * from values {rows} as t(relay_group_id, outbox_name, r, minutes)")
    return r.join(_tops(spark, d), "outbox_name").select(
        "relay_group_id",
        F.concat("outbox_name", F.lit("-p")).alias("pipeline_id"),
        "outbox_name",
        F.floor(F.col("mx") * F.col("r") / 10).alias("last_change_id"),
        F.concat(F.lit("w-"), "relay_group_id").alias("worker_id"),
        (as_of() - F.expr("make_dt_interval(0, 0, minutes)")).alias("updated_at"),
    )


def inbox_config(spark: SparkSession, d: str) -> DataFrame:
    rows = ", ".join(f"('{t}', 'app', {3 + len(t) % 3}, 72, 0)" for t in KINDS)
    return spark.sql(f"select * from values {rows} as t(inbox_name, inbox_schema, max_retries, processed_retention_hours, dlq_retention_hours)")


def inbox(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("id")
    return messages(spark, d).select(
        "id",
        F.col("outbox_name").alias("inbox_name"),
        F.concat(F.lit("outbox_"), "outbox_name", F.lit(":"), n, F.lit(":0")).alias("event_id"),
        "payload",
        (F.col("created_at") + F.expr("interval 1 minute")).alias("received_at"),
        F.when(n % 3 == 0, F.col("created_at") + F.expr("interval 2 hours")).alias("processed_at"),
        (n % 6).cast("int").alias("retry_count"),
        F.when(n % 6 > 0, F.concat(F.lit("failure "), (n % 6).cast("string"))).alias("last_error"),
    )


def inbox_redelivery(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries with duplicates within the batch (twice) and across batches."""
    m = inbox(spark, d)
    tops = m.groupBy("inbox_name").agg(F.max("id").alias("mx"))
    again = m.where("id % 7 = 0").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    tail = m.join(tops, "inbox_name").where("id > mx - 10").withColumn("copy", F.lit(0)).drop("mx")
    new = tail.withColumn("event_id", F.concat("event_id", F.lit("-new"))).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return again.unionByName(tail).unionByName(new)


def dlq(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("id")
    kinds = F.array(*[F.lit(k) for k in ("decode", "sink_permanent", "inbox_permanent", "max_retries_exceeded")])
    return messages(spark, d).where("outbox_name = 'error' and id % 4 = 0").select(
        "id",
        F.lit("error-p").alias("pipeline_name"),
        F.lit("error").alias("source_name"),
        F.lit("kafka").alias("sink_name"),
        F.concat(F.lit("outbox_error:"), n, F.lit(":0")).alias("dedup_key"),
        "payload",
        F.concat(F.lit("message "), (n % 3).cast("string")).alias("error_message"),
        F.element_at(kinds, (F.expr("id div 4") % 4 + 1).cast("int")).alias("error_kind"),
        (1 + n % 3).cast("int").alias("attempt_count"),
        F.col("created_at").alias("first_failed_at"),
        (F.col("created_at") + F.expr("make_dt_interval(0, cast(id % 48 as int))")).alias("last_failed_at"),
        F.lit(None).cast("timestamp_ntz").alias("retried_at"),
        (n % 5 == 0).alias("resolved"),
    )


def receipts(spark: SparkSession, d: str) -> DataFrame:
    o = relay_offsets(spark, d).where("relay_group_id = 'default'").select("pipeline_id", "outbox_name", "last_change_id")
    return messages(spark, d).join(o, "outbox_name").where("id <= last_change_id and id % 2 = 0").select(
        F.col("pipeline_id").alias("pipeline_name"),
        "outbox_name",
        F.col("id").alias("message_id"),
        F.concat(F.lit("outbox_"), "outbox_name", F.lit(":"), "id", F.lit(":0")).alias("dedup_key"),
        (F.col("created_at") + F.expr("interval 30 seconds")).alias("delivered_at"),
    )


#: Literal tables: columns, then rows. Times are minutes before AS_OF.
LITERALS = {
    "cleanup_state": ("outbox_name string, highest_deleted_id bigint, total_rows_deleted bigint, age int", [("click", 40, 12, 60), ("purchase", 900, 300, 1500), ("view", 0, 0, 3000)]),
    "runtime": (
        "grp string, pipeline_name string, owner_token string, owner_acquired int, heartbeat int, last_error_class string",
        [("default", "click-p", "tok-1", 300, 1, None), ("default", "error-p", "tok-2", 200, 10, "sink_transient"), (None, "purchase-p", None, None, 1, None)],
    ),
    "runtime_new": (
        "grp string, pipeline_name string, owner_token string, heartbeat int, last_error_class string",
        [("default", "click-p", "tok-1", 0, None), ("default", "error-p", "tok-9", 0, None), ("default", "signup-p", "tok-3", 0, "decode")],
    ),
    "publishers": ("outbox_name string, role string", [("click", "web"), ("click", "job"), ("purchase", "shop")]),
    "publish_requests": (
        "req bigint, outbox_name string, role string, superuser boolean, owner boolean, publisher boolean",
        [(1, "click", "root", True, False, False), (2, "click", "own", False, True, False), (3, "click", "web", False, False, True), (4, "click", "web2", False, False, True), (5, "click", "web", False, False, False), (6, "view", "web", False, False, True), (7, "error", "web", False, False, True), (8, "none", "root", True, False, True)],
    ),
    "tenant_grants": ("tenant_name string, role string", [("t0", "r0"), ("t1", "r1"), ("t1", "r2"), ("default", "r2")]),
    "principals": ("role string, admin boolean", [("r0", False), ("r1", False), ("r2", False), ("root", True), ("none", False)]),
    "templates": (
        "name string, config string, description string, required string",
        [("basic", '{"sink_type":"nats","subject":"{{topic}}.{{kind}}","batch_size":"10"}', "plain", "topic,kind"), ("hook", '{"sink_type":"webhook","url":"https://{{host}}/in"}', "", "host"), ("void", '{"sink_type":"stdout"}', "none", "")],
    ),
    "overrides": ("call bigint, name string, k string, v string", [(1, "basic", "topic", "orders"), (1, "basic", "kind", "new"), (2, "basic", "topic", "x"), (3, "hook", "host", "example.org"), (3, "hook", "batch_size", "5")]),
    "calls": ("call bigint, name string", [(1, "basic"), (2, "basic"), (3, "hook"), (4, "void")]),
    "config_audit": ("id bigint, pipeline_name string, age int, changed_by string, batch int", [(1, "click-p", 500, "ada", 10), (2, "click-p", 400, "ben", 20), (3, "error-p", 300, "ada", 30), (4, "click-p", 200, "ada", 40), (5, "click-p", 200, "cai", 50)]),
    "deps": ("upstream string, downstream string", [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "f"), ("f", "g")]),
    "edge_requests": ("req bigint, upstream string, downstream string, policy string", [(1, "g", "e", "always"), (2, "d", "e", "on_idle"), (3, "x", "x", "always"), (4, "d", "x", "on_offset_gte(12)"), (5, "d", "y", "sometimes"), (6, "g", "f", "always")]),
    "schema_log": (
        "pipeline string, tap string, stream string, logged int, property string, kind string",
        [("p", "tap", "users", 200, "id", "integer"), ("p", "tap", "users", 200, "name", "string"), ("p", "tap", "users", 200, "age", "integer"), ("p", "tap", "users", 100, "id", "integer"), ("p", "tap", "users", 100, "age", "string"), ("p", "tap", "users", 100, "mail", "string")],
    ),
    "lake_map": ("pipeline string, grp string, first_offset bigint, snapshot_id bigint", [("click-p", "default", 1, 10), ("click-p", "default", 100, 11), ("click-p", "default", 200, 12), ("error-p", "default", 50, 7), ("error-p", "default", 150, 9)]),
    "lake_columns": ("table_id bigint, column_name string, kind string, begin_snapshot bigint, end_snapshot bigint", [(1, "id", "bigint", 1, None), (1, "v", "int", 1, 4), (1, "v", "bigint", 4, None), (2, "x", "text", 2, None)]),
    "lake_tables": ("table_id bigint, schema_id bigint, table_name string", [(1, 1, "click"), (2, 2, "other")]),
    "lake_schemas": ("schema_id bigint, schema_name string", [(1, "main"), (2, "side")]),
    "fan_in": ("name string, members string", [("all", "click,error,view"), ("one", "signup")]),
    "pipeline_state": ("pipeline_name string, last_error string, error_class string, paused int, failure_count int", [("click-p", "down", "sink_transient", 600, 3), ("error-p", "bad", "decode", 100, 1), ("purchase-p", None, None, None, 0), ("legacy-redis", "gone", "config", 4000, 9)]),
    "state_updates": ("pipeline_name string, last_error string, error_class string, failure_count int", [("click-p", "down", "sink_transient", 4), ("error-p", None, None, 0), ("signup-p", "new", "poll", 1)]),
    "commits": ("group_name string, consumer_name string, new_offset bigint", [("click-g0", "c0", 5), ("click-g0", "c1", 1000000000), ("purchase-g1", "c0", -1), ("signup-g1", "c0", 7), ("error-g1", "c1", 0)]),
    "rewinds": ("req bigint, group_name string, consumer_name string, target bigint, confirm boolean", [(1, "click-g0", "c0", 50, True), (2, "click-g0", "c0", 50, False), (3, "click-g0", "c0", -1, True), (4, "click-g0", "c0", 1000000000, True), (5, "click-g0", "c1", 10, True), (6, "none", "c0", 10, True), (7, "error-g0", "c0", 0, True)]),
    "relay_updates": ("relay_group_id string, pipeline_id string, outbox_name string, last_change_id bigint", [("default", "click-p", "click", 3), ("default", "error-p", "error", 1000000), ("green", "view-p", "view", 4)]),
    "old_identities": ("relay_group_id string, pipeline_id string, outbox_name string, last_change_id bigint", [("default", "click-p", "click", 1), ("default", "click-p", "click", 2), ("default", "click-p", None, 3), ("blue", "error-p", None, 4), ("blue", "error-p", "error", 4), ("blue", "gone-p", None, 5)]),
    "backfills": ("name string, status string, rows_processed bigint, rows_total bigint, age_s bigint", [("a", "running", 250, 1000, 100), ("b", "pending", 0, 500, 0), ("c", "completed", 500, 500, 50), ("d", "running", 0, 10, 20), ("e", "paused", 3, 0, 30)]),
    "identifiers": ("name string", [("orders",), ("",), ("é" * 32,), ("a" * 63,), ("a" * 64,), ('bad"name',), ("ok name",)]),
    "subjects": ("subject string", [("orders.created",), ("orders.*",), ("orders.>",), (">.x",), ("a..b",), ("a.b*",), ("",), (".a",), ("a.>b",), (">",)]),
    "policies": ("policy string", [("always",), ("on_idle",), ("on_offset_gte(10)",), ("on_offset_gte()",), ("on_offset_gte(x)",), ("alwaysx",), ("ON_IDLE",)]),
    "hook_urls": ("url string", [("https://127.0.0.1/x",), ("https://169.254.169.254/latest",), ("https://10.1.2.3/",), ("https://172.20.0.1/",), ("https://172.32.0.1/",), ("https://192.168.0.9/",), ("http://example.org/",), ("https://user@example.org/",), ("https://example.org/#f",), ("https://localhost/a",), ("https://0.0.0.0/",), ("https://8.8.8.8:443/x",), ("https://metadata.google.internal/",), ("ftp://example.org/",), ("https://",), ("https://[::1]/",), ("https://[::]/",), ("https://[fd00::1]:8443/",), ("https://[fe80::1%25eth0]/",), ("https://[FE80::1]/",), ("https://[ff02::1]/",), ("https://[::ffff:127.0.0.1]/",), ("https://[::ffff:a00:1]/",), ("https://[::ffff:8.8.8.8]/",), ("https://[2001:db8::5]/",), ("https://[2606:4700::1111]/",), ("https://[1:2:3:4:5:6:7:8]/",), ("https://[1:2]/",), ("https://[::1/",), ("https://100.64.0.1/",), ("https://100.128.0.1/",), ("https://198.18.0.1/",), ("https://198.51.100.7/",), ("https://192.0.2.9/",), ("https://203.0.113.1/",), ("https://192.88.99.1/",), ("https://239.1.1.1/",), ("https://localhost./",), ("https://LOCALHOST:8443/",), ("https://ip6-loopback/",), ("https://metadata.azure.com./",), ("https://instance-data.ec2.internal/",), ("https://127.1/",), ("https://0x7f000001/",), ("https://2130706433/",), ("https://1.2.3.999/",), ("HTTPS://Example.org./x",), ("https://user:pw@10.0.0.1/",), ("https://example.org:bad/",), (None,)]),
    "wire_in": (
        "pos bigint, record string",
        [(1, '{"outbox_id":7,"op":"insert","stream_table":"orders","payload":{"a":1},"dedup_key":"orders:7:0"}'), (2, '{"operation":"delete","stream_table":"orders","dedup_key":"k2","payload":{"a":2}}'), (3, '{"stream_table":"orders","payload":{"a":3}}'), (4, None), (5, '{"op":"update","payload":{"a":5},"dedup_key":"k5"}')],
    ),
    "cloud_in": (
        "pos bigint, record string, ce_op string",
        [(1, '{"specversion":"1.0","id":"e1","type":"io.ledger.insert","source":"/outbox/orders","data":{"a":1}}', None), (2, '{"specversion":"1.0","id":"e2","type":"io.ledger.x","source":"/outbox/orders","data":{"a":2}}', "delete"), (3, '{"specversion":"0.3","id":"e3","type":"io.ledger.insert","source":"/o"}', None), (4, '{"specversion":"1.0","id":"e4","type":"other","source":"/o"}', None), (5, '{"specversion":"1.0","id":"e5","type":"z.update","source":"/o"}', None)],
    ),
    "secret_payloads": ("pos bigint, payload string", [(1, '{"_enc":true,"kid":"k1","iv":"aa","ct":"bb"}'), (2, '{"a":1}'), (3, '{"_enc":false}'), (4, None)]),
    "outcomes": (
        "pos bigint, outcome string, error_code string, attempts int, max_retries int, dlq boolean",
        [(1, "success", None, 0, 3, True), (2, "breaker_open", None, 0, 3, True), (3, "failure", "authentication", 1, 3, True), (4, "failure", "timeout", 1, 3, True), (5, "failure", "throttled", 4, 3, True), (6, "failure", "invalid_config", 1, 3, False), (7, "failure", "unavailable", 4, 3, False), (8, "breaker_open", None, 0, 3, False), (9, "failure", "unheard_of", 3, 3, True)],
    ),
    "error_codes": ("code string", [(c,) for c in "unavailable timeout throttled authentication authorization tls_verification invalid_destination message_too_large protocol_rejection invalid_config shutdown unknown other".split()]),
    "statuses": ("status int", [(s,) for s in (200, 204, 301, 400, 401, 403, 404, 408, 422, 425, 429, 500, 503, 599, 700, 100)]),
    "fsm_events": (
        "message string, start bigint, seq bigint, event string, frontier bigint, transient boolean",
        [
            (m, start, i, *(e.split(":") + [None, None])[:1], int(e.split(":")[1]) if e.startswith(("sink_acknowledged", "next_batch")) else None, e.endswith(":t") if e.startswith("publish_failed") else None)
            for m, start, events_ in (
                ("success", 7, "encoded publish_started sink_acknowledged:7 checkpoint_committed cleanup_allowed"),
                ("ambiguous", 3, "encoded publish_started sink_accepted"),
                ("accepted", 4, "encoded publish_started sink_accepted sink_acknowledged:4 checkpoint_committed"),
                ("dry_run", 11, "encoded dry_run_observed checkpoint_committed"),
                ("filtered", 11, "encoded intentionally_filtered checkpoint_committed"),
                ("dead", 13, "encoded publish_started publish_failed:p dlq_persisted checkpoint_committed"),
                ("retry", 17, "encoded publish_started publish_failed:t"),
                ("too_early", 17, "encoded publish_started publish_failed:t checkpoint_committed encoded"),
                ("illegal", 19, "checkpoint_committed"),
                ("other_frontier", 5, "encoded publish_started sink_acknowledged:6 checkpoint_committed"),
                ("next", 23, "encoded publish_started sink_accepted sink_acknowledged:23 checkpoint_committed next_batch:29"),
            )
            for i, e in enumerate(events_.split())
        ],
    ),
    "breaker_events": ("pos bigint, at_s bigint, ok boolean", [(i, t, ok) for i, (t, ok) in enumerate([(0, True), (1, False), (2, False), (3, False), (4, False), (5, False), (6, False), (20, True), (36, True), (37, True), (38, True), (39, False), (40, True), (41, False), (42, False), (43, False), (44, False), (45, False), (80, False), (81, True)])]),
    "budgets": ("metric string, direction string, bound double, floor_value double, pct double, tier_pct double", [("latency", "max", 60.0, 1.0, 5.0, 10.0), ("rate", "min", 10.0, 1.0, 5.0, 10.0), ("memory", "max", 500.0, 2.0, 1.0, 20.0)]),
    "budget_samples": ("metric string, run string, v double", [(m, r, v) for m, r, vs in (("latency", "base", (10, 11, 12)), ("latency", "now", (20, 21, 25)), ("rate", "base", (100, 102, 98)), ("rate", "now", (99, 97, 101)), ("memory", "base", (100, 101, 102)), ("memory", "now", (600, 601, 602))) for v in map(float, vs)]),
    "hist_samples": ("grp string, le double, n bigint", [("a", 0.1, 10), ("a", 0.5, 40), ("a", 1.0, 90), ("a", float("inf"), 100), ("b", 0.1, 0), ("b", 0.5, 1), ("b", 1.0, 2), ("b", float("inf"), 200)]),
    "capacity": ("name string, rate double, bytes_per_msg double, outage_s double, drain_rate double", [("small", 100.0, 1024.0, 3600.0, 500.0), ("tight", 1000.0, 2048.0, 600.0, 1000.0), ("large", 5000.0, 512.0, 7200.0, 20000.0)]),
    "outbox_requests": (
        "req bigint, action string, outbox_name string, retention_hours int, strategy string",
        [(1, "create", "fresh", 12, "'none'"), (2, "create", "click", 1, "none"), (3, "create_if_missing", "view", 1, "none"), (4, "create", "n" * 35, 5, "daily"), (5, "create", "n" * 36, 5, "weekly"), (6, "create", "n" * 40, 5, "none"), (7, "create", "x", 5, "hourly"), (8, "create", "", 5, "none"), (9, "drop", "signup", None, None), (10, "drop", "gone", None, None), (11, "drop_if_present", "gone", None, None), (12, "disable", "click", None, None), (13, "enable", "click", None, None), (14, "enable", "error", None, None), (15, "disable", "gone", None, None), (16, "create_if_missing", "later", 7, "monthly")],
    ),
    "group_requests": (
        "req bigint, action string, group_name string, outbox_name string, reset string",
        [(1, "create", "click-new", "click", "latest"), (2, "create", "click-g0", "click", "odd"), (3, "create_if_missing", "click-g1", "click", "odd"), (4, "create", "lost", "gone", "latest"), (5, "create", "odd", "view", "odd"), (6, "drop", "error-g1", None, None), (7, "drop", "lost", None, None), (8, "drop_if_present", "lost", None, None), (9, "create_if_missing", "view-new", "view", "none")],
    ),
    "acl_requests": (
        "req bigint, action string, outbox_name string, role string",
        [(1, "grant", "click", "web"), (2, "grant", "view", "eye"), (3, "grant", "gone", "web"), (4, "revoke", "click", "job"), (5, "revoke", "purchase", "none"), (6, "grant", "signup", "a"), (7, "revoke", "signup", "a"), (8, "revoke", "view", "b"), (9, "grant", "view", "b"), (10, "grant", "view", "")],
    ),
    "inbox_requests": (
        "req bigint, action string, inbox_name string, inbox_schema string, max_retries int",
        [(1, "create", "fresh", "app", 4), (2, "create", "click", "app", 9), (3, "create", "bad", "", 1), (4, "drop", "view", None, None), (5, "drop", "gone", None, None), (6, "drop_if_present", "gone", None, None)],
    ),
    "tenant_requests": (
        "req bigint, action string, tenant_name string, role string",
        [(1, "grant", "t0", "r2"), (2, "grant", "t0", "r0"), (3, "revoke", "t1", "r1"), (4, "revoke", "t9", "r1"), (5, "grant", "t3", "")],
    ),
    "tenant_moves": ("req bigint, name string, tenant string", [(1, "click-p", "t7"), (2, "click-p", "t8"), (3, "gone", "t1"), (4, "error-p", "")]),
    "switch_requests": ("req bigint, action string, name string", [(1, "enable", "signup-p"), (2, "enable", "legacy-redis"), (3, "disable", "legacy-redis"), (4, "delete", "no-source"), (5, "enable", "gone"), (6, "enable", "no-source")]),
    "beats": ("group_name string, consumer_name string, minutes int", [("click-g0", "c0", 0), ("click-g0", "c0", 3), ("error-g1", "c1", 0), ("signup-g1", "c0", 0)]),
    "conversions": (
        "req bigint, layout string, confirm boolean, admin boolean, span bigint, ahead int",
        [(1, "plain", True, True, 1000, 2), (2, "plain", False, True, 1000, 2), (3, "plain", True, False, 1000, 2), (4, "id_range", True, True, 1000, 2), (5, "noncanonical", True, True, 1000, 2), (6, "plain", True, True, 0, 2), (7, "id_range", True, True, 10, 101)],
    ),
    "fan_in_requests": ("req bigint, name string, members string", [(1, "all", "click,view"), (2, "fresh", "signup,error"), (3, "one", "signup,gone"), (4, "fresh", "purchase")]),
    "cancels": ("name string", [("a",), ("b",), ("c",), ("e",), ("gone",)]),
    "keys": ("outbox_name string, kms string, key_id string", [("click", "local", "k1"), ("view", "aws", "arn")]),
    "key_updates": ("req bigint, outbox_name string, kms string, key_id string", [(1, "click", "vault", "k2"), (2, "error", "gcp", "g1"), (3, "error", "gcp", "g2"), (4, "view", "other", "x"), (5, "view", "aws", ""), (6, "", "aws", "x")]),
    "secret_configs": (
        "pos bigint, config string",
        [(1, '{"url":"${env:URL}","n":1}'), (2, '{"a":{"b":["x","${file:/run/k}"]},"c":"plain"}'), (3, '{"a":"pre-${env:K}-post","b":"$env:K"}'), (4, '{"a":"say \\"${env:K}\\"","b":"${other:K}"}'), (5, None), (6, '{"k":"v"}')],
    ),
    "signed": ("pos bigint, body string", [(1, ""), (2, '{"a":1}'), (3, "é" * 100), (4, "x" * 1000)]),
}


def literal(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = LITERALS[name]
    return spark.createDataFrame([tuple(r) for r in rows], schema).coalesce(1)
