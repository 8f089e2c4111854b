"""Pipelines' status and configuration, access, templates, dependencies, schema history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .poll import FORMATS, SINKS, SOURCES, config_field

#: Surfaces that were once supported and are now rejected by name.
REMOVED = ("redis", "sqs", "sns", "rabbitmq", "mqtt", "pubsub", "kinesis", "elasticsearch", "clickhouse", "snowflake", "bigquery", "iceberg", "delta", "ducklake", "s3", "mongodb", "singer", "airbyte")


def unsupported_surface_check(pipelines: DataFrame) -> DataFrame:
    """Removed, unknown or supported, by sink."""
    sink = config_field("sink_type")
    verdict = F.when(sink.isin(*SINKS), "supported").when(sink.isin(*REMOVED), "removed").otherwise("unknown")
    return pipelines.select("name", sink.alias("sink"), verdict.alias("verdict"))


def configured_pipelines(outbound: DataFrame, inbound: DataFrame) -> DataFrame:
    one = lambda d, way: d.select("name", F.lit(way).alias("direction"), "enabled", "tenant_name")
    return one(outbound, "outbound").unionByName(one(inbound, "inbound"))


def pipeline_status(pipelines: DataFrame, runtime: DataFrame, relay_offsets: DataFrame, dlq_depth: DataFrame) -> DataFrame:
    """State of each pipeline: disabled, unknown without a heartbeat, stale over two minutes, else running or degraded."""
    r = runtime.select(F.coalesce("grp", F.lit("default")).alias("grp"), F.col("pipeline_name").alias("name"), "heartbeat", "last_error_class")
    o = relay_offsets.where("relay_group_id = 'default'").select(F.col("pipeline_id").alias("name"), "last_change_id")
    d = dlq_depth.select(F.col("pipeline_name").alias("name"), "depth")
    rows = pipelines.select("name", "enabled").join(r.where("grp = 'default'"), "name", "left").join(o, "name", "left").join(d, "name", "left")
    state = (
        F.when(~F.col("enabled"), "disabled").when(F.col("heartbeat").isNull(), "unknown").when(F.col("heartbeat") > 2, "stale")
        .when(F.col("last_error_class").isNotNull(), "degraded").otherwise("running")
    )
    return rows.select("name", state.alias("state"), F.coalesce("last_change_id", F.lit(0)).alias("checkpoint"), F.coalesce("depth", F.lit(0)).alias("dlq_depth"))


def status_compat(pipelines: DataFrame, relay_offsets: DataFrame, as_of: Column) -> DataFrame:
    """Each pipeline's offset last written by any group; stale over five minutes."""
    last = relay_offsets.groupBy(F.col("pipeline_id").alias("name")).agg(F.max_by("last_change_id", F.struct("updated_at", "relay_group_id")).alias("checkpoint"), F.max("updated_at").alias("at"))
    state = F.when(F.col("at").isNull(), "unknown").when(F.col("at") < as_of - F.expr("interval 5 minutes"), "stale").otherwise("fresh")
    return pipelines.select("name").join(last, "name", "left").select("name", "checkpoint", state.alias("state"))


def publisher_acl_verdict(requests: DataFrame, publishers: DataFrame) -> DataFrame:
    """First that holds: superuser, owner, no publisher role, no entry at all, an entry, denied."""
    entries = publishers.select("outbox_name", "role", F.lit(True).alias("listed")).distinct()
    any_ = publishers.select("outbox_name", F.lit(True).alias("guarded")).distinct()
    rows = requests.join(entries, ["outbox_name", "role"], "left").join(any_, "outbox_name", "left")
    verdict = (
        F.when(F.col("superuser"), "superuser").when(F.col("owner"), "owner").when(~F.col("publisher"), "denied_no_role")
        .when(F.col("guarded").isNull(), "denied_no_acl").when(F.col("listed"), "allowed").otherwise("denied")
    )
    return rows.select("req", "outbox_name", "role", verdict.alias("verdict"))


def publish_admission(requests: DataFrame, config: DataFrame, publishers: DataFrame) -> DataFrame:
    acl = publisher_acl_verdict(requests, publishers)
    rows = acl.join(config.select("outbox_name", "enabled"), "outbox_name", "left")
    verdict = F.when(F.col("enabled").isNull(), "no_outbox").when(~F.col("enabled"), "disabled").when(F.col("verdict").startswith("denied"), "denied").otherwise("admitted")
    return rows.select("req", verdict.alias("admission"))


def tenant_visible(pipelines: DataFrame, grants: DataFrame, principals: DataFrame) -> DataFrame:
    """role, name: what each principal may see; administrators everything."""
    admins = principals.where("admin").select("role").crossJoin(pipelines.select("name"))
    others = principals.where("not admin").join(grants, "role").join(pipelines.select("name", "tenant_name"), "tenant_name").select("role", "name")
    return admins.unionByName(others.distinct())


def owner_visible(pipelines: DataFrame, owner: str) -> DataFrame:
    return pipelines.where(F.col("owner") == owner).select("name", "owner")


def relay_list_configs(pipelines: DataFrame) -> DataFrame:
    return pipelines.select("name", "enabled", "tenant_name", "owner", config_field("sink_type").alias("sink_type")).orderBy("name")


def relay_config_normalize(pipelines: DataFrame) -> DataFrame:
    """Defaults filled in and the first problem found."""
    batch = F.coalesce(config_field("batch_size").cast("int"), F.lit(100))
    problem = (
        F.when(config_field("source.outbox").isNull(), "outbox").when(~F.coalesce(config_field("source_type").isin(*SOURCES), F.lit(False)), "source_type")
        .when(~batch.between(1, 10_000), "batch_size").when(~F.col("wire_format").isin(*FORMATS), "wire_format")
    )
    return pipelines.select("name", F.coalesce(config_field("source_type"), F.lit("outbox")).alias("source_type"), config_field("source.outbox").alias("outbox"), batch.alias("batch_size"), problem.alias("problem"))


def _required(templates: DataFrame) -> DataFrame:
    return templates.withColumn("keys", F.when(F.col("required") == "", F.array().cast("array<string>")).otherwise(F.split("required", ",")))


def template_validate(calls: DataFrame, templates: DataFrame, overrides: DataFrame) -> DataFrame:
    given = overrides.groupBy("call").agg(F.collect_set("k").alias("given"))
    rows = calls.join(_required(templates), "name").join(given, "call", "left")
    missing = F.array_sort(F.array_except("keys", F.coalesce("given", F.array().cast("array<string>"))))
    return rows.select("call", "name", F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("valid"))


def template_render(calls: DataFrame, templates: DataFrame, overrides: DataFrame) -> DataFrame:
    """The template's document with overrides merged in, overrides winning, and `{{key}}` replaced; one row a key."""
    given = overrides.groupBy("call").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("given"))
    empty = F.create_map().cast("map<string,string>")
    rows = calls.join(templates, "name").join(given, "call", "left").select("call", F.coalesce("given", empty).alias("given"), F.from_json("config", "map<string,string>").alias("doc"))
    merged = F.map_concat(F.map_filter("doc", lambda k, v: ~F.map_contains_key("given", k)), F.map_filter("given", lambda k, v: F.map_contains_key("doc", k)))
    text = F.aggregate(F.map_entries("given"), F.col("value"), lambda acc, e: F.replace(acc, F.concat(F.lit("{{"), e.key, F.lit("}}")), e.value))
    return rows.select("call", "given", F.explode(merged).alias("key", "value")).select("call", "key", text.alias("value"))


def template_list(templates: DataFrame) -> DataFrame:
    return templates.select("name", "description", "required").orderBy("name")


def config_history(audit: DataFrame, pipeline: str, since_minutes: int, limit: int) -> DataFrame:
    rows = audit.where((F.col("pipeline_name") == pipeline) & (F.col("age") <= since_minutes))
    return rows.select("id", "changed_by", "age", "batch").orderBy("age", F.col("id").desc()).limit(limit)


def config_changes(audit: DataFrame) -> DataFrame:
    """Old and new value of each audited change; rows without a difference go."""
    before = F.lag("batch").over(Window.partitionBy("pipeline_name").orderBy(F.col("age").desc(), "id"))
    rows = audit.withColumn("old", before).where(~F.col("old").eqNullSafe(F.col("batch")))
    return rows.select("id", "pipeline_name", "old", F.col("batch").alias("new"), F.when(F.col("old").isNull(), "INSERT").otherwise("UPDATE").alias("action"))


def pipeline_state_merge(state: DataFrame, updates: DataFrame) -> DataFrame:
    """A pause starts once while failures last and ends with them; paused: minutes ago."""
    u = updates.select("pipeline_name", F.col("last_error").alias("e"), F.col("error_class").alias("c"), F.col("failure_count").alias("n"))
    both = state.join(u, "pipeline_name", "full_outer")
    new = F.col("n").isNotNull()
    paused = F.when(~new, F.col("paused")).when(F.col("n") == 0, F.lit(None)).otherwise(F.coalesce("paused", F.lit(0)))
    return both.select(
        "pipeline_name", F.when(new, F.col("e")).otherwise(F.col("last_error")).alias("last_error"),
        paused.cast("int").alias("paused"), F.coalesce("n", "failure_count").alias("failure_count"),
    )


def pause_reason(state: DataFrame, pipeline: str) -> DataFrame:
    return state.where((F.col("pipeline_name") == pipeline) & F.col("paused").isNotNull()).select("pipeline_name", "last_error", "error_class", "paused", "failure_count")


def auto_resume_candidates(state: DataFrame, pipelines: DataFrame, config: DataFrame) -> DataFrame:
    """Paused pipelines whose own outbox's waiting time is over."""
    p = pipelines.where("enabled").select(F.col("name").alias("pipeline_name"), config_field("source.outbox").alias("outbox_name"))
    rows = state.where("paused is not null").join(p, "pipeline_name").join(config.select("outbox_name", "resume_hours"), "outbox_name")
    return rows.where("resume_hours is not null and paused >= resume_hours * 60").select("pipeline_name", "outbox_name", "paused")


def runtime_status_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """A pipeline keeps its time of acquisition while the same owner holds it; times in minutes ago."""
    o = old.select(F.coalesce("grp", F.lit("default")).alias("grp"), "pipeline_name", F.col("owner_token").alias("o_token"), "owner_acquired", F.col("heartbeat").alias("o_beat"), F.col("last_error_class").alias("o_class"))
    both = o.join(new, ["grp", "pipeline_name"], "full_outer")
    fresh = F.col("owner_token").isNotNull()
    return both.select(
        "grp", "pipeline_name", F.coalesce("owner_token", "o_token").alias("owner_token"),
        F.when(~fresh | F.col("owner_token").eqNullSafe(F.col("o_token")), F.col("owner_acquired")).otherwise(F.lit(0)).alias("owner_acquired"),
        F.coalesce("heartbeat", "o_beat").alias("heartbeat"), F.coalesce("last_error_class", "o_class").alias("last_error_class"),
    )


def reachable(edges: DataFrame) -> DataFrame:
    """(src, dst) of all paths: known pairs are joined with themselves until nothing new is found, however long a path is.

    Each round doubles the length of the paths known, and reads what the round before wrote. The graph has an edge for each declared
    dependency between outboxes, so its pairs are the square of a catalog's names at most.
    """
    now = staged(edges.select(F.col("upstream").alias("src"), F.col("downstream").alias("dst")).distinct(), "paths")
    n, before = now.count(), -1
    while n > before:
        longer = now.alias("a").join(now.alias("b"), F.expr("a.dst = b.src and a.src <> a.dst")).select("a.src", "b.dst")
        now = staged(now.unionByName(longer).distinct(), "paths")
        n, before = now.count(), n
    return now


def dag_cycle(edges: DataFrame) -> DataFrame:
    """All nodes on a cycle."""
    return reachable(edges).where("src = dst").select(F.col("src").alias("node"))


TRIGGER_POLICY = r"^(always|on_idle|on_offset_gte\([0-9]+\))$"


def dag_edge_verdict(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether an edge may be added: no loop at a node, a known policy, no cycle with what is there."""
    back = reachable(edges).select(F.col("dst").alias("upstream"), F.col("src").alias("downstream"), F.lit(True).alias("back"))
    rows = requests.join(back, ["upstream", "downstream"], "left")
    verdict = F.when(F.col("upstream") == F.col("downstream"), "self").when(~F.col("policy").rlike(TRIGGER_POLICY), "policy").when(F.col("back"), "cycle").otherwise("ok")
    return rows.select("req", verdict.alias("verdict"))


def schema_drift(log: DataFrame) -> DataFrame:
    """Properties added, removed or changed between the last two schemas of a stream."""
    key = ["pipeline", "tap", "stream"]
    version = F.dense_rank().over(Window.partitionBy(*key).orderBy("logged"))
    rows = log.withColumn("version", version).where("version <= 2")
    new = rows.where("version = 1").select(*key, "property", F.col("kind").alias("new_kind"))
    old = rows.where("version = 2").select(*key, "property", F.col("kind").alias("old_kind"))
    both = new.join(old, [*key, "property"], "full_outer").where(~F.col("new_kind").eqNullSafe(F.col("old_kind")))
    change = F.when(F.col("old_kind").isNull(), "added").when(F.col("new_kind").isNull(), "removed").otherwise("changed")
    return both.select("stream", "property", change.alias("change"), "old_kind", "new_kind")


def schema_fingerprint(log: DataFrame) -> DataFrame:
    per = log.groupBy("pipeline", "stream", "logged").agg(F.array_join(F.array_sort(F.collect_set("property")), ",").alias("columns"))
    return per.select("pipeline", "stream", "logged", "columns", F.sha2("columns", 256).alias("fingerprint"))


def lake_column_history(columns: DataFrame, tables: DataFrame, schemas: DataFrame, schema: str) -> DataFrame:
    rows = columns.join(tables, "table_id").join(schemas.where(F.col("schema_name") == schema), "schema_id")
    return rows.select("table_name", "column_name", "kind", "begin_snapshot", "end_snapshot")


def offset_snapshot_range(lake_map: DataFrame, pipeline: str, first: int, last: int) -> DataFrame:
    """The first snapshot at or after an offset and the last at or before another."""
    rows = lake_map.where(F.col("pipeline") == pipeline)
    at = F.col("first_offset")
    return rows.agg(F.min_by("snapshot_id", F.when(at >= first, at)).alias("from_snapshot"), F.max_by("snapshot_id", F.when(at <= last, at)).alias("to_snapshot"))


def last_snapshot(lake_map: DataFrame) -> DataFrame:
    return lake_map.groupBy("pipeline").agg(F.max("snapshot_id").alias("snapshot_id"))


def lake_pipeline_names(pipelines: DataFrame) -> DataFrame:
    return pipelines.select("name", F.concat(F.lit("lake_"), F.regexp_replace(F.lower("name"), "[^a-z0-9_]", "_")).alias("lake_name"))


def fanin_participants(fan_in: DataFrame) -> DataFrame:
    return fan_in.select("name", F.explode(F.split("members", ",")).alias("outbox_name"))


def doctor_checks(cleanup: DataFrame, dlq: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """Outboxes not swept for a day, dead letters first failed in the last hours before as_of, as one row."""
    stale = cleanup.agg(F.count_if(F.col("age") > 1440).alias("stale_cleanup"))
    last = dlq.agg(F.count_if(F.col("first_failed_at") >= as_of - F.make_dt_interval(hours=F.lit(hours))).alias("recent_dlq"))
    return stale.crossJoin(last)


def backfill_progress(jobs: DataFrame) -> DataFrame:
    """Share done and seconds left at the rate so far."""
    done, total = F.col("rows_processed"), F.col("rows_total")
    rate = F.greatest(done / F.nullif("age_s", F.lit(0)), F.lit(0.001))
    pct = F.when(total > 0, F.round(100.0 * done / total, 2))
    eta = F.when((F.col("status") == "running") & (total > 0), F.round((total - done) / rate, 6))
    return jobs.select("name", "status", pct.alias("pct_complete"), eta.alias("eta_s"))
