"""The registered ledger queries: each binds an operator to the derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import secure, wire
from ..operators import catalog, inbox, lifecycle, metrics, poll, retention
from ..sources import tables as t
from ..streaming import delivery

CLAIM, SWEEP, SPAN = 4096, 50, 1000


def _lit(name):
    return lambda s: t.literal(s, name)


def _safe(s: SparkSession, d: str) -> DataFrame:
    parts = retention.participants(t.groups(s, d), t.offsets(s, d), t.pipelines(s, d), t.relay_offsets(s, d))
    return retention.safe_offset(t.outbox_config(s, d), parts)


def _candidates(s: SparkSession, d: str) -> DataFrame:
    return retention.sweep_candidates(t.messages(s, d), t.outbox_config(s, d), _safe(s, d), t.as_of(), SWEEP)


def _blocked(s: SparkSession, d: str) -> DataFrame:
    return retention.lease_blocked(t.groups(s, d), t.leases(s, d), t.as_of())


def _summary(s: SparkSession, d: str) -> DataFrame:
    return retention.sweep_summary(_candidates(s, d), t.outbox_config(s, d), _blocked(s, d), SWEEP)


def retention_status(s: SparkSession, d: str) -> DataFrame:
    return retention.retention_status(t.messages(s, d), t.outbox_config(s, d), _safe(s, d), t.literal(s, "cleanup_state"), t.as_of())


def _claims(s: SparkSession, d: str) -> DataFrame:
    return poll.claim_check_encode(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), CLAIM)


def _decoded(s: SparkSession, d: str) -> DataFrame:
    objects = s.read.parquet(f"{d}/documents.parquet").where(F.octet_length("text") > CLAIM).select(F.col("doc_id").alias("oid"), F.col("text").alias("object"))
    return poll.claim_check_decode(_claims(s, d), objects).select("doc_id", F.md5("text").alias("digest"))


def _envelopes(s: SparkSession, d: str) -> DataFrame:
    e = t.events(s, d).groupBy("event_type", F.hour("ts").alias("id"))
    sorted_ = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("event_id"))))
    even = F.col("event_id") % 2 == 0
    return e.agg(sorted_(even).alias("inserts"), sorted_(~even).alias("deletes")).withColumnRenamed("event_type", "name")


def _urls(s: SparkSession, d: str) -> DataFrame:
    urls = s.read.parquet(f"{d}/pages.parquet").select("url").unionByName(t.literal(s, "hook_urls"))
    return urls.select("url", wire.url_verdict(F.col("url")).alias("verdict")).groupBy("url", "verdict").agg(F.count("*").alias("n"))


def _outbox_status(s: SparkSession, d: str) -> DataFrame:
    one = retention_status(s, d).where("outbox_name = 'click'").select(F.to_json(F.struct("*")).alias("status"))
    get = lambda k: F.get_json_object("status", f"$.{k}").cast("long").alias(k)
    return one.select(F.get_json_object("status", "$.outbox_name").alias("outbox_name"), get("rows"), get("pending"), get("eligible"))


def _msg(s, d):
    return t.messages(s, d)


def _subjects(s, d):
    m = _msg(s, d)
    template = F.when(F.col("id") % 2 == 0, "ledger.{outbox}.{event_type}.{op}")
    fixed = F.when(F.col("id") % 5 == 0, "fixed").otherwise("")
    return m.select("id", "outbox_name", "op", wire.subject_spec(fixed, template).alias("spec"), F.coalesce(F.get_json_object("headers", "$.event_type"), F.lit("event")).alias("event_type"))


def _subject_render(s, d):
    return _subjects(s, d).select("id", wire.rendered(F.col("spec"), outbox=F.col("outbox_name"), stream_table=F.col("outbox_name"), op=F.col("op"), outbox_id=F.col("id"), event_type=F.col("event_type")).alias("subject"))


def _native_decode(s, d):
    g = lambda p: F.get_json_object("record", f"$.{p}")
    rows = t.literal(s, "wire_in").where("record is not null")
    return rows.select("pos", F.coalesce(g("op"), g("operation"), F.lit("event")).alias("op"), g("stream_table").alias("stream_table"), F.coalesce(g("dedup_key"), F.concat(F.lit("pos:"), "pos")).alias("dedup_key"), g("payload.a").cast("long").alias("a"))


def _cloud_decode(s, d):
    g = lambda p: F.get_json_object("record", f"$.{p}")
    suffix = F.regexp_extract(g("type"), r"\.(insert|update|delete)$", 1)
    ok = g("specversion") == "1.0"
    op = F.when(ok, F.coalesce("ce_op", F.nullif(suffix, F.lit("")), F.lit("event")))
    return t.literal(s, "cloud_in").select("pos", ok.alias("valid"), op.alias("op"), g("id").alias("id"), g("source").alias("source"))


def _mark_processed(s, d):
    ids = t.inbox(s, d).where("id % 4 = 0").select("event_id")
    return inbox.inbox_mark_processed(t.inbox(s, d), ids, t.as_of()).groupBy("inbox_name").agg(F.count("processed_at").alias("processed"), F.count_if(F.col("processed_at") == t.as_of()).alias("now"))


def _mark_failed(s, d):
    bad = t.inbox(s, d).where("id % 9 = 0").select("event_id", F.lit("boom").alias("error"))
    return inbox.inbox_mark_failed(t.inbox(s, d), bad).groupBy("inbox_name").agg(F.sum("retry_count").alias("retries"), F.count_if(F.col("last_error") == "boom").alias("boom"))


def _replay_inbox(s, d):
    ids = t.inbox(s, d).where("id % 5 = 0").select("event_id")
    return inbox.inbox_replay(t.inbox(s, d), ids).groupBy("inbox_name").agg(F.count_if("replayed").alias("replayed"), F.sum("retry_count").cast("long").alias("retries"), F.count("last_error").alias("errors"))


def _dlq_insert(s, d):
    failed = _msg(s, d).where("outbox_name = 'error' and id % 2 = 0").select(F.lit("error-p").alias("pipeline_name"), F.concat(F.lit("outbox_error:"), "id", F.lit(":0")).alias("dedup_key"))
    return inbox.dlq_insert(t.dlq(s, d), failed)


def _literal_expr(table, column, **exprs):
    return lambda s, d: t.literal(s, table).select(column, *[e.alias(k) for k, e in ((k, f(F.col(column))) for k, f in exprs.items())])


#: Keys of the queries on protected payloads; real ones never stand in code.
SIGNING, OLD_KEY, NEW_KEY = b"a signing secret of the fixtures", bytes(range(32)), bytes(range(100, 132))


def _drop_cascade(s, d):
    dropped = s.createDataFrame([("click",), ("gone",)], "outbox_name string")
    parts = lifecycle.outbox_drop_cascade(dropped, _msg(s, d), t.groups(s, d), t.offsets(s, d), t.leases(s, d))
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, rows in zip(("messages", "groups", "offsets", "leases"), parts)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def _sweep_loop(s, d):
    rows = retention.sweep_candidates(_msg(s, d), t.outbox_config(s, d), _safe(s, d), t.as_of(), SWEEP * 4)
    return lifecycle.sweep_loop(rows, t.outbox_config(s, d), _blocked(s, d), SWEEP, 4)


def _heartbeat(s, d):
    beats = t.literal(s, "beats").withColumn("at", t.as_of() - F.make_dt_interval(mins="minutes"))
    return lifecycle.heartbeat_next(t.offsets(s, d), beats)


def _dlq_single(s, d):
    asked = t.dlq(s, d).where("id % 3 <> 0").select(F.col("id").alias("req"), "id", F.when(F.col("id") % 3 == 1, "retry").otherwise("resolve").alias("action"))
    return lifecycle.dlq_single(t.dlq(s, d), asked, t.as_of())


def _sealed(s, d):
    nonce = F.substring(F.unhex(F.sha2(F.col("id").cast("string"), 256)), 1, 12)
    key = F.col("id") % 2 == 0
    sealed = F.when(key, secure.encrypted(F.col("payload"), NEW_KEY, nonce)).otherwise(secure.encrypted(F.col("payload"), OLD_KEY, nonce))
    return _msg(s, d).select("id", "payload", sealed.alias("sealed"))


def _opened(s, d):
    rows = _sealed(s, d).withColumn("part", F.when(F.col("id") % 5 == 0, F.col("payload")).otherwise(F.col("sealed")))
    return rows.select("id", secure.decrypted(F.col("part"), [OLD_KEY, NEW_KEY]).alias("payload"), secure.decrypted(F.col("sealed"), [OLD_KEY]).isNull().alias("lost"))


QUERIES = {
    "outbox_poll": lambda s, d: poll.outbox_poll(_msg(s, d), "click", 40, 25).select("id", "outbox_name", "payload", "created_at"),
    "pipeline_poll_batches": lambda s, d: poll.pipeline_poll_batches(_msg(s, d), t.pipelines(s, d), t.relay_offsets(s, d)),
    "group_poll": lambda s, d: poll.group_poll(_msg(s, d), t.groups(s, d), t.offsets(s, d), t.leases(s, d), t.as_of(), 20),
    "claim_check_encode": lambda s, d: _claims(s, d).select("doc_id", "checked", "size", F.when(F.col("checked"), F.col("payload")).alias("envelope")),
    "claim_check_decode": _decoded,
    "envelope_expand": lambda s, d: poll.envelope_expand(_envelopes(s, d)),
    "publish_admission": lambda s, d: catalog.publish_admission(t.literal(s, "publish_requests"), t.outbox_config(s, d), t.literal(s, "publishers")),
    "inbox_dedup": lambda s, d: inbox.inbox_dedup(t.inbox_redelivery(s, d), t.inbox(s, d)),
    "webhook_idempotency_key": lambda s, d: poll.webhook_idempotency_key(_msg(s, d), 7),
    "sink_jsonl": lambda s, d: poll.sink_jsonl(_msg(s, d)),
    "unsupported_surface_check": lambda s, d: catalog.unsupported_surface_check(t.pipelines(s, d)),
    "enabled_pipelines": lambda s, d: poll.enabled_pipelines(t.pipelines(s, d), "t1").select("name", "tenant_name"),
    "publish_limits": lambda s, d: poll.publish_limits(_msg(s, d), 100, 21, 8, 160),
    "replay_range": lambda s, d: poll.replay_range(_msg(s, d), None, 300).select("id", "outbox_name"),
    "replay_preview": lambda s, d: poll.replay_preview(_msg(s, d), "click", 10, 500, 40),
    "orphan_offsets": lambda s, d: retention.orphan_offsets(t.literal(s, "old_identities"), t.pipelines(s, d)),
    "lease_blocked": _blocked,
    "inbox_pending_rows": lambda s, d: inbox.inbox_pending_rows(t.inbox(s, d), t.inbox_config(s, d)),
    "unsupported_pipelines": lambda s, d: poll.unsupported_pipelines(t.pipelines(s, d)),
    "unsupported_pipelines_list": lambda s, d: poll.unsupported_pipelines(t.pipelines(s, d)).agg(F.expr("listagg(name, ',') within group (order by name)").alias("names")),
    "trigger_policy_valid": _literal_expr("policies", "policy", valid=lambda c: c.rlike(catalog.TRIGGER_POLICY)),
    "identifier_valid": _literal_expr("identifiers", "name", valid=wire.identifier_valid),
    "subject_valid": _literal_expr("subjects", "subject", valid=wire.subject_valid),
    "url_guard": _urls,
    "tenant_visible": lambda s, d: catalog.tenant_visible(t.pipelines(s, d), t.literal(s, "tenant_grants"), t.literal(s, "principals")),
    "owner_visible": lambda s, d: catalog.owner_visible(t.pipelines(s, d), "ada"),
    "publisher_acl_verdict": lambda s, d: catalog.publisher_acl_verdict(t.literal(s, "publish_requests"), t.literal(s, "publishers")),
    "id_gap_lag": lambda s, d: retention.id_gap_lag(_msg(s, d), t.groups(s, d), t.offsets(s, d)),
    "exact_lag": lambda s, d: retention.exact_lag(_msg(s, d), t.pipelines(s, d), t.relay_offsets(s, d)),
    "retention_status": retention_status,
    "outbox_status": _outbox_status,
    "retention_participants": lambda s, d: retention.retention_participants(retention.participants(t.groups(s, d), t.offsets(s, d), t.pipelines(s, d), t.relay_offsets(s, d))),
    "safe_offset": _safe,
    "outbox_pending": lambda s, d: retention.outbox_pending(_msg(s, d)),
    "pipeline_status": lambda s, d: catalog.pipeline_status(t.pipelines(s, d), t.literal(s, "runtime"), t.relay_offsets(s, d), inbox.dlq_depth(t.dlq(s, d))),
    "status_compat": lambda s, d: catalog.status_compat(t.pipelines(s, d), t.relay_offsets(s, d), t.as_of()),
    "dag_cycle": lambda s, d: catalog.dag_cycle(t.literal(s, "deps")),
    "dag_edge_verdict": lambda s, d: catalog.dag_edge_verdict(t.literal(s, "edge_requests"), t.literal(s, "deps")),
    "fanin_participants": lambda s, d: catalog.fanin_participants(t.literal(s, "fan_in")),
    "schema_drift": lambda s, d: catalog.schema_drift(t.literal(s, "schema_log")),
    "schema_fingerprint": lambda s, d: catalog.schema_fingerprint(t.literal(s, "schema_log")),
    "lake_column_history": lambda s, d: catalog.lake_column_history(t.literal(s, "lake_columns"), t.literal(s, "lake_tables"), t.literal(s, "lake_schemas"), "main"),
    "lake_pipeline_names": lambda s, d: catalog.lake_pipeline_names(t.pipelines(s, d)),
    "offset_outbox_backfill": lambda s, d: retention.offset_outbox_backfill(t.literal(s, "old_identities"), t.pipelines(s, d)),
    "duplicate_offset_identities": lambda s, d: retention.duplicate_offset_identities(t.literal(s, "old_identities")),
    "auto_resume_candidates": lambda s, d: catalog.auto_resume_candidates(t.literal(s, "pipeline_state"), t.pipelines(s, d), t.outbox_config(s, d)),
    "dlq_stats": lambda s, d: inbox.dlq_stats(t.dlq(s, d)),
    "dlq_depth": lambda s, d: inbox.dlq_depth(t.dlq(s, d)),
    "dlq_root_causes": lambda s, d: inbox.dlq_root_causes(t.dlq(s, d)),
    "dlq_by_kind": lambda s, d: inbox.dlq_by_kind(t.dlq(s, d)),
    "dlq_list": lambda s, d: inbox.dlq_list(t.dlq(s, d)),
    "dlq_insert": _dlq_insert,
    "dlq_retry_all": lambda s, d: inbox.dlq_retry_all(t.dlq(s, d), t.as_of()),
    "dlq_purge": lambda s, d: inbox.dlq_purge(t.dlq(s, d), t.as_of(), 10),
    "dlq_requeue": lambda s, d: inbox.dlq_requeue(t.dlq(s, d)),
    "delivery_confirm": lambda s, d: retention.delivery_confirm(t.receipts(s, d), "click", 10, 400),
    "receipts_prune": lambda s, d: retention.receipts_prune(t.receipts(s, d), t.as_of(), 600).select("pipeline_name", "message_id", "delivered_at"),
    "inbox_status": lambda s, d: inbox.inbox_status(t.inbox(s, d), t.inbox_config(s, d), "click"),
    "inbox_fleet_status": lambda s, d: inbox.inbox_fleet_status(t.inbox(s, d), t.inbox_config(s, d)),
    "inbox_fleet_summary": lambda s, d: inbox.inbox_fleet_summary(t.inbox_config(s, d)),
    "inbox_triage": lambda s, d: inbox.inbox_triage(t.inbox(s, d)),
    "inbox_dup_count": lambda s, d: inbox.inbox_dup_count(t.inbox_redelivery(s, d), inbox.inbox_dedup(t.inbox_redelivery(s, d), t.inbox(s, d))),
    "inbox_mark_processed": _mark_processed,
    "inbox_mark_failed": _mark_failed,
    "inbox_replay": _replay_inbox,
    "inbox_retention": lambda s, d: inbox.inbox_retention(t.inbox(s, d), t.inbox_config(s, d), t.as_of()),
    "doctor_checks": lambda s, d: catalog.doctor_checks(t.literal(s, "cleanup_state"), t.dlq(s, d), t.as_of(), hours=72),
    "payload_group_summary": lambda s, d: metrics.payload_group_summary(_msg(s, d)),
    "event_type_totals": lambda s, d: metrics.event_type_totals(t.events(s, d)),
    "latency_percentiles": lambda s, d: metrics.latency_percentiles(t.events(s, d)),
    "budget_regression": lambda s, d: metrics.budget_regression(t.literal(s, "budget_samples"), t.literal(s, "budgets")),
    "latest_offsets": lambda s, d: retention.latest_offsets(t.relay_offsets(s, d)),
    "sweep_candidates": lambda s, d: _candidates(s, d).where(F.col("rank") <= SWEEP).select("outbox_name", "id"),
    "sweep_summary": _summary,
    "sweep_apply": lambda s, d: retention.sweep_apply(_msg(s, d), _candidates(s, d), _blocked(s, d), SWEEP).select("id", "outbox_name"),
    "cleanup_state_next": lambda s, d: retention.cleanup_state_next(t.literal(s, "cleanup_state"), _summary(s, d)),
    "partition_plan": lambda s, d: retention.partition_plan(_msg(s, d), SPAN, 2),
    "config_history": lambda s, d: catalog.config_history(t.literal(s, "config_audit"), "click-p", 450, 2),
    "config_changes": lambda s, d: catalog.config_changes(t.literal(s, "config_audit")),
    "offset_snapshot_range": lambda s, d: catalog.offset_snapshot_range(t.literal(s, "lake_map"), "click-p", 50, 150),
    "last_snapshot": lambda s, d: catalog.last_snapshot(t.literal(s, "lake_map")),
    "configured_pipelines": lambda s, d: catalog.configured_pipelines(t.pipelines(s, d), t.inbox_config(s, d).select(F.concat("inbox_name", F.lit("-in")).alias("name"), F.lit(True).alias("enabled"), F.lit("default").alias("tenant_name"))),
    "relay_list_configs": lambda s, d: catalog.relay_list_configs(t.pipelines(s, d)),
    "relay_config_normalize": lambda s, d: catalog.relay_config_normalize(t.pipelines(s, d)),
    "commit_offsets": lambda s, d: retention.commit_offsets(t.offsets(s, d), t.literal(s, "commits")),
    "relay_offset_merge": lambda s, d: retention.relay_offset_merge(t.relay_offsets(s, d), t.literal(s, "relay_updates")),
    "rewind_verdict": lambda s, d: retention.rewind_verdict(t.literal(s, "rewinds"), t.offsets(s, d), t.groups(s, d), t.literal(s, "cleanup_state")),
    "template_validate": lambda s, d: catalog.template_validate(t.literal(s, "calls"), t.literal(s, "templates"), t.literal(s, "overrides")),
    "template_render": lambda s, d: catalog.template_render(t.literal(s, "calls"), t.literal(s, "templates"), t.literal(s, "overrides")),
    "template_list": lambda s, d: catalog.template_list(t.literal(s, "templates")),
    "pipeline_state_merge": lambda s, d: catalog.pipeline_state_merge(t.literal(s, "pipeline_state"), t.literal(s, "state_updates")),
    "pause_reason": lambda s, d: catalog.pause_reason(t.literal(s, "pipeline_state"), "click-p"),
    "runtime_status_merge": lambda s, d: catalog.runtime_status_merge(t.literal(s, "runtime"), t.literal(s, "runtime_new")),
    "dedup_key": lambda s, d: _msg(s, d).select("id", wire.dedup_key(F.concat(F.lit("outbox_"), "outbox_name"), F.col("id"), F.lit(0)).alias("dedup_key")),
    "subject_render": _subject_render,
    "subject_spec": lambda s, d: _subjects(s, d).select("id", "spec"),
    "topic_resolve": lambda s, d: _msg(s, d).select("id", wire.rendered(F.lit("{server}.{schema}.{stream_table}"), server=F.lit("s1"), schema=F.lit("app"), stream_table=F.col("outbox_name")).alias("topic")),
    "wire_native_encode": lambda s, d: _msg(s, d).select("id", wire.native_encode(F.col("id"), F.col("op"), F.col("outbox_name"), F.col("payload")).alias("value")),
    "wire_native_decode": _native_decode,
    "wire_cloudevents_encode": lambda s, d: _msg(s, d).select("id", wire.cloudevents_encode(F.col("id"), F.col("op"), F.col("outbox_name"), F.col("payload"), F.col("created_at")).alias("value")),
    "wire_cloudevents_decode": _cloud_decode,
    "encrypted_detect": lambda s, d: t.literal(s, "secret_payloads").select("pos", F.coalesce(F.get_json_object("payload", "$._enc") == "true", F.lit(False)).alias("encrypted")),
    "backfill_progress": lambda s, d: catalog.backfill_progress(t.literal(s, "backfills")),
    "date_partition_bounds": lambda s, d: metrics.date_partition_bounds(_msg(s, d), "week"),
    "delivery_fsm": lambda s, d: delivery.delivery_fsm(t.literal(s, "fsm_events")),
    "breaker_trace": lambda s, d: delivery.breaker_trace(t.literal(s, "breaker_events")),
    "publish_directive": lambda s, d: t.literal(s, "outcomes").select("pos", wire.publish_directive(*[F.col(c) for c in ("outcome", "error_code", "attempts", "max_retries", "dlq")]).alias("directive")),
    "error_class": _literal_expr("error_codes", "code", cls=wire.error_class),
    "status_code": _literal_expr("statuses", "status", code=wire.status_code),
    "tumbling_counts": lambda s, d: metrics.tumbling_counts(t.events(s, d)),
    "counter_rate": lambda s, d: metrics.counter_rate(metrics.counter_samples(t.events(s, d))),
    "histogram_quantile": lambda s, d: metrics.histogram_quantile(t.literal(s, "hist_samples"), 0.99),
    "success_ratio": lambda s, d: metrics.success_ratio(t.events(s, d)),
    "throughput_drop": lambda s, d: metrics.throughput_drop(t.events(s, d)),
    "lag_slope": lambda s, d: metrics.lag_slope(t.events(s, d)),
    "alerts_firing": lambda s, d: metrics.alerts_firing(t.events(s, d), 0.2, 2),
    "outbox_lifecycle": lambda s, d: lifecycle.outbox_verdict(t.literal(s, "outbox_requests"), t.outbox_config(s, d)).select("req", "verdict"),
    "outbox_config_next": lambda s, d: lifecycle.outbox_config_next(t.outbox_config(s, d), t.literal(s, "outbox_requests")),
    "outbox_drop_cascade": _drop_cascade,
    "group_lifecycle": lambda s, d: lifecycle.group_verdict(t.literal(s, "group_requests"), t.groups(s, d), t.outbox_config(s, d)).select("req", "verdict"),
    "groups_next": lambda s, d: lifecycle.groups_next(t.groups(s, d), t.literal(s, "group_requests"), t.outbox_config(s, d)),
    "publishers_next": lambda s, d: lifecycle.publishers_next(t.literal(s, "publishers"), t.literal(s, "acl_requests"), t.outbox_config(s, d)),
    "inbox_lifecycle": lambda s, d: lifecycle.inbox_verdict(t.literal(s, "inbox_requests"), t.inbox_config(s, d)).select("req", "verdict"),
    "inbox_config_next": lambda s, d: lifecycle.inbox_config_next(t.inbox_config(s, d), t.literal(s, "inbox_requests")),
    "tenant_grants_next": lambda s, d: lifecycle.grants_next(t.literal(s, "tenant_grants"), t.literal(s, "tenant_requests"), "tenant_name"),
    "pipeline_tenant_next": lambda s, d: lifecycle.pipeline_tenant_next(t.pipelines(s, d), t.literal(s, "tenant_moves")),
    "pipeline_switch": lambda s, d: lifecycle.pipeline_switch_verdict(t.literal(s, "switch_requests"), t.pipelines(s, d), poll.unsupported_pipelines(t.pipelines(s, d))),
    "consumer_heartbeat": _heartbeat,
    "dlq_single": _dlq_single,
    "sweep_loop": _sweep_loop,
    "truncate_delivered": lambda s, d: lifecycle.truncate_delivered(_summary(s, d)),
    "storage_conversion": lambda s, d: lifecycle.storage_conversion_verdict(t.literal(s, "conversions")),
    "id_range_layout": lambda s, d: lifecycle.to_id_ranges(_msg(s, d), SPAN).groupBy("id_bucket").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most")),
    "fan_in_next": lambda s, d: lifecycle.fan_in_next(t.literal(s, "fan_in"), t.literal(s, "fan_in_requests"), t.outbox_config(s, d)),
    "backfill_cancel": lambda s, d: lifecycle.backfill_cancel(t.literal(s, "backfills"), t.literal(s, "cancels")),
    "encryption_config_next": lambda s, d: lifecycle.encryption_config_next(t.literal(s, "keys"), t.literal(s, "key_updates")),
    "secret_masking": lambda s, d: t.literal(s, "secret_configs").select("pos", secure.masked(F.col("config")).alias("config")),
    "webhook_signature": lambda s, d: t.literal(s, "signed").select("pos", secure.signature(F.col("body"), SIGNING).alias("signature")),
    "payload_encryption": _opened,
    "capacity_plan": lambda s, d: metrics.capacity_plan(t.literal(s, "capacity")),
}
