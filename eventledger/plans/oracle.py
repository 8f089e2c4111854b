"""DuckDB SQL for the registered ledger queries, written apart from them: tables as CTEs, then one query each."""

from __future__ import annotations

import hashlib
import hmac
import json
import math
import re

from ..sources.tables import AS_OF, KINDS, LITERALS, PIPELINES

NOW = f"timestamp '{AS_OF}'"
_TYPES = {"string": "varchar", "bigint": "bigint", "int": "integer", "double": "double", "boolean": "boolean"}


def _value(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    return "'inf'::double" if isinstance(x, float) and math.isinf(x) else repr(x)


def _literal(name: str) -> str:
    schema, rows = LITERALS[name]
    columns = [c.split() for c in schema.split(", ")]
    values = ", ".join("(" + ", ".join(_value(x) for x in r) + ")" for r in rows)
    return f"select {', '.join(f'{c}::{_TYPES[k]} as {c}' for c, k in columns)} from (values {values}) as v({', '.join(c for c, _ in columns)})"


def _pipeline(p) -> str:
    name, enabled, source, outbox, sink, tenant, owner, fmt, batch = p
    config = {k: v for k, v in (("source_type", source), ("source", {"outbox": outbox}), ("sink_type", sink), ("batch_size", batch)) if v is not None}
    return "(" + ", ".join(_value(x) for x in (name, enabled, json.dumps(config, separators=(",", ":")), tenant, owner, fmt)) + ")"


def _kinds(row, skip=()) -> str:
    return ", ".join("(" + ", ".join(_value(x) for x in row(k)) + ")" for k in KINDS if k not in skip)


#: Signatures of the literal bodies by the standard library, under the secret of the fixtures.
_SIGNATURES = ", ".join(f"({pos}, 'sha256={hmac.new(b'a signing secret of the fixtures', body.encode(), hashlib.sha256).hexdigest()}')" for pos, body in LITERALS["signed"][1])

#: What is to be said of each literal address.
_HOOK_VERDICTS = ", ".join(
    f"({_value(u)}, '{v}')"
    for v, urls in {
        "private": """https://127.0.0.1/x https://169.254.169.254/latest https://10.1.2.3/ https://172.20.0.1/ https://192.168.0.9/ https://0.0.0.0/ https://[::1]/ https://[::]/
            https://[fd00::1]:8443/ https://[FE80::1]/ https://[ff02::1]/ https://[::ffff:127.0.0.1]/ https://[::ffff:a00:1]/ https://[2001:db8::5]/ https://100.64.0.1/ https://198.18.0.1/
            https://198.51.100.7/ https://192.0.2.9/ https://203.0.113.1/ https://192.88.99.1/ https://239.1.1.1/""".split(),
        "ok": "https://172.32.0.1/ https://8.8.8.8:443/x https://[::ffff:8.8.8.8]/ https://[2606:4700::1111]/ https://[1:2:3:4:5:6:7:8]/ https://100.128.0.1/ HTTPS://Example.org./x".split(),
        "scheme": "http://example.org/ ftp://example.org/".split(),
        "userinfo": "https://user@example.org/ https://user:pw@10.0.0.1/".split(),
        "fragment": ["https://example.org/#f"],
        "forbidden": "https://localhost/a https://metadata.google.internal/ https://localhost./ https://LOCALHOST:8443/ https://ip6-loopback/ https://metadata.azure.com./ https://instance-data.ec2.internal/".split(),
        "host": ["https://", "https://[fe80::1%25eth0]/", "https://[1:2]/", "https://[::1/", "https://127.1/", "https://0x7f000001/", "https://2130706433/", "https://1.2.3.999/", "https://example.org:bad/", None],
    }.items()
    for u in urls
)

#: Facts after each literal delivery: state, checkpoint, frontier, visible, duplicate possible, cleanup allowed, transient, refused, events.
_FACTS = [
    ("success", "cleanup_eligible", 7, 7, False, False, True, False, None, 5),
    ("ambiguous", "sink_accepted", 3, None, True, True, False, False, None, 3),
    ("accepted", "checkpoint_committed", 4, 4, False, True, False, False, None, 5),
    ("dry_run", "checkpoint_committed", 11, None, False, False, False, False, None, 3),
    ("filtered", "checkpoint_committed", 11, None, False, False, False, False, None, 3),
    ("dead", "checkpoint_committed", 13, None, False, False, False, False, None, 5),
    ("retry", "publish_failed", 17, None, True, False, False, True, None, 3),
    ("too_early", "publish_failed", 17, None, True, False, False, True, "checkpoint_committed", 5),
    ("illegal", "polled", 19, None, True, False, False, False, "checkpoint_committed", 1),
    ("other_frontier", "publish_started", 5, None, True, False, False, False, "sink_acknowledged", 4),
    ("next", "polled", 29, None, True, False, False, False, None, 6),
]

CTES = {
    "messages": """select event_id + 1 as id, event_type as outbox_name, props as payload,
        case when (event_id + 1) % 10 <> 0 then '{"event_type":"' || event_type || '.created"}' end as headers, ts::timestamp as created_at,
        case when (event_id + 1) % 3 = 0 then ts::timestamp + interval 1 hour end as consumed_at, 'insert' as op from events""",
    "tops": "select event_type as outbox_name, max(event_id) + 1 as mx from events group by 1",
    "outbox_config": f"select * from (values {_kinds(lambda k: (k, 24 * len(k), k != 'error', len(k) if k != 'view' else None))}) as v(outbox_name, retention_hours, enabled, resume_hours)",
    "grps": "select * from (values " + ", ".join(f"('{k}-g{g}', '{k}', {g})" for k in KINDS if k != "view" for g in (0, 1)) + ") as v(group_name, outbox_name, g)",
    "offsets": f"""select group_name, 'c' || c as consumer_name, floor(mx * (3 + g + c) / 10.0)::bigint as committed_offset, {NOW} - to_minutes(2 * g + c + 1) as last_heartbeat
        from grps cross join (values (0), (1)) as m(c) join tops using (outbox_name) where group_name <> 'signup-g1'""",
    "leases": f"""select group_name, consumer_name, committed_offset + 1 as lease_start, committed_offset + 100 as lease_end,
        case when group_name = 'click-g0' then {NOW} + interval 5 minute else {NOW} - interval 5 minute end as expires_at
        from offsets where (group_name, consumer_name) in (('click-g0', 'c0'), ('error-g0', 'c1'))
        union all select group_name, c, committed_offset + 1 + a, committed_offset + 1 + b, {NOW} + interval 5 minute from offsets, (values ('c8', 30, 60), ('c9', 75, 90)) as v(c, a, b) where group_name = 'click-g0' and consumer_name = 'c0'""",
    "pipelines": f"select *, config->>'$.source.outbox' as outbox, config->>'$.source_type' as source_type, config->>'$.sink_type' as sink_type from (values {', '.join(map(_pipeline, PIPELINES))}) as v(name, enabled, config, tenant_name, owner, wire_format)",
    "relay_offsets": f"""select g as relay_group_id, o || '-p' as pipeline_id, o as outbox_name, floor(mx * r / 10.0)::bigint as last_change_id, {NOW} - to_minutes(n) as updated_at
        from (values ('default', 'click', 6, 0), ('default', 'error', 5, 1), ('default', 'purchase', 9, 7), ('blue', 'click', 4, 90)) as v(g, o, r, n) join tops on o = outbox_name""",
    "inbox_config": f"select * from (values {_kinds(lambda k: (k, 'app', 3 + len(k) % 3, 72))}) as v(inbox_name, inbox_schema, max_retries, processed_retention_hours)",
    "inbox": """select id, outbox_name as inbox_name, 'outbox_' || outbox_name || ':' || id || ':0' as event_id, created_at + interval 1 minute as received_at,
        case when id % 3 = 0 then created_at + interval 2 hour end as processed_at, (id % 6)::int as retry_count, case when id % 6 > 0 then 'failure ' || (id % 6) end as last_error from messages""",
    "redelivery": """select i.inbox_name, i.event_id, i.id from inbox i cross join (values (0), (1)) as c(n) where i.id % 7 = 0
        union all select i.inbox_name, i.event_id || s, i.id from inbox i join tops on i.inbox_name = outbox_name cross join (values (''), ('-new'), ('-new')) as c(s) where i.id > mx - 10""",
    "dlq": """select id, 'error-p' as pipeline_name, 'error' as source_name, 'kafka' as sink_name, 'outbox_error:' || id || ':0' as dedup_key, 'message ' || (id % 3) as error_message,
        ['decode', 'sink_permanent', 'inbox_permanent', 'max_retries_exceeded'][(id // 4) % 4 + 1] as error_kind, (1 + id % 3)::int as attempt_count, created_at as first_failed_at,
        created_at + to_hours((id % 48)::int) as last_failed_at, id % 5 = 0 as resolved from messages where outbox_name = 'error' and id % 4 = 0""",
    "receipts": """select pipeline_id as pipeline_name, m.outbox_name, id as message_id, created_at + interval 30 second as delivered_at from messages m
        join relay_offsets o on m.outbox_name = o.outbox_name and relay_group_id = 'default' where id <= last_change_id and id % 2 = 0""",
    "parts": """select outbox_name, 'group:' || group_name as participant, coalesce(min(committed_offset), 0) as committed from grps left join offsets using (group_name) group by 1, 2
        union all select p.outbox, 'relay:' || name, coalesce(min(last_change_id), 0) from pipelines p left join relay_offsets r on p.name = r.pipeline_id and p.outbox = r.outbox_name where source_type = 'outbox' group by 1, 2""",
    "safe": "select c.outbox_name, min(committed) as safe_offset, count(participant) as participants from outbox_config c left join parts p using (outbox_name) group by 1",
    "blocked": f"select distinct outbox_name from leases join grps using (group_name) where expires_at > {NOW}",
    "aged": f"""select m.id, m.outbox_name, m.created_at < {NOW} - to_hours(retention_hours) as old, (safe_offset is null or id <= safe_offset) as free from messages m join outbox_config using (outbox_name) join safe using (outbox_name)""",
    "cand": "select * from (select outbox_name, id, row_number() over (partition by outbox_name order by id) as rn from aged where old and free) where rn <= 51",
    "summary": """select c.outbox_name, b.outbox_name is not null as blocked, case when b.outbox_name is null then coalesce(sum(case when rn <= 50 then 1 end), 0) else 0 end::bigint as deleted,
        case when b.outbox_name is null then max(case when rn <= 50 then id end) end as highest, b.outbox_name is null and count(rn) > 50 as has_more
        from outbox_config c left join cand using (outbox_name) left join blocked b on b.outbox_name = c.outbox_name group by c.outbox_name, b.outbox_name""",
    "status": f"""select c.outbox_name, enabled, count(m.id) as rows, coalesce(sum(strlen(payload) + coalesce(strlen(headers), 0)), 0)::bigint as bytes, min(created_at) as oldest, max(created_at) as newest,
        count(m.id) - count(consumed_at) as pending, coalesce(sum(old::int), 0)::bigint as expired, coalesce(sum((old and free)::int), 0)::bigint as eligible
        from outbox_config c left join messages m using (outbox_name) left join aged a on a.id = m.id group by 1, 2""",
    "claims": "select doc_id, strlen(text) > 4096 as checked, strlen(text)::bigint as size, text from documents",
    "subj": """select id, outbox_name, op, coalesce(nullif(case when id % 5 = 0 then 'fixed' else '' end, ''), case when id % 2 = 0 then 'ledger.{outbox}.{event_type}.{op}' end, '{outbox}.{op}') as spec,
        coalesce(headers->>'$.event_type', 'event') as event_type from messages""",
    "counter": "select series, minute, sum(n) over (partition by series order by minute)::bigint as value from (select event_type as series, date_trunc('minute', ts::timestamp) as minute, count(*) as n from events group by 1, 2)",
    "hourly": "select date_trunc('hour', ts::timestamp) as hour, event_type, count(*) as n from events group by 1, 2",
    "ratio": "select hour, round(1 - coalesce(sum(n) filter (event_type = 'error'), 0) / sum(n), 6)::double as ratio from hourly group by 1",
    "walk": """select distinct src, dst from (with recursive w(src, dst) as (select upstream, downstream from deps union select w.src, d.downstream from w join deps d on w.dst = d.upstream) select * from w)""",
}
CTES |= {name: _literal(name) for name in LITERALS}


def _needed_of(name: str) -> list[str]:
    out: list[str] = []
    for other in CTES:
        if other != name and re.search(rf"\b(from|join|\() *{other}\b|, *{other} [a-z]\b", CTES[name]):
            out += [x for x in _needed_of(other) if x not in out]
    return [*out, name]


def _sql(body: str) -> str:
    names = [n for n in dict.fromkeys(x for name in CTES if re.search(rf"\b(from|join) +{name}\b", body) for x in _needed_of(name))]
    return (f"with {', '.join(f'{n} as ({CTES[n]})' for n in names)}\n" if names else "") + body


_ACL = """select r.req, r.outbox_name, r.role, case when superuser then 'superuser' when owner then 'owner' when not publisher then 'denied_no_role'
    when r.outbox_name not in (select outbox_name from publishers) then 'denied_no_acl' when p.role is not null then 'allowed' else 'denied' end as verdict
    from publish_requests r left join publishers p on p.outbox_name = r.outbox_name and p.role = r.role"""

_BODIES = {
    "outbox_poll": "select id, outbox_name, payload, created_at from messages where outbox_name = 'click' and id > 40 order by id limit 25",
    "pipeline_poll_batches": """select pipeline_id, id, position from (select p.name as pipeline_id, m.id, row_number() over (partition by p.name order by m.id) as position, (config->>'$.batch_size')::int as batch
        from messages m join pipelines p on p.outbox = m.outbox_name and p.enabled left join relay_offsets o on o.pipeline_id = p.name and o.relay_group_id = 'default' where m.id > coalesce(last_change_id, 0)) where position <= batch""",
    "group_poll": f"""select group_name, consumer_name, id from (select o.group_name, o.consumer_name, m.id, row_number() over (partition by o.group_name, o.consumer_name order by m.id) as rn
        from messages m join grps g using (outbox_name) join offsets o using (group_name) where m.id > committed_offset and not exists (select 1 from leases l where l.group_name = o.group_name
        and l.consumer_name <> o.consumer_name and expires_at > {NOW} and m.id between lease_start and lease_end)) where rn <= 20""",
    "claim_check_encode": """select doc_id, checked, size, case when checked then '{"_cc":true,"oid":' || doc_id || ',"size":' || size || ',"dedup_key":"doc:' || doc_id || '"}' end as envelope from claims""",
    "claim_check_decode": "select doc_id, md5(text) as digest from documents",
    "envelope_expand": """select event_type as name, hour(ts::timestamp) as id, row_number() over (partition by event_type, hour(ts::timestamp) order by event_id % 2, event_id) - 1 as row_index,
        case when event_id % 2 = 0 then 'insert' else 'delete' end as op, event_id as value, event_type || ':' || hour(ts::timestamp) || ':' || (row_number() over (partition by event_type, hour(ts::timestamp) order by event_id % 2, event_id) - 1) as dedup_key from events""",
    "publisher_acl_verdict": _ACL,
    "publish_admission": f"""select req, case when c.outbox_name is null then 'no_outbox' when not enabled then 'disabled' when starts_with(verdict, 'denied') then 'denied' else 'admitted' end as admission
        from ({_ACL}) left join outbox_config c using (outbox_name)""",
    "inbox_dedup": "select inbox_name, event_id, min(id) as id from redelivery where event_id not in (select event_id from inbox) group by 1, 2",
    "inbox_dup_count": """select inbox_name, count(*) as received, count(distinct case when event_id not in (select event_id from inbox) then event_id end) as inserted,
        count(*) - count(distinct case when event_id not in (select event_id from inbox) then event_id end) as skipped from redelivery group by 1""",
    "webhook_idempotency_key": """select outbox_name, id // 7 as batch, case when count(*) = 1 then any_value(k) else 'batch-' || sha256(string_agg(repeat(chr(0), 7) || chr(strlen(k)::int) || k, '' order by id)) end as idempotency_key
        from (select outbox_name, id, 'outbox_' || outbox_name || ':' || id || ':0' as k from messages) group by 1, 2""",
    "sink_jsonl": """select id, '{"id":' || id || ',"outbox_name":"' || outbox_name || '","op":"insert","payload":"' || replace(payload, '"', '\\"') || '"}' as value from messages""",
    "unsupported_surface_check": "select name, sink_type as sink, case when sink_type in ('nats', 'kafka', 'webhook', 'inbox', 'pg_outbox', 'stdout') then 'supported' when sink_type in ('redis', 'sqs', 'rabbitmq') then 'removed' else 'unknown' end as verdict from pipelines",
    "enabled_pipelines": "select name, tenant_name from pipelines where enabled and tenant_name = 't1'",
    "publish_limits": """select *, case when n > 21 then 'too_many_messages' when largest > 8 then 'message_too_large' when bytes > 160 then 'batch_too_large' else 'ok' end as verdict from
        (select outbox_name, (id - 1) // 100 as batch, count(*) as n, max(strlen(payload)) as largest, sum(strlen(payload))::bigint as bytes from messages group by 1, 2)""",
    "replay_range": "select id, outbox_name from messages where id <= 300",
    "replay_preview": "select id, payload, created_at, consumed_at is not null as consumed from messages where outbox_name = 'click' and id between 10 and 500 order by id limit 40",
    "orphan_offsets": "select relay_group_id, pipeline_id, last_change_id from old_identities where pipeline_id not in (select name from pipelines)",
    "lease_blocked": "select outbox_name from blocked",
    "inbox_pending_rows": "select inbox_name, id, event_id, retry_count from inbox join inbox_config using (inbox_name) where processed_at is null and retry_count < max_retries",
    "unsupported_pipelines": """select * from (select name, case when coalesce(source_type, '') <> 'outbox' then 'source' when sink_type not in ('nats', 'kafka', 'webhook', 'inbox', 'pg_outbox', 'stdout') then 'sink'
        when wire_format not in ('native', 'cloudevents') then 'format' end as reason from pipelines) where reason is not null""",
    "unsupported_pipelines_list": """select string_agg(name, ',' order by name) as names from pipelines where coalesce(source_type, '') <> 'outbox' or sink_type not in ('nats', 'kafka', 'webhook', 'inbox', 'pg_outbox', 'stdout')
        or wire_format not in ('native', 'cloudevents')""",
    "trigger_policy_valid": "select policy, policy in ('always', 'on_idle') or regexp_full_match(policy, 'on_offset_gte\\([0-9]+\\)') as valid from policies",
    "identifier_valid": "select name, strlen(name) between 1 and 63 and not contains(name, '\"') as valid from identifiers",
    "subject_valid": "select subject, regexp_full_match(subject, '([^.*>]+|\\*)(\\.([^.*>]+|\\*))*(\\.>)?|>') as valid from subjects",
    # Verdicts on the literal addresses as the rules say them, one by one; page addresses are plain names.
    "url_guard": f"""select url, coalesce(v, case when not starts_with(url, 'https://') then 'scheme' when contains(url, '#') then 'fragment' else 'ok' end) as verdict, count(*) as n
        from (select url from pages union all select url from hook_urls) left join (values {_HOOK_VERDICTS}) as k(u, v) on url is not distinct from u group by 1, 2""",
    "tenant_visible": "select distinct g.role, p.name from principals g join pipelines p on g.admin or exists (select 1 from tenant_grants t where t.role = g.role and t.tenant_name = p.tenant_name)",
    "owner_visible": "select name, owner from pipelines where owner = 'ada'",
    "id_gap_lag": "select group_name, consumer_name, outbox_name, committed_offset, mx - committed_offset as lag from grps join offsets using (group_name) join tops using (outbox_name)",
    "exact_lag": """select relay_group_id, pipeline_id, outbox_name, last_change_id, (select count(*) from messages m where m.outbox_name = o.outbox_name and m.id > o.last_change_id) as lag
        from relay_offsets o join pipelines p on p.name = o.pipeline_id and p.source_type = 'outbox' and p.outbox = o.outbox_name""",
    "retention_status": f"""select s.*, least(eligible, 10001) as bounded_eligible, floor(epoch({NOW}) - epoch(oldest))::bigint as oldest_age_s, safe_offset, participants, coalesce(highest_deleted_id, 0) as highest_deleted_id,
        coalesce(total_rows_deleted, 0) as total_rows_deleted from status s join safe using (outbox_name) left join cleanup_state using (outbox_name)""",
    "outbox_status": "select outbox_name, rows, pending, eligible from status where outbox_name = 'click'",
    "retention_participants": "select outbox_name, string_agg(participant || '=' || committed, ',' order by participant) as participants from parts group by 1",
    "safe_offset": "select outbox_name, safe_offset, participants from safe",
    "outbox_pending": "select outbox_name, count(*) as pending, min(created_at) as oldest, max(id) as max_id from messages where consumed_at is null group by 1",
    "pipeline_status": """select p.name, case when not enabled then 'disabled' when heartbeat is null then 'unknown' when heartbeat > 2 then 'stale' when last_error_class is not null then 'degraded' else 'running' end as state,
        coalesce(last_change_id, 0) as checkpoint, coalesce(depth, 0) as dlq_depth from pipelines p left join runtime r on r.pipeline_name = p.name and coalesce(grp, 'default') = 'default'
        left join relay_offsets o on o.pipeline_id = p.name and o.relay_group_id = 'default' left join (select pipeline_name, count(*) as depth from dlq where not resolved group by 1) d on d.pipeline_name = p.name""",
    "status_compat": f"""select p.name, last_change_id as checkpoint, case when updated_at is null then 'unknown' when updated_at < {NOW} - interval 5 minute then 'stale' else 'fresh' end as state
        from pipelines p left join lateral (select last_change_id, updated_at from relay_offsets o where o.pipeline_id = p.name order by updated_at desc, relay_group_id desc limit 1) on true""",
    "dag_cycle": "select src as node from walk where src = dst",
    "dag_edge_verdict": """select req, case when upstream = downstream then 'self' when not (policy in ('always', 'on_idle') or regexp_full_match(policy, 'on_offset_gte\\([0-9]+\\)')) then 'policy'
        when exists (select 1 from walk where src = downstream and dst = upstream) then 'cycle' else 'ok' end as verdict from edge_requests""",
    "fanin_participants": "select name, unnest(string_split(members, ',')) as outbox_name from fan_in",
    "schema_drift": """select stream, property, case when o.kind is null then 'added' when n.kind is null then 'removed' else 'changed' end as change, o.kind as old_kind, n.kind as new_kind
        from (select * from schema_log where logged = 100) n full join (select * from schema_log where logged = 200) o using (pipeline, tap, stream, property) where n.kind is distinct from o.kind""",
    "schema_fingerprint": "select pipeline, stream, logged, string_agg(property, ',' order by property) as columns, sha256(string_agg(property, ',' order by property)) as fingerprint from schema_log group by 1, 2, 3",
    "lake_column_history": "select table_name, column_name, kind, begin_snapshot, end_snapshot from lake_columns join lake_tables using (table_id) join lake_schemas using (schema_id) where schema_name = 'main'",
    "lake_pipeline_names": "select name, 'lake_' || replace(name, '-', '_') as lake_name from pipelines",
    "offset_outbox_backfill": "select relay_group_id, pipeline_id, coalesce(i.outbox_name, p.outbox, '') as outbox_name, last_change_id from old_identities i left join pipelines p on p.name = i.pipeline_id",
    "duplicate_offset_identities": "select count(*) as groups, coalesce(sum(n - 1), 0)::bigint as surplus from (select count(*) as n from old_identities group by relay_group_id, pipeline_id having count(*) > 1)",
    "auto_resume_candidates": "select pipeline_name, p.outbox as outbox_name, paused from pipeline_state s join pipelines p on p.name = s.pipeline_name and p.enabled join outbox_config c on c.outbox_name = p.outbox where paused >= resume_hours * 60",
    "dlq_stats": "select pipeline_name, error_kind, count(*) as total, count(*) filter (not resolved) as unresolved from dlq group by 1, 2",
    "dlq_depth": "select pipeline_name, count(*) as depth from dlq where not resolved group by 1",
    "dlq_root_causes": "select error_kind, error_message, count(*) as n from dlq where not resolved group by 1, 2 order by 3 desc, 1, 2 limit 10",
    "dlq_by_kind": "select pipeline_name, error_kind, count(*) as n, max(last_failed_at) as latest from dlq group by 1, 2",
    "dlq_list": "select id, dedup_key, error_kind, attempt_count, first_failed_at from dlq where not resolved order by first_failed_at, id",
    "dlq_insert": """select pipeline_name, dedup_key, resolved from dlq union all select 'error-p', 'outbox_error:' || id || ':0', false from messages
        where outbox_name = 'error' and id % 2 = 0 and 'outbox_error:' || id || ':0' not in (select dedup_key from dlq where not resolved)""",
    "dlq_retry_all": f"select id, resolved, case when not resolved then {NOW} end as retried_at, attempt_count + (not resolved)::int as attempt_count from dlq",
    "dlq_purge": f"select id, resolved, last_failed_at from dlq where not resolved or last_failed_at >= {NOW} - interval 10 day",
    "dlq_requeue": "select pipeline_name, dedup_key, source_name, sink_name, error_kind, error_message, 0 as attempt_count, false as resolved from dlq where resolved",
    "delivery_confirm": "select count(*) as confirmed, max(delivered_at) as latest from receipts where outbox_name = 'click' and message_id between 10 and 400",
    "receipts_prune": f"select pipeline_name, message_id, delivered_at from receipts where delivered_at >= {NOW} - interval 600 hour",
    "inbox_status": "select inbox_name, count(*) filter (processed_at is null and retry_count < max_retries) as pending, count(*) filter (processed_at is null and retry_count >= max_retries) as dlq from inbox join inbox_config using (inbox_name) where inbox_name = 'click' group by 1",
    "inbox_fleet_status": """select c.inbox_name, max_retries, count(id) as total, count(id) filter (processed_at is null and retry_count < max_retries) as pending,
        count(id) filter (processed_at is null and retry_count >= max_retries) as dlq, count(processed_at) as processed from inbox_config c left join inbox using (inbox_name) group by 1, 2""",
    "inbox_fleet_summary": "select inbox_name, inbox_schema, max_retries, processed_retention_hours from inbox_config order by 1",
    "inbox_triage": "select count(processed_at) as processed, count(*) filter (processed_at is null and retry_count = 0) as waiting, count(*) filter (processed_at is null and retry_count > 0) as failing from inbox",
    "inbox_mark_processed": "select inbox_name, count(*) filter (id % 3 = 0 or id % 4 = 0) as processed, count(*) filter (id % 4 = 0 and id % 3 <> 0) as now from inbox group by 1",
    "inbox_mark_failed": "select inbox_name, sum(retry_count + (id % 9 = 0)::int)::bigint as retries, count(*) filter (id % 9 = 0) as boom from inbox group by 1",
    "inbox_replay": """select inbox_name, count(*) filter (id % 5 = 0 and processed_at is null) as replayed, sum(case when id % 5 = 0 and processed_at is null then 0 else retry_count end)::bigint as retries,
        count(last_error) filter (not (id % 5 = 0 and processed_at is null)) as errors from inbox group by 1""",
    "inbox_retention": f"select inbox_name, id from inbox where processed_at is null or processed_at >= {NOW} - interval 72 hour",
    "doctor_checks": f"select (select count(*) from cleanup_state where age > 1440) as stale_cleanup, (select count(*) from dlq where first_failed_at >= {NOW} - interval 72 hour) as recent_dlq",
    "payload_group_summary": "select payload->>'$.k' as k, count(*) as n, max(created_at)::date as latest from messages group by 1",
    "event_type_totals": "select event_type, count(*) as n, round(sum(value), 4) as total, sum((props->>'$.k')::bigint)::bigint as sum_k from events group by 1",
    "latency_percentiles": """select event_type, max(value) filter (rn - 1 = floor((n - 1) * 0.5 + 0.5)) as p50, max(value) filter (rn - 1 = floor((n - 1) * 0.95 + 0.5)) as p95, max(value) filter (rn - 1 = floor((n - 1) * 0.99 + 0.5)) as p99
        from (select event_type, value, row_number() over (partition by event_type order by value, event_id) as rn, count(*) over (partition by event_type) as n from events) group by 1""",
    "budget_regression": """select metric, b as base, w as now, round(band, 6) as band, case when (direction = 'max' and w > bound) or (direction = 'min' and w < bound) then 'over_budget'
        when (case when direction = 'max' then w - b else b - w end) > greatest(band, b * tier_pct / 100) then 'regressed' else 'ok' end as verdict from (select *, greatest(floor_value, 3 * bm, 3 * wm, b * pct / 100) as band from budgets join
        (select metric, median(v) as b, mad(v) as bm from budget_samples where run = 'base' group by 1) using (metric) join (select metric, median(v) as w, mad(v) as wm from budget_samples where run = 'now' group by 1) using (metric))""",
    "latest_offsets": "select pipeline_id, relay_group_id, last_change_id, updated_at from relay_offsets qualify row_number() over (partition by pipeline_id order by updated_at desc, relay_group_id) = 1",
    "sweep_candidates": "select outbox_name, id from cand where rn <= 50",
    "sweep_summary": "select outbox_name, blocked, deleted, highest, has_more from summary",
    "sweep_apply": "select id, outbox_name from messages where id not in (select id from cand where rn <= 50 and outbox_name not in (select outbox_name from blocked))",
    "cleanup_state_next": """select outbox_name, greatest(coalesce(highest_deleted_id, 0), coalesce(highest, 0)) as highest_deleted_id, coalesce(total_rows_deleted, 0) + coalesce(deleted, 0) as total_rows_deleted, deleted as last_batch_rows
        from summary full join cleanup_state using (outbox_name)""",
    "partition_plan": """select b as bucket, b * 1000 as from_id, (b + 1) * 1000 as to_id, count(id) as rows from (select unnest(range((select min(id) // 1000 from messages), (select max(id) // 1000 + 3 from messages))) as b)
        left join messages on id // 1000 = b group by 1""",
    "config_history": "select id, changed_by, age, batch from config_audit where pipeline_name = 'click-p' and age <= 450 order by age, id desc limit 2",
    "config_changes": """select id, pipeline_name, o as old, batch as new, case when o is null then 'INSERT' else 'UPDATE' end as action from
        (select *, lag(batch) over (partition by pipeline_name order by age desc, id) as o from config_audit) where o is distinct from batch""",
    "offset_snapshot_range": "select min_by(snapshot_id, first_offset) filter (first_offset >= 50) as from_snapshot, max_by(snapshot_id, first_offset) filter (first_offset <= 150) as to_snapshot from lake_map where pipeline = 'click-p'",
    "last_snapshot": "select pipeline, max(snapshot_id) as snapshot_id from lake_map group by 1",
    "configured_pipelines": "select name, 'outbound' as direction, enabled, tenant_name from pipelines union all select inbox_name || '-in', 'inbound', true, 'default' from inbox_config",
    "relay_list_configs": "select name, enabled, tenant_name, owner, sink_type from pipelines order by name",
    "relay_config_normalize": """select name, coalesce(source_type, 'outbox') as source_type, outbox, (config->>'$.batch_size')::int as batch_size, case when outbox is null then 'outbox' when coalesce(source_type, '') <> 'outbox' then 'source_type'
        when (config->>'$.batch_size')::int not between 1 and 10000 then 'batch_size' when wire_format not in ('native', 'cloudevents') then 'wire_format' end as problem from pipelines""",
    "commit_offsets": """select group_name, consumer_name, case when new_offset >= 0 and new_offset >= coalesce(committed_offset, 0) then new_offset else committed_offset end as committed_offset,
        case when new_offset is null then 'kept' when new_offset < 0 then 'negative' when new_offset < committed_offset then 'backwards' else 'committed' end as verdict from offsets full join commits using (group_name, consumer_name)""",
    "relay_offset_merge": """select relay_group_id, pipeline_id, outbox_name, max(last_change_id) as last_change_id from (select relay_group_id, pipeline_id, outbox_name, last_change_id from relay_offsets
        union all select * from relay_updates) group by 1, 2, 3""",
    "rewind_verdict": """select req, case when not confirm then 'not_confirmed' when committed_offset is null then 'unknown_consumer' when target < 0 then 'negative' when target > committed_offset then 'forward'
        when target < coalesce(highest_deleted_id, 0) then 'deleted' else 'allowed' end as verdict from rewinds left join offsets using (group_name, consumer_name) left join grps using (group_name) left join cleanup_state using (outbox_name)""",
    "template_validate": """select call, name, coalesce(string_agg(k, ',' order by k), '') as missing, count(k) = 0 as valid from calls join templates using (name)
        left join (select c.call as mc, u.k from calls c join (select name as tn, unnest(string_split(required, ',')) as k from templates where required <> '') u on u.tn = c.name
          where not exists (select 1 from overrides o where o.call = c.call and o.k = u.k)) on mc = call group by 1, 2""",
    "template_render": """select call, key, case when call = 1 and key = 'subject' then 'orders.new' when call = 2 and key = 'subject' then 'x.{{kind}}' when call = 3 and key = 'url' then 'https://example.org/in' else value end as value
        from (select c.call, u.key, u.value from calls c join (select name, unnest(json_keys(config)) as key, config->>unnest(json_keys(config)) as value from templates) u using (name))""",
    "template_list": "select name, description, required from templates order by name",
    "pipeline_state_merge": """select pipeline_name, case when n.failure_count is not null then n.last_error else s.last_error end as last_error,
        case when n.failure_count is null then paused when n.failure_count = 0 then null else coalesce(paused, 0) end as paused, coalesce(n.failure_count, s.failure_count) as failure_count
        from pipeline_state s full join state_updates n using (pipeline_name)""",
    "pause_reason": "select pipeline_name, last_error, error_class, paused, failure_count from pipeline_state where pipeline_name = 'click-p' and paused is not null",
    "runtime_status_merge": """select coalesce(o.grp, 'default') as grp, pipeline_name, coalesce(n.owner_token, o.owner_token) as owner_token,
        case when n.owner_token is null or n.owner_token is not distinct from o.owner_token then owner_acquired else 0 end as owner_acquired,
        coalesce(n.heartbeat, o.heartbeat) as heartbeat, coalesce(n.last_error_class, o.last_error_class) as last_error_class from runtime o full join runtime_new n using (pipeline_name)""",
    "dedup_key": "select id, 'outbox_' || outbox_name || ':' || id || ':0' as dedup_key from messages",
    "subject_spec": "select id, spec from subj",
    "subject_render": "select id, replace(replace(replace(spec, '{outbox}', outbox_name), '{op}', op), '{event_type}', event_type) as subject from subj",
    "topic_resolve": "select id, 's1.app.' || outbox_name as topic from messages",
    "wire_native_encode": """select id, '{"outbox_id":' || id || ',"op":"insert","stream_table":"' || outbox_name || '","payload":' || payload || '}' as value from messages""",
    "wire_native_decode": "select pos, coalesce(record->>'$.op', record->>'$.operation', 'event') as op, record->>'$.stream_table' as stream_table, coalesce(record->>'$.dedup_key', 'pos:' || pos) as dedup_key, (record->>'$.payload.a')::bigint as a from wire_in where record is not null",
    "wire_cloudevents_encode": """select id, '{"specversion":"1.0","id":"' || outbox_name || ':' || id || '","type":"io.ledger.insert","source":"/outbox/' || outbox_name || '","time":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') || '","data":' || payload || '}' as value from messages""",
    "wire_cloudevents_decode": """select pos, record->>'$.specversion' = '1.0' as valid, case when record->>'$.specversion' = '1.0' then coalesce(ce_op, nullif(regexp_extract(record->>'$.type', '\\.(insert|update|delete)$', 1), ''), 'event') end as op,
        record->>'$.id' as id, record->>'$.source' as source from cloud_in""",
    "encrypted_detect": "select pos, coalesce(payload->>'$._enc' = 'true', false) as encrypted from secret_payloads",
    "backfill_progress": """select name, status, case when rows_total > 0 then round(100.0::double * rows_processed / rows_total, 2) end as pct_complete,
        case when status = 'running' and rows_total > 0 then round((rows_total - rows_processed) / greatest(rows_processed::double / nullif(age_s, 0), 0.001), 6) end as eta_s from backfills""",
    "date_partition_bounds": "select 'p' || strftime(f, '%Y%m%d') as name, f as from_ts, f + interval 7 day as to_ts, n from (select date_trunc('week', created_at)::timestamp as f, count(*) as n from messages group by 1)",
    "delivery_fsm": f"""select f.* from (select distinct message from fsm_events) join (values {", ".join("(" + ", ".join(map(_value, r)) + ")" for r in _FACTS)})
        as f(message, state, checkpoint, acknowledged_frontier, source_visible, duplicate_possible, cleanup_allowed, failure_transient, refused, n_events) using (message)""",
    "breaker_trace": """select * from (with recursive f as (select -1::bigint as pos, true as allowed, 'closed' as state, 0 as n, 0::bigint as opened union all
        select pos, allowed, case when not allowed then 'open' when was = 'half_open' then case when not ok then 'open' when n + 1 >= 3 then 'closed' else 'half_open' end when not ok and n + 1 >= 5 then 'open' else 'closed' end,
          case when not allowed or (was = 'half_open' and (not ok or n + 1 >= 3)) or (was = 'closed' and (ok or n + 1 >= 5)) then 0 else n + 1 end,
          case when allowed and not ok and (was = 'half_open' or n + 1 >= 5) then at_s else opened end
        from (select e.pos, at_s, ok, opened, case when state = 'open' and at_s - opened >= 30 then 'half_open' else state end as was, state = 'open' and at_s - opened < 30 as refused,
          not refused as allowed, case when state = 'open' then 0 else n end as n from f join breaker_events e on e.pos = f.pos + 1)) select pos, allowed, state from f where pos >= 0)""",
    "publish_directive": """select pos, case when outcome = 'success' then 'continue' when outcome = 'breaker_open' then if(dlq, 'dead_letter:sink_permanent', 'backoff')
        when error_code in ('authentication', 'invalid_config') then if(dlq, 'dead_letter:sink_permanent', 'stop') when dlq and attempts > max_retries then 'dead_letter:max_retries_exceeded' else 'backoff' end as directive from outcomes""",
    "error_class": "select code, if(code in ('unavailable', 'timeout', 'throttled', 'unknown', 'other'), 'transient', 'permanent') as cls from error_codes",
    "status_code": """select status, case when status // 100 = 2 then null when status in (408, 425, 429) or status // 100 = 5 then 'throttled' when status // 100 = 3 then 'invalid_destination'
        when status in (401, 403) then 'authentication' when status // 100 = 4 then 'protocol_rejection' else 'unknown' end as code from statuses""",
    "outbox_lifecycle": """select req, case when action like 'create%' then case when outbox_name = '' then 'invalid_name' when strategy = 'hourly' then 'invalid_strategy' when trim(strategy, chr(39)) <> 'none' and length(outbox_name) > 35 then 'name_too_long'
        when o is null then 'created' when action = 'create' then 'exists' else 'unchanged' end when o is null then case when action = 'drop_if_present' then 'unchanged' else 'missing' end
        else case action when 'drop' then 'dropped' when 'enable' then 'enabled' else 'disabled' end end as verdict from outbox_requests left join (select outbox_name, 1 as o from outbox_config) using (outbox_name)""",
    "outbox_config_next": """select outbox_name, retention_hours, coalesce((select action = 'enable' from outbox_requests r where r.outbox_name = c.outbox_name and action in ('enable', 'disable') order by req desc limit 1), enabled) as enabled
        from outbox_config c where outbox_name <> 'signup' union all select outbox_name, retention_hours, true from outbox_requests where req in (1, 4, 6, 16)""",
    "outbox_drop_cascade": """select 'messages' as part, count(*) as n from messages where outbox_name <> 'click' union all select 'groups', count(*) from grps where outbox_name <> 'click'
        union all select 'offsets', count(*) from offsets where not starts_with(group_name, 'click-') union all select 'leases', count(*) from leases where not starts_with(group_name, 'click-')""",
    "group_lifecycle": """select req, case when action like 'create%' then case when not exists (select 1 from outbox_config c where c.outbox_name = r.outbox_name) then 'no_outbox' when p then case when action = 'create' then 'exists' else 'unchanged' end
        when reset = 'odd' then 'invalid_reset' else 'created' end when p then 'dropped' when action = 'drop' then 'missing' else 'unchanged' end as verdict from (select *, exists (select 1 from grps g where g.group_name = q.group_name) as p from group_requests q) r""",
    "groups_next": """select group_name, outbox_name, 'earliest' as auto_offset_reset from grps where group_name <> 'error-g1' union all values ('click-new', 'click', 'latest'), ('view-new', 'view', 'none')""",
    "publishers_next": "select outbox_name, role from publishers where (outbox_name, role) not in (('click', 'job')) union values ('view', 'eye'), ('view', 'b')",
    "inbox_lifecycle": """select req, case when action = 'create' then case when inbox_schema = '' then 'invalid_name' when exists (select 1 from inbox_config c where c.inbox_name = r.inbox_name) then 'exists' else 'created' end
        when exists (select 1 from inbox_config c where c.inbox_name = r.inbox_name) then 'dropped' when action = 'drop' then 'missing' else 'unchanged' end as verdict from inbox_requests r""",
    "inbox_config_next": "select inbox_name, inbox_schema, max_retries from inbox_config where inbox_name <> 'view' union all select inbox_name, inbox_schema, max_retries from inbox_requests where req = 1",
    "tenant_grants_next": "select tenant_name, role from tenant_grants except values ('t1', 'r1') union values ('t0', 'r2')",
    "pipeline_tenant_next": "select name, coalesce(tenant, tenant_name) as tenant_name from pipelines left join (select name, tenant from tenant_moves where tenant <> '' qualify row_number() over (partition by name order by req desc) = 1) using (name)",
    "pipeline_switch": """select req, r.name, case when p.name is null then 'missing' when action = 'enable' and (source_type is null or sink_type = 'redis') then 'unsupported' else action || 'd' end as verdict from switch_requests r left join pipelines p on p.name = r.name""",
    "consumer_heartbeat": f"select group_name, consumer_name, committed_offset, coalesce({NOW} - to_minutes(m::int), last_heartbeat) as last_heartbeat from offsets left join (select group_name, consumer_name, min(minutes) as m from beats group by 1, 2) using (group_name, consumer_name)",
    "dlq_single": f"select id, case id % 3 when 1 then false when 2 then true else resolved end as resolved, case when id % 3 = 1 then {NOW} end as retried_at from dlq",
    "sweep_loop": f"""select outbox_name, b is not null as failed, case when b is not null then 0 else least(coalesce(n, 0), 200) end as affected_rows, case when b is not null then 0 else least(4, greatest(1, (coalesce(n, 0) + 49) // 50)) end as completed_batches,
        b is null and coalesce(n, 0) > 200 as has_more from outbox_config left join (select m.outbox_name, count(*) as n from messages m join outbox_config c using (outbox_name) join safe s using (outbox_name)
        where created_at < {NOW} - to_hours(c.retention_hours) and (safe_offset is null or id <= safe_offset) group by 1) using (outbox_name)
        left join (select distinct outbox_name, true as b from leases join grps using (group_name) where expires_at > {NOW}) using (outbox_name)""",
    "truncate_delivered": "select sum(deleted)::bigint as deleted from summary",
    "storage_conversion": "select * from (values (1, 'converted'), (2, 'not_confirmed'), (3, 'not_allowed'), (4, 'unchanged'), (5, 'refused'), (6, 'invalid_range'), (7, 'invalid_range')) as v(req, verdict)",
    "id_range_layout": "select id // 1000 as id_bucket, count(*) as n, min(id) as least, max(id) as most from messages group by 1",
    "fan_in_next": "select * from (values ('all', 'click,view'), ('one', 'signup'), ('fresh', 'purchase')) as v(name, members)",
    "backfill_cancel": """select name, case when c and status in ('pending', 'running', 'paused') then 'failed' else status end as status, case when c and status in ('pending', 'running', 'paused') then 'cancelled by operator' end as error_message
        from (select *, name in (select name from cancels) as c from backfills)""",
    "encryption_config_next": "select * from (values ('click', 'vault', 'k2'), ('view', 'aws', 'arn'), ('error', 'gcp', 'g2')) as v(outbox_name, kms, key_id)",
    "secret_masking": """select pos, regexp_replace(config, '"([^"\\\\]|\\\\.)*\\$\\{(env|file):([^"\\\\]|\\\\.)*"', '"[REDACTED]"', 'g') as config from secret_configs""",
    "webhook_signature": f"select * from (values {_SIGNATURES}) as v(pos, signature)",
    "payload_encryption": "select id, payload, id % 2 = 0 as lost from messages",
    "tumbling_counts": "select event_type, date_trunc('hour', ts::timestamp) as start, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
    "counter_rate": """select series, date_trunc('hour', minute) as start, round(sum(rise) / 3600.0, 6)::double as rate from (select series, minute, coalesce(value - lag(value) over (partition by series order by minute), 0) as rise from counter) group by 1, 2""",
    "histogram_quantile": """select grp, round(case when le = 'inf'::double then low else low + (le - low) * (0.99::double * total - prev) / greatest(n - prev, 1) end, 6) as value from (select *, coalesce(lag(le) over w, 0.0) as low, coalesce(lag(n) over w, 0) as prev,
        max(n) over (partition by grp) as total from hist_samples window w as (partition by grp order by le)) where n >= 0.99::double * total and prev < 0.99::double * total""",
    "success_ratio": "select hour, ratio from ratio",
    "throughput_drop": "select a.event_type, a.hour, a.n, b.n as before from hourly a join hourly b on a.event_type = b.event_type and a.hour = b.hour + interval 1 day where a.n < 0.5 * b.n",
    "lag_slope": "select series, minute::date as day, round(regr_slope(value::double, epoch(minute) - epoch(minute::date::timestamp)), 6) as slope from counter group by 1, 2",
    "alerts_firing": """select min(hour) as since, count(*) as hours from (select hour, hour - to_hours(row_number() over (order by hour)) as run from ratio where ratio < 0.8) group by run having count(*) >= 2""",
    "capacity_plan": "select name, round(rate * outage_s * bytes_per_msg, 6) as disk_bytes, case when drain_rate > rate then round(rate * outage_s / (drain_rate - rate), 6) end as recovery_s from capacity",
}

ORACLES = {k: _sql(v) for k, v in _BODIES.items()}
