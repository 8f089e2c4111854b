"""Changes to the catalog as functions: what becomes of each request, and the table after those that are granted.

A request is judged against the catalog as it is; of several granted requests for one name in a batch the last counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wire import identifier_valid

#: How outboxes may be cut into partitions, where a new consumer group may begin (fixed values).
STRATEGIES, RESETS = ("none", "daily", "weekly", "monthly"), ("earliest", "latest", "none")
#: Bytes that partition tables put before an outbox's name, and the longest table name.
PREFIX_BYTES, NAME_BYTES = 28, 63


def _known(requests: DataFrame, catalog: DataFrame, key: str, name: str = "present") -> DataFrame:
    have = catalog.select(key).distinct().withColumn(name, F.lit(True))
    return requests.join(have, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _last(granted: DataFrame, *key: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col("req").desc()))
    return granted.withColumn("rank", rank).where("rank = 1").drop("rank")


def _verdict(action: Column, present: Column, invalid: Column) -> Column:
    """For create, create_if_missing, drop, drop_if_present, enable, disable; invalid is null or why a creation is refused."""
    return (
        F.when(action.startswith("create"), F.when(invalid.isNotNull(), invalid).when(~present, "created").when(action == "create", "exists").otherwise("unchanged"))
        .when(~present, F.when(action == "drop_if_present", "unchanged").otherwise("missing"))
        .when(action.startswith("drop"), "dropped").when(action == "enable", "enabled").when(action == "disable", "disabled").otherwise("unknown_action")
    )


def outbox_verdict(requests: DataFrame, config: DataFrame) -> DataFrame:
    """requests with a verdict; a partitioned outbox's name must leave room for the names of its tables."""
    strategy = F.trim(F.col("strategy"), F.lit("'"))
    long_ = (strategy != "none") & (F.octet_length(F.replace("outbox_name", F.lit("-"), F.lit("_"))) + PREFIX_BYTES > NAME_BYTES)
    invalid = F.when(~identifier_valid(F.col("outbox_name")), "invalid_name").when(~strategy.isin(*STRATEGIES), "invalid_strategy").when(long_, "name_too_long")
    rows = _known(requests, config, "outbox_name")
    return rows.select("req", "action", "outbox_name", "retention_hours", _verdict(F.col("action"), F.col("present"), invalid).alias("verdict"))


def outbox_config_next(config: DataFrame, requests: DataFrame) -> DataFrame:
    granted = _last(outbox_verdict(requests, config).where("verdict in ('created', 'dropped', 'enabled', 'disabled')"), "outbox_name")
    both = config.select("outbox_name", F.col("retention_hours").alias("held"), "enabled").join(granted.select("outbox_name", "retention_hours", "verdict"), "outbox_name", "full_outer")
    enabled = F.when(F.col("verdict") == "enabled", True).when(F.col("verdict") == "disabled", False).otherwise(F.coalesce("enabled", F.lit(True)))
    return both.where("verdict is null or verdict <> 'dropped'").select("outbox_name", F.coalesce("held", "retention_hours").alias("retention_hours"), enabled.alias("enabled"))


def outbox_drop_cascade(dropped: DataFrame, messages: DataFrame, groups: DataFrame, offsets: DataFrame, leases: DataFrame) -> tuple[DataFrame, ...]:
    """Messages, groups, offsets and leases without those of dropped outboxes."""
    left = groups.join(dropped, "outbox_name", "left_anti")
    of_left = lambda rows: rows.join(left.select("group_name"), "group_name", "left_semi")
    return messages.join(dropped, "outbox_name", "left_anti"), left, of_left(offsets), of_left(leases)


def group_verdict(requests: DataFrame, groups: DataFrame, config: DataFrame) -> DataFrame:
    """A group needs its outbox; whether it is there already is seen before where it may begin."""
    rows = _known(_known(requests, groups, "group_name"), config, "outbox_name", "has_outbox")
    creates = F.col("action").startswith("create")
    invalid = F.when(~F.col("has_outbox"), "no_outbox").when(~F.col("present") & ~F.col("reset").isin(*RESETS), "invalid_reset")
    return rows.select("req", "action", "group_name", "outbox_name", "reset", _verdict(F.col("action"), F.col("present"), F.when(creates, invalid)).alias("verdict"))


def groups_next(groups: DataFrame, requests: DataFrame, config: DataFrame) -> DataFrame:
    granted = _last(group_verdict(requests, groups, config).where("verdict in ('created', 'dropped')"), "group_name")
    kept = groups.join(granted.where("verdict = 'dropped'"), "group_name", "left_anti").select("group_name", "outbox_name", "auto_offset_reset")
    return kept.unionByName(granted.where("verdict = 'created'").select("group_name", "outbox_name", F.col("reset").alias("auto_offset_reset")))


def grants_next(grants: DataFrame, requests: DataFrame, subject: str) -> DataFrame:
    """(subject, role) after grants and revocations; both may be repeated. Names that aren't valid are left out."""
    valid = identifier_valid(F.col(subject)) & identifier_valid(F.col("role"))
    last = _last(requests.where(valid & F.col("action").isin("grant", "revoke")), subject, "role")
    kept = grants.select(subject, "role").join(last.where("action = 'revoke'"), [subject, "role"], "left_anti")
    return kept.unionByName(last.where("action = 'grant'").select(subject, "role")).distinct()


def publishers_next(publishers: DataFrame, requests: DataFrame, config: DataFrame) -> DataFrame:
    """Publish rights; only those on outboxes that are there can be granted."""
    there = requests.join(config.select("outbox_name"), "outbox_name", "left_semi")
    return grants_next(publishers, there.unionByName(requests.where("action = 'revoke'")).distinct(), "outbox_name")


def inbox_verdict(requests: DataFrame, config: DataFrame) -> DataFrame:
    invalid = F.when(~identifier_valid(F.col("inbox_name")) | ~identifier_valid(F.col("inbox_schema")), "invalid_name")
    rows = _known(requests, config, "inbox_name")
    return rows.select("req", "inbox_name", "inbox_schema", "max_retries", _verdict(F.col("action"), F.col("present"), invalid).alias("verdict"))


def inbox_config_next(config: DataFrame, requests: DataFrame) -> DataFrame:
    granted = _last(inbox_verdict(requests, config).where("verdict in ('created', 'dropped')"), "inbox_name")
    columns = ["inbox_name", "inbox_schema", "max_retries"]
    kept = config.join(granted.where("verdict = 'dropped'"), "inbox_name", "left_anti").select(*columns)
    return kept.unionByName(granted.where("verdict = 'created'").select(*columns))


def pipeline_tenant_next(pipelines: DataFrame, requests: DataFrame) -> DataFrame:
    """Pipelines after they were handed to tenants."""
    last = _last(requests.where(identifier_valid(F.col("tenant"))), "name").select("name", "tenant")
    return pipelines.join(last, "name", "left").select("name", F.coalesce("tenant", "tenant_name").alias("tenant_name"))


def pipeline_switch_verdict(requests: DataFrame, pipelines: DataFrame, unsupported: DataFrame) -> DataFrame:
    """enable, disable or delete by name; only pipelines of the supported surface can be enabled."""
    rows = _known(_known(requests, pipelines, "name"), unsupported, "name", "bad")
    verdict = F.when(~F.col("present"), "missing").when((F.col("action") == "enable") & F.col("bad"), "unsupported").otherwise(F.concat("action", F.lit("d")))
    return rows.select("req", "name", verdict.alias("verdict"))


def heartbeat_next(offsets: DataFrame, beats: DataFrame) -> DataFrame:
    """Members after heartbeats; one that never committed has no row and gets none."""
    last = beats.groupBy("group_name", "consumer_name").agg(F.max("at").alias("at"))
    return offsets.join(last, ["group_name", "consumer_name"], "left").select("group_name", "consumer_name", "committed_offset", F.coalesce("at", "last_heartbeat").alias("last_heartbeat"))


def dlq_single(dlq: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Dead letters after single requests by id: retry opens one again and notes when, resolve closes it."""
    last = _last(requests, "id").select("id", "action")
    rows = dlq.join(last, "id", "left")
    resolved = F.when(F.col("action") == "retry", False).when(F.col("action") == "resolve", True).otherwise(F.col("resolved"))
    return rows.select("id", resolved.alias("resolved"), F.when(F.col("action") == "retry", as_of).otherwise(F.col("retried_at")).alias("retried_at"))


def sweep_loop(candidates: DataFrame, config: DataFrame, blocked: DataFrame, batch: int, batches: int) -> DataFrame:
    """What up to so many sweeps of one batch each do, by outbox; candidates: up to batch * batches + 1 rows an outbox.

    A sweep that leaves nothing is the last; a live lease fails the first.
    """
    if not 1 <= batch <= 10_000 or batches < 1:
        raise ValueError("batch must be 1 to 10000 and batches 1 or more")
    per = candidates.groupBy("outbox_name").agg(F.count("*").alias("n"))
    rows = config.select("outbox_name").join(per, "outbox_name", "left").join(blocked.withColumn("blocked", F.lit(True)), "outbox_name", "left")
    stop, n = F.coalesce("blocked", F.lit(False)), F.coalesce("n", F.lit(0))
    runs = F.least(F.lit(batches), F.greatest(F.lit(1), F.ceil(n / batch))).cast("long")
    zero = F.lit(0).cast("long")
    return rows.select(
        "outbox_name", stop.alias("failed"), F.when(stop, zero).otherwise(F.least(n, F.lit(batch * batches))).cast("long").alias("affected_rows"),
        F.when(stop, zero).otherwise(runs).alias("completed_batches"), (~stop & (n > batch * batches)).alias("has_more"),
    )


def truncate_delivered(summary: DataFrame) -> DataFrame:
    """Messages deleted by one sweep over all outboxes, as one number."""
    return summary.agg(F.coalesce(F.sum("deleted"), F.lit(0)).alias("deleted"))


def storage_conversion_verdict(requests: DataFrame) -> DataFrame:
    """Whether the message table may be cut into id ranges; other layouts than the plain one can't be."""
    bad = (F.col("span") <= 0) | ~F.col("ahead").between(0, 100)
    verdict = (
        F.when(~F.col("confirm"), "not_confirmed").when(~F.col("admin"), "not_allowed").when(bad, "invalid_range").when(F.col("layout") == "id_range", "unchanged")
        .when(F.col("layout") != "plain", "refused").otherwise("converted")
    )
    return requests.select("req", verdict.alias("verdict"))


def fan_in_next(fan_in: DataFrame, requests: DataFrame, config: DataFrame) -> DataFrame:
    """Fan-ins after requests that name their members anew; one with an unknown outbox is refused."""
    members = requests.select("req", "name", "members", F.explode(F.split("members", ",")).alias("outbox_name"))
    bad = members.join(config.select("outbox_name"), "outbox_name", "left_anti").select("req").distinct()
    last = _last(requests.join(bad, "req", "left_anti"), "name").select("name", F.col("members").alias("new"))
    return fan_in.join(last, "name", "full_outer").select("name", F.coalesce("new", "members").alias("members"))


def date_range_conversion(messages: DataFrame) -> DataFrame:
    """The old way by dates, which is always refused: offsets are ids, and a range of dates has no bound in ids."""
    raise ValueError("cutting messages into date ranges is no longer supported; convert to id ranges")


def to_id_ranges(messages: DataFrame, span: int) -> DataFrame:
    """Messages with the number of their id range, to be written partitioned by it."""
    return messages.withColumn("id_bucket", F.expr(f"id div {span}"))


def backfill_cancel(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Jobs after cancellations; only unfinished ones can be cancelled, and then count as failed."""
    rows = jobs.join(requests.select("name").distinct().withColumn("asked", F.lit(True)), "name", "left")
    can = F.coalesce("asked", F.lit(False)) & F.col("status").isin("pending", "running", "paused")
    return rows.select("name", F.when(can, "failed").otherwise(F.col("status")).alias("status"), F.when(can, "cancelled by operator").alias("error_message"))


#: Where keys may be kept (fixed values).
PROVIDERS = ("aws", "gcp", "vault", "local")


def encryption_config_next(config: DataFrame, updates: DataFrame) -> DataFrame:
    """One key setting for each outbox; a valid update replaces it."""
    valid = updates.where((F.col("outbox_name") != "") & F.col("kms").isin(*PROVIDERS) & (F.col("key_id") != ""))
    last = _last(valid, "outbox_name").select("outbox_name", F.col("kms").alias("new_kms"), F.col("key_id").alias("new_key"))
    return config.join(last, "outbox_name", "full_outer").select("outbox_name", F.coalesce("new_kms", "kms").alias("kms"), F.coalesce("new_key", "key_id").alias("key_id"))
