"""Offsets, lag, retention and sweeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .poll import config_field, few

BOUND = 10_001


def id_gap_lag(messages: DataFrame, groups: DataFrame, offsets: DataFrame) -> DataFrame:
    """Greatest id of the outbox minus the offset; ids of other outboxes inflate it, see exact_lag."""
    tops = messages.groupBy("outbox_name").agg(F.max("id").alias("top"))
    rows = groups.join(offsets, "group_name").join(tops, "outbox_name", "left")
    return rows.select("group_name", "consumer_name", "outbox_name", "committed_offset", (F.coalesce("top", F.lit(0)) - F.col("committed_offset")).alias("lag"))


def exact_lag(messages: DataFrame, pipelines: DataFrame, offsets: DataFrame) -> DataFrame:
    """Messages after each pipeline's offset: few offsets go to the messages, which are counted before any shuffle."""
    p = pipelines.where(config_field("source_type") == "outbox").select(F.col("name").alias("pipeline_id"), config_field("source.outbox").alias("outbox"))
    o = offsets.join(p, "pipeline_id").where("outbox = outbox_name").select("relay_group_id", "pipeline_id", "outbox_name", "last_change_id")
    key = ["relay_group_id", "pipeline_id", "outbox_name", "last_change_id"]
    behind = messages.select("outbox_name", "id").join(few(o), "outbox_name").where("id > last_change_id").groupBy(*key).agg(F.count("*").alias("lag"))
    return o.join(behind, key, "left").select(*key, F.coalesce("lag", F.lit(0).cast("long")).alias("lag"))


def participants(groups: DataFrame, offsets: DataFrame, pipelines: DataFrame, relay_offsets: DataFrame) -> DataFrame:
    """outbox_name, participant, committed: consumer groups by their slowest member and pipelines, 0 if never committed."""
    g = groups.join(offsets, "group_name", "left").groupBy("outbox_name", "group_name").agg(F.coalesce(F.min("committed_offset"), F.lit(0)).alias("committed"))
    p = pipelines.where(config_field("source_type") == "outbox").select("name", config_field("source.outbox").alias("outbox_name"))
    r = relay_offsets.select(F.col("pipeline_id").alias("name"), "outbox_name", "last_change_id")
    r = p.join(r, ["name", "outbox_name"], "left").groupBy("outbox_name", "name").agg(F.coalesce(F.min("last_change_id"), F.lit(0)).alias("committed"))
    return g.select("outbox_name", F.concat(F.lit("group:"), "group_name").alias("participant"), "committed").unionByName(r.select("outbox_name", F.concat(F.lit("relay:"), "name").alias("participant"), "committed"))


def safe_offset(config: DataFrame, parts: DataFrame) -> DataFrame:
    """The offset up to which all participants are done; null without participants."""
    least = parts.groupBy("outbox_name").agg(F.min("committed").alias("safe_offset"), F.count("*").alias("participants"))
    return config.select("outbox_name").join(least, "outbox_name", "left").select("outbox_name", "safe_offset", F.coalesce("participants", F.lit(0)).alias("participants"))


def retention_participants(parts: DataFrame) -> DataFrame:
    """The participants of each outbox as one ordered text."""
    row = F.struct("participant", "committed")
    per = parts.groupBy("outbox_name").agg(F.array_sort(F.collect_list(row)).alias("all"))
    return per.select("outbox_name", F.array_join(F.transform("all", lambda x: F.concat(x.participant, F.lit("="), x.committed)), ",").alias("participants"))


def expired(as_of: Column) -> Column:
    return F.col("created_at") < as_of - F.expr("make_dt_interval(0, retention_hours)")


def deletable() -> Column:
    """Without participants age alone allows deletion."""
    return F.col("safe_offset").isNull() | (F.col("id") <= F.col("safe_offset"))


def retention_status(messages: DataFrame, config: DataFrame, safe: DataFrame, cleanup: DataFrame, as_of: Column) -> DataFrame:
    """What each outbox retains, what is pending, expired and free to go; outboxes without messages stay."""
    rules = config.select("outbox_name", "retention_hours", "enabled").join(safe, "outbox_name", "left")
    rows = messages.join(few(rules, config), "outbox_name")
    old = expired(as_of)
    per = rows.groupBy("outbox_name").agg(
        F.count("*").alias("rows"),
        F.sum(F.octet_length("payload") + F.coalesce(F.octet_length("headers"), F.lit(0))).cast("long").alias("bytes"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
        F.count_if(F.col("consumed_at").isNull()).alias("pending"),
        F.count_if(old).alias("expired"),
        F.count_if(old & deletable()).alias("eligible"),
    )
    out = rules.join(per, "outbox_name", "left").join(cleanup.select("outbox_name", "highest_deleted_id", "total_rows_deleted"), "outbox_name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(
        "outbox_name", "enabled", zero("rows"), zero("bytes"), "oldest", "newest", zero("pending"), zero("expired"), zero("eligible"),
        F.least(F.coalesce("eligible", F.lit(0)), F.lit(BOUND)).cast("long").alias("bounded_eligible"),
        F.timestamp_diff("SECOND", F.col("oldest"), as_of).alias("oldest_age_s"), "safe_offset", "participants", zero("highest_deleted_id"), zero("total_rows_deleted"),
    )


def lease_blocked(groups: DataFrame, leases: DataFrame, as_of: Column) -> DataFrame:
    """Outboxes on which a live lease stands."""
    live = leases.where(F.col("expires_at") > as_of).join(groups.select("group_name", "outbox_name"), "group_name")
    return live.select("outbox_name").distinct()


def sweep_candidates(messages: DataFrame, config: DataFrame, safe: DataFrame, as_of: Column, batch: int) -> DataFrame:
    """Up to batch + 1 rows an outbox that may be deleted, in id order; the extra one tells that more remain."""
    rules = config.select("outbox_name", "retention_hours").join(safe, "outbox_name", "left")
    rows = messages.select("id", "outbox_name", "created_at").join(few(rules, config), "outbox_name").where(expired(as_of) & deletable())
    rank = F.row_number().over(Window.partitionBy("outbox_name").orderBy("id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= batch + 1).select("outbox_name", "id", "rank")


def sweep_summary(candidates: DataFrame, config: DataFrame, blocked: DataFrame, batch: int) -> DataFrame:
    """Rows that a sweep would delete and whether more remain; a live lease stops it."""
    per = candidates.groupBy("outbox_name").agg(F.count_if(F.col("rank") <= batch).alias("rows"), F.max(F.when(F.col("rank") <= batch, F.col("id"))).alias("highest"), F.count("*").alias("n"))
    out = config.select("outbox_name").join(per, "outbox_name", "left").join(blocked.withColumn("blocked", F.lit(True)), "outbox_name", "left")
    stop = F.coalesce("blocked", F.lit(False))
    return out.select(
        "outbox_name", stop.alias("blocked"), F.when(stop, F.lit(0)).otherwise(F.coalesce("rows", F.lit(0))).cast("long").alias("deleted"),
        F.when(~stop, F.col("highest")).alias("highest"), (~stop & (F.coalesce("n", F.lit(0)) > batch)).alias("has_more"),
    )


def sweep_apply(messages: DataFrame, candidates: DataFrame, blocked: DataFrame, batch: int) -> DataFrame:
    """The messages that a sweep leaves."""
    gone = candidates.where(F.col("rank") <= batch).join(blocked, "outbox_name", "left_anti").select("id")
    return messages.join(gone, "id", "left_anti")


def cleanup_state_next(state: DataFrame, summary: DataFrame) -> DataFrame:
    """State after a sweep: highest id never falls, deletions add up; written even if nothing was deleted."""
    s = summary.select("outbox_name", "deleted", "highest")
    both = s.join(state.select("outbox_name", "highest_deleted_id", "total_rows_deleted"), "outbox_name", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(
        "outbox_name", F.greatest(zero("highest_deleted_id"), zero("highest")).alias("highest_deleted_id"),
        (zero("total_rows_deleted") + zero("deleted")).alias("total_rows_deleted"), F.col("deleted").alias("last_batch_rows"),
    )


def partition_plan(messages: DataFrame, span: int, ahead: int) -> DataFrame:
    """Aligned id ranges from the least to the greatest id and some ahead, with the rows now in each."""
    ids = messages.agg(F.expr(f"min(id) div {span}").alias("lo"), F.expr(f"max(id) div {span}").alias("hi")).where("lo is not null")
    wanted = ids.select(F.explode(F.sequence("lo", F.col("hi") + ahead)).alias("bucket"))
    have = messages.groupBy(F.expr(f"id div {span}").alias("bucket")).agg(F.count("*").alias("n"))
    return wanted.join(have, "bucket", "left").select("bucket", (F.col("bucket") * span).alias("from_id"), ((F.col("bucket") + 1) * span).alias("to_id"), F.coalesce("n", F.lit(0)).alias("rows"))


def prune_to_bucket(messages: DataFrame, after: int, span: int) -> DataFrame:
    """Messages after an offset of a table partitioned by id_bucket = id div span: the partition filter beside the id's."""
    return messages.where((F.col("id_bucket") >= after // span) & (F.col("id") > after))


def outbox_pending(messages: DataFrame) -> DataFrame:
    rows = messages.where("consumed_at is null").groupBy("outbox_name")
    return rows.agg(F.count("*").alias("pending"), F.min("created_at").alias("oldest"), F.max("id").alias("max_id"))


def orphan_offsets(relay_offsets: DataFrame, pipelines: DataFrame) -> DataFrame:
    return relay_offsets.join(pipelines.select(F.col("name").alias("pipeline_id")), "pipeline_id", "left_anti").select("relay_group_id", "pipeline_id", "last_change_id")


def latest_offsets(relay_offsets: DataFrame) -> DataFrame:
    """The offset last written for each pipeline."""
    rank = F.row_number().over(Window.partitionBy("pipeline_id").orderBy(F.col("updated_at").desc(), "relay_group_id"))
    return relay_offsets.withColumn("rank", rank).where("rank = 1").select("pipeline_id", "relay_group_id", "last_change_id", "updated_at")


def duplicate_offset_identities(identities: DataFrame) -> DataFrame:
    per = identities.groupBy("relay_group_id", "pipeline_id").agg(F.count("*").alias("n")).where("n > 1")
    return per.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"))


def offset_outbox_backfill(identities: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Offsets without an outbox get their pipeline's."""
    p = pipelines.select(F.col("name").alias("pipeline_id"), config_field("source.outbox").alias("configured"))
    return identities.join(p, "pipeline_id", "left").select("relay_group_id", "pipeline_id", F.coalesce("outbox_name", "configured", F.lit("")).alias("outbox_name"), "last_change_id")


def commit_offsets(offsets: DataFrame, commits: DataFrame) -> DataFrame:
    """Offsets after commits: never backwards, never negative; the verdict tells why one was refused."""
    both = offsets.select("group_name", "consumer_name", "committed_offset").join(commits, ["group_name", "consumer_name"], "full_outer")
    new, old = F.col("new_offset"), F.col("committed_offset")
    verdict = F.when(new.isNull(), "kept").when(new < 0, "negative").when(old.isNotNull() & (new < old), "backwards").otherwise("committed")
    both = both.withColumn("verdict", verdict)
    return both.select("group_name", "consumer_name", F.when(F.col("verdict") == "committed", new).otherwise(old).alias("committed_offset"), "verdict")


def relay_offset_merge(offsets: DataFrame, updates: DataFrame) -> DataFrame:
    key = ["relay_group_id", "pipeline_id", "outbox_name"]
    return offsets.select(*key, "last_change_id").unionByName(updates.select(*key, "last_change_id")).groupBy(*key).agg(F.max("last_change_id").alias("last_change_id"))


def rewind_verdict(rewinds: DataFrame, offsets: DataFrame, groups: DataFrame, cleanup: DataFrame) -> DataFrame:
    """Whether an administrator may move an offset back: confirmed, between 0 and the offset, above what was deleted."""
    rows = rewinds.join(offsets.select("group_name", "consumer_name", "committed_offset"), ["group_name", "consumer_name"], "left")
    rows = rows.join(groups.select("group_name", "outbox_name"), "group_name", "left").join(cleanup.select("outbox_name", "highest_deleted_id"), "outbox_name", "left")
    verdict = (
        F.when(~F.col("confirm"), "not_confirmed").when(F.col("committed_offset").isNull(), "unknown_consumer").when(F.col("target") < 0, "negative")
        .when(F.col("target") > F.col("committed_offset"), "forward").when(F.col("target") < F.coalesce("highest_deleted_id", F.lit(0)), "deleted").otherwise("allowed")
    )
    return rows.select("req", verdict.alias("verdict"))


def receipts_prune(receipts: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    return receipts.where(F.col("delivered_at") >= as_of - F.expr(f"make_dt_interval(0, {hours})"))


def delivery_confirm(receipts: DataFrame, outbox: str, first: int, last: int) -> DataFrame:
    """One row, also without receipts."""
    rows = receipts.where((F.col("outbox_name") == outbox) & F.col("message_id").between(first, last))
    return rows.agg(F.count("*").alias("confirmed"), F.max("delivered_at").alias("latest"))
