"""Inboxes and dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .poll import few


def inbox_dedup(deliveries: DataFrame, inbox: DataFrame) -> DataFrame:
    """Deliveries that an inbox takes in: the first of each event id that it doesn't hold."""
    once = deliveries.groupBy("inbox_name", "event_id").agg(F.min("id").alias("id"))
    return once.join(inbox.select("inbox_name", "event_id"), ["inbox_name", "event_id"], "left_anti")


def inbox_dup_count(deliveries: DataFrame, accepted: DataFrame) -> DataFrame:
    got = deliveries.groupBy("inbox_name").agg(F.count("*").alias("received"))
    new = accepted.groupBy("inbox_name").agg(F.count("*").alias("inserted"))
    return got.join(new, "inbox_name", "left").select("inbox_name", "received", F.coalesce("inserted", F.lit(0)).alias("inserted"), (F.col("received") - F.coalesce("inserted", F.lit(0))).alias("skipped"))


def inbox_pending_rows(inbox: DataFrame, config: DataFrame) -> DataFrame:
    rows = inbox.join(few(config.select("inbox_name", "max_retries")), "inbox_name").where("processed_at is null and retry_count < max_retries")
    return rows.select("inbox_name", "id", "event_id", "retry_count")


def inbox_fleet_status(inbox: DataFrame, config: DataFrame) -> DataFrame:
    """Counts of every configured inbox, also of empty ones: one aggregate over one table."""
    rows = inbox.join(few(config.select("inbox_name", "max_retries")), "inbox_name")
    open_ = F.col("processed_at").isNull()
    per = rows.groupBy("inbox_name").agg(
        F.count("*").alias("total"), F.count_if(open_ & (F.col("retry_count") < F.col("max_retries"))).alias("pending"),
        F.count_if(open_ & (F.col("retry_count") >= F.col("max_retries"))).alias("dlq"), F.count_if(~open_).alias("processed"),
    )
    out = config.select("inbox_name", "max_retries").join(per, "inbox_name", "left")
    return out.select("inbox_name", "max_retries", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "pending", "dlq", "processed")])


def inbox_status(inbox: DataFrame, config: DataFrame, name: str) -> DataFrame:
    return inbox_fleet_status(inbox.where(F.col("inbox_name") == name), config.where(F.col("inbox_name") == name)).select("inbox_name", "pending", "dlq")


def inbox_fleet_summary(config: DataFrame) -> DataFrame:
    return config.select("inbox_name", "inbox_schema", "max_retries", "processed_retention_hours").orderBy("inbox_name")


def inbox_triage(inbox: DataFrame) -> DataFrame:
    """Processed, waiting, failing messages over all inboxes."""
    done = F.col("processed_at").isNotNull()
    return inbox.agg(F.count_if(done).alias("processed"), F.count_if(~done & (F.col("retry_count") == 0)).alias("waiting"), F.count_if(~done & (F.col("retry_count") > 0)).alias("failing"))


def inbox_mark_processed(inbox: DataFrame, ids: DataFrame, as_of: Column) -> DataFrame:
    """A processed message keeps its time."""
    hit = ids.select("event_id").distinct().withColumn("hit", F.lit(True))
    return inbox.join(hit, "event_id", "left").withColumn("processed_at", F.when(F.col("hit") & F.col("processed_at").isNull(), as_of).otherwise(F.col("processed_at"))).drop("hit")


def inbox_mark_failed(inbox: DataFrame, failures: DataFrame) -> DataFrame:
    """failures: event_id, error."""
    return inbox.join(failures, "event_id", "left").select(
        "inbox_name", "id", "event_id", (F.col("retry_count") + F.when(F.col("error").isNotNull(), 1).otherwise(0)).alias("retry_count"), F.coalesce("error", "last_error").alias("last_error")
    )


def inbox_replay(inbox: DataFrame, ids: DataFrame) -> DataFrame:
    """Unprocessed messages among ids start anew."""
    hit = ids.select("event_id").distinct().withColumn("hit", F.lit(True))
    again = F.coalesce(F.col("hit") & F.col("processed_at").isNull(), F.lit(False))
    return inbox.join(hit, "event_id", "left").select(
        "inbox_name", "id", F.when(again, 0).otherwise(F.col("retry_count")).alias("retry_count"), F.when(~again, F.col("last_error")).alias("last_error"), again.alias("replayed")
    )


def inbox_retention(inbox: DataFrame, config: DataFrame, as_of: Column) -> DataFrame:
    """What stays: all but messages processed longer ago than their inbox keeps them."""
    rows = inbox.join(few(config.select("inbox_name", "processed_retention_hours")), "inbox_name")
    cut = as_of - F.expr("make_dt_interval(0, processed_retention_hours)")
    return rows.where(F.col("processed_at").isNull() | (F.col("processed_at") >= cut)).select("inbox_name", "id")


def dlq_stats(dlq: DataFrame) -> DataFrame:
    return dlq.groupBy("pipeline_name", "error_kind").agg(F.count("*").alias("total"), F.count_if(~F.col("resolved")).alias("unresolved"))


def dlq_depth(dlq: DataFrame) -> DataFrame:
    return dlq.where("not resolved").groupBy("pipeline_name").agg(F.count("*").alias("depth"))


def dlq_root_causes(dlq: DataFrame, top: int = 10) -> DataFrame:
    per = dlq.where("not resolved").groupBy("error_kind", "error_message").agg(F.count("*").alias("n"))
    return per.orderBy(F.col("n").desc(), "error_kind", "error_message").limit(top)


def dlq_by_kind(dlq: DataFrame) -> DataFrame:
    return dlq.groupBy("pipeline_name", "error_kind").agg(F.count("*").alias("n"), F.max("last_failed_at").alias("latest"))


def dlq_list(dlq: DataFrame) -> DataFrame:
    return dlq.where("not resolved").select("id", "dedup_key", "error_kind", "attempt_count", "first_failed_at").orderBy("first_failed_at", "id")


def dlq_insert(dlq: DataFrame, failed: DataFrame) -> DataFrame:
    """New dead letters; a message that waits unresolved already isn't entered twice."""
    waiting = dlq.where("not resolved").select("pipeline_name", "dedup_key")
    new = failed.dropDuplicates(["pipeline_name", "dedup_key"]).join(waiting, ["pipeline_name", "dedup_key"], "left_anti")
    return dlq.select("pipeline_name", "dedup_key", "resolved").unionByName(new.select("pipeline_name", "dedup_key", F.lit(False).alias("resolved")))


def dlq_retry_all(dlq: DataFrame, as_of: Column) -> DataFrame:
    return dlq.select("id", "resolved", F.when(~F.col("resolved"), as_of).otherwise(F.col("retried_at")).alias("retried_at"), (F.col("attempt_count") + (~F.col("resolved")).cast("int")).alias("attempt_count"))


def dlq_purge(dlq: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """What stays: resolved letters that last failed longer ago go."""
    return dlq.where(~(F.col("resolved") & (F.col("last_failed_at") < as_of - F.expr(f"make_dt_interval({days})")))).select("id", "resolved", "last_failed_at")


def dlq_requeue(dlq: DataFrame) -> DataFrame:
    """The latest resolved letter of each key that has no unresolved one, to be entered again with all its columns."""
    rank = F.row_number().over(Window.partitionBy("pipeline_name", "dedup_key").orderBy(F.col("last_failed_at").desc(), F.col("id").desc()))
    latest = dlq.where("resolved").withColumn("rank", rank).where("rank = 1").drop("rank")
    waiting = dlq.where("not resolved").select("pipeline_name", "dedup_key")
    return latest.join(waiting, ["pipeline_name", "dedup_key"], "left_anti").select("pipeline_name", "dedup_key", "source_name", "sink_name", "error_kind", "error_message", F.lit(0).alias("attempt_count"), F.lit(False).alias("resolved"))
