"""Reading messages from outboxes, and what happens on the way out: claim checks, limits, sinks, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sink types, source types and wire formats that a pipeline may name.
SINKS, SOURCES, FORMATS = ("nats", "kafka", "webhook", "inbox", "pg_outbox", "stdout"), ("outbox",), ("native", "cloudevents")


def outbox_poll(messages: DataFrame, outbox: str, last_offset: int, batch: int) -> DataFrame:
    """Messages of an outbox after an offset, in id order, at most batch."""
    return messages.where((F.col("outbox_name") == outbox) & (F.col("id") > last_offset)).orderBy("id").limit(batch)


def enabled_pipelines(pipelines: DataFrame, tenant: str | None = None) -> DataFrame:
    rows = pipelines.where("enabled")
    return rows if tenant is None else rows.where(F.col("tenant_name") == tenant)


def config_field(path: str) -> Column:
    return F.get_json_object("config", f"$.{path}")


#: Rows of a catalog table that go to every task; a larger one is joined by shuffle.
FEW = 100_000


def few(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """df, marked for broadcast if it has FEW rows at most; counted: a table with as many rows that is cheaper to count."""
    return F.broadcast(df) if (df if counted is None else counted).limit(FEW + 1).count() <= FEW else df


def pipeline_poll_batches(messages: DataFrame, pipelines: DataFrame, offsets: DataFrame, group: str = "default") -> DataFrame:
    """The next batch of every enabled pipeline from its own offset.

    The largest configured batch is a constant of the plan, so Spark limits each pipeline to it before the shuffle (batches
    over its own spark.sql.optimizer.windowGroupLimitThreshold, 1000 by default, after it).
    """
    p = pipelines.where("enabled").select(F.col("name").alias("pipeline_id"), config_field("source.outbox").alias("outbox_name"), config_field("batch_size").cast("int").alias("batch"))
    o = offsets.where(F.col("relay_group_id") == group).select("pipeline_id", "last_change_id")
    ready = p.join(o, "pipeline_id", "left").withColumn("after", F.coalesce("last_change_id", F.lit(0)))
    rows = messages.select("id", "outbox_name").join(few(ready), "outbox_name").where("id > after")
    rank = F.row_number().over(Window.partitionBy("pipeline_id").orderBy("id"))
    largest = p.agg(F.max("batch")).first()[0] or 0
    return rows.withColumn("rank", rank).where(F.col("rank") <= largest).where("rank <= batch").select("pipeline_id", "id", F.col("rank").cast("long").alias("position"))


def group_poll(messages: DataFrame, groups: DataFrame, offsets: DataFrame, leases: DataFrame, as_of: Column, batch: int) -> DataFrame:
    """Next messages of each group member: after its offset, outside ranges that other members lease. Our own definition."""
    members = offsets.join(groups.select("group_name", "outbox_name"), "group_name").select("group_name", "consumer_name", "outbox_name", "committed_offset")
    rows = messages.select("id", "outbox_name").join(few(members), "outbox_name").where("id > committed_offset").alias("m")
    live = few(leases.where(F.col("expires_at") > as_of).select("group_name", "consumer_name", "lease_start", "lease_end")).alias("l")
    held = F.expr("m.group_name = l.group_name and m.consumer_name <> l.consumer_name and m.id between l.lease_start and l.lease_end")
    free = rows.join(live, held, "left_anti")
    rank = F.row_number().over(Window.partitionBy("group_name", "consumer_name").orderBy("id"))
    return free.withColumn("rank", rank).where(F.col("rank") <= batch).select("group_name", "consumer_name", "id")


def claim_check_encode(docs: DataFrame, threshold: int) -> DataFrame:
    """Texts over the threshold become an envelope that names a stored object; others stay inline."""
    size = F.octet_length("text").cast("long")
    envelope = F.concat(F.lit('{"_cc":true,"oid":'), "doc_id", F.lit(',"size":'), size, F.lit(',"dedup_key":"doc:'), "doc_id", F.lit('"}'))
    large = size > threshold
    return docs.select("doc_id", large.alias("checked"), size.alias("size"), F.when(large, envelope).otherwise(F.col("text")).alias("payload"))


def claim_check_decode(encoded: DataFrame, objects: DataFrame) -> DataFrame:
    """Fetch the object of each envelope; inline payloads pass."""
    claim = F.get_json_object("payload", "$._cc") == "true"
    rows = encoded.withColumn("oid", F.when(F.col("payload").startswith('{"_cc"') & claim, F.get_json_object("payload", "$.oid").cast("long")))
    return rows.join(objects, "oid", "left").select("doc_id", F.coalesce("object", "payload").alias("text"))


def envelope_expand(envelopes: DataFrame) -> DataFrame:
    """Inserts, then deletes, one row each; row_index goes on over both."""
    side = lambda name: F.transform(name, lambda x: F.struct(F.lit(name[:-1]).alias("op"), x.alias("value")))
    rows = envelopes.select("name", "id", F.posexplode(F.concat(side("inserts"), side("deletes"))).alias("row_index", "row"))
    return rows.select("name", "id", F.col("row_index").cast("long").alias("row_index"), "row.op", "row.value", F.concat_ws(":", "name", "id", "row_index").alias("dedup_key"))


def publish_limits(messages: DataFrame, per_batch: int, most: int, message_bytes: int, batch_bytes: int) -> DataFrame:
    """The first limit that each batch breaks: count, message size, batch size."""
    size = F.octet_length("payload")
    per = messages.groupBy("outbox_name", F.expr(f"(id - 1) div {per_batch}").alias("batch")).agg(F.count("*").alias("n"), F.max(size).cast("long").alias("largest"), F.sum(size).cast("long").alias("bytes"))
    verdict = F.when(F.col("n") > most, "too_many_messages").when(F.col("largest") > message_bytes, "message_too_large").when(F.col("bytes") > batch_bytes, "batch_too_large").otherwise("ok")
    return per.withColumn("verdict", verdict)


def unsupported_pipelines(pipelines: DataFrame) -> DataFrame:
    """Pipelines with a source, sink or format outside the supported ones; a missing source is invalid."""
    source, sink = config_field("source_type"), config_field("sink_type")
    reason = (
        F.when(source.isNull() | ~source.isin(*SOURCES), "source").when(sink.isNull() | ~sink.isin(*SINKS), "sink").when(~F.col("wire_format").isin(*FORMATS), "format")
    )
    return pipelines.select("name", reason.alias("reason")).where("reason is not null")


def replay_range(messages: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """Messages with first <= id <= last; None is open, a missing id counts as 0."""
    at = F.coalesce("id", F.lit(0))
    return messages.where((at >= (first if first is not None else -(1 << 63))) & (at <= (last if last is not None else (1 << 63) - 1)))


def replay_preview(messages: DataFrame, outbox: str, first: int, last: int, limit: int) -> DataFrame:
    rows = messages.where((F.col("outbox_name") == outbox) & F.col("id").between(first, last))
    return rows.select("id", "payload", "created_at", F.col("consumed_at").isNotNull().alias("consumed")).orderBy("id").limit(limit)


def sink_jsonl(messages: DataFrame) -> DataFrame:
    """One JSON line for each message."""
    return messages.select("id", F.to_json(F.struct("id", "outbox_name", "op", "payload")).alias("value"))


def webhook_idempotency_key(messages: DataFrame, per_batch: int) -> DataFrame:
    """A batch's key: the message's own for one, else a digest over the length-prefixed keys in order."""
    rows = messages.select("outbox_name", F.expr(f"id div {per_batch}").alias("batch"), "id", F.concat(F.lit("outbox_"), "outbox_name", F.lit(":"), "id", F.lit(":0")).alias("key"))
    per = rows.groupBy("outbox_name", "batch").agg(F.sort_array(F.collect_list(F.struct("id", "key"))).alias("keys"))
    framed = F.transform("keys", lambda k: F.concat(F.lpad(F.hex(F.octet_length(k.key)), 16, "0"), F.hex(k.key)))
    digest = F.concat(F.lit("batch-"), F.sha2(F.unhex(F.array_join(framed, "")), 256))
    return per.select("outbox_name", "batch", F.when(F.size("keys") == 1, F.col("keys")[0]["key"]).otherwise(digest).alias("idempotency_key"))
