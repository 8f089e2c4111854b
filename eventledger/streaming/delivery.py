"""At-least-once delivery: states of a message, circuit breaker, rate limit, and the Structured Streaming loop."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.wire import error_class

#: For each event (fixed names) the states that it may follow and the state that it leads to; a checkpoint only follows terminal ones.
MOVES = {
    "encoded": (("polled",), "encoded"),
    "publish_started": (("encoded",), "publish_started"),
    "sink_accepted": (("publish_started",), "sink_accepted"),
    "sink_acknowledged": (("publish_started", "sink_accepted"), "sink_acknowledged"),
    "dry_run_observed": (("encoded",), "dry_run_observed"),
    "intentionally_filtered": (("encoded",), "intentionally_filtered"),
    "publish_failed": (("publish_started", "sink_accepted"), "publish_failed"),
    "dlq_persisted": (("publish_failed",), "dlq_persisted"),
    "checkpoint_committed": (("sink_acknowledged", "dry_run_observed", "intentionally_filtered", "dlq_persisted"), "checkpoint_committed"),
    "cleanup_allowed": (("checkpoint_committed",), "cleanup_eligible"),
    "next_batch": (("checkpoint_committed", "cleanup_eligible"), "polled"),
}


def delivery_fsm(events: DataFrame) -> DataFrame:
    """The facts about each delivery after its events in order: state, checkpoint, acknowledged frontier and what follows from them.

    An acknowledgement must name the checkpoint that was polled. The fold ends at the first illegal event, named in refused with
    the facts before it. events: message, start (checkpoint polled), seq, event, frontier (also the next batch's checkpoint), transient.
    """
    none, false = F.lit(None).cast("long"), F.lit(False)
    moves = F.create_map(*[F.lit(x) for event, (states, to) in MOVES.items() for s in states for x in (f"{s}|{event}", to)])

    def facts(state, checkpoint, acknowledged, visible, duplicate, cleanup, transient, refused):
        names = "state checkpoint acknowledged_frontier source_visible duplicate_possible cleanup_allowed failure_transient refused".split()
        return F.struct(*[c.alias(n) for c, n in zip((state, checkpoint, acknowledged, visible, duplicate, cleanup, transient, refused), names)])

    def step(f, x):
        to = F.element_at(moves, F.concat(f.state, F.lit("|"), x.event))
        is_ = lambda e: x.event == e
        legal = to.isNotNull() & (~is_("sink_acknowledged") | x.frontier.eqNullSafe(f.checkpoint))
        fresh = facts(F.lit("polled"), x.frontier, none, F.lit(True), false, false, false, F.lit(None).cast("string"))
        then = facts(
            to, f.checkpoint, F.when(is_("sink_acknowledged"), x.frontier).otherwise(f.acknowledged_frontier), f.source_visible & ~is_("checkpoint_committed"),
            f.duplicate_possible | is_("sink_accepted"), f.cleanup_allowed | is_("cleanup_allowed"), F.when(is_("publish_failed"), F.coalesce(x.transient, false)).otherwise(f.failure_transient), f.refused,
        )
        refused = facts(*[f[n] for n in "state checkpoint acknowledged_frontier source_visible duplicate_possible cleanup_allowed failure_transient".split()], x.event)
        return F.when(f.refused.isNotNull(), f).when(~legal, refused).when(is_("next_batch"), fresh).otherwise(then)

    ordered = events.groupBy("message").agg(F.first("start").alias("start"), F.array_sort(F.collect_list(F.struct("seq", "event", "frontier", "transient"))).alias("all"))
    begin = facts(F.lit("polled"), F.col("start"), none, F.lit(True), false, false, false, F.lit(None).cast("string"))
    return ordered.select("message", F.aggregate("all", begin, step).alias("f"), F.size("all").cast("long").alias("n_events")).select("message", "f.*", "n_events")


@dataclass
class CircuitBreaker:
    """Opens after failures in a row, lets calls through again after a wait, closes after successes in a row."""

    failures: int = 5
    successes: int = 3
    wait_s: float = 30.0
    state: str = "closed"
    count: int = 0
    opened: float = 0.0

    def allows(self, at: float) -> bool:
        if self.state == "open" and at - self.opened >= self.wait_s:
            self.state, self.count = "half_open", 0
        return self.state != "open"

    def record(self, ok: bool, at: float) -> None:
        if self.state == "half_open":
            if not ok:
                self.state, self.opened, self.count = "open", at, 0
            else:
                self.count += 1
                if self.count >= self.successes:
                    self.state, self.count = "closed", 0
        elif self.state == "closed":
            self.count = 0 if ok else self.count + 1
            if self.count >= self.failures:
                self.state, self.opened, self.count = "open", at, 0


def breaker_trace(events: DataFrame, key: str | None = None) -> DataFrame:
    """pos, allowed, state: a breaker replayed over calls in order, one for each value of key."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        breaker, out = CircuitBreaker(), []
        for r in rows.sort_values("pos").itertuples():
            allowed = breaker.allows(r.at_s)
            if allowed:
                breaker.record(r.ok, r.at_s)
            out.append((r.pos, allowed, breaker.state))
        return pd.DataFrame(out, columns=["pos", "allowed", "state"])

    return events.withColumn("_key", F.col(key) if key else F.lit("")).groupBy("_key").applyInPandas(run, "pos long, allowed boolean, state string")


@dataclass
class TokenBucket:
    """rate tokens a second, burst at most (twice the rate by default)."""

    rate: float
    burst: float | None = None
    tokens: float | None = None
    at: float = 0.0

    def take(self, n: float, at: float) -> bool:
        most = self.burst if self.burst is not None else 2 * self.rate
        held = most if self.tokens is None else min(most, self.tokens + (at - self.at) * self.rate)
        self.at, self.tokens = at, held - n if held >= n else held
        return held >= n


def backoff_s(attempt: int, first: float = 1.0, most: float = 60.0) -> float:
    return min(most, first * 2**attempt)


class VersionedTable:
    """A Parquet table replaced as a whole: a new version is written, then a pointer names it. One writer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at(self.path))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".done"))

    def read(self, schema: str | T.StructType) -> DataFrame:
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{have[-1]}")

    def replace(self, df: DataFrame) -> int:
        version = (self.versions() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        self._fs.create(self._at(f"{self.path}/v{version}.done"), True).close()
        return version


class Sink(Protocol):
    """Takes a batch; returns dedup_key, ok, error_code of its messages. May see a message again after a crash."""

    def publish(self, batch: DataFrame, batch_id: int, attempt: int = 1) -> DataFrame: ...


@dataclass
class FileSink:
    """JSON lines; a batch that runs again overwrites its own folder, so a repeat leaves no second copy."""

    path: str
    rejects: Callable | None = None

    def publish(self, batch: DataFrame, batch_id: int, attempt: int = 1) -> DataFrame:
        bad = self.rejects(batch) if self.rejects else F.lit(False)
        marked = batch.withColumn("_bad", bad)
        lines = marked.where("not _bad").select(F.to_json(F.struct("dedup_key", "outbox_name", "payload")).alias("value"))
        lines.write.mode("overwrite").text(f"{self.path}/batch={batch_id}/attempt={attempt}")
        return marked.select("dedup_key", (~F.col("_bad")).alias("ok"), F.when(F.col("_bad"), "protocol_rejection").alias("error_code"))


MESSAGE = "id long, outbox_name string, payload string, created_at timestamp"
LEDGER = "batch int, attempt int, dedup_key string, id long, outbox_name string, outcome string, error_code string"
#: Outcomes after which a message is done; `retry` is not one.
TERMINAL = ("delivered", "dry_run", "filtered", "dead_letter")


class PipelineStopped(Exception):
    """A failure that is not to be tried again, and no dead letters to put it in."""


@dataclass
class Delivery:
    """How a pipeline delivers. keep: messages to publish, others count as filtered; sizes in bytes of payload, None is open."""

    keep: Callable[[DataFrame], Column] | None = None
    dry_run: bool = False
    dlq: bool = True
    max_attempts: int = 4
    message_bytes: int | None = None
    breaker: CircuitBreaker | None = None
    bucket: TokenBucket | None = None
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep

    def wait(self, n: int) -> None:
        """Until the breaker lets a call through and the bucket has a token for each message, or as many as it can hold."""
        while self.breaker and not self.breaker.allows(self.clock()):
            self.sleep(max(0.01, self.breaker.opened + self.breaker.wait_s - self.clock()))
        if self.bucket:
            n = min(n, self.bucket.burst if self.bucket.burst is not None else 2 * self.bucket.rate)
            while not self.bucket.take(n, self.clock()):
                self.sleep(max(0.01, (n - self.bucket.tokens) / self.bucket.rate))


def deliver(spark: SparkSession, source: str, state: str, sink: Sink, pipeline: str, files_per_batch: int = 1, after_publish: Callable | None = None, how: Delivery | None = None):
    """Run all files that are there through a sink; returns the finished query.

    Order within a batch: leave out what the ledger of earlier batches has, set aside what is filtered, too large or only observed,
    publish the rest and write each attempt's outcomes. Transient failures are tried again after a growing wait, max_attempts times in
    all; what then fails, or fails for good, is a dead letter, or stops the pipeline where there are none. Only then does Spark's own
    checkpoint move. A crash before that runs the batch again with the same id, and its outcome folders are overwritten.
    after_publish is a hook for crash tests.
    """
    ledger, how = f"{state}/ledger", how or Delivery()

    def earlier(batch_id: int, batch: DataFrame) -> DataFrame:
        """Terminal outcomes of earlier batches; the range of the batch's ids keeps the rest of a grown ledger unread."""
        least, most = batch.agg(F.min("id"), F.max("id")).first()
        rows = ledger_of(spark, state).where((F.col("batch") < batch_id) & F.col("outcome").isin(*TERMINAL))
        return rows.where(F.col("id").between(least, most)) if least is not None else rows.limit(0)

    def written(rows: DataFrame, batch_id: int, attempt: int) -> DataFrame:
        path = f"{ledger}/batch={batch_id}/attempt={attempt}"
        rows.select("dedup_key", "id", "outbox_name", "outcome", "error_code").write.mode("overwrite").parquet(path)
        return spark.read.schema(LEDGER).option("basePath", ledger).parquet(path)

    def run(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumn("dedup_key", F.concat(F.lit("outbox_"), "outbox_name", F.lit(":"), "id", F.lit(":0"))).dropDuplicates(["dedup_key"])
        new = keyed.join(earlier(batch_id, batch).select("dedup_key"), "dedup_key", "left_anti")
        kept = F.coalesce(how.keep(new), F.lit(False)) if how.keep else F.lit(True)
        large = F.octet_length("payload") > how.message_bytes if how.message_bytes is not None else F.lit(False)
        outcome = F.when(~kept, "filtered").when(F.lit(how.dry_run), "dry_run").when(F.coalesce(large, F.lit(False)), "dead_letter" if how.dlq else "stop").otherwise("retry")
        first = new.withColumn("outcome", outcome).withColumn("error_code", F.when(F.col("outcome").isin("dead_letter", "stop"), "message_too_large"))
        state_ = written(first, batch_id, 0)
        stop_if_needed(state_)
        for attempt in range(1, how.max_attempts + 1):
            todo = new.join(state_.where("outcome = 'retry'").select("dedup_key"), "dedup_key", "left_semi")
            if not (n := state_.where("outcome = 'retry'").count()):
                break
            if attempt > 1:
                how.sleep(backoff_s(attempt - 2))
            how.wait(n)
            result = todo.select("dedup_key", "id", "outbox_name").join(sink.publish(todo, batch_id, attempt), "dedup_key")
            if after_publish:
                after_publish(batch_id)
            final = error_class(F.col("error_code")) == "permanent" if attempt < how.max_attempts else F.lit(True)
            fate = F.when(F.col("ok"), "delivered").when(~final, "retry").otherwise("dead_letter" if how.dlq else "stop")
            state_ = written(result.withColumn("outcome", fate), batch_id, attempt)
            if how.breaker:
                how.breaker.record(state_.where("outcome <> 'delivered'").isEmpty(), how.clock())
            stop_if_needed(state_)

    def stop_if_needed(rows: DataFrame) -> None:
        if bad := rows.where("outcome = 'stop'").select("dedup_key", "error_code").first():
            raise PipelineStopped(f"{bad.error_code} of {bad.dedup_key}")

    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{state}/checkpoint/{pipeline}").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def ledger_of(spark: SparkSession, state: str) -> DataFrame:
    """All outcomes written so far."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{state}/ledger")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def checkpoints(spark: SparkSession, state: str, messages: DataFrame) -> DataFrame:
    """The frontier of each outbox: the greatest id up to which every one of its messages has a terminal outcome.

    messages: all there are (id, outbox_name); one that has none yet holds the frontier below it, whenever it came.
    """
    done = ledger_of(spark, state).where(F.col("outcome").isin(*TERMINAL)).select("outbox_name", "id").distinct()
    open_ = messages.join(done, ["outbox_name", "id"], "left_anti").groupBy("outbox_name").agg(F.min("id").alias("open"))
    return done.join(open_, "outbox_name", "left").where("open is null or id < open").groupBy("outbox_name").agg(F.max("id").alias("last_change_id"))


def dead_letters(spark: SparkSession, state: str) -> DataFrame:
    return ledger_of(spark, state).where("outcome = 'dead_letter'").select("dedup_key", "id", "outbox_name", "error_code")
