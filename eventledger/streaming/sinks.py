"""Sinks of the delivery loop: any writer that Spark has, and webhooks called from the tasks."""

from __future__ import annotations

import socket
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.secure import signature
from ..functions.wire import native_encode, status_code, url_verdict

OUTCOME = "dedup_key string, ok boolean, error_code string"


def message_body() -> Column:
    """The native wire form of a message of the loop."""
    return native_encode(F.col("id"), F.lit("insert"), F.col("outbox_name"), F.col("payload"))


@dataclass
class WriterSink:
    """A batch written by one of Spark's own writers, as a whole or not at all in its outcome.

    Kafka: format "kafka" with columns key, value (and topic); a database: format "jdbc". Their connectors must be on the session's
    class path. columns: name and expression of what is written. Writers append, so a batch that runs again after a
    crash may stand twice; its dedup_key tells.
    """

    format: str
    options: dict[str, str]
    columns: dict[str, Column] = field(default_factory=lambda: {"key": F.col("dedup_key"), "value": message_body()})
    mode: str = "append"

    def publish(self, batch: DataFrame, batch_id: int, attempt: int = 1) -> DataFrame:
        error = None
        try:
            batch.select(*[c.alias(k) for k, c in self.columns.items()]).write.format(self.format).options(**self.options).mode(self.mode).save()
        except Exception as e:
            error = self.code_of(e)
        return batch.select("dedup_key", F.lit(error is None).alias("ok"), F.lit(error).cast("string").alias("error_code"))

    @staticmethod
    def code_of(error: Exception) -> str:
        """A writer that isn't there, or is asked for what it can't do, stays so; anything else may pass."""
        text = f"{type(error).__name__} {error}"
        if "DATA_SOURCE_NOT_FOUND" in text or "AnalysisException" in text or "IllegalArgument" in text:
            return "invalid_config"
        return "timeout" if "Timeout" in text else "unavailable"


@dataclass
class WebhookSink:
    """Each message posted to an address, with its key for the receiver to tell repeats by and, given a secret, a signature.

    guard: refuse addresses that a webhook must not reach. Redirects are not followed. Tasks post their rows one after another, so the
    batch's partitions are the number of posts at a time.
    """

    url: str
    secret: bytes | None = None
    guard: bool = True
    timeout_s: float = 10.0
    at_once: int = 8

    def publish(self, batch: DataFrame, batch_id: int, attempt: int = 1) -> DataFrame:
        if self.guard:
            verdict = batch.sparkSession.range(1).select(url_verdict(F.lit(self.url)).alias("v")).first().v
            if verdict != "ok":
                return batch.select("dedup_key", F.lit(False).alias("ok"), F.lit("invalid_destination").alias("error_code"))
        body = message_body()
        mark = signature(body, self.secret) if self.secret is not None else F.lit(None).cast("string")
        rows = batch.select("dedup_key", body.alias("body"), mark.alias("mark")).repartition(self.at_once, "dedup_key")
        url, timeout = self.url, self.timeout_s

        def post(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            opener = urllib.request.build_opener(_NoRedirect)
            for part in parts:
                yield pd.DataFrame([(key, *_posted(opener, url, key, body, mark, timeout)) for key, body, mark in part.itertuples(index=False)], columns=["dedup_key", "status", "failed"])

        found = rows.mapInPandas(post, "dedup_key string, status int, failed string")
        code = F.coalesce("failed", status_code(F.col("status")))
        return found.select("dedup_key", code.isNull().alias("ok"), code.alias("error_code"))


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def _posted(opener, url: str, key: str, body: str, mark: str | None, timeout: float) -> tuple[int | None, str | None]:
    """(HTTP status, failure code where there was no answer)."""
    headers = {"Content-Type": "application/json", "Idempotency-Key": key} | ({"X-Signature": mark} if mark else {})
    try:
        with opener.open(urllib.request.Request(url, body.encode(), headers, method="POST"), timeout=timeout) as answer:
            return answer.status, None
    except urllib.error.HTTPError as e:
        return e.code, None
    except (TimeoutError, socket.timeout):
        return None, "timeout"
    except urllib.error.URLError as e:
        return None, "timeout" if isinstance(e.reason, TimeoutError) else "unavailable"
    except OSError:
        return None, "unavailable"
