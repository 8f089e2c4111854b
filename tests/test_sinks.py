import hashlib
import hmac
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from eventledger.streaming import delivery, sinks

from .test_streaming import written


@pytest.fixture
def hook():
    """A receiver that answers each message with the status in its payload, once, and 200 from then on."""
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            key = self.headers["Idempotency-Key"]
            first = key not in [k for k, *_ in seen]
            seen.append((key, body, self.headers["X-Signature"]))
            status = json.loads(body)["payload"]["s"]
            self.send_response(status if first or status == 400 else 200)
            if status == 302:
                self.send_header("Location", "/elsewhere")
            self.end_headers()

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/in", seen
    server.shutdown()
    server.server_close()


def test_webhook_statuses_signatures_and_retries(spark, tmp_path, hook):
    url, seen = hook
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    rows = [(i, "a", json.dumps({"s": s})) for i, s in enumerate((200, 204, 429, 503, 400, 401, 302), 1)]
    written(spark, source, [rows])
    sink = sinks.WebhookSink(url, secret=b"s3cret", guard=False, at_once=3)
    delivery.deliver(spark, source, state, sink, "p", how=delivery.Delivery(max_attempts=2, sleep=lambda s: None))
    for key, body, mark in seen:
        assert mark == "sha256=" + hmac.new(b"s3cret", body.encode(), hashlib.sha256).hexdigest()
        assert key == f"outbox_a:{json.loads(body)['outbox_id']}:0"
    posts = sorted(json.loads(b)["outbox_id"] for _, b, _ in seen)
    assert posts == [1, 2, 3, 3, 4, 4, 5, 6, 7]
    outcome = {r.id: (r.outcome, r.error_code) for r in delivery.ledger_of(spark, state).where("outcome <> 'retry'").collect()}
    assert outcome == {1: ("delivered", None), 2: ("delivered", None), 3: ("delivered", None), 4: ("delivered", None), 5: ("dead_letter", "protocol_rejection"), 6: ("dead_letter", "authentication"), 7: ("dead_letter", "invalid_destination")}


def test_webhook_guard_and_no_answer(spark):
    batch = spark.createDataFrame([("k", 1, "a", "{}")], "dedup_key string, id long, outbox_name string, payload string")
    assert tuple(sinks.WebhookSink("https://127.0.0.1/x").publish(batch, 0).first()) == ("k", False, "invalid_destination")
    closed = sinks.WebhookSink("http://127.0.0.1:9/x", guard=False, timeout_s=2).publish(batch, 0).first()
    assert (closed.ok, closed.error_code) == (False, "unavailable")
    assert sinks.WebhookSink("http://127.0.0.1:9/x", guard=False).publish(batch.limit(0), 0).count() == 0


def test_spark_writers(spark, tmp_path):
    batch = spark.createDataFrame([("k1", 1, "a", '{"x":1}'), ("k2", 2, "a", "{}")], "dedup_key string, id long, outbox_name string, payload string")
    out = sinks.WriterSink("parquet", {"path": f"{tmp_path}/out"}).publish(batch, 0)
    assert [(r.ok, r.error_code) for r in out.collect()] == [(True, None)] * 2
    stored = {r.key: json.loads(r.value) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert stored["k1"] == {"outbox_id": 1, "op": "insert", "stream_table": "a", "payload": {"x": 1}}
    absent = sinks.WriterSink("no_such_writer", {}).publish(batch, 0)
    assert {(r.ok, r.error_code) for r in absent.collect()} == {(False, "invalid_config")}
    (tmp_path / "file").write_text("x")
    broken = sinks.WriterSink("parquet", {"path": f"{tmp_path}/file/below"}).publish(batch, 0)
    assert {(r.ok, r.error_code) for r in broken.collect()} == {(False, "unavailable")}
    custom = sinks.WriterSink("json", {"path": f"{tmp_path}/json"}, {"id": F.col("id")})
    assert custom.publish(batch, 0).count() == 2 and spark.read.json(f"{tmp_path}/json").count() == 2
