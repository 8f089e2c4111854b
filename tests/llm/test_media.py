import hashlib
import zlib

import numpy as np

from eventledger.llm import media


def payload(text):
    raw = (text or "").encode()
    return raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))


def checked(frame, texts):
    rows = frame.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in texts)
    by_id = dict(texts)
    for r in rows:
        raw = payload(by_id[r.doc_id])
        assert r.n_bytes == len((by_id[r.doc_id] or "").encode())
        assert (r.payload_bytes, r.payload_sha256) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert r.tail_crc32 == zlib.crc32(raw[-64:])
        file = media.wav_header(r.n_bytes, len(raw)) + raw
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        assert media.read_wav(file) == (r.n_bytes, raw)
        assert r.feature == media._features(np.frombuffer(raw, dtype=np.uint8))


def test_edge_texts_round_trip(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij é"), 4000))
    a, b, c = word(), word(), word()
    texts = [None, "", "x" * 64, "x" * 65, "é😀", a, a, a + b, c + a + b, b * 8, a, "z" * 100_000, None, a + b]
    rows = [*enumerate(texts), (None, "no id"), (5, a)]
    docs = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, sha binary")
    checked(media.media_features(docs), rows)
    _, _, own, shared = media.store(docs)
    stored = own.selectExpr("explode(parts) p").where("p.data is not null").selectExpr("p.digest").unionByName(shared.select("digest"))
    assert stored.count() == stored.distinct().count()  # each chunk once
    size = shared.selectExpr("sum(octet_length(data))").first()[0]
    assert size < len((a + b + c).encode()) + 8 * 8192


def test_empty_table(spark):
    assert media.media_features(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cuts_follow_content():
    rng = np.random.default_rng(2)
    body = rng.integers(0, 256, 60_000, dtype=np.uint8)
    moved = np.concatenate([rng.integers(0, 256, 777, dtype=np.uint8), body])

    def digests(x):
        ends = media.cuts(x, np.array([0, len(x)]))[0]
        return {media._digest(bytes(x[a:b])) for a, b in zip([0, *ends[:-1]], ends)}

    one, two = digests(body), digests(moved)
    assert len(one & two) >= len(one) - 3


def test_query_on_whole_table(spark, sf):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    checked(media.op1_media(spark, sf), texts)
