"""Media columns: payloads as 8-bit samples, stored as content-defined chunks, each distinct chunk once.

The stored form of a payload is a WAV file of 8-bit mono samples. Its samples are cut where a rolling gear
hash meets a mask, so equal passages give equal chunks wherever they stand. Chunk digests are deduplicated by
joins; an ordered chunk list and the header rebuild a file, verified by its digest.

1. A pass over the texts writes the manifest: payload digest and ordered chunk digests, no payloads.
2. Digests and payloads that occur twice go into two Bloom filters of fixed size.
3. A pass writes the payloads whose chunks occur nowhere else straight to the store, without a shuffle. A
   second one hands out only chunks that may be shared; joined with the owner of each digest, one copy of
   each is stored.
4. Stored rows are read back. Complete ones are rebuilt in place; lists with shared chunks are joined with the
   shared part of the store. Features are computed once a distinct payload and joined to its documents.

Filters only decide the route: a false hit sends a chunk through the join and changes no result.

Defined results: a null text is an empty payload of 64 zero bytes; rows with equal text have equal values;
a null doc_id is kept; an empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import groups
from .common import bloom_has, bloom_of, read, staged, trimmed

UNIT = 64
RATE = 8000
#: Chunk sizes in bytes; a cut needs CUT_BITS bits of the hash to be 0.
LEAST, MOST, CUT_BITS = 512, 8192, 11
_GEAR = np.random.default_rng(5).integers(0, 1 << 16, 256, dtype=np.uint16)
_MASK = np.uint16(((1 << CUT_BITS) - 1) << (16 - CUT_BITS))


def wav_header(n_bytes: int, payload_bytes: int) -> bytes:
    """RIFF header of 8-bit mono samples; the unpadded size stands in a chunk of its own before the data."""
    size = struct.pack("<4sIQ", b"size", 8, n_bytes)
    body = struct.pack("<4s4sIHHIIHH", b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8) + size + struct.pack("<4sI", b"data", payload_bytes)
    return struct.pack("<4sI", b"RIFF", len(body) + payload_bytes) + body


def read_wav(media: bytes) -> tuple[int, bytes]:
    """(unpadded size, samples)."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, n_bytes = 12, 0
    while at < len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        at += 8
        if name == b"size":
            (n_bytes,) = struct.unpack_from("<Q", media, at)
        elif name == b"data":
            return n_bytes, media[at : at + size]
        at += size
    raise ValueError("no samples")


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payloads of texts one after another, and where each starts."""
    size = np.diff(offsets)
    full = np.maximum(1, -(-size // UNIT)) * UNIT
    at = np.zeros(len(offsets), dtype=np.int64)
    np.cumsum(full, out=at[1:])
    out = np.zeros(at[-1], dtype=np.uint8)
    for i in range(len(size)):
        out[at[i] : at[i] + size[i]] = data[offsets[i] : offsets[i + 1]]
    return out, at


def cuts(payloads: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each payload. The hash of a place is over the 16 bytes before it, fewer than LEAST."""
    h = _GEAR[payloads]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] + (h[:-step] << np.uint16(step))
    places = (np.flatnonzero((h & _MASK) == 0) + 1).tolist()
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        ends, k = [], 0
        while b - a > LEAST:
            k = bisect_left(places, a + LEAST, k)
            a = min(places[k] if k < len(places) else b, a + MOST, b)
            ends.append(a)
        if not ends or ends[-1] < b:
            ends.append(b)
        out.append(ends)
    return out


def _digest(data) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), dtype=">i8").astype(np.int64) if digests else np.zeros(0, dtype=np.int64)


def _payloads(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, list[tuple[bytes, memoryview]]]]:
    """(row, unpadded size, payload digest, [(chunk digest, chunk)]) of each row."""
    for first, last, data, offsets in groups(batch.column("text")):
        payloads, at = padded(data, offsets)
        view = memoryview(payloads)
        for i, ends in enumerate(cuts(payloads, at)):
            starts = [int(at[i]), *ends[:-1]]
            chunks = [(_digest(view[a:b]), view[a:b]) for a, b in zip(starts, ends)]
            yield first + i, int(offsets[i + 1] - offsets[i]), hashlib.sha256(view[at[i] : at[i + 1]]).digest(), chunks


@trimmed
def _manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [(n, sha, [d for d, _ in chunks]) for _, n, sha, chunks in _payloads(batch)]
        n, sha, digests = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(_hashes(list(sha))), pa.array(digests, pa.list_(pa.binary()))],
            names=["doc_id", "n_bytes", "sha", "sha_hash", "digests"],
        )


_PARTS = pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary())]))


def _own(copies: np.ndarray, shared: np.ndarray):
    """Payloads that occur once, with the bytes of those of their chunks that do."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for _, n, sha, chunks in _payloads(batch):
                if bloom_has(copies, _hashes([sha]))[0]:
                    continue
                known = bloom_has(shared, _hashes([d for d, _ in chunks]))
                rows.append((n, sha, [{"digest": d, "data": None if k else bytes(x)} for (d, x), k in zip(chunks, known)]))
                size += n
                if size > 4 << 20:
                    yield _rows(rows)
                    rows, size = [], 0
            if rows:
                yield _rows(rows)

    return run


def _rows(rows: list) -> pa.RecordBatch:
    n, sha, parts = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(parts, _PARTS)], names=["n_bytes", "sha", "parts"])


def _loose(copies: np.ndarray, shared: np.ndarray):
    """Chunks that _own() leaves out."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = []
            for i, _, sha, chunks in _payloads(batch):
                known = bloom_has(shared, _hashes([d for d, _ in chunks])) | bloom_has(copies, _hashes([sha]))[0]
                rows += [(ids[i], k, d, bytes(x)) for k, (d, x) in enumerate(chunks) if known[k]]
            if rows:
                doc, seq, digest, data = zip(*rows)
                arrays = [pa.array(doc, pa.int64()), pa.array(seq, pa.int32()), pa.array(digest, pa.binary()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "seq", "digest", "data"])

    return run


def _features(samples: np.ndarray) -> str:
    """Level, energy, zero crossings and the commonest sample of the samples, in whole numbers."""
    x = samples.astype(np.int64)
    above = x >= 128
    return f"mean={int(x.sum()) * 1000 // len(x)};energy={int(((x - 128) ** 2).sum()) // len(x)};crossings={int((above[1:] != above[:-1]).sum())};mode={int(np.bincount(x, minlength=256).argmax())}"


_DECODED = "sha binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


@trimmed
def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rebuild the files of stored rows, verify chunks and payload, read the samples, compute features."""
    for batch in batches:
        rows = []
        for n, sha, parts in zip(batch.column("n_bytes").to_pylist(), batch.column("sha").to_pylist(), batch.column("parts").to_pylist()):
            for p in parts:
                if _digest(p["data"]) != p["digest"]:
                    raise ValueError("a stored chunk differs from its digest")
            body = b"".join(p["data"] for p in parts)
            media = wav_header(n, len(body)) + body
            _, payload = read_wav(media)
            found = hashlib.sha256(payload).digest()
            if found != sha:
                raise ValueError("a rebuilt payload differs from its digest")
            rows.append((sha, len(payload), found.hex(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), _features(np.frombuffer(payload, dtype=np.uint8))))
        if rows:
            types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in _DECODED.split(", ")])


def store(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Write the store of docs: distinct payloads, manifest, own payload rows, shared chunks; each staged."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    manifest = staged(texts.mapInArrow(_manifest, "doc_id long, n_bytes long, sha binary, sha_hash long, digests array<binary>"), "media-manifest")
    payloads = manifest.groupBy("sha").agg(F.count("*").alias("n"), F.min_by(F.struct("doc_id", "digests", "n_bytes"), "doc_id").alias("one"), F.first("sha_hash").alias("h"), F.first(F.struct("doc_id", "digests", "n_bytes")).alias("any"))
    payloads = staged(payloads.select("sha", "n", "h", F.coalesce("one", "any").alias("one")), "media-payloads")
    chunks = payloads.select("one.doc_id", F.posexplode("one.digests").alias("seq", "digest"))
    owners = chunks.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "seq")).alias("owner"))
    owners = staged(owners, "media-owners")
    as_long = F.expr("cast(conv(hex(substr(digest, 1, 8)), 16, -10) as bigint)")
    copies = bloom_of(payloads.where("n > 1").select("h"), "h")
    shared = bloom_of(owners.where("n > 1").select(as_long.alias("h")), "h")
    own = staged(texts.mapInArrow(_own(copies, shared), "n_bytes long, sha binary, parts array<struct<digest binary, data binary>>"), "media-own")
    loose = texts.mapInArrow(_loose(copies, shared), "doc_id long, seq int, digest binary, data binary")
    o = owners.select(F.col("digest").alias("d"), F.col("owner.doc_id").alias("o_doc"), F.col("owner.seq").alias("o_seq"))
    once = loose.join(o, F.expr("digest = d and doc_id <=> o_doc and seq = o_seq"), "left_semi").dropDuplicates(["digest"])
    return payloads, manifest, own, staged(once.select("digest", "data"), "media-shared")


def media_features(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what is read back from the store, one row for each row of docs."""
    payloads, manifest, own, shared = store(docs)
    whole = F.expr("forall(parts, p -> p.data is not null)")
    direct = own.where(whole).mapInArrow(_decode, _DECODED)
    held = own.where(~whole)
    lists = payloads.join(own.select("sha"), "sha", "left_anti").select("sha", F.col("one.n_bytes").alias("n_bytes"), F.posexplode("one.digests").alias("seq", "digest"))
    parts = held.select("sha", "n_bytes", F.posexplode("parts").alias("seq", "p")).select("sha", "n_bytes", "seq", "p.digest", "p.data")
    wanted = lists.unionByName(parts.where("data is null").drop("data"))
    fetched = wanted.join(shared, "digest").unionByName(parts.where("data is not null"), allowMissingColumns=True)
    rebuilt = (
        fetched.groupBy("sha", "n_bytes").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "data"))).alias("parts"))
        .select("n_bytes", "sha", F.expr("transform(parts, p -> struct(p.digest as digest, p.data as data))").alias("parts"))
        .mapInArrow(_decode, _DECODED)
    )
    decoded = direct.unionByName(rebuilt)
    return manifest.select("doc_id", "n_bytes", "sha").join(decoded, "sha").drop("sha")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(read(spark, sf_dir, "documents"))
