"""Token ids in binary blocks: one concatenated id array and Elias-Fano document boundaries.

Documents are dealt by ranges of doc_id and text hash and sorted within them; each task encodes its range and cuts it into
blocks of some million ids. A block holds a header, its documents' ids and ends, both Elias-Fano encoded, and the token ids,
16 bits each where the vocabulary allows. Blocks are binary rows of Parquet files that Spark writes and commits, so
that any store and lost tasks are no matter. Offsets over all files are the sum of the shards before, the
block's base within its shard, and a select in the block.

Encoding uses the tokenizers library. Byte-level pre-tokenization always cuts before a space that a non-space
follows, so a text's ids are those of the parts between such cuts. Each worker keeps a bounded table of parts that it has
met (their bytes, found by hash and then compared, and the ids) and looks up all parts of some megabytes of text at
once; only new parts are encoded. Tokenizers of another kind, and texts that hold a special token, are encoded as a whole.

Defined results: a null or empty text is the end id alone; null doc_ids come first; rows with equal doc_id follow
each other, in order of their text's hash; equal rows go to one task; an empty table gives no block. Only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytewords import groups, mixed, random_values, range_hashes
from .common import read, staged, trimmed
from .eliasfano import EliasFano

END = 0
MAGIC = b"EFTK"
#: Ids of a block, slots of a worker's table of parts (half are used), entries of its table of pieces.
BLOCK_IDS, SLOTS, PIECES = 4_000_000, 1 << 21, 150_000

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Parts of parts that surely are pre-tokens of their own: Latin letters, common signs, a line end.
_PIECES = re.compile(rf"[{_LETTERS}]+|[.,;:!?%#$&*|()-]+|\n")
_PLAIN = re.compile(rf"(?:[{_LETTERS}]+|[.,;:!?%#$&*|()-]+|\n(?!\n))+\Z")
#: Bytes that can begin a white-space character.
_MAY_BE_SPACE = np.zeros(256, dtype=bool)
_MAY_BE_SPACE[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_VALUES = random_values(50257, False)


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte: itself, or one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Where the ranges of two byte arrays are equal; length holds no 0."""
    if not len(length):
        return np.zeros(0, dtype=bool)
    first = np.cumsum(length) - length
    step = np.arange(first[-1] + length[-1])
    equal = a[step + np.repeat(a_start - first, length)] == b[step + np.repeat(b_start - first, length)]
    return np.logical_and.reduceat(equal, first)


class Pool:
    """An array that grows."""

    def __init__(self, kind: str):
        self.data, self.filled = np.zeros(1 << 16, dtype=kind), 0

    def add(self, values: np.ndarray) -> int:
        if self.filled + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(len(self.data), len(values)), dtype=self.data.dtype)])
        self.data[self.filled : self.filled + len(values)] = values
        self.filled += len(values)
        return self.filled - len(values)


class Parts:
    """An open-addressed table from parts of texts to ranges of a pool of ids, filled and read in arrays."""

    def __init__(self, kind: str, slots: int = SLOTS):
        self.slots, self.used = slots, 0
        self.keys = np.zeros(slots, dtype=np.uint64)
        self.start, self.length, self.text_start, self.text_length = (np.zeros(slots, dtype=np.int32) for _ in range(4))
        self.ids, self.text = Pool(kind), Pool("u1")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 where one isn't there."""
        out = np.full(len(keys), -1, dtype=np.int64)
        rows, at = np.arange(len(keys)), (keys & np.uint64(self.slots - 1)).astype(np.int64)
        while len(rows):
            held = self.keys[at]
            same = held == keys[rows]
            out[rows[same]] = at[same]
            on = ~same & (held != 0)
            rows, at = rows[on], (at[on] + 1) & (self.slots - 1)
        return out

    def are(self, at: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Where the part in slot at is the one in data, byte for byte."""
        out = (at >= 0) & (self.text_length[at] == length)
        rows = np.flatnonzero(out)
        out[rows] = same_bytes(self.text.data, self.text_start[at[rows]].astype(np.int64), data, start[rows], length[rows])
        return out

    def insert(self, keys: np.ndarray, texts: list[bytes], start: np.ndarray, length: np.ndarray) -> None:
        """Distinct keys that aren't there; those beyond half of the slots are left out."""
        room = max(0, self.slots // 2 - self.used)
        keys, start, length = keys[:room], start[:room], length[:room]
        self.used += len(keys)
        sizes = np.array([len(x) for x in texts[:room]], dtype=np.int64)
        text = self.text.add(np.frombuffer(b"".join(texts[:room]), dtype=np.uint8)) + np.cumsum(sizes) - sizes
        rows, at = np.arange(len(keys)), (keys & np.uint64(self.slots - 1)).astype(np.int64)
        while len(rows):
            free = self.keys[at] == 0
            where, first = np.unique(at[free], return_index=True)
            who = rows[free][first]
            self.keys[where], self.start[where], self.length[where] = keys[who], start[who], length[who]
            self.text_start[where], self.text_length[where] = text[who], sizes[who]
            placed = np.zeros(len(keys), dtype=bool)
            placed[who] = True
            on = ~placed[rows]
            rows, at = rows[on], (at[on] + 1) & (self.slots - 1)


class Encoder:
    """Ids of texts, with tables of the parts met before."""

    def __init__(self, path: str, slots: int = SLOTS, values: np.ndarray = _VALUES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        before = spec.get("pre_tokenizer") or {}
        self.cuts = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
        self.letters = _byte_letters()
        self.parts, self.values = Parts(self.kind, slots), values
        self.pieces: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token, by the tokenizer's model alone."""
        found = self.pieces.get(piece)
        if found is None:
            shown = piece.encode().decode("latin-1").translate(self.letters)
            found = np.array([t.id for t in self.tokenizer.model.tokenize(shown)], dtype=self.kind).tobytes()
            if len(self.pieces) < PIECES:
                self.pieces[piece] = found
        return found

    def _new(self, texts: list[str]) -> list[bytes]:
        """Ids of parts: piece by piece where it is plain how they are cut, else by the tokenizer as a whole."""
        out, odd = [b""] * len(texts), []
        for i, t in enumerate(texts):
            space = t[:1] == " "
            if self.cuts and _PLAIN.match(t, space):
                pieces = _PIECES.findall(t, space)
                if space:
                    pieces[0] = " " + pieces[0]
                out[i] = b"".join([self._piece(x) for x in pieces])
            else:
                odd.append(i)
        for i, ids in zip(odd, self._whole([texts[i] for i in odd])):
            out[i] = ids
        return out

    def _starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where parts begin: at texts, and at spaces that a non-space of the same text follows."""
        first = offsets[:-1][np.diff(offsets) > 0]
        if not self.cuts or len(data) < 2:
            return first
        space = np.zeros(len(data), dtype=bool)
        space[:-1] = (data[:-1] == 32) & ~_MAY_BE_SPACE[data[1:]]
        space[offsets[1:][offsets[1:] > 0] - 1] = False
        raw = data.tobytes() if any(len(s) for s in self.special) else b""
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                doc = int(np.searchsorted(offsets, at, side="right")) - 1
                space[offsets[doc] : offsets[doc + 1]] = False
                at = raw.find(s, max(at + 1, int(offsets[doc + 1])))
        space[first] = True
        return np.flatnonzero(space)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, each with the end id; number of ids of each text)."""
        starts = self._starts(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        size, parts = ends - starts, self.parts
        keys = mixed(range_hashes(data, starts, ends, self.values) + size.astype(np.uint64)) | np.uint64(1)
        at = parts.find(keys)
        known = parts.are(at, data, starts, size)
        # Of new parts with one hash the first is encoded for all that have its bytes, any others by themselves.
        missing = np.flatnonzero(~known)
        new, one, back = np.unique(keys[missing], return_index=True, return_inverse=True)
        first = missing[one][back.ravel()]
        alike = size[first] == size[missing]
        alike[alike] = same_bytes(data, starts[first[alike]], data, starts[missing[alike]], size[missing[alike]])
        rows = np.concatenate([missing[one], missing[~alike]])
        back = back.ravel()
        back[~alike] = len(one) + np.arange(len(rows) - len(one))
        raw = data.tobytes() if len(rows) else b""
        texts = [raw[starts[i] : ends[i]] for i in rows]
        ids = self._new([t.decode() for t in texts])
        sizes = np.array([len(x) // self.width for x in ids], dtype=np.int64)
        kept = parts.ids.filled
        place = parts.ids.add(np.frombuffer(b"".join(ids), dtype=self.kind)) + np.cumsum(sizes) - sizes
        final = parts.ids.add(np.array([end], dtype=self.kind))
        start, length = parts.start[at].astype(np.int64), parts.length[at].astype(np.int64)
        start[missing], length[missing] = place[back], sizes[back]
        last = np.searchsorted(starts, offsets[1:], side="left")
        start, length = np.insert(start, last, final), np.insert(length, last, 1)
        total = np.cumsum(length)
        out = parts.ids.data[np.repeat(start - total + length, length) + np.arange(total[-1] if len(total) else 0)]
        counts = np.diff(np.concatenate([[0], total[last + np.arange(len(last))]]))
        # Keep the ids of parts that found room in the table; a hash that is taken keeps its part.
        fresh = np.flatnonzero(at[missing[one]] < 0)[: max(0, parts.slots // 2 - parts.used)]
        held = b"".join([ids[i] for i in fresh])
        parts.ids.filled = kept
        place = parts.ids.add(np.frombuffer(held, dtype=self.kind)) + np.cumsum(sizes[fresh]) - sizes[fresh]
        parts.insert(new[fresh], [texts[i] for i in fresh], place, sizes[fresh])
        return out, counts


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_block(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """doc_ids: None, as often as there is, then whole numbers in order; counts: ids of each document, end included."""
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    nulls, least = len(doc_ids) - len(known), int(known[0]) if len(known) else 0
    numbers = EliasFano.of((known - np.int64(least)).view(np.uint64)).to_bytes()  # a difference of 64-bit numbers is right modulo 2**64
    ends = EliasFano.of(np.cumsum(counts)).to_bytes()
    return b"".join([MAGIC, struct.pack("<BQq", ids.dtype.itemsize, nulls, least), numbers, ends, ids.tobytes()])


@dataclass
class Block:
    """A block as read: documents by place, their boundaries by select."""

    nulls: int
    least: int
    numbers: EliasFano
    ends: EliasFano
    ids: np.ndarray

    def __len__(self) -> int:
        return self.ends.n

    def doc_ids(self, places: np.ndarray) -> pa.Array:
        known = places >= self.nulls
        out = np.zeros(len(places), dtype=np.int64)
        out[known] = (self.numbers.select(places[known] - self.nulls) + np.array(self.least).astype(np.uint64)).view(np.int64)
        return pa.array(out, mask=~known)

    def bounds(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of documents start and end."""
        start = np.zeros(len(places), dtype=np.int64)
        later = places > 0
        start[later] = self.ends.select(places[later] - 1)
        return start, self.ends.select(places).astype(np.int64)


def read_block(block: bytes) -> Block:
    if block[:4] != MAGIC:
        raise ValueError("not a token block")
    width, nulls, least = struct.unpack_from("<BQq", block, 4)
    numbers, at = EliasFano.from_bytes(block, 4 + struct.calcsize("<BQq"))
    ends, at = EliasFano.from_bytes(block, at)
    return Block(nulls, least, numbers, ends, np.frombuffer(block, f"<u{width}", offset=at))


_BLOCKS = "shard int, block int, base long, n_ids long, data binary"


def _written(path: str, end: int):
    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, base = TaskContext.get().partitionId(), 0, 0
        coder = encoder(path)
        docs, counts, held, size = [], [], [], 0

        def flushed() -> pa.RecordBatch:
            data = write_block(docs, np.concatenate(counts), np.concatenate(held))
            arrays = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([base], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["shard", "block", "base", "n_ids", "data"])

        for batch in batches:
            for first, last, data, offsets in groups(batch.column("text")):
                ids, n = coder.encode(data, offsets, end)
                docs += batch.column("doc_id").slice(first, last - first).to_pylist()
                counts.append(n)
                held.append(ids)
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield flushed()
                    base += size
                    block += 1
                    docs, counts, held, size = [], [], [], 0
        if docs:
            yield flushed()

    return run


@trimmed
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for before, data in zip(batch.column("before").to_pylist(), batch.column("data")):
            block = read_block(data.as_py())
            places = np.arange(len(block))
            start, end = block.bounds(places)
            crc = [zlib.crc32(block.ids[a:b].astype("<u4")) for a, b in zip(start.tolist(), end.tolist())]
            arrays = [block.doc_ids(places), pa.array(start + before), pa.array(end - start), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write(docs: DataFrame, tokenizer: str, end: int = END, shards: int | None = None) -> DataFrame:
    """Encode docs and write their blocks: the staged table of blocks, from as many tasks as shards (spark.sql.shuffle.partitions by default).

    A task holds one block at a time, however large its share of docs is.
    """
    n = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    dealt = rows.repartitionByRange(n, "doc_id", "hash").sortWithinPartitions("doc_id", "hash").select("doc_id", "text")
    return staged(dealt.mapInArrow(_written(tokenizer, end), _BLOCKS), "tokens")


def documents_of(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the blocks.

    The table of shards is broadcast: it has one row for each partition of the writer, spark.sql.shuffle.partitions at most.
    """
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    shards = shards.select("shard", before.alias("earlier"))
    placed = blocks.join(F.broadcast(shards), "shard").select((F.col("earlier") + F.col("base")).alias("before"), "data")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_of(write(read(spark, sf_dir, "documents"), default_tokenizer()))
