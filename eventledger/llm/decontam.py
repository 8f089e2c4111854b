"""Benchmark decontamination by suffix arrays over the training texts.

Each task builds the suffix array of its shard (some megabytes of texts, at word level), sorted as deep as
the longest benchmark item, and binary-searches every benchmark suffix in it. That gives the longest verbatim
match of each suffix; a suffix that matches at least a window long is located in the documents, and hit words
and items are kept per document. The longest match of a document is read off at its hit places, which are looked up among the
sorted suffixes of the items. No text leaves its task and nothing is shuffled.

The benchmark is the stated query set. It goes to tasks in blocks of at most BLOCK_BYTES of text, one on the driver at a time.
If there are several, a first pass looks for windows of the whole benchmark in a Bloom filter of bounded size; documents
without any are done, and the others are staged and go through one pass for each block, which adds to the state that rows carry.

Defined results: null texts have no words and no hits; items without words have no window, shorter items one
window of all their words; items are told apart by their id, however many rows it has, and rows without an id are searched for hits but
count as no item; rows of equal texts have equal results; an empty benchmark hits nothing; empty tables
give empty tables. Columns of any name stay.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import ALNUM, groups, mixed, words_of
from .common import bloom_has, bloom_of, read, staged, trimmed, unused

WINDOW = 10
SHARD_BYTES, BLOCK_BYTES = 8 << 20, 8 << 20


@dataclass
class Block:
    """Word hashes of some items one after another; windows by distinct content and the places that have each."""

    names: list
    words: np.ndarray
    bounds: np.ndarray
    #: Per distinct window: its first word in words, its length.
    at: np.ndarray
    length: np.ndarray
    #: Items that hold window i: item from place[i] to place[i + 1], each once.
    place: np.ndarray
    item: np.ndarray

    @property
    def depth(self) -> int:
        return int(np.diff(self.bounds).max(initial=1))

    @cached_property
    def suffixes(self) -> Shard:
        return Shard(self.words, self.bounds, self.depth)


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts and where each text's start."""
    hashes, bounds, n = [np.zeros(0, dtype=np.uint64)], [np.zeros(1, dtype=np.int64)], 0
    for _, _, data, offsets in groups(texts):
        w = words_of(data, offsets, ALNUM)
        hashes.append(w.hashes)
        bounds.append(w.bounds[1:] + n)
        n += len(w.hashes)
    return np.concatenate(hashes), np.concatenate(bounds)


def block_of(names: list, texts: pa.Array, window: int = WINDOW) -> Block:
    """names: of the items, repeated where one has several rows; None for rows that count as no item."""
    words, bounds = hashed(texts)
    number = {x: i for i, x in enumerate(dict.fromkeys(x for x in names if x is not None))}
    first, length, item, content = [], [], [], []
    for name, a, b in zip(names, bounds[:-1], bounds[1:]):
        size = min(window, b - a)
        for j in range(b - a - size + 1 if size else 0):
            first.append(a + j)
            length.append(size)
            item.append(number.get(name, -1))
            content.append(words[a + j : a + j + size].tobytes())
    ids: dict = {}
    which = np.array([ids.setdefault(c, len(ids)) for c in content], dtype=np.int64)
    first, length, item = (np.array(x, dtype=np.int64) for x in (first, length, item))
    _, least = np.unique(which, return_index=True)
    held = np.unique(np.stack([which, item]), axis=1) if len(which) else np.zeros((2, 0), dtype=np.int64)
    held = held[:, held[1] >= 0]
    return Block(list(number), words, bounds, first[least], length[least], np.searchsorted(held[0], np.arange(len(ids) + 1)), held[1])


class Shard:
    """The suffix array of some documents' words, sorted depth words deep; suffixes end with their document."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray, depth: int):
        self.n, self.bounds = len(words), bounds
        self.vocabulary, rank = np.unique(words, return_inverse=True)
        # Even ranks; words outside the vocabulary lie between, 0 is a document's end. Padding for look-ahead.
        self.end = np.repeat(bounds[1:], np.diff(bounds))
        self.rank = np.zeros(self.n + 1, dtype=np.int64)
        self.rank[:-1] = rank.ravel() * 2 + 2
        self.order = self._sorted(depth)

    def word(self, at: np.ndarray, step, end: np.ndarray) -> np.ndarray:
        """Rank of the word step after at, 0 from end on."""
        there = at + step
        return np.where(there < end, self.rank[np.minimum(there, self.n)], 0)

    def _sorted(self, depth: int) -> np.ndarray:
        if not self.n:
            return np.zeros(0, dtype=np.int64)
        every = np.arange(self.n)
        bits = int(self.rank.max()).bit_length()
        span = max(1, 63 // bits)
        key = np.zeros(self.n, dtype=np.int64)
        for j in range(span):
            key = (key << bits) | self.word(every, j, self.end)
        order = np.argsort(key, kind="stable")
        # group[i]: first place of the suffixes that are equal so far to the one at i
        place = np.zeros(self.n, dtype=np.int64)
        lead = np.ones(self.n, dtype=bool)
        lead[1:] = key[order][1:] != key[order][:-1]
        group = np.maximum.accumulate(np.where(lead, every, 0))
        place[order] = group
        while span < depth:
            alone = lead.copy()
            alone[:-1] &= lead[1:]
            open_ = np.flatnonzero(~alone)
            if not len(open_):
                break
            rows = order[open_]
            ahead = rows + span
            next_ = np.where(ahead < self.end[rows], place[np.minimum(ahead, self.n - 1)] + 1, 0)
            own = group[open_]
            by = np.lexsort((next_, own))
            order[open_] = rows[by]
            next_ = next_[by]
            lead[open_[1:]] |= (own[by][1:] == own[by][:-1]) & (next_[1:] != next_[:-1])
            group = np.maximum.accumulate(np.where(lead, every, 0))
            place[order[open_]] = group[open_]
            span *= 2
        return order

    def ranks(self, words: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, words)
        known = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == words
        return np.where(known, 2 * at + 2, 2 * at + 1)

    def search(self, query: np.ndarray, start: np.ndarray, end: np.ndarray, after: bool = False) -> np.ndarray:
        """Where each query[start:end] would go: before its equals (and what it begins), or after them."""
        low, high = np.zeros(len(start), dtype=np.int64), np.full(len(start), self.n)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            less = self._less(self.order[middle], query, start[open_], end[open_], after)
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        return low

    def _less(self, suffix, query, start, end, after: bool) -> np.ndarray:
        out = np.full(len(suffix), after)
        rows, step = np.arange(len(suffix)), 0
        while (rows := rows[start[rows] + step < end[rows]]).size:
            a, b = self.word(suffix[rows], step, self.end[suffix[rows]]), query[start[rows] + step]
            out[rows[a < b]] = True
            out[rows[a > b]] = False
            rows = rows[a == b]
            step += 1
        return out

    def common(self, place: np.ndarray, query, start, end) -> np.ndarray:
        """Words in common of the suffix at a place of the order and query[start:end]; 0 outside the order."""
        out = np.zeros(len(place), dtype=np.int64)
        rows = np.flatnonzero((place >= 0) & (place < self.n))
        suffix, step = self.order[np.clip(place, 0, self.n - 1)], 0
        while (rows := rows[start[rows] + step < end[rows]]).size:
            rows = rows[self.word(suffix[rows], step, self.end[suffix[rows]]) == query[start[rows] + step]]
            step += 1
            out[rows] = step
        return out


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of ranges, and the range of each."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    return low[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size), which


def match(shard: Shard, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hit words as booleans, document and item of each item found, longest verbatim match of each document)."""
    docs = len(shard.bounds) - 1
    hit = np.zeros(shard.n + 1, dtype=np.int64)
    longest = np.zeros(docs, dtype=np.int64)
    none = np.zeros(0, dtype=np.int64)
    if not shard.n or not len(block.at):
        return hit[:-1] > 0, none, none, longest
    query = shard.ranks(block.words)
    ends = np.repeat(block.bounds[1:], np.diff(block.bounds))
    start = np.arange(len(query))
    at = shard.search(query, start, ends)
    reach = np.maximum(shard.common(at - 1, query, start, ends), shard.common(at, query, start, ends))
    found = np.flatnonzero(reach[block.at] >= block.length)
    first, last = block.at[found], block.at[found] + block.length[found]
    places, which = _ranges(shard.search(query, first, last), shard.search(query, first, last, after=True))
    if not len(places):
        return hit[:-1] > 0, none, none, longest
    position, window = shard.order[places], found[which]
    np.add.at(hit, position, 1)
    np.add.at(hit, position + block.length[window], -1)
    doc = np.searchsorted(shard.bounds, position, side="right") - 1
    # Each window once a document, then the items that hold it.
    seen = np.unique(np.stack([doc, window]), axis=1)
    spot, row = _ranges(block.place[seen[1]], block.place[seen[1] + 1])
    pairs = np.unique(np.stack([seen[0][row], block.item[spot]]), axis=1)
    # Each hit place once, between its neighbours among the items' suffixes.
    position = np.unique(position)
    text = block.suffixes.ranks(shard.vocabulary)[(shard.rank[:-1] - 2) // 2]
    at = block.suffixes.search(text, position, shard.end[position])
    reach = np.maximum(block.suffixes.common(at - 1, text, position, shard.end[position]), block.suffixes.common(at, text, position, shard.end[position]))
    np.maximum.at(longest, np.searchsorted(shard.bounds, position, side="right") - 1, reach)
    return np.cumsum(hit[:-1]) > 0, pairs[0], pairs[1], longest


STATE = [("words", T.LongType()), ("hits", T.ArrayType(T.LongType())), ("items", T.ArrayType(T.StringType())), ("longest", T.LongType())]


def _runs(hit: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """Per document first and last + 1 word of each run of hit words, counted in the document."""
    n = len(hit)
    flag = np.zeros(n + 1, dtype=bool)
    flag[:-1] = hit
    before = np.zeros(n, dtype=bool)
    before[1:] = hit[:-1]
    before[bounds[(bounds > 0) & (bounds < n)]] = False
    after = flag[1:].copy()
    after[bounds[1:][bounds[1:] > 0] - 1] = False
    first, last = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
    at = np.searchsorted(first, bounds)
    base = np.repeat(bounds[:-1], np.diff(at))
    return pa.ListArray.from_arrays(pa.array((2 * at).astype(np.int32)), pa.array(np.stack([first - base, last - base], axis=1).ravel().astype(np.int64)))


def _in_shards(one: Callable[[pa.Table], pa.RecordBatch], text: str):
    """A task function that hands rows on in shards of about SHARD_BYTES of text."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
            total, start = np.cumsum(lengths), 0
            for i in range(batch.num_rows):
                if size + total[i] - (total[start - 1] if start else 0) >= SHARD_BYTES:
                    held.append(batch.slice(start, i + 1 - start))
                    yield one(pa.Table.from_batches(held))
                    held, size, start = [], 0, i + 1
            if start < batch.num_rows:
                held.append(batch.slice(start))
                size += total[-1] - (total[start - 1] if start else 0)
        if held:
            yield one(pa.Table.from_batches(held))

    return run


def _searched(block: Block, keep: list[str], text: str, state: list[str], first: bool):
    def one(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        words, bounds = hashed(rows.column(text))
        hit, doc, item, longest = match(Shard(words, bounds, block.depth), block)
        names = pa.array([str(x) for x in block.names], type=pa.string())
        at = np.searchsorted(doc, np.arange(rows.num_rows + 1))
        items = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), names.take(pa.array(item)))
        if not first:
            _, hits, old, far = (rows.column(c) for c in state)
            for i, flat in enumerate(hits.to_pylist()):
                for a, b in zip(flat[::2], flat[1::2]):
                    hit[bounds[i] + a : bounds[i] + b] = True
            items = pa.array([sorted({*x, *y}) for x, y in zip(items.to_pylist(), old.to_pylist())], type=pa.list_(pa.string()))
            longest = np.maximum(longest, far.to_numpy())
        return _batch(rows, keep, state, [pa.array(np.diff(bounds)), _runs(hit, bounds), items, pa.array(longest)])

    return _in_shards(one, text)


def _batch(rows: pa.Table, keep: list[str], names: list[str], added: list) -> pa.RecordBatch:
    columns = [rows.column(c).combine_chunks() for c in keep] + added
    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays(columns, names=keep + names)


def _window_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all windows of size words."""
    n = np.maximum(0, np.diff(bounds) - size + 1)
    text = np.repeat(np.arange(len(n)), n)
    first = bounds[text] + np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    h = np.full(len(text), size, dtype=np.uint64)
    for j in range(size):
        h = mixed(h + words[first + j] * np.uint64(2 * j + 3))
    return text, h.view(np.int64)


def _item_windows(window: int):
    """(size, hash) of the windows of items."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = hashed(batch.column("text"))
            n = np.minimum(np.diff(bounds), window)
            for size in np.unique(n[n > 0]).tolist():
                text, h = _window_hashes(words, bounds, size)
                h = h[n[text] == size]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), size)), pa.array(h)], names=["size", "h"])

    return run


def _sifted(wanted: np.ndarray, sizes: list[int], keep: list[str], text: str, state: list[str]):
    """Rows with a fresh state, whose longest match is -1 where a window of the benchmark may occur."""

    def one(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        words, bounds = hashed(rows.column(text))
        longest = np.zeros(rows.num_rows, dtype=np.int64)
        for size in sizes:
            doc, h = _window_hashes(words, bounds, size)
            longest[doc[bloom_has(wanted, h)]] = -1
        none = pa.ListArray.from_arrays(pa.array(np.zeros(rows.num_rows + 1, dtype=np.int32)), pa.array([], pa.int64()))
        return _batch(rows, keep, state, [pa.array(np.diff(bounds)), none, none.cast(pa.list_(pa.string())), pa.array(longest)])

    return _in_shards(one, text)


def blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_BYTES) -> tuple[int, Iterator[Block]]:
    """How many blocks of about most bytes of text each the items make, and the blocks, each collected when it is asked for."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-2 * total // most)) if total > most else 1

    def each() -> Iterator[Block]:
        for b in range(n):
            part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b)
            rows = part.orderBy("item", "text").collect()
            yield block_of([r.item for r in rows], pa.array([r.text for r in rows], type=pa.large_string()), window)

    return n, each()


def searched(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW) -> tuple[DataFrame, dict[str, str]]:
    """The columns keep of docs and the state: words, runs of hit words, items found, longest match; and the state's column names."""
    names = {k: unused([*keep, "text"], k) for k, _ in STATE}
    state = list(names.values())
    schema = lambda columns: T.StructType([docs.schema[c] for c in columns] + [T.StructField(names[k], kind) for k, kind in STATE])
    carried = [*keep, *(["text"] if "text" not in keep else [])]
    n, each = blocks(benchmark, window)
    if n == 1:
        return docs.select(*carried).mapInArrow(_searched(next(each), keep, "text", state, True), schema(keep)), names
    windows = staged(benchmark.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_item_windows(window), "size long, h long"), "windows")
    sizes = [r.size for r in windows.select("size").distinct().collect()]
    out = staged(docs.select(*carried).mapInArrow(_sifted(bloom_of(windows, "h"), sizes, carried, "text", state), schema(carried)), "sifted")
    far = F.col(names["longest"])
    done, open_ = out.where(far == 0), out.where(far < 0).withColumn(names["longest"], F.lit(0).cast("long"))
    for block in each:
        open_ = staged(open_.mapInArrow(_searched(block, carried, "text", state, False), schema(carried)), "searched")
    return done.unionByName(open_).select(*keep, *state), names


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those that hold a window of a benchmark item; all columns stay."""
    rows, names = searched(docs, benchmark, docs.columns, window)
    return rows.where(F.size(names["hits"]) == 0).select(*docs.columns)


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = searched(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = F.expr("aggregate(sequence(0, size(hits) div 2), 0L, (a, i) -> a + coalesce(get(hits, 2 * i + 1) - get(hits, 2 * i), 0L))")
    return rows.select(
        "doc_id",
        F.col("words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.col("longest").alias("longest_match"),
    )
