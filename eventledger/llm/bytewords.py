"""Words of many texts at once, over their UTF-8 bytes in numpy; no Python object per word.

Both word classes of the operators split at single ASCII bytes only, so bytes give the same words as
code points. A-Z count as a-z. A word's hash is a sum of random 64-bit values, one for each byte and its place in the word, then
mixed: unlike a polynomial it has no words that collide whatever the random values, such as those of Thue and Morse.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are handled in groups of about this many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 21

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: `[^\x20\x09-\x0D]+`
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of texts whose A-Z are lower-cased
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: Places that have random values of their own; those of later ones are mixed from these.
PLACES = 64


def random_values(seed: int, fold: bool) -> np.ndarray:
    """A random value for each place and byte."""
    values = np.random.default_rng(seed).integers(1, 1 << 63, (PLACES, 256), dtype=np.uint64)
    return (values[:, _FOLD] if fold else values).ravel()


_VALUES = random_values(20240131, True)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def value_sums(data: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values before each byte; a byte's place counts from the last of starts before it."""
    place = np.arange(len(data))
    if len(starts):
        place[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    each = values[((place & (PLACES - 1)) << 8) | data]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        each[far] = mixed(each[far] + (place[far] // PLACES).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(each, out=sums[1:])
    return sums


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hashes of ranges of bytes, in order and apart."""
    sums = value_sums(data, starts, values)
    return mixed(sums[ends] - sums[starts])


@dataclass
class Words:
    """Words of some texts in order: hash, first byte and byte after the last, and by text where its words start."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    sums: np.ndarray

    def prefixes(self, n: int) -> np.ndarray:
        """Hashes of the first n bytes of each word; of a shorter word, 0."""
        long_enough = self.ends - self.starts >= n
        at = self.starts[long_enough]
        out = np.zeros(len(self.starts), dtype=np.uint64)
        out[long_enough] = mixed(self.sums[at + n] - self.sums[at])
        return out

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """data: uint8 of all texts; offsets: where each starts, and the end."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        empty = none.astype(np.uint64)
        return Words(empty, none, none, np.zeros(len(offsets), dtype=np.int64), empty)
    inside = kind[data]
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    before[cuts] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    sums = value_sums(data, starts, _VALUES)
    return Words(mixed(sums[ends] - sums[starts]), starts, ends, np.searchsorted(starts, offsets), sums)


def groups(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, offsets from 0) of groups of texts; nulls are empty."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, where, content = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(content, dtype=np.uint8) if content is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + GROUP_BYTES, side="right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
