"""Words of whole Arrow batches as flat numpy arrays.

One pass over the bytes of a batch gives every word's place and a 64-bit hash, so
the Python operators never build an object per word. Memory is bounded by
``SLICE_BYTES`` of text at a time, or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Texts are worked on in slices of about this many bytes; a byte takes about 50 in numbers on the way.
SLICE_BYTES = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)


def _random_table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words (all of UTF-8's bytes from 0x80 on do), and
    what each byte counts as."""

    member: np.ndarray  # bool by byte
    image: np.ndarray  # uint8 by byte: A-Z become a-z

    @property
    def values(self) -> np.ndarray:
        return _random_table()[self.image]


def _image() -> np.ndarray:
    image = np.arange(256, dtype=np.uint8)
    image[65:91] += 32
    return image


def spaced_words() -> Alphabet:
    """Words are runs of anything but the space and 0x09 to 0x0D."""
    member = np.ones(256, bool)
    member[[32, 9, 10, 11, 12, 13]] = False
    return Alphabet(member, _image())


def item_words() -> Alphabet:
    """Words are runs of digits, letters and anything outside ASCII."""
    member = np.zeros(256, bool)
    member[48:58] = member[65:91] = member[97:123] = member[128:] = True
    return Alphabet(member, _image())


@dataclass
class Words:
    """``first[d] .. first[d + 1]`` are the words of text ``d``."""

    data: np.ndarray  # the bytes, lower-cased
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray  # byte range of each text in ``data``
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def joined(self, i: int, n: int) -> bytes:
        """``n`` words from ``i``, one space between."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[i : i + n], self.ends[i : i + n], strict=True))


_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(factors)
        if n <= 4 * SLICE_BYTES:  # a single huge text leaves no table behind
            _powers[str(base)] = have
    return have[:n]


def words_of(texts: pa.Array, alphabet: Alphabet) -> Words:
    """``texts`` is a string or binary array; a null text has no words."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    raw = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    lo, hi = int(raw[0]), int(raw[-1])
    buffer = texts.buffers()[2]
    source = np.frombuffer(buffer, np.uint8)[lo:hi] if buffer is not None and hi > lo else np.zeros(0, np.uint8)
    offsets = raw - lo
    if texts.null_count:  # bytes under a null do not count
        source = source.copy()
        for i in np.flatnonzero(np.asarray(texts.is_null())):
            source[offsets[i] : offsets[i + 1]] = 32
    member = alphabet.member[source]
    before = np.zeros(len(source) + 1, bool)
    before[1:] = member
    before[offsets] = False
    starts = np.flatnonzero(member & ~before[:-1])
    after = np.zeros(len(source) + 1, bool)
    after[:-1] = member
    after[offsets] = False
    ends = np.flatnonzero(member & ~after[1:]) + 1
    first = np.searchsorted(starts, offsets)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(source) + 1, np.uint64)
        np.cumsum(alphabet.values[source] * _power(_BASE, len(source)), out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * _power(_INVERSE, len(source) + 1)[starts]
    return Words(alphabet.image[source], starts, ends, first, offsets, mix(hashes ^ (ends - starts).astype(np.uint64)))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes, text borders ignored."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * _SHINGLE + hashes[j : len(hashes) - n + 1 + j]
    return mix(out)


def inside(words: Words, n: int) -> np.ndarray:
    """Of each run that ``windows`` made: whether it lies in one text."""
    size = max(0, len(words.hashes) - n + 1)
    fits = np.ones(size, bool)
    for border in words.first[1:-1]:
        fits[max(0, border - n + 1) : border] = False
    return fits


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of about ``SLICE_BYTES`` of text."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + SLICE_BYTES, side="right")) - 1
        stop = min(batch.num_rows, max(start + 1, stop))
        yield batch.slice(start, stop - start)
        start = stop
