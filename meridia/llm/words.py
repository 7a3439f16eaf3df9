"""Words of Arrow text columns as numpy arrays, many documents at a time.

A word is a run of digits, ASCII letters and code points from U+0080 up, with A-Z lower-cased first; in UTF-8 that is a
run of the bytes that LOWERED maps to non-zero. Everything is computed over whole byte buffers; there is no loop over
documents or words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
STEP = U64(0xD1B54A32D192ED03)
#: Bytes that are looked at together.
SPAN = 1 << 22


def _lowered() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    for lo, hi in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        t[lo : hi + 1] = np.arange(lo, hi + 1)
    t[0x41:0x5B] = np.arange(0x61, 0x7B)
    return t


#: Byte to lower-cased word byte, 0 for what parts words.
LOWERED = _lowered()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_SHORT = 64
_SHORT_TABLE = mix(np.arange(1, _SHORT * 256 + 1, dtype=U64) * GOLDEN)


def byte_values(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A random-looking number for each byte at its place in a word. Their sums tell words apart whatever their pattern is, which powers of one base
    modulo 2**64 do not."""
    at = place * 256 + byte
    if not len(at) or int(place.max()) < _SHORT:
        return _SHORT_TABLE[at]
    return mix((at.astype(U64) + U64(1)) * GOLDEN)


@dataclass
class Text:
    """Some documents: their bytes in one buffer, and where each begins (with one more bound at the end)."""

    rows: pa.RecordBatch
    bytes: np.ndarray
    bounds: np.ndarray


def chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[Text]:
    """The batch in slices of about limit bytes of text, a longer document alone. Null texts are empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(col):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        part = pa.concat_arrays([pc.fill_null(col.slice(at, to - at), "")])
        off = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        data = part.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        yield Text(batch.slice(at, to - at), raw, off - off[0])
        at = to


@dataclass
class Words:
    """start, end: byte places; hash: of the lower-cased word; first: number of the first word of each document, with one more bound."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(text: Text) -> Words:
    """The words of a text of any length: beyond SPAN bytes it is gone through in pieces that end where a word does, so that only the words are
    held, not some arrays for each byte."""
    n, cuts = len(text.bytes), [0]
    while n - cuts[-1] > 2 * SPAN:
        at = cuts[-1] + SPAN
        while at < n and not len(gap := np.flatnonzero(LOWERED[text.bytes[at : at + 4096]] == 0)):
            at += 4096
        if at >= n:
            break
        cuts.append(at + int(gap[0]))
    if len(cuts) == 1:
        return _words(text)
    parts = []
    for i, j in zip(cuts, [*cuts[1:], n]):
        w = _words(Text(text.rows, text.bytes[i:j], np.clip(text.bounds, i, j) - i))
        parts.append((w.start + i, w.end + i, w.hash))
    start, end, h = (np.concatenate(x) for x in zip(*parts))
    return Words(start, end, h, np.searchsorted(start, text.bounds))


def _words(text: Text) -> Words:
    raw, bounds = text.bytes, text.bounds
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, U64), np.zeros(len(bounds), np.int64))
    code = LOWERED[raw]
    inside = code != 0
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True  # a document's first byte, and the end
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return Words(start, end, np.zeros(0, U64), np.zeros(len(bounds), np.int64))
    length = end - start
    packed = code[inside]
    cum = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(len(packed)) - np.repeat(cum, length)
    h = np.add.reduceat(byte_values(packed, place), cum)
    return Words(start, end, mix(h + length.astype(U64)), np.searchsorted(start, bounds))


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values between successive bounds; empty segments give 0."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def sequence_digests(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each document's word sequence, equal for equal sequences: sums of two mixed numbers for each word at its place."""
    counts = w.counts()
    if not len(w.hash):
        zero = np.zeros(len(counts), U64)
        return zero, zero.copy()
    place = (np.arange(len(w.hash)) - np.repeat(w.first[:-1], counts)).astype(U64) + U64(1)
    a = segment_sums(mix(w.hash + place * GOLDEN), w.first)
    b = segment_sums(mix((w.hash ^ STEP) * GOLDEN + place * STEP), w.first)
    return mix(a + counts.astype(U64)), mix(b ^ counts.astype(U64))


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of k words; a document of fewer words, but not none, has one of all its words."""
    counts = w.counts()
    n = len(w.hash)
    doc = np.repeat(np.arange(len(counts)), counts)
    left = np.repeat(w.first[1:], counts) - np.arange(n)  # words from here to the document's end
    at = np.flatnonzero((left >= k) | ((counts[doc] < k) & (left == counts[doc])))
    h = np.zeros(len(at), U64)
    padded = np.concatenate((w.hash, np.zeros(k, U64)))
    for i in range(k):
        h = h * STEP + np.where(left[at] > i, padded[at + i], U64(0))
    return doc[at], mix(h)
