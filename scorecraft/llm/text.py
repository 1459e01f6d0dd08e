"""Whole texts as numpy arrays: one byte buffer, with words, lines and their hashes.

All functions take a slice of a string column as ``(data, bounds)``: its UTF-8 bytes, and
the document boundaries in them.  Nothing loops over bytes, words or lines in Python, and
texts are handled whole.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20

#: White space is U+0020 and U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_STEP = 0x9E3779B97F4A7C15
#: What is kept of a chunk of which so many bytes lie behind its span.
_KEPT = np.array([(1 << 8 * (8 - n)) - 1 for n in range(9)], np.uint64)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``SLICE_BYTES`` of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total + size > SLICE_BYTES and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its ``n + 1`` document boundaries."""
    array = pc.fill_null(array, "").cast(pa.large_string())
    _, offsets, data = array.buffers()
    if not len(array) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    bytes_ = np.frombuffer(data, np.uint8, bounds[-1] - bounds[0], bounds[0])
    return bytes_, bounds - bounds[0]


def document_of(positions: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The document that each byte position lies in."""
    return np.searchsorted(bounds, positions, side="right") - 1


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every ``[^\\x20\\x09-\\x0D]+``."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.ones(len(data), bool)
    before[1:] = ~inside[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = ~inside[1:]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return starts, ends, document_of(starts, bounds)


def lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (without ``\\n``) and document of every line; an empty text has one."""
    breaks = np.flatnonzero(data == 0x0A)
    owner = document_of(breaks, bounds)
    starts = np.concatenate([bounds[:-1], breaks + 1])
    ends = np.concatenate([breaks, bounds[1:]])
    documents = np.arange(len(bounds) - 1)
    order = np.lexsort((starts, np.concatenate([documents, owner])))
    back = np.lexsort((ends, np.concatenate([owner, documents])))
    return starts[order], ends[back], np.concatenate([documents, owner])[order]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """64-bit hashes of any spans of a buffer.

    A span is read as chunks of eight bytes, the last one filled with zeros.  Every chunk is
    mixed with its number in the span, which is no linear function of its bytes, and the
    results are summed; so no pattern of bytes cancels out, and the place of a span in the
    buffer does not matter.
    """

    def __init__(self, data: np.ndarray):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        self.chunks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        if not len(size):
            return np.zeros(0, np.uint64)
        places = mix(np.arange(1, (int(size.max()) >> 3) + 2, dtype=np.uint64) * np.uint64(_STEP))
        total = mix(self.chunks[starts] & _KEPT[np.maximum(8 - size, 0)] ^ places[0])
        long = np.flatnonzero(size > 8)
        if len(long):  # most spans are words, and one chunk
            count = (size[long] - 1) >> 3
            first = np.cumsum(count) - count
            nth = np.arange(first[-1] + count[-1]) - np.repeat(first - 1, count)
            chunk = self.chunks[np.repeat(starts[long], count) + 8 * nth]
            chunk &= _KEPT[np.maximum(8 * (nth + 1) - np.repeat(size[long], count), 0)]
            total[long] += np.add.reduceat(mix(chunk ^ places[nth]), first)
        return mix(total + size.astype(np.uint64))


def shingles(hashes: np.ndarray, documents: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every window of ``k`` words, within documents only."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = hashes[:n]
    for j in range(1, k):
        value = mix(value * np.uint64(0xC2B2AE3D27D4EB4F | 1) + hashes[j : n + j])
    whole = documents[:n] == documents[k - 1 :]
    return value[whole], documents[:n][whole]


def groups(keys: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (document, key), and the positions in it where a new pair begins.

    Equal pairs come in any order.
    """
    order = np.argsort(keys)
    # a stable sort of 16-bit numbers is a radix sort
    few = len(documents) and documents.max() < 1 << 16
    owner = documents.astype(np.uint16) if few else documents
    order = order[np.argsort(owner[order], kind="stable")]
    k, d = keys[order], documents[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    return order, np.flatnonzero(new)


def repeated(keys: np.ndarray, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: found twice or more in its document; equal to an earlier item."""
    order, first = groups(keys, documents)
    counts = np.diff(np.append(first, len(order)))
    often = np.zeros(len(order), bool)
    often[order] = np.repeat(counts > 1, counts)
    later = np.ones(len(order), bool)
    if len(order):
        later[np.minimum.reduceat(order, first)] = False
    return often, later


def per_document(values: np.ndarray, documents: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` (or count of true ones) for each of ``n`` documents."""
    return np.bincount(documents, weights=values, minlength=n)


def byte_sums(flags: np.ndarray) -> np.ndarray:
    """Prefix counts, so that ``sums[end] - sums[start]`` counts the flags in a span."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def byte_class(characters: str) -> np.ndarray:
    """A table of 256 flags, true for the ASCII characters given."""
    out = np.zeros(256, bool)
    out[list(characters.encode("ascii"))] = True
    return out
