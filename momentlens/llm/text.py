"""Vectorised text kernels that run inside Spark tasks on Arrow string columns.

An Arrow string column is one contiguous UTF-8 buffer plus offsets, so words, hashes and windows of a whole batch of
documents are computed with NumPy on that buffer instead of one Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
_MULT = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

#: Byte classes: True where a byte belongs to a word. All separators are ASCII, so bytes of UTF-8 sequences are safe.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunks at all
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def chunks(buf: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of whole documents with at most ``limit`` bytes, or of one longer document."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def by_byte(table: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """table[buf], read only, for a table of 256 values of a byte each; indexing would make a number of eight bytes of each."""
    return np.frombuffer(buf.tobytes().translate(table.tobytes()), table.dtype)


def small_batches(batches, limit: int = 4 << 20):
    """The rows of Arrow batches with a column ``text``, in batches of at most ``limit`` bytes of text (or one row)."""
    for batch in batches:
        buf, offsets = utf8(batch["text"])
        for i, j, *_ in chunks(buf, offsets, limit):
            yield batch.slice(i, j - i)


def words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = NON_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word and the n + 1 word offsets of the documents; no word crosses a document's end."""
    n = len(buf)
    if n == 0:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = by_byte(is_word, buf)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash depend on all bits of its input."""
    half = h >> np.uint64(32)
    h = h ^ half
    for _ in range(2):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= np.right_shift(h, np.uint64(32), out=half)
    return h


#: Powers of the base and of its inverse; a longer table replaces a shorter one and serves it too.
_powers = [np.zeros(0, np.uint64)] * 2


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = CHUNK_BYTES + 1
        while size < n:
            size *= 2
        up, down = np.ones(size, np.uint64), np.ones(size, np.uint64)
        up[1:], down[1:] = np.uint64(_MULT), np.uint64(pow(_MULT, -1, 1 << 64))
        _powers[:] = np.cumprod(up), np.cumprod(down)
    return _powers


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    up, _ = _power_tables(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans from the prefix sums of a polynomial in a fixed odd base."""
    _, down = _power_tables(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_MULT))


_FIRST = np.array([*((1 << 8 * i) - 1 for i in range(8)), _MASK], np.uint64)
_HEAD = 64


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, taken eight bytes at a time, which is less work for short words than ``span_hashes``
    (other values); that adds what stands beyond the first ``_HEAD`` bytes."""
    padded = np.append(buf, np.zeros(8, np.uint8))
    eight = np.ndarray((len(buf) + 1,), np.uint64, padded, 0, (1,))
    left, at = ends - starts, starts
    h = (eight[at] & _FIRST.take(np.minimum(left, 8))) + left.astype(np.uint64) * np.uint64(_MULT)
    rows = np.flatnonzero(left > 8)
    for done in range(8, _HEAD, 8):
        if not len(rows):
            return mix(h)
        left, at = ends[rows] - starts[rows] - done, starts[rows] + done
        h[rows] = mix(h[rows]) * np.uint64(_MULT) + (eight[at] & _FIRST.take(np.minimum(left, 8)))
        rows = rows[left > 8]
    if len(rows):
        h[rows] = mix(h[rows]) * np.uint64(_MULT) + span_hashes(prefix_sums(buf), starts[rows] + _HEAD, ends[rows])
    return mix(h)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive hashes; n - k + 1 values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(_MULT)
        out += hashes[j : j + n]
    return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, x
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


_POS = np.uint64((1 << 20) - 1)
_PIECE = 1 << 19


def anchors(grams: np.ndarray, width: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser segments: (first window, windows, anchor hash) for each run of windows with the same anchor.

    Window i holds the grams i .. i + width - 1; its anchor is the leftmost gram of least hash, so that equal windows have
    equal anchors wherever they stand. ``wanted[i]`` tells which windows exist (those that don't cross a document's end).
    """
    first, count, value = [], [], []
    n = len(grams) - width + 1
    for s in range(0, max(n, 0), _PIECE):
        m = min(_PIECE, n - s)
        part = grams[s : s + m + width - 1]
        least = sliding_min((part & ~_POS) | np.arange(len(part), dtype=np.uint64), width)
        at = (least & _POS).astype(np.int64)
        ok = wanted[s : s + m]
        new = ok.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
        begin = np.flatnonzero(new)
        if not len(begin):
            continue
        # a run ends where the next begins or where windows stop existing
        stop = np.append(begin[1:], m)
        gone = np.flatnonzero(~ok)
        k = np.searchsorted(gone, begin)
        stop = np.minimum(stop, np.append(gone, m)[k])
        first.append(begin + s)
        count.append(stop - begin)
        value.append(part[at[begin]])
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(first), np.concatenate(count), np.concatenate(value)


def existing_windows(offsets: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of the windows of ``length`` elements that start at 0 .. n - length lie in one document."""
    m = max(0, n - length + 1)
    out = np.zeros(m + 1, np.int32)
    lo = offsets[:-1]
    hi = np.maximum(lo, offsets[1:] - length + 1)
    np.add.at(out, np.minimum(lo, m), 1)
    np.add.at(out, np.minimum(hi, m), -1)
    return np.cumsum(out[:-1]) > 0
