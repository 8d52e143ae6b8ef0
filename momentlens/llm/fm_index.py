"""A compressed FM-index of one shard's word sequences: Burrows-Wheeler transform in a wavelet matrix of packed bits.

Of each row it holds its symbol, in log2(alphabet) bits and a quarter more for the counts, and two bits that mark runs of
rows; numbers are held for runs only. Documents are streamed through it by backward search.
"""

from __future__ import annotations

import numpy as np

_SUPER = 1024


class PackedBits:
    """A bit vector in 64-bit blocks; the ones before each block count from the last of every 1024 blocks (16 bits)."""

    def __init__(self, bits: np.ndarray):
        blocks = len(bits) // 64 + 1
        padded = np.zeros(blocks * 64, np.uint8)
        padded[: len(bits)] = bits
        self.blocks = np.packbits(padded, bitorder="little").view(np.uint64)
        before = np.zeros(blocks, np.int64)
        np.cumsum(np.bitwise_count(self.blocks[:-1]), out=before[1:])
        self.base = before[::_SUPER].copy()
        self.before = (before - np.repeat(self.base, _SUPER)[:blocks]).astype(np.uint16)
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        b = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.base[b // _SUPER] + self.before[b] + np.bitwise_count(self.blocks[b] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.bits = max(1, int(alphabet - 1).bit_length())
        self.levels = []
        rest = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = ((rest >> level) & 1).astype(bool)
            self.levels.append(PackedBits(bit))
            rest = np.concatenate([rest[~bit], rest[bit]])
        self.base = self._descend(np.arange(alphabet), np.zeros(alphabet, np.int64)).astype(np.int32)

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, packed in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            ones = packed.ones(i)
            i = np.where((symbol >> level) & 1, packed.zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._descend(symbol, i) - self.base[symbol]


class Runs:
    """Runs of rows: a bit where each begins, and where it begins by its number."""

    def __init__(self, key: np.ndarray):
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        self.marks = PackedBits(new)
        self.begin = np.append(np.flatnonzero(new), len(key)).astype(np.int32)

    def number(self, row: np.ndarray) -> np.ndarray:
        return self.marks.ones(row + 1) - 1


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (a[i], b[i])."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _shift(r: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(r), np.int64)
    if k < len(r):
        out[: len(r) - k] = r[k:] + 1
    return out


class FMIndex:
    """Backward search over word sequences that are separated by symbol 0.

    Suffixes are sorted by their first ``depth`` symbols, then by position; that is all that searches of at most
    ``depth`` symbols need. ``earliest`` is the first place of each string of ``depth`` symbols.
    """

    def __init__(self, text: np.ndarray, alphabet: int, depth: int):
        self.depth, self.size = depth, len(text)
        ranks, k = text.astype(np.int64), 1
        while 2 * k <= depth - 1:
            ranks = _pairs(ranks, _shift(ranks, k))
            k *= 2
        # runs of depth - 1 and depth symbols from two overlapping shorter ones
        shorter = _pairs(ranks, _shift(ranks, depth - 1 - k)) if depth - 1 > k else ranks
        full = _pairs(shorter if depth - k > k else ranks, _shift(ranks, depth - k))
        rows = np.argsort(full, kind="stable")
        self.first_rows = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])[:-1]
        self.tree = WaveletMatrix(text[rows - 1].astype(np.int64), alphabet)
        #: the rows that share their first depth - 1 symbols, to which a match of full length shrinks
        self.parents = Runs(shorter[rows])
        self.strings = Runs(full[rows])
        self.earliest = rows[self.strings.begin[:-1]].astype(np.int32)

    def matching_statistics(self, sequences: np.ndarray, offsets: np.ndarray):
        """For every position of the sequences: match length (at most depth), and the rows [lo, hi) that match.

        All sequences are searched in step from their last symbol; a symbol of -1 isn't in the index.
        """
        total, size = int(offsets[-1]), np.diff(offsets)
        length, lo_at, hi_at = np.zeros(total, np.int32), np.zeros(total, np.int32), np.zeros(total, np.int32)
        order = np.argsort(-size, kind="stable")
        ends, left = offsets[1:][order], size[order]
        n = self.size
        lo, hi, m = np.zeros(len(order), np.int64), np.full(len(order), n, np.int64), np.zeros(len(order), np.int64)
        for step in range(int(size.max(initial=0))):
            k = int(np.searchsorted(-left, -step, "left"))  # sequences with a symbol left
            at = ends[:k] - 1 - step
            symbol = sequences[at]
            full = np.flatnonzero(m[:k] == self.depth)
            if len(full):
                run = self.parents.number(lo[full])
                lo[full], hi[full] = self.parents.begin[run], self.parents.begin[run + 1]
                m[full] -= 1
            known = np.maximum(symbol, 0)
            new_lo = self.first_rows[known] + self.tree.rank(known, lo[:k])
            new_hi = self.first_rows[known] + self.tree.rank(known, hi[:k])
            gone = (new_lo >= new_hi) | (symbol < 0)
            if gone.any():  # an unseen context: start again from this symbol, or after it if it is unseen itself
                new_lo[gone] = self.first_rows[known[gone]]
                new_hi[gone] = new_lo[gone] + self.tree.rank(known[gone], np.full(int(gone.sum()), n))
                m[:k][gone] = 0
            m[:k] += 1
            lost = symbol < 0
            if lost.any():
                new_lo[lost], new_hi[lost], m[:k][lost] = 0, n, 0
            lo[:k], hi[:k] = new_lo, new_hi
            length[at], lo_at[at], hi_at[at] = m[:k], new_lo, new_hi
        return length, lo_at, hi_at

    def first_places(self, sequences: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For every position of streamed sequences, the earliest indexed place of its ``depth`` symbols, or -1."""
        length, lo, hi = self.matching_statistics(sequences, offsets)
        out = np.full(len(length), -1, np.int64)
        hit = np.flatnonzero((length == self.depth) & (hi > lo))
        out[hit] = self.earliest[self.strings.number(lo[hit].astype(np.int64))]
        return out


class WordIndex:
    """An index over texts of hashed words, which come in document order; ``hashes`` of all, cut at ``offsets``."""

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray, depth: int):
        size = np.diff(offsets)
        self.names, ids = np.unique(hashes, return_inverse=True)
        text = np.zeros(len(hashes) + len(size), np.int64)
        #: where each word of the texts stands in the indexed text, in which a separator follows each text
        self.place = np.arange(len(hashes)) + np.repeat(np.arange(len(size)), size)
        text[self.place] = ids + 1
        self.index = FMIndex(text, len(self.names) + 1, depth)

    def first_places(self, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.names, hashes), max(0, len(self.names) - 1))
        known = self.names[at] == hashes if len(self.names) else np.zeros(len(hashes), bool)
        return self.index.first_places(np.where(known, at + 1, -1), offsets)
