"""Repeated byte strings of a shard: Burrows-Wheeler transforms of its blocks, merged by iterative interleave refinement.

Symbols are phrases: bytes up to and including a phrase end, so that an iteration settles several bytes at once. A phrase
end depends on one byte only, hence equal strings have equal phrases inside. Blocks of bounded size are sorted each on its
own; then transforms are merged two by two, and no suffix is sorted again. The iteration in which two neighbours of the
merged order part gives their common prefix. A string that begins inside a phrase is a suffix of the transform's symbol
(the phrase before) and an interval of rows with a common prefix: one backward step from it.
"""

from __future__ import annotations

import numpy as np

from momentlens.llm.text import prefix_sums, span_hashes

#: Bytes of a block, which is sorted in one piece.
BLOCK_BYTES = 4 << 20

# Bytes that end a phrase. All ASCII but letters and digits, few of those, and a quarter of the rest.
_ENDS = np.ones(256, bool)
_ENDS[0x30:0x3A] = _ENDS[0x41:0x5B] = _ENDS[0x61:0x7B] = False
_ENDS[[ord(c) for c in "05qzQZ"]] = True
_ENDS[0x80:] = np.arange(0x80, 0x100) % 4 == 0


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


def _block_order(symbols: np.ndarray, follows: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of one block, ordered by their first ``depth`` symbols and whether they go on (its Burrows-Wheeler order)."""
    ranks, step, k = symbols, follows, 1
    while k <= depth:
        ranks = _pairs(ranks, np.where(step >= 0, ranks[step] + 1, 0))
        step = np.where(step >= 0, step[step], -1)
        k *= 2
    return np.argsort(ranks, kind="stable")


def _run_starts(key: np.ndarray) -> np.ndarray:
    """For sorted keys, the first position of each key."""
    at = np.arange(len(key))
    at[1:][key[1:] == key[:-1]] = 0
    return np.maximum.accumulate(at)


def _ranks(keys: list[np.ndarray]) -> list[np.ndarray]:
    """For two sorted lists of keys, how many keys of both are less than each."""
    return [_run_starts(x) + np.searchsorted(y, x, "left") for x, y in (keys, keys[::-1])]


def _members(classes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The rows of the wanted classes, for sorted classes."""
    a, b = np.searchsorted(classes, wanted, "left"), np.searchsorted(classes, wanted, "right")
    n = b - a
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)


def merge_orders(symbols: np.ndarray, follows: np.ndarray, blocks: tuple[np.ndarray, np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the merged order of all suffixes from two block orders, and for each suffix of it, how many symbols
    (at most ``depth``; at a text's end perhaps one fewer) it surely shares with the one before.

    After k iterations suffixes are interleaved by their first k symbols: a suffix's class is the number of suffixes
    whose first k symbols are less, so a class that appears in iteration k begins a row that shares k - 1 symbols with
    the row before. An iteration takes the class of each suffix's successor within its own class; both blocks are in
    order already, so the interleave is two binary searches. Only classes with a suffix whose successor has just got
    another class can split, so an iteration looks at no other suffix.
    """
    row = np.empty(len(symbols), np.int64)
    for x in blocks:
        row[x] = np.arange(len(x))
    nxt = [np.where(follows[x] >= 0, row[follows[x]], -1) for x in blocks]
    before = [np.full(len(x), -1, np.int64) for x in blocks]
    for p, n in zip(before, nxt, strict=True):
        p[n[n >= 0]] = np.flatnonzero(n >= 0)
    cls = _ranks([symbols[x] * 2 + (n >= 0) for x, n in zip(blocks, nxt, strict=True)])
    total = sum(map(len, blocks))
    common = np.full(total, depth, np.int64)
    for c in cls:
        common[c] = 0
    changed, wide = [np.arange(len(x)) for x in blocks], total + 2
    for k in range(1, depth):
        hit = [p[c] for p, c in zip(before, changed, strict=True)]
        wanted = np.unique(np.concatenate([c[h[h >= 0]] for c, h in zip(cls, hit, strict=True)]))
        if not len(wanted):
            break
        live = [_members(c, wanted) for c in cls]
        old = [c[x] for c, x in zip(cls, live, strict=True)]
        key = [o * wide + np.where(n[x] >= 0, c[n[x]] + 1, 0) for o, n, c, x in zip(old, nxt, cls, live, strict=True)]
        step = [a - b for a, b in zip(_ranks(key), _ranks(old), strict=True)]
        changed = [x[s > 0] for x, s in zip(live, step, strict=True)]
        for c, x, o, s in zip(cls, live, old, step, strict=True):
            c[x] = o + s
            fresh = c[x[s > 0]]
            fresh = fresh[common[fresh] == depth]
            common[fresh] = k
    out = np.empty(total, np.int64)
    out[np.arange(len(blocks[0])) + np.searchsorted(cls[1], cls[0], "left")] = blocks[0]
    out[np.arange(len(blocks[1])) + np.searchsorted(cls[0], cls[1], "right")] = blocks[1]
    return out, common


def merged(symbols: np.ndarray, follows: np.ndarray, blocks: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All blocks' orders merged two by two, and the symbols that neighbours of the last merge share."""
    none = np.zeros(0, np.int64)
    if len(blocks) == 1:
        return merge_orders(symbols, follows, (blocks[0], none), depth)
    while True:
        pairs = [(blocks[i], blocks[i + 1] if i + 1 < len(blocks) else none) for i in range(0, len(blocks), 2)]
        if len(pairs) == 1:
            return merge_orders(symbols, follows, pairs[0], depth)
        blocks = [merge_orders(symbols, follows, p, depth)[0] if len(p[1]) else p[0] for p in pairs]


def common_prefixes(buf: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal bytes at a and b, at most ``most``."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    at8 = np.ndarray((len(buf) + 1,), ">u8", padded.data, 0, (1,))
    out = np.zeros(len(a), np.int64)
    rest = np.arange(len(a))
    while len(rest):
        i, j = a[rest] + out[rest], b[rest] + out[rest]
        x = (at8[i] ^ at8[j]).astype(np.uint64)
        same = np.full(len(rest), 8, np.int64)
        differ = np.flatnonzero(x)
        if len(differ):  # leading equal bytes
            same[differ] = np.argmax(x[differ].astype(">u8").view(np.uint8).reshape(-1, 8) != 0, axis=1)
        out[rest] += same
        rest = rest[(same == 8) & (out[rest] < most[rest])]
    return np.minimum(out, most)


def _named(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(symbol of each phrase, the distinct phrases in order of their bytes). Equality is that of the bytes."""
    raw = buf.tobytes()
    _, where, of = np.unique(span_hashes(prefix_sums(buf), starts, ends), return_index=True, return_inverse=True)
    size = ends - starts
    lead = where[of]
    if (size == size[lead]).all() and (common_prefixes(buf, starts, starts[lead], size) == size).all():
        names = [raw[starts[i] : ends[i]] for i in where.tolist()]
    else:  # two phrases of one hash
        number: dict[bytes, int] = {}
        of = np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))
        names = list(number)
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), np.int64)
    rank[np.array(order, np.int64)] = np.arange(len(names))
    return rank[of], [names[i] for i in order]


def _from_the_end(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(place of each phrase among all in order of their bytes from the last, common bytes with the one before)."""
    turned = [x[::-1] for x in names]
    order = np.array(sorted(range(len(turned)), key=turned.__getitem__), np.int64)
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    buf = np.frombuffer(b"".join(turned), np.uint8)
    size = np.fromiter(map(len, turned), np.int64, len(turned))
    at = np.cumsum(size) - size
    common = np.zeros(len(names), np.int64)
    if len(names) > 1:
        a, b = order[:-1], order[1:]
        common[1:] = common_prefixes(buf, at[a], at[b], np.minimum(size[a], size[b]))
    return place, common


def first_windows(buf: np.ndarray, offsets: np.ndarray, count: np.ndarray, length: int, block_bytes: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """For each sequence's first ``count`` windows of ``length`` bytes: sequence number and whether it is the first copy.

    Sequences come in document order, windows in order of sequence and place.
    """
    size = np.diff(offsets)
    seq = np.repeat(np.arange(len(size)), count)
    at = np.arange(len(seq)) - np.repeat(np.cumsum(count) - count, count) + offsets[:-1][seq]
    if not len(seq):
        return seq, np.zeros(0, bool)
    is_start = np.zeros(len(buf) + 1, bool)
    is_start[1:] = _ENDS[buf]
    is_start[offsets] = True
    starts = np.flatnonzero(is_start[:-1])
    ends = np.append(starts[1:], len(buf))
    of_seq = np.searchsorted(offsets, starts, "right") - 1
    follows = np.arange(1, len(starts) + 1)
    follows[np.append(of_seq[1:] != of_seq[:-1], True)] = -1
    symbols, names = _named(buf, starts, ends)
    # phrases that ``length`` bytes can reach into
    reach = np.searchsorted(starts, np.minimum(starts + length, offsets[1:][of_seq]), "left") - np.arange(len(starts))
    depth = int(reach.max(initial=1))
    # blocks of whole sequences
    cut = np.unique(np.searchsorted(starts, offsets[np.searchsorted(offsets, np.arange(0, len(buf), block_bytes))]))
    cut = np.append(cut[cut < len(starts)], len(starts))
    blocks = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        own = np.where(follows[a:b] >= 0, follows[a:b] - a, -1)
        blocks.append(_block_order(symbols[a:b], own, depth) + a)
    order, shared = merged(symbols, follows, blocks, depth)
    # common bytes of neighbours: the shared phrases, then what the next phrases have in common
    left = offsets[1:][of_seq] - starts
    a, b = order[:-1], order[1:]
    known = np.minimum(np.append(starts, len(buf))[np.minimum(a + shared[1:], len(starts))] - starts[a], np.minimum(left[a], left[b]))
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = known + common_prefixes(buf, starts[a] + known, starts[b] + known, np.maximum(0, np.minimum(np.minimum(left[a], left[b]), length) - known))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    # a window is the end of a phrase and what follows it: the d bytes before the next phrase, and that phrase's row
    nxt = np.searchsorted(starts, at, "right")
    inside = nxt < len(starts)
    inside[inside] &= starts[nxt[inside]] < at[inside] + length
    d = np.zeros(len(at), np.int64)
    d[inside] = starts[nxt[inside]] - at[inside]
    turned, turned_lcp = _from_the_end(names)
    leader = np.arange(len(at))
    by_d = np.argsort(d.astype(np.int16), kind="stable")
    cut = np.searchsorted(d[by_d], np.arange(1, length + 1))
    for k in range(1, length):
        mine = by_d[cut[k - 1] : cut[k]]  # in order of place
        if len(mine) > 1:
            interval, end = np.cumsum(lcp < length - k), np.cumsum(turned_lcp < k)
            row = nxt[mine]
            group = interval[place[row]] * (len(names) + 1) + end[turned[symbols[row - 1]]]
            _, first_at, inverse = np.unique(group, return_index=True, return_inverse=True)
            leader[mine] = mine[first_at[inverse]]
    alone = np.flatnonzero(~inside)  # windows inside one phrase
    if len(alone):
        _, first_at, inverse = np.unique(span_hashes(prefix_sums(buf), at[alone], at[alone] + length), return_index=True, return_inverse=True)
        lead = alone[first_at[inverse]]
        if (common_prefixes(buf, at[alone], at[lead], np.full(len(alone), length)) == length).all():
            leader[alone] = lead
        else:  # two strings of one hash
            raw, seen = buf.tobytes(), {}
            leader[alone] = [seen.setdefault(raw[at[i] : at[i] + length], i) for i in alone.tolist()]
    return seq, leader == np.arange(len(at))
