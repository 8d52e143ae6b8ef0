"""LM scoring with a probabilistic suffix tree over words: contexts of up to four words on a smoothed unigram root.

The tree is never in one place. A shard holds what follows its contexts (of a very frequent context, a part), and the
documents, dealt into buckets, ask the shards level by level:

1. a bucket asks for the counts of its words, which make the root, and for their numbers;
2. for each context of k words it asks for the pairs (context, next word) that it holds: once each, with their
   training count here and the expected count by the state so far. A context is asked for if it occurs LEAST times or more in
   training and none of its suffixes has a single continuation (then it could not predict anything else);
3. the context's shard adds the counts up, tests whether the context's next words diverge from those of the shorter
   state, and answers counts, verdicts and the pairs' numbers in the order asked, from which the bucket computes the next level.

Words are told apart by 64-bit hashes. The words and pairs of a shard are numbered, and a longer context is known by the
number of the pair that it is, so contexts are never confused, whatever the corpus.

No threshold depends on the corpus, and each pair is sent once a bucket however often it occurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlens.llm.shared import groups_for, pack_numbers, packed_documents, split_by, unpack_numbers, unpack_table
from momentlens.llm.text import LOWER, by_byte, chunks, mix, utf8, word_hashes, words

#: Contexts have up to DEPTH words, and at least LEAST occurrences in training. Those of one word are all kept.
DEPTH, LEAST = 4, 2
#: Nats by which a longer context's next words must diverge from the shorter state's, over all its occurrences, to be kept.
LEAST_DIVERGENCE = 4.0
#: A context of more occurrences than this is kept untested (that is a divergence of 1e-4 nats an occurrence) and its next
#: words are dealt over several shards.
MANY = 32_768
#: Weight of the shorter state, in occurrences: p = (count of the pair + PRIOR * shorter p) / (count of the context + PRIOR).
PRIOR = 32.0
#: Bytes of text tokenised at a time: arrays of a number a byte stay in a core's cache.
_CACHED = 1 << 16
_U = np.uint64
_END = _U(0x5BD1E995A3C59AC3)
#: Numbers of pairs carry their level in so many bits.
_LEVEL_BITS = _U(3)
#: Expected counts are sent as a byte: steps of 1/8 nat from _LEAST_LOG on; _KEEP marks a context that is kept untested.
_STEPS, _LEAST_LOG, _KEEP = 8, 165, 255
_PART = _U(0xD6E8FEB86659FD93)


def _small(x: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned type."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _bits(x: np.ndarray) -> int:
    return int(x.max(initial=0)).bit_length()


def _runs(packed: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows packed over their number in the low ``bits``, sorted in place: the rows in order, where a new value begins, and
    the number of each row's value. Sorting values is several times as fast as sorting the numbers of rows by them."""
    packed.sort()
    order = (packed & _U((1 << bits) - 1)).view(np.int64)
    packed >>= _U(bits)
    new = np.zeros(len(packed), bool)
    np.not_equal(packed[1:], packed[:-1], out=new[1:])
    of = np.empty(len(packed), np.int64)
    of[order] = np.cumsum(new)
    new[:1] = True
    return order, new, of


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and the number of each value. Values are sorted by as many high bits as leave room for the
    number of the row, which is all of them unless two differ in the others only."""
    if len(x):
        bits = (len(x) - 1).bit_length()
        low = _U((1 << bits) - 1)
        narrow = _bits(x) + bits <= 64
        packed = x << _U(bits) if narrow else x & ~low
        packed |= np.arange(len(x), dtype=_U)
        order, new, of = _runs(packed, bits)
        values = x[order[new]]
        if narrow or (values[of] == x).all():
            return values, of
    return np.unique(x, return_inverse=True)


class Tokens:
    """The symbols of a bucket's documents (an end before the first, one after each) and what is known of each place.

    A place is open at a level if its context there occurs LEAST times or more and lies in its document. Places only close,
    as the counts of longer contexts are no greater, so what is known of contexts is kept for the open places alone: ``at``
    in order, ``before`` (occurrences of the context), ``context`` (its number), ``word`` (the number of the word at the
    place) and ``expected`` (a suffix of the context has one continuation, the word here; such a place isn't asked for).
    """

    def __init__(self, table: pa.Table):
        self.docs = pa.concat_tables([unpack_table(x) for x in table["data"].to_pylist()])
        buf, offsets = utf8(self.docs["text"])
        found, count = [], []
        for _, _, b, o in chunks(buf, offsets, _CACHED):
            low = by_byte(LOWER, b)
            starts, ends, at = words(low, o)
            found.append(word_hashes(low, starts, ends))
            count.append(np.diff(at))
        self.count = np.concatenate(count)
        n = self.count + 1
        self.first = 1 + np.cumsum(n) - n
        self.symbols = np.full(1 + int(n.sum()), _END, _U)
        inside = np.ones(len(self.symbols), bool)
        inside[0] = False
        inside[self.first + self.count] = False
        self.symbols[inside] = np.concatenate(found)
        self.train = np.append(False, np.repeat(~self.docs["held_out"].to_numpy(), n))

    def word_keys(self) -> tuple[np.ndarray, np.ndarray]:
        return _distinct(self.symbols)

    def start(self, of_word: np.ndarray, counts: np.ndarray, numbers: np.ndarray, tokens: int, distinct: int) -> None:
        """The root: the word of each place, the words' counts and numbers."""
        self.of_word, self.counts, self.base = of_word, counts, (counts + 1) / (tokens + distinct + 1)
        self.p = self.base.take(of_word)
        # how many symbols before a place belong to its document, the end before it included, up to DEPTH
        self.behind = np.full(len(of_word), DEPTH, np.uint8)
        self.behind[0] = 0
        for k in range(DEPTH - 1, 0, -1):
            self.behind[(self.first + k - 1)[: np.searchsorted(self.first, len(of_word) - k + 1)]] = k
        before, number = _small(counts).take(of_word), _small(numbers).take(of_word)
        self._open(np.arange(1, len(of_word)), before[:-1], number[:-1], number[1:], np.zeros(len(of_word) - 1, bool), before[:-1] >= LEAST)

    def _open(self, at, before, context, word, expected, stay) -> None:
        rows = np.flatnonzero(stay)
        self.at, self.before, self.context, self.word, self.expected = (x.take(rows) for x in (at, before, context, word, expected))

    def ask(self, k: int, shards: int) -> tuple[np.ndarray, ...]:
        """(context, word, pair of each place asked for, shard of each pair) of level k: numbers, in order."""
        self.asked = np.flatnonzero(~self.expected)
        rows = (self.at, self.before, self.context, self.word)
        self.places, self.n, asked, word = rows if len(self.asked) == len(self.at) else (x.take(self.asked) for x in rows)
        context, word, of = _distinct_pairs(asked, word)
        key = context.astype(_U)
        key *= _U(0x9E3779B97F4A7C15)
        many = np.flatnonzero(self.n > MANY)
        if len(many):
            part = np.zeros(len(context), _U)
            np.maximum.at(part, of[many], self.symbols[self.places[many]] % (self.n[many] // MANY + 1).astype(_U))
            key += part * _PART
        key += _U(k)
        key = mix(key)
        # the remainder; a quotient by one divisor is several times as fast
        whole = key // _U(shards)
        whole *= _U(shards)
        key -= whole
        return context, word, of, key.astype(np.int32)

    def hints(self, of: np.ndarray, n: int) -> np.ndarray:
        """Expected counts of the n pairs asked for, as bytes."""
        byte = np.clip(np.rint(_STEPS * np.log(self.n * self.p.take(self.places))) + _LEAST_LOG, 0, _KEEP - 1)
        out = np.zeros(n, np.uint8)
        np.maximum.at(out, of, np.where(self.n > MANY, _KEEP, byte).astype(np.uint8))
        return out

    def learn(self, k: int, counts: np.ndarray, kept: np.ndarray | None, numbers: np.ndarray | None) -> None:
        """Take in the answers for the places asked for (all kept if there are no verdicts) and move on to the next level."""
        at, n, c = (self.places, self.n, counts) if kept is None else (x[kept] for x in (self.places, self.n, counts))
        p = self.p.take(at)
        p *= PRIOR
        p += c
        p /= n + PRIOR
        self.p[at] = p
        if numbers is None:
            return
        # the pair of a longer context: as asked, or known where a suffix has the word here for its one continuation; such
        # a pair occurs wherever its context does, so it keeps the context's number
        final = (counts == self.n) & (self.n <= MANY)
        if len(self.places) == len(self.at):
            longer, pair, expected = counts, numbers, final
        else:
            longer, pair, expected = self.before.astype(np.int64), self.context.astype(_U), self.expected.copy()
            longer[self.asked], pair[self.asked], expected[self.asked] = counts, numbers, final
        stay = (np.diff(self.at) == 1) & (longer[:-1] >= LEAST) & (self.behind.take(self.at[1:]) > k)
        self._open(self.at[1:], longer[:-1], pair[:-1], self.word[1:], expected[1:], stay)


def _distinct_pairs(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of two columns, sorted, and the pair of each row; packed into one number with the row's where that
    has the bits, after the columns' values are numbered if need be."""
    if not len(one):
        return one, two, np.zeros(0, np.int64)
    bits, a, b = (len(one) - 1).bit_length(), one, two
    if _bits(a) + _bits(b) + bits > 64:
        a = _distinct(a)[1].astype(_U)
    if _bits(a) + _bits(b) + bits > 64:
        b = _distinct(b)[1].astype(_U)
    if (width := _bits(b)) + _bits(a) + bits <= 64:
        packed = a.astype(_U) << _U(width)
        packed |= b
        packed <<= _U(bits)
        packed |= np.arange(len(a), dtype=_U)
        order, new, of = _runs(packed, bits)
        first = order[new]
        return one.take(first), two.take(first), of
    order = np.lexsort((two, one))
    a, b = one[order], two[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return a[new], b[new], of


def _steps(sorted_: np.ndarray) -> np.ndarray:
    """Sorted numbers as differences, in the narrowest type."""
    return _small(np.concatenate([sorted_[:1], np.diff(sorted_)]))


def _sums(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(steps, dtype=_U)


def _requests(shard: np.ndarray, encode, every: int = 0) -> tuple[list[int], list[bytes]]:
    """A row for each shard: what ``encode`` makes of the rows that go there; with ``every``, for each of so many, if only of none."""
    groups, rows = [], []
    for g, at in split_by(shard):
        groups.append(g)
        rows.append(pack_numbers(*encode(at)))
    if len(groups) < every:
        none = pack_numbers(*encode(np.zeros(0, np.int64)))
        left = sorted(set(range(every)) - set(groups))
        groups, rows = groups + left, rows + [none] * len(left)
    return groups, rows


def _answers(table: pa.Table) -> dict[int, dict[int, list[np.ndarray]]]:
    """level -> shard -> counts, numbers (but of the last level) and, from level 2 on, verdicts; of the words, the shard's totals."""
    out: dict[int, dict[int, list[np.ndarray]]] = {}
    for level, shard, data in zip(*(table[c].to_pylist() for c in ("level", "shard", "data")), strict=True):
        out.setdefault(level, {})[shard] = unpack_numbers(data)
    return out


def _aligned(parts: dict[int, list[np.ndarray]], shard: np.ndarray, shards: int, level: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Counts, verdicts (from level 2 on) and numbers (but of the last level) for the rows asked for.

    Numbers are those of all shards and levels: the place in the shard, the shard, the level. They tell words apart, and
    pairs of LEAST occurrences or more.
    """
    counts = np.zeros(len(shard), np.int64)
    kept = np.zeros(len(shard), bool) if level > 1 else None
    numbers = np.zeros(len(shard), _U) if level < DEPTH else None
    for g, at in split_by(shard):
        counts[at] = parts[g][0]
        if numbers is not None:
            numbers[at] = _sums(parts[g][1]) * _U(shards) + _U(g)
        if kept is not None:
            kept[at] = parts[g][-1]
    if level and numbers is not None:
        numbers <<= _LEVEL_BITS
        numbers |= _U(level)
    return counts, kept, numbers


def _replayed(left: pa.Table, right: pa.Table, level: int, shards: int):
    """The bucket's tokens after all levels before ``level`` are answered, and (if any) the contexts, words, training counts,
    expected counts and shards that it asks for at this level."""
    tokens, answers = Tokens(left), _answers(right)
    words_, of_word = tokens.word_keys()
    counts, _, numbers = _aligned(answers[0], (words_ % _U(shards)).astype(np.int32), shards, 0)
    tokens.totals = tuple(sum(int(x[-1][i]) for x in answers[0].values()) for i in (0, 1))
    tokens.start(of_word, counts, numbers, *tokens.totals)
    for k in range(1, min(level, DEPTH) + 1):
        context, word, of, shard = tokens.ask(k, shards)
        if k == level:
            n = np.bincount(of[tokens.train[tokens.places]], minlength=len(context))
            return tokens, context, word, _small(n), tokens.hints(of, len(context)), shard
        counts, kept, numbers = _aligned(answers.get(k, {}), shard, shards, k)
        # contexts of one word are all kept
        tokens.learn(k, counts.take(of), None if kept is None else kept.take(of), None if numbers is None else numbers.take(of))
    return tokens


_ASKED = "shard int, bucket int, level int, data binary"


def _rows(bucket: int, found: list[tuple[int, list[int], list[bytes]]]) -> pa.Table:
    """Requests of (level, shards, data) as a table of _ASKED."""
    shard, level, data = ([x for _, groups, _ in found for x in groups], [n for n, groups, _ in found for _ in groups], [x for _, _, rows in found for x in rows])
    return pa.table({"shard": pa.array(shard, pa.int32()), "bucket": pa.array([bucket] * len(shard), pa.int32()), "level": pa.array(level, pa.int32()), "data": pa.array(data, pa.binary())})


def _asked_words(docs: DataFrame, shards: int) -> DataFrame:
    """The words that each bucket asks each shard for, with their training counts; every shard is asked, for its totals."""

    def run(table: pa.Table) -> pa.Table:
        tokens = Tokens(table)
        words_, of_word = tokens.word_keys()
        n = _small(np.bincount(of_word[tokens.train], minlength=len(words_)))
        return _rows(table["bucket"][0].as_py(), [(0, *_requests((words_ % _U(shards)).astype(np.int32), lambda at: (_steps(words_[at]), n[at]), shards))])

    return docs.groupBy("bucket").applyInArrow(run, _ASKED)


def _asked(docs: DataFrame, answers: DataFrame, level: int, shards: int) -> DataFrame:
    """The pairs of a level that each bucket asks each shard for, with the expected counts from level 2 on."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _rows(0, [])
        _, context, word, n, hints, shard = _replayed(left, right, level, shards)
        return _rows(left["bucket"][0].as_py(), [(level, *_requests(shard, lambda at: (_steps(context[at]), _small(word[at]), n[at], *([hints[at]] if level > 1 else []))))])

    return docs.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, _ASKED)


def verdicts(contexts: np.ndarray, counts: np.ndarray, hints: np.ndarray) -> np.ndarray:
    """For sorted distinct pairs, whether their context is kept."""
    if not len(contexts):
        return np.zeros(0, bool)
    begin = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1]))
    seen = counts > 0
    gain = np.zeros(len(contexts))
    gain[seen] = counts[seen] * (np.log(counts[seen]) - (hints[seen].astype(np.float64) - _LEAST_LOG) / _STEPS)
    kept = (np.maximum.reduceat(hints, begin) == _KEEP) | (np.add.reduceat(gain, begin) >= LEAST_DIVERGENCE)
    return np.repeat(kept, np.diff(np.append(begin, len(contexts))))


def _gathered(level: int, parts: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context of each distinct row, the distinct row of each row asked for, how many each request asks for)."""
    if level == 0:
        asked = [_sums(p[0]) for p in parts]
        found, of = _distinct(np.concatenate(asked))
        return found, of, np.array([len(x) for x in asked])
    context, _, of = _distinct_pairs(np.concatenate([_sums(p[0]) for p in parts]), np.concatenate([p[1].astype(_U) for p in parts]))
    return context, of, np.array([len(p[1]) for p in parts])


def _answered(asked: DataFrame, buckets: int) -> DataFrame:
    """(bucket, level, shard, data): training counts, numbers and verdicts, in the order in which each bucket asked; of
    words, the shard's training tokens and distinct ones too, so that a bucket has the sums of all shards."""

    def run(table: pa.Table) -> pa.Table:
        levels, out = table["level"].to_numpy(), [b""] * table.num_rows
        for level in np.unique(levels).tolist():
            rows = np.flatnonzero(levels == level).tolist()
            parts = [unpack_numbers(table["data"][i].as_py()) for i in rows]
            n_at = 2 if level else 1
            contexts, of, asked_for = _gathered(level, parts)
            counts = np.bincount(of, np.concatenate([p[n_at] for p in parts]), len(contexts)).astype(np.int64)
            kept = None
            if level > 1:
                hints = np.zeros(len(contexts), np.uint8)
                np.maximum.at(hints, of, np.concatenate([p[3] for p in parts]))
                kept = verdicts(contexts, counts, hints).astype(np.uint8)
            totals = np.array([counts.sum(), np.count_nonzero(counts)], _U)  # tokens and distinct words of the shard
            begin = 0
            for i, n in zip(rows, asked_for.tolist(), strict=True):
                mine = of[begin : begin + n]
                begin += n
                # a pair that can't be a context gets no number of its own
                own = mine if level == 0 else np.maximum.accumulate(np.where(counts[mine] >= LEAST, mine, 0)) if n else mine
                numbers = [_steps(own.astype(_U))] if level < DEPTH else []
                out[i] = pack_numbers(_small(counts[mine]), *numbers, *([kept[mine]] if kept is not None else []), *([totals] if level == 0 else []))
        return pa.table({"bucket": table["bucket"], "level": table["level"], "shard": table["shard"], "data": pa.array(out, pa.binary())})

    return asked.groupBy("shard").applyInArrow(run, "bucket int, level int, shard int, data binary").repartition(buckets, "bucket")


def score_documents(docs: DataFrame, folds: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    A document is held out if crc32 of its doc_id (as text; empty if null) modulo ``folds`` is ``held_out``; the others
    train. Null and empty texts have the end token only. Repeated rows train as often as they come and get a row each.
    Without training rows all counts are zero and the tree has a root only, whose probabilities are the base's. A token
    is scored by the longest kept context before it in its document; each kept context mixes its counts with the
    probability by the next shorter one, down to the root.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("did"), "doc_id", "text", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == held_out).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = buckets = groups_for(size)
    dealt = packed_documents(rows, buckets, 6).repartition(buckets, "bucket")
    answers = _answered(_asked_words(dealt, shards), buckets)
    for level in range(1, DEPTH + 1):
        answers = answers.unionByName(_answered(_asked(dealt, answers, level, shards), buckets))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        if not left.num_rows:
            return schema.empty_table()
        tokens = _replayed(left, right, DEPTH + 1, shards)
        if len(tokens.p) > 1 and tokens.p[1:].max() > 1:
            raise ValueError("a probability above 1: a context's count is less than that of a pair")
        per_doc = lambda x: np.add.reduceat(x[1:], tokens.first - 1)
        n, of_word = len(tokens.count), tokens.of_word
        known = per_doc((tokens.counts > 0).take(of_word).astype(np.int64))
        return pa.Table.from_arrays([tokens.docs["doc_id"].cast(pa.int64()), tokens.docs["held_out"], pa.array(tokens.count + 1), pa.array(known), pa.array(np.full(n, tokens.totals[0])), pa.array(per_doc(np.log10(tokens.base).take(of_word))), pa.array(per_doc(np.log10(tokens.p)))], schema=schema)

    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
