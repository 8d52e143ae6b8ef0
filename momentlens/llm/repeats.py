"""Removal of passages that occur earlier in the corpus, by words (FM-index) or by bytes (merged transforms).

Both operators share one dataflow in which no task sees more than a shard, and no key more than a row a bucket:

1. documents are dealt into buckets by id; each is cut into runs of windows that share an anchor (the least hashed gram
   of the window). A bucket asks the anchors' shards, once for each, which occur twice or more: windows of the others
   can't repeat. Runs of an anchor that occurs very often are cut again by a second anchor (a longer gram), so that what
   surrounds a frequent passage goes to many shards;
2. a bucket sends the text of the remaining runs to the anchor's shard, each distinct text once, with its first place in
   the bucket; its later places there are covered whole. Equal windows have equal anchors, so they meet in one shard;
3. a shard indexes its distinct runs in order of first occurrence and tells for each window sent whether it is the first;
4. the windows found go back to the documents, which drop the covered words or bytes.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from momentlens.llm import bwt_merge, fm_index
from momentlens.llm.shared import groups_for, identified, pack, pack_numbers, packed_documents, split_by, unpack, unpack_numbers, unpack_table
from momentlens.llm.text import anchors, chunks, existing_windows, gram_hashes, mix, prefix_sums, span_hashes, utf8, words

@dataclass(frozen=True)
class Unit:
    """What a window is made of: ``window`` words or bytes, with anchors of ``gram`` of them."""

    words: bool
    window: int
    gram: int
    second: bool = False

    def again(self) -> Unit:
        """The same windows with anchors of longer grams, by which runs of a frequent anchor are cut."""
        return Unit(self.words, self.window, self.window * 4 // 5, True)

    def runs(self, buf: np.ndarray, offsets: np.ndarray):
        """(document, first window, windows, anchor hash) of a chunk's runs."""
        if self.words:
            starts, ends, at = words(buf, offsets)
            grams = gram_hashes(span_hashes(prefix_sums(buf), starts, ends), self.gram)
        else:
            at = offsets
            i = np.arange(max(0, len(buf) - self.gram + 1))
            grams = span_hashes(prefix_sums(buf), i, i + self.gram)
        if self.second:  # another order of the grams
            grams = mix(grams ^ np.uint64(0xA0761D6478BD642F))
        n = int(at[-1])
        first, count, value = anchors(grams, self.window - self.gram + 1, existing_windows(at, n, self.window))
        doc = np.searchsorted(at, first, "right") - 1
        return doc, first - at[doc], count, value


WORDS = Unit(True, 20, 8)
BYTES = Unit(False, 100, 32)
#: An anchor that occurs more often than this is frequent (of a bucket's occurrences at most 255 count).
FREQUENT = 2048


class _Bucket:
    """The documents of a bucket, found by (did, rank)."""

    def __init__(self, table: pa.Table):
        tables = [unpack_table(x) for x in table["data"].to_pylist()]
        self.table = pa.concat_tables(tables)
        self.did, self.rank = self.table["did"].to_numpy(), self.table["rank"].to_numpy()
        self.buf, self.offsets = utf8(self.table["text"])
        self.order = np.lexsort((self.rank, self.did))
        self.keys = self._key(self.did, self.rank)[self.order]

    @staticmethod
    def _key(did: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.empty((len(did), 2), ">u8")
        out[:, 0] = did.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
        out[:, 1] = rank.astype(np.uint64) + np.uint64(1)
        return out.view("S16").reshape(-1)

    def find(self, did: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """A row of each document asked for (the first of rows equal in id and text)."""
        return self.order[np.searchsorted(self.keys, self._key(did, rank), "left")]

    def same(self) -> np.ndarray:
        """For each row, the row that ``find`` returns for it."""
        return self.find(self.did, self.rank)


    def runs(self, unit: Unit) -> tuple[np.ndarray, ...]:
        """(row, first window, windows, anchor hash) of all runs, of one row of those equal in id and text."""
        lead = self.same()
        found = []
        for first, _, b, o in chunks(self.buf, self.offsets):
            doc, *rest = unit.runs(b, o)
            mine = lead[doc + first] == doc + first
            found.append([doc[mine] + first, *[x[mine] for x in rest]])
        if not found:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _asked(docs: DataFrame, unit: Unit, shards: int) -> DataFrame:
    """(shard, bucket, data): the anchors of a bucket, and how often it has each."""

    def run(table: pa.Table) -> pa.Table:
        keys, n = np.unique(_Bucket(table).runs(unit)[3], return_counts=True)
        groups, rows = [], []
        for g, at in split_by((keys % np.uint64(shards)).astype(np.int32)):
            mine = keys[at]
            groups.append(g)
            rows.append(pack_numbers(np.concatenate([mine[:1], np.diff(mine)]), np.minimum(n[at], 255).astype(np.uint8)))
        return pa.table({"shard": pa.array(groups, pa.int32()), "bucket": pa.array([table["bucket"][0].as_py()] * len(rows), pa.int32()), "data": pa.array(rows, pa.binary())})

    return docs.groupBy("bucket").applyInArrow(run, "shard int, bucket int, data binary")


def _answered(asked: DataFrame, buckets: int, frequent: int) -> DataFrame:
    """(bucket, shard, data): which anchors occur twice or more (1) or are frequent (2), in the order in which each bucket asked."""

    def run(table: pa.Table) -> pa.Table:
        parts = [unpack_numbers(x) for x in table["data"].to_pylist()]
        keys, of = np.unique(np.concatenate([np.cumsum(k, dtype=np.uint64) for k, _ in parts]), return_inverse=True)
        times = np.bincount(of, np.concatenate([n for _, n in parts]), len(keys))
        again = (times > 1).astype(np.uint8) + (times > frequent)
        rows, begin = [], 0
        for k, _ in parts:
            rows.append(pack_numbers(again[of[begin : begin + len(k)]].astype(np.uint8)))  # in the order asked
            begin += len(k)
        return pa.table({"bucket": table["bucket"], "shard": table["shard"], "data": pa.array(rows, pa.binary())})

    return asked.groupBy("shard").applyInArrow(run, "bucket int, shard int, data binary").repartition(buckets, "bucket")


def _cut(bucket: _Bucket, unit: Unit, row: np.ndarray, pos: np.ndarray, count: np.ndarray, value: np.ndarray, shards: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, shard) of the pieces of runs of frequent anchors: a window's shard follows from both of
    its anchors, so equal windows still meet."""
    if not len(row):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.int32)
    at = words(bucket.buf, bucket.offsets)[2] if unit.words else bucket.offsets
    row2, pos2, count2, value2 = bucket.runs(unit.again())
    begin2 = at[row2] + pos2
    order = np.argsort(begin2, kind="stable")
    begin2, end2, value2 = begin2[order], (begin2 + count2)[order], value2[order]
    begin = at[row] + pos
    lo, hi = np.searchsorted(end2, begin, "right"), np.searchsorted(begin2, begin + count, "left")
    n = hi - lo
    run = np.repeat(np.arange(len(row)), n)
    piece = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n) + lo[run]
    a, b = np.maximum(begin[run], begin2[piece]), np.minimum(begin[run] + count[run], end2[piece])
    shard = (mix(value[run] ^ mix(value2[piece])) % np.uint64(shards)).astype(np.int32)
    return row[run], a - at[row[run]], b - a, shard


def _text_rows(docs: DataFrame, answers: DataFrame, unit: Unit, shards: int) -> DataFrame:
    """(key, bucket, texts, places): the runs' text, each distinct one once, and its first place in the bucket, for a
    shard (key >= 0); and for the bucket itself (key < 0) the places that are covered whole."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, texts, places = [], [], []
        if left.num_rows and right.num_rows:
            bucket = _Bucket(left)
            number = left["bucket"][0].as_py()
            row, pos, count, value = bucket.runs(unit)
            # the answers come in the order of the sorted anchors of each shard
            anchors_, of = np.unique(value, return_inverse=True)
            again = np.zeros(len(anchors_), np.uint8)
            answer = dict(zip(right["shard"].to_pylist(), right["data"].to_pylist(), strict=True))
            shard = (anchors_ % np.uint64(shards)).astype(np.int32)
            for g, at in split_by(shard):
                again[at] = unpack_numbers(answer[g])[0]
            verdict, shard = again[of], shard[of]
            some, often = np.flatnonzero(verdict == 1), np.flatnonzero(verdict == 2)
            whole = (row[some], pos[some], count[some].astype(np.int64), shard[some])
            row, pos, count, shard = (np.concatenate(x) for x in zip(whole, _cut(bucket, unit, row[often], pos[often], count[often], value[often], shards), strict=True))
            did, rank = bucket.did[row], bucket.rank[row]
            if unit.words:
                starts, ends, at = words(bucket.buf, bucket.offsets)
                w = at[row] + pos
                a, b = starts[w], ends[w + count + unit.window - 2]
            else:
                a = bucket.offsets[row] + pos
                b = a + count + unit.window - 1
            content = np.unique(span_hashes(prefix_sums(bucket.buf), a, b), return_inverse=True)[1]
            order = np.lexsort((pos, rank, did, content))
            lead = order[np.flatnonzero(np.diff(content[order], prepend=-1))]
            raw = bucket.buf.tobytes()
            # texts of one hash are compared by their bytes; another text of the same hash is sent as well
            first = lead[content]
            odd = [i for i in np.flatnonzero(first != np.arange(len(first))).tolist() if raw[a[i] : b[i]] != raw[a[first[i]] : b[first[i]]]]
            lead = np.concatenate([lead, np.array(odd, np.int64)])
            for g, part in split_by(shard[lead]):
                mine = lead[part]
                keys.append(g)
                texts.append(pack(text=pa.array([raw[i:j] for i, j in zip(a[mine].tolist(), b[mine].tolist(), strict=True)], pa.large_binary()), count=count[mine]))
                places.append(pack(did=did[mine], rank=rank[mine], pos=pos[mine]))
            later = np.setdiff1d(np.arange(len(row)), lead)
            if len(later):
                later = later[np.lexsort((pos[later], rank[later], did[later]))]
                keys.append(-1 - number)
                texts.append(None)
                places.append(pack(d_did=did[later], rank=rank[later], start=pos[later], length=count[later] + unit.window - 1))
            return pa.table({"key": pa.array(keys, pa.int32()), "bucket": pa.array([number] * len(keys), pa.int32()), "texts": pa.array(texts, pa.binary()), "places": pa.array(places, pa.binary())})
        return pa.table({"key": pa.array([], pa.int32()), "bucket": pa.array([], pa.int32()), "texts": pa.array([], pa.binary()), "places": pa.array([], pa.binary())})

    return docs.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, "key int, bucket int, texts binary, places binary")


#: Bytes of text that are streamed through an index at a time.
STREAM_BYTES = 2 << 20


class _WordShard:
    """The index of a shard's texts (in order of first occurrence), through which documents' texts are streamed."""

    def __init__(self, raw: list[bytes], unit: Unit):
        self.unit = unit
        hashes, at = self._hashed(raw)
        self.index = fm_index.WordIndex(hashes, at, unit.window)
        self.begin = at + np.arange(len(at))  # with a separator after each text

    @staticmethod
    def _hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        buf = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        starts, ends, at = words(buf, offsets)
        return span_hashes(prefix_sums(buf), starts, ends), at

    def first(self, texts: list[bytes], numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, is first) of each window of streamed texts, which are those of the given numbers in the index."""
        hashes, cut = self._hashed(texts)
        place = self.index.first_places(hashes, cut)
        seq = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(seq)) - np.repeat(np.cumsum(counts) - counts, counts)
        return seq, place[cut[seq] + within] == self.begin[numbers[seq]] + within


def _streamed(sizes: list[int]):
    """Runs of parts with STREAM_BYTES together or so."""
    run, total = [], 0
    for i, n in enumerate(sizes):
        run.append(i)
        total += n
        if total >= STREAM_BYTES:
            yield run
            run, total = [], 0
    if run:
        yield run


def _first_flags(raw: list[bytes], count: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """(text, is first) of each window of the texts, which come in order of first occurrence."""
    buf = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
    return bwt_merge.first_windows(buf, offsets, count, unit.window)


def _spans(seq: np.ndarray, first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows) of the runs of windows that aren't first, of texts with so many windows."""
    begin = np.cumsum(counts) - counts
    within = np.arange(len(seq)) - begin[seq]
    new = ~first
    new[1:] &= first[:-1] | (seq[1:] != seq[:-1])
    stop = ~first
    stop[:-1] &= first[1:] | (seq[1:] != seq[:-1])
    a, b = np.flatnonzero(new), np.flatnonzero(stop)
    return seq[a], within[a], b - a + 1


def _covered_rows(rows: DataFrame, unit: Unit) -> DataFrame:
    """(bucket, data): document, start and length of passages that occur earlier."""

    def run(table: pa.Table) -> pa.Table:
        schema = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
        if table["key"][0].as_py() < 0:  # a bucket's own
            return pa.Table.from_arrays([table["bucket"], table["places"]], schema=schema)
        parts, counts, places = [], [], []
        for t, p in zip(table["texts"].to_pylist(), table["places"].to_pylist(), strict=True):
            t, p = unpack_table(t), unpack(p)
            parts.append(t["text"].to_pylist())
            counts.append(t["count"].to_numpy())
            places.append((p["did"], p["rank"], p["pos"]))
        number: dict[bytes, int] = {}
        content = np.fromiter((number.setdefault(x, len(number)) for part in parts for x in part), np.int64)
        did, rank, pos = (np.concatenate(x) for x in zip(*places, strict=True))
        count = np.concatenate(counts)
        # the first place of each distinct text, and the texts in the order of these
        order = np.lexsort((pos, rank, did, content))
        lead = order[np.flatnonzero(np.diff(content[order], prepend=-1))]
        by_place = np.lexsort((pos[lead], rank[lead], did[lead]))
        distinct = list(number)
        raw = [distinct[i] for i in by_place.tolist()]
        lead = lead[by_place]
        found = []
        later = np.setdiff1d(np.arange(len(content)), lead)  # texts that stand somewhere earlier
        found.append((later, np.zeros(len(later), np.int64), count[later]))
        if unit.words:
            # the buckets' documents are streamed through the index; a window is first if its earliest place is its own
            shard = _WordShard(raw, unit)
            turn = np.full(len(content), -1)
            turn[lead] = np.arange(len(lead))
            begin = np.cumsum([0, *map(len, parts)])
            for run in _streamed([sum(map(len, x)) for x in parts]):
                mine = np.arange(begin[run[0]], begin[run[-1] + 1])
                mine = mine[turn[mine] >= 0]
                if len(mine):
                    seq, first = shard.first([raw[i] for i in turn[mine].tolist()], turn[mine], count[mine])
                    of, a, length = _spans(seq, first, count[mine])
                    found.append((mine[of], a, length))
        else:
            seq, first = _first_flags(raw, count[lead], unit)
            of, a, length = _spans(seq, first, count[lead])
            found.append((lead[of], a, length))
        own, a, length = (np.concatenate(x) for x in zip(*found, strict=True))
        bucket, data = [], []
        of_bucket = np.repeat(table["bucket"].to_numpy(), [len(x) for x in counts])
        for g, at in split_by(of_bucket[own]):
            i = own[at]
            at, i = (x[np.lexsort((pos[i] + a[at], rank[i], did[i]))] for x in (at, i))
            bucket.append(g)
            data.append(pack(d_did=did[i], rank=rank[i], start=pos[i] + a[at], length=length[at] + unit.window - 1))
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "data": pa.array(data, pa.binary())})

    return rows.groupBy("key").applyInArrow(run, "bucket int, data binary")


def _flags(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of n places are covered by the spans."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, stop, -1)
    return np.cumsum(step[:-1]) > 0


def _finished(docs: DataFrame, covered: DataFrame, unit: Unit, with_text: bool) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.binary())] * with_text)
        if not left.num_rows:
            return schema.empty_table()
        bucket = _Bucket(left)
        at = words(bucket.buf, bucket.offsets)[2] if unit.words else bucket.offsets
        gone = np.zeros(int(at[-1]), bool)
        if right.num_rows:
            parts = [unpack(x) for x in right["data"].to_pylist()]
            did, rank, start, length = (np.concatenate([x[k] for x in parts]) for k in ("d_did", "rank", "start", "length"))
            a = at[bucket.find(did, rank)] + start
            gone = _flags(len(gone), a, a + length)
        raw, out = bucket.buf.tobytes(), []
        total = np.concatenate([[0], np.cumsum(gone)])
        edge = np.concatenate([[0], np.cumsum(np.diff(gone.astype(np.int8), prepend=0) == 1)]) if len(gone) else np.zeros(1, np.int64)
        for row in bucket.same().tolist():
            a, b = int(at[row]), int(at[row + 1])
            text = raw[bucket.offsets[row] : bucket.offsets[row + 1]]
            removed = int(total[b] - total[a])
            if unit.words:
                kept = text.split()
                kept = b" ".join(compress(kept, (~gone[a:b]).tolist()) if removed else kept)
                spans = 0
            else:
                kept = np.frombuffer(text, np.uint8)[~gone[a:b]].tobytes() if removed else text
                # a run that goes on from the document before is counted there
                spans = int(edge[b] - edge[a]) + int(b > a > 0 and gone[a] and gone[a - 1])
            out.append((b - a, removed, spans, hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
        return pa.Table.from_arrays([bucket.table["doc_id"].cast(pa.int64()), *map(pa.array, zip(*out, strict=True), schema.types[1:])], schema=schema)

    columns = "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text binary" * with_text
    return docs.groupBy("bucket").cogroup(covered.groupBy("bucket")).applyInArrow(run, columns)


def remove_repeats(docs: DataFrame, unit: Unit, with_text: bool = True, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept_sha256, kept_text for every row of ``docs``.

    A unit is removed if a window that covers it also starts earlier: in a document of smaller doc_id, or earlier in the
    same one; windows are judged on the input. Null and empty texts have no units. Rows without doc_id come after all
    others; rows that share a doc_id are ordered by text; rows equal in both are one document and don't remove each
    other. ``kept_text`` is the kept words joined by single spaces, or the kept bytes; without ``with_text`` it isn't returned.
    """
    docs, total = identified(docs)
    shards, buckets = groups_for(total), groups_for(total, 4 << 20)
    packed = packed_documents(docs, buckets).repartition(buckets, "bucket")
    answers = _answered(_asked(packed, unit, shards), buckets, frequent)
    covered = _covered_rows(_text_rows(packed, answers, unit, shards), unit)
    return _finished(packed, covered, unit, with_text)
