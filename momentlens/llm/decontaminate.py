"""Benchmark decontamination: suffix arrays of the training text, searched with every suffix of the benchmark.

The corpus is cut into shards of whole documents. A shard's suffix array orders all its word positions by the WINDOW words
that begin there; every benchmark suffix is looked up in it by binary search. Words are compared by 64-bit hashes first;
what is found is then compared by its text. A benchmark of one block is sent to the tasks that build the arrays; for a
larger one the arrays are written once and each block searches them, one after the other.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentlens.llm.shared import materialize, pack, unpack_table
from momentlens.llm.text import ALNUM, LOWER, chunks, prefix_sums, span_hashes, utf8, words

WINDOW = 10
#: Text of a shard, and of a block of the benchmark that is sent to every task.
SHARD_BYTES, BLOCK_BYTES = 2 << 20, 4 << 20
_NONE = np.zeros(0, np.int64)
_MATCH = pa.struct([("item_id", pa.string()), ("item_start", pa.int64()), ("doc_start", pa.int64()), ("length", pa.int64())])
_MATCHES = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("item_start", "doc_start", "length")]]))


def _matches(docs: int, ids: pa.Array, doc: np.ndarray, item: np.ndarray, start: np.ndarray, there: np.ndarray, length: np.ndarray) -> pa.Array:
    """The matches of each text, from the windows found in it: windows that follow each other in the text and in their item
    are one longer match."""
    by = np.lexsort((start, there - start, length, item, doc))
    doc, item, start, there, length = doc[by], item[by], start[by], there[by], length[by]
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(length) != 0) | (np.diff(there - start) != 0) | (np.diff(start) != 1)
    begin = np.flatnonzero(new)
    length = length[begin] + np.diff(np.append(begin, len(new))) - 1
    doc, item, start, there = doc[begin], item[begin], start[begin], there[begin]
    found = pa.StructArray.from_arrays([ids.take(pa.array(item)), pa.array(start), pa.array(there), pa.array(length)], fields=list(_MATCH))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(docs + 1)).astype(np.int32)), found)


def renamed(matches: pa.Array) -> pa.Array:
    """The matches of texts by several blocks as those by one: each window is named by the least item of all."""
    docs, lists = len(matches), matches.value_lengths().fill_null(0).to_numpy()
    flat = matches.flatten()
    names, item = np.unique(np.array(flat.field("item_id").to_pylist(), object), return_inverse=True) if len(flat) else (np.zeros(0, object), _NONE)
    start, there, length = (flat.field(c).to_numpy() for c in ("item_start", "doc_start", "length"))
    doc, size = np.repeat(np.arange(docs), lists), np.minimum(length, WINDOW)
    n = length - size + 1  # windows of a match
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    doc, item, start, there, size = np.repeat(doc, n), np.repeat(item, n), np.repeat(start, n) + step, np.repeat(there, n) + step, np.repeat(size, n)
    by = np.lexsort((start, item, size, there, doc))
    doc, item, start, there, size = doc[by], item[by], start[by], there[by], size[by]
    first = np.ones(len(doc), bool)
    first[1:] = (np.diff(doc) != 0) | (np.diff(there) != 0) | (np.diff(size) != 0)
    return _matches(docs, pa.array(names.tolist(), pa.string()), doc[first], item[first], start[first], there[first], size[first])


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ranks of the pairs (a[i], b[i])."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


class Text:
    """The words of some texts: their bytes in lower case, their hashes, and where each text begins and ends."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.low = LOWER[buf]
        self.starts, self.ends, self.at = words(self.low, offsets, ALNUM)
        self.hashes = span_hashes(prefix_sums(self.low), self.starts, self.ends)
        self.count = np.diff(self.at)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.left = self.at[1:][self.doc] - np.arange(len(self.doc))  # words to the end of the text

    def words(self, at: int, n: int) -> list[bytes]:
        return [self.low[a:b].tobytes() for a, b in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist(), strict=True)]

    def suffix_array(self, depth: int = WINDOW) -> np.ndarray:
        """All word positions in the order of the hashes of the ``depth`` words from there to the text's end."""
        ranks, k = np.unique(self.hashes, return_inverse=True)[1] + 1, 1
        while k < depth:
            step = min(k, depth - k)
            after = np.zeros(len(ranks), np.int64)
            inside = np.flatnonzero(self.left > step)
            after[inside] = ranks[inside + step]
            ranks = _ranks(ranks, after) + 1
            k += step
        return np.argsort(ranks, kind="stable")


class TestSuffixes:
    """The suffixes of a block of items, each with the window that it begins with; equal windows are searched once."""

    __test__ = False

    def __init__(self, ids: list[str], texts: pa.Array):
        self.ids = sorted({x or "" for x in ids})
        number = {x: i for i, x in enumerate(self.ids)}
        self.text = Text(*utf8(texts))
        size = np.minimum(self.text.count, WINDOW)[self.text.doc]
        place = np.flatnonzero(self.text.left >= size)
        length = size[place]
        keys = np.zeros((len(place), WINDOW + 1), np.uint64)
        keys[:, WINDOW] = length
        for j in range(WINDOW):
            some = length > j
            keys[some, j] = self.text.hashes[place[some] + j]
        item = np.array([number[x or ""] for x in ids], np.int64)[self.text.doc[place]] if len(place) else _NONE
        start = place - self.text.at[self.text.doc[place]] if len(place) else _NONE
        order = np.lexsort((start, item))  # the first place of a window is in the least item, where it comes first
        where, of = np.unique(keys[order], axis=0, return_index=True, return_inverse=True)[1:] if len(place) else (_NONE, _NONE)
        self.keys, self.length = keys[order][where, :WINDOW], length[order][where]
        self.place, self.item = place[order][where], item[order][where]
        self.start = self.place - self.text.at[self.text.doc[self.place]]
        #: the items of each window
        pairs = np.unique(of.reshape(-1) * max(1, len(self.ids)) + item[order]) if len(place) else _NONE
        window = pairs // max(1, len(self.ids))
        self.item_of, self.items_at = pairs % max(1, len(self.ids)), np.searchsorted(window, np.arange(len(self.place) + 1))

    def _bound(self, text: Text, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, upper: bool) -> np.ndarray:
        """Binary search of all windows at once: the first suffix not below (or, ``upper``, above) each window."""
        lo, hi = lo.copy(), hi.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            at = order[mid]
            below = np.zeros(len(live), bool)
            open_ = np.arange(len(live))
            for j in range(WINDOW):
                want = self.length[live[open_]] > j
                if upper:
                    below[open_[~want]] = True  # the window is a prefix of the suffix
                open_ = open_[want]
                short = text.left[at[open_]] <= j  # the suffix is a prefix of the window
                below[open_[short]] = True
                open_ = open_[~short]
                if not len(open_):
                    break
                mine, theirs = text.hashes[at[open_] + j], self.keys[live[open_], j]
                below[open_[mine < theirs]] = True
                open_ = open_[mine == theirs]
            else:
                if upper:
                    below[open_] = True
            lo[live[below]] = mid[below] + 1
            hi[live[~below]] = mid[~below]
            live = live[lo[live] < hi[live]]
        return lo

    def occurrences(self, text: Text, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, word position) of every occurrence of every window in a shard, by its suffix array."""
        if not len(order) or not len(self.place):
            return _NONE, _NONE
        heads = text.hashes[order]  # sorted: the first words of the suffixes
        lo, hi = np.searchsorted(heads, self.keys[:, 0], "left"), np.searchsorted(heads, self.keys[:, 0], "right")
        lo, hi = self._bound(text, order, lo, hi, False), self._bound(text, order, lo, hi, True)
        n = hi - lo
        window = np.repeat(np.arange(len(n)), n)
        at = order[np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + lo[window]]
        if len(window):  # by the text: each place against the window's own place in the benchmark
            same = np.ones(len(window), bool)
            for j in range(WINDOW):
                some = np.flatnonzero(self.length[window] > j)
                p, q = at[some] + j, self.place[window[some]] + j
                size = text.ends[p] - text.starts[p]
                equal = size == self.text.ends[q] - self.text.starts[q]
                total = int(size[equal].sum())
                step = np.arange(total) - np.repeat(np.cumsum(size[equal]) - size[equal], size[equal])
                a = text.low[np.repeat(text.starts[p[equal]], size[equal]) + step]
                b = self.text.low[np.repeat(self.text.starts[q[equal]], size[equal]) + step]
                wrong = np.unique(np.repeat(np.flatnonzero(equal), size[equal])[a != b])
                equal[wrong] = False
                same[some[~equal]] = False
            window, at = window[same], at[same]
        return window, at

    def search(self, text: Text, order: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(words hit in each text, its longest verbatim matches, its items in order of their ids).

        A match is named by the least item that holds its windows; items that share them are among the items.
        """
        docs = len(text.count)
        window, at = self.occurrences(text, order)
        step = np.zeros(len(text.doc) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + self.length[window], -1)
        hits = np.bincount(text.doc[np.cumsum(step[:-1]) > 0], minlength=docs)
        ids = pa.array(self.ids, pa.string())
        lists = _matches(docs, ids, text.doc[at], self.item[window], self.start[window], at - text.at[text.doc[at]], self.length[window])
        at_doc = lambda x: pa.array(np.searchsorted(x, np.arange(docs + 1)).astype(np.int32))
        # items: of the distinct windows of each text
        width = max(1, len(self.place))
        pair = np.unique(text.doc[at] * width + window)
        n = (self.items_at[1:] - self.items_at[:-1])[pair % width]
        item = self.item_of[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.items_at[pair % width], n)]
        pair = np.unique(np.repeat(pair // width, n) * max(1, len(self.ids)) + item)
        return hits, lists, pa.ListArray.from_arrays(at_doc(pair // max(1, len(self.ids))), ids.take(pa.array(pair % max(1, len(self.ids)))))


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, text) and the number of blocks."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, max(1, -(-total // BLOCK_BYTES))


def _block(items: DataFrame, n: int, i: int):
    """The i-th of n blocks, broadcast: at most BLOCK_BYTES of text or so."""
    rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
    return items.sparkSession.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))


def _found_in(batch, tests: TestSuffixes) -> tuple[list, list, list, list]:
    counts, hits, matches, ids = [], [], [], []
    for _, _, b, o in chunks(*utf8(batch["text"]), SHARD_BYTES):
        text = Text(b, o)
        found = tests.search(text, text.suffix_array())
        counts.append(text.count)
        for into, x in zip((hits, matches, ids), found, strict=True):
            into.append(x)
    return counts, hits, matches, ids


def _searched(docs: DataFrame, block, passed: list[str]) -> DataFrame:
    """``passed`` columns of ``docs`` (which has ``text``) with n_words, n_hit, matches and item_ids, for one block."""
    fields = [docs.schema[c] for c in passed]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("matches", _MATCHES), T.StructField("item_ids", T.ArrayType(T.StringType()))])

    def run(batches):
        tests = TestSuffixes(block.value[0], pa.array(block.value[1], pa.string()))
        for batch in batches:
            if not batch.num_rows:
                continue
            counts, hits, matches, ids = _found_in(batch, tests)
            columns = [pa.array(np.concatenate(counts)), pa.array(np.concatenate(hits)), pa.concat_arrays(matches), pa.concat_arrays(ids)]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in passed], *columns], [*passed, "n_words", "n_hit", "matches", "item_ids"])

    return docs.mapInArrow(run, schema)


def _arrays(rows: DataFrame) -> DataFrame:
    """(data) of (row, text, order): the written suffix arrays of (row, text), a shard a row."""

    def run(batches):
        for batch in batches:
            for i, j, b, o in chunks(*utf8(batch["text"]), SHARD_BYTES):
                order = Text(b, o).suffix_array().astype(np.int64)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([pa.array([pack(row=part["row"], text=part["text"])], pa.binary()), pa.array([pack(order=order)], pa.binary())], ["docs", "arrays"])

    return materialize(rows.select("row", "text").mapInArrow(run, "docs binary, arrays binary"), "suffix-arrays")


def _by_block(arrays: DataFrame, block) -> DataFrame:
    """(row, matches, item_ids) of the texts that hold something of a block, written."""

    def run(batches):
        tests = TestSuffixes(block.value[0], pa.array(block.value[1], pa.string()))
        for batch in batches:
            for docs, data in zip(batch["docs"].to_pylist(), batch["arrays"].to_pylist(), strict=True):
                table = unpack_table(docs)
                text = Text(*utf8(table["text"]))
                hits, matches, ids = tests.search(text, unpack_table(data)["order"].to_numpy())
                some = pa.array(np.flatnonzero(hits))
                yield pa.RecordBatch.from_arrays([table["row"].combine_chunks().take(some), matches.take(some), ids.take(some)], ["row", "matches", "item_ids"])

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("matches", _MATCHES), T.StructField("item_ids", T.ArrayType(T.StringType()))])
    return materialize(arrays.mapInArrow(run, schema), "contaminated")


def _all_blocks(rows: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(row, matches, item_ids) of the texts that hold something of the benchmark: a block at a time over written arrays."""
    arrays, parts = _arrays(rows), []
    for i in range(n):
        block = _block(items, n, i)
        parts.append(_by_block(arrays, block))
        block.unpersist()
    found = reduce(DataFrame.unionByName, parts)
    sets = found.groupBy("row").agg(F.flatten(F.collect_list("matches")).alias("matches"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["row"], renamed(batch["matches"]), batch["item_ids"]], ["row", "matches", "item_ids"])

    return sets.mapInArrow(run, sets.schema)


_SPANS = "array_sort(transform(matches, m -> struct(m.doc_start AS a, m.doc_start + m.length AS b)))"
_HIT = f"aggregate({_SPANS}, struct(0L AS n, 0L AS till), (s, m) -> struct(s.n + greatest(0L, m.b - greatest(m.a, s.till)) AS n, greatest(s.till, m.b) AS till)).n"


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, matches for every row of ``docs``.

    Null and empty texts have no words; repeated rows get a row each. An item with fewer than WINDOW words is one window,
    one without words none; an empty benchmark finds nothing. An item without item_id counts under the empty id; items
    that share an id are one item. ``matches`` holds the longest verbatim matches, each named by the least item that has
    it: the item, its start word, the document's start word and the words that agree. Texts are searched whole.
    """
    items, n = _items(benchmark)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if n == 1:
        found = _searched(rows, _block(items, 1, 0), ["doc_id"])
    else:
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        counted = _searched(rows, _block(items.limit(0), 1, 0), ["row", "doc_id"]).select("row", "doc_id", "n_words")
        found = counted.join(_all_blocks(rows, items, n), "row", "left").withColumns({"matches": F.coalesce("matches", F.array().cast(_MATCHES)), "item_ids": F.coalesce("item_ids", F.array().cast("array<string>"))}).withColumn("n_hit", F.expr(_HIT))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "matches")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with their columns; whatever these are called, none clashes."""
    names = docs.columns
    inner = [f"c{i}" if c != "text" else "text" for i, c in enumerate(names)]
    items, n = _items(benchmark)
    renamed = docs.toDF(*inner)
    if n == 1:
        return _searched(renamed, _block(items, 1, 0), inner).where("n_hit = 0").select(*inner).toDF(*names)
    rows = materialize(renamed.withColumn("row", F.monotonically_increasing_id()), "rows")
    return rows.join(_all_blocks(rows, items, n), "row", "left_anti").select(*inner).toDF(*names)
