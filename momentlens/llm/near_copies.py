"""Near copies: documents whose sets of 5-word runs have a Jaccard similarity of at least 0.8, and one of each group.

SimHash classes come first: fingerprints of the runs, linked by the grid of op 5, each member checked against the least by
the exact sets. At similarity 0.8 two fingerprints differ in 10 of 64 bits or so, which no grid finds, so the rest of the pairs come from
bands of MinHash values (BANDS of ROWS each: a pair of similarity 0.8 shares none with probability 3e-6). A cell whose
nodes are in one group already is done; in the others nodes are tried against a head of the cell first, and then all
pairs of different groups that the sets' parity bitmaps leave possible. Every pair is checked by the exact sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlens.llm.shared import _LAST_ID, materialize
from momentlens.llm.simhash import components, fingerprints_of_hashes, links, one_row_each
from momentlens.llm.text import LOWER, chunks, gram_hashes, mix, prefix_sums, span_hashes, utf8, words

SHINGLE_WORDS, BANDS, ROWS, SEED = 5, 24, 4, 42
#: Similarity as a fraction.
LEAST, OF = 4, 5
#: A node that is tried against many others is dealt out in groups of this many.
_SPLIT = 128
#: 64-bit words of a set's parity bitmap: bit i tells whether the set has an odd number of runs of hash i. The bitmaps of
#: two sets differ in at most as many bits as the sets differ in runs.
PARITY = 16
_U = np.uint64
_XOR, _ODD = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS)).astype(_U) * _U(2) + _U(1)


def shingles(buf: np.ndarray, offsets: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the sorted distinct k-word hashes of each text of a chunk, lower-cased; a text of fewer words has one."""
    low = LOWER[buf]
    starts, ends, at = words(low, offsets)
    hashes = span_hashes(prefix_sums(low), starts, ends)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    grams = gram_hashes(hashes, k)
    whole = doc[: len(grams)] == doc[k - 1 :] if len(grams) else np.zeros(0, bool)
    short = np.flatnonzero((n > 0) & (n < k))
    few = [gram_hashes(hashes[at[d] : at[d + 1]], int(n[d])) for d in short.tolist()]
    value, owner = np.concatenate([grams[whole], *few]), np.concatenate([doc[: len(grams)][whole], short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(n))


def bands(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The BANDS cells of each non-empty set."""
    begin = (np.cumsum(count) - count)[count > 0]
    out = np.empty((len(begin), BANDS), _U)
    if not len(begin):
        return out
    for b in range(BANDS):
        key = np.full(len(begin), b, _U)
        for i in range(b * ROWS, (b + 1) * ROWS):
            key = mix(key + np.minimum.reduceat((value ^ _XOR[i]) * _ODD[i], begin))
        out[:, b] = key
    return out


def parities(value: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The parity bitmap of each set."""
    bit = np.repeat(np.arange(len(count)), count) * (64 * PARITY) + (value % _U(64 * PARITY)).astype(np.int64)
    bit, times = np.unique(bit, return_counts=True)
    bit = bit[times % 2 == 1]
    out = np.zeros(len(count) * PARITY, _U)
    np.bitwise_or.at(out, bit // 64, _U(1) << (bit % 64).astype(_U))
    return out.reshape(len(count), PARITY)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("did"), F.xxhash64("text").alias("th"), "text")


def with_bands(docs: DataFrame) -> DataFrame:
    """(did, th, node, n, fp, parity, cells) of every row: the node is a hash of the set of runs, n the set's size."""

    def run(batches):
        for batch in batches:
            buf, offsets = utf8(batch["text"])
            node, size, fp, parity, cells = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, _U)], [np.zeros((0, PARITY), _U)], [np.zeros((0, BANDS), _U)]
            for _, _, b, o in chunks(buf, offsets):
                value, count = shingles(b, o)
                some, total = count > 0, np.zeros(len(count), _U)
                if some.any():
                    total[some] = np.add.reduceat(mix(value), (np.cumsum(count) - count)[some])
                node.append(mix(total + count.astype(_U)))
                size.append(count)
                fp.append(fingerprints_of_hashes(value, count))
                parity.append(parities(value, count))
                cells.append(bands(value, count))
            size = np.concatenate(size)
            ends = np.concatenate([[0], np.cumsum((size > 0) * BANDS)]).astype(np.int32)
            longs = lambda x: pa.array(np.concatenate(x).reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(ends), longs(cells))
            bitmaps = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * PARITY), longs(parity))
            yield pa.RecordBatch.from_arrays([batch["did"], batch["th"], longs(node), pa.array(size), longs(fp), bitmaps, lists], ["did", "th", "node", "n", "fp", "parity", "cells"])

    return _keyed(docs).mapInArrow(run, "did long, th long, node long, n long, fp long, parity array<long>, cells array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, runs) of the wanted nodes, from the first row of each."""

    def run(batches):
        for batch in batches:
            buf, offsets = utf8(batch["text"])
            node = batch["node"]
            for i, j, b, o in chunks(buf, offsets):
                value, count = shingles(b, o)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([node.slice(i, j - i), lists], ["node", "runs"])

    first = nodes.join(wanted, "node", "left_semi").select("node", F.col("first.did").alias("did"), F.col("first.th").alias("th"))
    rows = _keyed(docs).join(first, ["did", "th"]).select("node", "text")
    return rows.mapInArrow(run, "node long, runs array<long>").dropDuplicates(["node"])


def _similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough."""
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    sets = materialize(_sets(docs, nodes, wanted), "runs")
    many = pairs.groupBy("u").agg(F.ceil(F.count("*") / _SPLIT).alias("parts"))
    dealt = pairs.join(many, "u").select("u", "v", F.pmod("v", "parts").alias("part"))
    left = dealt.select("u", "part").distinct().join(sets.toDF("u", "a"), "u")
    both = dealt.join(sets.toDF("v", "b"), "v").join(left, ["u", "part"])
    common = F.size(F.array_intersect("a", "b"))
    # common / (a + b - common) >= LEAST / OF
    return both.where(common * (OF + LEAST) >= LEAST * (F.size("a") + F.size("b"))).select("u", "v")


def _near(a, b):
    """Whether sets of these sizes can be similar enough."""
    return OF * F.least(a, b) >= LEAST * F.greatest(a, b)


def _may(a: str, b: str, n: str, m: str):
    """Whether parity bitmaps allow it: sets of n and m runs that differ in d have similarity (n + m - d) / (n + m + d)."""
    differ = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(PARITY)), F.lit(0))
    return differ * (OF + LEAST) <= (OF - LEAST) * (F.col(n) + F.col(m))


def _by_simhash(nodes: DataFrame) -> DataFrame:
    """Pairs (u, v): the least node of each class of linked fingerprints with every other node of the class."""
    prints = materialize(nodes.select("fp").distinct(), "fingerprints")
    roots = materialize(components(links(prints)), "roots")
    placed = nodes.join(roots.toDF("fp", "root"), "fp", "left").select("node", "n", F.coalesce("root", "fp").alias("root"))
    heads = materialize(placed.groupBy("root").agg(F.min(F.struct("node", "n")).alias("head"), F.count("*").alias("members")).where("members > 1"), "heads")
    each = placed.join(heads, "root").where((F.col("node") != F.col("head.node")) & _near(F.col("n"), F.col("head.n")))
    return each.select(F.col("head.node").alias("u"), F.col("node").alias("v"))


def _classes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The least (did, th) of each group of similar rows, as ``did`` and ``th``."""
    nodes = materialize(rows.groupBy("node").agg(F.min(F.struct("did", "th")).alias("first"), *[F.first(c).alias(c) for c in ("n", "fp", "parity", "cells")]), "nodes")
    tried = materialize(_by_simhash(nodes), "tried")
    found = materialize(_similar(docs, nodes, tried), "similar")
    cells = nodes.select("node", "n", F.explode("cells").alias("cell"))
    cells = materialize(cells.join(cells.groupBy("cell").agg(F.count("*").alias("members")).where("members > 1"), "cell", "left_semi"), "cells")

    def mixed() -> DataFrame:
        """(cell, node, n, root) of the cells that hold several groups."""
        placed = cells.join(materialize(components(found), "roots"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        many = placed.groupBy("cell").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("cell")
        return materialize(placed.join(many, "cell", "left_semi"), "mixed")

    def add(pairs: DataFrame) -> None:
        nonlocal tried, found
        new = materialize(pairs.distinct().join(tried, ["u", "v"], "left_anti"), "pairs")
        tried, found = tried.union(new), found.union(materialize(_similar(docs, nodes, new), "similar"))

    open_ = mixed()
    heads = open_.groupBy("cell").agg(F.min(F.struct("root", "node", "n")).alias("head"))
    each = open_.join(heads, "cell").where((F.col("root") != F.col("head.root")) & _near(F.col("n"), F.col("head.n")))
    add(each.select(F.col("head.node").alias("u"), F.col("node").alias("v")))
    open_ = mixed().join(nodes.select("node", "parity"), "node").select("cell", "node", "n", "root", "parity")
    other = open_.toDF("cell", "v", "m", "r", "bits")
    rest = open_.join(other, "cell").where((F.col("node") < F.col("v")) & (F.col("root") != F.col("r")) & _near(F.col("n"), F.col("m")) & _may("parity", "bits", "n", "m"))
    add(rest.select(F.col("node").alias("u"), "v"))
    whole = nodes.join(components(found), "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    return whole.select("first.did", "first.th")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, the one of smallest doc_id, with the columns of ``docs``.

    Rows are in one group where a chain of pairs of similarity 0.8 or more connects them; texts of the same runs are
    copies, and so are all texts without words, null ones included (one of them stays). Rows without doc_id come last.
    Equal rows of one id count once; an empty table gives no rows.
    """
    return one_row_each(docs, _classes(docs, materialize(with_bands(docs), "bands")))
