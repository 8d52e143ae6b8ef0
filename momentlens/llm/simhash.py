"""SimHash near-dedup: segment-popcount embedding, grid range join under Manhattan distance, exact check, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentlens.llm.shared import _LAST_ID, materialize
from momentlens.llm.text import LOWER, chunks, utf8

SHINGLE_WORDS, SEED, MAX_BITS = 4, 42, 4
#: Segments of the grid: the 32 two-bit segments are dealt into this many groups of neighbours (more, if rows are very
#: many; every grid finds the same links).
GRID_GROUPS = 6
_LOWER = LOWER.tobytes()
_HALVES = 0x5555555555555555


def fingerprints_of(buf: np.ndarray, offsets: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """The 64-bit SimHash of each text of a chunk; a text without words has fingerprint zero."""
    hashes, count = [], np.zeros(len(offsets) - 1, np.int64)
    raw, digest = buf.tobytes(), xxhash.xxh64_intdigest
    for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        ws = raw[a:b].translate(_LOWER).split()
        if not ws:
            continue
        text = b" ".join(ws)
        if len(ws) <= k:
            mine = [digest(text, SEED)]
        else:
            ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            mine = [digest(text[s:e], SEED) for s, e in zip(starts[: len(ws) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
        hashes.append(np.array(mine, np.uint64))
        count[d] = len(mine)
    return fingerprints_of_hashes(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), count)


def fingerprints_of_hashes(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each set of hashes, of which ``count`` belong to each text; zero for an empty set."""
    out = np.zeros(len(count), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        n = count[some]
        begin = np.cumsum(n) - n
        flat = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
        bits = np.empty((len(some), 64), np.int64)
        for byte in range(8):  # a byte at a time, so that the unpacked bits stay small
            bits[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(np.unpackbits(flat[:, byte : byte + 1], axis=1), begin, axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * bits > n[:, None], axis=1).reshape(-1).view(np.uint64)
    return out


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(did, th, fp) of every row: the id with nulls last, a hash of the text and the fingerprint."""

    def run(batches):
        for batch in batches:
            buf, offsets = utf8(batch["text"])
            found = [fingerprints_of(b, o) for _, _, b, o in chunks(buf, offsets)]
            fp = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch["did"], batch["th"], pa.array(fp.view(np.int64))], ["did", "th", "fp"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST_ID)).alias("did"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, "did long, th long, fp long")


def embed(fp):
    """Bit counts of the 32 two-bit segments in unary (00, 01, 11), so that Manhattan distance is a bit count of xor."""
    half = F.lit(_HALVES)
    a, b = fp.bitwiseAND(half), F.shiftrightunsigned(fp, 1).bitwiseAND(half)
    return a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def grid_masks(groups: int = GRID_GROUPS, distance: int = MAX_BITS) -> list[int]:
    """Masks of the grid's cells: within ``distance`` at least groups - distance groups of segments agree exactly."""
    cut = [round(32 * i / groups) for i in range(groups + 1)]
    parts = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    masks = [sum(parts[i] for i in some) for some in combinations(range(groups), groups - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _links(key: np.ndarray, fp: np.ndarray, most: int = MAX_BITS, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each run of equal keys, all that exact pairs would connect."""
    x = fp.view(np.uint64)
    half = np.uint64(_HALVES)
    a, b = x & half, (x >> np.uint64(1)) & half
    unary = (a | b) | ((a & b) << np.uint64(1))
    cut = np.flatnonzero(np.diff(key)) + 1
    begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
    size = end - begin
    left, right = [], []
    keep = np.repeat((size > 1) & (size <= small), size)
    own, at = key[keep], np.flatnonzero(keep)
    for s in range(1, small):
        same = np.flatnonzero(own[s:] == own[:-s])
        if not len(same):
            break
        i, j = at[same], at[same + s]
        near = np.bitwise_count(unary[i] ^ unary[j]) <= most
        i, j = i[near], j[near]
        near = np.bitwise_count(x[i] ^ x[j]) <= most
        left.append(fp[i[near]])
        right.append(fp[j[near]])
    for s, e in zip(begin[size > small].tolist(), end[size > small].tolist(), strict=True):
        # a large cell: search from each reached fingerprint among those not reached yet
        rest = np.arange(s, e)
        while len(rest):
            todo, rest = [int(rest[0])], rest[1:]
            while todo and len(rest):
                i = todo.pop()
                near = np.bitwise_count(unary[rest] ^ unary[i]) <= most
                near &= np.bitwise_count(x[rest] ^ x[i]) <= most
                if near.any():
                    got = rest[near]
                    left.append(np.full(len(got), fp[i]))
                    right.append(fp[got])
                    todo += got.tolist()
                    rest = rest[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links(nodes: DataFrame) -> DataFrame:
    """(u, v) of distinct fingerprints at most MAX_BITS apart: enough of them to connect every group."""

    def run(batches):
        old_key, old_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            key, fp = (np.concatenate([o, batch[c].to_numpy(zero_copy_only=False)]) for o, c in ((old_key, "key"), (old_fp, "fp")))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last cell may go on in the next batch
            old_key, old_fp = key[last:], fp[last:]
            if last:
                u, v = _links(key[:last], fp[:last])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        if len(old_key) > 1:
            u, v = _links(old_key, old_fp)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    unary = embed(F.col("fp"))
    # a cell fixes two groups of six, three of seven or four of eight: 21, 27 or 32 bits, so that cells stay small
    n = nodes.count()
    groups = GRID_GROUPS + (n > 1 << 27) + (n > 1 << 33)
    cells = [F.xxhash64(unary.bitwiseAND(F.lit(m)), F.lit(i)) for i, m in enumerate(grid_masks(groups))]
    grid = nodes.select("fp", F.explode(F.array(*cells)).alias("key"))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = grid.select("key", "fp").repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of an edge list can reach, by alternating star contraction.

    Each round is a written table; rounds end when one changes nothing, after about the logarithm of the longest path.
    """
    edges = materialize(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.union(least.select("u", F.col("m").alias("v"))).where("u != v")
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def _classes(rows: DataFrame) -> DataFrame:
    """(fp, first) for each distinct fingerprint: the least (did, th) of the rows that links can reach from it."""
    nodes = materialize(rows.groupBy("fp").agg(F.min(F.struct("did", "th")).alias("first")), "fingerprints")
    roots = components(links(nodes.select("fp")))
    # roots are nodes too; fingerprints without links are their own class
    placed = materialize(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "placed")
    # written, so that a large class is a skewed join of two tables, which Spark splits
    least = materialize(placed.groupBy("root").agg(F.min("first").alias("least")), "least")
    return placed.join(least, "root").select("fp", F.col("least").alias("first"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``.

    A null or empty text has fingerprint zero and is linked like any other. component_id is the smallest doc_id of the
    component, null where no row of it has a doc_id. Repeated rows get a row each.
    """
    rows = materialize(with_fingerprints(docs), "simhash")
    both = rows.join(_classes(rows), "fp")
    number = lambda c: F.when(c != _LAST_ID, c)
    return both.select(number(F.col("did")).alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), number(F.col("first.did")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of ``near_duplicates``, the one of smallest doc_id, with the columns of ``docs``."""
    return one_row_each(docs, _classes(materialize(with_fingerprints(docs), "simhash")).select("first.did", "first.th"))


def one_row_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``kept`` names by id (``did``, the last if null) and text (``th``), one row of each.

    Of rows equal in id and text the least by all columns (as text) stays, so that the choice doesn't depend on their
    order. No column's name can clash.
    """
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    at = dict(zip(names, inner, strict=True))
    renamed = docs.toDF(*inner)
    keyed = renamed.withColumns({"did": F.coalesce(F.col(at["doc_id"]).cast("long"), F.lit(_LAST_ID)), "th": F.xxhash64(at["text"])})
    one = keyed.join(kept.distinct(), ["did", "th"], "left_semi")
    order = Window.partitionBy("did", "th").orderBy(F.to_json(F.struct(*[c for c in inner if c != at["text"]])) if len(inner) > 1 else F.lit(1), at["text"])
    return one.withColumn("place", F.row_number().over(order)).where("place = 1").select(*inner).toDF(*names)
