"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard, by a weighted hash draw at each level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RACKS_PER_REGION, SHARDS_PER_RACK = 2, 4
#: Rows of a shard are ordered inside this many buckets, so that no task sorts a whole shard.
ORDER_BUCKETS = 1024
#: Copies of one row (equal in id and text) are written out in runs of at most this many.
_RUN = 1_000_000

#: regions -> racks -> (shard, weight)
Tree = list[list[list[tuple[int, float]]]]


def tree(weights: Sequence[float], planned: int | None = None) -> Tree:
    """The tree of shards 0, 1, ...: the first ``planned`` (all, if not given) fill racks and regions in order.

    Each later shard opens a region of its own. A key that it takes is taken at the top, so no other key moves.
    """
    planned = len(weights) if planned is None else planned
    regions: Tree = []
    for shard, weight in enumerate(weights):
        leaf = (shard, float(weight))
        if shard >= planned:
            regions.append([[leaf]])
        elif shard % (RACKS_PER_REGION * SHARDS_PER_RACK) == 0:
            regions.append([[leaf]])
        elif shard % SHARDS_PER_RACK == 0:
            regions[-1].append([leaf])
        else:
            regions[-1][-1].append(leaf)
    return regions


def _chosen(key: Column, name: str, weights: Sequence[float]) -> Column:
    """The number of the child with the least exponential draw of its weight; a child's draw is its own, by its name."""
    draws = []
    for i, w in enumerate(weights):
        if w > 0:
            unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{name}/{i}")), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
            draws.append(F.struct((-F.log(unit) / F.lit(w)).alias("draw"), F.lit(i).alias("child")))
    return (F.least(*draws) if len(draws) > 1 else draws[0])["child"]


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _descend(key: Column, name: str, node, depth: int) -> Column:
    """The shard that a key reaches below a node; only the branch chosen is evaluated."""
    total = lambda x: x[1] if isinstance(x, tuple) else sum(map(total, x))
    if isinstance(node, tuple):
        return F.lit(node[0])
    live = [i for i, x in enumerate(node) if total(x) > 0]
    below = {i: _descend(key, f"{name}/{i}", node[i], depth + 1) for i in live}
    if len(live) == 1:
        return below[live[0]]

    def branch(child: Column) -> Column:
        out = F.when(child == live[0], below[live[0]])
        for i in live[1:]:
            out = out.when(child == i, below[i])
        return out

    return _bound(_chosen(key, name, [total(x) for x in node]), branch)


def shard_of(key: Column, weights: Sequence[float], planned: int | None = None) -> Column:
    """The shard reached from the root through a region and a rack.

    A node is drawn in proportion to the sum of the weights below it. A change of weights moves keys only among the
    children of nodes whose shares change: one that leaves a rack's sum as it is moves keys inside that rack only.
    """
    nodes = tree(weights, planned)
    if not sum(w for region in nodes for rack in region for _, w in rack):
        raise ValueError("no shard has a weight above 0")
    return _descend(key, "tree", nodes, 0)


def assign_shards(docs: DataFrame, shards: int = 24, weights: Sequence[float] | None = None, planned: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    The law is ``key``: doc_id and the number of shards decide (rows without doc_id share a shard). The first
    ``planned`` shards (all, if not given) fill the tree; later ones stand beside it. ``grown_shard`` is the shard
    with one more of mean weight: the same, or the new one. Size is the text's bytes plus 8; a null text has no bytes
    and the checksum of an empty text. Slots number a shard's rows without gaps, ordered by bucket, doc_id, size and
    checksum whatever the session's settings; equal rows get slots of their own, as many as there are. They are counted
    before the shuffle, so copies of one row don't meet in one task; a bucket's offset is the sum of the buckets before.
    """
    weights = list(weights or [1.0] * shards)
    rows = docs.select("doc_id", *_sizes(F.col("text")))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    placed = rows.withColumns(_placed(F.col("doc_id"), weights, planned))
    inside = Window.partitionBy("shard", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    first = placed.withColumn("at", F.sum("copies").over(inside) - F.col("copies")).join(_before(placed, F.sum("copies")), ["shard", "bucket"])
    runs = first.withColumn("run", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(_RUN))))
    each = runs.withColumn("copy", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + _RUN, F.col("copies")) - 1)))
    return each.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("at") + F.col("copy")).cast("long").alias("slot"), "grown_shard")


ADDED = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard_documents(docs: DataFrame, shards: int = 24, weights: Sequence[float] | None = None, planned: int | None = None) -> DataFrame:
    """The rows of ``docs`` with their columns and those of ``assign_shards``, by the same rules.

    A column of ``docs`` that has the name of one of ADDED is replaced. Rows are dealt by shard and bucket, as they are
    to be written; of rows equal in id and text the order is that of all their columns.
    """
    weights = list(weights or [1.0] * shards)
    names = [c for c in docs.columns if c not in ADDED]
    inner = [f"c{i}" for i in range(len(names))]
    at = dict(zip(names, inner, strict=True))
    doc_id, text = F.col(at["doc_id"]), F.col(at["text"])
    rows = docs.select(*[F.col(f"`{c}`") for c in names]).toDF(*inner)
    sized = rows.select("*", *_sizes(text))
    placed = sized.withColumns(_placed(doc_id, weights, planned))
    order = Window.partitionBy("shard", "bucket").orderBy(doc_id.asc_nulls_first(), "size", "text_crc32", F.to_json(F.struct(*inner)))
    numbered = placed.withColumn("at", F.row_number().over(order) - 1).join(_before(placed, F.count("*")), ["shard", "bucket"])
    found = numbered.select(*inner, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.col("at")).cast("long").alias("slot"), "grown_shard")
    return found.toDF(*names, *ADDED)


def _sizes(text: Column) -> list[Column]:
    whole = F.coalesce(text, F.lit(""))
    return [(F.octet_length(whole).cast("long") + 8).alias("size"), F.crc32(whole.cast("binary")).cast("long").alias("text_crc32")]


def _placed(doc_id: Column, weights: list[float], planned: int | None) -> dict[str, Column]:
    planned = len(weights) if planned is None else planned
    key = F.coalesce(doc_id.cast("string"), F.lit(""))
    grown = [*weights, sum(weights) / len(weights)]
    bucket = F.pmod(F.xxhash64(key, F.lit("slot"), "text_crc32"), F.lit(ORDER_BUCKETS)).cast("int")
    return {"shard": shard_of(key, weights, planned).cast("int"), "grown_shard": shard_of(key, grown, planned).cast("int"), "bucket": bucket}


def _before(placed: DataFrame, n: Column) -> DataFrame:
    """(shard, bucket, before): the rows of a shard in the buckets before; at most ORDER_BUCKETS rows a shard."""
    counts = placed.groupBy("shard", "bucket").agg(n.alias("n"))
    return counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
