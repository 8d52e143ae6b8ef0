"""Order statistics by key without sorting or holding a key's values: bins are counted, then finer ones around each rank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentlens.sources.shared import written

#: So many values around a rank are gathered and sorted; more are counted in bins again.
FEW = 4096
BINS = 1024
#: Up to so many ranges that are still counted go to every task; more are joined by a shuffle.
MOST_RANGES = 100_000
_GREATEST = 1.7976931348623157e308


def _bin(x: Column, lo: Column, hi: Column, by_log: bool) -> Column:
    """A number that doesn't fall where x grows: equal bins, or bins in proportion to the distance from ``lo``."""
    if by_log:
        return F.when(x == lo, -5000).otherwise(F.floor(F.log2(x / 2 - lo / 2) * 4)).cast("long")
    return F.least(F.lit(BINS - 1), F.floor((x / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS)).cast("long")


def ranked(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], few: int = FEW) -> DataFrame:
    """(keys, n, names): for each name the value of a rank, from 1, that ``ranks`` computes from the number n of the key's values.

    Nulls and NaN are left out; infinite values count as the greatest or least number. A key without values gives no row.
    A range of values that holds a rank is cut into bins until it holds ``few`` values or equal ones only: equal bins,
    by turns with bins by the logarithm, so a skewed column takes a few rounds too. What a round carries is a row a key and rank.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("_all"))
    held = F.least(F.greatest(F.col(value).cast("double"), F.lit(-_GREATEST)), F.lit(_GREATEST))
    x = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(key.alias("_k"), held.alias("_x"))
    sums = x.groupBy("_k").agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
    each = F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.least(F.col("n"), rank(F.col("n")))).cast("long").alias("rank")) for name, rank in ranks.items()])
    asked = sums.withColumn("_a", F.explode(each)).select("_k", "n", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("rows"), "_a.name", "_a.rank")
    asked = written(asked, "ranks")
    many, turn = (F.col("rows") > few) & (F.col("lo") < F.col("hi")), 0
    while (left := asked.where(many).count()) > 0:
        open_ = asked.where(many)
        ranges = open_.select("_k", "lo", "hi").distinct()
        near = x.join(F.broadcast(ranges) if left <= MOST_RANGES else ranges, "_k").where("_x >= lo AND _x <= hi")
        cells = near.groupBy("_k", "lo", "hi", _bin(F.col("_x"), F.col("lo"), F.col("hi"), turn % 2 == 1).alias("b")).agg(F.count("*").alias("m"), F.min("_x").alias("from"), F.max("_x").alias("till"))
        upto = F.sum("m").over(Window.partitionBy("_k", "lo", "hi").orderBy("b"))
        found = open_.join(cells.withColumn("upto", upto), ["_k", "lo", "hi"]).where("rank - below <= upto AND rank - below > upto - m")
        narrowed = found.select("_k", "n", F.col("from").alias("lo"), F.col("till").alias("hi"), (F.col("below") + F.col("upto") - F.col("m")).alias("below"), F.col("m").alias("rows"), "name", "rank")
        asked, turn = written(asked.where(~many).unionByName(narrowed), "ranks"), turn + 1
    some = asked.where("lo < hi").select("_k", "lo", "hi").distinct()
    lists = x.join(some, "_k").where("_x >= lo AND _x <= hi").groupBy("_k", "lo", "hi").agg(F.sort_array(F.collect_list("_x")).alias("xs"))
    whole = asked.join(lists, ["_k", "lo", "hi"], "left")
    at = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.get("xs", (F.col("rank") - F.col("below") - 1).cast("int")))
    out = whole.withColumn("_v", at).groupBy("_k").agg(F.first("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks])
    return out.select(*[F.col("_k")[k].alias(k) for k in keys], "n", *ranks)


def floor_index(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], few: int = FEW) -> DataFrame:
    """(keys, n, names): sorted[int(n q)] for each q."""
    return ranked(df, keys, value, {name: (lambda n, q=q: F.floor(n * q) + 1) for name, q in qs.items()}, few)


def quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, float], few: int = FEW) -> DataFrame:
    """(keys, names): percentiles by linear interpolation between the two values next to index (n - 1) q."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, q in qs.items():
        ranks[f"_lo_{name}"] = lambda n, q=q: F.floor((n - 1) * q) + 1
        ranks[f"_hi_{name}"] = lambda n, q=q: F.floor((n - 1) * q) + 2
    found = ranked(df, keys, value, ranks, few)
    part = lambda q: (F.col("n") - 1) * q - F.floor((F.col("n") - 1) * q)
    return found.select(*keys, *[(F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * part(q)).alias(name) for name, q in qs.items()])
