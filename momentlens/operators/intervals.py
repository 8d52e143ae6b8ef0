"""Joins of timelines by overlapping intervals: equal bins instead of nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pieces of a timeline that make one of the next level.
FAN = 1024


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column, mode: str = "open") -> Column:
    """Whether two intervals overlap: ``open`` (by more than an end), ``touching`` (ends count), or ``words``: a lies inside
    b, reaches into it from either side, or spans it, where an end of a without length counts inside b."""
    if mode == "touching":
        return (a_start <= b_end) & (b_start <= a_end)
    if mode == "words":
        inside = (a_start >= b_start) & (a_end <= b_end)
        into = (a_start < b_start) & (a_end > b_start) & (a_end <= b_end)
        out_of = (a_start >= b_start) & (a_start < b_end) & (a_end > b_end)
        return inside | into | out_of | ((a_start <= b_start) & (a_end >= b_end))
    if mode != "open":
        raise ValueError(f"unknown mode: {mode}")
    return (a_start < b_end) & (a_end > b_start)


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], mode: str = "open", size: float = 60.0, how: str = "inner", names=("start_time", "end_time", "r_start", "r_end")) -> DataFrame:
    """Pairs of overlapping intervals with equal keys. Columns of the two sides but the keys must differ.

    Each interval is entered in the bins it touches, the bins are joined by equality, and a pair is kept in the first
    bin that both share, so it comes once and without a later distinct. Long recordings spread over many bins.
    """
    ls, le, rs, re = names
    binned = lambda df, s, e: df.withColumns({f"_first_{s}": F.floor(F.col(s) / size), "_bin": F.explode(F.sequence(F.floor(F.col(s) / size), F.floor(F.col(e) / size)))})
    a, b = binned(left.where(F.col(le) >= F.col(ls)), ls, le), binned(right.where(F.col(re) >= F.col(rs)), rs, re)
    exact = overlaps(F.col(ls), F.col(le), F.col(rs), F.col(re), mode)
    pairs = a.join(b, [*keys, "_bin"]).where(exact & (F.col("_bin") == F.greatest(f"_first_{ls}", f"_first_{rs}"))).drop("_bin", f"_first_{ls}", f"_first_{rs}")
    if how == "inner":
        return pairs
    return left.join(pairs.select(*[F.col(c) for c in pairs.columns if c not in left.columns or c in (*keys, ls, le)]), [*keys, ls, le], "left")


def point_in_interval_join(points: DataFrame, windows: DataFrame, keys: list[str], time: str = "time", lag: float = 15.0, closed: bool = True, size: float = 60.0, how: str = "inner") -> DataFrame:
    """Points with every window that has start <= t <= end + lag (or t < end + lag); windows need a ``window_id`` of their own.

    With ``how`` left, a window without a point is kept with nulls for the point.
    """
    w = windows.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_time") / size), F.floor((F.col("end_time") + lag) / size))))
    p = points.withColumn("_bin", F.floor(F.col(time) / size))
    till = F.col(time) <= F.col("end_time") + lag if closed else F.col(time) < F.col("end_time") + lag
    pairs = p.join(w, [*keys, "_bin"]).where((F.col(time) >= F.col("start_time")) & till).drop("_bin")
    if how == "inner":
        return pairs
    return windows.join(pairs.drop(*[c for c in windows.columns if c not in (*keys, "window_id")]), [*keys, "window_id"], "left")


def overlap_weighted_avg(left: DataFrame, right: DataFrame, keys: list[str], id_col: str, metrics: list[str], size: float = 60.0) -> DataFrame:
    """(keys, id, matched, metrics): means of the right side weighted by overlap; 0 where only ends touch."""
    pairs = interval_join(left.select(*keys, id_col, "start_time", "end_time"), right, keys, "touching", size)
    w = F.least("end_time", "r_end") - F.greatest("start_time", "r_start")
    weighed = pairs.withColumn("_w", F.greatest(w, F.lit(0.0)))
    return weighed.groupBy(*keys, id_col).agg(F.lit(True).alias("matched"), *[F.coalesce(F.sum(F.col(m) * F.col("_w")) / F.nullif(F.sum("_w"), F.lit(0.0)), F.lit(0.0)).alias(m) for m in metrics])


def _over_empty(ends: DataFrame, keys: list[str], levels: int = 1) -> DataFrame:
    """Adds to bins with their ``_first`` and ``_last`` point the last point of all bins before and the first of all after.

    Bins are looked at in groups of ``FAN``, which are carried over in the same way, as often as there are ``levels``.
    """
    line = Window.partitionBy(*keys, "_group") if levels else Window.partitionBy(*keys)
    # both sides as frames that grow by a row; a frame up to the last row is run through again for each row
    upto = lambda c: line.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    sides = {"_carried": F.max("_last").over(upto(F.col("_bin"))), "_coming": F.min("_first").over(upto(F.col("_bin").desc()))}
    if not levels:
        return ends.withColumns(sides)
    grouped = ends.withColumn("_group", F.floor(F.col("_bin") / FAN))
    groups = grouped.groupBy(*keys, F.col("_group").alias("_bin")).agg(F.max("_last").alias("_last"), F.min("_first").alias("_first"))
    outer = _over_empty(groups, keys, levels - 1).select(*keys, F.col("_bin").alias("_group"), F.col("_carried").alias("_past"), F.col("_coming").alias("_future"))
    found = grouped.withColumns(sides).join(outer, [*keys, "_group"])
    return found.withColumns({"_carried": F.coalesce("_carried", "_past"), "_coming": F.coalesce("_coming", "_future")}).drop("_group", "_past", "_future")


def neighbours(df: DataFrame, keys: list[str], at: str, value: str, size: float) -> DataFrame:
    """Adds ``before`` and ``after``: (at, value) of the last row at or before each row that has a value, and of the first at or after it.

    A timeline is cut into bins of ``size``; a bin knows the last value before it and the first after it from a table of bins,
    over empty ones too, so no task orders a whole key. Of values at one time ``before`` has the greatest, ``after`` the least.
    """
    point = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("at"), F.col(value).alias("value")))
    rows = df.withColumns({"_bin": F.floor(F.col(at) / size), "_point": point})
    ends = rows.groupBy(*keys, "_bin").agg(F.max("_point").alias("_last"), F.min("_point").alias("_first"))
    carried = _over_empty(ends, keys).select(*keys, "_bin", "_carried", "_coming")
    inside = Window.partitionBy(*keys, "_bin")
    back, ahead = (inside.orderBy(c).rangeBetween(Window.unboundedPreceding, 0) for c in (F.col(at), F.col(at).desc()))
    found = rows.withColumns({"before": F.max("_point").over(back), "after": F.min("_point").over(ahead)}).join(carried, [*keys, "_bin"])
    return found.withColumns({"before": F.coalesce("before", "_carried"), "after": F.coalesce("after", "_coming")}).drop("_bin", "_point", "_carried", "_coming")


def interp_join(target: DataFrame, series: DataFrame, keys: list[str], value: str, size: float = 600.0) -> DataFrame:
    """Linear interpolation of (t, value) at the target's times ``t``, clamped at the ends: a two-sided as-of join by bins of
    ``size``. Of values at one time the greatest counts at that time and after it, the least before it."""
    none = F.lit(None).cast("double")
    both = target.select(*keys, "t", none.alias("_v"), F.lit(True).alias("_want")).unionByName(series.select(*keys, "t", F.col(value).cast("double").alias("_v"), F.lit(False).alias("_want")))
    x = neighbours(both, keys, "t", "_v", size).where("_want")
    t0, v0, t1, v1 = (F.col(side)[c] for side in ("before", "after") for c in ("at", "value"))
    line = F.when(t0.isNull(), v1).when(t1.isNull() | (t1 == t0), v0).otherwise(v0 + (v1 - v0) * (F.col("t") - t0) / (t1 - t0))
    return x.select(*keys, "t", line.alias(value))


def latest(series: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    return series.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def offset_merge(parts: DataFrame, offsets: DataFrame, keys: list[str] | None = None, dedup_overlap: bool = False) -> DataFrame:
    """Part-local times plus each part's start; offsets (part_id, offset) are one row a part and join by hash.

    With ``dedup_overlap`` parts may overlap: offsets have the ``keys`` of the recording and a ``duration``, and a row stays only in
    the part whose centre is nearest to its own middle, the later one of two as near, so that what two parts say is said once.
    """
    if not dedup_overlap:
        return parts.join(offsets.select("part_id", "offset"), "part_id").withColumns({c: F.col(c) + F.col("offset") for c in ("start_time", "end_time")}).drop("offset")
    # a part owns the time up to half way to the centres of the parts beside it; the parts of a recording are a small table
    line = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_centre", "part_id")
    centred = offsets.withColumn("_centre", F.col("offset") + F.col("duration") / 2)
    half = lambda c: (F.col("_centre") + c) / 2
    owned = centred.select("part_id", "offset", half(F.lag("_centre").over(line)).alias("_from"), half(F.lead("_centre").over(line)).alias("_till"))
    moved = parts.join(owned, "part_id").withColumns({c: F.col(c) + F.col("offset") for c in ("start_time", "end_time")})
    middle = (F.col("start_time") + F.col("end_time")) / 2
    mine = (F.col("_from").isNull() | (middle >= F.col("_from"))) & (F.col("_till").isNull() | (middle < F.col("_till")))
    return moved.where(mine).drop("offset", "_from", "_till")
