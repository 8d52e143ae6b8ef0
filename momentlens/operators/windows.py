"""Windows over timelines: tumbling, sliding, rolling, smoothing, regions and ranks. Every window is partitioned by key."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from momentlens.operators.intervals import FAN, neighbours
from momentlens.operators.selection import quantiles
from momentlens.sources.shared import written

#: Rows of a block; a frame sees those that it needs of the blocks beside.
BLOCK = 4096


def tumbling_assign(df: DataFrame, keys: list[str], time: str = "time", size: float = 30.0) -> DataFrame:
    """Adds start_time and end_time of windows from each key's first time; windows start before the last time only."""
    span = df.groupBy(*keys).agg(F.min(time).alias("_t0"), F.max(time).alias("_t1"))
    k = F.floor((F.col(time) - F.col("_t0")) / size)
    start = F.col("_t0") + k * size
    return df.join(span, keys).withColumn("start_time", start).where("start_time < _t1").withColumn("end_time", F.col("start_time") + size).drop("_t0", "_t1")


def sliding_windows(extent: DataFrame, keys: list[str], size: int = 60, step: int = 30, cover_tail: bool = False) -> DataFrame:
    """(keys, window_id, start_time, end_time) up to each key's ``last``; windows of less than half the size are dropped.

    The last windows end before ``last`` where less than a step is left, and a short recording has none; with ``cover_tail`` one more
    window of the full size, or as long as the recording, ends at ``last``.
    """
    grid = extent.where(F.col("last") >= size).select(*keys, "last", F.explode(F.sequence(F.lit(0), F.floor((F.col("last") - size) / step).cast("int"))).alias("window_id"))
    placed = grid.select(*keys, F.col("window_id").cast("long").alias("window_id"), (F.col("window_id") * F.lit(float(step))).alias("start_time"), "last")
    extra = extent.where((F.col("last") >= size) & ((F.col("last") - size + 1) > (F.floor((F.col("last") - size) / step) + 1) * step)).select(*keys, (F.floor((F.col("last") - size) / step) + 1).cast("long").alias("window_id"), ((F.floor((F.col("last") - size) / step) + 1) * F.lit(float(step))).alias("start_time"), "last")
    short = extent.where((F.col("last") < size) & (F.col("last") > size - 1)).select(*keys, F.lit(0).cast("long").alias("window_id"), F.lit(0.0).alias("start_time"), "last")
    every = placed.unionByName(extra).unionByName(short)
    found = every.withColumn("end_time", F.least(F.col("start_time") + size, F.col("last"))).where(F.col("end_time") - F.col("start_time") >= size / 2).drop("last")
    if not cover_tail:
        return found
    done = found.groupBy(*keys).agg(F.max("end_time").alias("_till"), F.max("window_id").alias("_id"))
    left = extent.join(done, keys, "left").where((F.col("last") > 0) & (F.coalesce("_till", F.lit(0.0)) < F.col("last")))
    tail = left.select(*keys, (F.coalesce("_id", F.lit(-1)) + 1).cast("long").alias("window_id"), F.greatest(F.lit(0.0), F.col("last") - size).alias("start_time"), F.col("last").alias("end_time"))
    return found.unionByName(tail)


def counts_on_grid(rows: DataFrame, keys: list[str], size: int = 60, step: int = 30, share: float = 0.5) -> DataFrame:
    """(keys, window_id, n): intervals of which at least ``share`` lies in a window of a regular grid, by arithmetic on the
    grid instead of a join. Intervals without a length don't count."""
    s, e = F.col("start_time"), F.col("end_time")
    ids = F.sequence(F.greatest(F.lit(0), F.floor((s - size) / step) + 1).cast("long"), F.floor(e / step).cast("long"))
    near = rows.where("end_time > start_time AND end_time > 0").select(*keys, s, e, F.explode(ids).alias("window_id"))
    begin = F.col("window_id") * float(step)
    inside = F.least(e, begin + size) - F.greatest(s, begin)
    return near.where((inside > 0) & (inside >= share * (e - s))).groupBy(*keys, "window_id").agg(F.count("*").alias("n"))


def on_grid(rows: DataFrame, size: int, step: int, name: str) -> DataFrame:
    """Each interval once for every window of a regular grid from 0 that it reaches into, with the window's number; by
    arithmetic on the grid instead of a join."""
    s, e = F.col("start_time"), F.col("end_time")
    ids = F.sequence(F.greatest(F.lit(0), F.floor((s - size) / step)).cast("long"), F.floor(e / step).cast("long"))
    begin = F.col(name) * float(step)
    return rows.where("end_time >= start_time AND end_time > 0").withColumn(name, F.explode(ids)).where((s < begin + size) & (e > begin))


def chunk_plan(df: DataFrame, keys: list[str], chunk: float, overlap: float) -> DataFrame:
    step = chunk - overlap
    n = F.ceil(F.col("duration") / step) - 1
    rows = df.where("duration > 0").select(*keys, "duration", F.explode(F.sequence(F.lit(0), n.cast("int"))).alias("chunk_id"))
    return rows.select(*keys, "chunk_id", (F.col("chunk_id") * step).alias("start_time"), F.least(F.col("chunk_id") * step + chunk, F.col("duration")).alias("end_time"))


def trailing(df: DataFrame, keys: list[str], row: str, time: str, value: str, span: float) -> DataFrame:
    """(keys, row, value, n, sum, squares, mean, var) over the values of the last ``span`` of each row, itself and its peers included.

    The timeline is cut into bins of ``span``, each with the rows of the bin before, so a key spreads over many tasks.
    In a bin every row asks twice for the running sums, where its frame begins and where it ends; a frame is the
    difference, so the work is linear in the rows. Sums are of the distance from the bin's mean, so that a large offset
    doesn't cancel out a small variance. ``row`` must be unique.
    """
    t, b = F.col(time).cast("double"), F.floor(F.col(time) / span)
    event = lambda where, at, kind, sign, x: F.struct(where.alias("_bin"), at.alias("_at"), F.lit(kind).alias("_kind"), F.lit(sign).alias("_sign"), x.cast("double").alias("_x"))
    x, none = F.col(value), F.lit(None)
    events = F.array(event(b, t, 1, 0, x), event(b + 1, t, 1, 0, x), event(b, t - span, 0, -1, none), event(b, t, 2, 1, none))
    every = df.select(*keys, F.col(row), F.col(value), F.explode(events).alias("_e")).select(*keys, row, value, "_e.*")
    whole = Window.partitionBy(*keys, "_bin")
    w = whole.orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    centred = every.withColumn("_c", F.coalesce(F.avg("_x").over(whole), F.lit(0.0))).withColumn("_x", F.col("_x") - F.col("_c"))
    sums = centred.withColumns({"_n": F.count("_x").over(w), "_s": F.coalesce(F.sum("_x").over(w), F.lit(0.0)), "_q": F.coalesce(F.sum(F.col("_x") * F.col("_x")).over(w), F.lit(0.0))})
    asked = sums.where("_sign <> 0").groupBy(*keys, "_bin", row)
    part = lambda c: F.sum(F.col(c) * F.col("_sign"))
    found = asked.agg(F.first(value).alias(value), F.first("_c").alias("_c"), part("_n").alias("n"), part("_s").alias("_s"), part("_q").alias("_q"))
    n, c, s, q = (F.col(k) for k in ("n", "_c", "_s", "_q"))
    mean = s / F.nullif(n, F.lit(0))
    return found.select(*keys, row, value, "n", (s + n * c).alias("sum"), (q + 2 * c * s + n * c * c).alias("squares"), (c + mean).alias("mean"), F.greatest(F.lit(0.0), q / F.nullif(n, F.lit(0)) - mean * mean).alias("var"))


def rolling_zscore(df: DataFrame, keys: list[str], row: str, time: str, value: str, span: float = 600.0) -> DataFrame:
    """(keys, row, z): scaled z-score over the last ``span`` seconds, itself included: (z clipped to 3 + 3) / 6; null of a null."""
    x = trailing(df, keys, row, time, value, span)
    std = F.when((F.col("n") < 5) | (F.col("var") < 1e-10), 1.0).otherwise(F.sqrt("var"))
    z = (F.col(value) - F.when(F.col("n") < 5, 0.0).otherwise(F.col("mean"))) / std
    return x.select(*keys, row, ((F.when(z.isNotNull(), F.greatest(F.lit(-3.0), F.least(F.lit(3.0), z))) + 3) / 6).alias("z"))


def earlier(df: DataFrame, keys: list[str], order: list[str], piece: Column, sums: dict[str, Column], before: dict[str, Column], levels: int = 1, kept: str | None = None, after: dict[str, Column] | None = None) -> DataFrame:
    """Adds, by name, sums of the rows before each row in ``order`` (null before the first value) and values of the row before
    and ``after``.

    ``piece`` numbers pieces of the timeline that follow each other in ``order``. Rows are looked at inside their piece and
    shifted by what the pieces before leave. The pieces, a row each, are treated in the same way in pieces of ``FAN``, as often
    as there are ``levels``, before a window orders what is left of a key. Rows with a null key or piece are left out. The piece is
    kept under the name ``kept``, if there is one: the result is dealt by keys and piece.
    """
    by, after = F.struct(*order), after or {}
    cut = df.withColumns({"_piece": piece, **{f"_{k}": v for k, v in (*sums.items(), *before.items(), *after.items())}})
    pieces = cut.groupBy(*keys, F.col("_piece").alias("_at")).agg(*[F.sum(f"_{k}").alias(f"_w{k}") for k in sums], *[F.max_by(f"_{k}", by).alias(f"_w{k}") for k in before], *[F.min_by(f"_{k}", by).alias(f"_w{k}") for k in after])
    part = lambda names: {f"_p{k}": F.col(f"_w{k}") for k in names}
    if levels:
        shift = earlier(pieces, keys, ["_at"], F.floor(F.col("_at") / FAN), part(sums), part(before), levels - 1, after=part(after))
    else:
        line = Window.partitionBy(*keys).orderBy("_at")
        shift = pieces.withColumns({k: F.sum(v).over(line.rowsBetween(Window.unboundedPreceding, -1)) for k, v in part(sums).items()} | {k: F.lag(v).over(line) for k, v in part(before).items()} | {k: F.lead(v).over(line) for k, v in part(after).items()})
    inside = Window.partitionBy(*keys, "_piece").orderBy(*order)
    out = {k: _plus(F.col(f"_p{k}"), F.sum(f"_{k}").over(inside.rowsBetween(Window.unboundedPreceding, -1))) for k in sums}
    out |= {k: F.when(F.row_number().over(inside) == 1, F.col(f"_p{k}")).otherwise(F.lag(f"_{k}").over(inside)) for k in before}
    out |= {k: F.when(F.lead(F.lit(1)).over(inside).isNull(), F.col(f"_p{k}")).otherwise(F.lead(f"_{k}").over(inside)) for k in after}
    names = (*sums, *before, *after)
    moved = shift.select(*keys, F.col("_at").alias("_piece"), *[f"_p{k}" for k in names])
    found = cut.join(moved, [*keys, "_piece"]).withColumns(out).drop(*[f"_{k}" for k in names], *[f"_p{k}" for k in names])
    return found.withColumnRenamed("_piece", kept) if kept else found.drop("_piece")


def _plus(a: Column, b: Column) -> Column:
    """The sum of both, or the one that isn't null."""
    return F.coalesce(a + b, a, b)


def running(df: DataFrame, keys: list[str], order: list[str], piece: Column, sums: dict[str, Column], before: dict[str, Column] | None = None, kept: str | None = None, after: dict[str, Column] | None = None) -> DataFrame:
    """Adds running sums in ``order`` (by name, the row included; nulls add nothing) and, by ``before`` and ``after``, values of
    the rows beside. For ``piece`` and ``kept`` see ``earlier``: no task orders a whole key."""
    own = {f"_own_{k}": v for k, v in sums.items()}
    found = earlier(df.withColumns(own), keys, order, piece, {k: F.col(f"_own_{k}") for k in sums}, before or {}, kept=kept, after=after)
    return found.withColumns({k: _plus(F.col(k), F.col(f"_own_{k}")) for k in sums}).drop(*own)


def in_blocks(df: DataFrame, keys: list[str], order: list[str], piece: Column, before: int, after: int, made: Callable[[WindowSpec], dict[str, Column]], size: int = BLOCK) -> DataFrame:
    """Adds ``_row``, the number of a row in ``order`` (from 1), and columns over frames of rows around it.

    ``made`` gets a window, ordered by row, that holds ``before`` rows before each row and ``after`` after it at least, or
    all there are. Rows are numbered by ``running`` (see there for ``piece``) and cut into blocks; the rows next to a
    block's ends are copied into it, so no task orders a whole key and no frame is cut.
    """
    rows = running(df, keys, order, piece, {"_row": F.lit(1).cast("long")})
    block = lambda shift: F.floor((F.col("_row") - 1 + shift) / size)
    spread = F.sequence(F.greatest(F.lit(0), block(-after)), block(before))
    copies = rows.withColumn("_block", F.explode(spread))
    w = Window.partitionBy(*keys, "_block").orderBy("_row")
    return copies.withColumns(made(w)).where(F.col("_block") == block(0)).drop("_block")


def centered(df: DataFrame, keys: list[str], order: list[str], piece: Column, values: dict[str, Column], width: int = 5, size: int = BLOCK) -> DataFrame:
    """Adds mean_ and std_ of each of ``values`` (by name) over ``width`` rows around a row, null where one is missing."""
    half, named = width // 2, {f"_v_{k}": v for k, v in values.items()}

    def made(w: WindowSpec) -> dict[str, Column]:
        w = w.rowsBetween(-half, half)
        full = lambda k, f: F.when(F.count(f"_v_{k}").over(w) == width, f(f"_v_{k}").over(w))
        return {f"mean_{k}": full(k, F.avg) for k in values} | {f"std_{k}": full(k, F.stddev_samp) for k in values}

    return in_blocks(df.withColumns(named), keys, order, piece, half, half, made, size).drop("_row", *named)


def smooth_moving_average(df: DataFrame, keys: list[str], order: list[str], piece: Column, value: str, width: int = 15, size: int = BLOCK) -> DataFrame:
    """Adds ``smoothed``, the mean of ``width`` rows around a row; the rows next to the series' ends keep their values."""
    half = width // 2

    def made(w: WindowSpec) -> dict[str, Column]:
        edge = (F.col("_row") <= half) | (F.count("*").over(w.rowsBetween(1, half)) < half) if half else F.lit(False)
        return {"smoothed": F.when(edge, F.col(value)).otherwise(F.avg(value).over(w.rowsBetween(-half, half if width % 2 else half - 1)))}

    return in_blocks(df, keys, order, piece, half, half, made, size).drop("_row")


def loudness_smooth(df: DataFrame, keys: list[str], order: list[str], piece: Column, value: str, width: int = 50, size: int = BLOCK) -> DataFrame:
    """Adds ``loudness``: the mean of the absolute values of ``width`` rows around a row, the row itself the first after the
    middle; where one of them is missing, that of the next row that has one, or else of the last before."""
    x = df.withColumn("_abs", F.abs(F.col(value)))

    def made(w: WindowSpec) -> dict[str, Column]:
        w = w.rowsBetween(-(width // 2), width - width // 2 - 1)
        return {"_mean": F.when(F.count("_abs").over(w) == width, F.avg("_abs").over(w))}

    rows = neighbours(in_blocks(x, keys, order, piece, width // 2, width, made, size), keys, "_row", "_mean", float(size))
    found = F.coalesce(F.col("_mean"), F.col("after")["value"], F.col("before")["value"])
    return rows.withColumn("loudness", found).drop("_row", "_abs", "_mean", "before", "after")


def savgol_weights(width: int = 15, degree: int = 3) -> np.ndarray:
    """Weights of the fitted polynomial at each place of a window: row r gives the value at place r."""
    x = np.vander(np.arange(width) - width // 2, degree + 1)
    return x @ np.linalg.pinv(x)


def smooth_savgol(df: DataFrame, keys: list[str], order: list[str], piece: Column, value: str, width: int = 15, size: int = BLOCK) -> DataFrame:
    """Adds ``smoothed``: cubic least-squares smoothing; at the ends the polynomial of the first or last window. A series
    shorter than the window, which is made odd, stays as it is."""
    width += 1 - width % 2
    half, weights = width // 2, savgol_weights(width)
    table = F.array(*[F.array(*map(F.lit, r.tolist())) for r in weights])

    def made(w: WindowSpec) -> dict[str, Column]:
        near = w.rowsBetween(-(width - 1), width - 1)
        return {"_values": F.collect_list(F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))).over(near), "_later": F.count("*").over(w.rowsBetween(1, half)) if half else F.lit(0).cast("long")}

    rows = in_blocks(df, keys, order, piece, width - 1, width - 1, made, size)
    # the row's place in its window: the middle, but the window is held inside the series
    place = F.when(F.col("_row") <= half, F.col("_row") - 1).when(F.col("_later") < half, width - 1 - F.col("_later")).otherwise(half)
    first = F.least(F.col("_row") - 1, F.lit(width - 1)) - place
    cut = rows.withColumns({"_place": place.cast("int"), "_long": F.size("_values") >= width}).withColumn("_values", F.slice("_values", (first + 1).cast("int"), width))
    fitted = F.aggregate(F.zip_with(F.get(table, F.col("_place")), "_values", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return cut.withColumn("smoothed", F.when(F.col("_long"), F.nanvl(fitted, F.lit(None).cast("double"))).otherwise(F.col(value))).drop("_row", "_values", "_later", "_place", "_long")


def smooth_exponential(df: DataFrame, keys: list[str], order: list[str], value: str, piece: Column, width: int = 15) -> DataFrame:
    """Adds ``smoothed``, y = a x + (1 - a) y before, with a = 2 / (width + 1), from the first row on.

    Rows are numbered by ``running`` (see there for ``piece``) and cut into blocks so long that what is left of a value after
    a block is below the rounding of a double. A row is the weighted sum of its block's rows up to it and of what the two blocks
    before it leave, so no task holds a series.
    """
    a = 2 / (width + 1)
    size = max(1, math.ceil(-36.8 / math.log1p(-a))) if a < 1 else 1
    keep = 1 - a
    rows = running(df, keys, order, piece, {"_row": F.lit(1).cast("long")}).withColumns({"_block": F.floor((F.col("_row") - 1) / size), "_k": (F.col("_row") - 1) % size})
    weight = F.when(F.col("_row") == 1, 1.0).otherwise(a)
    lifted = F.col(value) * weight * F.pow(F.lit(keep), -F.col("_k")) if a < 1 else F.col(value)
    inside = Window.partitionBy(*keys, "_block").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_y", F.sum(lifted).over(inside) * F.pow(F.lit(keep), F.col("_k")) if a < 1 else F.col(value))
    ends = local.where(F.col("_k") == size - 1).select(*keys, (F.col("_block") + 1).alias("_block"), F.col("_y").alias("_end"))
    # a block's end reaches two blocks; blocks are numbered without gaps
    reach = F.array(F.struct("_block", "_end"), F.struct((F.col("_block") + 1).alias("_block"), (F.col("_end") * keep**size).alias("_end")))
    carried = ends.select(*keys, F.explode(reach).alias("_x")).groupBy(*keys, F.col("_x._block").alias("_block")).agg(F.sum("_x._end").alias("_end"))
    joined = local.join(carried, [*keys, "_block"], "left")
    return joined.withColumn("smoothed", F.col("_y") + F.coalesce("_end", F.lit(0.0)) * F.pow(F.lit(keep), F.col("_k") + 1)).drop("_row", "_block", "_k", "_y", "_end")


def threshold_regions(df: DataFrame, keys: list[str], time: str, value: str, threshold: float, piece: Column, least: float = 3.0) -> DataFrame:
    """(keys, start, end, peak, rows): longest runs of rows above a threshold that last ``least`` at least."""
    over = F.coalesce(F.col(value) > threshold, F.lit(False))
    # rows and high rows before a row: their difference stays the same inside a run
    rows = running(df, keys, [time, value], piece, {"_row": F.lit(1).cast("long"), "_above": over.cast("long")})
    island = rows.where(over).withColumn("_island", F.col("_row") - F.col("_above"))
    return island.groupBy(*keys, "_island").agg(F.min(time).alias("region_start"), F.max(time).alias("region_end"), F.max(value).alias("peak"), F.count("*").alias("n")).where(F.col("region_end") - F.col("region_start") >= least).drop("_island")


def gap_islands(df: DataFrame, keys: list[str], index: str, gap: int = 5, size: int = BLOCK) -> DataFrame:
    """(keys, first, last, middle): groups of indexes that lie at most ``gap`` apart."""
    piece = F.floor(F.col(index) / size)
    beside = running(df, keys, [index], piece, {}, {"_old": F.col(index)})
    new = F.coalesce((F.col(index) - F.col("_old") > gap).cast("int"), F.lit(1)).cast("long")
    grouped = running(beside, keys, [index], piece, {"_group": new})
    return grouped.groupBy(*keys, "_group").agg(F.min(index).alias("first"), F.max(index).alias("last")).withColumn("middle", F.expr("(first + last) DIV 2")).drop("_group")


def paragraphs_every_n_sentences(words: DataFrame, keys: list[str], order: str, n: int = 3, size: int = BLOCK) -> DataFrame:
    """(keys, paragraph, start_time, end_time, text) of ``n`` sentences each, the last of what is left. Words are put together
    in their pieces of the timeline first, so that texts are moved, not words."""
    end = F.coalesce(F.col("word").rlike("[.!?]"), F.lit(False)).cast("long")
    numbered = running(words, keys, [order], F.floor(F.col(order) / size), {"_ends": end}, kept="_part").withColumn("paragraph", F.floor((F.col("_ends") - end) / n))
    times = (F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"))
    joined = lambda by, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, c))), lambda x: x[c]), " ")
    parts = numbered.groupBy(*keys, "_part", "paragraph").agg(*times, F.when(F.count("word") > 0, joined(order, "word")).alias("text"))
    return parts.groupBy(*keys, "paragraph").agg(*times, joined("_part", "text").alias("text"))


def paragraphs_by_pause(segments: DataFrame, keys: list[str], piece: Column, pause: float = 0.8) -> DataFrame:
    """(keys, paragraph, start_time, end_time, segments): a new one after a pause."""
    order = ["start_time", "end_time"]
    beside = running(segments, keys, order, piece, {}, {"_old": F.col("end_time")})
    new = F.coalesce((F.col("start_time") - F.col("_old") >= pause).cast("int"), F.lit(1)).cast("long")
    return running(beside, keys, order, piece, {"paragraph": new}).groupBy(*keys, "paragraph").agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.count("*").alias("segments"))


def keep_updates(progress: pd.Series, stage: pd.Series, step: float, last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Which updates are kept, and (progress, stage, updates since) of the last one kept; ``last`` is that from before."""
    keep = []
    for p, s in zip(progress, stage, strict=True):
        since = last[2] + 1 if last else 1
        ok = last is None or abs(p - last[0]) >= step - 1e-12 or s != last[1] or since >= 10
        last = (float(p), s, 0) if ok else (*last[:2], since)
        keep.append(ok)
    return np.array(keep, bool), last


def notifications(updates: DataFrame, keys: list[str], order: str, ends: tuple[str, ...]) -> DataFrame:
    """Updates (percent, stage) worth telling by themselves: whole tens of percent, a stage other than before, an end.
    ``order`` is a whole number; updates with a null key or order are left out."""
    beside = earlier(updates, keys, [order], F.floor(F.col(order) / BLOCK), {}, {"_old": F.col("stage")})
    told = (F.col("percent") % 10 == 0) | ~F.col("stage").eqNullSafe(F.col("_old")) | F.col("stage").isin(*ends)
    return beside.where(told).drop("_old")


def transitions(df: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """Adds ``transition``, the state before and that of each row, as ``a -> b``; null at a key's first row or beside a null.
    ``order`` is a whole number; rows with a null key or order are left out."""
    beside = earlier(df, keys, [order], F.floor(F.col(order) / BLOCK), {}, {"_old": F.col(state)})
    return beside.withColumn("transition", F.concat("_old", F.lit(" -> "), F.col(state))).drop("_old")


def overlap_sums(left: DataFrame, right: DataFrame, keys: list[str], ids: list[str], values: list[str], names: tuple[str, str, str, str] = ("start_time", "end_time", "r_start", "r_end"), size: float = 600.0, how: str = "inner") -> DataFrame:
    """(ids, n, values): how many intervals of the right side with equal keys overlap or touch each of the left, and sums of their values.

    A right interval counts if it has begun when the left one ends and hasn't ended before that begins: both are running counts, so
    no pair is formed and the work is linear in the rows, however many overlap. The right side is points where its two names are the
    same. ``ids`` are of the left side. With ``how`` left, an interval that nothing overlaps is kept with 0 and nulls.
    """
    ls, le, rs, re = names
    points = rs == re
    sums = {"_n": F.lit(1).cast("long")}
    fractions = [f.name for f in right.schema.fields if f.name in values and f.dataType.typeName() in ("float", "double")]
    for v in values:
        x = F.col(v)
        finite = F.abs(x) < float("inf") if v in fractions else x.isNotNull()
        sums |= {f"_s_{v}": F.when(finite, x), f"_c_{v}": x.isNotNull().cast("long")}
        if v in fractions:  # a running sum never gets rid of these: they are counted
            sums |= {f"_up_{v}": (F.isnan(x) | (x == float("inf"))).cast("long"), f"_down_{v}": (F.isnan(x) | (x == float("-inf"))).cast("long")}
    # in one line beginnings come before the ends that ask for them, in the other ends come after the beginnings that ask
    event = lambda at, line, kind: F.struct(at.cast("double").alias("_at"), F.lit(line).alias("_line"), F.lit(kind).alias("_kind"))
    adds = [event(F.col(rs), 0, 1)] + ([] if points else [event(F.col(re), 1, 1)])
    asks = [event(F.col(le), 0, 2), event(F.col(ls), 0 if points else 1, 0)]
    a = left.where(F.col(le) >= F.col(ls)).select(*keys, *[F.col(c).alias(f"_id_{c}") for c in ids], F.explode(F.array(*asks)).alias("_e"))
    b = right.where(F.col(re) >= F.col(rs)).withColumns(sums).select(*keys, *sums, F.explode(F.array(*adds)).alias("_e"))
    events = a.unionByName(b, allowMissingColumns=True).select("*", "_e.*").drop("_e")
    summed = running(events, [*keys, "_line"], ["_at", "_kind"], F.floor(F.col("_at") / size), {f"_r{c}": F.col(c) for c in sums})
    sign = F.when(F.col("_kind") == 2, 1).otherwise(-1)
    asked = summed.where("_kind <> 1").groupBy(*[F.col(f"_id_{c}").alias(c) for c in ids])
    found = asked.agg(*[F.sum(sign * F.coalesce(F.col(f"_r{c}"), F.lit(0))).alias(c) for c in sums])
    if how == "left":
        none = left.where(" OR ".join(f"`{c}` IS NULL" for c in (*keys, ls, le)) + f" OR `{le}` < `{ls}`").select(*ids, *[F.lit(0).cast("long").alias(c) for c in sums])
        found = found.unionByName(none).groupBy(*ids).agg(*[F.sum(c).alias(c) for c in sums])
    else:
        found = found.where("_n > 0")
    out = {}
    for v in values:
        total = F.col(f"_s_{v}")
        if v in fractions:
            odd = lambda x: F.lit(float(x))
            total = F.when((F.col(f"_up_{v}") > 0) & (F.col(f"_down_{v}") > 0), odd("nan")).when(F.col(f"_up_{v}") > 0, odd("inf")).when(F.col(f"_down_{v}") > 0, odd("-inf")).otherwise(total)
        out[v] = F.when(F.col(f"_c_{v}") > 0, total)
    return found.select(*ids, F.col("_n").alias("n"), *[x.alias(v) for v, x in out.items()])


def video_minmax(df: DataFrame, keys: list[str], value: str, name: str, constant: float | None = 0.5) -> DataFrame:
    """Adds ``name``: the value between its key's extremes, as 0 to 1; a constant series gives ``constant``."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    x = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).when(F.col(value).isNotNull(), F.lit(constant).cast("double"))
    return df.join(ends, keys).withColumn(name, x).drop("_lo", "_hi")


def minute_summary(df: DataFrame, keys: list[str], start: str, score: str, means: list[str], q: float = 0.85, share: float = 0.8) -> DataFrame:
    """(keys, minute, score, means, marked): means of each minute; marked where the score is above ``share`` of the key's
    ``q`` percentile of all scores."""
    df = written(df.select(*keys, start, score, *means), "minutes")  # read by each round of the selection
    threshold = quantiles(df, keys, score, {"_t": q}).withColumn("_t", F.col("_t") * share)
    sums = df.groupBy(*keys, F.floor(F.col(start) / 60).alias("minute")).agg(F.avg(score).alias("score"), *[F.avg(m).alias(m) for m in means])
    return sums.join(threshold, keys).withColumn("marked", F.col("score") > F.col("_t") + 1e-9).drop("_t")


def cover_all(df: DataFrame, keys: list[str], score: str, order: str, labels: dict[str, str], ranked: tuple[str, ...], k: int) -> DataFrame:
    """(keys, emotion, order, rank): the top k rows with the dominant of the ``ranked`` labels, and for each label that is
    dominant in none of them the row where it is greatest (rank 0)."""
    best = F.array_max(F.array(*[F.struct(F.col(labels[e]).alias("v"), F.lit(-i).alias("i"), F.lit(e).alias("e")) for i, e in enumerate(ranked)]))
    top = top_k(df, keys, score, k, order).select(*keys, best["e"].alias("emotion"), order, F.col("rank").cast("long").alias("rank"))
    long = df.select(*keys, order, F.explode(F.array(*[F.struct(F.lit(e).alias("emotion"), F.col(c).alias("v")) for e, c in labels.items()])).alias("_x")).select(*keys, order, "_x.*")
    each = top_k(long, [*keys, "emotion"], "v", 1, order)
    missing = each.join(top.select(*keys, "emotion").distinct(), [*keys, "emotion"], "left_anti")
    return top.unionByName(missing.select(*keys, "emotion", order, F.lit(0).cast("long").alias("rank")))


def top_k(df: DataFrame, keys: list[str], score: str, k: int, *ties: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
