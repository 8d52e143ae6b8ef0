"""Peaks of series of any length: plateaus stitched, distances settled in chunks, prominences by a tree of extremes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentlens.operators.intervals import neighbours
from momentlens.operators.selection import quantiles
from momentlens.operators.windows import running
from momentlens.sources.shared import written

#: (rows between peaks, prominence, height); the adaptive one takes a twentieth of the series and its 60th percentile, and
#: the highest rows where there is no peak.
PROFILES = {"precomputed": (15, 0.25, 0.35), "legacy": (20, 0.3, 0.4), "adaptive": (None, 0.1, None), "emotion_precomputed": (15, 0.15, 0.25), "emotion_legacy": (20, 0.2, 0.3)}
#: Children of a node of the tree of extremes; rows of a leaf.
FAN = 256
#: Distances in a chunk of peaks that are settled together.
CHUNK = 256


def numbered_series(df: DataFrame, keys: list[str], time: str, value: str, piece: Column) -> DataFrame:
    """(keys, time, value, row, old, new): rows with a value in order of time (then value), from 0, with the values beside."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(time).cast("double").alias(time), F.col(value).cast("double").alias(value))
    made = running(rows, keys, [time, value], piece, {"_row": F.lit(1).cast("long")}, {"old": F.col(value)}, after={"new": F.col(value)})
    return made.withColumn("row", F.col("_row") - 1).drop("_row")


def plateau_peaks(series: DataFrame, keys: list[str], value: str, size: int) -> DataFrame:
    """(keys, at, value): the middle row of each run of equal values whose neighbours on both sides are lower.

    A run of one row is told by the values beside it; only the ends of longer runs are looked up from one another.
    """
    x = F.col(value)
    single = series.where((x > F.col("old")) & (x > F.col("new"))).select(*keys, F.col("row").alias("at"), value)
    edge = series.withColumns({"_begin": ~x.eqNullSafe(F.col("old")), "_end": ~x.eqNullSafe(F.col("new"))}).where("_begin <> _end")
    risen = F.when(F.col("_begin"), F.struct("row", (x > F.col("old")).alias("up")))
    paired = neighbours(edge.withColumn("_from", risen), keys, "row", "_from", float(size))
    first = F.col("before")["value"]
    out = paired.where(F.col("_end") & (x > F.col("new")) & F.coalesce(first["up"], F.lit(False)))
    return single.unionByName(out.select(*keys, F.expr("(before.value.row + row) DIV 2").alias("at"), value))


def settle(at: np.ndarray, v: np.ndarray, state: np.ndarray, own: np.ndarray, distance: int) -> np.ndarray:
    """States (1 kept, -1 gone, 0 open) of the own peaks of a chunk, highest first, the later of equal ones.

    A peak goes where a kept one is nearer than ``distance``; it stays open where a higher one is that is itself open.
    """
    state = state.copy()
    lo, hi = np.searchsorted(at, at - distance, "right"), np.searchsorted(at, at + distance, "left")
    place = np.empty(len(at), np.int64)
    place[np.lexsort((at, v))] = np.arange(len(at))
    for i in np.lexsort((at, v))[::-1].tolist():
        if own[i] and state[i] == 0:
            near = state[lo[i] : hi[i]]
            if (near == 1).any():
                state[i] = -1
            elif not ((near == 0) & (place[lo[i] : hi[i]] > place[i])).any():
                state[i] = 1
    return state


def spaced(peaks: DataFrame, keys: list[str], value: str, distance: int, chunk: int = CHUNK) -> DataFrame:
    """The peaks that are kept when each removes all lower ones nearer than ``distance`` rows, the highest first.

    Chunks of ``chunk`` distances see the peaks of their neighbours that lie within a distance and settle what doesn't
    hang on an open one of these; rounds go on until nothing is open, which takes as many as a rising chain crosses chunks.
    """
    if distance <= 1:
        return peaks
    size = distance * chunk
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in peaks.schema]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        own = pdf["_own"].to_numpy()
        new = settle(pdf["at"].to_numpy(), pdf[value].to_numpy(), pdf["_state"].to_numpy(), own, distance)
        return pdf.assign(_state=new)[own].drop(columns=["_chunk", "_own"])

    table = peaks.withColumn("_state", F.lit(0).cast("long"))
    while True:
        mine = F.floor(F.col("at") / size)
        spread = F.array_distinct(F.array(mine, F.floor((F.col("at") - distance) / size), F.floor((F.col("at") + distance) / size)))
        copies = table.where("_state >= 0").withColumn("_chunk", F.explode(spread)).withColumn("_own", F.col("_chunk") == mine)
        table = written(copies.groupBy(*keys, "_chunk").applyInPandas(run, ", ".join([*fields, "_state long"])), "spaced")
        if not table.where("_state = 0").limit(1).count():
            return table.where("_state = 1").drop("_state")


def widely_spaced(peaks: DataFrame, keys: list[str], value: str) -> DataFrame:
    """As ``spaced``, for distances (column ``gap``) that are a share of the series, so that each key keeps a few peaks.

    Bins are as long as the distance. The highest open peak of a bin that is higher than those of the bins beside it is kept;
    a round keeps the highest of each key at least.
    """
    table = written(peaks.withColumn("_bin", F.floor(F.col("at") / F.col("gap"))), "wide")
    kept = table.limit(0)
    while table.limit(1).count():
        tops = table.groupBy(*keys, "_bin").agg(F.max(F.struct(value, "at")).alias("_top"))
        beside = tops.withColumn("_bin", F.explode(F.array(F.col("_bin") - 1, F.col("_bin"), F.col("_bin") + 1))).groupBy(*keys, "_bin").agg(F.max("_top").alias("_most"))
        won = tops.join(beside, [*keys, "_bin"]).where("_top = _most").select(*keys, "_bin", F.col("_top.at").alias("_at"))
        won = written(won, "won")
        kept = kept.unionByName(table.join(won, [*keys, "_bin"]).where("at = _at").drop("_at"))
        near = won.withColumn("_bin", F.explode(F.array(F.col("_bin") - 1, F.col("_bin"), F.col("_bin") + 1)))
        same = [table[k] == near[k] for k in (*keys, "_bin")]
        table = written(table.join(near, [*same, F.abs(table["at"] - near["_at"]) < table["gap"]], "left_anti"), "wide")
    return kept.drop("_bin")


def prominences(peaks: DataFrame, series: DataFrame, keys: list[str], value: str, fan: int = FAN) -> DataFrame:
    """The peaks with ``prominence``: their height above the higher of the two lowest values on the way to a higher one.

    Leaves are ``fan`` rows, nodes ``fan`` leaves or nodes, each with its extremes. A peak looks away to either side in its
    leaf, then in ever higher nodes until one holds a higher value, and down again in that: an equi-join a step.
    """
    leaf = series.groupBy(*keys, F.floor(F.col("row") / fan).alias("_parent")).agg(F.array_sort(F.collect_list(F.struct("row", F.col(value).alias("lo"), F.col(value).alias("hi")))).alias("_kids"))
    levels = [written(leaf, "leaves")]
    far = levels[0].agg(F.max("_parent")).first()[0] or 0
    while far > 0:
        low, high = F.array_min(F.transform("_kids", lambda c: c["lo"])), F.array_max(F.transform("_kids", lambda c: c["hi"]))
        nodes = levels[-1].select(*keys, F.col("_parent").alias("row"), low.alias("lo"), high.alias("hi"))
        levels.append(written(nodes.groupBy(*keys, F.floor(F.col("row") / fan).alias("_parent")).agg(F.array_sort(F.collect_list(F.struct("row", "lo", "hi"))).alias("_kids")), "nodes"))
        far //= fan

    def look(asked: DataFrame, level: int, ahead: Column) -> DataFrame:
        """One step: ``ahead`` are the children on the way, nearest first; adds ``_first``, the place of the first one with a higher value or 0."""
        way = asked.join(levels[level], [*keys, "_parent"]).withColumn("_way", ahead)
        k = F.array_position(F.transform("_way", lambda c: c["hi"] > F.col(value)), F.lit(True))
        passed = F.when(F.col("_first") > 0, F.slice("_way", 1, (F.col("_first") - 1).cast("int"))).otherwise(F.col("_way"))
        least = F.least("_low", F.array_min(F.transform(passed, lambda c: c["lo"])))
        return way.withColumn("_first", k).withColumn("_low", least).withColumn("_size", F.size("_kids")).drop("_way", "_kids")

    index = (F.col("_node") % fan).cast("int")
    left, right = F.reverse(F.slice("_kids", 1, index)), F.slice("_kids", index + 2, fan)
    asked = peaks.select(*keys, "at", value, F.col(value).alias("_low"), F.col("at").alias("_node"), F.explode(F.array(F.lit(-1), F.lit(1))).alias("_side"))
    done, found = [], []
    for level in range(len(levels)):
        step = look(asked.withColumn("_parent", F.floor(F.col("_node") / fan)), level, F.when(F.col("_side") < 0, left).otherwise(right))
        step = written(step.withColumn("_node", F.when(F.col("_first") > 0, F.col("_node") + F.col("_side") * F.col("_first")).otherwise(F.col("_parent"))).drop("_parent", "_size"), "steps")
        found.append(step.where("_first > 0").drop("_first"))
        asked = step.where("_first = 0").drop("_first")
    done.append(asked)  # nothing higher up to the end
    for level in range(len(levels) - 1, 0, -1):
        down = look(found[level].withColumn("_parent", F.col("_node")), level - 1, F.when(F.col("_side") < 0, F.reverse("_kids")).otherwise(F.col("_kids")))
        child = F.when(F.col("_side") < 0, F.col("_size") - F.col("_first")).otherwise(F.col("_first") - 1)
        found[level - 1] = found[level - 1].unionByName(down.withColumn("_node", F.col("_parent") * fan + child).drop("_parent", "_first", "_size"))
    done.append(found[0])
    lows = done[0].unionByName(done[1]).groupBy(*keys, "at").agg((F.first(value) - F.max("_low")).alias("prominence"))
    return peaks.join(lows, [*keys, "at"])


def find_peaks(series: DataFrame, keys: list[str], value: str, height, distance, prominence: float, size: int = 4096, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(keys, at, value, prominence) of strict local maxima of a numbered series (the middle of a plateau), filtered by
    height, then distance, then prominence. ``height`` and ``distance`` are numbers or tables (keys, least) and (keys, gap)."""
    if isinstance(height, DataFrame):
        peaks = plateau_peaks(series, keys, value, size).join(height, keys).where(F.col(value) >= F.col("least")).drop("least")
    else:
        peaks = plateau_peaks(series.where(F.col(value) >= height), keys, value, size)
    kept = widely_spaced(peaks.join(distance, keys), keys, value).drop("gap") if isinstance(distance, DataFrame) else spaced(peaks, keys, value, distance, chunk)
    return prominences(written(kept, "peaks"), series, keys, value, fan).where(F.col("prominence") >= prominence)


def peak_moments(df: DataFrame, keys: list[str], time: str, value: str, profile: str | tuple = "precomputed", k: int | None = 10, piece: Column | None = None, size: int = 4096, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(keys, time, value, prominence, rank): the k highest peaks of each series (all, without k), the earlier of equal ones first.

    Rows without a value are left out, rows of one time are taken by value; a key that is null is left out. The adaptive profile gives the highest
    rows, without a prominence, of a series that has no peak. ``piece`` numbers pieces of the timeline (hours, if not given).
    """
    gap, prominence, height = PROFILES[profile] if isinstance(profile, str) else profile
    piece = F.floor(F.col(time) / 3600) if piece is None else piece
    whole = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, time)))
    series = written(numbered_series(whole, keys, time, value, piece), "series")
    least = height if height is not None else quantiles(series, keys, value, {"least": 0.6})
    apart = gap or series.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.count("*") / 20)).cast("long").alias("gap"))
    found = find_peaks(series, keys, value, least, apart, prominence, size, chunk, fan)
    if profile == "adaptive":
        found = written(found, "peaks")
        none = series.join(found.select(*keys).distinct(), keys, "left_anti")
        found = found.unionByName(none.select(*keys, F.col("row").alias("at"), value, F.lit(None).cast("double").alias("prominence")))
    order = Window.partitionBy(*keys).orderBy(F.desc(value), "at")
    top = found.withColumn("rank", F.row_number().over(order).cast("long"))
    if k is not None:
        top = top.where(F.col("rank") <= k)
    return top.join(series.select(*keys, F.col("row").alias("at"), time), [*keys, "at"]).select(*keys, time, value, "prominence", "rank")
