"""Live operators. Each takes a batch or a streaming DataFrame with an event time ``ts``; late rows are awaited for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Messages react to speech up to so much later, which is the lateness allowed.
LATENESS = "15 seconds"


def live_windows(messages: DataFrame, size: str, slide: str | None = None, keys=("video_id",), lateness: str = LATENESS) -> DataFrame:
    """(keys, window, message_count, mean) of tumbling or sliding windows."""
    each = F.window("ts", size, slide) if slide else F.window("ts", size)
    return messages.withWatermark("ts", lateness).groupBy(*keys, each.alias("window")).agg(F.count("*").alias("message_count"), F.avg("value").alias("mean"))


def live_alerts(points: DataFrame, size: str, warn: float, critical: float, name: str = "event_type", lateness: str = LATENESS) -> DataFrame:
    """Windows of a metric whose greatest value reaches a threshold."""
    sums = points.withWatermark("ts", lateness).groupBy(name, F.window("ts", size).alias("window")).agg(F.count("*").alias("n"), F.max("value").alias("most"))
    return sums.where(F.col("most") >= warn).withColumn("level", F.when(F.col("most") >= critical, "critical").otherwise("warning"))


def live_requests(requests: DataFrame, size: str, warn: float = 0.05, critical: float = 0.1, lateness: str = LATENESS) -> DataFrame:
    """Windows of each endpoint's requests: number, extremes and mean of the durations, errors, and the error rate's level."""
    failed = F.when(F.col("success"), 0.0).otherwise(1.0)
    sums = requests.withWatermark("ts", lateness).groupBy("endpoint", F.window("ts", size).alias("window"))
    out = sums.agg(F.count("*").alias("n"), F.min("duration").alias("least"), F.max("duration").alias("most"), F.avg("duration").alias("mean"), F.count_if(~F.col("success")).alias("errors"), F.avg(failed).alias("rate"))
    return out.withColumn("level", F.when(F.col("rate") >= critical, "critical").when(F.col("rate") >= warn, "warning").otherwise("ok")).drop("rate")


def chat_bursts(messages: DataFrame, gap: str, keys=("video_id",), lateness: str = LATENESS) -> DataFrame:
    """(keys, session, message_count, total): runs of messages with less than ``gap`` between neighbours."""
    return messages.withWatermark("ts", lateness).groupBy(*keys, F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("message_count"), F.sum("value").alias("total"))


def reactions(messages: DataFrame, segments: DataFrame, lag_seconds: int = 15, lateness: str = LATENESS, longest: int = 600, how: str = "inner") -> DataFrame:
    """Segments (video_id, start_ts, end_ts) with the messages that may react to them: from the start to ``lag_seconds`` after the
    end. Both sides may be streams. The columns of the messages, start_ts and end_ts.

    A segment longer than ``longest`` seconds is joined in slices of that length, so that the state kept is bounded and
    no message of a long segment is lost. Both sides are dealt by bins, so that a long recording spreads over many keys: a slice
    has one bin, a message is in that of its time and the one before. With ``how`` left, a slice without a message comes
    once, with nulls, as soon as the watermark has passed all that it could have got.
    """
    reach = longest + lag_seconds
    bin_of = lambda c: F.floor(F.unix_timestamp(c) / reach)
    long_ = F.unix_micros("end_ts") - F.unix_micros("start_ts")
    slices = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((long_ - 1) / (longest * 1_000_000))).cast("long"))
    cut = segments.where("start_ts IS NOT NULL AND end_ts >= start_ts").withColumn("_slice", F.explode(slices))
    cut = cut.withColumn("_from", F.timestamp_micros(F.unix_micros("start_ts") + F.col("_slice") * (longest * 1_000_000)))
    ends = F.timestamp_micros(F.unix_micros("end_ts") + lag_seconds * 1_000_000)
    s = cut.withColumn("_last", F.col("_slice") >= F.size(slices) - 1).withColumn("_till", F.when(F.col("_last"), ends).otherwise(F.timestamp_micros(F.unix_micros("_from") + longest * 1_000_000)))
    s = s.select("video_id", "start_ts", "end_ts", "_from", "_till", "_last").withWatermark("_from", lateness).withColumn("_bin", bin_of("_from")).alias("s")
    m = messages.withWatermark("ts", lateness).withColumn("_bin", F.explode(F.array(bin_of("ts"), bin_of("ts") - 1))).alias("m")
    near = F.expr(f"m.video_id = s.video_id AND m._bin = s._bin AND m.ts >= s._from AND m.ts <= s._from + INTERVAL {reach} SECONDS AND (m.ts < s._till OR (s._last AND m.ts = s._till))")
    rest = [F.col(f"m.{c}") for c in messages.columns if c != "video_id"]
    return s.join(m, near, {"inner": "inner", "left": "leftOuter"}[how]).select("s.video_id", *rest, "s.start_ts", "s.end_ts")


def second(windows: DataFrame) -> DataFrame:
    """The window as the second of the epoch at which it starts."""
    return windows.withColumn("start_second", F.unix_timestamp("window.start")).drop("window")
