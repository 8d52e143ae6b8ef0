"""Score tables of segments: defaults, reaction windows, stream weights, loudness, failures and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentlens.operators.windows import running

from momentlens.sources.adapters import EMOTIONS

# Parts of a message that tell a failure, in order of trial, and the order of methods to fall back to.
FAILURES = (
    ("gpu_memory_error", ("cuda", "memory", "out of memory")),
    ("model_loading_error", ("model", "loading", "download")),
    ("network_error", ("network", "connection", "timeout")),
    ("processing_timeout", ("timeout", "time")),
    ("file_error", ("file", "path", "not found")),
)
FALLBACKS = ("parakeet_gpu", "parakeet_cpu", "deepgram")


def in_reaction_window(t: Column, start: Column, end: Column, lag: float = 15.0) -> Column:
    return (t >= start) & (t <= end + lag)


def fill_missing_scores(df: DataFrame) -> DataFrame:
    """Adds absent score columns (0, ``neutral`` 1) and ``text`` (empty); times must be there."""
    missing = {"start_time", "end_time"} - set(df.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    scores = dict.fromkeys(("sentiment_score", "highlight_score", *EMOTIONS), 0.0) | {"neutral": 1.0}
    return df.withColumns({c: F.lit(v) for c, v in {**scores, "text": ""}.items() if c not in df.columns})


def classify_failure(message: Column) -> Column:
    low, out = F.lower(message), F
    for name, parts in FAILURES:
        hit = F.lit(False)
        for part in parts:
            hit = hit | low.contains(part)
        out = out.when(hit, name)
    return out.otherwise("unknown_error")


def next_fallback(method: Column, failure: Column, chain: tuple[str, ...] = FALLBACKS) -> Column:
    """The method to try after a failure, ``error`` where none is left; methods outside the chain start it."""
    after = F
    for here, there in zip(chain, (*chain[1:], "error"), strict=True):
        after = after.when(method == here, there)
    special = F.when((failure == "gpu_memory_error") & (method == "parakeet_gpu"), "deepgram").when(failure == "model_loading_error", "deepgram")
    return special.when((failure == "network_error") & (method == "deepgram"), "error").otherwise(after.otherwise(chain[0]))


def even_word_times(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, word, start_time, end_time): the words of ``text`` spread evenly over ``duration`` from ``start_time``."""
    split = df.withColumn("_w", F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    each = split.select(*keys, F.col("start_time").alias("_s"), (F.col("duration") / F.size("_w")).alias("_d"), F.posexplode("_w").alias("i", "word"))
    return each.select(*keys, "i", "word", (F.col("_s") + F.col("i") * F.col("_d")).alias("start_time"), (F.col("_s") + (F.col("i") + 1) * F.col("_d")).alias("end_time"))


def stream_weights(audio: DataFrame, messages: DataFrame, keys: list[str], chat_intensity: float = 0.5, compat: bool = True) -> DataFrame:
    """(keys, audio_weight, chat_weight): busy chat and strong audio emotions shift the weights from 0.6 and 0.4.

    ``messages`` has the keys and ``messages``, their number. With ``compat`` the chat's own emotions count as
    ``chat_intensity``, and busy chat weighs for the audio, strong audio emotions for the chat; without it both shifts go
    the other way, as meant, and ``messages`` has ``chat_strength``, the mean of the strongest emotion of its windows.
    """
    clip = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    a = audio.groupBy(*keys).agg((F.max("end_time") - F.min("start_time")).alias("span"), F.avg(F.greatest(*EMOTIONS[:5])).alias("strength"))
    x = a.join(messages, keys, "left")
    rate = F.when(F.col("span") > 0, F.coalesce("messages", F.lit(0)) / (F.col("span") / 60)).otherwise(0.0)
    activity = clip((rate - 10) / 100, 0.0, 1.0)
    chat = F.lit(chat_intensity) if compat else F.coalesce("chat_strength", F.lit(chat_intensity))
    emotion = F.when((F.col("strength") > 0) & (chat > 0), clip((F.col("strength") / chat - 0.5) / 2, 0.0, 1.0)).otherwise(0.5)
    shift = (activity - emotion) * (0.2 if compat else -0.2)
    wa, wc = clip(0.6 + shift, 0.4, 0.8), clip(0.4 - shift, 0.2, 0.6)
    return x.select(*keys, (wa / (wa + wc)).alias("audio_weight"), (wc / (wa + wc)).alias("chat_weight"))


def downsample(samples: DataFrame, keys: list[str], order: list[str], piece: Column, value: str, n: int) -> DataFrame:
    """(keys, i, v): ``n`` evenly spaced rows of each series (repeated if it has fewer), over its greatest magnitude."""
    placed = running(samples, keys, order, piece, {"_x": F.lit(1).cast("long")}).withColumn("_x", F.col("_x") - 1)
    size = samples.groupBy(*keys).agg((F.count("*") - 1).alias("_last"), F.max(F.abs(value)).alias("_top"))
    wanted = size.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumn("_x", F.expr(f"i * _last DIV {n - 1}"))
    return placed.join(wanted, [*keys, "_x"]).select(*keys, "i", (F.col(value) / F.nullif(F.col("_top"), F.lit(0.0))).alias("v"))


def block_means(samples: DataFrame, keys: list[str], order: list[str], piece: Column, value: str, n: int) -> DataFrame:
    """(keys, block, v): mean magnitudes of ``n`` blocks of equally many rows of each series, over the greatest of them; what
    is left after the last whole block doesn't count."""
    placed = running(samples, keys, order, piece, {"_x": F.lit(1).cast("long")})
    size = samples.groupBy(*keys).agg(F.expr(f"greatest(1, count(*) DIV {n})").alias("_each"))
    blocks = placed.join(size, keys).withColumn("block", F.expr("(_x - 1) DIV _each")).where(F.col("block") < n).groupBy(*keys, "block").agg(F.avg(F.abs(value)).alias("v"))
    top = blocks.groupBy(*keys).agg(F.max("v").alias("_top"))
    return blocks.join(top, keys).select(*keys, "block", (F.col("v") / F.nullif(F.col("_top"), F.lit(0.0))).alias("v"))


def alert_counts(alerts: DataFrame) -> DataFrame:
    """(level, n, active): alerts by level, and those that aren't resolved."""
    return alerts.groupBy("level").agg(F.count("*").alias("n"), F.count_if(~F.coalesce("resolved", F.lit(False))).alias("active"))


def health_status(checks: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, status, issues): the worst level of the checks and those that are not well; a check's ``level`` may be null.
    A key without a named check is ``unknown``."""
    worst = F.max(F.when(F.col("level") == "critical", 2).when(F.col("level") == "warning", 1).otherwise(0))
    issue = F.when(F.col("level").isNotNull(), F.struct(F.col(name), F.col("level")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(issue)), lambda x: F.concat_ws(":", x[name].cast("string"), x["level"])), ",")
    known = F.count(F.col(name))
    status = F.when(known == 0, "unknown").when(worst == 2, "critical").when(worst == 1, "warning").otherwise("healthy")
    return checks.groupBy(*keys).agg(status.alias("status"), text.alias("issues"))
