"""Live percentiles: histograms of each micro-batch, written once a batch id, merged over the windows that it touched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from momentlens.operators.telemetry import THRESHOLDS

#: Floor-index percentiles of a window, as those of a metric over the last minutes.
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
#: Values are told apart by this much; what lies on this grid gets exact percentiles.
GRID = 1e-4


def histogram(rows: DataFrame, key: str, value: str, seconds: int, grid: float = GRID) -> DataFrame:
    """(key, start_second, bin, n, total): how often each value of the grid occurs in each window. Rows without a value or a
    time are left out. Histograms of parts of the rows add up to that of all."""
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000)) * seconds
    found = rows.where(F.col(value).isNotNull() & F.col("ts").isNotNull())
    cells = found.groupBy(key, start.cast("long").alias("start_second"), F.round(F.col(value) / grid).cast("long").alias("bin"))
    return cells.agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def window_summary(histograms: DataFrame, key: str, grid: float = GRID, qs: dict[str, float] | None = None) -> DataFrame:
    """(key, start_second, n, least, most, mean, percentiles) of merged histograms.

    A percentile is the value of index floor(n q) of a window's sorted values, found by the running count over its bins,
    of which there are no more than the range of its values holds steps of the grid.
    """
    qs = PERCENTILES if qs is None else qs
    by = [key, "start_second"]
    merged = histograms.groupBy(*by, "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    line = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumns({"_till": F.sum("n").over(line), "_all": F.sum("n").over(Window.partitionBy(*by))})
    value = lambda c: c * F.lit(grid)
    at = {name: F.min(F.when(F.col("_till") > F.floor(F.col("_all") * q), F.col("bin"))) for name, q in qs.items()}
    sums = ranked.groupBy(*by).agg(F.sum("n").alias("n"), value(F.min("bin")).alias("least"), value(F.max("bin")).alias("most"), (F.sum("total") / F.sum("n")).alias("mean"), *[value(v).alias(k) for k, v in at.items()])
    return sums


def latency_level(summary: DataFrame, warn: float = THRESHOLDS["response_time_p95"][0], critical: float = THRESHOLDS["response_time_p95"][1], least: int = 20) -> DataFrame:
    """Adds ``level``: by the 95th percentile of windows of ``least`` values or more."""
    enough = F.col("n") >= least
    p95 = F.round("p95", 9)
    return summary.withColumn("level", F.when(enough & (p95 >= critical), "critical").when(enough & (p95 >= warn), "warning").otherwise("ok"))


def _batch_into(path: str, key: str, value: str, seconds: int, grid: float):
    """What a micro-batch does: its histogram replaces that of the same batch id, window by window, and the windows that it
    touched are summed up again from the histograms of all batches. Run twice, it leaves what it left the first time."""

    def once(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        made = histogram(batch, key, value, seconds, grid).withColumn("batch", F.lit(batch_id))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("start_second", "batch").parquet(f"{path}/histograms")
        every = spark.read.schema(made.schema).parquet(f"{path}/histograms")
        touched = [r[0] for r in every.where(F.col("batch") == batch_id).select("start_second").distinct().collect()]  # as many as the batch's time span has
        if touched:
            whole = every.where(F.col("start_second").isin(touched) & (F.col("batch") <= batch_id))
            summary = latency_level(window_summary(whole, key, grid))
            summary.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/levels/batch_id={batch_id}")

    return once


def live_latency(requests: DataFrame, path: str, key: str = "endpoint", value: str = "duration", seconds: int = 3600, grid: float = GRID, available_now: bool = False) -> StreamingQuery:
    """Starts a stream that keeps ``path`` (in a shared folder) up to date; ``latency_levels`` reads it.

    Each batch rewrites the summaries of the windows that it touched. Late rows count however late they are: a window's
    histograms stay. A batch that is replayed after a failure replaces what it wrote before.
    """
    writer = requests.writeStream.foreachBatch(_batch_into(path, key, value, seconds, grid)).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latency_levels(spark: SparkSession, path: str) -> DataFrame:
    """The last summary of each window: key, start_second, n, least, most, mean, percentiles and level."""
    every = spark.read.parquet(f"{path}/levels").drop("batch_id")
    key = every.columns[0]
    rest = [c for c in every.columns if c not in (key, "start_second", "batch")]
    last = every.groupBy(key, "start_second").agg(F.max_by(F.struct(*rest), "batch").alias("_x"))
    return last.select(key, "start_second", "_x.*")
