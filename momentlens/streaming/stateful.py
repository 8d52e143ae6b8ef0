"""Streams with a state of their own, which ends with its recording or job: z-scores over the last minutes, updates that
differ from the last one kept, and what was seen within a time to live.

They need the RocksDB state store (``state_store``). Each key has one timer in event time; when the watermark has passed it,
the key's state is removed.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from momentlens.operators.windows import keep_updates
from momentlens.sources.shared import new_folder

#: Rows may come so much later than the last one seen, and a state is kept so long after its key's last row.
LATENESS, TTL_SECONDS = "15 seconds", 24 * 3600
#: Rows of a recording that are scored and sent on at a time.
SCORED = 50_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """Streams started inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def scaled_zscores(t: np.ndarray, x: np.ndarray, first: int, span: float) -> np.ndarray:
    """(z clipped to 3 + 3) / 6 of x[first:] over the values of the last ``span`` seconds, itself included; t ascends."""
    lo = np.searchsorted(t, t[first:] - span, "left")
    hi = np.searchsorted(t, t[first:], "right")
    mid = x.mean() if len(x) else 0.0
    one, two = (np.concatenate([[0.0], np.cumsum(y)]) for y in (x - mid, (x - mid) ** 2))
    n = hi - lo
    mean = (one[hi] - one[lo]) / n
    var = np.maximum((two[hi] - two[lo]) / n - mean**2, 0)
    few = n < 5
    std = np.where(few | (var < 1e-10), 1.0, np.sqrt(var))
    return (np.clip((x[first:] - np.where(few, 0.0, mean + mid)) / std, -3, 3) + 3) / 6


class _Ending(StatefulProcessor):
    """A state that is cleared when event time has gone on for ``ttl`` seconds after its key's last row."""

    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle):
        self.handle = handle
        self.open()

    def again(self, last: pd.Timestamp, timers) -> None:
        """The key's only timer, set anew after its last row; a watermark that is further on already ends it at once."""
        old = list(self.handle.listTimers())
        at = max([int(last.timestamp() * 1000 + self.ttl * 1000), *old])
        if old != [at]:
            for t in old:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(at, timers.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.clear()
        yield from ()

    def close(self):
        pass


class _Zscores(_Ending):
    def __init__(self, key, time, value, row, span, ttl):
        super().__init__(ttl)
        self.names, self.span = (key, time, value, row), span

    def open(self):
        self.seen = self.handle.getListState("seen", "t double, x double")

    def clear(self):
        self.seen.clear()

    def handleInputRows(self, key, rows, timerValues):
        name, time, value, row = self.names
        parts, last = [], None
        for pdf in rows:  # three columns stay of each part
            parts.append((pdf[time].to_numpy(float), pdf[value].to_numpy(float), pdf[row].to_numpy()))
            last = pdf["ts"].max() if last is None else max(last, pdf["ts"].max())
        at, x, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        order = np.lexsort((pd.factorize(ids, sort=True)[0] if ids.dtype == object else ids, at))
        at, x, ids = at[order], x[order], ids[order]
        del order
        old = np.array([tuple(v) for v in self.seen.get()], float).reshape(-1, 2) if self.seen.exists() else np.zeros((0, 2))
        t, x = np.concatenate([old[:, 0], np.maximum(at, old[-1, 0] if len(old) else -np.inf)]), np.concatenate([old[:, 1], x])
        keep = slice(int(np.searchsorted(t, t[-1] - self.span, "left")), None)
        self.seen.put(list(zip(t[keep].tolist(), x[keep].tolist(), strict=True)))
        self.again(last, timerValues)
        for i in range(0, len(at), SCORED):
            j = min(i + SCORED, len(at))
            # the rows of the span before the part's first row, up to the last one's peers
            a, b = np.searchsorted(t, t[len(old) + i] - self.span, "left"), np.searchsorted(t, t[len(old) + j - 1], "right")
            z = scaled_zscores(t[a:b], x[a:b], len(old) + i - a, self.span)[: j - i]
            yield pd.DataFrame({name: key[0], row: ids[i:j], time: at[i:j], "z": z})


def live_zscores(frames: DataFrame, key: str, time: str, value: str, row: str, span: float = 600.0, lateness: str = LATENESS, ttl: float = TTL_SECONDS) -> DataFrame:
    """(key, row, time, z) of a stream with an event time ``ts``; the state of a key is its values of the last ``span`` seconds.

    Rows without a time, value or event time are left out, and so are those that the watermark has passed. Within a
    micro-batch rows are in order of time; a row that comes after a later one has been seen is scored at the last time seen.
    """
    kind = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    whole = frames.where(F.col(time).isNotNull() & F.col(value).isNotNull() & F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    schema = f"{key} {kind[key]}, {row} {kind[row]}, {time} {kind[time]}, z double"
    return whole.select(key, row, time, value, "ts").groupBy(key).transformWithStateInPandas(_Zscores(key, time, value, row, span, ttl), schema, "append", "EventTime")


class _Updates(_Ending):
    def __init__(self, order, step, columns, ttl):
        super().__init__(ttl)
        self.order, self.step, self.columns = order, step, columns

    def open(self):
        self.last = self.handle.getValueState("last", "progress double, stage string, since long")

    def clear(self):
        self.last.clear()

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(rows).sort_values(self.order)
        keep, last = keep_updates(pdf["progress"], pdf["stage"], self.step, tuple(self.last.get()) if self.last.exists() else None)
        self.last.update(last)
        self.again(pdf["ts"].max(), timerValues)
        yield pdf.loc[keep, self.columns]


def live_updates(updates: DataFrame, key: str, order: str, step: float = 0.1, lateness: str = LATENESS, ttl: float = TTL_SECONDS) -> DataFrame:
    """The updates of a stream with an event time ``ts`` that ``meaningful_updates`` keeps; the state of a job is the last one
    kept and how many came since. The result has the columns of ``updates`` without ``ts``."""
    columns = [c for c in updates.columns if c != "ts"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in updates.schema.fields if f.name != "ts")
    timed = updates.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(key).transformWithStateInPandas(_Updates(order, step, columns, ttl), schema, "append", "EventTime")


class _Retained(_Ending):
    def __init__(self, key, ttl, bucket):
        super().__init__(ttl)
        self.key, self.bucket = key, bucket

    def open(self):
        self.counts = self.handle.getMapState("counts", "bucket long", "n long")

    def clear(self):
        self.counts.clear()

    def handleInputRows(self, key, rows, timerValues):
        ts = pd.concat(rows)["ts"]
        us = np.floor_divide(ts.to_numpy("datetime64[us]").astype(np.int64), int(self.bucket * 1e6))
        for b, n in zip(*np.unique(us, return_counts=True), strict=True):
            old = self.counts.getValue((int(b),))[0] if self.counts.containsKey((int(b),)) else 0
            self.counts.updateValue((int(b),), (int(old + n),))
        held = {k[0]: v[0] for k, v in self.counts.iterator()}
        last = max(held)
        gone = last - int(self.ttl / self.bucket)
        for b in [b for b in held if b <= gone]:
            self.counts.removeKey((b,))
            del held[b]
        self.again(ts.max(), timerValues)
        yield pd.DataFrame({self.key: [key[0]], "as_of": [float(last * self.bucket)], "n": [sum(held.values())]})


def live_retained(rows: DataFrame, key: str, ttl: float, bucket: float = 60.0, lateness: str = LATENESS) -> DataFrame:
    """(key, as_of, n) after each micro-batch: how many rows of a stream are not older than ``ttl`` seconds.

    Time goes on in steps of ``bucket`` seconds, of which the state holds one count each; counts older than the time to live
    are removed, and the whole state of a key that has had no rows for as long.
    """
    kind = rows.schema[key].dataType.simpleString()
    timed = rows.where(F.col("ts").isNotNull()).select(key, F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", lateness)
    return timed.groupBy(key).transformWithStateInPandas(_Retained(key, ttl, bucket), f"{key} {kind}, as_of double, n long", "append", "EventTime")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all that is there now: it is run to the end into a table of the shared folder, which is read."""
    spark = stream.sparkSession
    path = new_folder(spark, name)
    with state_store(spark):
        q = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``events`` as a stream of files, one or many."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
