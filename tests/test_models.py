"""Scorers, stateful streams against the same operators as batches, and paragraphs by rules."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from momentlens import catalog
from momentlens.operators import scorers as R
from momentlens.operators import telemetry as M
from momentlens.operators import chains as K
from momentlens.streaming import stateful as V

SF = "/root/testdata/sf0.001"


def test_paragraphs_begin_where_a_rule_says(spark):
    texts = [(0, 1, "one"), (1, 2, " "), (1.5, 3, "two?"), (3, 4, "So three"), (5, 6, "four"), (6, 7, "However, five"), (7, 26.5, "six"), (26.5, 27, None), (26.6, 26.9, "so seven")]
    rows = spark.createDataFrame([("v", float(a), float(b), t) for a, b, t in texts] + [("w", float(i), i + 1.0, f"s{i}") for i in range(8)], "k string, start_time double, end_time double, text string")
    got = {(r.k, r.paragraph): r.text for r in K.paragraphs_by_rules(rows, ["k"]).collect()}
    assert got == {("v", 0): "one two?", ("v", 1): "So three", ("v", 2): "four", ("v", 3): "However, five", ("v", 4): "six so seven", ("w", 0): "s0 s1 s2 s3 s4 s5", ("w", 1): "s6 s7"}


def test_a_failing_model_is_followed_by_the_next(spark):
    def down(texts):
        raise OSError

    asked = spark.createDataFrame([(1, "a b"), (2, None), (3, "word"), (4, "c  d"), (5, "c d")], "id int, text string")
    got = {r.id: (r.model, r.highlight, r.neutral) for r in R.score_texts(asked, (("x", down), ("y", lambda ts: ["highlight: 2" if t == "a b" else None for t in ts]))).collect()}
    assert got == {1: ("y", 1.0, 0.0), 2: ("short", 0.0, 1.0), 3: ("short", 0.0, 1.0), 4: ("default", 0.2, 0.7), 5: ("default", 0.2, 0.7)}


@pytest.mark.parametrize("most", [200_000, 60])
def test_a_classifier_tells_what_it_was_taught(spark, most):
    rows = [(f"good {w} fine {i}", 1) if i % 2 else (f"bad {w} poor {i}", 0) for i in range(120) for w in ("cat",)]
    taught = spark.createDataFrame([*rows, (None, 0), ("unlabelled", None)], "text string, label int")
    p = R.classify(R.fit_classifier(taught, most_rows=most), spark.createDataFrame([("good fine",), ("bad poor",), (None,)], "text string")).collect()
    assert p[0].probabilities[1] > 0.5 > p[1].probabilities[1] and len(p) == 3


@pytest.fixture(scope="module")
def in_parts(spark, tmp_path_factory):
    """The events as six files in order of time, each a micro-batch."""
    src = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet(f"{SF}/events.parquet")
    n = events.count()
    from pyspark.sql import Window

    ordered = events.withColumn("_n", F.row_number().over(Window.orderBy("ts", "event_id")))
    for i in range(6):
        ordered.where((F.col("_n") > n * i // 6) & (F.col("_n") <= n * (i + 1) // 6)).drop("_n").coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_live_zscores_over_many_batches_equal_the_window(spark, in_parts):
    from momentlens.sources import adapters as A

    frames = A.frames_of(in_parts).withColumn("ts", F.timestamp_millis((F.lit(1704067200000) + F.round(F.col("t") * 100000)).cast("long")))
    got = V.drained(V.live_zscores(frames, "video_id", "t", "rms", "event_id"), "z")
    want = catalog.queries()["w5_rolling_zscore"](spark, SF)
    both = got.join(want.withColumnRenamed("z", "w"), ["video_id", "event_id"])
    assert both.count() == want.count() and both.where("abs(z - w) > 1e-3").count() == 0


@pytest.mark.parametrize("scored", [1, 7, 1000])
def test_scores_of_a_recording_are_sent_in_parts(monkeypatch, scored):
    """Parts of any size, with peers over their ends and a state from before, are scored as the whole."""
    monkeypatch.setattr(V, "SCORED", scored)
    rng = np.random.default_rng(1)
    made = V._Zscores("k", "t", "x", "id", 20.0, 1.0)
    state = [(float(t), float(t % 3)) for t in range(-15, 0)]
    made.seen = SimpleNamespace(exists=lambda: True, get=lambda: iter(state), put=lambda v: kept.extend(v))
    made.again, kept = lambda *a: None, []
    pdf = pd.DataFrame({"id": np.arange(90), "t": rng.integers(-3, 60, 90).astype(float), "x": rng.normal(size=90), "ts": pd.Timestamp(0)})
    parts = list(made.handleInputRows(("a",), iter([pdf[:40], pdf[40:]]), None))
    rows = pdf.sort_values(["t", "id"])
    t, x = np.concatenate([[s[0] for s in state], np.maximum(rows.t, -1.0)]), np.concatenate([[s[1] for s in state], rows.x])
    got = pd.concat(parts)
    assert max(map(len, parts)) <= scored and got.id.tolist() == rows.id.tolist() and got.t.tolist() == rows.t.tolist()
    assert np.allclose(got.z, V.scaled_zscores(t, x, len(state), 20.0)) and kept == [(a, b) for a, b in zip(t, x, strict=True) if a >= t[-1] - 20]


def test_live_updates_equal_the_batch(spark, in_parts):
    from momentlens.plans.models import _updates

    live = V.live_updates(_updates(in_parts), "job_id", "event_id")
    got, want = V.drained(live, "u").withColumn("progress", F.round(F.col("progress") + 1e-9, 6)), catalog.queries()["w22_meaningful_updates"](spark, SF)
    one = catalog.queries()["r6_live_updates"](spark, SF)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, want.collect()))
    ordered = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").select("event_id").toPandas().event_id
    if ordered.is_monotonic_increasing:  # else parts in order of time aren't in order of event_id
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 0


def test_the_state_of_an_ended_recording_goes(spark, tmp_path):
    """Three recordings, of which two end; rows of state after each batch, and a recording that comes again begins anew."""
    batches = [[("a", i, i / 1.0, 1.0 + i, 0) for i in range(6)] + [("b", 100, 3.0, 1.0, 1), ("c", 101, 3.0, 1.0, 1)], [("c", 200, 5000.0, 2.0, 5000)], [("c", 201, 9000.0, 2.0, 9000)], [("c", 300, 9001.0, 2.0, 9001), ("a", 301, 9001.0, 7.0, 9001)]]
    schema = "k string, id long, t double, x double, at long"
    src = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).withColumn("ts", F.timestamp_seconds(F.col("at") + 86400))
    with V.state_store(spark):
        live = V.live_zscores(stream, "k", "t", "x", "id", 600.0, "10 seconds", ttl=1000.0)
        q = live.writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    got = {r.id: r.z for r in spark.table("ended").collect()}
    assert len(got) == sum(map(len, batches))
    # with rows of a, b and c there is more state than when only c goes on
    assert held[-1] < held[0] and min(held) < held[0]
    # a row of a recording that had ended is scored as a first one: 7 is clipped to 3
    assert got[301] == 1.0


def test_counts_within_a_time_to_live(spark, tmp_path):
    schema = "k string, at long"
    src = str(tmp_path / "in")
    for rows in ([("a", 0), ("a", 30), ("b", 10)], [("a", 400), ("a", 410)], [("a", 1000)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src).withColumn("ts", F.timestamp_seconds(F.col("at") + 86400))
    got = V.drained(V.live_retained(stream, "k", 600.0), "retained").collect()
    assert sorted((r.k, r.as_of - 86400, r.n) for r in got) == [("a", 0.0, 2), ("a", 360.0, 4), ("a", 960.0, 1), ("b", 0.0, 1)]


def test_a_replayed_batch_changes_nothing(spark, in_parts, tmp_path):
    """Six batches equal one, and a batch that comes again with the same id leaves what was there."""
    from momentlens.streaming import latency

    def rows(events):
        return events.select("ts", (F.col("user_id") % 20).alias("endpoint"), (F.col("value") / 100 * 3).alias("duration"))

    many, one = f"file://{tmp_path}/many", f"file://{tmp_path}/one"
    latency.live_latency(rows(in_parts), many, seconds=6 * 3600, available_now=True).awaitTermination(300)
    whole = rows(spark.read.parquet(f"{SF}/events.parquet"))
    latency._batch_into(one, "endpoint", "duration", 6 * 3600, latency.GRID)(whole, 0)
    table = lambda path: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in latency.latency_levels(spark, path).collect())
    want = table(one)
    assert len(want) > 50 and table(many) == want
    first = spark.read.parquet(f"{many}/histograms").agg(F.sum("n")).first()[0]
    assert first == whole.where("duration IS NOT NULL").count()
    latency._batch_into(one, "endpoint", "duration", 6 * 3600, latency.GRID)(whole, 0)
    assert table(one) == want and spark.read.parquet(f"{one}/histograms").agg(F.sum("n")).first()[0] == first


def test_percentiles_of_merged_histograms_are_by_floor_index(spark):
    import numpy as np

    from momentlens.streaming import latency

    rng = np.random.default_rng(2)
    data = {k: (rng.integers(0, 50_000, n) / 10_000).tolist() for k, n in (("one", 1), ("two", 2), ("some", 20), ("many", 700))}
    rows = spark.createDataFrame([(k, v, 5) for k, x in data.items() for v in x] + [("many", None, 5), ("many", 1.0, None)], "name string, v double, at long").withColumn("ts", F.timestamp_seconds("at"))
    halves = [latency.histogram(rows.where(F.expr(w)), "name", "v", 60) for w in ("v < 2.5", "v >= 2.5")]
    got = {r.name: r for r in latency.latency_level(latency.window_summary(halves[0].unionByName(halves[1]), "name"), 4.0, 4.9).collect()}
    for k, x in data.items():
        x = sorted(x)
        want = [x[int(len(x) * q)] for q in (0.5, 0.9, 0.95, 0.99)]
        assert np.allclose([got[k].p50, got[k].p90, got[k].p95, got[k].p99], want) and got[k].n == len(x) and np.isclose(got[k].mean, np.mean(x))
        assert got[k].level == ("ok" if len(x) < 20 or want[2] < 4 else "critical" if want[2] >= 4.9 else "warning")


def test_hybrid_methods(spark):
    rows = spark.createDataFrame([(3600.0,), (9000.0,), (18000.0,)], "d double")
    got = rows.select(M.transcription_cost(F.col("d"), F.lit("hybrid")).alias("c"), M.processing_time(F.col("d"), F.lit("hybrid")).alias("t")).collect()
    assert [round(r.c, 6) for r in got] == [0.03125, 0.048125, 0.723125] and [r.t for r in got] == [90.0, 225.0, 225.0]


def test_reactions_of_two_streams_equal_the_batch(spark, in_parts):
    from momentlens.streaming import live

    def joined(events):
        e = events.select("event_id", "event_type", (F.col("user_id") % 10).alias("video_id"), F.col("ts").cast("timestamp").alias("ts"))
        seen = e.where("event_type = 'view'").select("video_id", F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("end_ts"))
        return live.reactions(e.drop("event_type"), seen)

    got, want = V.drained(joined(in_parts), "r"), joined(spark.read.parquet(f"{SF}/events.parquet"))
    assert want.count() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_segments_without_reactions_come_when_the_watermark_passes(spark, in_parts):
    """The outer join of two streams against the left join of whole tables, of segments that the last watermark has passed."""
    from momentlens.streaming import live

    def sides(events):
        e = events.select("event_id", "event_type", (F.col("user_id") % 10).alias("video_id"), F.col("ts").cast("timestamp").alias("ts"))
        seen = e.where("event_type = 'view'").select("video_id", F.col("ts").alias("start_ts"), (F.col("ts") + F.expr("INTERVAL 25 MINUTES")).alias("end_ts"))
        return e.where("event_type = 'purchase'").select("video_id", "event_id", "ts"), seen

    got = V.drained(live.reactions(*sides(in_parts), how="left"), "r").groupBy("video_id", "start_ts").agg(F.count("event_id").alias("n"), F.count("*").alias("rows"))
    m, s = sides(spark.read.parquet(f"{SF}/events.parquet"))
    near = (m.video_id == s.video_id) & (m.ts >= s.start_ts) & (m.ts <= s.end_ts + F.expr("INTERVAL 15 SECONDS"))
    want = s.join(m, near, "left").groupBy(s.video_id, "start_ts").agg(F.count("event_id").alias("n"))
    last = spark.read.parquet(f"{SF}/events.parquet").agg(F.max("ts")).first()[0]
    have = {(r.video_id, r.start_ts): (r.n, r.rows) for r in got.collect()}
    wanted = {(r.video_id, r.start_ts): r.n for r in want.collect()}
    passed = {k: n for k, n in wanted.items() if (last - k[1]).total_seconds() > 7200}
    assert sum(n == 0 for n in passed.values()) > 20 and any(passed.values())
    assert {k: have[k][0] for k in passed} == passed
    assert all(have[k][1] >= 3 for k in passed)  # three slices each
    # a message at the border of two slices is in one of them, and long segments lose none
    batch = live.reactions(m, s).groupBy("video_id", "start_ts").agg(F.count("*").alias("n"))
    assert {(r.video_id, r.start_ts): r.n for r in batch.collect()} == {k: n for k, n in wanted.items() if n}


def test_classifiers_tell_classes_apart_on_rows_held_out(spark):
    """The mean recall of the classes, where most rows are of one class, against that of a guess."""
    from momentlens.plans import models

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    for label in (models.EMOTION_LABEL, models.HIGHLIGHT_LABEL, "quality"):
        rows = docs.select("doc_id", "text", F.expr(label).alias("label")).where("label IS NOT NULL")
        held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
        model = R.fit_classifier(rows.where(~held))
        found = R.classify(model, rows.where(held)).select("label", F.expr("array_position(probabilities, array_max(probabilities)) - 1").alias("got")).toPandas()
        recall = (found.label == found.got).groupby(found.label).mean()
        print(label, (found.label == found.got).mean(), recall.mean())
        assert len(found) > 50 and recall.mean() > 1.3 / len(recall)


def test_prompts_name_the_keys_and_unknown_measures(spark):
    null = F.lit(None).cast("double")
    text = spark.range(1).select(R.prompt_of(F.lit("so it is"), null, F.lit(0.125), F.lit(1.0)).alias("p")).first().p
    assert text.endswith("Text: so it is") and "Words a second: unknown; loudness: 0.12; " in text and "highlight" in text
