"""The joins over all windows, frames and texts; catalog tests hold their queries to the SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentlens import catalog
from momentlens.operators import intervals, scorers, windows

SF = "/root/testdata/sf0.001"


def test_windows_without_a_point_are_kept(spark):
    points = spark.createDataFrame([(1, 5.0, 7), (1, 90.0, 8)], "video_id long, time double, event_id long")
    windows = spark.createDataFrame([(1, 1, 0.0, 60.0), (2, 1, 300.0, 360.0), (3, 2, 0.0, 60.0)], "window_id long, video_id long, start_time double, end_time double")
    got = intervals.point_in_interval_join(points, windows, ["video_id"], how="left")
    assert sorted((r.window_id, r.end_time, r.event_id or 0) for r in got.collect()) == [(1, 60.0, 7), (2, 360.0, 0), (3, 60.0, 0)]


def test_all_windows_and_frames_are_answered(spark):
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert {catalog.queries()[name](spark, SF).count() for name in ("j2_all_windows", "j5_all_frames")} == {n}


def test_a_key_is_asked_for_once_and_joined_back(spark, tmp_path):
    folder = str(tmp_path)

    def ask(texts):
        import uuid

        for x in texts:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(x)
        return [f"funny: 0.{len(x)}" for x in texts]

    rows = spark.createDataFrame([(1, "ab cd x"), (2, "ab cd yy"), (3, "zz top"), (4, None)], "id long, text string").repartition(3)
    got = {r.id: (r.model, r.funny) for r in scorers.score_distinct(rows, F.substring("text", 1, 5), [("m", ask)]).collect()}
    assert got == {1: ("m", 0.7), 2: ("m", 0.7), 3: ("m", 0.6), 4: ("short", 0.0)}
    assert sorted(f.read_text() for f in tmp_path.iterdir()) == ["ab cd x", "zz top"]


@pytest.mark.parametrize("points", [False, True])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_sums_over_overlaps_equal_brute_force(spark, points, how):
    rng = np.random.default_rng(7)
    side = lambda n: [(int(k) if k < 2 else None, i, float(s), float(s + d)) for i, (k, s, d) in enumerate(zip(rng.integers(0, 3, n), rng.integers(-20, 50, n), rng.integers(-3, 20, n), strict=True))]
    a, b = side(80), side(80)
    if points:
        b = [(k, i, s, s) for k, i, s, _ in b]
    odd = {3: float("nan"), 4: float("inf"), 5: float("-inf"), 6: None}
    value = lambda i: odd.get(i, i / 8)
    left = spark.createDataFrame(a, "k int, id int, start_time double, end_time double")
    right = spark.createDataFrame([(k, i, s, e, value(i)) for k, i, s, e in b], "k int, b long, r_start double, r_end double, v double")
    want = {}
    for k, i, s, e in a:
        near = [y for y in b if k is not None and k == y[0] and s <= e and y[2] <= y[3] and s <= y[3] and y[2] <= e]
        if near or how == "left":
            v = [value(y[1]) for y in near if value(y[1]) is not None]
            want[i] = (len(near), sum(y[1] for y in near) if near else None, str(sum(v)) if v else None)
    names = ("start_time", "end_time", "r_start", "r_start" if points else "r_end")
    got = windows.overlap_sums(left, right, ["k"], ["id"], ["b", "v"], names, 7.0, how)
    assert {r.id: (r.n, r.b, None if r.v is None else str(r.v)) for r in got.collect()} == want


@pytest.mark.parametrize("name", ["j1_interval_join", "j2_point_in_interval", "j2_all_windows"])
def test_overlaps_of_all_rows_with_all_make_no_pairs(spark, tmp_path, name):
    n = 20_000  # all in one window of one recording: 400 million pairs
    stamp = F.timestamp_millis(F.lit(1704067200000) + F.col("id")).cast("timestamp_ntz")
    spark.range(n).select(F.col("id").alias("event_id"), stamp.alias("ts"), (F.col("id") * 10).alias("user_id"), F.lit("click").alias("event_type"), F.lit(500.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    frame = catalog.queries()[name](spark, str(tmp_path))
    assert "_bin" not in frame._jdf.queryExecution().toString()
    got = frame.agg({"n": "sum"}).first()[0]
    assert got == (n * n if name.startswith("j1") else n * (n + 1) // 2)
