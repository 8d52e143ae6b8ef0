"""Series operators against plain loops: trailing and running sums, smoothing, peaks and paragraphs, over many bins."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentlens import catalog
from momentlens.operators import chains as K
from momentlens.operators import intervals as J
from momentlens.operators import peaks as P
from momentlens.operators import selection as Q
from momentlens.operators import telemetry as M
from momentlens.operators import windows as W
from momentlens.streaming import stateful as V

RNG = np.random.default_rng(11)


def _series(n, keys=2, ties=True):
    t = RNG.integers(0, 4 * n, n) / (2 if ties else 1)
    return [(int(k), i, float(a), float(v)) for i, (k, a, v) in enumerate(zip(RNG.integers(0, keys, n), t, RNG.normal(size=n), strict=True))]


@pytest.fixture(scope="module")
def rows(spark):
    data = _series(600)
    return data, spark.createDataFrame(data, "k int, id int, t double, v double").cache()


@pytest.mark.parametrize("span", [7.0, 60.0, 5000.0])
def test_trailing_sums(rows, span):
    data, df = rows
    got = {r.id: r for r in W.trailing(df, ["k"], "id", "t", "v", span).collect()}
    for k, i, t, _ in data:
        mine = [x[3] for x in data if x[0] == k and t - span <= x[2] <= t]
        assert got[i].n == len(mine) and math.isclose(got[i].sum, sum(mine), abs_tol=1e-9) and math.isclose(got[i].squares, sum(x * x for x in mine), abs_tol=1e-9)


def test_running_sums_and_the_row_before(rows):
    data, df = rows
    got = {r.id: r for r in W.running(df, ["k"], ["t", "id"], F.floor(F.col("t") / 100), {"total": F.col("v"), "row": F.lit(1)}, {"old": F.col("v")}).collect()}
    for k in (0, 1):
        total, old = 0.0, None
        for row, (_, i, _, v) in enumerate(sorted((x for x in data if x[0] == k), key=lambda x: (x[2], x[1])), 1):
            total += v
            assert math.isclose(got[i].total, total, abs_tol=1e-9) and got[i].row == row and got[i].old == old
            old = v


@pytest.mark.parametrize("fan", [1, 3, 1024])
@pytest.mark.parametrize("levels", [0, 1, 3])
def test_sums_and_rows_before_over_levels_of_pieces(spark, monkeypatch, fan, levels):
    """Pieces with gaps, below 0 too, with missing values; every level gives what a plain loop gives."""
    monkeypatch.setattr(W, "FAN", fan)
    rng = np.random.default_rng(fan + levels)
    data = [(int(k), i, int(t), None if v < 0.3 else float(v), None if v > 0.8 else f"s{i % 3}") for i, (k, t, v) in enumerate(zip(rng.integers(0, 2, 200), rng.integers(-900, 900, 200), rng.random(200), strict=True))]
    df = spark.createDataFrame(data, "k int, id int, t long, v double, s string")
    got = {r.id: r for r in W.earlier(df, ["k"], ["t", "id"], F.floor(F.col("t") / 7), {"total": F.col("v")}, {"old": F.col("s")}, levels).collect()}
    whole = {r.id: r.total for r in W.running(df, ["k"], ["t", "id"], F.floor(F.col("t") / 7), {"total": F.col("v")}).collect()}
    assert len(got) == len(data)
    for k in (0, 1):
        total, old = None, None
        for _, i, _, v, state in sorted((x for x in data if x[0] == k), key=lambda x: (x[2], x[1])):
            assert got[i].old == old and (got[i].total is None) == (total is None) and math.isclose(got[i].total or 0, total or 0, abs_tol=1e-9)
            total, old = total if v is None else (total or 0) + v, state
            assert (whole[i] is None) == (total is None) and math.isclose(whole[i] or 0, total or 0, abs_tol=1e-9)


@pytest.mark.parametrize("fan", [1, 3, 1024])
def test_values_carried_over_levels_of_empty_bins(spark, monkeypatch, fan):
    monkeypatch.setattr(J, "FAN", fan)
    rng = np.random.default_rng(fan)
    data = [(int(k), i, float(t), float(i) if x < 0.1 else None) for i, (k, t, x) in enumerate(zip(rng.integers(0, 2, 300), rng.integers(-3000, 3000, 300), rng.random(300), strict=True))]
    got = {r.i: r for r in J.neighbours(spark.createDataFrame(data, "k int, i int, t double, v double"), ["k"], "t", "v", 5.0).collect()}
    for k, i, t, _ in data:
        points = [(x[2], x[3]) for x in data if x[0] == k and x[3] is not None]
        past, future = [x for x in points if x[0] <= t], [x for x in points if x[0] >= t]
        assert (tuple(got[i].before) if got[i].before else None) == max(past, default=None)
        assert (tuple(got[i].after) if got[i].after else None) == min(future, default=None)


def test_transitions_and_notifications_over_blocks(spark):
    """A long series, whose blocks are many; no window of either is partitioned by the key alone."""
    n = 3 * W.BLOCK
    states = [None if i % 17 == 0 else "abc"[i // 5 % 3] for i in range(n)]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(states)] + [(2, W.BLOCK * 9, "z")], "k int, i long, stage string")
    told = W.transitions(df, ["k"], "i", "stage")
    got = {(r.k, r.i): r.transition for r in told.collect()}
    assert len(got) == n + 1 and got[2, W.BLOCK * 9] is None
    for i in range(n):
        pair = None if i == 0 or None in (states[i - 1], states[i]) else f"{states[i - 1]} -> {states[i]}"
        assert got[1, i] == pair
    kept = W.notifications(df.withColumn("percent", F.lit(1)), ["k"], "i", ("z",))
    assert {r.i for r in kept.where("k = 1").collect()} == {i for i in range(n) if states[i] != (states[i - 1] if i else None)}


@pytest.mark.parametrize("width", [1, 2, 15, 400])
def test_exponential_smoothing_over_many_blocks(rows, width):
    data, df = rows
    got = {r.id: r.smoothed for r in W.smooth_exponential(df, ["k"], ["t", "id"], "v", F.floor(F.col("t") / 100), width).collect()}
    a = 2 / (width + 1)
    for k in (0, 1):
        y = None
        for _, i, _, v in sorted((x for x in data if x[0] == k), key=lambda x: (x[2], x[1])):
            y = v if y is None else a * v + (1 - a) * y
            assert math.isclose(got[i], y, abs_tol=1e-9)
    assert len(got) == len(data)


def _peaks(x, height, distance, prominence):
    """Local maxima by the definitions, one by one."""
    n, found, i = len(x), [], 1
    while i < n - 1:
        j = i
        while j + 1 < n and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < n and x[j + 1] < x[i]:
            found.append((i + j) // 2)
        i = j + 1
    found = [p for p in found if x[p] >= height]
    kept = set(found)
    for p in sorted(found, key=lambda p: (x[p], p), reverse=True):
        if p in kept:
            kept -= {q for q in kept if q != p and abs(p - q) < distance}
    out = []
    for p in sorted(kept):
        a = p
        while a > 0 and x[a - 1] <= x[p]:
            a -= 1
        b = p
        while b < n - 1 and x[b + 1] <= x[p]:
            b += 1
        prom = x[p] - max(min(x[a : p + 1]), min(x[p : b + 1]))
        if prom >= prominence:
            out.append((p, prom))
    return out


@pytest.mark.parametrize(("size", "chunk", "fan"), [(3, 2, 2), (16, 1, 4), (4096, 256, 256)])
def test_peaks_equal_the_definitions_over_many_chunks(spark, size, chunk, fan):
    """Plateaus over block ends, rising chains over chunk ends, prominences over several levels of the tree."""
    rng = np.random.default_rng(size)
    series = {k: (rng.integers(0, 8, rng.integers(0, 90)) / 4.0).tolist() for k in range(12)}
    series[20] = [float(i % 2 * (1 + i)) for i in range(120)]  # ever higher peaks
    series[21] = [0.0, *[1.0] * 50, 0.0, 2.0, 2.0]
    series[22] = [float(v) for v in np.abs(np.sin(np.arange(100) / 3)).round(1)]
    df = spark.createDataFrame([(k, float(i), v) for k, x in series.items() for i, v in enumerate(x)], "k int, t double, v double")
    distance, height, prominence = 4, 0.5, 0.5
    got = P.peak_moments(df, ["k"], "t", "v", (distance, prominence, height), None, F.floor(F.col("t") / 10), size, chunk, fan).collect()
    want = {(k, float(p), round(prom, 9)) for k, x in series.items() for p, prom in _peaks(x, height, distance, prominence)}
    assert len(got) == len(want) and {(r.k, r.t, round(r.prominence, 9)) for r in got} == want


@pytest.mark.parametrize("profile", P.PROFILES)
def test_peak_profiles(spark, profile):
    x = np.abs(RNG.normal(size=300)).round(3)
    df = spark.createDataFrame([("a", float(i), float(v)) for i, v in enumerate(x)] + [("flat", float(i), 1.0) for i in range(9)] + [("null", 0.0, None), (None, 0.0, 1.0)], "k string, t double, v double")
    found = P.peak_moments(df, ["k"], "t", "v", profile, piece=F.floor(F.col("t") / 40), size=32, chunk=2, fan=8).orderBy("rank").collect()
    got = [(r.t, r.prominence) for r in found if r.k == "a"]
    gap, prominence, height = P.PROFILES[profile]
    want = _peaks(x.tolist(), float(np.percentile(x, 60)) if height is None else height, gap or 15, prominence)
    want = sorted(want, key=lambda p: (-x[p[0]], p[0]))[:10]
    assert [t for t, _ in got] == [float(p) for p, _ in want] and np.allclose([p for _, p in got], [p for _, p in want])
    assert sum(r.k == "flat" for r in found) == (9 if profile == "adaptive" else 0) and {r.k for r in found} <= {"a", "flat"}


def test_only_the_ends_of_plateaus_are_looked_up(spark, monkeypatch):
    """Rows see the values beside them in their piece, over empty pieces too; runs of one row aren't moved to tell peaks."""
    at = [0, 1, 2, 3, 50, 51, 52, 9000, 9001]
    values = [1.0, 3.0, 2.0, 4.0, 4.0, 4.0, 0.5, 6.0, 5.0]
    df = spark.createDataFrame([("a", float(t), v) for t, v in zip(at, values, strict=True)], "k string, t double, v double")
    series = P.numbered_series(df, ["k"], "t", "v", F.floor(F.col("t") / 2))
    got = [(r.row, r.old, r.v, r.new) for r in series.orderBy("row").collect()]
    assert got == [(i, values[i - 1] if i else None, v, values[i + 1] if i < 8 else None) for i, v in enumerate(values)]
    moved = []
    made = P.neighbours
    monkeypatch.setattr(P, "neighbours", lambda d, *a: moved.append(d.count()) or made(d, *a))
    assert sorted((r["at"], r.v) for r in P.plateau_peaks(series, ["k"], "v", 4).collect()) == [(1, 3.0), (4, 4.0), (7, 6.0)]
    assert moved == [2]


def test_no_rows_have_no_peaks(spark):
    df = spark.createDataFrame([], "k string, t double, v double")
    assert P.peak_moments(df, ["k"], "t", "v").count() == 0 and P.peak_moments(df, ["k"], "t", "v", "adaptive").count() == 0


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "gap", "prominence", "height", "k"), [("w12_find_peaks", 15, 0.35, 0.25, None), ("w13_peak_moments", 15, 0.25, 0.35, 10), ("w13_legacy_peaks", 20, 0.3, 0.4, 10), ("w13_adaptive_peaks", None, 0.1, None, 10), ("w14_emotion_peaks", 15, 0.15, 0.25, 5), ("w14_legacy_emotion_peaks", 20, 0.2, 0.3, 5)])
def test_peak_queries_equal_the_definitions_on_whole_tables(spark, name, gap, prominence, height, k):
    """Every recording of the table, from the events on."""
    series = {}
    for e in spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "user_id", "event_type", "value", "timestampdiff(MILLISECOND, timestamp_ntz'2024-01-01', ts) AS ms").collect():
        v, t, video = e.value / 500, e.ms / 100000.0, e.user_id % 10
        c = (e.event_id * 37) % 1000 / 1000
        if name.startswith("w14"):
            score = min(v, 1.0)
            kind = {"purchase": "excitement", "click": "funny", "signup": "happiness", "error": "anger", "view": "sadness"}[e.event_type]
            of = {x: score if x == kind else 0.1 * score for x in ("excitement", "funny", "happiness", "anger", "sadness")}
            for x, y in of.items():
                series.setdefault((video, x), []).append((t, 0.7 * y + 0.3 * max(of.values())))
        elif name == "w12_find_peaks":
            series.setdefault((video,), []).append((t, v))
        else:
            legacy = 0.5 * v + 0.2 * c + 0.1 * abs(v) + 0.2 * c
            series.setdefault((video,), []).append((t, legacy if "legacy" in name else 0.95 * v + 0.05 * c))
    want = set()
    for key, rows in series.items():
        rows.sort()
        x = [v for _, v in rows]
        found = _peaks(x, float(np.percentile(x, 60)) if height is None else height, gap or max(1, len(x) // 20), prominence)
        for p, prom in sorted(found, key=lambda p: (-x[p[0]], p[0]))[:k]:
            want.add((*key, round(rows[p][0], 6), round(prom, 6)))
    got = catalog.queries()[name](spark, SF).collect()
    assert want and len(got) == len(want) and {(*r[:-4], round(r[-4], 6), round(r.prominence, 6)) for r in got} == want


@pytest.mark.parametrize("span", [60.0, 100.0, 1000.0])
def test_paragraphs_over_pieces_of_a_timeline(spark, span):
    rng = np.random.default_rng(11)
    data = []
    for k in range(6):  # dense, sparse and with gaps over several pieces, starts that several words share, before 0 too
        t = np.round(np.sort(rng.uniform(-150 if k % 2 else 40 * k, 60 * k + 500, 40 * k + 1)), 0 if k > 3 else 2)
        t = t[(t // 200) % 3 != 1] if k == 2 else t
        data += [(k, float(x), float(x + rng.integers(1, 9)), None if rng.random() < 0.1 else "w") for x in t]
    want = []
    for k in range(6):
        begun, number = None, -1
        for _, s, e, w in sorted((r for r in data if r[0] == k), key=lambda r: r[1]):
            if begun is None or s >= begun + 60:
                begun, number = s, number + 1
                want.append([k, number, s, e, 0])
            want[-1][3], want[-1][4] = max(want[-1][3], e), want[-1][4] + (w is not None)
    df = spark.createDataFrame(data, "k long, start_time double, end_time double, word string").repartition(5)
    got = K.greedy_paragraphs(df, ["k"], span=span)
    assert sorted([r.k, r.paragraph, r.start_time, r.end_time, r.words] for r in got.collect()) == sorted(want)


def test_paragraphs_move_no_words(spark):
    words = spark.range(1000).select((F.col("id") % 10).alias("k"), F.col("id").cast("double").alias("start_time"), F.col("id").cast("double").alias("end_time"), F.repeat(F.lit("x"), 1000).alias("word"))
    plan = K.greedy_paragraphs(words, ["k"]).select("words")
    assert plan.agg({"words": "sum"}).first()[0] == 1000 and "word#" not in plan._jdf.queryExecution().toString()


@pytest.mark.parametrize("size", [2, 7, 4096])
def test_greedy_paragraphs(spark, size):
    data, want = [], []
    for k in ("a", "b"):
        starts, begin = np.sort(RNG.integers(0, 2000, 300) / 2).tolist(), None
        data += [(k, s, s + 0.4, "w") for s in starts]
        for s in starts:
            if begin is None or s - begin >= 60:
                begin = s
                want.append([k, s, 0])
            want[-1][2] += 1
    df = spark.createDataFrame([*data, ("a", None, 1.0, "w"), ("c", 1.0, 2.0, "w")], "k string, start_time double, end_time double, word string")
    got = K.greedy_paragraphs(df, ["k"], size=size).orderBy("k", "paragraph").collect()
    assert [[r.k, r.start_time, r.words] for r in got] == [*want, ["c", 1.0, 1]]


@pytest.mark.parametrize("size", [2, 5, 64])
def test_chains_over_many_pieces_and_levels(spark, size):
    """Random steps, most of them short, some over whole pieces; the same rows as walking takes."""
    steps, want = [], set()
    for k in range(4):
        to = {i: min(i + int(RNG.choice([1, 1, 2, 3, 40])), 400) for i in range(400)}
        steps += [(k, i, t if t < 400 else None) for i, t in to.items()]
        i = 0
        while i < 400:
            want.add((k, i))
            i = to[i]
    got = K.reached(spark.createDataFrame(steps, "k int, row long, to long"), ["k"], size, 2).collect()
    assert len(got) == len(want) and {(r.k, r.row) for r in got} == want


@pytest.mark.parametrize("size", [3, 4096])
def test_updates_are_kept_as_one_by_one(spark, size):
    rows = [(int(k), i, None if p < 0.03 else float(p), str(s)) for i, (k, p, s) in enumerate(zip(RNG.integers(0, 2, 300), RNG.random(300).round(2), RNG.choice(["x", "y"], 300, p=[0.9, 0.1]), strict=True))]
    want, last = set(), {}
    for k, i, p, s in rows:
        old = last.get(k)
        moved = old is not None and p is not None and old[0] is not None and abs(p - old[0]) >= 0.1 - 1e-12
        if old is None or moved or s != old[1] or old[2] + 1 >= 10:
            want.add(i)
            last[k] = (p, s, 0)
        else:
            last[k] = (old[0], old[1], old[2] + 1)
    got = K.meaningful_updates(spark.createDataFrame(rows, "k int, id int, progress double, stage string"), ["k"], "id", size=size).collect()
    assert len(got) == len(want) and {r.id for r in got} == want


@pytest.mark.parametrize("few", [1, 7, 4096])
@pytest.mark.parametrize("kind", ["even", "skewed", "ties", "wide"])
def test_ranks_by_selection(spark, kind, few):
    rng = np.random.default_rng(3)
    draw = {"even": lambda n: rng.random(n), "skewed": lambda n: np.where(rng.random(n) < 0.01, 1e12, rng.random(n) ** 9), "ties": lambda n: rng.integers(0, 3, n) / 1.0, "wide": lambda n: np.exp(rng.normal(size=n) * 90) * rng.choice([-1, 1], n)}[kind]
    data = {k: draw(n).tolist() for k, n in enumerate((1, 2, 20, 999))}
    rows = [(k, v) for k, x in data.items() for v in x] + [(0, None), (1, float("nan")), (9, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    got = {r.k: r for r in Q.floor_index(df, ["k"], "v", {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}, few).collect()}
    assert set(got) == set(data)
    for k, x in data.items():
        x = sorted(x)
        at = lambda q: x[min(int(len(x) * q), len(x) - 1)]
        assert (got[k].n, got[k].a, got[k].b, got[k].c, got[k].d) == (len(x), at(0.0), at(0.5), at(0.95), at(1.0))
    lines = {r.k: r for r in Q.quantiles(df, ["k"], "v", {"a": 0.25, "b": 0.95}, few).collect()}
    assert all(np.allclose([lines[k].a, lines[k].b], np.percentile(x, [25, 95])) for k, x in data.items())


def test_ranks_of_infinite_values_and_of_null_keys(spark):
    inf = float("inf")
    df = spark.createDataFrame([(None, v) for v in (-inf, -1.0, 0.0, 5.0, inf)] * 3, "k int, v double")
    got = Q.floor_index(df, ["k"], "v", {"a": 0.5}, 1).collect()
    assert [(r.k, r.n, r.a) for r in got] == [(None, 15, 0.0)]


@pytest.mark.parametrize("n", [1, 2, 20, 999])
def test_overall_percentiles_are_by_floor_index(spark, n):
    values = [float(v) for v in RNG.integers(0, 40, n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    got = M.overall_percentiles(df, "v", {"a": 0.0, "b": 0.5, "c": 0.95, "d": 0.99}, few=16).first()
    assert tuple(got) == tuple(sorted(values)[int(n * q)] for q in (0.0, 0.5, 0.95, 0.99))


@pytest.mark.parametrize("size", [8, 50, 4096])
def test_frames_in_blocks(rows, size):
    data, df = rows
    piece = F.floor(F.col("t") / 100)
    mean = {r.id: r for r in W.centered(df, ["k"], ["t", "id"], piece, {"v": F.col("v")}, 5, size).collect()}
    smooth = {r.id: r.smoothed for r in W.smooth_moving_average(df, ["k"], ["t", "id"], piece, "v", 15, size).collect()}
    fitted = {r.id: r.smoothed for r in W.smooth_savgol(df, ["k"], ["t", "id"], piece, "v", 15, size).collect()}
    loud = {r.id: r.loudness for r in W.loudness_smooth(df, ["k"], ["t", "id"], piece, "v", 50, size).collect()}
    weights = W.savgol_weights()
    for k in (0, 1):
        mine = sorted((x for x in data if x[0] == k), key=lambda x: (x[2], x[1]))
        v, n = np.array([x[3] for x in mine]), len(mine)
        means = [np.abs(v[i - 25 : i + 25]).mean() if 25 <= i <= n - 25 else None for i in range(n)]
        for i, x in enumerate(mine):
            whole = v[i - 2 : i + 3] if 2 <= i < n - 2 else None
            assert mean[x[1]].mean_v is None if whole is None else np.allclose([mean[x[1]].mean_v, mean[x[1]].std_v], [whole.mean(), whole.std(ddof=1)])
            assert math.isclose(smooth[x[1]], v[i - 7 : i + 8].mean() if 7 <= i < n - 7 else v[i], abs_tol=1e-9)
            at = max(0, min(i - 7, n - 15))
            assert math.isclose(fitted[x[1]], weights[i - at] @ v[at : at + 15], abs_tol=1e-9)
            assert math.isclose(loud[x[1]], means[min(max(i, 25), n - 25)], abs_tol=1e-9)


def test_zscores_keep_small_deviations_beside_a_large_offset(spark):
    v = RNG.normal(size=200)
    both = [(k, 1000 * k + i, float(i), float(x + offset)) for k, offset in ((0, 0.0), (1, 1e8)) for i, x in enumerate(v)]
    got = {r.id: r.z for r in W.rolling_zscore(spark.createDataFrame(both, "k int, id int, t double, v double"), ["k"], "id", "t", "v", 50.0).collect()}
    # fewer than five values are measured against 0
    assert max(abs(got[i] - got[1000 + i]) for i in range(4, 200)) < 1e-5
    live = V.scaled_zscores(np.arange(200.0), v + 1e8, 0, 50.0)
    assert max(abs(got[i] - live[i]) for i in range(4, 200)) < 1e-5


@pytest.mark.parametrize("size", [1.0, 9.0, 1e6])
def test_interpolation_over_empty_bins(spark, size):
    series = [(k, float(t), float(v)) for k in (0, 1) for t, v in zip(np.unique(RNG.integers(0, 900, 40)), RNG.normal(size=40), strict=False)] + [(2, 5.0, 1.0), (3, 7.0, None)]
    target = [(k, float(t) / 2) for k in (0, 1, 2, 3) for t in range(-20, 2000, 7)]
    got = {(r.k, r.t): r.v for r in J.interp_join(spark.createDataFrame(target, "k int, t double"), spark.createDataFrame(series, "k int, t double, v double"), ["k"], "v", size).collect()}
    assert len(got) == len(target)
    for k, t in target:
        xy = [(a, b) for c, a, b in series if c == k and b is not None]
        want = np.interp(t, [a for a, _ in xy], [b for _, b in xy]) if xy else None
        assert got[k, t] is None if want is None else math.isclose(got[k, t], want, abs_tol=1e-9)


def test_values_at_one_time(spark):
    df = spark.createDataFrame([("a", 1.0, 5.0), ("a", 1.0, 3.0), ("a", 2.0, None), ("a", 2.0, 7.0)], "k string, t double, v double")
    got = {(r.t, r.v): (r.before["value"], r.after["value"]) for r in J.neighbours(df, ["k"], "t", "v", 1.0).collect()}
    assert got == {(1.0, 5.0): (5.0, 3.0), (1.0, 3.0): (5.0, 3.0), (2.0, None): (7.0, 7.0), (2.0, 7.0): (7.0, 7.0)}


@pytest.mark.parametrize("size", [2, 4096])
def test_islands_over_blocks(spark, size):
    index = np.flatnonzero(RNG.random(400) < 0.15).tolist()
    want = []
    for i in index:
        if want and i - want[-1][1] <= 5:
            want[-1][1] = i
        else:
            want.append([i, i])
    got = W.gap_islands(spark.createDataFrame([("a", i) for i in index], "k string, x long"), ["k"], "x", 5, size).orderBy("first").collect()
    assert [[r.first, r.last] for r in got] == want and all(r.middle == (r.first + r.last) // 2 for r in got)


def test_words_of_overlapping_parts_are_kept_once(spark):
    """Parts of several lengths; no word twice, none lost, each in the part whose centre is nearest."""
    words = [(v, i, i * 0.7, i * 0.7 + 0.5) for v in (1, 2) for i in range(200)]
    parts = [(v, 10 * v + k, 20.0 * k, 20.0 + 3 * k + 6) for v in (1, 2) for k in range(7)]
    heard = [(p, i, s - off, e - off) for v, i, s, e in words for pv, p, off, d in parts if pv == v and s < off + d and e > off]
    offsets = spark.createDataFrame(parts, "video int, part_id int, offset double, duration double")
    got = J.offset_merge(spark.createDataFrame(heard, "part_id int, i int, start_time double, end_time double"), offsets, ["video"], dedup_overlap=True).collect()
    centre = {p: off + d / 2 for _, p, off, d in parts}
    assert len({(r.part_id // 10, r.i) for r in got}) == len(got) == len({(p // 10, i) for p, i, _, _ in heard})
    for r in got:
        middle = (r.start_time + r.end_time) / 2
        assert abs(centre[r.part_id] - middle) <= min(abs(c - middle) for p, c in centre.items() if p // 10 == r.part_id // 10) + 1e-9
    one = spark.createDataFrame([(1, 0.0, 1.0)], "part_id int, start_time double, end_time double")
    assert J.offset_merge(one, spark.createDataFrame([(1, 5.0)], "part_id int, offset double")).first()["start_time"] == 5.0


def test_windows_to_the_end(spark):
    ends = [("a", 58.0), ("b", 60.0), ("c", 89.0), ("d", 100.0), ("e", 120.0), ("f", 0.0)]
    got = W.sliding_windows(spark.createDataFrame(ends, "k string, last double"), ["k"], cover_tail=True).collect()
    last = {}
    for r in got:
        last[r.k] = max(last.get(r.k, 0.0), r.end_time)
    assert last == {k: e for k, e in ends if e} and len({(r.k, r.window_id) for r in got}) == len(got)


def test_a_constant_series_is_in_the_middle(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("b", 1.0), ("b", 2.0), ("b", None)], "k string, v double")
    assert sorted((r.k, r.x if r.x is not None else -1.0) for r in W.video_minmax(df, ["k"], "v", "x").collect()) == [("a", 0.5), ("a", 0.5), ("b", -1.0), ("b", 0.0), ("b", 1.0)]
