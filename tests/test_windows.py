import numpy as np
import pytest
from pyspark.sql import functions as F

from momentlens.operators import intervals as J
from momentlens.operators import windows as W


def test_savgol_keeps_a_cubic(spark):
    data = [("a", i, float(i**3 - 5 * i)) for i in range(40)] + [("b", i, 1.0 * i) for i in range(5)]
    out = W.smooth_savgol(spark.createDataFrame(data, "k string, i int, v double"), ["k"], ["i"], F.floor(F.col("i") / 8), "v").toPandas()
    assert np.allclose(out.smoothed, out.v, atol=1e-6)


@pytest.mark.parametrize("mode", ["open", "touching"])
@pytest.mark.parametrize("size", [1.0, 7.0, 1000.0])
def test_interval_join_equals_brute_force(spark, mode, size):
    rng = np.random.default_rng(3)
    side = lambda n: [(int(k), i, float(s), float(s + d)) for i, (k, s, d) in enumerate(zip(rng.integers(0, 2, n), rng.integers(0, 50, n), rng.integers(0, 20, n), strict=True))]
    a, b = side(60), side(60)
    got = J.interval_join(spark.createDataFrame(a, "k int, a int, start_time double, end_time double"), spark.createDataFrame(b, "k int, b int, r_start double, r_end double"), ["k"], mode, size)
    hit = (lambda x, y: x[2] < y[3] and x[3] > y[2]) if mode == "open" else (lambda x, y: x[2] <= y[3] and y[2] <= x[3])
    assert sorted((r.a, r.b) for r in got.collect()) == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and hit(x, y))
