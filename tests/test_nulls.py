"""Nulls stay nulls: no missing value turns into a best or worst score."""

import pytest
from pyspark.sql import functions as F

from momentlens.functions import chat as C
from momentlens.functions import fusion as U
from momentlens.operators import intervals as J
from momentlens.operators import telemetry as M
from momentlens.operators import windows as W



def _cases():
    null, one = F.lit(None).cast("double"), F.lit(1.0)
    return {
        "amplify": (U.amplify(one, null), 0.75),
        "amplify a null": (U.amplify(null, one), None),
        "enhanced": (U.enhanced_score(null, one, one, F.lit("mixed")), None),
        "enhanced without relationship": (U.enhanced_score(one, one, one, F.lit(None).cast("string")), 1.0),
        "rate": (C.speech_rate_norm(null), None),
        "cluster": (U.cluster_scores({e: null for e in ("excitement", "funny", "happiness", "anger", "sadness")})["sentiment"], None),
        "backoff": (M.backoff_delay(null, "exponential"), None),
        "eta": (M.eta_seconds(null, F.lit(50.0), F.lit("Running")), None),
        "eta of a share": (M.eta_seconds(one, null, F.lit("Running")), None),
        "eta done": (M.eta_seconds(null, null, F.lit("Completed")), 0),
        "performance": (M.performance_score(null, one, one), None),
        "simple performance": (M.simple_performance_score(null, one), None),
        "grade": (M.grade(null), None),
        "clip": (U.clip(null, 0.0, 1.0), None),
        "mmss": (U.format_mmss(null), "00:00"),
        "weighted": (U.weighted_highlight(null, one, one, one, "legacy"), None),
    }


def test_functions_of_nulls(spark):
    cases = _cases()
    got = spark.range(1).select(*[v.alias(k) for k, (v, _) in cases.items()]).first().asDict()
    assert got == {k: want for k, (_, want) in cases.items()}


@pytest.mark.parametrize("policy", ["exponential", "linear", "fixed", "immediate"])
def test_backoff_policies(spark, policy):
    got = [r.d for r in spark.range(1, 9).select(M.backoff_delay(F.col("id"), policy).alias("d")).collect()]
    assert got == {"exponential": [1, 2, 4, 8, 16, 32, 60, 60], "linear": [1, 2, 3, 4, 5, 6, 7, 8], "fixed": [1] * 8, "immediate": [0] * 8}[policy]


def test_zscore_of_a_null_is_null(spark):
    rows = spark.createDataFrame([("a", i, float(i), None if i == 3 else float(i % 4)) for i in range(12)], "k string, id int, t double, v double")
    got = {r.id: r.z for r in W.rolling_zscore(rows, ["k"], "id", "t", "v").collect()}
    assert len(got) == 12 and got[3] is None and all(z is not None and 0 <= z <= 1 for i, z in got.items() if i != 3)


def test_an_unknown_overlap_mode_is_an_error(spark):
    with pytest.raises(ValueError, match="unknown mode"):
        J.overlaps(*[F.lit(1.0)] * 4, "nearly")


def test_words_overlap_counts_a_word_without_length_inside(spark):
    words = J.overlaps(F.lit(5.0), F.lit(5.0), F.lit(0.0), F.lit(10.0), "words")
    apart = J.overlaps(F.lit(10.0), F.lit(12.0), F.lit(0.0), F.lit(10.0), "words")
    assert tuple(spark.range(1).select(words, apart).first()) == (True, False)
