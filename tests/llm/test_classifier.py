"""The quadratic discriminant against plain NumPy, on held-out rows, and on rows with nulls, ties and no labels."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from momentlens.llm import discriminant, queries

SPACE = r"[\x20\x09-\x0D]+"


def plain_statistics(text):
    """The statistics of one text by plain Python."""
    text = text or ""
    w = [x for x in re.split(SPACE, text) if x]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars = len(w), len(text)
    letter = lambda c: c.isascii() and c.isalpha() or not c.isascii()
    upper = lambda c: "A" <= c <= "Z" or 0xC0 <= ord(c) <= 0xDE
    share = lambda x, y: math.sqrt(x / max(y, 1))
    lengths = [len(x) for x in w]
    mean = sum(lengths) / max(n, 1)
    spread = math.sqrt(max(sum(x * x for x in lengths) / max(n, 1) - mean**2, 0))
    raw = Counter(text.encode())
    total = max(sum(raw.values()), 1)
    out = (
        math.log1p(n), math.log1p(mean), math.log1p(spread),
        share(sum(c in "#*$%&|<>" for c in text), chars), share(sum(c in "!?" for c in text), chars),
        share(sum(map(upper, text)), sum(map(letter, text))), share(sum(c in "0123456789" for c in text), chars),
        share(sum(not any(map(letter, x)) for x in w), n), share(sum(x[-1] in "#*$%&|<>!" for x in w), n),
        share(sum(a == b for a, b in zip(w, w[1:], strict=False)), n), math.log((len(set(w)) + 1) / (n + 1)),
        math.log1p(n / max(len(lines), 1)), share(sum(x[-1] == "." for x in lines), len(lines)), share(len(lines) - len(set(lines)), len(lines)),
        share(text.count("."), n), share(text.count(","), n), -sum(v / total * math.log2(v / total) for v in raw.values()),
    )
    return np.array(out)


TEXTS = ["", None, "a", " \n\t", "One line. Two!\nOne line. Two!", "Éa ÉB çà ß 中文。 x\n\n\nlast", "go go go 12 $$$ ### | a|", "x\r\ny\x0bz", "word " * 50_000 + "END!!", "x" * 1_500_000]


def test_statistics_equal_plain_python():
    import pyarrow as pa

    from momentlens.llm.text import chunks, utf8

    found = np.concatenate([discriminant.statistics(b, o) for _, _, b, o in chunks(*utf8(pa.array(TEXTS)))])
    want = np.array([plain_statistics(t) for t in TEXTS]) * discriminant.GRID
    assert np.abs(found - want).max() <= 0.5001


def _is_held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def _brute(rows, labels):
    """Scores by NumPy's own covariances and solvers."""
    x = np.rint(np.array([plain_statistics(t) for _, t in rows]) * discriminant.GRID) / discriminant.GRID
    of = {0: [], 1: []}
    for (doc_id, _), v in zip(rows, x, strict=True):
        if doc_id is not None and not _is_held_out(doc_id):
            for q in labels.get(doc_id, ()):
                of[q].append(v)
    n = [len(of[c]) for c in (0, 1)]
    means = [np.mean(of[c], axis=0) for c in (0, 1)]
    own = [np.cov(np.array(of[c]).T, bias=True) for c in (0, 1)]
    both = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    logs = []
    for c in (0, 1):
        cov = 0.95 * own[c] + 0.05 * both
        cov = 0.98 * cov + (0.02 * np.trace(cov) / len(cov) + discriminant.GRID**-2) * np.eye(len(cov))
        far = x - means[c]
        logs.append(math.log(n[c] / sum(n)) - (np.linalg.slogdet(cov)[1] + np.einsum("ij,ij->i", far @ np.linalg.inv(cov), far)) / 2)
    return 1 / (1 + np.exp(-(logs[1] - logs[0]) / discriminant.TEMPER))


def test_query_equals_numpy_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    labels = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        labels.setdefault(r.doc_id, []).append(r.quality)
    want = dict(zip([r[0] for r in rows], _brute(rows, labels), strict=True))
    found = queries.op12_quality_classifier(spark, sf)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6) and r.predicted == int(r.score >= 0.7) and r.held_out == _is_held_out(r.doc_id)


def test_held_out_rows_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r.score, r.predicted, labels[r.doc_id]) for r in queries.op12_quality_classifier(spark, sf).where("held_out").collect() if r.doc_id in labels]
    good, bad = [s for s, _, q in got if q], [s for s, _, q in got if not q]
    pairs = sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))
    assert len(bad) >= 10 and pairs > 0.97
    assert sum(p == q for _, p, q in got) / len(got) > 0.95


def test_nulls_repeats_ties_and_extra_columns(spark):
    rows = [(1, "good text here. " * 9), (1, "good text here. " * 9), (None, "no id"), (None, None), (3, ""), (4, "## $$ ## |"), (5, "y" * 2_000_000), (6, "Fine words. More words.")]
    docs = spark.createDataFrame([(*r, 7, 0.5, [1]) for r in rows], "doc_id long, text string, quality int, score double, x array<int>").repartition(3)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (4, 0, 1), (4, None, 1), (None, 1, 0), (99, 0, 0), (6, 1, 0), (5, 2, 0)], "doc_id long, quality int, toxic int")
    got = discriminant.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert {r.score for r in discriminant.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert discriminant.classify(docs.limit(0), labels).count() == 0


def test_sums_do_not_depend_on_partitions(spark):
    sf = "/root/testdata/sf0.001"
    x = discriminant.text_statistics(spark.read.parquet(f"{sf}/documents.parquet")).selectExpr("x", "doc_id % 2 AS n0", "1 - doc_id % 2 AS n1")
    one, many = discriminant.class_sums(x.coalesce(1)), discriminant.class_sums(x.repartition(13))
    assert all((one[c] == many[c]).all() for c in (0, 1))
