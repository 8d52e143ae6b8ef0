"""Fill-in-the-middle: cuts against plain slicing, round trips, forms, edge cases."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from momentlens.llm import fill_middle, queries
from momentlens.llm.text import utf8

TEXTS = ["", "a", "é", "中文字🙂x" * 300, "  two words \n and\nlines ", "\n\n", "x" * 511, "x" * 512, "x" * 513, "é" * 1024, "long" * 200_000, " " * 2000, "one\n" * 999]


def pieces(text, unit):
    if unit == "chars":
        return list(text)
    if unit == "lines":
        return [x for x in re.split(r"(?<=\n)", text) if x]
    return re.findall(r"^[ \t-\r]+|[^ \t-\r]+[ \t-\r]*", text)  # space at the beginning is a unit of its own


@pytest.mark.parametrize("unit", fill_middle.UNITS)
@pytest.mark.parametrize("block", [4, 64, 512])
def test_cuts_equal_slices(unit, block):
    buf, offsets = utf8(pa.array(TEXTS))
    forest = fill_middle.Forest(buf, offsets, unit, block)
    units = [pieces(t, unit) for t in TEXTS]
    assert forest.totals[:, 0].tolist() == [len(u) for u in units]
    rng = random.Random(block)
    for _ in range(4):
        k = np.array([rng.choice([0, len(u), rng.randint(0, len(u))]) for u in units])
        where, points = forest.cut(k)
        for i, u in enumerate(units):
            head = "".join(u[: k[i]])
            assert (where[i] - offsets[i], points[i]) == (len(head.encode()), len(head))


def test_no_texts_have_no_cuts():
    forest = fill_middle.Forest(*utf8(pa.array([], pa.string())))
    assert [x.tolist() for x in forest.cut(np.zeros(0, np.int64))] == [[], []]


ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(20, None), (None, None), (None, "no id at all"), (21, "holds <S> itself"), (22, "<P"), (23, "a<b>c<"), (24, "same"), (24, "same"), *[(i, f"text number {i} <M ends") for i in range(30, 90)]]


def _expected(doc_id, text):
    text = text or ""
    n = len(text)
    digits = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    x, y, z = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}")


def test_every_row_as_expected_and_back(spark):
    docs = spark.createDataFrame([(*r, "h", 5) for r in ROWS], "doc_id long, text string, h1 string, n int").repartition(3)
    made = fill_middle.fill_in_middle(docs)
    back = fill_middle.restored(fill_middle.F.col("output"), fill_middle.F.col("form"))
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", back.alias("back")).collect()
    key = lambda r: repr(r)
    assert sorted([tuple(r)[:6] for r in got], key=key) == sorted([(d, *_expected(d, t)) for d, t in ROWS], key=key)
    assert sorted([(r.doc_id, r.back) for r in got], key=key) == sorted([(d, t or "") for d, t in ROWS], key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["words", "lines"])
def test_other_units_come_back_too(spark, unit):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    made = fill_middle.fill_in_middle(docs, unit, block=16)
    rows = made.select("doc_id", "form", fill_middle.restored(fill_middle.F.col("output"), fill_middle.F.col("form")).alias("back")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.back) for r in rows) == sorted((d is None, d or 0, t or "") for d, t in ROWS)
    with pytest.raises(ValueError, match="unit"):
        fill_middle.fill_in_middle(docs, "bytes")


def test_query_columns(spark):
    assert queries.op13_fill_in_middle(spark, "/root/testdata/sf0.001").columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
