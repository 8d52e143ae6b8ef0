"""Quality classifier: a regularised quadratic discriminant over statistics of a text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentlens.llm.shared import materialize
from momentlens.llm.text import NON_SPACE, chunks, mix, prefix_sums, span_hashes, utf8, words

#: Statistics are whole multiples of 1 / GRID, so sums over any split of the rows are exact and equal.
GRID = 1024
#: Shrinkage of a class covariance: towards that of all rows, then towards a multiple of the unit matrix.
TOWARDS_POOLED, TOWARDS_UNIT = 0.05, 0.02
#: What a difference of log densities is divided by; the statistics aren't normal, so that they'd be too sure.
TEMPER = 6.0
BAR = 0.7

STATISTICS = ("words", "word_length", "length_spread", "symbols", "marks", "upper", "digits", "no_letter_words", "odd_ends", "said_again", "distinct", "line_words", "closed_lines", "line_copies", "stops", "commas", "byte_entropy")

_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOLS, _MARKS, _DIGITS, _STOPS, _COMMAS = map(_class, (b"#*$%&|<>", b"!?", b"0123456789", b".", b","))
_UPPER = _class(bytes(range(0x41, 0x5B)))
_LETTER = _UPPER | _class(bytes(range(0x61, 0x7B))) | (np.arange(256) >= 0x80)
_ODD = _SYMBOLS | _class(b"!|")


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[texts, STATISTICS] as multiples of 1 / GRID: logarithms of counts and square roots of shares."""
    docs = len(offsets) - 1
    starts, ends, first = words(buf, offsets)
    l_starts, l_ends, l_first = words(buf, offsets, _LINE)

    def per_doc(flags: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[cuts]).astype(float)

    def within(flags: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])

    sums = prefix_sums(buf)
    owner = np.repeat(np.arange(docs), np.diff(first))
    hashes = span_hashes(sums, starts, ends)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])

    def different(h: np.ndarray, of: np.ndarray) -> np.ndarray:
        _, at = np.unique(h ^ mix(of.astype(np.uint64) + np.uint64(1)), return_index=True)
        return np.bincount(of[at], minlength=docs).astype(float)

    points = within((buf & 0xC0) != 0x80)
    length = (points[ends] - points[starts]).astype(float)
    n, chars = np.diff(first).astype(float), np.diff(points[offsets]).astype(float)
    letters = within(_LETTER[buf] & ((buf & 0xC0) != 0x80))
    l_owner = np.repeat(np.arange(docs), np.diff(l_first))
    spoken = within(NON_SPACE[buf])
    l_full = spoken[l_ends] > spoken[l_starts]
    l_starts, l_ends, l_owner = l_starts[l_full], l_ends[l_full], l_owner[l_full]
    lines = np.bincount(l_owner, minlength=docs).astype(float)
    closed = _STOPS[buf[l_ends - 1]] if len(l_ends) else np.zeros(0, bool)
    two = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) if len(buf) else np.zeros(0, bool)
    upper = _UPPER[buf]
    upper[: len(two)] |= two  # capital letters of Western European languages
    mean = np.bincount(owner, length, docs) / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, docs) / np.maximum(n, 1) - mean**2, 0))
    counts = np.bincount(np.repeat(np.arange(docs), np.diff(offsets)) * 256 + buf, minlength=docs * 256).reshape(docs, 256)
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    of = lambda x, y: np.sqrt(x / np.maximum(y, 1))
    columns = (
        np.log1p(n),
        np.log1p(mean),
        np.log1p(spread),
        of(per_doc(_SYMBOLS[buf], offsets), chars),
        of(per_doc(_MARKS[buf], offsets), chars),
        of(per_doc(upper, offsets), np.diff(letters[offsets])),
        of(per_doc(_DIGITS[buf], offsets), chars),
        of(np.bincount(owner, letters[ends] == letters[starts], docs), n),
        of(np.bincount(owner, _ODD[buf[ends - 1]] if len(ends) else None, docs), n),
        of(np.bincount(owner, again, docs), n),
        np.log((different(hashes, owner) + 1) / (n + 1)),
        np.log1p(n / np.maximum(lines, 1)),
        of(np.bincount(l_owner, closed, docs), lines),
        of(lines - different(span_hashes(sums, l_starts, l_ends), l_owner), lines),
        of(per_doc(_STOPS[buf], offsets), n),
        of(per_doc(_COMMAS[buf], offsets), n),
        entropy,
    )
    return np.rint(np.stack(columns, axis=1) * GRID).astype(np.int32)


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the statistics of its whole text, for every row; a null text counts as an empty one. No shuffle."""

    def run(batches):
        for batch in batches:
            buf, offsets = utf8(batch["text"])
            found = [statistics(b, o) for _, _, b, o in chunks(buf, offsets)]
            x = np.concatenate(found) if found else np.zeros((0, len(STATISTICS)), np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(STATISTICS), pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], lists], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("x", T.ArrayType(T.IntegerType())))


@dataclass
class Model:
    """Means, inverse Cholesky factors of the shrunk covariances, log determinants and shares of classes 0 and 1."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    shares: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Of class 1, 0 to 1: the difference of the log densities and shares, tempered."""
        if self.shares.min() == 0:  # a class without rows has no density
            return np.full(len(x), self.shares[1] if self.shares.sum() else 0.5)
        logs = []
        for mean, factor, log_det, share in zip(self.means, self.factors, self.log_dets, self.shares, strict=True):
            z = (x / GRID - mean) @ factor.T
            logs.append(np.log(share) - (log_det + (z * z).sum(axis=1)) / 2)
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / TEMPER, -700, 700)))


def class_sums(labelled: DataFrame) -> dict[int, np.ndarray]:
    """For each class the sums of 1, x and x x' over its rows (columns ``x``, ``n0`` and ``n1``, how often a row counts).

    A task adds up its rows; sums are whole numbers, so neither order nor partitions change them.
    """
    d = len(STATISTICS)

    def run(batches):
        total = np.zeros((2, 1 + d + d * d), object)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch["x"].flatten().to_numpy().reshape(-1, d).astype(np.int64)
            for c in (0, 1):
                w = batch[f"n{c}"].to_numpy().astype(np.int64)
                found = np.concatenate([[w.sum()], w @ x, ((x * w[:, None]).T @ x).reshape(-1)])
                total[c] += found.astype(object)
        for c in (0, 1):
            if total[c, 0]:
                yield pa.RecordBatch.from_arrays([pa.array([c] * total.shape[1]), pa.array(range(total.shape[1])), pa.array([str(v) for v in total[c]])], ["c", "k", "v"])

    parts = labelled.select("x", "n0", "n1").mapInArrow(run, "c long, k long, v string")
    rows = parts.groupBy("c", "k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # two classes, 1 + d + d * d numbers
    out: dict[int, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.c, np.zeros(1 + d + d * d))[r.k] = float(r.v)
    return out


def fit(sums: dict[int, np.ndarray], pooled: float = TOWARDS_POOLED, unit: float = TOWARDS_UNIT) -> Model:
    d = len(STATISTICS)
    none = np.zeros(1 + d + d * d)
    n, means, scatter = [], [], []
    for c in (0, 1):
        s = sums.get(c, none)
        n.append(s[0])
        mean = s[1 : 1 + d] / max(s[0], 1)
        scatter.append(s[1 + d :].reshape(d, d) - s[0] * np.outer(mean, mean))
        means.append(mean / GRID)
    total = max(sum(n), 1)
    both = (scatter[0] + scatter[1]) / total / GRID**2
    factors, dets = [], []
    for c in (0, 1):
        own = scatter[c] / max(n[c], 1) / GRID**2
        cov = (1 - pooled) * own + pooled * both
        # a statistic that never varies still gets a variance, a step of the grid
        cov = (1 - unit) * cov + (unit * np.trace(cov) / d + GRID**-2) * np.eye(d)
        root = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(root))
        dets.append(2 * np.log(np.diag(root)).sum())
    return Model(np.array(means), np.array(factors), np.array(dets), np.array(n) / total)


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether a row is kept from learning; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def classify(docs: DataFrame, labels: DataFrame, bar: float = BAR) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, learnt from the labelled rows that aren't held out.

    ``labels`` has doc_id and quality (0 or 1; other values and nulls are left out). A document with several labels
    counts once for each, a repeated row of a document with each of its labels; labels are counted per document before
    they are joined, so repeats of one id don't multiply. Without labels of both classes every score is the share of class
    1 (0.5 without any). Null and empty texts have statistics like any other and get their score by them.
    """
    found = materialize(text_statistics(docs).withColumn("held_out", held_out(F.col("doc_id"))), "statistics")
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.count_if(F.col("quality") == c).alias(f"n{c}") for c in (0, 1)])
    model = fit(class_sums(found.where(~F.col("held_out")).join(known, "doc_id")))

    def run(batches):
        for batch in batches:
            x = batch["x"].flatten().to_numpy().reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(model.scores(x))], ["doc_id", "held_out", "score"])

    scored = found.mapInArrow(run, found.select("doc_id", "held_out").schema.add("score", "double"))
    return scored.withColumn("predicted", (F.col("score") >= bar).cast("int"))
