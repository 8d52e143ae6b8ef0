"""Emotion fusion and highlight arithmetic as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from momentlens.sources.adapters import EMOTIONS

POSITIVE, NEGATIVE = ("excitement", "funny", "happiness"), ("anger", "sadness")
# The bonus and the code of each streamer/audience relationship.
BONUS = {"synchronized": 0.15, "positive_aligned": 0.10, "audience_positive": 0.08, "audience_negative": 0.05}
CODES = {"synchronized": 5, "positive_aligned": 4, "audience_positive": 3, "mixed": 2, "audience_negative": 1, "negative_aligned": 0}


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` held between two bounds; null stays null (``least`` and ``greatest`` would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def cols(prefix: str = "", names=EMOTIONS) -> list[Column]:
    return [F.col(f"{prefix}{e}") for e in names]


def total(xs: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, xs)


def fuse_emotions(a: list[Column], c: list[Column], wa: Column, wc: Column) -> list[Column]:
    mixed = [(x * wa + y * wc) / (wa + wc) for x, y in zip(a, c, strict=True)]
    s = total(mixed)
    return [F.when(s > 0, m / s).otherwise(m) for m in mixed]


def fuse_sentiment(sa: Column, ca: Column, sc: Column, cc: Column) -> Column:
    return F.when(ca <= 0, sc).when(cc <= 0, sa).otherwise((sa * ca + sc * cc) / (ca + cc))


def dominant(values: list[Column], labels=EMOTIONS, default: str | None = None) -> Column:
    """The label of the greatest value, the first in order on ties; the default where all are zero."""
    ranked = [F.struct(v.alias("v"), F.lit(-i).alias("i"), F.lit(label).alias("label")) for i, (v, label) in enumerate(zip(values, labels, strict=True))]
    top = F.array_max(F.array(*ranked))
    return F.when(F.greatest(*values) == 0, F.lit(default)).otherwise(top["label"]) if default else top["label"]


def alignment(a: list[Column], c: list[Column]) -> Column:
    return total([1 - F.abs(x - y) for x, y in zip(a, c, strict=True)]) / len(a)


def relationship(a: Column, c: Column) -> Column:
    pos, neg = (lambda x: x.isin(*POSITIVE)), (lambda x: x.isin(*NEGATIVE))
    return F.when(a == c, "synchronized").when(pos(a) & pos(c), "positive_aligned").when(neg(a) & neg(c), "negative_aligned").when(pos(a) & neg(c), "audience_negative").when(neg(a) & pos(c), "audience_positive").otherwise("mixed")


def relationship_code(r: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])[r], F.lit(2))


def enhanced_score(h: Column, ch: Column, align: Column, rel: Column) -> Column:
    bonus = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in BONUS.items() for x in kv]), rel), F.lit(0.0))
    score = 0.6 * h + 0.4 * ch + bonus + 0.1 * align
    return F.when(score.isNotNull(), F.least(F.lit(1.0), score))


def blend_highlight(model: Column, sr_norm: Column, ri: Column, ai: Column, emotions: list[Column]) -> Column:
    base = (0.15 * sr_norm + 0.15 * ri + 0.10 * ai + 0.10 * total(emotions) / len(emotions)) * 2
    return F.when(model > 0, 0.5 * model + 0.5 * base).otherwise(base)


def weighted_highlight(h: Column, emo: Column, sentiment: Column, ai: Column, variant: str) -> Column:
    return {"precomputed": 0.95 * h + 0.05 * ai, "legacy": 0.5 * h + 0.2 * emo + 0.1 * F.abs(sentiment) + 0.2 * ai, "simple": 0.8 * h + 0.2 * emo}[variant]


def weighted_emotion(e: Column, ai: Column) -> Column:
    return 0.7 * e + 0.3 * ai


def amplify(e: Column, ai: Column) -> Column:
    return e * F.coalesce(clip(ai, 0.0, 1.0) + 0.5, F.lit(0.75))


def cluster_scores(p: dict[str, Column]) -> dict[str, Column]:
    sentiment = p["excitement"] + p["happiness"] + p["funny"] - p["anger"] - p["sadness"]
    near = lambda v: F.round(v + 1e-9, 3) + 0.0  # noqa: E731  no negative zero
    return {k: near(v) for k, v in p.items()} | {"sentiment": near(clip(sentiment, -1.0, 1.0))}


def format_mmss(s: Column) -> Column:
    two = lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)
    return F.coalesce(F.concat(two(F.floor(s / 60).cast("string")), F.lit(":"), two(F.floor(s % 60).cast("string"))), F.lit("00:00"))


def truncate_text(s: Column, most: int = 50) -> Column:
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 3), F.lit("..."))).otherwise(s)
