"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentlens.llm.shared import materialize
from momentlens.llm.text import ALNUM, LOWER, chunks, prefix_sums, span_hashes, utf8, words

#: Raking ends when no margin is off by more than TOLERANCE of its target, or when a round of SWEEPS sweeps doesn't bring
#: the largest error below STALLED of what it was (the margins contradict each other); the error left is in the result.
SWEEPS, TOLERANCE, STALLED = 4, 1e-3, 0.9
#: A cell this close to its tokens is full, so that rounding doesn't decide.
_FULL = 1e-9
DIMENSIONS = ("source", "language", "topic")
#: Up to so many cells are raked in one task by NumPy, more by windows over a table; the steps are the same.
LOCAL_CELLS = 100_000
#: A margin's target share is its share of tokens to this power, normalised: 1 keeps the mix, 0 makes it even.
TEMPER = {"source": 0.5, "language": 0.7, "topic": 0.0}
KEEP_SHARE, SEED = 0.7, "mix-1"
#: Topics are clusters of texts by their words, hashed into WIDTH classes. The centres are fitted on all documents with words, in
#: FIT_ROUNDS at most; up to LOCAL_ROWS of them in one process, more by a pass over a written table a step. The steps are the same.
TOPICS, WIDTH, FIT_ROUNDS, LOCAL_ROWS = 8, 256, 20, 4096
#: Profiles are summed as whole multiples of 1 / UNIT, so that sums don't depend on the order.
UNIT = 1 << 30


def word_classes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, counts of its word classes) of a chunk."""
    low = LOWER[buf]
    starts, ends, at = words(low, offsets, ALNUM)
    kind = (span_hashes(prefix_sums(low), starts, ends) % np.uint64(WIDTH)).astype(np.int64)
    n = np.diff(at)
    return n, np.bincount(np.repeat(np.arange(len(n)), n) * WIDTH + kind, minlength=len(n) * WIDTH).reshape(-1, WIDTH)


@dataclass(frozen=True)
class Topics:
    """Centres of word-class profiles; a profile is log counts, weighted by how few texts hold the class, of length 1."""

    weight: np.ndarray
    centres: np.ndarray

    @staticmethod
    def profiles(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * weight
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    @classmethod
    def fit(cls, step: Callable[[str, Topics], tuple], topics: int = TOPICS) -> Topics:
        """Cosine k-means from centres far apart. ``step`` gives what ``_part`` finds in all rows (see there)."""
        rows, held = step("held", cls(np.zeros(WIDTH), np.zeros((0, WIDTH))))
        found = cls(np.log((1 + rows) / (1 + held)), np.zeros((0, WIDTH)))
        if not rows:
            return cls(found.weight, np.zeros((topics, WIDTH)))
        while len(found.centres) < topics:
            found = cls(found.weight, np.concatenate([found.centres, found.profiles(step("far", found)[2][None], found.weight)]))
        for _ in range(FIT_ROUNDS):
            sums = step("sums", found)[0].astype(float)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 0, sums / np.maximum(size, 1e-12), found.centres)
            if (centres == found.centres).all():
                break
            found = cls(found.weight, centres)
        return found

    def assign(self, counts: np.ndarray) -> np.ndarray:
        return (self.profiles(counts, self.weight) @ self.centres.T).round(9).argmax(axis=1)


def _draw(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _part(kind: str, topics: Topics, place: np.ndarray, counts: np.ndarray) -> tuple:
    """What some rows with words add to a step of the fit: ``held``, (rows, rows that hold each class); ``far``, the row least like any
    centre, as (likeness, place, counts); ``sums``, (sums of profiles of each topic,)."""
    if kind == "held":
        return len(counts), (counts > 0).sum(axis=0)
    x = topics.profiles(counts, topics.weight)
    if kind == "far":
        like = (x @ topics.centres.T).max(axis=1).round(9) if len(topics.centres) else np.zeros(len(x))
        i = np.lexsort((place, like))[0]
        return float(like[i]), int(place[i]), counts[i]
    mine, units = topics.assign(counts), np.rint(x * UNIT).astype(np.int64)
    return (np.stack([units[mine == k].sum(axis=0) for k in range(len(topics.centres))]),)


def _step(table: DataFrame, kind: str, topics: Topics) -> tuple:
    """``_part`` over all rows of a table (place, counts); the driver gets one row, or one a class."""
    schema = "like double, place long, counts binary" if kind == "far" else "k int, x long"

    def run(batches):
        total, best = None, None
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                some = batch.slice(i, 2048)
                counts = np.frombuffer(b"".join(some["counts"].to_pylist()), np.int32).reshape(-1, WIDTH).astype(np.int64)
                found = _part(kind, topics, some["place"].to_numpy(), counts)
                if kind == "far":
                    best = found if best is None else min(best, found, key=lambda r: r[:2])
                else:
                    flat = np.concatenate([np.ravel(x) for x in found])
                    total = flat if total is None else total + flat
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]]), pa.array([best[2].astype(np.int32).tobytes()], pa.binary())], ["like", "place", "counts"])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["k", "x"])

    parts = table.mapInArrow(run, schema)
    if kind == "far":
        r = parts.agg(F.min(F.struct("like", "place", "counts")).alias("r")).first()["r"]
        return r["like"], r["place"], np.frombuffer(bytes(r["counts"]), np.int32).astype(np.int64)
    sums = np.array([r.x for r in sorted(parts.groupBy("k").agg(F.sum("x").alias("x")).collect())], np.int64)
    if kind == "held":
        return (int(sums[0]), sums[1:]) if len(sums) else (0, np.zeros(WIDTH, np.int64))
    return (sums.reshape(-1, WIDTH),)


def fit_topics(docs: DataFrame) -> Topics:
    """Centres from all rows that have words, written once as counts of WIDTH classes. A row's place is a hash of id and text."""
    place = F.xxhash64(F.lit("topics"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text"))

    def run(batches):
        for batch in batches:
            for i, j, b, o in chunks(*utf8(batch["text"])):
                n, counts = word_classes(b, o)
                rows = pa.array([x.tobytes() for x in counts.astype(np.int32)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch["place"].slice(i, j - i), rows], ["place", "counts"]).filter(pa.array(n > 0))

    table = materialize(docs.where("text IS NOT NULL").select(place.alias("place"), F.col("text").cast("string").alias("text")).mapInArrow(run, "place long, counts binary"), "profiles")
    if table.count() > LOCAL_ROWS:
        return Topics.fit(lambda kind, topics: _step(table, kind, topics))
    rows = table.collect()
    places = np.array([r.place for r in rows], np.int64)
    counts = np.array([np.frombuffer(bytes(r["counts"]), np.int32) for r in rows], np.int64).reshape(-1, WIDTH)
    return Topics.fit(lambda kind, topics: _part(kind, topics, places, counts))


def _keyed(docs: DataFrame, topics: Topics, columns: list[str], passed: list[str]) -> DataFrame:
    """``passed`` columns of ``docs`` (no name may be one of those added) with source, language, topic, tokens and draw."""
    doc_id, text, source, lang = columns
    inner = docs.select(*passed, F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("language"), _draw(F.lit(SEED), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.xxhash64(text).cast("string"), F.lit(""))).alias("draw"), F.col(text).cast("string").alias("body"))
    fields = [f for f in inner.schema.fields if f.name != "body"]
    schema = T.StructType([*fields, T.StructField("tokens", T.LongType()), T.StructField("topic", T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(topics)
    names = pa.array([f"topic{i}" for i in range(len(topics.centres))])

    def run(batches):
        for batch in batches:
            tokens, topic = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, b, o in chunks(*utf8(batch["body"])):
                n, counts = word_classes(b, o)
                tokens.append(n)
                topic.append(shared.value.assign(counts))
            kept = [batch[f.name] for f in fields]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate(tokens)), names.take(pa.array(np.concatenate(topic)))], [f.name for f in fields] + ["tokens", "topic"])

    return inner.mapInArrow(run, schema)


def _margin(cells: DataFrame, dimension: str, given: dict[str, float] | None, total: float) -> DataFrame:
    """(dimension, target): ``total`` tokens shared out by wish; no value gets more than it has, others get the rest."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("have"))
    if given is None:
        wish = F.pow(F.col("have"), F.lit(TEMPER[dimension]))
    else:
        wish = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in (kv[0], float(kv[1]))]), F.col(dimension)), F.lit(0.0))
    wished = materialize(sums.select(dimension, "have", wish.alias("wish")), "margin")
    level, full = 0.0, -1
    while True:  # raise the level until it holds for all values that aren't used up; each turn uses up one more at least
        used = F.col("wish") * F.lit(level) >= F.col("have")
        row = wished.agg(F.sum(F.when(used, F.col("have")).otherwise(0.0)), F.sum(F.when(used, 0.0).otherwise(F.col("wish"))), F.count_if(used)).first()
        if row[2] == full or not row[1]:
            break
        full, level = row[2], (total - row[0]) / row[1]
    return wished.select(dimension, F.least(F.col("have"), F.col("wish") * F.lit(level)).alias("target"))


def _wished(have: np.ndarray, wish: np.ndarray, total: float) -> np.ndarray:
    """As ``_margin``: what each value is to get."""
    level, full = 0.0, -1
    while True:
        used = wish * level >= have
        if used.sum() == full or not wish[~used].sum():
            return np.minimum(have, wish * level)
        full, level = used.sum(), (total - have[used].sum()) / wish[~used].sum()


def _raked_here(table: pa.Table, targets: dict[str, dict[str, float]], share: float, tolerance: float) -> tuple[np.ndarray, float, float]:
    """The weights of a table of cells, the largest error left, and how far targets were moved."""
    tokens = table["tokens"].to_numpy().astype(float)
    total = tokens.sum() * share
    coded = [table[d].combine_chunks().dictionary_encode() for d in DIMENSIONS]
    of = [c.indices.to_numpy().astype(np.int64) for c in coded]
    wanted, own = [], []
    for d, c, i in zip(DIMENSIONS, coded, of, strict=True):
        have, given = np.bincount(i, tokens), targets.get(d)
        own.append(given is None)
        wanted.append(_wished(have, have ** TEMPER[d] if given is None else np.array([float(given.get(x, 0.0)) for x in c.dictionary.to_pylist()]), total))
    weight, worst, moved = tokens * share, np.inf, None
    while True:
        for _ in range(SWEEPS):
            off = 0.0
            for i, target in zip(of, wanted, strict=True):
                now, free = np.bincount(i, weight), weight < tokens * (1 - _FULL)
                open_ = np.bincount(i, weight * free)
                off = max(off, float((np.abs(now - target) / np.maximum(target, 1.0)).max(initial=0.0)))
                down = np.divide(target, now, out=np.ones(len(now)), where=now > 0)
                up = 1 + np.divide(target - now, open_, out=np.zeros(len(now)), where=open_ > 0)
                weight = np.where((now > target)[i], weight * down[i], np.where(free, np.minimum(tokens, weight * up[i]), weight))
        if off <= tolerance or (off > worst * STALLED and (moved is not None or not any(own))):
            return weight, off, moved or 0.0
        if off > worst * STALLED:
            reached = [np.bincount(i, weight) for i in of]
            moved = max(float((np.abs(r - t) / np.maximum(t, 1.0)).max(initial=0.0)) for r, t, mine in zip(reached, wanted, own, strict=True) if mine)
            wanted = [r if mine else t for r, t, mine in zip(reached, wanted, own, strict=True)]
            off = np.inf
        worst = off


def _scaled(cells: DataFrame, dimension: str) -> DataFrame:
    """Scaled to one margin: down all cells of a value, up those below their tokens; ``off`` keeps the largest error."""
    by = Window.partitionBy(dimension)
    free = F.col("weight") < F.col("tokens") * (1 - _FULL)
    sums = cells.withColumns({"have": F.sum("weight").over(by), "open": F.sum(F.when(free, F.col("weight")).otherwise(0.0)).over(by)})
    target = F.col(f"target_{dimension}")
    down = F.col("weight") * target / F.when(F.col("have") > 0, F.col("have"))
    up = F.least(F.col("tokens").cast("double"), F.col("weight") * (1 + (target - F.col("have")) / F.when(F.col("open") > 0, F.col("open"))))
    moved = F.when(F.col("have") > target, down).when(free, up)
    error = F.abs(F.col("have") - target) / F.greatest(target, F.lit(1.0))
    return sums.withColumns({"off": F.greatest("off", error), "weight": F.coalesce(moved, "weight")}).drop("have", "open")


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = KEEP_SHARE, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells (source, language, topic, tokens) with ``weight``, the tokens to keep, ``residual`` and ``moved``.

    Weights start at the cells' tokens times ``share`` and are scaled to each margin in turn, never beyond the cell's
    tokens. Targets sum to ``share`` of all tokens; a value whose target is above what it has gets all it has, and the
    others share the rest. One rule ends the sweeps, however many cells there are: see SWEEPS. Margins may contradict each
    other, as one language makes up one topic. Where the sweeps end with an error, the targets that weren't given are moved to the
    margins that were reached, so that all can be met, by ``moved`` at most, as a share of the target; given targets stay as they
    are. ``residual`` is the largest error that a margin is left with. Cells without tokens are dropped. Few cells are raked in one
    task; of more each round is a written table, and a window holds the cells of one margin value, never documents.
    """
    cells = materialize(cells.where("tokens > 0").select(*DIMENSIONS, F.col("tokens").cast("long").alias("tokens")), "cells")
    n, have = cells.agg(F.count("*"), F.sum("tokens")).first()
    given = targets or {}
    if n <= LOCAL_CELLS:

        def run(table: pa.Table) -> pa.Table:
            weight, left, moved = _raked_here(table, given, share, tolerance)
            return pa.table({**{c: table[c] for c in (*DIMENSIONS, "tokens")}, "weight": weight, "residual": np.full(len(weight), left), "moved": np.full(len(weight), moved)})

        return cells.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(run, "source string, language string, topic string, tokens long, weight double, residual double, moved double")
    total = float(have or 0) * share
    for d in DIMENSIONS:
        cells = cells.join(_margin(cells, d, given.get(d), total).withColumnRenamed("target", f"target_{d}"), d)
    cells = cells.withColumn("weight", F.col("tokens") * F.lit(float(share)))
    own = [d for d in DIMENSIONS if given.get(d) is None]
    worst, moved = float("inf"), None
    while True:
        for _ in range(SWEEPS):
            cells = cells.withColumn("off", F.lit(0.0))
            for d in DIMENSIONS:
                cells = _scaled(cells, d)
        cells = materialize(cells, "cells")
        left = cells.agg(F.max("off")).first()[0] or 0.0
        if left <= tolerance or (left > worst * STALLED and (moved is not None or not own)):
            break
        if left > worst * STALLED:
            reached = {d: F.sum("weight").over(Window.partitionBy(d)) for d in own}
            change = F.greatest(F.lit(0.0), *[F.abs(F.col(f"_{d}") - F.col(f"target_{d}")) / F.greatest(f"target_{d}", F.lit(1.0)) for d in own])
            cells = materialize(cells.withColumns({f"_{d}": r for d, r in reached.items()}).withColumn("moved", change).withColumns({f"target_{d}": F.col(f"_{d}") for d in own}).drop(*[f"_{d}" for d in own]), "cells")
            moved, left = cells.agg(F.max("moved")).first()[0], float("inf")
            cells = cells.drop("moved")
        worst = left
    return cells.select(*DIMENSIONS, "tokens", "weight", F.lit(float(left)).alias("residual"), F.lit(float(moved or 0.0)).alias("moved"))


def _raked(keyed: DataFrame, targets, share: float) -> DataFrame:
    """source, language, topic, probability, residual and moved of each cell that has tokens."""
    cells = keyed.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))
    return rake(cells, targets, share).select(*DIMENSIONS, (F.col("weight") / F.col("tokens")).alias("probability"), "residual", "moved")


def mix_report(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = KEEP_SHARE) -> DataFrame:
    """doc_id, source, language, topic, n_tokens, probability, residual, moved, sampled for every row of ``docs``.

    The probability is the share of its cell's tokens that the raked mixture keeps; ``residual`` is the margins' largest
    error, ``moved`` how far targets of our own had to be moved to be met together (see ``rake``). Null sources and languages count as empty ones, null texts as texts without words; documents without words
    have no cell and are kept. Draws are hashes of doc_id and text, so rows equal in both share their fate, and each
    gets a row. An empty table gives no rows.
    """
    keyed = materialize(_keyed(docs, fit_topics(docs), ["doc_id", "text", "source", "lang"], ["doc_id"]), "mix")
    p = F.coalesce("probability", F.lit(1.0))
    found = keyed.join(_raked(keyed, targets, share), list(DIMENSIONS), "left")
    return found.select("doc_id", *DIMENSIONS, F.col("tokens").alias("n_tokens"), p.alias("probability"), *[F.when(F.col("tokens") > 0, F.col(c)).alias(c) for c in ("residual", "moved")], ((F.col("tokens") == 0) | (F.col("draw") < p)).alias("sampled"))


def sample_mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = KEEP_SHARE) -> DataFrame:
    """The sampled rows of ``docs`` with their columns, by the rules of ``mix_report``; no column's name can clash."""
    names = docs.columns
    inner = [f"c{i}" for i in range(len(names))]
    at = dict(zip(names, inner, strict=True))
    columns = [at[c] for c in ("doc_id", "text", "source", "lang")]
    topics = fit_topics(docs)
    renamed = docs.toDF(*inner)
    cells = _raked(materialize(_keyed(renamed, topics, columns, []).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells"), targets, share)
    joined = _keyed(renamed, topics, columns, inner).join(cells, list(DIMENSIONS), "left")
    return joined.where((F.col("tokens") == 0) | (F.col("draw") < F.coalesce("probability", F.lit(1.0)))).select(*inner).toDF(*names)
