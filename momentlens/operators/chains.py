"""Greedy chains, in which the next row taken depends on the last one taken: jump pointers inside pieces of a timeline, and
the pieces' entries as a smaller chain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentlens.operators.intervals import neighbours
from momentlens.operators.windows import in_blocks, running
from momentlens.sources.shared import written

#: Rows of a piece, and how many pieces make one of the next level.
PIECE, FAN = 4096, 64
#: Rows of a bucket, which holds pieces of many keys.
BUCKET = 1 << 18


def inside(group: np.ndarray, row: np.ndarray, to: np.ndarray) -> np.ndarray:
    """For each row the index of the row it leads to in the same group, itself where it leads out (``to`` is -1 at an end).
    Rows are sorted by group, then number."""
    span = int(max(row.max(), to.max())) + 2 if len(row) else 1
    place, wanted = group * span + row, group * span + to
    at = np.minimum(np.searchsorted(place, wanted), max(len(row) - 1, 0))
    return np.where((to >= 0) & (place[at] == wanted), at, np.arange(len(row)))


def last_inside(jump: np.ndarray) -> np.ndarray:
    """For each row the index of the last row of its group that its chain takes; by doubling."""
    while True:
        twice = jump[jump]
        if (twice == jump).all():
            return jump
        jump = twice


def taken(jump: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which rows the chains from ``starts`` take inside their groups: after k jumps of 1, 2, 4 ... all up to 2 ** k."""
    out = np.zeros(len(jump), bool)
    out[starts] = True
    for _ in range(max(1, len(jump)).bit_length()):
        out[jump[out]] = True
        jump = jump[jump]
    return out


def reached(steps: DataFrame, keys: list[str], size: int = PIECE, fan: int = FAN) -> DataFrame:
    """(keys, row) of the rows that the chain from each key's first row takes. ``steps`` has keys, row (unique, its first is
    0) and ``to``, a later row or null.

    A chain enters a piece once. The rows at which chains may enter pieces are a smaller chain, each with the row at which it
    enters the next piece; the same is done with that in longer pieces, until one piece is left. No task holds more than a
    piece, whose rows are taken by doubling.
    """
    table = written(steps.select(*keys, "row", F.coalesce("to", F.lit(-1)).cast("long").alias("to")), "steps")
    piece = lambda c: F.floor(F.col(c) / size)
    rows, most = table.agg(F.count("*"), F.max("row")).first()
    buckets = max(1, -(-rows // BUCKET))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*keys).schema)

    def in_buckets(df: DataFrame, run, schema: str) -> DataFrame:
        """Whole pieces, many to a task's group; a bucket's rows don't grow with the table."""
        dealt = df.withColumn("_piece", piece("row")).withColumn("_bucket", F.pmod(F.xxhash64(*keys, "_piece"), F.lit(buckets)))
        return dealt.groupBy("_bucket").applyInPandas(run, schema)

    def jumps(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        pdf = pdf.assign(_group=pdf.groupby([*keys, "_piece"], sort=False, dropna=False).ngroup()).sort_values(["_group", "row"])
        return pdf, inside(pdf["_group"].to_numpy(np.int64), pdf["row"].to_numpy(), pdf["to"].to_numpy()), pdf["entry"].to_numpy(bool)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, jump, entry = jumps(pdf)
        return pdf.loc[taken(jump, entry), [*keys, "row"]]

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, jump, entry = jumps(pdf)
        return pdf.assign(to=pdf["to"].to_numpy()[last_inside(jump)]).loc[entry, [*keys, "row", "to"]]

    if most is None or most < size:
        entries = table.withColumn("entry", F.col("row") == 0)
    else:
        crossing = table.where((F.col("to") >= 0) & (piece("to") > piece("row"))).select(*keys, F.col("to").alias("row")).distinct().withColumn("entry", F.lit(True))
        marked = written(table.join(crossing, [*keys, "row"], "left").withColumn("entry", F.coalesce("entry", F.col("row") == 0)), "entries")
        smaller = in_buckets(marked, exits, f"{fields}, row long, to long")
        through = reached(smaller.withColumn("to", F.when(F.col("to") >= 0, F.col("to"))), keys, size * fan, fan)
        entries = table.join(through.withColumn("entry", F.lit(True)), [*keys, "row"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    return in_buckets(entries, walk, f"{fields}, row long")


def chained(rows: DataFrame, keys: list[str], size: int = PIECE) -> DataFrame:
    """``rows`` (with ``row``, from 0, and ``to``) with ``taken``, whether the chain takes the row, and ``part``, the number of
    rows taken before it."""
    table = written(rows, "rows")
    found = reached(table.select(*keys, "row", "to"), keys, size).withColumn("taken", F.lit(True))
    marked = table.join(found, [*keys, "row"], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
    counted = running(marked, keys, ["row"], F.floor(F.col("row") / size), {"part": F.col("taken").cast("long")})
    return counted.withColumn("part", F.col("part") - 1)


def _first_of(conditions: list[Column], row: str = "row") -> Column:
    """The row after as many as the first condition that holds has places before it."""
    return F.col(row) + F.coalesce(*[F.when(c, j) for j, c in enumerate(conditions, 1)])


def _runs(pdf: pd.DataFrame, keys: list[str], longest: float) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by piece and start, an entry before the words of its time, the number of each row's piece and its first row, and the row of the same piece that the chain
    takes next (the end of the piece if it has none)."""
    pdf = pdf.assign(_group=pdf.groupby([*keys, "_piece"], sort=False).ngroup(), _later=~pdf["entry"].to_numpy(bool)).sort_values(["_group", "start_time", "_later"])
    group, start = pdf["_group"].to_numpy(np.int64), pdf["start_time"].to_numpy(float)
    cut = np.flatnonzero(np.diff(group, prepend=-1)) if len(group) else np.zeros(0, np.int64)
    ends = np.append(cut[1:], len(group))
    to = np.empty(len(group), np.int64)
    for a, b in zip(cut.tolist(), ends.tolist(), strict=True):
        to[a:b] = a + np.searchsorted(start[a:b], start[a:b] + longest, "left")
    return pdf, np.repeat(cut, ends - cut), np.repeat(ends, ends - cut), to


def greedy_paragraphs(words: DataFrame, keys: list[str], longest: float = 60.0, size: int = PIECE, span: float = 14400.0) -> DataFrame:
    """(keys, paragraph, start_time, end_time, words): a new paragraph when a word starts ``longest`` (above 0) after the first.

    Words without a start are left out, and so is a null key. A timeline is cut into pieces of ``span`` seconds; a piece gives parts of
    paragraphs, a row each, which are put together by running counts. The chain enters a piece at one of the words of its first ``longest``
    seconds or the one after: these are a smaller timeline, whose chain tells where. Only starts, ends and whether there is a word are
    moved, once where all timelines lie in one piece, twice else.
    """
    span = max(span, longest)
    piece = F.floor(F.col("start_time") / span)
    timed = words.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, "start_time")))
    rows = timed.select(*keys, F.col("start_time").cast("double").alias("start_time"), F.col("end_time").cast("double").alias("end_time"), F.col("word").isNotNull().cast("byte").alias("words"), F.lit(False).alias("entry"))
    n, first, last = rows.agg(F.count("*"), F.min(piece), F.max(piece)).first()
    buckets = max(1, -(-n // BUCKET))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def in_buckets(df: DataFrame, run, schema: str) -> DataFrame:
        bucket = F.pmod(F.xxhash64(*keys, piece), F.lit(buckets))
        return df.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandas(lambda pdf: run(pdf.assign(_piece=np.floor(pdf["start_time"].to_numpy(float) / span).astype(np.int64))), schema)

    def doors(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, begin, end, to = _runs(pdf, keys, longest)
        at = np.arange(len(to))
        end_of = last_inside(np.where(to < end, to, at))
        start, number = pdf["start_time"].to_numpy(), pdf["_piece"].to_numpy()
        # of the first piece of all only the first row can be an entry; a start that several words share is one
        before = np.concatenate([[-np.inf], start[:-1]])[: len(start)]
        open_ = (at == begin) | ((number > first) & (before < number * span + longest) & (start != before))
        return pdf.assign(last=start[end_of] if len(start) else start).loc[open_, [*keys, "start_time", "last"]]

    def parts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, begin, end, to = _runs(pdf, keys, longest)
        at = np.arange(len(to))
        entry = pdf["entry"].to_numpy(bool) | ((at == begin) & (pdf["_piece"].to_numpy() == first))
        new = taken(np.where(to < end, to, at), np.flatnonzero(entry))
        opened = pdf.assign(new=new.astype(np.int64), _part=np.cumsum(new | (at == begin)))
        sums = opened.groupby("_part", sort=False).agg(**{k: (k, "first") for k in keys}, start_time=("start_time", "min"), end_time=("end_time", "max"), words=("words", "sum"), new=("new", "max"))
        return sums.astype({"words": "int64"})[[*keys, "start_time", "end_time", "words", "new"]]

    if n and last > first:
        few = written(in_buckets(rows, doors, f"{fields}, start_time double, last double"), "doors")
        numbered = running(few, keys, ["start_time"], F.floor(F.col("start_time") / 3600), {"row": F.lit(1).cast("long")})
        numbered = written(numbered.withColumn("row", F.col("row") - 1), "numbered")
        none = F.lit(None).cast("long")
        near = neighbours(numbered.select(*keys, F.col("start_time").alias("t"), F.col("row").alias("next"), none.alias("row")).unionByName(numbered.select(*keys, (F.col("last") + longest).alias("t"), none.alias("next"), "row")), keys, "t", "next", max(longest, 1.0)).where("row IS NOT NULL")
        entered = reached(near.select(*keys, "row", F.col("after")["value"].alias("to")), keys, size)
        entries = numbered.join(entered, [*keys, "row"], "left_semi").select(*keys, "start_time", F.lit(None).cast("double").alias("end_time"), F.lit(0).cast("byte").alias("words"), F.lit(True).alias("entry"))
        rows = rows.unionByName(entries)
    found = in_buckets(rows, parts, f"{fields}, start_time double, end_time double, words long, new long")
    table = written(found, "parts")
    counted = running(table, keys, ["start_time", "new"], F.floor(F.col("start_time") / 3600), {"_opened": F.col("new")})
    return counted.groupBy(*keys, (F.col("_opened") - 1).alias("paragraph")).agg(F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("words").alias("words"))


# Words that open another topic, and those that do after a question.
CUES = ("now let's", "moving on", "speaking of", "by the way", "anyway", "meanwhile", "however", "on the other hand", "in other news", "next up", "switching gears")
OPENERS = ("alright", "okay", "well", "so")
_BLANKS = " \t\n\r\x0b\x0c"


def paragraphs_by_rules(segments: DataFrame, keys: list[str], pause: float = 0.8, longest: float = 20.0, most: int = 6, size: int = PIECE) -> DataFrame:
    """(keys, paragraph, start_time, end_time, segments, text): blank segments are left out; a paragraph begins after a
    pause, where it would reach ``longest`` seconds, after ``most`` segments, at a cue, or at an opener after a question.
    Segments are taken by their start, then end and text; those without a start or an end, or with a null key, are left out."""
    text = F.btrim(F.coalesce("text", F.lit("")), F.lit(_BLANKS))
    said = segments.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, "start_time", "end_time"))).withColumn("text", text).where("text <> ''")
    low = F.lower("text")
    opens = lambda words: F.lit(False) if not words else low.rlike("^(" + "|".join(words) + ")")
    flagged = said.withColumns({"_cue": opens([f"{c}[ ,]" for c in CUES]), "_opener": opens(OPENERS), "_asked": F.col("text").endswith("?")})

    def steps(w) -> dict[str, Column]:
        # what begins a paragraph wherever the one before began, and what depends on that
        def begins(j):
            at = lambda c: F.lead(c, j).over(w)
            before = (lambda c: F.lead(c, j - 1).over(w)) if j > 1 else F.col
            hard = (at("start_time") - before("end_time") >= pause) | at("_cue") | (at("_opener") & before("_asked"))
            own = at("end_time") - F.col("start_time") >= longest
            return at("start_time").isNotNull() & (hard | own | F.lit(j >= most))

        return {"to": _first_of([begins(j) for j in range(1, most + 1)], "_row") - 1}

    numbered = running(flagged, keys, ["start_time", "end_time", "text"], F.floor(F.col("start_time") / 3600), {"row": F.lit(1).cast("long")})
    table = written(numbered.withColumn("row", F.col("row") - 1), "segments")
    # texts stay behind until it is known which paragraph they are of
    found = in_blocks(table.drop("text"), keys, ["row"], F.floor(F.col("row") / size), 0, most, steps)
    out = table.select(*keys, "row", "start_time", "end_time", "text").join(chained(found.select(*keys, "row", "to"), keys, size).select(*keys, "row", "part"), [*keys, "row"])
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"]), " ")
    return out.groupBy(*keys, F.col("part").alias("paragraph")).agg(F.min("start_time").alias("start_time"), F.max_by("end_time", "row").alias("end_time"), F.count("*").alias("segments"), texts.alias("text"))


def meaningful_updates(updates: DataFrame, keys: list[str], order: str, step: float = 0.1, every: int = 10, size: int = PIECE) -> DataFrame:
    """Updates whose progress moved ``step`` since the last kept one, whose stage changed, or every tenth; ``order`` is a
    whole number. Updates with a null key or order are left out; a missing progress hasn't moved."""
    whole = updates.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, order)))

    def steps(w) -> dict[str, Column]:
        def kept(j):
            at = lambda c: F.lead(c, j).over(w)
            moved = F.coalesce(F.abs(at("progress") - F.col("progress")) >= step - 1e-12, F.lit(False))
            return at(order).isNotNull() & (moved | ~at("stage").eqNullSafe(F.col("stage")) | F.lit(j >= every))

        return {"to": _first_of([kept(j) for j in range(1, every + 1)], "_row") - 1}

    found = in_blocks(whole, keys, [order], F.floor(F.col(order) / size), 0, every, steps)
    table = written(found.withColumn("row", F.col("_row") - 1).drop("_row"), "updates")
    return table.join(reached(table.select(*keys, "row", "to"), keys, size), [*keys, "row"], "left_semi").select(*updates.columns)
