"""Fill-in-the-middle: texts cut in three at random places and put in another order, by a Fenwick tree over blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentlens.llm.text import NON_SPACE, small_batches, utf8

#: Bytes of a block; a text of any length is blocks of this size and a shorter last one.
BLOCK = 512
MARKS = ("<P>", "<S>", "<M>")
UNITS = ("chars", "words", "lines")


def unit_starts(buf: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """Which bytes begin a unit: a code point, a word with the space after it, or a line with its end."""
    if unit == "chars":
        return (buf & 0xC0) != 0x80
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit}")
    before = np.concatenate([[0x0A], buf[:-1]]).astype(np.uint8) if len(buf) else buf
    starts = NON_SPACE[buf] & ~NON_SPACE[before] if unit == "words" else before == 0x0A
    starts[offsets[:-1][np.diff(offsets) > 0]] = True
    return starts


class Forest:
    """A Fenwick tree a text over the units and the code points that begin in each of its blocks."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, unit: str = "chars", block: int = BLOCK):
        self.offsets, self.block = offsets, block
        self.blocks = -(-np.diff(offsets) // block)
        self.base = np.concatenate([[0], np.cumsum(self.blocks)])
        owner = np.repeat(np.arange(len(self.blocks)), self.blocks)
        self.local = np.arange(self.base[-1]) - self.base[owner] + 1
        self.begin = offsets[owner] + (self.local - 1) * block
        self.units, self.points = unit_starts(buf, offsets, unit), unit_starts(buf, offsets, "chars")
        self.tree = np.zeros((len(owner), 2), np.int64)
        if len(owner):
            for i, flags in enumerate((self.units, self.points)):
                self.tree[:, i] = np.add.reduceat(flags, self.begin, dtype=np.int64)
        self.totals = np.zeros((len(self.blocks), 2), np.int64)
        full = self.blocks > 0
        if full.any():
            self.totals[full] = np.add.reduceat(self.tree, self.base[:-1][full], axis=0)
        step, count = 1, self.blocks[owner]
        while step < (self.blocks.max() if len(self.blocks) else 0):
            # a node hands its sum to the next node above it; those of one lowest bit do so at once
            from_ = np.flatnonzero(((self.local & -self.local) == step) & (self.local + step <= count))
            self.tree[from_ + step] += self.tree[from_]
            step *= 2

    def cut(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text, the byte and the code point at which its unit ``k`` begins; its end where it has only ``k``."""
        at, rest, points = np.zeros(len(k), np.int64), k.astype(np.int64), np.zeros(len(k), np.int64)
        step = 1 << max(0, int(self.blocks.max() if len(k) else 0).bit_length() - 1)
        while step and len(self.tree):
            to = at + step
            node = self.tree[np.minimum(self.base[:-1] + to - 1, len(self.tree) - 1)]
            down = (to <= self.blocks) & (node[:, 0] <= rest)
            at, rest, points = np.where(down, to, at), rest - down * node[:, 0], points + down * node[:, 1]
            step //= 2
        where = self.offsets[1:].copy()
        inner = np.flatnonzero(at < self.blocks)
        for some in np.array_split(inner, max(1, len(inner) * self.block >> 22)):  # a few MB of blocks at a time
            place = self.offsets[some, None] + at[some, None] * self.block + np.arange(self.block)
            held = place < self.offsets[some + 1, None]
            place = np.minimum(place, len(self.units) - 1)
            first = (np.cumsum(self.units[place] & held, axis=1) > rest[some, None]).argmax(axis=1)
            where[some] = place[np.arange(len(some)), first]
            points[some] += ((self.points[place] & held) & (np.arange(self.block) < first[:, None])).sum(axis=1)
        return where, points


def _forms(raw: bytes, offsets: np.ndarray, plain: np.ndarray, spm: np.ndarray) -> np.ndarray:
    marks = [m.encode() for m in MARKS]
    out = np.where(spm, "spm", "psm").astype(object)
    marked = any(m in raw for m in marks)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if a == b or plain[i] or (marked and any(raw.find(m, a, b) >= 0 for m in marks)):
            out[i] = "plain"
    return out


def fill_in_middle(docs: DataFrame, unit: str = "chars", rate: int = 90, spm_rate: int = 20, seed: str = "1", block: int = BLOCK) -> DataFrame:
    """doc_id, n, form, prefix_units, middle_units, prefix_chars, middle_chars, output for every row of ``docs``.

    ``n`` is the number of the text's units (``UNITS``). Cuts and form are drawn from the digits of the SHA-256 of the
    seed and doc_id, so equal rows are cut alike; a null doc_id draws as no digits. ``rate`` percent of the texts are put
    in another order, ``spm_rate`` percent of these with the suffix first; an empty or null text and one that holds a
    mark stays as it is (``plain``, no counts). Any length of text: only the blocks that hold a cut are searched. No shuffle.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit: {unit}")
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]

    def run(batches):
        for batch in small_batches(batches):
            buf, offsets = utf8(batch["text"])
            raw = buf.tobytes()
            h = [batch[f"h{i + 1}"].to_numpy() for i in range(4)]
            forest = Forest(buf, offsets, unit, block)
            n = forest.totals[:, 0]
            ends = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
            (one, one_points), (two, two_points) = forest.cut(ends[0]), forest.cut(ends[1])
            form = _forms(raw, offsets, h[2] % 100 >= rate, h[3] % 100 < spm_rate)
            out = []
            for kind, a, b, c, d in zip(form, offsets[:-1].tolist(), one.tolist(), two.tolist(), offsets[1:].tolist(), strict=True):
                if kind == "plain":
                    out.append(raw[a:d])
                elif kind == "psm":
                    out.append(b"".join((b"<P>", raw[a:b], b"<S>", raw[c:d], b"<M>", raw[b:c])))
                else:
                    out.append(b"".join((b"<S>", raw[c:d], b"<P>", raw[a:b], b"<M>", raw[b:c])))
            plain = form == "plain"
            counts = [pa.array(x, pa.int64(), mask=plain) for x in (ends[0], ends[1] - ends[0], one_points, two_points - one_points)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n), pa.array(form, pa.string()), *counts, pa.array(out, pa.binary())], names)

    names = ["doc_id", "n", "form", "prefix_units", "middle_units", "prefix_chars", "middle_chars", "output"]
    schema = docs.select("doc_id").schema
    for c in names[1:]:
        schema = schema.add(c, {"form": "string", "output": "binary"}.get(c, "long"))
    made = docs.select("doc_id", "text", *draws).mapInArrow(run, schema)
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made of."""
    parts = F.split(output, "|".join(MARKS), -1)
    whole = lambda *at: F.transform(F.array(parts), lambda p: F.concat(*[p[i] for i in at]))[0]
    return F.when(form == "psm", whole(1, 3, 2)).when(form == "spm", whole(2, 3, 1)).otherwise(output)
