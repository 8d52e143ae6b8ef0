"""Conversation structure repair: cheapest edits to alternating turns, by a Viterbi pass in chunks whose ranks converge.

A conversation may be longer than a task can hold, so its turns are dealt by ranges and cut into chunks. Each chunk runs
backward from a speculative vector of costs to go; as long as the vector that the chunk after it found differs by more than
a constant, the chunk runs again, until its vectors do. Then all costs are known up to constants, and the least audit
is traced forward in every chunk from each state at once; the states that chunks begin in are composed last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentlens.llm.shared import groups_for, materialize
from momentlens.llm.text import utf8, words

#: Turns of a conversation in a chunk.
CHUNK = 4096
DELETE, REROLE, INSERT, UNFINISHED = 4, 3, 3, 3
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. A turn of the role NEED may follow.
START, SYSTEM, USER, ASSISTANT = range(4)
NEED = np.array([USER, USER, ASSISTANT, USER])
ROLES = np.array(["", "system", "user", "assistant"])
#: Costs to go at the end: a conversation may be empty or end with an assistant turn.
END = np.array([0, 2 * INSERT, INSERT, 0])
_NO = 1 << 40

# A turn's code: its role (system, user, assistant, other) + 4 * (0 sound, 1 to be deleted, 2 unfinished).
_KEEP, _TO, _REROLE = np.full((12, 4), _NO), np.zeros((12, 4), np.int64), np.full(12, _NO)
for _code in range(12):
    _role, _fault = _code % 4, _code // 4
    if _fault != 1:
        _more = UNFINISHED * (_fault == 2)
        _REROLE[_code] = REROLE + _more
        for _s in range(4):
            if (_role == 0 and _s == START) or (_role == 1 and NEED[_s] == USER) or (_role == 2 and NEED[_s] == ASSISTANT):
                _KEEP[_code, _s], _TO[_code, _s] = _more, _role + 1


def costs_before(codes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs to go [turns, states] before each of some turns, from those after it."""
    keep = _KEEP[codes] + np.take_along_axis(after, _TO[codes], 1)
    v = np.minimum(np.minimum(after + DELETE, keep), _REROLE[codes][:, None] + after[:, NEED])
    user, assistant = v[:, USER].copy(), v[:, ASSISTANT].copy()
    v[:, USER], v[:, ASSISTANT] = np.minimum(user, assistant + INSERT), np.minimum(assistant, user + INSERT)
    v[:, :USER] = np.minimum(v[:, :USER], v[:, USER : USER + 1] + INSERT)
    return v


def costs_to_go(codes: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Vectors before each turn of some chunks and, as each chunk's last, the one given at its end. Chunks run side by side."""
    n, length = len(ends), np.diff(offsets)
    out = np.empty((len(codes) + n, 4), np.int64)
    at_end = offsets[1:] + np.arange(n)
    out[at_end] = ends
    order = np.argsort(-length, kind="stable")
    for step in range(1, int(length.max()) + 1 if n else 1):
        live = order[: np.searchsorted(-length[order], -step, "right")]
        at = at_end[live] - step
        out[at] = costs_before(codes[offsets[live + 1] - step], out[at + 1])
    return out


def converge(codes: np.ndarray, vectors: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, int]:
    """A chunk's vectors from another end, and how many turns were run again until new and old differed by a constant."""
    vectors, v = vectors.copy(), end
    vectors[-1] = v
    for i in range(len(codes) - 1, -1, -1):
        v = costs_before(codes[i : i + 1], v[None])[0]
        shift = v - vectors[i]
        if (shift == shift[0]).all():
            vectors[: i + 1] += shift[0]
            return vectors, len(codes) - 1 - i
        vectors[i] = v
    return vectors, len(codes)


def least_edits(codes: np.ndarray, here: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each turn and each state before it the cheapest edit, ASCII-least first: 4 * inserts + (0 D, 2 K, 3 R), and the state after."""
    can = np.stack([after + DELETE == here, here[:, NEED] + INSERT == here, _KEEP[codes] + np.take_along_axis(after, _TO[codes], 1) == here, _REROLE[codes][:, None] + after[:, NEED] == here])
    pick = can.argmax(axis=0)
    state, inserts = np.tile(np.arange(4), (len(codes), 1)), np.zeros((len(codes), 4), np.int64)
    for _ in range(2):
        more = np.take_along_axis(pick, state, 1) == 1
        state, inserts = np.where(more, NEED[state], state), inserts + more
    edit = np.take_along_axis(pick, state, 1)
    to = np.where(edit == 0, state, np.where(edit == 2, np.take_along_axis(_TO[codes], state, 1), NEED[state]))
    return 4 * inserts + edit, to


def walk(offsets: np.ndarray, to: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States before each turn, and after each chunk's last, of chunks entered in the states ``entry`` [chunks, ways]."""
    length, state = np.diff(offsets), entry.copy()
    before = np.zeros((len(to), entry.shape[1]), np.int64)
    order = np.argsort(-length, kind="stable")
    for step in range(int(length.max()) if len(length) else 0):
        live = order[: np.searchsorted(-length[order], -step - 1, "right")]
        row = offsets[live] + step
        before[row] = state[live]
        state[live] = np.take_along_axis(to[row], state[live], 1)
    return before, state


def damage(rows: DataFrame) -> DataFrame:
    """Turns as a faulty export would leave them, by a checksum of conversation and turn: of twenty, one is lost, one is
    emptied, one loses its sentence ends, one comes twice and one is said to be the user's. Null roles and texts become a space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("_way") == 1, "").when(F.col("_way") == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(F.col("_way") == 4, "user").otherwise(said("role"))
    left = rows.select("conv_id", "turn", "role", "text", way.alias("_way")).where("_way <> 0")
    return left.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("_way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def _placed(rows: DataFrame, chunk: int) -> DataFrame:
    """Turns in order, as a written table: conv_id, place (ordered and unique), piece, turn, role, text, code, same.

    Ranges end where they do, whatever conversation they cut, and equal turns are dealt over several of them. The code knows
    nothing of repeats yet; ``same`` is the digest of role and text.
    """
    said = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    size = said.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    head, tie = F.substring("text", 1, 64), F.xxhash64("text")
    keyed = said.withColumns({"_head": head, "_tie": tie, "_uid": F.monotonically_increasing_id()})
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "_head", "_tie", "_uid"]
    ranged = keyed.repartitionByRange(groups_for(size, 16 << 20, 4), *order).sortWithinPartitions(*order).drop("_head", "_tie", "_uid")
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))

    def run(batches):
        from pyspark import TaskContext

        place, last, run_length = TaskContext.get().partitionId() << 40, (), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            buf, offsets = utf8(batch["text"])
            _, ends, first = words(buf, offsets)
            blank = first[1:] == first[:-1]
            closed = np.zeros(n, bool)
            closed[~blank] = np.isin(buf[ends[first[1:][~blank] - 1] - 1], list(b".!?"))
            names, at = utf8(batch["role"])
            initial = np.where(np.diff(at) > 0, names[np.minimum(at[:-1], max(len(names) - 1, 0))] if len(names) else 0, 0)
            role = np.select([initial == ord("s"), initial == ord("u"), initial == ord("a")], [0, 1, 2], 3)
            code = role + 4 * np.where(blank, 1, np.where(closed, 0, 2))
            # rows of the conversation so far in this range, which chunks are counted by
            conv = batch["conv_id"].to_pylist()
            piece = np.empty(n, np.int32)
            for i, c in enumerate(conv):
                run_length = run_length + 1 if last == (c,) else 0
                last, piece[i] = (c,), run_length // chunk
            yield pa.RecordBatch.from_arrays([batch["conv_id"], pa.array(place + np.arange(n)), pa.array(piece), batch["turn"], batch["role"], batch["text"], pa.array(blank), pa.array(code, pa.int32()), batch["same"]], names_out)
            place += n

    names_out = ["conv_id", "place", "piece", "turn", "role", "text", "blank", "code", "same"]
    schema = rows.select("conv_id").schema.add("place", "long").add("piece", "integer").add(rows.select("turn").schema[0])
    for c, t in (("role", "string"), ("text", "string"), ("blank", "boolean"), ("code", "integer"), ("same", "binary")):
        schema = schema.add(c, t)
    return materialize(ranged.withColumn("same", digest).mapInArrow(run, schema), "turns")


def _coded(placed: DataFrame) -> DataFrame:
    """(conv_id, place, piece, turn, code): turns that were said before, role and text, get the code to be deleted.

    First places are counted before the shuffle, so a sentence that a conversation repeats without end is no hot key.
    """
    slim = placed.select("conv_id", "place", "piece", "turn", "code", "blank", "same")
    first = slim.where("NOT blank").groupBy("conv_id", "same").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("new"))
    again = ~F.col("blank") & F.col("new").isNull()
    marked = slim.join(first, "place", "left")
    return marked.select("conv_id", "place", "piece", "turn", F.when(again, F.col("code") % 4 + 4).otherwise(F.col("code")).cast("byte").alias("code"), F.col("blank").alias("blank"), again.alias("again"))


def _chunks(coded: DataFrame) -> DataFrame:
    """A row a chunk: conv_id, place (of its first turn), codes, blank, duplicate, head and tail (first and last role), and
    ``before``/``final``: the last role of the chunk before, and whether no chunk follows."""
    turns = F.array_sort(F.collect_list(F.struct("place", "code")))
    grouped = coded.groupBy("conv_id", F.shiftright("place", 40).alias("part"), "piece").agg(F.min("place").alias("place"), F.transform(turns, lambda t: t["code"]).alias("codes"), F.count_if("blank").alias("blank"), F.count_if("again").alias("duplicate"))
    line = Window.partitionBy("conv_id").orderBy("place")
    last = F.element_at("codes", -1) % 4
    return grouped.drop("part", "piece").withColumns({"before": F.lag(last).over(line).cast("int"), "final": F.lead("place").over(line).isNull(), "first": F.lag("place").over(line).isNull()})


def _flat(batch) -> tuple[np.ndarray, np.ndarray]:
    lists = batch["codes"]
    return lists.flatten().to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)


_VECTORS = T.ArrayType(T.LongType())


def _lists(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), pa.array(values)).cast(pa.list_(pa.int64()))


def solved(chunks: DataFrame) -> DataFrame:
    """The chunks with ``vectors``, their costs to go (exact up to a constant a chunk), and ``lift``, the constant.

    Conversations of one chunk are done at once. The chunks of the others start from zeros; a pass runs those again whose
    end isn't, up to a constant, what the chunk after them began with. As a pass settles the last unsettled chunk of every
    conversation at least, there are no more passes than chunks, and two or so where vectors converge inside a chunk.
    """
    schema = T.StructType([*chunks.schema, T.StructField("vectors", _VECTORS)])

    def speculate(batches):
        for batch in batches:
            codes, offsets = _flat(batch)
            final = batch["final"].to_numpy(zero_copy_only=False)
            vectors = costs_to_go(codes, offsets, np.where(final[:, None], END, 0))
            cuts = 4 * (offsets + np.arange(len(offsets)))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(vectors.reshape(-1), cuts)], [*batch.schema.names, "vectors"])

    tried = materialize(chunks.mapInArrow(speculate, schema), "chunks")
    whole, cut = tried.where("first AND final"), tried.where("NOT (first AND final)")
    line = Window.partitionBy("conv_id").orderBy("place")

    def following(df: DataFrame) -> DataFrame:
        ahead = F.lead(F.slice("vectors", 1, 4)).over(line)
        least = F.array_min("ahead")
        end = F.slice("vectors", -4, 4)
        relative = lambda v, m: F.transform(v, lambda x: x - m)
        return df.withColumn("ahead", ahead).withColumns({"wanted": relative(F.col("ahead"), least), "stale": F.col("ahead").isNotNull() & (relative(F.col("ahead"), least) != relative(end, F.array_min(end)))}).drop("ahead")

    def again(batches):
        for batch in batches:
            codes, offsets = _flat(batch)
            old = [np.asarray(v, np.int64).reshape(-1, 4) for v in batch["vectors"].to_pylist()]
            wanted, stale = batch["wanted"].to_pylist(), batch["stale"].to_pylist()
            for i in np.flatnonzero(stale):
                old[i], _ = converge(codes[offsets[i] : offsets[i + 1]], old[i], np.array(wanted[i]))
            flat = np.concatenate(old).reshape(-1) if old else np.zeros(0, np.int64)
            kept = [batch[c] for c in schema.fieldNames() if c != "vectors"]
            yield pa.RecordBatch.from_arrays([*kept, _lists(flat, 4 * (offsets + np.arange(len(offsets))))], schema.fieldNames())

    while cut.limit(1).count():
        state = materialize(following(cut), "passes")
        if not state.where("stale").limit(1).count():
            break
        cut = materialize(state.mapInArrow(again, schema), "chunks")
    # what a chunk's vectors lack: the least of those that the chunks after it begin with
    begin, end = F.array_min(F.slice("vectors", 1, 4)), F.array_min(F.slice("vectors", -4, 4))
    lift = F.coalesce(F.sum(F.when(~F.col("first"), F.col("_begin") - F.col("_lead"))).over(line.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    lifted = cut.withColumns({"_begin": begin, "_lead": F.when(F.col("final"), 0).otherwise(end)}).withColumn("lift", lift - F.col("_lead")).drop("_begin", "_lead")
    return whole.withColumn("lift", F.lit(0).cast("long")).unionByName(lifted)


def _edits(batch, ways: np.ndarray):
    codes, offsets = _flat(batch)
    vectors = batch["vectors"].flatten().to_numpy().reshape(-1, 4)
    here = np.arange(len(codes)) + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    acts, to = least_edits(codes, vectors[here], vectors[here + 1])
    before, after = walk(offsets, to, ways)
    return codes, offsets, acts, before, after, vectors


_SIGNS = np.array(["I" * (c // 4) + "D?KR"[c % 4] for c in range(12)])


def traced(chunks: DataFrame) -> DataFrame:
    """The solved chunks with ``entry``, the state in which the traced path enters each."""

    def maps(batches):
        for batch in batches:
            *_, after, _ = _edits(batch, np.tile(np.arange(4), (batch.num_rows, 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(after.reshape(-1), 4 * np.arange(len(after) + 1))], [*batch.schema.names, "after"])

    whole, cut = chunks.where("first AND final"), chunks.where("NOT (first AND final)")
    mapped = cut.mapInArrow(maps, T.StructType([*cut.schema, T.StructField("after", _VECTORS)]))
    way = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    # a few numbers a chunk of CHUNK turns: maps of states compose from the conversation's beginning on
    earlier = F.collect_list("after").over(way)
    entry = F.aggregate(earlier, F.lit(0).cast("long"), lambda s, m: F.get(m, s.cast("int")))
    return whole.withColumn("entry", F.lit(0).cast("long")).unionByName(mapped.withColumn("entry", entry).drop("after"))


def repair(rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Two tables: a report a conversation, and the repaired turns.

    ``rows`` has conv_id, turn, role and text; a null role or text is one space, a null conv_id a conversation of its own.
    Turns are taken by turn (nulls first), then role and text. A turn's first fault counts: blank, duplicate (role and
    text were seen in the conversation), truncated (its last character ends no sentence). The edits keep a turn, give it the role user
    or assistant, delete it (as they must where it is blank or a duplicate) or insert an empty one, so that an optional system turn
    and pairs of user and assistant remain; of the cheapest, the ASCII-least audit is taken. Only roles' first letters
    count; a turn of an empty role can't be kept.

    Report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Turns: conv_id, place, sub (their order), edit (K, R, I), turn
    (null where inserted), role, text. No rows give none.
    """
    placed = _placed(rows, chunk)
    coded = materialize(_coded(placed), "codes")
    chunks = materialize(traced(solved(_chunks(coded))), "traced")
    per_turn = coded.groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    gaps = per_turn.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    legal = np.zeros((4, 4), bool)
    legal[0, 1] = legal[1, 2] = legal[2, 1] = True

    def summed(batches):
        for batch in batches:
            entry = batch["entry"].to_numpy()
            codes, offsets, acts, before, after, vectors = _edits(batch, entry[:, None])
            role = codes % 4
            pair = np.concatenate([[False], ~legal[role[:-1], role[1:]]]) if len(role) else np.zeros(0, bool)
            pair[offsets[:-1]] = False
            before_role = batch["before"].fill_null(-1).to_numpy()
            at = offsets[:-1]
            illegal = np.add.reduceat(pair, at, dtype=np.int64) + ((before_role >= 0) & ~legal[np.maximum(before_role, 0), role[at]])
            signs = _SIGNS[acts[np.arange(len(codes)), before[:, 0]]].tolist()
            tail = np.where(batch["final"].to_numpy(zero_copy_only=False), END[after[:, 0]] // INSERT, 0)
            audit = ["".join(signs[a:b]) + "I" * t for a, b, t in zip(offsets[:-1].tolist(), offsets[1:].tolist(), tail.tolist(), strict=True)]
            cost = np.where(batch["first"].to_numpy(zero_copy_only=False), vectors[offsets[:-1] + np.arange(len(entry)), START] + batch["lift"].to_numpy(), 0)
            unfinished = np.add.reduceat(codes // 4 == 2, at, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch["conv_id"], batch["place"], batch["blank"], batch["duplicate"], pa.array(unfinished), pa.array(illegal), pa.array(cost), pa.array(audit)], summary)

    summary = ["conv_id", "place", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    schema = rows.select("conv_id").schema
    for c in summary[1:]:
        schema = schema.add(c, "string" if c == "audit" else "long")
    parts = chunks.mapInArrow(summed, schema)
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "audit"))), lambda p: p["audit"]), "")
    totals = parts.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in summary[2:7]], audit.alias("audit"))
    report = gaps.join(totals, gaps["conv_id"].eqNullSafe(totals["conv_id"])).select(gaps["conv_id"], "gaps", *summary[2:])
    return report, _repaired(chunks, placed)


def _repaired(chunks: DataFrame, placed: DataFrame) -> DataFrame:
    """The turns that the traced path leaves: kept ones, those with another role, and inserted ones."""

    def run(batches):
        for batch in batches:
            codes, offsets, acts, before, after, _ = _edits(batch, batch["entry"].to_numpy()[:, None])
            rows = np.arange(len(codes))
            owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            act, state = acts[rows, before[:, 0]], before[:, 0]
            place = batch["place"].to_numpy()[owner] + rows - offsets[owner]
            # one line for each insert and each turn that stays: its owner, place, order there, edit and new role
            made = []
            for sub in range(2):
                some = act // 4 > sub
                made.append((owner[some], place[some], np.full(some.sum(), sub), np.full(some.sum(), "I"), ROLES[NEED[state[some]]]))
                state = np.where(some, NEED[state], state)
            some = act % 4 >= 2
            made.append((owner[some], place[some], np.full(some.sum(), 2), np.where(act[some] % 4 == 2, "K", "R"), np.where(act[some] % 4 == 2, "", ROLES[NEED[state[some]]])))
            tail = np.where(batch["final"].to_numpy(zero_copy_only=False), END[after[:, 0]] // INSERT, 0)
            state, last = after[:, 0], batch["place"].to_numpy() + np.diff(offsets) - 1
            for sub in range(2):
                some = np.flatnonzero(tail > sub)
                made.append((some, last[some], np.full(len(some), 3 + sub), np.full(len(some), "I"), ROLES[NEED[state[some]]]))
                state = np.where(tail > sub, NEED[state], state)
            columns = [np.concatenate(c) for c in zip(*made, strict=True)]
            conv = batch["conv_id"].take(pa.array(columns[0]))
            yield pa.RecordBatch.from_arrays([conv, pa.array(columns[1]), pa.array(columns[2], pa.int32()), pa.array(columns[3].tolist(), pa.string()), pa.array(columns[4].tolist(), pa.string())], names)

    names = ["conv_id", "place", "sub", "edit", "new_role"]
    schema = chunks.select("conv_id").schema
    for c, t in zip(names[1:], ("long", "integer", "string", "string"), strict=True):
        schema = schema.add(c, t)
    lines = chunks.mapInArrow(run, schema)
    inserted = lines.where("edit = 'I'").select("conv_id", "place", "sub", "edit", F.lit(None).cast(placed.schema["turn"].dataType).alias("turn"), F.col("new_role").alias("role"), F.lit("").alias("text"))
    stay = lines.where("edit <> 'I'").drop("conv_id").join(placed.select("conv_id", "place", "turn", "role", "text"), "place")
    role = F.when(F.col("edit") == "R", F.col("new_role")).otherwise(F.col("role"))
    return stay.select("conv_id", "place", "sub", "edit", "turn", role.alias("role"), "text").unionByName(inserted)


def digests(turns: DataFrame, line: Column) -> DataFrame:
    """(conv_id, sha256) of each conversation's lines in order, joined by newlines.

    A SHA-256 can't be put together from parts, so a conversation's lines pass one task, one after the other; none are held.
    """

    def run(batches):
        now, made = (), None
        for batch in batches:
            done = []
            for c, text in zip(batch["conv_id"].to_pylist(), batch["line"].to_pylist(), strict=True):
                if now != (c,):
                    if made is not None:
                        done.append((now[0], made.hexdigest()))
                    now, made = (c,), hashlib.sha256(text.encode())
                else:
                    made.update(b"\n" + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.schema.field("conv_id").type), pa.array([d[1] for d in done], pa.string())], ["conv_id", "sha256"])
            kind = batch.schema.field("conv_id").type
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], kind), pa.array([made.hexdigest()])], ["conv_id", "sha256"])

    lines = turns.select("conv_id", "place", "sub", line.alias("line"))
    dealt = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place", "sub").select("conv_id", "line")
    return dealt.mapInArrow(run, turns.select("conv_id").schema.add("sha256", "string"))
