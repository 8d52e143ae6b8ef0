"""Conversation repair against plain recursion, in chunks of several sizes; damaged tables; edge cases."""

import functools
import hashlib
import random
import zlib

import numpy as np
import pytest

from momentlens.llm import conversations, queries

SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """(role, text) in order to (initial, fault) as the contract has it."""
    seen, out = set(), []
    for role, text in rows:
        if not text.strip(SPACE):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "" if text.rstrip(SPACE)[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def cheapest(marked):
    """(cost, audit) by plain recursion over all edits."""
    to = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    need = {"0": "u", "s": "u", "a": "u", "u": "a"}

    @functools.cache
    def best(i, state, inserts=0):
        found = []
        if inserts < 2:
            cost, audit = best(i, need[state], inserts + 1)
            found.append((cost + 3, "I" + audit))
        if i == len(marked):
            if state in "0a":
                found.append((0, ""))
        else:
            initial, fault = marked[i]
            cost, audit = best(i + 1, state)
            found.append((cost + 4, "D" + audit))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (state, initial) in to:
                    cost, audit = best(i + 1, to[state, initial])
                    found.append((cost + more, "K" + audit))
                cost, audit = best(i + 1, need[state])
                found.append((cost + more + 3, "R" + audit))
        return min(found) if found else (1 << 30, "")

    return best(0, "0")


def applied(rows, audit):
    out, state, at = [], "0", 0
    need = {"0": "user", "s": "user", "a": "user", "u": "assistant"}
    for edit in audit:
        if edit == "I":
            out.append((need[state], ""))
        else:
            role, text = rows[at]
            at += 1
            if edit == "D":
                continue
            out.append((need[state] if edit == "R" else role, text))
        state = out[-1][0][:1]
    return out


def expected(rows):
    """One conversation's (turn, role, text), in order, to the row of the contract."""
    pairs = [(r, t) for _, r, t in rows]
    marked = faults(pairs)
    cost, audit = cheapest(tuple(marked))
    turns = [t for t, _, _ in rows if t is not None]
    initials = [i for i, _ in marked]
    count = lambda f: sum(x == f for _, x in marked)
    illegal = sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in zip(initials, initials[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    text = "\n".join(f"{r}:{t}" for r, t in applied(pairs, audit))
    return gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def by_order(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    for conv, turn, role, text in sorted([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], key=key):
        out.setdefault(conv, []).append((turn, role, text))
    return out


def repaired(spark, rows, chunk):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, place int, audit string").repartition(3)
    report, turns = conversations.repair(df, chunk)
    hashes = {r.conv_id: r.sha256 for r in conversations.digests(turns, conversations.F.concat("role", conversations.F.lit(":"), "text")).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashes.get(r.conv_id, empty)) for r in report.collect()}


def _random_rows(seed, n, convs):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]
    texts = ["Fine.", "No end", "", " \t", None, "What?", "Éé!", "Ja. \n", "和。", "a.b"]
    return [(rng.choice([*convs, convs[0]]), rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"{rng.randrange(10 * n)}{rng.choice('.!? x')}") for _ in range(n)]


@pytest.mark.parametrize(("seed", "chunk"), [(1, 3), (2, 1), (3, 4096), (4, 7)])
def test_repair_equals_recursion_whatever_the_chunk(spark, seed, chunk):
    rows = _random_rows(seed, 160, [1, 2, None, 4])
    rows += [(9, 0, "user", "Hi."), (9, 1, "assistant", "Hello."), (10, None, None, None), (11, 3, "system", "Be kind."), *[(12, 5, "user", "Same.")] * 9, (13, 0, "assistant", "x" * 300_000), (13, 1, "user", "y" * 300_000 + "!")]
    want = {c: expected(r) for c, r in by_order(rows).items()}
    assert repaired(spark, rows, chunk) == want


def test_no_rows_give_none(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    report, turns = conversations.repair(empty)
    assert report.count() == 0 and turns.count() == 0


def test_vectors_of_any_end_become_those_of_the_right_one():
    rng = np.random.default_rng(5)
    for n in (1, 2, 50, 400):
        codes = rng.integers(0, 12, n)
        offsets = np.array([0, n])
        right = conversations.costs_to_go(codes, offsets, conversations.END[None])
        guess = conversations.costs_to_go(codes, offsets, np.zeros((1, 4), np.int64))
        fixed, ran = conversations.converge(codes, guess, conversations.END)
        assert (fixed == right).all() and (n < 50 or ran < n)


def test_query_equals_recursion_on_the_damaged_table(spark):
    """Every row of the query over a whole table."""
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    damaged = []
    for c, t, r, x in rows:
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if way == 0:
            continue
        x = "" if way == 1 else x.translate({ord(m): None for m in ".!?"}) if way == 2 else x
        damaged += [(c, t, "user" if way == 4 else r, x)] * (2 if way == 3 else 1)
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in rows}
    want |= {c: expected(r) for c, r in by_order(damaged).items()}
    got = queries.op11_conversation_repair(spark, sf)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
    assert any(w[2] for w in want.values()) and any(w[4] for w in want.values())
