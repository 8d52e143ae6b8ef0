"""Each operator on rows with nulls, empty texts, ties, repeated rows and clashing columns, and against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from momentlens.llm import bwt_merge, decontaminate, hash_tree, license_scan, mixing, quality, queries, repeats, shared, simhash, suffix_tree, text, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, shard int, fingerprint string"
_long = "  ".join(f"word{i % 7000}" for i in range(30000))
_pass = " ".join(f"p{i}" for i in range(60))
ROWS = [
    (1, "The cat sat on the mat. " * 12, "en", "a"),
    (2, f"Before {_pass} after é中文🙂", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, f"other {_pass} end <|endoftext|> don't 're 'll", "fr", "b"),
    (6, _long, "de", "b"),
    (7, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "en", "c"),
    (7, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "en", "c"),
    (8, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "en", "c"),
    (8, "same id, another text", "en", "c"),
    (None, f"no id {_pass}", "en", None),
    (None, None, None, None),
    (9, "\t \n\r\x0b\x0c", "en", "a"),
    (10, "a" * 3000, "en", "a"),
    (11, "\n\n  x\x00y  ", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, 3, "f") for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(f"P{i}" for i in range(5, 30))), (2, "cat sat"), (3, None), (4, ""), (5, "SAME-id another"), (None, "unseen words here")], "item_id long, text string")


OPERATORS = {
    "op1": lambda d, b: token_counts.count_tokens(d, queries.tokenizer_path()),
    "op2": lambda d, b: mixing.mix_report(d),
    "op3": lambda d, b: repeats.remove_repeats(d, repeats.WORDS),
    "op4": lambda d, b: license_scan.scan_licenses(d),
    "op5": lambda d, b: simhash.near_duplicates(d),
    "op6": lambda d, b: repeats.remove_repeats(d, repeats.BYTES),
    "op7": lambda d, b: quality.quality_report(d),
    "op8": decontaminate.find_contamination,
    "op9": lambda d, b: hash_tree.assign_shards(d),
    "op10": lambda d, b: suffix_tree.score_documents(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row_and_none_for_none(docs, bench, name):
    assert OPERATORS[name](docs, bench).count() == len(ROWS)
    assert OPERATORS[name](docs.limit(0), bench).count() == 0


def test_token_counts_equal_the_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in OPERATORS["op1"](docs, None).collect())
    assert got == sorted((r[0] or -1, len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS)


def _dedup(unit):
    seen, out, order = {}, [], {}
    for r in ROWS:
        order.setdefault(r[0], set()).add(r[1] or "")
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")
    for r in sorted(set(ROWS), key=key):
        text = (r[1] or "").encode()
        u = text.split() if unit.words else text
        n, gone = unit.window, [False] * len(u)
        for s in range(len(u) - n + 1):
            w = tuple(u[s : s + n]) if unit.words else u[s : s + n]
            if w in seen:
                gone[s : s + n] = [True] * n
            seen[w] = 1
        kept = [x for x, g in zip(u, gone, strict=True) if not g]
        kept = b" ".join(kept) if unit.words else bytes(kept)
        spans = 0 if unit.words else sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out += [(r[0] or -1, len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest())] * ROWS.count(r)
    return sorted(out)


@pytest.mark.parametrize("frequent", [repeats.FREQUENT, 1])
@pytest.mark.parametrize("unit", [repeats.WORDS, repeats.BYTES])
def test_repeats_equal_brute_force(docs, unit, frequent):
    """With 1, the runs of every anchor that occurs twice are cut by a second one."""
    got = sorted((r.doc_id or -1, r.n_units, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs, unit, frequent=frequent).collect())
    assert got == _dedup(unit)


def test_simhash_equals_brute_force(docs):
    want = []
    for i, t, *_ in ROWS:
        w = (t or "").encode().translate(simhash._LOWER).split()
        grams = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) > 3 else [b" ".join(w)] * bool(w)
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        want.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))))
    parent = list(range(len(want)))
    for _ in want:
        for a in range(len(want)):
            for b in range(len(want)):
                if (want[a][1] ^ want[b][1]).bit_count() <= 4:
                    parent[a] = parent[b] = min(parent[a], parent[b])
    least = {}
    for k, (i, _) in enumerate(want):
        least[parent[k]] = min(least.get(parent[k], 1 << 62), i if i is not None else 1 << 62)
    expected = sorted((i or -1, f"{f:016x}", least[parent[k]] if least[parent[k]] < 1 << 62 else -1) for k, (i, f) in enumerate(want))
    assert sorted((r.doc_id or -1, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in simhash.near_duplicates(docs).collect()) == expected
    assert simhash.keep_one(docs).count() == len(least)


def test_large_cells_link_all(spark):
    rng = np.random.default_rng(1)
    fp = np.unique(np.array([7 ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (400, 2))], np.uint64)).view(np.int64)
    u, v = simhash._links(np.zeros(len(fp), np.int64), fp)
    assert len(set(u.tolist()) | set(v.tolist())) == len(fp) and len(u) == len(fp) - 1


def test_decontamination_equals_brute_force(docs, bench):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    items = [(str(r.item_id) if r.item_id else "", split(r.text)) for r in bench.collect()]
    want = []
    for i, t, *_ in ROWS:
        w, hit, ids = split(t), set(), set()
        for name, x in items:
            n = min(10, len(x))
            for s in range(len(x) - n + 1 if x else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        hit |= set(range(p, p + n))
                        ids.add(name)
        want.append((i or -1, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
    for size in (4 << 20, 40):  # one block, then several
        decontaminate.BLOCK_BYTES, old = size, decontaminate.BLOCK_BYTES
        try:
            got = decontaminate.find_contamination(docs, bench).collect()
            clean = decontaminate.remove_contaminated(docs, bench)
            assert clean.columns == docs.columns and clean.count() == sum(x[2] == 0 for x in want)
        finally:
            decontaminate.BLOCK_BYTES = old
        assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == sorted(want)


def test_matches_are_named_alike_whatever_the_blocks(spark):
    """One window in thirty items, longer matches over them, short items, and equal windows at several places of one item."""
    line = " ".join(f"q{i}" for i in range(14))
    items = [(f"item{i:02d}", f"own{i} words{i} {line if i % 2 else line[:29]} tail{i}") for i in range(30)]
    items += [("short", "q3 q4"), ("short2", "Q3 q4"), ("twice", f"{line} x {line}"), ("item05", f"{line} another text of one id"), (None, line)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(1, f"a {line} b {line[:29]} c q3 q4"), (2, line), (3, "nothing"), (4, None), (2, line), (5, f"own3 words3 {line} tail3")], "doc_id long, text string")
    found = []
    for size in (40, 300, 4 << 20):
        decontaminate.BLOCK_BYTES, old = size, decontaminate.BLOCK_BYTES
        try:
            found.append(sorted(repr((r.doc_id, r.n_hit, r.n_items, r.items_sha256, [tuple(m) for m in r.matches])) for r in decontaminate.find_contamination(docs, bench).collect()))
        finally:
            decontaminate.BLOCK_BYTES = old
    assert found[0] == found[1] == found[2] and len(found[0]) == 6
    whole = {r.doc_id: [tuple(m) for m in r.matches] for r in decontaminate.find_contamination(docs, bench).collect()}
    # the item without an id is the least; a document's own longer match begins and ends in item03
    assert whole[2] == [("", 0, 0, 14), ("short", 0, 3, 2)] and whole[3] == whole[4] == []
    assert ("item03", 0, 0, 11) in whole[5] and ("", 0, 2, 14) in whole[5] and all(m[0] in ("", "item03", "short") for m in whole[5])


def test_shards_have_gapless_slots_and_growth_only_fills_the_new_one(docs):
    got = hash_tree.assign_shards(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 24)
    spark = docs.sparkSession
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert sorted(map(repr, hash_tree.assign_shards(docs).collect())) == sorted(map(repr, got))
    spark.conf.set("spark.sql.shuffle.partitions", width)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, *_ in ROWS)


def test_weight_changes_move_keys_only_inside_their_subtree(spark):
    from pyspark.sql import functions as F

    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    of = lambda w, planned=None: hash_tree.shard_of(F.col("k"), w, planned)
    old = [1.0] * 24
    rack, region = list(old), list(old)
    rack[0], rack[1] = 1.5, 0.5  # in one rack
    region[0], region[5] = 1.5, 0.5  # in one region, over racks
    more = [*old, 1.0]
    got = keys.select(of(old).alias("a"), of(rack).alias("b"), of(region).alias("c"), of(more, 24).alias("d"), of([*more, 1.0], 24).alias("e")).toPandas()
    moved = lambda x, y: got[got[x] != got[y]]
    assert len(m := moved("a", "b")) and (m.a // 4 == 0).all() and (m.b // 4 == 0).all()
    assert len(m := moved("a", "c")) and (m.a // 8 == 0).all() and (m.c // 8 == 0).all()
    assert 500 < len(m := moved("a", "d")) < 1200 and (m.d == 24).all()
    assert len(m := moved("d", "e")) and (m.e == 25).all()
    share = got.groupby("b").size() / len(got) * 24
    assert share[0] > 1.3 and share[1] < 0.7 and abs(share[2:] - 1).max() < 0.25


def test_scores(docs):
    tokens = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + ["\0end"]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    c = Counter()
    for i, t, *_ in ROWS:
        if not held(i):
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i or -1, held(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 5)) for i, t, *_ in ROWS)
    got = suffix_tree.score_documents(docs).collect()
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


@pytest.mark.parametrize("bits", [3, 40])
def test_pairs_are_distinct_whether_they_fit_one_number_or_not(bits):
    rng = np.random.default_rng(bits)
    one, two = (rng.integers(0, 9, 400).astype(np.uint64) << np.uint64(bits) for _ in range(2))
    a, b, of = suffix_tree._distinct_pairs(one, two)
    assert sorted(set(zip(one.tolist(), two.tolist(), strict=True))) == list(zip(a.tolist(), b.tolist(), strict=True))
    assert (a[of] == one).all() and (b[of] == two).all()


def test_rows_are_numbered_by_sorting_values_only(monkeypatch):
    """Pairs that fit as they are, or after either column is numbered, and values that differ in their low bits only."""
    rng = np.random.default_rng(3)
    u = lambda n, top: rng.integers(0, top, n).astype(np.uint64)
    columns = [(u(999, 50), u(999, 9)), (u(999, 1 << 50) >> np.uint64(45) << np.uint64(45), u(999, 9)), (u(999, 1 << 62) | np.uint64(1 << 62), u(999, 7) << np.uint64(60))]
    want = [np.unique(np.stack(c), axis=1, return_inverse=True) for c in columns]
    close = np.array([1 << 63 | 5, 1 << 63 | 4, 7, 1 << 63 | 5], np.uint64)
    values, of = suffix_tree._distinct(close)
    assert (values[of] == close).all() and len(values) == 3 and (np.diff(values.astype(object)) > 0).all()
    assert all(len(x) == 0 for x in suffix_tree._distinct(close[:0])) and len(suffix_tree._distinct_pairs(close[:0], close[:0])[2]) == 0
    for f in ("unique", "lexsort", "argsort"):
        monkeypatch.setattr(np, f, lambda *a, **k: pytest.fail("sorts row numbers"))
    for (one, two), (pairs, inverse) in zip(columns, want, strict=True):
        a, b, of = suffix_tree._distinct_pairs(one, two)
        assert (a == pairs[0]).all() and (b == pairs[1]).all() and (of == inverse.ravel()).all()



def test_words_are_hashed_by_their_bytes_alone():
    """Wherever they stand; words that differ in one byte, of any length, or in zeros at their end are told apart."""
    rng = np.random.default_rng(5)
    found = {bytes(rng.integers(0, 3, n, np.uint8)) for n in (*range(1, 20), 63, 64, 65, 66, 200, 5000) for _ in range(40)}
    found |= {b"a" * n + b"\0" * z for n in range(70) for z in range(1, 9)}
    hashes = []
    for seed in (1, 2):
        order = sorted(found, key=lambda w, seed=seed: zlib.crc32(w, seed))
        ends = np.cumsum([len(w) for w in order])
        h = text.word_hashes(np.frombuffer(b"".join(order), np.uint8), ends - [len(w) for w in order], ends)
        hashes.append(dict(zip(order, h.tolist(), strict=True)))
    assert hashes[0] == hashes[1] and len(set(hashes[0].values())) == len(found)


def test_places_close_and_totals_take_no_pass_of_their_own(spark, monkeypatch):
    """Texts pass through Python once before they are dealt; state is kept for the places that may be asked for again only."""
    passes = []
    docs = spark.createDataFrame([(1, "a b c d e"), (3, "a b x y z")], "doc_id long, text string")
    made = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda *a, **k: passes.append(1) or made(*a, **k))
    got = suffix_tree.score_documents(docs).collect()
    assert len(passes) == 1 and {r.train_tokens for r in got} == {6 * (zlib.crc32(b"1") % 7 != 2) + 6 * (zlib.crc32(b"3") % 7 != 2)}
    rows = pa.table({"doc_id": [1, 3], "text": ["a b c d e", "a b x y z"], "held_out": [False, False]})
    tokens = suffix_tree.Tokens(pa.table({"data": [shared.pack(**{c: rows[c] for c in rows.column_names})]}))
    words, of = tokens.word_keys()
    tokens.start(of, np.bincount(of[1:], minlength=len(words)), np.arange(len(words)).astype(np.uint64), 12, 9)
    assert tokens.at.tolist() == [1, 2, 3, 7, 8, 9]  # after an end, after a and b of either text, not after words that occur once
    _, _, pair, _ = tokens.ask(1, 4)
    counts = np.bincount(pair)
    tokens.learn(1, counts[pair], None, pair.astype(np.uint64))
    assert tokens.at.tolist() == [2, 3, 8, 9] and tokens.before.tolist() == [2, 2, 2, 2]


def test_contexts_of_one_shard_are_never_one(spark, monkeypatch):
    """All contexts and words in one shard: as the tree over a thousand shards."""
    data = [(i, " ".join(f"w{(i * i + j * (1 + i % 3)) % 17}" for j in range(60))) for i in range(60)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    found = []
    for n in (1, 7):
        monkeypatch.setattr(suffix_tree, "groups_for", lambda size, n=n: n)
        found.append(sorted((r.doc_id, round(r.score, 9)) for r in suffix_tree.score_documents(docs).collect()))
    assert found[0] == found[1]


def _brute_tree(texts, depth=suffix_tree.DEPTH):
    """(probability of a token after the tokens before it, vocabulary, training tokens) by plain dictionaries."""
    end, c, grams = "\0end", Counter(), Counter()
    for t in texts:
        s = [end, *t, end]
        c.update(s[1:])
        for i in range(1, len(s)):
            for k in range(1, min(i, depth) + 1):
                grams[tuple(s[i - k : i + 1])] += 1
    total, size = sum(c.values()), sum(c.values()) + len(c) + 1
    after = {}
    for g in grams:
        after.setdefault(g[:-1], []).append(g)
    single = lambda x: len(after.get(x, ())) == 1 and sum(grams[g] for g in after[x]) >= suffix_tree.LEAST
    asked = lambda x: sum(grams[g] for g in after.get(x, ())) >= suffix_tree.LEAST and not any(single(x[j:]) for j in range(1, len(x)))
    kept = {}

    def keeps(x):
        if x not in kept:
            n = sum(grams[g] for g in after.get(x, ()))
            hint = lambda g: (min(max(round(8 * math.log(n * p(g[1:]))) + 165, 0), 254) - 165) / 8
            kept[x] = n >= suffix_tree.LEAST if len(x) == 1 else asked(x) and sum(grams[g] * (math.log(grams[g]) - hint(g)) for g in after[x]) >= suffix_tree.LEAST_DIVERGENCE
        return kept[x]

    def p(g):
        if len(g) == 1:
            return (c[g[0]] + 1) / size
        x, low = g[:-1], p(g[1:])
        if not keeps(x):
            return low
        return (grams[g] + suffix_tree.PRIOR * low) / (sum(grams[k] for k in after[x]) + suffix_tree.PRIOR)

    return p, [*c, "\0unseen"], total


def test_scores_equal_a_brute_force_tree_that_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokens = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    rows = {r.doc_id: tokens(r.text) for r in docs.collect()}
    held = {i for i in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    p, vocabulary, total = _brute_tree([t for i, t in rows.items() if i not in held])
    for context in (("\0end",), ("the",), *[tuple(t[:k]) for k, t in enumerate(list(rows.values())[:5], 1) if len(t) > k]):
        assert math.isclose(sum(p((*context[-4:], w)) for w in vocabulary), 1, abs_tol=1e-9)
    got = suffix_tree.score_documents(docs).collect()
    assert sum(r.score - r.base_score for r in got if r.held_out) > 0
    for r in got:
        s = ["\0end", *rows[r.doc_id], "\0end"]
        want = sum(math.log10(p(tuple(s[max(0, i - suffix_tree.DEPTH) : i + 1]))) for i in range(1, len(s)))
        assert r.train_tokens == total and math.isclose(r.score, want, rel_tol=1e-6), r.doc_id


def test_a_score_depends_on_no_table_size(spark):
    """Rows with words of their own change the root's size only: the counts of each context stay what they were."""
    rows = [(i, f"alpha beta gamma delta epsilon {'zeta' if i % 3 else 'eta'} theta iota") for i in range(40)]
    more = [(1000 + i, " ".join(f"x{i}y{j}" for j in range(2000))) for i in range(60)]
    score = lambda data: {r.doc_id: r for r in suffix_tree.score_documents(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    a, b = score(rows), score(rows + more)
    prior = suffix_tree.PRIOR / (suffix_tree.PRIOR + 20)
    for i in range(40):
        # a larger root can take from the prior's share only, at most as much as it took from the base
        assert 0 <= a[i].score - b[i].score <= (a[i].base_score - b[i].base_score) * prior * 2


def test_raked_margins_meet_their_targets(spark):
    data = [(f"s{i}", f"l{j}", f"t{k}", 10 + 7 * i + 3 * j * k) for i in range(4) for j in range(3) for k in range(2)]
    cells = spark.createDataFrame(data, "source string, language string, topic string, tokens long")
    got = mixing.rake(cells, {"language": {"l0": 0.5, "l1": 0.3, "l2": 0.2}}, share=0.4).toPandas()
    share = got.groupby("language").weight.sum() / got.weight.sum()
    assert np.allclose(share[["l0", "l1", "l2"]], [0.5, 0.3, 0.2], atol=2e-3)
    assert np.allclose(got.groupby("topic").weight.sum() / got.weight.sum(), 0.5, atol=2e-3)
    assert (got.weight <= got.tokens).all() and (got.residual <= mixing.TOLERANCE).all() and np.isclose(got.weight.sum(), 0.4 * got.tokens.sum(), rtol=2e-3)


@pytest.mark.parametrize("share", [0.4, 0.7])
def test_few_and_many_cells_are_raked_alike_and_meet_their_targets(spark, monkeypatch, share):
    """Topics that follow the languages, a large source and rare values: our own targets contradict each other and are moved."""
    rng = np.random.default_rng(8)
    data = [(f"s{i}", f"l{j}", f"t{(j + (k > 3)) % 3}{k % 2}", int(rng.pareto(1) * 50 * (30 if i == 0 else 1)) + 1) for i in range(9) for j in range(3) for k in range(5)]
    cells = spark.createDataFrame(data, "source string, language string, topic string, n long").groupBy("source", "language", "topic").agg({"n": "sum"}).toDF("source", "language", "topic", "tokens")
    key = list(mixing.DIMENSIONS)
    few = mixing.rake(cells, share=share).toPandas().sort_values(key).reset_index(drop=True)
    monkeypatch.setattr(mixing, "LOCAL_CELLS", 0)
    many = mixing.rake(cells, share=share).toPandas().sort_values(key).reset_index(drop=True)
    assert (few[key] == many[key]).all().all() and np.allclose(few.weight, many.weight, rtol=1e-6) and np.allclose(few.moved, many.moved, rtol=1e-6)
    assert (few.residual <= mixing.TOLERANCE).all() and (few.weight <= few.tokens * (1 + 1e-12)).all() and np.isclose(few.weight.sum(), share * few.tokens.sum(), rtol=0.02)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_registered_mix_meets_its_targets(spark, sf):
    got = mixing.mix_report(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).agg({"residual": "max", "moved": "max"}).first()
    print(sf, got)
    assert got["max(residual)"] < 1e-3


def test_topics_are_fitted_on_all_rows(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    here = mixing.fit_topics(docs)
    monkeypatch.setattr(mixing, "LOCAL_ROWS", 0)
    spread = mixing.fit_topics(docs.repartition(3))
    assert np.allclose(here.centres, spread.centres, atol=1e-9) and (here.weight == spread.weight).all()
    rows = 6000
    found = mixing.fit_topics(spark.range(rows).selectExpr("id AS doc_id", "concat('word n', id % 5) AS text"))
    held = np.rint((1 + rows) / np.exp(found.weight) - 1).astype(int)  # how many rows hold each class
    assert held.max() == rows and held.sum() == 2 * rows


def test_margins_that_contradict_each_other_end_with_their_error(spark):
    data = [("a", "x", "t", 100), ("b", "y", "t", 100)]  # source and language are the same, their targets aren't
    cells = spark.createDataFrame(data, "source string, language string, topic string, tokens long")
    got = mixing.rake(cells, {"source": {"a": 0.9, "b": 0.1}, "language": {"x": 0.1, "y": 0.9}}, share=0.5).toPandas()
    assert (got.residual > 0.5).all() and (got.weight <= got.tokens).all()


def test_licenses(docs):
    got = {(r.doc_id, r.n_known): r.licenses for r in license_scan.scan_licenses(docs).collect()}
    assert got[(7, 2)] == "Apache-2.0,MIT" and got[(4, 0)] == ""


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "/root/testdata/sf0.001")
        if name != "sharding":
            assert docs.columns == before.columns
    assert docs.count() > 0


def test_merged_orders_equal_a_sort():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n, depth = int(rng.integers(1, 60)), int(rng.integers(1, 9))
        symbols, follows, middle = rng.integers(0, 3, n), np.arange(1, n + 1), int(rng.integers(0, n + 1))
        follows[rng.random(n) < 0.2] = -1
        follows[-1] = -1
        if middle:
            follows[middle - 1] = -1
        blocks = []
        for a, b in ((0, middle), (middle, n)):
            blocks.append(bwt_merge._block_order(symbols[a:b], np.where(follows[a:b] >= 0, follows[a:b] - a, -1), depth) + a if b > a else np.zeros(0, np.int64))

        def head(i):
            out = []
            while i >= 0 and len(out) < depth:
                out.append(int(symbols[i]))
                i = int(follows[i])
            return out

        order, common = bwt_merge.merge_orders(symbols, follows, tuple(blocks), depth)
        heads = [head(i) for i in order]
        assert sorted(order.tolist()) == list(range(n)) and heads == sorted(map(head, range(n)))
        for a, b, k in zip(heads[:-1], heads[1:], common[1:].tolist(), strict=True):
            shared = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert shared - 1 <= k and (k <= shared or (k == depth and a == b))


CLASHES = ("_kept", "_m", "_failed", "_base_failed", "_x", "_tokens", "_topic", "_source", "_did", "_th", "_n", "tokens", "topic", "draw", "c0", "c1", "did", "th", "size", "slot", "row", "matches", "n_hit")


def test_columns_of_any_name_come_through(spark, bench):
    from pyspark.sql import functions as F

    rows = [(i, " ".join(f"the word{i} of {j} and a cat{i * j}" for j in range(20)), "en", f"s{i % 3}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs = docs.withColumns({c: F.lit(c) for c in CLASHES})
    from momentlens.llm import near_copies

    for keep in (quality.keep_good, simhash.keep_one, near_copies.keep_one, mixing.sample_mix, lambda d: decontaminate.remove_contaminated(d, bench)):
        got = keep(docs)
        assert got.columns == docs.columns
        for r in got.collect():
            assert all(r[c] == c for c in CLASHES) and r.text == rows[r.doc_id][1]
    placed = hash_tree.shard_documents(docs)
    assert sorted(placed.columns) == sorted({*docs.columns, *hash_tree.ADDED}) and placed.count() == len(rows)
    ids = sorted(map(repr, hash_tree.assign_shards(docs).collect()))
    assert sorted(map(repr, placed.select("doc_id", *hash_tree.ADDED).collect())) == ids


def test_of_equal_texts_the_least_row_stays(spark):
    rows = [(1, "same text here", "b"), (1, "same text here", "a"), (2, "same text here", "a"), (None, None, "x"), (None, "", "y")]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
        assert sorted(map(tuple, simhash.keep_one(docs).collect()), key=repr) == [(1, "same text here", "a"), (None, "", "y")] or sorted(map(tuple, simhash.keep_one(docs).collect()), key=repr) == [(1, "same text here", "a"), (None, None, "x")]


def test_very_long_texts(spark, bench):
    """A text of some megabytes, far above the chunks that texts are handled in, next to an empty one."""
    long = " ".join(f"w{i * 7919 % 50021}" for i in range(700_000))
    docs = spark.createDataFrame([(1, long, "en", "a"), (2, "", "en", "a"), (3, long[: len(long) // 2], "en", "a")], "doc_id long, text string, lang string, source string")
    for name in ("op1", "op2", "op3", "op5", "op6", "op8", "op9", "op10"):
        assert OPERATORS[name](docs, bench).count() == 3
    rules = {r.doc_id: r for r in OPERATORS["op7"](docs, bench).collect()}
    said = long.split()
    windows = Counter(zip(said, said[1:], said[2:]))
    again = {k + j for k, w in enumerate(zip(said, said[1:], said[2:])) if windows[w] > 1 for j in range(3)}
    assert (rules[1].n_words, rules[1].word_chars, rules[1].n_repeat_words) == (len(said), sum(map(len, said)), len(again)) and rules[2].n_words == 0
    notice = "\nReleased under the MIT License.\n"
    noticed = docs.withColumn("text", F.when(F.col("doc_id") == 2, "").otherwise(F.concat("text", F.lit(notice), "text", F.lit(notice))))
    found = {r.doc_id: r.licenses for r in OPERATORS["op4"](noticed, bench).collect()}
    assert found[1] == found[3] and "MIT" in found[1] and not found[2]
    got = {r.doc_id: r for r in repeats.remove_repeats(docs, repeats.WORDS).collect()}
    half = long[: len(long) // 2].split()
    assert got[3].n_removed >= len(half) - 1 and got[2].n_units == 0


def test_equal_windows_of_many_items_in_many_places(spark):
    window = " ".join(f"q{i}" for i in range(10))
    items = spark.createDataFrame([(i, f"{window} tail{i}") for i in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{'pad ' * i}{window} x {window}") for i in range(300)], "doc_id long, text string")
    got = decontaminate.find_contamination(docs, items).collect()
    assert all(r.n_hit == 20 and r.n_items == 300 and len(r.matches) == 2 for r in got)


def test_an_empty_benchmark_finds_nothing(spark, docs, bench):
    got = decontaminate.find_contamination(docs, bench.limit(0)).collect()
    assert len(got) == len(ROWS) and not any(r.contaminated for r in got)


def test_merged_transforms_find_first_windows():
    rng = np.random.default_rng(2)
    alphabet = np.frombuffer(b"abcdef .,05zqQ\xc3\xa9XY", np.uint8)
    for _ in range(12):
        bases = [rng.choice(alphabet, int(n)).tobytes() for n in rng.integers(150, 500, 4)]
        texts = [t for t in (b"".join(bases[i][a : a + n] for i, a, n in zip(rng.integers(0, 4, 2), rng.integers(0, 100, 2), rng.integers(100, 400, 2), strict=True)) for _ in range(8)) if len(t) >= 100] + [b"a" * 300]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        seen, want = set(), []
        for t in texts:
            for i in range(len(t) - 99):
                want.append(t[i : i + 100] not in seen)
                seen.add(t[i : i + 100])
        for block in (1 << 20, 500):  # one block, then several merged two by two
            _, first = bwt_merge.first_windows(np.frombuffer(b"".join(texts), np.uint8), offsets, np.array([len(t) - 99 for t in texts]), 100, block)
            assert first.tolist() == want


def test_numbers_survive_packing():
    from momentlens.llm.shared import pack_numbers, unpack_numbers

    columns = [np.array([], np.uint64), np.array([1, 2**63], np.uint64), np.array([7], np.uint8), np.array([300, 4, 65535], np.uint16)]
    got = unpack_numbers(pack_numbers(*columns))
    assert all(a.dtype == b.dtype and a.tolist() == b.tolist() for a, b in zip(columns, got, strict=True))
