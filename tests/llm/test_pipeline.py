"""The pipeline's rows and the mixture against brute force in plain Python and DuckDB, on whole small tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from momentlens.llm import hash_tree, mixing, queries
from momentlens.llm.text import prefix_sums, span_hashes

SF = "/root/testdata/sf0.001"


def _hash(*values) -> int:
    """xxhash64 of a row: each value hashed with the hash before it as the seed."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True) if isinstance(v, int) else v.encode(), h)
    return h


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _unit(h: int) -> float:
    return ((h >> 11) + 0.5) / (1 << 53)


def _lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _good(rows):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    kept = {i for i, ok in con.execute(f"SELECT doc_id, kept FROM ({queries.oracle_sql()['op7_quality_rules']}) AS q").fetchall() if ok}
    return [r for r in rows if r["doc_id"] in kept]


def _one_of_each(rows):
    """The row of least doc_id of each group that a chain of pairs of 5-word similarity 0.8 or more connects."""
    runs = []
    for r in rows:
        w = _lower(r["text"]).split()
        runs.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    seen, kept = set(), []
    for k in sorted(range(len(rows)), key=lambda k: rows[k]["doc_id"]):
        if k in seen:
            continue
        kept.append(rows[k])
        todo = [k]
        seen.add(k)
        while todo:
            a = todo.pop()
            more = [b for b in range(len(rows)) if b not in seen and near(runs[a], runs[b])]
            seen.update(more)
            todo += more
    return kept


def _clean(rows, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))
    windows = set()
    for t in items:
        w = split(t)
        windows |= {tuple(w[s : s + min(10, len(w))]) for s in range(len(w) - min(10, len(w)) + 1) if w}
    sizes = {len(w) for w in windows}
    return [r for r in rows if not any(tuple(w[s : s + n]) in windows for w in [split(r["text"])] for n in sizes for s in range(len(w) - n + 1))]


def _counts(text):
    kinds = np.zeros((1, mixing.WIDTH), np.int64)
    for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text)):
        b = np.frombuffer(w.encode(), np.uint8)
        kinds[0, int(span_hashes(prefix_sums(b), np.array([0]), np.array([len(b)]))[0]) % mixing.WIDTH] += 1
    return kinds


def _mixed(rows, topics):
    """Each row with its probability (None without words) and its draw, and the error that the margins are left with."""
    cells, of, share = Counter(), [], mixing.KEEP_SHARE
    for r in rows:
        kinds = _counts(r["text"])
        of.append((r["source"] or "", r["lang"] or "", f"topic{topics.assign(kinds)[0]}"))
        cells[of[-1]] += int(kinds.sum())
    cells = {c: n for c, n in cells.items() if n}
    weight = {c: n * share for c, n in cells.items()}
    target = []
    for d, name in enumerate(mixing.DIMENSIONS):
        have = Counter()
        for c, n in cells.items():
            have[c[d]] += n
        wish, rest, free = {v: n ** mixing.TEMPER[name] for v, n in have.items()}, sum(cells.values()) * share, set(have)
        while True:  # values that ask for more than they have get all of it
            level = rest / sum(wish[v] for v in free)
            full = {v for v in free if wish[v] * level >= have[v]}
            if not full:
                break
            rest -= sum(have[v] for v in full)
            free -= full
        target.append({v: wish[v] * level if v in free else have[v] for v in have})
    worst = math.inf
    while True:
        for _ in range(mixing.SWEEPS):
            off = 0.0
            for d in range(3):
                have, free = defaultdict(float), defaultdict(float)
                for c, x in weight.items():
                    have[c[d]] += x
                    free[c[d]] += x if x < cells[c] * (1 - mixing._FULL) else 0
                off = max([off, *(abs(have[v] - t) / max(t, 1) for v, t in target[d].items())])
                for c, x in weight.items():
                    h, t = have[c[d]], target[d][c[d]]
                    if h > t:
                        weight[c] = x * t / h
                    elif x < cells[c] * (1 - mixing._FULL):
                        weight[c] = min(cells[c], x * (1 + (t - h) / free[c[d]]))
        if off <= mixing.TOLERANCE or off > worst * mixing.STALLED:
            break
        worst = off
    draw = [_unit(_hash(mixing.SEED, str(r["doc_id"]), *[str(_signed(_hash(r["text"]))) if r["text"] is not None else ""])) for r in rows]
    return [(r, weight[c] / cells[c] if c in weight else None, u) for r, c, u in zip(rows, of, draw, strict=True)], off


def _reached(key, shards, planned=24):
    """Region, rack and shard by the least exponential draw of each level, over the planned shards and those added."""
    draw = lambda node, weight: -math.log(_unit(_hash(key, node))) / weight
    regions = [list(range(i, min(i + 8, planned))) for i in range(0, planned, 8)] + [[i] for i in range(planned, shards)]
    r = min(range(len(regions)), key=lambda i: draw(f"tree/{i}", len(regions[i])))
    racks = [regions[r][i : i + 4] for i in range(0, len(regions[r]), 4)]
    k = min(range(len(racks)), key=lambda i: draw(f"tree/{r}/{i}", len(racks[i]))) if len(racks) > 1 else 0
    return racks[k][min(range(len(racks[k])), key=lambda i: draw(f"tree/{r}/{k}/{i}", 1)) if len(racks[k]) > 1 else 0]


def _sharded(rows, shards=24):
    out = []
    for r in rows:
        text, key = (r["text"] or "").encode(), str(r["doc_id"])
        crc = zlib.crc32(text)
        bucket = _signed(_hash(key, "slot", crc)) % hash_tree.ORDER_BUCKETS
        out.append([_reached(key, shards), bucket, r["doc_id"], len(text) + 8, crc, _reached(key, shards + 1)])
    slot = Counter()
    found = []
    for shard, _, i, size, crc, grown in sorted(out):
        found.append((i, size, crc, "key", shard, slot[shard], grown))
        slot[shard] += 1
    return sorted(found)


@pytest.fixture(scope="module")
def rows(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_the_mixture_equals_brute_force(spark, rows):
    topics = mixing.fit_topics(spark.read.parquet(f"{SF}/documents.parquet"))
    mixed, off = _mixed(rows, topics)
    want = {r["doc_id"]: (w, u) for r, w, u in mixed}
    got = queries.op2_mixing(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        w, u = want[r.doc_id]
        assert math.isclose(r.probability, 1.0 if w is None else w, rel_tol=1e-6) and r.probability <= 1
        assert r.sampled == (w is None or u < w) and (w is None or math.isclose(r.residual, off, rel_tol=1e-3, abs_tol=1e-6))
    kept = sum(r.n_tokens * r.probability for r in got) / sum(r.n_tokens for r in got)
    assert abs(kept - mixing.KEEP_SHARE) <= max(off, mixing.TOLERANCE)


def test_the_pipeline_equals_brute_force(spark, rows):
    import corpus_pipeline

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = _clean(_one_of_each(_good(rows)), items)
    topics = mixing.fit_topics(docs.where(docs.doc_id.isin([r["doc_id"] for r in kept])))
    mixed = [r for r, w, u in _mixed(kept, topics)[0] if w is None or u < w]
    got = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(mixed) < len(kept) < len(rows)
    columns = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert sorted(tuple(r[c] for c in columns) for r in got) == _sharded(mixed)
    assert {r.doc_id: (r.text, r.source, r.lang, r.n_chars) for r in got} == {r["doc_id"]: (r["text"], r["source"], r["lang"], r["n_chars"]) for r in mixed}


def test_stages_take_very_long_null_and_repeated_texts(spark):
    """Each stage by itself: a long clean text stays whole, nulls and empty texts come through or go as the stage says."""
    import corpus_pipeline

    rng = np.random.default_rng(5)
    vowels = "aeiou"
    word = lambda x: "".join("bdfgklmnprst"[x >> 4 * k & 7] + vowels[x >> 4 * k & 3] for k in range(3 + x % 2))
    names = [word(int(x)) for x in rng.integers(0, 1 << 20, 300_000)]
    long = "\n".join(" ".join((*names[i : i + 12], "and the of")) + "." for i in range(0, len(names), 12))
    rows = [(1, long, "en", "a", len(long)), (2, long, "en", "a", len(long)), (3, None, "en", None, None), (4, "", None, "b", 0), (5, None, "en", None, None), (5, None, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    got = {n: stages[n](spark, docs, SF) for n in stages}
    assert ids(got["quality_rules"]) == [1, 2] and ids(got["near_duplicates"]) == [1, 3] and ids(got["sharding"]) == [1, 2, 3, 4, 5, 5]
    assert ids(got["decontamination"]) == [1, 2, 3, 4, 5, 5]
    assert {3, 4, 5} <= set(ids(got["mixture"]))
    for n in ("quality_rules", "near_duplicates", "decontamination", "mixture"):
        assert got[n].columns == docs.columns
    kept = got["near_duplicates"].where("doc_id = 1").first().text
    assert kept == long and len(long) > 1_000_000


def test_the_pipeline_of_an_empty_table_is_empty(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_shards_equal_brute_force_level_by_level(spark, rows):
    columns = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert sorted(tuple(r[c] for c in columns) for r in queries.op9_sharding(spark, SF).collect()) == _sharded(rows)


@pytest.mark.parametrize("n", [1, 7, 24, 30])
def test_the_tree_reaches_the_brute_force_shard(spark, n):
    from pyspark.sql import functions as F

    got = spark.range(200).select("id", hash_tree.shard_of(F.col("id").cast("string"), [1.0] * n, min(n, 24)).alias("s")).collect()
    assert all(r.s == _reached(str(r.id), n, min(n, 24)) for r in got)
