"""The pipeline's near copies against brute force over exact sets of 5-word runs."""

import random

from momentlens.llm import near_copies


def _runs(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _kept(rows):
    sets, seen, kept = [_runs(t) for _, t in rows], set(), []
    near = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    for k in sorted(range(len(rows)), key=lambda k: rows[k][0]):
        if k in seen:
            continue
        kept.append(rows[k][0])
        todo = [k]
        seen.add(k)
        while todo:
            a = todo.pop()
            more = [b for b in range(len(rows)) if b not in seen and near(sets[a], sets[b])]
            seen.update(more)
            todo += more
    return sorted(kept)


def _rows():
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, "two words"), (3, "Two  WORDS"), (4, "a b c d e"), (5, "a b c d e f")]
    for base in range(60):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        rows.append((len(rows), " ".join(w)))
        for changed in (1, 2, 3, 5, 8):
            x = list(w)
            for i in rng.sample(range(len(x)), changed):
                x[i] = f"x{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(x)))
    w = [f"v{i}" for i in range(400)]
    for _ in range(150):  # a large group, of which some are further off
        x = list(w)
        for i in rng.sample(range(len(x)), rng.choice((2, 4, 8, 14))):
            x[i] = f"y{rng.randrange(3000)}"
        rows.append((len(rows), " ".join(x)))
    return rows


def test_near_copies_equal_brute_force(spark):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == _kept(rows)


def test_the_stage_drops_copies_with_two_changed_words(spark):
    import corpus_pipeline

    rows = [r for r in _rows() if r[0] > 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == _kept(rows)
