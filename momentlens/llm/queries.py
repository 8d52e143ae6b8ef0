"""The registered queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from momentlens.llm import conversations, decontaminate, discriminant, fill_middle, hash_tree, license_scan, mixing, quality, repeats, simhash, suffix_tree, token_counts
from momentlens.llm.shared import read

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark, sf_dir):
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), tokenizer_path())


def op2_mixing(spark, sf_dir):
    return mixing.mix_report(read(spark, sf_dir, "documents"))


def op3_substring_dedup(spark, sf_dir):
    found = repeats.remove_repeats(read(spark, sf_dir, "documents"), repeats.WORDS, with_text=False)
    return found.selectExpr("doc_id", "n_units AS n_words", "n_removed", "kept_sha256")


def op4_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op5_simhash(spark, sf_dir):
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    found = repeats.remove_repeats(read(spark, sf_dir, "documents"), repeats.BYTES, with_text=False)
    return found.selectExpr("doc_id", "n_units AS n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_quality_rules(spark, sf_dir):
    found = quality.quality_report(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_decontamination(spark, sf_dir):
    return decontaminate.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("matches")


def op9_sharding(spark, sf_dir):
    return hash_tree.assign_shards(read(spark, sf_dir, "documents"))


def op10_suffix_tree(spark, sf_dir):
    return suffix_tree.score_documents(read(spark, sf_dir, "documents"))


def op11_conversation_repair(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    report, turns = conversations.repair(conversations.damage(rows))
    hashes = conversations.digests(turns, F.concat("role", F.lit(":"), "text"))
    every = rows.groupBy("conv_id").agg(F.lit(1).alias("one"))
    # a conversation that lost all of its turns is in neither table, one that lost the rest in the repair has no lines
    found = every.join(report, every["conv_id"].eqNullSafe(report["conv_id"]), "left").join(hashes, every["conv_id"].eqNullSafe(hashes["conv_id"]), "left")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(every["conv_id"], *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_quality_classifier(spark, sf_dir):
    return discriminant.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark, sf_dir):
    made = fill_middle.fill_in_middle(read(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    whole = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(whole).alias("restored_sha256"))


def queries():
    found = (op1_token_counts, op2_mixing, op3_substring_dedup, op4_license_scan, op5_simhash, op6_suffix_dedup, op7_quality_rules, op8_decontamination, op9_sharding, op10_suffix_tree, op11_conversation_repair, op12_quality_classifier, op13_fill_in_middle)
    return {f.__name__: f for f in found}


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP3 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
v AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM s),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM v),
g AS (SELECT DISTINCT doc_id, i + o AS at FROM f, (SELECT unnest(range(0, 20)) AS o) WHERE k > 1),
r AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS at, w FROM d),
k AS (SELECT e.doc_id, string_agg(e.w[e.at], ' ' ORDER BY e.at) AS t FROM e ANTI JOIN g ON e.doc_id = g.doc_id AND e.at = g.at GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""


def _op4() -> str:
    known = ", ".join(f"('{k}', '{v}')" for k, v in license_scan.SENTENCES.items())
    cases = []
    for name, wanted in license_scan.RULES:
        pattern = "," + ",([^,]+,)*".join(wanted) + ","
        cases.append(f"CASE WHEN regexp_matches(chain, '{pattern}') THEN '{name}' END")
    return rf"""
WITH known(id, sentence) AS (VALUES {known}),
d AS (SELECT doc_id, list_filter(list_transform(str_split(regexp_replace(lower(coalesce(text, '')), '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)), lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') AS f FROM documents),
u AS (SELECT doc_id, unnest(f) AS s, unnest(range(1, len(f) + 1)) AS i FROM d WHERE len(f) > 0),
m AS (SELECT u.doc_id, count(*) AS n, string_agg(known.id, ',' ORDER BY u.i) AS ids FROM u JOIN known ON u.s = known.sentence GROUP BY u.doc_id),
c AS (SELECT d.doc_id, CAST(len(f) AS BIGINT) AS n_sentences, CAST(coalesce(m.n, 0) AS BIGINT) AS n_known, coalesce(m.ids, '') AS sentence_ids, ',' || coalesce(m.ids, '') || ',' AS chain FROM d LEFT JOIN m ON d.doc_id = m.doc_id)
SELECT doc_id, n_sentences, n_known, sentence_ids, array_to_string(list_sort(list_distinct(list_filter([{", ".join(cases)}], lambda x: x IS NOT NULL))), ',') AS licenses FROM c
"""


def _op7() -> str:
    stops = ", ".join(f"'{x}'" for x in sorted({y for x in quality.STOP_WORDS for y in x.split()}))
    checks = []
    for _, value, least, most in quality.RULES:
        ratio = f"({value.split('/')[0]}::DOUBLE / nullif({value.split('/')[1]}, 0))" if "/" in value else f"{value}::DOUBLE"
        checks += [f"coalesce({ratio} {op} {x}, true)" for op, x in ((">=", least), ("<=", most)) if x is not None]
    count = lambda chars: f"length(t) - length(translate(t, '{chars}', ''))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(str_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
v AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS c FROM s),
g AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM v, (VALUES (0), (1), (2)) AS x(o) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST({count('#*$%&|<>')} AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
  len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop_words, {count('!?')} AS n_marks, {count('0123456789')} AS n_digits FROM d LEFT JOIN g ON d.doc_id = g.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(checks)} AS kept FROM b
"""


_OP8 = r"""
WITH low AS (SELECT 'd' AS k, CAST(doc_id AS VARCHAR) AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', CAST(item_id AS VARCHAR), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
a AS (SELECT k, id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM low),
q AS (SELECT id AS item, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i, w FROM a WHERE k = 'b' AND len(w) > 0),
t AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS h FROM q),
p AS (SELECT id, w, x.n, unnest(range(1, len(w) - x.n + 2)) AS i FROM a, (SELECT DISTINCT n FROM t) AS x WHERE k = 'd' AND len(w) >= x.n),
o AS (SELECT p.id, p.i, t.n, t.item FROM p JOIN t ON p.n = t.n AND array_to_string(p.w[p.i:p.i + p.n - 1], ' ') = t.h),
c AS (SELECT id, count(DISTINCT i + z) AS hit FROM o, (SELECT unnest(range(0, 10)) AS z) WHERE z < n GROUP BY id),
s AS (SELECT id, count(*) AS items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT id, item FROM o) GROUP BY id)
SELECT CAST(a.id AS BIGINT) AS doc_id, CAST(len(a.w) AS BIGINT) AS n_words, CAST(coalesce(c.hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(s.items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s.names, '')) AS items_sha256, coalesce(c.hit, 0) > 0 AS contaminated
FROM a LEFT JOIN c ON a.id = c.id LEFT JOIN s ON a.id = s.id WHERE a.k = 'd'
"""


_OP13 = r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
n AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || k[1:8] AS BIGINT) AS h1, CAST('0x' || k[9:16] AS BIGINT) AS h2, CAST('0x' || k[17:24] AS BIGINT) AS h3, CAST('0x' || k[25:32] AS BIGINT) AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, left(t, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def oracle_sql():
    return {"op13_fill_in_middle": _OP13, "op3_substring_dedup": _OP3, "op4_license_scan": _op4(), "op7_quality_rules": _op7(), "op8_decontamination": _OP8}
