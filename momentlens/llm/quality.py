"""Quality rules: a threshold table compiled into one projection of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with in a is for on it as was are this an by",
    "le la les de des et un une du que en est dans pour ou qui pas sur",
    "der die das und ist nicht ein eine zu den von mit im auf sich",
    "el los las del y con se lo no por su para es al",
)

#: (rule, measure, least, most): a document passes when every measure lies within its bounds. The measures are
#: expressions over the columns that ``measure`` makes.
RULES = (
    ("words", "n_words", 50, 1_000_000),
    ("mean_word_length", "word_chars / n_words", 2.5, 12.0),
    ("symbols_per_word", "n_symbols / n_words", None, 0.1),
    ("marks_per_word", "n_marks / n_words", None, 0.5),
    ("digit_share", "n_digits / word_chars", None, 0.3),
    ("stop_words_per_word", "n_stop_words / n_words", 0.005, None),
    ("duplicate_line_share", "n_dup_lines / n_lines", None, 0.4),
)

_SPACE = r"[\\x20\\x09-\\x0D]+"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_marks", "n_digits")


def _let(value: str, name: str, body: str) -> str:
    """Bind an expression to a lambda variable, so that it is evaluated once however often the body uses it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeat_words() -> str:
    """Words that lie in 3-word windows found twice or more. The windows are sorted only where some do repeat."""
    runs = "transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2]))"
    ordered = "array_sort(transform(t, (k, i) -> struct(k AS k, i AS i)))"
    repeated = (
        "array_sort(array_remove(transform(s, (x, j) -> IF((j > 0 AND x.k = get(s, j - 1).k) "
        "OR (j < size(s) - 1 AND x.k = get(s, j + 1).k), x.i, -1)), -1))"
    )
    covered = "aggregate(transform(p, (x, j) -> least(3, coalesce(get(p, j + 1) - x, 3))), 0, (a, x) -> a + x)"
    return f"IF(size(w) < 3, 0, {_let(runs, 't', f'IF(size(array_distinct(t)) = size(t), 0, {_let(ordered, "s", _let(repeated, "p", covered))})')})"


def _text_measures() -> str:
    stops = ", ".join(f"'{x}'" for x in sorted({y for x in STOP_WORDS for y in x.split()}))
    gone = lambda chars: f"length(t0) - length(translate(t0, '{chars}', ''))"
    lines = rf"filter(split(t0, '\\n', -1), x -> x RLIKE '[^\\x20\\x09-\\x0D]')"
    per_words = (
        f"struct(size(w) AS n_words, {_repeat_words()} AS n_repeat_words, "
        f"size(filter(w, x -> lower(x) IN ({stops}))) AS n_stop_words)"
    )
    parts = {
        "of_words": _let(f"array_remove(split(t0, '{_SPACE}', -1), '')", "w", per_words),
        "of_lines": _let(lines, "l", "struct(size(l) AS n_lines, size(l) - size(array_distinct(l)) AS n_dup_lines)"),
        "of_chars": rf"struct(length(translate(t0, ' \t\n\u000B\u000C\r', '')) AS word_chars, {gone('#*$%&|<>')} AS n_symbols, "
        f"{gone('!?')} AS n_marks, {gone('0123456789')} AS n_digits)",
    }
    body = "struct(" + ", ".join(f"{v} AS {k}" for k, v in parts.items()) + ")"
    return _let("coalesce(text, '')", "t0", body)


def measure(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` and a struct ``_m`` of counts per text (null: an empty text). No shuffle.

    The counts are generated from an array of one struct, so that the optimiser doesn't copy their expression into
    each of its uses.
    """
    m = docs.select("*", F.explode(F.array(F.expr(_text_measures()))).alias("_x"))
    pick = {c: f"_x.{g}.{c}" for g, cs in (("of_words", _COUNTS[0:1] + ("n_repeat_words", "n_stop_words")), ("of_lines", ("n_lines", "n_dup_lines")), ("of_chars", ("word_chars", "n_symbols", "n_marks", "n_digits"))) for c in cs}
    return m.withColumn("_m", F.struct(*[F.expr(pick[c]).cast("long").alias(c) for c in _COUNTS])).drop("_x")


def base_failed(m: str = "_m") -> Column:
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def compile_rules(rules=RULES, m: str = "_m") -> list[tuple[str, Column]]:
    """Each rule of the table as a boolean column that is true where the rule holds; a measure over zero holds."""
    out = []
    for name, value, least, most in rules:
        if "/" in value:
            over, under = (F.col(f"{m}.{x.strip()}") for x in value.split("/"))
            ratio = over / F.when(under != 0, under)
        else:
            ratio = F.col(f"{m}.{value}").cast("double")
        held = F.lit(True)
        if least is not None:
            held = held & (ratio >= F.lit(float(least)))
        if most is not None:
            held = held & (ratio <= F.lit(float(most)))
        out.append((name, F.coalesce(held, F.lit(True))))
    return out


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    """The columns of ``docs``, ``_m``, ``_base_failed``, ``_failed`` (names of broken rules) and ``_kept``."""
    table = compile_rules(rules)
    return (
        measure(docs)
        .withColumn("_base_failed", base_failed())
        .withColumn("_failed", F.array_compact(F.array(*[F.when(~held, F.lit(name)) for name, held in table])))
        .withColumn("_kept", ~F.col("_base_failed") & (F.size("_failed") == 0))
    )


def quality_report(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of ``docs``: counts, the base verdict, the rules broken and whether the document is kept.

    A null text counts as an empty one; repeated rows get a row each; other columns of ``docs`` aren't looked at.
    """
    counts = [F.col(f"_m.{c}").alias(c) for c in _COUNTS]
    return judge(docs.select("doc_id", "text"), rules).select("doc_id", *counts, F.col("_base_failed").alias("base_failed"), F.col("_failed").alias("failed_rules"), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows that pass, with the columns they came with, whatever these are called.

    A null or empty text has no words and fails, like every text of fewer than 50. Each of repeated rows is judged
    alike; an empty table gives no rows. A text in a language whose function words aren't among STOP_WORDS fails
    ``stop_words_per_word``.
    """
    names = docs.columns
    inner = [c if c == "text" else f"c{i}" for i, c in enumerate(names)]
    return judge(docs.toDF(*inner), rules).where("_kept").select(*inner).toDF(*names)
