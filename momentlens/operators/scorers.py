"""Scorers of texts: word rules, a trained classifier, and outside models asked in batches with others to fall back to."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentlens.functions.chat import SCORE_KEYS, parse_key_value_scores, word_count
from momentlens.functions.fusion import cluster_scores
from momentlens.sources.adapters import EMOTIONS

# The scores of a text that no model answers for, in the order of SCORE_KEYS.
UNANSWERED = (0.5, 0.2, 0.1, 0.2, 0.1, 0.1, 0.7, 0.2)

Ask = Callable[[list[str]], Sequence[str | None]]


def rule_scores(text: Column, lexicon: dict[str, tuple[str, ...]]) -> dict[str, Column]:
    """For each score, the share of a text's words that its lexicon entry names (0 without words). Built-in expressions."""
    low = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")
    hits = lambda known: F.size(F.filter(low, lambda w: w.isin(*known)))
    return {name: F.when(F.size(low) > 0, hits(known) / F.size(low)).otherwise(0.0) for name, known in lexicon.items()}


# The score that a lexicon entry's meaning speaks for; other meanings speak for none.
MEANINGS = {"excitement": "excitement", "laughter": "funny", "extreme laughter": "funny", "happiness": "happiness", "love": "happiness", "approval": "happiness", "sadness": "sadness", "crying": "sadness", "anger": "anger", "disgust": "anger", "disapproval": "anger"}


def lexicon_scores(chat: DataFrame, lexicon: DataFrame, keys: list[str], meanings: dict[str, str] = MEANINGS) -> DataFrame:
    """(keys, excitement, funny, happiness, anger, sadness, neutral) of every message: the share of its tokens whose lexicon
    meaning speaks for each; neutral is what is left. A message without tokens is neutral. The lexicon (token, meaning) is
    a table of a few entries, which goes to every task as one row of lists, so no token is moved."""
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in meanings.items() for x in kv]), F.col("meaning"))
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col("message"), F.lit(""))), r"\s+"), "")
    names = sorted(set(meanings.values()))
    spoken = lexicon.withColumn("_kind", kind).where("_kind IS NOT NULL")
    lists = spoken.agg(F.collect_set("token").alias("_any"), *[F.collect_set(F.when(F.col("_kind") == k, F.col("token"))).alias(f"_of_{k}") for k in names])
    told = chat.select(*keys, words.alias("_words")).crossJoin(F.broadcast(lists))
    told = told.withColumn("_hits", F.filter("_words", lambda w: F.array_contains("_any", w)))
    hits = lambda k: F.size(F.filter("_hits", lambda w: F.array_contains(f"_of_{k}", w)))
    out = told.select(*keys, *[(hits(k) / F.greatest(F.size("_words"), F.lit(1))).alias(k) for k in names])
    return out.withColumn("neutral", F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col(k) for k in names), F.lit(0.0))))


def prompt_of(text: Column, speech_rate: Column, absolute: Column, relative: Column) -> Column:
    """What an outside model is asked: the keys it is to answer with, the measures of the segment, and its text."""
    number = lambda x: F.coalesce(F.bround(x, 2).cast("decimal(20,2)").cast("string"), F.lit("unknown"))
    head = "Score the segment. Answer one line for each key, as key: value. sentiment is from -1 to 1, all others from 0 to 1.\nKeys: " + ", ".join(SCORE_KEYS)
    measures = F.concat(F.lit("Words a second: "), number(speech_rate), F.lit("; loudness: "), number(absolute), F.lit("; loudness against the last minutes: "), number(relative))
    return F.concat_ws("\n", F.lit(head), measures, F.concat(F.lit("Text: "), F.coalesce(text, F.lit(""))))


def fit_classifier(labelled: DataFrame, label: str = "label", text: str = "text", features: int = 1 << 14, most_rows: int = 200_000) -> PipelineModel:
    """Logistic regression over TF-IDF of hashed words; rows without a label are left out, a null text has no words.

    It is fitted on ``most_rows`` labelled rows or so, taken by a hash of the text where there are more. Rows of any
    number are then classified.
    """
    rows = labelled.where(F.col(label).isNotNull()).select(F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(label).cast("double").alias("_label"))
    n = rows.count()
    if n > most_rows:
        rows = rows.where(F.pmod(F.xxhash64("_text"), F.lit(1_000_000)) < F.lit(int(1_000_000 * most_rows / n)))
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\s+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        LogisticRegression(featuresCol="_tfidf", labelCol="_label", probabilityCol="_p", maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(rows)


def classify(model: PipelineModel, rows: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``rows`` and ``probabilities``, an array in the order of the labels."""
    found = model.transform(rows.withColumn("_text", F.coalesce(F.col(text), F.lit(""))))
    return found.select(*rows.columns, vector_to_array("_p").alias("probabilities"))


def emotion_scores(probabilities: Column) -> dict[str, Column]:
    """The six emotions and the sentiment from the probabilities of six classes in the order of EMOTIONS."""
    p = {e: F.coalesce(F.get(probabilities, F.lit(i)), F.lit(0.0)) for i, e in enumerate(EMOTIONS)}
    found = cluster_scores({e: p[e] for e in EMOTIONS[:5]})
    return found | {"neutral": F.round(p["neutral"] + 1e-9, 3)}


def highlight_score(probabilities: Column, classes: int = 4) -> Column:
    """The expected class, 0 to 3, of the highlight classifier."""
    return sum((F.coalesce(F.get(probabilities, F.lit(k)), F.lit(0.0)) * k for k in range(classes)), F.lit(0.0))


def ask_models(rows: DataFrame, asks: Sequence[tuple[str, Ask]], prompt: str = "text", batch: int = 32) -> DataFrame:
    """The columns of ``rows``, ``model`` and ``reply``: the first model that answers, and what it says; null if none does.

    Texts go to the first model in batches; those of a batch that fails, and those it gives no answer to, go on to the
    next. A task holds one Arrow batch at a time.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("model", T.StringType()), T.StructField("reply", T.StringType())])

    def run(frames):
        for pdf in frames:
            texts = ["" if x is None else x for x in pdf[prompt]]
            model: list[str | None] = [None] * len(texts)
            reply: list[str | None] = [None] * len(texts)
            for name, ask in asks:
                left = [i for i, r in enumerate(reply) if r is None]
                for at in (left[k : k + batch] for k in range(0, len(left), batch)):
                    try:
                        answers = ask([texts[i] for i in at])
                    except Exception:  # whatever an outside model raises, the next one is asked
                        continue
                    for i, answer in zip(at, answers, strict=False):
                        if answer is not None:
                            model[i], reply[i] = name, answer
            yield pdf.assign(model=pd.Series(model, dtype=object, index=pdf.index), reply=pd.Series(reply, dtype=object, index=pdf.index))

    return rows.mapInPandas(run, schema)


def score_texts(rows: DataFrame, asks: Sequence[tuple[str, Ask]], text: str = "text", batch: int = 32) -> DataFrame:
    """The columns of ``rows``, ``model`` and the eight scores.

    Each distinct text is asked for once. A text of fewer than two words isn't asked for: it is neutral (model
    ``short``). Where no model answers, the scores are UNANSWERED (model ``default``).
    """
    keyed = rows.withColumn("_text", F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")))
    wanted = keyed.where(word_count(F.col("_text")) >= 2).select("_text").distinct()
    replies = ask_models(wanted, asks, "_text", batch)
    scores = parse_key_value_scores(F.col("reply"))
    joined = keyed.join(replies, "_text", "left")
    short = word_count(F.col("_text")) < 2
    out = {"model": F.when(short, "short").otherwise(F.coalesce("model", F.lit("default")))}
    for name, default in zip(SCORE_KEYS, UNANSWERED, strict=True):
        out[name] = F.when(short, 1.0 if name == "neutral" else 0.0).when(F.col("reply").isNull(), default).otherwise(scores[name])
    return joined.withColumns(out).select(*rows.columns, *out)


def score_distinct(rows: DataFrame, key: Column, asks: Sequence[tuple[str, Ask]], text: str = "text", batch: int = 32) -> DataFrame:
    """The columns of ``rows``, ``model`` and the eight scores, asked for once for each distinct ``key`` and joined back.

    Of a key's texts the least one, its blanks made single, is scored.
    """
    keyed = rows.withColumn("_key", key)
    one = keyed.groupBy("_key").agg(F.min(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " "))).alias("_text"))
    replies = ask_models(one.where(word_count(F.col("_text")) >= 2), asks, "_text", batch)
    scores = parse_key_value_scores(F.col("reply"))
    found = [F.when(F.col("reply").isNull(), default).otherwise(scores[name]).alias(f"_{name}") for name, default in zip(SCORE_KEYS, UNANSWERED, strict=True)]
    # texts stay behind here: only keys and scores are joined; a key that wasn't asked for is short
    scored = replies.select(F.col("_key").alias("_of"), F.coalesce("model", F.lit("default")).alias("_model"), *found)
    joined = keyed.join(scored, F.col("_key").eqNullSafe(F.col("_of")), "left")
    short = F.col("_model").isNull()
    out = {"model": F.coalesce("_model", F.lit("short"))}
    out |= {name: F.when(short, 1.0 if name == "neutral" else 0.0).otherwise(F.col(f"_{name}")) for name in SCORE_KEYS}
    return joined.withColumns(out).select(*rows.columns, *out)
