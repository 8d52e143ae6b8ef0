"""File sources and sinks: chat and transcript JSON, interval tables, lexicons and scored segments."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHAT_SCHEMA = "comments array<struct<content_offset_seconds: double, commenter: struct<display_name: string>, message: struct<body: string>>>, video struct<id: string, duration: double>"
_WORD = "struct<word: string, start: double, `end`: double, punctuated_word: string>"
_PARAGRAPH = "struct<start: double, `end`: double, transcript: string, text: string, sentences: array<struct<text: string, transcript: string>>>"
TRANSCRIPT_SCHEMA = f"results struct<channels: array<struct<alternatives: array<struct<transcript: string, words: array<{_WORD}>, paragraphs: struct<transcript: string, paragraphs: array<{_PARAGRAPH}>>>>>>>"
# The lexicons used where a file is missing.
DEFAULT_LEXICONS = {
    "emote": (("Kappa", "sarcasm"), ("PogChamp", "excitement"), ("LUL", "laughter"), ("BibleThump", "sadness"), ("ResidentSleeper", "boredom"), ("TriHard", "trying hard"), ("4Head", "laughter"), ("DansGame", "disgust"), ("Kreygasm", "excitement"), ("SwiftRage", "anger")),
    "emoji": (("😂", "laughter"), ("😊", "happiness"), ("😍", "love"), ("🔥", "fire"), ("👍", "approval"), ("❤️", "love"), ("😭", "crying"), ("😢", "sadness"), ("😡", "anger"), ("🤔", "thinking")),
    "slang": (("pog", "excitement"), ("poggers", "excitement"), ("monkas", "anxiety"), ("pepega", "silly"), ("omegalul", "extreme laughter"), ("pepelaugh", "laughing at someone"), ("sadge", "sadness"), ("kekw", "laughter"), ("weirdchamp", "disapproval"), ("peeposad", "sadness")),
}


def _video_id(pattern: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def explode_comments(chats: DataFrame) -> DataFrame:
    """(video_id, time, username, message) of CHAT_SCHEMA rows; comments without one of the fields are skipped."""
    c = chats.select(F.col("video.id").alias("video_id"), F.explode("comments").alias("c"))
    out = c.select("video_id", F.col("c.content_offset_seconds").alias("time"), F.col("c.commenter.display_name").alias("username"), F.col("c.message.body").alias("message"))
    return out.where("time IS NOT NULL AND username IS NOT NULL AND message IS NOT NULL")


def read_chat_json(spark: SparkSession, path: str) -> DataFrame:
    """Chat messages of JSON files, one document a file, compressed or not."""
    return explode_comments(spark.read.schema(CHAT_SCHEMA).option("multiLine", True).json(path))


def read_interval_csv(spark: SparkSession, path: str, required: dict[str, str], pattern: str = r"(\d+)[^/]*$") -> DataFrame:
    """Named and typed columns of CSV files (blanks around header names don't count), with video_id from the file's name."""
    raw = spark.read.option("header", True).csv(path)
    named = {c.strip(): c for c in raw.columns}
    missing = [c for c in required if c not in named]
    if missing:
        raise AnalysisException(f"columns missing in {path}: {missing}")
    return raw.select(_video_id(pattern).alias("video_id"), *[F.col(f"`{named[c]}`").cast(t).alias(c) for c, t in required.items()])


def parse_transcript(transcripts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(words, paragraphs) of the first channel's first alternative of TRANSCRIPT_SCHEMA rows.

    A paragraph's text is the first that is not empty of its transcript, its text, its joined sentences, the whole transcript.
    """
    best = transcripts.select(*keys, F.get(F.get("results.channels", F.lit(0))["alternatives"], F.lit(0)).alias("a"))
    w = best.select(*keys, F.explode("a.words").alias("w"))
    words = w.select(*keys, F.col("w.start").alias("start_time"), F.col("w.end").alias("end_time"), F.coalesce("w.punctuated_word", "w.word").alias("word"))
    p = best.select(*keys, F.col("a.paragraphs.transcript").alias("whole"), F.explode("a.paragraphs.paragraphs").alias("p"))
    some = lambda c: F.nullif(c, F.lit(""))
    joined = F.array_join(F.transform("p.sentences", lambda s: F.coalesce(some(s["text"]), s["transcript"])), " ")
    text = F.coalesce(some(F.col("p.transcript")), some(F.col("p.text")), some(joined), F.col("whole"), F.lit(""))
    return words, p.select(*keys, F.col("p.start").alias("start_time"), F.col("p.end").alias("end_time"), text.alias("text"))


def read_transcripts(spark: SparkSession, path: str, pattern: str = r"(\d+)[^/]*$") -> tuple[DataFrame, DataFrame]:
    raw = spark.read.schema(TRANSCRIPT_SCHEMA).option("multiLine", True).json(path)
    return parse_transcript(raw.select(_video_id(pattern).alias("video_id"), "results"), ["video_id"])


def load_lexicon(spark: SparkSession, path: str | None = None, kind: str = "emote") -> DataFrame:
    """(token, meaning), tokens in lower case, of a two-column CSV file, or the kind's default where the path is none or not there."""
    if path:
        try:
            return spark.read.option("header", True).csv(path).toDF("token", "meaning").withColumn("token", F.lower(F.trim("token")))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return spark.createDataFrame([(t.lower(), m) for t, m in DEFAULT_LEXICONS[kind]], "token string, meaning string")


def write_segments(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Segments by video: times first, then scores, ``text`` last."""
    times = [c for c in ("start_time", "end_time") if c in df.columns]
    rest = [c for c in df.columns if c not in (*times, "video_id", "text")]
    ordered = df.select("video_id", *times, *rest, *[c for c in ("text",) if c in df.columns])
    writer = ordered.write.mode("error").partitionBy("video_id").format(form)
    (writer.option("header", True) if form == "csv" else writer).save(path)


def file_sizes(spark: SparkSession, path: str, kinds: dict[str, str], pattern: str = "*", of: int = -1) -> DataFrame:
    """(path, kind, bytes) of the files under a folder; ``kinds`` names a kind by a regular expression on the file's name (or,
    with ``of`` -2, on that of its folder), the first that fits.

    Only the metadata of the files is read, never what they hold. The source passes over empty files, which add no bytes.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    name = F.element_at(F.split("path", "/"), of)
    kind = F
    for k, expression in kinds.items():
        kind = kind.when(name.rlike(expression), k)
    return found.select("path", kind.otherwise(None).alias("kind"), "bytes")


# How the artifacts of a recording are named, the more special names first.
ARTIFACT_NAMES = {"words": "(?i)_words[.]", "paragraphs": "(?i)_paragraphs[.]", "segments": "(?i)_segments[.]", "chat": "(?i)_chat.*[.]csv$", "json": "(?i)_chat.*[.]json$", "waveform": "(?i)waveform", "video": "(?i)[.]mp4$", "audio": "(?i)[.](mp3|wav)$"}
