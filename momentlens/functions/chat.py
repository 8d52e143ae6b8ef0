"""Chat text: filters, cleaning, scores in replies, links and artifact paths. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accounts, words and patterns that mark a chat message as noise.
BOTS = ("nightbot", "streamelements", "moobot")
PARTS = ("buy", "subscribe", "follow", "gift", "sub", "donate", "nice", "good game", "lol", "gg")
PATTERNS = (("digits", r"(?U)^\d+$"), ("command", r"^[/!].*"), ("greeting", r"(?U)^(hi|hey|hello|sup)\s+\w+$"), ("link", r"https?://"))
SCORE_KEYS = ("sentiment", "excitement", "funny", "happiness", "anger", "sadness", "neutral", "highlight")


def filter_reason(message: Column, username: Column) -> Column:
    """The first rule that a message breaks, or null: missing, empty, bot, at, phrase, digits, command, greeting, link."""
    low = F.lower(message)
    out = F.when(message.isNull() | username.isNull(), "missing").when(F.trim(message) == "", "empty").when(F.lower(username).isin(*BOTS), "bot").when(message.contains("@"), "at")
    phrase = low.contains(PARTS[0])
    for p in PARTS[1:]:
        phrase = phrase | low.contains(p)
    out = out.when(phrase, "phrase")
    for name, pattern in PATTERNS:
        out = out.when((low if name == "greeting" else message).rlike(pattern), name)
    return out


def filter_chat(chat: DataFrame) -> DataFrame:
    return chat.where(filter_reason(F.col("message"), F.col("username")).isNull())


def normalize_ws(s: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(s, r"(?U)\s+", " ")), F.lit(""))


def clean_message(s: Column) -> Column:
    low = F.regexp_replace(F.lower(s), r"https?://\S+", "")
    return normalize_ws(F.regexp_replace(low, r"(?U)[^\w\s\x{10000}-\x{10FFFF}]", ""))


# Blocks of code points that are emojis: pictographs, transport, symbols, dingbats, stars.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B50}\x{2B55}]"


def extract_emojis(s: Column) -> Column:
    """Single code points that are emojis, in order, repeats kept; selectors, digits and signs aren't."""
    return F.filter(F.split(F.coalesce(s, F.lit("")), ""), lambda c: c.rlike(EMOJI))


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), ""))


def speech_rate(text: Column, start: Column, end: Column) -> Column:
    return F.when(text.isNull() | (F.trim(text) == "") | (end <= start), 0.0).otherwise(word_count(text) / (end - start))


def speech_rate_norm(rate: Column) -> Column:
    return F.when(rate.isNotNull(), F.least(rate / 6, F.lit(1.0)))


def parse_key_value_scores(reply: Column) -> dict[str, Column]:
    """Scores from ``key: value`` lines; the last readable one of a key wins; sentiment in [-1, 1], others in [0, 1]."""
    lines = F.transform(F.split(reply, "\n"), lambda x: F.split(x, ":"))
    out = {}
    for key in SCORE_KEYS:
        mine = F.filter(lines, _has_key(key))
        numbers = F.array_compact(F.transform(mine, lambda p: F.trim(F.get(p, F.lit(1))).try_cast("double")))
        low = -1.0 if key == "sentiment" else 0.0
        out[key] = F.greatest(F.lit(low), F.least(F.lit(1.0), F.coalesce(F.try_element_at(numbers, F.lit(-1)), F.lit(0.0))))
    return out


def _has_key(key: str):
    return lambda p: (F.size(p) > 1) & (F.lower(F.trim(F.get(p, F.lit(0)))) == F.lit(key))


def score_cache_key(model: str, text: Column, *metrics: Column) -> Column:
    return F.concat_ws("|", F.lit(model), *[F.bround(m, 1).cast("decimal(20,1)").cast("string") for m in metrics], F.substring(F.lower(normalize_ws(text)), 1, 100))


def parse_chat_text(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages, lines that don't match) from ``[stamp] user: message``."""
    pattern = r"^\[([^\]]+)\] ([^:]+): (.*)"
    stamp = F.split(F.regexp_extract("line", pattern, 1), ":")
    part = lambda i: F.get(stamp, F.lit(i)).try_cast("double")
    time = F.when(F.size(stamp) == 3, part(0) * 3600 + part(1) * 60 + part(2)).when(F.size(stamp) == 2, part(0) * 60 + part(1)).otherwise(part(0))
    parsed = lines.withColumns({"time": F.when(F.col("line").rlike(pattern), time), "username": F.regexp_extract("line", pattern, 2), "message": F.regexp_extract("line", pattern, 3)})
    return parsed.where("time IS NOT NULL").drop("line"), parsed.where("time IS NULL").select(*lines.columns)


def video_id_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"videos/(\d+)", 1), F.lit(""))


def is_valid_vod_url(url: Column) -> Column:
    return url.rlike(r"^https?://(?:www\.)?twitch\.tv/videos/\d+/?(?:\?.*)?$")


# The category of a kind of file.
CATEGORIES = {"Video Files": ("video",), "Audio Files": ("audio",), "Transcript Files": ("segments", "words", "paragraphs"), "Chat Files": ("chat", "json"), "Waveform Files": ("waveform",)}


def artifact_sizes(files: DataFrame) -> DataFrame:
    """(category, files, bytes, megabytes, gigabytes) of files (kind, bytes), with a row ``total``; other kinds don't count."""
    category = F
    for name, kinds in CATEGORIES.items():
        category = category.when(F.col("kind").isin(*kinds), name)
    rows = files.withColumn("category", category.otherwise(None)).where("category IS NOT NULL AND bytes IS NOT NULL")
    sums = rows.rollup("category").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    size = lambda n: F.col("bytes") / float(1 << n)
    return sums.select(F.coalesce("category", F.lit("total")).alias("category"), "files", "bytes", size(20).alias("megabytes"), size(30).alias("gigabytes"))


def route_artifact(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.rlike("transcript|paragraphs|words|segments"), "transcripts").when(low.contains("chat"), "chatlogs").otherwise("vods")


def annotate(chat: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hits, meanings): lexicon entries among a message's tokens."""
    tokens = chat.select(*keys, F.explode(F.split(F.lower("message"), r"\s+")).alias("token"))
    return tokens.join(lexicon, "token").groupBy(*keys).agg(F.count("*").alias("hits"), F.array_join(F.array_sort(F.collect_set("meaning")), ",").alias("meanings"))
