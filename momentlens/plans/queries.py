"""Registered queries over the adapters, each with the SQL it must agree with where SQL can express it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentlens.functions import chat as C
from momentlens.functions import fusion as U
from momentlens.functions import scores as N
from momentlens.operators import chains as K
from momentlens.operators import intervals as J
from momentlens.operators import peaks as P
from momentlens.operators import selection as Q
from momentlens.operators import telemetry as M
from momentlens.operators import windows as W
from momentlens.sources import adapters as A
from momentlens.sources import files as S
from momentlens.sources.adapters import EMOTIONS

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _round(x, digits: int):
    """Rounds off the middle between two values, where sums in another order would round either way."""
    return F.round((F.col(x) if isinstance(x, str) else x) + 1e-9, digits)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = re.sub(r", ([346])\)(?= AS |,| END| \+ 0)", r" + 1e-9, \1)", sql)
        return f

    return add


def hour():
    """The pieces of a timeline that running sums and row numbers are formed in."""
    return F.floor(F.col("t") / 3600)


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: _round(F.col(n).cast("double"), 6) for n in names})


def _r(*names: str) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in names)


EMO = ", ".join(EMOTIONS)
_AVG = ", ".join(f"avg({m}) AS avg_{m}" for m in ("sentiment_score", "highlight_score", *EMOTIONS))
_AVGS = [f"avg_{m}" for m in ("sentiment_score", "highlight_score", *EMOTIONS)]
_TUMBLE = f"""t AS (SELECT *, t0 + floor((time - t0) / 30.0e0) * 30.0e0 AS start_time FROM (SELECT *, min(time) OVER (PARTITION BY video_id) AS t0, max(time) OVER (PARTITION BY video_id) AS t1 FROM ({A.SCORED_SQL}) AS z) AS y),
cw AS (SELECT video_id, start_time, start_time + 30.0e0 AS end_time, count(*) AS message_count, {_AVG} FROM t WHERE start_time < t1 GROUP BY video_id, start_time)"""


def chat_windows(spark, sf_dir):
    scored = W.tumbling_assign(A.scored_chat(spark, sf_dir), ["video_id"])
    return scored.groupBy("video_id", "start_time", "end_time").agg(F.count("*").alias("message_count"), *[F.avg(m[4:]).alias(m) for m in _AVGS])


@query(f"WITH {_TUMBLE} SELECT video_id, message_count, {_r('start_time', 'end_time', *_AVGS)} FROM cw")
def a1_chat_window_stats(spark, sf_dir):
    return r6(chat_windows(spark, sf_dir), "start_time", "end_time", *_AVGS)


@query(f"WITH {_TUMBLE}, k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY message_count DESC, start_time) AS rank FROM cw) SELECT video_id, rank, message_count, {_r('start_time')} FROM k WHERE rank <= 10")
def t1_top_k(spark, sf_dir):
    return r6(W.top_k(chat_windows(spark, sf_dir), ["video_id"], "message_count", 10, "start_time").select("video_id", F.col("rank").cast("long").alias("rank"), "message_count", "start_time"), "start_time")


_LOW = "lower(message)"
_PHRASE = " OR ".join(f"contains({_LOW}, '{p}')" for p in C.PARTS)
_REASON = f"""CASE WHEN message IS NULL OR username IS NULL THEN 'missing' WHEN trim(message) = '' THEN 'empty' WHEN lower(username) IN ('nightbot', 'streamelements', 'moobot') THEN 'bot' WHEN contains(message, '@') THEN 'at'
 WHEN {_PHRASE} THEN 'phrase' WHEN regexp_matches(message, '^\\p{{Nd}}+$') THEN 'digits' WHEN regexp_matches(message, '^[/!].*') THEN 'command'
 WHEN regexp_matches({_LOW}, '^(hi|hey|hello|sup)\\s+[\\p{{L}}\\p{{N}}_]+$') THEN 'greeting' WHEN regexp_matches(message, 'https?://') THEN 'link' END"""


@query(f"SELECT doc_id, line_no, message FROM ({A.NOISY_SQL}) AS c WHERE ({_REASON}) IS NULL")
def p1_filter_chat(spark, sf_dir):
    return C.filter_chat(A.noisy_chat(spark, sf_dir)).select("doc_id", "line_no", "message")


@query(f"SELECT coalesce({_REASON}, 'kept') AS reason, count(*) AS n FROM ({A.NOISY_SQL}) AS c GROUP BY 1")
def p2_filter_reason(spark, sf_dir):
    return A.noisy_chat(spark, sf_dir).groupBy(F.coalesce(C.filter_reason(F.col("message"), F.col("username")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""SELECT a.event_id AS a_id, b.event_id AS b_id, a.time <= b.time + 20 AND b.time <= a.time + 30 AS touching, a.time < b.time + 20 AND a.time + 30 > b.time AS open,
 (a.time >= b.time AND a.time + 30 <= b.time + 20) OR (a.time < b.time AND a.time + 30 > b.time AND a.time + 30 <= b.time + 20) OR (a.time >= b.time AND a.time < b.time + 20 AND a.time + 30 > b.time + 20) OR (a.time <= b.time AND a.time + 30 >= b.time + 20) AS words
 FROM ({A.SCORED_SQL}) AS a JOIN ({A.SCORED_SQL}) AS b ON b.event_id = a.event_id + 1""")
def p3_overlaps(spark, sf_dir):
    s = A.scored_chat(spark, sf_dir).select("event_id", "time")
    b = s.select((F.col("event_id") - 1).alias("event_id"), F.col("event_id").alias("b_id"), F.col("time").alias("b_time"))
    x = (F.col("time"), F.col("time") + 30, F.col("b_time"), F.col("b_time") + 20)
    return s.join(b, "event_id").select(F.col("event_id").alias("a_id"), "b_id", J.overlaps(*x, "touching").alias("touching"), J.overlaps(*x).alias("open"), J.overlaps(*x, "words").alias("words"))


@query("SELECT video, regexp_extract(url, 'videos/(\\d+)', 1) AS video_id, regexp_matches(url, '^https?://(?:www\\.)?twitch\\.tv/videos/\\d+/?(?:\\?.*)?$') AS valid FROM (SELECT event_id AS video, CASE WHEN event_id % 3 = 0 THEN 'https://www.twitch.tv/videos/' ELSE 'https://example.org/videos/' END || event_id || CASE WHEN event_id % 2 = 0 THEN '?t=1' ELSE '/x' END AS url FROM events)")
def p6_video_links(spark, sf_dir):
    url = F.concat(F.when(F.col("event_id") % 3 == 0, "https://www.twitch.tv/videos/").otherwise("https://example.org/videos/"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, "?t=1").otherwise("/x"))
    return A.table(spark, sf_dir, "events").select(F.col("event_id").alias("video"), C.video_id_of(url).alias("video_id"), C.is_valid_vod_url(url).alias("valid"))


@query(f"""SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(regexp_replace(lower(message), 'https?://\\S+', '', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'), '\\s+', ' ', 'g')) AS cleaned,
 trim(regexp_replace(message, '\\s+', ' ', 'g')) AS plain, CAST(length(trim(regexp_replace(message, '\\s+', ' ', 'g'))) AS BIGINT) AS message_length FROM ({A.CHAT_SQL}) AS c""")
def f1_clean_message(spark, sf_dir):
    plain = C.normalize_ws(F.col("message"))
    return A.chat_messages(spark, sf_dir).select("doc_id", "line_no", C.clean_message(F.col("message")).alias("cleaned"), plain.alias("plain"), F.length(plain).cast("long").alias("message_length"))


_EMOJI_SQL = C.EMOJI.replace("\\", "\\")


@query(f"SELECT doc_id, line_no, array_to_string(e, ',') AS emojis, CAST(len(e) AS BIGINT) AS emoji_count FROM (SELECT doc_id, line_no, regexp_extract_all(message, '{_EMOJI_SQL}') AS e FROM ({A.EMOTED_SQL}) AS c) AS z")
def f3_emojis(spark, sf_dir):
    found = C.extract_emojis(F.col("message"))
    return A.emoted_chat(spark, sf_dir).select("doc_id", "line_no", F.array_join(found, ",").alias("emojis"), F.size(found).cast("long").alias("emoji_count"))


_LEXICON_ROWS = ", ".join(f"('{t.lower()}', '{m}')" for kind in sorted(S.DEFAULT_LEXICONS) for t, m in S.DEFAULT_LEXICONS[kind])


@query(f"SELECT doc_id, line_no, count(*) AS hits, string_agg(DISTINCT meaning, ',' ORDER BY meaning) AS meanings FROM (SELECT doc_id, line_no, unnest(regexp_split_to_array(lower(message), '\\s+')) AS token FROM ({A.EMOTED_SQL}) AS c) AS t JOIN (VALUES {_LEXICON_ROWS}) AS l(token, meaning) ON t.token = l.token GROUP BY 1, 2")
def s5_lexicons(spark, sf_dir):
    """Chat with the meanings of its emotes, emojis and slang; the three lexicons are the defaults, as no file is given."""
    lexicon = S.load_lexicon(spark, kind="emote").unionByName(S.load_lexicon(spark, kind="emoji")).unionByName(S.load_lexicon(spark, kind="slang"))
    return C.annotate(A.emoted_chat(spark, sf_dir), lexicon, ["doc_id", "line_no"])


@query(f"SELECT doc_id, line_no, count(*) AS hits, string_agg(DISTINCT meaning, ',' ORDER BY meaning) AS meanings FROM (SELECT doc_id, line_no, unnest(regexp_split_to_array(lower(message), '\\s+')) AS token FROM ({A.CHAT_SQL}) AS c) AS t JOIN (VALUES ('the', 'article'), ('of', 'preposition'), ('and', 'conjunction'), ('in', 'preposition')) AS l(token, meaning) ON t.token = l.token GROUP BY 1, 2")
def f5_lexicon_annotate(spark, sf_dir):
    lexicon = spark.createDataFrame([("the", "article"), ("of", "preposition"), ("and", "conjunction"), ("in", "preposition")], "token string, meaning string")
    return C.annotate(A.chat_messages(spark, sf_dir), lexicon, ["doc_id", "line_no"])


@query(f"""SELECT video_id, ord, round(rate, 6) AS rate, round(least(rate / 6, 1.0e0), 6) AS norm FROM (SELECT video_id, ord, CASE WHEN end_time <= start_time OR trim(text) = '' THEN 0.0e0 ELSE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) / (end_time - start_time) END AS rate FROM ({A.PARAGRAPHS_SQL}) AS p) AS q""")
def f6_speech_rate(spark, sf_dir):
    rate = C.speech_rate(F.col("text"), F.col("start_time"), F.col("end_time"))
    return A.paragraphs(spark, sf_dir).select("video_id", "ord", _round(rate, 6).alias("rate"), _round(C.speech_rate_norm(rate), 6).alias("norm"))


@query("""SELECT event_id, round(greatest(-1.0e0, least(1.0e0, value / 250.0e0 - 1)), 6) AS sentiment, round(least(1.0e0, value / 300.0e0), 6) AS funny, 0.0e0 AS anger FROM (SELECT event_id, CAST(CAST(value AS DECIMAL(12, 4)) AS DOUBLE) AS value FROM events)""")
def f8_parse_scores(spark, sf_dir):
    v = F.col("value").cast("decimal(12,4)").cast("double")
    reply = F.concat(F.lit("funny: 0.1\nSentiment : "), (v / 250.0 - 1).cast("decimal(20,12)").cast("string"), F.lit("\nfunny:"), (v / 300.0).cast("decimal(20,12)").cast("string"), F.lit("\nanger: high"))
    got = C.parse_key_value_scores(reply)
    return A.table(spark, sf_dir, "events").select("event_id", *[_round(got[k], 6).alias(k) for k in ("sentiment", "funny", "anger")])


@query(f"""WITH k AS (SELECT video_id, ord, substr(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 100) AS key FROM ({A.PARAGRAPHS_SQL}) AS p)
SELECT video_id, ord, round(length(key) / 100.0e0, 6) AS highlight, CAST(count(*) OVER (PARTITION BY key) AS BIGINT) AS uses FROM k""")
def j8_score_distinct(spark, sf_dir):
    """Each distinct cache key is scored once (by its length) and the score joined back, with how many rows it serves."""
    keyed = A.paragraphs(spark, sf_dir).select("video_id", "ord", C.score_cache_key("m", F.col("text")).alias("key"))
    scored = keyed.groupBy("key").agg(F.count("*").alias("uses")).withColumn("highlight", (F.length("key") - 2) / 100.0)
    return keyed.join(scored, "key").select("video_id", "ord", _round("highlight", 6).alias("highlight"), "uses")


def _chat_lines(spark, sf_dir):
    """Stamps of hours, of minutes and of seconds, and lines without a stamp, in turn."""
    t, k = F.col("time"), (F.col("doc_id") + F.col("line_no")) % 4
    part = lambda x: F.floor(x).cast("string")
    hours = F.concat_ws(":", part(t / 3600), part(t / 60 % 60), part(t % 60))
    stamp = F.when(k == 0, hours).when(k == 1, F.concat_ws(":", part(t / 60), part(t % 60))).otherwise(part(t))
    rest = F.concat(F.col("username"), F.lit(": "), F.col("message"))
    return A.chat_messages(spark, sf_dir).select("doc_id", "line_no", F.when(k == 3, rest).otherwise(F.concat(F.lit("["), stamp, F.lit("] "), rest)).alias("line"))


@query(f"SELECT doc_id, line_no, CAST(floor(time) AS DOUBLE) AS time, username, message FROM ({A.CHAT_SQL}) AS c WHERE (doc_id + line_no) % 4 <> 3")
def s2_parse_chat_text(spark, sf_dir):
    return C.parse_chat_text(_chat_lines(spark, sf_dir))[0].select("doc_id", "line_no", "time", "username", "message")


@query(f"SELECT doc_id, line_no, username || ': ' || message AS line FROM ({A.CHAT_SQL}) AS c WHERE (doc_id + line_no) % 4 = 3")
def s2_lines_without_stamp(spark, sf_dir):
    return C.parse_chat_text(_chat_lines(spark, sf_dir))[1]


_KIND = "CASE event_id % 9 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' WHEN 2 THEN 'segments' WHEN 3 THEN 'words' WHEN 4 THEN 'paragraphs' WHEN 5 THEN 'chat' WHEN 6 THEN 'json' WHEN 7 THEN 'waveform' ELSE 'other' END"
_CATEGORY = "CASE WHEN kind = 'video' THEN 'Video Files' WHEN kind = 'audio' THEN 'Audio Files' WHEN kind IN ('segments', 'words', 'paragraphs') THEN 'Transcript Files' WHEN kind IN ('chat', 'json') THEN 'Chat Files' WHEN kind = 'waveform' THEN 'Waveform Files' END"


@query(f"SELECT coalesce(category, 'total') AS category, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes) / 1048576.0e0, 6) AS megabytes, round(sum(bytes) / 1073741824.0e0, 6) AS gigabytes FROM (SELECT {_CATEGORY} AS category, bytes FROM (SELECT {_KIND} AS kind, CAST(floor(value * 1000000) AS BIGINT) AS bytes FROM events) AS f) AS z WHERE category IS NOT NULL GROUP BY ROLLUP (category)")
def s7_artifact_sizes(spark, sf_dir):
    files = A.table(spark, sf_dir, "events").select(F.expr(_KIND).alias("kind"), F.floor(F.col("value") * 1000000).cast("long").alias("bytes"))
    return r6(C.artifact_sizes(files), "megabytes", "gigabytes")


@query("SELECT dataset, count(*) AS n FROM (SELECT CASE WHEN event_type IN ('view', 'signup', 'error') THEN 'transcripts' WHEN event_type = 'click' THEN 'chatlogs' ELSE 'vods' END AS dataset FROM events) AS x GROUP BY dataset")
def s8_routed_artifacts(spark, sf_dir):
    e = F.col("event_type")
    path = F.when(e == "view", "out/Words_1.csv").when(e == "signup", "a/chat_Segments.csv").when(e == "error", "x/transcript.json").when(e == "click", "out/1_Chat.json").otherwise("out/a.mp4")
    return A.table(spark, sf_dir, "events").groupBy(C.route_artifact(path).alias("dataset")).agg(F.count("*").alias("n"))


_WIN = f"""x AS (SELECT video_id, max(end_time) AS last FROM ({A.WORDS_SQL}) AS w GROUP BY video_id),
g AS (SELECT video_id, last, unnest(range(0, CAST(ceil((last - 59) / 30) AS BIGINT))) AS window_id FROM x WHERE last > 59),
v AS (SELECT video_id, window_id, window_id * 30.0e0 AS start_time, least(window_id * 30.0e0 + 60, last) AS end_time FROM g)"""


def _windows(spark, sf_dir):
    return W.sliding_windows(A.words(spark, sf_dir).groupBy("video_id").agg(F.max("end_time").alias("last")), ["video_id"])


@query(f"WITH {_WIN} SELECT video_id, window_id, start_time, end_time FROM v WHERE end_time - start_time >= 30")
def w2_sliding_windows(spark, sf_dir):
    return _windows(spark, sf_dir)


@query(f"WITH {_WIN}, k AS (SELECT * FROM v WHERE end_time - start_time >= 30), m AS (SELECT x.video_id, last, max(k.end_time) AS till, max(k.window_id) AS id FROM x LEFT JOIN k ON k.video_id = x.video_id GROUP BY 1, 2) SELECT video_id, window_id, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time FROM k UNION ALL SELECT video_id, coalesce(id, -1) + 1, round(greatest(0.0e0, last - 60), 6), round(last, 6) FROM m WHERE coalesce(till, 0) < last")
def w2_windows_to_the_end(spark, sf_dir):
    """With a last window that ends where the recording does."""
    return r6(W.sliding_windows(A.words(spark, sf_dir).groupBy("video_id").agg(F.max("end_time").alias("last")), ["video_id"], cover_tail=True), "start_time", "end_time")


@query(f"""WITH {_WIN}, c AS (SELECT v.video_id, v.window_id, count(*) AS n FROM v JOIN ({A.WORDS_SQL}) AS w ON w.video_id = v.video_id AND w.start_time < v.end_time AND w.end_time > v.start_time
 WHERE least(w.end_time, v.end_time) - greatest(w.start_time, v.start_time) >= 0.5 * (w.end_time - w.start_time) GROUP BY 1, 2),
p AS (SELECT v.video_id, v.window_id, string_agg(q.text, ' ' ORDER BY q.ord) AS text FROM v JOIN ({A.PARAGRAPHS_SQL}) AS q ON q.video_id = v.video_id AND q.start_time < v.end_time AND q.end_time > v.start_time
 WHERE least(q.end_time, v.end_time) - greatest(q.start_time, v.start_time) >= 0.3 * (q.end_time - q.start_time) GROUP BY 1, 2)
SELECT v.video_id, v.window_id, v.start_time, v.end_time, coalesce(c.n, 0) AS word_count, round(coalesce(c.n, 0) / 60.0e0, 6) AS speech_rate, coalesce(p.text, '') AS text FROM v LEFT JOIN c ON v.video_id = c.video_id AND v.window_id = c.window_id LEFT JOIN p ON v.video_id = p.video_id AND v.window_id = p.window_id WHERE v.end_time - v.start_time >= 30""")
def w3_sliding_pipeline(spark, sf_dir):
    win = _windows(spark, sf_dir).withColumnsRenamed({"start_time": "r_start", "end_time": "r_end"})
    cut = F.least("end_time", "r_end") - F.greatest("start_time", "r_start")
    share = lambda x: cut >= x * (F.col("end_time") - F.col("start_time"))
    n = W.counts_on_grid(A.words(spark, sf_dir), ["video_id"])
    t = J.interval_join(A.paragraphs(spark, sf_dir), win, ["video_id"]).where(share(0.3)).groupBy("video_id", "window_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ").alias("text"))
    out = win.join(n, ["video_id", "window_id"], "left").join(t, ["video_id", "window_id"], "left")
    count = F.coalesce("n", F.lit(0))
    return out.select("video_id", "window_id", F.col("r_start").alias("start_time"), F.col("r_end").alias("end_time"), count.alias("word_count"), _round(count / 60.0, 6).alias("speech_rate"), F.coalesce("text", F.lit("")).alias("text"))


_GRID = "(SELECT event_id, user_id % 10 AS video_id, date_diff('millisecond', timestamp '2024-01-01', ts) / 100000.0e0 AS start_time FROM events)"


def _in_windows(s: DataFrame, how: str = "inner") -> DataFrame:
    """Messages of each message's next 60 seconds and 15 after, and their score."""
    win = s.select("event_id", "video_id", F.col("time").alias("start_time"), (F.col("time") + 60 + 15.0).alias("end_time"))
    points = s.select("video_id", "time", F.col("highlight_score").alias("score"))
    found = W.overlap_sums(win, points, ["video_id"], ["event_id"], ["score"], ("start_time", "end_time", "time", "time"), how=how)
    return found.withColumn("score", _round("score", 6))


@query(f"SELECT g.event_id, count(s.event_id) AS n, round(sum(s.highlight_score), 6) AS score FROM {_GRID} AS g JOIN ({A.SCORED_SQL}) AS s ON s.video_id = g.video_id AND s.time >= g.start_time AND s.time <= g.start_time + 60 + 15 GROUP BY 1")
def j2_point_in_interval(spark, sf_dir):
    return _in_windows(A.scored_chat(spark, sf_dir))


@query(f"SELECT g.event_id, count(s.event_id) AS n, round(sum(s.highlight_score), 6) AS score FROM (SELECT event_id, video_id, time AS start_time FROM ({A.SCORED_SQL}) AS w) AS g LEFT JOIN ({A.SCORED_SQL}) AS s ON s.video_id = g.video_id AND s.time >= g.start_time AND s.time <= g.start_time + 60 + 15 GROUP BY 1")
def j2_all_windows(spark, sf_dir):
    return _in_windows(A.scored_chat(spark, sf_dir), "left")


@query(f"""SELECT a.event_id AS a_id, count(*) AS n, CAST(sum(b.event_id) AS BIGINT) AS ids FROM ({A.SCORED_SQL}) AS a JOIN ({A.SCORED_SQL}) AS b ON a.video_id = b.video_id AND a.time <= b.time + 100 * b.highlight_score AND b.time <= a.time + 45 GROUP BY 1""")
def j1_interval_join(spark, sf_dir):
    s = A.scored_chat(spark, sf_dir)
    a = s.select("video_id", "event_id", F.col("time").alias("start_time"), (F.col("time") + 45).alias("end_time"))
    b = s.select("video_id", F.col("event_id").alias("b_id"), F.col("time").alias("r_start"), (F.col("time") + 100 * F.col("highlight_score")).alias("r_end"))
    return W.overlap_sums(a, b, ["video_id"], ["event_id"], ["b_id"]).select(F.col("event_id").alias("a_id"), "n", F.col("b_id").alias("ids"))


_AUDIO = f"au AS (SELECT video_id, CAST(floor(time / 60) AS BIGINT) AS seg, {', '.join(f'avg({m}) AS {m}' for m in ('sentiment_score', 'highlight_score', *EMOTIONS))} FROM ({A.SCORED_SQL}) AS s WHERE event_id % 2 = 0 GROUP BY 1, 2)"
_SIDE = f"ch AS (SELECT video_id, CAST(floor(time / 30) AS BIGINT) AS w, {', '.join(f'avg({m}) AS c_{m}' for m in ('sentiment_score', 'highlight_score', *EMOTIONS))} FROM ({A.SCORED_SQL}) AS s WHERE event_id % 2 = 1 GROUP BY 1, 2)"
_METRICS = ("sentiment_score", "highlight_score", *EMOTIONS)


def _sides(spark, sf_dir):
    s = A.scored_chat(spark, sf_dir)
    seg = F.floor(F.col("time") / 60)
    audio = s.where("event_id % 2 = 0").groupBy("video_id", seg.alias("seg")).agg(*[F.avg(m).alias(m) for m in _METRICS])
    audio = audio.withColumns({"start_time": F.col("seg") * 60.0, "end_time": F.col("seg") * 60.0 + 60})
    chat = s.where("event_id % 2 = 1").groupBy("video_id", F.floor(F.col("time") / 30).alias("w")).agg(*[F.avg(m).alias(f"c_{m}") for m in _METRICS])
    return audio, chat.withColumns({"r_start": F.col("w") * 30.0, "r_end": F.col("w") * 30.0 + 30}).drop("w")


def integrated(spark, sf_dir, wa=0.6, wc=0.4):
    """Audio segments with overlap-weighted chat, fused emotions, relationship and the enhanced score."""
    audio, chat = _sides(spark, sf_dir)
    near = J.overlap_weighted_avg(audio, chat, ["video_id"], "seg", [f"c_{m}" for m in _METRICS])
    x = audio.join(near, ["video_id", "seg"], "left")
    a, c = U.cols(), U.cols("c_")
    fused = U.fuse_emotions(a, c, F.lit(wa), F.lit(wc))
    da, dc = U.dominant(a), U.dominant(c)
    align, rel = U.alignment(a, c), U.relationship(da, dc)
    m = F.col("matched").isNotNull()
    zero = lambda v: F.when(m, v).otherwise(0.0)
    new = {f"fused_{e}": zero(v) for e, v in zip(EMOTIONS, fused, strict=True)}
    new |= {"fused_sentiment": zero(U.fuse_sentiment(F.col("sentiment_score"), F.greatest(*a), F.col("c_sentiment_score"), F.greatest(*c))), "alignment": zero(align), "relationship": F.when(m, rel).otherwise(""), "enhanced": zero(U.enhanced_score(F.col("highlight_score"), F.col("c_highlight_score"), align, rel))}
    return x.withColumns(new)


def _dom(prefix):
    top = f"greatest({', '.join(prefix + e for e in EMOTIONS)})"
    return "CASE " + " ".join(f"WHEN {prefix}{e} = {top} THEN '{e}'" for e in EMOTIONS) + " END"


_POS, _NEG = "('excitement', 'funny', 'happiness')", "('anger', 'sadness')"
_FUSED_SUM = " + ".join(f"({e} * 0.6e0 + c_{e} * 0.4e0)" for e in EMOTIONS)
_INTEGRATED = f"""WITH {_AUDIO}, {_SIDE},
m AS (SELECT a.video_id, a.seg, {", ".join(f"coalesce(sum(c.c_{m} * ov) / nullif(sum(ov), 0), 0) AS c_{m}" for m in _METRICS)} FROM (SELECT a.video_id, a.seg, c.*, greatest(0.0e0, least(a.seg * 60.0e0 + 60, c.w * 30.0e0 + 30) - greatest(a.seg * 60.0e0, c.w * 30.0e0)) AS ov FROM au AS a JOIN (SELECT video_id AS v, w, {", ".join("c_" + m for m in _METRICS)} FROM ch) AS c ON c.v = a.video_id AND a.seg * 60.0e0 <= c.w * 30.0e0 + 30 AND c.w * 30.0e0 <= a.seg * 60.0e0 + 60) AS c JOIN au AS a ON a.video_id = c.video_id AND a.seg = c.seg GROUP BY 1, 2),
j AS (SELECT au.*, m.video_id IS NOT NULL AS hit, {", ".join("m.c_" + m for m in _METRICS)}, {_FUSED_SUM} AS fs, {_dom("")} AS da, {_dom("c_")} AS dc, ({" + ".join(f"(1 - abs({e} - c_{e}))" for e in EMOTIONS)}) / 6 AS al FROM au LEFT JOIN m ON au.video_id = m.video_id AND au.seg = m.seg),
k AS (SELECT *, CASE WHEN da = dc THEN 'synchronized' WHEN da IN {_POS} AND dc IN {_POS} THEN 'positive_aligned' WHEN da IN {_NEG} AND dc IN {_NEG} THEN 'negative_aligned' WHEN da IN {_POS} AND dc IN {_NEG} THEN 'audience_negative' WHEN da IN {_NEG} AND dc IN {_POS} THEN 'audience_positive' ELSE 'mixed' END AS rel,
 greatest({EMO}) AS ca, greatest({", ".join("c_" + e for e in EMOTIONS)}) AS cc FROM j),
i AS (SELECT *, {", ".join(f"CASE WHEN hit THEN ({e} * 0.6e0 + c_{e} * 0.4e0) / CASE WHEN fs > 0 THEN fs ELSE 1 END ELSE 0 END AS fused_{e}" for e in EMOTIONS)},
 CASE WHEN NOT hit THEN 0 WHEN ca <= 0 THEN c_sentiment_score WHEN cc <= 0 THEN sentiment_score ELSE (sentiment_score * ca + c_sentiment_score * cc) / (ca + cc) END AS fused_sentiment,
 CASE WHEN hit THEN al ELSE 0 END AS alignment, CASE WHEN hit THEN rel ELSE '' END AS relationship,
 CASE WHEN hit THEN least(1.0e0, 0.6e0 * highlight_score + 0.4e0 * c_highlight_score + CASE rel WHEN 'synchronized' THEN 0.15e0 WHEN 'positive_aligned' THEN 0.1e0 WHEN 'audience_positive' THEN 0.08e0 WHEN 'audience_negative' THEN 0.05e0 ELSE 0 END + 0.1e0 * al) ELSE 0 END AS enhanced, seg * 60.0e0 AS start_time FROM k)
"""
_FUSED = [f"fused_{e}" for e in EMOTIONS]


@query(f"{_INTEGRATED} SELECT video_id, seg, relationship, {_r(*_FUSED, 'fused_sentiment', 'alignment', 'enhanced')} FROM i")
def j7_integrate(spark, sf_dir):
    return r6(integrated(spark, sf_dir).select("video_id", "seg", "relationship", *_FUSED, "fused_sentiment", "alignment", "enhanced"), *_FUSED, "fused_sentiment", "alignment", "enhanced")


_SMOOTHED = """sm AS (SELECT *, CASE WHEN n < 15 OR r <= 7 OR r > n - 7 THEN enhanced ELSE m END AS smooth FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n, row_number() OVER (PARTITION BY video_id ORDER BY seg) AS r, avg(enhanced) OVER (PARTITION BY video_id ORDER BY seg ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m FROM i) AS q),
th AS (SELECT video_id, quantile_cont(smooth, 0.85) AS thr FROM sm GROUP BY 1)"""


@query(f"""{_INTEGRATED}, {_SMOOTHED}, mi AS (SELECT video_id, CAST(floor(start_time / 60) AS BIGINT) AS minute, avg(smooth) AS score, {", ".join(f"avg({x}) AS {x}" for x in _FUSED)} FROM sm GROUP BY 1, 2)
SELECT mi.video_id, minute, {_r("score", *_FUSED)}, {_dom("fused_")} AS dominant, score > 0.8e0 * thr + 1e-9 AS marked FROM mi JOIN th ON mi.video_id = th.video_id""")
def a10_minute_summary(spark, sf_dir):
    x = W.smooth_moving_average(integrated(spark, sf_dir), ["video_id"], ["seg"], F.floor(F.col("seg") / 4096), "enhanced").withColumnRenamed("smoothed", "smooth")
    marked = W.minute_summary(x, ["video_id"], "start_time", "smooth", _FUSED)
    return r6(marked.select("video_id", "minute", "score", *_FUSED, U.dominant(U.cols("fused_")).alias("dominant"), "marked"), "score", *_FUSED)


_STAMP = "CASE WHEN {0} < 600 THEN '0' ELSE '' END || CAST(CAST(floor({0} / 60) AS BIGINT) AS VARCHAR) || ':00'"
_TABLE = f"""e AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(enhanced, 9) DESC, start_time) AS rank FROM i),
d AS (SELECT e.video_id, rank, start_time, start_time + 60 AS end_time, 60.0e0 AS duration, round(enhanced, 6) AS score, {_STAMP.format("start_time")} AS starts, {_STAMP.format("(start_time + 60)")} AS ends, CASE WHEN greatest({", ".join(_FUSED)}) = 0 THEN 'neutral' ELSE {_dom("fused_")} END AS emotion, relationship AS reaction, da AS streamer_emotion, round(greatest({", ".join(EMOTIONS[:5])}), 6) AS intensity,
 CASE WHEN length(t.text) > 50 THEN substr(t.text, 1, 47) || '...' ELSE coalesce(t.text, '') END AS content FROM e LEFT JOIN (SELECT doc_id, text FROM documents) AS t ON t.doc_id = e.seg * 10 + e.video_id WHERE rank <= 15)"""


@query(f"{_INTEGRATED}, {_TABLE} SELECT * FROM d")
def t2_editor_table(spark, sf_dir):
    """The fifteen best segments of each recording; a segment's content is the document of its number."""
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "text")
    top = W.top_k(integrated(spark, sf_dir).withColumn("enhanced", F.round("enhanced", 9)), ["video_id"], "enhanced", 15, "start_time")
    whole = top.join(docs, F.col("doc_id") == F.col("seg") * 10 + F.col("video_id"), "left")
    mmss = lambda c: U.format_mmss(F.col(c))
    return whole.select("video_id", F.col("rank").cast("long").alias("rank"), "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"), _round("enhanced", 6).alias("score"), mmss("start_time").alias("starts"), mmss("end_time").alias("ends"), U.dominant(U.cols("fused_"), default="neutral").alias("emotion"), F.col("relationship").alias("reaction"), U.dominant(U.cols()).alias("streamer_emotion"), _round(F.greatest(*EMOTIONS[:5]), 6).alias("intensity"), F.coalesce(U.truncate_text(F.col("text")), F.lit("")).alias("content"))


@query(f"""{_INTEGRATED}, e AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(enhanced, 9) DESC, start_time) AS rank FROM i), top AS (SELECT video_id, rank, seg, {_dom("fused_").replace("fused_neutral", "-1")} AS emotion FROM e WHERE rank <= 10),
u AS ({' UNION ALL '.join(f"""SELECT video_id, '{e}' AS emotion, fused_{e} AS v, seg FROM i""" for e in EMOTIONS)}), kk AS (SELECT *, row_number() OVER (PARTITION BY video_id, emotion ORDER BY round(v, 9) DESC, seg) AS n FROM u)
SELECT video_id, emotion, seg, CAST(rank AS BIGINT) AS rank FROM top UNION ALL SELECT video_id, emotion, seg, 0 FROM kk WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM top WHERE top.video_id = kk.video_id AND top.emotion = kk.emotion)""")
def t3_cover_all_emotions(spark, sf_dir):
    return W.cover_all(integrated(spark, sf_dir).withColumns({e: F.round(e, 9) for e in ("enhanced", *_FUSED)}), ["video_id"], "enhanced", "seg", {e: f"fused_{e}" for e in EMOTIONS}, EMOTIONS[:5], 10)


_SEG = f"{_AUDIO}, sg AS (SELECT *, seg * 60.0e0 AS start_time, greatest({', '.join(EMOTIONS[:5])}) AS emo FROM au)"


@query(f"WITH {_SEG} SELECT video_id, seg, round(0.95e0 * highlight_score + 0.05e0 * emo, 6) AS pre, round(0.5e0 * highlight_score + 0.2e0 * emo + 0.1e0 * abs(sentiment_score) + 0.2e0 * emo, 6) AS legacy, round(0.8e0 * highlight_score + 0.2e0 * emo, 6) AS simple, round(0.7e0 * anger + 0.3e0 * emo, 6) AS angry, round(funny * (least(1.0e0, greatest(0.0e0, emo)) + 0.5e0), 6) AS amplified, round(CASE WHEN highlight_score > 0 THEN 0.5e0 * highlight_score + 0.5e0 * b ELSE b END, 6) AS blended FROM (SELECT *, (0.15e0 * 0.5e0 + 0.15e0 * emo + 0.10e0 * emo + 0.10e0 * (excitement + funny + happiness + anger + sadness) / 5) * 2 AS b FROM sg) AS z")
def f21_weighted_highlight(spark, sf_dir):
    a = _sides(spark, sf_dir)[0].withColumn("emo", F.greatest(*EMOTIONS[:5]))
    h, e, s = F.col("highlight_score"), F.col("emo"), F.col("sentiment_score")
    out = {"pre": U.weighted_highlight(h, e, s, e, "precomputed"), "legacy": U.weighted_highlight(h, e, s, e, "legacy"), "simple": U.weighted_highlight(h, e, s, e, "simple"), "angry": U.weighted_emotion(F.col("anger"), e), "amplified": U.amplify(F.col("funny"), e), "blended": U.blend_highlight(h, F.lit(0.5), e, e, U.cols(names=EMOTIONS[:5]))}
    return a.select("video_id", "seg", *[_round(v, 6).alias(k) for k, v in out.items()])


@query(f"""SELECT video_id, event_id, round((greatest(-3.0e0, least(3.0e0, (rms - CASE WHEN n < 5 THEN 0 ELSE m END) / CASE WHEN n < 5 OR v < 1e-10 THEN 1 ELSE sqrt(v) END)) + 3) / 6, 4) AS z FROM (
 SELECT *, count(*) OVER w AS n, avg(rms) OVER w AS m, var_pop(rms) OVER w AS v FROM ({A.FRAMES_SQL}) AS f WINDOW w AS (PARTITION BY video_id ORDER BY t RANGE BETWEEN 600 PRECEDING AND CURRENT ROW)) AS q""")
def w5_rolling_zscore(spark, sf_dir):
    return W.rolling_zscore(A.frames(spark, sf_dir), ["video_id"], "event_id", "t", "rms").select("video_id", "event_id", _round("z", 4).alias("z"))


_W5 = "WINDOW w AS (PARTITION BY video_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query(f"SELECT video_id, event_id, CASE WHEN n = 5 THEN round(m, 6) END AS mean, CASE WHEN n = 5 THEN round(s, 6) END AS std FROM (SELECT *, count(*) OVER w AS n, avg(rms) OVER w AS m, stddev_samp(rms) OVER w AS s FROM ({A.FRAMES_SQL}) AS f {_W5}) AS q")
def w6_centered(spark, sf_dir):
    x = W.centered(A.frames(spark, sf_dir), ["video_id"], ["t", "event_id"], hour(), {"rms": F.col("rms")})
    return x.select("video_id", "event_id", _round("mean_rms", 6).alias("mean"), _round("std_rms", 6).alias("std"))


@query(f"SELECT video_id, event_id, round(CASE WHEN n < 15 OR r <= 7 OR r > n - 7 THEN rms ELSE m END, 6) AS smooth FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) AS r, avg(rms) OVER (PARTITION BY video_id ORDER BY t, event_id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m FROM ({A.FRAMES_SQL}) AS f) AS q")
def w8_moving_average(spark, sf_dir):
    return W.smooth_moving_average(A.frames(spark, sf_dir), ["video_id"], ["t", "event_id"], hour(), "rms").select("video_id", "event_id", _round("smoothed", 6).alias("smooth"))


_NUMBERED = f"f AS (SELECT video_id, event_id, t, rms, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) AS r, count(*) OVER (PARTITION BY video_id) AS n FROM ({A.FRAMES_SQL}) AS z)"


@query(f"WITH RECURSIVE {_NUMBERED}, y AS (SELECT video_id, event_id, r, rms AS y FROM f WHERE r = 1 UNION ALL SELECT f.video_id, f.event_id, f.r, 0.125e0 * f.rms + 0.875e0 * y.y FROM y JOIN f ON f.video_id = y.video_id AND f.r = y.r + 1) SELECT video_id, event_id, round(y, 6) AS smoothed FROM y")
def w9_smooth_exponential(spark, sf_dir):
    return W.smooth_exponential(A.frames(spark, sf_dir), ["video_id"], ["t", "event_id"], "rms", hour()).select("video_id", "event_id", _round("smoothed", 6).alias("smoothed"))


_SAVGOL = ", ".join(f"({place}, {j}, {w!r}e0)" if "e" not in repr(w) else f"({place}, {j}, {w!r})" for place, row in enumerate(W.savgol_weights().tolist()) for j, w in enumerate(row))


@query(f"WITH {_NUMBERED}, s AS (SELECT *, greatest(0, least(r - 8, n - 15)) AS at FROM f), w(place, j, w) AS (VALUES {_SAVGOL}) SELECT s.video_id, s.event_id, round(sum(CAST(w.w AS DOUBLE) * g.rms), 6) AS smoothed FROM s JOIN w ON w.place = s.r - 1 - s.at JOIN f AS g ON g.video_id = s.video_id AND g.r = s.at + w.j + 1 WHERE s.n >= 15 GROUP BY 1, 2 UNION ALL SELECT video_id, event_id, round(rms, 6) FROM s WHERE n < 15")
def w10_smooth_savgol(spark, sf_dir):
    return W.smooth_savgol(A.frames(spark, sf_dir).select("video_id", "event_id", "t", "rms"), ["video_id"], ["t", "event_id"], hour(), "rms").select("video_id", "event_id", _round("smoothed", 6).alias("smoothed"))


@query()
def w12_find_peaks(spark, sf_dir):
    """All peaks of each recording, however many."""
    return P.peak_moments(A.frames(spark, sf_dir).select("video_id", "t", "rms"), ["video_id"], "t", "rms", (15, 0.35, 0.25), k=None)


def _peaks(spark, sf_dir, profile):
    x = A.frames(spark, sf_dir).withColumn("score", U.weighted_highlight(F.col("rms"), F.col("centroid"), F.col("rms"), F.col("centroid"), "legacy" if profile == "legacy" else "precomputed"))
    return P.peak_moments(x.select("video_id", "t", "score"), ["video_id"], "t", "score", profile)


@query()
def w13_peak_moments(spark, sf_dir):
    return _peaks(spark, sf_dir, "precomputed")


@query()
def w13_legacy_peaks(spark, sf_dir):
    return _peaks(spark, sf_dir, "legacy")


@query()
def w13_adaptive_peaks(spark, sf_dir):
    return _peaks(spark, sf_dir, "adaptive")


def _emotion_peaks(spark, sf_dir, profile):
    s = A.scored_chat(spark, sf_dir)
    strength = F.greatest(*EMOTIONS[:5])
    rows = s.select("video_id", "time", *[U.weighted_emotion(F.col(e), strength).alias(e) for e in EMOTIONS[:5]]).unpivot(["video_id", "time"], list(EMOTIONS[:5]), "emotion", "v")
    return P.peak_moments(rows, ["video_id", "emotion"], "time", "v", profile, 5)


@query()
def w14_emotion_peaks(spark, sf_dir):
    return _emotion_peaks(spark, sf_dir, "emotion_precomputed")


@query()
def w14_legacy_emotion_peaks(spark, sf_dir):
    return _emotion_peaks(spark, sf_dir, "emotion_legacy")


@query(f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t) AS r FROM ({A.FRAMES_SQL}) AS f), b AS (SELECT *, r - row_number() OVER (PARTITION BY video_id ORDER BY r) AS g FROM a WHERE rms > 0.1)
SELECT video_id, round(min(t), 6) AS region_start, round(max(t), 6) AS region_end, round(max(rms), 6) AS peak, count(*) AS n FROM b GROUP BY video_id, g HAVING max(t) - min(t) >= 3""")
def w15_threshold_regions(spark, sf_dir):
    return r6(W.threshold_regions(A.frames(spark, sf_dir), ["video_id"], "t", "rms", 0.1, hour()), "region_start", "region_end", "peak")


# Loudness with bursts of ten minutes, so that a few whole stretches are above the 95th percentile.
_BURSTS = f"(SELECT video_id, event_id, t, CASE WHEN CAST(floor(t / 600) AS BIGINT) % 14 = 3 THEN 0.9e0 + rms / 10 ELSE rms * 0.8e0 END AS rms FROM ({A.FRAMES_SQL}) AS z)"


@query(f"""WITH a AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS n, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) AS x, avg(rms) OVER (PARTITION BY video_id ORDER BY t, event_id ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m FROM {_BURSTS} AS f), p AS (SELECT video_id, quantile_cont(rms, 0.95) AS thr FROM a GROUP BY 1),
h AS (SELECT a.video_id, x FROM a JOIN p ON a.video_id = p.video_id WHERE round(CASE WHEN n < 15 OR x <= 7 OR x > n - 7 THEN rms ELSE m END - thr, 9) > 0), b AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY video_id ORDER BY x) <= 5 THEN 0 ELSE 1 END AS n FROM h), c AS (SELECT *, sum(n) OVER (PARTITION BY video_id ORDER BY x) AS g FROM b)
SELECT video_id, min(x) AS first, max(x) AS last, (min(x) + max(x)) // 2 AS middle FROM c GROUP BY video_id, g""")
def w16_gap_islands(spark, sf_dir):
    """Rows whose smoothed loudness is above the 95th percentile of all, in groups."""
    burst = F.floor(F.col("t") / 600) % 14 == 3
    f = A.frames(spark, sf_dir).withColumn("rms", F.when(burst, 0.9 + F.col("rms") / 10).otherwise(F.col("rms") * 0.8))
    order, keys = ["t", "event_id"], ["video_id"]
    smooth = W.running(W.smooth_moving_average(f, keys, order, hour(), "rms"), keys, order, hour(), {"x": F.lit(1).cast("long")})
    rows = smooth.join(Q.quantiles(f, keys, "rms", {"thr": 0.95}), "video_id").where(F.round(F.col("smoothed") - F.col("thr"), 9) > 0)
    return W.gap_islands(rows, keys, "x")


@query(f"""WITH a AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(word, '[.!?]') THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM ({A.WORDS_SQL}) AS w)
SELECT video_id, CAST(s // 3 AS BIGINT) AS paragraph, min(start_time) AS start_time, max(end_time) AS end_time, string_agg(word, ' ' ORDER BY i) AS text FROM a GROUP BY 1, 2""")
def w17_sentences(spark, sf_dir):
    return W.paragraphs_every_n_sentences(A.words(spark, sf_dir), ["video_id"], "i")


@query(f"""WITH RECURSIVE w AS (SELECT video_id, start_time, end_time FROM ({A.WORDS_SQL}) AS z), p AS (SELECT video_id, 0 AS paragraph, min(start_time) AS s FROM w GROUP BY 1 UNION ALL SELECT p.video_id, p.paragraph + 1, (SELECT min(w.start_time) FROM w WHERE w.video_id = p.video_id AND w.start_time - p.s >= 60) FROM p WHERE EXISTS (SELECT 1 FROM w WHERE w.video_id = p.video_id AND w.start_time - p.s >= 60)),
q AS (SELECT *, lead(s) OVER (PARTITION BY video_id ORDER BY paragraph) AS till FROM p) SELECT q.video_id, CAST(paragraph AS BIGINT) AS paragraph, min(w.start_time) AS start_time, max(w.end_time) AS end_time, count(*) AS words FROM q JOIN w ON w.video_id = q.video_id AND w.start_time >= q.s AND (till IS NULL OR w.start_time < till) GROUP BY 1, 2""")
def w18_paragraphs_by_length(spark, sf_dir):
    return K.greedy_paragraphs(A.words(spark, sf_dir).select("video_id", "start_time", "end_time", "word"), ["video_id"])


@query(f"""WITH a AS (SELECT *, CASE WHEN time - lag(time + 5) OVER (PARTITION BY video_id ORDER BY time) < 0.8e0 THEN 0 ELSE 1 END AS n FROM (SELECT DISTINCT video_id, time FROM ({A.SCORED_SQL}) AS s) AS z), b AS (SELECT *, sum(n) OVER (PARTITION BY video_id ORDER BY time) AS paragraph FROM a)
SELECT video_id, CAST(paragraph AS BIGINT) AS paragraph, round(min(time), 6) AS start_time, round(max(time + 5), 6) AS end_time, count(*) AS segments FROM b GROUP BY 1, 2""")
def w19_paragraphs_by_pause(spark, sf_dir):
    seg = A.scored_chat(spark, sf_dir).select("video_id", F.col("time").alias("start_time")).distinct().withColumn("end_time", F.col("start_time") + 5)
    return r6(W.paragraphs_by_pause(seg, ["video_id"], F.floor(F.col("start_time") / 3600)), "start_time", "end_time")


@query(f"SELECT event_id, round(time - lag(time) OVER (PARTITION BY video_id ORDER BY time, event_id), 6) AS time_diff, CASE WHEN count(*) OVER w = 60 THEN 60.0e0 END AS message_rate, count(*) OVER s AS last_minute FROM ({A.SCORED_SQL}) AS c WINDOW w AS (PARTITION BY video_id ORDER BY time, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW), s AS (PARTITION BY video_id ORDER BY time RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)")
def w20_chat_features(spark, sf_dir):
    s = A.scored_chat(spark, sf_dir).select("video_id", "event_id", "time")
    x = W.running(s, ["video_id"], ["time", "event_id"], F.floor(F.col("time") / 3600), {"row": F.lit(1)}, {"before": F.col("time")})
    # sixty rows up to a row, where there are so many
    rows = x.select("event_id", _round(F.col("time") - F.col("before"), 6).alias("time_diff"), F.when(F.col("row") >= 60, 60.0).alias("message_rate"))
    return rows.join(W.trailing(s, ["video_id"], "event_id", "time", "time", 60.0).select("event_id", F.col("n").alias("last_minute")), "event_id")


@query("SELECT conv_id, turn, lag(role) OVER w || ' -> ' || role AS transition FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def w21_status_transitions(spark, sf_dir):
    return W.transitions(A.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role").drop("role")


#: A step a row: the last update kept, and how many came since.
_KEPT = """WITH RECURSIVE u AS (SELECT user_id % 50 AS job_id, event_id, value / 500 AS progress, event_type AS stage, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS r FROM events),
k AS (SELECT job_id, r, event_id, progress AS p, stage AS s, 0 AS since, true AS kept FROM u WHERE r = 1
 UNION ALL SELECT job_id, r, event_id, CASE WHEN ok THEN progress ELSE p END, CASE WHEN ok THEN stage ELSE s END, CASE WHEN ok THEN 0 ELSE since + 1 END, ok FROM (SELECT u.job_id, u.r, u.event_id, u.progress, u.stage, k.p, k.s, k.since, abs(u.progress - k.p) >= 0.1e0 - 1e-12 OR u.stage <> k.s OR k.since + 1 >= 10 AS ok FROM k JOIN u ON u.job_id = k.job_id AND u.r = k.r + 1) AS n)
SELECT u.job_id, u.event_id, round(u.progress, 6) AS progress, u.stage FROM k JOIN u ON u.event_id = k.event_id WHERE kept"""


@query(_KEPT)
def w22_meaningful_updates(spark, sf_dir):
    u = A.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("job_id"), "event_id", (F.col("value") / 500).alias("progress"), F.col("event_type").alias("stage"))
    return r6(K.meaningful_updates(u, ["job_id"], "event_id"), "progress")


@query("SELECT event_id, stage FROM (SELECT event_id, event_type AS stage, CAST(floor(value) AS BIGINT) AS p, lag(event_type) OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS old FROM events) AS u WHERE p % 10 = 0 OR old IS DISTINCT FROM stage OR stage = 'error'")
def w22_notifications(spark, sf_dir):
    """The stateless variant: whole tens of percent, another stage, or an end (here: errors)."""
    u = A.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("job_id"), "event_id", F.floor("value").alias("percent"), F.col("event_type").alias("stage"))
    return W.notifications(u, ["job_id"], "event_id", ("error",)).select("event_id", "stage")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000) / 1000.0e0 RANGE BETWEEN 18000 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def w23_trailing_avg(spark, sf_dir):
    s = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01', ts)") / 1000.0
    x = W.trailing(A.table(spark, sf_dir, "events").withColumn("s", s), ["event_type"], "event_id", "s", "value", 18000.0)
    return x.select("event_id", _round(F.col("sum") / F.col("n"), 6).alias("mean"))


@query("SELECT event_id, round((value - lag(value) OVER (PARTITION BY event_type ORDER BY event_id)) / 5, 6) AS rate, round(sum(value) OVER (PARTITION BY event_type ORDER BY event_id), 4) AS counter FROM events")
def w24_rates_and_counters(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    x = W.running(e, ["event_type"], ["event_id"], F.floor(F.col("event_id") / 4096), {"counter": F.col("value")}, {"before": F.col("value")})
    # a counter that falls has begun anew
    return x.select("event_id", _round((F.col("value") - F.col("before")) / 5, 6).alias("rate"), _round("counter", 4).alias("counter"))


@query("SELECT o_orderkey AS job, unnest(range(0, CAST(ceil(d / 540) AS BIGINT))) AS chunk_id, d FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) % 7000 + 1 AS d FROM orders)".replace("SELECT o_orderkey AS job,", "SELECT job, chunk_id, chunk_id * 540.0e0 AS start_time, least(chunk_id * 540.0e0 + 600, d) AS end_time FROM (SELECT o_orderkey AS job,", 1) + ") AS z")
def w4_chunk_plan(spark, sf_dir):
    d = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), (F.floor("o_totalprice").cast("long") % 7000 + 1).cast("double").alias("duration"))
    return W.chunk_plan(d, ["job"], 600.0, 60.0).withColumn("chunk_id", F.col("chunk_id").cast("long"))


_FLAT = f"(SELECT event_id, video_id, CASE WHEN video_id = 3 THEN 0.25e0 ELSE rms END AS rms FROM ({A.FRAMES_SQL}) AS f)"


@query(f"SELECT video_id, round(CASE WHEN hi > lo THEN (rms - lo) / (hi - lo) ELSE 0.5e0 END, 6) AS x, event_id FROM (SELECT *, min(rms) OVER (PARTITION BY video_id) AS lo, max(rms) OVER (PARTITION BY video_id) AS hi FROM {_FLAT} AS f) AS q")
def a7_minmax(spark, sf_dir):
    """One of the recordings is made constant."""
    f = A.frames(spark, sf_dir).withColumn("rms", F.when(F.col("video_id") == 3, 0.25).otherwise(F.col("rms")))
    return W.video_minmax(f, ["video_id"], "rms", "x").select("video_id", "event_id", _round("x", 6).alias("x"))


@query(f"""WITH f AS ({A.FRAMES_SQL}), r AS (SELECT video_id, min(rms) AS a, max(rms) AS b, min(centroid) AS c, max(centroid) AS d FROM f GROUP BY 1)
SELECT f.video_id, CAST(floor(t / 60) AS BIGINT) AS seg, round(avg(rms), 6) AS raw, round(0.7e0 * avg((rms - a) / (b - a + 1e-10)) + 0.3e0 * avg((centroid - c) / (d - c + 1e-10)), 6) AS intensity FROM f JOIN r ON f.video_id = r.video_id GROUP BY 1, 2""")
def a5_segment_intensity(spark, sf_dir):
    f = A.frames(spark, sf_dir)
    r = f.groupBy("video_id").agg(F.min("rms").alias("a"), F.max("rms").alias("b"), F.min("centroid").alias("c"), F.max("centroid").alias("d"))
    x = f.join(r, "video_id").withColumns({"m": (F.col("rms") - F.col("a")) / (F.col("b") - F.col("a") + 1e-10), "n": (F.col("centroid") - F.col("c")) / (F.col("d") - F.col("c") + 1e-10)})
    return x.groupBy("video_id", F.floor(F.col("t") / 60).alias("seg")).agg(_round(F.avg("rms"), 6).alias("raw"), _round(0.7 * F.avg("m") + 0.3 * F.avg("n"), 6).alias("intensity"))


@query(f"WITH a AS (SELECT video_id, rms, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) - 1 AS x, count(*) OVER (PARTITION BY video_id) AS n FROM ({A.FRAMES_SQL}) AS f), b AS (SELECT video_id, x // greatest(1, n // 100) AS block, avg(abs(rms)) AS v FROM a WHERE x // greatest(1, n // 100) < 100 GROUP BY 1, 2) SELECT video_id, block, round(v / max(v) OVER (PARTITION BY video_id), 6) AS v FROM b")
def a8_block_mean_abs(spark, sf_dir):
    return r6(N.block_means(A.frames(spark, sf_dir), ["video_id"], ["t", "event_id"], hour(), "rms", 100), "v")


@query(f"SELECT video_id, round(quantile_cont(rms, 0.85), 6) AS q85, round(quantile_cont(rms, 0.95), 6) AS q95 FROM ({A.FRAMES_SQL}) AS f GROUP BY 1")
def a11_quantiles(spark, sf_dir):
    return r6(Q.quantiles(A.frames(spark, sf_dir), ["video_id"], "rms", {"q85": 0.85, "q95": 0.95}), "q85", "q95")


@query("""WITH p AS (SELECT event_id, event_type AS name, ts, value FROM events), q AS (SELECT * FROM p WHERE ts > (SELECT max(ts) FROM p) - INTERVAL 6000 MINUTE), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY value, event_id) - 1 AS k, count(*) OVER (PARTITION BY name) AS n FROM q)
SELECT name, n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, arg_max(value, event_id) AS current, max(CASE WHEN k = floor(n * 0.5e0) THEN value END) AS p50, max(CASE WHEN k = floor(n * 0.9e0) THEN value END) AS p90, max(CASE WHEN k = floor(n * 0.95e0) THEN value END) AS p95, max(CASE WHEN k = floor(n * 0.99e0) THEN value END) AS p99 FROM r GROUP BY name, n""")
def a12_metric_summary(spark, sf_dir):
    return r6(M.metric_summary(A.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"), "ts", "value"), 6000), "mean")


@query(f"SELECT endpoint, count(*) AS requests, round(avg(duration), 6) AS avg_time, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) AS BIGINT) AS errors, round(avg(CASE WHEN success THEN 0.0e0 ELSE 1.0e0 END), 6) AS error_rate FROM ({A.REQUESTS_SQL}) AS r GROUP BY 1")
def a13_endpoint_stats(spark, sf_dir):
    return r6(M.endpoint_stats(A.requests(spark, sf_dir)), "avg_time", "error_rate")


_COST = f"""ca AS (SELECT *, cost / hours AS cost_per_hour, hours * 60 * 0.0045e0 AS baseline, hours * 60 * 0.0045e0 - cost AS savings FROM (SELECT method, count(*) AS n, sum(duration) / 3600 AS hours, sum(CASE WHEN coalesce(actual_cost, 0) <> 0 THEN actual_cost ELSE estimated_cost END) AS cost, avg(processing) AS avg_time, avg(CASE WHEN success THEN 1.0e0 ELSE 0.0e0 END) AS success_rate FROM ({A.TRANSCRIPTIONS_SQL}) AS t GROUP BY 1) AS z)"""


@query(f"WITH {_COST} SELECT method, n, {', '.join(f'round({c}, 4) AS {c}' for c in ('hours', 'cost', 'avg_time', 'success_rate', 'cost_per_hour', 'baseline', 'savings'))} FROM ca")
def a15_cost_analysis(spark, sf_dir):
    return M.cost_analysis(A.transcriptions(spark, sf_dir)).withColumns({c: _round(c, 4) for c in ("hours", "cost", "avg_time", "success_rate", "cost_per_hour", "baseline", "savings")})


_ALL = f"x AS (SELECT sum(cost) / 1000.0e0 > 0.8e0 AS a, max(cost_per_hour) FILTER (WHERE method = 'deepgram') > 2 * max(cost_per_hour) FILTER (WHERE method = 'parakeet_gpu') AS b, sum(savings) / sum(baseline) < 0.8e0 AS c, min(success_rate) >= 0.95e0 AS d FROM ca)"


@query(f"WITH {_COST}, {_ALL} SELECT method, 'low_success' AS advice FROM ca WHERE success_rate < 0.95 UNION ALL SELECT 'all', 'high_budget_use' FROM x WHERE a UNION ALL SELECT 'all', 'use_gpu_more' FROM x WHERE b UNION ALL SELECT 'all', 'raise_savings' FROM x WHERE c UNION ALL SELECT 'all', 'all_well' FROM x WHERE d AND NOT a AND NOT coalesce(b, false) AND NOT c")
def a16_cost_recommendations(spark, sf_dir):
    return M.cost_recommendations(M.cost_analysis(A.transcriptions(spark, sf_dir)))


_HYBRID = "CASE WHEN d <= 9000 THEN d / 3600 * (0.45e0 / 40) + 0.02e0 ELSE 2.5e0 * (0.45e0 / 40) + 0.02e0 + (d / 3600 - 2.5e0) * 0.27e0 END"


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, duration AS d FROM ({A.TRANSCRIPTIONS_SQL}) AS t), c AS (SELECT *, d / 3600 * 0.27e0 AS c1, d / 3600 * (0.45e0 / 40) + 0.02e0 AS c2, {_HYBRID} AS c3 FROM t), s AS (SELECT *, c1 + 0.01e0 + (1 - 0.99e0) * c1 AS s1, c2 + d / 40 * 0.001e0 + (1 - 0.2e0) * c2 AS s2, c3 + least(d / 40, 225) * 0.001e0 + 0.1e0 * c3 AS s3 FROM c)
SELECT l_orderkey, l_linenumber, CASE WHEN s1 <= s2 AND s1 <= s3 THEN 'deepgram' WHEN s3 < s2 THEN 'hybrid' ELSE 'parakeet_gpu' END AS method, round(least(s1, s2, s3), 6) AS score FROM s""")
def a17_choose_method(spark, sf_dir):
    t = A.transcriptions(spark, sf_dir).select("l_orderkey", "l_linenumber", "duration")
    return M.choose_method(t, {"deepgram": 0.99, "parakeet_gpu": 0.2}).select("l_orderkey", "l_linenumber", "method", _round("score", 6).alias("score"))


@query(f"SELECT queue_key AS webhook_id, count(*) AS total, CAST(sum(CASE WHEN status = 'Completed' THEN 1 ELSE 0 END) AS BIGINT) AS delivered, CAST(sum(CASE WHEN status = 'Failed' THEN 1 ELSE 0 END) AS BIGINT) AS failed, CAST(sum(CASE WHEN status = 'Queued' THEN 1 ELSE 0 END) AS BIGINT) AS pending, round(avg(CASE WHEN status = 'Completed' THEN 100.0e0 ELSE 0.0e0 END), 6) AS success_percent FROM ({A.JOBS_SQL}) AS j GROUP BY 1")
def a18_delivery_stats(spark, sf_dir):
    n = lambda s: F.sum((F.col("status") == s).cast("long"))
    return A.jobs(spark, sf_dir).groupBy(F.col("queue_key").alias("webhook_id")).agg(F.count("*").alias("total"), n("Completed").alias("delivered"), n("Failed").alias("failed"), n("Queued").alias("pending"), _round(F.avg(F.when(F.col("status") == "Completed", 100.0).otherwise(0.0)), 6).alias("success_percent"))


@query("SELECT event_type AS kind, count(*) AS accesses, CAST(sum(CASE WHEN value >= 100 THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN value < 100 THEN 1 ELSE 0 END) AS BIGINT) AS misses, round(avg(CASE WHEN value >= 100 THEN 100.0e0 ELSE 0.0e0 END), 6) AS hit_percent, count(DISTINCT user_id) AS entries, count(DISTINCT user_id) - count(DISTINCT CASE WHEN ts > now - INTERVAL 1 DAY THEN user_id END) AS expired FROM (SELECT *, max(ts) OVER () AS now FROM events) AS e GROUP BY 1")
def a19_cache_stats(spark, sf_dir):
    """Users stand for cached keys; a key that wasn't used in the last day is expired."""
    log = A.table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("user_id").alias("key"), "ts", (F.col("value") >= 100).alias("hit"))
    return M.cache_stats(log, 24).withColumn("hit_percent", _round("hit_percent", 6))


def _verdict(rules, field: int, other) -> str:
    text = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(message), '{r[0]}') THEN {text(r[field])}" for r in rules) + f" ELSE {text(other)} END"


def _verdicts(rules) -> str:
    return f"SELECT code, error_type, retry_after > 0 AS retryable, CAST(retry_after AS BIGINT) AS retry_after, count(*) AS n, max(event_id) AS last FROM (SELECT event_id, {_verdict(rules, 1, 'UNCLASSIFIED_ERROR')} AS code, {_verdict(rules, 2, 'unknown_error')} AS error_type, {_verdict(rules, 3, 120)} AS retry_after FROM ({A.ERRORS_SQL}) AS e) AS x GROUP BY 1, 2, 3, 4"


def _classified(spark, sf_dir, rules):
    x = A.error_messages(spark, sf_dir).withColumn("v", M.classify(F.col("message"), rules))
    return x.groupBy("v.code", "v.error_type", "v.retryable", F.col("v.retry_after").cast("long").alias("retry_after")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


_CODE = _verdict(M.ERROR_RULES, 1, "UNCLASSIFIED_ERROR")


@query(_verdicts(M.ERROR_RULES))
def f28_classify_error(spark, sf_dir):
    return _classified(spark, sf_dir, M.ERROR_RULES)


@query(_verdicts(M.TRANSCRIPTION_RULES + M.ERROR_RULES))
def f28_transcription_errors(spark, sf_dir):
    return _classified(spark, sf_dir, M.TRANSCRIPTION_RULES + M.ERROR_RULES)


_POLICY = "CASE user_id % 4 WHEN 0 THEN least(pow(2.0e0, user_id % 8), 60.0e0) WHEN 1 THEN least((user_id % 8 + 1) * 1.0e0, 60.0e0) WHEN 2 THEN 1.0e0 ELSE 0.0e0 END"


@query(f"SELECT operation, count(*) AS attempts, round(sum(delay), 6) AS delay, string_agg(code, ',' ORDER BY ts, event_id) AS codes, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM (SELECT user_id AS operation, event_id, ts, {_POLICY} AS delay, event_type AS code FROM events) AS x GROUP BY 1")
def a20_retry_stats(spark, sf_dir):
    k, n = F.col("user_id") % 4, F.col("user_id") % 8 + 1
    delay = F.when(k == 0, M.backoff_delay(n, "exponential")).when(k == 1, M.backoff_delay(n, "linear")).when(k == 2, M.backoff_delay(n, "fixed")).otherwise(M.backoff_delay(n, "immediate"))
    log = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("operation"), "event_id", "ts", delay.alias("delay"), F.col("event_type").alias("code"))
    micros = lambda c: F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', {c})")
    return M.retry_stats(log).select("operation", "attempts", _round("delay", 6).alias("delay"), "codes", micros("first").alias("first"), micros("last").alias("last"))


@query(f"SELECT event_id % 3 AS method, code, count(*) AS n, max(event_id) AS last FROM (SELECT event_id, {_CODE} AS code FROM ({A.ERRORS_SQL}) AS e) AS x GROUP BY 1, 2")
def a21_failure_counts(spark, sf_dir):
    return A.error_messages(spark, sf_dir).groupBy((F.col("event_id") % 3).alias("method"), M.classify(F.col("message"))["code"].alias("code")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


_TESTS = f"(SELECT CAST(endpoint AS VARCHAR) AS category, CASE WHEN success THEN 'PASS' WHEN event_id % 2 = 0 THEN 'FAIL' ELSE 'ERROR' END AS status FROM ({A.REQUESTS_SQL}) AS r)"


@query(f"""WITH s AS (SELECT category, count(*) AS total, sum(CASE WHEN status = 'PASS' THEN 1 ELSE 0 END) AS passed, sum(CASE WHEN status <> 'PASS' AND category IN ('0', '3') THEN 1 ELSE 0 END) AS bad FROM {_TESTS} AS t GROUP BY ROLLUP (category))
SELECT coalesce(category, 'all') AS category, total, CAST(passed AS BIGINT) AS passed, round(passed / total, 6) AS rate, CASE WHEN category IS NOT NULL THEN CASE WHEN passed = total THEN 'PASS' ELSE 'FAIL' END WHEN bad = 0 AND passed >= 0.9 * total THEN 'PRODUCTION_READY' WHEN bad = 0 AND passed >= 0.8 * total THEN 'READY_WITH_WARNINGS' WHEN bad <= 2 AND passed >= 0.7 * total THEN 'NEEDS_ATTENTION' ELSE 'NOT_READY' END AS status FROM s""")
def a22_test_report(spark, sf_dir):
    """Requests as tests of their endpoints, of which 0 and 3 are critical."""
    r = A.requests(spark, sf_dir)
    status = F.when(F.col("success"), "PASS").when(F.col("event_id") % 2 == 0, "FAIL").otherwise("ERROR")
    return r6(M.results_report(r.select(F.col("endpoint").cast("string").alias("category"), status.alias("status")), ("0", "3")), "rate")


@query(f"SELECT endpoint, count(*) AS total, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS ok, round(avg(CASE WHEN success THEN 1.0e0 ELSE 0.0e0 END), 6) AS availability, round(avg(duration) * 1000, 3) AS mean_ms, min(duration) * 1000 AS fastest_ms, max(duration) * 1000 AS slowest_ms, avg(CASE WHEN success THEN 1.0e0 ELSE 0.0e0 END) >= 0.75e0 AND avg(duration) < 5 AS healthy FROM ({A.REQUESTS_SQL}) AS r GROUP BY 1")
def a23_availability(spark, sf_dir):
    return M.availability(A.requests(spark, sf_dir), 0.75, 5000.0).withColumn("mean_ms", _round("mean_ms", 3))


_QUEUE = f"(SELECT queue_key, CASE WHEN status = 'Queued' AND job_id % 7 = 0 THEN 'Running' ELSE status END AS status, job_id % 3 AS retries, cost / 1000 AS seconds FROM ({A.JOBS_SQL}) AS j)"


@query(f"""SELECT queue_key, jobs, waiting, active, processed, failed, retried, round(avg_seconds, 6) AS avg_seconds, round(processed * 100.0e0 / greatest(processed + failed, 1), 6) AS success_percent, round(active / 4.0e0 * 100, 6) AS worker_percent, round(waiting / 100.0e0 * 100, 6) AS queue_percent, CASE WHEN failed > processed * 0.1 THEN 'warning' WHEN active = 0 AND waiting > 0 THEN 'critical' WHEN waiting >= 90 THEN 'warning' ELSE 'healthy' END AS status,
 array_to_string(list_filter([CASE WHEN waiting >= 90 THEN 'nearly_full' END, CASE WHEN active = 0 AND waiting > 0 THEN 'no_workers' END, CASE WHEN failed > processed * 0.1 THEN 'many_failures' END], lambda x: x IS NOT NULL), ',') AS issues
 FROM (SELECT queue_key, count(*) AS jobs, count(*) FILTER (WHERE status = 'Queued') AS waiting, count(*) FILTER (WHERE status = 'Running') AS active, count(*) FILTER (WHERE status = 'Completed') AS processed, count(*) FILTER (WHERE status = 'Failed') AS failed, CAST(sum(retries) AS BIGINT) AS retried, avg(CASE WHEN status = 'Completed' THEN seconds END) AS avg_seconds FROM {_QUEUE} AS q GROUP BY 1) AS a""")
def a24_queue_health(spark, sf_dir):
    j = A.jobs(spark, sf_dir)
    running = F.when((F.col("status") == "Queued") & (F.col("job_id") % 7 == 0), "Running").otherwise(F.col("status"))
    rows = j.select("queue_key", running.alias("status"), (F.col("job_id") % 3).alias("retries"), (F.col("cost") / 1000).alias("seconds"))
    return r6(M.queue_health(rows), "avg_seconds", "success_percent", "worker_percent", "queue_percent")


@query(f"SELECT method, round(avg(processing), 6) AS mean_batch, count(*) AS n, round(avg(CASE WHEN success THEN 100.0e0 ELSE 0.0e0 END), 6) AS ok_percent, max(duration) AS peak, round(avg(duration) / max(duration) * 100, 6) AS mean_of_peak_percent FROM ({A.TRANSCRIPTIONS_SQL}) AS t GROUP BY 1")
def a25_batch_perf_summary(spark, sf_dir):
    """The minutes of a record stand for the size of a batch, its duration for the memory in use."""
    t = A.transcriptions(spark, sf_dir).select("method", F.col("processing").alias("size"), F.col("success").alias("flag"), F.col("duration").alias("used"))
    return r6(M.batch_summary(t, ["method"]), "mean_batch", "ok_percent", "mean_of_peak_percent")


@query("SELECT name, value, level FROM (SELECT event_type AS name, arg_max(value, event_id) AS value, CASE WHEN arg_max(value, event_id) >= 60 THEN 'critical' WHEN arg_max(value, event_id) >= 10 THEN 'warning' END AS level FROM events GROUP BY 1) AS z WHERE level IS NOT NULL")
def l1_threshold_alerts(spark, sf_dir):
    last = J.latest(A.table(spark, sf_dir, "events").withColumnRenamed("event_type", "name"), ["name"], "value", "ts", "event_id")
    return M.threshold_alerts(last, dict.fromkeys(("click", "view", "purchase", "signup", "error"), (10.0, 60.0)))


_METRIC_POINTS = "(SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'cpu_percent' WHEN 1 THEN 'memory_percent' WHEN 2 THEN 'disk_percent' WHEN 3 THEN 'error_rate' WHEN 4 THEN 'response_time_p95' WHEN 5 THEN 'queue_length' ELSE 'failed_jobs_rate' END AS name, user_id % 40 AS host, value * CASE event_id % 7 WHEN 3 THEN 0.0005e0 WHEN 4 THEN 0.05e0 WHEN 5 THEN 0.4e0 WHEN 6 THEN 0.001e0 ELSE 0.4e0 END AS value FROM {events})"


@query(f"""SELECT host, name, round(value, 6) AS value, level FROM (SELECT host, name, value, CASE name {' '.join(f"WHEN '{k}' THEN CASE WHEN value >= {c}e0 THEN 'critical' WHEN value >= {w}e0 THEN 'warning' END" for k, (w, c) in (("cpu_percent", (80, 95)), ("memory_percent", (85, 95)), ("disk_percent", (85, 95)), ("error_rate", (0.05, 0.1)), ("response_time_p95", (5, 10)), ("queue_length", (50, 100)), ("failed_jobs_rate", (0.1, 0.2))))} END AS level FROM (SELECT host, name, arg_max(value, event_id) AS value FROM {_METRIC_POINTS.format(events="events")} AS m GROUP BY 1, 2) AS l) AS z WHERE level IS NOT NULL""")
def l1_default_metrics(spark, sf_dir):
    """The seven metrics of forty hosts by the default thresholds."""
    points = spark.sql("SELECT * FROM " + _METRIC_POINTS.replace("e0", "D"), events=A.table(spark, sf_dir, "events"))
    return r6(M.threshold_alerts(J.latest(points, ["host", "name"], "value", "event_id")), "value")


# Durations times three and fewer errors, so that requests fall on both sides of the thresholds.
_STRESSED = f"(SELECT event_id, ts, endpoint, duration * 3 AS duration, success OR event_id % 3 <> 0 AS success FROM ({A.REQUESTS_SQL}) AS r)"


def _stressed(spark, sf_dir):
    return A.requests(spark, sf_dir).withColumns({"duration": F.col("duration") * 3, "success": F.col("success") | (F.col("event_id") % 3 != 0)})


@query(f"SELECT endpoint, round(r, 6) AS error_rate, CASE WHEN r >= 0.1e0 THEN 'critical' ELSE 'warning' END AS level FROM (SELECT endpoint, avg(CASE WHEN success THEN 0.0e0 ELSE 1.0e0 END) AS r FROM {_STRESSED} AS q GROUP BY 1) AS z WHERE r >= 0.05e0")
def l2_error_rate_alerts(spark, sf_dir):
    return r6(M.error_rate_alerts(M.endpoint_stats(_stressed(spark, sf_dir))), "error_rate")


@query(f"WITH l AS (SELECT * FROM {_STRESSED} AS r QUALIFY row_number() OVER (PARTITION BY endpoint ORDER BY ts DESC, event_id DESC) <= 1000), t AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY duration, ts, event_id) - 1 AS k, count(*) OVER (PARTITION BY endpoint) AS n FROM l), p AS (SELECT endpoint, n, max(CASE WHEN k = floor(n * 0.95e0) THEN duration END) AS p95 FROM t GROUP BY 1, 2) SELECT endpoint, n, p95, CASE WHEN n >= 20 AND p95 >= 10 THEN 'critical' WHEN n >= 20 AND p95 >= 5 THEN 'warning' ELSE 'ok' END AS level FROM p")
def l3_latency_alert(spark, sf_dir):
    return M.latency_alert(_stressed(spark, sf_dir), ["endpoint"], "ts", "event_id")


@query(f"WITH t AS (SELECT duration, row_number() OVER (ORDER BY duration) - 1 AS k, count(*) OVER () AS n FROM ({A.REQUESTS_SQL}) AS r) SELECT max(CASE WHEN k = floor(n * 0.5e0) THEN duration END) AS p50, max(CASE WHEN k = floor(n * 0.95e0) THEN duration END) AS p95, max(CASE WHEN k = floor(n * 0.99e0) THEN duration END) AS p99 FROM t")
def a13_global_percentiles(spark, sf_dir):
    return M.overall_percentiles(A.requests(spark, sf_dir), "duration", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(f"""WITH z AS (SELECT count(*) AS n, sum(duration) / 3600 AS hours, sum(CASE WHEN coalesce(actual_cost, 0) <> 0 THEN actual_cost ELSE estimated_cost END) AS cost FROM ({A.TRANSCRIPTIONS_SQL}) AS t WHERE ts >= (SELECT max(ts) FROM ({A.TRANSCRIPTIONS_SQL}) AS u) - INTERVAL 90 DAY)
SELECT n, round(hours, 4) AS hours, round(cost, 4) AS cost, round(hours * 0.27e0, 4) AS baseline, round(cost / hours, 4) AS cost_per_hour, round(hours * 0.27e0 - cost, 4) AS savings, round((hours * 0.27e0 - cost) / (hours * 0.27e0) * 100, 4) AS savings_percent, round(cost / 3, 4) AS projection, round(cost / 3 / 1000, 4) AS budget_share FROM z WHERE n > 0""")
def a15_cost_totals(spark, sf_dir):
    found = M.cost_totals(A.transcriptions(spark, sf_dir), 90)
    return found.withColumns({c: _round(c, 4) for c in found.columns if c != "n"})


@query("""SELECT event_id, round(greatest(0.0e0, 100 - CASE WHEN c > 80 THEN (c - 80) * 0.5e0 ELSE 0 END - CASE WHEN c > 85 THEN (c - 85) * 0.5e0 ELSE 0 END), 1) AS score FROM (SELECT *, CAST(user_id % 101 AS DOUBLE) AS c FROM events) AS e""".replace(", 1)", ", 6)"))
def f33_simple_score(spark, sf_dir):
    c = (F.col("user_id") % 101).cast("double")
    return A.table(spark, sf_dir, "events").select("event_id", _round(M.simple_performance_score(c, c), 6).alias("score"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def l5_retain(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("event_type", "ts")
    now = e.agg(F.max("ts").alias("now"))
    return e.crossJoin(F.broadcast(now)).where("ts > now - INTERVAL 7 DAYS").groupBy("event_type").agg(F.count("*").alias("n"))  # now is one row


@query(f"SELECT job_id, queue_key, CAST(row_number() OVER (PARTITION BY queue_key ORDER BY priority DESC, queued_at DESC, job_id) - 1 AS BIGINT) AS position FROM ({A.JOBS_SQL}) AS j")
def t4_priority_order(spark, sf_dir):
    return M.priority_order(A.jobs(spark, sf_dir)).select("job_id", "queue_key", F.col("position").cast("long").alias("position"))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50")
def t5_recent(spark, sf_dir):
    return A.table(spark, sf_dir, "events").where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type")


@query(f"SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 4 = 0 THEN {_HYBRID.replace('d /', 'duration /').replace('d <=', 'duration <=')} WHEN method = 'deepgram' THEN duration / 3600 * 0.27e0 WHEN method = 'parakeet_gpu' THEN duration / 3600 * (0.45e0 / 40) + 0.02e0 ELSE duration / 3600 * 0.05e0 + 0.01e0 END, 6) AS cost, CASE WHEN duration / 3600 < 2 THEN 'parakeet' WHEN duration / 3600 < 4 THEN 'hybrid' ELSE 'deepgram' END AS by_duration, round(CASE WHEN l_linenumber % 4 = 0 THEN least(duration / 40, 225) WHEN method = 'deepgram' THEN 10 WHEN method = 'parakeet_gpu' THEN duration / 40 ELSE duration / 2 END, 6) AS seconds FROM ({A.TRANSCRIPTIONS_SQL}) AS t")
def f30_transcription_cost(spark, sf_dir):
    d, m = F.col("duration"), F.when(F.col("l_linenumber") % 4 == 0, "hybrid").otherwise(F.col("method"))
    return A.transcriptions(spark, sf_dir).select("l_orderkey", "l_linenumber", _round(M.transcription_cost(d, m), 6).alias("cost"), M.method_by_duration(d / 3600).alias("by_duration"), _round(M.processing_time(d, m), 6).alias("seconds"))


@query("""SELECT event_id, round(s, 6) AS score, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 60 THEN 'D' ELSE 'F' END AS grade FROM (SELECT event_id, greatest(0.0e0, 100 - CASE WHEN c > 80 THEN least(20.0e0, (c - 80) * 2) ELSE 0 END - CASE WHEN c > 85 THEN least(20.0e0, (c - 85) * 2) ELSE 0 END - CASE WHEN value / 100 > 2 THEN least(30.0e0, (value / 100 - 2) * 10) ELSE 0 END) AS s FROM (SELECT *, CAST(user_id % 100 AS DOUBLE) AS c FROM events) AS e) AS z""")
def f33_performance_score(spark, sf_dir):
    c = (F.col("user_id") % 100).cast("double")
    s = M.performance_score(c, c, F.col("value") / 100)
    return A.table(spark, sf_dir, "events").select("event_id", _round(s, 6).alias("score"), M.grade(s).alias("grade"))


@query("""SELECT event_id, round(CASE event_type WHEN 'view' THEN 20 + p * 0.3e0 WHEN 'click' THEN 50 + p * 0.3e0 ELSE 0 END, 6) AS progress, CASE WHEN event_type = 'error' THEN 0 WHEN p <= 0 THEN 3600 ELSE CAST(floor(greatest(0.0e0, least(value / (p / 100) - value, 7200.0e0))) AS BIGINT) END AS eta FROM (SELECT *, CAST(user_id % 101 AS DOUBLE) AS p FROM events) AS e""")
def f26_stage_progress(spark, sf_dir):
    p = (F.col("user_id") % 101).cast("double")
    stage = F.when(F.col("event_type") == "view", "transcribing").when(F.col("event_type") == "click", "analyzing").otherwise("failed")
    status = F.when(F.col("event_type") == "error", "Failed").otherwise("Running")
    return A.table(spark, sf_dir, "events").select("event_id", _round(M.stage_progress(stage, p), 6).alias("progress"), M.eta_seconds(F.col("value"), p, status).alias("eta"))


@query(f"SELECT video_id, ord, CASE WHEN length(text) > 50 THEN substr(text, 1, 47) || '...' ELSE text END AS short, CASE WHEN len(m) < 2 THEN '0' ELSE '' END || m || ':' || CASE WHEN len(s) < 2 THEN '0' ELSE '' END || s AS stamp FROM (SELECT *, CAST(CAST(floor(start_time / 60) AS BIGINT) AS VARCHAR) AS m, CAST(CAST(floor(start_time % 60) AS BIGINT) AS VARCHAR) AS s FROM ({A.PARAGRAPHS_SQL}) AS p) AS q")
def f24_labels(spark, sf_dir):
    return A.paragraphs(spark, sf_dir).select("video_id", "ord", U.truncate_text(F.col("text")).alias("short"), U.format_mmss(F.col("start_time")).alias("stamp"))


@query(f"SELECT event_id, round(excitement, 3) AS excitement, round(greatest(-1.0e0, least(1.0e0, excitement + happiness + funny - anger - sadness)), 3) + 0.0e0 AS sentiment FROM ({A.SCORED_SQL}) AS s")
def f11_cluster_scores(spark, sf_dir):
    got = U.cluster_scores({e: F.col(e) for e in EMOTIONS[:5]})
    return A.scored_chat(spark, sf_dir).select("event_id", got["excitement"].alias("excitement"), got["sentiment"].alias("sentiment"))


@query(f"""WITH f AS (SELECT video_id, t, max(centroid) AS c FROM ({A.FRAMES_SQL}) AS y GROUP BY 1, 2), w AS (SELECT event_id, video_id, t + 0.25e0 AS t FROM ({A.FRAMES_SQL}) AS z)
SELECT w.event_id, round(CASE WHEN a.t IS NULL THEN b.c WHEN b.t IS NULL OR b.t = a.t THEN a.c ELSE a.c + (b.c - a.c) * (w.t - a.t) / (b.t - a.t) END, 6) AS v FROM w ASOF LEFT JOIN f AS a ON w.video_id = a.video_id AND w.t >= a.t ASOF LEFT JOIN f AS b ON w.video_id = b.video_id AND w.t <= b.t""")
def j5_interp_join(spark, sf_dir):
    f = A.frames(spark, sf_dir)
    want = f.select("event_id", "video_id", (F.col("t") + 0.25).alias("t"))
    got = J.interp_join(want.select("video_id", "t").distinct(), f.groupBy("video_id", "t").agg(F.max("centroid").alias("c")), ["video_id"], "c")
    return want.join(got, ["video_id", "t"]).select("event_id", _round("c", 6).alias("v"))


@query(f"""WITH f AS (SELECT video_id, t, max(rms) AS rms FROM ({A.FRAMES_SQL}) AS y GROUP BY 1, 2), w AS (SELECT event_id, video_id, t + 0.5e0 AS t FROM ({A.FRAMES_SQL}) AS z)
SELECT w.event_id, round(CASE WHEN a.t IS NULL THEN b.rms WHEN b.t IS NULL OR b.t = a.t THEN a.rms ELSE a.rms + (b.rms - a.rms) * (w.t - a.t) / (b.t - a.t) END, 6) AS v FROM w ASOF LEFT JOIN f AS a ON w.video_id = a.video_id AND w.t >= a.t ASOF LEFT JOIN f AS b ON w.video_id = b.video_id AND w.t <= b.t""")
def j5_all_frames(spark, sf_dir):
    f = A.frames(spark, sf_dir)
    want = f.select("event_id", "video_id", (F.col("t") + 0.5).alias("t"))
    got = J.interp_join(want.select("video_id", "t").distinct(), f.groupBy("video_id", "t").agg(F.max("rms").alias("rms")), ["video_id"], "rms")
    return want.join(got, ["video_id", "t"]).select("event_id", _round("rms", 6).alias("v"))


@query(f"SELECT event_id, video_id * 1000 + event_id % 7 AS part_id, round(t + event_id % 7 * 100.0e0, 6) AS start_time FROM ({A.FRAMES_SQL}) AS f")
def j10_offset_merge(spark, sf_dir):
    f = A.frames(spark, sf_dir).withColumn("part", F.col("event_id") % 7).withColumn("part_id", F.col("video_id") * 1000 + F.col("part"))
    parts = f.select("event_id", "part_id", F.col("t").alias("start_time"), F.col("t").alias("end_time"))
    return r6(J.offset_merge(parts, f.groupBy("part_id").agg((F.max("part") * 100.0).alias("offset"))).select("event_id", "part_id", "start_time"), "start_time")


_PARTS = f"(SELECT video_id, k, k * 50.0e0 AS beg, least(k * 50.0e0 + 60, last) AS till FROM (SELECT video_id, last, unnest(range(0, greatest(1, CAST(ceil(last / 50) AS BIGINT)))) AS k FROM (SELECT video_id, max(end_time) AS last FROM ({A.WORDS_SQL}) AS w GROUP BY 1) AS x) AS y)"


@query(f"""WITH p AS (SELECT *, (beg + till) / 2 AS c FROM {_PARTS} AS q), o AS (SELECT *, (c + lag(c) OVER w) / 2 AS a, (c + lead(c) OVER w) / 2 AS b FROM p WINDOW w AS (PARTITION BY video_id ORDER BY c, k))
SELECT o.video_id, w.i, o.k AS part, w.word, round(w.start_time, 6) AS start_time FROM o JOIN ({A.WORDS_SQL}) AS w ON w.video_id = o.video_id AND w.start_time < o.till AND w.end_time > o.beg WHERE (a IS NULL OR (w.start_time + w.end_time) / 2 >= a) AND (b IS NULL OR (w.start_time + w.end_time) / 2 < b)""")
def j10_overlapping_parts(spark, sf_dir):
    """The words of each document as heard in parts of 60 seconds that begin every 50, each word kept once."""
    w = A.words(spark, sf_dir)
    last = w.groupBy("video_id").agg(F.max("end_time").alias("duration"))
    plan = W.chunk_plan(last, ["video_id"], 60.0, 10.0).select("video_id", F.col("chunk_id").cast("long").alias("part"), F.col("start_time").alias("r_start"), F.col("end_time").alias("r_end"))
    plan = plan.withColumn("part_id", F.struct("video_id", "part"))
    heard = W.on_grid(w, 60, 50, "part").select(F.struct("video_id", "part").alias("part_id"), "i", "word", *[(F.col(c) - F.col("part") * 50.0).alias(c) for c in ("start_time", "end_time")])
    offsets = plan.select("part_id", "video_id", F.col("r_start").alias("offset"), (F.col("r_end") - F.col("r_start")).alias("duration"))
    return r6(J.offset_merge(heard, offsets, ["video_id"], dedup_overlap=True).select("part_id.video_id", "i", "part_id.part", "word", "start_time"), "start_time")
