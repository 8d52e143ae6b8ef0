"""Registered queries on scorers, stateful streams, paragraphs by rules and files, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from momentlens.functions.chat import score_cache_key
from momentlens.operators import scorers as R
from momentlens.operators import chains as K
from momentlens.operators import intervals as J
from momentlens.plans.queries import _AUDIO, _AVGS, _LEXICON_ROWS, _STRESSED, _TUMBLE, SQL, _r, _round, _sides, _stressed, chat_windows, query, r6
from momentlens.sources import adapters as A
from momentlens.functions import chat as C
from momentlens.sources import files as S
from momentlens.sources.shared import new_folder
from momentlens.streaming import latency, live
from momentlens.streaming import stateful as V


@query()
def u1_classifier(spark, sf_dir):
    """Every document by a classifier of the four pairs of quality and toxic, trained on the labelled documents."""
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = A.table(spark, sf_dir, "labels").select("doc_id", (2 * F.col("quality") + F.col("toxic")).alias("label"))
    p = R.classify(R.fit_classifier(docs.join(labels, "doc_id")), docs)
    of = lambda *ks: sum((F.coalesce(F.get("probabilities", F.lit(k)), F.lit(0.0)) for k in ks), F.lit(0.0))
    return p.select("doc_id", _round(of(2, 3), 4).alias("quality"), _round(of(1, 3), 4).alias("toxic"))


def _labelled(spark, sf_dir, label):
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return docs.join(A.table(spark, sf_dir, "labels"), "doc_id").select("text", F.expr(label).alias("label"))


#: Six and four classes from what is labelled here: quality, toxic, and whether a text is long.
EMOTION_LABEL = "3 * quality + toxic + CAST(n_chars > 1500 AS INT)"
HIGHLIGHT_LABEL = "2 * quality + toxic"


@query()
def u1_emotion_scores(spark, sf_dir):
    """Every document by a classifier of six classes, and the sentiment that follows from them."""
    model = R.fit_classifier(_labelled(spark, sf_dir, EMOTION_LABEL))
    p = R.classify(model, A.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return p.select("doc_id", *[v.alias(k) for k, v in R.emotion_scores(F.col("probabilities")).items()])


@query()
def u1_highlight_scores(spark, sf_dir):
    """Every document by a classifier of its own for the highlight score, 0 to 3."""
    model = R.fit_classifier(_labelled(spark, sf_dir, HIGHLIGHT_LABEL))
    p = R.classify(model, A.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return p.select("doc_id", _round(R.highlight_score(F.col("probabilities")), 4).alias("highlight"))


@query(f"SELECT video_id, ord, 'Score the segment. Answer one line for each key, as key: value. sentiment is from -1 to 1, all others from 0 to 1.' || chr(10) || 'Keys: sentiment, excitement, funny, happiness, anger, sadness, neutral, highlight' || chr(10) || 'Words a second: 2.50; loudness: ' || CASE WHEN ord % 4 = 0 THEN 'unknown' ELSE '0.' || (ord % 4) || '0' END || '; loudness against the last minutes: 0.50' || chr(10) || 'Text: ' || text AS prompt FROM ({A.PARAGRAPHS_SQL}) AS p")
def u2_prompts(spark, sf_dir):
    loud = F.when(F.col("ord") % 4 != 0, F.col("ord") % 4 / 10.0)
    return A.paragraphs(spark, sf_dir).select("video_id", "ord", R.prompt_of(F.col("text"), F.lit(2.5), loud, F.lit(0.5)).alias("prompt"))


_MEANT = "CASE meaning " + " ".join(f"WHEN '{m}' THEN '{k}'" for m, k in R.MEANINGS.items()) + " END"
_SPOKEN = sorted(set(R.MEANINGS.values()))


@query(f"""WITH t AS (SELECT doc_id, line_no, list_filter(regexp_split_to_array(lower(message), '\\s+'), lambda x: x <> '') AS w FROM ({A.EMOTED_SQL}) AS c), u AS (SELECT doc_id, line_no, unnest(w) AS token FROM t),
k AS (SELECT doc_id, line_no, {', '.join(f"count(*) FILTER (WHERE kind = '{x}') AS {x}" for x in _SPOKEN)} FROM u JOIN (SELECT DISTINCT token, {_MEANT} AS kind FROM (VALUES {_LEXICON_ROWS}) AS l(token, meaning)) AS l ON u.token = l.token WHERE kind IS NOT NULL GROUP BY 1, 2)
SELECT t.doc_id, t.line_no, {', '.join(f'round(coalesce(k.{x}, 0) * 1.0e0 / greatest(len(w), 1), 6) AS {x}' for x in _SPOKEN)}, round(1 - ({' + '.join(f'coalesce(k.{x}, 0)' for x in _SPOKEN)}) * 1.0e0 / greatest(len(w), 1), 6) AS neutral FROM t LEFT JOIN k ON t.doc_id = k.doc_id AND t.line_no = k.line_no""")
def u3_lexicon_scores(spark, sf_dir):
    lexicon = S.load_lexicon(spark, kind="emote").unionByName(S.load_lexicon(spark, kind="emoji")).unionByName(S.load_lexicon(spark, kind="slang"))
    scores = R.lexicon_scores(A.emoted_chat(spark, sf_dir), lexicon, ["doc_id", "line_no"])
    return r6(scores, *_SPOKEN, "neutral")


def _down(texts: list[str]) -> list[str | None]:
    raise ConnectionError("no answer")


def _first_model(texts: list[str]) -> list[str | None]:
    """Stands for an outside model that leaves some texts unanswered."""
    return [f"excitement: {min(1, x.count('e') / 40):.8f}\nhighlight: {min(1, len(x) / 400):.8f}" if len(x) % 3 else None for x in texts]


def _second_model(texts: list[str]) -> list[str | None]:
    return [f"sadness : {min(1, x.count('a') / 40):.8f}\nhighlight: high" if len(x) % 2 else None for x in texts]


_T = f"(SELECT video_id, ord, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM ({A.PARAGRAPHS_SQL}) AS p)"
_COUNT = "least(1.0e0, (length(t) - length(replace(t, '{}', ''))) / 40.0e0)"


@query(f"""SELECT video_id, ord, model, round(CASE model WHEN 'first' THEN {_COUNT.format('e')} WHEN 'default' THEN 0.2e0 ELSE 0.0e0 END, 6) AS excitement, round(CASE model WHEN 'second' THEN {_COUNT.format('a')} WHEN 'default' THEN 0.1e0 ELSE 0.0e0 END, 6) AS sadness,
 round(CASE model WHEN 'short' THEN 1.0e0 WHEN 'default' THEN 0.7e0 ELSE 0.0e0 END, 6) AS neutral, round(CASE model WHEN 'first' THEN least(1.0e0, length(t) / 400.0e0) WHEN 'default' THEN 0.2e0 ELSE 0.0e0 END, 6) AS highlight
 FROM (SELECT *, CASE WHEN NOT contains(t, ' ') THEN 'short' WHEN length(t) % 3 <> 0 THEN 'first' WHEN length(t) % 2 <> 0 THEN 'second' ELSE 'default' END AS model FROM {_T} AS q) AS z""")
def u2_model_chain(spark, sf_dir):
    asks = (("down", _down), ("first", _first_model), ("second", _second_model))
    scored = R.score_texts(A.paragraphs(spark, sf_dir).select("video_id", "ord", "text"), asks)
    return r6(scored.select("video_id", "ord", "model", "excitement", "sadness", "neutral", "highlight"), "excitement", "sadness", "neutral", "highlight")


@query(f"""SELECT video_id, ord, model, round(CASE model WHEN 'first' THEN {_COUNT.format('e')} WHEN 'default' THEN 0.2e0 ELSE 0.0e0 END, 6) AS excitement, round(CASE model WHEN 'second' THEN {_COUNT.format('a')} WHEN 'default' THEN 0.1e0 ELSE 0.0e0 END, 6) AS sadness,
 round(CASE model WHEN 'short' THEN 1.0e0 WHEN 'default' THEN 0.7e0 ELSE 0.0e0 END, 6) AS neutral, round(CASE model WHEN 'first' THEN least(1.0e0, length(t) / 400.0e0) WHEN 'default' THEN 0.2e0 ELSE 0.0e0 END, 6) AS highlight
 FROM (SELECT *, CASE WHEN NOT contains(t, ' ') THEN 'short' WHEN length(t) % 3 <> 0 THEN 'first' WHEN length(t) % 2 <> 0 THEN 'second' ELSE 'default' END AS model FROM (SELECT video_id, ord, min(t) OVER (PARTITION BY substr(lower(t), 1, 100)) AS t FROM {_T} AS q) AS k) AS z""")
def j8_score_joined_back(spark, sf_dir):
    asks = (("down", _down), ("first", _first_model), ("second", _second_model))
    scored = R.score_distinct(A.paragraphs(spark, sf_dir).select("video_id", "ord", "text"), score_cache_key("m", F.col("text")), asks)
    return r6(scored.select("video_id", "ord", "model", "excitement", "sadness", "neutral", "highlight"), "excitement", "sadness", "neutral", "highlight")


_LEXICON = {"excitement": ("the", "und"), "sadness": ("of", "and", "de")}
_WORDS = "list_filter(regexp_split_to_array(lower(t), '\\s+'), lambda x: x <> '')"


@query(f"SELECT video_id, ord, {', '.join(f'''round(len(list_filter(w, lambda x: x IN {known})) / len(w), 6) AS {name}''' for name, known in _LEXICON.items())} FROM (SELECT video_id, ord, {_WORDS} AS w FROM {_T} AS q) AS z")
def u3_rule_scorer(spark, sf_dir):
    scores = R.rule_scores(F.col("text"), _LEXICON)
    return A.paragraphs(spark, sf_dir).select("video_id", "ord", *[_round(v, 6).alias(k) for k, v in scores.items()])


#: A step a segment: the paragraph's first start, its segments so far, the end of the last one and whether that asked.
_RULED = f"""WITH RECURSIVE u AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_time, end_time, text) AS r, regexp_matches(lower(text), '^({"|".join(f"{c}[ ,]" for c in K.CUES).replace("'", "''")})') AS cue, regexp_matches(lower(text), '^({"|".join(K.OPENERS)})') AS opener, text LIKE '%?' AS asked FROM (SELECT video_id, start_time, end_time, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM ({A.PARAGRAPHS_SQL}) AS p) AS t WHERE text <> ''),
k AS (SELECT video_id, r, start_time AS b, end_time AS e, asked AS q, 1 AS n, 0 AS paragraph FROM u WHERE r = 1
 UNION ALL SELECT video_id, r, CASE WHEN new THEN s ELSE b END, e2, a2, CASE WHEN new THEN 1 ELSE n + 1 END, CASE WHEN new THEN paragraph + 1 ELSE paragraph END FROM (SELECT u.video_id, u.r, u.start_time AS s, u.end_time AS e2, u.asked AS a2, k.b, k.n, k.paragraph, u.start_time - k.e >= 0.8e0 OR u.end_time - k.b >= 20 OR k.n >= 6 OR u.cue OR (k.q AND u.opener) AS new FROM k JOIN u ON u.video_id = k.video_id AND u.r = k.r + 1) AS z)
SELECT k.video_id, CAST(paragraph AS BIGINT) AS paragraph, min(u.start_time) AS start_time, arg_max(u.end_time, u.r) AS end_time, count(*) AS segments, string_agg(u.text, ' ' ORDER BY u.r) AS text FROM k JOIN u ON u.video_id = k.video_id AND u.r = k.r GROUP BY 1, 2"""


@query(_RULED)
def w19_paragraphs_by_rules(spark, sf_dir):
    return K.paragraphs_by_rules(A.paragraphs(spark, sf_dir).select("video_id", "start_time", "end_time", "text"), ["video_id"])


@query()
def r3_live_zscores(spark, sf_dir):
    """The rolling z-scores as a stream, run to its end; its SQL is that of the same windows over the whole table."""
    frames = A.frames_of(V.events_stream(spark, sf_dir))
    # the stream's time of a frame: 100 seconds of the events are one of the recording
    frames = frames.withColumn("ts", F.timestamp_millis((F.lit(1704067200000) + F.round(F.col("t") * 100000)).cast("long")))
    got = V.drained(V.live_zscores(frames, "video_id", "t", "rms", "event_id"), "zscores")
    return got.select("video_id", "event_id", _round("z", 4).alias("z"))


SQL["r3_live_zscores"] = SQL["w5_rolling_zscore"]


def _updates(events):
    return events.select((F.col("user_id") % 50).alias("job_id"), "event_id", (F.col("value") / 500).alias("progress"), F.col("event_type").alias("stage"), "ts")


@query()
def r6_live_updates(spark, sf_dir):
    """The updates worth telling as a stream, run to its end."""
    return r6(V.drained(V.live_updates(_updates(V.events_stream(spark, sf_dir)), "job_id", "event_id"), "updates"), "progress")


SQL["r6_live_updates"] = SQL["w22_meaningful_updates"]


@query("SELECT m.event_id, count(*) AS n FROM events AS m JOIN (SELECT user_id % 10 AS video_id, ts FROM events WHERE event_type = 'view') AS s ON m.user_id % 10 = s.video_id AND m.ts >= s.ts AND m.ts <= s.ts + INTERVAL 315 SECOND GROUP BY 1")
def r4_reactions(spark, sf_dir):
    """Messages within five minutes and the lag of what was viewed; the same join takes two streams."""
    return live.reactions(*_reacting(spark, sf_dir, 300)).groupBy("event_id").agg(F.count("*").alias("n"))


def _reacting(spark, sf_dir, seconds):
    e = A.table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 10).alias("video_id"), F.col("ts").cast("timestamp").alias("ts"))
    seen = e.where("event_type = 'view'").select("video_id", F.col("ts").alias("start_ts"), (F.col("ts") + F.expr(f"INTERVAL {seconds} SECONDS")).alias("end_ts"))
    return e.drop("event_type"), seen.distinct()


@query("SELECT s.video_id, epoch_us(s.ts) AS start_us, count(m.event_id) AS n FROM (SELECT DISTINCT user_id % 10 AS video_id, ts FROM events WHERE event_type = 'view') AS s LEFT JOIN events AS m ON m.user_id % 10 = s.video_id AND m.ts >= s.ts AND m.ts <= s.ts + INTERVAL 1515 SECOND AND m.event_type = 'purchase' GROUP BY 1, 2")
def r4_all_segments(spark, sf_dir):
    """Purchases within 25 minutes and the lag of each view, of views without one too; a segment comes in three slices."""
    messages, seen = _reacting(spark, sf_dir, 1500)
    bought = messages.join(A.table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id"), "event_id", "left_semi").select("video_id", "event_id", "ts")
    return live.reactions(bought, seen, how="left").groupBy("video_id", F.unix_micros("start_ts").alias("start_us")).agg(F.count("event_id").alias("n"))


@query(f"WITH {_AUDIO} SELECT au.video_id, au.seg, count(*) AS frames, round(avg(f.rms), 6) AS rms FROM au JOIN ({A.FRAMES_SQL}) AS f ON f.video_id = au.video_id AND f.t >= au.seg * 60.0e0 AND f.t < au.seg * 60.0e0 + 60 GROUP BY 1, 2")
def j3_frames_in_segments(spark, sf_dir):
    segments = _sides(spark, sf_dir)[0].select("video_id", F.col("seg").alias("window_id"), "start_time", "end_time")
    near = J.point_in_interval_join(A.frames(spark, sf_dir), segments, ["video_id"], "t", 0.0, closed=False)
    return near.groupBy("video_id", F.col("window_id").alias("seg")).agg(F.count("*").alias("frames"), _round(F.avg("rms"), 6).alias("rms"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS video_id, CAST(line_no * 2 AS DOUBLE) AS time, username, message FROM ({A.CHAT_SQL}) AS c WHERE username IS NOT NULL AND message IS NOT NULL")
def s1_chat_json(spark, sf_dir):
    """The lines of each document as comments of one JSON text, read back from it."""
    docs = A.table(spark, sf_dir, "documents")
    comment = lambda x, i: F.struct((i * 2).cast("double").alias("content_offset_seconds"), F.struct(F.col("source").alias("display_name")).alias("commenter"), F.struct(x.alias("body")).alias("message"))
    text = F.to_json(F.struct(F.transform(F.split("text", "\n"), comment).alias("comments"), F.struct(F.col("doc_id").cast("string").alias("id")).alias("video")))
    return S.explode_comments(docs.select(F.from_json(text, S.CHAT_SCHEMA).alias("x")).select("x.*"))


@query(f"SELECT video_id, ord, start_time, end_time, text FROM ({A.PARAGRAPHS_SQL}) AS p")
def s4_transcript_json(spark, sf_dir):
    """The paragraphs of each document as one transcript JSON, read back from it in the order of their times."""
    p = A.paragraphs(spark, sf_dir)
    part = F.struct(F.col("start_time").alias("start"), F.col("end_time").alias("end"), F.when(F.col("ord") % 2 == 0, F.col("text")).alias("transcript"), F.col("text").alias("text"))
    whole = p.groupBy("video_id").agg(F.collect_list(part).alias("paragraphs"))
    best = F.struct(F.struct(F.lit("").alias("transcript"), F.col("paragraphs")).alias("paragraphs"))
    text = F.to_json(F.struct(F.struct(F.array(F.struct(F.array(best).alias("alternatives"))).alias("channels")).alias("results")))
    found = S.parse_transcript(whole.select("video_id", F.from_json(text, S.TRANSCRIPT_SCHEMA).alias("x")).select("video_id", "x.results"), ["video_id"])[1]
    return found.join(p.select("video_id", "ord", "start_time"), ["video_id", "start_time"]).select("video_id", "ord", "start_time", "end_time", "text")


@query(f"WITH {_TUMBLE} SELECT CAST(video_id AS VARCHAR) AS video_id, message_count, {_r('start_time', 'end_time', *_AVGS)} FROM cw")
def s6_segment_files(spark, sf_dir):
    """Chat windows written as CSV by video and read back as an interval table."""
    path = f"{new_folder(spark, 'segments')}/csv"
    S.write_segments(chat_windows(spark, sf_dir), path, "csv")
    names = {"start_time": "double", "end_time": "double", "message_count": "long"} | dict.fromkeys(_AVGS, "double")
    return r6(S.read_interval_csv(spark, path, names, r"video_id=(\d+)/"), "start_time", "end_time", *_AVGS)


@query(f"SELECT video_id, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, CASE WHEN i % 3 = 0 THEN word || ',' ELSE word END AS word FROM ({A.WORDS_SQL}) AS w")
def s4_transcript_words(spark, sf_dir):
    """The words of each document as one transcript JSON, read back from it; every third has a punctuated form."""
    part = lambda w, i: F.struct(w.alias("word"), (i * 2 / 5.0).alias("start"), ((i + 1) * 2 / 5.0).alias("end"), F.when(i % 3 == 0, F.concat(w, F.lit(","))).alias("punctuated_word"))
    best = A.word_lists(spark, sf_dir).select("video_id", F.struct(F.lit("").alias("transcript"), F.transform("words", part).alias("words")).alias("best"))
    text = F.to_json(F.struct(F.struct(F.array(F.struct(F.array("best").alias("alternatives"))).alias("channels")).alias("results")))
    found = S.parse_transcript(best.select("video_id", F.from_json(text, S.TRANSCRIPT_SCHEMA).alias("x")).select("video_id", "x.results"), ["video_id"])[0]
    return r6(found, "start_time", "end_time")


@query(SQL["s6_segment_files"])
def s6_segment_json(spark, sf_dir):
    """Chat windows written as JSON records by video and read back."""
    path = f"{new_folder(spark, 'segments')}/json"
    windows = chat_windows(spark, sf_dir)
    S.write_segments(windows, path, "json")
    back = spark.read.schema(windows.select(F.col("video_id").cast("string"), *[c for c in windows.columns if c != "video_id"]).schema).json(path)
    return r6(back.select(*windows.columns), "start_time", "end_time", *_AVGS)


@query("SELECT endpoint, CAST(us // 3600000000 * 3600 AS BIGINT) AS start_second, count(*) AS n, min(duration) AS least, max(duration) AS most, round(avg(duration), 6) AS mean, count(*) FILTER (WHERE NOT success) AS errors, CASE WHEN avg(CASE WHEN success THEN 0.0e0 ELSE 1.0e0 END) >= 0.1e0 THEN 'critical' WHEN avg(CASE WHEN success THEN 0.0e0 ELSE 1.0e0 END) >= 0.05e0 THEN 'warning' ELSE 'ok' END AS level FROM (SELECT user_id % 20 AS endpoint, epoch_us(ts) AS us, value / 100.0e0 AS duration, event_type <> 'error' AS success FROM events) AS x GROUP BY 1, 2")
def r5_live_requests(spark, sf_dir):
    """Statistics and error level of each endpoint by the hour; the same operator takes a stream."""
    r = A.requests(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    return r6(live.second(live.live_requests(r, "1 hour")), "mean")


_FLOORS = "max(CASE WHEN k = floor(n * 0.5e0) THEN v END) AS p50, max(CASE WHEN k = floor(n * 0.9e0) THEN v END) AS p90, max(CASE WHEN k = floor(n * 0.95e0) THEN v END) AS p95, max(CASE WHEN k = floor(n * 0.99e0) THEN v END) AS p99"


def _summary_sql(key: str, rows: str, seconds: int) -> str:
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {key}, s ORDER BY v, event_id) - 1 AS k, count(*) OVER (PARTITION BY {key}, s) AS n FROM (SELECT event_id, {key}, v, CAST(epoch_us(ts) // {seconds * 1_000_000} * {seconds} AS BIGINT) AS s FROM {rows} AS r) AS q"
    sums = f"SELECT {key}, s AS start_second, n, min(v) AS least, max(v) AS most, avg(v) AS mean, {_FLOORS} FROM ({ranked}) AS z GROUP BY {key}, s, n"
    return f"SELECT {key}, start_second, n, {', '.join(f'round({c}, 6) AS {c}' for c in ('least', 'most', 'mean', 'p50', 'p90', 'p95', 'p99'))}, CASE WHEN n >= 20 AND round(p95, 9) >= 10 THEN 'critical' WHEN n >= 20 AND round(p95, 9) >= 5 THEN 'warning' ELSE 'ok' END AS level FROM ({sums}) AS y"


def _live_summary(stream, name, key, value, seconds):
    path = new_folder(stream.sparkSession, name)
    latency.live_latency(stream, path, key, value, seconds, available_now=True).awaitTermination()
    return r6(latency.latency_levels(stream.sparkSession, path), "least", "most", "mean", *latency.PERCENTILES)


@query(_summary_sql("endpoint", f"(SELECT event_id, ts, endpoint, duration AS v FROM {_STRESSED} AS x)", 6 * 3600))
def r5_live_latency(spark, sf_dir):
    """Percentiles and latency level of each endpoint's requests in windows of six hours, as a stream, run to its end."""
    requests = V.events_stream(spark, sf_dir).select("event_id", "ts", (F.col("user_id") % 20).alias("endpoint"), (F.col("value") / 100 * 3).alias("duration"))
    return _live_summary(requests, "latency", "endpoint", "duration", 6 * 3600)


@query(_summary_sql("name", "(SELECT event_id, ts, event_type AS name, value AS v FROM events)", 12 * 3600))
def r5_live_metrics(spark, sf_dir):
    """The summary of each metric in windows of twelve hours, as a stream, run to its end."""
    points = V.events_stream(spark, sf_dir).select("event_id", "ts", F.col("event_type").alias("name"), "value")
    return _live_summary(points, "metrics", "name", "value", 12 * 3600)


@query("WITH b AS (SELECT event_type, epoch_us(ts) // 60000000 AS minute FROM events), m AS (SELECT event_type, max(minute) AS last FROM b GROUP BY 1) SELECT b.event_type, CAST(any_value(last) * 60 AS DOUBLE) AS as_of, count(*) AS n FROM b JOIN m ON b.event_type = m.event_type AND b.minute > last - 10080 GROUP BY 1")
def l5_live_retained(spark, sf_dir):
    """How many events of each type are retained for a week, as a stream with a state that forgets, run to its end."""
    counts = V.drained(V.live_retained(V.events_stream(spark, sf_dir).select("event_type", "ts"), "event_type", 7 * 86400.0), "retained")
    last = counts.groupBy("event_type").agg(F.max_by(F.struct("as_of", "n"), F.struct("as_of", "n")).alias("x"))
    return last.select("event_type", "x.*")


@query("SELECT coalesce(category, 'total') AS category, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT CASE user_id % 5 WHEN 0 THEN 'Transcript Files' WHEN 1 THEN 'Chat Files' WHEN 2 THEN 'Waveform Files' WHEN 3 THEN 'Transcript Files' END AS category, octet_length(encode(s)) AS bytes FROM (SELECT user_id, string_agg(event_type, chr(10) ORDER BY event_id) || chr(10) AS s FROM events GROUP BY 1) AS x) AS z WHERE category IS NOT NULL GROUP BY ROLLUP (category)")
def s7_file_sizes(spark, sf_dir):
    """The events of each user written as a file whose name tells its kind; sizes are read from the files' metadata."""
    e = A.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    kind = F.element_at(F.array(*map(F.lit, ("1_words.csv", "1_Chat.json", "waveform.json", "1_Segments.csv", "notes.txt"))), (F.col("user_id") % 5 + 1).cast("int"))
    path = f"{new_folder(spark, 'artifacts')}/files"
    named = e.withColumn("file", F.concat(F.col("user_id").cast("string"), F.lit("-"), kind))
    # a number of partitions, as without one they are put together by bytes: few rows, but a file each user
    dealt = named.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file")
    dealt.sortWithinPartitions("file", "event_id").select("event_type", "file").write.partitionBy("file").option("compression", "none").text(path)
    found = S.file_sizes(spark, path, {k: rf"file={v}" for k, v in {"words": "[0-9]+-1_words", "json": "[0-9]+-1_Chat", "waveform": "[0-9]+-waveform", "segments": "[0-9]+-1_Segments"}.items()}, "*.txt", of=-2)
    return C.artifact_sizes(found.select("kind", "bytes")).select("category", "files", "bytes")
