"""Registered queries on segments, scores, failures, alerts and batch runs of the live operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentlens.functions import chat as C
from momentlens.functions import fusion as U
from momentlens.functions import scores as S
from momentlens.operators import intervals as J
from momentlens.operators import telemetry as M
from momentlens.operators import windows as W
from momentlens.plans.queries import hour, _AUDIO, _AVGS, _METRICS, _NEG, _POS, _TUMBLE, _dom, _round, _sides, chat_windows, query, r6
from momentlens.sources import adapters as A
from momentlens.sources.adapters import EMOTIONS
from momentlens.streaming import live as V

_PAIRS = f"({A.SCORED_SQL}) AS a JOIN (SELECT event_id AS b_id, time AS b_time, highlight_score AS c_highlight_score, {', '.join(f'{e} AS c_{e}' for e in EMOTIONS)} FROM ({A.SCORED_SQL}) AS z) AS b ON b.b_id = a.event_id + 1"


def _pairs(spark, sf_dir) -> DataFrame:
    """Each scored message with the next one."""
    s = A.scored_chat(spark, sf_dir)
    nxt = s.select((F.col("event_id") - 1).alias("event_id"), F.col("time").alias("b_time"), F.col("highlight_score").alias("c_highlight_score"), *[F.col(e).alias(f"c_{e}") for e in EMOTIONS])
    return s.join(nxt, "event_id")


@query(f"SELECT event_id, b_time >= time AND b_time <= time + 30 + 15 AS inside FROM {_PAIRS}")
def p4_reaction_window(spark, sf_dir):
    return _pairs(spark, sf_dir).select("event_id", S.in_reaction_window(F.col("b_time"), F.col("time"), F.col("time") + 30).alias("inside"))


@query(f"SELECT event_id, round(time, 6) AS start_time, round(time + 5, 6) AS end_time, round(sentiment_score, 6) AS sentiment_score, 0.0e0 AS highlight_score, {', '.join(f'''{1.0 if e == 'neutral' else 0.0}e0 AS {e}''' for e in EMOTIONS)}, '' AS text FROM ({A.SCORED_SQL}) AS s")
def p5_fill_missing_scores(spark, sf_dir):
    s = A.scored_chat(spark, sf_dir).select("event_id", F.col("time").alias("start_time"), (F.col("time") + 5).alias("end_time"), "sentiment_score")
    return r6(S.fill_missing_scores(s), "start_time", "end_time", "sentiment_score")


@query(f"SELECT key, count(*) AS n FROM (SELECT 'm|' || format('{{:.1f}}', least(ord, 60) * 1.0e0) || '|' || substr(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 100) AS key FROM ({A.PARAGRAPHS_SQL}) AS p) AS k GROUP BY key")
def f10_score_cache_key(spark, sf_dir):
    key = C.score_cache_key("m", F.col("text"), F.least(F.col("ord"), F.lit(60)).cast("double"))
    return A.paragraphs(spark, sf_dir).groupBy(key.alias("key")).agg(F.count("*").alias("n"))


@query(f"SELECT event_id, {_dom('')} AS dominant FROM ({A.SCORED_SQL}) AS s")
def f14_dominant(spark, sf_dir):
    return A.scored_chat(spark, sf_dir).select("event_id", U.dominant(U.cols()).alias("dominant"))


_REL = f"CASE WHEN da = dc THEN 'synchronized' WHEN da IN {_POS} AND dc IN {_POS} THEN 'positive_aligned' WHEN da IN {_NEG} AND dc IN {_NEG} THEN 'negative_aligned' WHEN da IN {_POS} AND dc IN {_NEG} THEN 'audience_negative' WHEN da IN {_NEG} AND dc IN {_POS} THEN 'audience_positive' ELSE 'mixed' END"
_ALIGN = f"({' + '.join(f'(1 - abs({e} - c_{e}))' for e in EMOTIONS)}) / 6"


@query(f"SELECT event_id, round({_ALIGN}, 6) AS alignment FROM {_PAIRS}")
def f15_alignment(spark, sf_dir):
    return _pairs(spark, sf_dir).select("event_id", _round(U.alignment(U.cols(), U.cols("c_")), 6).alias("alignment"))


@query(f"SELECT da, dc, relationship, CASE relationship WHEN 'synchronized' THEN 5 WHEN 'positive_aligned' THEN 4 WHEN 'audience_positive' THEN 3 WHEN 'audience_negative' THEN 1 WHEN 'negative_aligned' THEN 0 ELSE 2 END AS code, count(*) AS n FROM (SELECT *, {_REL} AS relationship FROM (SELECT {_dom('')} AS da, {_dom('c_')} AS dc FROM {_PAIRS}) AS y) AS z GROUP BY 1, 2, 3, 4")
def f16_relationship(spark, sf_dir):
    x = _pairs(spark, sf_dir).select(U.dominant(U.cols()).alias("da"), U.dominant(U.cols("c_")).alias("dc"))
    x = x.withColumn("relationship", U.relationship(F.col("da"), F.col("dc")))
    return x.groupBy("da", "dc", "relationship", U.relationship_code(F.col("relationship")).alias("code")).agg(F.count("*").alias("n"))


@query(f"SELECT event_id, round(least(1.0e0, 0.6e0 * highlight_score + 0.4e0 * c_highlight_score + CASE {_REL} WHEN 'synchronized' THEN 0.15e0 WHEN 'positive_aligned' THEN 0.1e0 WHEN 'audience_positive' THEN 0.08e0 WHEN 'audience_negative' THEN 0.05e0 ELSE 0 END + 0.1e0 * al), 6) AS enhanced FROM (SELECT event_id, highlight_score, c_highlight_score, {_dom('')} AS da, {_dom('c_')} AS dc, {_ALIGN} AS al FROM {_PAIRS}) AS z")
def f18_enhanced_score(spark, sf_dir):
    a, c = U.cols(), U.cols("c_")
    score = U.enhanced_score(F.col("highlight_score"), F.col("c_highlight_score"), U.alignment(a, c), U.relationship(U.dominant(a), U.dominant(c)))
    return _pairs(spark, sf_dir).select("event_id", _round(score, 6).alias("enhanced"))


_FAIL = "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains(lower(message), '{p}')''' for p in parts)} THEN '{name}'" for name, parts in S.FAILURES) + " ELSE 'unknown_error' END"


@query(f"""SELECT method, failure, next, count(*) AS n FROM (SELECT *, CASE WHEN failure = 'gpu_memory_error' AND method = 'parakeet_gpu' THEN 'deepgram' WHEN failure = 'model_loading_error' THEN 'deepgram' WHEN failure = 'network_error' AND method = 'deepgram' THEN 'error'
 WHEN method = 'parakeet_gpu' THEN 'parakeet_cpu' WHEN method = 'parakeet_cpu' THEN 'deepgram' WHEN method = 'deepgram' THEN 'error' ELSE 'parakeet_gpu' END AS next FROM (SELECT {_FAIL} AS failure, CASE event_id % 4 WHEN 0 THEN 'parakeet_gpu' WHEN 1 THEN 'parakeet_cpu' WHEN 2 THEN 'deepgram' ELSE 'other' END AS method FROM ({A.ERRORS_SQL}) AS e) AS y) AS z GROUP BY 1, 2, 3""")
def f29_fallbacks(spark, sf_dir):
    k = F.col("event_id") % 4
    method = F.when(k == 0, "parakeet_gpu").when(k == 1, "parakeet_cpu").when(k == 2, "deepgram").otherwise("other")
    x = A.error_messages(spark, sf_dir).select(method.alias("method"), S.classify_failure(F.col("message")).alias("failure"))
    return x.groupBy("method", "failure", S.next_fallback(F.col("method"), F.col("failure")).alias("next")).agg(F.count("*").alias("n"))


@query(f"SELECT video_id, ord, w AS word, i, round(start_time + i * 30.0e0 / n, 6) AS start_time, round(start_time + (i + 1) * 30.0e0 / n, 6) AS end_time FROM (SELECT video_id, ord, start_time, len(ws) AS n, unnest(ws) AS w, unnest(range(0, len(ws))) AS i FROM (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM ({A.PARAGRAPHS_SQL}) AS p) AS q) AS z")
def f35_even_word_times(spark, sf_dir):
    p = A.paragraphs(spark, sf_dir).select("video_id", "ord", "start_time", "text").withColumn("duration", F.lit(30.0))
    return r6(S.even_word_times(p, ["video_id", "ord"]), "start_time", "end_time").withColumn("i", F.col("i").cast("long"))


_SEGS = f"{_AUDIO}, p AS (SELECT * FROM ({A.SCORED_SQL}) AS s WHERE event_id % 2 = 1)"


@query(f"""WITH {_SEGS} SELECT au.video_id, au.seg, au.seg * 60.0e0 + 30 AS time_mid, count(p.event_id) AS message_count, {', '.join(f'round(coalesce(avg(p.{m}), 0), 6) AS avg_{m}' for m in _METRICS)}, round(coalesce(stddev_samp(p.sentiment_score), 0), 6) AS std_sentiment
 FROM au LEFT JOIN p ON p.video_id = au.video_id AND p.time >= au.seg * 60.0e0 AND p.time <= au.seg * 60.0e0 + 60 + 15 GROUP BY 1, 2""")
def a2_segment_chat_stats(spark, sf_dir):
    audio = _sides(spark, sf_dir)[0].select("video_id", F.col("seg").alias("window_id"), "start_time", "end_time")
    near = J.point_in_interval_join(A.scored_chat(spark, sf_dir).where("event_id % 2 = 1"), audio, ["video_id"])
    stats = near.groupBy("video_id", "window_id").agg(F.count("*").alias("n"), *[F.avg(m).alias(f"avg_{m}") for m in _METRICS], F.stddev_samp("sentiment_score").alias("std_sentiment"))
    out = audio.join(stats, ["video_id", "window_id"], "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in (*[f"avg_{m}" for m in _METRICS], "std_sentiment")}
    out = out.withColumns({**zero, "message_count": F.coalesce("n", F.lit(0)), "time_mid": (F.col("start_time") + F.col("end_time")) / 2, "seg": F.col("window_id")})
    return r6(out.select("video_id", "seg", "time_mid", "message_count", *zero), *zero)


_TOP5 = f"greatest({', '.join(EMOTIONS[:5])})"


@query(f"""WITH {_AUDIO}, x AS (SELECT video_id, max(seg * 60.0e0 + 60) - min(seg * 60.0e0) AS span, avg({_TOP5}) AS ai FROM au GROUP BY 1), y AS (SELECT video_id, count(*) AS n FROM ({A.SCORED_SQL}) AS s WHERE event_id % 2 = 1 GROUP BY 1),
f AS (SELECT x.video_id, greatest(0.0e0, least(1.0e0, (coalesce(n, 0) / (span / 60) - 10) / 100)) AS act, CASE WHEN ai > 0 THEN greatest(0.0e0, least(1.0e0, (ai / 0.5e0 - 0.5e0) / 2)) ELSE 0.5e0 END AS emo FROM x LEFT JOIN y ON x.video_id = y.video_id),
w AS (SELECT video_id, least(0.8e0, greatest(0.4e0, 0.6e0 + act * 0.2e0 - emo * 0.2e0)) AS a, least(0.6e0, greatest(0.2e0, 0.4e0 - act * 0.2e0 + emo * 0.2e0)) AS c FROM f) SELECT video_id, round(a / (a + c), 6) AS audio_weight, round(c / (a + c), 6) AS chat_weight FROM w""")
def a6_stream_weights(spark, sf_dir):
    chat = A.scored_chat(spark, sf_dir).where("event_id % 2 = 1").groupBy("video_id").agg(F.count("*").alias("messages"))
    return r6(S.stream_weights(_sides(spark, sf_dir)[0], chat, ["video_id"]), "audio_weight", "chat_weight")


@query(f"""WITH {_AUDIO}, {_TUMBLE}, x AS (SELECT video_id, max(seg * 60.0e0 + 60) - min(seg * 60.0e0) AS span, avg({_TOP5}) AS ai FROM au GROUP BY 1), y AS (SELECT video_id, sum(message_count) AS n, avg(greatest({', '.join(f'avg_{e}' for e in EMOTIONS[:5])})) AS ci FROM cw GROUP BY 1),
f AS (SELECT x.video_id, greatest(0.0e0, least(1.0e0, (coalesce(n, 0) / (span / 60) - 10) / 100)) AS act, CASE WHEN ai > 0 AND coalesce(ci, 0.5e0) > 0 THEN greatest(0.0e0, least(1.0e0, (ai / coalesce(ci, 0.5e0) - 0.5e0) / 2)) ELSE 0.5e0 END AS emo FROM x LEFT JOIN y ON x.video_id = y.video_id),
w AS (SELECT video_id, least(0.8e0, greatest(0.4e0, 0.6e0 - act * 0.2e0 + emo * 0.2e0)) AS a, least(0.6e0, greatest(0.2e0, 0.4e0 + act * 0.2e0 - emo * 0.2e0)) AS c FROM f) SELECT video_id, round(a / (a + c), 6) AS audio_weight, round(c / (a + c), 6) AS chat_weight FROM w""")
def a6_stream_weights_as_meant(spark, sf_dir):
    """With the chat's own emotions, and both shifts the way that is meant."""
    strength = F.avg(F.greatest(*[f"avg_{e}" for e in EMOTIONS[:5]]))
    chat = chat_windows(spark, sf_dir).groupBy("video_id").agg(F.sum("message_count").alias("messages"), strength.alias("chat_strength"))
    return r6(S.stream_weights(_sides(spark, sf_dir)[0], chat, ["video_id"], compat=False), "audio_weight", "chat_weight")


@query(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) - 1 AS x, count(*) OVER (PARTITION BY video_id) AS n, max(abs(rms)) OVER (PARTITION BY video_id) AS top FROM ({A.FRAMES_SQL}) AS f)
SELECT video_id, k AS i, round(rms / top, 6) AS v FROM f JOIN (SELECT unnest(range(0, 100)) AS k) AS g ON x = k * (n - 1) // 99""")
def a9_downsample(spark, sf_dir):
    return r6(S.downsample(A.frames(spark, sf_dir), ["video_id"], ["t", "event_id"], hour(), "rms", 100), "v")


@query("SELECT event_id, event_type AS name, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events")
def a14_counter_running_total(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"), "ts", "value")
    day = F.expr("timestampdiff(DAY, timestamp_ntz'1970-01-01', ts)")
    return W.running(e, ["name"], ["ts", "event_id"], day, {"total": F.col("value")}).select("event_id", "name", _round("total", 4).alias("total"))


_ALERTS = f"SELECT endpoint, CASE WHEN r >= 0.22e0 THEN 'critical' WHEN r >= 0.18e0 THEN 'warning' END AS level FROM (SELECT endpoint, avg(CASE WHEN success THEN 0.0e0 ELSE 1.0e0 END) AS r FROM ({A.REQUESTS_SQL}) AS q GROUP BY 1) AS z"


def _alerts(spark, sf_dir):
    """Every endpoint with its error level, by limits on both sides of which endpoints lie here."""
    s = M.endpoint_stats(A.requests(spark, sf_dir))
    found = M.error_rate_alerts(s, warn=0.18, critical=0.22).select("endpoint", "level")
    return s.select("endpoint").join(found, "endpoint", "left")


@query(f"SELECT level, count(*) AS n, count(*) FILTER (WHERE endpoint % 3 <> 0) AS active FROM ({_ALERTS}) AS a WHERE level IS NOT NULL GROUP BY 1")
def a26_alert_counts(spark, sf_dir):
    """Alerts of every third endpoint are resolved."""
    return S.alert_counts(_alerts(spark, sf_dir).where("level IS NOT NULL").withColumn("resolved", F.col("endpoint") % 3 == 0))


@query(f"""SELECT service, CASE WHEN count(endpoint) = 0 THEN 'unknown' WHEN count(level) FILTER (WHERE level = 'critical') > 0 THEN 'critical' WHEN count(level) > 0 THEN 'warning' ELSE 'healthy' END AS status, coalesce(string_agg(CAST(endpoint AS VARCHAR) || ':' || level, ',' ORDER BY endpoint) FILTER (WHERE level IS NOT NULL), '') AS issues
 FROM (SELECT DISTINCT user_id % 7 AS service FROM events) AS s LEFT JOIN (SELECT *, endpoint % 5 AS of FROM ({_ALERTS}) AS a) AS a ON a.of = service GROUP BY 1""")
def l4_health_status(spark, sf_dir):
    """Seven services, of which two have no endpoints."""
    services = A.table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("service")).distinct()
    checks = _alerts(spark, sf_dir).withColumn("service", F.col("endpoint") % 5)
    return S.health_status(services.join(checks, "service", "left"), ["service"], "endpoint")


@query(f"WITH {_TUMBLE}, m AS (SELECT video_id, start_time, {', '.join(f'avg_{x} * message_count AS w_{x}' for x in ('sentiment_score', 'highlight_score', *EMOTIONS[:5]))} FROM cw), s AS (SELECT *, count(*) OVER w AS n, {', '.join(f'avg(w_{x}) OVER w AS m_{x}' for x in ('sentiment_score', 'highlight_score', *EMOTIONS[:5]))} FROM m WINDOW w AS (PARTITION BY video_id ORDER BY start_time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT video_id, round(start_time, 6) AS start_time, {', '.join(f'CASE WHEN n = 5 THEN round(m_{x}, 6) END AS mean_{x}' for x in ('sentiment_score', 'highlight_score', *EMOTIONS[:5]))} FROM s")
def w7_weighted_metrics(spark, sf_dir):
    names = [m[4:] for m in _AVGS if m != "avg_neutral"]
    weighted = {m: F.col(f"avg_{m}") * F.col("message_count") for m in names}
    x = W.centered(chat_windows(spark, sf_dir), ["video_id"], ["start_time"], F.floor(F.col("start_time") / 3600), weighted)
    return x.select("video_id", _round("start_time", 6).alias("start_time"), *[_round(f"mean_{m}", 6).alias(f"mean_{m}") for m in names])


@query(f"""WITH a AS (SELECT *, count(*) OVER w AS n, avg(abs(rms)) OVER w AS m0 FROM ({A.FRAMES_SQL}) AS f WINDOW w AS (PARTITION BY video_id ORDER BY t, event_id ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING)), b AS (SELECT *, CASE WHEN n = 50 THEN m0 END AS m FROM a)
SELECT video_id, event_id, round(coalesce(m, first_value(m IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(m IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS loudness FROM b""")
def w11_loudness_smooth(spark, sf_dir):
    return W.loudness_smooth(A.frames(spark, sf_dir), ["video_id"], ["t", "event_id"], hour(), "rms").select("video_id", "event_id", _round("loudness", 6).alias("loudness"))


@query(f"WITH {_AUDIO}, k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(s, 9) DESC, seg) AS rank FROM (SELECT video_id, seg, 0.8e0 * highlight_score + 0.2e0 * {_TOP5} AS s FROM au) AS z) SELECT video_id, rank, seg, round(s, 6) AS score FROM k WHERE rank <= 10")
def t6_simple_top_highlights(spark, sf_dir):
    a = _sides(spark, sf_dir)[0]
    emo = F.greatest(*EMOTIONS[:5])
    s = a.select("video_id", "seg", F.round(U.weighted_highlight(F.col("highlight_score"), emo, F.col("sentiment_score"), F.lit(0.5), "simple"), 9).alias("s"))
    return W.top_k(s, ["video_id"], "s", 10, "seg").select("video_id", F.col("rank").cast("long").alias("rank"), "seg", _round("s", 6).alias("score"))


_LIVE = "(SELECT user_id % 10 AS video_id, ts, value, event_type, epoch_us(ts) // 1000 AS ms FROM events)"


def _live(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("video_id"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_type")


@query(f"SELECT video_id, CAST(ms // 30000 * 30 AS BIGINT) AS start_second, count(*) AS message_count, round(avg(value), 6) AS mean FROM {_LIVE} AS x GROUP BY 1, 2")
def r1_live_windows(spark, sf_dir):
    return r6(V.second(V.live_windows(_live(spark, sf_dir), "30 seconds")), "mean")


@query(f"SELECT video_id, CAST((ms // 30000 - k) * 30 AS BIGINT) AS start_second, count(*) AS message_count, round(avg(value), 6) AS mean FROM {_LIVE} AS x, (VALUES (0), (1)) AS o(k) GROUP BY 1, 2")
def r2_live_segments(spark, sf_dir):
    return r6(V.second(V.live_windows(_live(spark, sf_dir), "60 seconds", "30 seconds")), "mean")


@query(f"SELECT event_type, CAST(ms // 300000 * 300 AS BIGINT) AS start_second, count(*) AS n, max(value) AS most, CASE WHEN max(value) >= 60 THEN 'critical' WHEN max(value) >= 10 THEN 'warning' END AS level FROM {_LIVE} AS x GROUP BY 1, 2 HAVING max(value) >= 10")
def r5_live_alerts(spark, sf_dir):
    return V.second(V.live_alerts(_live(spark, sf_dir), "5 minutes", 10.0, 60.0))


@query(f"WITH a AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY video_id ORDER BY ms) < 3600000 THEN 0 ELSE 1 END AS n FROM {_LIVE} AS x), b AS (SELECT *, sum(n) OVER (PARTITION BY video_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT video_id, count(*) AS message_count, round(sum(value), 4) AS total FROM b GROUP BY video_id, g")
def r7_chat_bursts(spark, sf_dir):
    return V.chat_bursts(_live(spark, sf_dir), "60 minutes").select("video_id", "message_count", _round("total", 4).alias("total"))
