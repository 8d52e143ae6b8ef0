"""File sources and sinks on small files, and live operators as streams against the same operators as batches."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from momentlens.sources import files
from momentlens.streaming import live


def test_chat_json(spark, tmp_path):
    comments = [{"content_offset_seconds": 1.5, "commenter": {"display_name": "u"}, "message": {"body": "hi"}}, {"content_offset_seconds": 2.0, "message": {"body": "no name"}}]
    (tmp_path / "1.json").write_text(json.dumps({"comments": comments, "video": {"id": "7", "duration": 9.0}}))
    assert [tuple(r) for r in files.read_chat_json(spark, str(tmp_path)).collect()] == [("7", 1.5, "u", "hi")]


def test_interval_csv(spark, tmp_path):
    (tmp_path / "words_42.csv").write_text(" start_time, end_time ,word\n0.5,1.0,a\n")
    want = {"start_time": "double", "end_time": "double", "word": "string"}
    assert [tuple(r) for r in files.read_interval_csv(spark, str(tmp_path), want).collect()] == [("42", 0.5, 1.0, "a")]
    with pytest.raises(Exception, match="columns missing"):
        files.read_interval_csv(spark, str(tmp_path), {"nope": "int"})


def test_transcript_text_falls_back(spark, tmp_path):
    ps = [{"start": 0.0, "end": 1.0, "text": "t"}, {"start": 1.0, "end": 2.0, "sentences": [{"text": "a."}, {"text": "b."}]}, {"start": 2.0, "end": 3.0}]
    words = [{"word": "a", "start": 0.0, "end": 0.4, "punctuated_word": "A,"}, {"word": "b", "start": 0.5, "end": 0.9}]
    doc = {"results": {"channels": [{"alternatives": [{"words": words, "paragraphs": {"transcript": "whole", "paragraphs": ps}}]}]}}
    (tmp_path / "t_5.json").write_text(json.dumps(doc))
    w, p = files.read_transcripts(spark, str(tmp_path))
    assert [r.word for r in w.orderBy("start_time").collect()] == ["A,", "b"]
    assert [r.text for r in p.orderBy("start_time").collect()] == ["t", "a. b.", "whole"]


def test_lexicon_and_segments(spark, tmp_path):
    assert [files.load_lexicon(spark, str(tmp_path / "none.csv"), k).count() for k in files.DEFAULT_LEXICONS] == [10, 10, 10]
    (tmp_path / "l.csv").write_text("emote,meaning\nPog ,wow\n")
    assert [tuple(r) for r in files.load_lexicon(spark, str(tmp_path / "l.csv")).collect()] == [("pog", "wow")]
    df = spark.createDataFrame([("x", 1, 0.0, 1.0, 0.5)], "text string, video_id int, start_time double, end_time double, score double")
    files.write_segments(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["start_time", "end_time", "score", "text", "video_id"]


def test_file_sizes_without_their_content(spark, tmp_path):
    for name, text in {"1_Words.csv": "ab", "1_Chat.csv": "é", "sub/2_Chat.json": "{}", "v.MP4": "x" * 10, "a.wav": "yy", "other.txt": "zzz"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.file_sizes(spark, str(tmp_path), files.ARTIFACT_NAMES)
    got = {r.path.rsplit("/", 1)[-1]: (r.kind, r.bytes) for r in found.collect()}
    assert got == {"1_Words.csv": ("words", 2), "1_Chat.csv": ("chat", 2), "2_Chat.json": ("json", 2), "v.MP4": ("video", 10), "a.wav": ("audio", 2), "other.txt": (None, 3)}
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()


def test_files_of_users_are_written_side_by_side(spark, monkeypatch):
    """Several tasks write, each user has one file, and its lines are in order of event_id."""
    from momentlens import catalog

    seen, real = [], files.file_sizes
    monkeypatch.setattr(files, "file_sizes", lambda s, path, *a, **k: seen.append(path) or real(s, path, *a, **k))
    sf = "/root/testdata/sf0.001"
    catalog.queries()["s7_file_sizes"](spark, sf)
    written = [p for p in Path(seen[0].removeprefix("file:")).rglob("*.txt") if p.is_file()]
    assert len({p.name.split("-")[1] for p in written}) > 1
    want = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").collect():
        want.setdefault(str(r.user_id), []).append(r.event_type)
    assert len(written) == len(want) and {p.parent.name.removeprefix("file=").split("-")[0]: p.read_text().splitlines() for p in written} == want


OPERATORS = {
    "tumbling": lambda d: live.live_windows(d, "6 hours"),
    "sliding": lambda d: live.live_windows(d, "12 hours", "6 hours"),
    "alerts": lambda d: live.live_alerts(d, "1 day", 10.0, 60.0, "video_id"),
    "bursts": lambda d: live.chat_bursts(d, "2 hours"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_streams_agree_with_batches(spark, tmp_path, name):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select((F.col("user_id") % 10).alias("video_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    src = str(tmp_path / "in")
    events.orderBy("ts").coalesce(1).write.parquet(src)
    # a last row far ahead moves the watermark over all windows
    stream = spark.readStream.schema(events.schema).parquet(src)
    q = OPERATORS[name](stream).writeStream.format("memory").queryName(f"live_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(map(str, r)) for r in spark.table(f"live_{name}").collect()}
    batch = OPERATORS[name](events)
    end = "session.end" if name == "bursts" else "window.end"
    passed = events.agg((F.max("ts") - F.expr(f"INTERVAL {live.LATENESS}")).alias("w"))
    # windows that the watermark has passed are emitted, others are still open
    closed = batch.crossJoin(passed).where(F.col(end) <= F.col("w")).drop("w")
    want = {tuple(map(str, r)) for r in closed.collect()}
    assert got and got == want
