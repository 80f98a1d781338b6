"""Capture, blobs, upkeep and retrieval over small files."""

import json

import pytest
from pyspark.sql import functions as F

from loomtrace.engine import Engine
from loomtrace.functions import payload as P
from loomtrace.operators import retrieval as R
from loomtrace.operators import sessions as SE
from loomtrace.sources.jsonl import complete_end, project_dirs, read_history, read_session_index
from loomtrace.streaming.capture import keep_up, should_rebuild, sweep, watch


def line(uuid=None, session="s1", kind="user", text="hello", at="2024-03-01T10:00:00.000Z", **more):
    row = {"sessionId": session, "type": kind, "timestamp": at, "message": {"role": kind, "content": text}, **more}
    return json.dumps({"uuid": uuid, **row} if uuid else row)


def nine_lines():
    """Four ids (one with a long text), three lines without, one cut short, one repeated id."""
    return [line("a"), line("b", text="x" * 150_000), line("c", kind="assistant"), line("d"), line(text="one"), line(text="two"), line(text="three"), '{"uuid": "e", "mess', line("a", text="again")]


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "lake"))


def test_every_line_is_accounted_for(engine, tmp_path):
    path = tmp_path / "p" / "s1.jsonl"
    path.parent.mkdir()
    path.write_text("\n".join(nine_lines()) + "\n")
    assert engine.refresh(str(path)) == 8
    records, bad = engine.lake.table("records"), engine.lake.table("malformed_lines")
    assert (records.count(), bad.count()) == (7, 1)
    assert bad.first().byte_offset == len("\n".join(nine_lines()[:7])) + 1
    assert engine.refresh(str(path)) == 0  # from the recorded offset
    with path.open("a") as out:
        out.write(line("f") + "\n" + line("g")[:20])
    assert engine.refresh(str(path)) == 1
    with path.open("a") as out:
        out.write(line("g")[20:] + "\n")
    assert engine.refresh(str(path)) == 1
    assert records.count() == 7 and engine.lake.table("records").count() == 9
    kept = engine.lake.table("records").where("uuid = 'a'").first()
    assert json.loads(kept.raw)["message"]["content"] == "hello" and kept.raw == line("a")
    # the long text is a blob, found again in the session
    assert engine.lake.table("blobs").count() == 1 and engine.lake.table("blob_meta").first().original_size == 150_000
    blob = json.loads(engine.query("SELECT length(read_blob(file_id)) AS n FROM blob_meta"))
    assert blob == [{"n": 150_000}]
    session = engine.get_session("s1").collect()
    assert len(json.loads(next(r.raw for r in session if r.uuid == "b"))["message"]["content"]) == 150_000
    meta = engine.lake.table("sessions").where("session_id = 's1'").first()
    assert meta.message_count == 9 and meta.first_prompt == "hello"


def test_offsets_inside_lines(tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_bytes(b'{"a":1}\n{"b":2}\r\n{"c"')
    assert complete_end(str(path)) == 17
    path.write_bytes(b'{"c"')
    assert complete_end(str(path)) == 0


def test_byte_ranges_cover_each_line_once(spark, tmp_path):
    from loomtrace.sources.jsonl import read_lines

    path = tmp_path / "many.jsonl"
    path.write_text("".join(f'{{"n":{i},"pad":"{"y" * (i % 37)}"}}\n' for i in range(500)))
    for split in (50, 997, 1 << 20):
        rows = read_lines(spark, str(path), split_bytes=split).collect()
        assert sorted(json.loads(r.line)["n"] for r in rows) == list(range(500))
        assert len({r.byte_offset for r in rows}) == 500


@pytest.mark.parametrize("text,valid", [('{"a": NaN}', True), ('{"a":1,"a":2}', True), ('{"a":1} trailing', False), ("{'a':1}", False), ('[{"a":1}]', False), ("7", False)])
def test_validity_is_that_of_json_loads(text, valid):
    assert P.parse_line(text)[0] is valid


def test_content_text():
    content = [{"type": "text", "text": "a"}, {"type": "tool_use", "name": "ls", "input": {}}, {"type": "tool_result", "content": [{"type": "text", "text": "b"}]}, 3]
    assert P.content_text(content) == "a\n[tool_use: ls]\nb"
    assert P.record_text(json.dumps({"message": {"role": "user", "content": content}})).startswith("user: a")
    assert P.record_text("[]") == "" and P.record_text('{"message": {"role": "user", "content": 5}}') == "user"


def test_fallback_summary_is_shorter_and_longest():
    for n in (2, 5, 30, 200):
        text = "word " * 500
        out = P.fallback_summary(text, n)
        assert 0 < P.tokens_of(out) < n
    assert P.fallback_summary("  ", 5) == "" and P.fallback_summary("abc", 1) == "a"


def test_summaries_and_context(engine, tmp_path):
    path = tmp_path / "s9.jsonl"
    path.write_text("".join(line(f"u{i:03d}", "s9", "user" if i % 2 else "assistant", f"text {i} " * 20, f"2024-03-01T10:{i % 60:02d}:00Z") + "\n" for i in range(50)))
    engine.refresh(str(path))
    made = engine.summarize(1000)
    assert made == {"sprigs_created": 2, "bindles_created": 0, "unsummarized_remaining": 10}
    assert [r.section for r in engine.context("s9").collect()] == ["sprig"] * 2 + ["tail"] * 10
    assert engine.summarize(2000)["sprigs_created"] == 0


def test_retrieval_prefers_what_is_current(engine, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join([line("old", "s1", text="the zebra crossing plan"), line("new", "s2", text="the zebra crossing plan"), line("x", "s3", text="nothing at all")]) + "\n")
    engine.refresh(str(path))
    assert engine.sync()["record_embeddings"] == 3 and engine.backfill()["record_embeddings"] == 0
    now = 1_709_290_000_000
    assert engine.add_supersession([("s2", "s1", "adr")], 1) == 1
    assert engine.add_supersession([("s2", "s1", "adr")], 2) == 0
    with pytest.raises(ValueError):
        engine.add_supersession([("a", "b", "x"), ("c", "c", "x")], 3)
    hits = engine.retrieve_relevant("zebra plan", now_ms=now).collect()
    assert [h.id for h in hits][0] == "new" and next(h for h in hits if h.id == "old").superseded
    assert "error" in json.loads(engine.query("SELECT nope FROM records"))
    assert json.loads(engine.query("SELECT count(*) AS n FROM records")) == [{"n": 3}]
    found = engine.retrieve_relevant("zebra plan", now_ms=now)
    text = R.format_injection(found)
    scores = {h.id: f"{h.final_score:.2f}" for h in hits}
    assert text.splitlines()[1:] == [f"- (session s2 {scores['new']}) the zebra crossing plan", *sorted([f"- (session s3 {scores['x']}) nothing at all", f"- (session s1 {scores['old']} [superseded]) the zebra crossing plan"], key=lambda x: (next(i for i, h in enumerate(hits) if h.session_id in x)))]
    assert R.format_injection(found.where("false")) is None


def test_stream_picks_up_growth(spark, engine, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text(line("a") + "\n")
    for n in (1, 2):
        query = watch(spark, engine.lake, str(folder), str(tmp_path / "cp"), {"availableNow": True})
        query.awaitTermination()
        assert engine.lake.table("records").count() == n
        with (folder / "a.jsonl").open("a") as out:
            out.write(line(f"more{n}") + "\n")


def test_history_index_and_projects(spark, tmp_path):
    path = tmp_path / "history.jsonl"
    path.write_text('{"timestamp":1,"display":"Hi","sessionId":"s","project":"p"}\nnot json\n\n{"timestamp":1,"display":"Hi","sessionId":"s","project":"p"}\n{"timestamp":2,"display":"yo","sessionId":"s","project":"q"}\n')
    assert read_history(spark, str(path)).count() == 2 and read_history(spark, str(path), "hi").count() == 1
    assert read_history(spark, str(tmp_path / "none.jsonl")).count() == 0
    for d, summary in (("p1", "old"), ("p2", "new")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "sessions-index.json").write_text(json.dumps({"entries": [{"sessionId": "s", "summary": summary, "messageCount": 3}]}))
    assert read_session_index(spark, [str(tmp_path / "p1"), str(tmp_path / "p2")]).first().summary == "new"
    assert len(project_dirs(str(tmp_path), "*")) == 2
    for bad in (["p3"], "p1", 4):
        with pytest.raises(ValueError):
            project_dirs(str(tmp_path), bad)


def test_policies_and_guards(engine):
    assert should_rebuild(True, 0, 5.0, 6.0) and not should_rebuild(False, 0, None, 6.0) and should_rebuild(False, 1, None, 6.0)
    assert not should_rebuild(False, 1, 5.0, 6.0) and should_rebuild(False, 1, 5.0, 6.0, throttled=False)
    with engine.lake.single_flight("sweep") as mine:
        assert mine and sweep(engine.lake, engine.embedder)["status"] == "already_running"
    assert engine.lake.migrate() and not engine.lake.migrate()
    assert "records(" in engine.lake.describe()


def test_snapshot_survives_a_failed_write(spark, engine):
    assert engine.lake.replace("record_fts", spark.createDataFrame([("a", "t")], "uuid string, text string")) == 1
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("uuid"), F.lit("t").alias("text"))
    with pytest.raises(Exception):
        engine.lake.replace("record_fts", broken)
    assert engine.lake.table("record_fts").count() == 1


def test_session_text(spark):
    rows = spark.createDataFrame([("u", "user", None, json.dumps({"message": {"role": "user", "content": "hi"}}))], "uuid string, type string, timestamp timestamp_ntz, raw string")
    assert SE.session_text(rows, "s") == "# Session s\n\n## user\n\nuser: hi"


def test_stream_of_files_that_shrink_or_end_in_a_line(spark, engine, tmp_path):
    folder = tmp_path / "in" / "project"
    folder.mkdir(parents=True)
    file = folder / "a.jsonl"

    def run():
        watch(spark, engine.lake, str(tmp_path / "in"), str(tmp_path / "cp"), {"availableNow": True}).awaitTermination()
        return sorted(r.uuid for r in engine.lake.table("records").collect())

    file.write_text(line("a") + "\n" + line("b") + "\n" + line("c")[:30])
    assert run() == ["a", "b"]
    with file.open("a") as out:
        out.write(line("c")[30:] + "\n")
    (folder / "b.jsonl").write_text(line("d", "s4") + "\n")
    (folder / "deep").mkdir()
    (folder / "deep" / "x.jsonl").write_text(line("hidden") + "\n")
    assert run() == ["a", "b", "c", "d"]
    file.write_text(line("e") + "\n")  # shorter than what was read of it
    (folder / "sessions-index.json").write_text(json.dumps({"entries": [{"sessionId": "s1", "summary": "indexed"}]}))
    assert run() == ["a", "b", "c", "d", "e"]
    assert engine.lake.table("sessions").where("session_id = 's1'").first().summary == "indexed"
    assert run() == ["a", "b", "c", "d", "e"]


def flaky(mark):
    """An embedder that fails until it is mended: a mark in a file, since tasks have their own copy."""

    class Flaky:
        def embed(self, texts):
            import os

            if not os.path.exists(mark):
                raise RuntimeError("the model is gone")
            return [[1.0, 2.0] for _ in texts]

    return Flaky()


def test_sweeps_go_on_after_a_failed_pass(spark, engine, tmp_path):
    import time

    path = tmp_path / "s1.jsonl"
    path.write_text(line("a") + "\n" + line("b") + "\n")
    engine.refresh(str(path))
    mark = tmp_path / "mended"
    query = keep_up(spark, engine.lake, flaky(str(mark)), str(tmp_path / "cp"), {"processingTime": "1 second"})
    try:
        passes = lambda: engine.lake.table("sweeps").orderBy("began_ms").collect()
        until = time.time() + 240
        while not passes() and time.time() < until:
            time.sleep(0.5)
        with path.open("a") as out:
            out.write(line("c") + "\n")
        engine.refresh(str(path))
        mark.write_text("")
        while len([p for p in passes() if p.status == "done"]) < 2 and time.time() < until:
            time.sleep(0.5)
        assert query.isActive
    finally:
        query.stop()
    rows = passes()
    done = [p for p in rows if p.status == "done"]
    assert rows[0].status == "failed" and "gone" in rows[0].error
    assert [p.embedded for p in done[:2]] == [3, 0] and [p.fts for p in done[:2]] == [3, None]  # throttled, nothing new
    assert engine.lake.table("record_embeddings").count() == 3
