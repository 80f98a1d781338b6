"""Batch capture with profiles, and supersession links of a repository."""

import datetime as dt
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from loomtrace import jobs
from loomtrace.engine import Engine
from loomtrace.functions.text import timestamp_text
from loomtrace.operators import sessions as SE
from loomtrace.operators import supersession as SP
from loomtrace.operators.lake import Lake

A, B = "0000000a-0000-4000-8000-000000000000", "0000000b-0000-4000-8000-000000000000"


def line(uuid, text, kind="user"):
    return json.dumps({"uuid": uuid, "type": kind, "timestamp": "2024-03-01T10:00:00.500Z", "message": {"role": kind, "content": text}}) + "\n"


@pytest.fixture()
def home(tmp_path):
    root = tmp_path / "home"
    for path, text in {
        "projects/one/s1.jsonl": line("a", "the Needle") + line("b", "hay", "assistant"),
        "projects/one/s2.jsonl": line("c", "hay") + line("d", "needle cut short")[:60],
        "projects/one/inner/s9.jsonl": line("z", "needle"),
        "projects/two/s3.jsonl": line("e", "NEEDLE") + "{broken\n",
        "projects/two/s4.jsonl": "",
        "projects/two/sessions-index.json": json.dumps({"entries": [{"sessionId": "s3", "summary": "from the index", "messageCount": 7}]}),
        "projects/empty/notes.txt": "",
        "history.jsonl": "".join(json.dumps({"timestamp": i, "display": d, "sessionId": "s1", "project": "/p"}) + "\n" for i, d in enumerate(["a needle", "hay"])),
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


def test_all_projects(spark, home, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    done = jobs.ingest(lake, home)
    assert done["bytes"] > 0 and {k: v for k, v in done.items() if k != "bytes"} == {"sessions": 4, "projects": {"one": 2, "two": 2}, "records": 4, "history": 2, "types": {"user": 3, "assistant": 1}}
    assert {r.uuid for r in lake.table("records").collect()} == {"a", "b", "c", "e"}  # no inner folder, no line cut short
    assert lake.table("malformed_lines").count() == 1
    known = {r.session_id: (r.message_count, r.summary) for r in lake.table("sessions").collect()}
    assert known == {"s1": (2, None), "s2": (1, None), "s3": (7, "from the index"), "s4": (0, None)}
    again = jobs.ingest(lake, home)
    assert again["history"] == 0 and again["types"] == done["types"] and lake.table("malformed_lines").count() == 1


def test_filter_and_named_projects(spark, home, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    done = jobs.ingest(lake, home, content_filter="nEEdle")
    assert (done["projects"], done["history"]) == ({"one": 1, "two": 1}, 1)
    assert {r.uuid for r in lake.table("records").collect()} == {"a", "b", "e"}  # whole files, s1 and s3
    other = Lake(spark, str(tmp_path / "other"))
    assert jobs.ingest(other, home, ["two", "empty"], history=False)["projects"] == {"two": 2}
    assert other.table("history").count() == 0
    with pytest.raises(ValueError, match="nowhere"):
        jobs.ingest(other, home, ["nowhere"])
    nothing = jobs.ingest(Lake(spark, str(tmp_path / "third")), home, content_filter="not there at all")
    assert (nothing["sessions"], nothing["records"], nothing["types"]) == (0, 0, {})


def test_command_with_a_profile(spark, home, tmp_path, capsys):
    profiles, out = tmp_path / "profiles.toml", str(tmp_path / "lake")
    profiles.write_text(f'[mine]\nroot = "{home}"\noutput = "{out}"\nprojects = ["two"]\nfilter = "needle"\n[other]\nroot = "x"\n')
    assert jobs.main(["ingest", "--profiles", str(profiles), "--no-history", "mine"], spark) == 0
    shown = capsys.readouterr().out
    assert "two: 1 sessions" in shown and "1 sessions, 1 records, 0 history entries" in shown and "user: 1" in shown
    assert jobs.main(["ingest", "--profiles", str(profiles), "--projects", "one,two", "mine"], spark) == 0  # options go before the profile
    assert "2 sessions, 3 records, 1 history entries" in capsys.readouterr().out
    with pytest.raises(ValueError, match="mine, other"):
        jobs.load_profile(str(profiles), "none")
    with pytest.raises(SystemExit):
        jobs.main(["ingest", "--profiles", str(profiles), "other"], spark)  # no output


@pytest.fixture()
def repo(tmp_path):
    root = tmp_path / "repo"
    (root / "docs/decisions").mkdir(parents=True)
    (root / "docs/decisions/1.md").write_text(f"Session: {A}\n")
    (root / "docs/decisions/2.md").write_text(f"Session: {B}\nSupersedes: 1.md\n")
    run = lambda *args: subprocess.run(["git", "-C", str(root), "-c", "user.name=x", "-c", "user.email=x@example.com", *args], check=True, capture_output=True, text=True).stdout.strip()
    run("init", "-q")
    run("add", ".")
    run("commit", "-q", "-m", "first")
    sha = run("rev-parse", "HEAD")
    run("commit", "-q", "--allow-empty", "-m", f'Revert "first"\n\nThis reverts commit {sha}.')
    return str(root), sha, run("rev-parse", "HEAD")


def test_links_of_a_repository(spark, repo, tmp_path, capsys, monkeypatch):
    root, sha, newer = repo
    lake = Lake(spark, str(tmp_path / "lake"))
    links, added = jobs.link(lake, root, dry_run=True)
    assert added == 0 and lake.table("supersessions").count() == 0
    assert list(jobs.report(links)) == ["1 links between sessions", f"  {B} -> {A} [adr-supersedes]", "0 links between commits (no session's rank changes)"]
    monkeypatch.setattr(jobs, "LOG_PART", 7)  # parts end inside commits
    assert jobs.link(lake, root, reverts=True)[1] == 2 and jobs.link(lake, root, reverts=True)[1] == 0
    assert {(r.superseding_id, r.superseded_id) for r in lake.table("supersessions").collect()} == {(B, A), (newer, sha)}
    assert jobs.main(["link", root, "--lake", lake.root, "--dry-run", "--include-reverts"], spark) == 0
    assert f"  {newer} -> {sha} [git-revert]" in capsys.readouterr().out
    with pytest.raises(RuntimeError, match="git log"):
        jobs.link(lake, str(tmp_path / "lake"), reverts=True)
    assert jobs.link(lake, str(tmp_path / "nothing"))[1] == 0
    with pytest.raises(ValueError):
        SP.add_links(lake, spark.createDataFrame([(A, A, "x")], SP.LINK), 0)


def test_times_as_text_and_results_as_files(spark, tmp_path):
    moments = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 1, 2, 3, 500_000), dt.datetime(1969, 12, 31, 23, 59, 59, 1), None]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(moments)], "i int, m timestamp_ntz")
    assert [r.t for r in rows.orderBy("i").select(timestamp_text(F.col("m")).alias("t")).collect()] == [None if m is None else str(m) for m in moments]
    engine = Engine(spark, str(tmp_path / "lake"))
    path = tmp_path / "s1.jsonl"
    path.write_text(line("a", "x") + line("b", "y"))
    engine.refresh(str(path))
    assert [r.timestamp for r in SE.payload_rows(engine.get_session("s1")).collect()] == ["2024-03-01 10:00:00.500000"] * 2
    assert engine.query_to("SELECT uuid, parent_uuid FROM records", str(tmp_path / "out")) == 2
    assert sorted(r.uuid for r in spark.read.json(str(tmp_path / "out")).collect()) == ["a", "b"]
