"""Jobs for ``spark-submit`` or ``python -m loomtrace.jobs``: capture of a whole folder of transcripts
(C14, K8) and supersession links of a repository (D10)."""

from __future__ import annotations

import argparse
import subprocess
import time
import tomllib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import sessions, supersession
from .operators.lake import Lake
from .session import build_session
from .sources import artifacts
from .sources.files import Files, shared_folder
from .sources.jsonl import lines_of, project_dirs, read_history, read_session_index, stem, transcript_ranges
from .streaming import capture

#: A log's commits, parted as ``artifacts.git_reverts`` reads them.
LOG_FORMAT = "%H%x1f%B%x1e"
LOG_PART = 16 << 20


def load_profile(path: str, name: str) -> dict:
    """A named table of a TOML file; an unknown name is an error that lists the known ones."""
    with open(path, "rb") as source:
        profiles = tomllib.load(source)
    if name not in profiles:
        raise ValueError(f"no profile {name!r}; there are: {', '.join(sorted(profiles))}")
    return profiles[name]


def ingest(lake: Lake, root: str, projects: str | Sequence[str] = "*", content_filter: str | None = None, history: bool = True) -> dict:
    """C14: capture the projects below ``root``/projects, files as a whole if a complete line of them holds
    the filter, and ``root``/history.jsonl. Each file's session gets metadata, even without a record.
    Running it again adds nothing. What was done: sessions (all, and by project), records (seen), history
    (added), types (records of the lake) and bytes (of the lake).

    Tasks list the folders, look for the filter and read; the driver holds the projects' names."""
    spark = lake.spark
    folders = project_dirs(f"{root}/projects", projects)
    ranges = transcript_ranges(spark, folders)
    if content_filter:
        ranges = ranges.join(sessions.files_holding(lines_of(ranges, root), content_filter), "file_path", "left_semi")
    ranges = ranges.persist()
    index = read_session_index(spark, folders)
    seen = capture.capture(lake, lines_of(ranges, root), index=index)["seen"]
    own = ranges.select(stem(F.col("file_path")).alias("session_id")).distinct()
    bare = own.join(lake.table("sessions").select("session_id"), "session_id", "left_anti").persist()
    lake.insert("sessions", sessions.session_metadata(bare, index, lake.rows_by("records", bare)))
    by_project = ranges.groupBy(F.element_at(F.split("file_path", "/"), -2).alias("project")).count().orderBy("project").collect()  # a row a project
    added = lake.insert("history", read_history(spark, f"{root}/history.jsonl", content_filter)) if history else 0
    types = {r.type: r.n for r in sessions.count_by_type(lake.table("records")).collect()}
    bare.unpersist()
    ranges.unpersist()
    return {"sessions": sum(r["count"] for r in by_project), "projects": {r.project: r["count"] for r in by_project}, "records": seen, "history": added, "types": types, "bytes": lake.files.size(lake.root)}


def read_git_log(spark: SparkSession, repo: str) -> DataFrame:
    """The log of a repository on the driver's machine, a row a commit. It is written in parts to the
    shared folder while git puts it out, so the driver holds one part."""
    folder, files = shared_folder(spark, "git-log"), Files(spark)
    with subprocess.Popen(["git", "-C", repo, "log", f"--format={LOG_FORMAT}"], stdout=subprocess.PIPE) as git:
        held, n = b"", 0
        while block := git.stdout.read(LOG_PART):
            whole, mark, rest = (held + block).rpartition(b"\x1e")
            held = rest
            if mark:
                files.put_new(f"{folder}/part-{n:05d}", whole.decode("utf-8", "replace"))
                n += 1
    if git.returncode:
        raise RuntimeError(f"git log of {repo} ended with {git.returncode}")
    return spark.read.text(folder, lineSep="\x1e") if n else spark.createDataFrame([], "value string")


def link(lake: Lake, repo: str, *, dry_run: bool = False, reverts: bool = False, log: str | None = None, created_ms: int | None = None) -> tuple[DataFrame, int]:
    """The links that a repository's artifacts state, and how many were new to the lake (0 in a dry
    run, which writes nothing). With ``reverts`` those of its git log, too, from ``log`` if the log was
    exported there; they name commits, so no session's rank changes. The links are kept in the shared
    folder: what is shown is what is written."""
    spark = lake.spark
    found = artifacts.resolve_links(artifacts.scan_artifacts(spark, repo))
    if reverts:
        commits = spark.read.text(log, lineSep="\x1e") if log else read_git_log(spark, repo)
        found = found.unionByName(artifacts.git_reverts(commits))
    folder = shared_folder(spark, "links")
    found.write.parquet(folder)
    found = spark.read.schema(found.schema).parquet(folder)
    return found, 0 if dry_run else supersession.add_links(lake, found, created_ms or int(time.time() * 1000))


def report(links: DataFrame) -> Iterator[str]:
    """Lines that show links in order, those between sessions first."""
    revert = F.col("source") == "git-revert"
    for title, rows in (("links between sessions", links.where(~revert)), ("links between commits (no session's rank changes)", links.where(revert))):
        yield f"{rows.count()} {title}"
        yield from (f"  {r.line}" for r in artifacts.describe_links(rows).toLocalIterator())


def _arguments(args: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="loomtrace.jobs")
    jobs = parser.add_subparsers(dest="job", required=True)
    one = jobs.add_parser("ingest", help="capture projects of transcripts into a lake")
    one.add_argument("profile", nargs="?", help="a table of the file of profiles; options go before it")
    one.add_argument("--profiles", help="TOML file of profiles: output, root, projects, filter, include_history")
    one.add_argument("--root", help="folder with projects/ and history.jsonl")
    one.add_argument("--projects", help="* or names with commas between")
    one.add_argument("--filter", help="only files that hold this text")
    one.add_argument("--output", help="folder of the lake")
    one.add_argument("--no-history", action="store_true")
    two = jobs.add_parser("link", help="supersession links of a repository")
    two.add_argument("repo")
    two.add_argument("--lake", required=True)
    two.add_argument("--dry-run", action="store_true", help="show the links, write nothing")
    two.add_argument("--include-reverts", action="store_true")
    two.add_argument("--log", help="an exported git log, commits parted by 0x1e")
    found = parser.parse_args(args)
    if found.job == "ingest":
        if found.profile and not found.profiles:
            parser.error("a profile needs --profiles")
        held = load_profile(found.profiles, found.profile) if found.profile else {}
        found.projects = held.get("projects", "*") if found.projects is None else found.projects if found.projects == "*" else found.projects.split(",")
        found.filter = found.filter if found.filter is not None else held.get("filter")
        found.output, found.root = found.output or held.get("output"), found.root or held.get("root")
        found.history = not found.no_history and held.get("include_history", True)
        if not found.output or not found.root:
            parser.error("--output and --root are needed, here or in the profile")
    return found


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    given = _arguments(args)
    spark = spark or build_session()
    if given.job == "ingest":
        done = ingest(Lake(spark, given.output), given.root, given.projects, given.filter, given.history)
        for project, n in done["projects"].items():
            print(f"  {project}: {n} sessions")
        print(f"{done['sessions']} sessions, {done['records']} records, {done['history']} history entries")
        for kind, n in done["types"].items():
            print(f"  {kind}: {n}")
        print(f"{done['bytes'] / (1 << 20):.1f} MB in {given.output}")
        return 0
    links, added = link(Lake(spark, given.lake), given.repo, dry_run=given.dry_run, reverts=given.include_reverts, log=given.log)
    for line in report(links):
        print(line)
    if not given.dry_run:
        print(f"{added} links are new")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
