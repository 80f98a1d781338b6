"""Supersession evidence in markdown artifacts and git logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payload import text_udf, without_code

# Fixed patterns of the citation contract.
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
CITATION = r"(?i)session(?:[-\s]of[-\s]record)?\s*[:=]?\s*(" + UUID + ")"
SUPERSEDED_BY = r"(?i)superseded[-\s]by\s*[:=]?\s*(\S+)"
SUPERSEDES = r"(?i)\bsupersedes\s*[:=]?\s*(\S+)"
REVERTED = r"(?i)This reverts commit ([0-9a-f]{7,40})"
FOLDERS = (("docs/decisions", "adr-supersedes"), ("docs/labbook", "labbook-supersedes"))


def clean_ref(ref: Column) -> Column:
    """The target of a markdown link, without quotes and punctuation around it."""
    target = F.when(ref.rlike(r"\[[^\]]*\]\([^)]+\)"), F.regexp_extract(ref, r"\[[^\]]*\]\(([^)]+)\)", 1)).otherwise(ref)
    return F.regexp_replace(F.trim(target), r"""^[`'"<>()\[\].,;:]+|[`'"<>()\[\].,;:]+$""", "")


def ref_keys(cleaned: Column) -> Column:
    """Path, file name and stem."""
    name = F.element_at(F.split(F.replace(cleaned, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.array_distinct(F.array(cleaned, name, F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")))


def session_ids(text: Column) -> Column:
    """Uuids cited as a session, lower-case, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)), F.lower))


def parse_artifacts(files: DataFrame) -> DataFrame:
    """X31. files: path, source, content."""
    plain = files.withColumn("content", text_udf(without_code)(F.col("content")))
    refs = lambda pattern: F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), clean_ref)
    return plain.select("path", "source", session_ids(F.col("content")).alias("session_ids"), refs(SUPERSEDED_BY).alias("superseded_by"), refs(SUPERSEDES).alias("supersedes"))


def scan_artifacts(spark: SparkSession, repo: str, folders: Sequence[tuple[str, str]] = FOLDERS) -> DataFrame:
    """Markdown files of a repository's folders, templates left out."""
    out = None
    for folder, source in folders:
        path = f"{repo.rstrip('/')}/{folder}"
        try:
            texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
        except Exception as error:  # the folder need not exist
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        relative = F.concat(F.lit(folder), F.element_at(F.split(F.input_file_name(), folder), -1))
        rows = texts.select(relative.alias("path"), F.lit(source).alias("source"), F.col("value").alias("content")).where(~F.col("path").endswith("/template.md"))
        out = rows if out is None else out.unionByName(rows)
    return parse_artifacts(out if out is not None else spark.createDataFrame([], "path string, source string, content string"))


def resolve_links(artifacts: DataFrame) -> DataFrame:
    """Links between sessions. A reference is a session id or names an artifact by path,
    name or stem (of several the greatest path counts); unresolved references and links of a
    session to itself are dropped."""
    keys = artifacts.select("path", "session_ids", F.explode(ref_keys(clean_ref(F.col("path")))).alias("key"))
    index = keys.groupBy("key").agg(F.max_by("session_ids", "path").alias("found"))
    sides = [artifacts.select("source", "session_ids", F.lit(newer).alias("newer"), F.explode(c).alias("ref")) for c, newer in (("superseded_by", False), ("supersedes", True))]
    refs = sides[0].unionByName(sides[1]).where("ref != ''").withColumn("id", F.monotonically_increasing_id())
    direct = refs.where(F.col("ref").rlike(f"^{UUID}$")).withColumn("others", F.array(F.lower("ref")))
    named = refs.where(~F.col("ref").rlike(f"^{UUID}$")).select("*", F.posexplode(ref_keys(F.col("ref"))).alias("place", "key")).join(index, "key").groupBy("id", "source", "newer", "session_ids").agg(F.min_by("found", "place").alias("others"))
    columns = ["source", "newer", "session_ids", "others"]
    pairs = direct.select(columns).unionByName(named.select(columns)).select("source", "newer", F.explode("session_ids").alias("own"), "others").select("source", "newer", "own", F.explode("others").alias("other"))
    return pairs.select(F.when(F.col("newer"), F.col("own")).otherwise(F.col("other")).alias("superseding_id"), F.when(F.col("newer"), F.col("other")).otherwise(F.col("own")).alias("superseded_id"), "source").where("superseding_id != superseded_id").distinct()


def git_reverts(log: DataFrame) -> DataFrame:
    """X32, S18. log: ``value``, one commit each (``sha 0x1f message``), for instance read with
    ``spark.read.text(path, lineSep="\\x1e")``."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")  # noqa: E731  # commits are parted by line breaks, too
    cut = log.select(F.split(bare(F.col("value")), "\x1f", 2).alias("c")).where(F.size("c") == 2).select(bare(F.get("c", F.lit(0))).alias("sha"), F.get("c", F.lit(1)).alias("message"))
    found = cut.where(F.col("message").rlike(r"(?m)^Revert ")).select(F.col("sha").alias("superseding_id"), F.explode(F.regexp_extract_all("message", F.lit(REVERTED), F.lit(1))).alias("superseded_id"))
    return found.where("superseding_id != '' and superseding_id != superseded_id").select("*", F.lit("git-revert").alias("source")).distinct()


def describe_links(links: DataFrame) -> DataFrame:
    """One line per link, in order."""
    return links.orderBy("superseding_id", "superseded_id", "source").select(F.concat("superseding_id", F.lit(" -> "), "superseded_id", F.lit(" ["), "source", F.lit("]")).alias("line"))
